"""Claims out of text files, configuration files and pages: lines, patterns and window functions, no Python at run time but for JSON.

Every reader takes a table of contents (path, content) such as ``spark.read.format("binaryFile")`` gives after a cast, so fetching stays outside.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import values as V

#: Beginnings of headings that reset the section of a document. Fixed values.
PLAIN_HEADINGS = [
    "overview", "introduction", "getting started", "summary", "table of contents", "notes", "appendix", "prerequisites", "requirements", "runtime requirements", "deployment profile",
    "deployment requirements", "technology stack", "service configuration", "configuration", "specifications", "specs", "monitoring", "security", "hardware requirements",
]
#: Keys of direct lines that hold no fact. Fixed values.
LABEL_WORDS = "specification property setting key parameter attribute"
#: Units that a long value is cut down to. Fixed values.
_SIZES = "gb|mb|tb|kb|g|m|b|ms|s|sec|seconds|minutes|hours"
#: Rules for statements in prose, in order: key, pattern with the value as its first group. Fixed values.
PROSE_RULES = [
    ("min_memory", r"(?:requires|minimum|needs|min|memory\s+is|ram\s+is|memory:?|ram:?)\s*(?:at\s+least)?\s*(\d+(?:\.\d+)?\s*(?:gb|mb|tb|kb|g|m|b))\s*(?:of\s+)?(?:ram|memory)?"),
    ("port", r"(?:runs|listens|hosted|serves|serving|started)\s+(?:on|at)\s+(?:http\s+)?port\s+(\d{2,5})"),
    ("node_version", r"(?:requires|using|uses|built\s+with|runtime\s+is)?\s*(?:node|node\.js|nodejs)\s+(?:version\s+)?([v=~^><\d.]+)"),
    ("python_version", r"(?:requires|using|uses)?\s*(?:python|python3)\s+(?:version\s+)?([v=~^><\d.]+)"),
    ("db_engine", r"(?:database|db|datastore)\s+(?:is|engine\s+is|backend\s+is|type\s+is|using|uses)\s+(postgres|postgresql|mysql|sqlite|redis|mongodb|mariadb)"),
    ("timeout", r"(?:timeout|deadline)\s+(?:is|of|set\s+to)\s*(\d+(?:\.\d+)?\s*(?:ms|s|sec|seconds|m|min|minutes))"),
    ("max_users", r"(?:max|maximum|limit|capacity\s+of)\s*(\d+)\s*(?:concurrent\s+)?(?:users|connections|clients|workers)"),
    ("license", r"(?:licensed?\s+under|license:?)\s*(?:the\s+)?(MIT|Apache(?:-2\.0)?|BSD|GPL|ISC|Proprietary)(?![A-Za-z0-9_])"),
    ("commercial_use", r"(?:commercial\s+use\s+(?:is\s+)?(strictly\s+prohibited|forbidden|prohibited|not\s+allowed|allowed|permitted))"),
    ("configuration_required", r"(?<![A-Za-z0-9_])(zero[- ]configuration|no\s+configuration\s+required)(?![A-Za-z0-9_])"),
    ("configuration_files_count", r"requires\s+(\d+)\s+(?:yaml|configuration|config)\s+files"),
]
#: The same for pages. Fixed values.
PAGE_RULES = [
    ("minimum_ram", r"(?:requires|minimum|needs)\s*(?:at\s+least)?\s*(\d+(?:\.\d+)?\s*(?:gb|mb|tb))\s*(?:of\s+)?(?:ram|memory)"),
    ("port", r"(?:runs|listens)\s+on\s+port\s+(\d{2,5})"),
    ("node_version", r"(?:requires\s+)?(?:node|node\.js|nodejs)\s+(?:version\s+)?([v=~^><\d.]+)"),
    ("python_version", r"(?:requires\s+)?(?:python|py)\s+(?:version\s+)?([v=~^><\d.]+)"),
    ("database", r"(?:uses|requires|backend)\s+(?:database\s+)?(postgres|postgresql|mysql|sqlite|redis|mongodb)"),
]

#: First cells of table rows that hold no fact. Fixed values.
TABLE_WORDS = "property setting key parameter attribute specification requirement requirements component minimum recommended default description notes feature variable option name field spec"
#: Dependencies of a package file that give claims. Fixed values.
DEPENDENCIES = {
    "typescript": "typescript_version", "react": "react_version", "next": "next_version", "express": "express_version", "@modelcontextprotocol/sdk": "mcp_sdk_version",
    "@modelcontextprotocol/server": "mcp_server_version", "@modelcontextprotocol/client": "mcp_client_version",
}
#: Patterns of pages, container files and workflows, and the character references that are decoded, in this order. Fixed values.
_HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>"
_ROW, _CELL = r"(?is)<tr\b[^>]*>(.*?)</tr>", r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "))
BASE_IMAGES = "node python postgres"
_FROM, _EXPOSE = r"(?i)^FROM\s+(?:--platform=\S+\s+)?([a-zA-Z0-9_./-]+)(?::([a-zA-Z0-9_.-]+))?", r"(?i)^EXPOSE\s+(\d{2,5})"
_NODE, _RUNNER = r"""(?i)node-version:\s*(?:\[([^\]]+)\]|['"]?([0-9.x]+)['"]?)""", r"(?i)runs-on:\s*([a-zA-Z0-9_.-]+)"

#: Patterns of Markdown, README files, scripts and badges. Fixed values.
_TABLE_RULE = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$"
_TABLE_ROW = r"^\s*\|.*\|\s*$"
_DIRECT = r"^\s*(?:[-*+]|\d+\.)?\s*(?:\*{1,2}|`|__)?([a-zA-Z0-9_\s.-]{2,50}?)(?:\*{1,2}|`|__)?\s*[:=]\s*(?:\*{1,2}|`|__)?([^\r\n#]{1,160}?)(?:\*{1,2}|`|__)?(?:\s+#.*)?$"
_LICENSE = r"(?i)licensed\s+under\s+the\s+([A-Za-z0-9.\-]+)"
_SCRIPT_PORT = r"(?i)(?:--port\s+|PORT=)(\d{2,5})"
_README_NODE = r"(?i)(?:(?:requires?|prerequisites?|built with|runs on)\s+)?node(?:\.js)?\s*(?:version)?\s*[:=~^>=<]*\s*([vV]?\d+(?:\.\d+)*)"
_README_PORT = r"(?i)(?:default\s+port|(?:runs?|running|listening|server)\s+(?:on\s+)?port|port\s*:)\s*[:=]?\s*(\d{2,5})(?![A-Za-z0-9_])"
_README_OLD = r"previously|deprecated|former|legacy|dropped\s+support|used\s+to"
_README_SHOWN = r"for\s+example|e\.g\.|sample|tutorial|docker\s+run"
_PAGE_DIRECT = r"^\s*[-*•]?\s*(?:\*{1,2}|`|__)?([a-zA-Z0-9_\s.-]{2,50}?)(?:\*{1,2}|`|__)?\s*[:=]\s*(?:\*{1,2}|`|__)?([^\r\n#]{1,160}?)(?:\*{1,2}|`|__)?(?:\s+#.*)?$"
_BADGE = r"(?i)!\[([^\]]*)\]\((https?://[^\s)]*(?:shields\.io/badge/|github\.com/[^\s)]*/badge\.svg|[a-z0-9_-]+-badge)[^\s)]*)\)"


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line with its number from 1."""
    return files.select("*", F.posexplode(F.split(content, r"\r?\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).drop("pos", content)


def key_form(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(T.trimmed(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def data_key(x: Column) -> Column:
    """:func:`key_form`; a key without any letter or digit of it keeps its underscores, so that it is not empty."""
    return F.when(key_form(x) != "", key_form(x)).otherwise(T.predicate_form(T.trimmed(x)))


# Patterns of single values. ``(?<![A-Za-z0-9_])`` and ``(?![A-Za-z0-9_])`` stand for an ASCII word boundary.
_ADDRESS = r"^\d{1,3}(\.\d{1,3}){3}(:\d+)?(/\d+)?$|^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$|^::1$|^localhost$"
_PLAIN_VERSION = r"^v\d+(\.\d+)*(-[A-Za-z0-9_]+)?$|^(>=|<=|>|<|=)\s*\d+"
_DOTTED_VERSION = r"^\^?~?[v=]?\d+\.\d+(\.\d+)*(-[A-Za-z0-9_]+)?$"
_MONEY = r"[$€£¥₹]|(?i)(?<![A-Za-z0-9_])(INR|USD|EUR|GBP|JPY|CAD|AUD)(?![A-Za-z0-9_])"
_DATE = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|^\d{1,2}[/.-]\d{1,2}[/.-]\d{4}"
_AMOUNT = r"^[-+]?[\d,]+(\.\d+)?\s*(b|bytes?|kb|kib|ki|k|mb|mib|mi|m|gb|gib|gi|g|tb|tib|ti|t|ms|milliseconds?|s|sec|seconds?|min|minutes?|h|hr|hours?|d|days?)?$"


def value_type(predicate: Column, value: Column) -> Column:
    """Type tag of a single value; the first rule that holds decides."""
    p, v = F.lower(T.trimmed(F.coalesce(predicate, F.lit("")))), F.lower(T.trimmed(F.coalesce(value, F.lit(""))))
    holds = lambda words: p.rlike("|".join(words.split()))
    address = v.rlike(_ADDRESS)
    return (
        F.when(address | p.rlike("host|ip_address|bind_address|^ip$|^address$|_ip$"), "address")
        .when(holds("version release semver") | v.rlike(_PLAIN_VERSION) | v.rlike(_DOTTED_VERSION) & (holds("node python ruby go java runtime ver") | v.rlike("^[~^v=]")), "version")
        .when(holds("price cost fee budget") | v.rlike(_MONEY), "price")
        .when(holds("date deadline expires expiry") | v.rlike(_DATE), "date")
        .when(holds("port ram memory cpu timeout ttl count limit capacity max_ min_") | v.rlike(_AMOUNT), "quantity")
        .when(holds("status state enabled disabled") | v.isin("true false yes no enabled disabled on off".split()), "status")
        .when(holds("policy rule"), "policy").when(holds("requirement prerequisite"), "requirement").otherwise("configuration")
    )


def source_key(kind: Column, identifier: Column) -> Column:
    """Stable external id of a source: ``type:identifier``."""
    return F.concat_ws(":", F.lower(T.trimmed(kind)), _slashless(identifier))


def claim_key(source: Column, path: Column, predicate: Column, distinct: Column | None = None) -> Column:
    """Stable external id of a claim: ``source:path:predicate``, and what else tells claims of one key apart."""
    parts = [F.lower(T.trimmed(source)), _slashless(path), F.lower(T.trimmed(predicate))]
    return F.concat_ws(":", *parts, *([F.nullif(F.lower(T.trimmed(distinct)), F.lit(""))] if distinct is not None else []))


def _slashless(x: Column) -> Column:
    return F.regexp_replace(F.lower(T.trimmed(x)), "^/+|/+$", "")


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def restricted_address(ip: Column) -> Column:
    """Whether a literal address must not be fetched: private, loopback, link-local, shared, documentation, multicast and reserved ranges; anything that is no address as well."""
    x = F.regexp_replace(ip, "^::ffff:", "")
    v4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
    inside = r"^(0|127|10|22[4-9]|2[3-5]\d)\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.168\.|^169\.254\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^192\.0\.2\.|^198\.51\.100\.|^203\.0\.113\."
    low, group = F.lower(x), "[0-9a-f]{1,4}"
    # an address of eight groups, or of fewer with one ``::``
    groups = F.size(F.filter(F.split(low, ":"), lambda g: g != ""))
    v6 = low.rlike(rf"^({group}:){{7}}{group}$") | low.rlike(rf"^(({group}:)*{group})?::(({group}:)*{group})?$") & (groups <= 7)
    local = low.rlike("^(::1|::|(0000:){7}0001|f[cd].*|fe[89ab].*)$")
    return F.when(x.rlike(v4), x.rlike(inside)).when(v6, local).otherwise(True)


#: Host names that are never fetched. Fixed values.
BANNED_HOSTS = ["localhost", "metadata.google.internal", "instance-data", "169.254.169.254"]


def fetchable(url: Column) -> Column:
    """Whether a page may be fetched, as far as its text tells: http or https, no banned host, no restricted literal address. Names are resolved outside."""
    host = F.lower(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), r"^\[|\]$", ""))
    literal = host.rlike(r"^[0-9.]+$") | F.contains(host, F.lit(":"))
    banned = host.isin(BANNED_HOSTS) | host.rlike(r"\.(local|internal)$")
    return F.coalesce(url.rlike("(?i)^https?://") & (host != "") & ~banned & ~(literal & restricted_address(host)), F.lit(False))


def _claims(rows: DataFrame, subject: Column, confidence: float | Column, method: str, *more: str) -> DataFrame:
    return rows.select("path", "line_no", subject.alias("subject"), "predicate", T.trimmed("value").alias("value"), value_type(F.col("predicate"), F.col("value")).alias("value_type"), F.lit(confidence).alias("confidence"), F.lit(method).alias("extraction_method"), *more)


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")


def yaml_claims(files: DataFrame) -> DataFrame:
    """Double-quoted, single-quoted or bare ``key: value`` lines; no nesting, comments cut, flow collections left out."""
    at = lambda p, k: F.regexp_extract("line", p, k)
    key = r"^\s*(?:-\s*)?([A-Za-z0-9_.\-]+)\s*[:=]\s*"
    forms = (key + r'"([^"]*)"\s*(?:#.*)?$', key + r"'([^']*)'\s*(?:#.*)?$", key + r"([^#\s{\[\"'][^#]*?)\s*(?:#.*)?$")
    rows = lines(files).where(~F.col("line").rlike(r"^\s*#"))
    hit = F.coalesce(*(F.when(F.col("line").rlike(p), F.struct(at(p, 1).alias("k"), at(p, 2).alias("v"))) for p in forms))
    rows = rows.withColumn("kv", hit).where("kv IS NOT NULL").select("path", "line_no", data_key(F.col("kv.k")).alias("predicate"), F.col("kv.v").alias("value"))
    return _claims(rows.where(T.trimmed("value") != ""), base_name(F.col("path")), 0.9, "yaml_parse")


def csv_claims(files: DataFrame) -> DataFrame:
    """Plain comma split with one quote off each side; the first column names the subject, the others are predicates."""
    cells = F.transform(F.split("line", ","), lambda c: F.regexp_replace(T.trimmed(c), "^[\"']|[\"']$", ""))
    rows = lines(files).where(T.trimmed("line") != "").withColumn("cells", cells)
    first = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("header", F.first("cells").over(first)).where("line_no > 1")
    rows = rows.select("*", F.posexplode("cells").alias("k", "value")).where("k > 0 AND k < size(header)")
    subject = F.when(F.col("cells")[0] != "", F.col("cells")[0]).otherwise(F.concat(base_name(F.col("path")), F.lit("_row_"), F.col("line_no") - 1))
    rows = rows.withColumn("predicate", data_key(F.col("header")[F.col("k")])).withColumn("subject", subject)
    return _claims(rows.where((F.col("predicate") != "") & (T.trimmed("value") != "")), F.col("subject"), 0.95, "csv_parse")


def _number(x: Decimal) -> str:
    """Shortest plain text of a JSON number, exact; very large and small ones keep their exponent."""
    if not x:
        return "0"
    text = format(x, "f") if -7 <= x.adjusted() < 21 else str(x).lower()
    return text.rstrip("0").rstrip(".") if "." in text and "e" not in text else text


def _scalar(x) -> str:
    """Text of a JSON value; of the value of a {name, value} item also where it is null, an array or an object, as the reference has it."""
    if isinstance(x, str):
        return x.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(x, list):
        return ",".join("" if v is None else _scalar(v) for v in x)
    return _number(x) if isinstance(x, Decimal) else "[object Object]" if isinstance(x, dict) else {True: "true", False: "false", None: "null"}[x]


def _not_json(word: str):
    raise ValueError(f"{word} is no JSON")


def _json_leaves(content: str | None) -> Iterator[tuple[list[str], str]]:
    """(keys from the root, text) of each scalar leaf at any depth, and ([name], value) of each {name, value} item of an array."""
    try:
        root = json.loads(content or "", parse_int=Decimal, parse_float=Decimal, parse_constant=_not_json)
    except ValueError:
        return
    stack = [((), dict(enumerate(root)) if isinstance(root, list) else root)]
    while stack:
        keys, node = stack.pop()
        if isinstance(node, dict):
            stack += [((*keys, _scalar(str(k))), v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            named = (v for v in node if isinstance(v, dict) and isinstance(v.get("name"), str) and "value" in v)
            yield from (([_scalar(v["name"])], _scalar(v["value"])) for v in named)
        elif node is not None and keys:
            yield list(keys), _scalar(node)


def json_claims(files: DataFrame) -> DataFrame:
    """Scalar leaves of nested objects of any depth as ``outer_inner``; of arrays the {name, value} items, under the bare name.

    Other items of arrays and nulls give nothing, malformed files give no rows. A file nested too deeply for the parser (thousands of levels) is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([(path, *leaf) for leaf in _json_leaves(content)], columns=["path", "keys", "value"])

    rows = files.select("path", "content").mapInPandas(run, "path string, keys array<string>, value string")
    predicate = F.array_join(F.transform("keys", data_key), "_")
    rows = rows.select("path", F.lit(None).cast("int").alias("line_no"), predicate.alias("predicate"), "value")
    return _claims(rows, base_name(F.col("path")), 0.95, "json_parse")


def markdown_claims(files: DataFrame) -> DataFrame:
    """Badges, direct ``key: value`` lines, tables and prose of Markdown; sections and table headers are carried forward by windows.

    A line gives its badges, and one of these: its direct pair, its table cells, or the first prose rule that it fits. A row of more than two cells under a header of more than two gives a claim
    ``row_column`` for each further cell; under no such header its first two cells count. Keys get the section's name in front. The external id holds the line's number.
    """
    rows = lines(files).where(T.trimmed("line") != "")
    order = Window.partitionBy("path").orderBy("line_no")
    heading = T.trimmed(F.regexp_extract("line", r"^#{2,6}\s+(.+)$", 1))
    plain = heading.rlike(f"(?i)^({'|'.join(PLAIN_HEADINGS)})")
    cell_form = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(T.trimmed(x)), "[^a-z0-9_]", "_"), "_+", "_"), "^_|_$", "")
    slug = F.regexp_replace(cell_form(heading), "_(cluster|layer|service|server|component|section)$", "")
    is_heading = F.col("line").rlike(r"^#{2,6}\s+.+$")
    section = F.when(is_heading, F.when(plain, "").otherwise(slug))
    is_rule, is_row = F.col("line").rlike(_TABLE_RULE), F.col("line").rlike(_TABLE_ROW)
    below = F.lead(F.struct("line_no", "line")).over(order)
    rows = rows.withColumn("section", F.coalesce(F.last(section, ignorenulls=True).over(order), F.lit("")))
    rows = rows.withColumn("is_header", F.coalesce(is_row & (below["line_no"] == F.col("line_no") + 1) & below["line"].rlike(_TABLE_RULE), F.lit(False))).where(~is_heading)
    named = F.lower(T.trimmed(F.regexp_extract("line", _DIRECT, 1))).isin(LABEL_WORDS.split()) & F.col("line").rlike(_DIRECT)
    rows = rows.withColumn("pair", F.when(~named, _direct(F.col("line"), _DIRECT, "", "markdown_pattern")))
    badges = badge_claims(rows)
    cells = F.transform(F.split(F.regexp_replace(T.trimmed("line"), r"^\||\|$", ""), r"\|"), T.trimmed)
    rows = rows.withColumn("cells", F.when(is_row, cells)).withColumn("in_table", is_row & ~is_rule & F.col("pair").isNull() & ~named)
    head = F.when(F.col("in_table") & F.col("is_header"), F.transform("cells", cell_form)).when(~is_row & ~is_rule & ~named, F.array().cast("array<string>"))
    rows = rows.withColumn("header", F.coalesce(F.last(head, ignorenulls=True).over(order), F.array().cast("array<string>"))).where(~named & ~is_rule & ~(F.col("in_table") & F.col("is_header")))
    bare = lambda c: T.trimmed(F.regexp_replace(c, r"""^[*`_"'\s]+|[*`_"'\s]+$""", ""))
    row_key = cell_form(F.col("cells")[0])
    good = F.col("in_table") & (F.size("cells") >= 2) & ~row_key.isin(TABLE_WORDS.split()) & ~F.contains(F.col("cells")[0], F.lit("---"))
    wide = good & (F.size("header") > 2) & (F.size("cells") > 2)
    out = "array<struct<k:string,v:string,method:string,any:boolean>>"
    by_column = F.transform(F.slice("cells", 2, F.size("cells")), lambda c, i: F.struct(
        F.concat_ws("_", row_key, F.coalesce(F.nullif(F.get("header", i + 1), F.lit("")), F.concat(F.lit("col_"), i + 1))).alias("k"), bare(c).alias("v"), F.lit("markdown_table").alias("method"), F.lit(True).alias("any")))
    by_column = F.filter(by_column, lambda x: ~x["v"].isin("", "-") & ~F.contains(x["v"], F.lit("---")))
    one = lambda x: F.array(F.struct(x["k"].alias("k"), x["v"].alias("v"), x["method"].alias("method"), F.lit(False).alias("any")))
    first_two = F.array(F.struct(row_key.alias("k"), bare(F.col("cells")[1]).alias("v"), F.lit("markdown_table").alias("method"), F.lit(False).alias("any")))
    prose = _prose(F.col("line"), PROSE_RULES)
    picked = F.when(F.col("pair").isNotNull(), one(F.col("pair")).cast(out)).when(wide, by_column.cast(out)).when(good & (row_key != ""), first_two.cast(out)).when(prose.isNotNull(), one(prose).cast(out))
    rows = rows.withColumn("kv", F.explode(picked)).withColumn("key", F.col("kv.k"))
    rows = rows.where(F.col("kv.any") | (F.length("key") > 2) & (F.col("kv.v") != "") & ~F.startswith("kv.v", F.lit("http")))
    found = rows.select("path", "line_no", F.col("kv.method").alias("method"), _namespaced(F.col("key")).alias("predicate"), F.col("kv.v").alias("value"), value_type(_namespaced(F.col("key")), F.col("kv.v")).alias("value_type"), T.trimmed("line").alias("evidence"))
    both = badges.unionByName(found)
    return both.select("path", "line_no", base_name(F.col("path")).alias("subject"), "predicate", "value", "value_type", F.lit(0.85).alias("confidence"), F.col("method").alias("extraction_method"), claim_key(F.lit("document"), F.col("path"), F.col("predicate"), F.col("line_no").cast("string")).alias("external_id"), "evidence")


def license_lines(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(_LICENSE))
    return rows.select("doc_id", F.regexp_extract("line", _LICENSE, 1).alias("license"))


def _row_lines(html: Column) -> Column:
    """Page text with each table row rewritten as a line of its own: the gaps between the rows, each with the row that follows it."""
    def line(content: Column) -> Column:
        cells = F.regexp_extract_all(content, F.lit(_CELL), F.lit(1))
        plain = F.transform(cells, lambda c: T.trimmed(decoded(T.trimmed(F.regexp_replace(c, "<[^>]+>", " ")))))
        filled = F.filter(plain, lambda c: c != "")
        return F.concat(F.lit("\n"), F.when(F.size(filled) >= 2, F.array_join(F.slice(filled, 1, 2), ": ")).otherwise(F.array_join(filled, " ")), F.lit("\n"))

    return F.when(html.rlike(r"(?i)<tr\b"), _between(html, _ROW, line)).otherwise(html)


def _between(x: Column, pattern: str, body) -> Column:
    """``x`` with ``body`` of the first group in place of each match of ``pattern``; what was put in is not looked at again."""
    parts = F.struct(F.split(x, pattern, -1).alias("gaps"), F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), body).alias("found"))
    return T.let(parts, lambda p: F.array_join(F.transform(p["gaps"], lambda g, i: F.concat(g, F.coalesce(F.get(p["found"], i), F.lit("")))), ""))


def decoded(x: Column) -> Column:
    """Character references decoded one after the other, as listed, then by number; a number is taken as a 16-bit unit, half of a pair is U+FFFD."""
    for code, char in ENTITIES:
        x = F.replace(x, F.lit(code), F.lit(char))

    def char(unit: Column) -> Column:
        paired = unit.between(0xD800, 0xDFFF)
        return F.when(paired, "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(F.when(paired, 32).otherwise(unit)), 4, "0")), "UTF-16BE"))

    unit = lambda digits: F.pmod(digits.cast("decimal(38, 0)"), F.lit(65536)).cast("long")
    decimal = T.let(x, lambda v: F.when(F.contains(v, F.lit("&#")), _between(v, r"&#(\d{1,30});", lambda d: char(unit(d)))).otherwise(v))
    hexed = lambda d: char(F.conv(F.right(d, F.lit(4)), 16, 10).cast("long"))
    return T.let(decimal, lambda v: F.when(F.contains(v, F.lit("&#x")), _between(v, r"&#x([0-9a-fA-F]+);", hexed)).otherwise(v))


def html_lines(pages: DataFrame, *more: str | Column) -> DataFrame:
    """Text lines of a page (page_id, line, and ``more`` of the page); scripts and styles are a blank, short lines and code comments are left out.

    A table row of two or more filled cells is the line ``first: second``, which leaves further cells out; any other row is its cells in one line.
    """
    text = decoded(F.regexp_replace(_row_lines(F.regexp_replace("html", _HIDDEN, " ")), "<[^>]+>", "\n"))
    rows = pages.select("page_id", *more, F.explode(F.split(text, r"\r?\n")).alias("line")).withColumn("line", T.trimmed("line"))
    return rows.where((F.length("line") > 3) & ~F.startswith("line", F.lit("//")) & ~F.startswith("line", F.lit("/*")))


def dockerfile_claims(files: DataFrame) -> DataFrame:
    """Versions of base images, up to the first hyphen of their tags, and exposed ports. The image's name tells what it is, wherever the word stands in it."""
    rows = lines(files).withColumn("line", T.trimmed("line"))
    image, tag = F.lower(F.regexp_extract("line", _FROM, 1)), F.split(F.regexp_extract("line", _FROM, 2), "-")[0]
    named = F.coalesce(*(F.when(F.contains(image, F.lit(word)), f"{word}_version") for word in BASE_IMAGES.split()))
    claim = lambda k, v, method: F.struct(k.alias("k"), v.alias("v"), F.lit(method).alias("m"))
    base = F.when(F.col("line").rlike(_FROM) & named.isNotNull() & (tag != ""), claim(named, tag, "dockerfile-base-image"))
    port = F.when(F.col("line").rlike(_EXPOSE), claim(F.lit("port"), F.regexp_extract("line", _EXPOSE, 1), "dockerfile-expose-port"))
    rows = rows.withColumn("kv", F.coalesce(base, port)).where("kv IS NOT NULL")
    rows = rows.select("path", "line_no", F.col("kv.k").alias("predicate"), F.col("kv.v").alias("value"), F.col("kv.m").alias("extraction_method"), F.col("line").alias("evidence"))
    typed = F.when(F.col("predicate") == "port", "quantity").otherwise("version")
    place = {"environment": "deployment", "scope": "service", "source_role": "configuration"}
    return rows.select("path", "line_no", F.lit("repository").alias("subject"), "predicate", "value", typed.alias("value_type"), F.lit(0.9).alias("confidence"), "extraction_method", *(F.lit(v).alias(k) for k, v in place.items()), "evidence")


def workflow_claims(files: DataFrame) -> DataFrame:
    """``node-version`` with a number, or with a list that gives a claim for each item under one multi-value context; ``runs-on`` gives the runner's system."""
    rows = lines(files)
    one, many = F.regexp_extract("line", _NODE, 2), F.regexp_extract("line", _NODE, 1)
    bare = lambda v: F.regexp_replace(F.regexp_replace(T.trimmed(v), "['\"]", ""), r"\.x$", "")
    claim = lambda k, v, t, c, group, method: F.struct(F.lit(k).alias("predicate"), v.alias("value"), F.lit(t).alias("value_type"), F.lit(c).alias("confidence"), F.lit(group).alias("multi_value_context"), F.lit(method).alias("extraction_method"))
    step = lambda v: claim("node_version", v, "version", 0.9, "ci_step", "github-workflow-node-version")
    matrix = lambda v: claim("node_version", bare(v), "version", 0.9, "ci_matrix", "github-workflow-node-matrix")
    node = F.when(one != "", F.array(step(F.regexp_replace(one, r"\.x$", "")))).when(many != "", F.transform(F.split(many, ","), matrix)).otherwise(F.array())
    runner = F.when(F.col("line").rlike(_RUNNER), F.array(claim("ci_runner_os", F.regexp_extract("line", _RUNNER, 1), "name", 0.95, "ci_runner", "github-workflow-runner"))).otherwise(F.array())
    found = rows.select("path", "line_no", F.substring(T.trimmed("line"), 1, 160).alias("evidence"), F.inline(F.concat(node, runner))).where("value <> ''")
    place = {"environment": "ci", "scope": "workflow", "source_role": "configuration"}
    return found.select("path", "line_no", "predicate", "value", "value_type", "confidence", "multi_value_context", "extraction_method", *(F.lit(v).alias(k) for k, v in place.items()), "evidence")


def package_claims(files: DataFrame) -> DataFrame:
    """Engines, the listed dependencies and the ports of scripts, with the environment that each speaks of."""
    part = lambda name: F.from_json(F.get_json_object("content", f"$.{name}"), "map<string,string>")
    claim = lambda k, v, confidence, dev: F.struct(k.alias("predicate"), v.alias("value"), F.lit(confidence).alias("confidence"), F.when(dev, "development").otherwise("production").alias("environment"))
    rows = files.select("path", *(part(n).alias(n) for n in ("engines", "dependencies", "devDependencies", "scripts")))
    each = lambda m, body: F.coalesce(F.transform(F.map_entries(m), lambda e: body(e["key"], e["value"])), F.array())
    engines = each("engines", lambda k, v: claim(F.concat(key_form(k), F.lit("_version")), v, 0.95, F.lit(False)))
    deps = F.array(*(claim(F.lit(p), F.coalesce(F.try_element_at("dependencies", F.lit(n)), F.try_element_at("devDependencies", F.lit(n))), 0.9, F.coalesce(F.map_contains_key("devDependencies", n), F.lit(False))) for n, p in DEPENDENCIES.items()))
    ports = each("scripts", lambda k, v: claim(F.lit("port"), F.regexp_extract(v, _SCRIPT_PORT, 1), 0.85, F.lower(k).rlike("dev|test")))
    rows = rows.select("path", F.lit(None).cast("int").alias("line_no"), F.inline(F.concat(engines, deps, ports)))
    return _claims(rows.where(T.trimmed("value") != ""), F.lit("repository"), F.col("confidence"), "json_parse", "environment")


def redact(x: Column) -> Column:
    """Tokens and credentials replaced; null is empty."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"gh[pousr]_[A-Za-z0-9_]{20,255}", "[REDACTED_GITHUB_TOKEN]")
    x = F.regexp_replace(x, r"(?i)Bearer\s+[A-Za-z0-9_.-]+", "Bearer [REDACTED]")
    x = F.regexp_replace(x, r"(?i)token\s+[A-Za-z0-9_.-]+", "token [REDACTED]")
    return F.regexp_replace(x, r"(?i)access_token=[A-Za-z0-9_.-]+", "access_token=[REDACTED]")


def readme_claims(files: DataFrame) -> DataFrame:
    """Node version and port of README lines; a line's words tell historical and example statements apart."""
    rows = lines(files)
    low = F.lower("line")
    old = low.rlike(_README_OLD)
    shown = low.rlike(_README_SHOWN)
    role = F.when(shown, "example").when(old, "historical").otherwise("documentation")
    version = F.regexp_extract("line", _README_NODE, 1)
    is_node = F.col("line").rlike(_README_NODE) & ~F.contains(low, F.lit("npm")) & (version != "0") & ~version.rlike("^(202|199)")
    limit = F.when(F.col("line").rlike(r"[><=~^\s*|xX]"), F.substring(T.trimmed("line"), 1, 50))
    claim = lambda k, v, t, c: F.struct(F.lit(k).alias("predicate"), v.alias("value"), F.lit(t).alias("value_type"), c.alias("value_constraint"))
    found = F.array(F.when(is_node, claim("node_version", version, "version", limit)), F.when(F.col("line").rlike(_README_PORT), claim("port", F.regexp_extract("line", _README_PORT, 1), "quantity", F.lit(None).cast("string"))))
    kept = rows.select("path", "line_no", role.alias("source_role"), old.alias("is_historical"), F.substring(T.trimmed("line"), 1, 160).alias("evidence"), F.inline(F.filter(found, lambda x: x.isNotNull())))
    return kept.select("path", "line_no", "predicate", "value", "value_type", F.lit(0.8).alias("confidence"), "source_role", "is_historical", "value_constraint", "evidence")


def normalized_claims(claims: DataFrame) -> DataFrame:
    """Predicates as normal snake-case words, and the value as the comparison with itself writes it."""
    own = V.compare(F.col("value"), F.col("value"), F.col("value_type"))["normalized_a"]
    return claims.withColumns({"predicate": F.regexp_replace(T.normalize_text(F.col("predicate")), r"\s+", "_"), "normalized_value": F.coalesce(F.nullif(own, F.lit("")), T.trimmed("value"))})


def page_title(html: Column) -> Column:
    return decoded(T.trimmed(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1)))


def page_claims(pages: DataFrame) -> DataFrame:
    """Claims of pages (page_id, url, html): ``key: value`` lines, else the first prose rule that a line fits. The title names the subject."""
    rows = html_lines(pages, "url", F.coalesce(F.nullif(T.trimmed(F.regexp_replace(page_title(F.col("html")), r"[^a-zA-Z0-9_\s-]", "")), F.lit("")), F.lit("Website")).alias("subject"))
    prose = _prose(F.col("line"), PAGE_RULES)
    rows = rows.withColumn("hit", F.coalesce(_direct(F.col("line"), _PAGE_DIRECT, ""), F.when(prose["k"] == "database", F.struct(prose["k"].alias("k"), F.lower(prose["v"]).alias("v"), prose["method"].alias("method"))).otherwise(prose)))
    rows = rows.where("hit.k <> '' AND hit.v <> ''").select("page_id", "url", "subject", F.col("hit.k").alias("predicate"), F.col("hit.v").alias("value"), F.col("hit.method").alias("extraction_method"), F.col("line").alias("evidence"))
    key = F.concat(F.lit("claim:website:"), F.substring(F.sha2(F.concat_ws(":", "url", "predicate", "value"), 256), 1, 16))
    return rows.select("*", value_type(F.col("predicate"), F.col("value")).alias("value_type"), F.when(F.col("extraction_method") == "prose_heuristic", 0.85).otherwise(0.95).alias("confidence"), key.alias("external_id"))


def _direct(line: Column, pattern: str, skipped: str, method: str = "html_text_pattern") -> Column:
    """struct(k, v, method) of a direct ``key: value`` line, null otherwise; a long value with a quantity in it is cut down to that."""
    k, v = T.trimmed(F.regexp_extract(line, pattern, 1)), T.trimmed(F.regexp_extract(line, pattern, 2))
    value = T.trimmed(F.regexp_replace(v, r"""^[*`_"'\s]+|[*`_"'\s]+$""", ""))
    amount = T.trimmed(F.regexp_extract(value, rf"(?i)(?:at\s+least|minimum|requires|is)?\s*(\d+(?:\.\d+)?\s*(?:{_SIZES}))(?![A-Za-z0-9_])", 1))
    ok = line.rlike(pattern) & (k != "") & (v != "") & ~F.contains(k, F.lit("---")) & ~F.lower(k).isin(skipped.split() or [""])
    short = F.when((F.length(value) > 20) & (amount != ""), amount).otherwise(value)
    return F.when(ok, F.struct(F.regexp_replace(F.lower(k), "[^a-z0-9_]", "_").alias("k"), short.alias("v"), F.lit(method).alias("method")))


def _prose(line: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(k, v, method) of the first rule that a line fits, null without one."""
    def hit(key: str, pattern: str) -> Column:
        v = T.trimmed(F.regexp_extract(line, f"(?i){pattern}", 1))
        if key == "commercial_use":
            v = F.when(v.rlike("(?i)prohibited|forbidden|not"), "prohibited").otherwise("allowed")
        if key == "configuration_required":
            v = F.lit("false")
        return F.when(line.rlike(f"(?i){pattern}"), F.struct(F.lit(key).alias("k"), v.alias("v"), F.lit("prose_heuristic").alias("method")))

    return F.coalesce(*(hit(k, p) for k, p in rules))


def badge_claims(rows: DataFrame) -> DataFrame:
    """Status badges of Markdown lines (path, line_no, line, section)."""
    all_of = lambda g: F.regexp_extract_all("line", F.lit(_BADGE), F.lit(g))
    rows = rows.where(F.col("line").rlike(_BADGE)).select("path", "line_no", "line", "section", F.explode(F.arrays_zip(all_of(1).alias("alt"), all_of(2).alias("url"))).alias("b"))
    alt, url = T.trimmed("b.alt"), T.trimmed("b.url")
    shield = F.split(F.try_url_decode(F.regexp_replace(F.regexp_extract(url, r"(?i)shields\.io/badge/([^?#]+)", 1), r"\+", "%2B")), "-")
    is_shield = url.rlike(r"(?i)shields\.io/badge/[^?#]+")
    form = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9_]", "_")
    either = lambda words: url.rlike(f"(?i){words}") | alt.rlike(f"(?i){words}")
    state = F.when(is_shield, F.when(F.size(shield) >= 2, F.struct(form(shield[0]).alias("k"), F.lower(shield[1]).alias("v")))).when(
        url.rlike(r"(?i)badge\.svg"), F.when(either("passing|success"), F.struct(F.lit("build").alias("k"), F.lit("passing").alias("v"))).when(either("failing|failed|error"), F.struct(F.lit("build").alias("k"), F.lit("failing").alias("v"))))
    named = F.split(alt, r"[:\s-]+")
    by_name = F.when((alt != "") & (F.size(named) >= 2), F.struct(form(named[0]).alias("k"), F.lower(named[1]).alias("v")))
    rows = rows.withColumn("s", F.coalesce(F.when(state["v"] != "", state), by_name)).where("s.v <> ''")
    return rows.select("path", "line_no", F.lit("markdown_badge").alias("method"), _namespaced(F.concat(F.col("s.k"), F.lit("_status"))).alias("predicate"), F.col("s.v").alias("value"), F.lit("status").alias("value_type"), T.trimmed("line").alias("evidence"))


def _namespaced(key: Column) -> Column:
    return F.when((F.col("section") != "") & ~F.startswith(key, F.col("section")), F.concat_ws("_", "section", key)).otherwise(key)
