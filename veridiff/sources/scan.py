"""One scan of a folder, or of the files of repositories, that hands each file to its reader.

Files are read once: what they hold is turned into text there and then (archives into lines, messages into their body), and written by *route* into a
table from which each reader takes its own partition. Size and place are looked at before any content is read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions import values as V
from ..operators.versioned import scratch
from . import archive, extract

MAX_BYTES = 10 * 1024 * 1024
#: What a file's ending, or a repository file's path, makes of it. Fixed values.
ROUTES = {"json": "json", "yaml": "yaml", "yml": "yaml", "csv": "csv", "pdf": "pdf", "eml": "email", "docx": "archive"}
HEADER_LINES = 8
CLAIM = (
    "path string, line_no int, subject string, predicate string, value string, value_type string, confidence double, extraction_method string, environment string, scope string, "
    "source_role string, is_historical boolean, multi_value_context string, value_constraint string, observed_at timestamp, external_id string, evidence string"
)


def document_route(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(T.lookup(ending, ROUTES), F.lit("text"))


def repository_route(path: Column) -> Column:
    """Null for files that state nothing."""
    low = F.lower(path)
    named = lambda name: (low == name) | F.endswith(low, F.lit(f"/{name}"))
    flow = F.startswith(low, F.lit(".github/workflows/")) & low.rlike(r"\.ya?ml$")
    return F.when(named("package.json"), "package").when(named("dockerfile") | F.contains(low, F.lit("dockerfile.")), "dockerfile").when(named("readme.md") | (low == "readme"), "readme").when(flow, "workflow")


# --- where files are, and which are refused ---------------------------------------------------------------------


def listing(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length and content of the files below a folder; content is read only where it is asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


@F.pandas_udf(StringType())
def _real(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A local file's place with all links resolved; other file systems know no links."""
    for batch in paths:
        yield batch.map(lambda p: "file:" + os.path.realpath(unquote(urlparse(p).path)) if p.startswith("file:") else p)


def inside(path: Column, roots: list[str]) -> Column:
    """Whether a path lies in one of the folders, links resolved on both sides."""
    real = _real(path)
    out = F.lit(False)
    for root in roots:
        r = "file:" + os.path.realpath(unquote(urlparse(root).path)) if root.startswith("file:") else root
        out = out | F.startswith(real, F.lit(r + "/")) | (real == r)
    return out


def refused(spark: SparkSession, folder: str, roots: list[str] | None = None, max_bytes: int = MAX_BYTES, glob: str | None = None) -> DataFrame:
    """(path, reason) of files that a scan leaves out: too large, outside the allowed folders, or a PDF, whose pages come as a table. No content is read."""
    files = listing(spark, folder, glob).select("path", "length")
    allowed = inside(F.col("path"), [_qualified(spark, r) for r in roots]) if roots else F.lit(True)
    reason = F.when(~allowed, "outside").when(F.col("length") > max_bytes, "too large").when(document_route(F.col("path")) == "pdf", "pages needed")
    return files.select("path", reason.alias("reason")).where("reason IS NOT NULL")


# --- text and routes ---------------------------------------------------------------------------------------------


def _archive_text(max_bytes: int):
    @F.pandas_udf(StringType())
    def run(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in contents:
            yield pd.Series(list(archive.texts(batch, max_bytes)), dtype=object)

    return run


def message_parts(content: Column) -> Column:
    """struct(body, sent) of a message: what follows the first blank line (all of it where there is none), and the last readable ``Date`` header, folded ones unfolded."""
    rows = F.split(content, r"\r?\n")
    parts = F.struct(rows.alias("rows"), F.array_position(F.transform(rows, lambda x: T.trimmed(x) == ""), F.lit(True)).alias("at"))

    def split(v: Column) -> Column:
        head = F.slice(v["rows"], F.lit(1), F.greatest(F.when(v["at"] > 0, v["at"] - 1).otherwise(F.size(v["rows"])), F.lit(0)).cast("int"))
        body = F.slice(v["rows"], (v["at"] + 1).cast("int"), F.size(v["rows"]))
        unfolded = F.regexp_replace(F.array_join(head, "\n"), r"\n[ \t]+", " ")
        dates = F.transform(F.regexp_extract_all(unfolded, F.lit(r"(?im)^Date:[ \t]*(.+)$"), F.lit(1)), sent_at)
        sent = F.try_element_at(F.filter(dates, lambda d: d.isNotNull()), F.lit(-1))
        has_body = (v["at"] > 0) & (F.size(body) > 0)
        return F.struct(F.array_join(F.when(has_body, body).otherwise(v["rows"]), "\n").alias("body"), sent.alias("sent"))

    return T.let(parts, split)


def sent_at(x: Column) -> Column:
    """Timestamp of a date header: with its time of day and offset where they are written out, else the day."""
    plain = F.regexp_replace(F.regexp_replace(T.trimmed(x), r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""), r"\s*\([^)]*\)\s*$", "")
    zoned = F.regexp_replace(plain, rf"(?i)\s(?:{V.ZONES})$", " +0000")
    full = F.coalesce(*(F.try_to_timestamp(zoned, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")))
    return F.coalesce(full, V.normalize_date(plain).try_cast("timestamp"))


def _prepared(files: DataFrame, max_bytes: int) -> DataFrame:
    """(path, modified, route, content) to (path, observed_at, route, content): archives and messages as plain text."""
    body = F.when(F.col("route") == "archive", _archive_text(max_bytes)(F.when(F.col("route") == "archive", F.col("content")))).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    rows = files.select("path", "modified", "route", body.alias("content")).where("content IS NOT NULL")
    first = F.slice(F.split("content", r"\r?\n"), 1, HEADER_LINES)
    letter = F.col("route").isin("text", "archive") & (F.size(F.split("content", r"\r?\n")) > 3) & F.exists(first, lambda x: x.rlike(r"(?i)^From:\s+"))
    route = F.when(letter, "email").when(F.col("route") == "archive", "text").otherwise(F.col("route"))
    rows = rows.withColumn("route", route).withColumn("m", F.when(F.col("route") == "email", message_parts(F.col("content"))))
    observed = F.coalesce("m.sent", "modified").alias("observed_at")
    return rows.select("path", observed, F.when(F.col("route") == "email", "text").otherwise(F.col("route")).alias("route"), F.coalesce("m.body", "content").alias("content"))


READERS = {
    "text": (extract.markdown_claims, {"source_role": "documentation", "scope": "file"}), "json": (extract.json_claims, {"source_role": "configuration", "scope": "file"}),
    "yaml": (extract.yaml_claims, {"source_role": "configuration", "scope": "file"}), "csv": (extract.csv_claims, {"source_role": "documentation", "scope": "file"}),
    "package": (extract.package_claims, {"source_role": "configuration", "scope": "package"}), "dockerfile": (extract.dockerfile_claims, {}), "workflow": (extract.workflow_claims, {}),
    "readme": (extract.readme_claims, {"scope": "repository", "environment": "production"}),
}


def _unified(claims: DataFrame, fixed: dict[str, str]) -> DataFrame:
    """CLAIM, with what a reader does not say taken from ``fixed`` or left open."""
    kinds = dict(c.split(" ") for c in CLAIM.split(", "))
    usual = {"environment": "unknown", "is_historical": False, "scope": "file", "subject": "repository", "extraction_method": "regex"} | fixed
    pick = lambda c: F.col(c) if c in claims.columns else F.lit(usual.get(c))
    return claims.select(*(pick(c).cast(t).alias(c) for c, t in kinds.items()))


def routed_claims(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """CLAIM rows of files (path, modified, route, content as bytes): one pass over the files, then each reader over its own part."""
    spark, path = files.sparkSession, scratch(files.sparkSession, "routed")
    _prepared(files, max_bytes).write.partitionBy("route").parquet(path)
    table = spark.read.schema("path string, observed_at timestamp, content string, route string").parquet(path)
    out = None
    for route, (reader, fixed) in READERS.items():
        own = table.where(F.col("route") == route)
        claims = _unified(reader(own.select("path", "content")), fixed).drop("observed_at").join(own.select("path", "observed_at"), "path")
        claims = claims.select(*[c.split(" ")[0] for c in CLAIM.split(", ")])
        out = claims if out is None else out.unionByName(claims)
    key = extract.claim_key(F.lit("document"), F.col("path"), F.col("predicate"), F.col("line_no").cast("string"))
    return out.withColumn("external_id", F.coalesce("external_id", key))


def document_claims(spark: SparkSession, folder: str, roots: list[str] | None = None, max_bytes: int = MAX_BYTES, glob: str | None = None) -> DataFrame:
    """CLAIM rows of all files below a folder, but for the :func:`refused` ones."""
    files = listing(spark, folder, glob).where(F.col("length") <= max_bytes).withColumn("route", document_route(F.col("path"))).where("route <> 'pdf'")
    if roots:
        files = files.where(inside(F.col("path"), [_qualified(spark, r) for r in roots]))
    return routed_claims(files.select("path", F.col("modificationTime").alias("modified"), "route", "content"), max_bytes)


def repository_claims(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """CLAIM rows with the repository as subject, of files (repository, path, content, encoding): base64 where the encoding says so, else plain text.

    Paths that state nothing are left out, so are contents that are null or no base64; a claim's path has its repository in front.
    """
    raw = F.regexp_replace("content", r"\s", "")
    plain = F.when(F.col("encoding") == "base64", F.try_to_binary(raw, F.lit("base64"))).otherwise(F.col("content").cast("binary"))
    rows = files.withColumn("route", repository_route(F.col("path"))).where("route IS NOT NULL")
    rows = rows.select(F.concat_ws("/", "repository", "path").alias("path"), F.lit(None).cast("timestamp").alias("modified"), "route", plain.alias("content"))
    claims = routed_claims(rows.where("content IS NOT NULL"), max_bytes)
    return claims.withColumn("subject", F.regexp_extract("path", "^([^/]+/[^/]+)/", 1))


def page_table_claims(pages: DataFrame) -> DataFrame:
    """Claims of pages of text (path, page, text), such as a PDF reader gives: ``key: value`` or ``key = value`` lines, the page in the external id."""
    lines = extract.lines(pages, "text").withColumn("line", T.trimmed("line")).where(F.col("line").rlike(_PAGE_LINE) & ~F.startswith("line", F.lit("#")))
    key = F.regexp_replace(F.lower(T.trimmed(F.regexp_extract("line", _PAGE_LINE, 1))), "[^a-z0-9_]", "_")
    value = F.regexp_replace(T.trimmed(F.regexp_extract("line", _PAGE_LINE, 2)), "^[\"'`]|[\"'`]$", "")
    rows = lines.withColumns({"predicate": key, "value": value}).where((F.length("predicate") > 2) & (F.col("value") != "") & ~F.startswith("value", F.lit("http")))
    place = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_l"), F.col("line_no").cast("string"))
    return rows.select(
        "path", "page", "line_no", extract.base_name(F.col("path")).alias("subject"), "predicate", "value", extract.value_type(F.col("predicate"), F.col("value")).alias("value_type"),
        F.lit("pdf_extractor").alias("extraction_method"), extract.claim_key(F.lit("document"), F.col("path"), F.col("predicate"), place).alias("external_id"), F.col("line").alias("evidence"),
    )


#: A line of a page that states something. Fixed value.
_PAGE_LINE = r"^([a-zA-Z0-9_\s-]+)[:=]\s*(.+)$"
