"""The queries opN_<name> and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, decontaminate, embedding_whitening, html_extraction, language_id, language_model, metric_search, near_dedup, sentencepiece_codec, source_mixing, substring_dedup, token_files
from .common import shared_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_search.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = language_id.held_out("doc_id", 4, 2)
    model = language_id.train(docs.where(~held))
    found = language_id.predict(docs.select("doc_id", "text", held.alias("held_out")), model, ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(_read(spark, sf_dir, "documents"), shared_path(spark, "tokens"), token_files.default_tokenizer())
    return token_files.read_digests(manifest)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak: doc_id, item_id, shared and n_item_shingles."""
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(_read(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 of the ids, and the digest of what they decode to."""
    model = sentencepiece_codec.default_model()
    ids = sentencepiece_codec.encode(_read(spark, sf_dir, "documents"), model)
    return sentencepiece_codec.decode_digest(ids, model).drop("ids")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(_read(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    model = sentencepiece_codec.default_model()
    return chat_format.read_digests(chat_format.format_turns(rows, model), model)


def whitened_rows(embeddings: DataFrame, k: int) -> DataFrame:
    """A row for each vector and component; ``deviation`` is null where it has no place in a long (``transform`` has it as a decimal)."""
    model = embedding_whitening.fit(embeddings, k)
    rows = embedding_whitening.transform(embeddings, model)
    explained = F.array(*[F.lit(x) for x in model.explained]).cast("array<double>")
    each = rows.select("vec_id", F.posexplode("whitened").alias("at", "whitened"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"))
    error = embedding_whitening.identity_error(rows, model)
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(_read(spark, sf_dir, "embeddings"), 32)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(_read(spark, sf_dir, "conversations")))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_metric_search, op2_language_id, op3_token_files, op4_language_model, op5_decontaminate, op6_near_dedup, op7_sentencepiece, op8_html_extraction, op9_substring_dedup, op10_chat_format, op11_embedding_whitening, op12_conversation_repair, op13_source_mixing)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str) -> str:
    """(key, words, shingle) CTE body: distinct five-word shingles, or the whole of fewer words."""
    return rf"""
        SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
        FROM (SELECT {key}, {_WORDS.format(_LOWER)} AS w FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL)"""


ORACLE_SQL = {
    "op1_metric_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
              FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_decontaminate": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
        k AS (SELECT DISTINCT len(w) AS k FROM (SELECT {_WORDS.format(_LOWER)} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL) WHERE len(w) BETWEEN 1 AND 4),
        d AS ({_shingles("documents", "doc_id")} UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) FROM w, k), b AS ({_shingles("benchmark", "item_id")}),
        n AS (SELECT item_id, count(*) AS q FROM b GROUP BY item_id)
        SELECT doc_id, item_id, count(*) AS shared, any_value(q) AS n_item_shingles
        FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(q)""",
    "op6_near_dedup": f"""
        WITH RECURSIVE s AS ({_shingles("documents", "doc_id")}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s AS x JOIN s AS y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM c JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
        reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
        SELECT documents.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(documents.doc_id, coalesce(min(reach.b), documents.doc_id)) AS component_id,
            documents.doc_id = least(documents.doc_id, coalesce(min(reach.b), documents.doc_id)) AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = documents.doc_id GROUP BY documents.doc_id""",
    "op9_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        o AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
        f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM o) WHERE doc_id > first),
        g AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM f, range(50) AS t(j) GROUP BY doc_id),
        k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id))
        SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
            sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' ')) AS kept_sha256
        FROM k""",
    "op10_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t AS (SELECT *, regexp_replace(role, '([<\[])(\\*/?(?:s>|unk>|INST\]))', '\1\\\2', 'g') AS role_out,
                regexp_replace(text, '([<\[])(\\*/?(?:s>|unk>|INST\]))', '\1\\\2', 'g') AS text_out FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(role_out) + length(text_out) + 23) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op12_conversation_repair": r"""
        WITH RECURSIVE k AS (SELECT *, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS b,
                coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0 FROM conversations),
        z AS (SELECT *, xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, octet_length(b) + 1), lambda i: ascii(substr(decode(b), i::INTEGER, 1))::UBIGINT),
                lambda c, x: list_reduce([xor(c, x)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda y, n: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)), 4294967295::UBIGINT) % 20 AS kind FROM k),
        g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r0 END AS role,
                CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(t0, '.!?', '') ELSE t0 END AS text, unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM z),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
                rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM g),
        f AS (SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
        inserted(src, via, icost, iaudit, itext) AS (VALUES ('', '', 0, '', ''), ('', 'u', 3, 'I', chr(10) || 'user:'), ('', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
            ('s', 's', 0, '', ''), ('s', 'u', 3, 'I', chr(10) || 'user:'), ('s', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 'u', 0, '', ''), ('u', 'a', 3, 'I', chr(10) || 'assistant:'),
            ('a', 'a', 0, '', ''), ('a', 'u', 3, 'I', chr(10) || 'user:')),
        follows(via, nxt) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
        steps AS (SELECT src, via AS dst, 'D' AS edit, icost + 4 AS cost, iaudit || 'D' AS audit, itext FROM inserted
            UNION ALL SELECT src, nxt, 'K', icost, iaudit || 'K', itext FROM inserted JOIN follows USING (via)
            UNION ALL SELECT src, nxt, 'R', icost + 3, iaudit || 'R', itext FROM inserted JOIN follows USING (via) WHERE nxt <> 's'),
        walk(conv_id, i, state, best) AS (
            SELECT DISTINCT conv_id, 0::BIGINT, '', {'cost': 0, 'audit': '', 'said': ''} FROM conversations
            UNION ALL
            SELECT w.conv_id, f.i, s.dst, min({'cost': w.best.cost + s.cost + CASE WHEN s.edit <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': w.best.audit || s.audit,
                'said': w.best.said || s.itext || CASE s.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || CASE s.dst WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text END})
            FROM walk AS w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN steps AS s ON s.src = w.state
            WHERE s.edit = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (s.edit = 'R' OR left(f.role, 1) = s.dst))
            GROUP BY w.conv_id, f.i, s.dst),
        n AS (SELECT conv_id, max(i) AS n FROM walk GROUP BY conv_id),
        b AS (SELECT walk.conv_id, min({'cost': best.cost + icost, 'audit': best.audit || iaudit, 'said': best.said || itext}) AS best
            FROM walk JOIN n ON n.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.i = n.n JOIN inserted ON src = state WHERE via IN ('', 'a') GROUP BY walk.conv_id),
        c AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
        SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(substr(best.said, 2)) AS repaired_sha256
        FROM b LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id""",
}
