"""Claims and sources derived from the driver's star schema, by expressions that DuckDB has as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources.extract import value_type


def _pick(x, names: list[str]):
    out = F.lit(names[-1])
    for k, n in enumerate(names[:-1]):
        out = F.when(x == k, n).otherwise(out)
    return out


ENVIRONMENTS = ["production", "staging", "unknown", "deployment"]
SCOPES = ["service", "repository", "unknown"]
ROLES = ["configuration", "documentation", "deployment", "example", "historical"]


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    null = lambda t: F.lit(None).cast(t)
    made = {
        "id": F.concat(F.lit("e"), F.lpad(i.cast("string"), 10, "0")), "source_id": F.concat(F.lit("src"), (i % 7).cast("string")), "subject": F.concat(F.lit("user_"), F.col("user_id").cast("string")),
        "predicate": F.col("event_type"), "value": F.format_string("%.2f", "value"), "value_type": F.lit("quantity"), "confidence": 1 - (i % 5) * 0.05,
        "environment": _pick(i % 4, ENVIRONMENTS), "scope": _pick(i % 3, SCOPES), "source_role": _pick(i % 5, ROLES), "is_historical": F.lit(False), "observed_at": F.col("ts"), "created_at": F.col("ts"),
    }
    made["external_id"] = F.concat_ws(":", made["subject"], made["predicate"])
    fields = [f.split(" ", 1) for f in schemas.CLAIMS.split(", metadata")[0].split(", ")]
    return e.select(*(made.get(n, null(t)).alias(n) for n, t in fields), null(schemas.METADATA).alias("metadata"))


def event_trust(spark: SparkSession) -> DataFrame:
    return spark.range(7).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("id"), (0.6 + F.col("id") * 0.05).alias("trust_score"))


#: (predicate, its values) of the mixed claims, by event_id modulo their number; every value type and difference occurs.
MIXED = [
    ("node_version", ("18.2.0", "18.4.1", "20.1.0", "v18.2.0")), ("http_port", ("80", "8080", "80")), ("launch_date", ("2024-01-15", "15.01.2024", "2024-01-19", "2024/03/01")),
    ("unit_price", ("$12.50", "12.50 USD", "$13.00", "12.50 EUR")), ("build_status", ("enabled", "Active", "failed", "pending")), ("memory", ("1 GB", "1024 MB", "2 GB", "1024")),
    ("access_policy", ("open to all", "Open  to all", "members only")), ("owner", ("team red", "team blue")), ("bind_host", ("10.0.0.1", "localhost")), ("debug_enabled", ("true", "no", "on")),
    ("login_requirement", ("", "two keys", "three keys")), ("environment_name", ("blue", "green")),
]


def mixed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event claims with predicates and values of all types; the value of an event is picked by event_id div 12."""
    i = F.col("event_id")
    k, turn = i % len(MIXED), F.floor(i / len(MIXED)).cast("long")
    predicate, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (name, values) in enumerate(MIXED):
        predicate = F.when(k == n, name).otherwise(predicate)
        value = F.when(k == n, _pick(turn % len(values), list(values))).otherwise(value)
    c = event_claims(spark, sf_dir).withColumn("event_id", F.substring("id", 2, 10).cast("long"))
    c = c.withColumns({"predicate": predicate, "value": value, "subject": F.concat(F.lit("unit_"), F.lpad(F.regexp_extract("subject", "[0-9]+", 0), 6, "0"))})
    return c.withColumn("value_type", value_type(F.col("predicate"), F.col("value"))).drop("event_id")


#: predicate: (value, its type) of claims that reach every gate of the verdict, by event_id modulo their numbers.
ODD = {
    "launch_deadline": (("TBD", "date"), ("2024-01-05", "date"), ("Tue, 15 Jan 2024 10:00:00 +0000", "date"), ("January 15, 2024", "date"), ("next spring", "date")),
    "remark": (("hello", None), ("world", None), ("8080", None), ("9090", None), ("30 days", None)),
    "retention": (("30 days", "policy"), ("60 days", "requirement"), ("30 days", "requirement")),
    "node_version": ((">=18.0.0", "version"), ("18.2.0", "version"), ("16.0.0", "version"), ("^18.0.0", "version")),
    "endpoint": (("10.0.0.1", "address"), ("80", "quantity"), ("localhost", "address")),
}


def odd_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event claims with values that no rule reads, without types, with ranges and with types that clash; every fifth is historical."""
    i = F.col("event_id")
    k, turn = i % len(ODD), F.floor(i / len(ODD)).cast("long")
    predicate, value, kind = (F.lit(None).cast("string") for _ in range(3))
    for n, (name, values) in enumerate(ODD.items()):
        predicate = F.when(k == n, name).otherwise(predicate)
        value = F.when(k == n, _pick(turn % len(values), [v for v, _ in values])).otherwise(value)
        kind = F.when(k == n, _pick(turn % len(values), [t for _, t in values])).otherwise(kind)
    c = event_claims(spark, sf_dir).withColumn("event_id", F.substring("id", 2, 10).cast("long"))
    role = F.when(F.floor(i / 7) % 5 == 4, "historical").otherwise("documentation")
    fixed = {"environment": F.lit("production"), "scope": F.lit("service"), "source_role": role, "subject": F.concat(F.lit("unit_"), F.lpad(F.regexp_extract("subject", "[0-9]+", 0), 6, "0"))}
    return c.withColumns({"predicate": predicate, "value": value, "value_type": kind, **fixed}).drop("event_id")
