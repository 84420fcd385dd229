"""Names that mean one thing, as tables: groups out of pairs by connected components, and a look-up by form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .versioned import scratch

GROUPS = "form string, group string, canonical string"


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(name, label) of all names of the pairs (a, b): the smallest name that pairs reach. Smallest neighbours and jumps along labels, until nothing changes; nulls take no part."""
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = _written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "alias-pairs")
    labels = _written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("name"), F.least("a", "b").alias("label")), "alias-labels")
    while True:
        near = both.join(labels.select(F.col("name").alias("b"), "label"), "b").groupBy(F.col("a").alias("name")).agg(F.min("label").alias("near"))
        step = labels.join(near, "name").select("name", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        further = labels.select(F.col("name").alias("label"), F.col("label").alias("further"))
        new = _written(step.join(further, "label", "left").select("name", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "alias-labels")
        if new.where("label < old").isEmpty():
            return new.select("name", "label")
        labels = new.select("name", "label")


def groups_of_pairs(pairs: DataFrame) -> DataFrame:
    """GROUPS out of pairs of names (a, b): names are compared by their forms, chains of pairs are one group, the smallest form is canonical."""
    forms = pairs.select(T.entity_form(F.col("a")).alias("a"), T.entity_form(F.col("b")).alias("b")).where("a <> '' AND b <> ''")
    return components(forms).select(F.col("name").alias("form"), F.col("label").alias("group"), F.col("label").alias("canonical"))


def groups_of_lists(members: DataFrame) -> DataFrame:
    """GROUPS out of lists (position, name): a form that stands in several lists belongs to the last one, of which the smallest form is canonical, whichever list that one belongs to."""
    rows = members.select("position", T.entity_form(F.col("name")).alias("form")).where("form <> ''").distinct()
    first = rows.groupBy("position").agg(F.min("form").alias("canonical"))
    last = rows.groupBy("form").agg(F.max("position").alias("position"))
    return last.join(first, "position").select("form", F.col("position").cast("string").alias("group"), "canonical")


def resolved(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of names (a, b) with ``r``: the engine's verdict on two entities, where a table's group makes an alias of what its rules leave apart.

    The table takes the place that lists in code have: after equal names and forms, before the engine's own aliases.
    """
    side = lambda n: groups.select(F.col("form").alias(f"{n}_form"), F.col("group").alias(f"{n}_group"))
    rows = pairs.withColumns({"a_form": T.entity_form(F.col("a")), "b_form": T.entity_form(F.col("b"))}).join(side("a"), "a_form", "left").join(side("b"), "b_form", "left")
    own = T.resolve_entity(F.col("a"), F.col("b"))
    alias = F.struct(F.lit(True).alias("is_match"), F.lit(0.95).alias("confidence"), F.lit("ALIAS").alias("match_type"), F.lit(False).alias("is_ambiguous"))
    rows = rows.withColumn("own", own)
    verdict = F.when((F.col("a_group") == F.col("b_group")) & ~F.col("own.match_type").isin("EXACT", "NORMALIZED"), alias).otherwise(F.col("own"))
    return rows.withColumn("r", verdict).drop("own", "a_form", "b_form", "a_group", "b_group")
