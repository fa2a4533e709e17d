"""Equal SELECTs with equal parameters, unless a write to one of their tables fell between."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sql_text
from .findings import finish, groups, saved, text, with_callsite


def unguarded(found: DataFrame, captures: DataFrame) -> DataFrame:
    """Groups without a write strictly between their first and last member on any of their tables.

    Spans and writes of a table stand in one order, in which each span sees the next write: neither is paired with all
    of the other."""
    none = lambda kind: F.lit(None).cast(kind)
    writes = captures.where("not is_select").select("scope_id", F.explode("tables").alias("table"), F.col("seq").alias("at"), F.lit(True).alias("write"), none("string").alias("key"), none("long").alias("last_seq"))
    spans = found.select("scope_id", F.explode("tables").alias("table"), F.col("first_seq").alias("at"), F.lit(False).alias("write"), "key", "last_seq")
    # Downwards from the last; at equal places the span comes first, so the write it sees is later than its start.
    later = Window.partitionBy("scope_id", "table").orderBy(F.desc("at"), "write").rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.unionByName(writes).withColumn("next_write", F.last(F.when(F.col("write"), F.col("at")), True).over(later))
    broken = placed.where("not write and next_write > at and next_write < last_seq").select("scope_id", "key").distinct()
    return found.join(broken, ["scope_id", "key"], "left_anti")


def analyze(captures: DataFrame, threshold: int = 2, guarded: bool = True) -> DataFrame:
    keyed = captures.where("is_select").withColumn("key", sql_text.duplicate_key(F.col("sql"), F.col("params_repr")))
    found = groups(keyed, "key", "fingerprint", "tables").where(F.col("query_count") >= threshold)
    found = saved(with_callsite(unguarded(found, captures) if guarded else found, captures))
    table = F.coalesce(F.get("tables", F.lit(0)), F.lit("unknown"))
    description = text("Duplicate query: ", F.col("query_count"), ' identical queries for table "', table, '"')
    fix = "Assign the queryset result to a variable and reuse it instead of executing the same query multiple times"
    return finish(found, 1, "duplicate_query", "warning", description, fix, {"table": table, "duplicate_type": "exact"})
