"""What all analyzers share: the table of findings and the groups that they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COLUMNS = (
    "scope_id", "analyzer_ord", "first_seq", "pos", "issue_type", "severity", "description", "fix_suggestion", "file_path", "line_number", "function_name",
    "query_count", "time_saved_ms", "fingerprint", "extra",
)

SCHEMA = (
    "scope_id long, analyzer_ord int, first_seq long, pos int, issue_type string, severity string, description string, fix_suggestion string, file_path string, line_number int, "
    "function_name string, query_count int, time_saved_ms double, fingerprint string, extra map<string, string>"
)


def none(spark: SparkSession) -> DataFrame:
    """No findings; it takes no task to read them."""
    return spark.range(0).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in StructType.fromDDL(SCHEMA)])


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def groups(rows: DataFrame, *keys: str) -> DataFrame:
    """Count, total time, first member and first member with a callsite of each group in a scope.

    Only numbers are aggregated, so that groups stay in hash tables; texts are part of the keys."""
    placed = F.when(F.col("callsite").isNotNull(), F.col("seq"))
    return rows.groupBy("scope_id", *keys).agg(
        F.count("*").cast("int").alias("query_count"), F.sum("duration_ms").alias("total_ms"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min(placed).alias("placed_seq"),
    )


def with_callsite(found: DataFrame, captures: DataFrame) -> DataFrame:
    """Groups with the callsite of their first member that has one; a null scope is one like others."""
    sites = captures.where("callsite is not null").select(F.col("scope_id").alias("__s"), F.col("seq").alias("__q"), "callsite").dropDuplicates(["__s", "__q"])
    return found.join(sites, F.col("scope_id").eqNullSafe(F.col("__s")) & (F.col("placed_seq") == F.col("__q")), "left").drop("__s", "__q")


def saved(found: DataFrame) -> DataFrame:
    return found.withColumn("time_saved_ms", F.col("total_ms") * (F.col("query_count") - 1) / F.col("query_count"))


def finish(found: DataFrame, order: int, issue_type: str, severity: str | Column, description: Column, fix: str | Column, extra: dict[str, Column | str | None]) -> DataFrame:
    """Rows as findings; missing counts, times and positions take their defaults."""
    defaults = {"pos": F.lit(0), "query_count": F.lit(0), "time_saved_ms": F.lit(0.0)}
    entries = [x for k, v in extra.items() for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(v).cast("string"))]
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    return found.withColumns({k: v for k, v in defaults.items() if k not in found.columns}).select(
        "scope_id", F.lit(order).alias("analyzer_ord"), "first_seq", F.col("pos").cast("int").alias("pos"), F.lit(issue_type).alias("issue_type"), column(severity).alias("severity"),
        description.alias("description"), column(fix).alias("fix_suggestion"), F.col("callsite.filepath").alias("file_path"), F.col("callsite.line_number").alias("line_number"),
        F.col("callsite.function_name").alias("function_name"), F.col("query_count").cast("int").alias("query_count"), F.col("time_saved_ms").cast("double").alias("time_saved_ms"), "fingerprint", F.create_map(*entries).alias("extra"),
    )


def by_count(limit: int = 10) -> Column:
    return F.when(F.col("query_count") >= limit, "critical").otherwise("warning")
