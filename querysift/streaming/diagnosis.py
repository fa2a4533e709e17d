"""Diagnosis of a stream of captures, and scopes for captures that have none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import enrich
from ..plans.pipeline import diagnose
from ..sources.catalog import Catalog


def scoped_by_session(captures: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of captures by key: start, end, queries and time; a scope for logs without one."""
    timed = captures.withColumn("at", F.col("captured_at").cast("timestamp")).withWatermark("at", late)
    sessions = timed.groupBy(key, F.session_window("at", gap).alias("scope")).agg(F.count("*").alias("queries"), F.sum("duration_ms").alias("time_ms"))
    return sessions.select(key, F.col("scope.start").alias("started_at"), F.col("scope.end").alias("ended_at"), "queries", "time_ms")


def diagnose_stream(captures: DataFrame, folder: str, report: Callable[[DataFrame, int], None] | None = None, once: bool = True, idle: str = "1 day") -> StreamingQuery:
    """Diagnoses scopes as they grow, also where one spans several batches. `folder` is in storage that all share.

    Each batch is kept under its number, with the scopes that it touched. Then these scopes are diagnosed over all that
    is kept of them, and the findings written under the batch's number; latest() has each scope's last. Only batches
    that hold a touched scope are read again, and none older than `idle` before the batch's first capture: a scope that
    rests so long starts anew. A batch that is tried again overwrites its own. `report` gets the findings that a batch
    made new."""
    spark = captures.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        at = lambda name: f"{folder}/{name}/batch={number}"
        batch.write.mode("overwrite").parquet(at("log"))
        own = spark.read.schema(batch.schema).parquet(at("log"))
        ages = own.groupBy("scope_id").agg(F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))
        ages.write.mode("overwrite").parquet(at("touched"))
        touched = spark.read.parquet(f"{folder}/touched").where(F.col("batch") <= number)
        now = touched.where(F.col("batch") == number).select(F.col("scope_id").alias("now_scope"), F.col("first_at").alias("now_at"))
        wanted = touched.join(now, F.col("scope_id").eqNullSafe(F.col("now_scope"))).where(F.col("last_at") >= F.col("now_at") - F.expr(f"interval {idle}")).select("scope_id", "batch")
        numbers = [r.batch for r in wanted.select("batch").distinct().collect()]  # as many as batches within `idle`
        if not numbers:
            return
        log = spark.read.option("basePath", f"{folder}/log").parquet(*[f"{folder}/log/batch={n}" for n in numbers])
        mine = wanted.withColumnsRenamed({"scope_id": "s", "batch": "b"})
        rows = log.join(mine, F.col("scope_id").eqNullSafe(F.col("s")) & (F.col("batch") == F.col("b")), "left_semi").drop("batch")
        kept: list[DataFrame] = []
        try:
            diagnose(enrich.known(rows, kept=kept), Catalog(spark)).write.mode("overwrite").parquet(at("findings"))
        finally:
            for one in kept:
                one.unpersist()
        if report:
            report(spark.read.parquet(at("findings")), number)

    started = captures.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state")
    return (started.trigger(availableNow=True) if once else started).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of each scope's last diagnosis; scopes that have none any more have no row."""
    last = spark.read.parquet(f"{folder}/touched").groupBy("scope_id").agg(F.max("batch").alias("b")).withColumnRenamed("scope_id", "s")
    found = spark.read.parquet(f"{folder}/findings")
    return found.join(last, F.col("scope_id").eqNullSafe(F.col("s")) & (F.col("batch") == F.col("b")), "left_semi").drop("batch")
