"""Columns in WHERE or ORDER BY that the catalog knows to have no index: the first use in a scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from .findings import finish, text


def analyze(captures: DataFrame, catalog: Catalog) -> DataFrame:
    used = captures.where("is_select").select("scope_id", F.col("seq").alias("first_seq"), "callsite", "fingerprint", F.posexplode("refs").alias("pos", "ref"))
    used = used.join(F.broadcast(catalog.unindexed()), (F.col("ref.table") == F.col("t")) & (F.col("ref.column") == F.col("c")))
    first = F.row_number().over(Window.partitionBy("scope_id", "t", "c").orderBy("first_seq", "pos"))
    found = used.withColumn("n", first).where("n = 1").withColumn("query_count", F.lit(1))
    table, column, name = F.col("t"), F.col("c"), F.col("model_name")
    description = text('Missing index: column "', column, '" on ', name, ' (table "', table, '") is used in WHERE/ORDER BY but has no index')
    fix = text("Add to ", name, "'s Meta.indexes: indexes = [models.Index(fields=[\"", column, '"], name="idx_', table, "_", column, '")]')
    return finish(found, 2, "missing_index", "info", description, fix, {"table": table, "column": column, "model": name})
