"""SELECTs of many columns of their base table: the first in a scope for each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from .findings import finish, text


def analyze(captures: DataFrame, catalog: Catalog, threshold: int = 8) -> DataFrame:
    wide = captures.where("is_select and base <> ''").where(F.size("columns") >= threshold).withColumnRenamed("base", "t")
    first = F.row_number().over(Window.partitionBy("scope_id", "t").orderBy("seq"))
    found = wide.withColumn("n", first).where("n = 1").withColumnRenamed("seq", "first_seq").withColumn("query_count", F.lit(1))
    large = catalog.large().groupBy("t").agg(F.array_sort(F.collect_set("c")).alias("known"))
    found = found.join(F.broadcast(large), "t", "left").withColumn("large", F.filter("columns", lambda x: F.coalesce(F.array_contains("known", x), F.lit(False))))
    any_large, count, table = F.size("large") > 0, F.size("columns"), F.col("t")
    quoted = F.array_join(F.transform("large", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    narrow = text("Use .defer(", quoted, ") to skip loading large fields, or .values()/.values_list() if you don't need model instances")
    plain = "Use .only('field1', 'field2', ...) to select only the fields you need, .defer() to skip large fields, or .values()/.values_list() if you don't need model instances"
    including = F.when(any_large, text(" including large fields: ", F.array_join("large", ", "))).otherwise(F.lit(""))
    description = F.concat(text("Fat SELECT: ", count, ' columns from "', table, '"'), including)
    return finish(found, 3, "fat_select", "info", description, F.when(any_large, narrow).otherwise(F.lit(plain)), {"table": table, "column_count": count, "large_fields": F.array_join("large", ",")})
