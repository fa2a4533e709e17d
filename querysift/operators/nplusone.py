"""Loops that fetch one row a round: equal SELECTs by key, resolved against the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sql_text
from ..sources.catalog import Catalog
from .findings import by_count, finish, groups, saved, text, with_callsite


def tables_read(captures: DataFrame) -> DataFrame:
    """When each scope first read each table."""
    reads = captures.where("is_select").select("scope_id", "seq", F.explode("tables").alias("source"))
    return reads.groupBy("scope_id", "source").agg(F.min("seq").alias("read_seq"))


def resolved(found: DataFrame, captures: DataFrame, catalog: Catalog) -> DataFrame:
    """Groups with table, strategy, model_name, label and field of the advice; others fall away."""
    fk_table, fk_column = (F.regexp_extract("normalized_sql", sql_text.FK_LOOKUP, i) for i in (1, 2))
    keyed = found.withColumns({"fk_table": fk_table, "fk_column": fk_column, "pk_table": F.regexp_extract("normalized_sql", sql_text.PK_LOOKUP, 1)})
    keyed = keyed.where("fk_table <> '' or pk_table <> ''").withColumn("table", F.when(F.col("fk_table") != "", F.col("fk_table")).otherwise(F.col("pk_table")))
    names = catalog.names().select(F.col("t").alias("nt"), F.col("model_name").alias("n_name"), F.col("label").alias("n_label"))
    through = catalog.through().select(F.col("t").alias("tt"), F.col("model_name").alias("t_name"), F.col("label").alias("t_label"), F.col("field").alias("t_field"))
    reverse = catalog.reverse().select(F.col("t").alias("rt"), F.col("c").alias("rc"), F.col("model_name").alias("r_name"), F.col("label").alias("r_label"), F.col("field").alias("r_field"))
    out = keyed.join(F.broadcast(names), F.col("table") == F.col("nt"), "left").join(F.broadcast(through), F.col("fk_table") == F.col("tt"), "left")
    out = out.join(F.broadcast(reverse), (F.col("fk_table") == F.col("rt")) & (F.col("fk_column") == F.col("rc")), "left")
    # A key to the table from one that the scope had read before: the first in the registry.
    targets = keyed.where("fk_table = ''").select("scope_id", "fingerprint", "pk_table", "first_seq").join(F.broadcast(catalog.forward()), F.col("pk_table") == F.col("t"))
    earlier = targets.join(tables_read(captures), ["scope_id", "source"]).where("read_seq < first_seq")
    best = earlier.withColumn("n", F.row_number().over(Window.partitionBy("scope_id", "fingerprint").orderBy("place"))).where("n = 1")
    best = best.select(F.col("scope_id").alias("fs"), F.col("fingerprint").alias("ff"), F.col("model_name").alias("f_name"), F.col("label").alias("f_label"), F.col("field").alias("f_field"))
    out = out.join(best, (F.col("scope_id") == F.col("fs")) & (F.col("fingerprint") == F.col("ff")), "left")
    strategy = F.when(F.col("t_field").isNotNull() | F.col("r_field").isNotNull(), "prefetch_related").when(F.col("f_field").isNotNull(), "select_related").otherwise("bulk_fetch")
    chosen = {"model_name": ("t_name", "r_name", "f_name", "n_name"), "label": ("t_label", "r_label", "f_label", "n_label"), "field": ("t_field", "r_field", "f_field")}
    return out.withColumns({"strategy": strategy, **{k: F.coalesce(*v) for k, v in chosen.items()}})


def analyze(captures: DataFrame, catalog: Catalog, threshold: int = 3) -> DataFrame:
    found = groups(captures.where("is_select"), "fingerprint", "normalized_sql").where(F.col("query_count") >= threshold)
    found = saved(with_callsite(resolved(found, captures, catalog), captures))
    bulk, table, field = F.col("strategy") == "bulk_fetch", F.col("table"), F.col("field")
    name = F.coalesce(F.col("model_name"), table)
    via = F.when(bulk, F.lit("(one row per iteration, no relation traversed)")).otherwise(text("(via ", F.col("model_name"), ".", field, ")"))
    relation = text("Add .", F.col("strategy"), "('", field, "') to your ", F.col("model_name"), " queryset")
    more = F.when(F.col("strategy") == "prefetch_related", text(". For advanced filtering, use Prefetch('", field, "', queryset=...)")).otherwise(F.lit(""))
    fetch = text("Fetch the rows in one query: ", name, ".objects.in_bulk(ids), or ", name, ".objects.filter(pk__in=ids), instead of one lookup per iteration")
    description = text("N+1 detected: ", F.col("query_count"), ' queries for table "', table, '" ', via)
    return finish(found, 0, "n_plus_one", by_count(), description, F.when(bulk, fetch).otherwise(F.concat(relation, more)), {"table": table, "field": field, "model": F.col("label"), "strategy": F.col("strategy")})
