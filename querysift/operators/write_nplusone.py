"""Loops that write one row a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql_text
from ..sources.catalog import Catalog
from .findings import by_count, finish, groups, saved, text, with_callsite

#: The advice for each kind of statement.
FIXES = {
    "insert": "Build the objects in a list and issue one write: Model.objects.bulk_create([Model(...), ...]). Pass batch_size= if the list is large enough to strain the driver.",
    "update": "Collect the modified objects and issue one write: Model.objects.bulk_update(objects, ['field']). If every row gets the same value, a queryset update is cheaper still: Model.objects.filter(...).update(field=value).",
    "delete": "Delete through the queryset instead of per object: Model.objects.filter(...).delete(), which issues one statement.",
}


def analyze(captures: DataFrame, catalog: Catalog, threshold: int = 3) -> DataFrame:
    writes = captures.where("not is_select and kind is not null").where(~sql_text.many_rows(F.col("kind"), F.col("sql")))
    found = groups(writes.withColumnRenamed("target", "t"), "fingerprint", "kind", "t").where(F.col("query_count") >= threshold)
    found = saved(with_callsite(found, captures)).join(F.broadcast(catalog.names()), "t", "left")
    name, count = F.col("model_name"), F.col("query_count")
    fix = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in FIXES.items()])
    named = F.replace(F.replace(fix, F.lit("Model.objects"), F.concat(name, F.lit(".objects"))), F.lit("Model(...)"), F.concat(name, F.lit("(...)")))
    subject = F.coalesce(name, text('table "', F.col("t"), '"'))
    description = text("Write N+1 detected: ", count, " single-row ", F.upper("kind"), " statements for ", subject, ". One bulk statement replaces all ", count, ".")
    return finish(found, 7, "write_n_plus_one", by_count(), description, F.coalesce(named, fix), {"table": F.col("t"), "statement": F.col("kind"), "model": name})
