"""Lines of code that evaluate all rows where less would do: one finding a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql_text
from .findings import finish, text

#: The advice for each way of evaluation.
FIXES = {
    "list(qs)[0]": "Use .first() instead of list(qs)[0] to avoid loading the entire queryset. For large result sets, consider .iterator() to reduce memory usage",
    "len(qs)": "Use .count() instead of len() to let the database count rows. If iterating afterward, consider .iterator() for large querysets",
    "bool(qs)": "Use .exists() instead of bool()/if to check for rows without loading them",
}


def analyze(captures: DataFrame) -> DataFrame:
    coded = captures.where("is_select and callsite.code_context <> ''").withColumn("pattern", sql_text.evaluation(F.col("callsite.code_context"))).where("pattern is not null")
    found = coded.withColumnRenamed("seq", "first_seq").withColumn("query_count", F.lit(1))
    fix = F.coalesce(*[F.when(F.col("pattern") == k, v) for k, v in FIXES.items()])
    return finish(found, 4, "queryset_eval", "info", text("Inefficient queryset evaluation: ", F.col("pattern")), fix, {"pattern": F.col("pattern")})
