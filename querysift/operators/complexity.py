"""Queries whose structure is too complex: one finding a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import finish, text


def advice(normalized: Column) -> Column:
    count = lambda pattern: F.regexp_count(F.upper(normalized), F.lit(pattern))
    joins = count(r"\bJOIN\b")
    split = text("Consider breaking this query into smaller queries: ", joins, " JOINs detected. Use select_related for 1-2 FKs and prefetch_related for the rest.")
    nested = "Replace subqueries with JOINs or annotate() where possible."
    either = "Multiple OR conditions prevent index usage. Consider using Q objects with separate filtered querysets combined via union()."
    said = F.concat_ws(" ", F.when(joins > 3, split), F.when(count(r"\bSELECT\b") > 1, nested), F.when(count(r"\bOR\b") > 2, either))
    return F.when(said == "", "Consider breaking into multiple simpler queries or using database views.").otherwise(said)


def analyze(captures: DataFrame, threshold: int = 8) -> DataFrame:
    found = captures.where("is_select").where(F.col("score") >= threshold).withColumnRenamed("seq", "first_seq")
    severity = F.when(F.col("score") >= 12, "critical").otherwise("warning")
    return finish(found, 5, "complexity", severity, text("Query complexity score ", F.col("score"), " exceeds threshold ", str(threshold)), advice(F.col("normalized_sql")), {"score": F.col("score")})
