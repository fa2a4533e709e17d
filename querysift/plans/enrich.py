"""Captures with what the analyzers derive from their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql_text


def read(captures: DataFrame) -> DataFrame:
    """Adds normalized_sql, fingerprint, tables and is_select.

    The chain of patterns runs once a row: its result is read several times, which keeps the optimizer from
    copying it into the filters above."""
    made = captures.withColumn("normalized_sql", sql_text.normalize(F.col("sql")))
    return made.withColumns({
        "fingerprint": sql_text.short_hash(F.col("normalized_sql")),
        "tables": sql_text.tables(F.col("sql")),
        "is_select": F.col("normalized_sql").startswith("select"),
    })


def derived(rows: DataFrame) -> DataFrame:
    """Adds what only analyzers read, all of it from normalized_sql: of SELECTs score, refs, base and columns (null where
    a single row is fetched), of others kind and target of a write."""
    text = F.col("normalized_sql")
    own = F.when(F.startswith(text, F.lit("select")), text)  # null texts make the patterns pass
    made = rows.withColumns({"__select": own, "__many": F.when(~sql_text.single_row(own), own), "base": sql_text.base_table(own), "kind": F.when(own.isNull(), sql_text.write_kind(text))})
    return made.withColumns({
        "score": sql_text.complexity(F.col("__select")),
        "refs": F.concat(sql_text.where_columns(F.col("__select")), sql_text.order_by_columns(F.col("__select"))),
        "columns": sql_text.select_columns(F.col("__many"), F.col("base")),
        "target": sql_text.write_table(F.col("kind"), text),
    }).drop("__select", "__many")


def enrich(captures: DataFrame) -> DataFrame:
    """Captures as the analyzers want them."""
    return derived(read(captures))


def settled(rows: DataFrame) -> DataFrame:
    """Rows that several parts of a plan read, derived now and kept; lost parts are derived again.

    Kept but not derived, they would be derived by each part that asks first: those run at once, on other executors."""
    kept = rows.persist()
    kept.count()
    return kept


def known(captures: DataFrame, most: int = 10_000, kept: list[DataFrame] | None = None) -> DataFrame:
    """Enriched captures, settled, in the parts they come in, so that times of a group add in the order of the log.

    A program has few statements besides their values. Of `most` texts at most, each goes through the analyzers' patterns
    once and the result is sent to all executors; of more, each row's does. `kept` gets what is to be let go afterwards."""
    rows = settled(read(captures))
    texts = rows.select("fingerprint", "normalized_sql").distinct()
    few = texts.limit(most + 1).count() <= most
    own = settled(derived(texts if few else rows))
    if kept is not None:
        kept += [rows, own]
    return rows.join(F.broadcast(own), ["fingerprint", "normalized_sql"], "left") if few else own
