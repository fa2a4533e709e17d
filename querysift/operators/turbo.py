"""Replay of a cache of compiled statements: which accesses miss, validate, are trusted or poison an entry."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lifecycle(accesses: DataFrame, validations: int = 3, resets: DataFrame | None = None) -> DataFrame:
    """Adds `state` to accesses (process_id, seq, fingerprint, fresh_sql), without eviction, by windows alone.

    `resets` (process_id, seq) empty a process's cache, as a schema change does: later accesses start anew, but
    fingerprints poisoned before stay so."""
    if resets is None:
        rows = accesses.withColumn("era", F.lit(0).cast("long"))
    else:
        marks = resets.select("process_id", "seq").distinct().withColumn("mark", F.lit(1))
        both = accesses.unionByName(marks, allowMissingColumns=True)
        upto = Window.partitionBy("process_id").orderBy("seq", F.col("mark").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = both.withColumn("era", F.count("mark").over(upto)).where("mark is null").drop("mark")
    own = Window.partitionBy("process_id", "fingerprint", "era").orderBy("seq")
    placed = rows.withColumns({"n": F.row_number().over(own), "first_sql": F.first("fresh_sql").over(own)})
    checked = (F.col("n") >= 2) & (F.col("n") <= validations + 1) & (F.col("fresh_sql") != F.col("first_sql"))
    # The first failed check of a fingerprint, in whichever era, poisons it for good.
    bad = placed.withColumn("bad", F.min(F.when(checked, F.struct("era", "n"))).over(Window.partitionBy("process_id", "fingerprint")))
    at = F.struct("era", "n")
    late, poison = F.coalesce(at > F.col("bad"), F.lit(False)), F.coalesce(at == F.col("bad"), F.lit(False))
    state = F.when((F.col("n") == 1) | late, "miss").when(poison, "poison").when(F.col("n") <= validations + 1, "validate").otherwise("trusted")
    return bad.withColumn("state", state).drop("first_sql")


def _n(*states: str) -> Column:
    return F.count_if(F.col("state").isin(*states))


def stats(states: DataFrame, validations: int = 3) -> DataFrame:
    """Hits, misses and the like of each process; size, trusted and poisoned entries at the end of the log."""
    hits, misses = _n("poison", "validate", "trusted"), _n("miss")
    rate = hits / F.greatest(F.lit(1), hits + misses)
    counted = states.groupBy("process_id").agg(hits.alias("hits"), misses.alias("misses"), F.round(rate, 6).alias("hit_rate"), _n("poison").alias("evictions"), _n("trusted").alias("trusted_hits"))
    last = entries(states, validations).groupBy("process_id").agg(F.count_if(~F.col("poisoned")).alias("size"), F.count_if(F.col("trusted")).alias("trusted_entries"), F.count_if(F.col("poisoned")).alias("poisoned_entries"))
    return counted.join(last, "process_id")


def entries(states: DataFrame, validations: int = 3) -> DataFrame:
    """The cache at the end of the log: each fingerprint's hits in the last era, cached text, and whether it is trusted or
    poisoned."""
    era = states.withColumn("last", F.max("era").over(Window.partitionBy("process_id")))
    now = F.col("era") == F.col("last")
    out = era.groupBy("process_id", "fingerprint").agg(
        F.count_if(now & F.col("state").isin("validate", "trusted")).alias("hit_count"), F.bool_or(F.col("state") == "poison").alias("poisoned"), F.bool_or(now).alias("held"),
        F.min_by("fresh_sql", F.when(now, F.col("seq"))).alias("sql"),
    )
    return out.where("held or poisoned").withColumn("trusted", ~F.col("poisoned") & (F.col("hit_count") >= validations)).drop("held")


def top_entries(states: DataFrame, most: int = 20) -> DataFrame:
    """The entries hit most often that the cache still holds, with the first 200 characters of the cached text."""
    held = entries(states).where("not poisoned and hit_count > 0")
    return held.select("process_id", "fingerprint", "hit_count", F.substring("sql", 1, 200).alias("preview"), "trusted").orderBy(F.desc("hit_count"), "process_id", "fingerprint").limit(most)


def chart(top: DataFrame, most: int = 10, width: int = 60) -> DataFrame:
    """The first of the top entries with labels for a chart."""
    label = F.when(F.length("preview") > width, F.concat(F.substring("preview", 1, width), F.lit("..."))).otherwise(F.col("preview"))
    return top.orderBy(F.desc("hit_count"), "process_id", "fingerprint").limit(most).select("process_id", "fingerprint", "hit_count", label.alias("label"))


def prepared(top: DataFrame, vendor: str = "sqlite", from_hits: int = 5) -> DataFrame:
    """How many of the top entries a driver would prepare: those of one that prepares, hit often enough."""
    would = (F.col("hit_count") >= from_hits) & F.lit(vendor == "postgresql")
    return top.agg(F.count_if(would).alias("prepared_count"), F.count_if(~would).alias("unprepared_count"))


def replay(accesses: DataFrame, max_size: int = 1024, validations: int = 3) -> DataFrame:
    """The exact replay, with eviction of the oldest entry and demotion; one process's log is one stream, of which a task
    holds the cache alone.

    Columns in: process_id, seq, fingerprint, fresh_sql, param_count. Adds `state` and the entries held."""
    columns = [*accesses.columns]
    at = [columns.index(x) for x in ("process_id", "fingerprint", "fresh_sql", "param_count")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        process, cache, poisoned = None, OrderedDict(), set()
        for part in parts:
            states, held = [], []
            for row in part.itertuples(index=False):
                own, fingerprint, sql, params = (row[i] for i in at)
                if own != process:
                    process, cache, poisoned = own, OrderedDict(), set()
                states.append(_step(cache, poisoned, fingerprint, sql, params, max_size, validations))
                held.append(len(cache))
            yield part.assign(state=states, held=held)

    ordered = accesses.repartition("process_id").sortWithinPartitions("process_id", "seq")
    return ordered.mapInPandas(run, T.StructType([*accesses.schema.fields, T.StructField("state", T.StringType()), T.StructField("held", T.IntegerType())]))


def _step(cache: OrderedDict, poisoned: set, fingerprint: str, sql: str, params: int, max_size: int, validations: int) -> str:
    """What one access does to the cache: entries are text, number of parameters and checks passed."""
    if fingerprint in poisoned:
        return "miss"
    entry = cache.get(fingerprint)
    if entry is None:
        if len(cache) >= max_size:
            cache.popitem(last=False)
        cache[fingerprint] = [sql, params, 0]
        return "miss"
    if entry[2] < validations and sql != entry[0]:
        poisoned.add(fingerprint)
        del cache[fingerprint]
        return "poison"
    cache.move_to_end(fingerprint)
    if entry[2] < validations:
        entry[2] += 1
        return "validate"
    if params != entry[1]:
        entry[2] = 0
        return "demote"
    return "trusted"
