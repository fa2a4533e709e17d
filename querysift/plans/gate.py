"""Which captures are diagnosed at all, and the endpoints that they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings
from ..settings import Settings


def share_of(scope: Column) -> Column:
    """A number from 0 to 1 that is always the same for a scope."""
    return F.conv(F.substring(F.md5(scope.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)


def admitted(captures: DataFrame, using: Settings | None = None) -> DataFrame:
    """Captures of whole scopes that are in the sample, without ignored endpoints; none if switched off."""
    known = using or settings.current()
    keep = F.lit(known.enabled)
    for prefix in known.ignored_prefixes:
        keep &= ~F.coalesce(F.col("endpoint").startswith(prefix), F.lit(False))
    return captures.where(keep & (share_of(F.col("scope_id")) < float(known.sample_rate)))


def of_endpoint(captures: DataFrame, endpoint: str, strict: bool = True) -> DataFrame:
    """The captures of one endpoint; with `strict` an endpoint without any is an error."""
    own = captures.where(F.col("endpoint") == endpoint)
    if strict and own.isEmpty():
        raise LookupError(f"no captures of endpoint {endpoint!r}")
    return own


def endpoints(captures: DataFrame) -> DataFrame:
    """Each endpoint with its app, its methods and whether its path has parameters."""
    found = captures.where("endpoint is not null").groupBy("endpoint").agg(F.min("app_name").alias("app_name"), F.array_sort(F.collect_set("http_method")).alias("methods"))
    return found.withColumn("has_parameters", F.col("endpoint").rlike(r"<\w+:?\w*>"))


def selected(urls: DataFrame, methods: list[str] = (), exclude: list[str] = (), apps: list[str] = ()) -> DataFrame:
    """Endpoints with `skip_reason`, null for those to analyse; excluded prefixes and other apps are left out."""
    keep = F.lit(True)
    for prefix in exclude:
        keep &= ~F.col("endpoint").startswith(prefix)
    if apps:
        keep &= F.col("app_name").isin(*apps)
    wanted = F.arrays_overlap("methods", F.array(*map(F.lit, methods))) if methods else F.lit(True)
    return urls.where(keep).withColumn("skip_reason", F.when(~wanted, "method").when(F.col("has_parameters"), "parameters"))


def durations(captures: DataFrame, shares: dict[str, float] = {"p10": 0.1, "p50": 0.5, "p90": 0.9}, cuts: int = 100) -> DataFrame:  # noqa: B006
    """Nearest-rank percentiles of the time by kind of statement, exact at any size.

    Approximate quantiles cut each kind into about `cuts` parts. Exact counts of the parts tell in which one a rank
    lies, and only that part is sorted, value by value."""
    timed = captures.where("duration_ms is not null").select("is_select", "duration_ms")
    bounds = timed.groupBy("is_select").agg(F.percentile_approx("duration_ms", [i / cuts for i in range(1, cuts)]).alias("bounds"))
    part = F.size(F.filter("bounds", lambda b: b < F.col("duration_ms")))
    values = timed.groupBy("is_select", "duration_ms").agg(F.count("*").alias("n")).join(F.broadcast(bounds), "is_select").select("is_select", "duration_ms", "n", part.alias("part"))
    parts = values.groupBy("is_select", "part").agg(F.sum("n").alias("n"))
    ends = parts.withColumn("end", F.sum("n").over(Window.partitionBy("is_select").orderBy("part"))).withColumn("total", F.sum("n").over(Window.partitionBy("is_select")))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.greatest(F.ceil(F.col("total") * F.lit(p)), F.lit(1)).alias("rank")) for k, p in shares.items()]))
    ranks = ends.select("is_select", "part", "end", "n", wanted.alias("w")).where("w.rank <= end and w.rank > end - n").select("is_select", "part", "w.name", (F.col("w.rank") - F.col("end") + F.col("n")).alias("rank"))
    reached = F.sum("n").over(Window.partitionBy("is_select", "part", "name").orderBy("duration_ms"))
    inside = values.join(F.broadcast(ranks), ["is_select", "part"]).withColumn("reached", reached).where("reached >= rank")
    found = inside.groupBy("is_select", "name").agg(F.min("duration_ms").alias("ms"))
    return found.groupBy("is_select").agg(*[F.max(F.when(F.col("name") == k, F.col("ms"))).alias(k) for k in shares])
