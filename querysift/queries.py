"""The engine's queries: captures rendered from the events table, and the mapper's workload."""

from __future__ import annotations

import tempfile
import uuid
from functools import partial
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples
from .functions import query_spec, sql_text
from .operators import complexity, duplicate, fat_select, findings, fixes, missing_index, nplusone, queryset_eval, turbo, write_nplusone
from .plans import gate, report, workload
from .plans.enrich import known, settled
from .plans.pipeline import diagnose
from .settings import Settings
from .sources import captures, catalog, serializers, stacks
from .sources.catalog import Catalog
from .streaming.diagnosis import diagnose_stream, latest, scoped_by_session

Query = Callable[[SparkSession, str], DataFrame]
#: Parameters that queries and their SQL share.
BUDGET = (70, 20000.0)
BASELINE_FILTER = "issue_type <> 'queryset_eval' AND first_seq % 2 = 0"
RULES = [("file", "app0/*"), ("sql", "shop_nation"), ("callsite", "app1/views.py:100"), ("ignore", "fat_select:app2")]


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that all analyzers read, its patterns run once."""
    return known(captures.from_events(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str, rules: list[tuple[str, str]] = ()) -> DataFrame:
    return diagnose(captured(spark, sf_dir), Catalog(spark), rules=rules)


def shown(rows: DataFrame, *more: str) -> DataFrame:
    keep = ("scope_id", "issue_type", "severity", "description", "fix_suggestion", "file_path", "line_number", "query_count")
    return rows.select(*keep, F.round("time_saved_ms", 3).alias("time_saved_ms"), "fingerprint", "first_seq", "pos", *more)


def dotted(pairs) -> F.Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["table"], F.lit("."), p["column"])), ",")


def _on_captures(plan: Callable[[DataFrame, SparkSession], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(captured(spark, sf_dir), spark)


def _on_findings(plan: Callable[[DataFrame], DataFrame], often: bool = False) -> Query:
    """`often`: the plan reads the findings more than once."""
    return lambda spark, sf_dir: plan(settled(found(spark, sf_dir)) if often else found(spark, sf_dir))


def _on_both(plan: Callable[[DataFrame, DataFrame], DataFrame], often: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = captured(spark, sf_dir)
        out = diagnose(log, Catalog(spark))
        return plan(log, settled(out) if often else out)

    return run


def _analyzer(run: Callable[[DataFrame, Catalog], DataFrame]) -> Query:
    return _on_captures(lambda c, s: shown(run(c, Catalog(s))))


def _loops(strategy: str) -> Query:
    def plan(c: DataFrame, s: SparkSession) -> DataFrame:
        groups = findings.groups(c.where("is_select"), "fingerprint", "normalized_sql").where("query_count >= 3")
        out = nplusone.resolved(groups, c, Catalog(s)).where(F.col("strategy") == strategy)
        return out.select("scope_id", "fingerprint", "table", "field", F.coalesce("model_name", "table").alias("model_name"))

    return _on_captures(plan)


def _duplicates(c: DataFrame) -> DataFrame:
    keyed = c.where("is_select").withColumn("key", sql_text.duplicate_key(F.col("sql"), F.col("params_repr")))
    return findings.groups(keyed, "key", "fingerprint", "tables").where("query_count >= 2")


def _guarded(c: DataFrame, s: SparkSession) -> DataFrame:
    groups = _duplicates(c)
    return groups.join(duplicate.unguarded(groups, c).select("scope_id", "key"), ["scope_id", "key"], "left_anti").select("scope_id", "key")


def _accesses(c: DataFrame) -> DataFrame:
    return c.where("is_select").select((F.col("scope_id") % 4).alias("process_id"), "seq", "fingerprint", F.col("sql").alias("fresh_sql"))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select("scope_id", "issue_hash", "description")


def _replay(c: DataFrame, s: SparkSession) -> DataFrame:
    return turbo.replay(_accesses(c).withColumn("param_count", F.length(F.regexp_replace("fresh_sql", "[^?%]", "")))).select("process_id", "seq", "state", "held")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, which a cluster must name."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="querysift-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, sf_dir: str, parts: int = 1) -> DataFrame:
    """The events as a stream, diagnosed batch by batch. With several parts each scope comes in several batches."""
    folder, per_batch = shared_folder(spark, "stream"), {}
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = f"{sf_dir}/events.parquet*"
    if parts > 1:
        for i in range(parts):
            events.where(F.col("event_id") % parts == i).write.parquet(f"{folder}/in/part={i}")
        at, per_batch = f"{folder}/in/*", {"maxFilesPerTrigger": max(1, events.rdd.getNumPartitions())}
    rows = captures.rendered(spark.readStream.schema(events.schema).options(pathGlobFilter="*.parquet", **per_batch).parquet(at))
    diagnose_stream(rows, folder).awaitTermination()
    # Sums over batches add in another order; what is added keeps them off the edge where rounding turns.
    return shown(latest(spark, folder).withColumn("time_saved_ms", F.col("time_saved_ms") + 1e-6))


def _sessions(c: DataFrame, s: SparkSession) -> DataFrame:
    out = scoped_by_session(c, "scope_id", "6 hours")
    return out.select("scope_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "queries", F.round("time_ms", 3).alias("time_ms"))


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures written as a log of JSON lines and read again."""
    folder = shared_folder(spark, "log")
    captures.from_events(spark, sf_dir).write.json(folder)
    back = captures.read_log(spark, folder)
    return back.select("scope_id", "seq", "endpoint", "http_method", "sql", "duration_ms", "callsite.filepath", "callsite.line_number")


def _report_fields(c: DataFrame, f: DataFrame) -> DataFrame:
    """What a reader finds in the JSON reports."""
    item = "struct<issue_type: string, severity: string, description: string, location: struct<file: string, line: int>>"
    kind = f"version string, timestamp string, summary struct<total_queries: long, issues_found: long, critical: long, warnings: long, info: long>, prescriptions array<{item}>"
    read = report.json_report(c, f, F.lit("2024-01-02 03:04:05").cast("timestamp")).select("scope_id", F.from_json("report", kind).alias("r"))
    told = F.transform("r.prescriptions", lambda x: F.concat_ws("|", x["issue_type"], x["severity"], F.coalesce(x["location"]["file"], F.lit("null")), F.coalesce(x["location"]["line"], F.lit(0))))
    return read.select("scope_id", "r.version", "r.timestamp", "r.summary.*", F.md5(F.array_join(told, ";").cast("binary")).alias("told"))


def _comments(c: DataFrame, f: DataFrame) -> DataFrame:
    return report.review_comment(c, f).select("scope_id", F.size(F.split("comment", "\n")).alias("lines"), F.regexp_extract("comment", r"\*\*(\d+)\*\*", 1).alias("found"), F.md5(F.split("comment", "\n").getItem(4).cast("binary")).alias("first_line"))


def _baseline_fields(f: DataFrame) -> DataFrame:
    lines = report.baseline_document(f)
    head = report.document_head(lines)
    issues = report.document_issues(lines, "issue_type string, severity string, description string, file_path string, line int")
    counted = issues.groupBy("i.issue_type", "i.file_path", "i.line").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(head)).select("version", "issue_count", "issue_type", "file_path", "line", "n")


def _baseline_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline saved, read again, and compared with the findings."""
    f, folder = settled(found(spark, sf_dir)), shared_folder(spark, "baseline")
    report.write_baseline(f.where(BASELINE_FILTER), folder)
    return _hashed(report.regressions(f, report.read_baseline(spark, folder)))


def _project_fields(c: DataFrame, f: DataFrame) -> DataFrame:
    url = "struct<pattern: string, queries: long, issues: long, prescriptions: array<struct<issue_type: string>>>"
    kind = f"summary struct<total_urls: long, health_score: double>, apps array<struct<name: string, health_score: double, total_queries: long, critical_count: long, urls: array<{url}>>>, skipped_urls array<struct<pattern: string, reason: string>>"
    urls = gate.selected(gate.endpoints(c), ["POST"]).where("skip_reason is not null")
    d = report.project_document(c, f, urls).select(F.from_json("document", kind).alias("d"))
    apps = d.select("d.summary.*", F.posexplode("d.apps").alias("place", "a"), F.size("d.skipped_urls").alias("skipped"))
    return apps.select("total_urls", F.col("health_score").alias("overall"), "skipped", "place", "a.name", "a.health_score", "a.total_queries", "a.critical_count", F.explode("a.urls").alias("u")).select("*", "u.pattern", "u.issues", F.size("u.prescriptions").alias("kinds")).drop("u")


def _spans(c: DataFrame, f: DataFrame) -> DataFrame:
    return report.spans(c, f).select("scope_id", "attributes.total_queries", "attributes.issues", F.size("events").alias("events"), F.try_element_at("events", F.lit(1))["name"].alias("first_event"), "status")


def _lines(c: DataFrame) -> DataFrame:
    """Source lines as the captures' callsites show them: of several for a place the last, on odd lines a condition."""
    sites = c.where("callsite is not null").select(F.col("callsite.filepath").alias("file"), F.col("callsite.line_number").alias("line"), F.concat(F.lit("    "), "callsite.code_context").alias("text")).distinct()  # few, in hash tables; the least and the largest text need sorted rows
    condition = F.min(F.when(F.col("text").startswith("    if "), F.col("text")))
    return sites.groupBy("file", "line").agg(F.when(F.col("line") % 2 == 1, F.coalesce(condition, F.max("text"))).otherwise(F.max("text")).alias("text"))


def _fixes(plan: Callable[[DataFrame], DataFrame], c: DataFrame, f: DataFrame) -> DataFrame:
    return plan(fixes.proposed(f, _lines(c)))


def _resets(c: DataFrame, s: SparkSession) -> DataFrame:
    resets = c.where("seq % 997 = 0").select((F.col("scope_id") % 4).alias("process_id"), "seq")
    return turbo.lifecycle(_accesses(c), resets=resets).select("process_id", "seq", "era", "state")


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.specs(spark, sf_dir)
    return rows.select("event_id", query_spec.fingerprint().alias("fingerprint"), F.array_join(query_spec.params(), ",").alias("params"), query_spec.cacheable().alias("cacheable"))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns of made models an index serves, against what part's columns are called."""
    rows = [(m.name, n, catalog.indexed(m, n)) for m in catalog.CASES for n in (*[f.name for f in m.fields], "unknown")]
    return spark.createDataFrame(rows, "model string, field string, indexed boolean")


QUERIES: dict[str, Query] = {
    "normalize": _on_captures(lambda c, s: c.select("seq", "normalized_sql", "fingerprint", "is_select")),
    "extract_tables": _on_captures(lambda c, s: c.select("seq", F.array_join("tables", ",").alias("tables"))),
    "complexity_score": _on_captures(lambda c, s: c.where("is_select").select("seq", sql_text.complexity(F.col("normalized_sql")).alias("score"))),
    "where_columns": _on_captures(lambda c, s: c.where("is_select").select("seq", dotted(sql_text.where_columns(F.col("normalized_sql"))).alias("columns"))),
    "order_by_columns": _on_captures(lambda c, s: c.where("is_select").select("seq", dotted(sql_text.order_by_columns(F.col("normalized_sql"))).alias("columns"))),
    "write_classify": _on_captures(lambda c, s: c.where("not is_select").withColumn("w", sql_text.write_class(F.col("normalized_sql"), F.col("sql"))).where("w is not null").select("seq", "w.kind", "w.table")),
    "duplicate_groups": _on_captures(lambda c, s: _duplicates(c).select("scope_id", "key", "query_count", "first_seq", "last_seq")),
    "nplusone_groups": _on_captures(lambda c, s: findings.groups(c.where("is_select"), "fingerprint").where("query_count >= 3").select("scope_id", "fingerprint", "query_count", F.round("total_ms", 3).alias("total_ms"), "first_seq")),
    "nplusone": _analyzer(nplusone.analyze),
    "nplusone_forward_fk": _loops("select_related"),
    "nplusone_relations": _loops("prefetch_related"),
    "nplusone_bulk": _loops("bulk_fetch"),
    "duplicate": _analyzer(lambda c, k: duplicate.analyze(c)),
    "duplicate_write_guard": _on_captures(_guarded),
    "missing_index": _analyzer(missing_index.analyze),
    "fat_select": _analyzer(fat_select.analyze),
    "queryset_eval": _analyzer(lambda c, k: queryset_eval.analyze(c)),
    "complexity": _analyzer(lambda c, k: complexity.analyze(c)),
    "write_nplusone": _analyzer(write_nplusone.analyze),
    "pipeline_all": _on_findings(lambda f: shown(f, "apply_rank")),
    "pipeline_ordered": _on_findings(lambda f: report.ordered(f).select("scope_id", "ord", "issue_type", "fingerprint", "pos")),
    "pipeline_ignored": lambda spark, sf_dir: shown(found(spark, sf_dir, RULES), "apply_rank"),
    "stream_pipeline": _streamed,
    "scope_report": _on_both(lambda c, f: report.scope_report(c, f).withColumn("total_time_ms", F.round("total_time_ms", 3))),
    "json_report": _on_both(_report_fields, often=True),
    "review_comment": _on_both(_comments, often=True),
    "ci_issues": _on_findings(report.ci_issues),
    "project_document": _on_both(_project_fields, often=True),
    "project_endpoints": _on_both(lambda c, f: report.project_urls(c, f).select("app_name", "endpoint", "methods", "requests", "queries", "issues", "critical", F.round("mean_ms", 3).alias("mean_ms"))),
    "project_extremes": _on_both(lambda c, f: report.app_extremes(report.project_apps(c, f))),
    "trace_spans": _on_both(_spans, often=True),
    "session_summary": _on_both(report.session_summary),
    "admin_totals": _on_both(report.recorded_totals),
    "baseline_document": _on_findings(_baseline_fields),
    "baseline_read": _baseline_read,
    "fixes_proposed": _on_both(partial(_fixes, lambda x: x)),
    "fixes_patch": _on_both(partial(_fixes, lambda x: fixes.patch(x).select("file", F.md5(F.col("patch").cast("binary")).alias("patch")))),
    "fixes_refused": _on_both(partial(_fixes, fixes.refused)),
    "endpoint_scan": _on_captures(lambda c, s: gate.of_endpoint(c, "/r/3/").select("scope_id", "seq")),
    "read_log": _logged,
    "stack_callsites": lambda spark, sf_dir: samples.stacks(spark, sf_dir).select("event_id", stacks.callsite(F.col("stack"), ("/srv/app3/",)).alias("c")).select("event_id", "c.filepath", "c.line_number", "c.code_context"),
    "serializer_methods": lambda spark, sf_dir: serializers.scan(samples.serializer_sources(spark, sf_dir)).select("path", "serializer", "field", "pattern", "severity", "line"),
    "structural_fingerprint": _structures,
    "catalog_indexed": _indexed,
    "stream_sessions": _on_captures(_sessions),
    "stream_split_scopes": partial(_streamed, parts=3),
    "turbo_resets": _on_captures(_resets),
    "turbo_chart": _on_captures(lambda c, s: turbo.chart(turbo.top_entries(turbo.lifecycle(_accesses(c))))),
    "turbo_prepared": _on_captures(lambda c, s: turbo.prepared(turbo.top_entries(turbo.lifecycle(_accesses(c))), "postgresql")),
    "severity_histogram": _on_findings(lambda f: f.groupBy("severity", "issue_type").agg(F.count("*").alias("n"))),
    "ordering_note": _on_findings(report.ordering_note),
    "group_file_analyzer": _on_findings(report.grouped),
    "group_root_cause": _on_findings(lambda f: report.grouped(f, "root_cause")),
    "group_view": _on_findings(lambda f: report.grouped(f, "view")),
    "baseline_regressions": _on_findings(lambda f: _hashed(report.regressions(f, f.where(BASELINE_FILTER))), often=True),
    "baseline_known": _on_findings(lambda f: _hashed(report.known(f, f.where(BASELINE_FILTER))), often=True),
    "baseline_resolved": _on_findings(lambda f: _hashed(report.resolved(f.where("severity <> 'critical'"), f)), often=True),
    "filter_file": _on_findings(lambda f: shown(report.in_files(f, files=["app1/"]))),
    "filter_module": _on_findings(lambda f: shown(report.in_files(f, modules=["app2.views"]))),
    "filter_diff": _on_findings(lambda f: shown(report.in_changed(f, ["src/app3/views.py"]))),
    "filter_diff_empty": _on_findings(lambda f: shown(report.in_changed(f, []))),
    "fail_on": _on_findings(lambda f: report.failing(f, "critical")),
    "budget_violations": _on_captures(lambda c, s: report.budget_violations(c, *BUDGET).withColumn("time_ms", F.round("time_ms", 3))),
    "project_apps": _on_both(lambda c, f: report.project_apps(c, f).withColumn("time_ms", F.round("time_ms", 3))),
    "project_overall": _on_both(lambda c, f: report.project_overall(report.project_apps(c, f))),
    "ci_annotations": _on_findings(report.annotations),
    "admin_last50": _on_both(report.latest),
    "workload_shape": _on_captures(lambda c, s: report.workload_shape(c)),
    "turbo_lifecycle": _on_captures(lambda c, s: turbo.lifecycle(_accesses(c)).select("process_id", "seq", "n", "state")),
    "turbo_stats": _on_captures(lambda c, s: turbo.stats(turbo.lifecycle(_accesses(c)))),
    "turbo_top20": _on_captures(lambda c, s: turbo.top_entries(turbo.lifecycle(_accesses(c)))),
    "turbo_replay": _on_captures(_replay),
    "gate_sampled": _on_captures(lambda c, s: gate.admitted(c, Settings(sample_rate=0.5, ignored_prefixes=("/r/1",))).select("scope_id", "seq")),
    "project_urls": _on_captures(lambda c, s: gate.selected(gate.endpoints(c), ["POST"], ["/r/5"]).select("endpoint", "app_name", F.array_join("methods", ",").alias("methods"), "skip_reason")),
    "duration_percentiles": _on_captures(lambda c, s: gate.durations(c)),
    "slow_queries": _on_captures(lambda c, s: c.where("duration_ms > 100").select("scope_id", "seq", "duration_ms")),
} | workload.PLANS
