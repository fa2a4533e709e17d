"""What is made of findings: reports, groups, baselines, filters, budgets and roll-ups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .enrich import settled
from .pipeline import rank

VERSION = "1"
ORDERING_NOTE = (  # fixed value
    "Note: findings are listed in the order to apply them. Resolving the N+1 above with select_related() widens the base query, "
    "so re-read the fat SELECT findings only after that."
)


def ordered(findings: DataFrame) -> DataFrame:
    """Findings with `ord`, their place in their scope: by apply rank, analyzer and first use."""
    place = Window.partitionBy("scope_id").orderBy("apply_rank", "analyzer_ord", "first_seq", "pos", "fingerprint")
    return findings.withColumn("ord", F.row_number().over(place))


def count_if(condition: Column | str) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def severities() -> list[Column]:
    return [count_if(F.col("severity") == x).alias(x) for x in ("critical", "warning", "info")]


def scope_report(captures: DataFrame, findings: DataFrame) -> DataFrame:
    """Each scope's queries, time and findings."""
    totals = captures.groupBy("scope_id").agg(F.count("*").alias("total_queries"), F.sum("duration_ms").alias("total_time_ms"))
    found = findings.groupBy("scope_id").agg(F.count("*").alias("issues"), count_if("issue_type = 'n_plus_one'").alias("n_plus_one_count"), *severities())
    counts = [F.coalesce(x, F.lit(0)).alias(x) for x in ("issues", "n_plus_one_count", "critical", "warning", "info")]
    return totals.join(found, "scope_id", "left").select("scope_id", "total_queries", "total_time_ms", *counts, (F.coalesce("critical", F.lit(0)) > 0).alias("has_critical"))


def ordering_note(findings: DataFrame) -> DataFrame:
    kinds = findings.groupBy("scope_id").agg(F.bool_or(F.col("issue_type") == "n_plus_one").alias("a"), F.bool_or(F.col("issue_type") == "fat_select").alias("b"))
    return kinds.select("scope_id", F.when(F.col("a") & F.col("b"), ORDERING_NOTE).otherwise("").alias("note"))


def json_report(captures: DataFrame, findings: DataFrame, at: Column | None = None, most: int = 10_000) -> DataFrame:
    """One JSON text a scope: version, timestamp, summary, and the findings in order, an empty list if there are none.

    Beyond `most` findings of a scope, the rest is counted in `prescriptions_left`, which is null otherwise."""
    location = F.when(F.col("file_path").isNotNull(), F.struct(F.col("file_path").alias("file"), F.col("line_number").alias("line"), F.col("function_name").alias("function")))
    finding = F.struct("issue_type", "severity", "description", "fix_suggestion", location.alias("location"), "query_count", F.col("time_saved_ms").alias("estimated_savings_ms"))
    lists = ordered(findings).where(F.col("ord") <= most).groupBy("scope_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", finding.alias("finding")))), lambda x: x["finding"]).alias("prescriptions"))
    summary = F.struct("total_queries", "total_time_ms", F.col("issues").alias("issues_found"), "critical", F.col("warning").alias("warnings"), "info")
    both = scope_report(captures, findings).join(lists, "scope_id", "left")
    none = F.from_json(F.lit("[]"), lists.schema["prescriptions"].dataType)
    made = F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    left = F.when(F.col("issues") > most, F.col("issues") - most)
    whole = F.struct(F.lit(VERSION).alias("version"), made.alias("timestamp"), summary.alias("summary"), F.coalesce("prescriptions", none).alias("prescriptions"), left.alias("prescriptions_left"))
    return both.select("scope_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("report"))


def review_comment(captures: DataFrame, findings: DataFrame, title: str = "Query findings", most: int = 200) -> DataFrame:
    """One comment for a code review a scope, in Markdown: each finding with its place, then how to mend them.

    Beyond `most` findings the comment says how many more there are."""
    place = F.when(F.col("file_path").isNotNull(), F.format_string(" (%s:%d)", "file_path", F.coalesce("line_number", F.lit(0)))).otherwise("")
    line = F.concat(F.lit("- **"), F.upper("severity"), F.lit("**: "), "description", place)
    fix = F.when(F.coalesce("fix_suggestion", F.lit("")) != "", F.concat(F.lit("- "), "fix_suggestion"))
    listed = ordered(findings).where(F.col("ord") <= most).groupBy("scope_id").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line"), fix.alias("fix")))).alias("x"))
    both = scope_report(captures, findings).select("scope_id", "issues").join(listed, "scope_id", "left")
    lines = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    fixes = F.array_join(F.filter(F.transform("x", lambda x: x["fix"]), lambda x: x.isNotNull()), "\n")
    more = F.when(F.col("issues") > most, F.format_string("\n- and %d more", F.col("issues") - most)).otherwise("")
    found = F.concat(F.format_string(f"## {title}\n\nFound **%d** query issue(s):\n\n", "issues"), lines, more, F.lit("\n\n<details><summary>How to fix</summary>\n\n"), fixes, F.lit("\n\n</details>"))
    return both.select("scope_id", F.when(F.col("issues") == 0, f"## {title}\n\nNo query issues found.").otherwise(found).alias("comment"))


def ci_issues(findings: DataFrame) -> DataFrame:
    """A flat list for scripts: severity, issue_type, message, suggestion, file, line and query_count of each finding."""
    return findings.select(
        "severity", "issue_type", F.col("description").alias("message"), F.col("fix_suggestion").alias("suggestion"), F.coalesce("file_path", F.lit("")).alias("file"), F.coalesce("line_number", F.lit(0)).alias("line"), "query_count",
    )


def group_key(strategy: str) -> Column:
    file = F.coalesce("file_path", F.lit("unknown"))
    default = F.concat(file, F.lit(":"), "issue_type")
    if strategy == "root_cause":
        return F.when(F.coalesce("fix_suggestion", F.lit("")) != "", F.col("fix_suggestion")).otherwise(default)
    return F.coalesce(F.get(F.array(F.col("extra")["endpoint"]), F.lit(0)), file) if strategy == "view" else default


def grouped(findings: DataFrame, strategy: str = "file_analyzer") -> DataFrame:
    """Groups of findings: size, highest severity and a summary by the first member; `ord` is their order, the most
    severe and largest first, then the one met first."""
    first = F.struct("scope_id", "apply_rank", "analyzer_ord", "first_seq", "pos", "fingerprint", F.coalesce("file_path", F.lit("")).alias("file"), "description")
    out = findings.groupBy(group_key(strategy).alias("key")).agg(F.count("*").alias("count"), F.max(rank(F.col("severity"))).alias("rank"), F.min(first).alias("first"))
    many = F.concat(F.col("count").cast("string"), F.lit(" related issues in "), "first.file", F.lit(": "), "first.description", F.lit(" (and "), (F.col("count") - 1).cast("string"), F.lit(" more)"))
    severity = F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")), F.col("rank") + 1)
    # Groups are places in code: as many as there are of those, however long the log.
    place = F.row_number().over(Window.orderBy(F.desc("rank"), F.desc("count"), "first", "key"))
    return out.select("key", "count", severity.alias("severity"), F.when(F.col("count") == 1, F.col("first.description")).otherwise(many).alias("summary"), place.alias("ord"))


def issue_hash(findings: DataFrame) -> DataFrame:
    key = F.concat_ws(":", "issue_type", F.coalesce("file_path", F.lit("")), "description")
    return findings.withColumn("issue_hash", F.substring(F.sha2(key.cast("binary"), 256), 1, 16))


def regressions(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that the baseline does not hold; repeated ones stay repeated."""
    return issue_hash(findings).join(issue_hash(baseline).select("issue_hash").distinct(), "issue_hash", "left_anti")


def resolved(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Issues of the baseline that no longer occur."""
    return issue_hash(baseline).join(issue_hash(findings).select("issue_hash").distinct(), "issue_hash", "left_anti")


def known(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return issue_hash(findings).join(issue_hash(baseline).select("issue_hash").distinct(), "issue_hash", "left_semi")


def baseline_issues(findings: DataFrame) -> DataFrame:
    return findings.select("issue_type", "severity", "description", "file_path", F.col("line_number").alias("line"), "fix_suggestion")


_ITEM = ("issue_type", "severity", "description", "file_path", "line", "fix_suggestion")
#: Lines of a baseline that are no issue.
_HEAD, _END = r'^\{"version":"(.*)","issue_count":(\d+),"issues":\[$', "]}"


def baseline_document(findings: DataFrame, block: int = 10_000) -> DataFrame:
    """One JSON text in lines (`document`), in order: version, issue_count and issues, in a fixed order, one a line.

    No row holds more than a line. Equal issues are counted before they are sorted and written out by `block` at most, so
    that neither a list nor an issue met very often lies in one task."""
    item = F.struct(*_ITEM)
    counted = settled(baseline_issues(findings).groupBy(*_ITEM).agg(F.count("*").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.min(item).alias("first"))
    blocks = counted.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))).alias("b"))
    issues = blocks.join(F.broadcast(total.select("first"))).select(F.lit(1).alias("part"), *_ITEM, "b", "n", item.eqNullSafe(F.col("first")).alias("leads"), F.lit(None).cast("long").alias("total"))
    none = [F.lit(None).cast(issues.schema[x].dataType).alias(x) for x in _ITEM]
    ends = total.select(F.explode(F.array(F.lit(0), F.lit(2))).alias("part"), *none, F.lit(0).alias("b"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("leads"), "total")
    placed = ends.unionByName(issues).orderBy("part", *_ITEM, "b")
    copies = F.explode(F.sequence(F.lit(1), F.least(F.lit(block), F.col("n") - F.col("b") * block).cast("int"))).alias("copy")
    head = F.concat(F.lit(f'{{"version":"{VERSION}","issue_count":'), F.col("total").cast("string"), F.lit(',"issues":['))
    comma = F.when(F.col("leads") & (F.col("b") == 0) & (F.col("copy") == 1), "").otherwise(",")
    line = F.when(F.col("part") == 0, head).when(F.col("part") == 2, _END).otherwise(F.concat(comma, F.to_json(item, {"ignoreNullFields": "false"})))
    return placed.select("*", copies).select(line.alias("document"))


def write_baseline(findings: DataFrame, path: str, table: bool = False) -> None:
    """The findings as one JSON document, whose lines lie in files in the order of their names, or with `table` as JSON
    lines in any order."""
    if table:
        baseline_issues(findings).write.mode("overwrite").json(path)
    else:
        baseline_document(findings).write.mode("overwrite").text(path)


def document_head(lines: DataFrame) -> DataFrame:
    """version and issue_count of a baseline's lines, in any order."""
    part = lambda i: F.regexp_extract("document", _HEAD, i)
    return lines.where(F.col("document").rlike(_HEAD)).select(part(1).alias("version"), part(2).cast("int").alias("issue_count"))


def document_issues(lines: DataFrame, kind: str) -> DataFrame:
    """The issues (`i`, of that kind) of a baseline's lines (`document`), in any order."""
    text = F.regexp_replace("document", "^,", "")
    issue = F.col("document").endswith("}") & (F.col("document") != _END)
    # The optimizer may parse before it filters.
    return lines.where(issue).select(F.from_json(F.when(issue, text), kind, {"mode": "FAILFAST"}).alias("i"))


class BaselineError(ValueError):
    """A baseline that cannot be read."""


_ISSUE = "struct<issue_type: string, analyzer: string, severity: string, description: string, message: string, file_path: string, callsite: struct<filepath: string>, line: int, fix_suggestion: string>"


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The issues of a baseline in either form, ready for regressions(), known() and resolved().

    Lines of ours and of tables are read line by line; only a document of another hand is read as a whole, since it may
    break its lines anywhere. Another key for the kind, the place or the text stands in where the usual one is missing."""
    try:
        lines = spark.read.text(path).withColumnRenamed("value", "document")
        shown = lines.where(F.trim("document") != "").limit(1).select("document", F.from_json("document", "issues string, version string, issue_type string, analyzer string, description string, message string").alias("d")).first()
        if shown is None or shown.document == _END or shown.document.startswith(",{") or re.match(_HEAD, shown.document):
            rows = document_issues(lines, _ISSUE)
        elif shown.d and shown.d.issues is None and shown.d.version is None and any(x is not None for x in shown.d):
            rows = document_issues(lines, _ISSUE)
        else:
            texts = spark.read.text(path, wholetext=True).select(F.from_json("value", f"version string, issues array<{_ISSUE}>", {"mode": "FAILFAST"}).alias("d"))
            rows = texts.select(F.explode("d.issues").alias("i"))
        out = rows.select(
            F.coalesce("i.issue_type", "i.analyzer").alias("issue_type"), "i.severity", F.coalesce("i.description", "i.message").alias("description"),
            F.coalesce("i.file_path", "i.callsite.filepath").alias("file_path"), F.col("i.line").alias("line_number"), "i.fix_suggestion",
        )
        out.limit(1).collect()
    except Exception as e:
        raise BaselineError(f"cannot read the baseline at {path}") from e
    return out


def module_of(path: Column) -> Column:
    return F.replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.py$", ""), F.lit("/"), F.lit("."))


def in_files(findings: DataFrame, files: list[str] = (), modules: list[str] = ()) -> DataFrame:
    """Findings whose path holds any of `files` or whose module any of `modules`; all, if neither is given."""
    hit = F.lit(not files and not modules)
    for part, column in [(x, F.col("file_path")) for x in files] + [(x, module_of(F.col("file_path"))) for x in modules]:
        hit |= F.coalesce(column.contains(part), F.lit(False))
    return findings.where(hit)


def in_changed(findings: DataFrame, changed: list[str]) -> DataFrame:
    """Findings in changed files (paths match if either ends with the other); none, if nothing changed."""
    hit = F.lit(False)
    for path in changed:
        hit |= F.coalesce(F.col("file_path").endswith(path) | F.endswith(F.lit(path), F.col("file_path")), F.lit(False))
    return findings.where(hit)


def failing(findings: DataFrame, level: str) -> DataFrame:
    """Scopes, and whether any finding is as severe as `level`."""
    return findings.groupBy("scope_id").agg((F.max(rank(F.col("severity"))) >= {"info": 0, "warning": 1, "critical": 2}[level]).alias("failed"))


def budget_violations(captures: DataFrame, max_queries: int | None, max_time_ms: float | None) -> DataFrame:
    """Scopes beyond the budget; the number of queries is checked first."""
    total = captures.groupBy("scope_id").agg(F.count("*").alias("queries"), F.sum("duration_ms").alias("time_ms"))
    over_count = F.col("queries") > max_queries if max_queries is not None else F.lit(False)
    over_time = F.col("time_ms") > max_time_ms if max_time_ms is not None else F.lit(False)
    return total.withColumn("violation", F.when(over_count, "queries").when(over_time, "time")).where("violation is not null")


def project_apps(captures: DataFrame, findings: DataFrame) -> DataFrame:
    """Each app's endpoints, queries, time, findings and health (from 100 down)."""
    apps = captures.groupBy("app_name").agg(F.countDistinct("endpoint").alias("urls"), F.count("*").alias("queries"), F.sum("duration_ms").alias("time_ms"))
    of = captures.select("scope_id", "app_name").distinct()
    found = findings.join(of, "scope_id").groupBy("app_name").agg(F.count("*").alias("issues"), *severities())
    filled = apps.join(found, "app_name", "left").na.fill(0, ["issues", "critical", "warning", "info"])
    return filled.withColumn("health", F.greatest(F.lit(0), 100 - 15 * F.col("critical") - 5 * F.col("warning") - F.col("info")).cast("int"))


def project_overall(apps: DataFrame) -> DataFrame:
    color = F.when(F.col("health") >= 80, "green").when(F.col("health") >= 60, "amber").otherwise("red")
    total = apps.agg(F.sum("urls").alias("urls"), F.sum("queries").alias("queries"), F.sum("issues").alias("issues"), F.coalesce(F.avg("health"), F.lit(100.0)).alias("health"))
    return total.withColumn("color", color)


def project_urls(captures: DataFrame, findings: DataFrame) -> DataFrame:
    """Each endpoint's app, methods, requests, queries, time, findings and mean time of a request."""
    urls = captures.where("endpoint is not null").groupBy("app_name", "endpoint").agg(
        F.array_join(F.array_sort(F.collect_set("http_method")), ",").alias("methods"), F.countDistinct("scope_id").alias("requests"), F.count("*").alias("queries"), F.sum("duration_ms").alias("time_ms"),
    )
    of = captures.select("scope_id", "app_name", "endpoint").distinct()
    found = findings.join(of, "scope_id").groupBy("app_name", "endpoint").agg(F.count("*").alias("issues"), *severities())
    filled = urls.join(found, ["app_name", "endpoint"], "left").na.fill(0, ["issues", "critical", "warning", "info"])
    return filled.withColumn("mean_ms", F.col("time_ms") / F.col("requests"))


def project_document(captures: DataFrame, findings: DataFrame, skipped: DataFrame | None = None, started: Column | None = None, finished: Column | None = None, most: int = 100) -> DataFrame:
    """The whole project as one JSON text: summary, apps (least healthy first) with their endpoints, skipped endpoints.

    An endpoint lists each of its findings once, `most` of them at most, by apply order; `prescriptions_left` counts
    the others. The text grows with the number of endpoints, not with the log."""
    stamp = lambda c: F.date_format(c if c is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    of = captures.select("scope_id", "app_name", "endpoint").distinct()
    place = F.when(F.col("file_path").isNotNull(), F.concat_ws(":", "file_path", "line_number")).alias("location")
    each = findings.join(of, "scope_id").groupBy("app_name", "endpoint", "issue_type", "severity", "description", "fix_suggestion", place).agg(F.min("apply_rank").alias("r"))
    order = Window.partitionBy("app_name", "endpoint").orderBy("r", "issue_type", "description", "location", "fix_suggestion", "severity")
    placed = each.withColumn("ord", F.row_number().over(order))
    kinds = placed.groupBy("app_name", "endpoint").agg(F.count("*").alias("kinds"))
    item = F.struct("issue_type", "severity", "description", "fix_suggestion", "location")
    lists = placed.where(F.col("ord") <= most).groupBy("app_name", "endpoint").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", item.alias("i")))), lambda x: x["i"]).alias("prescriptions"))
    keys = ["app_name", "endpoint"]
    urls = project_urls(captures, findings).join(lists, keys, "left").join(kinds, keys, "left")
    none = F.from_json(F.lit("[]"), lists.schema["prescriptions"].dataType)
    url = F.struct(
        F.col("endpoint").alias("pattern"), "methods", "queries", "issues", F.round("mean_ms", 1).alias("duration_ms"), F.coalesce("prescriptions", none).alias("prescriptions"),
        F.when(F.col("kinds") > most, F.col("kinds") - most).alias("prescriptions_left"),
    )
    by_app = urls.groupBy("app_name").agg(F.sort_array(F.collect_list(url)).alias("urls"))
    apps = project_apps(captures, findings).withColumnRenamed("urls", "url_count").join(by_app, "app_name", "left")
    app = F.struct(
        F.col("app_name").alias("name"), F.round(F.col("health").cast("double"), 1).alias("health_score"), F.col("queries").alias("total_queries"), F.col("issues").alias("total_issues"),
        F.col("critical").alias("critical_count"), F.col("warning").alias("warning_count"), "urls",
    )
    whole = apps.agg(
        F.coalesce(F.sum("url_count"), F.lit(0)).alias("total_urls"), F.coalesce(F.sum("queries"), F.lit(0)).alias("total_queries"), F.coalesce(F.sum("issues"), F.lit(0)).alias("total_issues"), F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"),
        F.coalesce(F.sum("warning"), F.lit(0)).alias("warnings"), F.round(F.coalesce(F.avg("health"), F.lit(100.0)), 1).alias("health_score"), F.sort_array(F.collect_list(F.struct("health", "app_name", app.alias("a")))).alias("apps"),
    )
    if skipped is None:
        skipped = captures.sparkSession.createDataFrame([], "endpoint string, skip_reason string")
    left_out = skipped.agg(F.sort_array(F.collect_list(F.struct(F.col("endpoint").alias("pattern"), F.col("skip_reason").alias("reason")))).alias("skipped_urls"))
    both = whole.join(F.broadcast(left_out))  # one row each
    summary = F.struct("total_urls", "total_queries", "total_issues", "critical", "warnings", "health_score")
    made = F.struct(stamp(started).alias("started_at"), stamp(finished).alias("finished_at"), summary.alias("summary"), F.transform("apps", lambda x: x["a"]).alias("apps"), "skipped_urls")
    return both.select(F.to_json(made, {"ignoreNullFields": "false"}).alias("document"))


def app_extremes(apps: DataFrame) -> DataFrame:
    """The least and the most healthy app; ties go to the smaller name."""
    worst, best = F.min_by("app_name", F.struct("health", "app_name")), F.min_by("app_name", F.struct(-F.col("health"), F.col("app_name")))
    return apps.agg(worst.alias("worst"), F.min("health").alias("worst_health"), best.alias("best"), F.max("health").alias("best_health"))


def spans(captures: DataFrame, findings: DataFrame, most: int = 128) -> DataFrame:
    """One tracing span a scope: three attributes, an event for each finding (`most` at most, in order), and the status."""
    event = F.struct(F.col("issue_type").alias("name"), F.struct("severity", "description", "file_path", "line_number").alias("attributes"))
    events = ordered(findings).where(F.col("ord") <= most).groupBy("scope_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", event.alias("e")))), lambda x: x["e"]).alias("events"))
    both = scope_report(captures, findings).join(events, "scope_id", "left")
    attributes = F.struct("total_queries", "total_time_ms", "issues")
    return both.select("scope_id", F.lit("diagnosis").alias("name"), attributes.alias("attributes"), F.coalesce("events", F.from_json(F.lit("[]"), events.schema["events"].dataType)).alias("events"), F.when(F.col("has_critical"), "ERROR").otherwise("OK").alias("status"))


def session_summary(captures: DataFrame, findings: DataFrame) -> DataFrame:
    """Scopes observed, those without findings and those with."""
    per = scope_report(captures, findings)
    return per.agg(F.count("*").alias("observed"), count_if("issues = 0").alias("clean"), count_if("issues > 0").alias("with_findings"))


def recorded_totals(captures: DataFrame, findings: DataFrame, most: int = 50) -> DataFrame:
    """What the last reports hold together."""
    return latest(captures, findings, most).agg(F.count("*").alias("reports"), F.coalesce(F.sum("total_queries"), F.lit(0)).alias("queries"), F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"), count_if("issues > 0").alias("with_issues"))


def annotations(findings: DataFrame) -> DataFrame:
    """One line for a code-review annotation per finding."""
    level = F.when(F.col("severity") == "critical", "error").otherwise("warning")
    line = F.format_string("::%s file=%s,line=%d::%s", level, F.coalesce("file_path", F.lit("")), F.coalesce("line_number", F.lit(0)), F.replace("description", F.lit("\n"), F.lit(" ")))
    return findings.select("scope_id", line.alias("annotation"))


def latest(captures: DataFrame, findings: DataFrame, most: int = 50) -> DataFrame:
    """The last scopes to end, newest first by `place`."""
    ended = captures.groupBy("scope_id").agg(F.max("captured_at").alias("recorded_at"), F.count("*").alias("total_queries"))
    last = ended.orderBy(F.desc("recorded_at"), "scope_id").limit(most)
    found = findings.groupBy("scope_id").agg(F.count("*").alias("issues"))
    kept = last.join(found, "scope_id", "left").na.fill(0, ["issues"])
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("recorded_at"), "scope_id")))


def workload_shape(captures: DataFrame) -> DataFrame:
    return captures.agg(
        count_if("is_select").alias("selects"), count_if("not is_select").alias("writes"), F.countDistinct("fingerprint").alias("fingerprints"), F.countDistinct("callsite.filepath", "callsite.line_number").alias("callsites"),
    )
