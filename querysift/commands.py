"""What the command line does: python -m querysift <command> ..., on a log of captured statements.

Each command returns its text and its exit code: 0, or 1 where a check fails."""

from __future__ import annotations

import argparse
import logging
import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators import fixes, turbo
from .plans import deliver, gate, report, sinks
from .plans.enrich import known
from .plans.pipeline import diagnose, read_rules
from .sources import captures, serializers
from .sources.catalog import Catalog

logger = logging.getLogger(__name__)
LEVELS = ("info", "warning", "critical")


def changed_files(ref: str, root: str = ".") -> set[str]:
    """Files that differ between `ref` and the present commit; none where that cannot be told."""
    try:
        out = subprocess.run(["git", "diff", "--name-only", ref, "HEAD"], cwd=root, capture_output=True, text=True, check=True, timeout=60)
    except (OSError, subprocess.SubprocessError):
        logger.warning("the files changed since %s are not known", ref, exc_info=True)
        return set()
    return {x.strip() for x in out.stdout.splitlines() if x.strip()}


def _log(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return known(gate.admitted(captures.read_log(spark, a.log, a.kind)))


def _filtered(found: DataFrame, a: argparse.Namespace) -> DataFrame:
    """By file and module, then by what has changed."""
    found = report.in_files(found, a.file, a.module)
    return report.in_changed(found, sorted(changed_files(a.diff))) if getattr(a, "diff", None) else found


def _compared(spark: SparkSession, found: DataFrame, a: argparse.Namespace) -> tuple[DataFrame, str, bool]:
    """Saves a baseline, then compares with one: what to show, a line on it, and whether it fails."""
    if a.save_baseline:
        report.write_baseline(found, a.save_baseline)
    if not a.baseline:
        return found, "", False
    base = report.read_baseline(spark, a.baseline)
    new, gone = report.regressions(found, base), report.resolved(found, base)
    n = new.count()
    return new, f"{n} new, {gone.count()} resolved against the baseline\n", bool(a.fail_on_regression and n)


def _shown(log: DataFrame, found: DataFrame, a: argparse.Namespace) -> str:
    if a.group:
        return sinks.grouped_console(report.grouped(found, a.group), log.count(), found.count())
    if a.format == "json":
        return "\n".join(r.report for r in report.json_report(log, found).orderBy("scope_id").toLocalIterator())
    return sinks.console(found)


def check_queries(spark: SparkSession, a: argparse.Namespace) -> tuple[str, int]:
    """Findings of a log, or of one endpoint: filters, then the baseline, then the report, then the checks."""
    log = _log(spark, a)
    log = gate.of_endpoint(log, a.url) if a.url else log
    found = _filtered(diagnose(log, Catalog(spark), rules=read_rules(spark, a.ignore) if a.ignore else []), a).persist()
    shown, said, failed = _compared(spark, found, a)
    if a.fail_on:
        failed |= not found.where(found.severity.isin(*LEVELS[LEVELS.index(a.fail_on) :])).isEmpty()
    return said + _shown(log, shown, a), int(failed)


def diagnose_project(spark: SparkSession, a: argparse.Namespace) -> tuple[str, int]:
    """All endpoints of a log by app; those left out are listed with the reason."""
    log = _log(spark, a)
    urls = gate.selected(gate.endpoints(log), a.methods, a.exclude_urls, a.apps)
    wanted = urls.where("skip_reason is null").select("endpoint")
    log = log.join(wanted, "endpoint", "left_semi")
    found = _filtered(diagnose(log, Catalog(spark)), a).persist()
    shown, said, failed = _compared(spark, found, a)
    skipped = urls.where("skip_reason is not null").select("endpoint", "skip_reason")
    if a.group:
        return said + sinks.grouped_console(report.grouped(shown, a.group), log.count(), shown.count()), int(failed)
    text = report.project_document(log, shown, skipped).first().document if a.format == "json" else deliver.project_page(log, shown, skipped)
    return said + text, int(failed)


def fix_queries(spark: SparkSession, a: argparse.Namespace) -> tuple[str, int]:
    """Changes of source files as a patch; with --apply those that need no person are written."""
    log = _log(spark, a)
    log = gate.of_endpoint(log, a.url, strict=False) if a.url else log
    made = fixes.proposed(diagnose(log, Catalog(spark)), fixes.source_lines(spark, a.sources), a.issue_type, a.file).persist()
    if made.isEmpty():
        return "No fixes to apply.", 0
    text = "\n".join(r.patch for r in fixes.patch(made).orderBy("file").toLocalIterator())
    if not a.apply:
        return text, 0
    done, failed = fixes.write(made, backup=not a.no_backup)
    left = fixes.refused(made).first()
    lines = [text, f"Changed {len(done)} file(s)."]
    lines += [f"Left {left.refused} change(s) to a person: {left.kinds}."] * bool(left.refused)
    lines += [f"Rejected, as they would not parse: {', '.join(failed)}."] * bool(failed)
    return "\n".join(lines), int(bool(failed))


def check_serializers(spark: SparkSession, a: argparse.Namespace) -> tuple[str, int]:
    """Findings of serializer classes in source files."""
    found = serializers.as_findings(serializers.scan(serializers.read_sources(spark, a.sources, tuple(a.module) or ("serializers",))))
    found = report.in_files(found, a.file).persist()
    failed = bool(a.fail_on) and not found.where(found.severity.isin(*LEVELS[LEVELS.index(a.fail_on) :])).isEmpty()
    if a.format == "json":
        return "\n".join(report.ci_issues(found).toJSON().toLocalIterator()), int(failed)
    return sinks.console(found.selectExpr("*", "1 AS apply_rank")), int(failed)


def query_budget(spark: SparkSession, a: argparse.Namespace) -> tuple[str, int]:
    """Scopes beyond a number of queries or a time."""
    over = report.budget_violations(_log(spark, a), a.max_queries, a.max_time_ms)
    rows = over.orderBy("scope_id").limit(a.most + 1).collect()
    lines = [f"scope {r.scope_id}: {r.queries} queries, {r.time_ms:.1f} ms, beyond the budget of {r.violation}" for r in rows[: a.most]]
    lines += ["... and more"] * (len(rows) > a.most)
    return "\n".join(lines) or "Query budget OK", int(bool(rows))


def cache_report(spark: SparkSession, a: argparse.Namespace) -> tuple[str, int]:
    """The statement cache as a page, from a log of accesses; zeros without one."""
    return deliver.cache_page(turbo.lifecycle(spark.read.format(a.kind).load(a.log)) if a.log else None), 0


COMMANDS = {"check_queries": check_queries, "diagnose_project": diagnose_project, "fix_queries": fix_queries, "check_serializers": check_serializers, "query_budget": query_budget, "cache_report": cache_report}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="querysift")
    sub = out.add_subparsers(dest="command", required=True)
    for name, run in COMMANDS.items():
        p = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        p.add_argument("--log", required=name not in ("check_serializers", "cache_report"), help="captured statements")
        p.add_argument("--kind", default="json", help="format of the log")
        p.add_argument("--output", "-o", help="write there instead of to the terminal")
        if name != "cache_report":
            p.add_argument("--file", action="append", default=[])
        if name in ("check_queries", "diagnose_project", "check_serializers"):
            p.add_argument("--module", action="append", default=[])
            p.add_argument("--format", choices=("console", "json", "html"), default="console")
            p.add_argument("--fail-on", choices=LEVELS)
        if name in ("check_queries", "diagnose_project"):
            for flag in ("--save-baseline", "--baseline"):
                p.add_argument(flag)
            p.add_argument("--fail-on-regression", action="store_true")
            p.add_argument("--group", nargs="?", const="file_analyzer", choices=("file_analyzer", "root_cause", "view"))
        if name in ("check_queries", "fix_queries"):
            p.add_argument("--url")
        if name == "check_queries":
            p.add_argument("--diff")
            p.add_argument("--ignore", help="a file of rules")
        if name == "diagnose_project":
            for flag in ("--apps", "--exclude-urls", "--methods"):
                p.add_argument(flag, nargs="*", default=[])
        if name in ("fix_queries", "check_serializers"):
            p.add_argument("--sources", required=True, help="folder of Python files")
        if name == "fix_queries":
            p.add_argument("--issue-type", action="append", default=[])
            p.add_argument("--apply", action="store_true")
            p.add_argument("--no-backup", action="store_true")
        if name == "query_budget":
            p.add_argument("--max-queries", type=int, required=True)
            p.add_argument("--max-time-ms", type=float)
            p.add_argument("--most", type=int, default=100, help="scopes to list")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    text, code = COMMANDS[a.command](spark or SparkSession.builder.appName("querysift").getOrCreate(), a)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as out:
            out.write(text)
    else:
        print(text)
    return code
