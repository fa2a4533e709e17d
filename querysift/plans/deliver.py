"""Reports by name, and when to deliver them."""

from __future__ import annotations

import logging
from collections.abc import Callable
from html import escape

from pyspark.sql import DataFrame

from .. import settings
from ..operators import turbo
from . import report, sinks

logger = logging.getLogger(__name__)
#: Reporters that settings name: each takes captures and findings.
REPORTERS: dict[str, Callable[[DataFrame, DataFrame], object]] = {
    "console": lambda captures, findings: print(sinks.console(findings)),
    "json": lambda captures, findings: [print(r.report) for r in report.json_report(captures, findings).toLocalIterator()],
    "log": lambda captures, findings: sinks.log(findings, logger),
}


def reporters(names: tuple[str, ...] | None = None) -> list[Callable[[DataFrame, DataFrame], object]]:
    """The reporters of those names; others are warned about and left out."""
    wanted = settings.current().reporters if names is None else names
    for name in wanted:
        if name not in REPORTERS:
            logger.warning("no reporter %r; there are %s", name, ", ".join(sorted(REPORTERS)))
    return [REPORTERS[x] for x in wanted if x in REPORTERS]


def deliver(captures: DataFrame, findings: DataFrame, to: list[Callable[[DataFrame, DataFrame], object]], record: Callable[[DataFrame], object] | None = None) -> bool:
    """Nothing without captures; otherwise the scopes are recorded, and reported if there are findings."""
    if captures.isEmpty():
        return False
    if record:
        record(report.scope_report(captures, findings))
    if findings.isEmpty():
        return False
    for one in to:
        try:
            one(captures, findings)
        except Exception:  # one reporter's failure is not the next one's
            logger.warning("a report failed", exc_info=True)
    return True


def export_spans(captures: DataFrame, findings: DataFrame, exporter: Callable[[dict], object] | None = None) -> int:
    """Hands each scope's span to `exporter`, or to the tracing library if that is installed; returns how many."""
    if exporter is None:
        try:
            from opentelemetry import trace
        except ImportError:
            logger.warning("no tracing library is installed; no spans are exported")
            return 0
        tracer = trace.get_tracer("querysift")

        def exporter(one: dict) -> None:
            with tracer.start_as_current_span(one["name"]) as span:
                for key, value in one["attributes"].items():
                    span.set_attribute(key, value)
                for event in one["events"]:
                    span.add_event(event["name"], {k: v for k, v in event["attributes"].items() if v is not None})
                if one["status"] == "ERROR":
                    span.set_status(trace.StatusCode.ERROR)

    n = 0
    for row in report.spans(captures, findings).toLocalIterator():
        exporter(row.asDict(recursive=True))
        n += 1
    return n


def _table(head: tuple[str, ...], rows: list[tuple]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{escape('' if x is None else str(x))}</{tag}>" for x in row)
    return f"<table><tr>{cells('th', head)}</tr>{''.join(f'<tr>{cells("td", r)}</tr>' for r in rows)}</table>"


def _page(title: str, *parts: str) -> str:
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{"".join(parts)}</body></html>'


def project_page(captures: DataFrame, findings: DataFrame, skipped: DataFrame | None = None, most: int = 1000) -> str:
    """The project as a page: the whole, its least and most healthy app, all apps by health, the endpoints with most
    findings (`most` of them, and how many more there are), and those skipped."""
    apps = report.project_apps(captures, findings).persist()
    whole, ends = report.project_overall(apps).first(), report.app_extremes(apps).first()
    by_health = [(r.app_name, r.health, r.urls, r.queries, r.issues, r.critical, r.warning) for r in apps.orderBy("health", "app_name").collect()]
    apps.unpersist()
    urls = report.project_urls(captures, findings)
    shown = urls.orderBy("issues", "endpoint", ascending=[False, True]).limit(most).collect()
    left = urls.count() - len(shown) if len(shown) == most else 0
    summary = f'<p class="{whole.color}">Health {whole.health:.1f}: {whole.urls or 0} endpoints, {whole.queries or 0} queries, {whole.issues or 0} findings.</p>'
    if by_health:
        summary += f"<p>Least healthy: {escape(ends.worst or '')} ({ends.worst_health}). Most healthy: {escape(ends.best or '')} ({ends.best_health}).</p>"
    parts = [summary, "<h2>Apps</h2>", _table(("App", "Health", "Endpoints", "Queries", "Findings", "Critical", "Warnings"), by_health)]
    parts += ["<h2>Endpoints</h2>", _table(("Endpoint", "App", "Methods", "Queries", "Findings"), [(r.endpoint, r.app_name, r.methods, r.queries, r.issues) for r in shown])]
    parts += [f"<p>{left} more endpoints are not shown.</p>"] * bool(left)
    if skipped is not None:
        parts += ["<h2>Skipped</h2>", _table(("Endpoint", "Reason"), [(r.endpoint, r.skip_reason) for r in skipped.orderBy("endpoint").collect()])]
    return _page("Project", *parts)


def cache_page(states: DataFrame | None) -> str:
    """The statement cache as a page: figures, a bar for each of the ten most used entries, and the top entries; zeros
    without a cache."""
    if states is None:
        figures, top, bars, ready = [], [], [], (0, 0)
    else:
        best = turbo.top_entries(states).persist()
        figures = [tuple(r) for r in turbo.stats(states).orderBy("process_id").collect()]
        top = [(r.hit_count, "yes" if r.trusted else "no", r.preview) for r in best.collect()]
        bars = [(r.label, r.hit_count) for r in turbo.chart(best).collect()]
        ready = tuple(turbo.prepared(best).first())
        best.unpersist()
    hits, misses = sum(r[1] for r in figures), sum(r[2] for r in figures)
    cards = _table(("Hits", "Misses", "Hit rate", "Entries", "Evictions", "Trusted", "Poisoned"), [(hits, misses, f"{100 * hits / max(1, hits + misses):.1f}%", *(sum(r[i] for r in figures) for i in (6, 4, 7, 8)))])
    widest = max((n for _, n in bars), default=1)
    drawn = "".join(f'<p>{escape(label)}<br><span style="display:inline-block;background:#468;height:1em;width:{100 * n // widest}%"></span> {n}</p>' for label, n in bars)
    return _page("Statement cache", cards, f"<p>Prepared: {ready[0]} of {sum(ready)} top entries.</p>", "<h2>Most used</h2>", drawn, _table(("Hits", "Trusted", "Statement"), top))
