"""Findings as text, log lines and HTML. Each takes at most `most` findings to the driver, the most urgent first,
and says how many it leaves out."""

from __future__ import annotations

import logging
from html import escape

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .pipeline import rank

LEVELS = {"critical": logging.ERROR, "warning": logging.WARNING, "info": logging.INFO}


def _first(findings: DataFrame, most: int) -> tuple[list[Row], str]:
    """The findings to show, and a line on those left out, if any."""
    order = ("apply_rank", F.desc(rank(F.col("severity"))), "scope_id", "first_seq", "pos")
    rows = findings.orderBy(*order).limit(most).collect()
    left = findings.count() - len(rows) if len(rows) == most else 0
    return rows, f"{left} more findings are not shown" if left else ""


def _place(row: Row) -> str:
    return f"{row.file_path}:{row.line_number}" if row.file_path else "unknown"


def console(findings: DataFrame, most: int = 1000) -> str:
    """Plain text, one finding after another."""
    rows, left = _first(findings, most)
    return "\n".join([f"[{r.severity.upper()}] {r.description}\n  at {_place(r)}\n  fix: {r.fix_suggestion}" for r in rows] + [left] * bool(left))


def grouped_console(groups: DataFrame, queries: int, issues: int, most: int = 1000) -> str:
    """Groups of findings as text, in their order."""
    rows = groups.orderBy("ord").limit(most + 1).collect()
    head = ["=" * 60, "Findings by group", f"Queries: {queries} | Groups: {groups.count()} | Findings: {issues}", "=" * 60]
    body = [f"{r.severity.upper()}: {r.summary}" for r in rows[:most]] or ["No issues detected."]
    return "\n".join(head + body + [f"{groups.count() - most} more groups are not shown"] * (len(rows) > most))


def log(findings: DataFrame, logger: logging.Logger, most: int = 1000) -> None:
    rows, left = _first(findings, most)
    for k, r in enumerate(rows, 1):
        logger.log(LEVELS[r.severity], "%s: %s (%s)%s", r.issue_type, r.description, _place(r), f"; {left}" if left and k == len(rows) else "")


def html(findings: DataFrame, title: str = "Findings", most: int = 1000) -> str:
    """A page with a table; all text is escaped."""
    rows, left = _first(findings, most)
    cells = "".join(f"<tr><td>{escape(r.severity)}</td><td>{escape(r.issue_type)}</td><td>{escape(r.description)}</td><td>{escape(_place(r))}</td><td>{escape(r.fix_suggestion)}</td></tr>" for r in rows)
    return f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr><th>Severity</th><th>Kind</th><th>Finding</th><th>Place</th><th>Fix</th></tr>{cells}</table>{f'<p>{left}</p>' if left else ''}</body></html>"


def write_json(findings: DataFrame, path: str) -> None:
    """All findings as JSON lines, written by the executors."""
    findings.select("issue_type", "severity", "description", "fix_suggestion", "file_path", "line_number", "query_count").write.mode("overwrite").json(path)
