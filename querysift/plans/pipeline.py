"""The diagnosis: all analyzers over one log, ignore rules, apply order."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from functools import reduce
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..operators import complexity, duplicate, fat_select, findings, missing_index, nplusone, queryset_eval, write_nplusone
from ..settings import Settings
from ..sources.catalog import Catalog

logger = logging.getLogger(__name__)

#: In which order findings are to be applied, and what severities weigh.
APPLY_ORDER = {"n_plus_one": 0, "write_n_plus_one": 0, "duplicate_query": 1, "serializer_method_field": 1, "drf_serializer": 1, "missing_index": 2, "queryset_eval": 2, "complexity": 3, "fat_select": 4}
RANKS = {"info": 0, "warning": 1, "critical": 2}
PLUGINS = "querysift.analyzers"

#: Captures, catalog and the options that settings hold for it, to findings.
Analyzer = Callable[..., DataFrame]
BUILT_IN: dict[str, Analyzer] = {
    "nplusone": nplusone.analyze,
    "duplicate": lambda c, cat, **k: duplicate.analyze(c, **k),
    "missing_index": missing_index.analyze,
    "fat_select": fat_select.analyze,
    "queryset_eval": lambda c, cat, **k: queryset_eval.analyze(c, **k),
    "complexity": lambda c, cat, **k: complexity.analyze(c, **k),
    "write_nplusone": write_nplusone.analyze,
}


def analyzers() -> dict[str, Analyzer]:
    """The built-in analyzers, then those of installed plugins; a plugin that cannot be loaded is skipped and logged."""
    found = dict(BUILT_IN)
    for plugin in entry_points(group=PLUGINS):
        try:
            run = plugin.load()
        except Exception:  # whatever a plugin does, the others still run
            logger.warning("analyzer %s cannot be loaded", plugin.name, exc_info=True)
            continue
        if callable(run):
            found[plugin.name] = run
        else:
            logger.warning("analyzer %s is no function of captures and catalog", plugin.name)
    return found


def rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == k, v) for k, v in RANKS.items()])


def apply_rank(issue_type: Column) -> Column:
    return F.coalesce(*[F.when(issue_type == k, v) for k, v in APPLY_ORDER.items()], F.lit(2))


def diagnose(captures: DataFrame, catalog: Catalog, using: Settings | None = None, rules: list[tuple[str, str]] = (), also: dict[str, Analyzer] | None = None) -> DataFrame:
    """Findings of enriched captures. Rules drop findings, never captures; `apply_rank` is the place in order.

    The captures feed every analyzer: hand over a written or persisted table when they are costly to derive. An analyzer
    that raises while its plan is made is logged and skipped."""
    known, found = using or settings.current(), [findings.none(captures.sparkSession)]
    for name, run in {**analyzers(), **(also or {})}.items():
        if not known.runs(name):
            continue
        try:
            own = run(captures, catalog, **known.options(name))
            found.append(found[0].unionByName(own, allowMissingColumns=True))
        except Exception:
            logger.warning("analyzer %s failed", name, exc_info=True)
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found[1:] or found)
    return ignored(whole, captures, rules).withColumn("apply_rank", apply_rank(F.col("issue_type")))


def glob_pattern(glob: str) -> str:
    """A shell-style pattern as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if close > 0:
            inside = glob[i + 1 : close].replace("\\", r"\\")
            out, i = f"{out}[{'^' + inside[1:] if inside[0] == '!' else inside}]", close
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def parse_rules(lines: list[str]) -> list[tuple[str, str]]:
    """`kind:pattern` lines; blank lines, comments and lines without a colon say nothing."""
    kept = [x.strip() for x in lines if x.strip() and not x.strip().startswith("#") and ":" in x]
    return [(a.strip(), b.strip()) for a, _, b in (x.partition(":") for x in kept)]


def read_rules(spark, path: str) -> list[tuple[str, str]]:
    """Rules of a file, one a line; the file is written by hand and small."""
    return parse_rules([r.value for r in spark.read.text(path).collect()])


def ignored(findings: DataFrame, captures: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Findings that no rule matches. A finding matches an `sql` rule by its
    description or by any query of its fingerprint in its scope."""
    file, hit = F.coalesce(F.col("file_path"), F.lit("")), F.lit(False)
    placed, wanted = F.col("file_path").isNotNull(), [glob_pattern(f"*{p.replace('%', '*')}*") for k, p in rules if k == "sql"]
    for kind, pattern in rules:
        issue, _, rest = pattern.partition(":")
        if kind == "file":
            hit |= placed & file.rlike(glob_pattern(pattern))
        elif kind == "callsite":
            hit |= placed & (F.concat_ws(":", file, "line_number") == pattern)
        elif kind == "ignore" and ":" in pattern:
            hit |= placed & (F.col("issue_type") == issue) & file.contains(rest.partition(":")[0])
    any_of = lambda c: reduce(lambda a, b: a | b, [c.rlike(p) for p in wanted])
    if not wanted:
        return findings.where(~hit)
    matching = captures.where(any_of(F.col("sql"))).select("scope_id", "fingerprint").distinct()
    return findings.where(~hit & ~any_of(F.col("description"))).join(matching, ["scope_id", "fingerprint"], "left_anti")
