"""Statements of a running program, recorded as captures: scopes for blocks, functions and tasks.

What a scope records stays on the driver until the scope ends: the statements one block of a program runs."""

from __future__ import annotations

import functools
import itertools
import logging
import time
import traceback
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import settings
from ..plans.enrich import enrich
from ..plans.pipeline import diagnose
from .captures import SCHEMA
from .catalog import Catalog
from .stacks import NOT_USER_CODE

logger = logging.getLogger(__name__)
_SCOPES = itertools.count(1)


class Recorder:
    """One scope: runs statements through `execute` and notes each, also those that raise."""

    def __init__(self, spark: SparkSession, execute: Callable[..., Any] | None = None, surface: str = "code", endpoint: str | None = None, app_name: str | None = None):
        self.spark, self.scope_id = spark, next(_SCOPES)
        self._execute, self._about, self._rows = execute or spark.sql, (surface, endpoint, app_name), []
        self.captured: DataFrame | None = None
        self.findings: DataFrame | None = None

    def run(self, statement: str, *args: Any, **kwargs: Any) -> Any:
        began, at = time.perf_counter(), datetime.now()
        try:
            return self._execute(statement, *args, **kwargs)
        finally:
            try:
                surface, endpoint, app_name = self._about
                params = repr(args or kwargs) if args or kwargs else None
                self._rows.append((self.scope_id, len(self._rows), at, surface, endpoint, app_name, None, statement, params, (time.perf_counter() - began) * 1000, _callsite()))
            except Exception:  # recording never breaks the program
                logger.warning("a statement was not recorded", exc_info=True)

    def rows(self) -> list[tuple]:
        return list(self._rows)

    def clear(self) -> None:
        self._rows.clear()

    def finish(self, catalog: Catalog | None = None) -> Recorder:
        """Diagnoses what was recorded: `captured` and `findings` are set from here on."""
        self.captured = enrich(self.spark.createDataFrame(self._rows, SCHEMA))
        self.findings = diagnose(self.captured, catalog or Catalog(self.spark))
        return self


def _callsite() -> tuple[str, int, str, str] | None:
    foreign = (*NOT_USER_CODE, *settings.current().stack_excludes)
    own = [f for f in traceback.extract_stack() if not any(part in f.filename for part in foreign)]
    return (own[-1].filename, own[-1].lineno or 0, own[-1].name, (own[-1].line or "").strip()) if own else None


@contextmanager
def recording(spark: SparkSession, catalog: Catalog | None = None, **about: Any) -> Iterator[Recorder]:
    """A block as a scope, diagnosed when it ends; a block that raises is not."""
    recorder = Recorder(spark, **about)
    yield recorder
    recorder.finish(catalog)


def recorded(spark: SparkSession, catalog: Catalog | None = None) -> Callable:
    """A function whose calls are scopes. It gets a recorder as its first argument, and has the last call's as `.last`."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args: Any, **kwargs: Any) -> Any:
            with recording(spark, catalog, surface="function") as recorder:
                out = f(recorder, *args, **kwargs)
            call.last = recorder
            return out

        call.last = None
        return call

    return wrap


def recorded_task(spark: SparkSession, on_report: Callable[[Recorder], None] | None = None, catalog: Catalog | None = None) -> Callable:
    """A task whose runs are scopes, diagnosed also where the task raises; then `on_report` gets the recorder."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args: Any, **kwargs: Any) -> Any:
            recorder = Recorder(spark, surface="task", endpoint=f.__name__)
            try:
                return f(recorder, *args, **kwargs)
            finally:
                try:
                    recorder.finish(catalog)
                    if on_report:
                        on_report(recorder)
                except Exception:
                    logger.warning("the report of task %s failed", f.__name__, exc_info=True)

        return call

    return wrap
