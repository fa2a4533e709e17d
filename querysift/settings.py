"""What a run may change. Thresholds are parameters of the analyzers; here only deviations from theirs are kept."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Settings:
    """`analyzers` maps an analyzer's name to its options: `off`, or parameters of its analyze()."""

    enabled: bool = True
    sample_rate: float = 1.0
    ignored_prefixes: tuple[str, ...] = ()
    analyzers: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    stack_excludes: tuple[str, ...] = ()
    reporters: tuple[str, ...] = ("console",)
    cache_size: int = 1024
    validations: int = 3
    prepare_from: int = 5

    def runs(self, analyzer: str) -> bool:
        return not self.analyzers.get(analyzer, {}).get("off", False)

    def options(self, analyzer: str) -> dict[str, Any]:
        return {k: v for k, v in self.analyzers.get(analyzer, {}).items() if k != "off"}

    def changed(self, **over: Any) -> Settings:
        """These settings with others laid over them; options of analyzers join those already there."""
        unknown = set(over) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        if "analyzers" in over:
            names = {**self.analyzers, **over["analyzers"]}
            over["analyzers"] = {n: {**self.analyzers.get(n, {}), **over["analyzers"].get(n, {})} for n in names}
        return replace(self, **over)


_CURRENT: ContextVar[Settings] = ContextVar("querysift_settings", default=Settings())


def current() -> Settings:
    return _CURRENT.get()


@contextmanager
def using(**over: Any) -> Iterator[Settings]:
    """Changed settings for a block and the thread or task that runs it; blocks nest."""
    token = _CURRENT.set(current().changed(**over))
    try:
        yield current()
    finally:
        _CURRENT.reset(token)
