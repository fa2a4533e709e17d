"""Which line of a user's code a statement comes from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STACK = "array<struct<filename: string, line: int, name: string, code: string>>"
#: Parts of paths whose frames are no user's code: the mapper's database layer, the interpreter's own
#: machinery, installed packages and test runners.
NOT_USER_CODE = (
    "querysift", "/django/db/", "\\django\\db\\", "importlib", "threading", "_bootstrap",
    "_pytest", "pluggy", "site-packages", "dist-packages", "runpy.py",
)


def callsite(stack: Column, more: tuple[str, ...] = ()) -> Column:
    """The innermost frame of user code, as captures hold it; null if there is none. `stack` runs outermost first."""
    foreign = lambda frame: F.exists(F.array(*map(F.lit, (*NOT_USER_CODE, *more))), lambda part: F.contains(frame["filename"], part))
    last = F.try_element_at(F.filter(stack, lambda frame: frame["filename"].isNotNull() & ~foreign(frame)), F.lit(-1))
    made = F.struct(
        last["filename"].alias("filepath"), F.coalesce(last["line"], F.lit(0)).alias("line_number"), last["name"].alias("function_name"), F.trim(F.coalesce(last["code"], F.lit(""))).alias("code_context"),
    )
    return F.when(last.isNotNull(), made)
