"""The structure of a mapper's queries: fingerprint, parameters, and whether a compiled text may be reused.

A query comes as a row. Its WHERE tree stands in `nodes`, in the order of a walk from the root: an inner node has a
connector, a leaf a lookup. Values never enter the fingerprint, but the length of an IN list does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE = "struct<depth: int, connector: string, negated: boolean, lookup: string, lhs: string, in_count: int, in_subquery: boolean, params: array<string>>"
SCHEMA = (
    "vendor string, alias string, model string, compiler string, distinct boolean, distinct_fields array<string>, for_update boolean, for_update_nowait boolean, for_update_skip_locked boolean, for_update_of array<string>, "
    f"selected array<string>, values_select array<string>, nodes array<{NODE}>, joins array<string>, order_by array<string>, extra_order_by array<string>, grouped boolean, "
    "annotations array<struct<name: string, kind: string, refs: array<string>, selected: boolean, params: array<string>>>, low_mark int, high_mark int, select_related string, "
    "extra_select_params array<string>, extra_where_params array<string>, having_params array<string>, extra boolean, raw_annotation boolean, subquery boolean, empty boolean"
)


def _named(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}:"), F.col(value) if isinstance(value, str) else value)


def _listed(name: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, _named(name, F.array_join(values, ",")))


def _flag(name: str, condition: Column | str) -> Column:
    return F.when(F.col(condition) if isinstance(condition, str) else condition, f"{name}:true")


def _node(x: Column) -> Column:
    at = F.concat(F.lit("where["), x["depth"].cast("string"), F.lit("]:"))
    inner = F.concat(at, F.lit("connector="), x["connector"], F.lit(",negated="), F.coalesce(x["negated"], F.lit(False)).cast("string"))
    length = F.when(x["in_subquery"], F.concat(F.lit("|"), at, F.lit("in_subquery"))).when(x["in_count"].isNotNull(), F.concat(F.lit("|"), at, F.lit("in_count="), x["in_count"].cast("string"))).otherwise("")
    leaf = F.concat(at, F.lit("lookup="), x["lookup"], F.lit(",lhs="), x["lhs"], F.when(x["lookup"] == "in", length).otherwise(""))
    return F.when(x["connector"].isNotNull(), inner).otherwise(leaf)


def _annotation(x: Column) -> Column:
    return F.concat(x["name"], F.lit(":"), x["kind"], F.when(F.size(x["refs"]) > 0, F.concat(F.lit("("), F.array_join(x["refs"], ","), F.lit(")"))).otherwise(""))


def canonical() -> Column:
    """What makes two queries the same to compile, as text."""
    updating = F.coalesce(F.col("for_update"), F.lit(False))
    locked = [_flag("for_update", "for_update"), _flag("for_update_nowait", updating & F.col("for_update_nowait")), _flag("for_update_skip_locked", updating & F.col("for_update_skip_locked"))]
    return F.concat_ws(
        "|", _named("vendor", "vendor"), _named("using", "alias"), _named("model", F.coalesce("model", F.lit("unknown"))), _named("compiler", "compiler"),
        _flag("distinct", "distinct"), F.when(F.col("distinct"), _listed("distinct_fields", F.col("distinct_fields"))), *locked, F.when(updating, _listed("for_update_of", F.array_sort("for_update_of"))),
        _listed("select", F.col("selected")), _listed("values_select", F.col("values_select")), F.when(F.size("nodes") > 0, F.array_join(F.transform("nodes", _node), "|")), _listed("joins", F.array_sort("joins")),
        _listed("order_by", F.col("order_by")), _listed("extra_order_by", F.col("extra_order_by")), _flag("group_by", "grouped"), _listed("annotations", F.array_sort(F.transform("annotations", _annotation))),
        _flag("offset", F.col("low_mark") > 0), _flag("limit", F.col("high_mark").isNotNull()), F.when(F.coalesce("select_related", F.lit("")) != "", _named("select_related", "select_related")),
    )


def fingerprint() -> Column:
    """32 hexadecimal digits; only equality of them means something."""
    return F.substring(F.sha2(canonical().cast("binary"), 256), 1, 32)


def params() -> Column:
    """The values of a query in the order of its placeholders: extra SELECT, selected annotations, WHERE, extra WHERE,
    HAVING. A test for null has none."""
    none = F.array().cast("array<string>")
    part = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), none)
    of_annotations = F.flatten(F.transform(F.filter("annotations", lambda x: F.coalesce(x["selected"], F.lit(True))), lambda x: part(x["params"])))
    of_nodes = F.flatten(F.transform(F.filter("nodes", lambda x: x["connector"].isNull() & (x["lookup"] != "isnull")), lambda x: part(x["params"])))
    return F.concat(part("extra_select_params"), part(of_annotations), part(of_nodes), part("extra_where_params"), part("having_params"))


def cacheable(skip_extra: bool = True, skip_raw: bool = True, skip_subqueries: bool = True) -> Column:
    """Whether a compiled text may be kept: a plain SELECT, without what the mapper does not spell out itself."""
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    out = (F.col("compiler") == "SQLCompiler") & off("empty")
    for on, column in ((skip_extra, "extra"), (skip_raw, "raw_annotation"), (skip_subqueries, "subquery")):
        out = out & off(column) if on else out
    return F.coalesce(out, F.lit(False))
