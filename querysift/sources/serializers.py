"""Serializer classes in source files, and what their per-object methods fetch.

A field declared as SerializerMethodField is computed by get_<field>(self, obj), once an object. Python's own parser
reads the files, a file a row; classes find inherited fields and methods among the classes of their file.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import SHOP, Model

#: Names of methods that reach the database, and of methods and attributes that do not.
FETCHING = frozenset("aggregate all annotate bulk_create bulk_update count create delete distinct exclude exists filter first get last order_by prefetch_related select_related update values values_list".split())
HARMLESS = frozenset(
    "__len__ __repr__ __str__ append capitalize decode encode endswith extend format get insert isalnum isalpha isdigit isnumeric items join keys lower lstrip pop remove replace reverse rstrip sort split startswith "
    "strip swapcase title update upper values".split()
)
FOUND = "path string, line int, serializer string, field string, pattern string, severity string, description string, fix_suggestion string, pos int"
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)


def dotted(node: ast.AST) -> tuple[str, ...]:
    """a.b.c as its names; without the first where that is no plain name."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    return (node.id, *names) if isinstance(node, ast.Name) else tuple(names)


@dataclass
class _Class:
    name: str
    bases: list[str]
    method_fields: list[str]
    methods: dict[str, ast.FunctionDef | ast.AsyncFunctionDef]
    model: str | None


def classes_of(tree: ast.Module) -> dict[str, _Class]:
    out = {}
    for node in ast.walk(tree):
        if not isinstance(node, ast.ClassDef):
            continue
        declared, methods, model = [], {}, None
        for item in node.body:
            if isinstance(item, ast.FunctionDef | ast.AsyncFunctionDef):
                methods[item.name] = item
            elif isinstance(item, ast.ClassDef) and item.name == "Meta":
                model = next((dotted(x.value)[-1] for x in item.body if isinstance(x, ast.Assign) and dotted(x.targets[0]) == ("model",) and dotted(x.value)), None)
            elif isinstance(item, ast.Assign | ast.AnnAssign) and isinstance(item.value, ast.Call) and dotted(item.value.func)[-1:] == ("SerializerMethodField",):
                declared += [t.id for t in (item.targets if isinstance(item, ast.Assign) else [item.target]) if isinstance(t, ast.Name)]
        out[node.name] = _Class(node.name, [dotted(b)[-1] for b in node.bases if dotted(b)], declared, methods, model)
    return out


def _lineage(name: str, known: dict[str, _Class], seen: tuple[str, ...] = ()) -> list[_Class]:
    """A class, then those it inherits from, depth first; each once."""
    if name not in known or name in seen:
        return []
    out = [known[name]]
    for base in known[name].bases:
        out += [c for c in _lineage(base, known, (*seen, name)) if c not in out]
    return out


class _Method:
    """The findings of one get_<field> method."""

    def __init__(self, serializer: str, field: str, obj: str, is_relation):
        self.where, self.obj, self.is_relation = f"{serializer}.get_{field}()", obj, is_relation

    def of_object(self, node: ast.AST, least: int) -> tuple[str, ...]:
        """The names behind the serialized object, if `node` reaches at least so many from it."""
        names = dotted(node)
        return names[1:] if names[:1] == (self.obj,) and len(names) > least else ()

    def found(self, body: ast.AST) -> Iterator[tuple[ast.AST, str, str, str, str]]:
        """node, pattern, severity, description and fix, in the order that a breadth-first walk meets them."""
        called = {id(n.func) for n in ast.walk(body) if isinstance(n, ast.Call)}
        for node in ast.walk(body):
            if isinstance(node, ast.Call):
                yield from self.call(node)
            elif isinstance(node, ast.For):
                yield from self.iterated(node, node.iter, "loop", True)
            elif isinstance(node, _COMPREHENSIONS):
                hits = (x for g in node.generators for x in self.iterated(node, g.iter, "comprehension", False))
                yield from list(hits)[:1]
            elif isinstance(node, ast.Attribute) and id(node) not in called:
                yield from self.chain(node)

    def call(self, node: ast.Call):
        names, method = dotted(node.func), getattr(node.func, "attr", "")
        if method not in FETCHING:
            return
        behind = self.of_object(node.func, 2)
        if behind and isinstance(node.func.value, ast.Attribute):
            text = f"N+1 risk in {self.where}: '{self.obj}.{behind[0]}.{method}()' triggers a query per object"
            fix = f"Use queryset.annotate() or prefetch_related('{behind[0]}') instead of accessing '{behind[0]}' in the serializer method"
            yield node, "related_manager_access", "warning", text, fix
        elif len(names) >= 3 and names[-2] == "objects":
            shown = f"{names[-3]}.objects.{method}()"
            yield node, "queryset_in_method", "warning", f"N+1 risk in {self.where}: '{shown}' executes a query per object", f"Move the {shown} call to the viewset queryset using annotate() or prefetch_related()"

    def iterated(self, node: ast.AST, over: ast.AST, kind: str, only_relations: bool):
        """A loop over what a manager returns, or over an attribute; the loop's attribute must be a relation."""
        said = f"N+1 risk in {self.where}: {kind} over "
        if isinstance(over, ast.Call) and (behind := self.of_object(over.func, 2)) and behind[-1] in FETCHING:
            fix = f"Use prefetch_related('{behind[0]}') on the viewset queryset to batch-load related objects"
            yield node, f"{kind}_queryset", "warning", f"{said}'{self.obj}.{behind[0]}.{behind[-1]}()' triggers a query per object", fix
        elif isinstance(over, ast.Attribute) and (behind := self.of_object(over, 1)) and not (only_relations and not self.is_relation(behind[0])):
            yield node, f"{kind}_queryset", "warning", f"{said}'{self.obj}.{behind[0]}' may trigger a query per object", f"Use prefetch_related('{behind[0]}') on the viewset queryset"

    def chain(self, node: ast.Attribute):
        behind = self.of_object(node, 2)
        if behind and behind[-1] not in FETCHING | HARMLESS and "objects" not in behind:
            text = f"Possible N+1 in {self.where}: '{self.obj}.{'.'.join(behind)}' may trigger a query per object if '{behind[0]}' is not select_related"
            yield node, "deep_attribute_chain", "info", text, f"Add select_related('{behind[0]}') to the viewset queryset"


def scan_source(path: str, text: str, relations: dict[str, set[str]]) -> list[tuple]:
    """Findings of one file, as rows of FOUND; `relations` holds the related fields of each model. A file that does not
    parse has none."""
    try:
        known = classes_of(ast.parse(text))
    except (SyntaxError, ValueError):
        return []
    out = []
    for name in known:
        line = _lineage(name, known)
        model = next((c.model for c in line if c.model), None)
        is_relation = (lambda x, m=model: x in relations.get(m, ())) if model else (lambda x: x.endswith("_set"))
        for field in dict.fromkeys(f for c in line for f in c.method_fields):
            method = next((c.methods[f"get_{field}"] for c in line if f"get_{field}" in c.methods), None)
            if method is None or len(method.args.args) < 2:
                continue
            hits = _Method(name, field, method.args.args[1].arg, is_relation).found(method)
            out += [(path, getattr(n, "lineno", method.lineno), name, field, pattern, severity, said, fix, i) for i, (n, pattern, severity, said, fix) in enumerate(hits)]
    return out


def scan(sources: DataFrame, models: tuple[Model, ...] = SHOP) -> DataFrame:
    """Findings of source files (path, text), each parsed by itself on the executors."""
    relations = {m.name: {f.name for f in m.fields if f.related} | {a for o in models for f in o.fields if (a := f.accessor) and f.related == m.table} for m in models}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        for part in parts:
            rows = [r for path, text in zip(part["path"], part["text"], strict=True) if text for r in scan_source(path, text, relations)]
            yield pd.DataFrame(rows, columns=names)

    return sources.select("path", "text").mapInPandas(run, FOUND)


def as_findings(found: DataFrame) -> DataFrame:
    """The scan's rows as findings of the diagnosis."""
    return found.select(
        F.lit(None).cast("long").alias("scope_id"), F.lit(6).alias("analyzer_ord"), F.lit(0).cast("long").alias("first_seq"), "pos", F.lit("serializer_method_field").alias("issue_type"), "severity", "description", "fix_suggestion",
        F.col("path").alias("file_path"), F.col("line").alias("line_number"), F.concat(F.lit("get_"), "field").alias("function_name"), F.lit(0).alias("query_count"), F.lit(0.0).alias("time_saved_ms"),
        F.lit(None).cast("string").alias("fingerprint"), F.create_map(F.lit("field"), "field", F.lit("pattern"), "pattern", F.lit("serializer"), "serializer").alias("extra"),
    )


def read_sources(spark: SparkSession, path: str, modules: tuple[str, ...] = ("serializers",)) -> DataFrame:
    """Python files below `path` whose name or folder is one of `modules`: path and text."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.py").select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    wanted = "|".join(modules)
    return files.where(F.col("path").rlike(rf"/({wanted})(\.py$|/)"))
