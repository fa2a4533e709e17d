"""Rows rendered from the events table for the parts of the engine that read no statements: stacks, query structures,
source files and schema changes. The same expressions serve the queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import query_spec
from .sources.stacks import STACK

#: Bodies of get_<field> methods, by event_id modulo their number, and what a scan of them finds (nothing, if None).
SERIALIZER_BODIES = (
    ("return obj.lines.count()", "related_manager_access"),
    ("return Order.objects.filter(id=obj.id)", "queryset_in_method"),
    ("for x in obj.line_set: y = x", "loop_queryset"),
    ("return [x for x in obj.notes]", "comprehension_queryset"),
    ("return obj.customer.name", "deep_attribute_chain"),
    ("return obj.name.upper()", None),
    ("return obj.name", None),
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and a stack: the interpreter, the user's view (not for every third event), the mapper."""
    frame = lambda f, line, name, code: F.struct(F.lit(f).alias("filename") if isinstance(f, str) else f.alias("filename"), line.cast("int").alias("line"), F.lit(name).alias("name"), F.lit(code).alias("code"))
    one = F.lit(1)
    user = F.array(frame(F.concat(F.lit("/srv/app"), (F.col("user_id") % 4).cast("string"), F.lit("/views.py")), F.col("k"), "view", "  rows = list(qs) "))
    inner = F.array(frame("/usr/lib/python3/site-packages/django/db/models/query.py", one, "get", "x"), frame("/srv/mydjango/db.py", F.col("k") + 1, "helper", "go()"), frame("/usr/lib/importlib/__init__.py", one, "f", ""))
    outer = F.array(frame("/usr/lib/python3/runpy.py", one, "run", "x"))
    shaped = F.when(F.col("event_id") % 3 == 0, outer).when(F.col("event_id") % 3 == 1, F.concat(outer, user)).otherwise(F.concat(outer, user, inner))
    return events(spark, sf_dir).select("event_id", shaped.cast(STACK).alias("stack"))


def serializer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and text: a file an event, with one serializer class."""
    body = F.element_at(F.array(*[F.lit(x) for x, _ in SERIALIZER_BODIES]), (F.col("event_id") % len(SERIALIZER_BODIES) + 1).cast("int"))
    text = F.concat(F.lit("class Base:\n    total = serializers.SerializerMethodField()\n\nclass Shown(Base):\n    def get_total(self, obj):\n        "), body, F.lit("\n"))
    return events(spark, sf_dir).select("event_id", F.format_string("/src/app%d/serializers_%d.py", F.col("user_id") % 4, "event_id").alias("path"), text.alias("text"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and the structure of a query that an event stands for."""
    strings = lambda *x: F.array(*[F.lit(y) if isinstance(y, str) else y for y in x]).cast("array<string>")
    id_, k = F.col("event_id").cast("string"), F.col("k")
    root = F.struct(F.lit(0).alias("depth"), F.lit("AND").alias("connector"), F.lit(False).alias("negated"), F.lit(None).cast("string").alias("lookup"), F.lit(None).cast("string").alias("lhs"), F.lit(None).cast("int").alias("in_count"), F.lit(False).alias("in_subquery"), strings().alias("params"))

    def leaf(lookup, lhs, count, params):
        return F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("connector"), F.lit(None).cast("boolean").alias("negated"), F.lit(lookup).alias("lookup"), F.lit(lhs).alias("lhs"), count.cast("int").alias("in_count"), F.lit(False).alias("in_subquery"), params.alias("params"))

    listed = F.transform(F.sequence(F.lit(1), k % 3 + 1), lambda i: i.cast("string"))
    nodes = F.array(root, leaf("exact", "shop.Order.id", F.lit(None), strings(id_)), leaf("in", "shop.Order.status", k % 3 + 1, listed), leaf("isnull", "shop.Order.note", F.lit(None), strings("true")))
    note = F.struct(F.lit("n").alias("name"), F.lit("Count").alias("kind"), strings("lines").alias("refs"), F.lit(True).alias("selected"), strings("7").alias("params"))
    none = F.lit(None)
    columns = {
        "vendor": F.lit("sqlite"), "alias": F.lit("default"), "model": F.concat(F.lit("shop."), "event_type"), "compiler": F.when(F.col("event_type") == "purchase", "SQLInsertCompiler").otherwise("SQLCompiler"), "distinct": k % 2 == 0,
        "distinct_fields": none, "for_update": F.lit(False), "for_update_nowait": F.lit(False), "for_update_skip_locked": F.lit(False), "for_update_of": none, "selected": strings("shop.Order.id", "shop.Order.title"),
        "values_select": none, "nodes": nodes, "joins": strings("shop_order:None", "shop_customer:INNER JOIN"), "order_by": strings("-id"), "extra_order_by": none, "grouped": k % 5 == 0, "annotations": F.array(note), "low_mark": F.lit(0),
        "high_mark": F.when(k > 50, k), "select_related": F.lit(""), "extra_select_params": none, "extra_where_params": none, "having_params": none, "extra": k % 7 == 0, "raw_annotation": F.lit(False), "subquery": k % 11 == 0, "empty": F.lit(False),
    }
    kinds = dict(x.split(" ", 1) for x in _fields(query_spec.SCHEMA))
    return events(spark, sf_dir).select("event_id", *[v.cast(kinds[n]).alias(n) for n, v in columns.items()])


def _fields(schema: str) -> list[str]:
    """The fields of a schema's text, cut at commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]
