"""Captured statements: logs in files, and logs rendered from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = (
    "scope_id long, seq long, captured_at timestamp_ntz, surface string, endpoint string, app_name string, http_method string, sql string, params_repr string, "
    "duration_ms double, callsite struct<filepath: string, line_number: int, function_name: string, code_context: string>"
)


def read_log(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """A log of captured statements in files of any kind that Spark reads."""
    return spark.read.schema(SCHEMA).format(kind).load(path)


def _columns(table: str, *names: str) -> str:
    return ", ".join(f'"{table}"."{x}"' for x in names)


PART_COLUMNS = ("id", "name", "brand", "kind", "size", "price", "stock", "comment", "made_on")
ORDER_COLUMNS = ("id", "customer_id", "title", "status", "total", "priority", "clerk", "note", "placed_on")
_PART, _ORDER = _columns("shop_part", *PART_COLUMNS), _columns("shop_order", *ORDER_COLUMNS)
_PATH = (("line", "order"), ("order", "customer"), ("customer", "nation"), ("nation", "region"), ("line", "part"), ("part", "tag"))
_JOINS = [f' INNER JOIN "shop_{b}" ON ("shop_{a}"."{b}_id" = "shop_{b}"."id")' for a, b in _PATH]
#: Statements by event type and remainder; {id} is the event's id.
TEMPLATES = {
    ("view", 0): f'SELECT {_columns("shop_order", "id", "customer_id", "title")} FROM "shop_order" ORDER BY "shop_order"."placed_on" ASC',
    ("view", 1): f'SELECT {_columns("shop_customer", "id", "name")} FROM "shop_customer" WHERE "shop_customer"."id" = {{id}}',
    ("view", 2): f'SELECT {_columns("shop_customer", "id", "name")} FROM "shop_customer" WHERE "shop_customer"."id" = {{id}}',
    ("view", 3): f'SELECT {_columns("shop_line", "id", "order_id", "qty")} FROM "shop_line" WHERE "shop_line"."order_id" = {{id}}',
    ("view", 4): f'SELECT {_columns("shop_part", "id", "name")} FROM "shop_part" INNER JOIN "shop_part_tags" ON ("shop_part"."id" = "shop_part_tags"."tag_id") WHERE "shop_part_tags"."part_id" = {{id}}',
    ("click", 0): f"""SELECT {_columns("shop_nation", "id", "name")} FROM "shop_nation" WHERE "shop_nation"."name" = 'FRANCE'""",
    ("click", 1): f"""SELECT {_columns("shop_nation", "id", "name")} FROM "shop_nation" WHERE "shop_nation"."name" = 'FRANCE'""",
    ("click", 2): f'SELECT {_PART} FROM "shop_part"',
    ("click", 3): f'SELECT {_columns("shop_region", "id", "name")} FROM "shop_region" WHERE "shop_region"."id" = {{id}}',
    ("click", 4): f'SELECT {_columns("shop_line", "id")} FROM "shop_line" WHERE ("shop_line"."order_id" = {{id}} AND "shop_line"."qty" > 3)',
    ("purchase", 0): 'INSERT INTO "shop_order" ("customer_id", "title") VALUES (%s, %s)',
    ("purchase", 1): 'INSERT INTO "shop_order" ("customer_id", "title") VALUES (%s, %s)',
    ("purchase", 2): 'INSERT INTO "shop_line" ("order_id") VALUES (%s), (%s)',
    ("purchase", 3): 'UPDATE "shop_order" SET "status" = %s WHERE "shop_order"."id" IN (%s, %s)',
    ("purchase", 4): "BEGIN",
    ("signup", 0): 'UPDATE "shop_customer" SET "name" = %s WHERE "shop_customer"."id" = %s',
    ("signup", 1): 'UPDATE "shop_customer" SET "name" = %s WHERE "shop_customer"."id" = %s',
    ("signup", 2): 'DELETE FROM "shop_line" WHERE "shop_line"."id" IN (%s)',
    ("signup", 3): 'UPDATE "shop_nation" SET "name" = %s WHERE "shop_nation"."id" = %s',
    ("signup", 4): 'INSERT INTO "shop_tag" ("id") VALUES (%s) ON CONFLICT (id) DO NOTHING',
    ("error", 0): f'SELECT "shop_region"."name", COUNT("shop_line"."id") FROM "shop_line"{"".join(_JOINS)} GROUP BY "shop_region"."name" HAVING COUNT("shop_line"."id") > 1 ORDER BY "shop_region"."name"',
    ("error", 1): f'SELECT "shop_line"."id" FROM "shop_line"{"".join(_JOINS[:4])}',
    ("error", 2): f'SELECT {_ORDER} FROM "shop_order" LIMIT 1',
    ("error", 3): 'SELECT "shop_line"."id" FROM "shop_line" WHERE "shop_line"."order_id" IN (SELECT U0."id" FROM "shop_order" U0)',
    ("error", 4): 'SELECT * FROM "shop_line"',
}


def _case(kind: str, rest: str, number: str) -> str:
    """The statement as an SQL expression that Spark and other engines read alike."""
    arms = []
    for (event, b), text in TEMPLATES.items():
        made = " || ".join(f"'{x}'" if i % 2 == 0 else f"CAST({number} AS STRING)" for i, x in enumerate(text.replace("'", "''").replace("{id}", "\0id\0").split("\0")) if i % 2 or x)
        arms.append(f"WHEN {kind} = '{event}' AND {rest} = {b} THEN {made}")
    return f"CASE {' '.join(arms)} END"


#: Rendering of events as captures, in SQL that Spark and DuckDB share; k and b come from the properties.
EVENT_SQL = _case("event_type", "k % 5", "event_id")
CODE_SQL = "CASE k % 4 WHEN 0 THEN 'for row in qs:' WHEN 1 THEN 'total = len(qs)' WHEN 2 THEN 'if qs:' ELSE 'first = list(qs)[0]' END"


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture an event; a user's events are a scope."""
    return rendered(spark.read.parquet(f"{sf_dir}/events.parquet"))


def rendered(events: DataFrame) -> DataFrame:
    """Events (batch or stream) as captures."""
    keyed = events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    return keyed.selectExpr(
        "user_id AS scope_id", "event_id AS seq", "ts AS captured_at", "'http' AS surface", "concat('/r/', user_id % 20, '/') AS endpoint", "concat('app', user_id % 4) AS app_name",
        "CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS http_method", f"{EVENT_SQL} AS sql", "CAST(NULL AS STRING) AS params_repr", "value AS duration_ms",
        "CASE WHEN event_id % 17 <> 0 THEN named_struct('filepath', concat('app', user_id % 4, '/views.py'), 'line_number', CAST(100 + k % 5 AS INT), "
        f"'function_name', concat('view_', k % 5), 'code_context', {CODE_SQL}) END AS callsite",
    )


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger log: one capture a line item, an order's lines are a scope."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    everything = Window.partitionBy("l_orderkey").orderBy("l_linenumber", *[c for c in sorted(lines.columns) if c not in ("l_orderkey", "l_linenumber")])
    kinds = F.array(*[F.lit(x) for x in ("view", "click", "purchase", "signup", "error")])
    rows = lines.withColumn("seq", F.row_number().over(everything).cast("long")).withColumn("k", (F.col("l_partkey") % 21).cast("int"))
    return rows.select(
        F.col("l_orderkey").alias("user_id"), F.col("seq").alias("event_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.get(kinds, (F.col("l_partkey") % 5).cast("int")).alias("event_type"), F.col("l_quantity").alias("value"), F.concat(F.lit('{"k": '), F.col("k"), F.lit("}")).alias("props"),
    ).transform(rendered)
