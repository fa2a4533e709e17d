"""Golden cases of the scalar functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from querysift.functions import sql_text

NORMALIZED = [
    ('SELECT "a"."b" FROM "a" LIMIT 1', 'select "a"."b" from "a" limit ?'),
    ("""SELECT x FROM a WHERE "a"."n" LIKE '%x%'""", 'select x from a where "a"."n" like ?'),
    ('SELECT x FROM a WHERE "a"."i" IN (SELECT U0."i" FROM "c" U0 WHERE U0."k" = 5) ORDER BY 1', 'select x from a where "a"."i" in (?) order by ?'),
    ("SELECT 1 ; ", "select ? ;"),
    ("SELECT 1;", "select ?"),
    ("select 1e5, 0x1F, $1, U0.x, T3.y, -7.50", "select 1e5, 0x1f, $?, u0.x, t3.y, -?"),
    (r"SELECT '\' , 'b' FROM t", "select ?b' from t"),
]
TUPLES = [("INSERT INTO t VALUES (%s), (%s)", 2), ("INSERT INTO t VALUES (f(g(1)))", 1), ("INSERT INTO t VALUES ('a) , (b')", 1), ("INSERT INTO t VALUES ('it''s (x)') ON CONFLICT (id) DO NOTHING", 2), ("INSERT INTO t DEFAULT VALUES", 0), ("INSERT INTO t SELECT 1", 0), ("INSERT INTO t VALUES (1)) (2", 2)]
LISTS = [("DELETE FROM t WHERE id IN (%s)", 1), ("UPDATE t SET x = 1 WHERE id IN (1, f(2, 3), 4)", 3), ("DELETE FROM t WHERE id IN (SELECT a, b FROM u)", 0), ("DELETE FROM t WHERE a IN (1, 2) AND b IN (1, 2, 3)", 3), ("DELETE FROM t WHERE x = 'in (1, 2)'", 0), ("DELETE FROM t", 0)]


def _values(spark, rows, plan):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, sql string, want string")
    return [(r.got, r.want) for r in frame.withColumn("got", plan(F.col("sql")).cast("string")).orderBy("i").collect()]


@pytest.mark.parametrize("rows, plan", [(NORMALIZED, sql_text.normalize), (TUPLES, sql_text.values_tuples), (LISTS, sql_text.longest_in_list)])
def test_golden(spark, rows, plan):
    for got, want in _values(spark, [(a, str(b)) for a, b in rows], plan):
        assert got == want


def test_tables_and_scores(spark):
    rows = spark.createDataFrame([('SELECT * FROM "public"."t" JOIN "a" ON 1 JOIN a ON 2',), ("SELECT x FROM a FOR UPDATE NOWAIT",)], "sql string")
    assert [r.t for r in rows.select(sql_text.tables(F.col("sql")).alias("t")).collect()] == [["public", "a"], ["a", "NOWAIT"]]
    joins = spark.createDataFrame([(n, "select x from a" + " join b on c" * n) for n in (3, 4)], "n int, sql string")
    assert {r.n: r.s for r in joins.select("n", sql_text.complexity(F.col("sql")).alias("s")).collect()} == {3: 6, 4: 8}


def test_long_literals_and_classes_of_unicode(spark):
    rows = [("SELECT '" + "x\\'" * 20_000 + "' , 5", "select ? , ?"), ("a  b  c\td e", "a b c d e"), ("x = ٥ AND y = é5 AND FALSE", "x = ? and y = é5 and ?"), ("%s5 1.5x xtrue True", "?? ?.5x xtrue ?")]
    for got, want in _values(spark, rows, sql_text.normalize):
        assert got == want
