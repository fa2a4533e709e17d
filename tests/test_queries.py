"""Each query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _names():
    from querysift import oracles

    return sorted(oracles.ORACLES)


@pytest.mark.parametrize("name", _names())
def test_same_rows(spark, sql, name):
    from querysift import oracles, queries

    got = queries.QUERIES[name](spark, SF)
    want = sql.sql(oracles.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_replay_without_eviction_is_the_lifecycle(spark):
    from pyspark.sql import functions as F

    from querysift.operators import turbo

    rows = [(p, i, f"f{i % 3}", "x" if (p, i % 3) != (1, 2) or i < 6 else "y", 1) for p in (0, 1) for i in range(24)]
    log = spark.createDataFrame(rows, "process_id int, seq int, fingerprint string, fresh_sql string, param_count int")
    a = turbo.replay(log).select("process_id", "seq", "state").collect()
    b = turbo.lifecycle(log).select("process_id", "seq", F.col("state")).collect()
    assert sorted(a) == sorted(b)
    assert {"poison", "miss", "validate", "trusted"} <= {r.state for r in a}


def test_replay_evicts_the_oldest(spark):
    from querysift.operators import turbo

    log = spark.createDataFrame([(0, i, f"f{i % 3}", "x", 1) for i in range(9)], "process_id int, seq int, fingerprint string, fresh_sql string, param_count int")
    assert {(r.state, r.held <= 2) for r in turbo.replay(log, max_size=2).collect()} == {("miss", True)}


def test_rules_drop_findings_only():
    from querysift.plans.pipeline import glob_pattern, parse_rules

    assert parse_rules(["# a", "", "nothing", " file: app/* ", "sql:SELECT:%"]) == [("file", "app/*"), ("sql", "SELECT:%")]
    import re

    assert re.match(glob_pattern("a[!b]?*.py"), "acd-x.py") and not re.match(glob_pattern("a[!b]?*.py"), "abd.py")


def test_empty_log(spark):
    from querysift.plans import report
    from querysift.plans.enrich import enrich
    from querysift.plans.pipeline import diagnose
    from querysift.sources import captures
    from querysift.sources.catalog import Catalog

    nothing = enrich(spark.createDataFrame([], captures.SCHEMA))
    found = diagnose(nothing, Catalog(spark))
    assert found.count() == 0 and report.scope_report(nothing, found).count() == 0
    assert report.project_overall(report.project_apps(nothing, found)).first().health == 100.0


def test_sinks(spark, tmp_path):
    import logging

    from querysift import queries
    from querysift.plans import sinks

    found = queries.found(spark, SF)
    text, page = sinks.console(found, 5), sinks.html(found, "<x>", 5)
    assert text.count("fix: ") == 5 and "N+1 detected" in text
    assert page.count("<tr>") == 6 and "&lt;x&gt;" in page and "&quot;shop" in page
    seen = []
    logger = logging.Logger("t")
    logger.addHandler(type("H", (logging.Handler,), {"emit": lambda self, r: seen.append(r.levelno)})())
    sinks.log(found, logger, 3)
    assert len(seen) == 3 and set(seen) <= set(sinks.LEVELS.values())
    sinks.write_json(found, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == found.count()


def test_reports_say_what_they_leave_out(spark, caplog):
    import logging

    from querysift.plans import sinks

    rows = [(0, "warning", f"s{i}", i, 0, "n_plus_one", f"finding {i}", "fix", None, None) for i in range(5)]
    found = spark.createDataFrame(rows, "apply_rank int, severity string, scope_id string, first_seq int, pos int, issue_type string, description string, fix_suggestion string, file_path string, line_number int")
    with caplog.at_level(logging.INFO):
        sinks.log(found, logging.getLogger("reports"), most=2)
    for text in (sinks.console(found, most=2), sinks.html(found, most=2), caplog.text):
        assert "finding 1" in text and "finding 2" not in text and "3 more findings are not shown" in text
    assert "not shown" not in sinks.console(found, most=5) + sinks.html(found)
