"""Parts of the diagnosis that no table's SQL covers: recording, baselines in files, fixes on disk, commands, plugins."""

from __future__ import annotations

import json
import logging
import subprocess

import pytest

from querysift import commands, settings
from querysift.operators import fixes, turbo
from querysift.plans import deliver, pipeline, report
from querysift.plans.enrich import enrich
from querysift.sources import captures, catalog, recorder, serializers


@pytest.fixture
def log(spark):
    rows = [(1, i, None, "http", "/a/", "shop", "GET", f'SELECT "shop_customer"."id" FROM "shop_customer" WHERE "shop_customer"."id" = {i}', None, 1.0, ("app/views.py", 2, "view", "if qs:")) for i in range(12)]
    rows += [(2, 0, None, "http", "/b/", "shop", "POST", "BEGIN", None, 1.0, None)]
    return spark.createDataFrame(rows, captures.SCHEMA)


def found_in(spark, log):
    known = enrich(log)
    return known, pipeline.diagnose(known, catalog.Catalog(spark))


def test_settings_merge_and_nest():
    assert settings.current().runs("complexity") and settings.current().options("nplusone") == {}
    with settings.using(analyzers={"nplusone": {"threshold": 5}}):
        with settings.using(sample_rate=0.5, analyzers={"nplusone": {"off": True}}) as inner:
            assert not inner.runs("nplusone") and inner.options("nplusone") == {"threshold": 5} and inner.sample_rate == 0.5
        assert settings.current().runs("nplusone") and settings.current().sample_rate == 1.0
    with pytest.raises(ValueError, match="colour"):
        settings.Settings().changed(colour=1)


def test_a_failing_analyzer_is_logged_and_skipped(spark, log, caplog):
    known = enrich(log)

    def broken(captures, catalog):
        raise RuntimeError("no")

    with caplog.at_level(logging.WARNING):
        found = pipeline.diagnose(known, catalog.Catalog(spark), also={"broken": broken})
    assert "broken" in caplog.text and {r.issue_type for r in found.collect()} == {"n_plus_one", "queryset_eval"}
    with settings.using(analyzers={"nplusone": {"threshold": 13}, "queryset_eval": {"off": True}}):
        assert pipeline.diagnose(known, catalog.Catalog(spark)).count() == 0


def test_a_broken_plugin_is_skipped(monkeypatch, caplog):
    class Plugin:
        def __init__(self, name, load):
            self.name, self.load = name, load

    def fail():
        raise ImportError("gone")

    monkeypatch.setattr(pipeline, "entry_points", lambda group: [Plugin("bad", fail), Plugin("odd", lambda: 3), Plugin("good", lambda: len)])
    with caplog.at_level(logging.WARNING):
        assert set(pipeline.analyzers()) == {*pipeline.BUILT_IN, "good"}
    assert "bad" in caplog.text and "odd" in caplog.text


def test_baseline_files(spark, log, tmp_path):
    _, found = found_in(spark, log)
    n = found.count()
    for table in (False, True):
        path = str(tmp_path / f"base{table}")
        report.write_baseline(found, path, table)
        known = report.read_baseline(spark, path)
        assert known.count() == n and report.regressions(found, known).count() == 0 and report.resolved(found, known).count() == 0
    old = tmp_path / "old.json"
    old.write_text(json.dumps({"version": "1", "issues": [{"analyzer": "gone", "message": "m", "callsite": {"filepath": "f.py"}}]}))
    assert [(r.issue_type, r.file_path, r.description) for r in report.resolved(found, report.read_baseline(spark, str(old))).collect()] == [("gone", "f.py", "m")]
    bad = tmp_path / "bad.json"
    bad.write_text("{no json")
    for path in (str(bad), str(tmp_path / "missing")):
        with pytest.raises(report.BaselineError):
            report.read_baseline(spark, path)


def test_json_report_keeps_nulls_and_empty_lists(spark, log):
    known, found = found_in(spark, log)
    by = {r.scope_id: json.loads(r.report) for r in report.json_report(known, found, most=1).collect()}
    assert by[2]["prescriptions"] == [] and by[2]["summary"]["issues_found"] == 0 and by[2]["prescriptions_left"] is None
    assert set(by[1]) == {"version", "timestamp", "summary", "prescriptions", "prescriptions_left"} and set(by[1]["summary"]) == {"total_queries", "total_time_ms", "issues_found", "critical", "warnings", "info"}
    assert set(by[1]["prescriptions"][0]) == {"issue_type", "severity", "description", "fix_suggestion", "location", "query_count", "estimated_savings_ms"}
    assert by[1]["prescriptions_left"] == by[1]["summary"]["issues_found"] - 1


def test_fixes_are_written_where_they_parse(spark, tmp_path):
    file, broken = tmp_path / "views.py", tmp_path / "broken.py"
    file.write_text("def view(qs):\n    if qs:\n        n = len(qs)\n    return qs\n")
    broken.write_text("def view(:\n    if qs:\n")
    rows = [
        (str(file), 2, "queryset_eval", "a", "Use .exists()"), (str(file), 3, "queryset_eval", "b", "Use .count()"), (str(file), 4, "n_plus_one", "c", "Add .select_related('x') to it"), (str(file), 99, "queryset_eval", "d", "Use .count()"),
        (str(file), 4, "duplicate_query", "e", "keep it"), (str(broken), 2, "queryset_eval", "f", "Use .exists()"), (str(file), 1, "complexity", "g", "split"), (None, 1, "queryset_eval", "h", "Use .count()"),
    ]
    found = spark.createDataFrame(rows, "file_path string, line_number int, issue_type string, description string, fix_suggestion string")
    made = fixes.proposed(found, fixes.source_lines(spark, str(tmp_path))).cache()
    assert [(r.line, r.after) for r in made.where("file like '%views.py' and not writable").collect()] == [(4, "    return qs.select_related('x')")]
    shown = {r.file: r.patch for r in fixes.patch(made).collect()}[str(file)]
    assert "[MANUAL FIX ONLY]" in shown and shown.index("@@ -4,1") < shown.index("@@ -2,1") and fixes.refused(made).first().kinds == "n_plus_one"
    done, failed = fixes.write(made)
    assert done == [str(file)] and failed == [str(broken)] and (tmp_path / "views.py.bak").exists() and not (tmp_path / "broken.py.bak").exists()
    assert file.read_text() == "def view(qs):\n    if qs.exists():\n        n = qs.count()\n    # TODO: Cache this query result to avoid duplicate execution\n    return qs\n"


SOURCE = '''
class Base(serializers.Serializer):
    total = serializers.SerializerMethodField()
    def get_total(self, item):
        return item.lines.count()

class Order(Base):
    names: list = SerializerMethodField()
    class Meta:
        model = models.Order
    def get_names(self, obj):
        for line in obj.lines:
            pass
        for c in obj.title:
            pass
        return {x: 1 for x in obj.customer.orders.all()}, obj.customer.nation.name, obj.customer.name.upper()

class Broken(Base):
    def get_total(self):
        return 1
'''


def test_serializers(spark):
    rows = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    got = serializers.scan(rows).collect()
    by = {}
    for r in got:
        by.setdefault((r.serializer, r.field), []).append(r.pattern)
    assert by[("Base", "total")] == by[("Order", "total")] == ["related_manager_access"] and ("Broken", "total") not in by
    assert sorted(by[("Order", "names")]) == ["comprehension_queryset", *["deep_attribute_chain"] * 4, "loop_queryset", "related_manager_access"]
    assert serializers.as_findings(serializers.scan(rows)).count() == len(got)


def test_recording(spark):
    with recorder.recording(spark) as block:
        for i in range(3):
            block.run(f"SELECT {i} AS x")
        with pytest.raises(Exception, match="nowhere"):
            block.run("SELECT * FROM nowhere_at_all")
    assert block.captured.count() == 4 and block.rows()[0][10][2] == "test_recording"
    with pytest.raises(KeyError), recorder.recording(spark) as failed:
        raise KeyError("x")
    assert failed.findings is None

    @recorder.recorded(spark)
    def work(own, n):
        own.run("SELECT 1")
        return n

    assert work(7) == 7 and work.last.captured.count() == 1
    seen = []

    @recorder.recorded_task(spark, on_report=seen.append)
    def task(own):
        own.run("SELECT 1")
        raise ValueError("late")

    with pytest.raises(ValueError, match="late"):
        task()
    assert seen[0].captured.first().surface == "task" and seen[0].findings.count() == 0
    seen[0].clear()
    assert seen[0].rows() == []


def test_delivery(spark, log, caplog):
    known, found = found_in(spark, log)
    seen = []
    with caplog.at_level(logging.WARNING):
        assert len(deliver.reporters(("console", "pigeon"))) == 1
    assert "pigeon" in caplog.text
    assert deliver.deliver(known, found, [lambda c, f: 1 / 0, lambda c, f: seen.append(f.count())], lambda r: seen.append("kept")) and seen == ["kept", 2 + 11]
    assert not deliver.deliver(known, found.limit(0), [lambda c, f: seen.append("no")], lambda r: seen.append("again")) and seen[-1] == "again"
    assert not deliver.deliver(known.limit(0), found, [], lambda r: seen.append("never")) and "never" not in seen
    spans = []
    assert deliver.export_spans(known, found, spans.append) == 2 and {s["status"] for s in spans} == {"ERROR", "OK"}
    page = deliver.project_page(known, found, spark.createDataFrame([("/<x>/", "method")], "endpoint string, skip_reason string"))
    assert "Least healthy: shop" in page and "&lt;x&gt;" in page
    assert "<td>0.0%</td>" in deliver.cache_page(None)
    states = turbo.lifecycle(spark.createDataFrame([(0, i, "f", "SELECT <1>") for i in range(9)], "process_id int, seq int, fingerprint string, fresh_sql string"))
    assert "88.9%" in deliver.cache_page(states) and "SELECT &lt;1&gt;" in deliver.cache_page(states)


def test_commands(spark, log, tmp_path, capsys):
    at = str(tmp_path / "log")
    log.write.json(at)
    run = lambda *a: (commands.main([*a], spark), capsys.readouterr().out)
    code, text = run("check_queries", "--log", at, "--fail-on", "critical")
    assert code == 1 and "N+1 detected: 12" in text
    code, text = run("check_queries", "--log", at, "--file", "nowhere", "--fail-on", "info")
    assert code == 0
    with pytest.raises(LookupError):
        run("check_queries", "--log", at, "--url", "/none/")
    code, text = run("check_queries", "--log", at, "--save-baseline", str(tmp_path / "base"), "--group")
    assert "Findings by group" in text
    code, text = run("check_queries", "--log", at, "--baseline", str(tmp_path / "base"), "--fail-on-regression")
    assert code == 0 and "0 new, 0 resolved" in text
    code, text = run("diagnose_project", "--log", at, "--format", "json", "--methods", "GET")
    assert json.loads(text)["skipped_urls"] == [{"pattern": "/b/", "reason": "method"}]
    assert run("query_budget", "--log", at, "--max-queries", "11")[0] == 1 and run("query_budget", "--log", at, "--max-queries", "12")[0] == 0
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "serializers.py").write_text(SOURCE)
    code, text = run("check_serializers", "--sources", str(tmp_path / "src"), "--fail-on", "warning", "--format", "json")
    assert code == 1 and "related" not in json.loads(text.splitlines()[0])["severity"]
    assert "No fixes to apply." in run("fix_queries", "--log", at, "--sources", str(tmp_path / "src"))[1]
    commands.main(["cache_report", "-o", str(tmp_path / "page.html")], spark)
    assert "Statement cache" in (tmp_path / "page.html").read_text()


def test_changed_files(tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    git("commit", "--allow-empty", "-qm", "a")
    (tmp_path / "f.py").write_text("x")
    git("add", ".")
    git("commit", "-qm", "b")
    assert commands.changed_files("HEAD~1", str(tmp_path)) == {"f.py"} and commands.changed_files("nowhere", str(tmp_path)) == set()


def test_catalog_from_tables(spark):
    models = spark.createDataFrame([("made", "Case", "made_case", 0)], "app string, name string, `table` string, place int")
    fields = spark.createDataFrame([("made_case", 0, "id", True), ("made_case", 1, "plain", None), ("made_case", 2, "ref", None)], "`table` string, place int, name string, primary_key boolean")
    indexes = spark.createDataFrame([("made_case", "index", ["ref_id"])], "`table` string, kind string, fields array<string>")
    read = catalog.Catalog.read(spark, models, fields, indexes)
    assert [tuple(r) for r in read.unindexed().collect()] == [("made_case", "plain", "Case")]


def test_replay_matches_a_plain_cache(spark):
    import random

    pick = random.Random(2)
    rows = [(p, i, f"f{pick.randrange(6)}", f"s{pick.randrange(20) == 0}", pick.choice([1, 1, 1, 2])) for p in (0, 1) for i in range(300)]
    got = {(r.process_id, r.seq): r.state for r in turbo.replay(spark.createDataFrame(rows, "process_id int, seq int, fingerprint string, fresh_sql string, param_count int"), max_size=4).collect()}
    for p in (0, 1):
        held, poisoned, order = {}, set(), []
        for _, i, f, sql, n in (r for r in rows if r[0] == p):
            if f in poisoned:
                want = "miss"
            elif f not in held:
                want = "miss"
                if len(order) == 4:
                    held.pop(order.pop(0))
                held[f] = [sql, n, 0]
                order.append(f)
            else:
                text, params, passed = held[f]
                order.remove(f)
                order.append(f)
                if passed >= 3:
                    want = "trusted" if n == params else "demote"
                    held[f][2] = passed if n == params else 0
                elif sql == text:
                    want = "validate"
                    held[f][2] += 1
                else:
                    want = "poison"
                    poisoned.add(f)
                    del held[f]
                    order.remove(f)
            assert got[p, i] == want
    assert {"miss", "validate", "trusted", "demote", "poison"} <= set(got.values())


def test_baseline_document_is_one_json_text_in_lines(spark, tmp_path):
    rows = [("n_plus_one", "warning", f"d{i % 3}\n,{{", None if i % 2 else "f.py", i % 2, "fix") for i in range(25)]
    found = spark.createDataFrame(rows, "issue_type string, severity string, description string, file_path string, line_number int, fix_suggestion string")
    lines = [r.document for r in report.baseline_document(found, block=2).collect()]
    whole = json.loads("\n".join(lines))
    assert len(lines) == 27 and whole["version"] == "1" and whole["issue_count"] == 25  # no line holds two issues
    want = [dict(zip(("issue_type", "severity", "description", "file_path", "line", "fix_suggestion"), r)) for r in rows]
    key = lambda d: [(v is not None, v) for v in d.values()]
    assert whole["issues"] == sorted(want, key=key)
    report.write_baseline(found, str(tmp_path / "base"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "base").glob("part-*")))
    assert json.loads(text) == whole and report.read_baseline(spark, str(tmp_path / "base")).count() == 25
    nothing = [r.document for r in report.baseline_document(found.where("false")).collect()]
    assert json.loads("\n".join(nothing)) == {"version": "1", "issue_count": 0, "issues": []}
    report.write_baseline(found.where("false"), str(tmp_path / "none"))
    assert report.read_baseline(spark, str(tmp_path / "none")).count() == 0
    other = tmp_path / "pretty.json"
    other.write_text(json.dumps(whole, indent=2))
    assert report.read_baseline(spark, str(other)).count() == 25


def test_texts_are_analyzed_once_or_row_by_row(spark, log):
    from querysift.plans.enrich import known

    kept = []
    few, many = known(log, kept=kept), known(log, most=0, kept=kept)
    columns = sorted(few.columns)
    assert columns == sorted(many.columns) == sorted(enrich(log).columns)
    assert sorted(map(str, few.select(columns).collect())) == sorted(map(str, many.select(columns).collect())) == sorted(map(str, enrich(log).select(columns).collect()))
    assert kept[1].count() == few.select("normalized_sql").distinct().count() and kept[3].count() == log.count()
    for one in kept:
        one.unpersist()
