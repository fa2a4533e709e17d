"""Findings as changes of source lines: what to write, as a patch, and on disk."""

from __future__ import annotations

import ast
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds whose change may be written without a person; all others are shown only.
WRITABLE = ("queryset_eval", "duplicate_query", "missing_index")


def source_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and text of the Python files below `path`."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.py")
    rows = files.select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("i", "text"))
    return rows.select("file", (F.col("i") + 1).alias("line"), "text")


def rewritten(issue_type: Column, text: Column, fix: Column) -> Column:
    """The line with its change; null where the kind has none that fits in a line."""
    indent = F.regexp_extract(text, r"^(\s*)", 1)
    call = lambda *names: F.coalesce(*[F.nullif(F.regexp_extract(fix, rf"\.{n}\([^)]*\)", 0), F.lit("")) for n in names])
    comment = lambda *said: F.concat(indent, F.lit("# TODO: "), *said, F.lit("\n"), text)
    counted = F.when(F.contains(F.lower(fix), F.lit("count()")), F.regexp_replace(text, r"len\((\w+)\)", "$1.count()")).otherwise(text)
    asked = F.when(F.contains(F.lower(fix), F.lit("exists()")), F.regexp_replace(counted, r"if\s+(\w+)\s*:", "if $1.exists():")).otherwise(counted)
    return (
        F.when(issue_type.isin("n_plus_one", "drf_serializer"), F.concat(text, call("select_related", "prefetch_related")))
        .when(issue_type == "fat_select", F.concat(text, call("only", "defer")))
        .when(issue_type == "duplicate_query", comment(F.lit("Cache this query result to avoid duplicate execution")))
        .when(issue_type == "missing_index", comment(F.lit("Consider adding an index via Meta.indexes - "), fix))
        .when(issue_type == "queryset_eval", asked)
    )


def proposed(findings: DataFrame, lines: DataFrame, kinds: tuple[str, ...] = (), files: tuple[str, ...] = ()) -> DataFrame:
    """Changes of findings with a place and advice, whose line is known and would differ: file, line, before, after,
    writable, issue_type and description, each once; `ord` counts a file's from its last line up.

    `kinds` and `files` keep only those kinds, and files whose paths end alike."""
    placed = findings.where("file_path is not null and coalesce(fix_suggestion, '') <> ''")
    if kinds:
        placed = placed.where(F.col("issue_type").isin(*kinds))
    if files:
        placed = placed.where(F.exists(F.array(*map(F.lit, files)), lambda x: F.endswith(F.col("file_path"), x) | F.endswith(x, F.col("file_path"))))
    wanted = placed.select(F.col("file_path").alias("file"), F.col("line_number").alias("line"), "issue_type", "description", "fix_suggestion").distinct()
    both = wanted.join(lines.select("file", "line", F.col("text").alias("before")), ["file", "line"])
    made = both.withColumn("after", rewritten(F.col("issue_type"), F.col("before"), F.col("fix_suggestion"))).where("after <> before")
    order = Window.partitionBy("file").orderBy(F.desc("line"), "issue_type", "description", "after")
    return made.select("file", "line", "before", "after", F.col("issue_type").isin(*WRITABLE).alias("writable"), "issue_type", "description", F.row_number().over(order).cast("int").alias("ord"))


def patch(fixes: DataFrame) -> DataFrame:
    """Each file's changes as text in the manner of a patch, from its last line up; those not writable say so."""
    tag = F.when(F.col("writable"), "").otherwise(" [MANUAL FIX ONLY]")
    added = F.array_join(F.transform(F.split("after", "\n"), lambda x: F.concat(F.lit("+ "), x)), "\n")
    at = F.col("line").cast("string")
    text = F.concat_ws("\n", F.concat(F.lit("--- "), "file"), F.concat(F.lit("+++ "), "file"), F.concat(F.lit("@@ -"), at, F.lit(",1 +"), at, F.lit(",1 @@")), F.concat(F.lit("  ["), "description", F.lit("]"), tag), F.concat(F.lit("- "), F.rtrim("before")), added)
    return fixes.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"]), "\n").alias("patch"))


def refused(fixes: DataFrame) -> DataFrame:
    """How many changes are left to a person, and of which kinds."""
    return fixes.agg(F.count_if(~F.col("writable")).alias("refused"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("writable"), F.col("issue_type")))), ",").alias("kinds"))


def write(fixes: DataFrame, backup: bool = True) -> tuple[list[str], list[str]]:
    """Writes the writable changes into the files on the driver's disk; returns the files written and those rejected
    because they would no longer parse. One file's changes are held at a time; of several for a line the first in order
    is written, as each was made from the line as it stood."""
    done, failed = [], []
    rows = fixes.where("writable").orderBy("file", "ord").toLocalIterator()
    by_file: dict[str, dict[int, str]] = {}
    for r in rows:
        if r.file not in by_file and by_file:
            _write_file(*by_file.popitem(), backup, done, failed)
        by_file.setdefault(r.file, {}).setdefault(r.line, r.after)
    if by_file:
        _write_file(*by_file.popitem(), backup, done, failed)
    return done, failed


def _write_file(file: str, changes: dict[int, str], backup: bool, done: list[str], failed: list[str]) -> None:
    path = Path(file)
    if not path.is_file():
        return
    lines = path.read_text(encoding="utf-8").split("\n")
    for line in sorted((x for x in changes if 0 < x <= len(lines)), reverse=True):
        lines[line - 1 : line] = changes[line].split("\n")
    try:
        ast.parse("\n".join(lines))
    except SyntaxError:
        failed.append(file)
        return
    if backup:
        shutil.copy2(path, f"{path}.bak")
    path.write_text("\n".join(lines), encoding="utf-8")
    done.append(file)
