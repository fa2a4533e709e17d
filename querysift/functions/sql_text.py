"""Scalar functions on SQL text, as native column expressions.

Patterns carry (?U) so that word, digit and space classes follow Unicode. Every row's text goes through each of them, so
none tests a costly class at every character: a pattern begins with what rarely fits, and a word's start is asked for
behind it (`TRUE(?<=\\bTRUE)` finds what `\\bTRUE` finds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The steps of normalization, whose order is part of the result. A single space is one already; literals
#: are possessive, so that a long one takes no stack.
NORMALIZE = (
    (r"'[^'\\]*+(?:\\.[^'\\]*+)*+'", "?"), (r"%s", "?"), (r"(?iU)TRUE(?<=\bTRUE)\b", "?"), (r"(?iU)FALSE(?<=\bFALSE)\b", "?"),
    (r"(?U)(?=\d)\b\d++(?:\.\d++)?\b", "?"), (r"(?iU)IN(?<=\bIN)\s*\([^)]*\)", "IN (?)"), (r"(?U)\s(?:(?<! )\s*|\s+)", " "), (r";+$", ""),
)
#: Patterns by which the analyzers read statements.
TABLES = r'(?iU)(?=[FJUID])(?:FROM|JOIN|UPDATE|INSERT\s+INTO|DELETE\s+FROM)\s+"?(\w+)"?'
FK_LOOKUP = r'(?iU)where\s+"?(\w+)"?\."?(\w+_id)"?\s*=\s*\?'
PK_LOOKUP = r'(?iU)where\s+"?(\w+)"?\."?id"?\s*=\s*\?'
WHERE_CLAUSE = r"(?iU)WHERE(?<=\bWHERE)\b(.+?)(?:(?=[OGLH])\b(?:ORDER|GROUP|LIMIT|HAVING)\b|$)"
WHERE_COLUMN = r'(?iU)"(\w+)"\."(\w+)"\s*(?:=|<|>|<=|>=|<>|!=|LIKE|IN|IS)\s'
ORDER_CLAUSE = r"(?iU)ORDER\s+BY\s+(.+?)(?:\s+LIMIT|\s*$)"
ANY_COLUMN = r'(?U)"(\w+)"\."(\w+)"'
SELECT_LIST = r"(?isU)SELECT\s+(.*?)\s+FROM\s+"
FROM_TABLE = r'(?iU)FROM\s+"?(\w+)"?'
ONE_BY_PK = r'(?iU)WHERE\s+"?\w+"?\."?id"?\s*=\s*\?'
ONE_BY_LIMIT = r"(?iU)LIMIT(?<=\bLIMIT)\s+1\b"
EVALUATIONS = (("list(qs)[0]", r"(?iU)\blist\s*\(.*\)\s*\[\s*\d+\s*\]"), ("len(qs)", r"(?iU)\blen\s*\("), ("bool(qs)", r"(?iU)(?:\bbool\s*\(|^\s*if\s+\w)"))
#: Pattern, weight, and how its matches count: each one, each beyond the first, or any at all.
COMPLEXITY = (
    (r"JOIN(?<=\bJOIN)\b", 2, "each"), (r"SELECT(?<=\bSELECT)\b", 3, "beyond"), (r"OR(?<=\bOR)\b", 1, "each"), (r"GROUP(?<=\bGROUP)\s+BY\b", 2, "any"), (r"HAVING(?<=\bHAVING)\b", 2, "any"),
    (r"DISTINCT(?<=\bDISTINCT)\b", 1, "any"), (r"ORDER(?<=\bORDER)\s+BY\b", 1, "any"), (r"WHEN(?<=\bWHEN)\b", 1, "each"), (r"(?=[UIE])\b(?:UNION|INTERSECT|EXCEPT)\b", 3, "any"), (r"LIKE\s+'%", 2, "any"),
)
NOT_WRITES = ("begin", "commit", "rollback", "savepoint", "release", "set ", "pragma")
WRITES = (("insert", r'(?iU)^insert\s+into\s+"?(\w+)"?'), ("update", r'(?iU)^update\s+"?(\w+)"?'), ("delete", r'(?iU)^delete\s+from\s+"?(\w+)"?'))


def normalize(sql: Column) -> Column:
    for pattern, to in NORMALIZE:
        sql = F.replace(sql, F.lit(pattern), F.lit(to)) if pattern == "%s" else F.regexp_replace(sql, pattern, to)
    return F.lower(F.trim(sql))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def fingerprint(sql: Column) -> Column:
    return short_hash(normalize(sql))


def tables(sql: Column) -> Column:
    """Distinct tables in order of mention, from the raw text."""
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(TABLES), F.lit(1)))


def duplicate_key(sql: Column, params: Column) -> Column:
    return short_hash(F.concat(sql, F.lit("|"), F.coalesce(params, F.lit("None"))))


def _pairs(text: Column, pattern: str) -> Column:
    """Table and column of each match."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2)]
    return F.arrays_zip(found[0].alias("table"), found[1].alias("column"))


def where_columns(normalized: Column) -> Column:
    return _pairs(F.regexp_extract(normalized, WHERE_CLAUSE, 1), WHERE_COLUMN)


def order_by_columns(normalized: Column) -> Column:
    return _pairs(F.regexp_extract(normalized, ORDER_CLAUSE, 1), ANY_COLUMN)


def base_table(sql: Column) -> Column:
    return F.regexp_extract(sql, FROM_TABLE, 1)


def select_columns(sql: Column, table: Column | None = None) -> Column:
    """Names in the first select list, of one table only if given; `*` alone gives itself."""
    names = F.regexp_extract(sql, SELECT_LIST, 1)
    pairs = _pairs(names, ANY_COLUMN)
    own = pairs if table is None else F.filter(pairs, lambda x: x["table"] == table)
    return F.when(F.trim(names) == "*", F.array(F.lit("*"))).otherwise(F.transform(own, lambda x: x["column"]))


def single_row(sql: Column) -> Column:
    return sql.rlike(ONE_BY_PK) | sql.rlike(ONE_BY_LIMIT)


def complexity(normalized: Column) -> Column:
    """The weighted count of joins, subqueries, disjunctions and the like."""
    upper, score = F.upper(normalized), F.lit(0)
    for pattern, weight, how in COMPLEXITY:
        count = F.regexp_count(upper, F.lit(pattern))
        score += weight * {"each": count, "beyond": F.greatest(count - 1, F.lit(0)), "any": upper.rlike(pattern).cast("int")}[how]
    return score + 2 * (upper.rlike(r"COUNT(?<=\bCOUNT)\s*\(") & upper.rlike(COMPLEXITY[0][0])).cast("int")


def masked(sql: Column) -> Column:
    """Literals as `?`; doubled quotes stay inside, an open literal goes to the end."""
    return F.regexp_replace(sql, r"'(?:[^']|'')*(?:'|$)", "?")


def values_tuples(sql: Column) -> Column:
    """Tuples at top level after the first VALUES."""

    def step(acc: Column, c: Column) -> Column:
        opened = (c == "(").cast("int")
        depth = F.greatest(acc["depth"] + opened - (c == ")").cast("int"), F.lit(0))
        return F.struct(depth.alias("depth"), (acc["n"] + F.when(acc["depth"] == 0, opened).otherwise(0)).alias("n"))

    tail = F.regexp_extract(masked(sql), r"(?isU)\bvalues\b(.*)$", 1)
    return F.aggregate(F.split(tail, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def longest_in_list(sql: Column) -> Column:
    """Most items of an IN list at its own depth; a subquery counts as none."""

    def items(body: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            depth = F.when(acc["depth"] == 0, 0).otherwise(acc["depth"] + (c == "(").cast("int") - (c == ")").cast("int"))
            return F.struct(depth.alias("depth"), (acc["n"] + ((acc["depth"] == 1) & (c == ",")).cast("int")).alias("n"))

        count = F.aggregate(F.split(body, ""), F.struct(F.lit(1).alias("depth"), F.lit(1).alias("n")), step, lambda acc: acc["n"])
        return F.when(F.lower(F.ltrim(body)).startswith("select"), 0).otherwise(count)

    parts = F.split(masked(sql), r"(?iU)\bin\s*\(", -1)
    bodies = F.transform(F.slice(parts, 2, F.size(parts)), lambda p, i: F.array_join(F.slice(parts, i + 2, F.size(parts)), " in ("))
    return F.coalesce(F.array_max(F.transform(bodies, items)), F.lit(0))


def write_kind(normalized: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(WRITES):
        out = F.when(normalized.rlike(pattern), kind).otherwise(out)
    for prefix in NOT_WRITES:
        out = F.when(~normalized.startswith(prefix), out)
    return out


def write_table(kind: Column, normalized: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.regexp_extract(normalized, p, 1)) for k, p in WRITES])


def many_rows(kind: Column, sql: Column) -> Column:
    """Whether the raw text of a write names several rows."""
    return F.when(kind == "insert", values_tuples(sql) > 1).otherwise(longest_in_list(sql) > 1)


def write_class(normalized: Column, sql: Column) -> Column:
    """kind and table of a single-row write, null for others; kind by the normalized text, rows by the raw."""
    kind = write_kind(normalized)
    return F.when(kind.isNotNull() & ~many_rows(kind, sql), F.struct(kind.alias("kind"), write_table(kind, normalized).alias("table")))


def evaluation(code: Column) -> Column:
    """How a line of code evaluates its rows inefficiently, or null."""
    return F.coalesce(*[F.when(code.rlike(pattern), name) for name, pattern in EVALUATIONS])
