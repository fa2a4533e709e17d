"""The queries in SQL, for an engine that reads the same tables."""

from __future__ import annotations

from .operators import queryset_eval, write_nplusone
from .plans import report, workload
from .queries import BASELINE_FILTER, BUDGET, RULES
from .sources.captures import CODE_SQL, EVENT_SQL
from .sources.catalog import SHOP


def _values(rows: list[tuple]) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    return "VALUES " + ", ".join(f"({', '.join(map(quote, r))})" for r in rows)


_BY_TABLE = {m.table: m for m in SHOP}
_LARGE = [f"{m.table}.{f.column}" for m in SHOP for f in m.fields if f.large]
_FK = [(m, f) for m in SHOP for f in m.fields if f.related and not f.through]
_STEPS = (
    ("'''(?:[^''\\\\]|\\\\.)*'''", "?"), ("'(?i)\\bTRUE\\b'", "?"), ("'(?i)\\bFALSE\\b'", "?"), ("'\\b\\d+(?:\\.\\d+)?\\b'", "?"),
    ("'(?i)\\bIN\\s*\\([^)]*\\)'", "IN (?)"), ("'\\s+'", " "), ("';+$'", ""),
)


def _normalized(column: str) -> str:
    for i, (pattern, to) in enumerate(_STEPS):
        column = f"regexp_replace({column}, {pattern}, '{to}', 'g')"
        column = f"replace({column}, '%s', '?')" if i == 0 else column
    return f"lower(trim({column}))"


_n = lambda pattern: f"len(regexp_extract_all(upper(n), '{pattern}'))"
_any = lambda pattern: f"CASE WHEN regexp_matches(upper(n), '{pattern}') THEN 1 ELSE 0 END"
_SCORE = (
    f"2 * {_n(r'\bJOIN\b')} + 3 * greatest({_n(r'\bSELECT\b')} - 1, 0) + {_n(r'\bOR\b')} + 2 * {_any(r'\bGROUP\s+BY\b')} + 2 * {_any(r'\bHAVING\b')} + {_any(r'\bDISTINCT\b')} "
    f"+ {_any(r'\bORDER\s+BY\b')} + {_n(r'\bWHEN\b')} + 3 * {_any(r'\b(?:UNION|INTERSECT|EXCEPT)\b')} + 2 * {_any(r'LIKE\s+''%')} "
    f"+ 2 * (CASE WHEN regexp_matches(upper(n), '\\bCOUNT\\s*\\(') AND regexp_matches(upper(n), '\\bJOIN\\b') THEN 1 ELSE 0 END)"
)
_CLAUSE = r"regexp_extract(n, '(?i)\bWHERE\b(.+?)(?:\bORDER\b|\bGROUP\b|\bLIMIT\b|\bHAVING\b|$)', 1)"
_COMPARED = r"""'(?i)"(\w+)"\."(\w+)"\s*(?:=|<|>|<=|>=|<>|!=|LIKE|IN|IS)\s'"""
_ORDER_BY = r"regexp_extract(n, '(?i)ORDER\s+BY\s+(.+?)(?:\s+LIMIT|\s*$)', 1)"
_QUALIFIED = r"""'"(\w+)"\."(\w+)"'"""
_refs = lambda text, pattern: f"list_zip(regexp_extract_all({text}, {pattern}, 1), regexp_extract_all({text}, {pattern}, 2))"
_SITE = "arg_min(struct_pack(f := file_path, l := line), seq) FILTER (WHERE file_path IS NOT NULL) AS site"
_GROUP = f"count(*)::INTEGER AS c, sum(ms) AS total, min(seq) AS first_seq, max(seq) AS last_seq, {_SITE}"
_BASE = "scope_id, {order} AS analyzer_ord, first_seq, {pos} AS pos, '{kind}' AS issue_type, {severity} AS severity, {text} AS description, {fix} AS fix_suggestion, {file} AS file_path, {line} AS line_number, {count} AS query_count, {saved} AS time_saved_ms, fp AS fingerprint"
_SAVED = "total * (c - 1) / c"


def _finding(order: int, kind: str, severity: str, text: str, fix: str, grouped: bool, pos: str = "0", count: str = "1") -> str:
    site = ("site.f", "site.l") if grouped else ("file_path", "line")
    return _BASE.format(order=order, pos=pos, kind=kind, severity=severity, text=text, fix=fix, file=site[0], line=site[1], count="c" if grouped else count, saved=_SAVED if grouped else "0.0")


_WRITE_FIX = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in write_nplusone.FIXES.items()) + " END"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{x}') AS {x}" for x in ("critical", "warning", "info"))
CTES = {
    "caps": f"""SELECT user_id AS scope_id, event_id AS seq, ts AS captured, '/r/' || (user_id % 20) || '/' AS endpoint, 'app' || (user_id % 4) AS app_name, {EVENT_SQL} AS raw, value AS ms,
  CASE WHEN event_id % 17 <> 0 THEN 'app' || (user_id % 4) || '/views.py' END AS file_path, CASE WHEN event_id % 17 <> 0 THEN (100 + k % 5)::INTEGER END AS line, CASE WHEN event_id % 17 <> 0 THEN {CODE_SQL} END AS code
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "norm": f"SELECT *, {_normalized('raw')} AS n FROM caps",
    "cq": r"""SELECT *, substr(sha256(n), 1, 16) AS fp, starts_with(n, 'select') AS is_select,
  list_filter(t, lambda x, i: list_position(t, x) = i) AS tables
  FROM (SELECT *, regexp_extract_all(raw, '(?i)(?:FROM|JOIN|UPDATE|INSERT\s+INTO|DELETE\s+FROM)\s+"?(\w+)"?', 1) AS t FROM norm)""",
    "names": f"SELECT * FROM ({_values([(m.table, m.name) for m in SHOP])}) x(t, name)",
    "through": f"SELECT * FROM ({_values([(f.through, m.name, f.name) for m in SHOP for f in m.fields if f.through])}) x(t, name, field)",
    "reverse": f"SELECT * FROM ({_values([(m.table, f.column, _BY_TABLE[f.related].name, f.accessor) for m, f in _FK])}) x(t, c, name, field)",
    "forward": f"SELECT * FROM ({_values([(f.related, m.table, m.name, f.name, i) for i, (m, f) in enumerate(_FK)])}) x(t, source, name, field, place)",
    "unindexed": f"SELECT * FROM ({_values([(m.table, f.column, m.name) for m in SHOP for f in m.fields if f.name != "id" and not f.related])}) x(t, c, name)",
    "sel": f"SELECT scope_id, fp, n, {_GROUP} FROM cq WHERE is_select GROUP BY scope_id, fp, n",
    "loops": r"""SELECT *, CASE WHEN fk <> '' THEN fk ELSE pk END AS tbl FROM (SELECT *, regexp_extract(n, 'where\s+"?(\w+)"?\."?(\w+_id)"?\s*=\s*\?', 1) AS fk,
  regexp_extract(n, 'where\s+"?(\w+)"?\."?(\w+_id)"?\s*=\s*\?', 2) AS col, regexp_extract(n, 'where\s+"?(\w+)"?\."?id"?\s*=\s*\?', 1) AS pk FROM sel WHERE c >= 3) WHERE fk <> '' OR pk <> ''""",
    "reads": "SELECT scope_id, source, min(seq) AS read_seq FROM (SELECT scope_id, seq, unnest(tables) AS source FROM cq WHERE is_select) GROUP BY ALL",
    "keys": "SELECT l.scope_id, l.fp, f.name, f.field FROM loops l JOIN forward f ON l.pk = f.t AND l.fk = '' JOIN reads r ON r.scope_id = l.scope_id AND r.source = f.source AND r.read_seq < l.first_seq QUALIFY row_number() OVER (PARTITION BY l.scope_id, l.fp ORDER BY f.place) = 1",
    "solved": """SELECT l.*, coalesce(h.name, r.name, k.name, m.name, l.tbl) AS name, coalesce(h.field, r.field, k.field) AS field,
  CASE WHEN h.field IS NOT NULL OR r.field IS NOT NULL THEN 'prefetch_related' WHEN k.field IS NOT NULL THEN 'select_related' ELSE 'bulk_fetch' END AS strategy
  FROM loops l LEFT JOIN names m ON l.tbl = m.t LEFT JOIN through h ON l.fk = h.t LEFT JOIN reverse r ON l.fk = r.t AND l.col = r.c LEFT JOIN keys k ON l.scope_id = k.scope_id AND l.fp = k.fp""",
    "f_nplusone": "SELECT " + _finding(0, "n_plus_one", "CASE WHEN c >= 10 THEN 'critical' ELSE 'warning' END",
        """'N+1 detected: ' || c || ' queries for table "' || tbl || '" ' || CASE strategy WHEN 'bulk_fetch' THEN '(one row per iteration, no relation traversed)' ELSE '(via ' || name || '.' || field || ')' END""",
        """CASE strategy WHEN 'bulk_fetch' THEN 'Fetch the rows in one query: ' || name || '.objects.in_bulk(ids), or ' || name || '.objects.filter(pk__in=ids), instead of one lookup per iteration'
        ELSE 'Add .' || strategy || '(''' || field || ''') to your ' || name || ' queryset' || CASE strategy WHEN 'prefetch_related' THEN '. For advanced filtering, use Prefetch(''' || field || ''', queryset=...)' ELSE '' END END""", True) + " FROM solved",
    "dup": f"SELECT scope_id, raw, fp, any_value(tables) AS tables, {_GROUP} FROM cq WHERE is_select GROUP BY scope_id, raw, fp HAVING count(*) >= 2",
    "writes": "SELECT scope_id, seq, unnest(tables) AS tbl FROM cq WHERE NOT is_select",
    "dup_free": "SELECT * FROM dup d WHERE NOT EXISTS (SELECT 1 FROM writes w WHERE w.scope_id = d.scope_id AND w.seq > d.first_seq AND w.seq < d.last_seq AND list_contains(d.tables, w.tbl))",
    "f_duplicate": "SELECT " + _finding(1, "duplicate_query", "'warning'", """'Duplicate query: ' || c || ' identical queries for table "' || coalesce(tables[1], 'unknown') || '"'""",
        "'Assign the queryset result to a variable and reuse it instead of executing the same query multiple times'", True) + " FROM dup_free",
    "refs": f"SELECT * FROM (SELECT *, unnest(r) AS ref, generate_subscripts(r, 1) - 1 AS pos FROM (SELECT *, {_refs(_CLAUSE, _COMPARED)} || {_refs(_ORDER_BY, _QUALIFIED)} AS r FROM cq WHERE is_select))",
    "f_missing_index": "SELECT " + _finding(2, "missing_index", "'info'", """'Missing index: column "' || c || '" on ' || name || ' (table "' || t2 || '") is used in WHERE/ORDER BY but has no index'""",
        """'Add to ' || name || '''s Meta.indexes: indexes = [models.Index(fields=["' || c || '"], name="idx_' || t2 || '_' || c || '")]'""", False, pos="pos::INTEGER")
        + " FROM (SELECT r.scope_id, r.seq AS first_seq, r.pos, r.fp, r.file_path, r.line, u.t AS t2, u.c, u.name FROM refs r JOIN unindexed u ON r.ref[1] = u.t AND r.ref[2] = u.c QUALIFY row_number() OVER (PARTITION BY r.scope_id, u.t, u.c ORDER BY r.seq, r.pos) = 1)",
    "wide": rf"""SELECT *, list_filter(cols, lambda x: list_contains({_LARGE}, base || '.' || x)) AS big FROM (SELECT *, CASE WHEN trim(list_text) = '*' THEN ['*'] ELSE list_transform(list_filter(list_zip(regexp_extract_all(list_text, '"(\w+)"\."(\w+)"', 1), regexp_extract_all(list_text, '"(\w+)"\."(\w+)"', 2)), lambda p: p[1] = base), lambda p: p[2]) END AS cols
  FROM (SELECT *, regexp_extract(n, '(?is)SELECT\s+(.*?)\s+FROM\s+', 1) AS list_text, regexp_extract(n, '(?i)FROM\s+"?(\w+)"?', 1) AS base FROM cq WHERE is_select
    AND NOT regexp_matches(n, '(?i)WHERE\s+"?\w+"?\."?id"?\s*=\s*\?') AND NOT regexp_matches(n, '(?i)\bLIMIT\s+1\b'))) WHERE len(cols) >= 8""",
    "f_fat_select": "SELECT " + _finding(3, "fat_select", "'info'", """'Fat SELECT: ' || len(cols) || ' columns from "' || base || '"' || CASE WHEN len(big) > 0 THEN ' including large fields: ' || array_to_string(big, ', ') ELSE '' END""",
        """CASE WHEN len(big) > 0 THEN 'Use .defer(' || array_to_string(list_transform(big, lambda x: '''' || x || ''''), ', ') || ') to skip loading large fields, or .values()/.values_list() if you don''t need model instances'
        ELSE 'Use .only(''field1'', ''field2'', ...) to select only the fields you need, .defer() to skip large fields, or .values()/.values_list() if you don''t need model instances' END""", False)
        + " FROM (SELECT *, seq AS first_seq FROM wide QUALIFY row_number() OVER (PARTITION BY scope_id, base ORDER BY seq) = 1)",
    "evals": r"""SELECT *, seq AS first_seq, CASE WHEN regexp_matches(code, '(?i)\blist\s*\(.*\)\s*\[\s*\d+\s*\]') THEN 'list(qs)[0]' WHEN regexp_matches(code, '(?i)\blen\s*\(') THEN 'len(qs)' WHEN regexp_matches(code, '(?i)(?:\bbool\s*\(|^\s*if\s+\w)') THEN 'bool(qs)' END AS pattern
  FROM cq WHERE is_select AND code <> ''""",
    "f_queryset_eval": "SELECT " + _finding(4, "queryset_eval", "'info'", "'Inefficient queryset evaluation: ' || pattern", "CASE pattern " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in queryset_eval.FIXES.items()) + " END", False) + " FROM evals WHERE pattern IS NOT NULL",
    "scored": f"SELECT *, seq AS first_seq, {_SCORE} AS score, {_n(r'\bJOIN\b')} AS joins, {_n(r'\bSELECT\b')} AS selects, {_n(r'\bOR\b')} AS ors FROM cq WHERE is_select",
    "f_complexity": "SELECT " + _finding(5, "complexity", "CASE WHEN score >= 12 THEN 'critical' ELSE 'warning' END", "'Query complexity score ' || score || ' exceeds threshold 8'",
        """CASE WHEN joins <= 3 AND selects <= 1 AND ors <= 2 THEN 'Consider breaking into multiple simpler queries or using database views.' ELSE concat_ws(' ',
        CASE WHEN joins > 3 THEN 'Consider breaking this query into smaller queries: ' || joins || ' JOINs detected. Use select_related for 1-2 FKs and prefetch_related for the rest.' END,
        CASE WHEN selects > 1 THEN 'Replace subqueries with JOINs or annotate() where possible.' END,
        CASE WHEN ors > 2 THEN 'Multiple OR conditions prevent index usage. Consider using Q objects with separate filtered querysets combined via union().' END) END""", False, count="0") + " FROM scored WHERE score >= 8",
    "kinds": r"""SELECT *, CASE kind WHEN 'insert' THEN regexp_extract(n, '^insert\s+into\s+"?(\w+)"?', 1) WHEN 'update' THEN regexp_extract(n, '^update\s+"?(\w+)"?', 1) ELSE regexp_extract(n, '^delete\s+from\s+"?(\w+)"?', 1) END AS tbl
  FROM (SELECT *, CASE WHEN regexp_matches(n, '^insert\s+into\s+"?(\w+)"?') THEN 'insert' WHEN regexp_matches(n, '^update\s+"?(\w+)"?') THEN 'update' WHEN regexp_matches(n, '^delete\s+from\s+"?(\w+)"?') THEN 'delete' END AS kind,
    len(regexp_extract_all(regexp_extract(raw, '(?i)\bvalues\b(.*)$', 1), '\(')) AS tuples, len(regexp_extract_all(regexp_extract(raw, '(?i)\bin\s*\(([^)]*)\)', 1), ',')) + 1 AS items FROM cq WHERE NOT is_select)
  WHERE kind IS NOT NULL AND NOT (CASE kind WHEN 'insert' THEN tuples > 1 ELSE items > 1 END)""",
    "written": f"SELECT w.*, m.name FROM (SELECT scope_id, fp, kind, tbl, {_GROUP} FROM kinds GROUP BY scope_id, fp, kind, tbl HAVING count(*) >= 3) w LEFT JOIN names m ON w.tbl = m.t",
    "f_write_nplusone": "SELECT " + _finding(7, "write_n_plus_one", "CASE WHEN c >= 10 THEN 'critical' ELSE 'warning' END",
        """'Write N+1 detected: ' || c || ' single-row ' || upper(kind) || ' statements for ' || coalesce(name, 'table "' || tbl || '"') || '. One bulk statement replaces all ' || c || '.'""",
        f"coalesce(replace(replace({_WRITE_FIX}, 'Model.objects', name || '.objects'), 'Model(...)', name || '(...)'), {_WRITE_FIX})", True) + " FROM written",
    "findings": "SELECT *, CASE WHEN issue_type IN ('n_plus_one', 'write_n_plus_one') THEN 0 WHEN issue_type = 'duplicate_query' THEN 1 WHEN issue_type IN ('missing_index', 'queryset_eval') THEN 2 WHEN issue_type = 'complexity' THEN 3 ELSE 4 END AS apply_rank FROM ("
        + " UNION ALL ".join(f"SELECT * FROM f_{x}" for x in ("nplusone", "duplicate", "missing_index", "fat_select", "queryset_eval", "complexity", "write_nplusone")) + ")",
    "hashed": "SELECT *, substr(sha256(issue_type || ':' || coalesce(file_path, '') || ':' || description), 1, 16) AS issue_hash FROM findings",
    "accesses": "SELECT scope_id % 4 AS process_id, seq, fp, raw FROM cq WHERE is_select",
    "of": "SELECT DISTINCT scope_id, app_name, endpoint FROM cq",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY apply_rank, analyzer_ord, first_seq, pos, fingerprint) AS ord FROM findings",
    "per_scope": f"SELECT scope_id, total_queries, coalesce(issues, 0) AS issues, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info FROM (SELECT scope_id, count(*) AS total_queries FROM cq GROUP BY 1) LEFT JOIN (SELECT scope_id, count(*) AS issues, {_COUNTS} FROM findings GROUP BY 1) USING (scope_id)",
    "site_lines": "SELECT file_path AS file, line, CASE WHEN line % 2 = 1 THEN coalesce(min('    ' || code) FILTER (WHERE starts_with(code, 'if ')), max('    ' || code)) ELSE max('    ' || code) END AS before FROM cq WHERE file_path IS NOT NULL GROUP BY file_path, line",
    "changes": r"""SELECT *, issue_type IN ('queryset_eval', 'duplicate_query', 'missing_index') AS writable, row_number() OVER (PARTITION BY file ORDER BY line DESC, issue_type, description, after)::INTEGER AS ord FROM (
  SELECT l.file, l.line, before, issue_type, description, CASE issue_type WHEN 'n_plus_one' THEN before || nullif(CASE WHEN fix LIKE '%.select_related(%' THEN regexp_extract(fix, '\.select_related\([^)]*\)') ELSE regexp_extract(fix, '\.prefetch_related\([^)]*\)') END, '')
    WHEN 'fat_select' THEN before || nullif(CASE WHEN fix LIKE '%.only(%' THEN regexp_extract(fix, '\.only\([^)]*\)') ELSE regexp_extract(fix, '\.defer\([^)]*\)') END, '')
    WHEN 'duplicate_query' THEN '    # TODO: Cache this query result to avoid duplicate execution' || chr(10) || before WHEN 'missing_index' THEN '    # TODO: Consider adding an index via Meta.indexes - ' || fix || chr(10) || before
    WHEN 'queryset_eval' THEN regexp_replace(CASE WHEN contains(lower(fix), 'count()') THEN regexp_replace(before, 'len\((\w+)\)', '\1.count()') ELSE before END, CASE WHEN contains(lower(fix), 'exists()') THEN 'if\s+(\w+)\s*:' ELSE 'no such (text)' END, 'if \1.exists():') END AS after
  FROM (SELECT DISTINCT file_path AS file, line_number AS line, issue_type, description, fix_suggestion AS fix FROM findings WHERE file_path IS NOT NULL AND coalesce(fix_suggestion, '') <> '') f JOIN site_lines l ON f.file = l.file AND f.line = l.line) WHERE after <> before""",
    "lived": """SELECT process_id, seq, fp, raw, n, CASE WHEN n = 1 OR n > bad THEN 'miss' WHEN n = bad THEN 'poison' WHEN n <= 4 THEN 'validate' ELSE 'trusted' END AS state FROM (
  SELECT *, min(CASE WHEN n BETWEEN 2 AND 4 AND raw <> first_raw THEN n END) OVER (PARTITION BY process_id, fp) AS bad FROM (
    SELECT *, row_number() OVER w AS n, first(raw) OVER w AS first_raw FROM accesses WINDOW w AS (PARTITION BY process_id, fp ORDER BY seq)))""",
    "lived_entries": "SELECT process_id, fp, count(*) FILTER (WHERE state IN ('validate', 'trusted')) AS hit_count, bool_or(state = 'poison') AS poisoned, arg_min(raw, seq) AS sql FROM lived GROUP BY process_id, fp",
    "top20": "SELECT process_id, fp AS fingerprint, hit_count, substr(sql, 1, 200) AS preview, hit_count >= 3 AS trusted FROM lived_entries WHERE NOT poisoned AND hit_count > 0 ORDER BY hit_count DESC, process_id, fp LIMIT 20",
}
_SHOWN = "scope_id, issue_type, severity, description, fix_suggestion, file_path, line_number, query_count, round(time_saved_ms, 3) AS time_saved_ms, fingerprint, first_seq, pos::INTEGER AS pos"
_KEY = "coalesce(file_path, 'unknown') || ':' || issue_type"


#: Tables that several others read: derived once.
_KEPT_ONCE = ("cq", "findings", "hashed", "lived", "changes")


def _with(body: str) -> str:
    """The body, after the common tables that it needs."""
    import re

    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                todo.append(CTES[name])
    tables = ", ".join(f"{k} AS {'MATERIALIZED ' * (k in _KEPT_ONCE)}({v})" for k, v in CTES.items() if k in need)
    return f"WITH {tables} {body}" if tables else body


def _groups(key: str) -> str:
    first = "arg_min(struct_pack(f := coalesce(file_path, ''), d := description), struct_pack(a := scope_id, b := apply_rank, c := analyzer_ord, d := first_seq, e := pos::INTEGER, f := fingerprint, g := coalesce(file_path, ''), h := description))"
    place = "struct_pack(a := scope_id, b := apply_rank, c := analyzer_ord, d := first_seq, e := pos::INTEGER, f := fingerprint, g := coalesce(file_path, ''), h := description)"
    return f"""SELECT key, count, ['info', 'warning', 'critical'][worst] AS severity, CASE WHEN count = 1 THEN first.d ELSE count || ' related issues in ' || first.f || ': ' || first.d || ' (and ' || (count - 1) || ' more)' END AS summary,
  row_number() OVER (ORDER BY worst DESC, count DESC, place, key)::INTEGER AS ord FROM (
  SELECT {key} AS key, count(*) AS count, max(CASE severity WHEN 'info' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END) AS worst, {first} AS first, min({place}) AS place FROM findings GROUP BY 1)"""


_APPS = f"""SELECT a.app_name, urls, queries, round(time_ms, 3) AS time_ms, coalesce(issues, 0) AS issues, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info,
  greatest(0, 100 - 15 * coalesce(critical, 0) - 5 * coalesce(warning, 0) - coalesce(info, 0))::INTEGER AS health
  FROM (SELECT app_name, count(DISTINCT endpoint) AS urls, count(*) AS queries, sum(ms) AS time_ms FROM cq GROUP BY app_name) a
  LEFT JOIN (SELECT app_name, count(*) AS issues, {_COUNTS} FROM findings JOIN (SELECT DISTINCT scope_id, app_name FROM cq) USING (scope_id) GROUP BY app_name) f USING (app_name)"""
_BASELINE = f"(SELECT * FROM hashed WHERE {BASELINE_FILTER})"
_KEPT = " AND ".join("NOT (" + {
    "file": lambda p: f"coalesce(file_path, '') GLOB '{p}'", "sql": lambda p: f"description LIKE '%{p}%' OR EXISTS (SELECT 1 FROM cq q WHERE q.scope_id = findings.scope_id AND q.fp = findings.fingerprint AND q.raw LIKE '%{p}%')",
    "callsite": lambda p: f"coalesce(file_path || ':' || line_number, '') = '{p}'", "ignore": lambda p: f"issue_type = '{p.split(':')[0]}' AND contains(coalesce(file_path, ''), '{p.split(':')[1]}')",
}[kind](pattern) + ")" for kind, pattern in RULES)
BODIES: dict[str, str] = {
    "normalize": "SELECT seq, n AS normalized_sql, fp AS fingerprint, is_select FROM cq",
    "extract_tables": "SELECT seq, array_to_string(tables, ',') AS tables FROM cq",
    "complexity_score": "SELECT seq, score::INTEGER AS score FROM scored",
    "where_columns": f"SELECT seq, array_to_string(list_transform({_refs(_CLAUSE, _COMPARED)}, lambda p: p[1] || '.' || p[2]), ',') AS columns FROM cq WHERE is_select",
    "order_by_columns": f"SELECT seq, array_to_string(list_transform({_refs(_ORDER_BY, _QUALIFIED)}, lambda p: p[1] || '.' || p[2]), ',') AS columns FROM cq WHERE is_select",
    "write_classify": "SELECT seq, kind, tbl AS \"table\" FROM kinds",
    "duplicate_groups": "SELECT scope_id, substr(sha256(raw || '|None'), 1, 16) AS key, c AS query_count, first_seq, last_seq FROM dup",
    "nplusone_groups": "SELECT scope_id, fp AS fingerprint, c AS query_count, round(total, 3) AS total_ms, first_seq FROM sel WHERE c >= 3",
    **{x: f"SELECT {_SHOWN} FROM f_{x}" for x in ("nplusone", "duplicate", "missing_index", "fat_select", "queryset_eval", "complexity", "write_nplusone")},
    **{f"nplusone_{k}": f"SELECT scope_id, fp AS fingerprint, tbl AS \"table\", field, name AS model_name FROM solved WHERE strategy = '{v}'" for k, v in (("forward_fk", "select_related"), ("relations", "prefetch_related"), ("bulk", "bulk_fetch"))},
    "duplicate_write_guard": "SELECT scope_id, substr(sha256(raw || '|None'), 1, 16) AS key FROM dup EXCEPT ALL SELECT scope_id, substr(sha256(raw || '|None'), 1, 16) FROM dup_free",
    "pipeline_all": f"SELECT {_SHOWN}, apply_rank FROM findings",
    "pipeline_ordered": f"SELECT scope_id, row_number() OVER (PARTITION BY scope_id ORDER BY apply_rank, analyzer_ord, first_seq, pos, fingerprint)::INTEGER AS ord, issue_type, fingerprint, pos::INTEGER AS pos FROM findings",
    "pipeline_ignored": f"SELECT {_SHOWN}, apply_rank FROM findings WHERE {_KEPT}",
    "stream_pipeline": "SELECT " + _SHOWN.replace("round(time_saved_ms,", "round(time_saved_ms + 1e-6,") + " FROM findings",
    "scope_report": f"""SELECT scope_id, total_queries, round(total_time_ms, 3) AS total_time_ms, coalesce(issues, 0) AS issues, coalesce(n_plus_one_count, 0) AS n_plus_one_count, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning,
  coalesce(info, 0) AS info, coalesce(critical, 0) > 0 AS has_critical FROM (SELECT scope_id, count(*) AS total_queries, sum(ms) AS total_time_ms FROM cq GROUP BY scope_id)
  LEFT JOIN (SELECT scope_id, count(*) AS issues, count(*) FILTER (WHERE issue_type = 'n_plus_one') AS n_plus_one_count, {_COUNTS} FROM findings GROUP BY scope_id) USING (scope_id)""",
    "severity_histogram": "SELECT severity, issue_type, count(*) AS n FROM findings GROUP BY ALL",
    "ordering_note": f"SELECT scope_id, CASE WHEN bool_or(issue_type = 'n_plus_one') AND bool_or(issue_type = 'fat_select') THEN '{report.ORDERING_NOTE}' ELSE '' END AS note FROM findings GROUP BY scope_id",
    "group_file_analyzer": _groups(_KEY), "group_root_cause": _groups("fix_suggestion"), "group_view": _groups("coalesce(file_path, 'unknown')"),
    "baseline_regressions": f"SELECT scope_id, issue_hash, description FROM hashed ANTI JOIN {_BASELINE} b USING (issue_hash)",
    "baseline_known": f"SELECT scope_id, issue_hash, description FROM hashed SEMI JOIN {_BASELINE} b USING (issue_hash)",
    "baseline_resolved": "SELECT scope_id, issue_hash, description FROM hashed ANTI JOIN (SELECT issue_hash FROM hashed WHERE severity <> 'critical') b USING (issue_hash)",
    "baseline_read": f"SELECT scope_id, issue_hash, description FROM hashed ANTI JOIN {_BASELINE} b USING (issue_hash)",
    "baseline_document": "SELECT '1' AS version, (SELECT count(*) FROM findings)::INTEGER AS issue_count, issue_type, file_path, line_number AS line, count(*) AS n FROM findings GROUP BY issue_type, file_path, line_number",
    "json_report": """SELECT scope_id, '1' AS version, '2024-01-02T03:04:05Z' AS timestamp, total_queries, issues AS issues_found, critical, warning AS warnings, info, md5(coalesce(told, '')) AS told FROM per_scope LEFT JOIN (
  SELECT scope_id, string_agg(issue_type || '|' || severity || '|' || coalesce(file_path, 'null') || '|' || coalesce(line_number, 0), ';' ORDER BY ord) AS told FROM ordered GROUP BY 1) USING (scope_id)""",
    "review_comment": """SELECT scope_id, CASE WHEN issues = 0 THEN 3 ELSE 9 + least(issues, 200) + CASE WHEN issues > 200 THEN 1 ELSE 0 END + fixes END::INTEGER AS lines, CASE WHEN issues = 0 THEN '' ELSE issues::VARCHAR END AS found,
  CASE WHEN issues > 0 THEN md5('- **' || upper(o.severity) || '**: ' || o.description || CASE WHEN o.file_path IS NULL THEN '' ELSE ' (' || o.file_path || ':' || coalesce(o.line_number, 0) || ')' END) END AS first_line
  FROM per_scope LEFT JOIN (SELECT * FROM ordered WHERE ord = 1) o USING (scope_id) LEFT JOIN (SELECT scope_id, greatest(1, count(*) FILTER (WHERE coalesce(fix_suggestion, '') <> '')) AS fixes FROM ordered WHERE ord <= 200 GROUP BY 1) USING (scope_id)""",
    "ci_issues": "SELECT severity, issue_type, description AS message, fix_suggestion AS suggestion, coalesce(file_path, '') AS file, coalesce(line_number, 0) AS line, query_count FROM findings",
    "project_endpoints": f"""SELECT app_name, endpoint, methods, requests, queries, coalesce(issues, 0) AS issues, coalesce(critical, 0) AS critical, round(ms / requests, 3) AS mean_ms FROM (
  SELECT app_name, endpoint, array_to_string(list_sort(list(DISTINCT CASE WHEN is_select THEN 'GET' ELSE 'POST' END)), ',') AS methods, count(DISTINCT scope_id) AS requests, count(*) AS queries, sum(ms) AS ms FROM cq GROUP BY 1, 2)
  LEFT JOIN (SELECT app_name, endpoint, count(*) AS issues, {_COUNTS} FROM findings JOIN of USING (scope_id) GROUP BY 1, 2) USING (app_name, endpoint)""",
    "project_extremes": f"SELECT (SELECT app_name FROM a ORDER BY health, app_name LIMIT 1) AS worst, min(health) AS worst_health, (SELECT app_name FROM a ORDER BY health DESC, app_name LIMIT 1) AS best, max(health) AS best_health FROM ({_APPS}) a".replace("FROM a ORDER", f"FROM ({_APPS}) ORDER"),
    "project_document": f"""SELECT total_urls::BIGINT AS total_urls, round(overall, 1) AS overall, skipped::INTEGER AS skipped, place::INTEGER AS place, app_name AS name, health::DOUBLE AS health_score, queries AS total_queries, critical AS critical_count, pattern, y.issues AS issues, kinds::INTEGER AS kinds FROM (
  SELECT a.*, row_number() OVER (ORDER BY health, app_name) - 1 AS place, avg(health) OVER () AS overall, 0 AS skipped, sum(urls) OVER () AS total_urls FROM ({_APPS}) a) x
  JOIN (SELECT app_name, endpoint AS pattern, coalesce(n, 0) AS issues, coalesce(least(k, 100), 0) AS kinds FROM (SELECT DISTINCT app_name, endpoint FROM cq) LEFT JOIN (SELECT app_name, endpoint, count(*) AS n FROM findings JOIN of USING (scope_id) GROUP BY 1, 2) USING (app_name, endpoint)
    LEFT JOIN (SELECT app_name, endpoint, count(*) AS k FROM (SELECT DISTINCT app_name, endpoint, issue_type, severity, description, fix_suggestion, file_path, line_number FROM findings JOIN of USING (scope_id)) GROUP BY 1, 2) USING (app_name, endpoint)) y USING (app_name)""",
    "trace_spans": "SELECT scope_id, total_queries, issues, least(issues, 128)::INTEGER AS events, o.issue_type AS first_event, CASE WHEN critical > 0 THEN 'ERROR' ELSE 'OK' END AS status FROM per_scope LEFT JOIN (SELECT scope_id, issue_type FROM ordered WHERE ord = 1) o USING (scope_id)",
    "session_summary": "SELECT count(*) AS observed, count(*) FILTER (WHERE issues = 0) AS clean, count(*) FILTER (WHERE issues > 0) AS with_findings FROM per_scope",
    "admin_totals": "SELECT count(*) AS reports, sum(total_queries)::BIGINT AS queries, sum(issues)::BIGINT AS issues, count(*) FILTER (WHERE issues > 0) AS with_issues FROM (SELECT p.* FROM per_scope p JOIN (SELECT scope_id, max(captured) AS ended FROM cq GROUP BY 1) USING (scope_id) ORDER BY ended DESC, scope_id LIMIT 50)",
    "fixes_proposed": "SELECT file, line, before, after, writable, issue_type, description, ord FROM changes",
    "fixes_patch": """SELECT file, md5(string_agg('--- ' || file || chr(10) || '+++ ' || file || chr(10) || '@@ -' || line || ',1 +' || line || ',1 @@' || chr(10) || '  [' || description || ']' || CASE WHEN writable THEN '' ELSE ' [MANUAL FIX ONLY]' END || chr(10) || '- ' || rtrim(before) || chr(10)
  || '+ ' || replace(after, chr(10), chr(10) || '+ '), chr(10) ORDER BY ord)) AS patch FROM changes GROUP BY file""",
    "fixes_refused": "SELECT count(*) FILTER (WHERE NOT writable) AS refused, coalesce(string_agg(DISTINCT issue_type, ',' ORDER BY issue_type) FILTER (WHERE NOT writable), '') AS kinds FROM changes",
    "endpoint_scan": "SELECT scope_id, seq FROM cq WHERE endpoint = '/r/3/'",
    "read_log": "SELECT scope_id, seq, endpoint, CASE WHEN is_select AND raw <> 'BEGIN' THEN 'GET' ELSE 'POST' END AS http_method, raw AS sql, ms AS duration_ms, file_path AS filepath, line AS line_number FROM cq",
    "stack_callsites": """SELECT event_id, CASE event_id % 3 WHEN 2 THEN '/srv/mydjango/db.py' WHEN 1 THEN CASE WHEN user_id % 4 <> 3 THEN '/srv/app' || (user_id % 4) || '/views.py' END END AS filepath,
  CASE event_id % 3 WHEN 2 THEN k + 1 WHEN 1 THEN CASE WHEN user_id % 4 <> 3 THEN k END END AS line_number, CASE event_id % 3 WHEN 2 THEN 'go()' WHEN 1 THEN CASE WHEN user_id % 4 <> 3 THEN 'rows = list(qs)' END END AS code_context
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "serializer_methods": """SELECT '/src/app' || (user_id % 4) || '/serializers_' || event_id || '.py' AS path, 'Shown' AS serializer, 'total' AS field, ['related_manager_access', 'queryset_in_method', 'loop_queryset', 'comprehension_queryset', 'deep_attribute_chain'][event_id % 7 + 1] AS pattern,
  CASE WHEN event_id % 7 = 4 THEN 'info' ELSE 'warning' END AS severity, 6 AS line FROM events WHERE event_id % 7 < 5""",
    "structural_fingerprint": """SELECT event_id, substr(sha256('vendor:sqlite|using:default|model:shop.' || event_type || '|compiler:' || CASE WHEN event_type = 'purchase' THEN 'SQLInsertCompiler' ELSE 'SQLCompiler' END || CASE WHEN k % 2 = 0 THEN '|distinct:true' ELSE '' END
  || '|select:shop.Order.id,shop.Order.title|where[0]:connector=AND,negated=false|where[0]:lookup=exact,lhs=shop.Order.id|where[0]:lookup=in,lhs=shop.Order.status|where[0]:in_count=' || (k % 3 + 1) || '|where[0]:lookup=isnull,lhs=shop.Order.note|joins:shop_customer:INNER JOIN,shop_order:None|order_by:-id'
  || CASE WHEN k % 5 = 0 THEN '|group_by:true' ELSE '' END || '|annotations:n:Count(lines)' || CASE WHEN k > 50 THEN '|limit:true' ELSE '' END), 1, 32) AS fingerprint,
  '7,' || event_id || ',' || array_to_string(range(1, k % 3 + 2), ',') AS params, event_type <> 'purchase' AND k % 7 <> 0 AND k % 11 <> 0 AS cacheable FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "catalog_indexed": "SELECT 'Case' AS model, field, field NOT IN ('plain', 'tags') AS indexed FROM (VALUES ('id'), ('code'), ('day'), ('owner'), ('plain'), ('second'), ('ref'), ('pair'), ('lone'), ('tags'), ('unknown')) x(field)",
    "stream_sessions": """SELECT scope_id, strftime(min(captured), '%Y-%m-%d %H:%M:%S') AS started_at, count(*) AS queries, round(sum(ms), 3) AS time_ms FROM (
  SELECT *, sum(CASE WHEN before IS NULL OR captured >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY scope_id ORDER BY captured, seq) AS session FROM (SELECT *, lag(captured) OVER (PARTITION BY scope_id ORDER BY captured, seq) AS before FROM cq)) GROUP BY scope_id, session""",
    "stream_split_scopes": "SELECT " + _SHOWN.replace("round(time_saved_ms,", "round(time_saved_ms + 1e-6,") + " FROM findings",
    "turbo_resets": """SELECT process_id, seq, era, CASE WHEN n = 1 OR (bad IS NOT NULL AND (era > bad.e OR (era = bad.e AND n > bad.n))) THEN 'miss' WHEN bad IS NOT NULL AND era = bad.e AND n = bad.n THEN 'poison' WHEN n <= 4 THEN 'validate' ELSE 'trusted' END AS state FROM (
  SELECT *, min(CASE WHEN n BETWEEN 2 AND 4 AND raw <> first_raw THEN struct_pack(e := era, n := n) END) OVER (PARTITION BY process_id, fp) AS bad FROM (
    SELECT *, row_number() OVER w AS n, first(raw) OVER w AS first_raw FROM (SELECT a.*, (SELECT count(DISTINCT seq) FROM cq c WHERE c.seq % 997 = 0 AND c.scope_id % 4 = a.process_id AND c.seq <= a.seq) AS era FROM accesses a) WINDOW w AS (PARTITION BY process_id, fp, era ORDER BY seq)))""",
    "turbo_chart": "SELECT process_id, fingerprint, hit_count, CASE WHEN length(preview) > 60 THEN substr(preview, 1, 60) || '...' ELSE preview END AS label FROM top20 ORDER BY hit_count DESC, process_id, fingerprint LIMIT 10",
    "turbo_prepared": "SELECT count(*) FILTER (WHERE hit_count >= 5) AS prepared_count, count(*) FILTER (WHERE hit_count < 5) AS unprepared_count FROM top20",
    "turbo_replay": "SELECT process_id, seq, state, sum(CASE WHEN n = 1 THEN 1 WHEN state = 'poison' THEN -1 ELSE 0 END) OVER (PARTITION BY process_id ORDER BY seq)::INTEGER AS held FROM lived",
    "filter_file": f"SELECT {_SHOWN} FROM findings WHERE contains(file_path, 'app1/')",
    "filter_module": f"SELECT {_SHOWN} FROM findings WHERE contains(replace(regexp_replace(file_path, '\\.py$', ''), '/', '.'), 'app2.views')",
    "filter_diff": f"SELECT {_SHOWN} FROM findings WHERE ends_with('src/app3/views.py', file_path) OR ends_with(file_path, 'src/app3/views.py')",
    "filter_diff_empty": f"SELECT {_SHOWN} FROM findings WHERE false",
    "fail_on": "SELECT scope_id, max(CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) >= 2 AS failed FROM findings GROUP BY scope_id",
    "budget_violations": f"SELECT scope_id, queries, round(time_ms, 3) AS time_ms, CASE WHEN queries > {BUDGET[0]} THEN 'queries' ELSE 'time' END AS violation FROM (SELECT scope_id, count(*) AS queries, sum(ms) AS time_ms FROM cq GROUP BY scope_id) WHERE queries > {BUDGET[0]} OR time_ms > {BUDGET[1]}",
    "project_apps": _APPS,
    "project_overall": f"SELECT sum(urls)::BIGINT AS urls, sum(queries)::BIGINT AS queries, sum(issues)::BIGINT AS issues, coalesce(avg(health), 100.0) AS health, CASE WHEN coalesce(avg(health), 100.0) >= 80 THEN 'green' WHEN coalesce(avg(health), 100.0) >= 60 THEN 'amber' ELSE 'red' END AS color FROM ({_APPS})",
    "ci_annotations": "SELECT scope_id, '::' || CASE severity WHEN 'critical' THEN 'error' ELSE 'warning' END || ' file=' || coalesce(file_path, '') || ',line=' || coalesce(line_number, 0) || '::' || description AS annotation FROM findings",
    "admin_last50": """SELECT scope_id, recorded_at, total_queries, coalesce(issues, 0) AS issues, row_number() OVER (ORDER BY recorded_at DESC, scope_id)::INTEGER AS place
  FROM (SELECT scope_id, max(captured) AS recorded_at, count(*) AS total_queries FROM cq GROUP BY scope_id ORDER BY recorded_at DESC, scope_id LIMIT 50) LEFT JOIN (SELECT scope_id, count(*) AS issues FROM findings GROUP BY scope_id) USING (scope_id)""",
    "workload_shape": "SELECT count(*) FILTER (WHERE is_select) AS selects, count(*) FILTER (WHERE NOT is_select) AS writes, count(DISTINCT fp) AS fingerprints, count(DISTINCT file_path || ':' || line) AS callsites FROM cq",
    "turbo_lifecycle": "SELECT process_id, seq, n::INTEGER AS n, state FROM lived",
    "turbo_stats": """SELECT process_id, hits, misses, round(hits / greatest(1, hits + misses), 6) AS hit_rate, evictions, trusted_hits, size, trusted_entries, poisoned_entries FROM (SELECT process_id, count(*) FILTER (WHERE state <> 'miss') AS hits, count(*) FILTER (WHERE state = 'miss') AS misses,
  count(*) FILTER (WHERE state = 'poison') AS evictions, count(*) FILTER (WHERE state = 'trusted') AS trusted_hits FROM lived GROUP BY process_id)
  JOIN (SELECT process_id, count(*) FILTER (WHERE NOT poisoned) AS size, count(*) FILTER (WHERE NOT poisoned AND hit_count >= 3) AS trusted_entries, count(*) FILTER (WHERE poisoned) AS poisoned_entries FROM lived_entries GROUP BY 1) USING (process_id)""",
    "turbo_top20": "SELECT process_id, fingerprint, hit_count, preview, trusted FROM top20",
    "gate_sampled": "SELECT scope_id, seq FROM cq WHERE ('0x' || substr(md5(scope_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.5 AND NOT starts_with(endpoint, '/r/1')",
    "project_urls": """SELECT endpoint, app_name, array_to_string(m, ',') AS methods, CASE WHEN NOT list_contains(m, 'POST') THEN 'method' END AS skip_reason FROM (
  SELECT endpoint, min(app_name) AS app_name, list_sort(list(DISTINCT CASE WHEN is_select THEN 'GET' ELSE 'POST' END)) AS m FROM cq GROUP BY endpoint) WHERE NOT starts_with(endpoint, '/r/5')""",
    "duration_percentiles": "SELECT is_select, quantile_disc(ms, 0.1) AS p10, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.9) AS p90 FROM cq GROUP BY is_select",
    "slow_queries": "SELECT scope_id, seq, ms AS duration_ms FROM cq WHERE ms > 100",
}
ORACLES: dict[str, str] = {k: _with(v) for k, v in BODIES.items()} | workload.SQL
