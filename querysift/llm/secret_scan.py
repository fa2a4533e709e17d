"""Secret scans with DataFrame functions only: base patterns, and a battery of randomness tests.

Base patterns find assignments, access ids and hexadecimal keys. Beside them, every long run of key characters
is a candidate. Its encoding is inferred, and three statistics are taken in that encoding: chi-squared against an even
alphabet, the runs of small letters, capitals, digits and marks, and the serial correlation of neighbours' places. Each
is held against ordinary text, in which letters are uneven, classes change seldom and neighbours are alike: the three
z-values join, weighted, to one p-value, how likely ordinary text of that length looks so random. Over a document's
candidates the p-values, weighted by length (long runs have more power), pass a step-up procedure that controls the
false discovery rate. What passes must also be in line with an even random source by the same three statistics.

Positions are code points, ends exclusive. Null text counts as empty. Rows are scanned one by one: repeated rows
alike, null ids are kept, other columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

#: The base patterns. Those of `access` and `hex` say the least length themselves, which finds the
#: same runs; an assignment too short still uses up its text, so its length is asked afterwards.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: Runs of key characters that the battery looks at.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Pattern, alphabet and shares of small letters, capitals, digits and marks, of each encoding; the first that fits.
#: Dashes are left out before the tests where the alphabet has none.
ENCODINGS = (
    (r"^[0-9]+$", "0123456789", (0, 0, 1, 0)),
    (r"^[0-9a-f]+$", "0123456789abcdef", (6 / 16, 0, 10 / 16, 0)),
    (r"^[0-9A-F]+$", "0123456789ABCDEF", (0, 6 / 16, 10 / 16, 0)),
    (r"^[0-9a-f]+(-[0-9a-f]+)+$", "0123456789abcdef", (6 / 16, 0, 10 / 16, 0)),
    (r"^[0-9A-F]+(-[0-9A-F]+)+$", "0123456789ABCDEF", (0, 6 / 16, 10 / 16, 0)),
    (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (0, 26 / 32, 6 / 32, 0)),
    (r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", (26 / 36, 0, 10 / 36, 0)),
    (r"^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", (0, 26 / 36, 10 / 36, 0)),
    (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", (26 / 62, 26 / 62, 10 / 62, 0)),
    (r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (26 / 64, 26 / 64, 10 / 64, 2 / 64)),
    (r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", (26 / 64, 26 / 64, 10 / 64, 2 / 64)),
)
#: Largest deviation from a random source, in standard deviations (chi-squared: half as much again), that counts as
#: random; the false discovery rate.
DEVIATION, DISCOVERY_RATE = 3.3, 0.001
#: Ordinary text: how often two letters of it are the same, least excess of chi-squared per character, changes of class
#: per character, correlation of neighbours; the weights of the three tests' z-values.
PROSE_SAME, PROSE_EXCESS, PROSE_CHANGES, PROSE_CORRELATION = 0.07, 0.3, 0.1, 0.5
WEIGHTS = (1.0, 2.0, 0.5)
_SPANS = "array<struct<start: int, kind: int, end: int>>"


def _found(text: Column, pattern: str, keep=None) -> Column:
    """start, end and match of the leftmost matches of a pattern that do not overlap."""
    none = F.array().cast("array<struct<start: int, end: int, match: string>>")

    def placed(m: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["before"])
            end = start + F.length(x["match"])
            own = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))
            return F.struct(end.alias("at"), F.concat(acc["out"], own).alias("out"))

        pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(m)).alias("before"), m.alias("match"))
        out = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
        return F.when(F.size(m) == 0, none).otherwise(F.filter(out, keep) if keep else out)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _upper_tail(z: Column) -> Column:
    """The normal distribution's upper tail, by its logistic approximation (within 2e-4)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def _class_of(c: Column) -> Column:
    return F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)


def _encoding(key: Column) -> Column:
    """The alphabet and class shares of the first encoding that fits; null if none does."""
    out = None
    for pattern, alphabet, shares in ENCODINGS:
        own = F.struct(F.lit(alphabet).alias("alphabet"), F.array(*[F.lit(float(x)) for x in shares]).alias("shares"))
        out = F.when(key.rlike(pattern), own) if out is None else out.when(key.rlike(pattern), own)
    return out


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _battery(key: Column) -> Column:
    """p, how likely ordinary text looks as random as `key`, and fits, whether a random source may have made it."""

    def of_encoding(e: Column) -> Column:
        kept = F.regexp_replace(key, F.when(F.contains(e["alphabet"], F.lit("-")), F.lit("=+$")).otherwise(F.lit("=+$|-")), F.lit(""))
        return let(F.filter(F.split(kept, ""), lambda c: c != ""), lambda chars: let(F.transform(chars, _class_of), lambda kinds: tests(e, chars, kinds)))

    def tests(e: Column, chars: Column, kinds: Column) -> Column:
        n, size = F.size(chars).cast("double"), F.length(e["alphabet"]).cast("double")
        even = _sum(F.transform(F.array_distinct(chars), lambda c: F.pow(F.size(F.filter(chars, lambda x: x == c)).cast("double"), F.lit(2.0)))) * size / n - n
        changes = F.size(F.filter(F.transform(kinds, lambda k, i: (i > 0) & (F.get(kinds, i - 1) != k)), lambda x: x)).cast("double")
        middle, spread = (size - 1) / 2, (size * size - 1) / 12
        places = F.transform(chars, lambda c: F.instr(e["alphabet"], c) - 1 - middle)
        serial = let(places, lambda v: _sum(F.transform(v, lambda x, i: F.when(i > 0, x * F.get(v, i - 1)).otherwise(F.lit(0.0))))) / spread / (n - 1)
        counts = F.transform(e["shares"], lambda p, k: F.size(F.filter(kinds, lambda x: x == k)).cast("double"))
        by_class = _sum(F.zip_with(counts, e["shares"], lambda c, p: F.when(p > 0, (c - n * p) * (c - n * p) / (n * p)).otherwise(F.lit(0.0))))
        freedom = F.greatest(F.size(F.filter(e["shares"], lambda p: p > 0)) - 1, F.lit(1)).cast("double")
        found = F.struct(
            n.alias("n"), size.alias("size"), even.alias("even"), changes.alias("changes"), serial.alias("serial"), by_class.alias("by_class"), freedom.alias("freedom"),
            (1 - _sum(F.transform(e["shares"], lambda p: p * p))).alias("q"),
        )
        return let(found, judged)

    def judged(x: Column) -> Column:
        n, steps = x["n"], x["n"] - 1
        # In ordinary text chi-squared is noncentral, by what uneven letters add for each character.
        more = F.greatest(x["size"] * PROSE_SAME - 1, F.lit(PROSE_EXCESS)) * n
        as_text = (
            (x["even"] - (x["size"] - 1) - more) / F.sqrt(2 * (x["size"] - 1) + 4 * more),
            (steps * PROSE_CHANGES + 0.5 - x["changes"]) / F.sqrt(steps * (PROSE_CHANGES * (1 - PROSE_CHANGES))),
            (x["serial"] - PROSE_CORRELATION) * F.sqrt(steps),
        )
        joint = sum((z * w for z, w in zip(as_text, WEIGHTS, strict=True)), F.lit(0.0)) / sum(w * w for w in WEIGHTS) ** 0.5
        # The cube root of a chi-squared value is nearly normal.
        class_z = (F.cbrt(x["by_class"] / x["freedom"]) - (1 - 2 / (9 * x["freedom"]))) / F.sqrt(2 / (9 * x["freedom"]))
        runs_z = F.when(x["q"] > 0, (x["changes"] - steps * x["q"]) / F.sqrt(steps * x["q"] * (1 - x["q"]))).otherwise(F.lit(0.0))
        even_z = (x["even"] - (x["size"] - 1)) / F.sqrt(2 * (x["size"] - 1))
        fits = (class_z < DEVIATION) & (F.abs(runs_z) < DEVIATION) & (F.abs(even_z) < 1.5 * DEVIATION) & (F.abs(x["serial"] * F.sqrt(steps)) < DEVIATION)
        return F.struct(_upper_tail(-joint).alias("p"), fits.alias("fits"))

    return let(_encoding(key), lambda e: F.when(e.isNotNull(), of_encoding(e)).otherwise(F.struct(F.lit(1.0).alias("p"), F.lit(False).alias("fits"))))


def _random(text: Column, base: Column) -> Column:
    """start and end of the candidates that pass the control and the battery, and overlap no base span."""

    def controlled(m: Column) -> Column:
        mean = _sum(F.transform(m, lambda x: F.length(x["match"]).cast("double"))) / F.size(m)

        def weighted(x: Column) -> Column:
            return let(_battery(x["match"]), lambda t: F.struct((t["p"] * mean / F.length(x["match"])).alias("p"), t["fits"].alias("fits"), x["start"].alias("start"), x["end"].alias("end")))

        def step_up(w: Column) -> Column:
            passing = F.filter(F.transform(F.sort_array(F.transform(w, lambda x: x["p"])), lambda p, i: F.when(p <= (i + 1) * DISCOVERY_RATE / F.size(w), p)), lambda p: p.isNotNull())
            return let(F.coalesce(F.array_max(passing), F.lit(-1.0)), lambda most: F.filter(w, lambda x: (x["p"] <= most) & x["fits"] & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))

        return let(F.transform(m, weighted), step_up)

    return let(_found(text, CANDIDATE), lambda m: F.when(F.size(m) == 0, F.array().cast(_SPANS)).otherwise(_as_spans(controlled(m), 3)))


def _as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, text_col: str = "text", base_col: str = "__base", spans_col: str = "__spans") -> DataFrame:
    """Adds the base spans and all spans, sorted arrays of start, kind (a place in KINDS) and end."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    long_enough = lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= ASSIGN_LENGTH
    found = [_found(text, ASSIGN, long_enough), _found(text, ACCESS), _found(text, HEX)]
    base = F.sort_array(F.concat(*[_as_spans(x, k) for k, x in enumerate(found)]))
    based = docs.withColumn(base_col, base)
    return based.withColumn(spans_col, F.sort_array(F.concat(F.col(base_col), _random(text, F.col(base_col)))))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The same columns, each secret in the text replaced by `mark`; null text stays null, overlapping spans give one."""
    base, spans = fresh(docs, "base", "spans")
    text = F.col(text_col)
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        own = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], own)).otherwise(F.concat(
            F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(F.element_at(acc["out"], -1)["start"].alias("start"), F.greatest(acc["at"], s["end"]).alias("end"))))).alias("out"))

    def cut(parts: Column) -> Column:
        before = F.transform(parts, lambda s, i: let(F.when(i > 0, F.get(parts, i - 1)["end"]).otherwise(F.lit(0)), lambda at: F.substring(text, at + 1, s["start"] - at)))
        return F.concat(F.array_join(before, mark), F.lit(mark), F.substring(text, F.element_at(parts, -1)["end"] + 1, F.length(text)))

    cleaned = let(F.aggregate(spans, first, step, lambda acc: acc["out"]), cut)
    return scan(docs, text_col, base, spans).withColumn(text_col, F.when(F.size(spans) > 0, cleaned).otherwise(text)).drop(base, spans)
