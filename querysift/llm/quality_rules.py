"""Quality rules on divergence from language references, with DataFrame functions only.

A document's histograms of character classes and of common words are compared with those of its language by
Jensen-Shannon distance (the root of the divergence to base 2, from 0 to 1). The references are sums over all
documents that pass the base rules, by language. Which language a document is in is not asked: the nearest
reference counts, be it of another language. Either comparison needs a minimum length; shorter texts pass it.
Documents labelled with a language that has no reference, for want of words in this input, pass both; unlabelled
ones are judged by the nearest.

Common words are measured against a text without any: its distance from a reference counts as 1, and the limit is a
share of that, wider for short texts, whose histograms scatter, but always below 1. COMMON has words of four
languages. A reference in which they are rare tells nothing of function words: it takes no part, and documents
labelled with its language pass this comparison, as do unlabelled ones of an input that has such a reference.

Base rules: at least 50 words, and at most half of them in repeated 3-word windows.

Null text has no words and fails the base rules. Rows are judged one by one: repeated rows alike, null ids are
kept, columns other than the documented new ones (`__rules`, `__base_failed`, both distances, `__kept`) are not touched; an empty table gives no rows. Without any reference the base rules decide.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]+"
#: Small letters and digits go together, since numbers and keys say nothing about the prose around them. What is
#: left of a text without them is short, and is searched for the other classes beside symbols; the rest is one more.
PLAIN = r"[\p{Ll}\p{Nd}]+"
CLASSES = (r"\p{Lu}+", r"[\p{L}&&[^\p{Ll}\p{Lu}]]+", r"[.,;:!?'\"()\-@/=_+]+")
#: Frequent function words of English, German, French and Spanish.
COMMON = tuple(
    dict.fromkeys(
        "the of and to in a is that for it as was with be by on not he are this at from or have an they which you had we but were "
        "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei um am sind "
        "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son "
        "el y los del las por para con no su al lo como más pero sus le ya o una es".split()
    )
)


#: Histograms of character classes and of common words, by language.
References = dict[str, tuple[list[float], list[float]]]


@dataclass(frozen=True)
class Limits:
    """Parameters of the rules: lengths from which a comparison counts, and largest distances."""

    min_words: int = 50
    repeat_percent: int = 50
    min_chars_classes: int = 200
    min_words_common: int = 80
    classes: float = 0.14
    #: Shares of the distance of a text without common words: for long texts, at most, and what is added (in squares)
    #: for the scatter of one word. References nearer than `least_common` to such a text tell nothing.
    common: float = 0.6
    most_common: float = 0.9
    scatter: float = 7.0
    least_common: float = 0.25
    min_reference_words: int = 5000


def _repeated(w: Column) -> Column:
    """How many of the words stand in 3-word windows that occur twice or more."""

    def marked(s: Column) -> Column:
        again = F.filter(s, lambda p, k: F.coalesce((k > 0) & (F.get(s, k - 1)["h"] == p["h"]), F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == p["h"], F.lit(False)))
        return let(F.sort_array(F.transform(again, lambda p: p["i"])), covered)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def windows(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, marked))

    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashed, windows))


def _taken(text: Column, pattern: str) -> Column:
    """Code points of `text` in matches of a pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds a struct `__rules` with the base statistics and both histograms."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"), F.array_join(w, "").alias("joined"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    spoken = F.filter(F.split(F.lower(text), r"[^\p{L}]+", -1), lambda x: x != "")
    w, dup, s, left, classes, counts = fresh(docs, "__w", "__dup", "__s", "__left", "__classes", "__counts")
    first = docs.withColumns({
        w: let(words, counted),
        dup: let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        s: let(spoken, lambda x: F.struct(F.size(x).alias("n"), F.concat(F.lit(" "), F.array_join(F.filter(x, lambda y: y.isin(*COMMON)), "  "), F.lit(" ")).alias("common"))),
    })
    joined, common = F.col(w)["joined"], F.col(s)["common"]
    first = first.withColumn(left, F.regexp_replace(joined, PLAIN, ""))
    second = first.withColumns({
        classes: F.array(_taken(F.col(left), SYMBOLS), F.length(joined) - F.length(left), *[_taken(F.col(left), x) for x in CLASSES]).cast("array<long>"),
        counts: F.array(*[((F.length(common) - F.length(F.replace(common, F.lit(f" {x} "), F.lit("")))) / (len(x) + 2)).cast("long") for x in COMMON]),
    })
    rest = lambda whole, parts: F.concat(parts, F.array(whole.cast("long") - F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)))
    made = F.struct(
        F.col(w)["n_words"].alias("n_words"), F.length(joined).cast("long").alias("word_chars"), F.get(classes, F.lit(0)).alias("n_symbols"), F.col(dup).alias("n_dup_lines"),
        F.col(w)["n_repeat_words"].alias("n_repeat_words"), rest(F.length(joined), F.col(classes)).alias("classes"), rest(F.col(s)["n"], F.col(counts)).alias("common"),
        # Not deterministic, so the optimizer does not copy all this into each filter above.
        F.monotonically_increasing_id().alias("row"),
    )
    return second.withColumn("__rules", made).drop(w, dup, s, left, classes, counts)


def base_failed(limits: Limits = Limits()) -> Column:
    n = F.col("__rules.n_words")
    return (n < limits.min_words) | (100 * F.col("__rules.n_repeat_words") > limits.repeat_percent * n)


def references(featured: DataFrame, limits: Limits = Limits(), lang_col: str = "lang") -> References:
    """Both histograms, as shares, of each language with enough words.

    Summed twice: the second time over the documents that the first sums let pass, so that junk shifts nothing. A
    language that has too few words left then keeps its first sums."""
    first = _pooled(featured.where(~base_failed(limits)), limits, lang_col)
    return first | _pooled(verdicts(featured, first, limits, lang_col).where("__kept"), limits, lang_col)


def _pooled(usable: DataFrame, limits: Limits, lang_col: str) -> References:
    kinds = {"classes": len(CLASSES) + 3, "common": len(COMMON) + 1}
    sums = [F.sum(F.col(f"__rules.{k}")[i]).alias(f"{k}{i}") for k, n in kinds.items() for i in range(n)]
    total = usable.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.sum("__rules.n_words").alias("n"), *sums)
    total = total.where(F.col("n") >= limits.min_reference_words)
    shares = lambda r, k: [r[f"{k}{i}"] / max(1, sum(r[f"{k}{j}"] for j in range(kinds[k]))) for i in range(kinds[k])]
    return {r["lang"]: (shares(r, "classes"), shares(r, "common")) for r in total.orderBy("lang").collect()}


def distance(counts: Column, reference: list[float] | Column) -> Column:
    """The Jensen-Shannon distance of a histogram from a reference."""

    def part(share: Column, own: Column) -> Column:
        middle = (share + own) / 2
        gain = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(F.lit(0.0))
        return (gain(share) + gain(own)) / 2

    def sum_of(whole: Column) -> Column:
        own = F.array(*map(F.lit, reference)) if isinstance(reference, list) else reference
        parts = F.zip_with(counts, own, lambda n, q: part(n / whole, q))
        return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))

    whole = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    return F.when(whole > 0, let(whole, sum_of)).otherwise(F.lit(1.0))


def without_common(reference: list[float]) -> float:
    """The distance of a text without common words from a reference of common words."""
    rest = reference[-1]
    gain = rest * math.log2(2 * rest / (1 + rest)) if rest else 0.0
    return math.sqrt(max((1 - rest + math.log2(2 / (1 + rest)) + gain) / 2, 0.0))


def verdicts(featured: DataFrame, found: References, limits: Limits = Limits(), lang_col: str = "lang") -> DataFrame:
    """Adds `__base_failed`, the distances from the nearest reference, and `__kept`.

    `__common_distance` is a share of the distance of a text without common words."""
    wordless = {lang: without_common(common) for lang, (_, common) in found.items()}
    telling = [lang for lang, x in wordless.items() if x >= limits.least_common]
    # One literal however many languages there are.
    listed = lambda rows: F.from_json(F.lit(json.dumps(rows)), "array<struct<own: array<double>, whole: double>>")
    nearest = lambda kind, rows: F.array_min(F.transform(listed(rows), lambda r: distance(F.col(f"__rules.{kind}"), r["own"]) / r["whole"])) if rows else F.lit(0.0)
    classes = nearest("classes", [{"own": x, "whole": 1.0} for x, _ in found.values()])
    common = nearest("common", [{"own": found[lang][1], "whole": wordless[lang]} for lang in telling])
    out = featured.withColumns({"__base_failed": base_failed(limits), "__classes_distance": classes, "__common_distance": common})
    strange = (F.col("__rules.word_chars") >= limits.min_chars_classes) & (F.col("__classes_distance") > limits.classes)
    known = F.coalesce(~F.col(lang_col).isin([x for x in found if x not in telling]), F.lit(len(telling) == len(found)))
    n = F.aggregate("__rules.common", F.lit(0).cast("long"), lambda a, x: a + x)
    most = F.least(F.lit(limits.most_common), F.sqrt(limits.common**2 + limits.scatter**2 / n))
    missing = F.coalesce(~F.col(lang_col).isin([*found]), F.lit(False))
    strange = strange | (known & (n >= limits.min_words_common) & (F.col("__common_distance") > most))
    return out.withColumn("__kept", ~F.col("__base_failed") & (missing | ~strange))
