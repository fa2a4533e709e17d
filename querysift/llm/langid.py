"""Language identification with language-bitmask n-gram filters.

The filter is a Bloom filter cut into bit slices, one a language: a slot holds a bitmask, and the masks in an
n-gram's slots, ANDed, hold all languages that contain it. A text's languages are decided by the number of its
n-grams with each language's bit, less those that the share of set bits in that language's slice lets expect
by chance.

The filter is learned from at most SAMPLE documents a language (chosen by hash) and holds the GRAMS most
frequent n-grams of each, so its size is bounded. Null text and text without a letter give `und` and 0. A text
none of whose n-grams is known goes to the language with the most learned documents, with 0. Repeated rows are
predicted alike, null ids are kept, an empty table gives no rows; without labelled rows all text is `und`.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents a language to learn from (expected number), n-grams kept of each, their length, and hash functions.
SAMPLE, GRAMS, LENGTH, HASHES = 4000, 20_000, 4, 3
#: An n-gram belongs to a language where it is at least this share as frequent as in its main language.
SHARE = 0.2
_U, _MARK = np.uint64, 1 << 24


@functools.cache
def _folded() -> np.ndarray:
    """For each code point its lower case if it is a letter, itself with a bit above if it is a mark that joins letters
    (as vowel signs do), else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(x.lower()) if len(x.lower()) == 1 else c
        elif unicodedata.category(x)[0] == "M":
            out[c] = c | _MARK
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def grams(text: str | None, length: int = LENGTH) -> np.ndarray | None:
    """Hashes of all n-grams of a text's words in lower case, with a mark at either end; None without a letter.

    Words shorter than an n-gram less its marks give themselves."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    folded = _folded()[points]
    if not ((folded > 0) & (folded < _MARK)).any():
        return None
    x = np.concatenate([[0], folded, [0]]).astype(_U)
    x = x[(x != 0) | np.concatenate([[True], x[:-1] != 0])]
    out = []
    for n in range(3, length + 1):
        if len(x) < n:
            break
        windows = [x[i : len(x) - n + 1 + i] for i in range(n)]
        whole = np.logical_and.reduce([w != 0 for w in windows[1:-1]])
        if n < length:  # only whole words
            whole &= (windows[0] == 0) & (windows[-1] == 0)
        made = np.full(len(windows[0]), n, _U)
        for w in windows:
            made = _mixed(made * _U(0x9E3779B97F4A7C15) + w)
        out.append(made[whole])
    return np.concatenate(out)


class Filter:
    """Which languages contain an n-gram."""

    def __init__(self, by_language: dict[str, np.ndarray], weights: dict[str, int]):
        self.languages = sorted(by_language, key=lambda x: (-weights[x], x))
        keys = sum(len(x) for x in by_language.values())
        self.slots = 1 << max(10, int(np.ceil(np.log2(max(1, 8 * keys)))))
        self.masks = np.zeros((-(-len(self.languages) // 64), self.slots), _U)
        for i, language in enumerate(self.languages):
            for at in self._places(by_language[language]):
                self.masks[i // 64, at] |= _U(1) << _U(i % 64)
        bits = [((self.masks[i // 64] >> _U(i % 64)) & _U(1)).mean() for i in range(len(self.languages))]
        self.by_chance = np.array(bits) ** HASHES

    def _places(self, found: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(HASHES):
            yield (_mixed(found + _U((k + 1) * 0xD1342543DE82EF95 % 2**64)) & _U(self.slots - 1)).astype(np.int64)

    def counts(self, found: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains, less those expected by chance."""
        places = list(self._places(found))
        out = np.empty(len(self.languages))
        for word, masks in enumerate(self.masks):
            common = np.bitwise_and.reduce([masks[p] for p in places])
            for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                out[i] = np.count_nonzero(common & (_U(1) << _U(i % 64)))
        return np.maximum((out - len(found) * self.by_chance) / (1 - np.minimum(self.by_chance, 0.99)), 0)

    def decide(self, text: str | None) -> tuple[str, float]:
        found = grams(text)
        if found is None or not self.languages:
            return "und", 0.0
        counts = self.counts(found)
        best = int(np.argmax(counts))
        return self.languages[best], float(counts[best] / counts.sum()) if counts.sum() else 0.0


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Filter:
    """The filter of the languages in `labelled`; rows without language or text teach nothing."""
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    weights = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    # Up to SAMPLE documents by hash, so that the choice neither depends on their order nor takes some twice.
    part = (F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    share = F.create_map(*[F.lit(x) for lang, n in weights.items() for x in (lang, min(1.0, SAMPLE / n))]) if weights else F.create_map(F.lit(""), F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_language: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (found := grams(text)) is not None:
                    by_language.setdefault(lang, []).append(found)
            for lang, found in by_language.items():
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = rows.where(part < share[F.col("lang")]).select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rate = counted.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    own = rate.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= SHARE * F.col("most"))
    kept = own.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= GRAMS)
    found: dict[str, list[int]] = {lang: [] for lang in weights}
    for r in kept.select("lang", "gram").toLocalIterator():
        found[r.lang].append(r.gram)
    return Filter({k: np.array(v, np.int64).view(_U) for k, v in found.items()}, weights)


def predict(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of each document, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.decide(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that teach nothing: crc32 of the id's text leaves 2 when divided by 4. A null id is none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
