"""A quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model of the text alone gives each document its evidence. Grouped aggregation adds the documents'
probabilities up by host and by path within a host; hosts shrink toward the corpus, paths toward their host, by
prior strengths estimated from how much the group means differ. A document's probability joins its own evidence
with the posterior of its path, from which it is itself left out.

The model is fitted on at most SAMPLE labelled documents (expected number, chosen by hash); the aggregation covers
all documents. Null text counts as empty, null hosts and paths are groups of their own. Labels that are null
teach nothing, nor do labels of ids without a document; a label repeated for an id counts once, with the smallest of
the id's features where it has several texts, and an id with both labels counts once for each. With labels of one
class only, or none, all evidence is neutral and every document has the share of good labels, kept within 0.01 and
0.99 (or one half). Repeated rows are judged alike, null ids are kept, other columns are not touched; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, settled

#: Labelled documents to fit on, and limits of the prior strengths (in documents).
SAMPLE, LEAST_STRENGTH, MOST_STRENGTH = 20_000, 2.0, 10_000.0
#: Kept from this probability on.
KEEP_FROM = 0.5
NAMES = ("lower", "upper", "digit", "symbol", "mark", "space", "beyond", "log_words", "word_length", "distinct", "repeats", "loose", "repeated_lines")


def _kinds() -> np.ndarray:
    out = np.full(128, 4, np.uint8)
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), ("#*$%&|<>", 3), (" \t\n\r\x0b\x0c", 5)):
        out[[ord(c) for c in chars]] = kind
    return out


_KINDS = _kinds()


def described(text: str | None) -> list[float]:
    """A text's features, in the order of NAMES; all are shares but for the words' number and length."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KINDS[raw[raw < 128]], minlength=6)
    beyond = np.count_nonzero((raw & 0xC0) == 0xC0)
    total = max(1, int(kinds.sum()) + beyond)
    words = (text or "").split()
    n = max(1, len(words))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        *(kinds / total), beyond / total, float(np.log1p(len(words))), sum(map(len, words)) / n, len(set(words)) / n, same / n,
        sum(not any(c.isalnum() for c in x) for x in words if len(x) < 3) / n, 1 - len(set(lines)) / max(1, len(lines)),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(described)


@dataclass(frozen=True)
class Model:
    """Weights of the features and of 1, the latter last, for the log-odds; the share of good labels."""

    weights: tuple[float, ...]
    share: float

    def probability(self, described_col: Column) -> Column:
        logit = sum((F.get(described_col, F.lit(i)) * w for i, w in enumerate(self.weights[:-1]) if w), F.lit(self.weights[-1]))
        return 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Logistic regression by Newton steps, on standardized features."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        bounded = min(max(share, 0.01), 0.99)
        return Model((0.0,) * x.shape[1] + (float(np.log(bounded / (1 - bounded))),), bounded)
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([(x - middle) / spread, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    keep = ridge * np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9), z.T @ (y - p) - keep * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    weights = beta[:-1] / spread
    return Model((*map(float, weights), float(beta[-1] - weights @ middle)), share)


def fit(described_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """The model of labelled documents; `described_docs` has `__features`."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).where("__id is not null and __y is not null").distinct()
    share = min(1.0, SAMPLE / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = described_docs.select(F.col(id_col).alias("__id"), "__features").join(chosen, "__id").groupBy("__id", "__y").agg(F.min("__features").alias("__features"))
    found = rows.orderBy("__id", "__y").toPandas()
    x = np.array(found["__features"].tolist(), float).reshape(len(found), len(NAMES))
    return fitted(x, found["__y"].to_numpy(float))


@dataclass(frozen=True)
class Priors:
    """The corpus's mean probability, and how many documents a prior weighs, for hosts and for paths."""

    mean: float
    host: float
    path: float


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength from group sums (n, s): by how much their means scatter beyond chance around `mean`."""
    chance = mean * (1 - mean) / F.col("n")
    off = F.pow(F.col("s") / F.col("n") - mean, F.lit(2.0))
    got = groups.where("n > 1").agg(F.sum((off - chance) * F.col("n")).alias("more"), F.sum(mean * (1 - mean) * F.col("n")).alias("whole")).first()
    if not got.whole or got.more is None or got.more <= 0:
        return MOST_STRENGTH
    return float(min(max(got.whole / got.more - 1, LEAST_STRENGTH), MOST_STRENGTH))


def sums(scored: DataFrame, host: Column, path: Column) -> tuple[DataFrame, DataFrame, Priors]:
    """Sums of probability by host and by path, and the priors; `scored` has `__p`."""
    by_path = settled(scored.groupBy(F.coalesce(host.cast("string"), F.lit("")).alias("__host"), F.coalesce(path.cast("string"), F.lit("")).alias("__path")).agg(F.count("*").alias("n"), F.sum("__p").alias("s")))
    by_host = by_path.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = by_host.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total.s / total.n, 1e-6), 1 - 1e-6) if total.n else 0.5
    host_mean = F.least(F.greatest(F.col("hs") / F.col("hn"), F.lit(1e-6)), F.lit(1 - 1e-6))
    within = by_path.join(by_host.select("__host", F.col("n").alias("hn"), F.col("s").alias("hs")), "__host")
    return by_host, by_path, Priors(mean, _strength(by_host, F.lit(mean)), _strength(within, host_mean))


def judged(scored: DataFrame, host: Column, path: Column, model: Model, groups: tuple[DataFrame, DataFrame, Priors], p_col: str = "__p", score_col: str = "__score") -> DataFrame:
    """Adds the probability of good quality from evidence and posteriors to rows with the classifier's own (`p_col`)."""
    by_host, by_path, priors = groups
    names = dict(zip(("host", "path", "hn", "hs", "pn", "ps", "h", "q"), fresh(scored, *(f"__{x}" for x in ("host", "path", "hn", "hs", "pn", "ps", "h", "q"))), strict=True))
    of_host = by_host.select(F.col("__host"), F.col("n").alias(names["hn"]), F.col("s").alias(names["hs"]))
    sites = by_path.join(of_host, "__host").withColumnsRenamed({"n": names["pn"], "s": names["ps"], "__host": names["host"], "__path": names["path"]})
    keyed = scored.withColumns({names["h"]: F.coalesce(host.cast("string"), F.lit("")), names["q"]: F.coalesce(path.cast("string"), F.lit(""))})
    both = keyed.join(sites, (F.col(names["h"]) == F.col(names["host"])) & (F.col(names["q"]) == F.col(names["path"])), "left")
    p = F.col(p_col)
    at_host = (F.col(names["hs"]) - p + priors.host * priors.mean) / (F.col(names["hn"]) - 1 + priors.host)
    at_path = (F.col(names["ps"]) - p + priors.path * at_host) / (F.col(names["pn"]) - 1 + priors.path)
    inside = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda x: F.log(inside(x) / (1 - inside(x)))
    odds = logit(p) - float(np.log(model.share / (1 - model.share))) + logit(at_path)
    return both.withColumn(score_col, 1 / (1 + F.exp(-odds))).drop(*names.values())


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", p_col: str = "__p", score_col: str = "__score", keep_text: bool = True) -> DataFrame:
    """The documents with two columns added: the classifier's own probability and the score.

    Without keep_text only the id comes with them, and each text is described once; with it a second time, which
    costs less than writing whole documents in between."""
    by_text = features(F.col(text_col).cast("string"))
    small = settled(docs.select(F.col(id_col).alias(id_col), host.cast("string").alias("__host_key"), path.cast("string").alias("__path_key"), by_text.alias("__features")))
    model = fit(small, labels, id_col)
    own = model.probability(F.col("__features"))
    keys = F.col("__host_key"), F.col("__path_key")
    groups = sums(small.withColumn("__p", own), *keys)
    if not keep_text:
        return judged(small.withColumn(p_col, own), *keys, model, groups, p_col, score_col).select(id_col, p_col, score_col)
    at = fresh(docs, "__features")[0]
    described_docs = docs.withColumn(at, by_text)
    return judged(described_docs.withColumn(p_col, model.probability(F.col(at))).drop(at), host, path, model, groups, p_col, score_col)
