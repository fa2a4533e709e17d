"""A corpus cleaned and packed in stages. Each takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of `docs`. What each does with null, empty and long texts, ties, repeated
rows and empty tables is told in its docstring and its operator's.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querysift.llm import jaccard, packing, quality_model, quality_rules, secret_scan
from querysift.llm.common import fresh, settled, shared_dir, table, written
from querysift.llm.queries import DEFINITION


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality, from text and site, reaches the limit.

    Null and empty texts are judged like others; without labels the sites decide alone. Repeated rows stay or go
    together, null ids are kept, empty tables give no rows."""
    p, score = fresh(docs, "p", "score")
    scored = quality_model.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), p_col=p, score_col=score)
    return scored.where(F.col(score) >= quality_model.KEEP_FROM).select(*docs.columns)


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stay near a language reference.

    Null and empty texts fail the base rules. Repeated rows stay or go together, null ids are kept, empty tables give no
    rows."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")  # apart from the operator's own columns
    featured = written(quality_rules.features(docs.select(whole, "text", "lang")).drop("text"))
    return quality_rules.verdicts(featured, quality_rules.references(featured)).where("__kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (5-word shingles, similarity 0.8).

    Rows are told apart by id and text: rows that repeat both count once, and another text under the same id is a
    document of its own. A row without an id takes one from its text, larger than usual ones."""
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    groups = settled(jaccard.join(docs, words=5, percent=80, id_col=own_id))
    first = groups.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n")).where("n > 1")
    others = groups.join(first, "group").where(F.struct("doc_id", "text_hash") != F.col("first")).select("doc_id", "text_hash").distinct()
    a, b = fresh(docs, "own_id", "own_text")
    among = lambda rows, of, how: rows.join(of.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b)), (own_id == F.col(a)) & (F.xxhash64("text") == F.col(b)), how)
    kept = among(docs, others, "left_anti")
    again = settled(groups.groupBy("doc_id", "text_hash").count().where("count > 1"))
    if again.isEmpty():
        return kept
    return among(kept, again, "left_anti").unionByName(among(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as tokens, packed into sequences of at most 2048."""
    return packing.pack(packing.pieces_of(docs, public_tokenizers.path(DEFINITION), 2048), 2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_redaction),
    ("best-fit packing", best_fit_packing),
]
#: A fitted classifier and a tokenizer's ids are beyond SQL; tests/llm runs the stages, but compares no row of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each one's result is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
