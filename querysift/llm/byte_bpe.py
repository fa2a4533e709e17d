"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file becomes a tokenizers model once, on the driver, and is broadcast (its size is that of the
vocabulary). Bytes map to characters by the byte-level table; decoding reverses that table, so tokens that
end inside a character join again without loss.

Null text counts as empty (no ids). Rows are handled one by one: repeated ids, ties, extra columns and
empty tables need no care, and a null id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenization


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """One row per document: its id and `ids` (binary: little-endian uint32).

    with_offsets adds `offsets`, code point ranges (start, end exclusive) by token; the parts of a character
    that is split over tokens all get that character's range."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenization.rank_tokenizer_json(ranks_path, pattern))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        encoded = tokenization.encoder(shared.value)
        whole = Tokenizer.from_str(shared.value) if with_offsets else None
        for batch in batches:
            texts = batch.column(1)
            ids = pa.array([encoded(x.as_py()) for x in texts], pa.binary())
            columns = [batch.column(0), ids]
            if whole:
                spans = [whole.encode(x.as_py() or "", add_special_tokens=False).offsets for x in texts]
                columns.append(pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "offsets"][: len(columns)])

    offsets = ", offsets array<struct<start: int, end: int>>" if with_offsets else ""
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids binary{offsets}")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Adds `decoded` (binary) to rows of id and `ids`: the bytes that the ids stand for. Null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenization.rank_tokenizer_json(ranks_path, pattern))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        behind = tokenization.id_bytes(shared.value)
        for batch in batches:
            raw = (x.as_py() for x in batch.column(1))
            out = [None if x is None else b"".join([behind[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=[id_col, "ids", "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, encoded and decoded again."""
    both = decode(encode(docs, ranks_path, pattern), ranks_path, pattern)
    return both.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
