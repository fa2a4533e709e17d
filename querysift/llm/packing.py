"""Best-fit packing of tokenized documents into sequences by the sum-of-squares rule.

Each document goes where the sum, over all residual gaps, of the squared number of open sequences with that
gap becomes smallest; a new sequence opens only where no open one has room. Documents are dealt at random
into groups of bounded size, which are packed independently and in order of falling length; a group leaves a handful of part-filled sequences, so the
loss against packing all at once shrinks with the group size.

Null text counts as empty: a document of the end id alone. Repeated rows are packed each for itself, null ids
are kept, an empty table gives no rows. Only documents longer than a sequence are cut; the first piece is
then the short one, so all others are sequences of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokenization
from .common import settled

#: Pieces that one task packs. The state of a task is a few arrays of this length.
GROUP_PIECES = 1 << 17
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence number and offset of each piece (1 <= length <= capacity), packed longest first."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; none has gap 0 or `capacity`
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if size == capacity:
            bins[i], opened = opened, opened + 1
            continue
        # Leaving gap g takes 2 n(g) - 1 from the sum of squares, reaching gap g - size adds 2 n(g - size) + 1.
        cost = 2 * (count[: capacity + 1 - size] - count[size:]) + 2
        cost[0] -= 1  # a full sequence has no gap to count
        cost[capacity - size] -= 1  # a new sequence leaves none
        usable = count[size:] > 0
        usable[capacity - size] = not usable.any()  # a new sequence only where no open one has room
        gap = size + int(np.argmin(np.where(usable, cost, np.iinfo(np.int64).max)))
        if gap == capacity:
            own, opened = opened, opened + 1
        else:
            own = open_by_gap[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = own, capacity - gap
        if gap > size:
            open_by_gap[gap - size].append(own)
            count[gap - size] += 1
    return bins, offsets


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Documents as tokens with `end_id` after the last, cut where longer than `capacity`.

    Columns: doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32, and with keep_ids
    also ids (binary, little-endian uint32)."""
    with open(tokenizer_path, encoding="utf-8") as definition:
        shared = docs.sparkSession.sparkContext.broadcast(definition.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = tokenization.rank_encoder(shared.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoded(text.as_py()) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(part), part if keep_ids else None))
            columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            made = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made[: 5 + keep_ids], names=names[: 5 + keep_ids])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES + ", ids binary" * keep_ids)


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` column; other columns stay as they are."""
    pieces = settled(pieces)  # so that numbering the rows by their place is stable
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="__group").assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    return dealt.groupBy("__group").applyInPandas(run, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
