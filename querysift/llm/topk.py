"""Exact top-k search by inner product, with pivot-table elimination.

Vectors become integers, floor(scale * x). With M the largest norm, every vector v gets one more component
sqrt(M^2 - |v|^2), and every query is scaled to norm M; then the inner product falls as the distance grows, so
the triangle inequality holds. A table keeps each vector's distances to many pivots, chosen far from one another; the
largest difference from a query's own distances bounds their distance from below, hence the score from above.

1. Vectors are sorted by their nearest pivot and the distance from it, and cut into blocks of bounded size. A block's
   range is the least and largest distance of its vectors from each pivot.
2. A query first meets its own block, where its neighbours are: the k-th best score there is one it surely reaches.
3. Ranges bound the scores of whole blocks. Only blocks that may hold a better score than that travel to a chunk of
   queries; the others are eliminated before any of their vectors is moved.
4. There candidates are evaluated in the order of their own bounds, until a bound falls under the k-th best score.

How much that eliminates is the data's: much where vectors lie in groups, little where, as with evenly spread
directions in many dimensions, all are about as far from everything. The result tells it: `evaluated` of `candidates`.

Queries are a stated subset and are met with all vectors in blocks: each task holds one block of vectors and one
chunk of queries.

Vectors that are null, hold null or non-finite components, or have no id take no part. Shorter vectors count as
filled with zeros. Rows that share an id count as one candidate (by their best score) and never answer a
query of that id; equal query rows are answered once, and queries of one id with different vectors each get
a ranking. Scores beyond 64 bits are cut there. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Vectors in a block, queries in a chunk, blocks whose ranges are read at once, pivots, and vectors they are chosen
#: from. They bound a task's memory and the broadcast pivots.
BLOCK, QUERY_CHUNK, RANGE_GROUP, PIVOTS, PIVOT_POOL = 2048, 1024, 4096, 64, 4096
_EVALUATED_AT_ONCE = 256


def _integers(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Rows of vec_id, packed (float64 bytes of the integer vector) and norm2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                made = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(made).all():
                    for column, value in zip(out, (i, made.tobytes(), float(made @ made)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.float64()), strict=True)], names=["vec_id", "packed", "norm2"])

    kept = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    return kept.mapInArrow(run, "vec_id long, packed binary, norm2 double")


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Packed vectors as rows of `width` numbers; those beyond a vector's end are zero."""
    if all(len(x) == 8 * width for x in packed):
        return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), width)
    out = np.zeros((len(packed), width))
    for row, x in zip(out, packed, strict=True):
        row[: len(x) // 8] = np.frombuffer(x, np.float64)
    return out


def _spread(pool: np.ndarray, wanted: int) -> list[int]:
    """Rows of `pool` far from one another: each next one is the farthest from those chosen."""
    chosen, away = [], np.full(len(pool), np.inf)
    while len(chosen) < min(wanted, len(pool)) and away.max() > 0:
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, ((pool - pool[chosen[-1]]) ** 2).sum(axis=1))
    return chosen


def _scores(rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (rows @ query).astype(np.int64)
    most = np.iinfo(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in rows]
    return np.array([min(max(x, most.min), most.max) for x in whole], np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of distinct ids, ties to smaller ids."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], scores[order]


def _search(query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, bound: np.ndarray, known: float, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """The block's k best for a query, and how many vectors were evaluated; `bound` is no less than each score, `known`
    no more than the k-th best."""
    order = np.argsort(-bound, kind="stable")
    got_ids, got = np.empty(0, np.int64), np.empty(0, np.int64)
    evaluated = 0
    for at in range(0, len(order), _EVALUATED_AT_ONCE):
        part = order[at : at + _EVALUATED_AT_ONCE]
        part = part[bound[part] >= known]  # nothing else can reach the k-th best, not even as a tie
        if not len(part):
            break
        evaluated += len(part)
        scores = _scores(rows[part], query, exact)
        use = (ids[part] != own) & (scores >= known)
        got_ids, got = _best(np.concatenate([got_ids, ids[part][use]]), np.concatenate([got, scores[use]]), k)
        if len(got) == k:
            known = max(known, float(got[-1]))
    return got_ids, got, evaluated


class _Space:
    """Vectors lifted to one norm, whose square is `most`, and the pivots among them."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots, most
        self.rest = np.sqrt(np.maximum(most - (pivots**2).sum(axis=1), 0))

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """Of vectors from the pivots."""
        own = np.sqrt(np.maximum(self.most - (rows**2).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * self.most - 2 * (rows @ self.pivots.T + own[:, None] * self.rest), 0)).astype(np.float32)

    def query_distances(self, queries: np.ndarray) -> np.ndarray:
        """Of queries, scaled to the norm of the others, from the pivots."""
        norms = np.sqrt((queries**2).sum(axis=1))
        scaled = queries @ self.pivots.T * (np.sqrt(self.most) / np.where(norms > 0, norms, 1))[:, None]
        return np.sqrt(np.maximum(2 * self.most - 2 * scaled, 0)).astype(np.float32)

    def bound(self, least: np.ndarray, norm: float) -> np.ndarray:
        """The most that a score can be at these least distances, with room for rounding."""
        return (self.most - least.astype(np.float64) ** 2 / 2) * (norm / np.sqrt(self.most)) + 1 + 1e-4 * norm * np.sqrt(self.most)


def _floats(packed: pa.ChunkedArray | pa.Array | list, width: int) -> np.ndarray:
    values = packed if isinstance(packed, list) else packed.to_pylist()
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), width)


def _batch(columns: dict[str, tuple[list | np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns.values()], names=list(columns))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """Each query's k best: query_id, rank (from 1), vec_id, score; evaluated and candidates, the numbers of vectors whose
    score was computed for the query and of all. `is_query` is a condition on vec_id."""
    spark = vectors.sparkSession
    all_rows = settled(_integers(vectors, id_col, vector_col, scale))
    n, most, width = all_rows.agg(F.count("*"), F.max("norm2"), F.max(F.octet_length("packed"))).first()
    width, most = (width or 0) // 8, max(most or 0.0, 1.0)
    pool = all_rows.orderBy(F.xxhash64("vec_id"), "vec_id", "packed").limit(PIVOT_POOL).dropDuplicates(["vec_id"]).collect()
    values = _matrix([bytes(r.packed) for r in pool], width)
    chosen = values[_spread(values, pivots)]
    space, exact, n_pivots = spark.sparkContext.broadcast(_Space(chosen, most)), 2 * most < 2**53, len(chosen)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = space.value.distances(_matrix(batch.column(1).to_pylist(), width))
            nearest = away.argmin(axis=1) if n_pivots else np.zeros(len(away), np.int64)
            near = away[np.arange(len(away)), nearest] if n_pivots else np.zeros(len(away))
            yield _batch({"vec_id": (batch.column(0), pa.int64()), "packed": (batch.column(1), pa.binary()), "asked": (batch.column(2), pa.bool_()), "away": ([x.tobytes() for x in away], pa.binary()), "nearest": (nearest, pa.int32()), "near": (near, pa.float32())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            block = at + (seen + np.arange(len(batch))) // BLOCK
            seen += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(block)], names=["vec_id", "packed", "asked", "away", "block"])

    located_rows = all_rows.select("vec_id", "packed", F.coalesce(is_query, F.lit(False)).alias("asked")).mapInArrow(located, "vec_id long, packed binary, asked boolean, away binary, nearest int, near float")
    in_order = located_rows.repartitionByRange("nearest", "near", "vec_id").sortWithinPartitions("nearest", "near", "vec_id")
    blocks = settled(in_order.mapInArrow(cut, "vec_id long, packed binary, asked boolean, away binary, block long"))

    def described(block: pa.Table) -> pa.Table:
        """A block's range, and its queries with the k-th best score they reach in the block."""
        ids, rows, away = block["vec_id"].to_numpy(), _matrix(block["packed"].to_pylist(), width), _floats(block["away"], n_pivots)
        number = block["block"][0].as_py()
        out = [(number, None, None, None, away.min(axis=0).tobytes() + away.max(axis=0).tobytes())]
        for i in np.flatnonzero(block["asked"].to_numpy()):
            reached = _best(ids[ids != ids[i]], _scores(rows[ids != ids[i]], rows[i], exact), k)[1]
            out.append((number, int(ids[i]), rows[i].tobytes(), float(reached[-1]) - (0 if exact else abs(float(reached[-1])) * 1e-9) if len(reached) == k else float("-inf"), None))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary()), strict=True)], names=["block", "vec_id", "packed", "known", "range"])

    told = settled(blocks.groupBy("block").applyInArrow(described, "block long, vec_id long, packed binary, known double, range binary"))
    ranges = told.where("range is not null").select("block", "range")
    queries = told.where("range is null").groupBy("vec_id", "packed").agg(F.max("known").alias("known"), F.min("block").alias("home"))
    n_ranges, n_queries = ranges.count(), queries.count()
    # Neighbours share a chunk, so that it needs few blocks; the hash splits what would grow too large.
    chunks = max(1, -(-n_queries // QUERY_CHUNK))
    ordered = queries.repartitionByRange(chunks, "home", "vec_id", "packed").withColumn("chunk", F.spark_partition_id())
    queries = settled(ordered.select("vec_id", "packed", "known", F.xxhash64("packed").alias("query_no"), "chunk"))

    def needed(asked: pa.Table, held: pa.Table) -> pa.Table:
        """The blocks of a group that may hold a better score for some query of a chunk."""
        if not len(held) or not len(asked):
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int64())], names=["chunk", "block"])
        limits = _floats(held["range"], 2 * n_pivots)
        low, high = limits[:, :n_pivots], limits[:, n_pivots:]
        rows, known, use = _matrix(asked["packed"].to_pylist(), width), asked["known"].to_numpy(), np.zeros(len(held), bool)
        norms = np.sqrt((rows**2).sum(axis=1))
        for away, norm, reached in zip(space.value.query_distances(rows), norms, known, strict=True):
            if n_pivots and not use.all():
                outside = np.maximum(np.maximum(low - away, away - high), 0).max(axis=1)
                use |= space.value.bound(outside, norm) >= reached
        found = held["block"].to_numpy()[use] if n_pivots else held["block"].to_numpy()
        return pa.table([pa.array([asked["chunk"][0].as_py()] * len(found), pa.int32()), pa.array(found)], names=["chunk", "block"])

    groups = max(1, -(-n_ranges // RANGE_GROUP))
    dealt = ranges.withColumns({"grp": F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"), "chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))})
    spread = queries.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    meetings = settled(spread.groupBy("chunk", "grp").cogroup(dealt.groupBy("chunk", "grp")).applyInArrow(needed, "chunk int, block long"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        if len(left) and len(right):
            ids, rows, away = left["vec_id"].to_numpy(), _matrix(left["packed"].to_pylist(), width), _floats(left["away"], n_pivots)
            asked = _matrix(right["packed"].to_pylist(), width)
            norms = np.sqrt((asked**2).sum(axis=1))
            low, high = (away.min(axis=0), away.max(axis=0)) if n_pivots else (away, away)
            each = zip(right["vec_id"].to_pylist(), right["query_no"].to_pylist(), asked, norms, space.value.query_distances(asked), right["known"].to_pylist(), strict=True)
            for own, number, query, norm, own_away, known in each:
                if n_pivots and space.value.bound(np.maximum(np.maximum(low - own_away, own_away - high), 0).max(), norm) < known:
                    continue  # the block may serve another query of the chunk, not this one
                bound = space.value.bound(np.abs(away - own_away).max(axis=1), norm) if n_pivots else np.full(len(ids), np.inf)
                got_ids, got, evaluated = _search(query, own, ids, rows, bound, known, k, exact)
                for column, found in zip(out, ([own] * (len(got) + 1), [number] * (len(got) + 1), [*got_ids.tolist(), None], [*got.tolist(), None], [*[0] * len(got), evaluated]), strict=True):
                    column.extend(found)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "query_no", "vec_id", "score", "evaluated"])

    moved = blocks.select("block", "vec_id", "packed", "away").join(meetings, "block")
    asked = queries.join(meetings, "chunk")
    found = settled(moved.groupBy("chunk", "block").cogroup(asked.groupBy("chunk", "block")).applyInArrow(meet, "query_id long, query_no long, vec_id long, score long, evaluated long"))
    counted = found.groupBy("query_id", "query_no").agg(F.sum("evaluated").alias("evaluated"))
    best = found.where("vec_id is not null").groupBy("query_id", "query_no", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(counted, ["query_id", "query_no"]).select("query_id", "rank", "vec_id", "score", "evaluated", F.lit(n).alias("candidates"))
