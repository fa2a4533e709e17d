"""N-gram Jaccard join: which documents share enough of their word shingles, and the groups this links.

Two sets whose Jaccard similarity reaches t share at least one token among the first n - ceil(t n) + 1 of each,
under any global order of all tokens, and in those prefixes enough tokens that the rest can make up for the
others. The join uses several orders; in each, tokens that many documents hold stand last, so that common
passages stay out of the prefixes. No step makes all pairs of a group:

1. Tokens are counted in cells by hash; a broadcast bitmap (its size bounded) tells the crowded cells. It only
   shapes the orders: any order gives the same result.
2. Documents of equal sets become one class, stored with its prefixes in all orders.
3. Classes that share a token of the first order's prefix meet. Up to FEW at a token are paired there, where their
   lengths and the token's places allow it. More meet at spots, one for all tokens with the same smallest class, cut
   by size; there the smallest class is paired with each other one.
4. A pair passes if the parities of the whole sets (a few bits a token) allow it, and the prefixes in every order, each by
   itself and all together: the filters are intersected, and only then texts are fetched, those of pairs that passed, and
   the whole sets compared. Links that hold give the first components.
5. Spots whose members are of several components are looked at again. Large ones get other centres. Then each
   member outside the component of its spot's first class is tried with all members of other components, in blocks;
   of the pairs that the parities allow its best few go on as in step 4, and more of them in each further round until
   none is left. So all pairs that pass are verified, but for those that verified links join already.
6. Components are those of verified links only.

Words are maximal runs without ASCII white space, A-Z in lower case. A document with fewer words than a shingle
has one shingle, its whole sequence; null text or text without words has no shingle and links with nothing.
Rows that repeat an id are documents of their own: those with equal texts are in one component, others need not be.
Rows with a null id take no part. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, shared_dir, swept

#: Members of a block and their tokens; cells of the token counts: CELLS_A_DOCUMENT for each, at most MOST_CELLS (2 MB of
#: bits). They bound a task's memory and what is broadcast.
BLOCK, BLOCK_TOKENS, CELLS_A_DOCUMENT, MOST_CELLS = 1024, 1 << 22, 16, 1 << 24
#: Most classes at a token that are paired there at once; partners to which one copy of a class goes; turns with new
#: centres in spots beyond a block; partners tried at first.
FEW, PARTNERS, TURNS, FIRST_MOST = 16, 256, 3, 4
#: Cells go in chunks of this many; a cell is crowded beyond the mean by CROWDED and six times the mean's root.
CHUNK, CROWDED = 1 << 14, 32
#: Parities kept of a set: as many bits as the power of 2 from twice its size on, and this many at least.
LEAST_BITS = 256
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a text in UTF-8."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, _U)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed=len(parts))], _U)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, parts), _U, len(parts))
    n = len(parts) - words + 1
    out = np.zeros(n, _U)
    for i in range(words):
        out = (out ^ (out >> _U(29))) * _U(0x9FB21C651E98DF25) + hashed[i : i + n]
    return np.unique(_mixed(out))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _in_order(tokens: np.ndarray, crowded: np.ndarray | None, order: int, orders: int) -> np.ndarray:
    """Places of tokens in a global order: round the circle of their hashes from the order's own start, with those of
    crowded cells last. The upper bit tells these."""
    keys = ((tokens >> _U(1)) - _U(order * 2**63 // orders)) & _U(2**63 - 1)
    if crowded is not None:
        cell = tokens & _U(8 * len(crowded) - 1)
        keys |= ((crowded[(cell >> _U(3)).astype(np.int64)] >> (cell & _U(7)).astype(np.uint8)) & 1).astype(_U) << _U(63)
    return keys


def _prefix(tokens: np.ndarray, crowded: np.ndarray | None, order: int, percent: int, orders: int) -> np.ndarray:
    """The first tokens of a set, as sorted places in the order."""
    keys, p = _in_order(tokens, crowded, order, orders), prefix_length(len(tokens), percent)
    return np.sort(np.partition(keys, p - 1)[:p])


def crowded_cells(docs: DataFrame, words: int, n_docs: int) -> np.ndarray:
    """A bitmap of the cells that hold unusually many (document, token) pairs."""
    cells = 1 << int(np.clip(np.ceil(np.log2(max(1, CELLS_A_DOCUMENT * n_docs))), np.log2(CHUNK), np.log2(MOST_CELLS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append((shingles(text.as_py(), words) & _U(cells - 1)).astype(np.uint32))
                size += len(held[-1])
                if size >= 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=cells).astype(np.uint32)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=cells).astype(np.uint32)
        for chunk in range(cells // CHUNK):
            part = total[chunk * CHUNK : (chunk + 1) * CHUNK]
            if part.any():
                narrow = part.astype(np.uint8 if part.max() < 256 else np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([narrow.tobytes()], pa.binary())], names=["chunk", "counts"])

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in parts["counts"]:
            raw = x.as_py()
            total += np.frombuffer(raw, np.uint8 if len(raw) == CHUNK else np.uint32)
        return pa.table([pa.array([parts["chunk"][0].as_py()], pa.int32()), pa.array([int(total.sum())], pa.int64()), pa.array([total.astype(np.uint32).tobytes()], pa.binary())], names=["chunk", "total", "counts"])

    summed = settled(docs.select(F.col("text").cast("binary")).mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, total long, counts binary"))
    mean = (summed.agg(F.sum("total")).first()[0] or 0) / cells
    most = mean + 6 * mean**0.5 + CROWDED

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(x.as_py(), np.uint32) > most, bitorder="little").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["chunk", "bits"])

    out = np.zeros(cells // 8, np.uint8)
    for r in summed.select("chunk", "counts").mapInArrow(mark, "chunk int, bits binary").toLocalIterator():
        out[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return out


class _Store:
    """Tables of one join, written to the shared folder; those no longer needed are deleted."""

    def __init__(self, spark: SparkSession):
        self._spark, self._folder, self._n = spark, f"{shared_dir(spark).rstrip('/')}/jaccard-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self._folder}/{self._n}"
        df.write.parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for x in tables:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(x._stored_at)
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        swept(self._spark)


def _sets(docs: DataFrame, words: int, percent: int, orders: int, crowded: Broadcast) -> DataFrame:
    """doc_id, text_hash, set_id (16 bytes that stand for the set), n_shingles, parities and head: the prefixes in all
    orders, that of the first as whole places, those of the others as the upper half of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, parities, heads = [], [], [], []
            for text in batch.column(1):
                tokens = shingles(text.as_py(), words)
                sizes.append(len(tokens))
                ids.append(_digest(tokens) if len(tokens) else None)
                made = [_prefix(tokens, crowded.value, k, percent, orders) for k in range(orders)] if len(tokens) else None
                heads.append(b"".join([made[0].tobytes(), *[(x >> _U(32)).astype(np.uint32).tobytes() for x in made[1:]]]) if made else None)
                parities.append(_parities(tokens).tobytes() if made else None)
            made = [batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(parities, pa.binary()), pa.array(heads, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "text_hash", "set_id", "n_shingles", "parities", "head"])

    rows = docs.select("doc_id", F.col("text").cast("binary"), F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, set_id binary, n_shingles long, parities binary, head binary")


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _parities(tokens: np.ndarray) -> np.ndarray:
    """For each cell of tokens, by their lowest bits, whether it holds an odd number of them, as bits."""
    cells = max(LEAST_BITS, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _folded(parities: np.ndarray, length: int) -> np.ndarray:
    """The same sets' parities in fewer cells: the halves together are those in half as many."""
    while parities.shape[-1] > length:
        half = parities.shape[-1] // 2
        parities = parities[..., :half] ^ parities[..., half:]
    return parities


def _parts(n: int, head: bytes, percent: int) -> list[np.ndarray]:
    """The prefixes of a head, by order."""
    p = prefix_length(n, percent)
    return [np.frombuffer(head, _U, p), *[np.frombuffer(head, np.uint32, p, at) for at in range(8 * p, len(head), 4 * p)]]


def _enough(shared, total, percent: int):
    """Whether sets with so many elements together and in common reach the similarity."""
    return (100 + percent) * shared >= percent * total


def _alike_in_size(a, b, percent: int):
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _may_be_near(x: np.ndarray, y: np.ndarray, a, b, percent: int):
    """Whether sets of a and b tokens can reach the similarity, by their parities, of equal lengths: a cell in which they
    differ holds at least one token that only one of the sets has."""
    differ = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return _alike_in_size(a, b, percent) & _enough(a + b - differ, 2 * (a + b), percent), differ


def _may_link(x: list[np.ndarray], y: list[np.ndarray], a: int, b: int, percent: int) -> bool:
    """Whether sets of a and b tokens can reach the similarity, by their prefixes in all orders together.

    In each order the prefixes must share a token. The orders start apart on the circle, so each has an arc of tokens to
    itself; what the prefixes tell about the arcs adds up."""
    common = of_x = of_y = 0
    for u, v in zip(x, y, strict=True):
        shared = v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u
        if not shared.any():
            return False
        top = u.dtype.type(1 << (8 * u.dtype.itemsize - 1))
        arc = u.dtype.type(int(top) // len(x))
        last = min(u[-1], v[-1])  # below it both sets are known
        own, other = (u < last) & ((u & ~top) < arc), (v < last) & ((v & ~top) < arc)
        common += int(np.count_nonzero(shared & own))
        of_x += int(np.count_nonzero(own))
        of_y += int(np.count_nonzero(other))
        if not _enough(common + min(a - of_x, b - of_y), a + b, percent):
            return False
    return True


def _first_tokens(classes: DataFrame, percent: int) -> DataFrame:
    """token, key, n (the set's size) and left (what it has from the token on): a row for each token of the first prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch.column(1).to_numpy()
            own = [_parts(int(n), x.as_py(), percent)[0] for n, x in zip(sizes, batch.column(2), strict=True)]
            lengths = [len(x) for x in own]
            n = np.repeat(sizes, lengths)
            made = [np.concatenate(own).view(np.int64), np.repeat(batch.column(0).to_numpy(), lengths), n, n - np.concatenate([np.arange(x) for x in lengths])]
            for i in range(0, len(n), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in made], names=["token", "key", "n", "left"])

    return classes.select("key", "n_shingles", "head").mapInArrow(run, "token long, key long, n long, left long")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Groups of rows with equal first columns, from rows sorted by those."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda r: r[:keys])


def _tested(pairs: DataFrame, payloads: DataFrame, prepare, test) -> DataFrame:
    """The pairs (a, b) for which test(x, y) holds; x and y come from prepare(n, data) of the payloads (key, n, data).

    A class goes to each of its partners in chunks of PARTNERS, so neither its copies nor a task's work pile up; a task
    holds one class at a time."""
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("chunks"))
    firsts = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), F.col("a").alias("key"))
    others = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b", F.col("b").alias("key"))
    rows = firsts.unionByName(others).join(payloads, "key").select("a", "chunk", "b", "n", "data")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in batch], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int]]]:
        own, first = None, None
        for batch in batches:
            found = []
            columns = [c.to_pylist() for c in batch.columns[:4]]
            for a, chunk, b, n, data in zip(*columns, batch.column(4), strict=True):
                made = prepare(n, data.as_py())
                if b is None:
                    own, first = (a, chunk), made
                elif own == (a, chunk) and test(first, made):
                    found.append((a, b))
            yield found

    return rows.mapInArrow(run, "a long, b long")


def _cells(wanted: DataFrame, column: str) -> tuple[Column, Broadcast]:
    """The cell of a row by the hash of that column, and a broadcast bitmap, bounded in size, of those of wanted rows."""
    cells = 1 << int(np.clip(np.ceil(np.log2(max(1, 16 * wanted.count()))), np.log2(CHUNK), np.log2(MOST_CELLS)))
    cell = F.pmod(F.xxhash64(column), F.lit(cells))
    held = wanted.groupBy(F.floor(cell / CHUNK).cast("int").alias("chunk")).agg(F.collect_set((cell % CHUNK).cast("int")).alias("cells"))
    bits = np.zeros(cells, bool)
    for r in held.collect():  # MOST_CELLS numbers at most
        bits[r.chunk * CHUNK + np.array(r.cells)] = True
    return cell, wanted.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))


def _held(shared: Broadcast, cells: pa.Array) -> pa.Array:
    at = cells.to_numpy()
    return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))


def _among(classes: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """key, n and data (the column) of the classes whose key is wanted, and few others: so most stay where they are."""
    cell, shared = _cells(wanted, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_held(shared, batch.column(3))).select(["key", "n", "data"])

    rows = classes.select("key", F.col("n_shingles").alias("n"), F.col(column).alias("data"), cell.alias("cell"))
    return rows.mapInArrow(run, "key long, n long, data binary")


def _passed(store: _Store, pairs: DataFrame, classes: DataFrame, column: str, prepare, test) -> DataFrame:
    """The stored pairs for which test(x, y) holds of what prepare(n, data) makes of the column, stored in their place."""
    wanted = store.put(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    out = store.put(_tested(pairs, _among(classes, wanted, column), prepare, test))
    store.drop(pairs, wanted)
    store.sweep()
    return out


def _by_parities(store: _Store, candidates: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The candidates that the parities allow, stored."""

    def test(x: tuple, y: tuple) -> bool:
        (a, u), (b, v) = x, y
        length = min(len(u), len(v))
        return bool(_may_be_near(_folded(u, length), _folded(v, length), a, b, percent)[0])

    return _passed(store, store.put(candidates.distinct()), classes, "parities", lambda n, data: (n, np.frombuffer(data, np.uint8)), test)


def _by_prefixes(store: _Store, pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The stored pairs that the prefixes of all orders allow, stored in their place."""
    test = lambda x, y: _may_link(x[1], y[1], x[0], y[0], percent)
    return _passed(store, pairs, classes, "head", lambda n, head: (n, _parts(n, head, percent)), test)


def _texts(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """key, n and data (the text) of the wanted classes (key, doc_id, set_id).

    A bitmap of their ids keeps most other texts from the shuffle."""
    cell, shared = _cells(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(_held(shared, batch.column(2)))
            made = [shingles(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(x) if len(x) else None for x in made], pa.binary()), batch.column(1)], names=["doc_id", "set_id", "data"])

    found = docs.select("doc_id", F.col("text").cast("binary"), cell.alias("cell")).mapInArrow(run, "doc_id long, set_id binary, data binary")
    return found.join(wanted, ["doc_id", "set_id"]).dropDuplicates(["key"]).select("key", F.lit(0).cast("long").alias("n"), "data")


def _verified(store: _Store, pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The stored pairs whose whole sets are similar enough, stored."""
    wanted = store.put(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(classes.select("key", "doc_id", "set_id"), "key"))
    texts = store.put(_texts(docs, wanted, words))

    def test(x: np.ndarray, y: np.ndarray) -> bool:
        return bool(_enough(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y), percent))

    out = store.put(_tested(pairs, texts, lambda _, text: shingles(text, words), test))
    store.drop(wanted, texts)
    store.sweep()
    return out


def _met(store: _Store, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a, b) that meet with few others at some token, and the members (place, size, key) of spots."""
    tokens = _first_tokens(classes, percent)
    sums = {"m": F.count("*"), "a": F.min("key"), "b": F.max("key"), "total": F.sum("n"), "least": F.min("n"), "most": F.max("n"), "left": F.min("left")}
    alike = lambda least, most: 100 * F.col(least) >= percent * F.col(most)
    alone = (F.col("m") == 2) & alike("least", "most") & ((100 + percent) * F.col("left") >= percent * F.col("total"))
    meeting = store.put(tokens.groupBy("token").agg(*[x.alias(k) for k, x in sums.items()]).where((F.col("m") > 2) | alone).select("token", "m", "a", "b"))
    store.sweep()
    shared = store.put(tokens.join(meeting.where("m > 2").select("token", "m", F.col("a").alias("place")), "token"))
    store.sweep()
    few = shared.where(F.col("m") <= FEW)
    x, y = (few.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("key", "n", "left")]) for k in "xy")
    reachable = (100 + percent) * F.least("left_x", "left_y") >= percent * (F.col("n_x") + F.col("n_y"))
    similar = (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & reachable
    by_few = x.join(y, "token").where((F.col("key_x") < F.col("key_y")) & similar).select(F.col("key_x").alias("a"), F.col("key_y").alias("b"))
    pairs = store.put(meeting.where("m = 2").select("a", "b").unionByName(by_few).distinct())
    places = shared.where(F.col("m") > FEW).select("place", "key", "n").distinct()
    # Sizes of a similar pair are in one bucket, or the larger one's reaches down to the smaller one's.
    t = percent / 100
    bucket = lambda n: F.floor(F.log(n) / (-2 * math.log(t) + 1e-9)).cast("int")
    rows = places.withColumn("size", F.explode(F.array_distinct(F.array(bucket(F.col("n")), bucket(F.greatest(F.col("n") * (t - 1e-9), F.lit(1.0)))))))
    several = rows.groupBy("place", "size").count().where("count > 1").select("place", "size")
    members = store.put(rows.join(several, ["place", "size"]).select("place", "size", "key", "n"))
    store.drop(meeting, shared)
    store.sweep()
    return pairs, members


def _named(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    """Rows of classes with their component, so far: that of `names`, or their own key."""
    if names is None:
        return rows.withColumn("component", F.col("key"))
    known = names.withColumnRenamed("node", "key")
    return rows.join(known, "key", "left").withColumn("component", F.coalesce("component", "key"))


def _divided(named: DataFrame, more_than: int) -> DataFrame:
    """place, size, and the component of the first member, of spots with more members, of several components."""
    several = named.groupBy("place", "size").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "key").alias("main"))
    return several.where((F.col("m") > more_than) & (F.col("low") < F.col("high"))).select("place", "size", "main")


def _stars(named: DataFrame, spots: DataFrame, turn: int) -> DataFrame:
    """Pairs of a spot's centre, one of the members outside its main component, and its other members."""
    outside = named.join(spots, ["place", "size"]).where("component <> main")
    chosen = outside.groupBy("place", "size").agg(F.min_by(F.struct("key", "component"), F.xxhash64("key", F.lit(turn))).alias("centre"))
    pairs = named.join(chosen, ["place", "size"]).where("component <> centre.component")
    return pairs.select(F.least("key", "centre.key").alias("a"), F.greatest("key", "centre.key").alias("b"))


def _across(named: DataFrame, asked: DataFrame, parities: DataFrame, percent: int, most: int) -> DataFrame:
    """place, size, a, b: for each asked member (place, size, key) up to `most` members of other components with which
    the parities allow a link, those that differ least first, and a row with null b if there are more."""
    spot = ["place", "size"]
    blocks = lambda df, name: df.groupBy(*spot).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias(name))
    asked = asked.join(named, [*spot, "key"])
    dealt = blocks(asked, "rows").join(blocks(named, "columns"), spot)
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(dealt, spot).select(*spot, place("rows").alias("row"), every("columns").alias("column"), F.lit(0).alias("side"), "key", "component")
    right = named.join(dealt, spot).select(*spot, every("rows").alias("row"), place("columns").alias("column"), F.lit(1).alias("side"), "key", "component")
    rows = left.unionByName(right).join(parities, "key").select(*spot, "row", "column", "side", "key", "component", "n", "data")
    rows = rows.repartition(*spot, "row", "column").sortWithinPartitions(*spot, "row", "column", "side", "key")

    def found(group: list[tuple]) -> Iterator[tuple]:
        keys, of, sizes = (np.array([r[k] for r in group], np.int64) for k in (5, 6, 7))
        bits = [np.frombuffer(r[8], np.uint8) for r in group]
        left, right = (np.array([i for i, r in enumerate(group) if r[4] == side], np.int64) for side in (0, 1))
        lengths = np.array([len(x) for x in bits])
        same = [right[lengths[right] == n] for n in np.unique(lengths[right])]
        of_length = [np.stack([bits[j] for j in js]) for js in same]
        folded = functools.cache(lambda k, length: _folded(of_length[k], length))
        for i in left:
            others, differ = [], []
            for k, js in enumerate(same):
                length = min(lengths[i], of_length[k].shape[1])
                near, by = _may_be_near(folded(k, length), _folded(bits[i], length), sizes[js], sizes[i], percent)
                near &= of[js] != of[i]
                others.append(js[near])
                differ.append(by[near])
            if not same or not (n := sum(map(len, others))):
                continue
            best = np.concatenate(others)[np.argsort(np.concatenate(differ), kind="stable")][:most]
            yield from ((int(keys[i]), int(keys[j])) for j in best)
            if n > most:
                yield int(keys[i]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _grouped(batches, 4):
            out = list(found(list(group)))
            columns = [[key[0]] * len(out), [key[1]] * len(out), [x[0] for x in out], [x[1] for x in out]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["place", "size", "a", "b"])

    return rows.mapInArrow(run, "place long, size int, a long, b long")


def components(edges: DataFrame, put=settled) -> DataFrame:
    """node and component (the smallest node it reaches), for all nodes of `edges` (a, b).

    In each round every node takes the smallest name among its neighbours', then its name's name; that ends after
    about as many rounds as the logarithm of the longest path. Names and edges stay in tables all along, which `put`
    writes."""
    both = put(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    names = put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(names, both.b == names.node).groupBy("a").agg(F.min("component").alias("near"))
        hooked = names.join(near, names.node == near.a).select("node", F.least("component", "near").alias("new"), F.col("component").alias("old"))
        # The name's own new name: also the smallest that any node of that name has found.
        best = hooked.groupBy("old").agg(F.min("new").alias("best"))
        jumped = put(hooked.join(best, "old").select("node", F.least("new", "best").alias("component"), "old"))
        names = jumped.select("node", "component")
        if jumped.where("component <> old").isEmpty():
            return names


def _linked(store: _Store, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame | None:
    """node and component (both keys of classes) of all classes with a link; None if there is none."""
    pairs, members = _met(store, classes, percent)
    edges: list[DataFrame] = []
    names: DataFrame | None = None

    def verify(near: DataFrame) -> DataFrame | None:
        """The components after the links among stored pairs have joined those known; the pairs are dropped."""
        passed = _by_prefixes(store, near, classes, percent)
        found = None if passed.isEmpty() else _verified(store, passed, classes, docs, words, percent)
        store.drop(passed)
        if found is None or found.isEmpty():
            return names
        edges.append(found)
        return components(functools.reduce(DataFrame.unionByName, edges), store.put)

    firsts = members.groupBy("place", "size").agg(F.min("key").alias("a"))
    stars = members.join(firsts, ["place", "size"]).where("key <> a").select("a", F.col("key").alias("b"))
    names = verify(_by_parities(store, pairs.unionByName(stars), classes, percent))
    store.drop(pairs)
    for turn in range(TURNS):
        now = _named(members, names)
        spots = store.put(_divided(now, BLOCK))
        if spots.isEmpty():
            break
        names = verify(_by_parities(store, _stars(now, spots, turn), classes, percent))
        store.drop(spots)
    asked, most = None, FIRST_MOST
    while True:
        now = _named(members, names)
        spots = store.put(_divided(now, 2))
        inside = store.put(now.join(spots, ["place", "size"]))
        store.drop(spots)
        if inside.isEmpty():
            return names
        wanted = inside.where("component <> main").select("place", "size", "key")
        if asked is not None:
            wanted = wanted.select("place", "size").distinct().join(asked, ["place", "size"])
        found = store.put(_across(inside.drop("main"), wanted, _among(classes, inside.select("key").distinct(), "parities"), percent, most))
        asked = store.put(found.where("b is null").select("place", "size", F.col("a").alias("key")).distinct())
        near = store.put(found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        store.sweep()
        names = verify(near)
        store.drop(found, inside)
        if asked.isEmpty():
            return names
        most *= 16


def join(docs: DataFrame, words: int = 4, percent: int = 85, orders: int = 3, id_col: str | Column = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each document: the smallest id that links of at least `percent`
    hundredths reach from it, its own included.

    Two more columns tell rows with repeated ids apart: text_hash, xxhash64 of the text, and group, a number of the
    component, null without shingles."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id") if isinstance(id_col, str) else id_col.alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    store = _Store(docs.sparkSession)
    crowded = docs.sparkSession.sparkContext.broadcast(crowded_cells(docs, words, docs.count()))
    found = store.put(_sets(docs, words, percent, orders, crowded))
    firsts = found.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    classes = found.join(firsts, ["set_id", "doc_id"]).dropDuplicates(["set_id", "doc_id"])
    classes = store.put(classes.select("doc_id", "set_id", "n_shingles", "parities", "head", F.monotonically_increasing_id().alias("key")))
    documents = store.put(found.drop("parities", "head"))
    store.drop(found)
    store.sweep()
    names = _linked(store, classes, docs, words, percent)
    own = _named(classes.select("doc_id", "set_id", "key"), names).withColumnRenamed("component", "group")
    smallest = own.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    reached = store.put(own.join(smallest, "group").select("set_id", "component_id", "group"))
    store.drop(classes)
    return documents.join(reached, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "group")
