"""Nearest neighbours by collision counting over query-centred windows.

Unit vectors are projected on random directions; an index is one sorted array per
direction. A query opens a window of half width ``radius * WIDTH / 2`` around its own
place in every array; an object collides as often as it stands in a window. Virtual
rehashing widens the same windows instead of building coarser tables, so every step counts
only the places that are new. Objects with enough collisions are verified by their exact
cosine. A vector at distance ``radius`` stands in a window with a known probability, so
the threshold is set where it misses one such vector in ``1 / MISS``; a query is done when
its k-th best verified distance is within the radius. That rule knows nothing of the
data: recall holds on hard data too, at the price of more verified objects there.

Equal vectors are one object with its least ids. Objects are dealt into blocks of bounded
size, each with its own index; every block answers all queries, streamed past it in
batches, with its best few. Only those are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import stored
from tensorloom.session import shuffle_width

NEAREST = 5
EVERY = 50  # rows whose id is divisible by it are queries
DIRECTIONS = 64
WIDTH = 2.2
MISS = 0.01  # share of true neighbours that the collision threshold may miss
GROWTH = 1.25  # of the radius per step
LEAST_RADIUS = 0.05
BLOCK_BYTES = 64 << 20  # of a block's vectors in double precision
BLOCK_ROWS = 65_536
LEAST_ROWS = 256


def collision_threshold(directions: int = DIRECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """Collisions that a vector within the radius reaches with probability 1 - ``miss`` at least."""
    p = 1 - 2 * NormalDist().cdf(-width / 2)
    tail, k = 0.0, 0
    while tail + math.comb(directions, k) * p**k * (1 - p) ** (directions - k) <= miss:
        tail += math.comb(directions, k) * p**k * (1 - p) ** (directions - k)
        k += 1
    return max(k, 1)


def radii() -> np.ndarray:
    """The widths of virtual rehashing; the last one holds everything."""
    steps = math.ceil(math.log(2 / LEAST_RADIUS) / math.log(GROWTH))
    return np.array([LEAST_RADIUS * GROWTH**k for k in range(steps)] + [math.inf])


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaling by the largest component first keeps tiny and huge ones in range."""
    scaled = x / np.abs(x).max(axis=1)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


class SortedProjections:
    """One sorted array per direction over a block of vectors (rows of doubles)."""

    def __init__(self, x: np.ndarray, directions: int = DIRECTIONS) -> None:
        self.x, self.unit = x, unit_rows(x)
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.axes = np.random.default_rng(13).normal(size=(x.shape[1], directions))
        places = (self.unit @ self.axes).T
        self.order = np.argsort(places, axis=1, kind="stable")
        self.values = np.take_along_axis(places, self.order, axis=1)

    def windows(self, unit: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of each query's window in every array: [direction, query]."""
        if math.isinf(half):
            shape = (len(self.values), len(unit))
            return np.zeros(shape, np.int64), np.full(shape, self.values.shape[1])
        centre = (unit @ self.axes).T
        ends = [
            (np.searchsorted(v, c - half, "left"), np.searchsorted(v, c + half, "right"))
            for v, c in zip(self.values, centre, strict=True)
        ]
        return np.stack([e[0] for e in ends]), np.stack([e[1] for e in ends])

    def cosines(self, y: np.ndarray, y_unit: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Cosines in double precision of ``y`` with the given rows, from the vectors as they are."""
        scale = self.norm[rows] * math.sqrt(float(y @ y))
        plain = (scale > 0) & np.isfinite(scale)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            return np.where(plain, (self.x[rows] @ y) / scale, self.unit[rows] @ y_unit)

    def search(self, queries: np.ndarray, k: int, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows verified and their cosines; holds the k nearest but for missed ones."""
        steps, n = radii(), self.values.shape[1]
        unit = unit_rows(queries)
        bounds = [self.windows(unit, r * WIDTH / 2) for r in steps]
        held = np.stack([(hi - lo).sum(axis=0) for lo, hi in bounds])
        # earlier, windows hold too little to be worth a step of their own
        first = np.argmax(held * 16 >= n * len(self.values), axis=0)
        for q in range(len(queries)):
            lo, hi = (b[:, q] for b in bounds[first[q]])
            counts = np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, lo, hi, strict=True)]), minlength=n)
            rows, scores = np.zeros(0, np.int64), np.zeros(0)
            for step in range(first[q], len(steps)):
                if step > first[q]:
                    wider_lo, wider_hi = (b[:, q] for b in bounds[step])
                    fresh = [o[a:b] for o, a, b in zip(self.order, wider_lo, lo, strict=True)]
                    fresh += [o[a:b] for o, a, b in zip(self.order, hi, wider_hi, strict=True)]
                    counts += np.bincount(np.concatenate(fresh), minlength=n)
                    lo, hi = wider_lo, wider_hi
                met = np.flatnonzero(counts >= threshold)
                if len(met):
                    counts[met] = np.iinfo(np.int32).min  # verified once
                    rows = np.concatenate([rows, met])
                    scores = np.concatenate([scores, self.cosines(queries[q], unit[q], met)])
                if len(scores) >= k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    if 2 - 2 * least <= steps[step] ** 2:
                        break
            yield rows, scores


def nearest_neighbours(
    vectors: DataFrame,
    k: int = NEAREST,
    *,
    every: int = EVERY,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` vectors found nearest to each query by cosine.

    Queries are the rows whose id is divisible by ``every``, candidates all rows of other ids
    with as many components. Nearest first, ties to the smaller id; a query with fewer
    candidates gets all of them, one without any no row. Null and zero vectors, those with
    null or non-finite components and rows without an id take no part. Rows that repeat an id
    and its vector count once; one id with several vectors is several candidates and several
    queries. Other columns are ignored.
    """
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    usable = F.forall("vector", real) & F.exists("vector", lambda x: x != F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(usable)
    key = F.concat(*[F.lower(F.lpad(F.hex(F.xxhash64(F.lit(s), "vector")), 16, "0")) for s in (1, 2)])
    rows = rows.withColumn("key", key)
    # equal vectors are one object: its least ids, one more than wanted as a query's own may be among them
    within = Window.partitionBy("key").orderBy("vec_id")
    least = rows.dropDuplicates(["vec_id", "key"]).withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= k + 1)
    objects = least.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    objects = stored(objects.withColumn("dim", F.size("vector")), "ann-objects")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "key"])
    asked = stored(asked.withColumn("dim", F.size("vector")), "ann-queries")
    best = stored(_answers(objects, asked.dropDuplicates(["key"]), k, block_rows, least_rows), "ann-best")

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    listed = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("found"))
    other = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    told = asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")).join(listed, "query")
    return told.select("query_id", F.posexplode(other).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def _answers(objects: DataFrame, queries: DataFrame, k: int, block_rows: int, least_rows: int) -> DataFrame:
    """(query, vec_id, score): the k + 1 best ids of every block for every query."""
    width = F.lit(shuffle_width(objects.sparkSession))
    most = F.least(F.lit(block_rows), F.greatest(F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))), F.lit(1)))
    # as many blocks as the session plans tasks, but none too large for a task or too small for an index
    needed = F.greatest(F.ceil(F.col("n") / most), F.least(width, F.ceil(F.col("n") / F.lit(least_rows))))
    blocks = objects.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", needed.cast("int").alias("blocks"))
    dealt = objects.join(blocks, "dim")
    place = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    own = dealt.select("dim", place.alias("block"), F.lit(0).alias("asks"), "key", "ids", "vector")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    none = F.expr("cast(array() as array<long>)")
    asked = queries.join(blocks, "dim").select(
        "dim", everywhere.alias("block"), F.lit(1).alias("asks"), "key", none.alias("ids"), "vector"
    )
    placed = own.union(asked).repartition("dim", "block").sortWithinPartitions("dim", "block", "asks", "key")
    threshold = collision_threshold()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, ids = None, None, None
        held: list[pa.RecordBatch] = []
        for part in _runs(batches):
            head = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
            if part.column(2)[0].as_py() == 0:
                held = [*held, part] if at == head else [part]
                at, index = head, None
                continue
            if index is None:  # a block's objects come before its queries
                index = SortedProjections(np.concatenate([_matrix(b.column(5)) for b in held]))
                ids = [x for b in held for x in b.column(4).to_pylist()]
                held = []
            for lo in range(0, part.num_rows, 256):
                yield _best(index, ids, part.slice(lo, 256), k, threshold)

    return placed.mapInArrow(answer, "query string, vec_id long, score double")


def _best(index: SortedProjections, ids: list, asked: pa.RecordBatch, k: int, threshold: int) -> pa.RecordBatch:
    keys, out, names, scores = asked.column(3).to_pylist(), [], [], []
    for key, (rows, found) in zip(keys, index.search(_matrix(asked.column(5)), k + 1, threshold), strict=True):
        # all objects as good as the last one wanted: ties are settled by id
        if len(found) > k + 1:
            keep = found >= np.partition(found, len(found) - k - 1)[len(found) - k - 1]
            rows, found = rows[keep], found[keep]
        each = sorted((-s, i) for r, s in zip(rows.tolist(), found.tolist(), strict=True) for i in ids[r])[: k + 1]
        out += [key] * len(each)
        names += [i for _, i in each]
        scores += [-s for s, _ in each]
    return pa.RecordBatch.from_arrays(
        [pa.array(out, pa.string()), pa.array(names, pa.int64()), pa.array(scores, pa.float64())], ["query", "vec_id", "score"]
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with equal (dim, block, asks)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in range(3)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
