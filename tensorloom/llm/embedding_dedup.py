"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are scaled to unit length and quantised to int8 with one scale each; the length
of the quantisation error is kept per vector. For two vectors the cosine differs from the
scaled integer product by at most (1 + e1) * e2 + e1, so a tile product in exact integer
arithmetic proves most pairs below the threshold. Only the others are recomputed in
double precision.

Equal vectors of one label are compared once and counted. The others of a label are dealt
into tiles; each pair of tiles is one unit of work that returns link counts and the edges
of a spanning forest, never pairs, so nothing grows with the square of a group but the
arithmetic itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import components, stored

TILE = 1024
THRESHOLD = 0.98
EXACT = 1024  # dimensions summed at once: 1024 * 127 * 127 < 2^24


def dedup_embeddings(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    tile: int = TILE,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``vectors``.

    Vectors link when their labels are equal and not null, their sizes are equal and their
    cosine in double precision is at least ``threshold``. Null or zero vectors and those
    with null or non-finite components link with nothing: no links, own component, kept.
    Repeated rows count as other vectors with the same id, and so do different vectors under
    one id: their links and components are their own. A row without an id counts as a vector
    like any other, but names no component: ``component_id`` is the least id there is in it,
    null if none; of a component without ids all rows are kept. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    usable = (
        F.col("label").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", real)
        & F.exists("vector", lambda x: x != F.lit(0.0))
    )
    rows = rows.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    # one representative per distinct vector of a label
    # a vertex is a vector of a label, named by two hashes of 64 bits
    name = F.concat(*[F.hex(F.xxhash64(F.lit(s), "label", "vector")) for s in (1, 2)])
    rows = rows.withColumn("key", F.when(F.col("_ok"), name))
    groups = rows.where("_ok").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    groups = stored(groups, "vec-groups")
    found = stored(_tile_pairs(groups, threshold, tile), "vec-links")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("a <> root").select(F.col("a").alias("u"), F.col("root").alias("v")))
    # the root of a component is its least key; its name is the least id below it
    least = roots.join(groups.select("key", "rep"), F.col("id") == F.col("key")).groupBy("root").agg(F.min("rep").alias("named"))
    told = (
        groups.select("key", "rep", "n")
        .join(links, F.col("key") == F.col("a"), "left")
        .join(roots.join(least, "root"), F.col("key") == F.col("id"), "left")
        .select(
            F.col("key").alias("key2"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
            F.coalesce("named", "rep").alias("component_id"),
        )
    )
    linked = rows.where("_ok").select("vec_id", "key").join(told, F.col("key") == F.col("key2"))
    rest = rows.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        linked.select("vec_id", "n_links", "component_id")
        .union(rest)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def _tile_pairs(groups: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(a, links, root): link counts per vector and pair of tiles, and its root in their forest."""
    sized = groups.withColumn("dim", F.size("vector"))
    counts = sized.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles"))
    dealt = sized.join(counts, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    # each tile goes to the pairs (i <= j) it is part of
    spread = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label",
        "dim",
        F.least("t", "o").alias("i"),
        F.greatest("t", "o").alias("j"),
        "t",
        "key",
        "n",
        "vector",
    )
    shape = "a string, links long, root string"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            keys, side = group.column(5).to_pylist(), group.column(4).to_numpy()
            n = group.column(6).to_numpy()
            x = np.stack([np.asarray(v.values, dtype=np.float64) for v in group.column(7)])
            i, j = group.column(2)[0].as_py(), group.column(3)[0].as_py()
            a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
            yield from _links(keys, n, x, a, b, i == j, threshold)

    placed = spread.repartition("label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j", "key")
    return placed.mapInArrow(compare, shape)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows with equal first four columns, which arrive together."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(k[a] for k in keys)
            if key != last and held:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
            last = key
    if held:
        yield pa.concat_tables(held).combine_chunks()


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(integers in float32, scale, length of the error) of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q.astype(np.float32), scale, error * (1 + 1e-9) + 1e-12


def possible_pairs(qa, qb, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine may reach the threshold."""
    (a, sa, ea), (b, sb, eb) = qa, qb
    # sums of EXACT products of integers up to 127 stay below 2^24, so float32 holds them exactly
    whole = sum(
        (a[:, k : k + EXACT] @ b[:, k : k + EXACT].T).astype(np.float64 if a.shape[1] > EXACT else np.float32)
        for k in range(0, a.shape[1], EXACT)
    )
    product = (whole * (sa[:, None] * sb[None, :])).astype(np.float32)
    # slack of the scaling in float32 on top of the quantisation bound
    bound = ((1 + ea)[:, None] * eb[None, :] + ea[:, None] + 1e-6).astype(np.float32)
    return np.nonzero(product + bound >= threshold)


def _links(keys, n, x, a, b, same: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    norm = np.sqrt((x * x).sum(axis=1))
    safe = np.where((norm > 0) & np.isfinite(norm), norm, 1.0)
    big = np.abs(x).max(axis=1)
    scaled = x / big[:, None]  # keeps tiny and huge vectors inside the double range
    unit = scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]
    q = quantise(unit)
    step = 1024
    parent: dict[int, int] = {}
    total = np.zeros(len(x), np.int64)

    def root(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = k = parent[parent[k]]
        return k

    for lo in range(0, len(a), step):
        rows = a[lo : lo + step]
        for lo2 in range(0, len(b), step):
            columns = b[lo2 : lo2 + step]
            r, c = possible_pairs([v[rows] for v in q], [v[columns] for v in q], threshold)
            r, c = rows[r], columns[c]
            if same:
                keep = r < c
                r, c = r[keep], c[keep]
            for at in range(0, len(r), 65536):
                u, v = r[at : at + 65536], c[at : at + 65536]
                plain = (norm[u] == safe[u]) & (norm[v] == safe[v])
                cosine = np.where(
                    plain,
                    np.einsum("ij,ij->i", x[u], x[v]) / (safe[u] * safe[v]),
                    np.einsum("ij,ij->i", unit[u], unit[v]),
                )
                hit = cosine >= threshold
                u, v = u[hit], v[hit]
                np.add.at(total, u, n[v])
                np.add.at(total, v, n[u])
                for p, o in zip(u.tolist(), v.tolist(), strict=True):
                    p, o = root(p), root(o)
                    if p != o:
                        parent[max(p, o)] = min(p, o)
    linked = np.flatnonzero(total)
    if len(linked):
        own = [keys[k] for k in linked.tolist()]
        roots = [keys[root(k)] for k in linked.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.string()), pa.array(total[linked]), pa.array(roots, pa.string())], ["a", "links", "root"]
        )
