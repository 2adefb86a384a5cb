"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles, represented by min-hash signatures whose positions
agree with probability equal to the Jaccard similarity. A run walks a random tree: every
node chooses few signature positions, by a hash of its path that all documents share, and
each document moves to one child per chosen position, named by its value there. Similar
documents share about one chosen child per level, others almost never. Small buckets are
compared by brute force; larger ones are split again. A bucket that splitting does not
shrink (boilerplate, a large group of near copies) is compared in tiles instead, so no
task ever holds more than two tiles. Runs repeat until a pair at the threshold is met
with the target recall even at the deepest level there is.

A pair that meets in several buckets is counted in the least one only, so comparisons
return link counts and spanning-forest edges per document, never pairs. Signatures decide
which documents go on to the exact comparison of their shingle sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import components, small, stored

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
POSITIONS = 128  # min-hash values of a signature
BUCKET = 256  # documents compared by brute force at once; also the side of a tile
DEPTH = 4  # deepest level; larger buckets there are compared in tiles
SLACK = 5.0  # standard deviations below the threshold that a signature may show
WORD = re.compile(r"\w+")
CACHE = 100_000
ROWS = 1000  # texts whose features a worker holds at once

FEATURES = "doc_id long, key string, h long, items binary, signature binary, brief binary"
BROADCAST, PAIR_BYTES = 48 << 20, 48  # bytes of a broadcast, and of a pair of longs in it


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the word n-grams; fewer words than n give one shingle of all of them."""
    found = WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, np.uint32)
    h = np.array(list(map(hashes.__getitem__, found)), np.uint64)
    width = min(words, len(h))
    mixed = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def _multipliers(positions: int) -> np.ndarray:
    return np.random.default_rng(20_011).integers(1, 2**63, positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(items: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Min-hash values of a non-empty set."""
    x = items.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(16))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 500_000 // len(factors))
    for at in range(0, len(x), step):
        h = x[None, at : at + step] * factors[:, None]
        least = np.minimum(least, (h ^ (h >> np.uint64(31))).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def shingle_features(docs: DataFrame, words: int = WORDS, positions: int = POSITIONS, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, key, h, items, signature, brief) of every document.

    ``key`` names the shingle set (128 bits, empty for texts without words), ``h`` is a short
    form of it for the search, where two sets under one h do no harm; ``items`` are the
    hashed shingles, ``signature`` the min-hash values, ``brief`` their low bytes.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = WordHash(), _multipliers(positions)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            keys, short, sets, signs, briefs = [], [], [], [], []
            for text in batch.column(1):
                items = shingle_set(text.as_py(), words, hashes)
                data = items.astype("<u4").tobytes()
                sign = signature(items, factors) if len(items) else np.zeros(0, np.uint32)
                keys.append(xxhash.xxh3_128_hexdigest(data) if len(items) else "")
                short.append(xxhash.xxh64_intdigest(data) - (1 << 63))
                sets.append(data)
                signs.append(sign.astype("<u4").tobytes())
                briefs.append((sign & 0xFF).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(keys, pa.string()),
                    pa.array(short, pa.int64()),
                    *[pa.array(c, pa.binary()) for c in (sets, signs, briefs)],
                ],
                ["doc_id", "key", "h", "items", "signature", "brief"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(make, FEATURES)


def jaccard_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    recall: float = RECALL,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket: int = BUCKET,
) -> DataFrame:
    """Rows (doc_id, copy_id, class_id, n_links, kept), one per row of ``docs``.

    Two documents link when the Jaccard similarity of their sets of word n-grams (lower
    case, runs of letters, digits and underscores) is at least ``threshold``. ``copy_id`` is
    the least id with the same set, ``class_id`` the least id reachable by links, ``n_links``
    the number of other documents linked directly, ``kept`` marks one document per class.
    Null, empty and wordless texts link with nothing and are their own class. Repeated
    rows count as other documents; of rows that share the least id of a class all are kept.
    """
    features = stored(shingle_features(docs, words, id_col=id_col, text_col=text_col), "ngram-features")
    full = features.where("key <> ''")
    sets = full.groupBy("key", "h").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    sets = stored(sets, "ngram-sets")
    meets = stored(_buckets(full, sets, threshold, recall, bucket), "ngram-buckets")
    links = stored(_compare(meets, full, sets, threshold), "ngram-links")
    counted = links.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(links.where("a <> root").select(F.col("a").alias("u"), F.col("root").alias("v")))
    # the root of a component is its least key; its class is the least id below it
    least = roots.join(sets, F.col("id") == F.col("key")).groupBy("root").agg(F.min("rep").alias("class_id"))
    classed = roots.join(least, "root").select("id", "class_id")
    told = (
        sets.join(counted, F.col("key") == F.col("a"), "left")
        .join(classed, F.col("key") == F.col("id"), "left")
        .select(
            F.col("key").alias("key2"),
            F.col("rep").alias("copy_id"),
            F.coalesce("class_id", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
        )
    )
    # wordless texts have no partner in `told`; a salted key keeps them from meeting in one task
    own = F.when(F.col("key") == "", F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).otherwise(F.col("key"))
    return (
        features.select("doc_id", own.alias("key"))
        .join(told, F.col("key") == F.col("key2"), "left")
        .select(
            "doc_id",
            F.coalesce("copy_id", "doc_id").alias("copy_id"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
    )


def _of_sets(features: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """(h, rep) and feature columns of the wanted sets, from the row of each one's least id.

    The join is on both, so copies don't meet in one task. While the pairs are within a bound of
    bytes they, and nothing else of the wanted rows, go to the features, which then aren't shuffled.
    """
    own = stored(wanted.select(F.col("h").alias("h2"), "rep"), "ngram-pairs")
    own = F.broadcast(own) if small(own, PAIR_BYTES, BROADCAST) else own
    at = (F.col("h") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    return features.select("doc_id", "h", *columns).join(own, at).drop("h2", "doc_id")


# ---- the tree of chosen paths ----------------------------------------------------


def survival(depth: int) -> float:
    """Least probability that a pair at the threshold still shares a path at ``depth``.

    It shares a Poisson(1) number of chosen children at every node: q(d) = 1 - exp(-q(d-1)).
    """
    q = 1.0
    for _ in range(depth):
        q = 1.0 - math.exp(-q)
    return q


def runs_needed(depth: int, recall: float) -> int:
    return math.ceil(math.log(1.0 - recall) / math.log(1.0 - survival(depth)))


def _chosen(path: int, positions: int, threshold: float) -> list[int]:
    """Signature positions that the node ``path`` chooses, each with probability 1 / (threshold * positions)."""
    draw = np.random.default_rng(path & 0xFFFFFFFFFFFFFFFF).random(positions)
    return np.flatnonzero(draw < 1.0 / (threshold * positions)).tolist()


def _child(path: int, position: int, values: np.ndarray) -> np.ndarray:
    """Path ids of the children at ``position``, one per signature value (wrapping 64-bit mix)."""
    seed = np.uint64(xxhash.xxh64_intdigest(f"{path}:{position}"))
    h = (values.astype(np.uint64) ^ seed) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _signatures(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u4").reshape(len(rows), -1)


def _split(nodes: DataFrame, threshold: float) -> DataFrame:
    """Children (path, parent, h) of nodes (path, h, signature)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = _signatures(batch.column(2))
            paths, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for path in np.unique(paths).tolist():
                own = np.flatnonzero(paths == path)
                for position in _chosen(path, signs.shape[1], threshold):
                    child = _child(path, position, signs[own, position])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(child), pa.array(np.full(len(own), path)), pa.array(h[own])], ["path", "parent", "h"]
                    )

    ordered = nodes.select("path", "h", "signature").sortWithinPartitions("path")
    return ordered.mapInArrow(split, "path long, parent long, h long")


def _roots(features: DataFrame, first: int, runs: int, threshold: float) -> DataFrame:
    """First level (path, h) of the runs numbered from ``first``, copies included."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = _signatures(batch.column(1))
            for run in range(first, first + runs):
                for position in _chosen(run, signs.shape[1], threshold):
                    child = _child(run, position, signs[:, position])
                    yield pa.RecordBatch.from_arrays([pa.array(child), batch.column(0)], ["path", "h"])

    return features.select("h", "signature").mapInArrow(split, "path long, h long")


def _buckets(features: DataFrame, sets: DataFrame, threshold: float, recall: float, bucket: int) -> DataFrame:
    """(path, tiles, h): the buckets to compare, in ``tiles`` tiles each.

    There are as many runs as the recall takes at the deepest level, whatever the size of the
    corpus, so a document stands in as many nodes in a large one as in a small one.
    """
    out = None
    level = _roots(features, 0, runs_needed(DEPTH, recall), threshold).distinct().withColumn("parent", F.lit(None).cast("long"))
    parents = None
    for depth in range(1, DEPTH + 1):
        level = stored(level, "ngram-level")
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("parent").alias("parent")).where("size > 1")
        if parents is None:
            sizes = sizes.withColumn("stuck", F.lit(False))
        else:  # splitting that leaves more than half of a bucket together doesn't help
            sizes = sizes.join(parents, "parent", "left").withColumn("stuck", F.col("size") * 2 > F.col("parent_size"))
        sizes = stored(sizes.select("path", "size", "stuck"), "ngram-sizes")
        last = F.col("stuck") | (F.col("size") <= bucket) | F.lit(depth == DEPTH)
        here = sizes.where(last).select("path", F.ceil(F.col("size") / F.lit(bucket)).cast("int").alias("tiles"))
        rows = level.join(here, "path").select("path", "tiles", "h")
        out = rows if out is None else out.union(rows)
        deeper = sizes.where(~last)
        if deeper.isEmpty():
            break
        parents = deeper.select(F.col("path").alias("parent"), F.col("size").alias("parent_size"))
        going = stored(level.join(deeper.select("path"), "path").select("path", "h"), "ngram-going")
        signed = _of_sets(features, sets.join(going.select("h").distinct(), "h").select("h", "rep"), "signature")
        level = _split(going.join(signed.drop("rep"), "h"), threshold).distinct()
    return out


# ---- comparison ------------------------------------------------------------------


def _compare(meets: DataFrame, features: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, links, root) from all buckets."""
    # a set stands in few buckets: some per run and level
    placed = stored(meets.groupBy("h").agg(F.collect_list(F.struct("path", "tiles")).alias("places")), "ngram-places")
    briefs = _of_sets(features, sets.join(placed.select("h"), "h").select("h", "rep"), "brief")
    dealt = _tiled(placed.join(briefs.drop("rep"), "h"), "brief")
    agree = max(0, math.floor(POSITIONS * threshold - SLACK * math.sqrt(POSITIONS * threshold * (1 - threshold))))
    near = stored(_in_groups(dealt, "brief", _candidates(agree), "path long, i int, j int, t int, h long"), "ngram-near")
    groups = near.distinct().groupBy("h").agg(F.collect_list(F.struct("path", "i", "j", "t")).alias("groups"))
    paths = placed.select("h", F.transform("places", lambda p: p["path"]).alias("paths"))
    wanted = stored(sets.join(groups, "h").join(paths, "h"), "ngram-wanted").drop("key")
    found = _of_sets(features, wanted, "key", "items").withColumnsRenamed({"h": "h2", "rep": "rep2"})
    exact = found.join(wanted, (F.col("h") == F.col("h2")) & F.col("rep").eqNullSafe(F.col("rep2"))).withColumn("g", F.explode("groups"))
    exact = exact.select("g.*", "h", "paths", "items", "n", "key")
    return _in_groups(exact, "items", _verified(threshold), "a string, links long, root string", "n", "key")


def _tiled(rows: DataFrame, payload: str) -> DataFrame:
    """Each row goes to every bucket it has a place in, there to the pairs of tiles (i <= j) that hold its own tile t."""
    each = rows.select("h", F.transform("places", lambda p: p["path"]).alias("paths"), payload, F.explode("places").alias("p"))
    own = each.withColumn("t", F.pmod(F.xxhash64("h"), F.col("p.tiles")).cast("int"))
    return own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("p.tiles") - 1))).select(
        F.col("p.path").alias("path"), F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "h", "paths", payload
    )


def _in_groups(rows: DataFrame, payload: str, work, shape: str, *more: str) -> DataFrame:
    """Apply ``work`` to whole groups of (path, i, j), many small groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            path, i, j = (table.column(k).to_numpy() for k in range(3))
            cut = int(np.flatnonzero((path == path[-1]) & (i == i[-1]) & (j == j[-1]))[0])  # the last group may go on
            if cut:
                yield from work(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from work(held.combine_chunks())

    keys = ["path", "i", "j"]
    placed = rows.select(*keys, "t", "h", "paths", payload, *more).repartition(*keys).sortWithinPartitions(*keys, "h")
    return placed.mapInArrow(run, shape)


def _groups(table: pa.Table) -> list[tuple[int, int]]:
    keys = [table.column(k).to_numpy() for k in range(3)]
    change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    edges = [0, *change.tolist(), table.num_rows]
    return list(zip(edges, edges[1:], strict=False))


def _first_meeting(paths: list, path: int) -> np.ndarray:
    """For the rows of one group: whether two of them meet in no bucket less than this one."""
    lower = [[p for p in row if p < path] for row in paths]
    names = {p: k for k, p in enumerate(sorted({p for row in lower for p in row}))}
    seen = np.zeros((len(paths), max(1, len(names))), np.float32)
    for k, row in enumerate(lower):
        seen[k, [names[p] for p in row]] = 1
    return seen @ seen.T == 0


def _pairs(table: pa.Table, a: int, b: int) -> np.ndarray:
    """Mask of the pairs of one group that this pair of tiles is the one to compare."""
    h = table.column(4).slice(a, b - a).to_numpy()
    tile = table.column(3).slice(a, b - a).to_numpy()
    i, j, path = (table.column(k)[a].as_py() for k in (1, 2, 0))
    ours = np.triu(np.ones((b - a, b - a), bool), 1)
    if i != j:
        ours &= tile[:, None] != tile[None, :]
    again = np.flatnonzero(h[1:] == h[:-1]) + 1  # a set that stands twice (repeated rows) doesn't meet itself
    ours[again, :] = ours[:, again] = False
    return ours & _first_meeting(table.column(5).slice(a, b - a).to_pylist(), path)


def _candidates(agree: int):
    """Rows of which a pair's signatures agree in at least ``agree`` positions."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = table.column(6).to_pylist()
        signs = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        keep = np.zeros(table.num_rows, bool)
        for a, b in _groups(table):
            n = b - a
            if n < 2:
                continue
            own = signs[a:b]
            alike = np.zeros((n, n), np.int16)
            for k in range(n - 1):
                alike[k, k + 1 :] = (own[k + 1 :] == own[k]).sum(axis=1)
            alike = alike >= agree
            if alike.any():
                alike &= _pairs(table, a, b)
                keep[a:b] = alike.any(axis=0) | alike.any(axis=1)
        if keep.any():
            chosen = table.select(["path", "i", "j", "t", "h"]).take(pa.array(np.flatnonzero(keep)))
            yield from chosen.combine_chunks().to_batches()

    return work


def _verified(threshold: float):
    """Exact links within groups."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        out_keys, out_links, out_roots = [], [], []
        for a, b in _groups(table):
            if b - a < 2:
                continue
            sets = [np.frombuffer(x, "<u4") for x in table.column(6).slice(a, b - a).to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            shared = _intersections(sets)
            union = size[:, None] + size[None, :] - shared
            # shared / union >= threshold, with the quotient as any reader would compute it
            hit = (shared / np.maximum(union, 1) >= threshold) & _pairs(table, a, b)
            hit = hit | hit.T
            n = table.column(7).slice(a, b - a).to_numpy()
            links = hit @ n
            keys = table.column(8).slice(a, b - a).to_pylist()
            for k, root in _forest(hit, keys):
                out_keys.append(keys[k])
                out_links.append(int(links[k]))
                out_roots.append(root)
        if out_keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_keys, pa.string()), pa.array(out_links, pa.int64()), pa.array(out_roots, pa.string())],
                ["a", "links", "root"],
            )

    return work


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, in blocks of shared items."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), common], [common, len(sets[1])]], np.int64)
    items, row = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(items, kind="stable")
    items, row = items[order], row[order]
    fresh = np.r_[True, items[1:] != items[:-1]]
    item = np.cumsum(fresh) - 1
    count = np.bincount(item)
    many = count[item] > 1  # an item of one set alone adds to no pair
    item, row = item[many], row[many]
    shared = np.zeros((n, n), np.float32)
    if len(item):
        _, item = np.unique(item, return_inverse=True)
        step = 8192
        for at in range(0, int(item.max()) + 1, step):
            own = (item >= at) & (item < at + step)
            block = np.zeros((n, step), np.float32)
            block[row[own], item[own] - at] = 1
            shared += block @ block.T  # whole numbers below 2**24 are exact
    return shared.astype(np.int64)


def _forest(hit: np.ndarray, keys: list[str]) -> Iterator[tuple[int, str]]:
    """(row, least key of its component) for every row with a link."""
    left = set(np.flatnonzero(hit.any(axis=0)).tolist())
    while left:
        stack, seen = [left.pop()], []
        while stack:
            k = stack.pop()
            seen.append(k)
            new = left.intersection(np.flatnonzero(hit[k]).tolist())
            left -= new
            stack.extend(new)
        root = min(keys[k] for k in seen)
        yield from ((k, root) for k in seen)
