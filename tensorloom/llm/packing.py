"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

Pieces of equal length are interchangeable, so a packing is a multiset of *bins* (which
lengths share a sequence) with a multiplicity each. The search therefore works on the
histogram of piece lengths, whose size is bounded by the sequence length whatever the
number of documents, and its result is exact for all of them at once.

Islands, one Spark task each, evolve populations of packings: crossover injects whole
well-filled bins of one parent into the other, takes out bins that now hold pieces twice,
and places the displaced pieces by best fit. Between epochs every island sends its elite
to the next one. Seeds are fixed, so a lost task repeats the same evolution.

Placement numbers the pieces of each length (spread over hash buckets, so a length that
a third of all pieces share is no single task) and reads sequence and offset from the
chosen bins by binary search.
"""

from __future__ import annotations

import base64
import os
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import stored
from tensorloom.session import shuffle_width

LENGTH = 1024
END_ID = 2
#: the pre-tokenizer of byte-level BPE vocabularies of this family (fixed value)
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: the rank library fails on a million white-space characters in a row (its pattern looks ahead
#: there); far shorter runs count, each tried from its first character only
WIDE = 100_000
WIDE_GAP = re.compile(rf"(?<!\s)\s{{{WIDE}}}")

BLURS = (0.0, 0.2, 0.5, 0.8)  # how far mutations stray from the order of lengths
WORK = 20_000  # bins placed by an island in an epoch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class DocumentIds:
    """Token ids of whole texts.

    A file of the same vocabulary as ranks (``ranks``) lets the faster library encode; texts
    that hold a special token's string or a very long run of white space, and all texts if
    there is no such file, go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks is not None:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        wide = len(text) >= WIDE and WIDE_GAP.search(text)
        if self.fast is None or wide or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


@lru_cache(maxsize=2)
def document_ids(path: str, ranks: str | None) -> DocumentIds:
    """One per worker, kept over its tasks."""
    return DocumentIds(path, ranks)


def ranks_beside(path: str) -> str | None:
    """The rank file of the same name, if there is one."""
    ranks = path.removesuffix(".json") + ".tiktoken"
    return ranks if os.path.exists(ranks) else None


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, *, length: int = LENGTH, id_col="doc_id", text_col="text") -> DataFrame:
    """Token pieces (doc_id, piece, start, length, ids_crc32) of every document.

    A document is its ids and the end id. Longer ones are cut into pieces of ``length``
    counted from the end, so only the first piece may be shorter. Null texts are empty and
    give one piece, the end id. Ids may be null or repeat; other columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = document_ids(path, ranks_beside(path))
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                n = len(ids)
                edges = [0, *range((n - 1) % length + 1, n + 1, length)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    *,
    length: int = LENGTH,
    islands: int = 4,
    epochs: int = 3,
    population: int = 16,
    generations: int | None = None,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces with (sequence_id, offset): every sequence is filled from 0 without gaps, to ``length`` at most.

    ``generations`` is the number of children that an island makes in an epoch, by default as
    many as a fixed budget of placed bins allows; a search that reaches the lower bound of
    :func:`least_sequences` ends at once.

    See :func:`cut_pieces` for nulls and repeats; an empty table gives no rows.
    """
    pieces = stored(cut_pieces(docs, tokenizer, length=length, id_col=id_col, text_col=text_col), "pack-pieces")
    plan = evolve_packing(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), length, islands, epochs, population, generations, seed)
    return place_pieces(pieces, plan)


# ---- the search on the histogram -------------------------------------------------

Bins = dict[tuple[int, ...], int]  # descending lengths of one sequence -> how many such sequences


def best_fit(bins: Bins, free: dict[int, int], length: int, rng: random.Random | None = None, blur: float = 0.0) -> Bins:
    """Place ``free`` (length -> count) by best fit, into ``bins`` first.

    Pieces go to the fullest bin that takes them; equal bins are filled together. Longer
    pieces go first; ``blur`` lets shorter ones overtake those up to that share longer.
    """
    rooms: dict[int, list[list]] = {}
    for pattern, n in bins.items():
        rooms.setdefault(length - sum(pattern), []).append([pattern, n])
    order = {s: s * rng.uniform(1 - blur, 1) if rng and blur else s for s in sorted(free)}
    for size in sorted(order, key=lambda s: (-order[s], -s)):
        left = free[size]
        for room in sorted(r for r in rooms if r >= size):
            stack = rooms[room]
            while left and stack:
                pattern, n = stack.pop()
                each = room // size
                take = min(n, left // each)
                if take:
                    grown = tuple(sorted((*pattern, *[size] * each), reverse=True))
                    rooms.setdefault(room - each * size, []).append([grown, take])
                    left -= take * each
                    n -= take
                if n and left:  # fewer pieces than one bin takes
                    grown = tuple(sorted((*pattern, *[size] * left), reverse=True))
                    rooms.setdefault(room - left * size, []).append([grown, 1])
                    left, n = 0, n - 1
                if n:
                    stack.append([pattern, n])
            if not left:
                break
        each = length // size
        if left >= each:
            rooms.setdefault(length - each * size, []).append([(size,) * each, left // each])
            left %= each
        if left:
            rooms.setdefault(length - left * size, []).append([(size,) * left, 1])
    out: Bins = {}
    for stack in rooms.values():
        for pattern, n in stack:
            out[pattern] = out.get(pattern, 0) + n
    return out


def cross(giver: Bins, taker: Bins, length: int, rng: random.Random) -> Bins:
    """Inject well-filled bins of ``giver`` into ``taker``; re-place what they displace."""
    floor = length * rng.uniform(0.97, 1.0)
    gift: Bins = {}
    for p, n in giver.items():
        if sum(p) >= floor and rng.random() < 0.5:
            gift[p] = max(1, round(n * rng.uniform(0.3, 1.0)))
    owed: dict[int, int] = {}
    for p, n in gift.items():
        for size in p:
            owed[size] = owed.get(size, 0) + n
    kept: Bins = {}
    free: dict[int, int] = {}
    order = sorted(taker.items(), key=lambda x: (sum(x[0]), rng.random()))  # the emptiest go first
    for p, n in order:
        hit = max((-(-owed.get(s, 0) // p.count(s)) for s in set(p)), default=0)
        gone = min(n, hit)
        if gone:
            for size in p:  # pieces the gift holds are duplicates, the others are displaced
                dup = min(gone, owed.get(size, 0))
                if dup:
                    owed[size] -= dup
                if gone > dup:
                    free[size] = free.get(size, 0) + gone - dup
        if n > gone:
            kept[p] = n - gone
    for p, n in gift.items():
        kept[p] = kept.get(p, 0) + n
    return best_fit(kept, free, length, rng, rng.choice(BLURS))


def mutate(bins: Bins, length: int, rng: random.Random) -> Bins:
    """Open the emptiest bins and some others, and place their pieces anew."""
    kept: Bins = {}
    free: dict[int, int] = {}
    emptiest = set(sorted(bins, key=sum)[: max(2, len(bins) // 20)])
    opened = rng.choice((0.1, 0.3, 0.6))
    for p, n in bins.items():
        gone = n if p in emptiest else (rng.randint(0, n) if rng.random() < opened else 0)
        for size in p if gone else ():
            free[size] = free.get(size, 0) + gone
        if n > gone:
            kept[p] = n - gone
    return best_fit(kept, free, length, rng, rng.choice(BLURS))


def fitness(bins: Bins, length: int) -> tuple:
    """Fewest sequences first, then the fullest bins (sum of squared fill)."""
    count = sum(bins.values())
    return count, -sum(n * sum(p) ** 2 for p, n in bins.items())


def least_sequences(histogram: dict[int, int], length: int) -> int:
    """A lower bound of the number of sequences, tighter than tokens over length.

    For any limit k up to half a sequence: pieces longer than ``length - k`` stand alone, no two of
    those longer than half share one, and what pieces of k and more don't find room for beside the
    latter needs sequences of its own.
    """
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    best = -(-int((sizes * counts).sum()) // length) if len(sizes) else 0
    halves = sizes * 2 > length
    for k in [0, *sizes[sizes * 2 <= length].tolist()]:
        alone = sizes > length - k
        middle = halves & ~alone
        few = ~halves & (sizes >= k)
        taken = (sizes * counts)[middle | few].sum() - counts[middle].sum() * length
        best = max(best, int(counts[alone | middle].sum()) + max(0, -(-int(taken) // length)))
    return best


def generations_for(bins: int) -> int:
    """Children of an island and epoch: a budget of bins placed, so small searches are long ones."""
    return min(max(WORK // max(bins, 1), 24), 1200)


def _evolve(histogram: dict[int, int], start: list[Bins], length: int, population: int, generations: int | None, rng: random.Random) -> list[Bins]:
    found = list(start) or [best_fit({}, histogram, length)]
    while len(found) < population:
        found.append(mutate(found[rng.randrange(len(found))], length, rng))
    pool = sorted(((fitness(b, length), b) for b in found), key=lambda x: x[0])
    least = least_sequences(histogram, length)
    for _ in range(generations if generations is not None else generations_for(len(pool[0][1]))):
        if pool[0][0][0] <= least:  # as few as there can be: nothing to gain
            break
        a, b = sorted(rng.sample(range(len(pool)), 2))
        child = cross(pool[a][1], pool[b][1], length, rng)
        if rng.random() < 0.5:
            child = mutate(child, length, rng)
        worth = fitness(child, length)
        if worth < pool[-1][0]:
            pool[-1] = (worth, child)
            pool.sort(key=lambda x: x[0])
    return [b for _, b in pool[:population]]


def evolve_packing(histogram: DataFrame, length: int, islands: int, epochs: int, population: int, generations: int | None, seed: int) -> DataFrame:
    """Bins (pattern array<int>, n) of the best packing over all islands; ``histogram`` has (length, n).

    A histogram has ``length`` rows at most and a population a few thousand bins; both are
    the same for any number of documents.
    """
    spark = histogram.sparkSession
    shape = "island int, member int, pattern array<int>, n long"
    # at most `length` pairs of numbers
    sizes = {r["length"]: r["n"] for r in histogram.collect()}

    def epoch(number: int):
        def grow(frame: pd.DataFrame) -> pd.DataFrame:
            island = int(frame["island"].iloc[0])
            start: dict[int, Bins] = {}
            for member, pattern, n in zip(frame["member"], frame["pattern"], frame["n"], strict=True):
                if len(pattern):
                    start.setdefault(int(member), {})[tuple(int(x) for x in pattern)] = int(n)
            rng = random.Random(seed * 1_000_003 + number * 1009 + island)
            pool = _evolve(sizes, [start[m] for m in sorted(start)], length, population, generations, rng)
            return pd.DataFrame(
                [(island, m, list(p), n) for m, bins in enumerate(pool) for p, n in bins.items()],
                columns=["island", "member", "pattern", "n"],
            )

        return grow

    if not sizes:
        return spark.createDataFrame([], "pattern array<int>, n long")
    now = spark.range(islands).select(
        F.col("id").cast("int").alias("island"), F.lit(0).alias("member"), F.expr("cast(array() as array<int>)").alias("pattern"), F.lit(0).cast("long").alias("n")
    )
    for number in range(epochs):
        now = stored(now.groupBy("island").applyInPandas(epoch(number), shape), "pack-epoch")
        if number + 1 < epochs:  # every elite also starts on the next island
            elite = now.where("member = 0").select(
                F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.lit(population).alias("member"), "pattern", "n"
            )
            now = now.union(elite)
    filled = F.aggregate("pattern", F.lit(0), lambda a, x: a + x).cast("long")
    best = now.groupBy("island", "member").agg(F.sum("n").alias("count"), F.sum(F.col("n") * filled * filled).alias("square"))
    best = best.orderBy("count", F.desc("square"), "island", "member").limit(1).select("island", "member")
    return now.join(F.broadcast(best), ["island", "member"]).select("pattern", "n")


def place_pieces(pieces: DataFrame, plan: DataFrame) -> DataFrame:
    """Give every piece a place in a bin of its length."""
    slots = _slots(plan.collect())  # bins of one packing: bounded by the histogram, not by the documents
    spread = shuffle_width(pieces.sparkSession)
    cut = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)).cast("int"))
    counts = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")
    number = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = (
        cut.withColumn("_rn", number)
        .join(counts.select("length", "_part", before.alias("_start")), ["length", "_part"])
        .withColumn("_rank", (F.col("_start") + F.col("_rn")).cast("long"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                own = size == s
                first, each, base, at = slots[int(s)]
                k = np.searchsorted(first, rank[own], "right") - 1
                inner = rank[own] - first[k]
                sequence[own] = base[k] + inner // each[k]
                offset[own] = at[k] + inner % each[k] * s
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(
        place, PIECES + ", sequence_id long, offset long"
    )


def _slots(plan: list) -> dict[int, tuple]:
    """Per length: first rank, pieces per bin, first sequence and offset of its run of equal bins."""
    runs: dict[int, list] = {}
    base = 0
    for row in sorted(plan, key=lambda r: tuple(r["pattern"])):
        pattern, at = tuple(row["pattern"]), 0
        for size in dict.fromkeys(pattern):
            each = pattern.count(size)
            runs.setdefault(size, []).append((row["n"] * each, each, base, at))
            at += each * size
        base += row["n"]
    out = {}
    for size, rows in runs.items():
        total, each, start, at = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        out[size] = (np.cumsum(total) - total, each, start, at)
    return out
