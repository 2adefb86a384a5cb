"""Sharding by a minimax contiguous partition of atomic groups.

Equal texts form one group, which no cut divides. Groups are ordered by the digest of
their text; groups larger than an even share stand first and get a shard each, as any
partition must give them one. Over the others we search the smallest capacity C for which
greedy filling in that order needs no more shards than there are, and cut there.

The search needs running sums of group sizes only near the cuts. Round by round the
driver sees about ``points`` of them: first evenly spaced over all, then those between
the positions that greedy filling can reach for the capacities still possible. Rounding a
cut to a seen point moves it by at most one bin, so each round narrows capacity and
windows by a constant factor, and the last one sees every group of its windows. Executors only sum and sort
narrow rows; texts are read once and never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.functions.ranking import hash_bits
from tensorloom.llm.common import stored, text_of
from tensorloom.session import shuffle_width

OVERHEAD = 16  # bytes a row costs besides its text
POINTS = 50_000  # running sums the driver sees in one round


def shard_documents(
    docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", points: int = POINTS
) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per document.

    Law ``bytes``: the largest shard is as small as an order of whole groups allows, and
    cuts lie as near to even shares as that capacity lets them. Null texts form one group
    apart from empty ones and have no bytes; their checksum is that of no bytes, 0. Rows
    may repeat, ids may be null; other columns are ignored. An empty table gives no rows;
    with fewer groups than shards some shards stay empty.
    """
    text = F.col(text_col)
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text_of(text)) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text_of(text)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(text), F.lit("")).alias("_key"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("_key").agg(F.sum("size").alias("bytes")), "shard-groups")
    alone, cuts = plan_cuts(groups, shards, points)
    return _slots(rows.withColumn("shard", shard_of(F.col("_key"), alone, cuts)))


def plan_cuts(groups: DataFrame, shards: int, points: int = POINTS) -> tuple[list[str], list[str]]:
    """Keys of the groups that get a shard each, and the last key of every other shard but the last one."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    top = groups.orderBy(F.desc("bytes"), "_key").limit(shards).collect()  # as many rows as shards
    alone: list[str] = []
    for row in top:
        if len(alone) < shards - 1 and row["bytes"] * (shards - len(alone)) > total:
            alone.append(row["_key"])
            total -= row["bytes"]
    rest = groups.where(~F.col("_key").isin(alone)) if alone else groups
    largest = next((r["bytes"] for r in top if r["_key"] not in alone), 0)
    left = shards - len(alone)
    if left < 2 or not total:
        return alone, []
    return alone, _minimax(_running(rest), total, largest, left, points)


def _running(groups: DataFrame) -> DataFrame:
    """(key, stop): the sum of sizes up to each group, by key."""
    bits = hash_bits(groups.sparkSession)
    head = F.coalesce(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.lit(0))
    cut = groups.withColumn("_b", F.shiftright(head, 32 - bits))
    sums = cut.groupBy("_b").agg(F.sum("bytes").alias("_s"))
    # at most 2**18 rows of two longs
    starts = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_start"))
    inside = F.sum("bytes").over(Window.partitionBy("_b").orderBy("_key"))
    numbered = cut.withColumn("_in", inside).join(F.broadcast(starts), "_b")
    return stored(numbered.select("_key", (F.col("_start") + F.col("_in")).cast("long").alias("stop")), "shard-stops")


def _minimax(running: DataFrame, total: int, largest: int, shards: int, points: int) -> list[str]:
    low, windows = max(-(-total // shards), largest), [(0, total)]
    known: dict[int, str] = {}
    width, groups = max(1, -(-total // points)), points + 1
    while True:
        if groups <= points:  # few groups are left: see each
            width = 1
        near = F.lit(False)
        for a, b in windows:  # one per cut at most
            near = near | F.col("stop").between(a, b)
        bins = (
            running.where(near)
            .groupBy(F.floor(F.col("stop") / F.lit(width)).alias("_bin"))
            .agg(F.max(F.struct("stop", "_key")).alias("top"), F.min("stop").alias("first"), F.count(F.lit(1)).alias("n"))
            .collect()  # at most points + one per window
        )
        known |= {r["top"]["stop"]: r["top"]["_key"] for r in bins}
        stops = sorted(known)
        high = _least_capacity(stops, total, shards, low)
        if high == low or all(r["n"] == 1 for r in bins):
            break
        low = max(low, high - width)
        windows = _reach(stops, sorted((r["first"], r["top"]["stop"]) for r in bins), total, shards, low, high)
        groups = sum(r["n"] for r in bins if any(r["first"] <= b and r["top"]["stop"] >= a for a, b in windows))
        # windows can't get narrower than cuts differ between capacities a few bytes apart,
        # by some of the largest groups each: then all groups there are few enough
        narrower = -(-sum(b - a + 1 for a, b in windows) // points)
        width = max(1, narrower) if narrower * 2 <= width else 1
    return [known[c] for c in _even_cuts(stops, total, shards, high)]


def _fill(stops: list[int], start: int, total: int, shards: int, capacity: int) -> bool:
    """Whether greedy filling from ``start`` ends within ``shards``."""
    for _ in range(shards):
        if start + capacity >= total:
            return True
        k = bisect_right(stops, start + capacity) - 1
        if k < 0 or stops[k] <= start:
            return False
        start = stops[k]
    return False


def _least_capacity(stops: list[int], total: int, shards: int, low: int) -> int:
    high = total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _fill(stops, 0, total, shards, mid) else (mid + 1, high)
    return low


def _reach(stops, bins, total, shards, low, high) -> list[tuple[int, int]]:
    """Windows that hold every cut of greedy filling for a capacity from low to high."""
    firsts, a, b, windows = [x for x, _ in bins], 0, 0, []
    for _ in range(shards - 1):
        k = bisect_right(stops, a + low) - 1
        a = max(a, stops[k]) if k >= 0 else a
        k = bisect_right(firsts, b + high) - 1
        b = min(b + high, max(b, bins[k][1])) if k >= 0 else b + high
        b = min(max(a, b), total)
        if windows and windows[-1][1] >= a:
            windows[-1] = (windows[-1][0], max(windows[-1][1], b))
        else:
            windows.append((a, b))
    return windows


def _even_cuts(stops: list[int], total: int, shards: int, capacity: int) -> list[int]:
    """Cuts nearest to even shares of what is left, among those that keep every shard within the capacity."""
    cuts, start = [], 0
    for left in range(shards - 1, 0, -1):
        lo, hi = bisect_right(stops, start), bisect_right(stops, start + capacity) - 1
        while hi >= 0 and stops[hi] >= total:
            hi -= 1
        if hi < lo:
            break
        a, b = lo, hi
        while a < b:  # later cuts leave less to the others
            mid = (a + b) // 2
            a, b = (a, mid) if _fill(stops, stops[mid], total, left, capacity) else (mid + 1, b)
        goal = start + (total - start) / (left + 1)
        k = min(max(bisect_left(stops, goal), a), hi)
        k = min((j for j in (k - 1, k) if a <= j <= hi), key=lambda j: abs(stops[j] - goal))
        start = stops[k]
        cuts.append(start)
    return cuts


def shard_of(key: Column, alone: list[str], cuts: list[str]) -> Column:
    """Shard number of a group key: a constant expression of fewer keys than shards."""
    number = F.lit(len(alone))
    for cut in cuts:
        number = number + (key > F.lit(cut)).cast("int")
    for i, own in enumerate(alone):
        number = F.when(key == F.lit(own), F.lit(i)).otherwise(number)
    return number.cast("int")


def _slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard; a shard is spread by id hash, so none is numbered in one task."""
    spread = min(4 * shuffle_width(rows.sparkSession), 4096)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int"))
    counts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")
    starts = counts.select("shard", "_part", before.alias("_start"))  # shards x 4096 narrow rows at most
    number = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "_key")) - 1
    return (
        rows.withColumn("_rn", number)
        .join(F.broadcast(starts), ["shard", "_part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_start") + F.col("_rn")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
