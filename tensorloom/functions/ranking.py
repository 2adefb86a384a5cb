"""Exact global positions without a single-task window.

``row_number() over (order by k)`` sends every row to one task. Both ranks here
split the order into consecutive buckets instead: count rows per bucket, turn
the (small, size-bounded) count table into bucket starts, and number rows inside
each bucket in parallel. The result is the same number the single window would
give, and depends only on the data, so a lost executor recomputes the same rank.

* :func:`hash_rank` -- random order. Buckets are the top bits of a seeded hash,
  uniform whatever the key distribution.
* :func:`order_rank` -- natural order of any column list. Bucket borders are
  sampled from the composite key, so a group that holds a third of all rows
  simply receives a third of the borders.

Key columns must be unique per row; carry ids through these functions and join
wide columns afterwards.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.functions.arrays import bind
from tensorloom.functions.hashing import hash32
from tensorloom.session import shuffle_width

MAX_BITS = 18
MAX_BORDERS = 1024
SAMPLES_PER_BORDER = 16
SAMPLE_SEED = 7


def hash_bits(spark) -> int:
    """Bucket bits giving ~16 buckets per shuffle partition (at most 2**18)."""
    return min(max(math.ceil(math.log2(shuffle_width(spark) * 16)), 8), MAX_BITS)


def hash_rank(
    df: DataFrame,
    key: str | list[str],
    *parts: str | int | Column,
    out: str = "pos",
    total: str | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Position of each row in the order of ``hash(*parts, key)``, ties by key.

    ``total`` optionally names a column receiving the row count, which rides on
    the bucket table and costs nothing extra.
    """
    keys = [key] if isinstance(key, str) else list(key)
    bits = bits or hash_bits(df.sparkSession)
    hashed = df.withColumn("_h", hash32(*parts, *[F.col(k) for k in keys])).withColumn(
        "_bucket", F.shiftright("_h", 32 - bits)
    )
    return _number_in_buckets(hashed, ["_h", *keys], out, total).drop("_h")


def order_rank(
    df: DataFrame,
    keys: str | list[str],
    *,
    out: str = "item_pos",
    total: str | None = None,
    borders: int | None = None,
) -> DataFrame:
    """Position of each row in the ascending order of ``keys``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cuts = sample_borders(df, keys, borders or min(shuffle_width(df.sparkSession) * 4, MAX_BORDERS))
    placed = df.withColumn("_bucket", bucket_of(df, keys, cuts))
    return _number_in_buckets(placed, keys, out, total)


def sample_borders(df: DataFrame, keys: list[str], borders: int) -> list[tuple]:
    """About ``borders`` keys as text, evenly spaced in a uniform sample.

    The row count gives the share of rows that makes a sample of ``SAMPLES_PER_BORDER`` for
    each border, whatever the table's size, and every task draws its rows by itself: a task
    hands on its part of the sample, not a full one of its own, and a key that stands in many
    rows counts as often as it stands there. Only the balance of buckets depends on the
    sample, never the rank.
    """
    as_text = F.struct(*[F.col(f"k.{k}").cast("string").alias(k) for k in keys])
    sample = (
        border_sample(df, keys, borders * SAMPLES_PER_BORDER)
        .select(F.struct(*keys).alias("k"))
        .select("k", as_text.alias("text"))
        .agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("all"))
        .select(F.filter("all", lambda x, i: i % SAMPLES_PER_BORDER == SAMPLES_PER_BORDER // 2).alias("all"))
        .select(F.transform("all", lambda x: x["text"]).alias("cuts"))
    )
    return [tuple(c) for c in sample.first()["cuts"]]


def border_sample(df: DataFrame, keys: list[str], wanted: int) -> DataFrame:
    """About ``wanted`` rows of the keys, each drawn by itself; all of them if there are no more."""
    narrow = df.select(*keys)
    n = narrow.count()
    return narrow if n <= wanted else narrow.where(F.rand(SAMPLE_SEED) < wanted / n)


def bucket_of(df: DataFrame, keys: list[str], cuts: list[tuple]) -> Column:
    """How many cuts are <= the row's key, by binary search over a constant array.

    The array is one folded constant per query. It takes exactly the key's types and
    is sorted in the engine: any sorted array is a valid bucketing, so what text and
    time-zone conversions did to a border cannot matter.
    """
    if not cuts:
        return F.lit(0)
    typed = T.StructType([T.StructField(f"f{i}", df.select(k).schema[0].dataType) for i, k in enumerate(keys)])
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in typed])
    rows = json.dumps([dict(zip(text.names, c, strict=True)) for c in cuts])
    # only foldable pieces (no lambda, no arrays_zip): the optimizer leaves a literal
    table = F.sort_array(F.from_json(F.lit(rows), T.ArrayType(text)).cast(T.ArrayType(typed)))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

    def search(k: Column) -> Column:
        return F.aggregate(
            steps,
            F.lit(0),
            lambda found, step: F.when(F.get(table, found + step - 1) <= k, found + step).otherwise(found),
        )

    found = bind(F.struct(*keys), search)
    return F.coalesce(found, F.lit(0))  # never null, so joins add no recomputing null filter


def running_offsets(df: DataFrame, order_col: str, value_col: str, *, out: str = "base", span: int = 4096) -> DataFrame:
    """Exclusive running sum of ``value_col`` by an integer ``order_col``.

    Two levels: sums per block of ``span`` consecutive ids, then within blocks, so
    even a table of 10^8 shards never meets in one task.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order_col) / F.lit(span)).cast("long"))
    blocks = blocked.groupBy("_block").agg(F.sum(value_col).alias("_sum"))
    starts = blocks.select(
        "_block",
        (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_start"),
    )
    inside = Window.partitionBy("_block").orderBy(order_col)
    return (
        blocked.join(starts, "_block")
        .withColumn(
            out,
            (F.col("_start") + F.sum(value_col).over(inside) - F.col(value_col)).cast("long"),
        )
        .drop("_block", "_start")
    )


def _number_in_buckets(df: DataFrame, order: list[str], out: str, total: str | None) -> DataFrame:
    counts = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # one row per bucket: bounded by 2**MAX_BITS or MAX_BORDERS + 1 rows by construction
    starts = counts.select(
        "_bucket",
        (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_start"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    inside = Window.partitionBy("_bucket").orderBy(*order)
    # number first, join after: the shuffle then carries no bucket starts
    ranked = (
        df.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(starts), "_bucket")
        .withColumn(out, (F.col("_start") + F.col("_rn") - F.lit(1)).cast("long"))
        .drop("_rn")
    )
    if total:
        ranked = ranked.withColumn(total, F.col("_total").cast("long"))
    return ranked.drop("_bucket", "_start", "_total")
