"""Split, subset, order and batch items by exact global position.

Every function expects a narrow frame with a unique key and adds position
columns; join tensors afterwards (see ``sources.store.lookup``). Orders can hand
on the row count they already know (``total="n"``), which ``ordered_split`` and
``assign_batches`` accept as ``total=F.col("n")`` instead of counting again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.hashing import hash32
from tensorloom.functions.ranking import hash_rank, order_rank
from tensorloom.session import FILTER_INDICES, index_rows

SPLITS = ("train", "val", "test")


def _share(n: Column, ratio: float, whole: float = 1.0) -> Column:
    """int(n * ratio / whole) in the same double arithmetic as Python."""
    return F.floor(n.cast("double") * F.lit(float(ratio)) / F.lit(float(whole))).cast("long")


def ratio_split(
    df: DataFrame,
    key: str | list[str],
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
    seed: int = 42,
    total: str | None = None,
) -> DataFrame:
    """Seeded random train/val/test split with exact sizes; ratios are normalised."""
    tr, va, te = ratios
    if min(ratios) < 0 or sum(ratios) <= 0:
        raise ValueError(f"ratios must be non-negative with a positive sum: {ratios}")
    whole = tr + va + te
    n = F.col("_n")
    train_end = F.least(_share(n, tr, whole), n)
    val_end = F.greatest(train_end, F.least(_share(n, tr + va, whole), n))
    pos = F.col("pos")
    split = F.when(pos < train_end, SPLITS[0]).when(pos < val_end, SPLITS[1]).otherwise(SPLITS[2])
    ranked = hash_rank(df, key, seed, out="pos", total="_n").withColumn("split", split)
    return ranked.withColumnRenamed("_n", total) if total else ranked.drop("_n")


def parse_slice(text: str) -> tuple[int, int]:
    """``"start,end"`` -> half-open integer range."""
    pieces = text.split(",")
    if len(pieces) != 2:
        raise ValueError(f"expected 'start,end', got {text!r}")
    try:
        start, end = int(pieces[0]), int(pieces[1])
    except ValueError:
        raise ValueError(f"slice bounds must be integers, got {text!r}") from None
    return start, end


def slice_items(df: DataFrame, key: str | list[str], start: int, end: int) -> DataFrame:
    """Rows [start, end) in key order; an end past the last row is clamped."""
    if start < 0 or start >= end:
        raise ValueError(f"need 0 <= start < end, got [{start}, {end})")
    ranked = df if "item_pos" in df.columns else order_rank(df, key, out="item_pos")
    return ranked.where((F.col("item_pos") >= start) & (F.col("item_pos") < end))


def first_n(df: DataFrame, n: int, index_col: str = "global_idx") -> DataFrame:
    """The first n rows by a stored position -- a plain filter that reaches the scan."""
    return df.where(F.col(index_col) < F.lit(n))


def index_subset(df: DataFrame, indices: list[int] | DataFrame, index_col: str = "global_idx") -> DataFrame:
    """Exactly the requested positions that exist, each once.

    A short list becomes a filter that prunes partitions and row groups in the scan;
    anything longer is a semi join.
    """
    if isinstance(indices, DataFrame):
        wanted = indices.select(F.col(indices.columns[0]).cast("long").alias(index_col))
    elif len(indices) <= FILTER_INDICES:
        return df.where(F.col(index_col).isin([int(i) for i in indices]))
    else:
        wanted = index_rows(df.sparkSession, indices, index_col)
    return df.join(wanted, index_col, "left_semi")


def shard_shuffle(
    df: DataFrame,
    shard_col: str = "shard_id",
    offset_col: str = "offset",
    seed: int = 42,
    epoch: int = 0,
    total: str | None = None,
) -> DataFrame:
    """Two-level order: shards in random order, rows in random order inside each.

    One composite ranking; its sampled borders cut through a shard of any size.
    """
    shard, offset = F.col(shard_col), F.col(offset_col)
    keyed = df.withColumns(
        {"_hs": hash32(seed, epoch, shard), "_hr": hash32(seed, epoch, shard, offset)}
    )
    return order_rank(keyed, ["_hs", shard_col, "_hr", offset_col], out="pos", total=total).drop("_hs", "_hr")


def ordered_split(ordered: DataFrame, train_ratio: float, total: int | Column | None = None) -> DataFrame:
    """Cut an ordered frame at int(n * ratio); both sides keep the order."""
    n, frame = _with_total(ordered, total)
    return frame.withColumn(
        "split", F.when(F.col("pos") < _share(n, train_ratio), SPLITS[0]).otherwise(SPLITS[1])
    ).drop("_n")


def uniform_shuffle(
    df: DataFrame, key: str | list[str], seed: int = 42, epoch: int = 0, total: str | None = None
) -> DataFrame:
    """Plain random order, new for each epoch."""
    return hash_rank(df, key, seed, epoch, out="pos", total=total)


def sequential_order(df: DataFrame, key: str | list[str], total: str | None = None) -> DataFrame:
    """Evaluation order: by key."""
    return order_rank(df, key, out="pos", total=total)


def assign_batches(
    ordered: DataFrame, batch_size: int, drop_last: bool = False, total: int | Column | None = None
) -> DataFrame:
    """batch_id and pos_in_batch from ``pos``; optionally without a short last batch."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    size = F.lit(int(batch_size)).cast("long")
    out = ordered
    if drop_last:
        n, out = _with_total(ordered, total)
        out = out.where(F.col("pos") < n - F.pmod(n, size))
    return out.withColumns(
        {
            "batch_id": ((F.col("pos") - F.pmod(F.col("pos"), size)) / size).cast("long"),
            "pos_in_batch": F.pmod(F.col("pos"), size),
        }
    ).drop("_n")


def tail_holdout(df: DataFrame, val_ratio: float, total: int | Column | None = None, index_col: str = "global_idx") -> DataFrame:
    """Mark the last int(n * ratio) rows as validation, disjoint from train.

    A ratio >= 1, or one giving no validation row, leaves ``split = 'all'``:
    every row serves both sides.
    """
    n, frame = _with_total(df, total)
    n_val = F.lit(0).cast("long") if val_ratio >= 1 else _share(n, val_ratio)
    return frame.withColumn(
        "split",
        F.when(n_val <= 0, "all").when(F.col(index_col) >= n - n_val, SPLITS[1]).otherwise(SPLITS[0]),
    ).drop("_n")


def split_report(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Size, distinct keys and position range per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.col(key)).alias("n_keys"),
        F.min(pos).alias("first_pos"),
        F.max(pos).alias("last_pos"),
    )


def steps_per_epoch(n: int, batch_size: int, drop_last: bool = False) -> int:
    return n // batch_size if drop_last else math.ceil(n / batch_size)


def _with_total(df: DataFrame, total: int | Column | None) -> tuple[Column, DataFrame]:
    """The row count as a column: given, or a one-row scalar subquery."""
    if isinstance(total, Column):
        return total, df
    if total is not None:
        return F.lit(int(total)).cast("long"), df
    count = df.groupBy().agg(F.count(F.lit(1)).alias("_n")).scalar()
    return F.col("_n"), df.withColumn("_n", count)
