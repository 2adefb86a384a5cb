"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: cuts the lineage and
    survives lost executors, as nothing of it lives on their disks."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 128 << 20  # of the rows that may be sent to every executor, as they lie in memory there


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(narrow: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a stored, narrow table may be broadcast: the sum of ``row_bytes`` is within ``limit``."""
    size = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    return (narrow.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"] or 0) <= limit


def text_of(column: str | Column = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (``u``, ``v``): rows (``id``, ``root``), root the least id.

    Alternates large-star and small-star steps; every step is a grouped minimum and an
    equi-join, so a hub vertex is pre-aggregated and its join can be split. Every round is
    written to the shared folder. Vertices without an edge to another one don't appear.
    """
    now = stored(_oriented(edges), "cc")
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _oriented(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = stored(
            _oriented(
                small.select("u", F.col("m").alias("v")).union(
                    small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                )
            ),
            "cc",
        )
        last, mark = mark, _mark(now)
        if mark == last:
            break
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
    ).first()
    return tuple(row)
