"""Split, subset, order and batch queries (B rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators import split
from tensorloom.operators.shards import assign_shards
from tensorloom.plans.catalog import h32, query, table

ORDER_POS = f"""pos AS (SELECT o_orderkey, o_totalprice, count(*) OVER () AS n,
  row_number() OVER (ORDER BY {h32("'42'", "o_orderkey")}, o_orderkey) - 1 AS pos FROM orders)"""
CUT = "floor(n::DOUBLE * {r}::DOUBLE / {w}::DOUBLE)"
SPLIT_CASE = f"""CASE WHEN pos < {CUT.format(r=0.8, w=1.0)} THEN 'train'
  WHEN pos < {CUT.format(r=0.9, w=1.0)} THEN 'val' ELSE 'test' END"""
RATIOS = (0.8, 0.1, 0.1)


def orders(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", *columns)


@query(
    "b1_ratio_split",
    f"WITH {ORDER_POS} SELECT o_orderkey, pos::BIGINT AS pos, {SPLIT_CASE} AS split FROM pos",
)
def b1_ratio_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.ratio_split(orders(spark, sf), "o_orderkey", RATIOS)


@query(
    "b1_split_normalised",
    f"""WITH {ORDER_POS} SELECT CASE WHEN pos < {CUT.format(r=0.9, w=1.1)} THEN 'train'
  WHEN pos < {CUT.format(r=1.0, w=1.1)} THEN 'val' ELSE 'test' END AS split, count(*)::BIGINT AS n_rows,
  sum(o_orderkey)::BIGINT AS key_sum FROM pos GROUP BY 1""",
)
def b1_split_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios summing to 1.1 are normalised, not clipped."""
    marked = split.ratio_split(orders(spark, sf), "o_orderkey", (0.9, 0.1, 0.1))
    return marked.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").cast("long").alias("key_sum")
    )


@query(
    "b1_split_batches",
    f"""WITH {ORDER_POS}, s AS (SELECT *, {SPLIT_CASE} AS split FROM pos)
SELECT split, count(*)::BIGINT AS n_rows, count(DISTINCT pos // 64)::BIGINT AS n_batches,
  round(avg(o_totalprice), 4) AS mean_price FROM s GROUP BY split""",
)
def b1_split_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, batches and mean price per split."""
    marked = split.assign_batches(split.ratio_split(orders(spark, sf, "o_totalprice"), "o_orderkey", RATIOS), 64)
    return marked.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("batch_id").alias("n_batches"),
        F.round(F.avg("o_totalprice"), 4).alias("mean_price"),
    )


@query(
    "b2_slice_items",
    """WITH p AS (SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS item_pos FROM documents)
SELECT source, doc_id, item_pos::BIGINT AS item_pos FROM p WHERE item_pos >= 100 AND item_pos < 900""",
)
def b2_slice_items(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "documents").select("source", "doc_id")
    return split.slice_items(items, ["source", "doc_id"], *split.parse_slice("100,900"))


STORE_POS = "p AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY source, doc_id) - 1 AS global_idx FROM documents)"


def indexed_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return assign_shards(docs, ["source", "doc_id"], 100).drop("source")


@query(
    "b3_first_n",
    f"""WITH {STORE_POS} SELECT doc_id, n_chars, global_idx::BIGINT AS global_idx,
  (global_idx // 100)::INTEGER AS shard_id, (global_idx % 100)::BIGINT AS "offset" FROM p WHERE global_idx < 320""",
)
def b3_first_n(spark: SparkSession, sf: str) -> DataFrame:
    return split.first_n(indexed_documents(spark, sf), 320)


@query(
    "b4_index_subset",
    f"""WITH {STORE_POS} SELECT doc_id, n_chars, global_idx::BIGINT AS global_idx,
  (global_idx // 100)::INTEGER AS shard_id, (global_idx % 100)::BIGINT AS "offset"
FROM p WHERE global_idx IN (SELECT doc_id FROM labels)""",
)
def b4_index_subset(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled ids taken as wanted positions."""
    return split.index_subset(indexed_documents(spark, sf), table(spark, sf, "labels").select("doc_id"))


HS, HR = h32("'7'", "'2'", "user_id"), h32("'7'", "'2'", "user_id", "event_id")
SHUFFLED = f"""s AS (SELECT event_id, user_id, count(*) OVER () AS n,
  row_number() OVER (ORDER BY {HS}, user_id, {HR}, event_id) - 1 AS pos FROM events)"""


def shuffled_events(spark: SparkSession, sf: str, total: str | None = None) -> DataFrame:
    """Users as shards of unequal size, in the two-level order of epoch 2."""
    rows = table(spark, sf, "events").select("event_id", "user_id")
    return split.shard_shuffle(rows, "user_id", "event_id", seed=7, epoch=2, total=total)


@query("b5_shard_shuffle", f"WITH {SHUFFLED} SELECT event_id, user_id, pos::BIGINT AS pos FROM s")
def b5_shard_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return shuffled_events(spark, sf)


@query(
    "b6_ordered_split",
    f"""WITH {SHUFFLED} SELECT event_id, pos::BIGINT AS pos,
  CASE WHEN pos < floor(n::DOUBLE * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM s""",
)
def b6_ordered_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.ordered_split(shuffled_events(spark, sf, "n"), 0.9, F.col("n")).select("event_id", "pos", "split")


@query(
    "b7_uniform_shuffle",
    f"""SELECT event_id, (row_number() OVER (ORDER BY {h32("'42'", "'5'", "event_id")}, event_id) - 1)::BIGINT AS pos
FROM events""",
)
def b7_uniform_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return split.uniform_shuffle(table(spark, sf, "events").select("event_id"), "event_id", seed=42, epoch=5)


@query(
    "b8_sequential_order",
    "SELECT event_id, (row_number() OVER (ORDER BY event_type, ts, event_id) - 1)::BIGINT AS pos FROM events",
)
def b8_sequential_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", "ts", "event_id")
    return split.sequential_order(rows, ["event_type", "ts", "event_id"]).select("event_id", "pos")


@query(
    "b9_assign_batches",
    f"""WITH s AS (SELECT event_id, count(*) OVER () AS n,
  row_number() OVER (ORDER BY {h32("'42'", "'0'", "event_id")}, event_id) - 1 AS pos FROM events)
SELECT event_id, pos::BIGINT AS pos, (pos // 48)::BIGINT AS batch_id, (pos % 48)::BIGINT AS pos_in_batch
FROM s WHERE pos < n - n % 48""",
)
def b9_assign_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = split.uniform_shuffle(table(spark, sf, "events").select("event_id"), "event_id", total="n")
    batches = split.assign_batches(rows, 48, drop_last=True, total=F.col("n"))
    return batches.select("event_id", "pos", "batch_id", "pos_in_batch")


@query(
    "b10_tail_holdout",
    f"""WITH {STORE_POS} SELECT doc_id, CASE WHEN global_idx >= n - floor(n::DOUBLE * 0.15::DOUBLE)
  THEN 'val' ELSE 'train' END AS split FROM p, (SELECT count(*) AS n FROM documents)""",
)
def b10_tail_holdout(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "doc_id")
    indexed = assign_shards(docs, ["source", "doc_id"], 100, total="n")
    return split.tail_holdout(indexed, 0.15, F.col("n")).select("doc_id", "split")


@query(
    "b11_split_report",
    f"""WITH {ORDER_POS}, s AS (SELECT *, {SPLIT_CASE} AS split FROM pos)
SELECT split, count(*)::BIGINT AS n_rows, count(DISTINCT o_orderkey)::BIGINT AS n_keys,
  min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos FROM s GROUP BY split""",
)
def b11_split_report(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_report(split.ratio_split(orders(spark, sf), "o_orderkey", RATIOS), "o_orderkey")
