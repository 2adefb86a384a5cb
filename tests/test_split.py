import pytest
from pyspark.sql import functions as F

from tensorloom.operators import split


def sizes(df):
    return {r["split"]: r["n_rows"] for r in split.split_report(df, "id").collect()}


@pytest.mark.parametrize(
    ("ratios", "want"),
    [
        ((0.6, 0.25, 0.15), {"train": 60, "val": 25, "test": 15}),
        ((1.0, 0.0, 0.0), {"train": 100}),
        ((0.9, 0.1, 0.1), {"train": 81, "val": 9, "test": 10}),  # normalised by 1.1
        ((8, 1, 1), {"train": 80, "val": 10, "test": 10}),
    ],
)
def test_ratio_split_sizes(spark, ratios, want):
    assert sizes(split.ratio_split(spark.range(100), "id", ratios)) == want


def test_ratio_split_is_a_partition_and_repeats(spark):
    a = split.ratio_split(spark.range(97), "id", seed=1)
    assert a.select("id").distinct().count() == 97
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, split.ratio_split(spark.range(97).repartition(5), "id", seed=1).collect()))
    assert rows != sorted(map(tuple, split.ratio_split(spark.range(97), "id", seed=2).collect()))


def test_ratio_split_empty_and_bad(spark):
    assert split.ratio_split(spark.range(0), "id").count() == 0
    with pytest.raises(ValueError):
        split.ratio_split(spark.range(3), "id", (0, 0, 0))


def test_slice(spark):
    got = split.slice_items(spark.range(50), "id", *split.parse_slice("40,70"))
    assert sorted(r["id"] for r in got.collect()) == list(range(40, 50))
    for text in ("5", "a,b", "1,2,3"):
        with pytest.raises(ValueError):
            split.parse_slice(text)
    for bounds in ((5, 5), (6, 2), (-1, 3)):
        with pytest.raises(ValueError):
            split.slice_items(spark.range(50), "id", *bounds)


def test_subset_beyond_the_first_thousand(spark):
    # a subset of 1500 positions returns all of them, and only existing ones
    df = spark.range(3000).withColumnRenamed("id", "global_idx")
    wanted = [*range(0, 3000, 2), 5000]
    assert split.index_subset(df, wanted).count() == 1500
    assert split.first_n(df, 1700).count() == 1700


def test_shard_shuffle_visits_each_shard_once_and_changes_by_epoch(spark):
    df = spark.range(500).select((F.col("id") / 100).cast("int").alias("shard_id"), (F.col("id") % 100).alias("offset"))
    orders = []
    for seed, epoch in ((1, 0), (1, 1), (2, 0), (1, 0)):
        rows = split.shard_shuffle(df, seed=seed, epoch=epoch).orderBy("pos").collect()
        assert [r["pos"] for r in rows] == list(range(500))
        runs = 1 + sum(a["shard_id"] != b["shard_id"] for a, b in zip(rows, rows[1:], strict=False))
        assert runs == 5
        orders.append([(r["shard_id"], r["offset"]) for r in rows])
    assert orders[0] == orders[3] and orders[0] != orders[1] and orders[0] != orders[2]


def test_shard_shuffle_short_middle_shard(spark):
    rows = [(s, o) for s, n in ((0, 10), (1, 3), (2, 8)) for o in range(n)]
    got = split.shard_shuffle(spark.createDataFrame(rows, "shard_id int, offset long")).collect()
    assert sorted((r["shard_id"], r["offset"]) for r in got) == rows
    assert sorted(r["pos"] for r in got) == list(range(21))


@pytest.mark.parametrize(("drop", "batches", "rows"), [(False, 4, 100), (True, 3, 96)])
def test_batches(spark, drop, batches, rows):
    ordered = split.sequential_order(spark.range(100), "id")
    got = split.assign_batches(ordered, 32, drop)
    assert got.count() == rows and got.select("batch_id").distinct().count() == batches
    assert got.where("pos_in_batch >= 32 or pos <> batch_id * 32 + pos_in_batch").count() == 0
    assert split.steps_per_epoch(100, 32, drop) == batches


def test_ordered_split(spark):
    got = split.ordered_split(split.uniform_shuffle(spark.range(101), "id"), 0.9)
    assert sizes(got) == {"train": 90, "val": 11}
    assert got.where("split = 'train'").agg(F.max("pos")).first()[0] == 89


@pytest.mark.parametrize(("ratio", "want"), [(0.1, {"train": 90, "val": 10}), (0.001, {"all": 100}), (1.0, {"all": 100})])
def test_tail_holdout(spark, ratio, want):
    df = spark.range(100).withColumn("global_idx", F.col("id"))
    got = split.tail_holdout(df, ratio)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == want
    assert got.where("split = 'val' and id < 90").count() == 0
