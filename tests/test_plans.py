"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from tensorloom.functions.ranking import hash_rank, order_rank
from tensorloom.operators import shards, split
from tensorloom.plans import queries_store
from tensorloom.sources import store as fs
from tests_support import make_store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return re.findall(r"ReadSchema: (struct<[^\n]*>)", plan(df))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return make_store(spark, str(tmp_path_factory.mktemp("s") / "store"))


@pytest.mark.parametrize("rank", [lambda df: hash_rank(df, "id", 1), lambda df: order_rank(df, "id")])
def test_rank_windows_only_meet_in_one_task_over_bucket_counts(spark, rank):
    text = plan(rank(spark.range(1000)))
    for block in text.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in block.split("\n", 2)[1]
    assert text.count("Exchange SinglePartition") <= 1
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_row_count_rides_on_the_rank(spark):
    frame = split.ratio_split(spark.range(100), "id", total="n")
    assert "Subquery" not in plan(split.assign_batches(frame, 8, True, F.col("n")))


def test_order_reads_no_tensor(spark, store):
    ordered = split.shard_shuffle(fs.read_keys(spark, store), seed=1)
    assert ordered.count() == 28
    assert scans(ordered) and all("tokens" not in s and "gt_" not in s for s in scans(ordered))


def test_first_n_reaches_the_scan(spark, store):
    text = plan(split.first_n(spark.read.parquet(store), 12).select("item_id"))
    assert "LessThan(global_idx,12)" in text and "tokens" not in text


def test_lookup_prunes_shards_and_row_groups(spark, store):
    meta = spark.createDataFrame([(0, 10), (1, 10), (2, 8)], "shard_id int, n_images long")
    text = plan(fs.lookup(spark, store, [3, 25], meta))
    assert re.search(r"PartitionFilters: \[.*shard_id#\d+ IN \(0,2\)", text)
    assert re.search(r"PushedFilters: \[.*In\(offset", text)


@pytest.mark.parametrize("as_table", [False, True])
def test_long_lookup_prunes_to_its_shards(spark, store, as_table):
    meta = spark.createDataFrame([(0, 10), (1, 10), (2, 8)], "shard_id int, n_images long")
    wanted = [i % 20 for i in range(1500)]
    rows = fs.lookup(spark, store, spark.createDataFrame([(i,) for i in wanted], "idx long") if as_table else wanted, meta)
    assert re.search(r"PartitionFilters: \[.*shard_id#\d+ IN \(0,1\)", plan(rows)) and rows.count() == 1500


def test_index_subset_prunes_by_shard(spark, store):
    rows = spark.read.parquet(store)
    assert re.search(r"PartitionFilters: \[.*shard_id#\d+ IN \(1,2\)", plan(split.index_subset(rows, [1, 2], "shard_id")))
    assert re.search(r"PushedFilters: \[.*In\(global_idx", plan(split.index_subset(rows, [3, 25])))


def test_shards_are_not_counted_again(spark, store):
    (table,) = scans(fs.committed_shards(spark, store))
    assert "n_images" in table and "item_id" not in table
    (counted,) = scans(fs.counted_shards(spark, store))  # ids and positions, no tensor
    assert counted == "struct<item_id:bigint,offset:bigint>"


def test_step_share_prunes_partitions(spark, store):
    lane = F.pmod(F.xxhash64(F.lit(1), F.lit(0), F.col("shard_id")), F.lit(2))
    text = plan(fs.read_store(spark, store).where(lane == 0))
    assert re.search(r"PartitionFilters: \[.*xxhash64", text)


def test_fingerprint_aggregates_partially(spark):
    df = spark.range(100).selectExpr("concat(id, '.jpg') file_name", "'d' parent").repartition(4)
    text = plan(shards.dataset_fingerprint(df))
    assert "partial_sum" in text


def test_no_nested_loops_in_registered_queries(spark, sf):
    import __spark_entry__ as entry

    for name, fn in entry.queries().items():
        text = plan(fn(spark, sf))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_broadcast_list_is_bounded(spark, monkeypatch):
    from tensorloom import session

    df = spark.range(50).withColumnRenamed("id", "global_idx")
    logical = split.index_subset(df, list(range(2000)))._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in logical
    monkeypatch.setattr(session, "MAX_BROADCAST_ROWS", 1)
    logical = split.index_subset(df, list(range(2000)))._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in logical


def test_rank_borders_are_a_literal(spark):
    df = spark.range(1000).withColumn("s", F.col("id").cast("string"))
    text = order_rank(df, ["s", "id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in text and "sort_array" not in text


def test_a_write_counts_its_own_shards_only(spark, tmp_path):
    """The shard table of a write follows from what it wrote: other partitions aren't read."""
    path = make_store(spark, str(tmp_path / "store"))
    only = spark.createDataFrame([(1,)], "shard_id int")
    text = plan(fs._counted(spark, path, fs.store_schema(spark, path), only))
    assert re.search(r"PartitionFilters: \[.*shard_id#\d+ = 1", text) or re.search(r"shard_id#\d+ IN \(1\)", text)
    rows = spark.read.parquet(path).where("shard_id = 1").withColumn("item_id", F.col("item_id") + 1000)
    fs.write_shards(fs.stored(rows, "t"), path)
    told = lambda df: sorted(map(tuple, df.select("shard_id", "n_images", "word_0").collect()))
    assert told(fs.committed_shards(spark, path)) == told(fs.counted_shards(spark, path))


def listing_tasks(spark, run):
    """Tasks of the jobs that list folders while ``run`` runs."""
    sc, group = spark.sparkContext, f"listed-{id(run)}"
    sc.setJobGroup(group, "listed")
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds]
    return out, sum(s.numTasks for s in stages)


def test_folders_of_a_store_are_listed_by_few_tasks(spark, tmp_path):
    path, one = make_store(spark, str(tmp_path / "store"), (1,)), tmp_path / "store"
    (file,) = (f for f in one.glob("shard_id=0/*.parquet"))
    for shard in range(1, 60):
        (one / f"shard_id={shard}").mkdir()
        (one / f"shard_id={shard}" / "a.parquet").write_bytes(file.read_bytes())
    before = spark.conf.get(fs.LISTING)
    for read in (lambda: fs.read_store(spark, path), lambda: fs._counted(spark, path, fs.store_schema(spark, path))):
        rows, tasks = listing_tasks(spark, read)
        assert 0 < tasks <= 4 * 4 + 2 and rows.select("shard_id").distinct().count() == 60  # 4 slots
        assert spark.conf.get(fs.LISTING) == before
    spark.conf.set(fs.LISTING, "7")
    try:
        assert fs.read_keys(spark, path).count() == 60 and spark.conf.get(fs.LISTING) == "7"
    finally:
        spark.conf.unset(fs.LISTING)


def test_encoded_rows_reach_their_file_narrow(spark, tmp_path, monkeypatch):
    """The latent is made once for each row, after the exchange that brings the rows of a file together."""
    rows = [(i, [((i + k) % 9 - 4) / 5 for k in range(64)], i % 5) for i in range(150)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    taken, write = [], fs.write_shards
    monkeypatch.setattr(fs, "write_shards", lambda df, path, **more: (taken.append((df, more)), write(df, path, **more)))
    back = fs.read_store(spark, queries_store.store_path(spark, str(tmp_path)))
    ((df, more),) = taken
    assert more["placed"] and more["replacing"] is not None
    text = plan(df)
    assert text.count("flatten") and "flatten" not in text[text.index("Exchange") :]
    got = sorted(back.select("shard_id", "offset", "item_id", F.size("tokens"), F.size("gt_mean"), F.size("gt_logvar")).collect())
    assert got == [(i // 64, i % 64, i, 64, 256, 256) for i in range(150)]
    near = back.where("item_id = 9").select("gt_mean", "gt_logvar").first()
    assert all(abs(abs(a) - 1 - b) < 2e-3 for a, b in zip(near["gt_mean"], near["gt_logvar"], strict=True))
