"""Commits, pinned readers, conflicts, lookups by row group and descriptions from footers."""

import threading

import pytest
from pyspark.sql import functions as F

from tensorloom.operators import shards
from tensorloom.sources import store as fs
from tensorloom.sources import versions as vs
from test_store import SCHEMA, make_rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def tokens(df):
    return {r["global_idx"]: r["tokens"] for r in df.collect()}


@pytest.fixture
def path(spark, tmp_path):
    where = str(tmp_path / "store")
    assert vs.commit_shards(frame(spark, make_rows()), where, rows_per_file=4) == 1
    return where


@pytest.mark.parametrize("storage", ["float", "half"])
def test_a_version_reads_as_written(spark, tmp_path, storage):
    where, rows = str(tmp_path / "s"), make_rows()
    vs.commit_shards(frame(spark, rows), where, storage=storage, rows_per_file=4)
    got = {r["global_idx"]: r for r in vs.read_version(spark, where).collect()}
    assert {k: (r["tokens"], r["gt_logvar"], r["shard_id"], r["offset"], r["path"]) for k, r in got.items()} == {
        r[0]: (r[5], r[7], r[3], r[4], r[2]) for r in rows
    }
    with pytest.raises(ValueError, match="tokens"):
        vs.commit_shards(frame(spark, rows), where, storage="half" if storage == "float" else "float")
    assert vs.versions(spark, where) == [1]


def test_a_read_begun_before_a_write_sees_the_old_rows(spark, path):
    old, new = make_rows(), make_rows(seed=5)
    before = vs.read_version(spark, path)
    assert vs.commit_shards(frame(spark, [r for r in new if r[3] == 1]), path) == 2
    assert tokens(before) == {r[0]: r[5] for r in old}  # run after the write
    assert tokens(vs.read_version(spark, path)) == {r[0]: r[5] for r in [*old[:10], *new[10:20], *old[20:]]}
    assert tokens(vs.read_version(spark, path, 1)) == {r[0]: r[5] for r in old}
    with pytest.raises(FileNotFoundError):
        vs.read_version(spark, path, 9)


def test_the_second_writer_of_a_shard_is_refused(spark, path):
    rows = make_rows(seed=5)
    of = lambda s: frame(spark, [r for r in rows if r[3] == s])
    assert vs.commit_shards(of(1), path, base=1) == 2
    with pytest.raises(vs.ConflictError, match=r"\[1\]"):
        vs.commit_shards(of(1), path, base=1)
    assert vs.versions(spark, path) == [1, 2]
    assert vs.commit_shards(of(2), path, base=1) == 3  # other shards: put on top
    assert tokens(vs.read_version(spark, path)) == {r[0]: r[5] for r in [*make_rows()[:10], *rows[10:]]}


def test_a_version_can_be_created_once(spark, path):
    """Many writers of one number: one of them creates it."""
    entry = {"version": 2, "base": 1, "table": "t", "schema": {}}
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(vs._create_entry(spark, path, {**entry, "table": str(k)}))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 7 + [True] and vs._entry(spark, path, 2)["version"] == 2


def test_writers_at_once(spark, path):
    """Two writers start from version 1 and race for shard 0: one is refused, the rows are those of the other."""
    done = []

    def write(seed):
        try:
            vs.commit_shards(frame(spark, [r for r in make_rows(seed=seed) if r[3] == 0]), path, base=1)
            done.append(seed)
        except vs.ConflictError:
            done.append(None)

    threads = [threading.Thread(target=write, args=(seed,)) for seed in (5, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (won,) = [s for s in done if s is not None]
    assert len(done) == 2 and tokens(vs.read_version(spark, path))[3] == make_rows(seed=won)[3][5]


def test_a_write_that_never_committed_is_not_seen(spark, path, monkeypatch):
    monkeypatch.setattr(vs, "_create_entry", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        vs.commit_shards(frame(spark, make_rows(seed=9)), path)
    monkeypatch.undo()
    assert vs.versions(spark, path) == [1] and tokens(vs.read_version(spark, path)) == {r[0]: r[5] for r in make_rows()}


def test_shards_can_be_removed_and_old_versions_dropped(spark, path):
    rows = make_rows(seed=5)
    gone = spark.createDataFrame([(2,)], "shard_id int")
    assert vs.commit_shards(frame(spark, [r for r in rows if r[3] < 2]), path, removing=gone) == 2
    assert sorted(map(tuple, vs.version_shards(spark, path).collect())) == [(0, 10), (1, 10)]
    assert vs.expire(spark, path) == 1 and vs.versions(spark, path) == [2]
    assert tokens(vs.read_version(spark, path)) == {r[0]: r[5] for r in rows[:20]}
    assert vs.expire(spark, path) == 0


def test_columns_of_later_commits(spark, tmp_path):
    where = str(tmp_path / "s")
    rows = frame(spark, make_rows())
    vs.commit_shards(rows.where("shard_id = 0").drop("gt_logvar"), where)
    vs.commit_shards(rows.where("shard_id > 0").withColumn("label", F.lit(7)), where)
    got = vs.read_version(spark, where)
    assert {(r["shard_id"], r["n"]) for r in got.groupBy("shard_id").agg(F.count("label").alias("n")).collect()} == {(0, 0), (1, 10), (2, 8)}
    assert got.where("shard_id = 0").where(F.forall("gt_logvar", lambda v: v == 0)).count() == 10
    found = vs.lookup_version(spark, where, [3, 12]).orderBy("idx").collect()
    assert [(r["label"], r["gt_logvar"]) for r in found] == [(None, [0.0] * 4), (7, make_rows()[12][7])]


def test_lookup_opens_the_row_groups_of_its_rows_only(spark, path):
    rows, wanted = make_rows(), [27, 0, 10, 0, 1, 400]
    got = vs.lookup_version(spark, path, wanted).orderBy("list_pos").collect()
    assert [(r["list_pos"], r["idx"], r["shard_id"], r["offset"], r["item_id"], r["tokens"], r["gt_mean"]) for r in got] == [
        (p, i, *rows[i][3:5], rows[i][1], *rows[i][5:7]) for p, i in enumerate(wanted[:-1])
    ]
    groups = vs.located_groups(spark, path, wanted).select("commit", "below", "row_group").distinct().count()
    assert groups == 3 and vs._table(spark, path, 1).count() == 8  # 3 + 3 + 2 files of four rows
    table = spark.createDataFrame([(i, f"x{i}") for i in range(28)], "idx long, mine string")
    found = vs.lookup_version(spark, path, table)
    assert {r["idx"]: (r["mine"], r["tokens"]) for r in found.collect()} == {r[0]: (f"x{r[0]}", r[5]) for r in rows}
    vs.commit_shards(frame(spark, [r for r in make_rows(seed=5) if r[3] == 1]), path)
    assert vs.lookup_version(spark, path, [10], 1).first()["tokens"] == rows[10][5]
    assert vs.lookup_version(spark, path, [10]).first()["tokens"] == make_rows(seed=5)[10][5]


def test_row_groups_are_small_for_wide_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vs, "GROUP_BYTES", 64 << 10)
    wide = spark.range(40).select(
        F.col("id").alias("global_idx"), F.col("id").alias("item_id"), F.lit(0).alias("shard_id"), F.col("id").alias("offset"),
        F.transform(F.sequence(F.lit(1), F.lit(8192)), lambda i: F.rand(3).cast("float") + i * F.col("id")).alias("tokens"),
    )
    vs.commit_shards(wide, str(tmp_path / "s"))
    groups = vs._table(spark, str(tmp_path / "s"), 1).collect()
    assert len(groups) >= 10 and sum(g["n_rows"] for g in groups) == 40
    assert vs.lookup_version(spark, str(tmp_path / "s"), [7, 33]).count() == 2


@pytest.mark.parametrize("storage", ["float", "half"])
def test_descriptions_come_from_footers(spark, tmp_path, storage):
    plain, versioned = str(tmp_path / "p"), str(tmp_path / "v")
    rows = frame(spark, make_rows()).withColumn("gt_logvar", F.when(F.col("shard_id") > 0, F.col("gt_logvar")))
    fs.write_shards(rows, plain, storage=storage)
    vs.commit_shards(rows, versioned, storage=storage)
    want = shards.store_info(spark.read.parquet(plain)).first()
    summary = vs.store_summary(spark, plain)
    assert summary.first() == want and summary.dtypes == shards.store_info(spark.read.parquet(plain)).dtypes
    assert "tokens" not in summary._jdf.queryExecution().executedPlan().toString()
    told = vs.version_info(spark, versioned).first()
    assert told[:4] == want[:4] and told["with_logvar"] == 18
    assert (told["token_values"], told["latent_values"]) == ((6, 4) if storage == "float" else (None, None))
