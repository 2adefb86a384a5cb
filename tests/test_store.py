import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorloom.operators import shards
from tensorloom.sources import store as fs

SCHEMA = (
    "global_idx long, item_id long, path string, shard_id int, offset long, "
    "tokens array<float>, gt_mean array<float>, gt_logvar array<float>"
)


def make_rows(counts=(10, 10, 8), seed=0):
    rng, rows, g = np.random.default_rng(seed), [], 0
    for s, n in enumerate(counts):
        for o in range(n):
            t, m, v = (rng.standard_normal(k).astype(np.float16).astype(float).tolist() for k in (6, 4, 4))
            rows.append((g, g + 100, f"d/{g}.jpg", s, o, t, m, v))
            g += 1
    return rows


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    fs.write_shards(spark.createDataFrame(make_rows(), SCHEMA), path)
    return path


@pytest.mark.parametrize("storage", ["float", "half"])
def test_round_trip(spark, tmp_path, storage):
    path = str(tmp_path / "s")
    rows = make_rows()
    fs.write_shards(spark.createDataFrame(rows, SCHEMA), path, storage=storage, rows_per_file=4)
    got = {r["global_idx"]: r for r in fs.read_store(spark, path).collect()}
    assert len(got) == 28
    for r in rows:
        assert (got[r[0]]["tokens"], got[r[0]]["gt_logvar"]) == (r[5], r[7])
    info = shards.store_info(fs.read_store(spark, path)).first()
    assert (info["shard_count"], info["largest_shard"], info["smallest_shard"]) == (3, 10, 8)


def test_rewrite_replaces_only_its_shards(spark, store):
    rows = [r for r in make_rows(seed=5) if r[3] == 1]
    fs.write_shards(spark.createDataFrame(rows, SCHEMA), store)
    fs.write_shards(spark.createDataFrame(rows, SCHEMA), store)  # a retry changes nothing
    got = {r["global_idx"]: r["tokens"] for r in fs.read_store(spark, store).collect()}
    assert len(got) == 28 and got[12] == rows[2][5] and got[2] == make_rows()[2][5]


def test_files_keep_to_their_size(spark, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "s"
    fs.write_shards(spark.createDataFrame(make_rows((40,)), SCHEMA), str(path), rows_per_file=10)
    sizes = [pq.read_metadata(f).num_rows for f in (path / "shard_id=0").glob("*.parquet")]
    assert sum(sizes) == 40 and max(sizes) <= 10


def test_shard_table_follows_the_store(spark, store):
    def told(df):
        return sorted(map(tuple, df.select(fs.counted_shards(spark, store).columns).collect()))

    assert told(fs.committed_shards(spark, store)) == told(fs.counted_shards(spark, store))
    rows = [(r[0], r[1] + 1000, *r[2:]) for r in make_rows() if r[3] == 1]  # as many rows, other items
    before = told(fs.committed_shards(spark, store))
    fs.write_shards(spark.createDataFrame(rows, SCHEMA), store)
    after = told(fs.committed_shards(spark, store))
    assert after == told(fs.counted_shards(spark, store)) and before != after
    assert fs.drop_shards(spark, store, spark.createDataFrame([(0,), (1,)], "shard_id int")) == 1
    assert [r[0] for r in told(fs.committed_shards(spark, store))] == [0, 1]
    assert fs.read_store(spark, store).count() == 20


def test_resume_tells_content_from_count(spark):
    rows = spark.range(40).selectExpr("id AS item_id", "cast(id DIV 10 AS int) AS shard_id", "id % 10 AS offset")
    shifted = rows.selectExpr("item_id + (shard_id = 2)::int AS item_id", "shard_id", "offset")
    moved = rows.selectExpr("item_id", "shard_id", "if(shard_id = 3, 9 - offset, offset) AS offset")
    plan = shards.shard_contents(rows)
    assert [r["shard_id"] for r in shards.resume_plan(plan, shards.shard_contents(shifted)).collect()] == [2]
    assert [r["shard_id"] for r in shards.resume_plan(plan, shards.shard_contents(moved)).collect()] == [3]
    assert shards.resume_plan(plan, plan).count() == 0


def test_mixed_storage_is_refused(spark, store):
    rows = spark.createDataFrame([r for r in make_rows() if r[3] == 1], SCHEMA)
    with pytest.raises(ValueError, match="tokens"):
        fs.write_shards(rows, store, storage="half")
    assert fs.read_store(spark, store).count() == 28


def test_columns_of_some_shards_are_kept(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame(make_rows(), SCHEMA)
    fs.write_shards(rows.where("shard_id = 0"), path)
    fs.write_shards(rows.where("shard_id > 0").withColumn("label", F.lit(7)), path)
    got = fs.read_store(spark, path).groupBy("shard_id").agg(F.count("label").alias("n")).collect()
    assert {r["shard_id"]: r["n"] for r in got} == {0: 0, 1: 10, 2: 8}
    import shutil

    (tmp_path / "old").mkdir()
    shutil.copytree(path, tmp_path / "old" / "s")  # without the files beside it
    assert "label" in fs.read_store(spark, str(tmp_path / "old" / "s")).columns


def test_store_info_of_any_store(spark, tmp_path):
    rows = spark.createDataFrame(make_rows(), SCHEMA)
    fs.write_shards(rows, str(tmp_path / "packed"), storage="half")
    fs.write_shards(rows.drop("gt_logvar"), str(tmp_path / "old"))
    for name, logvars in (("packed", 28), ("old", 0)):
        info = shards.store_info(spark.read.parquet(str(tmp_path / name))).first()
        assert (info["token_values"], info["latent_values"], info["with_logvar"]) == (6, 4, logvars)


def test_lookup(spark, store):
    rows = make_rows()
    got = fs.lookup(spark, store, [27, 0, 10, 0, 400]).orderBy("list_pos").collect()
    assert [(r["list_pos"], r["idx"], r["tokens"]) for r in got] == [
        (p, i, rows[i][5]) for p, i in ((0, 27), (1, 0), (2, 10), (3, 0))
    ]


def test_lookup_uneven_shards(spark, tmp_path):
    # a short middle shard must not shift later indices
    path = str(tmp_path / "s")
    rows = make_rows((10, 3, 8))
    fs.write_shards(spark.createDataFrame(rows, SCHEMA), path)
    got = fs.lookup(spark, path, list(range(21))).orderBy("idx").collect()
    assert [r["item_id"] for r in got] == [r[1] for r in rows]


def test_index_map_and_global_index(spark, store):
    meta = fs.committed_shards(spark, store)
    mapped = {r["global_idx"]: (r["shard_id"], r["offset"]) for r in shards.index_map(meta).collect()}
    assert mapped == {r[0]: (r[3], r[4]) for r in make_rows()}
    rows = spark.createDataFrame(make_rows(), SCHEMA).drop("global_idx")
    assert {(r["item_id"], r["global_idx"]) for r in shards.global_index(rows).collect()} == {
        (r[1], r[0]) for r in make_rows()
    }


def test_index_map_of_a_huge_shard_stays_in_small_pieces(spark):
    meta = spark.createDataFrame([(0, 3), (1, 20_000), (5, 2)], "shard_id int, n_images long")
    got = shards.index_map(meta)
    assert got.count() == 20_005 and got.agg(F.max("global_idx")).first()[0] == 20_004
    assert got.where("shard_id = 5").agg(F.min("global_idx")).first()[0] == 20_003


def test_shard_meta(spark):
    df = spark.createDataFrame(make_rows(), SCHEMA).repartition(5)
    meta = {r["shard_id"]: r for r in shards.shard_meta(df, 10).collect()}
    assert meta[2]["n_images"] == 8 and meta[1]["image_paths"] == [f"d/{i}.jpg" for i in range(10, 20)]
    with pytest.raises(Exception, match="offset beyond"):
        shards.shard_meta(df, 5).collect()


def test_old_store_without_logvar(spark, tmp_path):
    path = str(tmp_path / "s")
    old = spark.createDataFrame([r for r in make_rows() if r[3] < 2], SCHEMA).drop("gt_logvar")
    fs.write_shards(old, path)
    assert fs.read_store(spark, path).where(F.forall("gt_logvar", lambda v: v == 0)).count() == 20
    fs.write_shards(spark.createDataFrame([r for r in make_rows() if r[3] == 2], SCHEMA), path)
    back = fs.read_store(spark, path)
    assert back.where(F.size("gt_logvar") == 4).count() == 28
    assert back.where("shard_id = 2 and gt_logvar[0] <> 0").count() == 8


def test_load_shards(spark, store, tmp_path):
    held = fs.load_shards(spark, store, 2)
    assert held.count() == 20 and held.is_cached
    held.unpersist()
    with pytest.raises(FileNotFoundError, match=r"\[3\]"):
        fs.load_shards(spark, store, 4)
    planned = spark.createDataFrame([(0, 10), (1, 10), (2, 10)], "shard_id int, n_images long")
    with pytest.raises(FileNotFoundError, match=r"\[2\]"):  # short shard
        fs.load_shards(spark, store, 3, planned)


def test_resume_fills_holes(spark):
    plan = spark.createDataFrame([(s, 10) for s in range(6)], "shard_id int, n_images long")
    done = spark.createDataFrame([(0, 10), (2, 10), (3, 7), (5, 10)], "shard_id int, n_images long")
    assert sorted(r["shard_id"] for r in shards.resume_plan(plan, done).collect()) == [1, 3, 4]
    assert shards.resume_plan(plan, done.where("false")).count() == 6
    audit = shards.shard_audit(plan, done)
    assert sorted(map(tuple, audit.collect())) == [(1, 10, 0), (3, 10, 7), (4, 10, 0)]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.booleans(), min_size=1, max_size=12))
def test_resume_and_committed_cover_the_plan(spark, kept):
    plan = spark.createDataFrame([(s, 3) for s in range(len(kept))], "shard_id int, n_images long")
    done = plan.where(F.col("shard_id").isin([s for s, k in enumerate(kept) if k] or [-1]))
    pending = {r["shard_id"] for r in shards.resume_plan(plan, done).collect()}
    assert pending == {s for s, k in enumerate(kept) if not k}


def items(spark, pairs):
    return spark.createDataFrame(pairs, "file_name string, parent string")


def test_fingerprint(spark):
    def of(pairs):
        return shards.dataset_fingerprint(items(spark, pairs)).first()["fingerprint"]

    pairs = [(f"{i}.jpg", f"d{i % 3}") for i in range(50)]
    assert of(pairs) == of(pairs[::-1]) and len(of(pairs)) == 16
    assert of(pairs) != of(pairs[1:]) and of([("a.jpg", "x")]) != of([("a.jpg", "y")])


def test_fingerprint_delimits_names(spark):
    a, b = items(spark, [("ab", "c")]), items(spark, [("a", "bc")])
    assert shards.dataset_fingerprint(a).first() != shards.dataset_fingerprint(b).first()


def test_manifest_and_validation(spark, store, tmp_path):
    manifest, models = str(tmp_path / "m"), {"encoder": "e1", "latent": "v1"}
    its = items(spark, [(f"{i}.jpg", "d") for i in range(28)])
    with pytest.raises(FileNotFoundError):
        fs.load_manifest(spark, manifest)
    assert fs.validate_store(spark, manifest, its, models) == ["no_manifest"]
    fs.save_manifest(spark, manifest, its, models, store=store, shard_size=10, dataset_root="/data")
    row = fs.load_manifest(spark, manifest).first()
    assert (row["total_shards"], row["shard_count"], row["last_shard"]) == (3, 3, 2)
    assert row["model_versions"] == models and row["dataset_root"] == "/data" and row["created_at"] is not None
    assert fs.validate_store(spark, manifest, its, models) == []
    assert fs.validate_store(spark, manifest, its.limit(5), models) == ["hash"]
    changed = {"encoder": "e2", "latent": "v1", "extra": "x"}
    assert fs.validate_store(spark, manifest, its, changed) == ["model:encoder", "model:extra"]


def test_manifest_ignores_unknown_fields(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "part.json").write_text('{"version": 2, "shard_count": 4, "surprise": [1, 2]}')
    row = fs.load_manifest(spark, str(tmp_path / "m")).first()
    assert (row["version"], row["shard_count"], row["dataset_hash"]) == (2, 4, None)


def test_estimate_counts_every_tensor(spark):
    n, size = shards.estimate_store(337_038, [(1024, 384), (16, 64, 64), (16, 64, 64)])
    row = spark.range(1).select(n.alias("n"), size.alias("b")).first()
    assert row["n"] == 338 and row["b"] == 337_038 * 2 * (1024 * 384 + 2 * 65536)
