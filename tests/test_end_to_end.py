import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import mappers
from tensorloom.operators.encode import patch_encoder
from tensorloom.operators.panel import panel_error, png_bytes
from tensorloom.operators.registry import RunConfig
from tensorloom.plans.pre_encode import pre_encode
from tensorloom.plans.train import epoch_batches, run_training
from tensorloom.sources import images, inventory
from tensorloom.sources import store as fs

ENCODER = patch_encoder(3, 8, 4, 6, 2, seed=1)
SHAPES = [(4, 6), (2, 4, 4), (2, 4, 4)]
MODELS = {"encoder": "patch-1", "latent": "patch-1"}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("png")
    rng = np.random.default_rng(0)
    for i in range(23):
        (root / f"d{i % 3}").mkdir(exist_ok=True)
        img = rng.integers(0, 256, (8 + i % 3, 9, 3), dtype=np.uint8)
        (root / f"d{i % 3}" / f"{i:03d}.png").write_bytes(png_bytes(img))
    return str(root)


def inputs(spark, corpus):
    def with_id(df, path):
        return df.withColumn("item_id", F.xxhash64(F.regexp_extract(path, r"([^/]+/[^/]+)$", 1)))

    items = with_id(inventory.scan_items(spark, corpus, "**/*.png"), "path")
    pictures = with_id(images.read_images(spark, corpus), "image.origin").select("item_id", "image")
    return items, pictures


def prepare(df):
    return images.resize_center_crop(images.load_images(df.drop("path")), 8)


def run(spark, corpus, store, **options):
    items, pictures = inputs(spark, corpus)
    options = {"tensor_shapes": SHAPES, "shard_size": 5, "prepare": prepare, **options}
    return pre_encode(spark, items, pictures, ENCODER, store, MODELS, **options)


def test_pre_encode_resume_and_dry_run(spark, corpus, tmp_path):
    store = str(tmp_path / "store")
    plan = run(spark, corpus, store, dry_run=True)
    assert (plan.n_items, plan.shard_count, plan.pending_shards, plan.problems) == (23, 5, 5, ["no_manifest"])
    assert plan.estimated_bytes == 23 * 2 * (24 + 32 + 32) and not plan.written
    assert fs.committed_shards(spark, store).count() == 0

    report = run(spark, corpus, store)
    assert report.written and report.incomplete_shards == 0
    done = {r["shard_id"]: r["n_images"] for r in fs.committed_shards(spark, store).collect()}
    assert done == {0: 5, 1: 5, 2: 5, 3: 5, 4: 3}
    before = {r["item_id"]: r["tokens"] for r in fs.read_store(spark, store).collect()}
    assert len(before) == 23 and {len(t) for t in before.values()} == {24}

    # a hole and a short shard are found again and only they are rewritten
    import pathlib

    hole = pathlib.Path(store) / "shard_id=1"
    for f in hole.glob("*"):
        f.unlink()
    for f in hole.glob(".*"):
        f.unlink()
    kept = {p: p.stat().st_mtime_ns for p in pathlib.Path(store).glob("shard_id=0/*.parquet")}
    assert run(spark, corpus, store, dry_run=True).pending_shards == 1
    run(spark, corpus, store)
    assert {r["item_id"]: r["tokens"] for r in fs.read_store(spark, store).collect()} == before
    assert {p: p.stat().st_mtime_ns for p in pathlib.Path(store).glob("shard_id=0/*.parquet")} == kept
    assert run(spark, corpus, store, dry_run=True).problems == []


def test_unreadable_images_are_told_and_left_out(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for i in range(7):
        (root / f"{i}.png").write_bytes(png_bytes(np.full((8, 8, 3), i, np.uint8)))
    (root / "1.png").write_bytes(b"not an image")
    (root / "_h.png").write_bytes(png_bytes(np.full((8, 8, 3), 9, np.uint8)))
    store = str(tmp_path / "store")
    report = run(spark, str(root), store, shard_size=3)
    assert (report.n_items, report.shard_count, report.rejected, report.incomplete_shards) == (8, 3, 2, 0)
    told = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in spark.read.parquet(f"{store}_rejected").collect()}
    assert told == {"1.png": "undecodable", "_h.png": "not_read"}
    assert fs.read_store(spark, store).count() == 6
    assert run(spark, str(root), store, shard_size=3, dry_run=True).pending_shards == 0


def stored_items(spark, store):
    return sorted((r["global_idx"], r["shard_id"], r["offset"], r["item_id"]) for r in fs.read_store(spark, store).collect())


def test_subsets_and_the_full_run_share_positions(spark, corpus, tmp_path):
    store, whole = str(tmp_path / "store"), str(tmp_path / "whole")
    run(spark, corpus, whole)
    run(spark, corpus, store, subset=(7, 12))
    assert [g for g, *_ in stored_items(spark, store)] == list(range(7, 12))
    run(spark, corpus, store, subset=(3, 6))  # shard 1 keeps what it held
    assert [g for g, *_ in stored_items(spark, store)] == [3, 4, 5, *range(7, 12)]
    assert run(spark, corpus, store, subset=(3, 6), dry_run=True).pending_shards == 0
    run(spark, corpus, store)
    assert stored_items(spark, store) == stored_items(spark, whole)
    assert run(spark, corpus, store, subset=(7, 12), dry_run=True).pending_shards == 0


def test_a_crash_before_the_manifest_leaves_nothing_wrong(spark, corpus, tmp_path):
    """Same counts, shifted items: W3."""
    from tensorloom.plans.pre_encode import pre_encode as job

    store, options = str(tmp_path / "store"), {"tensor_shapes": SHAPES, "shard_size": 5, "prepare": prepare}
    items, pictures = inputs(spark, corpus)
    first = items.orderBy("path").first()["item_id"]
    job(spark, items.where(F.col("item_id") != first), pictures, ENCODER, store, MODELS, **options)
    import shutil

    shutil.rmtree(f"{store}_manifest")
    job(spark, items, pictures, ENCODER, store, MODELS, **options)
    rows = stored_items(spark, store)
    assert [g for g, *_ in rows] == list(range(23)) and len({r[3] for r in rows}) == 23


def test_a_smaller_corpus_leaves_no_old_shards(spark, corpus, tmp_path):
    from tensorloom.plans.pre_encode import pre_encode as job

    store, options = str(tmp_path / "store"), {"tensor_shapes": SHAPES, "shard_size": 5, "prepare": prepare}
    items, pictures = inputs(spark, corpus)
    job(spark, items, pictures, ENCODER, store, MODELS, **options)
    few = items.where("parent = 'd0'")
    report = job(spark, few, pictures, ENCODER, store, MODELS, resume=False, **options)
    assert report.shard_count == 2 and fs.read_store(spark, store).count() == few.count() == 8
    manifest = fs.load_manifest(spark, f"{store}_manifest").first()
    assert (manifest["total_shards"], manifest["shard_count"]) == (2, 2)


def test_other_models_items_or_storage_are_refused(spark, corpus, tmp_path):
    store = str(tmp_path / "store")
    run(spark, corpus, store, subset=(0, 10))
    items, pictures = inputs(spark, corpus)
    from tensorloom.plans.pre_encode import pre_encode as job

    options = {"tensor_shapes": SHAPES, "shard_size": 5, "prepare": prepare}
    with pytest.raises(ValueError, match="hash"):
        job(spark, items.where("parent = 'd0'"), pictures, ENCODER, store, MODELS, **options)
    with pytest.raises(ValueError, match="encoder"):
        job(spark, items, pictures, ENCODER, store, {**MODELS, "encoder": "other"}, **options)
    with pytest.raises(ValueError, match="tokens"):
        run(spark, corpus, store, storage="half")
    assert run(spark, corpus, store, resume=False).pending_shards == 5


def test_packed_store_trains(spark, corpus, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "runs")
    run(spark, corpus, store, storage="half")
    spec = mappers.create_mapper("linear", dim=6, latent=2, grid=2)
    config = RunConfig(lr=0.02, epochs=4, warmup_steps=0, save_every=3, mapper="linear", sample_indices=[0, 22], val_ratio=0.2)
    result = run_training(spark, store, spec, config, "r", out, steps_per_epoch=1)
    losses = [r["loss"] for r in result.steps.orderBy("step").collect()]
    assert losses[-1] < losses[0]
    assert result.validation.first()["n_rows"] == 4
    panels = spark.read.parquet(f"{out}/samples")
    assert {(r["epoch"], r["idx"]) for r in panels.collect()} == {(e, i) for e in (0, 3, 4) for i in (0, 22)}
    errors = {r["epoch"]: r["mse"] for r in panel_error(panels, ["epoch"]).collect()}
    assert errors[4] < errors[0]
    saved = {r["epoch"] for r in spark.read.parquet(f"{out}/checkpoints").select("epoch").distinct().collect()}
    assert saved == {3, 4}
    longer = RunConfig(**{**config.__dict__, "epochs": 5})
    resumed = run_training(spark, store, spec, longer, "r", out, resume=True, steps_per_epoch=1)
    assert [r["epoch"] for r in resumed.steps.collect()] == [4]
    assert spark.read.parquet(f"{out}/configs").count() == 1
    assert spark.read.parquet(f"{out}/steps").where("run_id = 'r'").count() == 5

    for _ in range(2):  # a repeated run replaces what it wrote
        best = run_training(spark, store, spec, config, "closed", out, closed_form=True, steps_per_epoch=1)
    assert spark.read.parquet(f"{out}/steps").where("run_id = 'closed'").count() == 4
    assert spark.read.parquet(f"{out}/configs").count() == 2
    assert best.steps.orderBy("step").first()["mse"] < losses[0]


def test_train_rows_exclude_validation(spark, corpus, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "runs")
    run(spark, corpus, store)
    spec = mappers.create_mapper("linear", dim=6, latent=2, grid=2)
    config = RunConfig(epochs=1, mapper="linear", val_ratio=0.2)
    from tensorloom.plans import train

    seen, original = [], train.fit_gradient

    def spy(rows, *args, **options):
        seen.extend(r["global_idx"] for r in rows.select("global_idx").collect())
        return original(rows, *args, **options)

    train.fit_gradient = spy
    try:
        run_training(spark, store, spec, config, "r", out)
    finally:
        train.fit_gradient = original
    assert sorted(seen) == list(range(19))


def test_epochs_visit_every_row_in_batches(spark, corpus, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "runs")
    run(spark, corpus, store)
    spec = mappers.create_mapper("linear", dim=6, latent=2, grid=2)
    config = RunConfig(epochs=2, mapper="linear", val_ratio=0.2, batch_size=8, warmup_steps=0)
    from tensorloom.operators import fit

    seen, original = [], fit.gradient_step

    def spy(rows, *args, **options):
        seen.append(sorted((r["shard_id"], r["offset"]) for r in rows.select("shard_id", "offset").collect()))
        return original(rows, *args, **options)

    fit.gradient_step = spy
    try:
        result = run_training(spark, store, spec, config, "r", out)
    finally:
        fit.gradient_step = original
    assert [len(b) for b in seen] == [8, 8, 3] * 2 and result.steps.count() == 6
    places = sorted((g // 5, g % 5) for g in range(19))
    assert sorted(sum(seen[:3], [])) == sorted(sum(seen[3:], [])) == places and seen[:3] != seen[3:]


def test_epoch_batches(spark, corpus, tmp_path):
    store = str(tmp_path / "store")
    run(spark, corpus, store)
    keys = fs.read_keys(spark, store)
    first, second = (epoch_batches(keys, 4, 1, e, 0.9).orderBy("pos").collect() for e in (0, 1))
    assert len(first) == 20 and {r["batch_id"] for r in first} == set(range(5))
    assert [r["item_id"] for r in first] != [r["item_id"] for r in second]
