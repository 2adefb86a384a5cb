import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators.panel import png_bytes
from tensorloom.plans.images import image_batches
from tensorloom.plans.queries_inventory import a3_read_files
from tensorloom.sources import images, inventory
from tensorloom.streaming import ingest
from tensorloom.streaming.ingest import incremental_ingest

SIZES = [(8, 6), (10, 12), (32, 32), (23, 60)]  # height, width


def write_png(path, h, w, seed):
    img = np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(png_bytes(img))
    return img


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for d in range(3):
        for i in range(10):
            path = root / f"{d:04d}" / f"{i:07d}.jpg"
            path.parent.mkdir(exist_ok=True)
            path.write_bytes(b"x" * (d * 10 + i + 1))
    (root / "0000" / "notes.txt").write_text("no image")
    return root


@pytest.mark.parametrize(
    ("pattern", "n"),
    [("**/*.jpg", 30), ("*.jpg", 30), ("0001/*.jpg", 10), ("000[12]/**/*.jpg", 20), ("**/*5.jpg", 3), ("*.png", 0)],
)
def test_scan(spark, tree, pattern, n):
    assert inventory.scan_items(spark, str(tree), pattern).count() == n


def test_scan_several_patterns_and_parts(spark, tree):
    items = inventory.scan_items(spark, str(tree), ["**/*.jpg", "**/*.txt"])
    assert items.count() == 31
    row = items.where("file_name = '0000003.jpg' and parent = '0002'").first()
    assert (row["ext"], row["length"]) == ("jpg", 24)


def test_scan_sees_below_the_root_and_every_name(spark, tmp_path):
    root = tmp_path / "train"
    names = ["a.jpg", "train/b.jpg", "x/_c.jpg", "x/.g.jpg", "_hid/e.jpg", "x/deep/train/f.jpg"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"1")

    def below(pattern):
        return sorted(r["path"].split("/train/", 1)[1] for r in inventory.scan_items(spark, str(root), pattern).collect())

    assert below("**/*.jpg") == sorted(names)
    assert below("train/*.jpg") == ["train/b.jpg", "x/deep/train/f.jpg"]
    assert below("_hid/*") == ["_hid/e.jpg"]
    (tmp_path / "empty").mkdir()
    assert inventory.scan_items(spark, str(tmp_path / "empty"), "*").count() == 0


def test_snapshot_reuses_and_refreshes(spark, tree, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "snap")
    root.mkdir()
    (root / "a.jpg").write_bytes(b"1")
    assert inventory.inventory_snapshot(spark, store, str(root)).count() == 1
    (root / "b.jpg").write_bytes(b"2")
    assert inventory.inventory_snapshot(spark, store, str(root)).count() == 1  # kept listing
    assert inventory.inventory_snapshot(spark, store, str(root), refresh=True).count() == 2
    assert inventory.inventory_snapshot(spark, store, str(tree)).count() == 30
    assert inventory.inventory_snapshot(spark, store, str(root)).count() == 2


def test_incremental_ingest_takes_only_new_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "d").mkdir(parents=True)
    args = (str(root), str(tmp_path / "sink"), str(tmp_path / "ckpt"), "*.jpg")
    (root / "d" / "a.jpg").write_bytes(b"1")
    incremental_ingest(spark, *args)
    (root / "d" / "_b.jpg").write_bytes(b"22")
    (root / "d" / "c.txt").write_bytes(b"3")
    incremental_ingest(spark, *args)
    incremental_ingest(spark, *args)
    rows = spark.read.parquet(args[1]).orderBy("length").collect()
    assert [(r["file_name"], r["parent"], r["length"]) for r in rows] == [("a.jpg", "d", 1), ("_b.jpg", "d", 2)]


def test_a_crash_between_sink_and_checkpoint_adds_no_row(spark, tmp_path, monkeypatch):
    root = tmp_path / "in"
    root.mkdir()
    args = (str(root), str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    (root / "a").write_bytes(b"1")
    ingest.incremental_ingest(spark, *args)
    (root / "b").write_bytes(b"22")
    whole = ingest.put_batch

    def crash(rows, batch, sink):
        whole(rows, batch, sink)
        raise RuntimeError("lost after the sink was written")

    monkeypatch.setattr(ingest, "put_batch", crash)
    with pytest.raises(Exception, match="lost after"):
        ingest.incremental_ingest(spark, *args)
    monkeypatch.undo()
    (root / "c").write_bytes(b"333")
    for _ in range(2):
        ingest.incremental_ingest(spark, *args)
    rows = spark.read.parquet(args[1]).select("file_name", "length").collect()
    assert sorted(map(tuple, rows)) == [("a", 1), ("b", 2), ("c", 3)]


def test_ingest_lands_changed_folders_only(spark, tmp_path):
    import os

    root = tmp_path / "in"
    for d in ("old", "new"):
        (root / d).mkdir(parents=True)
        for k in range(5):
            (root / d / f"{k}.txt").write_bytes(b"x")
    for d in ("old", "new"):
        os.utime(root / d, (1_700_000_000, 1_700_000_000))
    args = (str(root), str(tmp_path / "sink"), str(tmp_path / "ckpt"), "*.txt")
    ingest.incremental_ingest(spark, *args)
    (root / "new" / "more.txt").write_bytes(b"yy")  # changes the folder's time
    ingest.incremental_ingest(spark, *args)
    landed = spark.read.parquet(f"{tmp_path}/ckpt/landing")
    assert landed.count() == 10 + 6 and landed.where("parent = 'old'").count() == 5
    assert spark.read.parquet(args[1]).select("path").distinct().count() == spark.read.parquet(args[1]).count() == 11


def test_a_large_folder_is_listed_in_pages_by_several_tasks(spark, tmp_path):
    root = tmp_path / "flat"
    (root / "below").mkdir(parents=True)
    for k in range(3000):
        (root / f"n{k:05d}.bin").touch()
    (root / "below" / "_x").write_bytes(b"123")
    pages = list(inventory.name_pages(str(root), "", 256))
    assert max(map(len, pages)) == 256 and sum(map(len, pages)) == 3001
    listed = inventory._listed(spark.createDataFrame([("",)], "below string"), f"file:{root}", 256)
    tasks = listed.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) == 4 and max(t["count"] for t in tasks) < 1000  # no task stats the whole folder
    files = inventory.list_files(spark, str(root), 256)
    assert files.count() == 3001 and files.where("below = 'below/_x' and length = 3 and mtime is not null").count() == 1


@pytest.fixture(scope="module")
def pictures(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    arrays = {f"p{i}.png": write_png(root / f"p{i}.png", h, w, i) for i, (h, w) in enumerate(SIZES)}
    (root / "junk.png").write_bytes(b"not an image")
    return root, arrays


def named(df):
    return df.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def test_pictures_of_any_name_are_read(spark, tmp_path):
    """Names and folders that file sources hide; the root itself may be one."""
    root = tmp_path / "_root"
    below = ["a.png", "_b.png", ".c.png", "_d/e.png", "f/.g/h.png", "_k=v/i.png", "_metadata.png", "j/k.png"]
    for n, name in enumerate(below):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        write_png(root / name, 5, 4, n)
    (root / "_junk.png").write_bytes(b"not an image")
    items = inventory.scan_items(spark, str(root), "**/*.png")
    pictures = images.read_listed_images(spark, items, str(root))
    rows = {r["image"]["origin"]: r["image"] for r in pictures.collect()}
    top = f"{root}/"
    assert sorted(p.split(top)[1] for p in rows) == sorted([*below, "_junk.png"]) and pictures.count() == 9
    assert {p.split(top)[1] for p, i in rows.items() if i["height"] < 0} == {"_junk.png"}
    told = images.rejected_images(
        items.select(F.regexp_replace("path", "^file:/+", "/").alias("item_id"), "path"),
        pictures.select(F.regexp_replace("image.origin", "^file:/+", "/").alias("item_id"), "image"),
    )
    assert [(r["path"].split(top)[1], r["reason"]) for r in told.collect()] == [("_junk.png", "undecodable")]


def test_picture_files_are_opened_in_one_pass(spark, tmp_path):
    """Sums and rejects come from the rows of a single scan, so that the result itself opens no file."""
    rows = [(i, [(i * 7 + k) % 11 / 6 - 0.9 for k in range(64)], i % 3) for i in range(45)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    shown = a3_read_files(spark, str(tmp_path))
    assert "FileScan image" not in shown._jdf.queryExecution().executedPlan().toString()
    got = {r["vec_id"]: r for r in shown.collect()}
    assert len(got) == shown.count() == 45
    for i, values, _ in rows:
        levels = np.floor((np.array(values, np.float32).astype(float) + 1.0) * 127.5).astype(int)
        red, rest = int(levels.sum()), (int(levels[0]), int(levels[63]))
        want = (None,) * 5 + ("undecodable",) if i % 20 == 3 else (red, 255 * 64 - red, red, *rest, None)
        assert tuple(got[i][c] for c in ("sum_r", "sum_g", "sum_b", "first_r", "first_b", "reason")) == want


def test_load_png(spark, pictures):
    root, arrays = pictures
    rows = named(images.load_images(images.read_images(spark, str(root)))).collect()
    assert len(rows) == len(arrays) + 1
    assert [r["name"] for r in rows if r["pixels"] is None and r["height"] is None] == ["junk.png"]
    for r in rows:
        if r["name"] == "junk.png":
            continue
        want = arrays[r["name"]].transpose(2, 0, 1) / np.float32(255)
        assert (r["height"], r["width"]) == want.shape[1:]
        assert np.array_equal(np.array(r["pixels"], np.float32).reshape(want.shape), want.astype(np.float32))


def test_load_jpeg_colour(spark, tmp_path):
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(64, 48, 1)
    graphics = picture.createGraphics()
    graphics.setColor(jvm.java.awt.Color(128, 64, 200))
    graphics.fillRect(0, 0, 64, 48)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "one.jpg")))
    row = images.load_images(images.read_images(spark, str(tmp_path))).first()
    planes = np.array(row["pixels"]).reshape(3, 48, 64).mean(axis=(1, 2)) * 255
    assert np.allclose(planes, [128, 64, 200], atol=3)
    assert 0 <= min(row["pixels"]) and max(row["pixels"]) <= 1


def test_grey_and_alpha(spark):
    grey = ("g", 1, 2, 1, 0, bytearray([10, 250]))
    alpha = ("a", 1, 2, 4, 24, bytearray([1, 2, 3, 9, 4, 5, 6, 9]))
    schema = "origin string, height int, width int, nChannels int, mode int, data binary"
    df = spark.createDataFrame([(grey,), (alpha,)], f"image struct<{schema}>")
    got = {r["path"]: [round(v * 255) for v in r["pixels"]] for r in images.load_images(df).collect()}
    assert got == {"g": [10, 250] * 3, "a": [3, 6, 2, 5, 1, 4]}


def test_resize_center_crop(spark, pictures):
    root, arrays = pictures
    df = images.resize_center_crop(images.load_images(images.read_images(spark, str(root))), 8)
    for r in named(df).where("pixels is not null").collect():
        h, w = arrays[r["name"]].shape[:2]
        got = np.array(r["pixels"]).reshape(3, 8, 8)
        new_h, new_w = images.scaled_size(h, w, 8)
        assert min(new_h, new_w) == 8
        src = arrays[r["name"]].transpose(2, 0, 1) / 255.0
        full = images.triangle_weights(h, new_h) @ src @ images.triangle_weights(w, new_w).T
        top, left = round((new_h - 8) / 2), round((new_w - 8) / 2)
        assert np.allclose(got, full[:, top : top + 8, left : left + 8], atol=1e-6)


def test_triangle_weights():
    assert np.allclose(images.triangle_weights(5, 5), np.eye(5))
    assert np.allclose(images.triangle_weights(512, 100).sum(axis=1), 1)
    # halving averages with weights 1:3:3:1
    assert np.allclose(images.triangle_weights(8, 4)[1], np.array([0, 1, 3, 3, 1, 0, 0, 0]) / 8)


def test_flips_are_seeded_and_train_only(spark):
    rows = [(i, 2, 3, [float(v) for v in range(18)], "train" if i % 2 else "val") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, height int, width int, pixels array<float>, split string")
    train = F.col("split") == "train"
    got = images.random_flip(df, "id", 1, 0, train=train).orderBy("id").collect()
    base = np.arange(18.0).reshape(3, 2, 3)
    seen = set()
    for r in got:
        flip = (r["flip_h"], r["flip_v"])
        want = base[:, :: -1 if flip[1] else 1, :: -1 if flip[0] else 1]
        assert np.array_equal(np.array(r["pixels"]).reshape(3, 2, 3), want)
        seen.add(flip)
        if r["split"] == "val":
            assert flip == (False, False)
    assert len(seen) == 4
    again = images.random_flip(df.repartition(5), "id", 1, 0, train=train).orderBy("id").collect()
    assert [r["flip_h"] for r in again] == [r["flip_h"] for r in got]
    other = images.random_flip(df, "id", 1, 1, train=train).orderBy("id").collect()
    assert [r["flip_h"] for r in other] != [r["flip_h"] for r in got]


def test_get_batch_keeps_order_and_duplicates(spark):
    items = spark.range(20).withColumn("v", F.col("id") * 10)
    rows = images.get_batch(items, "id", [7, 3, 7, 99]).orderBy("list_pos").collect()
    assert [(r["list_pos"], r["v"]) for r in rows] == [(0, 70), (1, 30), (2, 70)]


def test_image_batches(spark, tmp_path):
    for i in range(64):
        write_png(tmp_path / "0000" / f"{i:07d}.png", 16 + i % 5, 16, i)
    read = images.read_images(spark, str(tmp_path)).withColumn("name", F.regexp_extract("image.origin", r"([^/]+)$", 1))
    got = image_batches(read, "name", size=8, batch_size=8, ratios=(0.7, 0.2, 0.1)).select(
        "name", "split", "batch_id", "pos_in_batch", "flip_h", F.size("pixels").alias("n")
    )
    rows = got.collect()
    sizes = {}
    for r in rows:
        sizes.setdefault((r["split"], r["batch_id"]), []).append(r["pos_in_batch"])
        assert r["n"] == 192 and (r["split"] == "train" or not r["flip_h"])
    # 44 train rows -> 5 full batches; 13 val -> 8 + 5; 7 test
    assert {k: len(v) for k, v in sizes.items()} == {
        **{("train", b): 8 for b in range(5)}, ("val", 0): 8, ("val", 1): 5, ("test", 0): 7
    }
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
