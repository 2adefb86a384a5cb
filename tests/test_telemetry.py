import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import panel, telemetry
from tensorloom.operators.encode import linear_decoder
from tensorloom.streaming import ingest

LOG = """2026-06-05 10:00:00,123 [INFO] Output directory: runs/x
2026-06-05 10:00:01,000 [INFO] Training: 3 epochs, 1,000 steps/epoch
2026-06-05 10:00:02,500 [INFO]   step 1  batch=1  loss=2.1100  mse=2.0000  kl=1100.000000  lr=0.000100
2026-06-05 10:00:03,750 [INFO]   step 1,100  batch=100  loss=1.5000  mse=1.4000  kl=0.001000  lr=0.001000
broken step line
2026-06-05 10:00:04,000 [INFO] Epoch 2/3  loss=1.7500
2026-06-05 10:00:05,000 [INFO]   step 2,000  batch=1000  loss=nan  mse=nan  kl=1e-05  lr=0.000500
"""


@pytest.fixture
def runs(tmp_path):
    for run in ("alpha", "beta"):
        (tmp_path / "runs" / run / "logs").mkdir(parents=True)
        (tmp_path / "runs" / run / "logs" / "train.log").write_text(LOG)
    return str(tmp_path / "runs")


def test_parse(spark, runs):
    lines = telemetry.read_train_log(spark, runs)
    steps = telemetry.parse_steps(lines, 1000).where("run_id = 'beta'").orderBy("step").collect()
    assert [(r["step"], r["batch"], r["epoch"]) for r in steps] == [(1, 1, 0), (1100, 100, 1), (2000, 1000, 1)]
    assert steps[0]["kl"] == 1100.0 and np.isnan(steps[2]["loss"]) and steps[2]["kl"] == 1e-5
    assert steps[0]["ts"].microsecond == 500_000
    epochs = telemetry.parse_epochs(lines).collect()
    assert {(r["run_id"], r["epoch"], r["epochs"], r["loss"]) for r in epochs} == {
        ("alpha", 2, 3, 1.75), ("beta", 2, 3, 1.75)
    }


def test_tail_reads_each_file_once(spark, runs, tmp_path):
    sink, ckpt = str(tmp_path / "rows"), str(tmp_path / "ckpt")
    for _ in range(2):
        ingest.write_steps(ingest.tail_steps(spark, runs, 1000), sink, ckpt).awaitTermination()
    assert spark.read.parquet(sink).count() == 6


def test_step_line_round_trip(spark):
    df = spark.sql(
        "select timestamp'2026-06-05 10:00:00.123' ts, 1234567L step, 7L batch, 0.12344D loss, 2D mse, 1e-6D kl, 1e-3D lr"
    )
    line = df.select(telemetry.step_line(*[F.col(c) for c in ("ts", "step", "batch", "loss", "mse", "kl", "lr")]).alias("value"))
    assert "step 1,234,567  batch=7  loss=0.1234  mse=2.0000  kl=0.000001  lr=0.001000" in line.first()[0]
    row = telemetry.parse_steps(line).first()
    assert (row["step"], row["loss"], row["ts"]) == (1234567, 0.1234, df.first()["ts"]) and row["epoch"] is None


def test_thin_and_global_step(spark):
    df = spark.range(1, 251).withColumnRenamed("id", "batch")
    assert [r[0] for r in telemetry.thin_steps(df, 100).orderBy("batch").collect()] == [1, 100, 200]
    assert telemetry.thin_steps(df, 0).count() == 0
    got = df.select(telemetry.global_step(F.lit(2), F.col("batch") - 1, 250).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert tuple(got) == (501, 750)


def test_epoch_summary(spark):
    rows = [("a", 0, 1.0, 2), ("a", 0, 4.0, 1), ("a", 1, 1.0, 5), ("b", 1, 3.0, 1)]
    df = spark.createDataFrame([(r, e, v, v, v, n) for r, e, v, n in rows], "run_id string, epoch int, loss double, mse double, kl double, n int")
    got = {(r["run_id"], r["epoch"]): (r["loss"], r["delta"], r["n_samples"]) for r in telemetry.epoch_summary(df).collect()}
    assert got == {("a", 0): (2.0, None, 3), ("a", 1): (1.0, -1.0, 5), ("b", 1): (3.0, None, 1)}


def test_decode_plan_orders_numerically(spark):
    df = spark.createDataFrame([(10, "s/sample_0002.pt"), (2, "s/sample_0001.pt"), (2, "plain7")], "idx long, file string")
    plan = panel.decode_plan(df.withColumn("epoch", F.lit(0)), fmt="jpg", source="file")
    rows = plan.where("epoch is not null").orderBy("idx").collect()
    assert [r["out_key"] for r in rows] == ["idx_2/epoch_0001.jpg", "idx_10/epoch_0002.jpg"]


def read_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    w, h = struct.unpack(">II", data[16:24])
    n = struct.unpack(">I", data[33:37])[0]
    raw = np.frombuffer(zlib.decompress(data[41 : 41 + n]), np.uint8).reshape(h, 1 + 3 * w)
    assert not raw[:, 0].any()
    return raw[:, 1:].reshape(h, w, 3)


def test_decode_samples(spark, tmp_path):
    z = np.random.default_rng(0).standard_normal((6, 4, 5, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, 0, r.ravel().tolist()) for i, r in enumerate(z)], "idx long, epoch int, pred_z array<float>")
    decoder = linear_decoder(4, 5, seed=1)
    rows = panel.decode_samples(df, decoder, 5).orderBy("idx").collect()
    pixels = decoder.make_predict_fn()(z)["pixels"].reshape(6, 3, 5, 5)
    for r, p in zip(rows, pixels, strict=True):
        want = np.floor((np.clip(p, -1, 1) + 1) / 2 * 255 + 0.5).transpose(1, 2, 0)
        assert np.abs(read_png(r["image"]).astype(int) - want).max() <= 1
        (tmp_path / f"{r['idx']}.png").write_bytes(r["image"])
    # the JVM reads our PNG files
    assert spark.read.format("image").load(str(tmp_path)).where("image.height = 5 and image.width = 5").count() == 6


def cells(spark, specs):
    rows = []
    for run, epoch, idx, h, w in specs:
        level = 10 * epoch + idx
        rows.append((run, epoch, idx, h, w, bytearray([level] * (h * w * 3))))
    return spark.createDataFrame(rows, "run_id string, epoch int, idx long, height int, width int, levels binary")


def test_comparison_grid(spark):
    df = cells(spark, [("r", e, i, 4 if i == 2 else 2, 3, ) for e in (1, 2, 10) for i in (2, 10)])
    row = panel.comparison_grid(df).first()
    page = read_png(row["image"])
    assert page.shape == (12, 6, 3)  # rows are epochs in number order, cells as tall as the tallest
    assert [[int(page[y, x, 0]) for x in (0, 3)] for y in (0, 4, 8)] == [[12, 20], [22, 30], [102, 110]]


def test_comparison_grid_pages_lose_nothing(spark):
    df = cells(spark, [("r", e, i, 1, 1) for e in range(5) for i in range(7)])
    pages = {(r["page_x"], r["page_y"]): read_png(r["image"]) for r in panel.comparison_grid(df, columns=3, rows=2).collect()}
    assert {k: p.shape[:2] for k, p in pages.items()} == {
        (x, y): (2 if y < 2 else 1, 3 if x < 2 else 1) for x in range(3) for y in range(3)
    }
    assert pages[2, 2][0, 0, 0] == 46


def test_panel_error_and_grid(spark):
    rows = [(e, i, [1.0, 2.0], [1.0 + e, 2.0 + i]) for e in range(2) for i in range(2)]
    df = spark.createDataFrame(rows, "epoch int, idx long, pred_z array<double>, gt_mean array<double>")
    grid = panel.error_grid(panel.panel_error(df), [0, 1]).orderBy("epoch").collect()
    assert [tuple(r) for r in grid] == [(0, 0.0, 0.5), (1, 0.5, 1.0)]


def test_panel_schedule(spark):
    df = spark.createDataFrame([("r", e, 7) for e in range(7)], "run_id string, epoch int, epochs int")
    assert sorted(r["panel_epoch"] for r in panel.panel_schedule(df, 3).collect()) == [0, 3, 6, 7]
