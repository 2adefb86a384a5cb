import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import fit, latent, loss


def one(spark, **arrays):
    schema = ", ".join(f"{n} array<double>" for n in arrays)
    return spark.createDataFrame([tuple(list(map(float, a)) for a in arrays.values())], schema)


@pytest.mark.parametrize(("channels", "grid"), [(1, 1), (2, 3), (4, 4), (3, 8)])
def test_upsample(spark, channels, grid):
    z = np.random.default_rng(0).standard_normal((channels, grid, grid))
    got = one(spark, z=z.ravel()).select(latent.upsample2x(F.col("z"), channels, grid)).first()[0]
    up = latent.upsample_matrix(grid)
    assert np.allclose(np.reshape(got, (channels, 2 * grid, 2 * grid)), up @ z @ up.T)


def test_upsample_rows_equals_the_expression(spark):
    z = np.random.default_rng(0).standard_normal((7, 3 * 16))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(z)], "i int, z array<double>")
    a = df.select("i", latent.upsample2x(F.col("z"), 3, 4).alias("z")).orderBy("i").collect()
    b = latent.upsample_rows(df.repartition(3), "z", 3, 4).orderBy("i").collect()
    assert np.allclose([r["z"] for r in a], [r["z"] for r in b], atol=1e-6)


def test_upsample_matrix_is_half_pixel_bilinear():
    up = latent.upsample_matrix(4)
    # source position of output o is (o + 0.5) / 2 - 0.5, clamped to the first cell
    for o in range(8):
        place = max((o + 0.5) / 2 - 0.5, 0.0)
        low = min(int(place), 3)
        want = np.zeros(4)
        want[low] += 1 - (place - low)
        want[min(low + 1, 3)] += place - low
        assert np.allclose(up[o], want)


def test_tokens_to_grid_and_drop(spark):
    t = np.arange(36)
    got = one(spark, t=t).select(
        latent.tokens_to_grid(F.col("t"), 4, 3).alias("g"), latent.drop_leading_tokens(F.col("t"), 4, 5).alias("d")
    ).first()
    assert np.array_equal(np.reshape(got["g"], (4, 3, 3)), t.reshape(9, 4).T.reshape(4, 3, 3))
    assert got["d"] == list(range(20, 36))


def test_denormalize_and_scale(spark):
    row = one(spark, v=[-2, -1, 0, 0.5, 1, 7]).select(
        latent.denormalize(F.col("v")), latent.latent_unscale(latent.latent_scale(F.col("v")))
    ).first()
    assert row[0] == [0, 0, 128, 191, 255, 255]
    assert not np.allclose(row[1], [-2, -1, 0, 0.5, 1, 7])  # the two published forms are not inverses


def test_reparameterize(spark):
    n = 4000
    df = spark.range(1).select(F.array_repeat(F.lit(2.0), n).alias("m"), F.array_repeat(F.lit(math.log(9.0)), n).alias("lv"))
    z = df.select(latent.reparameterize(F.col("m"), F.col("lv"), F.lit(5), seed=1).alias("z"))
    draw = np.array(z.first()["z"])
    assert abs(draw.mean() - 2) < 0.2 and abs(draw.std() - 3) < 0.15
    assert np.array_equal(draw, z.repartition(3).first()["z"])
    other = df.select(latent.reparameterize(F.col("m"), F.col("lv"), F.lit(6), seed=1)).first()[0]
    assert not np.array_equal(draw, other)
    fixed = df.select(latent.reparameterize(F.col("m"), F.col("lv"), F.lit(5), sample=False)).first()[0]
    assert set(fixed) == {2.0}


def test_kl_and_mse_values(spark):
    rng = np.random.default_rng(2)
    mm, lm, mv, lv = rng.standard_normal((4, 50))
    row = one(spark, mm=mm, lm=lm, mv=mv, lv=lv).select(
        loss.kl_divergence(*[F.col(c) for c in ("mm", "lm", "mv", "lv")]), loss.mse(F.col("mm"), F.col("mv"))
    ).first()
    want = 0.5 * (np.log(np.exp(lv) / np.exp(lm)) + (np.exp(lm) + (mm - mv) ** 2) / np.exp(lv) - 1)
    assert math.isclose(row[0], want.mean()) and math.isclose(row[1], ((mm - mv) ** 2).mean())
    assert one(spark, a=mm).select(loss.kl_divergence(*[F.col("a")] * 4)).first()[0] == 0


def test_kl_does_not_overflow_on_large_logvar(spark):
    df = one(spark, m=[0.0], big=[800.0], bigger=[801.0])
    got = df.select(loss.kl_divergence(F.col("m"), F.col("big"), F.col("m"), F.col("bigger"))).first()[0]
    assert math.isclose(got, 0.5 * (1 + math.exp(-1) - 1))


def test_evaluate_weights_batches_by_size(spark):
    rows = [(i, [float(i)], [0.0], [0.0], [0.0], i // 4) for i in range(10)]
    df = spark.createDataFrame(
        rows, "i int, pred_z array<double>, pred_mean array<double>, pred_logvar array<double>, gt_mean array<double>, batch_id int"
    ).withColumn("gt_logvar", F.col("gt_mean"))
    got = loss.evaluate(df).first()
    assert got["n_rows"] == 10 and math.isclose(got["mse"], np.mean(np.arange(10) ** 2))
    assert math.isclose(loss.evaluate(df.drop("batch_id")).first()["loss"], got["loss"])


def test_lr_schedule(spark):
    steps = spark.range(0, 120).withColumnRenamed("id", "step")
    got = [r["lr"] for r in loss.lr_schedule(steps, 0.5, 100, 10).orderBy("step").collect()]
    assert math.isclose(got[0], 0.05) and math.isclose(got[10], 0.5, rel_tol=1e-9)
    assert math.isclose(got[99], 0.05, rel_tol=0.05) and got[110] > got[100]  # progress is not clamped
    assert np.allclose(got, [fit.lr_at(s, 0.5, 100, 10) for s in range(120)])
