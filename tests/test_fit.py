import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import fit, mappers, registry
from tensorloom.operators.latent import upsample_matrix

GEO = {"dim": 5, "latent": 2, "grid": 3, "width": 4, "layers": 2}


def make_store(spark, n=40, seed=0, parts=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 9, 5)).astype(np.float32)
    w = rng.standard_normal((5, 2))
    up = upsample_matrix(3)
    y = up @ ((x @ w).transpose(0, 2, 1).reshape(n, 2, 3, 3)) @ up.T + 0.1 * rng.standard_normal((n, 2, 6, 6))
    lv = 0.3 * rng.standard_normal((n, 2, 6, 6)) - 1
    rows = [(i, i // 10, *(a[i].ravel().tolist() for a in (x, y, lv))) for i in range(n)]
    df = spark.createDataFrame(
        rows, "item_id long, shard_id int, tokens array<float>, gt_mean array<float>, gt_logvar array<float>"
    ).repartition(parts)
    return df, x.astype(np.float64), y.astype(np.float32).astype(np.float64), lv.astype(np.float32).astype(np.float64)


def test_fit_linear_equals_lstsq(spark):
    df, x, y, lv = make_store(spark)
    up = upsample_matrix(3)
    wide = (up @ x.transpose(0, 2, 1).reshape(-1, 5, 3, 3) @ up.T).reshape(len(x), 5, -1).transpose(0, 2, 1).reshape(-1, 5)
    design = np.column_stack([wide, np.ones(len(wide))])
    p = fit.fit_linear(df, mappers.create_mapper("linear", **GEO))
    for head, target in (("mean", y), ("logvar", lv)):
        flat = target.reshape(len(x), 2, -1).transpose(0, 2, 1).reshape(-1, 2)
        want = np.linalg.lstsq(design, flat, rcond=None)[0]
        assert np.allclose(p[f"{head}.w"], want[:-1]) and np.allclose(p[f"{head}.b"], want[-1])


@pytest.mark.parametrize("parts", [1, 40])
def test_nearly_collinear_tokens(spark, parts):
    """Condition about 1e8: the factor keeps the digits that squared moments lose; 40 tasks are two rounds of merges."""
    rng = np.random.default_rng(11)
    n, up = 80, upsample_matrix(3)
    x = rng.standard_normal((n, 9, 5))
    x[:, :, 4] = x[:, :, 0] + 1e-8 * x[:, :, 4]
    w = rng.standard_normal((5, 4))
    y = up @ ((x @ w).transpose(0, 2, 1).reshape(n, 4, 3, 3)) @ up.T
    rows = [(i, x[i].ravel().tolist(), y[i, :2].ravel().tolist(), y[i, 2:].ravel().tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "item_id long, tokens array<double>, gt_mean array<double>, gt_logvar array<double>").repartition(parts)
    spec = mappers.create_mapper("linear", **GEO)
    wide = (up @ x.transpose(0, 2, 1).reshape(-1, 5, 3, 3) @ up.T).reshape(n, 5, -1).transpose(0, 2, 1).reshape(-1, 5)
    design = np.column_stack([wide, np.ones(len(wide))])
    assert 1e7 < np.linalg.cond(design) < 1e10
    p = fit.fit_linear(df, spec)
    flat = y.reshape(n, 4, -1).transpose(0, 2, 1).reshape(-1, 4)
    want = np.linalg.lstsq(design, flat, rcond=None)[0]
    got = np.concatenate([np.vstack([p[f"{h}.w"], p[f"{h}.b"]]) for h in ("mean", "logvar")], axis=1)
    assert np.allclose(got, want, rtol=1e-6, atol=1e-6) and np.allclose(design @ got, flat, atol=1e-9)
    xtx, xty, _ = fit.linear_moments(df, 5, 2, 3)
    assert not np.allclose(np.linalg.lstsq(xtx, xty, rcond=None)[0], want, rtol=1e-6, atol=1e-6)


def test_ridge_and_collinear_tokens(spark):
    df, x, y, lv = make_store(spark, n=12)
    spec, up = mappers.create_mapper("linear", **GEO), upsample_matrix(3)
    wide = (up @ x.transpose(0, 2, 1).reshape(-1, 5, 3, 3) @ up.T).reshape(len(x), 5, -1).transpose(0, 2, 1).reshape(-1, 5)
    design = np.column_stack([wide, np.ones(len(wide))])
    flat = y.reshape(len(x), 2, -1).transpose(0, 2, 1).reshape(-1, 2)
    penalty = 0.1 * len(design) * np.diag([1.0] * 5 + [0.0])
    want = np.linalg.solve(design.T @ design + penalty, design.T @ flat)
    p = fit.fit_linear(df, spec, ridge=0.1)
    assert np.allclose(np.vstack([p["mean.w"], p["mean.b"]]), want)
    same = df.withColumn("tokens", F.transform("tokens", lambda v, i: F.when(i % 5 == 4, F.get("tokens", i - 4)).otherwise(v)))
    twice = fit.fit_linear(same, spec)
    assert np.allclose(twice["mean.w"][0], twice["mean.w"][4])  # least norm shares the weight


def test_moments_ignore_partitioning_and_empty_tasks(spark):
    df, x, _, _ = make_store(spark, n=7, parts=6)
    a = fit.linear_moments(df, 5, 2, 3)
    b = fit.linear_moments(df.coalesce(1), 5, 2, 3)
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1]) and a[2] == b[2] == 7 * 36
    with pytest.raises(ValueError):
        fit.fit_linear(df.where("false"), mappers.create_mapper("linear", **GEO))


@pytest.mark.parametrize(("name", "norm"), [("linear", True), ("mlp", True), ("mlp", False)])
def test_gradient_by_finite_differences(name, norm):
    spec = mappers.create_mapper(name, norm=norm, **GEO)
    rng = np.random.default_rng(3)
    p = mappers.init_weights(spec, 1)
    x, noise = rng.standard_normal((2, 9, 5)), rng.standard_normal((2, 9, 2))
    gm, gl = rng.standard_normal((2, 2, 2, 6, 6))
    beta = 0.3

    def value(vector):
        _, m, k = fit.loss_and_gradient(spec, fit.from_vector(spec, vector), x, gm, gl, noise, beta)
        return m + beta * k

    grad = fit.to_vector(fit.loss_and_gradient(spec, p, x, gm, gl, noise, beta)[0])
    base = fit.to_vector(p)
    for i in rng.choice(base.size, min(40, base.size), replace=False):
        step = np.zeros_like(base)
        step[i] = 1e-5
        assert np.isclose(grad[i], (value(base + step) - value(base - step)) / 2e-5, rtol=1e-4, atol=1e-7)


def test_no_gradient_for_deep_mappers():
    spec = mappers.create_mapper("resnet", **GEO)
    with pytest.raises(ValueError):
        fit.loss_and_gradient(spec, {}, None, None, None, None, 0.1)


def test_step_is_the_mean_over_rows(spark):
    df, x, y, lv = make_store(spark, n=11)
    spec = mappers.create_mapper("linear", **GEO)
    p = mappers.init_weights(spec)
    grad, mse, kl, n = fit.gradient_step(df, spec, p, step=4, seed=2, batch_size=3)
    noise = mappers.row_noise(2 * 1_000_003 + 4, np.arange(11), (9, 2))
    want, m, k = fit.loss_and_gradient(spec, p, x, y, lv, noise, 1e-4)
    assert n == 11 and np.isclose(mse, m / 11) and np.isclose(kl, k / 11)
    assert np.allclose(grad, fit.to_vector(want) / 11)


@pytest.mark.parametrize("name", ["linear", "mlp"])
def test_loss_falls(spark, name):
    df, *_ = make_store(spark)
    _, log = fit.fit_gradient(df, mappers.create_mapper(name, **GEO), epochs=6, steps_per_epoch=2, lr=0.05)
    assert log[-1][3] < log[0][3]
    assert [r[2] for r in log] == sorted({r[2] for r in log})


def test_every_row_is_used_once_per_epoch(spark):
    df, *_ = make_store(spark)
    seen = []
    original = fit.gradient_step

    def spy(rows, *args):
        seen.extend(r["item_id"] for r in rows.select("item_id").collect())
        return original(rows, *args)

    fit.gradient_step = spy
    try:
        fit.fit_gradient(df, mappers.create_mapper("linear", **GEO), epochs=1, steps_per_epoch=3)
    finally:
        fit.gradient_step = original
    assert sorted(seen) == list(range(40))


def test_resume_equals_an_unbroken_run(spark, tmp_path):
    df, *_ = make_store(spark)
    spec, path = mappers.create_mapper("mlp", **GEO), str(tmp_path / "ckpt")
    options = {"epochs": 4, "lr": 0.05, "warmup_steps": 3}

    def save(epoch, p, opt, _loss):
        if epoch == 2:
            registry.checkpoint_save(spark, path, "r", epoch, p, opt)

    whole, _ = fit.fit_gradient(df, spec, on_epoch=save, **options)
    epoch, p, opt = registry.checkpoint_load(spark, path, "r", spec)
    assert epoch == 2 and opt.t == 2
    again, log = fit.fit_gradient(df, spec, params=p, optimizer=opt, start_epoch=epoch, **options)
    assert [r[0] for r in log] == [2, 3]
    assert np.allclose(fit.to_vector(whole), fit.to_vector(again))


def test_checkpoint_parts_and_latest(spark, tmp_path):
    spec, path = mappers.create_mapper("linear", **GEO), str(tmp_path / "c")
    p = mappers.init_weights(spec)
    registry.checkpoint_save(spark, path, "a", 5, p)
    registry.checkpoint_save(spark, path, "a", 10, {k: v + 1 for k, v in p.items()}, final=True)
    epoch, back, opt = registry.checkpoint_load(spark, path, "a", spec)
    assert epoch == 10 and opt is None and np.allclose(back["mean.w"], p["mean.w"] + 1)
    assert registry.checkpoint_load(spark, path, "a", spec, epoch=5)[0] == 5
    other = mappers.create_mapper("mlp", **GEO)
    assert registry.checkpoint_load(spark, path, "a", other)[1] is None  # partial restore
    with pytest.raises(FileNotFoundError):
        registry.checkpoint_load(spark, path, "zzz", spec)


def test_partial_restore(spark, tmp_path):
    spec, path = mappers.create_mapper("linear", **GEO), str(tmp_path / "c")
    p = mappers.init_weights(spec)
    registry.checkpoint_save(spark, path, "a", 5, p, fit.AdamW(fit.to_vector(p).size))
    whole = registry.checkpoint_restore(spark, path, "a", spec, mappers.init_weights(spec, 9))
    assert whole.restored == list(p) and not whole.missing and whole.optimizer is not None
    assert np.allclose(fit.to_vector(whole.params), fit.to_vector(p))
    other = mappers.create_mapper("mlp", **GEO)  # other weights in the heads, layers of its own
    start = mappers.init_weights(other, 3)
    part = registry.checkpoint_restore(spark, path, "a", other, start)
    assert part.restored == ["mean.b", "logvar.b"] and part.reshaped == ["mean.w", "logvar.w"] and "mlp0.w" in part.missing
    assert part.epoch == 5 and part.optimizer is None and list(part.params) == list(start)
    assert all(np.allclose(v, p[n] if n in part.restored else start[n]) for n, v in part.params.items())
    assert {r["param"]: r["status"] for r in registry.restore_plan(spark.createDataFrame([("x", [1])], "param string, shape array<int>"), spec).collect()} == {
        "x": "unused", **dict.fromkeys(p, "missing")
    }
    with pytest.raises(FileNotFoundError):
        registry.checkpoint_restore(spark, path, "zzz", spec, p)


def test_stored_parameters_are_counted(spark):
    spec = mappers.create_mapper("mlp", **GEO)
    table = mappers.weights_table(spark, mappers.init_weights(spec), "r", 2)
    assert tuple(mappers.param_totals(table).first()) == ("r", 2, len(mappers.param_shapes(spec)), mappers.param_count(spec), True)
    assert not mappers.param_totals(table.withColumn("shape", F.array(F.lit(1)))).first()["whole"]


def test_hashed_weights_have_the_ranges_of_the_first_ones(spark):
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, seed int")
    for name in ("linear", "mlp"):
        spec = mappers.create_mapper(name, dim=40, latent=8, grid=3, width=30, layers=1)
        rows = mappers.hashed_weights(runs, spec).toPandas()
        for param, want in mappers.init_weights(spec).items():
            own = rows[(rows.run_id == "a") & (rows.param == param)].sort_values("i").value.to_numpy()
            assert own.size == want.size and np.isclose(own.std(), want.std(), rtol=0.35) and np.abs(own).max() <= np.abs(want).max() * 1.5 + 1e-12
        a, b = (rows[(rows.run_id == r) & (rows.param == "mean.w")].value.to_numpy() for r in "ab")
        assert not np.allclose(np.sort(a), np.sort(b))


@pytest.mark.parametrize(("epochs", "every", "want"), [(12, 5, [5, 10, 12]), (10, 5, [5, 10]), (3, 5, [3])])
def test_save_set(spark, epochs, every, want):
    df = spark.createDataFrame([("r", e, epochs) for e in range(epochs)], "run_id string, epoch int, epochs int")
    rows = registry.save_set(df, every).orderBy("saved_epoch").collect()
    assert [r["saved_epoch"] for r in rows] == want and [r["final"] for r in rows] == [False] * (len(want) - 1) + [True]


def test_run_config(spark):
    config = registry.RunConfig()
    assert (config.lr, config.epochs, config.batch_size, config.beta, config.save_every) == (1e-3, 100, 8, 1e-4, 5)
    debug = config.for_debug()
    assert (debug.epochs, debug.batch_size, debug.warmup_steps, debug.debug) == (2, 2, 2, True)
    table = registry.run_config(spark, "r1", config).unionByName(registry.run_config(spark, "r2", debug))
    assert {r["run_id"]: r["epochs"] for r in table.collect()} == {"r1": 100, "r2": 2}
    assert mappers.param_count(config.spec()) == 306_208


def test_fit_compare(spark):
    df, *_ = make_store(spark, n=4)
    specs = {n: mappers.create_mapper(n, **GEO) for n in ("linear", "mlp")}
    rows = {r["mapper"]: r for r in fit.fit_compare(df, specs, steps=8, lr=0.05).collect()}
    assert set(rows) == {"linear", "mlp"} and all(r["after"] < r["before"] for r in rows.values())
