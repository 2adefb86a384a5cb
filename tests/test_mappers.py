import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import mappers
from tensorloom.operators.encode import cut, encode_features, patch_encoder
from tensorloom.operators.latent import drop_leading_tokens

SMALL = {"dim": 8, "latent": 3, "grid": 4, "width": 6, "heads": 2, "layers": 2, "blocks": 2}
NAMES = list(mappers.SPECS)


# fixed values: parameter counts at the class defaults
@pytest.mark.parametrize(
    ("name", "n"),
    [("linear", 12_320), ("mlp", 306_208), ("resnet", 17_090_080), ("transformer", 1_788_320), ("transformer_resnet", 18_866_080)],
)
def test_param_count(name, n):
    assert mappers.param_count(mappers.SPECS[name]) == n


def test_param_count_narrow_resnet():
    assert mappers.param_count(mappers.create_mapper("resnet", width=256, blocks=4)) == 637_728


def test_unknown_mapper():
    with pytest.raises(ValueError, match="unknown mapper"):
        mappers.create_mapper("cnn")


def test_erf_and_gelu():
    x = np.linspace(-9, 9, 4001)
    assert np.abs(mappers.erf(x) - [math.erf(v) for v in x]).max() < 1e-9
    assert np.allclose(mappers.gelu(np.array([0.0, 1.0, -1.0])), [0, 0.8413447, -0.1586553])


@pytest.mark.parametrize("norm", [True, False])
@pytest.mark.parametrize("name", NAMES)
def test_forward(name, norm):
    spec = mappers.create_mapper(name, norm=norm, **SMALL)
    p = mappers.init_weights(spec, 1)
    assert {k: a.shape for k, a in p.items()} == mappers.param_shapes(spec)
    x = np.random.default_rng(0).standard_normal((5, 16, 8))
    z, mean, logvar = mappers.forward(spec, p, x)
    assert z.shape == mean.shape == logvar.shape == (5, 3, 8, 8)
    assert np.array_equal(z, mean) and not np.allclose(mean, logvar)
    # a row's result does not depend on its batch
    assert np.allclose(mappers.forward(spec, p, x[2:3])[1], mean[2:3])
    noisy = mappers.forward(spec, p, x, np.ones((5, 16, 3)))[0]
    assert not np.allclose(noisy, mean)


def test_attention_by_hand():
    spec = mappers.create_mapper("transformer", **{**SMALL, "heads": 2})
    p = mappers.init_weights(spec, 3)
    x = np.random.default_rng(1).standard_normal((1, 16, 8))
    qkv = x[0] @ p["att0.qkv.w"] + p["att0.qkv.b"]
    heads = []
    for h in range(2):
        q, k, v = (qkv[:, o + 4 * h : o + 4 * h + 4] for o in (0, 8, 16))
        w = np.exp(q @ k.T / 2.0)
        heads.append(w / w.sum(1, keepdims=True) @ v)
    want = np.concatenate(heads, axis=1) @ p["att0.out.w"] + p["att0.out.b"]
    assert np.allclose(mappers.attend(p, "att0", x, 2)[0], want)


def test_init_bounds():
    spec = mappers.create_mapper("mlp")
    p = mappers.init_weights(spec)
    bound = math.sqrt(6 / (384 + 256))
    assert abs(p["mlp0.w"]).max() <= bound and abs(p["mlp0.w"]).max() > 0.99 * bound
    assert not p["mlp0.b"].any() and (p["mlp0.ln.g"] == 1).all()
    linear = mappers.init_weights(mappers.create_mapper("linear"))
    assert 0 < abs(linear["mean.b"]).max() <= 1 / math.sqrt(384)


@pytest.mark.parametrize("name", NAMES)
def test_score_equals_forward_and_ignores_partitioning(spark, name):
    spec = mappers.create_mapper(name, **SMALL)
    p = mappers.init_weights(spec, 2)
    x = np.random.default_rng(4).standard_normal((23, 16, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, r.ravel().tolist()) for i, r in enumerate(x)], "item_id long, tokens array<float>")
    noise = mappers.row_noise(7, np.arange(23), (16, 3))
    want = mappers.forward(spec, p, x.astype(np.float64), noise)
    for parts, batch in ((1, 4), (5, 32)):
        rows = mappers.score(df.repartition(parts), spec, p, sample=True, seed=7, batch_size=batch).orderBy("item_id").collect()
        for c, w in zip(("pred_z", "pred_mean", "pred_logvar"), want, strict=True):
            assert np.allclose(np.array([r[c] for r in rows]), w.reshape(23, -1), atol=1e-5)


def test_weights_table_round_trip(spark):
    p = mappers.init_weights(mappers.create_mapper("mlp", **SMALL))
    back = mappers.weights_from_table(mappers.weights_table(spark, p, "r", 3))
    assert all(np.array_equal(back[k], a) for k, a in p.items())


def test_full_size_score(spark):
    spec = mappers.create_mapper("linear")
    x = np.random.default_rng(0).standard_normal((2, 1024 * 384)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "item_id long, tokens array<float>")
    row = mappers.score(df, spec, mappers.init_weights(spec)).select(F.size("pred_z"), F.size("pred_logvar")).first()
    assert tuple(row) == (16 * 64 * 64,) * 2


def test_encode_features(spark):
    encoder = patch_encoder(3, 8, 4, 5, 2, seed=3, leading=5)
    x = np.random.default_rng(0).random((7, 3, 8, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, r.ravel().tolist()) for i, r in enumerate(x)], "i long, pixels array<float>")
    out = encode_features(df, encoder, batch_size=3).withColumn("kept", drop_leading_tokens(F.col("tokens"), 5, 5))
    rows = out.orderBy("i").collect()
    want = encoder.make_predict_fn()(x)
    assert np.allclose([r["tokens"] for r in rows], want["tokens"], atol=1e-6)
    assert np.allclose([r["gt_logvar"] for r in rows], want["gt_logvar"], atol=1e-6)
    assert {len(r["kept"]) for r in rows} == {20} and {len(r["gt_mean"]) for r in rows} == {32}
    assert cut(x, 4).shape == (7, 4, 48) and np.array_equal(cut(x, 4)[0, 1], x[0, :, :4, 4:].ravel())


def test_score_losses_equal_expressions(spark):
    from tensorloom.operators import loss

    spec = mappers.create_mapper("mlp", **SMALL)
    p = mappers.init_weights(spec, 2)
    rng = np.random.default_rng(4)
    rows = [(i, *(rng.standard_normal(k).tolist() for k in (128, 192, 192))) for i in range(9)]
    df = spark.createDataFrame(rows, "item_id long, tokens array<float>, gt_mean array<float>, gt_logvar array<float>")
    a = loss.evaluate(mappers.score(df, spec, p)).first()
    b = loss.evaluate(mappers.score_losses(df.repartition(3), spec, p, keep=["item_id"], batch_size=2)).first()
    assert a["n_rows"] == b["n_rows"] == 9
    assert math.isclose(a["loss"], b["loss"], rel_tol=1e-5) and math.isclose(a["kl"], b["kl"], rel_tol=1e-5)
