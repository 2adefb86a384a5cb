import numpy as np
from pyspark.sql import functions as F

from tensorloom.functions.half import half_value, round_half, unpack_half


def test_every_half_value_and_midpoint(spark):
    halves = np.arange(65536, dtype=np.uint16).view(np.float16)
    finite = np.sort(halves[np.isfinite(halves)].astype(np.float64))
    middles = (finite[1:] + finite[:-1]) / 2
    edges = np.array([0.0, -0.0, 65504.0, 65519.99, 65520.0, -65520.0, 1e9, 5e-9, -3e-8, np.inf, -np.inf])
    values = np.concatenate([finite, middles, np.nextafter(middles, 0), np.nextafter(middles, np.inf), edges])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    got = np.array([r["h"] for r in df.select("i", half_value(F.col("v")).alias("h")).orderBy("i").collect()])
    with np.errstate(over="ignore"):
        want = values.astype(np.float16).astype(np.float64)
    assert np.array_equal(got, want)


def test_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,)], "v double")
    got = [r[0] for r in df.select(half_value(F.col("v"))).collect()]
    assert np.isnan(got[0]) and got[1] is None


def test_pack_round_trip(spark):
    rng = np.random.default_rng(0)
    arrays = [rng.standard_normal(n).astype(np.float32) for n in (5, 0, 3)]
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(arrays)] + [(3, None)], "i int, a array<float>")
    packed = round_half(df.coalesce(1), ["a"], packed=True)
    plain = {r["i"]: r["a"] for r in round_half(df.coalesce(1), ["a"]).collect()}
    assert plain[3] is None and plain[1] == []
    assert plain[0] == arrays[0].astype(np.float16).astype(np.float32).tolist()
    rows = packed.select("i", F.octet_length("a").alias("n"), unpack_half(F.col("a")).alias("a")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [10, 0, 6, None]
    for r, a in zip(rows, arrays, strict=False):
        assert np.array_equal(np.array(r["a"], np.float32), a.astype(np.float16).astype(np.float32))
    assert rows[3]["a"] is None
