"""Latent arithmetic, loss, scoring and fitting queries (D and E rows)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.functions.arrays import total
from tensorloom.functions.ranking import order_rank
from tensorloom.operators import epochs, fit, latent, loss, registry
from tensorloom.operators.mappers import (
    MapperSpec,
    Params,
    create_mapper,
    hashed_weights,
    init_weights,
    param_shapes,
    param_totals,
    score,
    score_losses,
    weights_table,
)
from tensorloom.operators.split import assign_batches, uniform_shuffle
from tensorloom.plans.catalog import h32, half_sql, query, table, unnest_sql, written
from tensorloom.plans.forward_sql import formula_params, score_sql, training_sql
from tensorloom.plans.queries_store import DIM, GRID, store_path
from tensorloom.sources.store import read_keys, read_store

E = unnest_sql("embeddings", "vec_id", "embedding")
SMALL = {"dim": DIM, "latent": DIM, "grid": GRID, "width": 8, "heads": 2, "layers": 2, "blocks": 2}


def vec() -> Column:
    return F.col("embedding")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumn("embedding", vec().cast("array<double>"))


def exploded(df: DataFrame, arr: Column, name: str, digits: int | None = 6) -> DataFrame:
    rows = df.select("vec_id", F.posexplode(arr).alias("i", name))
    return rows if digits is None else rows.withColumn(name, F.round(name, digits))


# ---- latent ---------------------------------------------------------------


@query(
    "d1_tokens_to_grid",
    f"SELECT vec_id, ((i % 4) * 16 + i // 4)::INTEGER AS i, v AS value FROM ({E})",
)
def d1_tokens_to_grid(spark: SparkSession, sf: str) -> DataFrame:
    return exploded(vectors(spark, sf), latent.tokens_to_grid(vec(), DIM, GRID), "value", None)


UP_SQL = f"""w AS (SELECT o, greatest((o + 1) // 2 - 1, 0) AS s, CASE WHEN o % 2 = 0 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS k
  FROM range(8) t(o) UNION ALL
  SELECT o, least((o + 1) // 2, 3), CASE WHEN o % 2 = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END FROM range(8) t(o)),
e AS (SELECT vec_id, i % 4 AS c, i // 16 AS y, (i // 4) % 4 AS x, v FROM ({E})),
up AS (SELECT vec_id, (c * 64 + wy.o * 8 + wx.o)::INTEGER AS i, sum(v * wy.k * wx.k) AS v
  FROM e JOIN w wy ON wy.s = e.y JOIN w wx ON wx.s = e.x GROUP BY vec_id, c, wy.o, wx.o)"""


@query("d2_upsample2x", f"WITH {UP_SQL} SELECT vec_id, i, round(v, 6) AS value FROM up")
def d2_upsample2x(spark: SparkSession, sf: str) -> DataFrame:
    grids = vectors(spark, sf).select("vec_id", latent.tokens_to_grid(vec(), DIM, GRID).alias("z"))
    return exploded(latent.upsample_rows(grids, "z", DIM, GRID), F.col("z"), "value")


@query("d2_upsample_cells", f"WITH {UP_SQL} SELECT vec_id, i, round(v, 6) AS value FROM up")
def d2_upsample_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same as one expression, for latents of a few cells."""
    grid = latent.tokens_to_grid(vec(), DIM, GRID)
    return exploded(vectors(spark, sf), latent.upsample2x(grid, DIM, GRID), "value")


@query(
    "d3_latent_scale",
    f"""SELECT vec_id, i::INTEGER AS i, round((v - 0.1159::DOUBLE) / 0.3611::DOUBLE, 6) AS scaled,
  round(v / 0.3611::DOUBLE + 0.1159::DOUBLE, 6) AS unscaled FROM ({E})""",
)
def d3_latent_scale(spark: SparkSession, sf: str) -> DataFrame:
    both = F.arrays_zip(latent.latent_scale(vec()).alias("s"), latent.latent_unscale(vec()).alias("u"))
    rows = vectors(spark, sf).select("vec_id", F.posexplode(both).alias("i", "z"))
    return rows.select("vec_id", "i", F.round("z.s", 6).alias("scaled"), F.round("z.u", 6).alias("unscaled"))


@query(
    "d4_tensor_stats",
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT label, count(*)::BIGINT AS n_values, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  min(v) AS min, max(v) AS max FROM e GROUP BY label""",
)
def d4_tensor_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = latent.tensor_stats(vectors(spark, sf), "embedding", ["label"])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "d5_denormalize",
    f"""SELECT vec_id, i::INTEGER AS i,
  floor((least(greatest(v * 4, -1), 1) + 1) / 2 * 255.0::DOUBLE + 0.5)::INTEGER AS level FROM ({E})""",
)
def d5_denormalize(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors stretched by four, so that some values clamp."""
    return exploded(vectors(spark, sf), latent.denormalize(F.transform(vec(), lambda v: v * 4)), "level", None)


def noise_sql(seed: int, item: str, i: str) -> str:
    d = f"md5(concat_ws(':', '{seed}', {item}, {i}))"

    def unit(start: int) -> str:
        return f"((('0x' || substr({d}, {start}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"

    return f"sqrt(-2.0::DOUBLE * ln({unit(1)})) * cos(6.283185307179586::DOUBLE * {unit(9)})"


@query(
    "d6_reparameterize",
    f"""SELECT vec_id, i::INTEGER AS i, round(v + exp((abs(v) - 1) * 0.5) * {noise_sql(11, "vec_id", "i")}, 6) AS z,
  v AS mode FROM ({E})""",
)
def d6_reparameterize(spark: SparkSession, sf: str) -> DataFrame:
    logvar = F.transform(vec(), lambda v: F.abs(v) - 1.0)
    z = latent.reparameterize(vec(), logvar, F.col("vec_id"), seed=11)
    both = F.arrays_zip(z.alias("z"), latent.mode(vec()).alias("m"))
    rows = vectors(spark, sf).select("vec_id", F.posexplode(both).alias("i", "r"))
    return rows.select("vec_id", "i", F.round("r.z", 6).alias("z"), F.col("r.m").alias("mode"))


# ---- scoring --------------------------------------------------------------


def known_linear() -> Params:
    """Weights given by a formula, so that SQL can state them too."""
    d, c = np.arange(DIM)[:, None], np.arange(DIM)[None, :]
    return {
        "mean.w": np.cos(d + 4.0 * c),
        "mean.b": 0.1 * np.arange(DIM),
        "logvar.w": np.sin(d + 4.0 * c),
        "logvar.b": -0.1 * np.arange(DIM),
    }


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", vec().alias("tokens"))


@query(
    "e1_score_linear",
    f"""WITH t AS (SELECT vec_id, i // 4 AS n, i % 4 AS d, v FROM ({E})),
p AS (SELECT vec_id, n, c, sum(v * cos((d + 4 * c)::DOUBLE)) + 0.1::DOUBLE * c AS m,
  sum(v * sin((d + 4 * c)::DOUBLE)) - 0.1::DOUBLE * c AS l FROM t, range(4) r(c) GROUP BY vec_id, n, c)
SELECT vec_id, 256::INTEGER AS n_values, round(avg(m), 4) AS mean_avg, round(avg(l), 4) AS logvar_avg,
  round(max(CASE WHEN n = 0 AND c = 0 THEN m END)::FLOAT::DOUBLE, 4) AS first_cell,
  round(max(CASE WHEN n = 15 AND c = 3 THEN l END)::FLOAT::DOUBLE, 4) AS last_cell FROM p GROUP BY vec_id""",
)
def e1_score_linear(spark: SparkSession, sf: str) -> DataFrame:
    spec = create_mapper("linear", **SMALL)
    scored = score(tokens(spark, sf), spec, known_linear(), item="vec_id")

    def avg(c: str) -> Column:
        return F.round(total(F.col(c)) / F.size(c), 4)

    return scored.select(
        "vec_id",
        F.size("pred_z").alias("n_values"),
        avg("pred_mean").alias("mean_avg"),
        avg("pred_logvar").alias("logvar_avg"),
        F.round(F.element_at("pred_z", 1).cast("double"), 4).alias("first_cell"),
        F.round(F.element_at("pred_logvar", -1).cast("double"), 4).alias("last_cell"),
    )


def score_summary(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Scores of a mapper with formula weights over every row."""
    spec = create_mapper(name, **SMALL)
    scored = score(tokens(spark, sf), spec, formula_params(spec), item="vec_id")
    return scored.select(
        "vec_id",
        F.size("pred_z").alias("n_values"),
        F.round(total(F.col("pred_mean")) / F.size("pred_mean"), 3).alias("mean_avg"),
        F.round(total(F.col("pred_logvar")) / F.size("pred_logvar"), 3).alias("logvar_avg"),
        F.round(F.element_at("pred_z", 1).cast("double"), 3).alias("first_cell"),
        F.round(F.element_at("pred_logvar", -1).cast("double"), 3).alias("last_cell"),
    )


def deep_sql(name: str) -> str:
    return score_sql(create_mapper(name, **SMALL), E, UP_SQL.split(",\ne AS")[0])


@query("e2_score_mlp", deep_sql("mlp"))
def e2_score_mlp(spark: SparkSession, sf: str) -> DataFrame:
    return score_summary(spark, sf, "mlp")


@query("e3_score_resnet", deep_sql("resnet"))
def e3_score_resnet(spark: SparkSession, sf: str) -> DataFrame:
    return score_summary(spark, sf, "resnet")


@query("e4_score_transformer", deep_sql("transformer"))
def e4_score_transformer(spark: SparkSession, sf: str) -> DataFrame:
    return score_summary(spark, sf, "transformer")


@query("e5_score_transformer_resnet", deep_sql("transformer_resnet"))
def e5_score_transformer_resnet(spark: SparkSession, sf: str) -> DataFrame:
    return score_summary(spark, sf, "transformer_resnet")


# ---- loss -----------------------------------------------------------------


def shifted(vec: Column) -> Column:
    return F.transform(vec, lambda v: v * 0.9 + 0.01)


@query(
    "e7_mse",
    f"SELECT vec_id, round(avg((v * 0.9::DOUBLE + 0.01::DOUBLE - v) ** 2), 6) AS mse FROM ({E}) GROUP BY vec_id",
)
def e7_mse(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", F.round(loss.mse(shifted(vec()), vec()), 6).alias("mse"))


KL_SQL = "(lv - lm + exp(lm - lv) + (mm - mv) * (mm - mv) * exp(-lv) - 1.0::DOUBLE) * 0.5::DOUBLE"


@query(
    "e8_kl_divergence",
    f"""WITH e AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
c AS (SELECT label, i, count(*) AS n, avg(v) AS mm, ln(var_pop(v)) AS lm FROM e GROUP BY label, i),
a AS (SELECT i, avg(v) AS mv, ln(var_pop(v)) AS lv FROM e GROUP BY i)
SELECT label, max(n)::BIGINT AS n_rows, round(avg({KL_SQL}), 6) AS kl FROM c JOIN a ON a.i = c.i GROUP BY label""",
)
def e8_kl_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """KL of each class posterior against the posterior of the whole set.

    Moments per class and dimension are partial aggregates over one scan; the
    whole-set moments are merged from them (one row per dimension), so the exploded
    values are read once and their shuffle is reused.
    """
    values = vectors(spark, sf).select("label", F.posexplode("embedding").alias("i", "v"))
    classes = values.groupBy("label", "i").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mm"), F.var_pop("v").alias("vm")
    )
    n, mean = F.col("n"), F.sum(F.col("n") * F.col("mm")) / F.sum("n")
    square = F.sum(n * (F.col("vm") + F.col("mm") * F.col("mm"))) / F.sum("n")
    whole = classes.groupBy("i").agg(mean.alias("mv"), F.ln(square - mean * mean).alias("lv"))
    classes = classes.withColumn("lm", F.ln("vm"))
    term = loss.kl_term(F.col("mm"), F.col("lm"), F.col("mv"), F.col("lv"))
    return classes.join(whole, "i").groupBy("label").agg(
        F.max("n").alias("n_rows"), F.round(F.avg(term), 6).alias("kl")
    )


QUARTERS = {"pred_mean": 1, "pred_logvar": 17, "gt_mean": 33, "gt_logvar": 49}
QUARTERED = f"""q AS (SELECT vec_id, i % 16 AS d, max(v) FILTER (i < 16) AS mm, max(v) FILTER (i BETWEEN 16 AND 31) AS lm,
  max(v) FILTER (i BETWEEN 32 AND 47) AS mv, max(v) FILTER (i > 47) AS lv FROM ({E}) GROUP BY vec_id, i % 16)"""


def quartered(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector read as predicted and true posteriors of 16 elements."""
    parts = {name: F.slice("embedding", start, 16) for name, start in QUARTERS.items()}
    return vectors(spark, sf).select("vec_id", "label", *[c.alias(n) for n, c in parts.items()])


@query("e8_kl_rows", f"WITH {QUARTERED} SELECT vec_id, round(avg({KL_SQL}), 6) AS kl FROM q GROUP BY vec_id")
def e8_kl_rows(spark: SparkSession, sf: str) -> DataFrame:
    kl = loss.kl_divergence(*[F.col(n) for n in QUARTERS])
    return quartered(spark, sf).select("vec_id", F.round(kl, 6).alias("kl"))


@query(
    "e9_combined_loss",
    f"""WITH {QUARTERED} SELECT vec_id, round(avg((mm - mv) * (mm - mv)) + 0.0001::DOUBLE * avg({KL_SQL}), 6) AS loss
FROM q GROUP BY vec_id""",
)
def e9_combined_loss(spark: SparkSession, sf: str) -> DataFrame:
    mse = loss.mse(F.col("pred_mean"), F.col("gt_mean"))
    kl = loss.kl_divergence(*[F.col(n) for n in QUARTERS])
    return quartered(spark, sf).select("vec_id", F.round(loss.combined_loss(mse, kl), 6).alias("loss"))


@query(
    "e10_evaluate",
    f"""WITH {QUARTERED}, r AS (SELECT vec_id, avg((mm - mv) * (mm - mv)) AS mse, avg({KL_SQL}) AS kl FROM q GROUP BY vec_id),
p AS (SELECT vec_id, row_number() OVER (ORDER BY {h32("'42'", "'0'", "vec_id")}, vec_id) - 1 AS pos FROM embeddings),
b AS (SELECT label, pos // 24 AS batch, count(*) AS n, avg(mse) AS mse, avg(kl) AS kl FROM r JOIN p ON p.vec_id = r.vec_id
  JOIN embeddings e ON e.vec_id = r.vec_id GROUP BY label, pos // 24)
SELECT label, sum(n)::BIGINT AS n_rows, round(sum((mse + 0.0001::DOUBLE * kl) * n) / sum(n), 6) AS loss,
  round(sum(mse * n) / sum(n), 6) AS mse, round(sum(kl * n) / sum(n), 6) AS kl FROM b GROUP BY label""",
)
def e10_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    rows = quartered(spark, sf)
    batches = assign_batches(uniform_shuffle(rows.select("vec_id"), "vec_id"), 24).select("vec_id", "batch_id")
    scored = rows.join(batches, "vec_id").withColumn("pred_z", F.col("pred_mean"))
    result = loss.evaluate(scored, by=["label"])
    return result.withColumns({c: F.round(c, 6) for c in ("loss", "mse", "kl")})


@query(
    "e11_lr_schedule",
    """WITH s AS (SELECT event_id, count(*) OVER () AS n, row_number() OVER (ORDER BY ts, event_id) - 1 AS step FROM events)
SELECT event_id, step::BIGINT AS step, round(0.001::DOUBLE * CASE WHEN step < 500
  THEN 0.1::DOUBLE + 0.9::DOUBLE * (step / 500.0::DOUBLE)
  ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5 * (1 + cos(3.14159::DOUBLE * ((step - 500) / (n - 500)::DOUBLE))) END, 9) AS lr FROM s""",
)
def e11_lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Events in time order as the steps of one run."""
    steps = order_rank(table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"], out="step", total="n")
    rates = loss.lr_schedule(steps, 0.001, F.col("n"), 500)
    return rates.select("event_id", "step", F.round("lr", 9).alias("lr"))


# ---- fitting --------------------------------------------------------------


@query(
    "e12_moments",
    f"""WITH t AS (SELECT vec_id, i // 4 AS n, i % 4 AS d, v FROM ({E}) UNION ALL
  SELECT vec_id, n, 4, 1.0::DOUBLE FROM embeddings, range(16) r(n))
SELECT a.d::INTEGER AS i, b.d::INTEGER AS j, round(sum(a.v * b.v), 6) AS value
FROM t a JOIN t b ON a.vec_id = b.vec_id AND a.n = b.n GROUP BY a.d, b.d""",
)
def e12_moments(spark: SparkSession, sf: str) -> DataFrame:
    return fit.moments_table(tokens(spark, sf), DIM, GRID).withColumn("value", F.round("value", 6))


def small(name: str) -> MapperSpec:
    return create_mapper(name, **SMALL)


@query(
    "e12_fit_linear",
    """WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS g FROM embeddings)
SELECT (g // 64)::INTEGER AS shard_id, count(*)::BIGINT AS n_rows, 0.0::DOUBLE AS mse FROM p GROUP BY 1""",
)
def e12_fit_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares over the whole store, then its error per shard. The stored
    latents are upsampled tokens, so the fit must find the identity: no error left."""
    rows = read_store(spark, store_path(spark, sf)).select("item_id", "shard_id", "tokens", "gt_mean", "gt_logvar")
    params = fit.fit_linear(rows, small("linear"))
    result = loss.evaluate(score_losses(rows, small("linear"), params, keep=["shard_id"]), by=["shard_id"])
    return result.select("shard_id", "n_rows", F.round("mse", 6).alias("mse"))


def solved_sql(n: int) -> str:
    """Elimination of the (i, j, v) system ``m0``, whose first n columns are positive definite; ``m{n}`` has the solution beyond them."""
    return ", ".join(
        f"""m{k + 1} AS (SELECT a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - f.v * r.v / p.v END AS v FROM m{k} a
  JOIN m{k} r ON r.i = {k} AND r.j = a.j JOIN m{k} f ON f.i = a.i AND f.j = {k} JOIN m{k} p ON p.i = {k} AND p.j = {k})"""
        for k in range(n)
    )


@query(
    "e12_fit_heads",
    f"""WITH {UP_SQL}, tk AS (SELECT vec_id, i, {half_sql("v")} AS v FROM ({E})),
truth AS (SELECT u.vec_id, i // 64 AS c, (i // 8) % 8 AS y, i % 8 AS x, {half_sql("v")} * {half_sql("v")} AS mean,
  CASE WHEN label >= 3 THEN {half_sql("abs(v) - 1")} ELSE 0.0::DOUBLE END AS logvar
  FROM up u JOIN (SELECT vec_id AS own, label FROM embeddings) l ON own = u.vec_id),
cells AS (SELECT vec_id, wy.o AS y, wx.o AS x, i % 4 AS j, sum(v * wy.k * wx.k) AS v FROM tk
    JOIN w wy ON wy.s = i // 16 JOIN w wx ON wx.s = (i // 4) % 4 GROUP BY vec_id, wy.o, wx.o, i % 4
  UNION ALL SELECT vec_id, y.o, x.o, 4, 1.0::DOUBLE FROM embeddings, range(8) y(o), range(8) x(o)
  UNION ALL SELECT vec_id, y, x, 5 + c, mean FROM truth UNION ALL SELECT vec_id, y, x, 9 + c, logvar FROM truth),
m0 AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM cells a JOIN cells b ON b.vec_id = a.vec_id AND b.y = a.y AND b.x = a.x
  WHERE a.j < 5 GROUP BY a.j, b.j), {solved_sql(5)}
SELECT CASE WHEN j < 9 THEN 'mean' ELSE 'logvar' END AS head, i::INTEGER AS i, ((j - 5) % 4)::INTEGER AS j, round(v, 4) AS weight
FROM m5 WHERE j >= 5""",
)
def e12_fit_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of both heads, constants last, for targets that no linear map meets: squared latents
    and log-variances that many rows lack."""
    rows = read_store(spark, store_path(spark, sf)).withColumn("gt_mean", F.transform("gt_mean", lambda v: v.cast("double") * v))
    found = fit.fit_linear(rows, small("linear"))
    told = [
        (head, i, j, float(w))
        for head in ("mean", "logvar")
        for i, row in enumerate([*found[f"{head}.w"], found[f"{head}.b"]])
        for j, w in enumerate(row)
    ]
    return spark.createDataFrame(told, "head string, i int, j int, weight double").withColumn("weight", F.round("weight", 4))


TRAINED = {"dim": DIM, "latent": DIM, "grid": GRID, "width": 6, "layers": 1, "norm": False}
STEPS, BASE_RATE = 3, 0.02


def rate_sql(base: float, steps: int) -> str:
    """The schedule without warm-up, of the zero-based step."""
    return f"{base}::DOUBLE * (0.1::DOUBLE + 0.9::DOUBLE * 0.5 * (1 + cos(3.14159::DOUBLE * ({{step}} / {steps}.0::DOUBLE))))"


# the store's rows: rounded tokens and targets; log-variances are missing, so zero, for the older labels
TRUTH = f"""tk AS (SELECT vec_id, i, {half_sql("v")} AS v FROM ({E})),
truth AS (SELECT u.vec_id, i // 64 AS c, (i // 8) % 8 AS y, i % 8 AS x, {half_sql("v")} AS mean,
  CASE WHEN label >= 3 THEN {half_sql("abs(v) - 1")} ELSE 0.0::DOUBLE END AS logvar
  FROM up u JOIN (SELECT vec_id AS own, label FROM embeddings) l ON own = u.vec_id)"""


def trained(name: str, batches: str, tag: str, steps: int = STEPS) -> str:
    spec = create_mapper(name, **TRAINED)
    return training_sql(spec, "SELECT * FROM tk", "", "truth", batches, steps, rate_sql(BASE_RATE, steps), loss.BETA, tag)


@query(
    "e13_fit_gradient",
    f"""WITH {UP_SQL}, {TRUTH}, p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS g, count(*) OVER () AS n FROM embeddings),
dealt AS (SELECT vec_id, floor(g / ceil(n / {STEPS}.0::DOUBLE))::INTEGER AS batch FROM p), {trained("mlp", "dealt", "t")}
SELECT 0::INTEGER AS epoch, step::INTEGER AS batch, (step + 1)::INTEGER AS step, round(loss, 5) AS loss, round(mse, 5) AS mse, round(kl, 5) AS kl,
  round({rate_sql(BASE_RATE, STEPS).format(step="step")}, 9) AS lr FROM t_log""",
)
def e13_fit_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """Step log of an epoch over the whole store, one job of barrier tasks: an MLP from weights
    given by a formula, batches of consecutive rows."""
    rows = read_store(spark, store_path(spark, sf))
    keys = read_keys(spark, store_path(spark, sf))
    size = F.ceil(F.lit(keys.count()) / F.lit(float(STEPS)))
    places = keys.select("shard_id", "offset", F.floor(F.col("global_idx") / size).cast("int").alias("batch_id"))
    spec = create_mapper("mlp", **TRAINED)
    _, log = fit.fit_gradient(
        rows, spec, epochs=1, steps_per_epoch=STEPS, lr=BASE_RATE, params=formula_params(spec), batches=lambda _: places, barrier=True, sampled=False
    )
    digits = {c: F.round(c, 5) for c in ("loss", "mse", "kl")} | {"lr": F.round("lr", 9)}
    return spark.createDataFrame(log, fit.STEP_LOG_SCHEMA).withColumns(digits)


@query(
    "e13_linear_step",
    f"""WITH {UP_SQL}, {TRUTH}, dealt AS (SELECT vec_id, unnest(range(2)) AS batch FROM embeddings), {trained("linear", "dealt", "t", 2)}
SELECT step::INTEGER AS step, round(loss, 5) AS loss, round(mse, 5) AS mse, round(kl, 5) AS kl FROM t_log""",
)
def e13_linear_step(spark: SparkSession, sf: str) -> DataFrame:
    """Loss of the linear mapper over the whole store before and after one full-batch step."""
    rows = read_store(spark, store_path(spark, sf)).withColumn(epochs.BATCH, F.lit(0))
    spec = create_mapper("linear", **TRAINED)
    learners, logs = [epochs.Learner.of(spec, formula_params(spec))], []
    for step in range(2):
        rate = fit.lr_at(step, BASE_RATE, 2, 0)
        learners, (log,) = epochs.run_epoch(rows, learners, [rate], first_step=step, sampled=False)
        logs += [(step, *map(float, r[1:4])) for r in log]
    told = spark.createDataFrame(logs, "step int, loss double, mse double, kl double")
    return told.withColumns({c: F.round(c, 5) for c in ("loss", "mse", "kl")})


@query(
    "e17_fit_compare",
    f"""WITH {UP_SQL}, {TRUTH}, dealt AS (SELECT vec_id, unnest(range({STEPS})) AS batch FROM embeddings),
{trained("linear", "dealt", "a")}, {trained("mlp", "dealt", "b")},
r AS (SELECT 'linear' AS mapper, * FROM a_log UNION ALL SELECT 'mlp', * FROM b_log)
SELECT mapper, round(arg_min(loss, step), 5) AS before, round(arg_max(loss, step), 5) AS after FROM r GROUP BY mapper""",
)
def e17_fit_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Two mappers learn from the whole store in the same passes."""
    specs = {n: create_mapper(n, **TRAINED) for n in ("linear", "mlp")}
    starts = {n: formula_params(s) for n, s in specs.items()}
    rows = read_store(spark, store_path(spark, sf))
    told = fit.fit_compare(rows, specs, steps=STEPS, lr=BASE_RATE, params=starts, sampled=False)
    return told.withColumns({c: F.round(c, 5) for c in ("before", "after")})


# ---- parameters -----------------------------------------------------------

PARAMS = list(param_shapes(create_mapper("linear", **SMALL))) + ["mlp0.w"]
NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in PARAMS) + "]"


def saved_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as the stored parameters of one model per label, the later one where two have a name; some in another shape."""
    name = F.get(F.array(*map(F.lit, PARAMS)), F.pmod("vec_id", F.lit(len(PARAMS))).cast("int"))
    shape = F.when(F.col("vec_id") % 7 == 1, F.array(F.lit(8), F.lit(8))).when(name.endswith(".b"), F.array(F.lit(4))).otherwise(F.array(F.lit(4), F.lit(4)))
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("run_id"), F.lit(1).alias("epoch"), name.alias("param"), "vec_id", shape.alias("shape"), "embedding")
    kept = rows.groupBy("run_id", "epoch", "param").agg(F.max_by(F.struct("shape", "embedding"), "vec_id").alias("x"))
    size = F.aggregate("x.shape", F.lit(1), lambda a, n: a * n)
    return kept.select("run_id", "epoch", "param", F.col("x.shape").alias("shape"), F.slice(F.col("x.embedding").cast("array<double>"), F.lit(1), size).alias("values"))


SAVED_SQL = f"""n AS (SELECT *, {NAMES_SQL}[1 + vec_id % {len(PARAMS)}] AS param FROM embeddings),
sv AS (SELECT label::VARCHAR AS run_id, param, arg_max(vec_id, vec_id) AS v FROM n GROUP BY 1, 2),
saved AS (SELECT run_id, param, CASE WHEN v % 7 = 1 THEN [8, 8] WHEN param LIKE '%.b' THEN [4] ELSE [4, 4] END AS shape FROM sv)"""


def stored_weights(spark: SparkSession, sf: str) -> DataFrame:
    path = written(spark, sf, "weights", lambda p: saved_weights(spark, sf).write.parquet(p))
    return spark.read.parquet(path)


@query(
    "e6_param_count",
    f"""WITH {SAVED_SQL} SELECT run_id, 1::INTEGER AS epoch, count(*)::BIGINT AS n_params, sum(list_product(shape))::BIGINT AS n_values, true AS whole
FROM saved GROUP BY run_id""",
)
def e6_param_count(spark: SparkSession, sf: str) -> DataFrame:
    return param_totals(stored_weights(spark, sf))


WANTED_SQL = ", ".join(f"('{n}', {list(s)})" for n, s in param_shapes(create_mapper("linear", **SMALL)).items())


@query(
    "e15_restore_plan",
    f"""WITH {SAVED_SQL}, asked AS (SELECT * FROM (SELECT DISTINCT run_id FROM saved), (VALUES {WANTED_SQL}) t(param, wanted))
SELECT coalesce(a.run_id, s.run_id) AS run_id, coalesce(a.param, s.param) AS param, CASE WHEN wanted IS NULL THEN 'unused'
  WHEN shape IS NULL THEN 'missing' WHEN shape = wanted THEN 'restored' ELSE 'reshaped' END AS status
FROM saved s FULL JOIN asked a ON a.run_id = s.run_id AND a.param = s.param""",
)
def e15_restore_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What each label's stored model gives to a linear mapper."""
    return registry.restore_plan(stored_weights(spark, sf), small("linear"), ("run_id",))


INIT_SPEC = create_mapper("mlp", **SMALL)
INIT_SQL = ", ".join(
    f"('{n}', {int(np.prod(s))}, {1.0 if n.endswith('.g') else -math.sqrt(6.0 / sum(s)) if n.endswith('.w') else 0.0!r}::DOUBLE, "
    f"{2 * math.sqrt(6.0 / sum(s)) if n.endswith('.w') else 0.0!r}::DOUBLE)"
    for n, s in param_shapes(INIT_SPEC).items()
)


@query(
    "e14_init_weights",
    f"""WITH r AS (SELECT DISTINCT label FROM embeddings), p AS (SELECT * FROM (VALUES {INIT_SQL}) t(param, n, low, width)),
e AS (SELECT label, param, low, width, unnest(range(n)) AS i FROM r, p)
SELECT label::VARCHAR AS run_id, param, i::INTEGER AS i, round(low + width * (({h32("label", "param", "i")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE), 9) AS value FROM e""",
)
def e14_init_weights(spark: SparkSession, sf: str) -> DataFrame:
    """First weights of an MLP for every label as a run, its number the seed."""
    runs = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("run_id"), F.col("label").alias("seed")).distinct()
    return hashed_weights(runs, INIT_SPEC).withColumn("value", F.round("value", 9))


# ---- registry -------------------------------------------------------------

RUN_EPOCHS = """r AS (SELECT event_type AS run_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch, avg(value) AS score
  FROM events GROUP BY 1, 2), k AS (SELECT *, 1 + max(epoch) OVER (PARTITION BY run_id) AS epochs FROM r)"""


def run_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Event types as runs, days as zero-based epochs."""
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    per_day = table(spark, sf, "events").groupBy(F.col("event_type").alias("run_id"), day.alias("epoch")).agg(
        F.avg("value").alias("score")
    )
    return per_day.withColumn("epochs", F.max("epoch").over(Window.partitionBy("run_id")) + 1)


@query(
    "e15_save_set",
    f"""WITH {RUN_EPOCHS} SELECT run_id, (epoch + 1)::INTEGER AS saved_epoch, epoch = epochs - 1 AS final FROM k
WHERE (epoch + 1) % 4 = 0 OR epoch = epochs - 1""",
)
def e15_save_set(spark: SparkSession, sf: str) -> DataFrame:
    return registry.save_set(run_epochs(spark, sf), 4)


@query(
    "e15_latest_checkpoint",
    f"""WITH {RUN_EPOCHS}, s AS (SELECT * FROM k WHERE (epoch + 1) % 7 = 0)
SELECT run_id, (max(epoch) + 1)::INTEGER AS saved_epoch, round(arg_max(score, epoch), 6) AS score FROM s GROUP BY run_id""",
)
def e15_latest_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    saved = run_epochs(spark, sf).where(F.pmod(F.col("epoch") + 1, F.lit(7)) == 0)
    named = saved.withColumn("saved_epoch", (F.col("epoch") + 1).cast("int"))
    latest = registry.latest_checkpoint(named, "score")
    return latest.withColumn("score", F.round("score", 6))


@query(
    "e16_run_config",
    """WITH c AS (SELECT user_id, count(*) AS n, max(value) AS v, bool_or(event_type = 'error' AND value > 100) AS debug
  FROM events GROUP BY user_id)
SELECT user_id::VARCHAR AS run_id, debug, (CASE WHEN debug THEN 2 ELSE n END)::INTEGER AS epochs,
  (CASE WHEN debug THEN 2 ELSE 8 END)::INTEGER AS batch_size, (CASE WHEN debug THEN 2 ELSE 1000 END)::INTEGER AS warmup_steps,
  v / 1000 AS lr FROM c""",
)
def e16_run_config(spark: SparkSession, sf: str) -> DataFrame:
    """One typed row per user as a run; debug runs get the short settings."""
    defaults = registry.RunConfig()
    per_user = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).cast("int").alias("epochs"),
        F.max("value").alias("v"),
        F.bool_or((F.col("event_type") == "error") & (F.col("value") > 100)).alias("debug"),
    )
    configs = per_user.select(
        F.col("user_id").cast("string").alias("run_id"),
        "debug",
        "epochs",
        F.lit(defaults.batch_size).alias("batch_size"),
        F.lit(defaults.warmup_steps).alias("warmup_steps"),
        (F.col("v") / 1000).alias("lr"),
    )
    return registry.debug_override(configs)
