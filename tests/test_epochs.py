"""Barrier epochs: the same steps as one job per batch, in one job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import epochs, fit, mappers
from tests_support import counted_jobs

GEO = {"dim": 5, "latent": 2, "grid": 3, "width": 4, "layers": 1}


def make_rows(spark, n=40, seed=0):
    rng = np.random.default_rng(seed)
    tensors = [rng.standard_normal((n, k)).astype(np.float32) for k in (45, 72, 72)]
    rows = [(i, i // 10, i % 10, *(a[i].tolist() for a in tensors)) for i in range(n)]
    return spark.createDataFrame(
        rows, "item_id long, shard_id int, offset int, tokens array<float>, gt_mean array<float>, gt_logvar array<float>"
    ).repartition(3)


def job_per_batch(rows, spec, batches, lr, params, seed=42):
    """The plain way: each batch its own gradient step."""
    optimizer, log = fit.AdamW(fit.to_vector(params).size), []
    for step in range(batches):
        grad, mse, kl, n = fit.gradient_step(rows.where(F.col(epochs.BATCH) == step), spec, params, step, seed)
        if n:
            rate = fit.lr_at(step, lr, batches, 0)
            params = fit.from_vector(spec, optimizer.update(fit.to_vector(params), grad, rate))
            log.append((step, mse + 1e-4 * kl, mse, kl, rate))
    return params, log


@pytest.mark.parametrize("name", ["linear", "mlp"])
def test_an_epoch_takes_the_steps_of_single_jobs(spark, name):
    """Uneven batches, one of them empty."""
    spec = mappers.create_mapper(name, **GEO)
    rows = make_rows(spark).withColumn(epochs.BATCH, F.when(F.col("item_id") < 3, 0).when(F.col("item_id") < 20, 2).otherwise(3))
    start = mappers.init_weights(spec)
    want, log = job_per_batch(rows, spec, 4, 0.05, start)
    rates = [fit.lr_at(k, 0.05, 4, 0) for k in range(4)]
    (learner,), (told,) = epochs.run_epoch(rows, [epochs.Learner.of(spec, start)], rates, batch_size=4)
    assert [r[0] for r in told] == [0, 2, 3]
    assert np.allclose(told, log, rtol=1e-9) and learner.optimizer.t == 3
    assert np.allclose(fit.to_vector(learner.params), fit.to_vector(want), rtol=1e-9)


def test_models_learn_side_by_side_as_alone(spark):
    specs = [mappers.create_mapper(n, **GEO) for n in ("linear", "mlp")]
    rows = make_rows(spark).withColumn(epochs.BATCH, F.pmod("item_id", F.lit(2)).cast("int"))
    both, logs = epochs.run_epoch(rows, [epochs.Learner.of(s, mappers.init_weights(s)) for s in specs], [0.1, 0.2], first_step=7)
    for spec, learner, log in zip(specs, both, logs, strict=True):
        (alone,), (own,) = epochs.run_epoch(rows, [epochs.Learner.of(spec, mappers.init_weights(spec))], [0.1, 0.2], first_step=7)
        assert np.allclose(log, own) and np.allclose(fit.to_vector(learner.params), fit.to_vector(alone.params))


def test_jobs_of_an_epoch_dont_grow_with_its_batches(spark):
    spec = mappers.create_mapper("linear", **GEO)
    rows = make_rows(spark)

    def jobs(batches, learners=1):
        dealt = rows.withColumn(epochs.BATCH, F.pmod("item_id", F.lit(batches)).cast("int"))
        models = [epochs.Learner.of(spec, mappers.init_weights(spec, k)) for k in range(learners)]
        return counted_jobs(spark, lambda: epochs.run_epoch(dealt, models, [0.01] * batches))

    few = jobs(2)
    assert few == jobs(6) == jobs(2, learners=3) <= 3  # with adaptive execution, map sides count as jobs, that of the fixture too


def test_fit_by_batches_is_one_epoch_job(spark):
    spec, rows = mappers.create_mapper("linear", **GEO), make_rows(spark)
    places = rows.select("shard_id", "offset", F.pmod("item_id", F.lit(4)).alias("batch_id"))
    options = {"epochs": 2, "steps_per_epoch": 4, "lr": 0.05, "batches": lambda _: places}
    params, log = fit.fit_gradient(rows, spec, barrier=True, **options)
    plain, same = fit.fit_gradient(rows, spec, **options)
    assert np.allclose(log, same, rtol=1e-9) and np.allclose(fit.to_vector(params), fit.to_vector(plain), rtol=1e-9)
    assert [r[:3] for r in log] == [(e, b, 4 * e + b + 1) for e in range(2) for b in range(4)]
    dealt = rows.withColumn(epochs.BATCH, F.pmod("item_id", F.lit(4)).cast("int"))
    start, first = mappers.init_weights(spec), []
    learner = epochs.Learner.of(spec, start)
    for epoch in range(2):
        rates = [fit.lr_at(4 * epoch + k, 0.05, 8, 0) for k in range(4)]
        (learner,), (own,) = epochs.run_epoch(dealt, [learner], rates, first_step=4 * epoch)
        first += own
    assert np.allclose([r[3:] for r in log], [r[1:] for r in first])
    assert np.allclose(fit.to_vector(params), fit.to_vector(learner.params))


def test_an_epoch_without_rows_changes_nothing(spark):
    spec = mappers.create_mapper("linear", **GEO)
    rows = make_rows(spark).withColumn(epochs.BATCH, F.lit(0)).where("false")
    start = mappers.init_weights(spec)
    (learner,), (log,) = epochs.run_epoch(rows, [epochs.Learner.of(spec, start)], [0.1, 0.1])
    assert log == [] and np.array_equal(fit.to_vector(learner.params), fit.to_vector(start))


def test_a_batch_beyond_the_epoch_is_an_error(spark):
    spec = mappers.create_mapper("linear", **GEO)
    rows = make_rows(spark, n=4).withColumn(epochs.BATCH, F.col("item_id").cast("int"))
    with pytest.raises(Exception, match="beyond the 2 steps"):
        epochs.run_epoch(rows, [epochs.Learner.of(spec, mappers.init_weights(spec))], [0.1, 0.1])


def test_messages_bound_the_width():
    assert epochs.barrier_width(1000, 100) == 1000
    assert epochs.barrier_width(1000, 306_208) == 20
    assert epochs.barrier_width(8, 10**9) == 1
