"""Order, fit, evaluate and record a run over a feature store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators.fit import STEP_LOG_SCHEMA, fit_gradient, fit_linear
from tensorloom.operators.loss import evaluate
from tensorloom.operators.mappers import MapperSpec, Params, init_weights, score_losses
from tensorloom.operators.panel import sample_panel, write_panel
from tensorloom.operators.registry import RunConfig, checkpoint_load, checkpoint_save, run_config
from tensorloom.operators.split import assign_batches, first_n, ordered_split, shard_shuffle, tail_holdout
from tensorloom.session import stored
from tensorloom.sources.store import read_keys, read_store


@dataclass
class RunResult:
    params: Params
    steps: DataFrame
    validation: DataFrame | None


def epoch_batches(keys: DataFrame, batch_size: int, seed: int, epoch: int, train_ratio: float = 0.9, drop_last: bool = True) -> DataFrame:
    """Shard-aware order of one epoch, cut into train/val and train batches.

    Works on positions only; join the result to the store on (shard_id, offset).
    """
    ordered = ordered_split(shard_shuffle(keys, seed=seed, epoch=epoch, total="n"), train_ratio, F.col("n"))
    n_train = F.floor(F.col("n").cast("double") * train_ratio).cast("long")
    train = assign_batches(ordered.where(F.col("split") == "train"), batch_size, drop_last, n_train)
    return train.drop("n")


def run_training(
    spark: SparkSession,
    store: str,
    spec: MapperSpec,
    config: RunConfig,
    run_id: str,
    out: str,
    *,
    steps_per_epoch: int | None = None,
    resume: bool = False,
    closed_form: bool = False,
    barrier: bool = False,
) -> RunResult:
    """Fit a mapper on a store; writes config, steps, checkpoints and panels below ``out``.

    An epoch visits every training row in batches of ``config.batch_size``, in the
    shard-aware order of that epoch. ``steps_per_epoch`` replaces that by as many global
    batches, each all rows of its share of the shards. Writing the same run again replaces
    what it wrote before.
    ``barrier`` makes each epoch of batches one job instead of one for each batch, where the
    cluster can run all its tasks at once (see ``fit_gradient``).
    ``closed_form`` starts a linear mapper from its least-squares solution.
    """
    if config.debug:
        config = config.for_debug()
    _replace(run_config(spark, run_id, config), f"{out}/configs", "run_id")

    rows = read_store(spark, store)
    keys = read_keys(spark, store)
    if config.subset_size is not None:
        rows, keys = first_n(rows, config.subset_size), first_n(keys, config.subset_size)
    validation = None
    n = keys.count()
    if not config.no_val:
        keys = tail_holdout(keys, config.val_ratio, n).where(F.col("split").isin("train", "all")).drop("split")
        marked = tail_holdout(rows, config.val_ratio, n)
        validation = marked.where(F.col("split").isin("val", "all")).drop("split")
        rows = marked.where(F.col("split").isin("train", "all")).drop("split")

    params, optimizer, start = init_weights(spec, config.seed), None, 0
    if resume:
        start, params, optimizer = checkpoint_load(spark, f"{out}/checkpoints", run_id, spec)
    elif closed_form:
        params = fit_linear(rows, spec)

    def panel(epoch: int, p: Params) -> None:
        if config.sample_indices:
            write_panel(sample_panel(spark, store, spec, p, config.sample_indices, run_id, epoch), f"{out}/samples")

    def after(epoch: int, p: Params, opt, _loss: float) -> None:
        last = epoch == config.epochs
        if epoch % config.save_every == 0 or last:
            checkpoint_save(spark, f"{out}/checkpoints", run_id, epoch, p, opt, final=last)
            panel(epoch, p)

    if not resume:
        panel(0, params)
    batches = None
    if steps_per_epoch is None:
        n_train = keys.count() if not config.no_val else n
        steps_per_epoch = max(1, -(-n_train // config.batch_size))

        def batches(epoch: int) -> DataFrame:
            dealt = epoch_batches(keys, config.batch_size, config.seed, epoch, train_ratio=1.0, drop_last=False)
            return stored(dealt.select("shard_id", "offset", "batch_id"), "epoch-batches")

    params, log = fit_gradient(
        rows,
        spec,
        epochs=config.epochs,
        steps_per_epoch=steps_per_epoch,
        batches=batches,
        barrier=barrier,
        lr=config.lr,
        warmup_steps=config.warmup_steps,
        beta=config.beta,
        seed=config.seed,
        params=params,
        optimizer=optimizer,
        start_epoch=start,
        on_epoch=after,
    )
    steps = spark.createDataFrame(log, STEP_LOG_SCHEMA).withColumn("run_id", F.lit(run_id))
    _replace(steps, f"{out}/steps", "run_id", "epoch")
    held_out = evaluate(score_losses(validation, spec, params, keep=[]), config.beta) if validation is not None else None
    return RunResult(params, steps, held_out)


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    """Write ``rows``, replacing the partitions they belong to and no others."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)
