"""Losses, evaluation and the learning-rate curve as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.arrays import as_double, average, bind, pairwise

BETA = 1e-4  # fixed value: default KL weight
LR_FLOOR = 0.1  # fixed value: lowest share of the base rate
LR_PI = 3.14159  # fixed value: pi as the schedule uses it


def mse(pred: Column, target: Column) -> Column:
    """Mean squared error of two arrays."""
    return average(pairwise(pred, target, lambda p, t: (p - t) * (p - t)))


def kl_term(mean_m: Column, logvar_m: Column, mean_v: Column, logvar_v: Column) -> Column:
    """KL of one pair of scalar Gaussians given as mean and log-variance.

    Written on log-variances throughout, so a large one cannot overflow the log.
    """
    gap = mean_m - mean_v
    return (logvar_v - logvar_m + F.exp(logvar_m - logvar_v) + gap * gap * F.exp(-logvar_v) - 1.0) * 0.5


def kl_divergence(mean_m: Column, logvar_m: Column, mean_v: Column, logvar_v: Column) -> Column:
    """Mean KL over the elements of two diagonal Gaussians (array columns)."""
    quad = F.struct(
        as_double(mean_m).alias("mm"),
        as_double(logvar_m).alias("lm"),
        as_double(mean_v).alias("mv"),
        as_double(logvar_v).alias("lv"),
    )
    terms = bind(
        quad,
        lambda q: F.transform(
            q["mm"], lambda m, i: kl_term(m, F.get(q["lm"], i), F.get(q["mv"], i), F.get(q["lv"], i))
        ),
    )
    return average(terms)


def combined_loss(mse_value: Column, kl_value: Column, beta: float = BETA) -> Column:
    return mse_value + F.lit(float(beta)) * kl_value


def evaluate(scored: DataFrame, beta: float = BETA, by: list[str] | None = None) -> DataFrame:
    """Mean losses over scored rows.

    Expects pred_z, pred_mean, pred_logvar, gt_mean, gt_logvar -- or mse and kl per
    row, as ``mappers.score_losses`` returns them. With ``batch_id`` present losses
    are averaged per batch and weighted by batch size; all rows have the same shape,
    so this equals the plain mean and needs no batch otherwise.
    """
    keys = by or []
    batch = ["batch_id"] if "batch_id" in scored.columns else []
    if {"mse", "kl"} <= set(scored.columns):
        rows = scored.select(*keys, *batch, "mse", "kl")
    else:
        rows = scored.select(
            *keys,
            *batch,
            mse(F.col("pred_z"), F.col("gt_mean")).alias("mse"),
            kl_divergence(F.col("pred_mean"), F.col("pred_logvar"), F.col("gt_mean"), F.col("gt_logvar")).alias("kl"),
        )
    if "batch_id" in rows.columns:
        rows = rows.groupBy(*keys, "batch_id").agg(
            F.count(F.lit(1)).alias("n"), F.avg("mse").alias("mse"), F.avg("kl").alias("kl")
        )
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    n = F.sum("n")
    return rows.groupBy(*keys).agg(
        n.alias("n_rows"),
        (F.sum(combined_loss(F.col("mse"), F.col("kl"), beta) * F.col("n")) / n).alias("loss"),
        (F.sum(F.col("mse") * F.col("n")) / n).alias("mse"),
        (F.sum(F.col("kl") * F.col("n")) / n).alias("kl"),
    )


def lr_factor(step: Column, total_steps: Column | int, warmup_steps: int) -> Column:
    """Share of the base rate at a global step: linear warm-up, then cosine decay."""
    total = total_steps if isinstance(total_steps, Column) else F.lit(int(total_steps))
    s = step.cast("double")
    span = F.lit(1.0 - LR_FLOOR)
    warm = F.lit(LR_FLOOR) + span * (s / F.lit(float(max(warmup_steps, 1))))
    progress = (s - F.lit(float(warmup_steps))) / F.greatest(total.cast("double") - F.lit(float(warmup_steps)), F.lit(1.0))
    decay = F.lit(LR_FLOOR) + span * 0.5 * (F.lit(1.0) + F.cos(F.lit(LR_PI) * progress))
    return F.when(step < warmup_steps, warm).otherwise(decay)


def lr_schedule(steps: DataFrame, base_lr: float, total_steps: Column | int, warmup_steps: int, step: str = "step") -> DataFrame:
    """Add ``lr``: a pure function of the global step, so resuming needs no state."""
    return steps.withColumn("lr", F.lit(float(base_lr)) * lr_factor(F.col(step), total_steps, warmup_steps))
