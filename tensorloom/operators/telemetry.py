"""Training logs as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: the log line formats
STAMP = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) \[\w+\] "
STEP_LINE = (
    STAMP + r"\s*step ([\d,]+)\s+batch=(\d+)\s+loss=(\S+)\s+mse=(\S+)\s+kl=(\S+)\s+lr=(\S+)\s*$"
)
SEPARATOR = "\x1f"
RUN_IN_PATH = r"([^/]+)/logs/[^/]+$"
EPOCH_LINE = STAMP + r"Epoch (\d+)/(\d+)\s+loss=(\S+)\s*$"


def read_train_log(
    spark: SparkSession, path: str, name_glob: str = "*.log", run_pattern: str = RUN_IN_PATH
) -> DataFrame:
    """Lines of ``<run>/logs/*.log`` files with the run taken from the path."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob).text(path)
    return with_run(lines, run_pattern)


def with_run(lines: DataFrame, pattern: str = RUN_IN_PATH) -> DataFrame:
    return lines.withColumn("run_id", F.regexp_extract(F.input_file_name(), pattern, 1))


def parse_steps(lines: DataFrame, steps_per_epoch: Column | int | None = None) -> DataFrame:
    """Step lines -> typed rows. A stream of lines works the same way.

    The line holds the global step, ``epoch * steps_per_epoch + batch``; the epoch
    follows from it when the steps per epoch are given.
    """

    part = _groups(STEP_LINE, 7)
    step = F.regexp_replace(part(2), ",", "").try_cast("long")
    batch = part(3).try_cast("long")
    per_epoch = steps_per_epoch if isinstance(steps_per_epoch, Column) else F.lit(steps_per_epoch)
    return lines.where(F.col("value").rlike(STEP_LINE)).select(
        *([F.col("run_id")] if "run_id" in lines.columns else []),
        _stamp(part(1)).alias("ts"),
        F.floor((step - batch) / per_epoch.cast("long")).cast("int").alias("epoch"),
        step.alias("step"),
        batch.alias("batch"),
        *[part(i).try_cast("double").alias(n) for i, n in ((4, "loss"), (5, "mse"), (6, "kl"), (7, "lr"))],
    )


def parse_epochs(lines: DataFrame) -> DataFrame:
    """Epoch lines -> (run_id,) ts, epoch, epochs, loss."""

    part = _groups(EPOCH_LINE, 4)
    return lines.where(F.col("value").rlike(EPOCH_LINE)).select(
        *([F.col("run_id")] if "run_id" in lines.columns else []),
        _stamp(part(1)).alias("ts"),
        part(2).try_cast("int").alias("epoch"),
        part(3).try_cast("int").alias("epochs"),
        part(4).try_cast("double").alias("loss"),
    )


def step_line(ts: Column, step: Column, batch: Column, loss: Column, mse: Column, kl: Column, lr: Column) -> Column:
    """The log text of a step (the inverse of :func:`parse_steps`)."""
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS"),
        F.lit(" [INFO]   step "),
        F.format_string("%,d  batch=%d  loss=%.4f  mse=%.4f  kl=%.6f  lr=%.6f", step, batch, loss, mse, kl, lr),
    )


def global_step(epoch: Column, batch: Column, steps_per_epoch: Column | int) -> Column:
    """One-based global step of a zero-based batch."""
    per_epoch = steps_per_epoch if isinstance(steps_per_epoch, Column) else F.lit(steps_per_epoch)
    return epoch.cast("long") * per_epoch + batch + 1


def thin_steps(steps: DataFrame, log_freq: int, batch: str = "batch") -> DataFrame:
    """Rows a logger with this frequency keeps: the first and every Nth (one-based) batch."""
    b = F.col(batch)
    keep = F.lit(False) if log_freq <= 0 else (F.pmod(b, F.lit(log_freq)) == 0) | (b == 1)
    return steps.where(keep)


def epoch_summary(steps: DataFrame, weight: str = "n") -> DataFrame:
    """Size-weighted mean losses per run and epoch, with the change to the epoch before."""
    w = F.col(weight)
    means = {c: (F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in ("loss", "mse", "kl")}
    per_epoch = steps.groupBy("run_id", "epoch").agg(F.sum(w).alias("n_samples"), *means.values())
    before = F.lag("loss").over(Window.partitionBy("run_id").orderBy("epoch"))
    return per_epoch.withColumn("delta", F.col("loss") - before)


def _groups(pattern: str, n: int) -> Callable[[int], Column]:
    """Access to the groups of a whole-line match, found in a single regex pass.

    The rewritten line is one shared subexpression; every field is a piece of it.
    """
    pieces = F.split(F.regexp_replace("value", pattern, SEPARATOR.join(f"${i}" for i in range(1, n + 1))), SEPARATOR)
    return lambda i: F.get(pieces, F.lit(i - 1))


def _stamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss,SSS"))
