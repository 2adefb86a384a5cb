"""Runs, their configuration and their checkpoints as tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators.fit import AdamW
from tensorloom.operators.mappers import MapperSpec, Params, create_mapper, param_shapes

CKPT_SCHEMA = "run_id string, epoch int, final boolean, slot string, param string, shape array<int>, values array<double>"


@dataclass(frozen=True)
class RunConfig:
    """Options of one run."""

    # fixed values: option names and defaults of a run
    lr: float = 1e-3
    epochs: int = 100
    batch_size: int = 8
    warmup_steps: int = 1000
    max_steps: int = 0
    log_freq: int = 100
    val_ratio: float = 0.1
    debug: bool = False
    output_dir: str = "runs/default"
    seed: int = 42
    mapper: str = "mlp"
    hidden_channels: int = 256
    num_layers: int = 4
    learnable_norm: bool = True
    num_heads: int = 8
    num_transformer_layers: int = 1
    mlp_ratio: float = 4.0
    num_resnet_layers: int = 32
    dataset: str = ""
    subset_size: int | None = None
    no_val: bool = False
    save_every: int = 5
    sample_indices: list[int] = field(default_factory=list)
    beta: float = 1e-4

    def for_debug(self) -> "RunConfig":
        """The short settings of a debug run."""
        return replace(self, debug=True, epochs=2, batch_size=2, warmup_steps=2)

    def spec(self) -> MapperSpec:
        return create_mapper(
            self.mapper,
            width=self.hidden_channels,
            layers=self.num_layers,
            blocks=self.num_layers if self.mapper == "resnet" else self.num_resnet_layers,
            heads=self.num_heads,
            attention=self.num_transformer_layers,
            ratio=self.mlp_ratio,
            norm=self.learnable_norm,
        )


CONFIG_SCHEMA = (
    "run_id string, lr double, epochs int, batch_size int, warmup_steps int, max_steps int, log_freq int, "
    "val_ratio double, debug boolean, output_dir string, seed long, mapper string, hidden_channels int, "
    "num_layers int, learnable_norm boolean, num_heads int, num_transformer_layers int, mlp_ratio double, "
    "num_resnet_layers int, dataset string, subset_size int, no_val boolean, save_every int, "
    "sample_indices array<long>, beta double"
)


def run_config(spark: SparkSession, run_id: str, config: RunConfig) -> DataFrame:
    """One typed row per run."""
    return spark.createDataFrame([(run_id, *asdict(config).values())], CONFIG_SCHEMA)


def debug_override(configs: DataFrame) -> DataFrame:
    """Apply the debug settings to rows marked debug."""
    short = RunConfig().for_debug()
    return configs.withColumns(
        {
            c: F.when(F.col("debug"), F.lit(getattr(short, c))).otherwise(F.col(c))
            for c in ("epochs", "batch_size", "warmup_steps")
        }
    )


def is_save_epoch(epoch: Column, epochs: Column, save_every: int) -> Column:
    """Zero-based epochs that are saved: every Nth and always the last."""
    return (F.pmod(epoch + 1, F.lit(save_every)) == 0) | (epoch == epochs - 1)


def save_set(epochs: DataFrame, save_every: int = 5) -> DataFrame:
    """Checkpoints a run writes, from (run_id, epoch zero-based, epochs)."""
    kept = epochs.where(is_save_epoch(F.col("epoch"), F.col("epochs"), save_every))
    return kept.select(
        "run_id",
        (F.col("epoch") + 1).cast("int").alias("saved_epoch"),
        (F.col("epoch") == F.col("epochs") - 1).alias("final"),
    )


def latest_checkpoint(saved: DataFrame, value: str) -> DataFrame:
    """Per run, the newest epoch and its ``value``."""
    return saved.groupBy("run_id").agg(
        F.max("saved_epoch").alias("saved_epoch"), F.max_by(value, "saved_epoch").alias(value)
    )


def checkpoint_save(
    spark: SparkSession, path: str, run_id: str, epoch: int, params: Params, optimizer: AdamW | None = None, final: bool = False
) -> None:
    """Write one checkpoint; partitions (run_id, epoch) make a repeat idempotent."""
    rows = [(run_id, epoch, final, "param", n, list(a.shape), a.ravel().tolist()) for n, a in params.items()]
    if optimizer is not None:
        for slot, v in (("adam_m", optimizer.m), ("adam_v", optimizer.v), ("adam_t", np.array([optimizer.t]))):
            rows.append((run_id, epoch, final, slot, "*", [v.size], v.astype(float).tolist()))
    (
        spark.createDataFrame(rows, CKPT_SCHEMA)
        .coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "epoch")
        .parquet(path)
    )


def checkpoint_load(
    spark: SparkSession, path: str, run_id: str, spec: MapperSpec, epoch: int | None = None
) -> tuple[int, Params | None, AdamW | None]:
    """Restore a run's checkpoint (newest by default); absent parts come back as None."""
    table = spark.read.schema(CKPT_SCHEMA).parquet(path).where(F.col("run_id") == run_id)
    if epoch is None:
        epoch = table.agg(F.max("epoch")).first()[0]
    if epoch is None:
        raise FileNotFoundError(f"no checkpoint of run {run_id!r} at {path}")
    # one model's rows
    parts = {(r["slot"], r["param"]): np.asarray(r["values"]) for r in table.where(F.col("epoch") == epoch).collect()}
    names = param_shapes(spec)
    params = None
    if all(("param", n) in parts for n in names):
        params = {n: parts["param", n].reshape(s) for n, s in names.items()}
    optimizer = None
    if ("adam_m", "*") in parts:
        optimizer = AdamW(parts["adam_m", "*"].size)
        optimizer.m, optimizer.v = parts["adam_m", "*"], parts["adam_v", "*"]
        optimizer.t = int(parts["adam_t", "*"][0])
    return epoch, params, optimizer




@dataclass
class Restored:
    """What a partial restore took from a checkpoint, by parameter name."""

    epoch: int
    params: Params
    restored: list[str]
    missing: list[str]  # not in the checkpoint: kept as they were
    reshaped: list[str]  # there in another shape: kept as they were
    optimizer: AdamW | None


def checkpoint_restore(spark: SparkSession, path: str, run_id: str, spec: MapperSpec, into: Params, epoch: int | None = None) -> Restored:
    """Take from a checkpoint whatever fits ``spec`` by name and shape; the rest stays as in ``into``.

    The optimiser comes along only when every parameter does, as its state is one vector over
    all of them.
    """
    table = spark.read.schema(CKPT_SCHEMA).parquet(path).where(F.col("run_id") == run_id)
    epoch = epoch if epoch is not None else table.agg(F.max("epoch")).first()[0]
    if epoch is None:
        raise FileNotFoundError(f"no checkpoint of run {run_id!r} at {path}")
    saved = table.where((F.col("epoch") == epoch) & (F.col("slot") == "param"))
    status = {r["param"]: r["status"] for r in restore_plan(saved, spec).collect()}
    of = lambda kind: [n for n in param_shapes(spec) if status.get(n) == kind]
    fits = {r["param"]: r for r in saved.where(F.col("param").isin(of("restored"))).collect()}  # one model's rows
    params = {n: np.asarray(fits[n]["values"]).reshape(s) if n in fits else into[n] for n, s in param_shapes(spec).items()}
    optimizer = checkpoint_load(spark, path, run_id, spec, epoch)[2] if len(fits) == len(params) else None
    return Restored(epoch, params, of("restored"), of("missing"), of("reshaped"), optimizer)


def restore_plan(saved: DataFrame, spec: MapperSpec, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., param, status) of every parameter that is saved or asked for.

    ``saved`` has param and shape. ``restored``: both agree; ``reshaped``: saved in another
    shape; ``missing``: not saved; ``unused``: saved, but not a parameter of ``spec``.
    """
    named = [F.struct(F.lit(n).alias("param"), F.array(*map(F.lit, s)).alias("wanted")) for n, s in param_shapes(spec).items()]
    groups = saved.select(*by).distinct() if by else saved.sparkSession.range(1).select()
    asked = groups.select(*by, F.inline(F.array(*named)))
    both = saved.select(*by, "param", "shape").join(asked, [*by, "param"], "full_outer")
    status = (
        F.when(F.col("wanted").isNull(), "unused")
        .when(F.col("shape").isNull(), "missing")
        .when(F.col("shape") == F.col("wanted"), "restored")
        .otherwise("reshaped")
    )
    return both.select(*by, "param", status.alias("status"))
