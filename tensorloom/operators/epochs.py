"""Mini-batch epochs as single jobs: barrier tasks that exchange gradients step by step.

Synchronous training needs the sum of all gradients of a batch before the next one. A job
per batch pays for planning, scheduling and a collect each time. Here an epoch is one job:
its rows are dealt to tasks that run at the same time (a barrier stage), each sorted by
batch, so every task holds its share of every batch. After each batch the tasks gather all
partial gradients and all take the same step in the same order of sums; nothing goes to
the driver but the final parameters and the step log.

Several models can learn from the same rows at once: their partial gradients travel in one
message, so neither scans nor exchanges grow with the number of models.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.fit import AdamW, from_vector, loss_and_gradient, to_vector
from tensorloom.operators.loss import BETA
from tensorloom.operators.mappers import MapperSpec, Params, noise_key, row_chunks, row_noise, stack
from tensorloom.session import task_slots

BATCH = "_batch"
MESSAGE_BYTES = 64 << 20  # what one task receives per exchange, all partial gradients together
RESULT = "model int, part string, v array<double>"


@dataclass
class Learner:
    """One model under training: its geometry, parameters and optimiser."""

    spec: MapperSpec
    params: Params
    optimizer: AdamW

    @staticmethod
    def of(spec: MapperSpec, params: Params, optimizer: AdamW | None = None) -> "Learner":
        return Learner(spec, params, optimizer or AdamW(sum(a.size for a in params.values())))


def barrier_width(slots: int, size: int) -> int:
    """Tasks of an epoch: all of a barrier stage must run at once, and their messages stay bounded."""
    return max(1, min(slots, MESSAGE_BYTES // max(8 * size * 4 // 3, 1)))


def _message_size(learners: list[Learner]) -> int:
    """Values per exchange: gradients, two losses for each model and the row count."""
    return sum(a.size for learner in learners for a in learner.params.values()) + 2 * len(learners) + 1


def placed_rows(rows: DataFrame, learners: list[Learner]) -> DataFrame:
    """The columns an epoch reads, dealt to its tasks and sorted by batch within each."""
    width = barrier_width(task_slots(rows.sparkSession), _message_size(learners))
    needed = rows.withColumn("_noise", noise_key(rows, "item_id")).select(BATCH, "_noise", "tokens", "gt_mean", "gt_logvar")
    return needed.repartition(width, BATCH, "_noise").sortWithinPartitions(BATCH)


def run_epoch(
    rows: DataFrame,
    learners: list[Learner],
    rates: list[float],
    *,
    first_step: int = 0,
    seed: int = 42,
    beta: float = BETA,
    sampled: bool = True,
    placed: bool = False,
    batch_size: int = 32,
) -> tuple[list[Learner], list[list[tuple]]]:
    """One epoch of ``len(rates)`` steps in one job; returns the learners after it and their logs.

    ``rows`` has ``_batch`` (from 0; the step that a row belongs to), item_id, tokens, gt_mean
    and gt_logvar. A step is the mean gradient over its rows at the learning rate ``rates[step]``;
    a step without rows changes nothing and isn't logged. A log row is (step, loss, mse, kl,
    rate). Without ``sampled`` the latents are the predicted means. ``placed`` rows come from
    :func:`placed_rows` and aren't dealt again. A task holds one Arrow batch of rows, the models
    and one message at a time. A lost task restarts the epoch.

    Spark looks for the end of an exchange once a second, so a step takes a second at least.
    """
    spark = rows.sparkSession
    size = _message_size(learners)
    needed = rows if placed else placed_rows(rows, learners)
    state = spark.sparkContext.broadcast([(x.spec, x.params, x.optimizer) for x in learners])  # sized by the specs
    steps = len(rates)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        models = [[spec, to_vector(p), opt] for spec, p, opt in state.value]
        logs: list[list[float]] = [[] for _ in models]
        queue = _by_batch(batches, batch_size)
        held = next(queue, None)
        for step in range(steps):
            partial = np.zeros(size)
            while held is not None and held[0] == step:
                _fold(partial, held[1], models, seed * 1_000_003 + first_step + step, beta, sampled)
                held = next(queue, None)
            told = context.allGather(base64.b64encode(partial.tobytes()).decode())
            whole = np.sum([np.frombuffer(base64.b64decode(x)) for x in told], axis=0)  # by task, so alike everywhere
            n = whole[-1]
            if not n:
                continue
            at = 0
            for model, log in zip(models, logs, strict=True):
                _, vector, opt = model
                grad, (mse, kl) = whole[at : at + vector.size] / n, whole[at + vector.size : at + vector.size + 2] / n
                at += vector.size + 2
                model[1] = opt.update(vector, grad, rates[step])
                log.extend((step, mse + beta * kl, mse, kl, rates[step]))
        if held is not None:
            raise ValueError(f"batch {held[0]} is beyond the {steps} steps of the epoch")
        if context.partitionId() == 0:
            for k, ((_, vector, opt), log) in enumerate(zip(models, logs, strict=True)):
                parts = {"w": vector, "m": opt.m, "v": opt.v, "t": [float(opt.t)], "log": log}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k] * len(parts), pa.int32()),
                        pa.array(list(parts), pa.string()),
                        pa.array([np.asarray(p, np.float64) for p in parts.values()], pa.list_(pa.float64())),
                    ],
                    ["model", "part", "v"],
                )

    got = {(r["model"], r["part"]): np.asarray(r["v"], np.float64) for r in needed.mapInArrow(learn, RESULT, barrier=True).collect()}
    state.unpersist()
    if not got:  # no partition at all: nothing to learn from
        return learners, [[] for _ in learners]
    after, logs = [], []
    for k, learner in enumerate(learners):
        optimizer = AdamW(got[k, "m"].size)
        optimizer.m, optimizer.v, optimizer.t = got[k, "m"], got[k, "v"], int(got[k, "t"][0])
        after.append(Learner(learner.spec, from_vector(learner.spec, got[k, "w"]), optimizer))
        logs.append([(int(r[0]), *r[1:].tolist()) for r in got[k, "log"].reshape(-1, 5)])
    return after, logs


def _by_batch(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(batch id, at most ``most`` rows of it), in order."""
    for whole in batches:
        ids = whole.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(edges, edges[1:], strict=False):
            for part in row_chunks(whole.slice(a, b - a), most):
                yield int(ids[a]), part


def _fold(partial: np.ndarray, rows: pa.RecordBatch, models: list, noise_seed: int, beta: float, sampled: bool) -> None:
    """Add the gradients and losses of some rows for every model."""
    n, at = rows.num_rows, 0
    keys = rows.column("_noise").to_numpy(zero_copy_only=False)
    for spec, vector, _ in models:
        tokens, side = spec.grid * spec.grid, 2 * spec.grid
        x = stack(rows.column("tokens"), tokens * spec.dim).astype(np.float64).reshape(n, tokens, spec.dim)
        mean, logvar = (
            stack(rows.column(c), spec.latent * side * side).astype(np.float64).reshape(n, spec.latent, side, side)
            for c in ("gt_mean", "gt_logvar")
        )
        shape = (tokens, spec.latent)
        noise = row_noise(noise_seed, keys, shape) if sampled else np.zeros((n, *shape))
        grad, mse, kl = loss_and_gradient(spec, from_vector(spec, vector), x, mean, logvar, noise, beta)
        partial[at : at + vector.size] += to_vector(grad)
        partial[at + vector.size : at + vector.size + 2] += (mse, kl)
        at += vector.size + 2
    partial[-1] += n


def dealt_rows(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` with their ``_batch`` from (shard_id, offset, batch_id); rows without a place are left out."""
    return rows.join(places.select("shard_id", "offset", F.col("batch_id").cast("int").alias(BATCH)), ["shard_id", "offset"])
