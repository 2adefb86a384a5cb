"""Fitting mappers: one-pass least squares and synchronous gradient descent.

Both are the same shape of job: every task folds its rows into one fixed-size partial --
a gradient, or a triangular factor --, partials are merged few at a time, and the driver
gets a result whose size depends on the model only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.latent import upsample_matrix
from tensorloom.operators.loss import BETA, LR_FLOOR, LR_PI
from tensorloom.operators.mappers import (
    MapperSpec,
    Params,
    affine,
    erf,
    init_weights,
    noise_key,
    param_shapes,
    row_chunks,
    row_noise,
    stack,
    to_latent,
)
from tensorloom.session import task_slots

BLOCK_VALUES = 4096
FAN_IN = 64


# ---- distributed vector sum ----------------------------------------------


def sum_vectors(df: DataFrame, columns: list[str], fold: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """Sum over all tasks of ``fold(batches of this task)``, a vector of ``size``.

    Tasks are merged onto the cluster's slots first (no shuffle), so the number of
    partials is bounded by the cluster, not by the number of input splits.
    """
    n_blocks = -(-size // BLOCK_VALUES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = peek(batches)
        if seen is None:
            return
        vector = np.zeros(n_blocks * BLOCK_VALUES)
        vector[:size] = fold(seen)
        salt = TaskContext.get().partitionId() % FAN_IN  # same on a retry
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(n_blocks, dtype=np.int32)),
                pa.array(np.full(n_blocks, salt, dtype=np.int32)),
                pa.array(list(vector.reshape(n_blocks, BLOCK_VALUES)), pa.list_(pa.float64())),
            ],
            names=["block", "salt", "v"],
        )

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    narrow = _large_enough(df.select(*columns), 8 * size)
    sums = narrow.mapInArrow(partial, "block int, salt int, v array<double>")
    for keys in (["block", "salt"], ["block"]):
        sums = sums.groupBy(*keys).applyInPandas(add, "block int, v array<double>")
    out = np.zeros(n_blocks * BLOCK_VALUES)
    for row in sums.collect():  # n_blocks rows: the size of one model
        out[row["block"] * BLOCK_VALUES : (row["block"] + 1) * BLOCK_VALUES] = row["v"]
    return out[:size]


def _large_enough(rows: DataFrame, vector_bytes: int) -> DataFrame:
    """``rows`` with the scan's own partitions, merged only as far as a task's input outweighs its sum 16 times.

    A usual model is far smaller than a scan split, so nothing is merged; with a very large
    one, sums of single splits would be as much data as the store itself.
    """
    spark = rows.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    merge = 16 * vector_bytes // split
    if merge < 2:
        return rows
    return rows.coalesce(max(rows._jdf.rdd().getNumPartitions() // merge, 2 * task_slots(spark)))


def peek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch] | None:
    """None for a task without rows."""
    for first in batches:
        if first.num_rows:

            def chain() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            return chain()
    return None


# ---- least squares --------------------------------------------------------


def linear_moments(
    store: DataFrame, dim: int, latent: int, grid: int, tokens: str = "tokens", upsample: bool = True, batch_size: int = 8
) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums (XtX, XtY) over all cells of all rows, and the number of cells.

    X: upsampled tokens plus a constant; Y: gt_mean and gt_logvar channels. The
    upsampling U is linear and acts on space only, so it commutes with the projection
    and regressing on upsampled tokens fits the mapper itself. For the same reason
    nothing is upsampled here: XtX = tokens' (UtU) tokens and XtY = tokens' (UtY),
    both at token resolution. Without upsampling only token moments are formed.
    """
    d, t = dim + 1, 2 * latent
    up = upsample_matrix(grid)
    gram = up.T @ up if upsample else np.eye(grid)
    columns = [tokens] + (["gt_mean", "gt_logvar"] if upsample else [])
    cells = (4 if upsample else 1) * grid * grid

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        xtx, xty, n = np.zeros((d, d)), np.zeros((d, t)), 0
        for whole in batches:
            for batch in row_chunks(whole, batch_size):
                rows = batch.num_rows
                x = stack(batch.column(tokens), grid * grid * dim).astype(np.float64).reshape(rows, grid * grid, dim)
                x = np.concatenate([x, np.ones((rows, grid * grid, 1))], axis=2)  # U keeps a constant constant
                flat = x.reshape(-1, d)
                smooth = gram @ x.transpose(0, 2, 1).reshape(rows, d, grid, grid) @ gram
                xtx += flat.T @ smooth.reshape(rows, d, -1).transpose(0, 2, 1).reshape(-1, d)
                n += rows * cells
                if upsample:
                    y = [stack(batch.column(c), latent * cells).reshape(rows, latent, 2 * grid, 2 * grid) for c in columns[1:]]
                    small = up.T @ np.concatenate(y, axis=1).astype(np.float64) @ up
                    xty += flat.T @ small.reshape(rows, t, -1).transpose(0, 2, 1).reshape(-1, t)
        return np.concatenate([xtx.ravel(), xty.ravel(), [n]])

    v = sum_vectors(store, columns, fold, d * d + d * t + 1)
    return v[: d * d].reshape(d, d), v[d * d : -1].reshape(d, t), int(round(v[-1]))


def moments_table(store: DataFrame, dim: int, grid: int, tokens: str = "tokens") -> DataFrame:
    """Token second moments (i, j, value) with the constant as the last feature."""
    xtx, _, _ = linear_moments(store, dim, 0, grid, tokens, upsample=False)
    rows = [(i, j, float(xtx[i, j])) for i in range(dim + 1) for j in range(dim + 1)]
    return store.sparkSession.createDataFrame(rows, "i int, j int, value double")


MERGE = 16  # factors merged at once


def linear_factor(store: DataFrame, dim: int, latent: int, grid: int, batch_size: int = 8) -> tuple[np.ndarray, int]:
    """The triangular factor of the design with its targets, [X Y] = QR, and the number of cells.

    X: upsampled tokens plus a constant; Y: gt_mean and gt_logvar channels; one row per
    cell. Every task folds its rows into one factor, factors are merged ``MERGE`` at a time in
    as many rounds as that takes, so no task holds more of them and nothing is squared: the
    factor keeps the condition of the data. The upsampling U acts on space only; with U = QuRu
    the residual of U X W - Y differs from that of Ru X W - Qu'Y by a constant, so blocks have
    token resolution.
    """
    q1, r1 = np.linalg.qr(upsample_matrix(grid))
    width, cells = dim + 1 + 2 * latent, grid * grid

    def block(batch: pa.RecordBatch) -> np.ndarray:
        n = batch.num_rows
        x = stack(batch.column("tokens"), cells * dim).astype(np.float64).reshape(n, cells, dim)
        x = np.concatenate([x, np.ones((n, cells, 1))], axis=2).transpose(0, 2, 1).reshape(n, dim + 1, grid, grid)
        y = [stack(batch.column(c), latent * 4 * cells).reshape(n, latent, 2 * grid, 2 * grid) for c in ("gt_mean", "gt_logvar")]
        small = q1.T @ np.concatenate(y, axis=1).astype(np.float64) @ q1
        both = np.concatenate([r1 @ x @ r1.T, small], axis=1)
        return both.reshape(n, width, cells).transpose(0, 2, 1).reshape(-1, width)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, n = np.zeros((0, width)), 0
        for whole in batches:
            for batch in row_chunks(whole, batch_size):
                factor = np.linalg.qr(np.concatenate([factor, block(batch)]), mode="r")
                n += batch.num_rows * 4 * cells
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([factor.ravel()], pa.list_(pa.float64()))],
                ["node", "n", "factor"],
            )

    shape = "node long, n long, factor array<double>"

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.asarray(f).reshape(-1, width) for f in pdf["factor"]]
        merged = np.linalg.qr(np.concatenate(parts), mode="r")
        return pd.DataFrame({"node": [key[0]], "n": [int(pdf["n"].sum())], "factor": [merged.ravel()]})

    narrow = _large_enough(store.select("tokens", "gt_mean", "gt_logvar"), 8 * width * width)
    factors, left = narrow.mapInArrow(fold, shape), narrow._jdf.rdd().getNumPartitions()
    while left > 1:
        node = F.floor(F.col("node") / MERGE).cast("long")
        factors, left = factors.withColumn("node", node).groupBy("node").applyInPandas(merge, shape), -(-left // MERGE)
    row = factors.first()  # one factor: the size of the model's moments
    return (np.zeros((0, width)), 0) if row is None else (np.asarray(row["factor"]).reshape(-1, width), row["n"])


def fit_linear(store: DataFrame, spec: MapperSpec, ridge: float = 0.0) -> Params:
    """Least-squares linear mapper (the MSE part of the objective) in one pass.

    Solved from the data's triangular factor, so nearly collinear tokens lose no more
    digits than they must; collinear ones get the solution of least norm.
    """
    factor, n = linear_factor(store, spec.dim, spec.latent, spec.grid)
    if n == 0:
        raise ValueError("cannot fit on an empty store")
    d = spec.dim + 1
    x, y = factor[:, :d], factor[:, d:]
    if ridge:
        penalty = np.sqrt(ridge * n) * np.eye(d)[:-1]  # the constant is free
        x, y = np.concatenate([x, penalty]), np.concatenate([y, np.zeros((d - 1, y.shape[1]))])
    solution = np.linalg.lstsq(x, y, rcond=None)[0]
    mean, logvar = solution[:, : spec.latent], solution[:, spec.latent :]
    return {"mean.w": mean[:-1], "mean.b": mean[-1], "logvar.w": logvar[:-1], "logvar.b": logvar[-1]}


# ---- gradients ------------------------------------------------------------


def to_vector(params: Params) -> np.ndarray:
    return np.concatenate([a.ravel() for a in params.values()])


def from_vector(spec: MapperSpec, vector: np.ndarray) -> Params:
    out, start = {}, 0
    for name, shape in param_shapes(spec).items():
        n = int(np.prod(shape))
        out[name] = vector[start : start + n].reshape(shape)
        start += n
    return out


def loss_and_gradient(
    spec: MapperSpec, p: Params, x: np.ndarray, gt_mean: np.ndarray, gt_logvar: np.ndarray, noise: np.ndarray, beta: float
) -> tuple[Params, float, float]:
    """Gradient of sum over rows of (row MSE + beta * row KL), with both sums.

    x [B, N, dim]; targets [B, latent, 2g, 2g]; noise [B, N, latent]. Linear and MLP.
    """
    if spec.kind not in ("linear", "mlp"):
        raise ValueError(f"no gradient for {spec.kind!r}")
    tape, h = [], x
    for i in range(spec.layers if spec.kind == "mlp" else 0):
        pre = affine(p, f"mlp{i}", h)
        normed, unit, spread = pre, None, None
        if spec.norm:
            centred = pre - pre.mean(axis=-1, keepdims=True)
            spread = np.sqrt((centred * centred).mean(axis=-1, keepdims=True) + 1e-5)
            unit = centred / spread
            normed = unit * p[f"mlp{i}.ln.g"] + p[f"mlp{i}.ln.s"]
        gate = 0.5 * (1.0 + erf(normed / np.sqrt(2.0)))
        tape.append((h, normed, gate, unit, spread))
        h = normed * gate

    mean, logvar = affine(p, "mean", h), affine(p, "logvar", h)
    std = np.exp(0.5 * logvar)
    z_up, mean_up, logvar_up = (to_latent(spec, a) for a in (mean + std * noise, mean, logvar))
    cells = gt_mean[0].size
    miss, gap = z_up - gt_mean, mean_up - gt_mean
    inv = np.exp(-gt_logvar)
    ratio = np.exp(logvar_up - gt_logvar)
    mse_sum = (miss**2).sum() / cells
    kl_sum = 0.5 * (gt_logvar - logvar_up + ratio + gap**2 * inv - 1.0).sum() / cells

    dz = down(spec, 2.0 * miss / cells)
    dmean = dz + down(spec, beta * gap * inv / cells)
    dlogvar = dz * 0.5 * std * noise + down(spec, beta * 0.5 * (ratio - 1.0) / cells)

    grad: Params = {}

    def back(name: str, inputs: np.ndarray, d: np.ndarray) -> np.ndarray:
        grad[f"{name}.w"] = inputs.reshape(-1, inputs.shape[-1]).T @ d.reshape(-1, d.shape[-1])
        grad[f"{name}.b"] = d.reshape(-1, d.shape[-1]).sum(axis=0)
        return d @ p[f"{name}.w"].T

    dh = back("mean", h, dmean) + back("logvar", h, dlogvar)
    for i in reversed(range(len(tape))):
        inputs, normed, gate, unit, spread = tape[i]
        d = dh * (gate + normed * np.exp(-0.5 * normed * normed) / np.sqrt(2.0 * np.pi))
        if spec.norm:
            grad[f"mlp{i}.ln.g"] = (d * unit).reshape(-1, spec.width).sum(axis=0)
            grad[f"mlp{i}.ln.s"] = d.reshape(-1, spec.width).sum(axis=0)
            d = d * p[f"mlp{i}.ln.g"]
            d = (d - d.mean(axis=-1, keepdims=True) - unit * (d * unit).mean(axis=-1, keepdims=True)) / spread
        dh = back(f"mlp{i}", inputs, d)
    return {name: grad[name] for name in param_shapes(spec)}, float(mse_sum), float(kl_sum)


def down(spec: MapperSpec, planes: np.ndarray) -> np.ndarray:
    """Transpose of the upsampling: [B, latent, 2g, 2g] -> [B, N, latent]."""
    up = upsample_matrix(spec.grid)
    small = up.T @ planes @ up
    return small.reshape(len(planes), spec.latent, -1).transpose(0, 2, 1)


def gradient_step(
    rows: DataFrame, spec: MapperSpec, params: Params, step: int, seed: int = 42, beta: float = BETA, batch_size: int = 32
) -> tuple[np.ndarray, float, float, int]:
    """Mean gradient (flat), mean MSE, mean KL and row count over all given rows, in one job."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(params)  # size: param_count(spec) doubles
    n_tokens, side = spec.grid * spec.grid, 2 * spec.grid
    size = sum(a.size for a in params.values())

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        p, out = shared.value, np.zeros(size + 3)
        for whole in batches:
            for batch in row_chunks(whole, batch_size):
                n = batch.num_rows
                x = stack(batch.column("tokens"), n_tokens * spec.dim).astype(np.float64).reshape(n, n_tokens, spec.dim)
                mean, logvar = (
                    stack(batch.column(c), spec.latent * side * side).astype(np.float64).reshape(n, spec.latent, side, side)
                    for c in ("gt_mean", "gt_logvar")
                )
                noise = row_noise(
                    seed * 1_000_003 + step, batch.column("_noise").to_numpy(zero_copy_only=False), (n_tokens, spec.latent)
                )
                grad, mse_sum, kl_sum = loss_and_gradient(spec, p, x, mean, logvar, noise, beta)
                out[:size] += to_vector(grad)
                out[size:] += (mse_sum, kl_sum, n)
        return out

    keyed = rows.withColumn("_noise", noise_key(rows, "item_id"))
    total = sum_vectors(keyed, ["_noise", "tokens", "gt_mean", "gt_logvar"], fold, size + 3)
    shared.unpersist()
    n = int(round(total[-1]))
    if n == 0:
        return np.zeros(size), 0.0, 0.0, 0
    return total[:size] / n, float(total[size] / n), float(total[size + 1] / n), n


class AdamW:
    """Decoupled weight decay Adam on one flat vector (driver side, model-sized)."""

    # fixed values: usual defaults of the optimiser
    BETA_1, BETA_2, EPS, DECAY = 0.9, 0.999, 1e-8, 1e-4

    def __init__(self, size: int) -> None:
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0

    def update(self, w: np.ndarray, g: np.ndarray, lr: float) -> np.ndarray:
        self.t += 1
        self.m = self.BETA_1 * self.m + (1 - self.BETA_1) * g
        self.v = self.BETA_2 * self.v + (1 - self.BETA_2) * g * g
        m, v = self.m / (1 - self.BETA_1**self.t), self.v / (1 - self.BETA_2**self.t)
        return w * (1 - lr * self.DECAY) - lr * m / (np.sqrt(v) + self.EPS)


def lr_at(step: int, base_lr: float, total_steps: int, warmup_steps: int) -> float:
    """Driver-side twin of ``loss.lr_factor`` for the update rule."""
    if step < warmup_steps:
        return base_lr * (LR_FLOOR + (1 - LR_FLOOR) * step / max(warmup_steps, 1))
    progress = (step - warmup_steps) / max(total_steps - warmup_steps, 1)
    return base_lr * (LR_FLOOR + (1 - LR_FLOOR) * 0.5 * (1 + float(np.cos(LR_PI * progress))))


def fit_gradient(
    store: DataFrame,
    spec: MapperSpec,
    *,
    epochs: int = 1,
    steps_per_epoch: int = 1,
    lr: float = 1e-3,
    warmup_steps: int = 0,
    beta: float = BETA,
    seed: int = 42,
    params: Params | None = None,
    optimizer: AdamW | None = None,
    start_epoch: int = 0,
    cache: StorageLevel | None = None,
    batches: Callable[[int], DataFrame] | None = None,
    barrier: bool = False,
    sampled: bool = True,
    on_epoch: Callable[[int, Params, AdamW, float], None] | None = None,
) -> tuple[Params, list[tuple[int, int, int, float, float, float, float]]]:
    """Synchronous data-parallel AdamW on mse + beta * kl; linear and MLP mappers.

    Each step is one job over its share of the rows: a global batch. Shares are whole
    shards, dealt anew each epoch by a seeded hash, so a step on a partitioned store
    reads only its own shards (rows without a shard_id are dealt one by one). State
    between steps is the flat parameter vector, never a growing plan. ``batches`` deals rows
    by position instead: for an epoch it gives (shard_id, offset, batch_id), and a step reads
    the rows of its batch, found by constant filters. With ``barrier`` such an epoch is one job
    of barrier tasks that exchange gradients after each batch (see ``epochs``): it takes the
    same steps without planning and collecting for each. Its tasks must all run at once, which
    dynamic allocation doesn't allow. ``sampled=False`` takes the predicted means for latents,
    in epochs of barrier tasks. ``cache`` keeps
    the rows between steps; leave it out when the store exceeds the cluster's storage.
    Returns parameters and a log of (epoch, batch, global step, loss, mse, kl, lr).
    """
    from tensorloom.operators.epochs import Learner, dealt_rows, run_epoch  # they build on this module

    if not sampled and not barrier:
        raise ValueError("steps of single jobs sample their latents")
    params = params or init_weights(spec, seed)
    optimizer = optimizer or AdamW(sum(a.size for a in params.values()))
    deal_by = "shard_id" if "shard_id" in store.columns else "item_id"
    places = ["offset"] if batches is not None else []
    rows = store.select(*dict.fromkeys([deal_by, *places, "item_id", "tokens", "gt_mean", "gt_logvar"]))
    if cache is not None:
        rows = rows.persist(cache)
    log = []
    try:
        for epoch in range(start_epoch, epochs):
            losses, seen = 0.0, 0
            first, total = epoch * steps_per_epoch, epochs * steps_per_epoch
            dealt = batches(epoch) if batches is not None else None
            if dealt is not None and barrier:
                counts = dict(dealt.groupBy("batch_id").agg(F.count(F.lit(1))).collect())  # one row per step
                rates = [lr_at(first + k, lr, total, warmup_steps) for k in range(steps_per_epoch)]
                (learner,), (steps,) = run_epoch(
                    dealt_rows(rows, dealt),
                    [Learner.of(spec, params, optimizer)],
                    rates,
                    first_step=first,
                    seed=seed,
                    beta=beta,
                    sampled=sampled,
                )
                params, optimizer = learner.params, learner.optimizer
                for step, loss, *rest in steps:
                    losses, seen = losses + loss * counts[step], seen + counts[step]
                    log.append((epoch, step, first + step + 1, loss, *rest))
            else:
                for batch in range(steps_per_epoch):
                    part = rows
                    if dealt is not None:
                        part = rows.where(_at_places(dealt.where(F.col("batch_id") == batch)))
                    elif steps_per_epoch > 1:
                        lane = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(deal_by)), F.lit(steps_per_epoch))
                        part = rows.where(lane == batch)
                    grad, mse_mean, kl_mean, n = gradient_step(part, spec, params, first + batch, seed, beta)
                    if n == 0:
                        continue
                    rate = lr_at(first + batch, lr, total, warmup_steps)
                    params = from_vector(spec, optimizer.update(to_vector(params), grad, rate))
                    loss = mse_mean + beta * kl_mean
                    losses, seen = losses + loss * n, seen + n
                    log.append((epoch, batch, first + batch + 1, loss, mse_mean, kl_mean, rate))
            if on_epoch is not None and seen:
                on_epoch(epoch + 1, params, optimizer, losses / seen)
    finally:
        if cache is not None:
            rows.unpersist()
    return params, log


def _at_places(batch: DataFrame) -> Column:
    """Constant filter for the (shard_id, offset) pairs of one batch, of which there are ``batch_size``."""
    places: dict[int, list[int]] = {}
    for row in batch.select("shard_id", "offset").collect():
        places.setdefault(row["shard_id"], []).append(row["offset"])
    found = F.lit(False)
    for shard, offsets in sorted(places.items()):
        found = found | ((F.col("shard_id") == shard) & F.col("offset").isin(sorted(offsets)))
    return F.col("shard_id").isin(sorted(places)) & found


STEP_LOG_SCHEMA = "epoch int, batch int, step int, loss double, mse double, kl double, lr double"


def fit_compare(
    store: DataFrame,
    specs: dict[str, MapperSpec],
    *,
    steps: int = 20,
    lr: float = 1e-3,
    seed: int = 42,
    beta: float = BETA,
    params: dict[str, Params] | None = None,
    sampled: bool = True,
) -> DataFrame:
    """First and last loss of each spec after ``steps`` updates on the same rows.

    All specs learn in the same pass: a step is one job and one scan, whatever their number.
    ``params`` gives initial weights by name.
    """
    from tensorloom.operators.epochs import BATCH, Learner, placed_rows, run_epoch  # they build on this module

    learners = [Learner.of(spec, (params or {}).get(name) or init_weights(spec, seed)) for name, spec in specs.items()]
    needed = store.select("item_id", "tokens", "gt_mean", "gt_logvar", F.lit(0).alias(BATCH))
    rows = placed_rows(needed, learners).persist(StorageLevel.MEMORY_AND_DISK)
    before = after = [None] * len(learners)
    try:
        for step in range(steps):
            rates = [lr_at(step, lr, steps, 0)]
            learners, logs = run_epoch(
                rows, learners, rates, first_step=step, seed=seed, beta=beta, sampled=sampled, placed=True
            )
            after = [log[0][1] if log else None for log in logs]
            before = after if step == 0 else before
    finally:
        rows.unpersist()
    told = list(zip(specs, before, after, strict=True))
    return store.sparkSession.createDataFrame(told, "mapper string, before double, after double")
