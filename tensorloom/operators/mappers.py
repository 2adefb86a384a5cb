"""Small mapping models: specs, parameters and distributed scoring.

A model is a ``MapperSpec`` (what to compute) plus a parameter table
``(param, shape, values)``. Scoring is one ``mapInArrow`` pass: parameters travel
to each Python worker once as a broadcast whose size follows from the spec, every
Arrow batch is stacked to a dense block, and only row-local numpy runs on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.functions.hashing import hash32, unit
from tensorloom.operators.latent import upsample_matrix

Params = dict[str, np.ndarray]


@dataclass(frozen=True)
class MapperSpec:
    """Geometry and depth of one mapper. Defaults are the full-size geometry."""

    kind: str = "linear"
    dim: int = 384
    latent: int = 16
    grid: int = 32
    width: int = 256
    layers: int = 4  # MLP layers
    blocks: int = 32  # residual blocks
    heads: int = 8
    attention: int = 1  # attention blocks
    ratio: float = 4.0
    norm: bool = True

    def sized(self, **changes) -> "MapperSpec":
        return replace(self, **changes)


# name -> spec with the class defaults
SPECS: dict[str, MapperSpec] = {
    "linear": MapperSpec("linear"),
    "mlp": MapperSpec("mlp"),
    "resnet": MapperSpec("resnet", width=512),
    "transformer": MapperSpec("transformer"),
    "transformer_resnet": MapperSpec("transformer_resnet", width=512),
}


def create_mapper(name: str, **options) -> MapperSpec:
    """Look a mapper up by name; unknown names are an error."""
    if name not in SPECS:
        raise ValueError(f"unknown mapper {name!r}; known: {sorted(SPECS)}")
    return SPECS[name].sized(**options)


# ---- parameters -----------------------------------------------------------


def param_shapes(spec: MapperSpec) -> dict[str, tuple[int, ...]]:
    """Every parameter of a spec, in forward order. Weights are [in, out]."""
    shapes: dict[str, tuple[int, ...]] = {}

    def linear(name: str, n_in: int, n_out: int) -> None:
        shapes[f"{name}.w"] = (n_in, n_out)
        shapes[f"{name}.b"] = (n_out,)

    def norm(name: str, n: int) -> None:
        shapes[f"{name}.g"] = (n,)
        shapes[f"{name}.s"] = (n,)

    feature = spec.dim
    if spec.kind == "mlp":
        for i in range(spec.layers):
            linear(f"mlp{i}", feature, spec.width)
            if spec.norm:
                norm(f"mlp{i}.ln", spec.width)
            feature = spec.width
    if spec.kind.startswith("transformer"):
        if spec.norm:
            norm("pre", spec.dim)
        for i in range(spec.attention):
            if spec.norm:
                norm(f"att{i}.ln", spec.dim)
            linear(f"att{i}.qkv", spec.dim, 3 * spec.dim)
            linear(f"att{i}.out", spec.dim, spec.dim)
            if spec.norm:
                norm(f"ffn{i}.ln", spec.dim)
            linear(f"ffn{i}.up", spec.dim, int(spec.dim * spec.ratio))
            linear(f"ffn{i}.down", int(spec.dim * spec.ratio), spec.dim)
        if spec.norm:
            norm("post", spec.dim)
    if spec.kind.endswith("resnet"):
        linear("enter", feature, spec.width)
        norm("enter.ln", spec.width)
        for i in range(spec.blocks):
            for half in "ab":
                linear(f"res{i}{half}", spec.width, spec.width)
                if spec.norm:
                    norm(f"res{i}{half}.ln", spec.width)
        feature = spec.width
    linear("mean", feature, spec.latent)
    linear("logvar", feature, spec.latent)
    return shapes


def param_count(spec: MapperSpec) -> int:
    return sum(math.prod(s) for s in param_shapes(spec).values())


def init_weights(spec: MapperSpec, seed: int = 42) -> Params:
    """Xavier-uniform weights, zero biases, unit norms.

    The plain linear mapper keeps the fan-in uniform default for both.
    """
    rng = np.random.default_rng(seed)
    params: Params = {}
    for name, shape in param_shapes(spec).items():
        slot = name.rsplit(".", 1)[1]
        fan_in = shape[0] if slot == "w" else params[name[:-1] + "w"].shape[0] if slot == "b" else 0
        if slot == "g":
            params[name] = np.ones(shape)
        elif spec.kind == "linear":
            params[name] = rng.uniform(-1, 1, shape) / math.sqrt(fan_in)
        elif slot == "w":
            params[name] = rng.uniform(-1, 1, shape) * math.sqrt(6.0 / sum(shape))
        else:
            params[name] = np.zeros(shape)
    return params


def weights_table(spark: SparkSession, params: Params, run_id: str, epoch: int) -> DataFrame:
    """Parameters as rows (run_id, epoch, param, shape, values)."""
    rows = [(run_id, epoch, n, list(a.shape), a.ravel().tolist()) for n, a in params.items()]
    return spark.createDataFrame(
        rows, "run_id string, epoch int, param string, shape array<int>, values array<double>"
    )


def param_totals(weights: DataFrame) -> DataFrame:
    """(run_id, epoch, n_params, n_values, whole): size of every stored model, and whether each parameter has as many values as its shape says."""
    told = F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n)
    return weights.groupBy("run_id", "epoch").agg(
        F.count(F.lit(1)).alias("n_params"),
        F.sum(F.size("values")).alias("n_values"),
        F.bool_and(told == F.size("values")).alias("whole"),
    )


def hashed_weights(runs: DataFrame, spec: MapperSpec) -> DataFrame:
    """(run_id, param, i, value): first weights of many runs (run_id, seed), made in tasks.

    Ranges and constants are those of :func:`init_weights`; the draw is a hash of (seed,
    parameter, flat index) instead of a generator's next number, so any value can be made alone.
    """
    rows = []
    shapes = param_shapes(spec)
    for name, shape in shapes.items():
        slot = name.rsplit(".", 1)[1]
        fan_in = shapes[name[:-1] + "w"][0] if slot in "wb" else 1
        if slot == "g":
            low, width = 1.0, 0.0
        elif spec.kind == "linear":
            low, width = -1 / math.sqrt(fan_in), 2 / math.sqrt(fan_in)
        else:
            bound = math.sqrt(6.0 / sum(shape)) if slot == "w" else 0.0
            low, width = -bound, 2 * bound
        rows.append((name, math.prod(shape), low, width))
    params = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("param", "n", "low", "width"), row, strict=True)]) for row in rows])
    each = runs.select("run_id", "seed", F.inline(params)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return each.select("run_id", "param", "i", (F.col("low") + F.col("width") * unit(hash32(F.col("seed"), F.col("param"), F.col("i")))).alias("value"))


def weights_from_table(table: DataFrame) -> Params:
    """Back to arrays; one model's rows, bounded by its parameter count."""
    return {
        r["param"]: np.asarray(r["values"]).reshape(r["shape"])
        for r in table.select("param", "shape", "values").collect()
    }


# ---- forward --------------------------------------------------------------

# erf on a fixed grid with its exact derivative; cubic Hermite in between (~1e-11)
_ERF_STEP = 1.0 / 128
_ERF_END = 6.0
_ERF_X = np.arange(-_ERF_END, _ERF_END + _ERF_STEP, _ERF_STEP)
_ERF_Y = np.array([math.erf(x) for x in _ERF_X])
_ERF_D = 2.0 / math.sqrt(math.pi) * np.exp(-_ERF_X * _ERF_X) * _ERF_STEP


def erf(x: np.ndarray) -> np.ndarray:
    place = np.clip((x + _ERF_END) / _ERF_STEP, 0, len(_ERF_X) - 1.000001)
    i = place.astype(np.int64)
    t = place - i
    y0, y1, d0, d1 = _ERF_Y[i], _ERF_Y[i + 1], _ERF_D[i], _ERF_D[i + 1]
    rise = y1 - y0
    return y0 + t * (d0 + t * (3 * rise - 2 * d0 - d1 + t * (d0 + d1 - 2 * rise)))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)))


def layer_norm(p: Params, name: str, x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    if f"{name}.g" not in p:
        return x
    centred = x - x.mean(axis=-1, keepdims=True)
    spread = np.sqrt((centred * centred).mean(axis=-1, keepdims=True) + eps)
    return centred / spread * p[f"{name}.g"] + p[f"{name}.s"]


def affine(p: Params, name: str, x: np.ndarray) -> np.ndarray:
    return x @ p[f"{name}.w"] + p[f"{name}.b"]


def attend(p: Params, name: str, x: np.ndarray, heads: int) -> np.ndarray:
    """Multi-head self-attention among the tokens of one row."""
    b, n, d = x.shape
    q, k, v = affine(p, f"{name}.qkv", x).reshape(b, n, 3, heads, d // heads).transpose(2, 0, 3, 1, 4)
    score = q @ k.transpose(0, 1, 3, 2) / math.sqrt(d // heads)
    score = np.exp(score - score.max(axis=-1, keepdims=True))
    mixed = (score / score.sum(axis=-1, keepdims=True)) @ v
    return affine(p, f"{name}.out", mixed.transpose(0, 2, 1, 3).reshape(b, n, d))


def features(spec: MapperSpec, p: Params, x: np.ndarray) -> np.ndarray:
    """Token features before the two heads, [B, N, dim or width]."""
    if spec.kind == "mlp":
        for i in range(spec.layers):
            x = gelu(layer_norm(p, f"mlp{i}.ln", affine(p, f"mlp{i}", x)))
    if spec.kind.startswith("transformer"):
        x = layer_norm(p, "pre", x)
        for i in range(spec.attention):
            x = x + attend(p, f"att{i}", layer_norm(p, f"att{i}.ln", x), spec.heads)
            x = x + affine(p, f"ffn{i}.down", gelu(affine(p, f"ffn{i}.up", layer_norm(p, f"ffn{i}.ln", x))))
        x = layer_norm(p, "post", x)
    if spec.kind.endswith("resnet"):
        x = layer_norm(p, "enter.ln", gelu(affine(p, "enter", x)))
        for i in range(spec.blocks):
            inner = layer_norm(p, f"res{i}a.ln", gelu(affine(p, f"res{i}a", x)))
            x = x + layer_norm(p, f"res{i}b.ln", gelu(affine(p, f"res{i}b", inner)))
    return x


def to_latent(spec: MapperSpec, tokens: np.ndarray) -> np.ndarray:
    """[B, N, latent] -> bilinear [B, latent, 2g, 2g]."""
    g = spec.grid
    up = upsample_matrix(g)
    planes = tokens.transpose(0, 2, 1).reshape(len(tokens), spec.latent, g, g)
    return up @ planes @ up.T


def forward(
    spec: MapperSpec, p: Params, x: np.ndarray, noise: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, mean, logvar) latents of a block of rows; z is the mean without noise."""
    h = features(spec, p, x)
    mean, logvar = affine(p, "mean", h), affine(p, "logvar", h)
    mean_up, logvar_up = to_latent(spec, mean), to_latent(spec, logvar)
    if noise is None:
        return mean_up, mean_up, logvar_up
    return to_latent(spec, mean + np.exp(0.5 * logvar) * noise), mean_up, logvar_up


def row_noise(seed: int, items: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Standard normals keyed by (seed, item): independent of batching and retries."""
    return np.stack(
        [np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), int(i) & (2**64 - 1)])).standard_normal(shape) for i in items]
    )


def noise_key(df: DataFrame, item: str) -> Column:
    """What keys an item's noise: the id itself when it is a number, else a hash of it."""
    whole = dict(df.dtypes)[item] in ("bigint", "int", "smallint", "tinyint")
    return F.col(item).cast("long") if whole else F.xxhash64(item)


# ---- scoring --------------------------------------------------------------


def stack(column: pa.Array, width: int) -> np.ndarray:
    """List column -> dense [rows, width]; rows must agree in length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def unstack(block: np.ndarray) -> pa.ListArray:
    """Dense [rows, ...] -> list column of float."""
    flat = np.ascontiguousarray(block.reshape(len(block), -1), dtype=np.float32)
    ends = np.arange(len(block) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))


def row_chunks(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def score(
    df: DataFrame,
    spec: MapperSpec,
    params: Params,
    *,
    tokens: str = "tokens",
    item: str = "item_id",
    sample: bool = False,
    seed: int = 42,
    batch_size: int = 32,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add pred_z, pred_mean, pred_logvar.

    ``keep`` names the columns to carry along (default: all but the tokens).
    """
    keep = [c for c in df.columns if c != tokens] if keep is None else keep
    keyed = df.withColumn("_noise", noise_key(df, item)) if sample else df
    inputs = keyed.select(*keep, *[c for c in dict.fromkeys([tokens, *(["_noise"] if sample else [])]) if c not in keep])
    out_names = ["pred_z", "pred_mean", "pred_logvar"]
    schema = T.StructType(
        [df.schema[c] for c in keep] + [T.StructField(n, T.ArrayType(T.FloatType())) for n in out_names]
    )
    shared = df.sparkSession.sparkContext.broadcast(params)  # size: param_count(spec) doubles
    n_tokens = spec.grid * spec.grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for whole in batches:
            for batch in row_chunks(whole, batch_size):
                x = stack(batch.column(tokens), n_tokens * spec.dim).reshape(-1, n_tokens, spec.dim).astype(np.float64)
                noise = None
                if sample:
                    noise = row_noise(seed, batch.column("_noise").to_numpy(zero_copy_only=False), (n_tokens, spec.latent))
                outs = forward(spec, p, x, noise)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + [unstack(o) for o in outs], names=keep + out_names
                )

    return inputs.mapInArrow(run, schema)


def score_losses(
    df: DataFrame,
    spec: MapperSpec,
    params: Params,
    *,
    keep: list[str],
    tokens: str = "tokens",
    batch_size: int = 32,
) -> DataFrame:
    """Per-row mse and kl of the predictions (not sampled) against gt_mean, gt_logvar.

    The predictions themselves never leave the Python worker: a row returns two
    numbers instead of three latents. Feed the result to ``loss.evaluate``.
    """
    inputs = df.select(*keep, *[c for c in (tokens, "gt_mean", "gt_logvar") if c not in keep])
    schema = T.StructType(
        [df.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in ("mse", "kl")]
    )
    shared = df.sparkSession.sparkContext.broadcast(params)  # size: param_count(spec) doubles
    n_tokens, cells = spec.grid * spec.grid, 4 * spec.grid * spec.grid * spec.latent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for whole in batches:
            for batch in row_chunks(whole, batch_size):
                x = stack(batch.column(tokens), n_tokens * spec.dim).reshape(-1, n_tokens, spec.dim).astype(np.float64)
                mean, _, logvar = (o.reshape(len(x), -1) for o in forward(spec, p, x))
                gt_mean, gt_logvar = (stack(batch.column(c), cells).astype(np.float64) for c in ("gt_mean", "gt_logvar"))
                gap = mean - gt_mean
                kl = 0.5 * (gt_logvar - logvar + np.exp(logvar - gt_logvar) + gap * gap * np.exp(-gt_logvar) - 1.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + [pa.array((gap * gap).mean(axis=1)), pa.array(kl.mean(axis=1))],
                    names=keep + ["mse", "kl"],
                )

    return inputs.mapInArrow(run, schema)
