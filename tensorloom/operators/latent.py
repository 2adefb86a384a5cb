"""Latent-space arithmetic on flat array columns (row-local, no shuffle).

Layouts: tokens are (n_tokens, dim) row-major with n_tokens = grid * grid; a grid
is (channels, grid, grid) row-major.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.functions.arrays import bind
from tensorloom.functions.hashing import gaussian

# fixed values: published scale and shift of the 16-channel latent space
LATENT_SCALE = 0.3611
LATENT_SHIFT = 0.1159


def drop_leading_tokens(tokens: Column, dim: int, k: int = 5) -> Column:
    """Remove the first k tokens (class and register tokens) of a flat array."""
    return F.slice(tokens, F.lit(k * dim + 1), F.greatest(F.size(tokens) - F.lit(k * dim), F.lit(0)))


def tokens_to_grid(tokens: Column, channels: int, grid: int) -> Column:
    """(grid*grid, channels) -> (channels, grid, grid)."""
    places = _upto(grid * grid)

    def planes(t: Column) -> Column:
        return F.transform(_upto(channels), lambda c: F.transform(places, lambda n: F.get(t, n * channels + c)))

    return F.flatten(bind(tokens, planes))


def upsample2x(latent: Column, channels: int, grid: int) -> Column:
    """Bilinear x2 at half-pixel centres with clamped edges, as double.

    Along each axis output cell o blends source cells (o+1)//2 - 1 and (o+1)//2; the
    nearer one has weight 3/4.
    """
    wide = _upto(2 * grid)
    last = grid - 1

    def blend(at, o: Column) -> Column:
        upper = F.shiftright(o + 1, 1)
        lower = F.greatest(upper - 1, F.lit(0))
        upper = F.least(upper, F.lit(last))
        near_upper = F.pmod(o, F.lit(2)) == 0
        return F.when(near_upper, at(lower) * 0.25 + at(upper) * 0.75).otherwise(at(lower) * 0.75 + at(upper) * 0.25)

    def one_row(z: Column, c: Column, oy: Column) -> Column:
        """One output row: source rows blended once, then along x."""
        row = F.transform(
            _upto(grid), lambda x: blend(lambda y: F.get(z, (c * grid + y) * grid + x).cast("double"), oy)
        )
        return bind(row, lambda r: F.transform(wide, lambda ox: blend(lambda x: F.get(r, x), ox)))

    def planes(z: Column) -> Column:
        return F.flatten(
            F.transform(_upto(channels), lambda c: F.flatten(F.transform(wide, lambda oy: one_row(z, c, oy))))
        )

    return bind(latent, planes)


def upsample_matrix(grid: int) -> np.ndarray:
    """[2*grid, grid] weights of :func:`upsample2x` along one axis."""
    out = np.arange(2 * grid)
    upper = (out + 1) // 2
    weight = np.zeros((2 * grid, grid))
    for cell, share in ((upper - 1, np.where(out % 2 == 0, 0.25, 0.75)), (upper, np.where(out % 2 == 0, 0.75, 0.25))):
        np.add.at(weight, (out, np.clip(cell, 0, grid - 1)), share)
    return weight


def upsample_rows(df: DataFrame, column: str, channels: int, grid: int) -> DataFrame:
    """:func:`upsample2x` of a whole array column, batch by batch in numpy.

    For full-size rows: two small matrix products per plane instead of one
    expression per output cell. Doubles stay doubles, other numbers become floats.
    """
    up = upsample_matrix(grid)
    exact = df.schema[column].dataType == T.ArrayType(T.DoubleType())
    kind, dtype = (T.DoubleType(), np.float64) if exact else (T.FloatType(), np.float32)
    schema = T.StructType(
        [T.StructField(f.name, T.ArrayType(kind)) if f.name == column else f for f in df.schema.fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
            wide = up @ flat.reshape(-1, channels, grid, grid).astype(np.float64) @ up.T
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (channels * 4 * grid * grid)
            out = pa.ListArray.from_arrays(pa.array(ends), pa.array(wide.astype(dtype).ravel()))
            names = batch.schema.names
            arrays = [out if n == column else c for n, c in zip(names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def latent_scale(z: Column, scale: float = LATENT_SCALE, shift: float = LATENT_SHIFT) -> Column:
    """(z - shift) / scale."""
    return F.transform(z, lambda v: (v.cast("double") - F.lit(shift)) / F.lit(scale))


def latent_unscale(z: Column, scale: float = LATENT_SCALE, shift: float = LATENT_SHIFT) -> Column:
    """z / scale + shift."""
    return F.transform(z, lambda v: v.cast("double") / F.lit(scale) + F.lit(shift))


def tensor_stats(df: DataFrame, tensor: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min and max over all elements, per group."""
    values = df.select(*(by or []), F.explode(tensor).alias("_v")).withColumn("_v", F.col("_v").cast("double"))
    return values.groupBy(*(by or [])).agg(
        F.count("_v").alias("n_values"),
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )


def denormalize(pixels: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """[low, high] -> clamp -> integer 0..255, halves rounded up."""

    def level(v: Column) -> Column:
        clamped = F.least(F.greatest(v.cast("double"), F.lit(float(low))), F.lit(float(high)))
        return F.floor((clamped - F.lit(float(low))) / F.lit(float(high - low)) * 255.0 + 0.5).cast("int")

    return F.transform(pixels, level)


def reparameterize(mean: Column, logvar: Column, item: Column, seed: int = 42, sample: bool = True) -> Column:
    """z = mean + exp(logvar / 2) * eps; the mean itself when not sampling.

    eps is keyed by (seed, item, element), so a recomputed task draws the same z.
    """
    if not sample:
        return F.transform(mean, lambda m: m.cast("double"))
    return bind(
        logvar,
        lambda lv: F.transform(
            mean,
            lambda m, i: m.cast("double") + F.exp(F.get(lv, i).cast("double") * 0.5) * gaussian(seed, item, i),
        ),
    )


def mode(mean: Column) -> Column:
    """Mode of the Gaussian posterior: its mean."""
    return mean


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))
