"""Frozen-model encoding: any batch model behind a small protocol.

An encoder (or decoder) is a ``make_predict_fn`` -- called once per Python worker,
so a heavy model loads once -- plus the shapes it consumes and produces. Its
output is a struct of named tensors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class BatchModel:
    """A pluggable model: factory, input shape, output tensor names."""

    make_predict_fn: Callable[[], Callable[[np.ndarray], Mapping[str, np.ndarray]]]
    input_shape: tuple[int, ...]
    outputs: tuple[str, ...]


def apply_model(df: DataFrame, model: BatchModel, column: str, batch_size: int = 32, drop: bool = True) -> DataFrame:
    """Run a model over ``column`` and add its output tensors as array columns.

    ``column`` should be a stored column or the output of a batch transform (decoded
    pixels, scored latents): the optimizer does not reliably extract a Python UDF
    whose argument is itself an expression with nested lambdas.
    """
    schema = T.StructType([T.StructField(n, T.ArrayType(T.FloatType())) for n in model.outputs])
    predict = predict_batch_udf(
        model.make_predict_fn, return_type=schema, batch_size=batch_size, input_tensor_shapes=[list(model.input_shape)]
    )
    out = df.withColumn("_out", predict(F.col(column)))
    out = out.select("*", *[F.col(f"_out.{n}").alias(n) for n in model.outputs]).drop("_out")
    return out.drop(column) if drop and column not in model.outputs else out


def encode_features(
    df: DataFrame, encoder: BatchModel, pixels: str = "pixels", batch_size: int = 16, keep_pixels: bool = False
) -> DataFrame:
    """pixels -> tokens, gt_mean, gt_logvar (whatever the encoder names)."""
    return apply_model(df, encoder, pixels, batch_size, drop=not keep_pixels)


def patch_encoder(
    channels: int, size: int, patch: int, dim: int, latent: int, seed: int = 0, leading: int = 0
) -> BatchModel:
    """Deterministic stand-in for a pretrained encoder: fixed random projections.

    tokens: every patch times a [pixels, dim] matrix, after ``leading`` summary
    tokens (patch averages), as vision encoders emit them. gt_mean / gt_logvar: each
    half-patch cell times [pixels, latent] matrices, on a grid twice as fine.
    """

    def make_predict_fn():
        rng = np.random.default_rng(seed)

        def projection(n: int, m: int) -> np.ndarray:
            return (rng.standard_normal((n, m)) / np.sqrt(n)).astype(np.float32)

        to_token = projection(channels * patch * patch, dim)
        cell = patch // 2
        to_mean = projection(channels * cell * cell, latent)
        to_logvar = projection(channels * cell * cell, latent)

        def predict(pixels: np.ndarray) -> dict[str, np.ndarray]:
            tokens = cut(pixels, patch) @ to_token
            if leading:
                summary = np.repeat(tokens.mean(axis=1, keepdims=True), leading, axis=1)
                tokens = np.concatenate([summary, tokens], axis=1)
            cells = cut(pixels, cell)
            mean = (cells @ to_mean).transpose(0, 2, 1)
            logvar = (cells @ to_logvar).transpose(0, 2, 1)
            n = len(pixels)
            return {
                "tokens": tokens.reshape(n, -1),
                "gt_mean": mean.reshape(n, -1),
                "gt_logvar": logvar.reshape(n, -1),
            }

        return predict

    return BatchModel(make_predict_fn, (channels, size, size), ("tokens", "gt_mean", "gt_logvar"))


def cut(pixels: np.ndarray, patch: int) -> np.ndarray:
    """[B, C, H, W] -> [B, patches, C * patch * patch], patches in row-major order."""
    b, c, h, w = pixels.shape
    tiles = pixels.reshape(b, c, h // patch, patch, w // patch, patch)
    return tiles.transpose(0, 2, 4, 1, 3, 5).reshape(b, -1, c * patch * patch)


def linear_decoder(latent: int, size: int, seed: int = 0) -> BatchModel:
    """Deterministic stand-in decoder: latent channels -> RGB in [-1, 1] per cell."""

    def make_predict_fn():
        mix = np.random.default_rng(seed).standard_normal((3, latent)) / np.sqrt(latent)

        def predict(z: np.ndarray) -> dict[str, np.ndarray]:
            rgb = np.tanh(np.einsum("kc,bchw->bkhw", mix, z))
            return {"pixels": rgb.reshape(len(z), -1).astype(np.float32)}

        return predict

    return BatchModel(make_predict_fn, (latent, size, size), ("pixels",))
