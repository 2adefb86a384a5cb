"""Fixed sample panels: predictions per epoch, decoded and laid out for comparison."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.functions.ranking import order_rank
from tensorloom.operators.encode import BatchModel, apply_model
from tensorloom.operators.latent import denormalize
from tensorloom.operators.loss import mse
from tensorloom.operators.mappers import MapperSpec, Params, score
from tensorloom.operators.registry import is_save_epoch
from tensorloom.sources.images import triangle_weights
from tensorloom.sources.store import lookup

PANEL_COLUMNS = ("run_id", "epoch", "idx", "tokens", "gt_mean", "gt_logvar", "pred_z")


def panel_schedule(epochs: DataFrame, save_every: int = 5) -> DataFrame:
    """Panels a run writes, from (run_id, epoch zero-based, epochs): 0, then each save epoch."""
    start = epochs.select("run_id", F.lit(0).alias("panel_epoch")).distinct()
    later = epochs.where(is_save_epoch(F.col("epoch"), F.col("epochs"), save_every)).select(
        "run_id", (F.col("epoch") + 1).cast("int").alias("panel_epoch")
    )
    return start.unionByName(later)


def sample_panel(
    spark: SparkSession, store: str, spec: MapperSpec, params: Params, indices: list[int] | DataFrame, run_id: str, epoch: int
) -> DataFrame:
    """Predictions (without sampling) for fixed store indices at one epoch."""
    rows = lookup(spark, store, indices).drop("list_pos")
    scored = score(rows.withColumn("_t", F.col("tokens")), spec, params, tokens="_t", sample=False)
    return scored.select(
        F.lit(run_id).alias("run_id"),
        F.lit(epoch).alias("epoch"),
        "idx",
        "tokens",
        "gt_mean",
        "gt_logvar",
        "pred_z",
    )


def write_panel(panel: DataFrame, path: str) -> None:
    """Panels partitioned by run and epoch; rewriting an epoch replaces it."""
    panel.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "epoch").parquet(path)


def panel_error(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean squared error of pred_z against gt_mean."""
    keys = by or ["epoch", "idx"]
    return (
        samples.withColumn("_mse", mse(F.col("pred_z"), F.col("gt_mean")))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.avg("_mse").alias("mse"))
    )


def decode_plan(samples: DataFrame, fmt: str = "png", source: str | None = None) -> DataFrame:
    """Output key ``idx_{n}/epoch_{e}.{fmt}``, the idx compared as a number.

    ``source`` names a column with the panel file name (``sample_0001``); its epoch
    is what follows the last underscore.
    """
    epoch = F.col("epoch")
    if source is not None:
        epoch = F.regexp_extract(F.regexp_replace(F.col(source), r"^.*/|\.[^./]*$", ""), r"([^_]*)$", 1).try_cast("int")
    planned = samples.withColumn("epoch", epoch)
    return planned.withColumn(
        "out_key", F.format_string(f"idx_%d/epoch_%04d.{fmt}", F.col("idx").cast("long"), F.col("epoch"))
    )


def decode_samples(
    samples: DataFrame, decoder: BatchModel, size: int, latent: str = "pred_z", batch_size: int = 16
) -> DataFrame:
    """Latents -> pixels in [-1, 1] -> 8-bit levels -> PNG bytes, one row per image."""
    decoded = apply_model(samples, decoder, latent, batch_size)
    levels = decoded.withColumn("levels", denormalize(F.col("pixels"))).drop("pixels")
    keep = [c for c in levels.columns if c != "levels"]
    schema = T.StructType(
        [levels.schema[c] for c in keep]
        + [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("image", T.BinaryType())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("levels")
            pngs = []
            for i in range(batch.num_rows):
                planes = column[i].values.to_numpy(zero_copy_only=False).reshape(3, size, size)
                pngs.append(png_bytes(planes.transpose(1, 2, 0)))
            n = batch.num_rows
            extra = [pa.array([size] * n, pa.int32()), pa.array([size] * n, pa.int32()), pa.array(pngs, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + extra, names=keep + ["height", "width", "image"]
            )

    return levels.mapInArrow(encode, schema)


def encode_pngs(rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, png) from (key, height, width, data), data as interleaved B, G, R bytes."""
    schema = T.StructType([rows.schema[key], T.StructField("png", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True)
            pngs = [png_bytes(np.frombuffer(d.as_buffer(), np.uint8).reshape(h, w, 3)[:, :, ::-1]) for h, w, d in shapes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pngs, pa.binary())], names=[key, "png"])

    return rows.select(key, "height", "width", "data").mapInArrow(encode, schema)


def error_grid(errors: DataFrame, indices: list[int]) -> DataFrame:
    """One row per epoch, one column per panel index."""
    return errors.groupBy("epoch").pivot("idx", indices).agg(F.first("mse"))


PAGE_SIDE = 4096  # pixels: a page of 3 bytes a pixel is 50 MB at most


def comparison_grid(cells: DataFrame, columns: int | None = None, rows: int | None = None, side: int = PAGE_SIDE) -> DataFrame:
    """Montage: one strip per epoch with cells ordered by idx, strips stacked by epoch.

    ``cells`` has run_id, epoch, idx, height, width, levels (H, W, 3 bytes); hand in a
    written table, since its keys are read several times. Cells of
    a strip are resized to its largest height and width. Pages hold as many cells of the
    largest height and width as fit into ``side`` pixels each way (at least one, and no more
    than ``columns`` / ``rows`` where given); panels continue on further pages, so a page has
    a bounded size and no cell is left out.
    """
    largest = cells.agg(F.max("height"), F.max("width")).first()
    fits = [max(1, side // (size or 1)) for size in largest]
    rows, columns = min(rows or fits[0], fits[0]), min(columns or fits[1], fits[1])
    by = "run_id"
    keys = [by, "epoch", "idx"]
    # positions come from the narrow keys, so a run or epoch with very many cells is
    # numbered by many tasks and no pixel bytes are sorted
    ranked = order_rank(cells.select(*keys), keys, out="_pos")
    strips = ranked.groupBy(by, "epoch").agg(F.min("_pos").alias("_first"))
    numbered = order_rank(strips, [by, "epoch"], out="_strip")
    tops = numbered.groupBy(by).agg(F.min("_strip").alias("_top"))
    places = (
        ranked.join(numbered, [by, "epoch"])
        .join(tops, by)
        .select(
            *keys,
            (F.col("_pos") - F.col("_first")).alias("_col"),
            (F.col("_strip") - F.col("_top")).alias("_row"),
        )
        .withColumn("page_x", F.floor(F.col("_col") / columns).cast("int"))
        .withColumn("page_y", F.floor(F.col("_row") / rows).cast("int"))
    )
    strip = (
        cells.join(places, keys)
        .groupBy(by, "page_x", "page_y", "_row")
        .applyInPandas(_strip, f"{by} string, page_x int, page_y int, _row long, height int, width int, levels binary")
    )
    return strip.groupBy(by, "page_x", "page_y").applyInPandas(
        _stack, f"{by} string, page_x int, page_y int, height int, width int, image binary"
    )


def _strip(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    high, wide = int(pdf["height"].max()), int(pdf["width"].max())
    cells = [_resized(_pixels(r), high, wide) for r in pdf.sort_values("_col").itertuples()]
    strip = np.concatenate(cells, axis=1)
    return pd.DataFrame(
        [(*key, strip.shape[0], strip.shape[1], strip.tobytes())],
        columns=["run_id", "page_x", "page_y", "_row", "height", "width", "levels"],
    )


def _stack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    wide = int(pdf["width"].max())
    # shorter strips are padded with black on the right
    strips = [np.pad(_pixels(r), ((0, 0), (0, wide - r.width), (0, 0))) for r in pdf.sort_values("_row").itertuples()]
    page = np.concatenate(strips, axis=0)
    return pd.DataFrame(
        [(*key, page.shape[0], page.shape[1], png_bytes(page))],
        columns=["run_id", "page_x", "page_y", "height", "width", "image"],
    )


def _pixels(row) -> np.ndarray:
    return np.frombuffer(row.levels, dtype=np.uint8).reshape(row.height, row.width, 3)


def _resized(img: np.ndarray, high: int, wide: int) -> np.ndarray:
    if img.shape[:2] == (high, wide):
        return img
    planes = img.transpose(2, 0, 1).astype(np.float64)
    out = triangle_weights(img.shape[0], high) @ planes @ triangle_weights(img.shape[1], wide).T
    return np.floor(out.transpose(1, 2, 0) + 0.5).astype(np.uint8)


def pack_levels(levels: Column, height: int, width: int) -> Column:
    """Channel-major 0..255 levels -> interleaved (H, W, 3) bytes."""
    return _interleave(levels, F.lit(height * width))


@F.pandas_udf(T.BinaryType())
def _interleave(levels: pd.Series, plane: pd.Series) -> pd.Series:
    return pd.Series(
        [np.asarray(v, dtype=np.uint8).reshape(3, n).T.tobytes() for v, n in zip(levels, plane, strict=True)]
    )


def png_bytes(img: np.ndarray) -> bytes:
    """Encode (H, W, 3) levels as an 8-bit RGB PNG."""
    data = np.ascontiguousarray(img, dtype=np.uint8)
    h, w = data.shape[:2]
    # one filter byte (0: none) ahead of every row
    raw = np.concatenate([np.zeros((h, 1), np.uint8), data.reshape(h, w * 3)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
