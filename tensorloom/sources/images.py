"""Images as float arrays: decode, resize, crop, flip, normalise, batch.

Pixels live in ``pixels array<float>`` laid out channel-major (C, H, W), RGB, with
``height`` and ``width`` next to it. Geometry runs in numpy over Arrow batches;
everything that is plain arithmetic or a decision is a Catalyst expression.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.functions.hashing import coin
from tensorloom.session import index_rows, scratch_path, stored, task_slots
from tensorloom.sources.inventory import open_root, qualified

PIXEL_FIELDS = [
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("pixels", T.ArrayType(T.FloatType())),
]


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JPEG/PNG files through the JVM decoder; an undecodable file keeps its row, with height -1.

    The image source passes over names that start with ``_`` or ``.``: :func:`read_listed_images`
    reads them too, and :func:`rejected_images` finds both kinds.
    """
    return (
        spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(paths)
    )


#: fixed rule: what Spark's file sources pass over, as folder or file name
HIDDEN = r"(^|/)(\.|_[^/=]*(/|$))|\._COPYING_$"


def read_listed_images(spark: SparkSession, items: DataFrame, root: str, path: str = "path") -> DataFrame:
    """As :func:`read_images`, for all listed files below ``root``: those the image source passes over too.

    Files with such a name, or in a folder with one, are copied in tasks to plain names in the
    shared scratch folder, chunk by chunk, and read from there; ``image.origin`` is the listed
    path. All others are read in place.
    """
    base = qualified(spark, root).rstrip("/")
    below = F.expr(f"substring(`{path}`, {len(base) + 2})")
    hidden = items.select(F.col(path).alias("path")).where(below.rlike(HIDDEN)).distinct()
    name = F.concat(*[F.lower(F.hex(F.xxhash64(F.lit(s), "path"))) for s in (1, 2)])
    shared = scratch_path(spark, "images")
    staged = stored(_copied(hidden.withColumn("name", name), qualified(spark, shared)), "images-staged")
    plain = read_images(spark, root)
    if staged.isEmpty():
        return plain
    own = F.regexp_extract("image.origin", r"([^/]+)$", 1)
    copies = read_images(spark, shared).withColumn("name", own).join(staged.select("name", "path"), "name")
    return plain.unionByName(copies.select(F.col("image").withField("origin", F.col("path")).alias("image")))


def _copied(files: DataFrame, target: str) -> DataFrame:
    """Copies each file to its ``name`` below ``target``; a copy appears when complete."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_root(target)
        system.create_dir(top, recursive=True)
        for batch in batches:
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, place = open_root(path)
                own = f"{top}/.{name}-{uuid.uuid4().hex}"
                with source.open_input_stream(place, compression=None) as raw, system.open_output_stream(own, compression=None) as out:
                    while chunk := raw.read(1 << 20):
                        out.write(chunk)
                system.move(own, f"{top}/{name}")
            yield batch

    spread = files.select("path", "name").repartition(task_slots(files.sparkSession), "name")
    return spread.mapInArrow(copy, "path string, name string")


def rejected_images(items: DataFrame, pictures: DataFrame, key: str = "item_id", image: str = "image") -> DataFrame:
    """(key, path, reason) of items without pixels: ``undecodable`` or ``not_read``."""
    seen = pictures.select(key, (F.col(f"{image}.height") > 0).alias("_readable"))
    joined = items.select(key, "path").join(seen, key, "left")
    reason = F.when(F.col("_readable").isNull(), "not_read").when(~F.col("_readable"), "undecodable")
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(key, "path", "reason")


def load_images(df: DataFrame, image: str = "image") -> DataFrame:
    """Decode an image-source struct (BGR bytes) into RGB floats in [0, 1].

    Rows without a decoded image get null height, width and pixels.
    """
    keep = [c for c in df.columns if c != image]
    flat = df.select(
        *keep,
        *([F.col(f"{image}.origin").alias("path")] if "path" not in keep else []),
        F.col(f"{image}.height").alias("height"),
        F.col(f"{image}.width").alias("width"),
        F.col(f"{image}.nChannels").alias("_channels"),
        F.col(f"{image}.data").alias("_data"),
    )

    def decode(block: np.ndarray, _: dict) -> np.ndarray:
        # grey -> three equal planes; BGR(A) -> RGB
        rgb = np.repeat(block, 3, axis=3) if block.shape[3] == 1 else block[..., 2::-1]
        return (rgb.astype(np.float32) / np.float32(255.0)).transpose(0, 3, 1, 2)

    return _map_blocks(flat, decode, drop=["_channels", "_data"])


def resize_center_crop(df: DataFrame, size: int) -> DataFrame:
    """Shorter side -> ``size`` (antialiased triangle filter), then centre crop."""

    def resample(block: np.ndarray, _: dict) -> np.ndarray:
        h, w = block.shape[2:]
        new_h, new_w = scaled_size(h, w, size)
        img = triangle_weights(h, new_h) @ block.astype(np.float64) @ triangle_weights(w, new_w).T
        top, left = round((new_h - size) / 2), round((new_w - size) / 2)
        return img[:, :, top : top + size, left : left + size].astype(np.float32)

    return _map_blocks(df, resample)


def scaled_size(height: int, width: int, size: int) -> tuple[int, int]:
    """Output size with the shorter side at ``size`` and the aspect ratio kept."""
    if height <= width:
        return size, int(size * width / height)
    return int(size * height / width), size


@lru_cache(maxsize=256)
def triangle_weights(n_in: int, n_out: int) -> np.ndarray:
    """Row-stochastic [n_out, n_in] resampling matrix.

    Linear interpolation at half-pixel centres; when shrinking, the triangle is
    widened by the ratio so every input pixel contributes (antialiasing).
    """
    ratio = n_in / n_out
    support = max(ratio, 1.0)
    centre = (np.arange(n_out) + 0.5) * ratio
    distance = np.abs((np.arange(n_in) + 0.5)[None, :] - centre[:, None]) / support
    weight = np.clip(1.0 - distance, 0.0, None)
    return weight / weight.sum(axis=1, keepdims=True)


def flip_coins(df: DataFrame, key: str, seed: int, epoch: int, p_h: float = 0.5, p_v: float = 0.5) -> DataFrame:
    """Add flip_h / flip_v, repeatable per (seed, epoch, item, axis)."""
    item = F.col(key)
    return df.withColumns(
        {"flip_h": coin(p_h, seed, epoch, item, "h"), "flip_v": coin(p_v, seed, epoch, item, "v")}
    )


def random_flip(
    df: DataFrame, key: str, seed: int, epoch: int, p_h: float = 0.5, p_v: float = 0.5, train: Column | None = None
) -> DataFrame:
    """Flip pixels by :func:`flip_coins`; rows outside ``train`` are never flipped."""
    marked = flip_coins(df, key, seed, epoch, p_h, p_v)
    if train is not None:
        marked = marked.withColumns({c: F.col(c) & train for c in ("flip_h", "flip_v")})

    def flip(block: np.ndarray, flags: dict) -> np.ndarray:
        out = block.copy()
        for name, axis in (("flip_h", 3), ("flip_v", 2)):
            rows = np.flatnonzero(flags[name])
            out[rows] = np.flip(out[rows], axis)
        return out

    return _map_blocks(marked, flip, flags=("flip_h", "flip_v"))


def normalize_channels(pixels: Column, mean: list[float], std: list[float]) -> Column:
    """``(x - mean[c]) / std[c]`` on a channel-major array."""
    plane = F.size(pixels) / F.lit(len(mean))
    means = F.array(*[F.lit(float(m)) for m in mean])
    stds = F.array(*[F.lit(float(s)) for s in std])

    def scale(v: Column, i: Column) -> Column:
        c = F.floor(i / plane).cast("int")
        return (v.cast("double") - F.get(means, c)) / F.get(stds, c)

    return F.transform(pixels, scale)


def to_signed(pixels: Column) -> Column:
    """[0, 1] -> [-1, 1]."""
    return F.transform(pixels, lambda v: v.cast("double") * 2 - 1)


def get_batch(items: DataFrame, index_col: str, indices: list[int] | DataFrame) -> DataFrame:
    """Rows for an index list; duplicates kept, ``list_pos`` gives the order.

    ``indices`` is a Python list (already on the driver; broadcast while short) or a
    DataFrame ``(list_pos long, idx long)`` of any size (join left to the planner).
    """
    if isinstance(indices, DataFrame):
        wanted = indices.select("list_pos", "idx")
    else:
        wanted = index_rows(items.sparkSession, indices, "list_pos", "idx")
    return wanted.join(items, wanted["idx"] == items[index_col]).drop("idx")


def _map_blocks(df: DataFrame, fn, flags: tuple = (), drop: tuple | list = ()) -> DataFrame:
    """Replace (height, width, pixels) block by block inside Arrow batches.

    Rows of one size form a block [B, C, H, W] (decoding: bytes [B, H, W, C]); ``fn`` gets it
    with the ``flags`` columns of its rows. Rows without pixels stay without.
    """
    keep = [f for f in df.schema.fields if f.name not in {"height", "width", "pixels", *drop}]
    schema = T.StructType(keep + PIXEL_FIELDS)
    names = [f.name for f in keep]
    raw = "_data" in df.columns

    def blocks(batch: pa.RecordBatch, shape: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for size in np.unique(shape[shape[:, 0] > 0], axis=0):
            rows = np.flatnonzero((shape == size).all(axis=1))
            h, w = size[:2]
            if raw:
                data = batch.column("_data")
                flat = b"".join(data[int(k)].as_buffer() for k in rows)
                yield rows, np.frombuffer(flat, np.uint8).reshape(len(rows), h, w, size[2])
            else:
                taken = batch.column("pixels").take(pa.array(rows)).flatten()
                yield rows, taken.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(rows), -1, h, w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = ["height", "width"] + (["_channels"] if raw else [])
            shape = np.stack([batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            if not raw:
                shape[batch.column("pixels").is_null().to_numpy(zero_copy_only=False)] = -1
            marks = {c: batch.column(c).fill_null(False).to_numpy(zero_copy_only=False) for c in flags}
            height, width = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, -1, np.int32)
            parts: list[np.ndarray] = [np.empty(0, np.float32)] * batch.num_rows
            for rows, block in blocks(batch, shape):
                out = fn(block, {c: v[rows] for c, v in marks.items()})
                height[rows], width[rows] = out.shape[2:]
                for k, flat in zip(rows, np.ascontiguousarray(out, np.float32).reshape(len(rows), -1), strict=True):
                    parts[k] = flat
            none = pa.array(height < 0)
            ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.empty(0, np.float32)
            arrays = [batch.column(n) for n in names] + [
                pa.array(height, pa.int32(), mask=height < 0),
                pa.array(width, pa.int32(), mask=height < 0),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=none),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names + ["height", "width", "pixels"])

    return df.mapInArrow(run, schema)
