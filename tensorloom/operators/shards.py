"""Shard arithmetic and metadata: assignment, index map, fingerprint, resume, audit."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.hashing import digest, word
from tensorloom.functions.ranking import order_rank, running_offsets

SHARD_SIZE = 1000
FINGERPRINT_HEX = 16  # fixed value: fingerprint length in hex digits
BLOCK = 1 << 12  # rows; a few shards of the usual size


def assign_shards(
    df: DataFrame, key: str | list[str], shard_size: int = SHARD_SIZE, total: str | None = None
) -> DataFrame:
    """global_idx, shard_id and offset by key order; the last shard may be short."""
    if shard_size < 1:
        raise ValueError("shard_size must be positive")
    ranked = df if "global_idx" in df.columns else order_rank(df, key, out="global_idx", total=total)
    size = F.lit(int(shard_size)).cast("long")
    offset = F.pmod(F.col("global_idx"), size)
    return ranked.withColumns(
        {"shard_id": ((F.col("global_idx") - offset) / size).cast("int"), "offset": offset}
    )


def shard_meta(store: DataFrame, shard_size: int | None = None, path: str = "path") -> DataFrame:
    """Rows and ordered paths per shard.

    A path list is as long as its shard. With ``shard_size``, a row with a larger offset
    fails the job before anything is collected. Use :func:`shard_sizes` where only the
    counts matter.
    """
    checked = F.col("offset")
    if shard_size is not None:
        checked = F.when(checked < shard_size, checked).otherwise(
            F.raise_error(F.lit(f"offset beyond shard_size {shard_size}")).cast("long")
        )
    return store.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n_images"),
        F.transform(
            F.array_sort(F.collect_list(F.struct(checked.alias("offset"), F.col(path).alias("path")))),
            lambda s: s["path"],
        ).alias("image_paths"),
    )


def shard_sizes(store: DataFrame) -> DataFrame:
    """Rows per shard (partial aggregation, one row per shard)."""
    return store.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_images"))


CONTENT = [f"word_{i}" for i in range(4)]  # sums of the four md5 words of a shard's item ids


def shard_contents(rows: DataFrame, item: str = "item_id") -> DataFrame:
    """Rows per shard and what they are: sums of the md5 words of (offset, item).

    Two shards with equal counts and sums hold the same items in the same places.
    """
    d = digest(F.col("offset"), F.col(item))
    return rows.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n_images"), *[F.sum(word(d, i)).cast("long").alias(c) for i, c in enumerate(CONTENT)]
    )


def shard_bases(meta: DataFrame) -> DataFrame:
    """meta with ``base``, the global index of each shard's first row."""
    return running_offsets(meta, "shard_id", "n_images", out="base")


def index_map(meta: DataFrame) -> DataFrame:
    """(global_idx, shard_id, offset) for every row, from shard counts alone.

    Expanded in two steps (blocks, then rows), so no single row carries a list as
    long as its shard.
    """
    span = F.lit(BLOCK).cast("long")
    blocks = (
        shard_bases(meta.select("shard_id", "n_images"))
        .where("n_images > 0")
        .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_images") - 1) / span))))
    )
    first = F.col("_b") * span
    last = F.least(first + span, F.col("n_images")) - 1
    return (
        blocks.repartition("shard_id", "_b")
        .withColumn("offset", F.explode(F.sequence(first, last)))
        .select((F.col("base") + F.col("offset")).alias("global_idx"), "shard_id", "offset")
    )


def global_index(rows: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Add global_idx to rows that know their (shard_id, offset)."""
    bases = shard_bases(meta if meta is not None else shard_sizes(rows)).select("shard_id", "base")
    return rows.join(bases, "shard_id").withColumn("global_idx", F.col("base") + F.col("offset")).drop("base")


def locate(meta: DataFrame, indices: DataFrame, block: int = BLOCK) -> DataFrame:
    """Find (shard_id, offset) of wanted global indices (column ``idx``).

    A range join made equi: each shard is listed under the index blocks it
    overlaps, each wanted index under its own block.
    """
    size = F.lit(int(block)).cast("long")

    def block_of(c: Column) -> Column:
        return F.floor(c / size).cast("long")

    bases = shard_bases(meta.select("shard_id", "n_images")).where("n_images > 0")
    ranges = bases.withColumn(
        "_b", F.explode(F.sequence(block_of(F.col("base")), block_of(F.col("base") + F.col("n_images") - 1)))
    )
    return (
        indices.withColumn("_b", block_of(F.col("idx")))
        .join(ranges, "_b")
        .where((F.col("idx") >= F.col("base")) & (F.col("idx") < F.col("base") + F.col("n_images")))
        .withColumn("offset", F.col("idx") - F.col("base"))
        .drop("_b", "base", "n_images")
    )


def dataset_fingerprint(items: DataFrame, file_name: str = "file_name", parent: str = "parent") -> DataFrame:
    """One-row identity of a corpus, independent of row order.

    Row count and sums of the four md5 words of each entry; merges like any sum, so it
    works at any size.
    """
    d = digest(F.col(parent), F.col(file_name))
    return items.agg(
        F.count(F.lit(1)).alias("n_items"),
        *[F.coalesce(F.sum(word(d, i)), F.lit(0)).cast("long").alias(f"word_{i}") for i in range(4)],
    ).withColumn(
        "fingerprint",
        F.substring(F.sha2(F.concat_ws(":", "n_items", "word_0", "word_1", "word_2", "word_3"), 256), 1, FINGERPRINT_HEX),
    )


def model_diff(recorded: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare two (model, version) tables; only differing models remain."""
    left = recorded.select("model", F.col("version").alias("recorded"))
    right = expected.select("model", F.col("version").alias("expected"))
    return left.join(right, "model", "full_outer").where(~F.col("recorded").eqNullSafe(F.col("expected")))


def resume_plan(planned: DataFrame, committed: DataFrame) -> DataFrame:
    """Planned shards without a committed copy of the same content.

    Content is the row count and, where both sides have them (:func:`shard_contents`),
    the item sums: a shard of the right length that holds other items is planned again.
    """
    told = [c for c in CONTENT if c in planned.columns and c in committed.columns]
    left = planned.select("shard_id", "n_images", *told)
    right = committed.select("shard_id", "n_images", *told)
    return left.join(right, ["shard_id", "n_images", *told], "left_anti").select("shard_id", "n_images")


def estimate_store(
    n_rows: Column | int, tensor_shapes: list[tuple[int, ...]], shard_size: int = SHARD_SIZE, bytes_per_value: int = 2
) -> tuple[Column, Column]:
    """(shard count, stored bytes) over every tensor kept per row."""
    n = n_rows if isinstance(n_rows, Column) else F.lit(int(n_rows)).cast("long")
    row_bytes = sum(prod(s) for s in tensor_shapes) * bytes_per_value
    shards = F.ceil(n / F.lit(shard_size)).cast("long")
    return shards, (n * F.lit(row_bytes)).cast("long")


def shard_audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected shards that are missing or short, with both counts."""
    left = expected.select("shard_id", F.col("n_images").alias("expected_rows"))
    right = found.select("shard_id", F.col("n_images").alias("found_rows"))
    joined = left.join(right, "shard_id", "left").withColumn("found_rows", F.coalesce("found_rows", F.lit(0).cast("long")))
    return joined.where(F.col("expected_rows") != F.col("found_rows"))


def default_logvar(df: DataFrame, logvar: str = "gt_logvar", mean: str = "gt_mean") -> DataFrame:
    """Rows written before log-variances existed get zeros (unit variance)."""
    zeros = F.transform(F.col(mean), lambda _: F.lit(0.0).cast("float"))
    if logvar not in df.columns:
        return df.withColumn(logvar, zeros)
    return df.withColumn(logvar, F.coalesce(F.col(logvar), zeros))


def store_info(store: DataFrame) -> DataFrame:
    """One row: samples, shards, shard size range, tensor lengths.

    Takes any store: tensors as float arrays or packed, log-variances or none.
    """
    kinds = dict(store.dtypes)

    def values(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("int")
        packed = (F.octet_length(name) / F.lit(2)).cast("int")  # two bytes a value
        return packed if kinds[name] == "binary" else F.when(F.col(name).isNotNull(), F.size(name))

    per_shard = store.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(values("tokens")).alias("token_values"),
        F.max(values("gt_mean")).alias("latent_values"),
        (F.count("gt_logvar") if "gt_logvar" in kinds else F.lit(0).cast("long")).alias("n_logvar"),
    )
    return per_shard.agg(
        F.sum("n").alias("total_samples"),
        F.count(F.lit(1)).alias("shard_count"),
        F.max("n").alias("largest_shard"),
        F.min("n").alias("smallest_shard"),
        F.max("token_values").alias("token_values"),
        F.max("latent_values").alias("latent_values"),
        F.sum("n_logvar").alias("with_logvar"),
    )
