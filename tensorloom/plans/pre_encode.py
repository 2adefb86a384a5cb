"""Encode a corpus once into a feature store, resumable shard by shard."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators.encode import BatchModel, encode_features
from tensorloom.operators.shards import SHARD_SIZE, assign_shards, estimate_store, resume_plan, shard_contents
from tensorloom.session import stored
from tensorloom.sources.images import rejected_images
from tensorloom.sources.inventory import path_exists
from tensorloom.sources.store import (
    SHARD_TABLE,
    counted_shards,
    drop_shards,
    place_rows,
    read_keys,
    save_manifest,
    validate_store,
    write_shards,
)


@dataclass
class EncodeReport:
    """What a run found, planned and did."""

    n_items: int
    shard_count: int
    estimated_bytes: int
    problems: list[str] = field(default_factory=list)
    pending_shards: int = 0
    written: bool = False
    incomplete_shards: int = 0  # still not as planned after writing
    rejected: int = 0  # items without a readable image, listed in the store's table of rejects


def pre_encode(
    spark: SparkSession,
    items: DataFrame,
    images: DataFrame,
    encoder: BatchModel,
    store: str,
    models: dict[str, str],
    *,
    tensor_shapes: list[tuple[int, ...]],
    shard_size: int = SHARD_SIZE,
    subset: tuple[int, int] | None = None,
    resume: bool = True,
    dry_run: bool = False,
    storage: str = "float",
    batch_size: int = 16,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> EncodeReport:
    """Run (or, with ``dry_run``, only check and plan) the encoding job.

    ``items`` needs item_id, path, file_name, parent. ``images`` has item_id and
    either pixels, or anything that ``prepare`` turns into pixels (an image-source
    struct through ``load_images`` and ``resize_center_crop``, say).

    Positions are those of the full corpus, so a ``subset`` (positions from, to) fills
    parts of the shards that a later full run completes; rows that a partly filled shard
    already holds are planned again with it. A shard counts as done when what is on disk
    has the planned row count and item sums. Rows without an image or with one that can't
    be decoded go to the table ``<store>_rejected`` (item_id, path, reason) and out of the
    plan. Existing shards of another corpus, model or storage are refused when resuming;
    without ``resume`` all are rewritten. Shards outside the plan are removed.

    Images join only for shards not done yet and reach their output file compact; decoding,
    encoding and writing then run in one task without moving a tensor. Shard table and
    manifest are written after the shards.
    """
    store = store.rstrip("/")
    manifest = f"{store}_manifest"
    narrow = items.select("item_id", "path", "file_name", "parent")
    refused = stored(rejected(narrow, images), "rejected")
    full = stored(assign_shards(narrow, ["path", "item_id"], shard_size), "encode-plan")
    readable = full.join(refused.select("item_id"), "item_id", "left_anti")
    found = stored(counted_shards(spark, store), "encode-found") if resume else spark.createDataFrame([], SHARD_TABLE)

    planned = readable
    if subset is not None:
        first, last = subset
        asked = (F.col("global_idx") >= first) & (F.col("global_idx") < last)
        held = read_keys(spark, store).select("item_id", "global_idx", F.lit(True).alias("_held")) if resume and path_exists(spark, store) else None
        if held is None:
            planned = readable.where(asked)
        else:
            touched = readable.where(asked).select("shard_id").distinct()
            planned = (
                readable.join(touched, "shard_id", "left_semi")
                .join(held.distinct(), ["item_id", "global_idx"], "left")
                .where(asked | F.col("_held"))
                .drop("_held")
            )
        planned = stored(planned, "encode-subset")
    contents = stored(shard_contents(planned), "encode-shards")
    pending = stored(resume_plan(contents, found), "encode-pending")

    wanted = narrow.count() if subset is None else full.where(asked).count()
    shards, size = estimate_store(F.lit(wanted), tensor_shapes, shard_size)
    total = spark.range(1).select(shards.alias("s"), size.alias("b")).first()
    todo_size = pending.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_images"), F.lit(0)).alias("rows")).first()
    problems = validate_store(spark, manifest, narrow, models)
    report = EncodeReport(wanted, total["s"], total["b"], problems, todo_size["n"], rejected=refused.count())
    if dry_run:
        return report
    if resume and [p for p in problems if p != "no_manifest"]:
        raise ValueError(f"store {store} does not match this corpus or these models: {problems}")
    refused.write.mode("overwrite").parquet(f"{store}_rejected")
    if path_exists(spark, store):
        drop_shards(spark, store, readable.select("shard_id").distinct() if resume else contents)

    if todo_size["n"]:
        todo = planned.join(pending.select("shard_id"), "shard_id", "left_semi")
        joined = todo.drop("file_name", "parent").join(images.drop("path"), "item_id")
        rows = place_rows(joined, n_rows=todo_size["rows"])
        pixels = prepare(rows) if prepare else rows
        encoded = encode_features(pixels, encoder, batch_size=batch_size).drop("height", "width")
        write_shards(encoded, store, storage=storage, placed=True, replacing=pending)
    save_manifest(spark, manifest, narrow, models, store=store, shard_size=shard_size)
    report.written = True
    report.incomplete_shards = resume_plan(contents, counted_shards(spark, store)).count()
    return report


def rejected(items: DataFrame, images: DataFrame) -> DataFrame:
    """(item_id, path, reason) of the items that have no usable row in ``images``."""
    if "image" in images.columns:
        return rejected_images(items, images)
    missing = items.select("item_id", "path").join(images.select("item_id"), "item_id", "left_anti")
    return missing.withColumn("reason", F.lit("not_read"))
