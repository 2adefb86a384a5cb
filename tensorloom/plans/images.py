"""Image-mode preparation: split, decode, crop, flip the train side, batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.split import assign_batches, ratio_split
from tensorloom.sources.images import load_images, random_flip, resize_center_crop


def image_batches(
    images: DataFrame,
    key: str,
    *,
    size: int = 512,
    batch_size: int = 64,
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
    seed: int = 42,
    epoch: int = 0,
) -> DataFrame:
    """Rows with split, batch_id and pixels.

    Split and batch numbers are computed on the key alone and joined to the pixels
    last. Train batches drop a short tail; evaluation rows are never flipped.
    """
    ranked = ratio_split(images.select(key), key, ratios, seed, total="n")
    n = F.col("n")
    whole = float(sum(ratios))
    train_end = F.floor(n.cast("double") * F.lit(float(ratios[0])) / F.lit(whole)).cast("long")
    val_end = F.floor(n.cast("double") * F.lit(float(ratios[0] + ratios[1])) / F.lit(whole)).cast("long")
    starts = {"train": F.lit(0).cast("long"), "val": train_end, "test": F.greatest(train_end, val_end)}
    train = assign_batches(ranked.where("split = 'train'"), batch_size, True, train_end)
    rest = ranked.where("split <> 'train'").withColumn(
        "pos", F.col("pos") - F.when(F.col("split") == "val", starts["val"]).otherwise(starts["test"])
    )
    order = train.unionByName(assign_batches(rest, batch_size)).drop("n")
    pixels = resize_center_crop(load_images(images.join(order, key)), size)
    return random_flip(pixels, key, seed, epoch, train=F.col("split") == "train")
