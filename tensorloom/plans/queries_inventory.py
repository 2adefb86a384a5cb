"""Inventory and image queries (A rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.arrays import bind
from tensorloom.functions.ranking import order_rank
from tensorloom.operators import panel
from tensorloom.plans.catalog import h32, query, table, unnest_sql, written
from tensorloom.session import scratch_path, stored
from tensorloom.sources import images, inventory
from tensorloom.streaming.ingest import incremental_ingest


def corpus(spark: SparkSession, sf: str) -> str:
    """The documents as a tree of text files, one directory per source."""

    def write(path: str) -> None:
        table(spark, sf, "documents").select("source", "text").write.partitionBy("source").text(path)

    return written(spark, sf, "corpus", write)


def image_rows(spark: SparkSession, sf: str, height: int = 8, width: int = 8) -> DataFrame:
    """Every embedding as an image-source struct: red from the vector, green its
    complement, blue the reversed vector; bytes interleaved B, G, R."""
    levels = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1.0) * 127.5).cast("int"))
    n = height * width

    def interleaved(lv: Column) -> Column:
        return F.transform(lv, lambda red, i: F.array(F.get(lv, F.lit(n - 1) - i), F.lit(255) - red, red))

    raw = F.flatten(bind(levels, interleaved))
    data = F.unhex(F.array_join(F.transform(raw, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    return (
        table(spark, sf, "embeddings")
        .select(
            "vec_id",
            "label",
            F.struct(
                F.format_string("emb/%d.png", "vec_id").alias("origin"),
                F.lit(height).alias("height"),
                F.lit(width).alias("width"),
                F.lit(3).alias("nChannels"),
                F.lit(16).alias("mode"),
                data.alias("data"),
            ).alias("image"),
        )
    )


FOLDER_SQL = """SELECT 'source=' || source AS parent, sum(strlen(text) + 1)::BIGINT AS n_bytes
FROM documents GROUP BY source"""


@query("a1_scan_items", FOLDER_SQL)
def a1_scan_items(spark: SparkSession, sf: str) -> DataFrame:
    items = inventory.scan_items(spark, corpus(spark, sf), ["**/*.txt", "**/*.jpg"])
    return items.groupBy("parent").agg(F.sum("length").alias("n_bytes"))


NAMED_SQL = """CASE doc_id % 5 WHEN 0 THEN 'tree/' WHEN 1 THEN '_kept/' WHEN 2 THEN '.dot/' WHEN 3 THEN 'plain/tree/'
  ELSE 'plain/' END || CASE doc_id % 3 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END || 'doc_' || doc_id || '.txt'"""


def named_tree(spark: SparkSession, sf: str) -> str:
    """The documents as files below a folder ``tree``: one inside bears its name, and many names start with ``_`` or ``.``."""
    folder = F.element_at(F.array(*map(F.lit, ("tree/", "_kept/", ".dot/", "plain/tree/", "plain/"))), (F.col("doc_id") % 5 + 1).cast("int"))
    mark = F.element_at(F.array(*map(F.lit, ("_", ".", ""))), (F.col("doc_id") % 3 + 1).cast("int"))
    below = F.concat(folder, mark, F.format_string("doc_%d.txt", "doc_id"))

    def write(path: str) -> None:
        files = table(spark, sf, "documents").select(below.alias("below"), F.encode("text", "utf-8").alias("content"))
        inventory.write_files(files, f"{path}/tree")

    return written(spark, sf, "named", write) + "/tree"


@query(
    "a1_scan_names",
    f"""WITH f AS (SELECT {NAMED_SQL} AS below, strlen(text)::BIGINT AS n FROM documents)
SELECT 'all' AS pattern, regexp_extract(below, '([^/]+)/[^/]+$', 1) AS parent, count(*)::BIGINT AS n_files, sum(n)::BIGINT AS n_bytes
FROM f GROUP BY 2
UNION ALL SELECT 'tree', 'tree', count(*)::BIGINT, sum(n)::BIGINT FROM f WHERE regexp_matches(below, '(^|/)tree/[^/]+$')
UNION ALL SELECT 'hidden', regexp_extract(below, '([^/]+)/[^/]+$', 1), count(*)::BIGINT, sum(n)::BIGINT FROM f
  WHERE regexp_matches(below, '/_[^/]+$') GROUP BY 2""",
)
def a1_scan_names(spark: SparkSession, sf: str) -> DataFrame:
    """No file is lost for its name, and a pattern sees only what is below the root."""
    root = named_tree(spark, sf)
    out = None
    for name, pattern in (("all", "**/*.txt"), ("tree", "tree/*.txt"), ("hidden", "**/_*.txt")):
        rows = inventory.scan_items(spark, root, pattern).groupBy("parent")
        rows = rows.agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes")).withColumn("pattern", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "a2_inventory_signature",
    """SELECT page_id, substr(sha256(concat_ws(':::', url, '**/*.jpg')), 1, 16) AS sig FROM pages""",
)
def a2_inventory_signature(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", inventory.signature(F.col("url"), F.lit("**/*.jpg")).alias("sig")
    )


@query("a2_inventory_snapshot", FOLDER_SQL)
def a2_inventory_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    store = written(spark, sf, "snapshots", lambda path: None)
    listed = inventory.inventory_snapshot(spark, store, corpus(spark, sf), "**/*.txt")
    return listed.groupBy("parent").agg(F.sum("length").alias("n_bytes"))


@query(
    "a3_load_images",
    """WITH lv AS (SELECT vec_id, unnest(range(len(embedding))) AS i,
  floor((unnest(embedding)::DOUBLE + 1.0) * 127.5)::BIGINT AS r FROM embeddings)
SELECT vec_id, sum(r)::BIGINT AS sum_r, sum(255 - r)::BIGINT AS sum_g, sum(r)::BIGINT AS sum_b,
  max(CASE WHEN i = 0 THEN r END)::BIGINT AS first_r, max(CASE WHEN i = 63 THEN r END)::BIGINT AS first_b
FROM lv GROUP BY vec_id""",
)
def a3_load_images(spark: SparkSession, sf: str) -> DataFrame:
    return plane_sums(images.load_images(image_rows(spark, sf)))


def plane_sums(pixels: DataFrame, *keep: str) -> DataFrame:
    def level(v: Column) -> Column:
        return F.round(v.cast("double") * 255.0).cast("long")

    def plane(c: int) -> Column:
        return F.aggregate(F.slice("pixels", c * 64 + 1, 64), F.lit(0).cast("long"), lambda a, v: a + level(v))

    return pixels.select(
        "vec_id",
        plane(0).alias("sum_r"),
        plane(1).alias("sum_g"),
        plane(2).alias("sum_b"),
        level(F.get("pixels", F.lit(0))).alias("first_r"),
        level(F.get("pixels", F.lit(128))).alias("first_b"),
        *keep,
    )


@query(
    "a4_resize_center_crop",
    """WITH lv AS (SELECT vec_id, unnest(range(len(embedding))) AS i,
  floor((unnest(embedding)::DOUBLE + 1.0) * 127.5) / 255.0::DOUBLE AS v FROM embeddings),
ty AS (SELECT o, i, greatest(0, 1 - abs(i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * 4 / 3) / (4.0::DOUBLE / 3)) AS w
  FROM range(3) a(o), range(4) b(i)),
tx AS (SELECT o, i, greatest(0, 1 - abs(i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * 16 / 12) / (16.0::DOUBLE / 12)) AS w
  FROM range(12) a(o), range(16) b(i)),
wy AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM ty),
wx AS (SELECT o - 4 AS o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM tx),
px AS (SELECT vec_id, wy.o AS y, wx.o AS x, sum(v * wy.w * wx.w) AS v FROM lv
  JOIN wy ON wy.i = lv.i // 16 JOIN wx ON wx.i = lv.i % 16
  WHERE wy.w > 0 AND wx.w > 0 AND wx.o BETWEEN 0 AND 2 GROUP BY vec_id, wy.o, wx.o)
SELECT vec_id, 3::INTEGER AS height, 3::INTEGER AS width, round(sum(v), 3) AS sum_r,
  round(max(CASE WHEN y = 0 AND x = 0 THEN v END), 3) AS first_r FROM px GROUP BY vec_id""",
)
def a4_resize_center_crop(spark: SparkSession, sf: str) -> DataFrame:
    pixels = images.resize_center_crop(images.load_images(image_rows(spark, sf, 4, 16)), 3)
    red = F.aggregate(F.slice("pixels", 1, 9), F.lit(0.0), lambda a, v: a + v.cast("double"))
    return pixels.select(
        "vec_id",
        "height",
        "width",
        F.round(red, 3).alias("sum_r"),
        F.round(F.get("pixels", F.lit(0)).cast("double"), 3).alias("first_r"),
    )


@query(
    "a3_read_files",
    """WITH lv AS (SELECT vec_id, unnest(range(len(embedding))) AS i,
  floor((unnest(embedding)::DOUBLE + 1.0) * 127.5)::BIGINT AS r FROM embeddings)
SELECT vec_id, sum(r)::BIGINT AS sum_r, sum(255 - r)::BIGINT AS sum_g, sum(r)::BIGINT AS sum_b,
  max(CASE WHEN i = 0 THEN r END)::BIGINT AS first_r, max(CASE WHEN i = 63 THEN r END)::BIGINT AS first_b,
  NULL::VARCHAR AS reason FROM lv WHERE vec_id % 20 <> 3 GROUP BY vec_id
UNION ALL SELECT vec_id, NULL, NULL, NULL, NULL, NULL, 'undecodable' FROM embeddings WHERE vec_id % 20 = 3""",
)
def a3_read_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures written as PNG files and decoded from them, whatever their names; broken files are told, not lost."""
    broken, hidden = F.col("vec_id") % 20 == 3, F.col("vec_id") % 20 == 13

    def write(path: str) -> None:
        rows = image_rows(spark, sf)
        png = panel.encode_pngs(rows.select("vec_id", "image.height", "image.width", "image.data"))
        name = F.concat(F.when(hidden, "_").otherwise(""), F.format_string("%d.png", "vec_id"))
        content = F.when(broken, F.encode(F.lit("no image"), "utf-8")).otherwise(F.col("png"))
        inventory.write_files(png.select(name.alias("below"), content.alias("content")), path)

    root = written(spark, sf, "pictures", write)
    key = lambda path: F.regexp_extract(path, r"_?(\d+)\.png$", 1).cast("long").alias("vec_id")
    items = stored(inventory.scan_items(spark, root, "**/*.png").select(key("path"), "path"), "pictures")
    pictures = images.read_listed_images(spark, items, root).select(key("image.origin"), F.struct("image.height").alias("found"), "image")
    # the files are opened in one pass: sums and rejects both come from the narrow rows it leaves
    shown = stored(plane_sums(images.load_images(pictures), "found"), "pictures-shown")
    refused = images.rejected_images(items, shown, "vec_id", "found").select("vec_id", "reason")
    return shown.where("found.height > 0").drop("found").unionByName(refused, allowMissingColumns=True)


# a grey JPEG of one 8x8 block, in hex: quantiser 8 throughout, so that the block's one coefficient is its
# level less 128; Huffman codes of four bits for the coefficient's size, of one bit for the end of the block
JPEG_HEAD = (
    "FFD8 FFDB0043 00" + "08" * 64 + "FFC0000B 08 0008 0008 01 011100"
    "FFC4001F 00 000000" + "0C" + "00" * 12 + "".join(f"{k:02X}" for k in range(12))
    + "FFC40014 10 01" + "00" * 15 + "00" + "FFDA0008 01 0100 003F00"
).replace(" ", "")


def grey_jpeg(level: Column) -> Column:
    """The file of an 8x8 picture of one grey level, as binary."""
    value = level.cast("int") - 128
    size = F.when(value == 0, 0).otherwise(F.length(F.bin(F.abs(value))))
    bits = F.when(value >= 0, value).otherwise(value + F.pow(F.lit(2), size).cast("int") - 1)
    coded = F.concat(F.lpad(F.bin(size), 4, "0"), F.when(size > 0, F.lpad(F.bin(bits), size, "0")).otherwise(""), F.lit("0"))
    n = F.ceil(F.length(coded) / 8).cast("int")
    return F.unhex(F.concat(F.lit(JPEG_HEAD), F.lpad(F.conv(F.rpad(coded, n * 8, "1"), 2, 16), n * 2, "0"), F.lit("FFD9")))


@query(
    "a3_read_jpeg",
    """SELECT vec_id, 8::INTEGER AS height, 8::INTEGER AS width, 64 * 3 * floor((embedding[1]::DOUBLE + 1.0) * 127.5)::BIGINT AS level_sum FROM embeddings""",
)
def a3_read_jpeg(spark: SparkSession, sf: str) -> DataFrame:
    """One-coloured JPEG files, a fifth of them with names that file sources hide."""

    def write(path: str) -> None:
        level = F.floor((F.get("embedding", F.lit(0)).cast("double") + 1.0) * 127.5)
        mark = F.element_at(F.array(*map(F.lit, ("", "_", ".", "_d/", "d/"))), (F.col("vec_id") % 5 + 1).cast("int"))
        name = F.concat(mark, F.format_string("v%d.jpg", "vec_id"))
        rows = table(spark, sf, "embeddings").select(name.alias("below"), grey_jpeg(level).alias("content"))
        inventory.write_files(rows, path)

    root = written(spark, sf, "jpegs", write)
    items = stored(inventory.scan_items(spark, root, "**/*.jpg").select("path"), "jpegs-listed")
    key = F.regexp_extract("path", r"v(\d+)\.jpg$", 1).cast("long")
    pixels = images.load_images(images.read_listed_images(spark, items, root))
    levels = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + F.round(v.cast("double") * 255.0).cast("long"))
    return pixels.select(key.alias("vec_id"), "height", "width", levels.alias("level_sum"))


COIN_SQL = "({h} + 0.5::DOUBLE) / 4294967296.0::DOUBLE < 0.5"


@query(
    "a5_random_flip",
    f"""WITH c AS (SELECT vec_id, embedding,
  {COIN_SQL.format(h=h32("'42'", "'3'", "vec_id", "'h'"))} AS flip_h,
  {COIN_SQL.format(h=h32("'42'", "'3'", "vec_id", "'v'"))} AS flip_v FROM embeddings)
SELECT vec_id, flip_h, flip_v,
  floor((embedding[1 + (CASE WHEN flip_v THEN 56 ELSE 0 END) + (CASE WHEN flip_h THEN 7 ELSE 0 END)]::DOUBLE + 1.0) * 127.5)::BIGINT AS corner
FROM c""",
)
def a5_random_flip(spark: SparkSession, sf: str) -> DataFrame:
    flipped = images.random_flip(images.load_images(image_rows(spark, sf)), "vec_id", seed=42, epoch=3)
    corner = F.round(F.get("pixels", F.lit(0)).cast("double") * 255.0).cast("long")
    return flipped.select("vec_id", "flip_h", "flip_v", corner.alias("corner"))


MEAN, STD = [0.485, 0.456, 0.406, 0.5], [0.229, 0.224, 0.225, 0.25]


@query(
    "a6_normalize_channels",
    f"""WITH e AS ({unnest_sql("embeddings", "vec_id", "embedding")}),
p AS (SELECT * FROM (VALUES (0, 0.485::DOUBLE, 0.229::DOUBLE), (1, 0.456::DOUBLE, 0.224::DOUBLE),
  (2, 0.406::DOUBLE, 0.225::DOUBLE), (3, 0.5::DOUBLE, 0.25::DOUBLE)) t(c, m, s))
SELECT vec_id, i::INTEGER AS i, round((v - m) / s, 6) AS normed, round(v * 2 - 1, 6) AS signed
FROM e JOIN p ON p.c = e.i // 16""",
)
def a6_normalize_channels(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    both = e.select(
        "vec_id",
        F.posexplode(
            F.arrays_zip(
                images.normalize_channels(F.col("embedding"), MEAN, STD).alias("n"),
                images.to_signed(F.col("embedding")).alias("s"),
            )
        ).alias("i", "z"),
    )
    return both.select("vec_id", "i", F.round("z.n", 6).alias("normed"), F.round("z.s", 6).alias("signed"))


@query(
    "a7_get_batch",
    """WITH l AS (SELECT *, row_number() OVER (ORDER BY toxic, quality, doc_id) - 1 AS r FROM labels),
w AS (SELECT 2 * r AS list_pos, doc_id FROM l UNION ALL SELECT 2 * r + 1, doc_id FROM l WHERE quality = 1)
SELECT list_pos::BIGINT AS list_pos, w.doc_id, d.source, d.n_chars FROM w JOIN documents d ON d.doc_id = w.doc_id""",
)
def a7_get_batch(spark: SparkSession, sf: str) -> DataFrame:
    ranked = order_rank(table(spark, sf, "labels"), ["toxic", "quality", "doc_id"], out="r")
    # good documents are listed twice: duplicates must survive
    copies = F.when(F.col("quality") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    wanted = ranked.withColumn("copy", F.explode(copies)).select(
        (F.col("r") * 2 + F.col("copy")).alias("list_pos"), F.col("doc_id").alias("idx")
    )
    items = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return images.get_batch(items, "doc_id", wanted).select("list_pos", "doc_id", "source", "n_chars")


@query("a8_incremental_ingest", FOLDER_SQL)
def a8_incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files, taken in by a stream that runs twice."""
    sink = scratch_path(spark, "ingest")
    for _ in range(2):  # the second call finds nothing new
        incremental_ingest(spark, corpus(spark, sf), f"{sink}/items", f"{sink}/checkpoint", "*.txt")
    return spark.read.parquet(f"{sink}/items").groupBy("parent").agg(F.sum("length").alias("n_bytes"))


@query(
    "a9_json_round_trip",
    """SELECT source, lang, count(*)::BIGINT AS n_items, sum(n_chars)::BIGINT AS n_chars,
  min('doc_' || doc_id || '.txt') AS first_name FROM documents GROUP BY source, lang""",
)
def a9_json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    items = docs.select("source", "lang", "n_chars", F.format_string("doc_%d.txt", "doc_id").alias("file_name"))
    path = written(spark, sf, "items-json", lambda p: items.write.json(p))
    back = spark.read.schema("source string, lang string, n_chars bigint, file_name string").json(path)
    return back.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("n_chars").alias("n_chars"), F.min("file_name").alias("first_name")
    )
