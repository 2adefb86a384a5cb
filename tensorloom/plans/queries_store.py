"""Feature-store queries (C rows)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.arrays import dot, total
from tensorloom.functions.half import to_half
from tensorloom.operators import latent, shards
from tensorloom.operators.encode import BatchModel, cut, encode_features
from tensorloom.plans.catalog import half_sql, query, table, unnest_sql, written
from tensorloom.plans.pre_encode import pre_encode
from tensorloom.plans.queries_inventory import image_rows
from tensorloom.session import stored
from tensorloom.sources import store as feature_store
from tensorloom.sources import versions
from tensorloom.sources.images import load_images

SHARD = 64
GRID, DIM = 4, 4  # a 64-value vector read as 16 tokens of 4 channels
HALF = half_sql("v")


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with their places in the store."""
    rows = table(spark, sf, "embeddings")
    return shards.assign_shards(rows.select("vec_id"), "vec_id", SHARD).join(rows, "vec_id")


def encoded(rows: DataFrame) -> DataFrame:
    """Indexed embeddings as an encoded corpus: 16 tokens, a 4x8x8 latent, and log-variances
    that are missing for the older labels 0-2."""
    # a step of its own: the log-variances take the latent as it is, not a second one
    up = latent.upsample2x(latent.tokens_to_grid(F.col("embedding"), DIM, GRID), DIM, GRID)
    return rows.withColumn("gt_mean", up).select(
        "global_idx",
        F.col("vec_id").alias("item_id"),
        F.format_string("emb/%d.png", "vec_id").alias("path"),
        "shard_id",
        "offset",
        "label",
        F.col("embedding").alias("tokens"),
        "gt_mean",
        F.when(F.col("label") >= 3, F.transform("gt_mean", lambda v: F.abs(v) - 1.0)).alias("gt_logvar"),
    )


def write_encoded(spark: SparkSession, sf: str, path: str, rows_per_file: int, **options) -> None:
    """A store of the encoded embeddings. Places are found once, and rows go to the task of their
    file as narrow as the table has them: tensors are made and written there."""
    rows = stored(indexed(spark, sf), "store-indexed")
    placed = feature_store.place_rows(rows, rows_per_file)
    feature_store.write_shards(
        encoded(placed), path, rows_per_file=rows_per_file, placed=True, replacing=rows.select("shard_id"), **options
    )


def store_path(spark: SparkSession, sf: str) -> str:
    return written(spark, sf, "store", lambda path: write_encoded(spark, sf, path, 32))


STORE = f"""st AS (SELECT vec_id AS item_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS g
  FROM embeddings),
tk AS (SELECT item_id, i, {HALF} AS v FROM ({unnest_sql("embeddings", "vec_id AS item_id", "embedding")})),
ts AS (SELECT item_id, sum(v) AS token_sum FROM tk GROUP BY item_id)"""


def formula_encoder() -> BatchModel:
    """An encoder whose weights SQL can state: two 4x4 patches per axis, 6 channels
    weighted by cos(pixel + 2 * channel), after one summary token."""

    def make_predict_fn():
        weights = np.cos(np.arange(48)[:, None] + 2.0 * np.arange(6)[None, :])

        def predict(pixels: np.ndarray) -> dict[str, np.ndarray]:
            tokens = cut(pixels.astype(np.float64), 4) @ weights
            tokens = np.concatenate([tokens.mean(axis=1, keepdims=True), tokens], axis=1)
            n = len(pixels)
            return {"tokens": tokens.reshape(n, -1), "gt_mean": pixels.reshape(n, -1)[:, :64] * 2 - 1}

        return predict

    return BatchModel(make_predict_fn, (3, 8, 8), ("tokens", "gt_mean"))


@query(
    "c1_encode_features",
    """WITH lv AS (SELECT vec_id, unnest(range(len(embedding))) AS i,
  floor((unnest(embedding)::DOUBLE + 1.0) * 127.5) AS r FROM embeddings),
px AS (SELECT vec_id, 0 AS c, i, r / 255 AS v FROM lv UNION ALL SELECT vec_id, 1, i, (255 - r) / 255 FROM lv
  UNION ALL SELECT vec_id, 2, 63 - i, r / 255 FROM lv),
t AS (SELECT vec_id, (i // 32) * 2 + (i % 8) // 4 AS n, k,
  sum(v * cos((c * 16 + (i // 8) % 4 * 4 + i % 4 + 2 * k)::DOUBLE)) AS v FROM px, range(6) r(k) GROUP BY vec_id, n, k)
SELECT vec_id, 24::INTEGER AS n_token_values, 64::INTEGER AS n_latent_values, round(sum(v), 2) AS token_sum,
  round(sum(v * v), 1) AS token_power FROM t GROUP BY vec_id""",
)
def c1_encode_features(spark: SparkSession, sf: str) -> DataFrame:
    images = load_images(image_rows(spark, sf)).select("vec_id", "pixels")
    out = encode_features(images, formula_encoder(), batch_size=64)
    tokens = latent.drop_leading_tokens(F.col("tokens"), 6, 1)
    return out.select(
        "vec_id",
        F.size(tokens).alias("n_token_values"),
        F.size("gt_mean").alias("n_latent_values"),
        F.round(total(tokens), 2).alias("token_sum"),
        F.round(dot(tokens, tokens), 1).alias("token_power"),
    )


@query(
    "c2_drop_leading_tokens",
    f"""SELECT vec_id, (i - 20)::INTEGER AS i, v AS value FROM ({unnest_sql("embeddings", "vec_id", "embedding")})
WHERE i >= 20""",
)
def c2_drop_leading_tokens(spark: SparkSession, sf: str) -> DataFrame:
    kept = latent.drop_leading_tokens(F.col("embedding"), DIM, 5)
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(kept).alias("i", "value"))
    return rows.withColumn("value", F.col("value").cast("double"))


@query(
    "c3_to_half",
    f"SELECT vec_id, i::INTEGER AS i, {HALF} AS half FROM ({unnest_sql('embeddings', 'vec_id', 'embedding')})",
)
def c3_to_half(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(to_half(F.col("embedding"))).alias("i", "half"))
    return rows.withColumn("half", F.col("half").cast("double"))


@query(
    "c4_assign_shards",
    """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS g FROM orders)
SELECT o_orderkey, g::BIGINT AS global_idx, (g // 1000)::INTEGER AS shard_id, (g % 1000)::BIGINT AS "offset" FROM p""",
)
def c4_assign_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query(
    "c5_write_shards",
    f"""WITH {STORE} SELECT (g // {SHARD})::INTEGER AS shard_id, count(*)::BIGINT AS n_rows,
  min(g)::BIGINT AS first_idx, round(sum(token_sum), 6) AS token_sum
FROM st JOIN ts ON ts.item_id = st.item_id GROUP BY 1""",
)
def c5_write_shards(spark: SparkSession, sf: str) -> DataFrame:
    back = feature_store.read_store(spark, store_path(spark, sf))
    return back.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("global_idx").alias("first_idx"),
        F.round(F.sum(total(F.col("tokens"))), 6).alias("token_sum"),
    )


@query(
    "c5_write_shards_packed",
    f"""WITH {STORE} SELECT st.item_id, token_sum FROM st JOIN ts ON ts.item_id = st.item_id""",
)
def c5_write_shards_packed(spark: SparkSession, sf: str) -> DataFrame:
    """The same store with tensors packed as binary16."""

    def write(path: str) -> None:
        write_encoded(spark, sf, path, feature_store.ROWS_PER_FILE, storage="half")

    back = feature_store.read_store(spark, written(spark, sf, "store-half", write))
    return back.select("item_id", total(F.col("tokens")).alias("token_sum"))


def versioned_path(spark: SparkSession, sf: str) -> str:
    """A store of two versions: the second one replaces every third shard by the doubled tensors."""

    def write(path: str) -> None:
        rows = encoded(indexed(spark, sf))
        versions.commit_shards(rows, path, rows_per_file=32)
        doubled = rows.where("shard_id % 3 = 1").withColumn("tokens", F.transform("tokens", lambda v: v * 2))
        versions.commit_shards(doubled, path, rows_per_file=32)

    return written(spark, sf, "versions", write)


@query(
    "c5_versions",
    f"""WITH {STORE}, r AS (SELECT (g // {SHARD})::INTEGER AS shard_id, g, token_sum FROM st JOIN ts ON ts.item_id = st.item_id)
SELECT version::INTEGER AS version, shard_id, count(*)::BIGINT AS n_rows, min(g)::BIGINT AS first_idx,
  round(sum(token_sum * CASE WHEN version = 2 AND shard_id % 3 = 1 THEN 2 ELSE 1 END), 6) AS token_sum
FROM r, range(1, 3) v(version) GROUP BY 1, 2""",
)
def c5_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Both versions of a store side by side."""
    path = versioned_path(spark, sf)
    first, second = (
        versions.read_version(spark, path, n).select(F.lit(n).alias("version"), "shard_id", "global_idx", "tokens") for n in (1, 2)
    )
    return first.union(second).groupBy("version", "shard_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("global_idx").alias("first_idx"),
        F.round(F.sum(total(F.col("tokens"))), 6).alias("token_sum"),
    )


@query(
    "c13_lookup_version",
    f"""WITH {STORE} SELECT l.doc_id AS idx, st.item_id, (g // {SHARD})::INTEGER AS shard_id, (g % {SHARD})::BIGINT AS "offset",
  token_sum * CASE WHEN (g // {SHARD}) % 3 = 1 THEN 2 ELSE 1 END AS token_sum
FROM labels l JOIN st ON st.g = l.doc_id JOIN ts ON ts.item_id = st.item_id""",
)
def c13_lookup_version(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted rows of the newest version, by row group."""
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("idx"))
    rows = versions.lookup_version(spark, versioned_path(spark, sf), wanted)
    return rows.select("idx", "item_id", "shard_id", "offset", total(F.col("tokens")).alias("token_sum"))


@query(
    "c6_shard_meta",
    """WITH p AS (SELECT doc_id, source || '/doc_' || doc_id || '.txt' AS path,
  row_number() OVER (ORDER BY source, doc_id) - 1 AS g FROM documents)
SELECT (g // 100)::INTEGER AS shard_id, count(*)::BIGINT AS n_images, min(CASE WHEN g % 100 = 0 THEN path END) AS first_path,
  md5(string_agg(path, chr(10) ORDER BY g)) AS paths_digest FROM p GROUP BY 1""",
)
def c6_shard_meta(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "doc_id")
    named = docs.withColumn("path", F.format_string("%s/doc_%d.txt", "source", "doc_id"))
    meta = shards.shard_meta(shards.assign_shards(named, ["source", "doc_id"], 100), 100)
    return meta.select(
        "shard_id",
        "n_images",
        F.get("image_paths", F.lit(0)).alias("first_path"),
        F.md5(F.array_join("image_paths", "\n")).alias("paths_digest"),
    )


def document_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", "lang", F.format_string("doc_%d.txt", "doc_id").alias("file_name"), F.col("source").alias("parent")
    )


WORDS = ", ".join(
    f"sum(('0x' || substr(md5(source || ':doc_' || doc_id || '.txt'), {8 * i + 1}, 8))::BIGINT)::BIGINT AS word_{i}"
    for i in range(4)
)
MULTISET = f"""m AS (SELECT count(*)::BIGINT AS n_items, {WORDS} FROM documents),
f AS (SELECT *, substr(sha256(concat_ws(':', n_items, word_0, word_1, word_2, word_3)), 1, 16) AS fingerprint FROM m)"""


@query(
    "c7_manifest",
    f"""WITH {MULTISET} SELECT 1::INTEGER AS version, fingerprint AS dataset_hash,
  ((n_items + 99) // 100)::INTEGER AS total_shards, ((n_items + 99) // 100)::INTEGER AS shard_count,
  ((n_items + 99) // 100 - 1)::INTEGER AS last_shard, 'enc-1' AS encoder FROM f""",
)
def c7_manifest(spark: SparkSession, sf: str) -> DataFrame:
    def write(path: str) -> None:
        items = document_items(spark, sf)
        placed = shards.assign_shards(items, ["parent", "doc_id"], 100)
        feature_store.write_shards(placed, f"{path}/store")
        feature_store.save_manifest(
            spark, f"{path}/manifest", items, {"encoder": "enc-1"}, store=f"{path}/store", shard_size=100
        )

    manifest = feature_store.load_manifest(spark, written(spark, sf, "manifest", write) + "/manifest")
    return manifest.select(
        "version",
        "dataset_hash",
        "total_shards",
        "shard_count",
        "last_shard",
        F.col("model_versions")["encoder"].alias("encoder"),
    )


@query("c8b_fingerprint_multiset", f"WITH {MULTISET} SELECT * FROM f")
def c8b_fingerprint_multiset(spark: SparkSession, sf: str) -> DataFrame:
    return shards.dataset_fingerprint(document_items(spark, sf))


def language_versions(docs: DataFrame) -> DataFrame:
    """One "model" per language, versioned by its content."""
    return docs.groupBy(F.col("lang").alias("model")).agg(
        F.concat_ws(":", F.count(F.lit(1)), F.sum("n_chars")).alias("version")
    )


@query(
    "c9_model_diff",
    """WITH a AS (SELECT lang, concat_ws(':', count(*), sum(n_chars)) AS v FROM documents GROUP BY lang),
b AS (SELECT lang, concat_ws(':', count(*), sum(n_chars)) AS v FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang)
SELECT coalesce(a.lang, b.lang) AS model, a.v AS recorded, b.v AS expected
FROM a FULL JOIN b ON a.lang = b.lang WHERE a.v IS DISTINCT FROM b.v""",
)
def c9_model_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return shards.model_diff(language_versions(docs), language_versions(docs.join(toxic, "doc_id", "left_anti")))


@query(
    "c10_resume_plan",
    """WITH p AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS s FROM orders),
plan AS (SELECT s, count(*) AS n FROM p GROUP BY s),
bad AS (SELECT DISTINCT s FROM p WHERE o_totalprice >= 480000 OR o_custkey % 500 = 7)
SELECT plan.s::INTEGER AS shard_id, plan.n::BIGINT AS n_images FROM plan JOIN bad ON bad.s = plan.s""",
)
def c10_resume_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Orders above a price are not committed and some customers' orders stand there as
    others: shards holding either are planned again, though the latter have the right count."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    placed = shards.assign_shards(orders, "o_orderkey", 50)
    other = F.when(F.col("o_custkey") % 500 == 7, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    committed = placed.where("o_totalprice < 480000").withColumn("o_orderkey", other)
    return shards.resume_plan(
        shards.shard_contents(placed, "o_orderkey"), shards.shard_contents(committed, "o_orderkey")
    )


@query(
    "c10_resume_subset",
    f"""WITH st AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS g FROM embeddings)
SELECT vec_id AS item_id, (g // {SHARD})::INTEGER AS shard_id, (g % {SHARD})::BIGINT AS "offset", g::BIGINT AS global_idx
FROM st""",
)
def c10_resume_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Encode a stretch in the middle of the corpus, then all of it: the store holds every item once, in place."""

    def write(path: str) -> None:
        vectors = table(spark, sf, "embeddings")
        items = vectors.select(
            F.col("vec_id").alias("item_id"),
            F.format_string("emb/%012d.png", "vec_id").alias("path"),
            F.format_string("%012d.png", "vec_id").alias("file_name"),
            F.lit("emb").alias("parent"),
        )
        pixels = load_images(image_rows(spark, sf)).select(F.col("vec_id").alias("item_id"), "height", "width", "pixels")
        shapes = [(4, 6), (64,)]
        for subset in ((100, 230), None):
            pre_encode(
                spark, items, pixels, formula_encoder(), path, {"encoder": "formula"}, tensor_shapes=shapes, shard_size=SHARD, subset=subset
            )

    rows = feature_store.read_store(spark, written(spark, sf, "resumed", write))
    return rows.select("item_id", "shard_id", "offset", "global_idx")


@query(
    "c11_estimate_store",
    """SELECT lang, count(*)::BIGINT AS n_items, ((count(*) + 99) // 100)::BIGINT AS shards,
  (count(*) * 2 * (1024 * 384 + 2 * 16 * 64 * 64))::BIGINT AS n_bytes FROM documents GROUP BY lang""",
)
def c11_estimate_store(spark: SparkSession, sf: str) -> DataFrame:
    n, size = shards.estimate_store(F.col("n_items"), [(1024, 384), (16, 64, 64), (16, 64, 64)], 100)
    counts = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_items"))
    return counts.select("lang", "n_items", n.alias("shards"), size.alias("n_bytes"))


MAP_SQL = """SELECT (row_number() OVER (ORDER BY user_id, event_id) - 1)::BIGINT AS global_idx, user_id AS shard_id,
  (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS "offset" FROM events"""


@query("c12_index_map", MAP_SQL)
def c12_index_map(spark: SparkSession, sf: str) -> DataFrame:
    """Users as shards of unequal size; the map follows from their counts alone."""
    meta = table(spark, sf, "events").groupBy(F.col("user_id").alias("shard_id")).agg(
        F.count(F.lit(1)).alias("n_images")
    )
    return shards.index_map(meta)


@query(
    "c12_locate",
    f"""WITH m AS ({MAP_SQL}) SELECT doc_id AS idx, shard_id, "offset" FROM labels JOIN m ON m.global_idx = labels.doc_id""",
)
def c12_locate(spark: SparkSession, sf: str) -> DataFrame:
    meta = table(spark, sf, "events").groupBy(F.col("user_id").alias("shard_id")).agg(
        F.count(F.lit(1)).alias("n_images")
    )
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("idx"))
    return shards.locate(meta, wanted, block=256).select("idx", "shard_id", "offset")


@query(
    "c13_lookup",
    f"""WITH {STORE} SELECT l.doc_id AS idx, st.item_id, (g // {SHARD})::INTEGER AS shard_id,
  (g % {SHARD})::BIGINT AS "offset", token_sum
FROM labels l JOIN st ON st.g = l.doc_id JOIN ts ON ts.item_id = st.item_id""",
)
def c13_lookup(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("idx"))
    rows = feature_store.lookup(spark, store_path(spark, sf), wanted)
    return rows.select("idx", "item_id", "shard_id", "offset", total(F.col("tokens")).alias("token_sum"))


@query(
    "c14_default_logvar",
    """SELECT vec_id AS item_id, 256::INTEGER AS n_values, label < 3 AS was_missing FROM embeddings""",
)
def c14_default_logvar(spark: SparkSession, sf: str) -> DataFrame:
    rows = feature_store.read_store(spark, store_path(spark, sf))
    return rows.select(
        "item_id",
        F.size("gt_logvar").alias("n_values"),
        F.forall("gt_logvar", lambda v: v == 0).alias("was_missing"),
    )


@query(
    "c15_load_shards",
    f"""WITH {STORE} SELECT (g // {SHARD})::INTEGER AS shard_id, count(*)::BIGINT AS n_rows,
  round(sum(token_sum), 6) AS token_sum FROM st JOIN ts ON ts.item_id = st.item_id WHERE g // {SHARD} < 5 GROUP BY 1""",
)
def c15_load_shards(spark: SparkSession, sf: str) -> DataFrame:
    held = feature_store.load_shards(spark, store_path(spark, sf), 5, keep=False)
    return held.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(total(F.col("tokens"))), 6).alias("token_sum")
    )


@query(
    "c15_shard_audit",
    """WITH p AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS s FROM orders)
SELECT s::INTEGER AS shard_id, count(*)::BIGINT AS expected_rows,
  (count(*) FILTER (o_totalprice < 480000))::BIGINT AS found_rows
FROM p GROUP BY s HAVING count(*) <> count(*) FILTER (o_totalprice < 480000)""",
)
def c15_shard_audit(spark: SparkSession, sf: str) -> DataFrame:
    placed = shards.assign_shards(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50)
    return shards.shard_audit(shards.shard_sizes(placed), shards.shard_sizes(placed.where("o_totalprice < 480000")))


@query(
    "c16_store_info",
    f"""WITH {STORE}, s AS (SELECT g // {SHARD} AS s, count(*) AS n FROM st GROUP BY 1)
SELECT sum(n)::BIGINT AS total_samples, count(*)::BIGINT AS shard_count, max(n)::BIGINT AS largest_shard,
  min(n)::BIGINT AS smallest_shard, 64::INTEGER AS token_values, 256::INTEGER AS latent_values,
  (SELECT count(*) FROM embeddings WHERE label >= 3)::BIGINT AS with_logvar FROM s""",
)
def c16_store_info(spark: SparkSession, sf: str) -> DataFrame:
    return versions.store_summary(spark, store_path(spark, sf))
