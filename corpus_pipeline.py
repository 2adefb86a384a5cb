"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import langid, mixing, ngram_join, packing, secrets
from tensorloom.llm.common import small, stored, unused
from tensorloom.plans.catalog import query, table

ORACLE_SQL = None  # random projections, min-hashes and a genetic search have no SQL form


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without letters are rejected."""
    model = langid.learn_prototypes(docs.where(~langid.held_out()))
    own = {c: unused(docs, f"_{c}") for c in docs.columns if c.lower() in ("lang_pred", "score")}
    judged = langid.predict_language(docs.withColumnsRenamed(own), model)
    accepted = judged.where(F.col("lang_pred") != langid.NONE).drop("lang_pred", "score")
    return accepted.withColumnsRenamed({hidden: c for c, hidden in own.items()})


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by word 5-grams at 0.8 or more.

    Rows that repeat, have no id or share one count as rows of their own: null ids come
    last, rows of one id are chosen by a hash. Texts without words link with nothing and stay.
    Texts stay where they are: the keys of dropped rows go to them, while that set is within
    the bytes of a broadcast.
    """
    doubled = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if doubled.isEmpty():  # ids name rows
        key, rows = "doc_id", docs
        gone = ngram_join.jaccard_join(docs.select("doc_id", "text")).where("not kept").select("doc_id")
    else:
        key = unused(docs, "_row")
        rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows")
        classed = ngram_join.jaccard_join(rows.select(key, "text"), id_col=key).select(F.col("doc_id").alias("id"), "class_id")
        ranks = rows.select(F.col(key).alias("id"), F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), key).alias("rank"))
        least = classed.join(ranks, "id").groupBy("class_id").agg(F.min_by("id", "rank").alias("id"))
        gone = classed.select("id").join(least.select("id"), "id", "left_anti").withColumnRenamed("id", key)
    gone = stored(gone, "pipeline-gone")
    gone = F.broadcast(gone) if small(gone, 64) else gone  # a long in a hashed relation
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked; the length follows the text."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by the raked mixture."""
    return mixing.sample_mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("ngram_jaccard_join", deduplicate),
    ("secret_scans", remove_secrets),
    ("mixing", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


query("pipeline", ORACLE_SQL)(run)
