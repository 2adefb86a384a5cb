"""Run telemetry and sample panel queries (F rows)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.arrays import average, total
from tensorloom.operators import panel, telemetry
from tensorloom.operators.encode import BatchModel, apply_model, linear_decoder
from tensorloom.operators.latent import denormalize
from tensorloom.operators.mappers import create_mapper, score
from tensorloom.plans.catalog import half_sql, query, table, unnest_sql, written
from tensorloom.plans.queries_model import E, RUN_EPOCHS, SMALL, UP_SQL, known_linear, run_epochs, small, tokens
from tensorloom.plans.queries_store import DIM, store_path
from tensorloom.session import scratch_path
from tensorloom.streaming import ingest

PER_EPOCH = 500  # batches in an epoch of the logs below


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as step lines of one log per event type."""
    value = F.col("value")
    line = telemetry.step_line(
        F.col("ts").cast("timestamp"),
        F.col("event_id") + 1,
        F.pmod(F.col("event_id"), F.lit(PER_EPOCH)) + 1,
        value,
        value / 10,
        value / 1000,
        F.lit(0.001),
    )
    return table(spark, sf, "events").select(F.col("event_type").alias("run"), line.alias("value"))


def log_tree(spark: SparkSession, sf: str) -> str:
    def write(path: str) -> None:
        log_lines(spark, sf).write.partitionBy("run").text(path)

    return written(spark, sf, "logs", write)


RUN_IN_TREE = r"run=([^/]+)/[^/]+$"
STEP_SQL = f"""SELECT event_type AS run_id, (epoch_us(ts) // 1000)::BIGINT AS ts_ms, (event_id // {PER_EPOCH})::INTEGER AS epoch,
  (event_id + 1)::BIGINT AS step, (event_id % {PER_EPOCH} + 1)::BIGINT AS batch, value AS loss, round(value / 10, 4) AS mse,
  round(value / 1000, 6) AS kl, 0.001::DOUBLE AS lr FROM events"""


def step_rows(steps: DataFrame) -> DataFrame:
    # the written log time read back as wall-clock milliseconds
    wall = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return steps.select("run_id", wall.alias("ts_ms"), "epoch", "step", "batch", "loss", "mse", "kl", "lr")


@query("f1_parse_train_log", STEP_SQL)
def f1_parse_train_log(spark: SparkSession, sf: str) -> DataFrame:
    lines = telemetry.read_train_log(spark, log_tree(spark, sf), "*.txt", RUN_IN_TREE)
    return step_rows(telemetry.parse_steps(lines, PER_EPOCH))


@query("f1_tail_train_log", STEP_SQL)
def f1_tail_train_log(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows through a file stream."""
    out = scratch_path(spark, "steps")
    stream = ingest.tail_steps(spark, log_tree(spark, sf), PER_EPOCH, "*.txt", RUN_IN_TREE)
    ingest.write_steps(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return step_rows(spark.read.parquet(f"{out}/rows"))


@query(
    "f1_parse_epochs",
    f"""SELECT event_type AS run_id, epoch_us(max(ts)) // 1000 AS ts_ms, (event_id // {PER_EPOCH} + 1)::INTEGER AS epoch,
  max(count(*))  OVER (PARTITION BY event_type)::INTEGER AS epochs, max(value) AS loss
FROM events GROUP BY event_type, event_id // {PER_EPOCH}""",
)
def f1_parse_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch lines among the step lines of the same logs; the total stands for the most steps in an epoch."""
    epoch = F.floor(F.col("event_id") / F.lit(PER_EPOCH)) + 1
    ends = table(spark, sf, "events").groupBy(F.col("event_type").alias("run"), epoch.alias("epoch"))
    ends = ends.agg(F.max("ts").cast("timestamp").alias("ts"), F.max("value").alias("loss"), F.count(F.lit(1)).alias("n"))
    most = ends.groupBy("run").agg(F.max("n").alias("most"))
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"),
        F.lit(" [INFO] "),
        F.format_string("Epoch %d/%d  loss=%.4f", "epoch", "most", "loss"),
    )

    def write(path: str) -> None:
        lines = ends.join(most, "run").select("run", line.alias("value"))
        lines.unionByName(log_lines(spark, sf)).write.partitionBy("run").text(path)

    lines = telemetry.read_train_log(spark, written(spark, sf, "epoch-logs", write), "*.txt", RUN_IN_TREE)
    wall = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return telemetry.parse_epochs(lines).select("run_id", wall.alias("ts_ms"), "epoch", "epochs", "loss")


def step_table(spark: SparkSession, sf: str) -> DataFrame:
    batch = F.pmod(F.col("event_id"), F.lit(PER_EPOCH))
    epoch = ((F.col("event_id") - batch) / PER_EPOCH).cast("int")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"), epoch.alias("epoch"), (batch + 1).alias("batch"), "value", "user_id"
    ).withColumn("step", telemetry.global_step(F.col("epoch"), F.col("batch") - 1, PER_EPOCH))


@query(
    "f2_thin_steps",
    f"""SELECT event_type AS run_id, (event_id + 1)::BIGINT AS step, (event_id % {PER_EPOCH} + 1)::BIGINT AS batch FROM events
WHERE (event_id % {PER_EPOCH} + 1) % 100 = 0 OR event_id % {PER_EPOCH} = 0""",
)
def f2_thin_steps(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.thin_steps(step_table(spark, sf), 100).select("run_id", "step", "batch")


@query(
    "f3_epoch_summary",
    """WITH s AS (SELECT event_type AS run_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS epoch,
  value AS loss, value * 0.9::DOUBLE AS mse, value / 7 AS kl, 1 + user_id % 8 AS n FROM events),
m AS (SELECT run_id, epoch, sum(n)::BIGINT AS n_samples, sum(loss * n) / sum(n) AS loss, sum(mse * n) / sum(n) AS mse,
  sum(kl * n) / sum(n) AS kl FROM s GROUP BY run_id, epoch)
SELECT run_id, epoch, n_samples, round(loss, 6) AS loss, round(mse, 6) AS mse, round(kl, 6) AS kl,
  round(loss - lag(loss) OVER (PARTITION BY run_id ORDER BY epoch), 6) AS delta FROM m""",
)
def f3_epoch_summary(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    steps = table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"),
        day.alias("epoch"),
        F.col("value").alias("loss"),
        (F.col("value") * 0.9).alias("mse"),
        (F.col("value") / 7).alias("kl"),
        (F.col("user_id") % 8 + 1).alias("n"),
    )
    summary = telemetry.epoch_summary(steps)
    return summary.withColumns({c: F.round(c, 6) for c in ("loss", "mse", "kl", "delta")})


@query(
    "f4_panel_schedule",
    f"""WITH {RUN_EPOCHS} SELECT DISTINCT run_id, 0::INTEGER AS panel_epoch FROM k UNION ALL
SELECT run_id, (epoch + 1)::INTEGER FROM k WHERE (epoch + 1) % 5 = 0 OR epoch = epochs - 1""",
)
def f4_panel_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return panel.panel_schedule(run_epochs(spark, sf), 5)


@query(
    "f4_sample_panel",
    f"""WITH {UP_SQL}, g AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS g FROM embeddings),
tk AS (SELECT vec_id, i // 4 AS n, i % 4 AS d, {half_sql("v")} AS v FROM ({E})),
z AS (SELECT vec_id, n, o, sum(v * cos((d + 4 * o)::DOUBLE)) + 0.1::DOUBLE * o AS v FROM tk, range(4) r(o) GROUP BY vec_id, n, o),
share AS (SELECT s, sum(k) AS k FROM w GROUP BY s),
f AS (SELECT vec_id, sum(v * a.k * b.k) AS z_sum, max(CASE WHEN n = 0 AND o = 0 THEN v END) AS z_first FROM z
  JOIN share a ON a.s = n // 4 JOIN share b ON b.s = n % 4 GROUP BY vec_id)
SELECT 'demo' AS run_id, 3::INTEGER AS epoch, l.doc_id AS idx, 64::INTEGER AS n_tokens, 256::INTEGER AS n_latents,
  round(z_sum, 3) AS z_sum, round(z_first::FLOAT::DOUBLE, 4) AS z_first FROM labels l JOIN g ON g.g = l.doc_id JOIN f ON f.vec_id = g.vec_id""",
)
def f4_sample_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions for the labelled positions of the store."""
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("list_pos"), F.col("doc_id").alias("idx"))
    shown = panel.sample_panel(spark, store_path(spark, sf), small("linear"), known_linear(), wanted, "demo", 3)
    return shown.select(
        "run_id",
        "epoch",
        "idx",
        F.size("tokens").alias("n_tokens"),
        F.size("pred_z").alias("n_latents"),
        F.round(total(F.col("pred_z")), 3).alias("z_sum"),
        F.round(F.get("pred_z", F.lit(0)).cast("double"), 4).alias("z_first"),
    )


@query(
    "f5_decode_plan",
    """SELECT event_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS epoch,
  printf('idx_%d/epoch_%04d.png', user_id, date_diff('day', DATE '2024-01-01', ts::DATE)) AS out_key FROM events""",
)
def f5_decode_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Sample files of every day, one per user; the epoch comes from the file name."""
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    files = table(spark, sf, "events").select(
        "event_id",
        F.lit(-1).alias("epoch"),
        F.col("user_id").alias("idx"),
        F.concat(F.lit("runs/demo/samples/"), F.format_string("sample_%04d.pt", day)).alias("file"),
    )
    return panel.decode_plan(files, source="file").select("event_id", "epoch", "out_key")


def panel_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a panel sample: label as epoch, latents from the known mapper."""
    scored = score(tokens(spark, sf), create_mapper("linear", **SMALL), known_linear(), item="vec_id")
    return scored.select(
        F.lit("demo").alias("run_id"), F.col("label").alias("epoch"), F.col("vec_id").alias("idx"), "pred_z"
    )


@query(
    "f6_decode_samples",
    """SELECT label AS epoch, vec_id AS idx, printf('idx_%d/epoch_%04d.png', vec_id, label) AS out_key,
  8::INTEGER AS height, 8::INTEGER AS width, '89504E470D0A1A0A' AS magic FROM embeddings""",
)
def f6_decode_samples(spark: SparkSession, sf: str) -> DataFrame:
    decoded = panel.decode_samples(panel_rows(spark, sf), linear_decoder(DIM, 8, seed=2), 8)
    return panel.decode_plan(decoded).select(
        "epoch", "idx", "out_key", "height", "width", F.hex(F.substring("image", 1, 8)).alias("magic")
    )


def formula_decoder() -> BatchModel:
    """A decoder whose weights SQL can state: tanh of cos(k + 3 c) mixes."""

    def make_predict_fn():
        mix = np.cos(np.arange(3)[:, None] + 3.0 * np.arange(DIM)[None, :])

        def predict(z: np.ndarray) -> dict[str, np.ndarray]:
            rgb = np.tanh(np.einsum("kc,bchw->bkhw", mix, z.astype(np.float64)))
            return {"pixels": rgb.reshape(len(z), -1)}

        return predict

    return BatchModel(make_predict_fn, (DIM, 8, 8), ("pixels",))


@query(
    "f6_decode_levels",
    f"""WITH {UP_SQL}, z AS (SELECT vec_id, i // 64 AS d, i % 64 AS p, v FROM up),
m AS (SELECT vec_id, c, p, sum(v * cos((d + 4 * c)::DOUBLE)) + 0.1::DOUBLE * c AS v FROM z, range(4) r(c) GROUP BY vec_id, c, p),
x AS (SELECT vec_id, k, p, tanh(sum(v * cos((k + 3 * c)::DOUBLE))) AS v FROM m, range(3) r(k) GROUP BY vec_id, k, p)
SELECT vec_id AS idx, round(avg(floor((v + 1) / 2 * 255.0::DOUBLE + 0.5)), 1) AS mean_level FROM x GROUP BY vec_id""",
)
def f6_decode_levels(spark: SparkSession, sf: str) -> DataFrame:
    decoded = apply_model(panel_rows(spark, sf), formula_decoder(), "pred_z", batch_size=64)
    levels = denormalize(F.col("pixels"))
    return decoded.select("idx", F.round(average(levels), 1).alias("mean_level"))


ERROR_SQL = f"""x AS (SELECT label AS epoch, vec_id % 4 AS idx, vec_id, avg((v * 0.9::DOUBLE + 0.01::DOUBLE - v) ** 2) AS mse
  FROM ({unnest_sql("embeddings", "label, vec_id", "embedding")}) GROUP BY label, vec_id),
m AS (SELECT epoch, idx, count(*)::BIGINT AS n_rows, avg(mse) AS mse FROM x GROUP BY epoch, idx)"""


def errors(spark: SparkSession, sf: str) -> DataFrame:
    vec = F.col("embedding").cast("array<double>")
    samples = table(spark, sf, "embeddings").select(
        F.col("label").alias("epoch"),
        (F.col("vec_id") % 4).alias("idx"),
        F.transform(vec, lambda v: v * 0.9 + 0.01).alias("pred_z"),
        vec.alias("gt_mean"),
    )
    return panel.panel_error(samples)


@query(
    "f7_error_grid",
    f"""WITH {ERROR_SQL} SELECT epoch, round(max(mse) FILTER (idx = 0), 6) AS "0", round(max(mse) FILTER (idx = 1), 6) AS "1",
  round(max(mse) FILTER (idx = 2), 6) AS "2", round(max(mse) FILTER (idx = 3), 6) AS "3" FROM m GROUP BY epoch""",
)
def f7_error_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = panel.error_grid(errors(spark, sf), [0, 1, 2, 3])
    return grid.select("epoch", *[F.round(f"`{i}`", 6).alias(str(i)) for i in range(4)])


@query(
    "f7_comparison_grid",
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
w AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS r, p, least(n - p * 16, 16) AS cells
  FROM c, LATERAL (SELECT unnest(range((n + 15) // 16)) AS p))
SELECT 'demo' AS run_id, p::INTEGER AS page_x, 0::INTEGER AS page_y, (count(*) * 8)::INTEGER AS height,
  (max(cells) * 8)::INTEGER AS width FROM w GROUP BY p""",
)
def f7_comparison_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Montage of a written table of decoded cells."""

    def write(path: str) -> None:
        decoded = apply_model(panel_rows(spark, sf), linear_decoder(DIM, 8, seed=2), "pred_z")
        decoded.select(
            "run_id",
            "epoch",
            "idx",
            F.lit(8).alias("height"),
            F.lit(8).alias("width"),
            panel.pack_levels(denormalize(F.col("pixels")), 8, 8).alias("levels"),
        ).write.parquet(path)

    cells = spark.read.parquet(written(spark, sf, "cells", write))
    return panel.comparison_grid(cells, columns=16).drop("image")


@query("f8_panel_error", f"WITH {ERROR_SQL} SELECT epoch, idx, n_rows, round(mse, 6) AS mse FROM m")
def f8_panel_error(spark: SparkSession, sf: str) -> DataFrame:
    return errors(spark, sf).withColumn("mse", F.round("mse", 6))
