"""Small fixtures shared by several test modules."""

import numpy as np

from tensorloom.sources import store as fs

STORE_SCHEMA = (
    "global_idx long, item_id long, path string, shard_id int, offset long, "
    "tokens array<float>, gt_mean array<float>, gt_logvar array<float>"
)


def make_store(spark, path, counts=(10, 10, 8), tokens=36, latents=64, seed=0):
    """A store of short shards with random tensors (defaults: 3x3x4 -> ..., 4x4 latents)."""
    rng, rows, g = np.random.default_rng(seed), [], 0
    for s, n in enumerate(counts):
        for o in range(n):
            arrays = [rng.standard_normal(k).astype(np.float32).tolist() for k in (tokens, latents, latents)]
            rows.append((g, g + 100, f"d/{g}.jpg", s, o, *arrays))
            g += 1
    fs.write_shards(spark.createDataFrame(rows, STORE_SCHEMA), path)
    return path


def counted_jobs(spark, run):
    """How many Spark jobs ``run`` starts."""
    sc, group = spark.sparkContext, f"count-{id(run)}"
    sc.setJobGroup(group, "counted")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))
