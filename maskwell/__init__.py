"""PySpark-native sensitive-data discovery, masking and corpus preparation."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Python workers live on between stages: of freed memory they keep 16 MiB at most, blocks of 4 MiB go back at once (smaller ones
#: would be paged in anew for every batch), and products of matrices take one thread.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "OPENBLAS_NUM_THREADS": "1"}


def ship(spark):
    """Let Python workers import this package where only the driver's path has it; on a cluster, install it or use --py-files.
    Arrow batches are 4 MiB unless the session says otherwise (10,000 long texts are hundreds, held on both sides)."""
    if not spark.conf.get(ARROW_BYTES, None):
        spark.conf.set(ARROW_BYTES, str(4 << 20))
    env = spark.sparkContext.environment
    for name, value in WORKERS.items():
        env.setdefault(name, value)
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def dealt(df):
    """``df`` dealt over as many tasks as a shuffle has, two a core at least."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def shared_dir(spark) -> str:
    """The folder that the driver and all executors share, as the cluster names it; one of its own only in a single process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="maskwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
