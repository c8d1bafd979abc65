"""Session set-up and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "weft", **conf: str) -> SparkSession:
    """Session for tests and benches. On a cluster, the session is the cluster's own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="weft-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and read it from there.

    Needed where a value depends on the physical layout (a partition number), and used
    where a small result feeds several others: once written, a lost executor cannot bring
    back a different layout, and readers get column pruning and true sizes.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/weft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input by ``keys`` if it comes in fewer splits than there are cores.

    For work that grows with the text: a small file is one split and would keep one core
    busy. A large input has many splits and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < 2 * cores else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's number of shuffle partitions.

    For rows that grow many times after the shuffle (text into n-grams): a fixed number
    keeps the partitions apart that adaptive coalescing would merge by their size before.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
