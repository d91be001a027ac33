"""Session settings and lineage cutting."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators count on. A person or a concept may hold a
# large share of all rows: joins leave that to AQE, which splits the hot
# partition; "force" lets it do so even where the split costs one more exchange.
ADAPTIVE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Size of a shuffle partition that sorts in executor memory without spilling.
PARTITION_BYTES = 128 * 1024 * 1024


def tune(spark: SparkSession, shuffle_bytes: int | None = None) -> SparkSession:
    """Apply the runtime settings to a session somebody else has built.

    ``shuffle_bytes``, the size of the largest shuffle expected, sets the number
    of shuffle partitions; AQE merges those that turn out small.
    """
    for key, value in ADAPTIVE_SETTINGS.items():
        spark.conf.set(key, value)
    if shuffle_bytes is not None:
        partitions = max(1, math.ceil(shuffle_bytes / PARTITION_BYTES))
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortlake")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the folder the cluster names.

    The rows are frozen on shared storage, so a lost executor can neither lose
    them nor change them. Without a named folder only a local master may fall
    back to a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
