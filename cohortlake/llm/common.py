"""Shared folders, stored intermediates and row numbers."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Sub-buckets per group when rows are numbered; bounds the rows one task must sort.
NUMBER_BUCKETS = 4096
# Bytes of an Arrow batch; decoded texts and what is worked out from them take several times as much.
BATCH_BYTES = 8 << 20


def worker_cache() -> dict:
    """What a Python worker keeps from one task to the next, such as loaded tokenizers."""
    return vars(sys.modules.setdefault("_cohortlake_worker", types.ModuleType("_cohortlake_worker")))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, not yet made, in the place all executors share.

    The place is ``spark.checkpoint.dir``. Where it is unset, as in tests, a local
    master gets a temporary folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Hold what a Python worker gets at a time to ``BATCH_BYTES`` of texts; a smaller setting stays."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(setting).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor neither loses nor changes the rows.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove the files of a ``stored`` result that nothing will read again."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 without a gap, at any group size.

    A group is dealt into sub-buckets by a hash of ``order``. The sub-buckets are
    counted, the counts summed up along the group, and rows are numbered inside
    their sub-bucket. Which number a row gets depends on its values alone; the
    numbers follow the hash, not the order of the columns. Columns of ``group`` must not
    be null.
    """
    bucket, before = spare_name(df, "_bucket"), spare_name(df, "_before")
    keys = [*group, bucket]
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(NUMBER_BUCKETS)).cast("int"))
    along = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(before))
        .withColumn(before, F.coalesce(F.sum(before).over(along), F.lit(0)))
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = dealt.withColumn(out, F.row_number().over(inside).cast("long") - 1)
    return numbered.join(offsets, keys).select(
        *[c for c in df.columns if c != out], (F.col(out) + F.col(before)).alias(out)
    )
