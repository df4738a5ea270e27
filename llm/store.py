"""Tables written to the folder that the cluster shares, to cut lineage."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one id column that may be broadcast: 2 million longs are 16 MB. Beyond it a shuffle join is used.
BROADCAST_ROWS = 2_000_000
#: Bytes of rows that Spark hands to a Python worker at once, and rows that it decodes of a Parquet file at once, where ``small_batches`` was called. A longer single row is a batch of its own.
BATCH_BYTES, READ_ROWS = 1_000_000, 512
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def small_batches(spark: SparkSession) -> None:
    """From now on batches of this session hold BATCH_BYTES, and those of Parquet readers READ_ROWS, at most; all rows come as before.

    Rows of text otherwise come 10,000 or 64 MB at once (4,096 from a reader), which executors and their workers then keep from one stage to the next. Smaller settings stay.
    """
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most, number in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, as_bytes), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS, int)):
        if number(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset (tests, one machine) a folder of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` whose successors are written; nothing may read them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``ids``; ``ids`` is broadcast only if its counted size is within BROADCAST_ROWS."""
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, on, "left_semi")


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
