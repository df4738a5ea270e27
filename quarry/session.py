"""Sessions and tables."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows dealt (by ``keys``) over one task for each ``rows`` of them: for narrow rows whose every one makes much work, as a small file is read by one task."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame) -> DataFrame:
    """The rows written to the folder that the cluster shares (the warehouse where none is named) and read again."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` whose successors are written; nothing may read them any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Rounds:
    """A table that grows by one written part for each round, so that no round writes again what those before it wrote."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema, self.count = spark, shared_path(spark), None, 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write the rows of the next round and read them again."""
        self.schema = self.schema or df.schema
        part = f"{self.path}/round={self.count}"
        df.write.parquet(part)
        self.count += 1
        return self.spark.read.schema(self.schema).parquet(part)

    def table(self) -> DataFrame:
        """All rows so far."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
