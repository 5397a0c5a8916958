"""Shared helpers: input tables, tables written to the shared folder, Arrow batch size."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
#: Rows and bytes in an Arrow batch sent to Python; texts may be long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 256, "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset and Spark runs in one process (tests), below a folder of
    our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="noticeflow-"))
        base = "file://" + _own_dir[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and its size is then known."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more than this part of all rows is hot; there are at most HOT_KEYS such keys.
HOT_KEYS = 1000


def joined_by_key(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of side, which has one row for each key and in `n` how many of all `total` rows have it. Rows of
    hot keys, whose number is bounded, meet a broadcast; the others are shuffled. Both tables are read twice."""
    hot = F.col("n") * HOT_KEYS > total
    few = side.where(hot).drop("n").withColumn("__hot", F.lit(True))
    marked = rows.join(few.hint("broadcast"), key, "left")
    columns = [key, *(c for c in rows.columns if c != key), *(c for c in side.columns if c not in (key, "n"))]
    many = marked.where("__hot is null").select(*rows.columns).hint("merge").join(side.where(~hot).drop("n"), key)
    return marked.where("__hot").select(*columns).unionByName(many.select(*columns))


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)


#: Tables of at most so many narrow rows (about 50 bytes each) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def with_side(left: DataFrame, side: DataFrame, on, how: str = "inner", name: str = "side") -> DataFrame:
    """Join with a side table that is written out and counted first: broadcast if it is small, else by a shuffle."""
    side = saved(side, name)
    return left.join(side.hint("broadcast" if side.count() <= BROADCAST_ROWS else "merge"), on, how)
