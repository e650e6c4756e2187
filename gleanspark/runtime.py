"""Session-level helpers: size checks for broadcasts and a shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of at most this many narrow rows (a key and a few numbers) is broadcast.
BROADCAST_ROWS = 2_000_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a side that was counted; otherwise Spark shuffles it."""
    return F.broadcast(df) if fits(df, max_rows) else df


def use_all_cores(df: DataFrame, key: str) -> DataFrame:
    """Spread a source with fewer splits than cores, such as one small file.

    Anything larger has splits enough and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for local sessions without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="gleanspark-")
        atexit.register(shutil.rmtree, root, True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_root(spark)}/gleanspark-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the folders this process has written so far; call it when their results have been written.

    DataFrames that still read them cannot be used afterwards. Gives the number of folders.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
