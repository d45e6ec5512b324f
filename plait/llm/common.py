"""What the operators of this package share: the cluster's shared folder, written tables, word splitting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these six, in Java, DuckDB and Python syntax.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"

#: Rows in an Arrow batch. Texts may be long; a batch must fit a Python worker several times.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master (tests) gets a temporary folder, removed at exit; a cluster
    gets an error, as a machine-local folder would not be seen by its executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="plait-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def arrow_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker receives at once, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plait/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plait_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in frames:
        spark, path = df.sparkSession, df._plait_path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished phases: it acts on the driver's garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def released() -> None:
    """Gives freed memory back to the system at the end of a task, as Python workers live on."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def spread(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A table is broadcast only if it has at most so many rows; beyond, it is joined by a shuffle with a salt.
BROADCAST_ROWS = 100_000
SALTS = 64


def small_join(big: DataFrame, small: DataFrame, keys: list[str], salt, how: str = "inner") -> DataFrame:
    """big joined with a table of one row per group, null keys equal.

    The table's size is counted: broadcast up to BROADCAST_ROWS, else a shuffled join in which every row
    of the table stands SALTS times and big's rows go to one of them by salt, as one group may hold a third of big.
    """
    renamed = small.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in small.columns if c not in keys))
    on = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = e if on is None else on & e
    if renamed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = big.join(F.broadcast(renamed), on, how)
    else:
        renamed = renamed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = big.withColumn("__own", F.pmod(salt, F.lit(SALTS)).cast("int")).join(renamed, on & (F.col("__own") == F.col("__salt")), how).drop("__own", "__salt")
    return out.drop(*(f"__{k}" for k in keys))
