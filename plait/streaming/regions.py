"""Signed-digit projections of a stream: stateless, so that any batch plan of them also runs on readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.functions import digits as D
from plait.operators import shared


def projected(events: DataFrame) -> DataFrame:
    """event_id with its digits and value."""
    k = F.col("event_id").cast("bigint")
    return events.select("event_id", D.text(D.hex_cells(k)).alias("cells"), D.value(D.hex_cells(k)).alias("value"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the events table through projected() once, and returns what came out."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    out = shared.place(spark, "regions")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/events*.parquet")
    made = projected(stream)
    done = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared.place(spark, "regions-progress")).outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
