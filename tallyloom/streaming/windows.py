"""Windowed aggregates of events, in batch and as a stream with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.staging import shared_dir


def tumbling(events: DataFrame, width: str) -> DataFrame:
    """Count and total per window and type; on a stream, windows close behind the watermark."""
    w = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_end(spark: SparkSession, path: str, width: str, late: str = "1 day") -> DataFrame:
    """Windows of a file stream that the watermark has closed, written with exactly-once file output.

    Checkpoint and output lie in the shared folder; a query restarted on them goes on where it stopped.
    """
    schema = spark.read.parquet(path).schema
    # A file source streams folders: a single file is named by a pattern of its own.
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path if _is_folder(spark, path) else path.replace(".parquet", ".parquet*"))
    out = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    stream = tumbling(source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
