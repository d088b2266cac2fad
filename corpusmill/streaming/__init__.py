"""Continuous ingestion: exact dedup of arriving files against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.dedup import sha


def fresh_contents(files: DataFrame, watermark: str | None = None, time_col: str = "ts") -> DataFrame:
    """Of a stream of files, the first of each content; with a watermark, state is bounded by it."""
    hashed = files.withColumn("sha", sha(F.col("content")))
    if watermark:
        return hashed.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["sha"])
    return hashed.dropDuplicates(["sha"])


def ingest(files: DataFrame, store: str, checkpoint: str):
    """Append the contents of a stream that ``store`` (a Parquet folder) does not hold; returns the query.

    Batch ``n`` is written to its own folder, so a batch that is run again after a failure replaces itself.
    """
    spark = files.sparkSession

    def add(batch: DataFrame, n: int) -> None:
        own = batch.withColumn("sha", sha(F.col("content"))).dropDuplicates(["sha"])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        earlier = [f"{store}/batch={k}" for k in range(n) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/batch={k}"))]
        if earlier:
            own = own.join(spark.read.parquet(*earlier).select("sha"), "sha", "left_anti")
        own.write.mode("overwrite").parquet(f"{store}/batch={n}")

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
