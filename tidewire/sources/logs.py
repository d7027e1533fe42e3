"""Log files as rows."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.clock import log_stamp
from tidewire.operators.scale import join_dimension, settle


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``(file, row, value)``: every line with its 1-based number in its file.

    A large file is read in blocks by many tasks. A line's number is its place in the block plus the
    lines of the file's earlier blocks, so only one row per block is ever sorted.
    """
    # Written once: a second scan could be split elsewhere and number other lines.
    lines = settle(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (lines.groupBy("file", "block").agg(F.min("line").alias("first"), F.count("*").alias("n"))
              .select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    return (join_dimension(lines, settle(blocks), ["file", "block"], "inner")
            .select("file", (F.col("before") + F.col("line") - F.col("first") + 1).alias("row"), "value"))


def parse_logs(lines: DataFrame) -> DataFrame:
    """Add the service name (the file's base name), the time stamp and whether a line looks stamped."""
    return (lines.withColumn("_stamp", log_stamp(F.col("value")))
            .select(*lines.columns,
                    F.regexp_extract("file", r"([^/]+?)(?:\.log)?$", 1).alias("service"),
                    F.col("_stamp").isNotNull().alias("stamped"),
                    F.col("_stamp").try_cast("timestamp_ntz").alias("logged_at")))
