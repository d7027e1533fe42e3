"""Bounded scans of a channel feed: files that hold nothing above a channel's last id are not opened.

A feed is written in the order of channel and message id, so a file holds few channels and a narrow range of ids of
each. A small table beside it, the zones, holds the highest id of each channel in each file.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.ingest import newer_than_tracker
from tidewire.operators.scale import join_dimension
from tidewire.sources.files import Files
from tidewire.streaming import store

ZONES = "file string, channel string, top bigint"
BESIDE = "_zones"  # readers of the feed pass over it


def write_clustered(feed: DataFrame, path: str) -> None:
    """Append messages in files of neighbouring channels and ids, and take down their zones."""
    (feed.repartitionByRange("channel", "message_id").sortWithinPartitions("channel", "message_id")
     .write.mode("append").parquet(path))
    update_zones(feed.sparkSession, path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    zones = f"{path}/{BESIDE}"
    return spark.read.schema(ZONES).parquet(zones) if store.children(spark, zones) else spark.createDataFrame([], ZONES)


def update_zones(spark: SparkSession, path: str) -> None:
    """Take down the zones of files that have none yet. Only channel and id of these files are read.

    Interrupted before its end it adds nothing; until it is run, ``read_above`` opens the new files whole.
    """
    fresh, files = _without_zones(spark, path), Files(spark, path)
    if fresh:
        whole = F.col("_metadata.file_path")
        name = F.substr(whole, F.instr(whole, F.lit(files.raw + "/")) + len(files.raw) + 1)
        (spark.read.parquet(*map(files.url, fresh)).groupBy(name.alias("file"), "channel").agg(F.max("message_id").alias("top"))
         .coalesce(1).write.mode("append").parquet(f"{path}/{BESIDE}"))


def _without_zones(spark: SparkSession, path: str) -> list[str]:
    """Files of the feed that no zone names, relative to it; the driver holds names only."""
    known, files = {r.file for r in read_zones(spark, path).select("file").distinct().toLocalIterator()}, Files(spark, path)
    return sorted(set(map(files.relative, spark.read.parquet(path).inputFiles())) - known)


def files_above(spark: SparkSession, path: str, last_ids: DataFrame) -> list[str]:
    """Files, relative to the feed, that can hold a message above its channel's last id, or of a channel without one."""
    marks = last_ids.groupBy("channel").agg(F.max("last_id").alias("last_id"))
    zones = join_dimension(read_zones(spark, path), marks, ["channel"], "left")
    open_ = zones.filter(F.col("last_id").isNull() | (F.col("top") > F.col("last_id"))).select("file").distinct()
    return sorted({r.file for r in open_.toLocalIterator()} | set(_without_zones(spark, path)))


def read_above(spark: SparkSession, path: str, last_ids: DataFrame) -> DataFrame:
    """Messages above their channel's last id, from the files that can hold some."""
    files = list(map(Files(spark, path).url, files_above(spark, path, last_ids)))
    feed = spark.read.parquet(*files) if files else spark.read.parquet(path).limit(0)
    return newer_than_tracker(feed, last_ids.groupBy("channel").agg(F.max("last_id").alias("last_id")))
