"""State between batches, as folders of plain tables.

Every batch writes under its own id, so a batch that is run again replaces what it wrote, and reads
only what earlier batches left behind.
"""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions.clock import at
from tidewire.operators.ingest import STATE_TTL


def _fs(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def children(spark: SparkSession, path: str) -> list[str]:
    fs, root = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, folder = _fs(spark, path)
    fs.delete(folder, True)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions of a small state table."""
    names = [n for n in children(spark, root) if n.startswith("v=")]
    fs, _ = _fs(spark, root)
    done = [n for n in names if fs.exists(_fs(spark, f"{root}/{n}/_SUCCESS")[1])]
    return sorted(int(n[2:]) for n in done)


def read_state(spark: SparkSession, root: str, before: int, schema: str) -> DataFrame:
    """The newest version older than ``before``; empty when there is none."""
    older = [v for v in versions(spark, root) if v < before]
    if not older:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/v={older[-1]}")


def write_state(df: DataFrame, root: str, version: int, keep: int = 10) -> None:
    """Write a version and drop those that are ``keep`` or more versions old."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/v={version}")
    for old in [v for v in versions(spark, root) if v <= version - keep]:
        remove(spark, f"{root}/v={old}")


def batch_time(spark: SparkSession, root: str, batch_id: int, clock: Callable[[], datetime]) -> datetime:
    """The time of a batch: taken once, and read again when the batch is repeated."""
    if batch_id not in versions(spark, root):
        write_state(spark.createDataFrame([(clock().isoformat(),)], "at string"), root, batch_id)
    return datetime.fromisoformat(spark.read.schema("at string").parquet(f"{root}/v={batch_id}").first()["at"])


def _hour(moment):
    return F.date_format(at(moment), "yyyyMMddHH").cast("bigint")


def read_ledger(spark: SparkSession, root: str, before: int, now, ttl: int = STATE_TTL) -> DataFrame:
    """Ledger rows of earlier batches. Whole hours beyond ``ttl`` are pruned by partition."""
    if not children(spark, root):
        return spark.createDataFrame([], schemas.LEDGER)
    oldest = F.date_format(at(now) - F.expr(f"INTERVAL '{ttl}' SECOND"), "yyyyMMddHH").cast("bigint")
    return (spark.read.schema(schemas.LEDGER + ", hour bigint, v bigint").parquet(root)
            .filter((F.col("hour") >= oldest) & (F.col("v") < before)).drop("hour", "v"))


def write_ledger(entries: DataFrame, root: str, version: int, now) -> None:
    spark = entries.sparkSession
    hour = spark.range(1).select(_hour(now)).first()[0]
    entries.write.mode("overwrite").parquet(f"{root}/hour={hour}/v={version}")


def drop_expired_hours(spark: SparkSession, root: str, now, ttl: int = STATE_TTL) -> int:
    """Delete ledger hours that are past ``ttl``; returns how many."""
    oldest = spark.range(1).select(
        F.date_format(at(now) - F.expr(f"INTERVAL '{ttl}' SECOND"), "yyyyMMddHH").cast("bigint")).first()[0]
    stale = [n for n in children(spark, root) if n.startswith("hour=") and int(n[5:]) < oldest]
    for name in stale:
        remove(spark, f"{root}/{name}")
    return len(stale)
