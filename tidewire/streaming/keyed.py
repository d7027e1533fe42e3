"""State by key, kept by Spark's state store: throttle counters and high-water marks.

Both are stateful processors over the rows of a key as they come, a chunk at a time, so no group is ever held. Their
values live in RocksDB, survive a restart with the checkpoint, and expire ``ttl`` after their last change, in
processing time.
"""

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidewire.operators.ingest import STATE_TTL

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
VALUE = StructType([StructField("value", LongType())])


class _Value(StatefulProcessor):
    """One number for each key, with a time to live."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("value", VALUE, self.ttl * 1000)

    def read(self, default: int | None) -> int | None:
        return self.state.get()[0] if self.state.exists() else default

    def close(self) -> None:
        pass


class Throttle(_Value):
    """Every ``n``-th row of a key in the order of arrival, with its number since the counter began."""

    def __init__(self, n: int, number: str, ttl: int) -> None:
        super().__init__(ttl)
        self.n, self.number = n, number

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = self.read(0)
        for part in rows:
            number = pd.RangeIndex(seen + 1, seen + 1 + len(part))
            picked = number % self.n == 0
            seen += len(part)
            if picked.any():
                yield part[picked].assign(**{self.number: number[picked]})
        self.state.update((seen,))


class HighWater(_Value):
    """Rows above the key's mark; the mark then moves to the highest of them.

    All rows of a batch are held against the mark that the batch found, so their order does not matter.
    """

    def __init__(self, column: str, mark: str, ttl: int) -> None:
        super().__init__(ttl)
        self.column, self.mark = column, mark

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        known = initialState[self.mark].dropna()
        if len(known):
            self.state.update((int(known.max()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.read(None)
        top = before
        for part in rows:
            fresh = part[part[self.column].notna()] if before is None else part[part[self.column] > before]
            if len(fresh):
                top = int(fresh[self.column].max()) if top is None else max(top, int(fresh[self.column].max()))
                yield fresh
        if top is not None and top != before:
            self.state.update((top,))


# The processors travel with the query: the worker that sets up their state does not see files shipped to executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def rocks(spark: SparkSession):
    """The settings that these states need, for queries started inside.

    Batches without data are off: with a processing-time state there would always be another one, and a run over
    what is there now would not end.
    """
    needed = {PROVIDER: ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {key: spark.conf.get(key, None) for key in needed}
    for key, value in needed.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def throttle_stream(events: DataFrame, n: int, key: str = "source", number: str = "error_number", ttl: int = STATE_TTL) -> DataFrame:
    """Every ``n``-th event of each key across batches and restarts. Start it inside ``rocks``."""
    out = StructType([*events.schema.fields, StructField(number, LongType())])
    return events.groupBy(key).transformWithStateInPandas(Throttle(n, number, ttl), out, "append", "processingTime")


def newer_stream(feed: DataFrame, last_ids: DataFrame | None = None, key: str = "channel", column: str = "message_id",
                 mark: str = "last_id", ttl: int = STATE_TTL) -> DataFrame:
    """Messages above their channel's high-water mark. Start it inside ``rocks``.

    ``last_ids`` (one row or more for a channel; null counts as none) is where a stream without a checkpoint
    begins, for instance at the highest archived id; a mark that has expired begins at nothing.
    """
    seeds = None if last_ids is None else last_ids.select(key, F.col(mark).cast("bigint").alias(mark)).groupBy(key)
    return feed.groupBy(key).transformWithStateInPandas(HighWater(column, mark, ttl), feed.schema, "append", "processingTime", seeds)


def start_keyed(stream: DataFrame, root: str, every: str | None = None) -> StreamingQuery:
    """Write a keyed stream to ``root/out``, on a timer or over what is there now."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    with rocks(stream.sparkSession):
        return (stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger)
                .format("parquet").option("path", f"{root}/out").start())
