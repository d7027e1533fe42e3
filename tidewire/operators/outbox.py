"""Deliveries and what became of them: attempts are events, and the newest of a delivery tells its state."""

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.clock import at
from tidewire.functions.lookups import delivery_outcome
from tidewire.operators.summary import outbox_due
from tidewire.session import ship_package
from tidewire.streaming import store

KEY = ["country_code", "channel", "message_id", "sink"]
ATTEMPTS = "country_code string, channel string, message_id string, sink string, attempt int, status int, attempted_at timestamp_ntz"
MAX_ATTEMPTS = 5


class Sender(Protocol):
    def send(self, target: str, card: str) -> int | None:
        """The status of a delivery; None for a timeout. Raising counts as None."""


def newest_attempts(results: DataFrame) -> DataFrame:
    """The attempt with the highest number of each delivery. Reduced map-side; told twice, an attempt counts once."""
    last = F.max_by(F.struct("status", "attempted_at"), F.struct("attempt", "attempted_at"))
    return (results.groupBy(*[F.col(k).cast("string").alias(k) for k in KEY]).agg(F.max("attempt").alias("attempt"), last.alias("_last"))
            .select(*KEY, "attempt", F.col("_last.status").alias("status"), F.col("_last.attempted_at").alias("attempted_at")))


def record_delivery(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """The outbox with the results of attempts: sets attempts, last_status and last_attempt_at.

    An attempt that is not above those recorded changes nothing, so results may be repeated, come late or in any
    order. Deliveries without a result stay as they are; results without a delivery are dropped.
    """
    newest = newest_attempts(results).select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("attempt").alias("_attempt"),
                                             F.col("status").alias("_status"), F.col("attempted_at").alias("_at"))
    same = [F.col(k).cast("string").eqNullSafe(F.col(f"_{k}")) for k in KEY]
    joined = outbox.join(newest, same, "left")
    moved = F.col("_attempt") > F.col("attempts")

    def pick(new: str, old: str) -> Column:
        return F.when(moved, F.col(new)).otherwise(F.col(old)).cast(dict(outbox.dtypes)[old]).alias(old)

    changed = {"attempts": "_attempt", "last_status": "_status", "last_attempt_at": "_at"}
    return joined.select(*[pick(changed[c], c) if c in changed else F.col(c) for c in outbox.columns])


def delivery_state(outbox: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """``new``, ``ok``, ``permanent``, ``retry`` or ``failed``."""
    return F.when(F.col("attempts") == 0, "new").otherwise(delivery_outcome(F.col("last_status"), F.col("attempts"), max_attempts))


def send(target: Column, card: Column, make: Callable[[], Sender]) -> Column:
    """The status of sending each card; null for a timeout or an error. Null targets are not sent."""
    @F.pandas_udf("int")
    def call(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        sender = make()

        def one(to, what):
            try:
                return None if to is None else sender.send(to, what)
            except Exception:
                return None

        for targets, cards in batches:
            yield pd.Series([one(t, c) for t, c in zip(targets, cards)], dtype="Int32")

    ship_package()
    return call.asNondeterministic()(target, card)


def read_attempts(spark: SparkSession, root: str, before: int) -> DataFrame:
    """Attempts of earlier rounds: the compacted ones, and the log after them."""
    folded = [v for v in store.versions(spark, f"{root}/folded") if v < before]
    log = [v for v in store.versions(spark, f"{root}/log") if v < before and (not folded or v > folded[-1])]
    out = store.read_state(spark, f"{root}/folded", before, ATTEMPTS)
    return out.unionByName(spark.read.schema(ATTEMPTS).parquet(*[f"{root}/log/v={v}" for v in log])) if log else out


def fold_attempts(spark: SparkSession, root: str, upto: int) -> None:
    """Compact the log of rounds up to ``upto``: the newest attempt of each delivery.

    The folded table is written before the log is dropped, and the log below it is not read, so this can be
    interrupted and repeated.
    """
    store.write_state(newest_attempts(read_attempts(spark, root, upto + 1)), f"{root}/folded", upto, keep=2)
    for v in store.versions(spark, f"{root}/log"):
        if v <= upto:
            store.remove(spark, f"{root}/log/v={v}")


def deliver(outbox: DataFrame, root: str, number: int, now, make: Callable[[], Sender], max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One round: sends what is due, logs the attempts under the round's number and returns the outbox after it.

    A round that is already logged sends nothing again. One that was interrupted before is sent anew, as nobody knows
    how far it got.
    """
    spark = outbox.sparkSession
    before = record_delivery(outbox, read_attempts(spark, root, number))
    if number not in store.versions(spark, f"{root}/log") and number not in store.versions(spark, f"{root}/folded"):
        due = outbox_due(before, now, max_attempts)
        tried = due.select(*[F.col(k).cast("string").alias(k) for k in KEY], (F.col("attempts") + 1).cast("int").alias("attempt"),
                           send(F.col("alert_target"), F.col("card"), make).alias("status"), at(now).alias("attempted_at"))
        tried.write.mode("overwrite").parquet(f"{root}/log/v={number}")
    return record_delivery(outbox, read_attempts(spark, root, number + 1))
