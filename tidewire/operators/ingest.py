"""Which messages of a feed are new: trackers, age limits, the ledger and their summaries."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.clock import at, seconds
from tidewire.operators.parse import has_content
from tidewire.operators.scale import join_dimension, settle

KEYS = ["channel", "message_id"]
STATE_TTL = 86_400
MAX_AGE = 4 * 3600
FETCH_INTERVAL = 240
AGE_BUFFER = 30
SAFE_CAP = 20


def latest_n(df: DataFrame, n: int | None, cap: int | None = SAFE_CAP) -> DataFrame:
    """The newest ``min(n, cap)`` messages of each channel; all of them where both are None.

    Spark drops all but ``n`` rows per channel before the shuffle, so a hot channel costs no more
    than a quiet one.
    """
    limit = min((x for x in (n, cap) if x is not None), default=None)
    if limit is None:
        return df
    newest = Window.partitionBy("channel").orderBy(F.desc("message_id"))
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= limit).drop("_rank")


def first_per_key(df: DataFrame, keys: list[str] = KEYS, order: str = "date") -> DataFrame:
    """One row per key, the newest; copies are dropped before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


def fresh(df: DataFrame, now, interval: int = FETCH_INTERVAL, buffer: int = AGE_BUFFER) -> DataFrame:
    """Messages of the last fetch interval, plus a buffer."""
    return df.filter(F.col("date") >= at(now) - seconds(interval + buffer))


def max_age(df: DataFrame, now, age: int = MAX_AGE) -> DataFrame:
    return df.filter(F.col("date") >= at(now) - seconds(age))


def live(state: DataFrame, now, column: str, ttl: int = STATE_TTL) -> DataFrame:
    """State rows that have not expired."""
    return state.filter(F.col(column) > at(now) - seconds(ttl))


def newer_than_tracker(df: DataFrame, last_ids: DataFrame) -> DataFrame:
    """Messages above their channel's last id; channels without one pass whole."""
    marks = last_ids.select("channel", F.col("last_id").alias("_last"))
    joined = join_dimension(df, settle(marks), ["channel"], "left")
    return joined.filter(F.col("_last").isNull() | (F.col("message_id") > F.col("_last"))).drop("_last")


def dedupe_against_ledger(df: DataFrame, ledger: DataFrame, now, ttl: int = STATE_TTL) -> DataFrame:
    """Messages without a live ledger entry."""
    return df.join(live(ledger, now, "processed_at", ttl).select(*KEYS), KEYS, "left_anti")


def archive_max_id(archive: DataFrame) -> DataFrame:
    """Highest archived id per channel; ids that are not numbers are skipped, 0 counts as none."""
    return (archive.groupBy(F.col("Channel").alias("channel"))
            .agg(F.max(F.col("Message_ID").try_cast("bigint")).alias("last_id"))
            .filter((F.col("last_id") != 0)))


def resolve_last_id(channels: DataFrame, tracker: DataFrame, archive: DataFrame, now) -> DataFrame:
    """``(channel, last_id, source)``: the live tracker, else the archive, else null.

    The archive counts only under the first country that lists the channel. It is reduced to one row
    per (country, channel) before it is joined.
    """
    first = channels.groupBy("channel").agg(F.min_by("country_code", "country_pos").alias("country_code"))
    seen = (archive.groupBy(F.col("Channel").alias("channel"), "country_code")
            .agg(F.max(F.col("Message_ID").try_cast("bigint")).alias("_archived")))
    marks = live(tracker, now, "updated_at").groupBy("channel").agg(
        F.max_by("last_id", "updated_at").alias("_tracked"))
    tracked = F.nullif("_tracked", F.lit(0))
    archived = F.nullif("_archived", F.lit(0))
    return (first.join(seen, ["channel", "country_code"], "left").join(marks, "channel", "left")
            .select("channel", F.coalesce(tracked, archived).alias("last_id"),
                    F.when(tracked.isNotNull(), "tracker").when(archived.isNotNull(), "archive").alias("source")))


def seed_tracker(last_ids: DataFrame, now) -> DataFrame:
    """Tracker rows for ids that came from the archive."""
    return last_ids.filter("source = 'archive'").select("channel", "last_id", at(now).alias("updated_at"))


def mark_fetch(df: DataFrame, last_ids: DataFrame, ledger: DataFrame, now, limit: int | None = 10,
               cap: int | None = SAFE_CAP, interval: int = FETCH_INTERVAL, age: int = MAX_AGE) -> DataFrame:
    """The messages a fetch looks at, each with its ``strategy`` and ``reason``.

    Channels with a last id are read above it and judged by the absolute age limit, the others by the
    fetch interval. The cap is applied first, so what it cuts off is not looked at; ``cap=None`` with
    ``limit=None`` looks at everything. Reasons: ``too_old``, ``service``, ``duplicate``, ``accepted``.
    """
    marks = last_ids.filter("last_id is not null").select("channel", F.col("last_id").alias("_last"))
    seen = latest_n(
        join_dimension(df, settle(marks), ["channel"], "left")
        .filter(F.col("_last").isNull() | (F.col("message_id") > F.col("_last"))), limit, cap)
    tracked = F.col("_last").isNotNull()
    cutoff = F.when(tracked, at(now) - seconds(age)).otherwise(at(now) - seconds(interval + AGE_BUFFER))
    done = live(ledger, now, "processed_at").select(*KEYS).distinct().withColumn("_done", F.lit(True))
    content = has_content(F.col("text"), F.col("media")) if "media" in df.columns else F.col("text") != ""
    return seen.join(done, KEYS, "left").select(
        *df.columns,
        F.when(tracked, "ID-based").otherwise("time-based").alias("strategy"),
        F.when(F.col("date") < cutoff, "too_old")
        .when(~F.coalesce(content, F.lit(False)), "service")
        .when(F.col("_done"), "duplicate")
        .otherwise("accepted").alias("reason"))


def accepted(marked: DataFrame) -> DataFrame:
    return marked.filter("reason = 'accepted'").drop("strategy", "reason")


def fetch_summary(marked: DataFrame) -> DataFrame:
    """Counts per channel: checked, new, duplicates, too old."""
    return marked.groupBy("channel", "strategy").agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("reason") == "accepted").alias("new"),
        F.count_if(F.col("reason") == "duplicate").alias("duplicates"),
        F.count_if(F.col("reason") == "too_old").alias("too_old"))


def next_tracker(accepted_messages: DataFrame, tracker: DataFrame, now) -> DataFrame:
    """The tracker after a fetch: the highest accepted id per channel, others unchanged."""
    moved = (accepted_messages.groupBy("channel").agg(F.max("message_id").alias("_new"))
             .filter(F.col("_new") > 0))
    return tracker.join(moved, "channel", "full_outer").select(
        "channel", F.coalesce("_new", "last_id").alias("last_id"),
        F.when(F.col("_new").isNotNull(), at(now)).otherwise(F.col("updated_at")).alias("updated_at"))


def ledger_entries(df: DataFrame, now) -> DataFrame:
    """Ledger rows for handled messages, the empty ones included."""
    return df.select("channel", F.col("message_id").cast("bigint"), at(now).alias("processed_at"))


def expire_ledger(entries: DataFrame, now, ttl: int = STATE_TTL) -> DataFrame:
    """Drop entries that are due or have no expiry; clamp later expiries to ``ttl``."""
    return (entries.filter(F.col("expires_at") > at(now))
            .withColumn("expires_at", F.least("expires_at", at(now) + seconds(ttl))))
