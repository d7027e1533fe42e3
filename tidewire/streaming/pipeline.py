"""The message pipeline on a stream: ingest, classify, translate, fan out."""

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire import schemas
from tidewire.functions.fixed import NOTIFY_EVERY
from tidewire.operators import ingest
from tidewire.operators.classify import classify, label, load_keywords
from tidewire.operators.parse import append_webpage_url, parse_messages, processing_aliases, split_empty_text
from tidewire.operators.project import next_row
from tidewire.operators.providers import additional_criteria, ai_classify, error_events, provider_errors, translate
from tidewire.operators.routing import route_country
from tidewire.operators.sinks import admin_alert_rows, alert_rows, feed_rows, write_archive
from tidewire.operators.summary import failure_log, run_log
from tidewire.sources.feeds import channel_or_id, read_archive
from tidewire.streaming import store

FEED_STATE = "country_code string, sheet string, next_row bigint"
ARCHIVE_STATE = "Channel string, country_code string, Message_ID bigint"
ERROR_STATE = "source string, errors bigint"
UNKNOWN = "unknown"
ERRORS = "_errors"
RUN_LOG = "status string, timestamp string, channels_checked bigint, messages_processed bigint, messages_skipped bigint"


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass
class Settings:
    """Dimensions, folder and options of a running pipeline."""

    root: str
    channels: DataFrame
    countries: DataFrame
    keywords: DataFrame
    limit: int | None = None  # a limit or cap is for sources that need it: the tracker moves past what it cuts off
    cap: int | None = None
    interval: int = ingest.FETCH_INTERVAL
    model: Callable | None = None
    translator: Callable | None = None
    service: Callable | None = None
    clock: Callable[[], datetime] = utc_now
    archive_format: str = "parquet"
    handler: Callable[[DataFrame, int], None] | None = None
    keyword_rows: list | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        """Read the dimensions once, not in every batch."""
        self.channels, self.countries = self.channels.persist(), self.countries.persist()
        if self.keyword_rows is None:
            self.keyword_rows = load_keywords(self.keywords)


def max_archived(archive: DataFrame) -> DataFrame:
    """Highest archived id per channel and country. Kept as state, so that only the first batch reads
    the archive itself."""
    return archive.groupBy("Channel", "country_code").agg(
        F.max(F.col("Message_ID").try_cast("bigint")).alias("Message_ID"))


def enrich(parsed: DataFrame, s: Settings, now) -> DataFrame:
    """Classification, model checks, translation and labels of parsed messages with text."""
    # Messages of channels that no country lists stay in the run, under the country that the archive has for them.
    routed = route_country(parsed, s.channels, "left").withColumn("country_code", F.coalesce("country_code", F.lit(UNKNOWN)))
    named = processing_aliases(routed)
    done = classify(named, s.keywords, keys=["Channel", "Message_ID", "country_code"],
                    rows=s.keyword_rows)
    if s.model is not None:
        done = additional_criteria(done, s.countries, s.model, errors=ERRORS)
        done = ai_classify(done, s.countries, s.keywords, s.model, errors=ERRORS)
    return label(translate(done, s.countries, s.translator, s.service, errors=ERRORS), now)


class BatchFailed(RuntimeError):
    """What failed in a batch, by sink."""

    def __init__(self, batch_id: int, failures: dict[str, Exception]) -> None:
        super().__init__(f"batch {batch_id}: " + "; ".join(f"{k}: {e}" for k, e in failures.items()))
        self.failures = failures


def process_batch(batch: DataFrame, batch_id: int, s: Settings) -> None:
    """One batch, end to end. Running it again for the same id, however late, gives the same tables.

    Every sink is tried even if another one fails. The failures are raised afterwards, so the batch
    is repeated, and the ledger and the tracker move only when all sinks have it. Each failed attempt leaves one
    record of its own; the record of a success is written last.
    """
    spark = batch.sparkSession
    now = store.batch_time(spark, f"{s.root}/clock", batch_id, s.clock)
    # Streams switch adaptive execution off. The joins and writes of a batch keep no state and need it.
    with adaptive(spark):
        try:
            _process(spark, batch, batch_id, s, now)
        except Exception as error:
            failures = error.failures if isinstance(error, BatchFailed) else {"batch": error}
            record_failure(spark, s, batch_id, failures)
            raise


def record_failure(spark: SparkSession, s: Settings, batch_id: int, failures: dict[str, Exception]) -> None:
    """One row for a failed attempt: the sinks that failed, their errors and the status of the first."""
    folder = f"{s.root}/run_failures/batch_id={batch_id}"
    attempt = len(store.children(spark, folder)) + 1
    texts = [f"{sink}: {error}" for sink, error in failures.items()]
    row = spark.createDataFrame([(", ".join(failures), "; ".join(texts), str(next(iter(failures.values()))))],
                                "sink string, error string, _first string")
    (failure_log(row, s.clock(), s.channels).coalesce(1).write.mode("overwrite").parquet(f"{folder}/attempt={attempt}"))


def read_run_log(spark: SparkSession, root: str) -> DataFrame:
    """Records of all runs, successful and failed: one for each success, one for each failed attempt."""
    frames = [spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
              for name, schema in (("run_log", RUN_LOG), ("run_failures", f"{RUN_LOG}, sink string, error string, attempt int"))
              if store.children(spark, f"{root}/{name}")]
    out = spark.createDataFrame([], f"{RUN_LOG}, batch_id int, sink string, error string, attempt int")
    for frame in frames:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


@contextmanager
def adaptive(spark: SparkSession):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def _process(spark: SparkSession, batch: DataFrame, batch_id: int, s: Settings, now: datetime) -> None:
    tracker = store.read_state(spark, f"{s.root}/tracker", batch_id, schemas.TRACKER)
    ledger = store.read_ledger(spark, f"{s.root}/ledger", batch_id, now)
    archived = store.read_state(spark, f"{s.root}/archive_ids", batch_id, ARCHIVE_STATE)
    if not any(v < batch_id for v in store.versions(spark, f"{s.root}/archive_ids")):  # a rerun does not see its own
        archive = read_archive(spark, f"{s.root}/archive", s.archive_format)
        if "batch_id" in archive.columns:
            archive = archive.filter(F.col("batch_id") < batch_id)  # not what a failed run of this batch left
        archived = max_archived(archive)
    last_ids = ingest.resolve_last_id(s.channels, tracker, archived, now)
    marked = ingest.mark_fetch(ingest.first_per_key(named_channels(batch)), last_ids, ledger, now, s.limit, s.cap, s.interval)
    marked = marked.persist(StorageLevel.MEMORY_AND_DISK)
    taken = ingest.accepted(marked)
    parsed = parse_messages(taken, now)
    full, _ = split_empty_text(parsed)
    # Written once and read by every sink: model and translation calls are not repeated, whatever is lost.
    staged = f"{s.root}/staged/batch_id={batch_id}"
    enrich(full, s, now).write.mode("overwrite").parquet(staged)
    written = spark.read.parquet(staged)
    records = written.drop(ERRORS)
    free = store.read_state(spark, f"{s.root}/feed_rows", batch_id, FEED_STATE)
    here = f"batch_id={batch_id}"

    def write_feed() -> None:
        rows = feed_rows(records, s.countries, free, ["Date", "Time", "Channel", "Message_ID"], stage=False)
        rows.write.mode("overwrite").parquet(f"{s.root}/feed/{here}")
        used = next_row(spark.read.parquet(f"{s.root}/feed/{here}"))
        merged = free.unionByName(used).groupBy("country_code", "sheet").agg(F.max("next_row").alias("next_row"))
        store.write_state(merged, f"{s.root}/feed_rows", batch_id)

    sinks = {
        "alerts": lambda: alert_rows(records, s.countries).write.mode("overwrite").parquet(f"{s.root}/outbox/{here}"),
        "feed": write_feed,
        "archive": lambda: write_archive(records, f"{s.root}/archive/{here}", s.archive_format, mode="overwrite"),
        "errors": lambda: write_errors(written, batch_id, s.root, now),
        "fetch_log": lambda: ingest.fetch_summary(marked).withColumn("run_at", ingest.at(now))
        .write.mode("overwrite").parquet(f"{s.root}/fetch_log/{here}"),
    }
    if s.handler is not None:
        sinks["handler"] = lambda: s.handler(records, batch_id)
    failures = {}
    try:
        for name, write in sinks.items():
            try:
                write()
            except Exception as error:
                failures[name] = error
        if not failures:
            store.write_state(max_archived(archived.unionByName(max_archived(records))),
                              f"{s.root}/archive_ids", batch_id)
            store.write_state(ingest.next_tracker(taken, tracker, now), f"{s.root}/tracker", batch_id)
            store.write_ledger(ingest.ledger_entries(taken, now), f"{s.root}/ledger", batch_id, now)
            run_log(marked.withColumn("empty", append_webpage_url(F.col("text"), F.col("media")) == ""), now, s.channels).write.mode(
                "overwrite").parquet(f"{s.root}/run_log/{here}")
            store.remove(spark, staged)
            store.drop_expired_hours(spark, f"{s.root}/ledger", now)
    finally:
        marked.unpersist()
    if failures:
        raise BatchFailed(batch_id, failures)


def write_errors(records: DataFrame, batch_id: int, root: str, now: datetime) -> None:
    """The errors of the backends as a table, and a card for as many of them as their source asks for."""
    failed = provider_errors(records, ERRORS, ["channel", "message_id"])
    failed.write.mode("overwrite").parquet(f"{root}/backend_errors/batch_id={batch_id}")
    events = error_events(records.sparkSession.read.schema(failed.schema).parquet(f"{root}/backend_errors/batch_id={batch_id}"), ingest.at(now))
    throttle_batch(events, batch_id, root, NOTIFY_EVERY, ["channel", "message_id", "error"])


def named_channels(batch: DataFrame) -> DataFrame:
    """A message without a channel name gets one made of its chat's id, where it has one."""
    return batch.withColumn("channel", channel_or_id(F.col("channel"), F.col("from_id.channel_id")))


def intake_metrics(stream: DataFrame, name: str = "intake") -> DataFrame:
    """Counts per trigger, found in the query's progress under ``observedMetrics``; ``metrics.ProgressTable`` keeps them."""
    return stream.observe(name, F.count(F.lit(1)).alias("messages"),
                          F.count_if(F.coalesce("text", F.lit("")) == "").alias("without_text"))


def start_metrics(stream: DataFrame, root: str, every: str | None = None) -> StreamingQuery:
    """Observe a stream that goes nowhere else."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (intake_metrics(stream).writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger)
            .format("noop").start())


def start_ingest(stream: DataFrame, s: Settings, every: str | None = "240 seconds",
                 name: str = "ingest") -> StreamingQuery:
    """Run the pipeline on a stream: on a timer, or over what is there now with ``every=None``."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (intake_metrics(stream).writeStream.queryName(name)
            .option("checkpointLocation", f"{s.root}/checkpoint")
            .trigger(**trigger)
            .foreachBatch(lambda batch, batch_id: process_batch(batch, batch_id, s)).start())


def dedupe_stream(stream: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Drop repeats of (channel, message_id) within ``ttl`` of the batch that first read them.

    Like the ledger in ``process_batch`` this counts from the reading, not from the message's own date, so an old
    message that comes late is never taken for an expired one. A repeated batch has the time of its first run.
    """
    timed = stream.withColumn("_read_at", F.current_timestamp())
    return (timed.withWatermark("_read_at", ttl)
            .dropDuplicatesWithinWatermark(["channel", "message_id"]).drop("_read_at"))


def throttle_batch(events: DataFrame, batch_id: int, root: str, n: int | dict[str, int], order: list[str]) -> None:
    """Every ``n``-th event of each source to the admin outbox, counted across batches."""
    spark = events.sparkSession
    earlier = store.read_state(spark, f"{root}/error_counts", batch_id, ERROR_STATE)
    admin_alert_rows(events, n, order, earlier=earlier).write.mode("overwrite").parquet(
        f"{root}/admin_outbox/batch_id={batch_id}")
    counts = events.groupBy("source").agg(F.count("*").alias("errors"))
    total = earlier.unionByName(counts).groupBy("source").agg(F.sum("errors").alias("errors"))
    store.write_state(total, f"{root}/error_counts", batch_id)


def start_throttle(events: DataFrame, root: str, n: int, order: list[str], every: str | None = None) -> StreamingQuery:
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (events.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger)
            .foreachBatch(lambda batch, batch_id: throttle_batch(batch, batch_id, root, n, order)).start())
