"""Streams with state by key, windows, observed metrics and run records, run to the end and read back as tables."""

from datetime import timedelta

from pyspark.sql import functions as F

from tidewire.operators import summary
from tidewire.operators.alerts import SYSTEM_NAME, summary_card
from tidewire.plans import bindings as b
from tidewire.plans.feed_queries import _MARKED
from tidewire.plans.registry import ORACLES, query
from tidewire.plans.stream_queries import NOW, _events, _settings
from tidewire.session import shared_dir
from tidewire.sources.feeds import read_archive
from tidewire.streaming import keyed, metrics, pipeline


@query(f"""WITH {b.TRACKER} SELECT '@user' || e.user_id AS channel, event_id AS message_id FROM events e LEFT JOIN tracker t ON t.channel = '@user' || e.user_id
WHERE t.last_id IS NULL OR event_id > t.last_id""")
def stream_high_water(spark, sf):
    """Messages above their channel's mark, kept as keyed state that begins at the tracker."""
    root = shared_dir(spark, "stream_high_water")
    feed = b.feed_of(_events(spark, sf)).select("channel", "message_id", "date")
    keyed.start_keyed(keyed.newer_stream(feed, b.tracker(spark, sf)), root).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("channel", "message_id")


@query("""SELECT event_type AS source, 20 * i AS error_number FROM (SELECT event_type, unnest(range(1, count(*) // 20 + 1)) AS i FROM events GROUP BY 1)""")
def stream_throttle_state(spark, sf):
    """Every twentieth event of a type, counted in keyed state in the order of arrival: its numbers."""
    root = shared_dir(spark, "stream_throttle_state")
    events = _events(spark, sf).select(F.col("event_type").alias("source"), "event_id")
    keyed.start_keyed(keyed.throttle_stream(events, 20), root).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("source", "error_number")


def _summarized(df):
    kind = F.col("event_type")
    return df.select(F.col("ts").alias("date"), F.col("user_id").alias("channel"),
                     kind.isin("purchase", "signup").alias("is_significant"), (kind == "error").alias("is_error"))


@query(ORACLES["daily_summary"])
def stream_daily_summary(spark, sf):
    """Each day told once it is over. A tick four days after the last event closes the last day."""
    root = shared_dir(spark, "stream_daily")
    events = b.table(spark, sf, "events")
    last = events.agg((F.max("ts") + F.expr("INTERVAL '4' DAY")).alias("ts"))
    last.select(*[F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes]).write.parquet(f"{root}/ticks")
    ticks = spark.readStream.schema(events.schema).parquet(f"{root}/ticks")
    days = summary.daily_stream(_summarized(_events(spark, sf).unionByName(ticks)), "1 hour")
    run = (days.writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
           .format("parquet").option("path", f"{root}/out").start())
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query(f"""WITH d AS ({ORACLES["daily_summary"]})
SELECT day, '📊 Daily {SYSTEM_NAME} Summary' AS title, 'Daily activity completed for ' || day AS body,
 total_messages || ' | ' || significant_messages || ' | ' || channels_monitored || ' | ' || errors_encountered || ' | ' || printf('%.1f', success_rate) || '%' AS facts FROM d""")
def stream_summary_cards(spark, sf):
    """The card of each day that a stream has told, read back from its JSON."""
    days = stream_daily_summary(spark, sf)
    cards = days.withColumn("_card", F.from_json(summary_card(days), """
        sections array<struct<activityTitle: string, text: string, facts: array<struct<name: string, value: string>>>>"""))
    section = F.element_at("_card.sections", 1)
    return cards.select("day", section["activityTitle"].alias("title"), section["text"].alias("body"),
                        F.array_join(F.transform(section["facts"], lambda f: f["value"]), " | ").alias("facts"))


@query("SELECT count(*) AS messages, count(*) FILTER (event_type IN ('view', 'error')) AS without_text FROM events")
def stream_metrics(spark, sf):
    """Counters that a stream observes, as the listener has kept them."""
    root = shared_dir(spark, "stream_metrics")
    table = metrics.ProgressTable(spark, f"{root}/progress")
    spark.streams.addListener(table)
    try:
        run = pipeline.start_metrics(b.feed_of(_events(spark, sf)), root)
        run.awaitTermination()
        if not table.wait(run):
            raise TimeoutError("the end of the stream was not told")
    finally:
        spark.streams.removeListener(table)
    count = lambda name: F.sum(F.col("observed")["intake"][name]).cast("bigint").alias(name)
    return metrics.read_progress(spark, f"{root}/progress").agg(count("messages"), count("without_text"))


_OLD = "2024-01-20"
_FROM_ARCHIVE = f"""{b.CHANNELS}, {b.ARCHIVE},
firsts AS (SELECT channel, arg_min(country_code, country_pos) AS country_code FROM channels GROUP BY 1),
seen AS (SELECT channel, country_code, max(TRY_CAST(message_id AS BIGINT)) AS archived FROM archive WHERE date < '{_OLD}' GROUP BY 1, 2),
known AS (SELECT channel, coalesce(nullif(live.last_id, 0), nullif(archived, 0)) AS last_id FROM firsts LEFT JOIN seen USING (channel, country_code) LEFT JOIN live USING (channel)),
cand AS"""
_AGAIN = (_MARKED.replace("INTERVAL 172800 SECOND", "INTERVAL 4 HOUR").replace("FROM top WHERE r <= 10", "FROM top").replace("cand AS", _FROM_ARCHIVE)
          .replace("SELECT f.*, live.last_id FROM feed f LEFT JOIN live USING (channel) WHERE live.last_id IS NULL OR f.message_id > live.last_id",
                   "SELECT f.*, known.last_id FROM feed f LEFT JOIN known USING (channel) WHERE known.last_id IS NULL OR f.message_id > known.last_id"))


@query(f"""{_AGAIN} SELECT m.channel, CAST(message_id AS VARCHAR) AS message_id, c.country_code FROM marked m JOIN channels c USING (channel)
WHERE reason = 'accepted' AND (text <> '' OR kind = 'webpage')""")
def stream_repeat_archive(spark, sf):
    """The first batch run twice where an older archive gives last ids: both runs take the same messages."""
    root = shared_dir(spark, "stream_repeat_archive")
    late = iter([NOW, NOW + timedelta(hours=5)])
    settings = _settings(spark, sf, root, clock=lambda: next(late))
    (b.archive(spark, sf).filter(F.col("Date") < _OLD).withColumn("batch_id", F.lit(-1))
     .write.partitionBy("batch_id", "country_code", "category").parquet(f"{root}/archive"))
    for _ in range(2):
        pipeline.process_batch(b.feed(spark, sf), 0, settings)
    return read_archive(spark, f"{root}/archive", "parquet").filter("batch_id >= 0").select(
        F.col("Channel").alias("channel"), F.col("Message_ID").alias("message_id"), "country_code")


@query(f"""{_MARKED.replace("INTERVAL 172800 SECOND", "INTERVAL 4 HOUR").replace("FROM top WHERE r <= 10", "FROM top")}, {b.CHANNELS},
checked AS (SELECT count(DISTINCT channel) AS n FROM channels)
SELECT 'rate_limited' AS status, n AS channels_checked, CAST(0 AS BIGINT) AS messages_processed, CAST(0 AS BIGINT) AS messages_skipped, 'handler' AS sink,
 CAST(1 AS BIGINT) AS attempt FROM checked
UNION ALL SELECT 'success', n, count(*) FILTER (reason = 'accepted' AND text || coalesce(kind, '') NOT IN ('', 'photo')),
 count(*) FILTER (reason = 'accepted' AND text || coalesce(kind, '') IN ('', 'photo')), NULL, NULL FROM marked, checked GROUP BY n""")
def stream_run_log(spark, sf):
    """A batch whose handler fails once: a record of the failed attempt and one of the successful retry."""
    root = shared_dir(spark, "stream_run_log")
    broken = [True]

    def handler(records, batch_id):
        if broken.pop() if broken else False:
            raise RuntimeError("Rate limit reached")

    settings = _settings(spark, sf, root, handler=handler)
    try:
        pipeline.process_batch(b.feed(spark, sf), 0, settings)
    except pipeline.BatchFailed:
        pipeline.process_batch(b.feed(spark, sf), 0, settings)
    return pipeline.read_run_log(spark, root).select("status", "channels_checked", "messages_processed", "messages_skipped", "sink",
                                                     F.col("attempt").cast("bigint").alias("attempt"))
