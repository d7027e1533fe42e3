"""Streams over the test tables, run to the end of the input and read back as tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.operators.ingest import live
from tidewire.operators.sinks import write_archive
from tidewire.plans import bindings as b
from tidewire.plans.feed_queries import _MARKED
from tidewire.plans.registry import query
from tidewire.plans.sink_queries import _CANON, _RECORDS, records
from tidewire.session import shared_dir
from tidewire.sources import config as cfg
from tidewire.sources.feeds import read_archive, stream_channel_feed
from tidewire.streaming import pipeline, store

NOW = datetime.fromisoformat(b.NOW)


def _events(spark, sf):
    schema = b.table(spark, sf, "events").schema
    return stream_channel_feed(spark, sf, schema, pathGlobFilter="events.parquet")


def _settings(spark, sf, root, **options):
    configs = b.configs(spark, b.FEED_CONFIG)
    # Tracker and ledger as earlier runs left them, under a batch id before the first.
    store.write_state(b.tracker(spark, sf), f"{root}/tracker", -1)
    live(b.ledger(spark, sf), NOW, "processed_at").withColumns({
        "hour": F.date_format("processed_at", "yyyyMMddHH").cast("bigint"), "v": F.lit(-1)}).write.partitionBy(
            "hour", "v").parquet(f"{root}/ledger")
    return pipeline.Settings(
        root=root, channels=b.feed_channels(spark, sf), countries=cfg.country_dim(configs),
        keywords=cfg.keyword_dim(configs), interval=4 * 86_400, **{"clock": lambda: NOW} | options)


def _run(spark, sf, name):
    root = shared_dir(spark, name)
    query_ = pipeline.start_ingest(b.feed_of(_events(spark, sf)), _settings(spark, sf, root), every=None, name=name)
    query_.awaitTermination()
    return root, query_


# The stream uses the age limit of four hours for tracked channels, and sees purchases as significant.
_STREAMED = _MARKED.replace("INTERVAL 172800 SECOND", "INTERVAL 4 HOUR").replace("FROM top WHERE r <= 10", "FROM top")
_TAKEN = f"""{_STREAMED}, {b.CHANNELS},
taken AS (SELECT m.channel, m.message_id, c.country_code, m.text, m.kind FROM marked m JOIN channels c USING (channel)
          WHERE reason = 'accepted' AND (text <> '' OR kind = 'webpage'))"""


@query(f"""{_TAKEN} SELECT channel, CAST(message_id AS VARCHAR) AS message_id, country_code, CASE WHEN kind = 'document' THEN 'significant' ELSE 'trivial' END AS category,
 CASE WHEN kind = 'document' THEN 'purchase' WHEN kind = 'webpage' THEN 'signup' ELSE '' END AS keywords FROM taken""")
def stream_ingest(spark, sf):
    """The whole pipeline on a stream of events: the archive it writes."""
    root, _ = _run(spark, sf, "stream_ingest")
    return read_archive(spark, f"{root}/archive", "parquet").select(
        F.col("Channel").alias("channel"), F.col("Message_ID").alias("message_id"), "country_code", "category",
        F.col("Keywords_Matched").alias("keywords"))


@query(f"""{_TAKEN} SELECT channel, CAST(message_id AS VARCHAR) AS message_id, country_code, CASE WHEN kind = 'document' THEN 'significant' ELSE 'trivial' END AS category FROM taken""")
def stream_repeat(spark, sf):
    """A batch run again five hours later, after everything was written: the archive is still that of the first run."""
    root = shared_dir(spark, "stream_repeat")
    late = iter([NOW, NOW + timedelta(hours=5)])
    settings = _settings(spark, sf, root, clock=lambda: next(late))
    for _ in range(2):
        pipeline.process_batch(b.feed(spark, sf), 0, settings)
    return read_archive(spark, f"{root}/archive", "parquet").select(
        F.col("Channel").alias("channel"), F.col("Message_ID").alias("message_id"), "country_code", "category")


@query(f"{_TAKEN} SELECT channel, CAST(message_id AS VARCHAR) AS message_id FROM taken")
def stream_handler(spark, sf):
    """What a handler of the user's gets of a batch."""
    root = shared_dir(spark, "stream_handler")

    def keep(records, batch_id):
        records.select("Channel", "Message_ID").write.mode("overwrite").parquet(f"{root}/handled/batch_id={batch_id}")

    pipeline.process_batch(b.feed(spark, sf), 0, _settings(spark, sf, root, handler=keep))
    return spark.read.parquet(f"{root}/handled").select(
        F.col("Channel").alias("channel"), F.col("Message_ID").cast("string").alias("message_id"))


@query(f"""{_TAKEN} SELECT 'alerts' AS sink, count(*) FILTER (kind = 'document' AND country_code = 'alpha') AS written FROM taken
UNION ALL SELECT 'feed', count(*) FROM taken
UNION ALL SELECT 'ledger', (SELECT count(*) FROM marked WHERE reason = 'accepted')
UNION ALL SELECT 'tracker', (SELECT count(*) FROM (SELECT channel FROM tracker UNION SELECT channel FROM marked WHERE reason = 'accepted'))""")
def stream_fan_out(spark, sf):
    """What one run adds to every sink and state table."""
    root, _ = _run(spark, sf, "stream_fan_out")
    parts = {
        "alerts": spark.read.parquet(f"{root}/outbox"), "feed": spark.read.parquet(f"{root}/feed"),
        "ledger": spark.read.parquet(f"{root}/ledger").filter("v >= 0"),
        "tracker": store.read_state(spark, f"{root}/tracker", 1 << 40, "channel string, last_id bigint")}
    counted = [df.agg(F.count("*").alias("written")).select(F.lit(n).alias("sink"), "written") for n, df in parts.items()]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out


@query("SELECT '@user' || user_id AS channel, event_id AS message_id FROM events")
def stream_dedupe(spark, sf):
    """Every message sent twice and kept once."""
    root = shared_dir(spark, "stream_dedupe")
    feed = b.feed_of(_events(spark, sf)).select("channel", "message_id", "date")
    twice = feed.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    run = (pipeline.dedupe_stream(twice).select("channel", "message_id").writeStream
           .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
           .format("parquet").option("path", f"{root}/out").start())
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("""SELECT source, event_id, error_number, '⚠️ CELERY TASK FAILED (Retrying)' AS title FROM (SELECT event_type AS source, event_id,
 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS error_number FROM events) WHERE error_number % 20 = 0""")
def stream_throttled_alerts(spark, sf):
    """Every twentieth event of a type as an admin card."""
    root = shared_dir(spark, "stream_throttle")
    empty = {c: F.lit(None).cast(t) for c, t in (
        ("module", "string"), ("stack_trace", "string"), ("impact_level", "string"), ("advice", "string"),
        ("current_value", "double"), ("threshold", "double"), ("unit", "string"), ("context", "map<string,string>"))}
    events = _events(spark, sf).select(
        F.col("event_type").alias("source"), "event_id", "ts", F.lit("task").alias("kind"),
        F.col("event_type").alias("subject"), F.lit("failed").alias("message"),
        F.col("event_id").cast("string").alias("task_id"), F.lit(1).alias("retry_count"), F.lit(3).alias("max_retries")
    ).withColumns(empty)
    pipeline.start_throttle(events, root, 20, ["ts", "event_id"]).awaitTermination()
    return spark.read.parquet(f"{root}/admin_outbox").select("source", "event_id", "error_number", "title")


@query(f"""WITH {_RECORDS} SELECT {_CANON.format(text="regexp_replace(text, chr(13) || chr(10) || '|' || chr(10) || '|' || chr(13), '<br>', 'g')")},
 country_code, lower(category) AS category FROM records""")
def archive_round_trip(spark, sf):
    """The archive written as CSV and read back."""
    root = shared_dir(spark, "archive")
    write_archive(records(spark, sf), root)
    return read_archive(spark, root)
