"""Parsing, trackers, age limits, the ledger and routing over the test tables."""

from pyspark.sql import functions as F

from tidewire.functions.fixed import NOTIFY_EVERY
from tidewire.operators import ingest, parse, routing, zones
from tidewire.operators.summary import daily_summary as summarize
from tidewire.operators.summary import every_nth, run_log
from tidewire.operators.summary import resource_warnings as warn
from tidewire.plans import bindings as b
from tidewire.plans.registry import query
from tidewire.session import shared_dir
from tidewire.sources import feeds

NOW = b.NOW
TWO_DAYS = 2 * 86_400

_PARSED = f"""WITH {b.FEED}
SELECT message_id AS "Message_ID", channel AS "Channel", 'https://t.me/user' || user_id || '/' || message_id AS "Message_URL",
 strftime(date, '%Y-%m-%d') AS "Date", strftime(date, '%H:%M:%S') AS "Time", AUTHOR AS "Author",
 text || CASE WHEN kind = 'webpage' THEN chr(10) || chr(10) || 'URL: ' || site ELSE '' END AS "Message_Text",
 coalesce(kind, 'text') AS "Message_Type", FORWARD AS "Forward_From",
 CASE WHEN kind = 'document' AND value > 20 THEN 'video' WHEN kind = 'document' AND value > 5 THEN 'audio' ELSE coalesce(kind, '') END AS "Media_Type",
 '2024-01-31 08:00:00' AS "Processed_Date"
FROM feed WHERE text <> '' OR kind IS NOT NULL"""

_PLAIN = (_PARSED
          .replace("AUTHOR", "CASE WHEN user_id % 3 = 0 THEN 'Editor ' || user_id WHEN user_id % 3 = 1 THEN 'User_' || user_id "
                             "WHEN user_id % 6 = 2 THEN 'Channel_' || user_id ELSE '' END")
          .replace("FORWARD", "CASE WHEN user_id % 10 = 0 THEN 'Source A' WHEN user_id % 15 = 0 THEN 'User_' || message_id "
                              "WHEN user_id % 5 = 0 AND user_id <> 0 THEN 'Channel_' || user_id ELSE '' END"))
_RICH = (_PARSED
         .replace("AUTHOR", "CASE user_id % 8 WHEN 0 THEN '@u' || user_id WHEN 4 THEN '@u' || user_id WHEN 1 THEN 'Ann Lee' WHEN 5 THEN 'Ann' ELSE 'Group' END")
         .replace("FORWARD", "CASE WHEN user_id % 10 = 0 THEN 'Source A' WHEN user_id % 15 = 0 THEN CAST(user_id AS VARCHAR) WHEN user_id % 5 = 0 THEN 'Chat' ELSE '' END"))


def _parsed(spark, sf, rich):
    return parse.parse_messages(b.feed(spark, sf), NOW, rich).drop(
        "Datetime_UTC", "Attached_Links", "AI_Category", "Keywords_Matched")


@query(_PLAIN)
def parse_messages(spark, sf):
    return _parsed(spark, sf, rich=False)


@query(_RICH)
def parse_messages_rich(spark, sf):
    return _parsed(spark, sf, rich=True)


@query(f"WITH {b.FEED} SELECT message_id, channel FROM feed WHERE text <> '' OR kind IS NOT NULL")
def drop_service(spark, sf):
    return parse.drop_service(b.feed(spark, sf)).select("message_id", "channel")


@query(f"""WITH {b.FEED}, {b.CHANNELS}
SELECT f.message_id AS id, f.channel, country_code, country_name AS "Country", text || CASE WHEN kind = 'webpage' THEN chr(10) || chr(10) || 'URL: ' || site ELSE '' END AS text
FROM feed f JOIN channels USING (channel) WHERE text <> '' OR kind IS NOT NULL""")
def processing_aliases(spark, sf):
    parsed = parse.parse_messages(b.feed(spark, sf), NOW)
    routed = routing.route_country(parsed, b.feed_channels(spark, sf))
    return parse.processing_aliases(routed).select(
        "id", "channel", "country_code", "Country", "text")


@query(f"WITH {b.FEED} SELECT message_id, channel, text FROM feed WHERE channel IN ('@user1', '@user2', '@user3')")
def read_channel_feed(spark, sf):
    """A written feed restricted to listed channels."""
    path = shared_dir(spark, "feed")
    b.feed(spark, sf).write.parquet(path)
    return feeds.read_channel_feed(spark, path, ["@user1", "@user2", "@user3"]).select("message_id", "channel", "text")


@query(f"""WITH {b.FEED} SELECT message_id, channel, text FROM feed WHERE channel = '@user7' AND contains(lower(text), 'click')
ORDER BY message_id DESC LIMIT 5""")
def search_messages(spark, sf):
    return feeds.search_messages(b.feed(spark, sf), "@user7", "CLICK", 5).select("message_id", "channel", "text")


@query("""SELECT c_custkey AS id, c_name AS title, lower(c_name) AS username, CAST(0 AS BIGINT) AS participants_count,
 CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS description, FALSE AS verified, FALSE AS restricted FROM customer""")
def channel_info(spark, sf):
    return feeds.channel_info(b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lower("c_name").alias("username"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("description")))


@query("""SELECT channel, message_id, role FROM (SELECT 'conv' || conv_id AS channel, turn AS message_id, role,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3""")
def latest_turns(spark, sf):
    turns = b.table(spark, sf, "conversations").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("channel"), F.col("turn").alias("message_id"), "role")
    return ingest.latest_n(turns, 3)


@query(f"""WITH {b.FEED} SELECT channel, message_id FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY message_id DESC) AS r FROM feed) WHERE r <= 20""")
def latest_messages(spark, sf):
    """The cap of 20 wins over a larger limit."""
    return ingest.latest_n(b.feed(spark, sf), 100).select("channel", "message_id")


@query(f"WITH {b.FEED} SELECT channel, message_id FROM feed WHERE date >= TIMESTAMP '{NOW}' - INTERVAL 86430 SECOND")
def fresh_messages(spark, sf):
    return ingest.fresh(b.feed(spark, sf), NOW, interval=86_400).select("channel", "message_id")


@query(f"WITH {b.FEED} SELECT channel, message_id FROM feed WHERE date >= TIMESTAMP '{NOW}' - INTERVAL 4 HOUR")
def max_age(spark, sf):
    return ingest.max_age(b.feed(spark, sf), NOW).select("channel", "message_id")


@query(f"""WITH {b.FEED}, {b.TRACKER} SELECT f.channel, f.message_id FROM feed f LEFT JOIN tracker t USING (channel)
WHERE t.last_id IS NULL OR f.message_id > t.last_id""")
def newer_than_tracker(spark, sf):
    return ingest.newer_than_tracker(b.feed(spark, sf), b.tracker(spark, sf)).select("channel", "message_id")


@query(f"""WITH {b.FEED}, {b.LEDGER} SELECT channel, message_id FROM feed f WHERE NOT EXISTS (
 SELECT 1 FROM ledger l WHERE l.channel = f.channel AND l.message_id = f.message_id AND l.processed_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR)""")
def dedupe_against_ledger(spark, sf):
    return ingest.dedupe_against_ledger(b.feed(spark, sf), b.ledger(spark, sf), NOW).select("channel", "message_id")


@query("""SELECT source AS channel, n_chars AS message_id, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2""")
def first_per_key(spark, sf):
    """One document per source and length: the newest."""
    docs = b.table(spark, sf, "documents").select(
        F.col("source").alias("channel"), F.col("n_chars").alias("message_id"), "doc_id")
    return ingest.first_per_key(docs, order="doc_id")


@query(f"""WITH {b.ARCHIVE} SELECT channel, max(TRY_CAST(message_id AS BIGINT)) AS last_id FROM archive GROUP BY 1 HAVING last_id IS NOT NULL AND last_id <> 0""")
def archive_max_id(spark, sf):
    return ingest.archive_max_id(b.archive(spark, sf))


_LAST_IDS = f"""{b.CHANNELS}, {b.TRACKER}, {b.ARCHIVE},
firsts AS (SELECT channel, arg_min(country_code, country_pos) AS country_code FROM channels GROUP BY 1),
seen AS (SELECT channel, country_code, max(TRY_CAST(message_id AS BIGINT)) AS archived FROM archive GROUP BY 1, 2),
live AS (SELECT channel, last_id AS tracked FROM tracker WHERE updated_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR),
last_ids AS (SELECT channel, coalesce(nullif(tracked, 0), nullif(archived, 0)) AS last_id,
   CASE WHEN nullif(tracked, 0) IS NOT NULL THEN 'tracker' WHEN nullif(archived, 0) IS NOT NULL THEN 'archive' END AS source
 FROM firsts LEFT JOIN seen USING (channel, country_code) LEFT JOIN live USING (channel))"""


def _last_ids(spark, sf):
    return ingest.resolve_last_id(b.feed_channels(spark, sf), b.tracker(spark, sf), b.archive(spark, sf), NOW)


@query(f"WITH {_LAST_IDS} SELECT channel, last_id, source FROM last_ids")
def resolve_last_id(spark, sf):
    return _last_ids(spark, sf)


@query(f"WITH {_LAST_IDS} SELECT channel, last_id, '{NOW}' AS updated_at FROM last_ids WHERE source = 'archive'")
def seed_tracker(spark, sf):
    return ingest.seed_tracker(_last_ids(spark, sf), NOW).withColumn(
        "updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


# Channels with a tracker are read above it; the others by time. Ages are wide enough to admit some of both.
_MARKED = f"""WITH {b.FEED}, {b.TRACKER}, {b.LEDGER},
live AS (SELECT channel, last_id FROM tracker WHERE updated_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR),
cand AS (SELECT f.*, live.last_id FROM feed f LEFT JOIN live USING (channel) WHERE live.last_id IS NULL OR f.message_id > live.last_id),
top AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY message_id DESC) AS r FROM cand),
marked AS (SELECT channel, message_id, date, text, kind, CASE WHEN last_id IS NOT NULL THEN 'ID-based' ELSE 'time-based' END AS strategy,
  CASE WHEN date < TIMESTAMP '{NOW}' - CASE WHEN last_id IS NOT NULL THEN INTERVAL {TWO_DAYS} SECOND ELSE INTERVAL {4 * 86_400 + 30} SECOND END THEN 'too_old'
       WHEN text = '' AND kind IS NULL THEN 'service'
       WHEN EXISTS (SELECT 1 FROM ledger l WHERE l.channel = top.channel AND l.message_id = top.message_id AND l.processed_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) THEN 'duplicate'
       ELSE 'accepted' END AS reason
 FROM top WHERE r <= 10)"""


def marked_feed(spark, sf):
    live = ingest.live(b.tracker(spark, sf), NOW, "updated_at").select("channel", "last_id")
    return ingest.mark_fetch(b.feed(spark, sf), live, b.ledger(spark, sf), NOW, limit=10,
                             interval=4 * 86_400, age=TWO_DAYS)


@query(f"{_MARKED} SELECT channel, message_id, strategy, reason FROM marked")
def fetch_decisions(spark, sf):
    return marked_feed(spark, sf).select("channel", "message_id", "strategy", "reason")


@query(f"""{_MARKED} SELECT channel, strategy, count(*) AS checked, count(*) FILTER (reason = 'accepted') AS new,
 count(*) FILTER (reason = 'duplicate') AS duplicates, count(*) FILTER (reason = 'too_old') AS too_old FROM marked GROUP BY 1, 2""")
def fetch_summary(spark, sf):
    return ingest.fetch_summary(marked_feed(spark, sf))


@query(f"""{_MARKED}, moved AS (SELECT channel, max(message_id) AS new_id FROM marked WHERE reason = 'accepted' GROUP BY 1 HAVING new_id > 0)
SELECT coalesce(t.channel, m.channel) AS channel, coalesce(new_id, last_id) AS last_id,
 CASE WHEN new_id IS NOT NULL THEN '{NOW}' ELSE strftime(updated_at, '%Y-%m-%d %H:%M:%S') END AS updated_at
FROM tracker t FULL OUTER JOIN moved m ON t.channel = m.channel""")
def next_tracker(spark, sf):
    moved = ingest.next_tracker(ingest.accepted(marked_feed(spark, sf)), b.tracker(spark, sf), NOW)
    return moved.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"{_MARKED} SELECT channel, message_id, '{NOW}' AS processed_at FROM marked WHERE reason = 'accepted'")
def mark_processed(spark, sf):
    """Ledger entries of everything a fetch took, the empty messages included."""
    rows = ingest.ledger_entries(ingest.accepted(marked_feed(spark, sf)), NOW)
    return rows.withColumn("processed_at", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""{_MARKED}, {b.CHANNELS} SELECT 'success' AS status, '2024-01-31T00:00:00' AS timestamp, (SELECT count(DISTINCT channel) FROM channels) AS channels_checked,
 count(*) FILTER (reason = 'accepted' AND text || coalesce(kind, '') NOT IN ('', 'photo')) AS messages_processed,
 count(*) FILTER (reason = 'accepted' AND text || coalesce(kind, '') IN ('', 'photo')) AS messages_skipped FROM marked""")
def fetch_run_log(spark, sf):
    marked = marked_feed(spark, sf)
    empty = parse.append_webpage_url(F.col("text"), F.col("media")) == ""
    return run_log(marked.withColumn("empty", empty), NOW, b.feed_channels(spark, sf))


@query(f"WITH {b.FEED}, {b.TRACKER} SELECT f.channel, message_id FROM feed f LEFT JOIN tracker t USING (channel) WHERE last_id IS NULL OR message_id > last_id")
def bounded_scan(spark, sf):
    """A feed written by channel and id, and read above the tracker by the zones of its files."""
    path = shared_dir(spark, "clustered")
    zones.write_clustered(b.feed(spark, sf), path)
    return zones.read_above(spark, path, b.tracker(spark, sf)).select("channel", "message_id")


@query(f"WITH {b.FEED}, {b.CHANNELS} SELECT f.channel, message_id, country_code, country_name FROM feed f JOIN channels USING (channel)")
def route_country(spark, sf):
    return routing.route_country(b.feed(spark, sf), b.feed_channels(spark, sf)).select(
        "channel", "message_id", "country_code", "country_name")


@query(f"WITH {b.CHANNELS} SELECT channel FROM channels")
def union_channels(spark, sf):
    return routing.union_channels(b.feed_channels(spark, sf))


@query(f"WITH {b.ARCHIVE} SELECT channel AS \"Channel\", message_id AS \"Message_ID\", date AS \"Date\", country_code, category FROM archive")
def union_archives(spark, sf):
    whole = b.archive(spark, sf)
    return feeds.union_archives(whole.filter("category = 'significant'"), whole.filter("category = 'trivial'"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total_messages, count(*) FILTER (event_type IN ('purchase', 'signup')) AS significant_messages,
 count(DISTINCT user_id) AS channels_monitored, count(*) FILTER (event_type = 'error') AS errors_encountered,
 round((count(*) - count(*) FILTER (event_type = 'error')) / greatest(count(*), 1) * 100, 1) AS success_rate FROM events GROUP BY 1""")
def daily_summary(spark, sf):
    e = b.table(spark, sf, "events").select(
        F.col("ts").alias("date"), F.col("user_id").alias("channel"),
        F.col("event_type").isin("purchase", "signup").alias("is_significant"), (F.col("event_type") == "error").alias("is_error"))
    return summarize(e)


@query("""SELECT source, event_id, error_number FROM (SELECT event_type AS source, event_id,
 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS error_number FROM events) WHERE error_number % 10 = 0""")
def every_tenth_error(spark, sf):
    """Every tenth event of a type; a type may hold most of the rows."""
    e = b.table(spark, sf, "events").select(F.col("event_type").alias("source"), "event_id", "ts")
    return every_nth(e, 10, ["ts", "event_id"]).select("source", "event_id", "error_number")


@query("""SELECT source, event_id, error_number FROM (SELECT CASE event_type WHEN 'error' THEN 'fetch' WHEN 'click' THEN 'sheet' WHEN 'view' THEN 'files' ELSE 'other' END AS source, event_id,
 row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS error_number FROM events)
WHERE error_number % CASE source WHEN 'fetch' THEN 10 WHEN 'sheet' THEN 3 WHEN 'files' THEN 5 END = 0""")
def notified_errors(spark, sf):
    """The errors each source reports at its own rate; other sources report none."""
    kind = F.col("event_type")
    e = b.table(spark, sf, "events").select(
        F.when(kind == "error", "fetch").when(kind == "click", "sheet").when(kind == "view", "files")
        .otherwise("other").alias("source"), "event_id", "ts")
    return every_nth(e, NOTIFY_EVERY, ["ts", "event_id"]).select("source", "event_id", "error_number")


@query("""SELECT event_id, resource, value, threshold, round((value - threshold) / threshold * 100, 6) AS excess FROM (
 SELECT event_id, value, CASE event_type WHEN 'click' THEN 'memory' WHEN 'view' THEN 'swap' WHEN 'error' THEN 'disk' ELSE 'cpu' END AS resource,
  CASE event_type WHEN 'click' THEN 80.0::DOUBLE WHEN 'view' THEN 50.0::DOUBLE WHEN 'error' THEN 80.0::DOUBLE END AS threshold FROM events) WHERE value > threshold""")
def resource_warnings(spark, sf):
    kind = F.col("event_type")
    readings = b.table(spark, sf, "events").select("event_id", "value", F.when(kind == "click", "memory").when(
        kind == "view", "swap").when(kind == "error", "disk").otherwise("cpu").alias("resource"))
    return warn(readings).withColumn("excess", F.round("excess", 6))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'Channel_' || user_id ELSE '@user' || user_id END AS channel FROM events""")
def channel_or_id(spark, sf):
    e = b.table(spark, sf, "events")
    named = F.when(F.col("event_type") != "view", F.concat(F.lit("@user"), F.col("user_id").cast("string")))
    return e.select("event_id", feeds.channel_or_id(named, F.col("user_id")).alias("channel"))
