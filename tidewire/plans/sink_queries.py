"""Archive, sheet feed, outbox and retention over the test tables."""

from pyspark.sql import functions as F

from tidewire.functions import clock, lookups
from tidewire.functions.fixed import EXCLUDED_FIELDS, MESSAGE_FIELDS
from tidewire.functions.text import escape_formula, flatten_newlines, join_keywords
from tidewire.operators import ingest, project, retention, routing, sinks, summary
from tidewire.operators.classify import label
from tidewire.operators.parse import message_url
from tidewire.plans import bindings as b
from tidewire.plans.message_queries import classified
from tidewire.plans.registry import query
from tidewire.session import shared_dir
from tidewire.sources.logs import parse_logs
from tidewire.sources.logs import read_logs as read_log_files

NOW = b.NOW
SHEET_NOW, SHEET_DAYS = "1998-06-15 03:00:00", 30
CSV_NOW, CSV_DAYS = "1997-01-10 12:00:00", 7


def records(spark, sf):
    """Classified messages in canonical columns."""
    done = label(classified(spark, sf), NOW)
    return done.select(
        F.col("message_id").alias("Message_ID"), F.col("channel").alias("Channel"),
        message_url(F.col("channel"), F.col("message_id")).alias("Message_URL"),
        clock.date_text(F.col("date")).alias("Date"), clock.time_text(F.col("date")).alias("Time"),
        F.col("text").alias("Message_Text"), "AI_Category", "AI_Reasoning", "Keywords_Matched",
        F.lit(False).alias("Was_Translated"), "country_code", "is_significant")


_RECORDS = b.CLASSIFIED + """,
records AS (
  SELECT message_id, channel, 'https://t.me/' || ltrim(channel, '@') || '/' || message_id AS url, strftime(date, '%Y-%m-%d') AS day,
         strftime(date, '%H:%M:%S') AS tod, text, CASE WHEN is_significant THEN 'Significant' ELSE 'Trivial' END AS category,
         'Classified as ' || CASE WHEN is_significant THEN 'significant' ELSE 'trivial' END || ' using ' || method AS reasoning,
         keywords, country_code, is_significant
  FROM classified)"""
_CANON = """CAST(message_id AS VARCHAR) AS "Message_ID", channel AS "Channel", url AS "Message_URL", '' AS "Country", day AS "Date", tod AS "Time",
 '' AS "Author", {text} AS "Message_Text", '' AS "Attached_Links", category AS "AI_Category", reasoning AS "AI_Reasoning", keywords AS "Keywords_Matched",
 '' AS "Message_Type", '' AS "Forward_From", '' AS "Media_Type", '' AS "Original_Text", '' AS "Original_Language", 'False' AS "Was_Translated", '' AS "Processed_Date" """


@query(f"WITH {_RECORDS} SELECT {_CANON.format(text='text')} FROM records")
def canonical_projection(spark, sf):
    return project.canonical_projection(records(spark, sf))


@query(f"""WITH {_RECORDS} SELECT {_CANON.format(text="regexp_replace(text, chr(13) || chr(10) || '|' || chr(10) || '|' || chr(13), '<br>', 'g')")},
 country_code, lower(category) AS category FROM records""")
def archive_rows(spark, sf):
    return sinks.archive_rows(records(spark, sf))


@query(f"""WITH {_RECORDS} SELECT country_code, lower(category) AS category, count(*) AS messages FROM records GROUP BY ALL""")
def route_split(spark, sf):
    """The two sides of the split, counted."""
    yes, no = routing.route_split(records(spark, sf))
    return routing.with_category(yes).unionByName(routing.with_category(no)).groupBy("country_code", "category").agg(
        F.count("*").alias("messages"))


_FIELD_SQL = {"Message_ID": "CAST(message_id AS VARCHAR)", "Channel": "'''' || channel", "Message_URL": "url", "Date": "day", "Time": "tod",
              "Message_Text": "text", "Attached_Links": "''", "AI_Reasoning": "reasoning", "Keywords_Matched": "keywords",
              "Original_Text": "''", "Original_Language": "''"}
_CELLS = " || chr(31) || ".join(_FIELD_SQL[f] for f in MESSAGE_FIELDS if f not in EXCLUDED_FIELDS)


@query(f"""WITH {_RECORDS}, placed AS (SELECT *, CASE country_code WHEN 'alpha' THEN category ELSE CASE category WHEN 'Significant' THEN 'Major' ELSE 'Trivial' END END AS sheet,
  CASE country_code WHEN 'alpha' THEN '/Telegram_Feeds/alpha_Telegram_Feed.xlsx' ELSE '/Feeds/beta_Telegram_Feed.xlsx' END AS feed_path FROM records),
numbered AS (SELECT *, 1 + row_number() OVER (PARTITION BY country_code, sheet ORDER BY message_id) AS row_index FROM placed)
SELECT country_code, feed_path, sheet, row_index, 'A' || row_index || ':K' || row_index AS address, md5({_CELLS}) AS cells FROM numbered""")
def feed_rows(spark, sf):
    """Sheet rows with position and address; there are only four sheets, so each is numbered in parts."""
    free = spark.createDataFrame([], "country_code string, sheet string, next_row bigint")
    rows = sinks.feed_rows(records(spark, sf), b.countries(spark), free, ["message_id"])
    return rows.withColumn("cells", F.md5(F.array_join("cells", "\x1f")))


@query(f"""WITH {_RECORDS} SELECT country_code, channel, message_id, 'alert' AS sink, 'https://hooks.example.com/alpha' AS alert_target, CAST(0 AS BIGINT) AS attempts
FROM records WHERE is_significant AND country_code = 'alpha'""")
def alert_outbox(spark, sf):
    return sinks.alert_rows(records(spark, sf), b.countries(spark)).select(
        "country_code", F.col("channel").alias("channel"), F.col("message_id").alias("message_id"), "sink", "alert_target", F.col("attempts").cast("bigint").alias("attempts"))


@query(f"""WITH {_RECORDS} SELECT message_id, CASE country_code WHEN 'alpha' THEN 'https://hooks.example.com/alpha' END AS alert_target,
 CASE country_code WHEN 'alpha' THEN 'Alpha' ELSE 'Beta' END || ' Telegram Alerts' AS alert_channel,
 CASE WHEN country_code = 'beta' AND is_significant THEN 'Major' ELSE category END AS sheet FROM records""")
def sink_lookup(spark, sf):
    return routing.sink_lookup(records(spark, sf), b.countries(spark)).select(
        F.col("message_id").alias("message_id"), "alert_target", "alert_channel", "sheet")


@query("""WITH rows AS (SELECT o_orderstatus AS country_code, 'S' AS sheet, o_orderkey, CAST(o_orderkey AS VARCHAR) || chr(31) || coalesce(o_orderpriority, '') || chr(31) AS cells FROM orders)
SELECT country_code, sheet, 1 + row_number() OVER (PARTITION BY country_code ORDER BY o_orderkey) AS row_index, cells FROM rows
UNION ALL SELECT DISTINCT o_orderstatus, 'S', CAST(1 AS BIGINT), 'o_orderkey' || chr(31) || 'o_orderpriority' || chr(31) || 'missing' FROM orders""")
def to_matrix(spark, sf):
    o = b.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("country_code"), F.lit("S").alias("sheet"), "o_orderkey", "o_orderpriority")
    m = project.to_matrix(o, ["o_orderkey", "o_orderpriority", "missing"], ["o_orderkey"])
    return m.withColumn("cells", F.array_join("cells", "\x1f"))


@query("""SELECT doc_id, regexp_replace(text, chr(13) || chr(10) || '|' || chr(10) || '|' || chr(13), '<br>', 'g') AS flat,
 CASE WHEN starts_with(text, '@') THEN '''' || text ELSE text END AS escaped,
 CASE WHEN starts_with('@' || source, '@') THEN '''' || '@' || source END AS channel, lang || ', ' || source AS joined FROM documents""")
def cell_forms(spark, sf):
    return b.table(spark, sf, "documents").select(
        "doc_id", flatten_newlines(F.col("text")).alias("flat"), escape_formula(F.col("text")).alias("escaped"),
        escape_formula(F.concat(F.lit("@"), "source")).alias("channel"),
        join_keywords(F.array("lang", "source")).alias("joined"))


@query("""SELECT o_orderstatus AS country_code, 'S' || (o_orderkey % 3) AS sheet, greatest(max(o_orderkey % 50) + 1, 2) AS next_row FROM orders GROUP BY 1, 2""")
def next_row(spark, sf):
    s = b.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("country_code"), F.concat(F.lit("S"), (F.col("o_orderkey") % 3).cast("string")).alias("sheet"),
        (F.col("o_orderkey") % 50).alias("row_index"))
    return project.next_row(s)


@query("""WITH n AS (SELECT p_partkey, p_size, 1 + p_partkey % 800 AS w FROM part),
l AS (SELECT *, CASE WHEN w <= 26 THEN chr(CAST(64 + w AS INT)) WHEN w <= 702 THEN chr(CAST(64 + (w - 1) // 26 AS INT)) || chr(CAST(65 + (w - 1) % 26 AS INT))
  ELSE 'A' || chr(CAST(65 + (w - 703) // 26 AS INT)) || chr(CAST(65 + (w - 703) % 26 AS INT)) END AS letters FROM n)
SELECT p_partkey, 'A' || p_size || ':' || letters || (p_size + 2) AS address FROM l""")
def a1_range(spark, sf):
    p = b.table(spark, sf, "part")
    return p.select("p_partkey", lookups.a1_range(F.col("p_size"), 1 + F.col("p_partkey") % 800, F.lit(3)).alias("address"))


@query("""SELECT c_custkey, least(180 * power(2, c_custkey % 6), 900)::BIGINT AS feed_delay, (600 * power(2, c_custkey % 3))::BIGINT AS cleanup_delay,
 CASE c_custkey % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'permanent' WHEN 2 THEN 'permanent' ELSE CASE WHEN c_custkey % 4 >= 3 THEN 'failed' ELSE 'retry' END END AS outcome,
 round(CASE WHEN c_acctbal > 0 THEN (5000 - c_acctbal) / c_acctbal * 100 ELSE 0 END, 4) AS excess,
 CASE c_custkey % 4 WHEN 0 THEN '🇮🇶' WHEN 1 THEN '🇵🇭' WHEN 2 THEN '🇮🇩' ELSE '🌏' END AS flag,
 CASE c_custkey % 5 WHEN 0 THEN '28a745' WHEN 1 THEN 'ffc107' WHEN 2 THEN 'dc3545' ELSE '17a2b8' END AS color,
 CASE c_custkey % 5 WHEN 0 THEN '🟡' WHEN 1 THEN '🟠' WHEN 3 THEN '🚨' ELSE '🔴' END AS impact FROM customer""")
def delivery_rules(spark, sf):
    """Retry delays, outcomes, threshold excess and fixed lookups, per customer."""
    key = F.col("c_custkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (key % n + 1).cast("int"))
    return b.table(spark, sf, "customer").select(
        "c_custkey", lookups.retry_delay(key % 6).alias("feed_delay"),
        lookups.retry_delay(key % 3, 600, None).alias("cleanup_delay"),
        lookups.delivery_outcome(pick(7, 200, 403, 404, 401, 429, 500, None), key % 4).alias("outcome"),
        F.round(lookups.resource_excess(F.lit(5000.0), F.col("c_acctbal")), 4).alias("excess"),
        lookups.country_flag(pick(4, "Iraq", "Philippines", "Indonesia", "Elsewhere")).alias("flag"),
        lookups.severity_color(pick(5, "GOOD", "warning", "Attention", "info", "other")).alias("color"),
        lookups.impact_emoji(pick(5, "LOW", "MEDIUM", "HIGH", "CRITICAL", "?")).alias("impact"))


_DAY = """CASE form WHEN '1' THEN CAST(day AS VARCHAR) WHEN '2' THEN CAST(day AS VARCHAR) WHEN '3' THEN CAST(day AS VARCHAR)
 WHEN '4' THEN CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(day AS VARCHAR) END END"""
_CUTOFF = "1998-05-16"


@query(f"WITH {b.SHEET} SELECT o_orderkey, cell, {_DAY} AS day FROM sheet WHERE NOT blank")
def normalize_sheet_date(spark, sf):
    s = b.sheet(spark, sf).filter((F.col("row_index") > 1) & (F.element_at("cells", 1) != ""))
    cell = F.element_at("cells", 2)
    return s.select(F.element_at("cells", 1).try_cast("bigint").alias("o_orderkey"), cell.alias("cell"),
                    clock.normalize_sheet_date(cell).alias("day"))


@query(f"""WITH {b.SHEET} SELECT country_code, sheet, row_index FROM sheet WHERE {_DAY} IS NULL OR {_DAY} >= '{_CUTOFF}'
UNION ALL SELECT DISTINCT country_code, sheet, CAST(1 AS BIGINT) FROM sheet""")
def retain_sheet(spark, sf):
    return retention.retain_sheet(b.sheet(spark, sf), SHEET_NOW, SHEET_DAYS).select("country_code", "sheet", "row_index")


@query(f"""WITH {b.SHEET}, last AS (SELECT country_code, sheet, max(row_index) AS m FROM sheet WHERE NOT blank GROUP BY 1, 2)
SELECT country_code, sheet, row_index FROM sheet JOIN last USING (country_code, sheet) WHERE blank AND row_index < m""")
def interior_blank_rows(spark, sf):
    return retention.interior_blank_rows(b.sheet(spark, sf)).select("country_code", "sheet", "row_index")


@query(f"""WITH {b.SHEET}, last AS (SELECT country_code, sheet, max(row_index) AS m FROM sheet WHERE NOT blank GROUP BY 1, 2),
kept AS (SELECT country_code, sheet, row_index AS old, CASE WHEN blank THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS first_cell FROM sheet JOIN last USING (country_code, sheet) WHERE NOT blank OR row_index > m
  UNION ALL SELECT DISTINCT country_code, sheet, 1, 'Id' FROM sheet)
SELECT country_code, sheet, row_number() OVER (PARTITION BY country_code, sheet ORDER BY old) AS row_index, first_cell FROM kept""")
def compact_sheet(spark, sf):
    return retention.compact_sheet(b.sheet(spark, sf)).select(
        "country_code", "sheet", "row_index", F.element_at("cells", 1).alias("first_cell"))


_CSV_DATE = """CASE l_linenumber % 5 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN '2' || substr(strftime(l_shipdate, '%Y-%m-%d'), 2)
 WHEN 2 THEN '"20' || substr(strftime(l_shipdate, '%Y-%m-%d'), 3) || '"' WHEN 3 THEN '2025-02-31' ELSE 'n/a' END"""
_MOVED_NOW, _MOVED_DAYS = "2096-06-10 12:00:00", 7


def _csv(spark, sf):
    """Line items as archive rows whose dates are plain, moved by a thousand years or quoted, impossible or missing."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    form = F.col("l_linenumber") % 5
    return b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.when(form == 0, day).when(form == 1, F.concat(F.lit("2"), day.substr(F.lit(2), F.lit(9))))
        .when(form == 2, F.concat(F.lit('"20'), day.substr(F.lit(3), F.lit(8)), F.lit('"')))
        .when(form == 3, "2025-02-31").otherwise("n/a").alias("Date"))


_CSV = f"""WITH csv AS (SELECT l_orderkey, l_linenumber, l_returnflag, {_CSV_DATE} AS date FROM lineitem),
marked AS (SELECT *, replace(date, '"', '') AS bare, regexp_full_match(replace(date, '"', ''), '20[0-9]{{2}}-[0-1][0-9]-[0-3][0-9]') AS looks FROM csv),
kept AS (SELECT *, NOT looks OR coalesce(CAST(TRY_CAST(bare AS DATE) AS TIMESTAMP) > TIMESTAMP '{_MOVED_NOW}' - INTERVAL {_MOVED_DAYS} DAY, FALSE) AS keep FROM marked)"""


@query(f"{_CSV} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, date AS \"Date\" FROM kept WHERE keep")
def retain_csv(spark, sf):
    return retention.retain_csv(_csv(spark, sf), _MOVED_NOW, _MOVED_DAYS).select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "Date")


@query(f"{_CSV} SELECT l_returnflag AS file, count(*) AS original, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS removed FROM kept GROUP BY 1")
def retention_report(spark, sf):
    marked = _csv(spark, sf).withColumn("keep", retention.csv_keep(F.col("Date"), _MOVED_NOW, _MOVED_DAYS))
    return retention.retention_report(marked.withColumnRenamed("l_returnflag", "file"), ["file"])


@query(f"{_CSV} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, looks AS pattern, looks AND TRY_CAST(bare AS DATE) IS NOT NULL AS valid FROM kept")
def valid_csv_date(spark, sf):
    return _csv(spark, sf).select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        clock.is_csv_date(F.col("Date")).alias("pattern"), clock.valid_csv_date(F.col("Date")).alias("valid"))


@query(f"""SELECT event_id AS message_id, strftime(least(ts + INTERVAL 20 DAY, TIMESTAMP '{NOW}' + INTERVAL 24 HOUR), '%Y-%m-%d %H:%M:%S') AS expires_at
FROM events WHERE event_type <> 'view' AND ts + INTERVAL 20 DAY > TIMESTAMP '{NOW}'""")
def expire_ledger(spark, sf):
    """Entries of views have no expiry."""
    entries = b.table(spark, sf, "events").select(
        F.col("event_id").alias("message_id"),
        F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL '20' DAY")).alias("expires_at"))
    return ingest.expire_ledger(entries, NOW).withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH o AS (SELECT event_id, ts AS last_attempt_at, CAST(event_id % 6 AS BIGINT) AS attempts,
  CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 403 WHEN 'error' THEN 429 WHEN 'signup' THEN NULL ELSE 500 END AS st FROM events)
SELECT event_id, attempts FROM o WHERE attempts < 5 AND (attempts = 0 OR ((st IS NULL OR st NOT IN (200, 403, 404))
  AND last_attempt_at + CAST(least(180 * power(2, attempts - 1), 900) AS INT) * INTERVAL 1 SECOND <= TIMESTAMP '2024-01-30 12:00:00'))""")
def outbox_due(spark, sf):
    kind = F.col("event_type")
    box = b.table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("last_attempt_at"), (F.col("event_id") % 6).alias("attempts"),
        F.when(kind == "click", 200).when(kind == "view", 403).when(kind == "error", 429)
        .when(kind == "purchase", 500).alias("last_status"))
    return summary.outbox_due(box, "2024-01-30 12:00:00").select("event_id", "attempts")


LOG_NOW, LOG_DAYS = "2024-01-20 20:00:00", 3  # 04:00 on the 21st in Manila, so the cutoff is midnight of the 19th
_LOG_CUTOFF = "TIMESTAMP '2024-01-19 00:00:00'"
_KEPT = f"""WITH {b.LOGS},
base AS (SELECT *, stamped AND (logged_at IS NULL OR logged_at > {_LOG_CUTOFF}) AS kept FROM logs),
lines AS (SELECT *, CASE WHEN stamped THEN kept ELSE coalesce(bool_or(kept) OVER (PARTITION BY file ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) END AS keep FROM base)"""


@query(f"WITH {b.LOGS} SELECT file, row, stamped, strftime(logged_at, '%Y-%m-%d %H:%M:%S') AS logged_at, service FROM logs")
def log_timestamp(spark, sf):
    return parse_logs(b.logs(spark, sf)).select(
        "file", "row", "stamped", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("logged_at"), "service")


@query(f"{_KEPT} SELECT file, row, value FROM lines WHERE keep")
def retain_logs(spark, sf):
    return retention.retain_logs(b.logs(spark, sf), LOG_NOW, LOG_DAYS)


@query(f"{_KEPT} SELECT file, row, keep FROM lines WHERE NOT stamped")
def log_continuations(spark, sf):
    lines = b.logs(spark, sf)
    return (retention.mark_logs(lines, LOG_NOW, LOG_DAYS)
            .filter(~clock.has_log_stamp(F.col("value"))).select("file", "row", "keep"))


@query(f"""WITH {b.LOGS}, s AS (SELECT file, row, logged_at > {_LOG_CUTOFF} AS new, count(*) FILTER (logged_at <= {_LOG_CUTOFF}) OVER (PARTITION BY file ORDER BY row) AS grp FROM logs WHERE logged_at IS NOT NULL),
r AS (SELECT file, row, count(*) FILTER (new) OVER (PARTITION BY file, grp ORDER BY row) AS run FROM s)
SELECT file, min(row) AS from_row FROM r WHERE run >= 5 GROUP BY 1""")
def fast_forward(spark, sf):
    """Blocks of 100 lines, so that every file spans several."""
    return retention.fast_forward_row(b.logs(spark, sf), LOG_NOW, LOG_DAYS, chunk_rows=100)


@query(f"""WITH {b.LOGS} SELECT service, count(*) AS lines, count(*) FILTER (event_type = 'purchase') AS successes,
 strftime(max(logged_at) FILTER (event_type = 'purchase'), '%Y-%m-%d %H:%M:%S') AS last_success,
 arg_max('Sheet' || user_id, row) FILTER (event_type = 'purchase') AS last_worksheet,
 count(*) FILTER (event_type = 'error' OR contains(value, 'failed')) AS errors, count(*) FILTER (event_type = 'error') AS timeouts,
 count(*) FILTER (regexp_matches(lower(value), 'auth|401|403')) AS auth_failures, count(*) FILTER (FALSE) AS crash_alerts,
 count(*) FILTER (event_type = 'signup') AS admin_messages, count(*) FILTER (contains(value, 'succeeded')) AS tasks_succeeded,
 count(*) FILTER (contains(value, 'failed')) AS tasks_failed, count(DISTINCT file) FILTER (event_type = 'error') AS files_with_errors
FROM logs GROUP BY 1""")
def log_health(spark, sf):
    return summary.log_health(parse_logs(b.logs(spark, sf)))


@query(f"""WITH {b.LOGS} SELECT service, row, value, r AS event_rank FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY logged_at DESC NULLS LAST, row DESC) AS r
 FROM logs WHERE regexp_matches(lower(value), 'error|failed|exception')) WHERE r <= 5""")
def last_log_errors(spark, sf):
    return (summary.last_n_events(parse_logs(b.logs(spark, sf)), 5, "error|failed|exception")
            .select("service", "row", "value", F.col("event_rank").cast("bigint").alias("event_rank")))


@query(f"WITH {b.LOGS} SELECT service, row_number() OVER (PARTITION BY service ORDER BY row) AS row, value FROM logs")
def read_logs(spark, sf):
    """The lines written as one text file per service and read back with their numbers."""
    path = shared_dir(spark, "logs")
    lines = b.logs(spark, sf).select(F.regexp_extract("file", r"([^/]+)\.log$", 1).alias("service"), "row", "value")
    (lines.repartition("service").sortWithinPartitions("service", "row").select("service", "value")
     .write.partitionBy("service").text(path))
    return read_log_files(spark, path).select(F.regexp_extract("file", "service=([^/]+)/", 1).alias("service"), "row", "value")
