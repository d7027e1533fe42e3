"""Daily figures, throttled notifications, run records and log health."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.clock import at, date_text, utc_day, utc_instant
from tidewire.functions.fixed import MARKERS, RESOURCE_THRESHOLDS
from tidewire.functions.lookups import delivery_outcome, resource_excess, retry_delay
from tidewire.operators.scale import join_dimension, number_rows


def success_rate(total: Column, errors: Column) -> Column:
    """Percent without errors, one decimal; 0 for an empty day."""
    return F.round((total - errors) / F.greatest(total, F.lit(1)) * 100, 1)


def daily_summary(df: DataFrame, ts: str = "date", significant: str = "is_significant",
                  error: str = "is_error") -> DataFrame:
    """Totals per calendar day. Channels are counted per day after their repeats are merged map-side."""
    return df.groupBy(date_text(F.col(ts)).alias("day")).agg(
        F.count("*").alias("total_messages"),
        F.count_if(F.col(significant)).alias("significant_messages"),
        F.count_distinct("channel").alias("channels_monitored"),
        F.count_if(F.col(error)).alias("errors_encountered"),
    ).withColumn("success_rate", success_rate(F.col("total_messages"), F.col("errors_encountered")))


def every_nth(df: DataFrame, n: int | dict[str, int], order: list[str], keys: list[str] = ["source"],
              earlier: DataFrame | None = None) -> DataFrame:
    """The n-th, 2n-th, ... error of each source, with its number.

    ``n`` may differ by source, as in ``NOTIFY_EVERY``; sources without an entry are never notified.
    ``earlier`` holds counts from before this batch as ``(source, errors)``.
    """
    numbered = number_rows(df, keys, order, "error_number")
    if earlier is not None:
        past = earlier.select(*keys, F.col("errors").alias("_past"))
        numbered = join_dimension(numbered, past, keys, "left").withColumn(
            "error_number", F.col("error_number") + F.coalesce("_past", F.lit(0))).drop("_past")
    step = F.lit(n) if isinstance(n, int) else F.try_element_at(
        F.create_map(*[F.lit(x) for pair in n.items() for x in pair]), F.col(keys[0]))
    return numbered.filter(F.col("error_number") % step == 0)


def resource_warnings(metrics: DataFrame, thresholds: dict[str, float] = RESOURCE_THRESHOLDS) -> DataFrame:
    """Readings ``(resource, value)`` above their warning level, with the level and the excess in percent."""
    level = F.try_element_at(F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair]), F.col("resource"))
    return (metrics.withColumn("threshold", level).filter(F.col("value") > F.col("threshold"))
            .withColumn("excess", resource_excess(F.col("value"), F.col("threshold"))))


def run_log(marked: DataFrame, now, channels: DataFrame | None = None) -> DataFrame:
    """One status record of a fetch: messages handed on, and skipped for lack of text.

    ``marked`` has ``reason`` and a boolean ``empty``. All of ``channels`` count as checked, with or without
    messages; without that table only those with messages do.
    """
    taken, status = F.col("reason") == "accepted", message_status(F.col("empty"))
    counts = marked.agg(
        F.count_if(taken & (status == "success")).alias("messages_processed"),
        F.count_if(taken & (status == "skipped_empty")).alias("messages_skipped"),
        F.count_distinct("channel").alias("_channels"))
    checked = F.col("_channels") if channels is None else channels.agg(F.count_distinct("channel")).scalar()
    return counts.select(
        F.when(checked == 0, "no_channels").otherwise("success").alias("status"),
        F.date_format(at(now), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        checked.alias("channels_checked"), "messages_processed", "messages_skipped")


def message_status(empty: Column) -> Column:
    return F.when(empty, "skipped_empty").otherwise("success")


def failure_status(error: Column) -> Column:
    """Status of a failed fetch from its error text."""
    text = F.lower(error)
    return (
        F.when(text.contains("rate limit"), "rate_limited")
        .when(text.contains("session safety"), "skipped_safety")
        .when(text.contains("session"), "session_error")
        .when(text.contains("auth"), "auth_error")
        .when(text.contains("timeout"), "timeout")
        .otherwise("error"))


def failure_log(failed: DataFrame, now, channels: DataFrame) -> DataFrame:
    """The status record of each failed run in ``failed`` (sink, error, and the text that decides the status)."""
    return failed.select(
        failure_status(F.col("_first")).alias("status"), F.date_format(at(now), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        channels.agg(F.count_distinct("channel")).scalar().alias("channels_checked"), F.lit(0).cast("bigint").alias("messages_processed"),
        F.lit(0).cast("bigint").alias("messages_skipped"), "sink", "error")


def daily_stream(stream: DataFrame, delay: str, ts: str = "date", significant: str = "is_significant", error: str = "is_error") -> DataFrame:
    """``daily_summary`` on a stream: a day is told once, when the watermark (the newest message less ``delay``) has passed it.

    Messages that come later than that are left out; Spark counts them, see ``ProgressTable``. Channels are counted
    by a first window per channel, so that the state holds a row for a channel and day and no set of channels.
    """
    timed = stream.withColumn(ts, utc_instant(F.col(ts))) if dict(stream.dtypes)[ts] == "timestamp_ntz" else stream
    per = (timed.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), "channel")
           .agg(F.count("*").alias("total"), F.count_if(F.col(significant)).alias("yes"), F.count_if(F.col(error)).alias("bad")))
    day = F.window(F.window_time("window"), "1 day")
    totals = per.groupBy(day).agg(
        F.sum("total").alias("total_messages"), F.sum("yes").alias("significant_messages"),
        F.count("channel").alias("channels_monitored"), F.sum("bad").alias("errors_encountered"))
    return totals.select(
        utc_day(F.col("window.start")).alias("day"), "total_messages", "significant_messages", "channels_monitored", "errors_encountered",
        success_rate(F.col("total_messages"), F.col("errors_encountered")).alias("success_rate"))


def outbox_due(outbox: DataFrame, now, max_attempts: int = 5) -> DataFrame:
    """Deliveries whose last outcome asks for a retry, whose attempts are not used up, and whose
    waiting time has passed. ``attempts`` counts finished tries; a fresh row has 0."""
    tried = F.col("attempts") > 0
    wait = retry_delay(F.col("attempts") - 1)
    due = F.col("last_attempt_at") + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))
    again = ~tried | (delivery_outcome(F.col("last_status")) == "retry")
    return outbox.filter((F.col("attempts") < max_attempts) & again & (~tried | (due <= at(now))))





def log_health(lines: DataFrame, markers: dict[str, str] = MARKERS) -> DataFrame:
    """Counts per service from parsed log lines, with the last success and the sheet it wrote to.

    Lines are counted per file first, so that files with errors need no distinct count.
    """
    value, low = F.col("value"), F.col("_low")
    task = value.contains(markers["task"])
    flags = {
        "successes": value.contains(markers["success"]),
        "errors": low.contains("error") | low.contains("failed") | low.contains("exception"),
        "timeouts": low.contains("timeout"),
        "auth_failures": low.contains("auth") | low.contains("401") | low.contains("403"),
        "crash_alerts": value.contains(markers["crash_alert"]),
        "admin_messages": value.contains(markers["admin_message"]),
        "tasks_succeeded": task & value.contains("succeeded"),
        "tasks_failed": task & value.contains("failed"),
    }
    grave = value.contains("ERROR") | value.contains("CRITICAL") | value.contains("Exception")
    marked = lines.withColumn("_low", F.lower("value")).select(
        "service", "file", *[test.alias(name) for name, test in flags.items()], grave.alias("_grave"),
        F.when(flags["successes"], F.struct(
            "logged_at", "row", F.regexp_extract("value", r"worksheet=([^,]*)", 1).alias("sheet"))).alias("_ok"))
    files = marked.groupBy("service", "file").agg(
        F.count("*").alias("lines"), *[F.count_if(name).alias(name) for name in flags],
        F.bool_or("_grave").alias("_grave"), F.max("_ok").alias("_ok"))
    return files.groupBy("service").agg(
        F.sum("lines").alias("lines"), *[F.sum(name).alias(name) for name in flags],
        F.count_if("_grave").alias("files_with_errors"), F.max("_ok").alias("_ok"),
    ).select(
        "service", "lines", *flags, "files_with_errors",
        F.date_format("_ok.logged_at", "yyyy-MM-dd HH:mm:ss").alias("last_success"),
        F.col("_ok.sheet").alias("last_worksheet"))


def last_n_events(lines: DataFrame, n: int, pattern: str) -> DataFrame:
    """The last ``n`` lines of each service that match a pattern, newest first."""
    newest = Window.partitionBy("service").orderBy(F.desc("logged_at"), F.desc("row"))
    return (lines.filter(F.lower("value").rlike(pattern))
            .withColumn("event_rank", F.row_number().over(newest)).filter(F.col("event_rank") <= n))
