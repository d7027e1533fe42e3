"""Clock and date expressions. Every operator that needs the time takes it as an argument."""

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.fixed import CSV_DATE, LONG_STAMP, SHORT_STAMP

LOCAL_ZONE = "Asia/Manila"
# Last dates that have four-digit years.
LAST_MILLIS, LAST_SERIAL = 253_402_300_800_000, 2_958_465


def at(moment: datetime | str | Column) -> Column:
    """A UTC wall clock from a datetime (naive means UTC), an ISO string or a column."""
    if isinstance(moment, Column):
        return moment.cast("timestamp_ntz")
    if isinstance(moment, datetime):
        if moment.tzinfo is not None:
            moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
        moment = moment.isoformat(sep=" ")
    return F.lit(moment).cast("timestamp_ntz")


def seconds(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' SECOND")


def to_local(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def stamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def normalize_sheet_date(cell: Column, zone: str = LOCAL_ZONE) -> Column:
    """``yyyy-MM-dd`` text of a sheet cell: ``Date(ms)``, a spreadsheet serial, or a leading ISO date.

    Null when the cell holds none of them.
    """
    millis = F.regexp_extract(cell, r"Date\((\d+)\)", 1).try_cast("bigint")
    from_millis = date_text(to_local(
        F.timestamp_add("MILLISECOND", millis, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), zone))
    digits = F.replace(cell, F.lit("."), F.lit(""))
    serial = F.floor(cell.try_cast("double")).try_cast("int")
    from_serial = date_text(F.date_add(F.lit("1899-12-30").cast("date"), serial))
    head = F.substring(cell, 1, 10)
    from_iso = F.when(head.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & head.try_cast("date").isNotNull(), head)
    return (
        F.when(cell.startswith("Date("), F.when(millis < LAST_MILLIS, from_millis))
        .when(digits.rlike(r"\A[0-9]+\z"), F.when(serial.between(0, LAST_SERIAL), from_serial))
        .otherwise(from_iso)
    )


def is_csv_date(cell: Column) -> Column:
    """The archive's date pattern. A match may still be an impossible date."""
    return F.replace(cell, F.lit('"'), F.lit("")).rlike(CSV_DATE)


def valid_csv_date(cell: Column) -> Column:
    bare = F.replace(cell, F.lit('"'), F.lit(""))
    return is_csv_date(cell) & bare.try_cast("date").isNotNull()




def log_stamp(line: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text of the stamp a log line starts with; null without one.

    ``[yyyyMMdd_HH:mm:ss]:`` and ``[yyyy-MM-dd HH:mm:ss,SSS: LEVEL/process]`` are known.
    """
    def cut(start: int, length: int) -> Column:
        return F.substring(line, start, length)

    short = F.concat(cut(2, 4), F.lit("-"), cut(6, 2), F.lit("-"), cut(8, 2), F.lit(" "), cut(11, 8))
    return F.when(line.rlike(SHORT_STAMP), short).when(line.rlike(LONG_STAMP), cut(2, 19))


def has_log_stamp(line: Column) -> Column:
    return log_stamp(line).isNotNull()


def log_timestamp(line: Column) -> Column:
    """The local wall clock at the start of a log line; null if there is none or it is impossible."""
    return log_stamp(line).try_cast("timestamp_ntz")


def utc_instant(wall: Column) -> Column:
    """A UTC wall clock (``timestamp_ntz``) as an instant, whatever the session zone; watermarks need one."""
    second = F.extract(F.lit("SECOND"), wall)
    minutes = (F.unix_date(wall.cast("date")).cast("bigint") * 24 + F.hour(wall)) * 60 + F.minute(wall)
    return F.timestamp_micros(minutes * 60_000_000 + (second * 1_000_000).cast("bigint"))


def utc_day(instant: Column) -> Column:
    """The UTC day of an instant as text."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86_400).cast("int")).cast("string")
