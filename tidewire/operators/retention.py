"""What to keep of sheets, archives and logs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.clock import (
    LOCAL_ZONE, at, date_text, is_csv_date, log_stamp, log_timestamp, normalize_sheet_date, to_local)
from tidewire.operators.scale import join_dimension, number_rows, settle
from tidewire.sources.sheets import KEYS, date_position, read_sheet

FAST_FORWARD_AFTER = 5


def sheet_keep(date_cell: Column, now, days: int, zone: str = LOCAL_ZONE) -> Column:
    """Keep from the cutoff day on; cells without a readable date are kept."""
    day = normalize_sheet_date(date_cell, zone)
    cutoff = date_text(to_local(at(now), zone) - F.make_dt_interval(F.lit(days)))
    return day.isNull() | (day >= cutoff)


def retain_sheet(sheet: DataFrame, now, days: int, zone: str = LOCAL_ZONE) -> DataFrame:
    """Rows of the sheets that stay, headers included; row numbers are not changed."""
    header = sheet.filter("row_index = 1")
    rows = read_sheet(sheet)
    return header.unionByName(rows.filter(sheet_keep(F.col("date_cell"), now, days, zone)).select(*sheet.columns))


def mark_sheet(rows: DataFrame, now, days: int, header: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Adds ``keep`` to rows of sheets, some or all of them; ``header`` holds the first row of each sheet."""
    places = header.select(*KEYS, date_position(F.col("cells")).cast("int").alias("_place"))
    cell = F.when(F.col("_place") > 0, F.try_element_at("cells", F.col("_place")))
    return join_dimension(rows, settle(places), KEYS, "left").select(
        *rows.columns, ((F.col("row_index") == 1) | sheet_keep(cell, now, days, zone)).alias("keep"))


def csv_keep(date: Column, now, days: int) -> Column:
    """Keep when the day's midnight is later than ``days`` days ago, so the cutoff day itself goes.

    A date that lacks the pattern is kept; one that has it but does not exist is not.
    """
    midnight = F.replace(date, F.lit('"'), F.lit("")).try_cast("date").cast("timestamp_ntz")
    recent = midnight > at(now) - F.make_dt_interval(F.lit(days))
    return ~F.coalesce(is_csv_date(date), F.lit(False)) | F.coalesce(recent, F.lit(False))


def retain_csv(archive: DataFrame, now, days: int, date: str = "Date") -> DataFrame:
    """Archive rows that stay; an archive without a date column is untouched."""
    return archive if date not in archive.columns else archive.filter(csv_keep(F.col(date), now, days))


def _running_new(stamped: DataFrame, chunk_rows: int) -> DataFrame:
    """Per stamped line, how many new lines in a row precede and include it.

    Runs are counted inside blocks of ``chunk_rows`` lines and carried from block to block, so a file
    of any length is spread over tasks and only one row per block is sorted per file.
    """
    blocks = stamped.withColumn("_block", F.floor(F.col("row") / chunk_rows))
    here = Window.partitionBy("file", "_block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.col("_new").cast("int")).over(here)
    local = (blocks.withColumn("_total", total)
             .withColumn("_reset", F.max(F.when(~F.col("_new"), F.col("_total"))).over(here)))
    ends = local.groupBy("file", "_block").agg(
        F.max("_total").alias("_count"), F.max("_reset").alias("_last"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    carried = (ends.withColumn("_sum", F.sum("_count").over(upto))
               .withColumn("_mark", F.col("_sum") - F.col("_count") + F.col("_last"))
               .select("file", "_block", (
                   F.coalesce(F.sum("_count").over(before), F.lit(0))
                   - F.coalesce(F.max("_mark").over(before), F.lit(0))).alias("_carry")))
    return local.join(carried, ["file", "_block"]).withColumn("run", F.when(
        F.col("_reset").isNotNull(), F.col("_total") - F.col("_reset")).otherwise(F.col("_total") + F.col("_carry")))


def fast_forward_row(lines: DataFrame, now, days: int, after: int = FAST_FORWARD_AFTER,
                     zone: str = LOCAL_ZONE, chunk_rows: int = 100_000) -> DataFrame:
    """``(file, from_row)``: where ``after`` new stamped lines in a row have been seen.

    An old line starts the count again; lines without a readable stamp neither count nor reset.
    """
    stamped = (lines.withColumn("_at", log_timestamp(F.col("value"))).filter(F.col("_at").isNotNull())
               .select("file", "row", (F.col("_at") > log_cutoff(now, days, zone)).alias("_new")))
    return (_running_new(stamped, chunk_rows).filter(F.col("run") >= after)
            .groupBy("file").agg(F.min("row").alias("from_row")))


def log_cutoff(now, days: int, zone: str = LOCAL_ZONE) -> Column:
    """Local midnight of ``days - 1`` days ago."""
    return F.date_trunc("DAY", to_local(at(now), zone)).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days - 1))


def log_continuations(lines: DataFrame, kept: Column, stamped: Column) -> DataFrame:
    """Adds ``keep``: a stamped line by ``kept``, any other line when an earlier line of its file stays.

    The first kept line is found by one aggregate per file, no file is sorted.
    """
    marked = lines.withColumns({"_stamped": stamped, "_kept": F.coalesce(kept, F.lit(False))})
    # Not a filter: it would be pushed below the stamp column and read every stamp again per use.
    first = marked.groupBy("file").agg(F.min(F.when(F.col("_stamped") & F.col("_kept"), F.col("row"))).alias("_first"))
    return join_dimension(marked, settle(first), ["file"], "left").select(
        *lines.columns,
        F.when(F.col("_stamped"), F.col("_kept"))
        .otherwise(F.coalesce(F.col("row") > F.col("_first"), F.lit(False))).alias("keep"))


def mark_logs(lines: DataFrame, now, days: int, fast_forward: bool = False, zone: str = LOCAL_ZONE) -> DataFrame:
    """Adds ``keep``. Lines whose stamp cannot be read are kept. ``fast_forward`` keeps the rest of a
    file once enough new lines in a row were seen; on files in time order it changes nothing."""
    read = lines.withColumn("_stamp", log_stamp(F.col("value")))
    at_ = F.col("_stamp").try_cast("timestamp_ntz")
    marked = log_continuations(read, at_.isNull() | (at_ > log_cutoff(now, days, zone)), F.col("_stamp").isNotNull())
    if fast_forward:
        jump = settle(fast_forward_row(lines, now, days, zone=zone))
        marked = join_dimension(marked, jump, ["file"], "left").withColumn(
            "keep", F.col("keep") | F.coalesce(F.col("row") > F.col("from_row"), F.lit(False)))
    return marked.select(*lines.columns, "keep")


def retain_logs(lines: DataFrame, now, days: int, fast_forward: bool = False, zone: str = LOCAL_ZONE) -> DataFrame:
    return mark_logs(lines, now, days, fast_forward, zone).filter("keep").drop("keep")


def _blank(cells: Column) -> Column:
    return ~F.coalesce(F.exists(cells, lambda c: F.coalesce(c.rlike(r"(?U)[^\s\x1C-\x1F]"), F.lit(False))), F.lit(False))


def interior_blank_rows(sheet: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Blank data rows with data below them. The last data row is found by one aggregate per sheet."""
    marked = sheet.withColumn("_blank", _blank(F.col("cells")))
    last = marked.filter(~F.col("_blank")).groupBy(*keys).agg(F.max("row_index").alias("_last"))
    return (join_dimension(marked.filter(F.col("_blank") & (F.col("row_index") > 1)), settle(last), keys, "inner")
            .filter(F.col("row_index") < F.col("_last")).select(*sheet.columns))


def compact_sheet(sheet: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Remove interior blank rows and number the rest from 1."""
    marked = sheet.withColumn("_blank", _blank(F.col("cells")) & (F.col("row_index") > 1))
    last = marked.filter(~F.col("_blank")).groupBy(*keys).agg(F.max("row_index").alias("_last"))
    kept = (join_dimension(marked, settle(last), keys, "left")
            .filter(~F.col("_blank") | F.coalesce(F.col("row_index") > F.col("_last"), F.lit(True)))
            .select(*sheet.columns))
    return (number_rows(kept, keys, ["row_index"], "_new")
            .withColumn("row_index", F.col("_new")).select(*sheet.columns))


def retention_report(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Original, kept and removed rows per file; the input has a boolean ``keep``."""
    return marked.groupBy(*keys).agg(
        F.count("*").alias("original"), F.count_if("keep").alias("kept"),
        F.count_if(~F.col("keep")).alias("removed"))


def retention_job(components: dict) -> dict:
    """Run the retention steps one after the other; a failed one does not stop the rest.

    ``components`` maps a name to a function without arguments.
    """
    details = {}
    for name, run in components.items():
        try:
            details[name] = {"status": "success", "result": run()}
        except Exception as error:
            details[name] = {"status": "error", "error": str(error)}
    done = all(d["status"] == "success" for d in details.values())
    return {"status": "success" if done else "partial_success", "details": details}
