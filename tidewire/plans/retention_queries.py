"""Retention that changes stored archives, sheets and logs: written, retained in place and read back."""

from pyspark.sql import functions as F

from tidewire.operators import sinks, stored
from tidewire.operators.retention import retention_job as run_job
from tidewire.operators.scale import few_listing_tasks, few_tasks
from tidewire.plans import bindings as b
from tidewire.plans.registry import ORACLES, query
from tidewire.plans.sink_queries import _CANON, _KEPT, _RECORDS, LOG_DAYS, LOG_NOW, SHEET_DAYS, SHEET_NOW, records
from tidewire.session import shared_dir
from tidewire.sources.feeds import read_archive
from tidewire.sources.files import Files, write_local_csv
from tidewire.sources.logs import read_logs

ARCHIVE_NOW, ARCHIVE_DAYS = "2024-01-12 12:00:00", 7  # the cutoff day, the 5th, goes
_KEPT_DAYS = "day > '2024-01-05'"


# A local file system starts a process for every file and folder it makes. These files are read back at once, so they go
# without a second one each for checksums. Other file systems do not look at these options.
_NO_CHECKSUMS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def _archive(spark, sf, root, fmt="csv"):
    """The archive as stream batches leave it: a folder for every two days of messages.

    A batch is one task's, which makes its folders once; large ones are split.
    """
    rows = sinks.archive_rows(records(spark, sf)).withColumn("batch_id", F.floor(F.col("Message_ID").cast("bigint") / 48))
    rows, keys = rows.hint("rebalance", "batch_id"), ["batch_id", "country_code", "category"]
    if fmt == "csv" and Files(spark, root).local:
        return write_local_csv(rows, keys, root)
    writer = rows.write.partitionBy(*keys).options(**_NO_CHECKSUMS)
    writer.options(**({"header": True, "escape": '"'} if fmt == "csv" else {})).format(fmt).save(root)


def _sheets(spark, sf, root):
    b.sheet(spark, sf).hint("rebalance", "country_code", "sheet").write.partitionBy("country_code", "sheet").parquet(root)


def _logs(spark, sf, root):
    """One text file for each service, lines in order."""
    lines = b.logs(spark, sf).select(F.regexp_extract("file", r"([^/]+)\.log$", 1).alias("service"), "row", "value")
    (lines.repartition("service").sortWithinPartitions("service", "row").select("service", "value")
     .write.partitionBy("service").text(root))


@query(f"""WITH {_RECORDS} SELECT {_CANON.format(text="regexp_replace(text, chr(13) || chr(10) || '|' || chr(10) || '|' || chr(13), '<br>', 'g')")},
 country_code, lower(category) AS category FROM records WHERE {_KEPT_DAYS}""")
def retain_archive_in_place(spark, sf):
    root = shared_dir(spark, "archive")
    _archive(spark, sf, root)
    stored.retain_stored(spark, stored.stored_archive(spark, root, ARCHIVE_NOW, ARCHIVE_DAYS))
    with few_listing_tasks(spark):
        return few_tasks(read_archive(spark, root)).drop("batch_id")


@query(f"""WITH {_RECORDS}, kept AS (SELECT CAST(floor(message_id / 48) AS BIGINT) AS batch_id, country_code, lower(category) AS category,
  {_KEPT_DAYS} AS keep FROM records)
SELECT batch_id, country_code, category, CASE WHEN bool_and(keep) THEN 'unchanged' ELSE 'retained' END AS status, count(*) AS original,
 count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS removed FROM kept GROUP BY ALL""")
def retain_archive_report(spark, sf):
    """What a run reports, by partition: those without expired rows are left alone."""
    root = shared_dir(spark, "archive")
    _archive(spark, sf, root, "parquet")
    report = stored.retain_stored(spark, stored.stored_archive(spark, root, ARCHIVE_NOW, ARCHIVE_DAYS, "parquet"))
    part = lambda name: F.regexp_extract("file", f"{name}=([^/]+)/", 1)
    return report.groupBy(part("batch_id").cast("bigint").alias("batch_id"), part("country_code").alias("country_code"),
                          part("category").alias("category")).agg(
        F.min("status").alias("status"), *[F.sum(c).alias(c) for c in ("original", "kept", "removed")])


@query(ORACLES["retain_sheet"])
def retain_sheets_in_place(spark, sf):
    root = shared_dir(spark, "sheets")
    _sheets(spark, sf, root)
    stored.retain_stored(spark, stored.stored_sheets(spark, root, SHEET_NOW, SHEET_DAYS))
    return spark.read.schema("row_index bigint, cells array<string>, country_code string, sheet string").parquet(root).select(
        "country_code", "sheet", "row_index")


@query(f"""{_KEPT} SELECT regexp_extract(file, '([^/]+)\\.log$', 1) AS service, row_number() OVER (PARTITION BY file ORDER BY row) AS row, value
FROM lines WHERE keep""")
def retain_logs_in_place(spark, sf):
    """What is left of each log file, in order."""
    root = shared_dir(spark, "logs")
    _logs(spark, sf, root)
    stored.retain_stored(spark, stored.stored_logs(spark, root, LOG_NOW, LOG_DAYS))
    return read_logs(spark, root).select(F.regexp_extract("file", "service=([^/]+)/", 1).alias("service"), "row", "value")


@query(f"""{_KEPT} SELECT count(DISTINCT file) AS files_processed, CAST(1 AS BIGINT) AS files_failed,
 count(*) FILTER (NOT keep) AS rows_deleted, CAST(1 AS BIGINT) AS errors, 'partial_success' AS status FROM lines""")
def retention_totals(spark, sf):
    """The totals of a run over logs, one of which is a broken archive."""
    root = shared_dir(spark, "logs")
    _logs(spark, sf, root)
    files = Files(spark, root)
    out = files.fs.create(files.path("service=broken/part-0.txt.gz"), True)
    out.write(bytearray(b"not an archive"))
    out.close()
    totals = stored.report_totals(stored.retain_stored(spark, stored.stored_logs(spark, root, LOG_NOW, LOG_DAYS)))
    return totals.withColumn("errors", F.size("errors").cast("bigint"))


@query(f"""SELECT 'logs' AS component, 'success' AS status, count(*) AS kept FROM ({ORACLES["retain_logs"]})
UNION ALL SELECT 'sheet', 'success', count(*) FROM ({ORACLES["retain_sheet"]})
UNION ALL SELECT 'unreachable', 'error', NULL""")
def retention_job(spark, sf):
    """The daily run: logs and sheets retained in place, and one step that fails without stopping them."""
    logs, sheets = shared_dir(spark, "logs"), shared_dir(spark, "sheets")
    _logs(spark, sf, logs)
    _sheets(spark, sf, sheets)
    done = run_job({
        "unreachable": lambda: stored.retain_stored(spark, stored.stored_logs(spark, shared_dir(spark, "none"), LOG_NOW, LOG_DAYS)),
        "logs": lambda: stored.retain_stored(spark, stored.stored_logs(spark, logs, LOG_NOW, LOG_DAYS)),
        "sheet": lambda: stored.retain_stored(spark, stored.stored_sheets(spark, sheets, SHEET_NOW, SHEET_DAYS))})
    status = [(name, d["status"]) for name, d in done["details"].items()]
    left = spark.read.text(logs).select(F.lit("logs").alias("component")).unionByName(
        spark.read.parquet(sheets).select(F.lit("sheet").alias("component")))
    return spark.createDataFrame(status, "component string, status string").join(
        left.groupBy("component").agg(F.count("*").alias("kept")), "component", "left")
