"""Retention of stored tables, in place.

Files are counted first, and only those that hold expired rows are written anew, beside the table. A manifest names
the files that go and those that come; once it is there, the change is finished, however often it is interrupted.
Until then nothing of the table has been touched.
"""

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions.fixed import MESSAGE_FIELDS
from tidewire.operators import retention
from tidewire.operators.scale import few_listing_tasks, few_tasks, settle
from tidewire.sources.files import Files, partition_value
from tidewire.sources.logs import read_logs

WORK = "_retain-"
MANIFEST = "manifest"
REPORT = "file string, status string, original bigint, kept bigint, removed bigint, error string"


@dataclass(frozen=True)
class Stored:
    """A stored table and its retention rule.

    ``rows`` reads some files (or the root) with their ``file``; ``mark`` adds ``keep``. A file holds ``columns``.
    ``malformed`` names a column that is filled in rows the reader could not parse whole. With ``whole`` each file is
    written as one file of the same name, its rows in the order of ``row``: for logs, where a file is a sequence.
    """

    root: str
    rows: Callable[[list[str]], DataFrame]
    mark: Callable[[DataFrame], DataFrame]
    columns: list[str]
    fmt: str
    options: dict = field(default_factory=dict)
    malformed: str | None = None
    whole: bool = False


def stored_archive(spark: SparkSession, root: str, now, days: int, fmt: str = "csv") -> Stored:
    """The message archive, whatever it is partitioned by."""
    options = {"header": True, "escape": '"'} if fmt == "csv" else {}
    schema, bad = ", ".join(f"{f} string" for f in MESSAGE_FIELDS), "_malformed" if fmt == "csv" else None

    def rows(paths: list[str]) -> DataFrame:
        reader = spark.read.schema(schema + (f", {bad} string" if bad else "")).option("recursiveFileLookup", True).options(**options)
        if bad:  # every column is parsed, or rows with too many cells would pass for whole ones
            reader = reader.option("columnNameOfCorruptRecord", bad).option("columnPruning", False)
        with few_listing_tasks(spark):
            return few_tasks(reader.format(fmt).load(paths).select("*", F.col("_metadata.file_path").alias("file")))

    return Stored(root, rows, lambda df: df.withColumn("keep", retention.csv_keep(F.col("Date"), now, days)),
                  MESSAGE_FIELDS, fmt, options, bad)


def stored_sheets(spark: SparkSession, root: str, now, days: int, **zone: str) -> Stored:
    """Worksheets, one (country_code, sheet) to a partition. Headers stay; the rows below are not moved up."""
    def rows(paths: list[str]) -> DataFrame:
        return (spark.read.schema(schemas.SHEET).option("basePath", root).parquet(*paths)
                .select("*", F.col("_metadata.file_path").alias("file")))

    def mark(df: DataFrame) -> DataFrame:
        header = spark.read.schema(schemas.SHEET).parquet(root).filter("row_index = 1")
        return retention.mark_sheet(df, now, days, header, **zone)

    return Stored(root, rows, mark, ["row_index", "cells"], "parquet")


def stored_logs(spark: SparkSession, root: str, now, days: int, fast_forward: bool = False) -> Stored:
    """A folder of log files. A file stays one file, so one task writes what is left of it, in order and unheld."""
    return Stored(root, lambda paths: read_logs(spark, paths), lambda df: retention.mark_logs(df, now, days, fast_forward),
                  ["value"], "text", whole=True)


def _message(error: Exception) -> str:
    return (str(error).strip().splitlines() or [type(error).__name__])[0][:300]


def _counts(stored: Stored, paths: list[str]) -> DataFrame:
    """``retention_report`` with the malformed rows of each file, computed once."""
    marked = stored.mark(stored.rows(paths))
    bad = F.col(stored.malformed).isNotNull() if stored.malformed else F.lit(False)
    return settle(marked.groupBy("file").agg(
        F.count("*").alias("original"), F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("removed"),
        F.count_if(bad).alias("malformed")))


def unreadable(stored: Stored, paths: list[str]) -> dict[str, str]:
    """The files among ``paths`` whose reading fails, with the error. Found by halving, so few broken files cost
    few more scans than one of all of them."""
    try:
        stored.rows(paths).write.format("noop").mode("overwrite").save()
        return {}
    except Exception as error:
        if len(paths) == 1:
            return {paths[0]: _message(error)}
    half = len(paths) // 2
    return unreadable(stored, paths[:half]) | unreadable(stored, paths[half:])


def recover(spark: SparkSession, root: str) -> int:
    """Finish changes that were interrupted after their manifest, and forget those before it; returns how many."""
    files = Files(spark, root)
    left = [name for name in files.children() if name.startswith(WORK)]
    for work in left:
        if files.exists(f"{work}/{MANIFEST}"):
            _swap(files, work)
        files.remove(work)
    return len(left)


def _swap(files: Files, work: str) -> None:
    """Bring in the new files, then drop the old ones; both can be repeated.

    A reader in between can see a row in its old and its new file, but none that is kept is ever missing.
    """
    plan = files.read_json(f"{work}/{MANIFEST}")
    for source, target in plan["new"]:
        if files.exists(source):  # otherwise it was moved before
            files.move(source, target)
    for old in plan["old"]:
        files.remove(old)
    for folder in sorted({old.rpartition("/")[0] for old in plan["old"]}):
        files.drop_if_empty(folder)


def _rewrite(spark: SparkSession, stored: Stored, files: Files, touched: list[str]) -> list[str]:
    """Write what is left of the ``touched`` files and swap; returns those that changed meanwhile and were left alone."""
    work = f"{WORK}{uuid.uuid4().hex}"
    names = [files.relative(f) for f in touched]
    before = {name: files.stamp(name) for name in names}
    kept = stored.mark(stored.rows([files.url(n) for n in names])).filter("keep")
    target = _below(files) if stored.whole else F.regexp_replace(_below(files), "/?[^/]*$", "")
    kept = kept.withColumn("_target", target)
    if stored.whole:
        kept = kept.repartition("_target").sortWithinPartitions("_target", "row")
        writer = kept.select(*stored.columns, "_target").write.option("maxRecordsPerFile", 0)
    else:
        # Whole targets of usual size go to one task each, large ones are split.
        writer = kept.select(*stored.columns, "file", "_target").hint("rebalance", "_target").drop("file").write
    writer.partitionBy("_target").options(**stored.options).format(stored.fmt).save(files.url(f"{work}/new"))
    changed = {name for name in names if files.stamp(name) != before[name]}
    fresh = []
    for folder in files.children(f"{work}/new"):
        if folder.startswith("_target"):
            to = partition_value(folder)
            to = "" if to == "__HIVE_DEFAULT_PARTITION__" else to  # files right below the root
            parts = [p for p in files.children(f"{work}/new/{folder}") if not p.startswith(("_", "."))]
            fresh += [(f"{work}/new/{folder}/{p}", to if stored.whole else f"{to}/{p}".lstrip("/")) for p in parts]
    if changed and not stored.whole:
        # New files can hold rows of several old ones, so they come all or not at all.
        files.remove(work)
        return sorted(changed)
    old = [n for n in names if n not in changed]
    if stored.whole:
        fresh = [(s, t) for s, t in fresh if t not in changed]
        old = [n for n in old if n not in {t for _, t in fresh}]
    files.write_json(f"{work}/{MANIFEST}", {"new": fresh, "old": old})
    _swap(files, work)
    files.remove(work)
    return sorted(changed)


def retain_stored(spark: SparkSession, stored: Stored) -> DataFrame:
    """Apply a retention rule to a stored table in place; ``(file, status, original, kept, removed, error)``.

    ``retained`` files were written anew without their expired rows, ``unchanged`` ones are the same files as before.
    ``failed`` ones could not be read whole, hold malformed rows or changed while they were copied; they stay as they
    are and do not stop the others. Interrupted earlier runs are finished first. The driver holds file names only.
    """
    recover(spark, stored.root)
    files = Files(spark, stored.root)
    here = [files.root.toString()]
    broken: dict[str, str] = {}
    try:
        counts = _counts(stored, here)
    except Exception as error:
        every = _every_file(spark, files)
        broken = unreadable(stored, every)
        if not broken:
            raise error
        good = [f for f in every if f not in broken]
        counts = _counts(stored, good) if good else None
    if counts is None:
        status = spark.createDataFrame([], REPORT)
    else:
        bad, expired = F.col("malformed") > 0, F.col("removed") > 0
        touched = [r.file for r in counts.filter(expired & ~bad).select("file").toLocalIterator()]
        changed = _rewrite(spark, stored, files, touched) if touched else []
        # Where files are written anew together, none of them is replaced if one has changed.
        late = F.lit(False) if not changed else _below(files).isin(changed) if stored.whole else expired & ~bad
        error = F.when(bad, F.concat(F.col("malformed").cast("string"), F.lit(" malformed rows"))).when(late, "changed while it was copied")
        status = counts.select(
            "file", F.when(error.isNotNull(), "failed").when(expired, "retained").otherwise("unchanged").alias("status"),
            "original", F.when(error.isNotNull(), F.col("original")).otherwise(F.col("kept")).alias("kept"),
            F.when(error.isNotNull(), F.lit(0)).otherwise(F.col("removed")).cast("bigint").alias("removed"), error.alias("error"))
    rows = [(f, "failed", None, None, 0, e) for f, e in sorted(broken.items())]
    return status.unionByName(spark.createDataFrame(rows, REPORT)) if rows else status


def _below(files: Files):
    """The path of a row's file below the root."""
    return F.substr("file", F.instr("file", F.lit(files.raw + "/")) + len(files.raw) + 1)


def _every_file(spark: SparkSession, files: Files) -> list[str]:
    """Every visible file below the root."""
    found, walk = [], files.fs.listFiles(files.root, True)
    while walk.hasNext():
        path = walk.next().getPath()
        raw = path.toUri().getRawPath()[len(files.raw) + 1:]
        if not any(part.startswith(("_", ".")) for part in raw.split("/")):
            found.append(path.toString())
    return sorted(found)


def report_totals(report: DataFrame) -> DataFrame:
    """One row for a run: files processed and failed, rows deleted, the errors by file, and the overall status."""
    failed = F.col("status") == "failed"
    name = F.regexp_extract("file", "([^/]+)$", 1)
    totals = report.agg(
        F.count_if(~failed).alias("files_processed"), F.count_if(failed).alias("files_failed"),
        F.coalesce(F.sum("removed"), F.lit(0)).cast("bigint").alias("rows_deleted"),
        F.array_sort(F.collect_list(F.when(failed, F.concat(name, F.lit(": "), "error")))).alias("errors"))
    return totals.withColumn("status", F.when(F.col("files_failed") > 0, "partial_success").otherwise("success"))
