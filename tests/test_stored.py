"""Retention of stored tables in place: what is left alone, what an interrupted run leaves, what cannot be read."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tidewire.functions.fixed import MESSAGE_FIELDS
from tidewire.functions.text import flatten_newlines
from tidewire.operators import sinks, stored
from tidewire.plans import retention_queries
from tidewire.plans.sink_queries import records
from tidewire.sources.feeds import read_archive
from tidewire.sources.files import Files, write_local_csv

NOW = "2024-01-12 12:00:00"


def archive(spark, root, fmt="csv", days=("2024-01-02", "2024-01-09")):
    """Two partitions with expired rows beside new ones, and one without."""
    rows = [(f"{c}{k}", day, c) for c in ("mixed a", "mixed=b") for k, day in enumerate(days)]
    rows += [("new1", "2024-01-10", "new"), ("new2", "someday", "new"), ("old", "2023-01-01", "old")]
    cells = [F.col(f).alias(f) if f in ("Message_ID", "Date") else F.lit('a, "b" c').alias(f) for f in MESSAGE_FIELDS]
    df = spark.createDataFrame(rows, "Message_ID string, Date string, country_code string").select(*cells, "country_code", F.lit("trivial").alias("category"))
    writer = df.repartition(1).write.partitionBy("country_code", "category")
    writer.options(**({"header": True, "escape": '"'} if fmt == "csv" else {})).format(fmt).save(root)
    return stored.stored_archive(spark, root, NOW, 7, fmt)


def ids(spark, target):
    return sorted(r.Message_ID for r in target.rows([target.root]).select("Message_ID").collect())


def data_files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.startswith("part")}


KEPT = ["mixed a1", "mixed=b1", "new1", "new2"]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_only_files_with_expired_rows_change(spark, tmp_path, fmt):
    root = str(tmp_path / "archive of messages")
    target = archive(spark, root, fmt)
    before = data_files(root)
    report = {r.file.split("country_code=")[1].split("/")[0]: r for r in stored.retain_stored(spark, target).collect()}
    after = data_files(root)
    assert ids(spark, target) == KEPT
    assert {f for f in before.keys() & after.keys()} == {f for f in before if "country_code=new" in f}
    assert all(before[f] == after[f] for f in before.keys() & after.keys())
    assert sorted((r.status, r.original, r.kept, r.removed) for r in report.values()) == [
        ("retained", 1, 0, 1), ("retained", 2, 1, 1), ("retained", 2, 1, 1), ("unchanged", 2, 2, 0)]
    assert not [d for d in os.listdir(root) if d.startswith("_retain") or "old" in d]
    again = stored.retain_stored(spark, target).collect()
    assert {r.status for r in again} == {"unchanged"} and data_files(root) == after
    texts = target.rows([root]).select("Message_Text").distinct().collect()
    assert [r[0] for r in texts] == ['a, "b" c']


@pytest.mark.parametrize("moves", [0, 1])
def test_a_run_killed_while_it_swaps_is_finished_by_the_next(spark, tmp_path, monkeypatch, moves):
    root = str(tmp_path / "a")
    target = archive(spark, root)
    plain, done = Files.move, []

    def move(self, source, to):
        if "/new/" in source and len(done) == moves:
            raise KeyboardInterrupt
        done.extend([to] if "/new/" in source else [])
        plain(self, source, to)

    monkeypatch.setattr(Files, "move", move)
    with pytest.raises(KeyboardInterrupt):
        stored.retain_stored(spark, target)
    monkeypatch.setattr(Files, "move", plain)
    assert set(ids(spark, target)) >= set(KEPT)  # whatever stays is there at any time
    assert stored.recover(spark, root) == 1 and ids(spark, target) == KEPT
    assert stored.recover(spark, root) == 0


def test_a_run_killed_while_it_drops_old_files_is_finished(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "a")
    target = archive(spark, root)
    plain = Files.remove
    monkeypatch.setattr(Files, "remove", lambda self, name: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        stored.retain_stored(spark, target)
    monkeypatch.setattr(Files, "remove", plain)
    stored.retain_stored(spark, target)
    assert ids(spark, target) == KEPT


def test_a_run_killed_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "a")
    target = archive(spark, root)
    before = data_files(root)
    plain = Files.write_json
    monkeypatch.setattr(Files, "write_json", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        stored.retain_stored(spark, target)
    monkeypatch.setattr(Files, "write_json", plain)
    assert stored.recover(spark, root) == 1 and data_files(root) == before
    assert not [d for d in os.listdir(root) if d.startswith("_retain")]


def test_files_that_change_meanwhile_are_left_alone(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "a")
    target = archive(spark, root)
    before, plain = data_files(root), Files.stamp
    seen = []
    monkeypatch.setattr(Files, "stamp", lambda self, name: (seen.append(name), plain(self, name) if seen.count(name) == 1 else (0, 0))[1])
    report = stored.retain_stored(spark, target).collect()
    assert data_files(root) == before
    assert sorted((r.status, r.removed, r.error) for r in report) == [("failed", 0, "changed while it was copied")] * 3 + [("unchanged", 0, None)]


def test_broken_and_malformed_files_are_reported_and_stay(spark, tmp_path):
    root = str(tmp_path / "a")
    target = archive(spark, root)
    folder = next(d for d, _, fs in os.walk(root) if "mixed a" in d.replace("%20", " ") and fs)
    wide = ",".join(["2020-01-01"] * (len(MESSAGE_FIELDS) + 2))
    with open(f"{folder}/part-wide.csv", "w") as f:
        f.write(",".join(MESSAGE_FIELDS) + "\n" + wide + "\n")
    with open(f"{folder}/part-cut.csv.gz", "wb") as f:
        f.write(gzip.compress(os.urandom(100_000))[:50_000])
    report = stored.retain_stored(spark, target)
    totals = stored.report_totals(report).first()
    assert (totals.files_processed, totals.files_failed, totals.rows_deleted, totals.status) == (4, 2, 3, "partial_success")
    assert [e.split(":")[0] for e in totals.errors] == ["part-cut.csv.gz", "part-wide.csv"] and "1 malformed rows" in totals.errors[1]
    assert os.path.exists(f"{folder}/part-wide.csv") and os.path.exists(f"{folder}/part-cut.csv.gz")
    os.remove(f"{folder}/part-cut.csv.gz")
    os.remove(f"{folder}/part-wide.csv")
    assert ids(spark, target) == KEPT


def test_log_files_keep_their_names_and_order(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    line = "[{}_10:00:00]: {}".format
    long = [x for k in range(2000) for x in (line("20240101" if k % 2 else "20240112", f"line {k}"), f"  stack of {k}")]
    (root / "a b.log").write_text("\n".join(long) + "\n")
    (root / "new.log").write_text(line("20240111", "x") + "\n")
    (root / "old.log").write_text(line("20230111", "x") + "\n")
    before = data_files(str(root)), os.stat(root / "new.log").st_mtime_ns
    report = stored.retain_stored(spark, stored.stored_logs(spark, str(root), NOW, 3)).collect()
    assert sorted(n for n in os.listdir(root) if not n.startswith(".")) == ["a b.log", "new.log"]
    # The first line is new, so every line without a stamp after it stays.
    assert (root / "a b.log").read_text().splitlines() == [x for x in long if not x.startswith("[20240101")]
    assert os.stat(root / "new.log").st_mtime_ns == before[1]
    assert sorted((r.status, r.removed) for r in report) == [("retained", 1), ("retained", 1000), ("unchanged", 0)]


def test_sheets_read_their_header_from_other_files(spark, tmp_path):
    root = str(tmp_path / "sheets")
    rows = [("a", "S", 1, ["Text", "date"]), ("a", "S", 2, ["x", "2023-01-01"]), ("a", "S", 3, ["y", "2024-01-11"]), ("b", "S", 1, ["Text"]), ("b", "S", 2, ["z"])]
    (spark.createDataFrame(rows, "country_code string, sheet string, row_index bigint, cells array<string>").repartition(4, "row_index")
     .write.partitionBy("country_code", "sheet").parquet(root))
    target = stored.stored_sheets(spark, root, NOW, 3)
    stored.retain_stored(spark, target)
    assert sorted((r.country_code, r.row_index) for r in target.rows([root]).collect()) == [("a", 1), ("a", 3), ("b", 1), ("b", 2)]


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        stored.retain_stored(spark, stored.stored_archive(spark, str(tmp_path / "none"), NOW, 7))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_a_batch_of_the_archive_is_one_task_s_and_has_no_checksum_files(spark, tmp_path, fmt):
    rows = [(k, f"source{k % 3}", "en", "mit license\r\nof \"all\", kinds" if k % 4 else None) for k in range(480)] + [(5, "source5", "en", "again")]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    sf, root = str(tmp_path / "sf"), str(tmp_path / "archive")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        retention_queries._archive(spark, sf, root, fmt)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = {}
    for folder, _, names in os.walk(root):
        for name in names:
            assert not name.endswith(".crc")
            if name.startswith("part-"):
                tasks.setdefault(folder.split("batch_id=")[1].split("/")[0], []).append(name.split("-")[1])
    assert len(tasks) == 10 and len({t for ts in tasks.values() for t in ts}) > 1
    assert all(len(set(ts)) == 1 for ts in tasks.values()) and max(map(len, tasks.values())) > 1
    plain = sinks.archive_rows(records(spark, sf)).fillna("")
    back = read_archive(spark, root, fmt).select(*plain.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, plain.collect()))


def test_an_archive_of_many_files_is_listed_and_read_by_few_tasks(spark, tmp_path):
    root, key = tmp_path / "archive", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    for k in range(600):
        (root / f"batch_id={k}").mkdir(parents=True)
        (root / f"batch_id={k}" / "part-0.csv").write_text(",".join(MESSAGE_FIELDS) + "\n" + ",".join([str(k)] * len(MESSAGE_FIELDS)) + "\n")
    most, before, tracker = 32 * spark.sparkContext.defaultParallelism, spark.conf.get(key), spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    spark.sparkContext.setJobGroup("listing of many folders", "")
    try:
        rows = stored.stored_archive(spark, str(root), NOW, 7).rows([str(root)])
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing of many folders")]
        assert [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds] == [most]
        assert rows.rdd.getNumPartitions() == most and spark.conf.get(key) == before
        assert rows.selectExpr("count(*)", "count(distinct file, Message_ID)", "count(_malformed)").first() == (600, 600, 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_local_csv_is_what_spark_s_writer_leaves(spark, tmp_path):
    cells = ["plain", "", " led and trailed ", 'a "quoted", b', "back\\slash", 'end\\"', "line\nbreak\rand\ttab", "#comment", "\u00fc\u0634", "\u0000", None]
    keys = [(1, "a b"), (1, "x=/%:?'*[]{}^#\\"), (2, ""), (2, None), (None, "\u00fc"), (3, "~(),.-_&$!;@+|<>`")]
    rows = [(*key, f"{k}", cell) for key in keys for k, cell in enumerate(cells)]
    df = spark.createDataFrame(rows, "n bigint, k string, id string, text string").repartition(3, "id")
    ours, theirs = str(tmp_path / "our files"), str(tmp_path / "theirs")
    write_local_csv(df.select("id", "n", "text", "k"), ["n", "k"], ours)
    df.select("id", "n", "text", "k").write.partitionBy("n", "k").option("header", True).option("escape", '"').csv(theirs)

    def content(root):
        found = {}
        for folder, _, names in os.walk(root):
            parts = [open(os.path.join(folder, x), "rb").read() for x in names if x.startswith("part-")]
            if parts:
                assert all(x.startswith(b"id,text\n") for x in parts)
                found[os.path.relpath(folder, root)] = sorted(x.removeprefix(b"id,text\n") for x in parts)
        return {k: sorted(b"".join(v).split(b"\n")) for k, v in found.items()}, {k: len(v) for k, v in found.items()}

    assert content(ours) == content(theirs) and max(content(ours)[1].values()) > 1
    assert not [x for x in os.listdir(ours) if not x.startswith("n=")]


def test_local_csv_holds_nothing_of_attempts_that_failed(spark, tmp_path):
    df = spark.range(100).selectExpr("id % 10 AS n", "CAST(id AS string) AS id").repartition(1)
    broken = df.withColumn("id", F.when(F.col("n") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    root = str(tmp_path / "a")
    with pytest.raises(Exception, match="broken"):
        write_local_csv(broken, ["n"], root)
    assert not [x for x in (os.listdir(root) if os.path.isdir(root) else []) if not x.startswith("_")]
    write_local_csv(df, ["n"], root)
    assert spark.read.option("header", True).csv(root).selectExpr("count(*)", "count(distinct id)").first() == (100, 100)


def test_a_local_archive_is_written_without_hadoop_s_file_system(spark, tmp_path, monkeypatch):
    rows = [(k, f"source{k % 3}", "en", "mit license") for k in range(96)]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    # A writer of Hadoop's would start a process for each of these files and folders.
    monkeypatch.setattr(retention_queries, "_NO_CHECKSUMS", {"fs.file.impl": "no.such.FileSystem", "fs.file.impl.disable.cache": "true"})
    retention_queries._archive(spark, str(tmp_path / "sf"), str(tmp_path / "archive"))
    assert read_archive(spark, str(tmp_path / "archive")).count() == 96


def test_the_names_in_a_folder_come_in_a_few_calls(spark, tmp_path, monkeypatch):
    root = tmp_path / "a, b"
    odd = ["plain", "a, b", "Array(x)", "k=%C3%BC", "\u00fc \u0634", "x\ny"]
    for name in odd + [f"batch_id={k}" for k in range(200)]:
        (root / name).mkdir(parents=True)
    files, calls = Files(spark, str(root)), []
    client = spark.sparkContext._gateway._gateway_client
    plain = client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **b: (calls.append(a), plain(*a, **b))[1])
    names = files.children()
    assert len(names) == 206 and len(calls) < 100 and files.children("plain") == [] and files.children("none") == []
    assert all(files.exists(name) for name in names) and {"plain", "a,%20b", "Array(x)", "k=%25C3%25BC"} <= set(names)


def test_line_breaks_of_every_kind_are_flattened(spark):
    texts = ["a\r\nb", "a\r\r\nb", "a\n\rb", "\r\n\r\n", "\r", "none", "", None, "a\u2028b\u0085c"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert all(r[0] == r[1] for r in df.select(flatten_newlines(F.col("t")), F.regexp_replace("t", r"\r\n|\n|\r", "<br>")).collect())
