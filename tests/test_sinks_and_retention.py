from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions import clock, lookups, text
from tidewire.functions.fixed import MESSAGE_FIELDS
from tidewire.operators import project, retention, sinks, summary
from tidewire.sources.feeds import read_archive
from tidewire.sources.logs import parse_logs, read_logs

NOW = datetime(2025, 11, 10, 4)  # noon in Manila


def one(frame, value, column, schema="v string"):
    return frame([(value,)], schema).select(column).first()[0]


def test_fields_and_addresses(frame):
    assert len(project.FEED_FIELDS) == 11 and project.FEED_FIELDS[0] == "Message_ID"
    v = F.col("v")
    letters = {1: "A", 11: "K", 26: "Z", 27: "AA", 28: "AB", 52: "AZ", 53: "BA", 702: "ZZ", 703: "AAA", 16384: "XFD"}
    for n, name in letters.items():
        assert one(frame, n, lookups.column_letters(v), "v int") == name
    assert one(frame, 2, lookups.a1_range(v, F.lit(11)), "v int") == "A2:K2"
    assert one(frame, 2, lookups.a1_range(v, F.lit(28), F.lit(3)), "v int") == "A2:AB4"


def test_text_forms(frame):
    v = F.col("v")
    assert one(frame, "Line 1\nLine 2\r\nLine 3\rLine 4", text.flatten_newlines(v)) == "Line 1<br>Line 2<br>Line 3<br>Line 4"
    assert one(frame, "@wa3ediq", text.escape_formula(v)) == "'@wa3ediq"
    assert one(frame, "regular", text.escape_formula(v)) == "regular"
    assert one(frame, "x" * 600, text.truncate_ellipsis(v, 500)) == "x" * 500 + "..."
    assert one(frame, "x" * 500, text.truncate_ellipsis(v, 500)) == "x" * 500
    assert one(frame, " a\nb" + "c" * 40, text.preview(v)) == "a b" + "c" * 16


@pytest.mark.parametrize("value, day, sheet, csv", [
    ("2025-11-06", "2025-11-06", False, False),
    ("2025-11-07", "2025-11-07", True, False),
    ("2025-11-08", "2025-11-08", True, True),
    ("45963", "2025-11-02", False, True),
    ("45963.75", "2025-11-02", False, True),
    ("Date(1762387200000)", "2025-11-06", False, True),
    ("Date(x)", None, True, True),
    ("n/a", None, True, True),
    ("", None, True, True),
    (None, None, True, True),
    ("2025-02-31", None, True, False),
    ("2025-11-09T10:00", "2025-11-09", True, True),
    ("999999999999", None, True, True),
    ("1.2.3", None, True, True),
    ("Date(99999999999999999)", None, True, True),
])
def test_dates_and_keep_rules(frame, value, day, sheet, csv):
    v = F.col("v")
    assert one(frame, value, clock.normalize_sheet_date(v)) == day
    assert one(frame, value, retention.sheet_keep(v, NOW, 3)) == sheet
    assert one(frame, value, retention.csv_keep(v, "2025-11-10 12:00:00", 3)) == csv


def sheet(frame, rows, header=("Id", " DATE ")):
    cells = [list(header), *[[str(i), d] if d != "blank" else [" ", None] for i, d in enumerate(rows)]]
    return frame([("x", "S", i + 1, c) for i, c in enumerate(cells)], schemas.SHEET)


def test_sheets(frame):
    s = sheet(frame, ["2025-11-06", "2025-11-07", "n/a", "blank", "45963"])
    assert sorted(r["row_index"] for r in retention.retain_sheet(s, NOW, 3).collect()) == [1, 3, 4, 5]
    no_date = sheet(frame, ["2020-01-01"], header=("Id", "When"))
    assert retention.retain_sheet(no_date, NOW, 3).count() == 2
    s = sheet(frame, ["a", "blank", "b", "blank", "blank"])
    assert [r["row_index"] for r in retention.interior_blank_rows(s).collect()] == [3]
    packed = {r["row_index"]: r["cells"][0] for r in retention.compact_sheet(s).collect()}
    assert packed == {1: "Id", 2: "0", 3: "2", 4: " ", 5: " "}
    assert sorted(map(str, retention.compact_sheet(retention.compact_sheet(s)).collect())) == sorted(
        map(str, retention.compact_sheet(s).collect()))
    only_blank = sheet(frame, ["blank", "blank"])
    assert retention.compact_sheet(only_blank).count() == 3


@pytest.mark.parametrize("rows, expected", [(0, 2), (1, 2), (2, 3), (40, 41)])
def test_next_row(frame, rows, expected):
    used = frame([("x", "S", i + 1, ["a"]) for i in range(max(rows, 1))], schemas.SHEET)
    assert project.next_row(used).first()["next_row"] == expected


def test_feed_positions(frame):
    countries = frame([("x", "t", "c", "/f.xlsx", "Major", "Minor"), ("y", None, "c", None, None, None)],
                      "country_code string, alert_target string, alert_channel string, feed_path string, significant_sheet string, trivial_sheet string")
    df = frame([("x", i, "@c", i % 2 == 0) for i in range(6)] + [("y", 9, "@c", True)],
               "country_code string, Message_ID bigint, Channel string, is_significant boolean")
    free = frame([("x", "Major", 10)], "country_code string, sheet string, next_row bigint")
    rows = {(r["sheet"], r["row_index"]): (r["address"], r["cells"][0], r["cells"][1])
            for r in sinks.feed_rows(df, countries, free, ["Message_ID"]).collect()}
    assert rows == {("Major", 10): ("A10:K10", "0", "'@c"), ("Major", 11): ("A11:K11", "2", "'@c"), ("Major", 12): ("A12:K12", "4", "'@c"),
                    ("Minor", 2): ("A2:K2", "1", "'@c"), ("Minor", 3): ("A3:K3", "3", "'@c"), ("Minor", 4): ("A4:K4", "5", "'@c")}
    alerts = sinks.alert_rows(df, countries)
    assert sorted(r["message_id"] for r in alerts.collect()) == [0, 2, 4]


def test_archive_round_trip(frame, spark, tmp_path):
    root = str(tmp_path / "archive")
    assert read_archive(spark, root).count() == 0
    df = frame([(1, "@a", 'say "hi", \\ ok\nnext', True, "x", True, "extra"), (2, "@b", "", None, None, None, "extra")],
               "Message_ID bigint, Channel string, Message_Text string, Was_Translated boolean, country_code string, is_significant boolean, other string")
    sinks.write_archive(df, root)
    sinks.write_archive(df.filter("Message_ID = 2"), root)
    back = read_archive(spark, root)
    rows = {r["Message_ID"]: r for r in back.collect()}
    assert back.columns[:19] == MESSAGE_FIELDS and back.count() == 3
    assert rows["1"]["Message_Text"] == 'say "hi", \\ ok<br>next' and rows["1"]["Was_Translated"] == "True"
    assert (rows["1"]["country_code"], rows["1"]["category"]) == ("x", "significant")
    assert (rows["2"]["country_code"], rows["2"]["category"]) == ("unknown", "trivial") and rows["2"]["Author"] == ""


LOG = """[20251107_10:00:00]: old
 continuation of old
[20251109_10:00:00]: new
 stack trace
[20251107_11:00:00]: old again
 after an old line
[20251340_10:00:00]: impossible stamp
[2025-11-09 04:01:39,123: INFO/MainProcess] x"""


def test_logs(frame):
    lines = frame([("/l/a.log", i + 1, v) for i, v in enumerate(LOG.split("\n"))]
                  + [("/l/b.log", 1, " no stamp"), ("/l/b.log", 2, "[20251108_00:00:00]: edge")], "file string, row bigint, value string")
    kept = retention.retain_logs(lines, NOW, 3)
    assert sorted((r["file"], r["row"]) for r in kept.collect()) == [("/l/a.log", i) for i in (3, 4, 6, 7, 8)]
    parsed = {(r["service"], r["row"]): (r["stamped"], r["logged_at"]) for r in parse_logs(lines).collect()}
    assert parsed["a", 8] == (True, datetime(2025, 11, 9, 4, 1, 39)) and parsed["a", 7] == (True, None)
    assert parsed["a", 2] == (False, None)


def slow_fast_forward(lines, after):
    run = 0
    for row, new in lines:
        run = run + 1 if new else 0
        if run == after:
            return row
    return None


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1000])
def test_fast_forward_over_blocks(frame, chunk):
    patterns = {"a": "NNONNNNNON", "b": "NNNNO", "c": "NNNNN", "d": "ONNONNNNNNO", "e": "O"}
    stamp = {"N": "[20251109_10:00:00]: n", "O": "[20251101_10:00:00]: o"}
    rows, expected = [], {}
    for f, p in patterns.items():
        body = [x for ch in p for x in (stamp[ch], " trace")]
        rows += [(f, i + 1, v) for i, v in enumerate(body)]
        hit = slow_fast_forward([(2 * i + 1, ch == "N") for i, ch in enumerate(p)], 5)
        if hit:
            expected[f] = hit
    df = frame(rows, "file string, row bigint, value string")
    got = retention.fast_forward_row(df, NOW, 3, chunk_rows=chunk)
    assert {r["file"]: r["from_row"] for r in got.collect()} == expected
    kept = retention.mark_logs(df, NOW, 3, fast_forward=True).filter("keep")
    assert kept.filter("file = 'd' and row = 21").count() == 1


def test_read_logs_numbers_lines_across_blocks(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 700)):
        (tmp_path / f"{name}.log").write_text("".join(f"line {i + 1}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_logs(spark, str(tmp_path))
        assert lines.filter(F.col("value") != F.concat(F.lit("line "), F.col("row").cast("string"))).count() == 0
        assert {r["service"]: r["n"] for r in parse_logs(lines).groupBy("service").agg(F.max("row").alias("n")).collect()} == {"a": 5000, "b": 700}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_log_health(frame):
    lines = ["[20251109_10:00:00]: SharePoint response: status=200, worksheet=Major, x", "[20251109_11:00:00]: SharePoint response: status=200, worksheet=Minor, x",
             "[20251109_12:00:00]: Error: timeout", "[20251109_12:00:01]: SharePointInitializationError 403"]
    h = summary.log_health(parse_logs(frame([("/l/s.log", i, v) for i, v in enumerate(lines)], "file string, row bigint, value string"))).first()
    assert (h["successes"], h["last_success"], h["last_worksheet"], h["errors"], h["timeouts"], h["auth_failures"], h["crash_alerts"]) == (
        2, "2025-11-09 11:00:00", "Minor", 2, 1, 1, 1)


def test_retention_job_runs_every_component():
    def broken():
        raise RuntimeError("no sheet")

    result = retention.retention_job({"sheet": broken, "ledger": lambda: 3})
    assert result["status"] == "partial_success" and result["details"]["ledger"] == {"status": "success", "result": 3}
    assert retention.retention_job({"a": lambda: 1})["status"] == "success"


def test_rules(frame):
    v = F.col("v")
    assert [one(frame, n, lookups.retry_delay(v), "v int") for n in range(4)] == [180, 360, 720, 900]
    assert [one(frame, n, lookups.retry_delay(v, 600, None), "v int") for n in range(2)] == [600, 1200]
    codes = {200: "ok", 403: "permanent", 404: "permanent", 401: "retry", 429: "retry", 500: "retry", None: "retry"}
    assert {c: one(frame, c, lookups.delivery_outcome(v), "v int") for c in codes} == codes
    assert one(frame, 500, lookups.delivery_outcome(v, F.lit(3)), "v int") == "failed"
    assert one(frame, 90.0, lookups.resource_excess(v, F.lit(80.0)), "v double") == 12.5
    assert one(frame, 90.0, lookups.resource_excess(v, F.lit(0.0)), "v double") == 0.0
    rate = summary.success_rate(F.lit(200), F.lit(3)), summary.success_rate(F.lit(0), F.lit(0))
    assert tuple(frame([(1,)], "x int").select(*rate).first()) == (98.5, 0.0)
