import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.operators.summary import daily_stream
from tidewire.streaming import keyed, metrics, pipeline, store

NOW = datetime(2025, 11, 10, 12)


def raw(i, text, channel="@a", minutes=0, media=None):
    return (i, channel, NOW - timedelta(minutes=minutes), text, None, None, None, None, media, None)


@pytest.fixture
def setup(frame, tmp_path):
    def build(**over):
        countries = frame([("x", "X", "hook", "c", "/f.xlsx", "Major", "Minor", True, False, False, True, False, [])],
                          "country_code string, name string, alert_target string, alert_channel string, feed_path string, significant_sheet string, "
                          "trivial_sheet string, has_filtering boolean, use_ai_for_message_filtering boolean, use_ai_for_enhanced_filtering boolean, "
                          "translate_trivial_msgs boolean, use_ai_for_translation boolean, additional_ai_criteria array<string>")
        channels = frame([("@a", "x", "X", 0), ("@b", "x", "X", 0)], "channel string, country_code string, country_name string, country_pos int")
        words = frame([("x", "significant", 0, 0, "storm", "storm")], schemas.KEYWORDS)
        return pipeline.Settings(**{**dict(root=str(tmp_path / "state"), channels=channels, countries=countries, keywords=words,
                                           clock=lambda: NOW), **over})
    return build


def ids(spark, path, column="Message_ID"):
    return sorted(int(r[0]) for r in spark.read.parquet(path).select(column).collect())


def write(frame, path, rows):
    frame(rows, schemas.RAW_MESSAGE).coalesce(1).write.mode("append").parquet(path)


def test_stream_in_steps(frame, spark, setup, tmp_path):
    inbox, s = str(tmp_path / "inbox"), setup()
    from tidewire.sources.feeds import stream_channel_feed

    def run():
        q = pipeline.start_ingest(stream_channel_feed(spark, inbox), s, every=None)
        q.awaitTermination()
        return q

    write(frame, inbox, [raw(1, "storm"), raw(2, "calm"), raw(2, "calm"), raw(3, ""), raw(4, "", media=("photo", None, None, None)), raw(9, "storm", "@lost")])
    run()
    # A channel that no country lists is archived as unknown, and goes to no feed and no alert.
    assert ids(spark, f"{s.root}/archive") == [1, 2, 9] and ids(spark, f"{s.root}/outbox", "message_id") == [1]
    assert ids(spark, f"{s.root}/archive/batch_id=0/country_code=unknown") == [9]
    assert ids(spark, f"{s.root}/ledger", "message_id") == [1, 2, 4, 9]
    write(frame, inbox, [raw(2, "again"), raw(5, "storm"), raw(6, "late", minutes=300)])
    q = run()
    assert ids(spark, f"{s.root}/archive") == [1, 2, 5, 9]
    tracker = store.read_state(spark, f"{s.root}/tracker", 99, schemas.TRACKER)
    assert {r["channel"]: r["last_id"] for r in tracker.collect()} == {"@a": 5, "@lost": 9}
    feed = {(r["sheet"], r["row_index"]) for r in spark.read.parquet(f"{s.root}/feed").collect()}
    assert feed == {("Major", 2), ("Major", 3), ("Minor", 2)}
    assert sum(p["observedMetrics"]["intake"]["messages"] for p in q.recentProgress if p["observedMetrics"]) == 3
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_a_batch_can_run_again(frame, spark, setup):
    s = setup()
    batch = frame([raw(1, "storm"), raw(2, "calm")], schemas.RAW_MESSAGE)
    pipeline.process_batch(batch, 0, s)
    pipeline.process_batch(batch, 0, s)
    assert ids(spark, f"{s.root}/archive") == [1, 2] and ids(spark, f"{s.root}/feed", "row_index") == [2, 2]
    pipeline.process_batch(batch, 1, s)
    assert ids(spark, f"{s.root}/archive") == [1, 2]


def test_no_message_of_a_busy_channel_is_lost(frame, spark, setup):
    s = setup()
    pipeline.process_batch(frame([raw(i, "storm") for i in range(1, 31)], schemas.RAW_MESSAGE), 0, s)
    assert ids(spark, f"{s.root}/archive") == list(range(1, 31))


def test_a_batch_keeps_its_time(frame, spark, setup):
    s = setup()
    batch = frame([raw(i, "storm") for i in range(1, 6)], schemas.RAW_MESSAGE)
    pipeline.process_batch(batch, 0, s)
    s.clock = lambda: NOW + timedelta(hours=5)
    pipeline.process_batch(batch, 0, s)
    assert ids(spark, f"{s.root}/outbox", "message_id") == [1, 2, 3, 4, 5]
    assert [r["v"] for r in spark.read.parquet(f"{s.root}/ledger").select("v").distinct().collect()] == [0]
    assert spark.read.parquet(f"{s.root}/ledger").select("hour").distinct().count() == 1


def test_late_messages_are_not_taken_for_repeats(frame, spark, tmp_path):
    from tidewire.sources.feeds import stream_channel_feed

    inbox = str(tmp_path / "inbox")

    def run():
        stream = pipeline.dedupe_stream(stream_channel_feed(spark, inbox))
        (stream.select("message_id").writeStream.option("checkpointLocation", str(tmp_path / "checkpoint"))
         .trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination())

    for days in (0, 3, 6):  # newest first, with one repeat in each file
        write(frame, inbox, [raw(i + days, "storm", minutes=days * 1440) for i in range(3)] + [raw(0, "again")])
        run()
    assert ids(spark, str(tmp_path / "out"), "message_id") == list(range(9))


def test_the_run_log_is_a_table(frame, spark, setup):
    s = setup()
    pipeline.process_batch(frame([raw(1, "storm"), raw(2, "", media=("photo", None, None, None))], schemas.RAW_MESSAGE), 0, s)
    log = pipeline.read_run_log(spark, s.root).first()
    assert (log["status"], log["channels_checked"], log["messages_processed"], log["messages_skipped"], log["sink"]) == ("success", 2, 1, 1, None)


def test_every_failed_attempt_leaves_one_record(frame, spark, setup, monkeypatch):
    def broken(df, batch_id):
        raise ValueError("Timeout while sending")

    s = setup(handler=broken)
    batch = frame([raw(1, "storm")], schemas.RAW_MESSAGE)
    for _ in range(2):
        with pytest.raises(pipeline.BatchFailed):
            pipeline.process_batch(batch, 0, s)
    s.handler = None
    with monkeypatch.context() as m:
        m.setattr(pipeline, "enrich", lambda *a: (_ for _ in ()).throw(KeyError("no model")))
        with pytest.raises(KeyError):
            pipeline.process_batch(batch, 0, s)
    pipeline.process_batch(batch, 0, s)
    pipeline.process_batch(batch, 0, s)  # a repeat of a success is still one record
    log = sorted((r["status"], r["sink"] or "", r["attempt"] or 0, r["batch_id"]) for r in pipeline.read_run_log(spark, s.root).collect())
    assert log == [("error", "batch", 3, 0), ("success", "", 0, 0), ("timeout", "handler", 1, 0), ("timeout", "handler", 2, 0)]


def test_a_message_without_channel_is_named_by_its_chat(frame, spark, setup):
    s = setup()
    chat = (None, 77, None)
    rows = [(1, None, NOW, "storm", None, chat, None, None, None, None), (2, None, NOW, "calm", None, chat, None, None, None, None)]
    pipeline.process_batch(frame(rows, schemas.RAW_MESSAGE), 0, s)
    got = spark.read.parquet(f"{s.root}/archive").select("Channel", "country_code").distinct().collect()
    assert [tuple(r) for r in got] == [("Channel_77", "unknown")]


def test_the_first_batch_again_reads_the_archive_that_it_found(frame, spark, setup):
    s = setup()
    (frame([("@a", "2", "x")], "Channel string, Message_ID string, country_code string").withColumn("batch_id", F.lit(-1))
     .withColumn("category", F.lit("trivial")).write.partitionBy("batch_id", "country_code", "category").parquet(f"{s.root}/archive"))
    batch = frame([raw(i, "storm", minutes=60) for i in range(1, 6)], schemas.RAW_MESSAGE)  # too old for a channel without last id
    for _ in range(2):
        pipeline.process_batch(batch, 0, s)
        assert ids(spark, f"{s.root}/archive/batch_id=0") == [3, 4, 5]


def test_late_rows_are_left_out_and_counted(frame, spark, tmp_path):
    inbox, rows = str(tmp_path / "inbox"), "date timestamp_ntz, channel string, is_significant boolean, is_error boolean"
    table = metrics.ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(table)

    def run(*messages):
        frame([(NOW - timedelta(days=d), c, True, False) for d, c in messages], rows).coalesce(1).write.mode("append").parquet(inbox)
        q = (daily_stream(spark.readStream.schema(rows).parquet(inbox), "1 hour").writeStream.outputMode("append")
             .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
             .format("parquet").option("path", str(tmp_path / "out")).start())
        q.awaitTermination()
        assert table.wait(q)

    try:
        run((3, "@a"), (3, "@b"), (3, "@a"), (2, "@a"), (0, "@a"))
        run((3, "@late"), (0, "@b"), (-2, "@a"))
    finally:
        spark.streams.removeListener(table)
    got = {r["day"]: (r["total_messages"], r["channels_monitored"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2025-11-07": (3, 2), "2025-11-08": (1, 1), "2025-11-10": (2, 2)}
    progress = metrics.read_progress(spark, str(tmp_path / "progress"))
    assert progress.agg(F.sum("late_rows"), F.sum("rows")).first()[:] == (1, 8)
    assert metrics.read_ends(spark, str(tmp_path / "progress")).count() == 2


def test_the_end_of_a_failed_query_is_kept(frame, spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    write(frame, inbox, [raw(1, "storm")])
    table = metrics.ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(table)
    try:
        q = (pipeline.intake_metrics(spark.readStream.schema(schemas.RAW_MESSAGE).parquet(inbox)).filter("assert_true(message_id > 5) is null")
             .writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("noop").start())
        with pytest.raises(Exception):
            q.awaitTermination()
        assert table.wait(q)
    finally:
        spark.streams.removeListener(table)
    assert metrics.read_ends(spark, str(tmp_path / "progress")).first()["error"]


def test_counters_survive_a_restart_and_expire(frame, spark, tmp_path):
    inbox, root, schema = str(tmp_path / "inbox"), str(tmp_path / "state"), "source string, n int"

    def run(ttl, *rows):
        frame(list(rows), schema).coalesce(1).write.mode("append").parquet(inbox)
        keyed.start_keyed(keyed.throttle_stream(spark.readStream.schema(schema).parquet(inbox), 3, ttl=ttl), root).awaitTermination()
        return sorted((r["source"], r["error_number"]) for r in spark.read.parquet(f"{root}/out").collect())

    assert run(600, *[("x", k) for k in range(4)], ("y", 0), (None, 0)) == [("x", 3)]
    assert run(600, ("x", 9), ("x", 10), ("y", 1), ("y", 2)) == [("x", 3), ("x", 6), ("y", 3)]


def test_an_expired_counter_begins_again(frame, spark, tmp_path):
    inbox, root, schema = str(tmp_path / "inbox"), str(tmp_path / "state"), "source string, n int"

    def run(*rows):
        frame(list(rows), schema).coalesce(1).write.mode("append").parquet(inbox)
        keyed.start_keyed(keyed.throttle_stream(spark.readStream.schema(schema).parquet(inbox), 3, ttl=1), root).awaitTermination()
        return sorted(r["error_number"] for r in spark.read.parquet(f"{root}/out").collect())

    run(("x", 1), ("x", 2))
    time.sleep(1.5)
    assert run(("x", 3)) == []
    time.sleep(1.5)
    assert run(("x", 4), ("x", 5), ("x", 6)) == [3]


def test_marks_move_with_the_highest_message(frame, spark, tmp_path):
    inbox, root, schema = str(tmp_path / "inbox"), str(tmp_path / "state"), "channel string, message_id bigint"
    seeds = frame([("@a", 5), ("@a", 3), ("@b", None)], "channel string, last_id bigint")

    def run(*rows):
        frame(list(rows), schema).coalesce(1).write.mode("append").parquet(inbox)
        keyed.start_keyed(keyed.newer_stream(spark.readStream.schema(schema).parquet(inbox), seeds), root).awaitTermination()
        return sorted((r["channel"], r["message_id"]) for r in spark.read.parquet(f"{root}/out").collect())

    assert run(("@a", 9), ("@a", 4), ("@a", 6), ("@b", 1), ("@c", 2), ("@c", None)) == [("@a", 6), ("@a", 9), ("@b", 1), ("@c", 2)]
    assert run(("@a", 7), ("@a", 10), ("@b", 1), ("@c", 1)) == [("@a", 6), ("@a", 9), ("@a", 10), ("@b", 1), ("@c", 2)]


def test_a_failed_sink_does_not_stop_the_others(frame, spark, setup):
    def broken(df, batch_id):
        raise ValueError("no network")

    s = setup(handler=broken)
    batch = frame([raw(1, "storm")], schemas.RAW_MESSAGE)
    with pytest.raises(RuntimeError, match="handler: no network"):
        pipeline.process_batch(batch, 0, s)
    assert ids(spark, f"{s.root}/archive") == [1]
    assert store.versions(spark, f"{s.root}/tracker") == []
    s.handler = None
    pipeline.process_batch(batch, 0, s)
    assert ids(spark, f"{s.root}/archive") == [1] and store.versions(spark, f"{s.root}/tracker") == [0]


def test_state_versions(frame, spark, tmp_path):
    root = str(tmp_path / "state")
    for v in range(14):
        store.write_state(frame([(v,)], "n int"), root, v)
    assert store.versions(spark, root) == list(range(4, 14))
    assert store.read_state(spark, root, 9, "n int").first()[0] == 8
    assert store.read_state(spark, root, 0, "n int").count() == 0
    led = str(tmp_path / "ledger")
    for hours, v in ((30, 0), (23, 1), (0, 2)):
        t = NOW - timedelta(hours=hours)
        store.write_ledger(frame([("@a", v, t)], schemas.LEDGER), led, v, t)
    assert sorted(r["message_id"] for r in store.read_ledger(spark, led, 9, NOW).collect()) == [1, 2]
    assert [r["message_id"] for r in store.read_ledger(spark, led, 2, NOW).collect()] == [1]
    assert store.drop_expired_hours(spark, led, NOW) == 1 and spark.read.parquet(led).count() == 2


def test_batch_with_model_and_service(frame, spark, setup):
    class Model:
        def complete(self, prompt):
            return "Significant: flood" if "water" in prompt.split("Message: ")[-1] else "Trivial"

    class Service:
        def translate(self, text, source):
            return "water everywhere", "ar"

    base = setup()
    countries = base.countries.withColumn("use_ai_for_message_filtering", base.countries["has_filtering"])
    s = setup(countries=countries, model=Model, service=Service)
    batch = frame([raw(1, "deep water"), raw(2, "calm"), raw(3, "ماء في كل مكان")], schemas.RAW_MESSAGE)
    pipeline.process_batch(batch, 0, s)
    got = {r["Message_ID"]: (r["category"], r["Message_Text"], r["Original_Language"], r["Was_Translated"], r["Keywords_Matched"])
           for r in spark.read.parquet(f"{s.root}/archive").collect()}
    assert got == {"1": ("significant", "deep water", "English", "False", "flood"), "2": ("trivial", "calm", "English", "False", ""),
                   "3": ("trivial", "water everywhere", "Ar", "True", "")}


def test_backend_errors_are_kept_and_told(frame, spark, setup):
    class Service:
        def translate(self, text, source):
            raise ConnectionError("down")

    s = setup(translator=None, service=Service)
    for n in range(2):
        pipeline.process_batch(frame([raw(100 * n + k, f"ماء كثير {k}") for k in range(15)], schemas.RAW_MESSAGE), n, s)
    failed = spark.read.parquet(f"{s.root}/backend_errors")
    assert failed.count() == 30 and {tuple(r) for r in failed.select("source", "error").distinct().collect()} == {("translation", "google: down")}
    told = spark.read.parquet(f"{s.root}/admin_outbox").collect()
    assert [(r["error_number"], r["message"], r["message_id"]) for r in told] == [(20, "google: down", 104)]
    assert spark.read.parquet(f"{s.root}/archive").count() == 30
