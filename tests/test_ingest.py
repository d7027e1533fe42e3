from datetime import datetime, timedelta

import pytest

from tidewire import schemas
from tidewire.operators import ingest, routing
from tidewire.operators.summary import failure_status, run_log
from pyspark.sql import functions as F

NOW = datetime(2025, 11, 10, 12)
FEED = "channel string, message_id bigint, date timestamp_ntz, text string"
C = "@testchannel"


def feed(frame, *items):
    return frame([(C, i, NOW - timedelta(minutes=m), "x") for i, m in items], FEED)


def state(frame, tracker=(), ledger=()):
    last = frame([(C, t) for t in tracker], "channel string, last_id bigint")
    led = frame([(C, i, NOW - timedelta(hours=h)) for i, h in ledger], schemas.LEDGER)
    return last, led


@pytest.mark.parametrize("items, tracker, ledger, accepted", [
    ([(101, 0), (102, 5)], [100], [], [101, 102]),
    ([(101, 0), (102, 5)], [], [], [101]),
    ([(101, 0), (102, 60), (103, 300), (104, 360)], [100], [], [101, 102]),
    ([(101, 0), (102, 0)], [100], [(101, 1)], [102]),
    ([(101, 0)], [100], [(101, 25)], [101]),
    ([(99, 0), (100, 0), (101, 0)], [100], [], [101]),
    ([(i, 0) for i in range(101, 131)], [100], [], list(range(111, 131))),
])
def test_fetch(frame, items, tracker, ledger, accepted):
    last, led = state(frame, tracker, ledger)
    marked = ingest.mark_fetch(feed(frame, *items), last, led, NOW, limit=100)
    assert sorted(r["message_id"] for r in ingest.accepted(marked).collect()) == accepted


def test_summary_and_tracker(frame):
    last, led = state(frame, [100], [(103, 2)])
    df = feed(frame, (101, 0), (102, 300), (103, 1), (104, 2))
    marked = ingest.mark_fetch(df, last, led, NOW)
    row = ingest.fetch_summary(marked).first()
    assert (row["strategy"], row["checked"], row["new"], row["duplicates"], row["too_old"]) == ("ID-based", 4, 2, 1, 1)
    old = frame([(C, 100, NOW - timedelta(hours=2)), ("@quiet", 5, NOW - timedelta(hours=1))], schemas.TRACKER)
    moved = {r["channel"]: (r["last_id"], r["updated_at"]) for r in ingest.next_tracker(ingest.accepted(marked), old, NOW).collect()}
    assert moved == {C: (104, NOW), "@quiet": (5, NOW - timedelta(hours=1))}
    nothing = ingest.next_tracker(ingest.accepted(marked).filter("false"), old, NOW)
    assert {r["last_id"] for r in nothing.collect()} == {100, 5}
    log = run_log(marked.withColumn("empty", F.col("message_id") == 101), NOW).first()
    assert (log["status"], log["messages_processed"], log["messages_skipped"]) == ("success", 1, 1)


def test_last_id_precedence(frame):
    channels = frame([("@a", "x", 0), ("@a", "y", 1), ("@b", "y", 1), ("@c", "x", 0), ("@d", "x", 0)],
                     "channel string, country_code string, country_pos int")
    tracker = frame([("@a", 50, NOW - timedelta(hours=1)), ("@b", 60, NOW - timedelta(hours=25))], schemas.TRACKER)
    archive = frame([("@a", "99", "x"), ("@b", "7", "y"), ("@b", "9", "y"), ("@b", "n/a", "y"), ("@b", "11", "x"), ("@d", "0", "x")],
                    "Channel string, Message_ID string, country_code string")
    got = {r["channel"]: (r["last_id"], r["source"]) for r in ingest.resolve_last_id(channels, tracker, archive, NOW).collect()}
    assert got == {"@a": (50, "tracker"), "@b": (9, "archive"), "@c": (None, None), "@d": (None, None)}
    assert [(r["channel"], r["last_id"]) for r in ingest.seed_tracker(
        ingest.resolve_last_id(channels, tracker, archive, NOW), NOW).collect()] == [("@b", 9)]


def test_dedupe_is_idempotent(frame):
    df = feed(frame, (1, 0), (2, 0), (2, 3), (3, 0))
    once = ingest.first_per_key(df)
    assert sorted(r["message_id"] for r in once.collect()) == [1, 2, 3]
    ledger = ingest.ledger_entries(once, NOW)
    assert ingest.dedupe_against_ledger(once, ledger, NOW).count() == 0
    assert ingest.dedupe_against_ledger(once, ledger, NOW + timedelta(hours=24)).count() == 3


def test_expiry(frame):
    rows = [(1, None), (2, NOW - timedelta(hours=1)), (3, NOW + timedelta(hours=1)), (4, NOW + timedelta(days=9))]
    kept = ingest.expire_ledger(frame(rows, "id int, expires_at timestamp_ntz"), NOW)
    assert {r["id"]: r["expires_at"] for r in kept.collect()} == {
        3: NOW + timedelta(hours=1), 4: NOW + timedelta(hours=24)}


def test_routing(frame):
    channels = frame([("@a", "x", "X"), ("@a", "y", "Y")], "channel string, country_code string, country_name string")
    df = frame([("@a", 1), ("@z", 2)], "channel string, message_id int")
    assert sorted((r["message_id"], r["country_code"]) for r in routing.route_country(df, channels).collect()) == [(1, "x"), (1, "y")]
    assert routing.route_country(df, channels, "left").count() == 3
    split = frame([(1, True), (2, False), (3, None)], "id int, is_significant boolean")
    yes, no = routing.route_split(split)
    assert [r["id"] for r in yes.collect()] == [1] and sorted(r["id"] for r in no.collect()) == [2, 3]


@pytest.mark.parametrize("text, status", [
    ("Rate limit hit", "rate_limited"), ("session safety check failed", "skipped_safety"), ("session lost", "session_error"),
    ("Auth failed", "auth_error"), ("read timeout", "timeout"), ("boom", "error")])
def test_failure_status(frame, text, status):
    assert frame([(text,)], "e string").select(failure_status(F.col("e"))).first()[0] == status
