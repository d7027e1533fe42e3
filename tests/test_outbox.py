"""Deliveries: attempts are counted once, rounds do not send twice, and folding the log changes nothing."""

from datetime import datetime, timedelta

from tidewire.operators import outbox
from tidewire.streaming import store

NOW = datetime(2025, 1, 1)
BOX = ("country_code string, channel string, message_id bigint, sink string, alert_target string, card string, attempts int, "
       "last_status int, last_attempt_at timestamp_ntz")


def box(frame, *ids):
    return frame([("x", "@a", i, "alert", "hook", str(i), 0, None, None) for i in ids], BOX)


def sender(folder, answer):
    """Notes every card it is asked to send."""
    class Sender:
        def send(self, target, card):
            import pathlib
            with pathlib.Path(folder, "sent").open("a") as f:
                f.write(card + "\n")
            return answer(int(card))

    return Sender


def state(df):
    return {r.message_id: (r.attempts, r.last_status) for r in df.collect()}


def test_rounds_retry_until_they_succeed_or_are_used_up(frame, spark, tmp_path):
    root, b = str(tmp_path / "o"), box(frame, 1, 2, 3)
    make = sender(tmp_path, lambda i: {1: 200, 2: 500, 3: 404}[i])
    for k in range(9):
        done = outbox.deliver(b, root, k, NOW + timedelta(hours=k), make, max_attempts=4)
    assert state(done) == {1: (1, 200), 2: (4, 500), 3: (1, 404)}
    assert sorted((tmp_path / "sent").read_text().split()) == ["1", "2", "2", "2", "2", "3"]
    assert [r[0] for r in done.select(outbox.delivery_state(done, 4)).collect()] == ["ok", "failed", "permanent"]


def test_a_logged_round_sends_nothing_again(frame, spark, tmp_path):
    root, b = str(tmp_path / "o"), box(frame, 1)
    for _ in range(3):
        done = outbox.deliver(b, root, 0, NOW, sender(tmp_path, lambda i: 500))
    assert state(done) == {1: (1, 500)} and (tmp_path / "sent").read_text() == "1\n"
    outbox.fold_attempts(spark, root, 0)
    assert state(outbox.deliver(b, root, 0, NOW, sender(tmp_path, lambda i: 500))) == {1: (1, 500)}
    assert (tmp_path / "sent").read_text() == "1\n" and store.versions(spark, f"{root}/log") == []


def test_a_fold_that_was_interrupted_changes_nothing(frame, spark, tmp_path, monkeypatch):
    root, b = str(tmp_path / "o"), box(frame, 1, 2)
    for k in range(3):
        done = outbox.deliver(b, root, k, NOW + timedelta(hours=k), sender(tmp_path, lambda i: None if i == 1 else 200))
    before = state(done)
    with monkeypatch.context() as m:
        m.setattr(store, "remove", lambda *a: None)  # the folded table is there, and the log still is, too
        outbox.fold_attempts(spark, root, 2)
    assert before == {1: (3, None), 2: (1, 200)} == state(outbox.record_delivery(b, outbox.read_attempts(spark, root, 3)))
    assert outbox.read_attempts(spark, root, 3).count() == 2
    outbox.fold_attempts(spark, root, 2)
    assert store.versions(spark, f"{root}/log") == [] and outbox.read_attempts(spark, root, 3).count() == 2


def test_results_of_other_deliveries_and_null_keys(frame):
    b = frame([(None, "@a", 1, "alert", "hook", "c", 0, None, None), ("x", "@a", 2, "alert", "hook", "c", 2, 500, NOW)], BOX)
    results = frame([(None, "@a", "1", "alert", 1, 200, NOW), ("x", "@a", "2", "alert", 2, 200, NOW), ("x", "@b", "9", "alert", 1, 200, NOW)], outbox.ATTEMPTS)
    assert state(outbox.record_delivery(b, results)) == {1: (1, 200), 2: (2, 500)}
    assert state(outbox.record_delivery(b, results.limit(0))) == {1: (0, None), 2: (2, 500)}
