"""Deliveries over several rounds, with a scripted receiver."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.operators import outbox
from tidewire.plans import bindings as b
from tidewire.plans.registry import query
from tidewire.session import shared_dir

START = datetime.fromisoformat(b.NOW)
ROUNDS, STEP = 8, 400


def _receiver():
    """Answers by the type of the event and by how often it was asked: the card holds the type and a number."""
    class Receiver:
        def send(self, target, card):
            kind, number = card.split(" ")
            if kind == "signup" and int(number) % 2:
                raise TimeoutError
            return {"click": 200, "view": 403, "error": 429 if int(number) % 3 else 200, "purchase": 500, "signup": 200}[kind]

    return Receiver


def _box(spark, sf):
    return b.table(spark, sf, "events").select(
        F.lit("alpha").alias("country_code"), F.concat(F.lit("@user"), F.col("user_id").cast("string")).alias("channel"),
        F.col("event_id").alias("message_id"), F.lit("alert").alias("sink"), F.lit("https://hooks.example.com/alpha").alias("alert_target"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("card"), F.lit(0).alias("attempts"),
        F.lit(None).cast("int").alias("last_status"), F.lit(None).cast("timestamp_ntz").alias("last_attempt_at"))


# Round by round, from the rule alone: a try while it is due, the wait doubling from three minutes to fifteen.
_ROUNDS = f"""WITH RECURSIVE sent AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 403 WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 200 ELSE 429 END
    WHEN 'purchase' THEN 500 WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 200 END END AS st FROM events),
r AS (
  SELECT event_id, st, 0 AS round, 1 AS attempts, 0 AS tried_at FROM sent
  UNION ALL
  SELECT event_id, st, round + 1, attempts + CAST(due AS INT), CASE WHEN due THEN (round + 1) * {STEP} ELSE tried_at END
  FROM (SELECT *, attempts < 5 AND (st IS NULL OR st NOT IN (200, 403, 404)) AND tried_at + least(180 * power(2, attempts - 1), 900) <= (round + 1) * {STEP} AS due
        FROM r WHERE round < {ROUNDS - 1}))"""


@query(f"""{_ROUNDS} SELECT event_id AS message_id, CAST(attempts AS BIGINT) AS attempts, CAST(st AS BIGINT) AS last_status,
 strftime(TIMESTAMP '{b.NOW}' + tried_at * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS last_attempt_at,
 CASE WHEN st = 200 THEN 'ok' WHEN st = 403 THEN 'permanent' WHEN attempts >= 5 THEN 'failed' ELSE 'retry' END AS state
FROM r WHERE round = {ROUNDS - 1}""")
def outbox_rounds(spark, sf):
    """Eight rounds of deliveries, the log folded once in between and one round asked for twice."""
    root, box = shared_dir(spark, "outbox"), _box(spark, sf)
    for number in range(ROUNDS):
        now = START + timedelta(seconds=STEP * number)
        done = outbox.deliver(box, root, number, now, _receiver())
        if number == 3:
            outbox.deliver(box, root, number, now, _receiver())
            outbox.fold_attempts(spark, root, 2)
    return done.select("message_id", F.col("attempts").cast("bigint").alias("attempts"), F.col("last_status").cast("bigint").alias("last_status"),
                       F.date_format("last_attempt_at", "yyyy-MM-dd HH:mm:ss").alias("last_attempt_at"), outbox.delivery_state(done).alias("state"))


@query("""SELECT event_id AS message_id, CAST(CASE WHEN event_id % 4 = 0 THEN 3 WHEN event_id % 4 = 1 THEN 2 ELSE 0 END AS BIGINT) AS attempts,
 CAST(CASE WHEN event_id % 4 = 0 THEN 200 WHEN event_id % 4 = 1 THEN 500 END AS BIGINT) AS last_status FROM events""")
def record_delivery(spark, sf):
    """Results told twice, late and out of order: the attempt with the highest number counts."""
    box = _box(spark, sf)
    tried = box.filter("message_id % 4 < 2").select(
        *[F.col(k).cast("string").alias(k) for k in outbox.KEY],
        F.explode(F.when(F.col("message_id") % 4 == 0, F.array(*map(F.lit, (3, 1, 2, 3)))).otherwise(F.array(*map(F.lit, (2, 1))))).alias("attempt"),
    ).withColumn("status", F.when(F.col("attempt") == 3, 200).otherwise(500)).withColumn("attempted_at", F.lit(b.NOW).cast("timestamp_ntz"))
    done = outbox.record_delivery(outbox.record_delivery(box, tried.filter("attempt > 1")), tried)
    return done.select("message_id", F.col("attempts").cast("bigint").alias("attempts"), F.col("last_status").cast("bigint").alias("last_status"))
