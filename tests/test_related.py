"""Candidate pairs against all pairs, with crowded buckets and odd rows."""

import itertools
import random

import numpy as np
import pytest

from tidewire.operators import related
from tidewire.plans import related_queries


@pytest.mark.parametrize("threshold, cell", [(0.5, 1000), (0.3, 4), (1.0, 3)])
def test_block_pairs_are_all_pairs(frame, threshold, cell):
    rng = random.Random(cell)
    vocabulary = [f"w{k}" for k in range(40)]
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([1, 2]), " ".join(rng.sample(vocabulary, rng.randrange(1, 9)))) for k in range(150)]
    base = rng.sample(vocabulary, 12)
    rows += [(200 + k, "a", 1, " ".join([*base[:k % 12], "x", *base[k % 12 + 1:]])) for k in range(60)]  # a third of all rows, near copies
    rows += [(300 + k, "a", 1, "Same words  words SAME") for k in range(40)] + [(400, "a", 1, ""), (401, "a", 1, None), (402, "a", 1, " \n")]
    df = frame([(*r, "clash", "clash") for r in rows], "message_id bigint, country string, day int, text string, word string, id string")
    got = related.block_pairs(df, ["country", "day"], threshold=threshold, cell=cell).collect()
    sets = {}
    for i, c, d, t in rows:
        w = frozenset((t or "").lower().split())
        if w and c is not None:
            sets[c, d, w] = min(i, sets.get((c, d, w), i))
    expected = {(min(x, y), max(x, y)): len(u & v) / len(u | v) for ((c, d, u), x), ((e, f, v), y) in itertools.combinations(sets.items(), 2)
                if (c, d) == (e, f) and len(u & v) >= threshold * len(u | v) - 1e-12}
    assert len(got) == len(expected) and {(r.a, r.b): r.similarity for r in got} == pytest.approx(expected)
    assert related.block_pairs(df.limit(0), ["country", "day"]).count() == 0


@pytest.mark.parametrize("cell", [1000, 7])
def test_vector_pairs_reach_their_recall(frame, cell):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    rows = [(int(k), (base[k % 60] + 0.25 * rng.normal(size=24)).tolist()) for k in range(300)]
    rows += [(1000 + k, [float(j == 0) + 0.001 * k * (j == 1) for j in range(24)]) for k in range(100)]  # one crowded bucket
    rows += [(k, rows[5][1]) for k in range(2000, 2050)] + [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [float("nan")] * 24), (None, [1.0] * 24),
                                                            (3004, [1.0, 2.0]), (3005, [1.0, 2.1]), (3006, [None] * 24)]
    df = frame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, id int")
    got = {(r.a, r.b): r.similarity for r in related.vector_pairs(df, cell=cell).collect()}
    usable = [(i, np.array(v)) for i, v in rows[:400]]
    pairs = {(i, j): float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) for (i, x), (j, y) in itertools.combinations(usable, 2)}
    true = {p: s for p, s in pairs.items() if s >= 0.9}
    assert got.pop((3004, 3005)) > 0.9
    assert set(got) <= set(true) and len(got) >= 0.95 * len(true) > 4000
    assert all(abs(got[p] - true[p]) < 1e-9 for p in got)
    assert related.vector_pairs(df.limit(0)).count() == 0
    assert related.chance(0.9) > 0.98


def test_blocks_of_usual_size_are_compared_without_rows_of_words(frame, monkeypatch):
    rows = [(k, "ab"[k % 2], " ".join(f"w{j}" for j in range(k % 7, k % 7 + 9))) for k in range(60)]
    rows += [(100, "a", ""), (101, "b", None), (None, "a", "w1 w2"), (102, None, "w1 w2"), (103, "a", "w0 w1 w2 w3 w4 w5 w6 w7"), (103, "a", "w0 w1 w2 w3 w4 w5 w6")]
    df = frame(rows, "message_id bigint, country string, text string")
    by_prefix = {tuple(r) for r in related.block_pairs(df.filter("message_id < 100"), ["country"], threshold=0.4, cell=3, whole=1).collect()}
    some = {tuple(r) for r in related.block_pairs(df.filter("message_id < 100"), ["country"], threshold=0.4, whole=30).collect()}
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a block comes in several batches
    try:
        monkeypatch.setattr(related, "_parts", lambda *a: pytest.fail("words were filed"))
        monkeypatch.setattr(related, "TOLD", 2)
        got = [tuple(r) for r in related.block_pairs(df, ["country"], threshold=0.4).collect()]
    finally:
        df.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(by_prefix) > 20 and by_prefix == some == {r for r in got if r[2] < 100}
    assert len(got) == len(set(got)) and all(r[1] < r[2] for r in got) and any(r[2] == 103 for r in got)
    monkeypatch.undo()
    monkeypatch.setattr(related, "WHOLE_CHARS", 50)  # crowded by text
    assert {tuple(r) for r in related.block_pairs(df.filter("message_id < 100"), ["country"], threshold=0.4).collect()} == by_prefix


def test_many_tables_make_no_copies_of_vectors(frame, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 6))
    rows = [(k, (base[k % 20] + 0.4 * rng.normal(size=6)).astype(np.float32).tolist()) for k in range(200)]
    rows += [(5, rows[7][1]), (900, rows[7][1]), (901, None), (902, [0.0] * 6), (903, [1.0, 2.0]), (904, [1.0, 2.1]), (905, [None] * 6), (None, [1.0] * 6), (3, [1.0] * 6)]
    df = frame(rows, "vec_id bigint, embedding array<float>")
    buckets = {(r.a, r.b): r.similarity for r in related.vector_pairs(df, threshold=0.6, tables=3, bits=2, cell=9).collect()}
    monkeypatch.setattr(related, "_parts", lambda *a: pytest.fail("vectors were filed by table"))
    monkeypatch.setattr(related, "BLOCK", 16)
    distinct = df.filter("vec_id is not null and embedding is not null").selectExpr("vec_id id", "embedding v").groupBy("v").agg({"id": "min"}).withColumnRenamed("min(id)", "id")
    met = {(r.a, r.b): r.similarity for r in related._pairs_by_blocks(distinct, 0.6, 3, 2, 3).groupBy("a", "b").agg({"similarity": "max"}).toDF("a", "b", "similarity").collect()}
    assert met == pytest.approx(buckets) and len(met) > 500  # the same pairs, also those that no table finds left out
    every = related.vector_pairs(df, threshold=0.6, tables=64, bits=4).collect()
    assert {(r.a, r.b) for r in every} > set(met) and (903, 904) in {(r.a, r.b) for r in every}
    assert related.vector_pairs(df.limit(0), tables=64, bits=4).count() == 0


def test_only_texts_of_pairs_are_moved_to_the_model(spark, tmp_path):
    texts = ["one two three four", "one two three five six", "alpha beta gamma", "delta"] + [f"x{k} y{k}" for k in range(30)]
    rows = [(k, t, "en", "site2") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        judged = related_queries.related_judged(spark, str(tmp_path))
        assert judged._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2  # each side of a pair
        assert [tuple(r) for r in judged.collect()] == [(0, 1, False)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
