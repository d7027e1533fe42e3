import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewire.operators import scale


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_salted_join_equals_plain_join(frame, how):
    fact = frame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)] + [(1000, None)], "id int, k string")
    dim = frame([("hot", 1), ("k0", 2), ("k5", 3), ("none", 4)], "k string, v int")
    plain = sorted(map(str, fact.join(dim, ["k"], how).collect()))
    for rows in (0, 100):
        got = scale.join_dimension(fact, dim, ["k"], how, max_rows=rows, salts=5)
        assert sorted(map(str, got.collect())) == plain


def test_large_dimension_is_not_broadcast(frame):
    fact, dim = frame([(1, "a")], "id int, k string"), frame([("a", 1), ("b", 2)], "k string, v int")
    logical = scale.join_dimension(fact, dim, ["k"], max_rows=1)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in logical.lower()


def rank(rows):
    """``row_number()`` per key on plain tuples ``(key, order)``."""
    out, seen = {}, {}
    for k, o in sorted(rows, key=lambda r: (r[1] is not None, r[1])):
        seen[k] = seen.get(k, 0) + 1
        out[k, o] = seen[k]
    return out


@pytest.mark.parametrize("stage", [False, True])
def test_numbering_of_a_hot_key(frame, stage, monkeypatch):
    # Two thirds of the rows share a key, and half of them one first order column.
    rows = [("hot" if i % 3 else f"k{i % 5}", 7 if i % 2 else i, i) for i in range(4000)]
    df = frame(rows, "k string, a int, b int").repartition(8)
    got = scale.number_rows(df, ["k"], ["a", "b"], "n", chunks=16, stage=stage)
    expected = rank([(k, (a, b)) for k, a, b in rows])
    found = {(r["k"], (r["a"], r["b"])): r["n"] for r in got.collect()}
    assert found == expected
    cuts = scale._boundaries(df, ["a", "b"], 16)
    assert len(cuts) >= 14 and len(cuts[0]) == 2
    parts = df.groupBy(scale._chunk(["a", "b"], dict(df.dtypes), cuts).alias("c")).count().collect()
    assert max(r["count"] for r in parts) < 1000


def test_parts_grow_and_rows_are_shuffled_once(frame, monkeypatch):
    monkeypatch.setattr(scale, "ROWS_PER_PART", 100)
    assert [scale._parts_for(n) for n in (0, 3_000, 4_000, 10 ** 9)] == [32, 32, 40, 512]
    rows = [("hot" if i % 3 else f"k{i % 5}", i) for i in range(4000)]
    got = scale.number_rows(frame(rows, "k string, o int"), ["k"], ["o"], "n")
    assert {(r["k"], r["o"]): r["n"] for r in got.collect()} == rank(rows)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 10 ** 6)), min_size=70, max_size=120, unique=True))
def test_numbering_is_exact(frame, rows):
    df = frame(rows, "k string, o int")
    cuts = scale._boundaries(df, ["o"], 4, per_chunk=8)
    assert cuts
    got = scale.number_rows(df, ["k"], ["o"], "n", chunks=2)
    assert {(r["k"], r["o"]): r["n"] for r in got.collect()} == rank(rows)


def test_numbering_with_null_keys_and_order(frame):
    rows = [(None if i % 4 else "x", None if i == 9 else i) for i in range(300)]
    df = frame(rows, "k string, o int")
    got = scale.number_rows(df, ["k"], ["o"], "n", chunks=4)
    assert {(r["k"], r["o"]): r["n"] for r in got.collect()} == rank(rows)


def test_first_rows_are_cut_before_the_shuffle(frame):
    from tidewire.operators.ingest import latest_n
    df = frame([("c", i) for i in range(100)], "channel string, message_id int")
    plan = latest_n(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert sorted(r["message_id"] for r in latest_n(df, 5).collect()) == [95, 96, 97, 98, 99]
    assert latest_n(df, 50).count() == 20 and latest_n(df, 50, cap=None).count() == 50


def test_small_files_are_read_by_few_tasks_and_large_tables_by_more(spark):
    cores = spark.sparkContext.defaultParallelism
    tasks = lambda n: scale.few_tasks(spark.range(0, n, 1, n)).rdd.getNumPartitions()
    assert [tasks(n) for n in (5, 100 * cores, 1024 * cores)] == [5, 32 * cores, 64 * cores]
    assert scale.few_tasks(spark.range(0, 1000, 1, 700)).selectExpr("sum(id)", "count(*)").first() == (499500, 1000)
