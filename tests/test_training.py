"""Snapshot differences, uneven keys, orphan references on literal fixtures."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyloom.common import current_rows, heavy_keys, salted_join
from tallyloom.operators.eager import eager_join_aggregate
from tallyloom.operators.orphans import orphan_references, orphan_report, parent_intervals
from tallyloom.operators.snapshots import snapshot_changes

SNAP = "snapshot_no int, k int, g string, v int, w int, loaded_at timestamp, change string, n int"


def snap(spark, data):
    """Rows with extra columns whose names clash with those of the result."""
    return spark.createDataFrame([(s, k, g, v, w, t, "extra", 9) for s, k, g, v, w, t in data], "snapshot_no int, k int, g string, v int, w int, t string, change string, n int").selectExpr(
        "snapshot_no", "k", "g", "v", "w", "cast(t as timestamp_ntz) AS loaded_at", "change", "n"
    )


def brute_changes(data):
    now = {}
    for s, k, g, v, w, t in data:
        if s is None:
            continue
        at = (s, k, g)
        # Stamps of one key and snapshot differ in these fixtures, or the rows are equal.
        if at not in now or (t or "") >= now[at][0]:
            now[at] = (t or "", v, w)
    numbers = sorted({s for s, *_ in now})
    out = []
    for n in range(numbers[0] + 1, numbers[-1] + 1) if numbers else ():
        for k, g in {(k, g) for s, k, g in now if s in (n - 1, n)}:
            a, b = now.get((n - 1, k, g)), now.get((n, k, g))
            if a and not b:
                out.append((k, g, n, "removed"))
            elif b and not a:
                out.append((k, g, n, "added"))
            elif a[1:] != b[1:]:
                out.append((k, g, n, "changed"))
    return sorted(out, key=repr)


def test_changes_fixture(spark):
    data = [
        (1, 1, "a", 5, None, "2026-01-01"),
        (1, 1, "a", 5, None, "2026-01-01"),
        (2, 1, "a", 5, 0, "2026-02-01"),
        (1, 2, "a", 3, 1, "2026-01-01"),
        (2, 2, "a", 3, 1, "2026-02-01"),
        (1, 3, None, 1, 1, "2026-01-01"),
        (2, 4, "a", 7, 7, "2026-02-01"),
        (2, 4, "a", 8, 7, "2026-02-03"),
        (3, 4, "a", 8, 7, "2026-03-01"),
        (3, None, "a", None, None, "2026-03-01"),
        (None, 9, "a", 1, 1, "2026-01-01"),
    ]
    got = rows(snapshot_changes(snap(spark, data), ["k", "g"], ["v", "w"]))
    assert got == brute_changes(data)
    assert (1, "a", 2, "changed") in got and (3, None, 2, "removed") in got and (4, "a", 2, "added") in got


def test_changes_empty_and_gap(spark):
    assert rows(snapshot_changes(snap(spark, []), ["k", "g"], ["v"])) == []
    data = [(1, 1, "a", 1, 1, "2026-01-01"), (3, 1, "a", 1, 1, "2026-01-01")]
    assert rows(snapshot_changes(snap(spark, data), ["k", "g"], ["v"])) == [(1, "a", 2, "removed"), (1, "a", 3, "added")]
    many = [(i, 1, "a", i // 7, 1, "2026-01-01") for i in range(1, 80)]
    assert rows(snapshot_changes(snap(spark, many), ["k", "g"], ["v"])) == brute_changes([(s, k, g, v, None, t) for s, k, g, v, w, t in many])


def test_changes_ties_prefer_one_value(spark):
    data = [(1, 1, "a", 1, 1, "2026-01-01"), (1, 1, "a", 2, 1, "2026-01-01"), (2, 1, "a", 1, 1, "2026-02-01"), (2, 1, "a", 2, 1, "2026-02-01")]
    assert rows(snapshot_changes(snap(spark, data), ["k", "g"], ["v"])) == []


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 3), st.sampled_from(["a", "b"]), st.integers(0, 2), st.one_of(st.none(), st.integers(0, 1))), max_size=30))
def test_changes_random(spark, drawn):
    data = [(*r, f"2026-01-01 00:00:{i:02d}") for i, r in enumerate(drawn)]
    assert rows(snapshot_changes(snap(spark, data), ["k", "g"], ["v", "w"])) == brute_changes(data)


def test_changes_is_one_shuffle(spark):
    plan = snapshot_changes(snap(spark, [(1, 1, "a", 1, 1, "2026-01-01"), (2, 1, "a", 1, 1, "2026-01-01")]), ["k", "g"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan


def test_current_rows(spark):
    df = spark.createDataFrame([(1, 5, "2026-01-01"), (1, 7, "2026-01-02"), (1, 6, "2026-01-02"), (2, None, "2026-01-01"), (3, -4, None), (3, None, None)], "k int, v int, t string").selectExpr("k", "v", "cast(t as timestamp_ntz) t")
    assert rows(current_rows(df, ["k"], "v", "t")) == [(1, 7), (2, None), (3, -4)]


def eager_brute(left, right, outer=False):
    out = {}
    for key, g, v, t, p in left:
        matches = [r for k, r in right if k == key and key is not None] or ([None] if outer else [])
        for r in matches:
            s = out.setdefault((g, r), [0, None, None, None, set()])
            s[0] += 1
            if v is not None:
                s[1] = (s[1] or 0) + v
                s[2] = v if s[2] is None else max(s[2], v)
                s[3] = (t, v) if s[3] is None else max(s[3], (t, v))
            if p is not None:
                s[4].add(p)
    return sorted(((*k, s[0], s[1], s[2], s[3] and s[3][1], len(s[4])) for k, s in out.items()), key=repr)


@pytest.mark.parametrize("outer", [False, True])
def test_eager_aggregation(spark, outer):
    rnd = random.Random(3)
    # Key 1 holds most rows; keys of both sides repeat; some keys match nothing.
    left = [(rnd.choice([1] * 8 + [2, 3, None]), rnd.choice(["x", "y", None]), rnd.choice([None, 1, 2, 3]), f"2026-01-{rnd.randint(1, 9):02d}", rnd.choice([None, 1, 2])) for _ in range(300)]
    right = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (4, "a"), (None, "a")]
    a = spark.createDataFrame([(*r, 0) for r in left], "k int, g string, v int, t string, p int, n_rows int").selectExpr("k", "g", "v", "cast(t as timestamp_ntz) t", "p", "n_rows")
    b = spark.createDataFrame([(*r, 0) for r in right], "k int, r string, value_sum int")
    got = rows(eager_join_aggregate(a, b, "k", ["g"], ["r"], "v", "t", distinct="p", outer=outer))
    assert got == eager_brute(left, right, outer)
    assert rows(eager_join_aggregate(a.limit(0), b, "k", ["g"], ["r"], "v", "t", outer=outer)) == []


def test_orphans(spark):
    parents = spark.createDataFrame([("1", "2026-01-01", None), ("2", "2026-01-01", "2026-02-01"), ("3", None, "2026-03-01"), ("4", "2026-01-01", "2026-02-01"), ("4", "2026-03-01", None), (None, "2026-01-01", None)], "id string, a string, b string").selectExpr("id", "to_date(a) a", "to_date(b) b")
    iv = parent_intervals(parents, parents["id"], parents["a"], parents["b"])
    data = [("1", "2025-12-31"), ("1", "2026-01-01"), ("2", "2026-01-31"), ("2", "2026-02-01"), ("3", "2020-01-01"), ("4", "2026-02-10"), ("4", "2026-03-01"), ("4", "2025-01-01"), ("9", "2026-01-01"), ("9", "2026-01-01"), (None, "2026-01-01"), ("1", None), ("8", None)]
    refs = spark.createDataFrame(data, "ref_key string, d string").selectExpr("ref_key", "to_date(d) day")
    got = [(k, str(d), r) for k, d, r in rows(orphan_references(refs, iv))]
    assert got == sorted([("1", "2025-12-31", "late"), ("2", "2026-02-01", "deleted"), ("4", "2026-02-10", "deleted"), ("4", "2025-01-01", "late"), ("9", "2026-01-01", "missing"), ("8", "None", "missing")], key=repr)
    assert rows(orphan_references(refs.limit(0), iv)) == []
    assert len(rows(orphan_references(refs, iv.limit(0)))) == 12 - 1


def test_orphans_hot_key_and_merge_join(spark):
    refs = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) AS ref_key", "date'2026-01-01' AS day", "id AS holder")
    parents = spark.range(1500).selectExpr("cast(id as string) id", "date'2025-01-01' a", "cast(null as date) b")
    df = orphan_references(refs, parent_intervals(parents, parents["id"], parents["a"], parents["b"]))
    assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1000 + sum(1 for i in range(1500, 3000) if i % 3)
    assert df.where("ref_key = 'hot'").count() == 1000
    flat = df.selectExpr("'t' table_name", "'f' field_name", "'2026-01' period", "ref_key", "reason", "holder")
    assert rows(orphan_report(flat)) == [("t", "f", "2026-01", "missing", 2000, 1001)]


def test_salted_join_and_heavy_keys(spark):
    left = spark.range(4000).selectExpr("if(id % 2 = 0, 7, cast(id as int)) AS k", "id AS v")
    assert rows(heavy_keys(left, ["k"], 0.1)) == [(7,)]
    right = spark.createDataFrame([(7, "a"), (7, "b"), (9, "c"), (None, "d")], "k int, x string")
    want = sorted(tuple(r) for r in left.join(right, "k").select("k", "v", "x").collect())
    assert sorted(tuple(r) for r in salted_join(left, right, ["k"]).select("k", "v", "x").collect()) == want
    assert salted_join(left, right, ["k"], "left_anti").count() == left.join(right, "k", "left_anti").count()
