"""Interval algebra against a direct computation, and its laws."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import dataset as D
from spindrift.operators import intervals as I  # noqa: E741
from spindrift.operators import phases as P

SCHEMA = "k int, side string, ts long, te long"


def make(seed, n=120, span=2000, longest=60):
    r = random.Random(seed)
    return [(r.randrange(2), r.choice(["a", "b"]), s := r.randrange(span), s + r.randrange(longest)) for _ in range(n)]


def merged(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed,buckets", [(1, 1), (1, 7), (2, 64), (3, 1000)])
def test_islands_and_union(spark, seed, buckets):
    rows = make(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["k"], r["start"], r["end"]) for r in I.islands(df, ["k"], "ts", "te", buckets).collect())
    want = sorted((k, *x) for k in (0, 1) for x in merged([(s, e) for kk, _, s, e in rows if kk == k]))
    assert got == want
    total = {r["k"]: r["length"] for r in I.union_length(df, ["k"], "ts", "te", buckets).collect()}
    assert total == {k: sum(e - s for kk, s, e in want if kk == k) for k in (0, 1)}


@pytest.mark.parametrize("buckets", [1, 9, 200])
def test_sweep(spark, buckets):
    rows = make(5)
    cover = lambda side: {t for _, x, s, e in rows if x == side for t in range(s, e)}
    a, b = cover("a"), cover("b")
    r = I.sweep(spark.createDataFrame(rows, SCHEMA), "side", "a", "b", [], "ts", "te", buckets).first()
    assert (r["left_us"], r["right_us"], r["both_us"], r["left_only_us"], r["right_only_us"]) == (len(a), len(b), len(a & b), len(a - b), len(b - a))


def test_gaps(spark):
    df = spark.createDataFrame([(0, "a", 10, 20), (0, "a", 15, 30), (0, "a", 100, 110)], SCHEMA)
    w = spark.createDataFrame([(0, 150)], "ws long, we long")
    assert sorted((r["start"], r["end"]) for r in I.gaps(df, w, 5, [], "ts", "te").collect()) == [(0, 10), (30, 100), (110, 150)]
    assert [(r["start"], r["end"]) for r in I.gaps(df.limit(0), w, 5, [], "ts", "te").collect()] == [(0, 150)]


@pytest.mark.parametrize("buckets", [1, 5, 300])
def test_gaps_in_any_parts(spark, buckets):
    rows = make(12, 40)
    w = spark.createDataFrame([(0, -50, 2100), (1, -10, 2500)], "k int, ws long, we long")
    got = I.gaps(spark.createDataFrame(rows, SCHEMA), w, 10, ["k"], "ts", "te", buckets).collect()
    want = set()
    for k, lo, hi in ((0, -50, 2100), (1, -10, 2500)):
        ends = [(lo, lo), *merged([(s, e) for kk, _, s, e in rows if kk == k]), (hi, hi)]
        want |= {(k, a[1], b[0]) for a, b in zip(ends, ends[1:], strict=False) if b[0] - a[1] > 10}
    assert {(r["k"], r["start"], r["end"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("buckets,keys", [(1, []), (7, []), (300, []), (7, ["k"])])
def test_as_of_in_any_parts(spark, buckets, keys):
    r = random.Random(3)
    left = [(i, r.choice([0, 1, None]), r.choice([None, r.randrange(500)])) for i in range(80)]
    right = [(r.choice([0, 1, None]), r.choice([None, r.randrange(500)]), r.choice([None, r.randrange(9)])) for _ in range(25)]
    got = I.as_of(spark.createDataFrame(left, "id int, k int, t long"), spark.createDataFrame(right, "k int, u long, v int"), "t", "u", "v", keys, buckets).collect()
    for row in got:
        before = [(u, v) for k, u, v in right if u is not None and v is not None and row["t"] is not None and u <= row["t"] and (not keys or k == row["k"])]
        assert row["v_asof"] == (max(before)[1] if before else None)
    assert len(got) == 80


def test_segments_and_outermost_runs(spark):
    rows, t, r = [], 0, random.Random(8)
    for i in range(200):
        t += 5000 if i % 40 == 39 else r.randrange(1, 30)
        rows.append((i, "host", "engine_step", t, t + 10 + 60 * (i % 7 == 0), 10 + 60 * (i % 7 == 0)))
    ev = spark.createDataFrame(rows, "idx long, device string, name string, ts long, te long, dur long")
    ends = merged([(x[3], x[4]) for x in rows])
    gaps = sorted(b[0] - a[1] for a, b in zip(ends, ends[1:], strict=False))
    limit, want = max(200, 4 * gaps[len(gaps) // 2]), [list(ends[0])]
    for s, e in ends[1:]:
        if s - want[-1][1] > limit:
            want.append([s, e])
        want[-1][1] = e
    assert [[x["ws"], x["we"]] for x in P.gap_segments(ev).orderBy("segment").collect()] == want
    assert P.gap_segments(ev.limit(0)).count() == 0
    top, most = [], None
    for s, e in sorted(((x[3], x[4]) for x in rows), key=lambda x: (x[0], -x[1])):
        if most is None or s >= most:
            top.append((s, e))
        most = e if most is None else max(most, e)
    assert sorted((x["ws"], x["we"]) for x in P.engine_steps(ev, "engine").collect()) == top


def test_laws(spark):
    df = spark.createDataFrame(make(9), SCHEMA)
    union = I.union_length(df, ["side"], "ts", "te").agg(F.sum("length")).first()[0]
    assert union <= df.agg(F.sum(F.expr("te - ts"))).first()[0]
    r = I.sweep(df, "side", "a", "b", [], "ts", "te").first()
    assert r["both_us"] <= min(r["left_us"], r["right_us"]) and r["left_only_us"] + r["both_us"] == r["left_us"]


def test_session_windows_agree(spark):
    df = spark.createDataFrame([r for r in make(4) if r[3] > r[2]], SCHEMA).withColumn("dur", F.expr("te - ts"))
    a = sorted((r["k"], r["start"], r["end"]) for r in I.islands(df, ["k"], "ts", "te").collect())
    assert a == sorted((r["k"], r["start"], r["end"]) for r in I.session_islands(df, ["k"], "ts", "dur").collect())


def test_as_of_and_containment(spark):
    left = spark.createDataFrame([(1, 5), (2, 10), (3, 1)], "id int, t long")
    right = spark.createDataFrame([(3, "x"), (10, "y")], "u long, v string")
    assert {r["id"]: r["v_asof"] for r in I.as_of(left, right, "t", "u", "v").collect()} == {1: "x", 2: "y", 3: None}
    steps = spark.createDataFrame([(0, 0, 5), (1, 5, 11)], "step int, ws long, we long")
    assert sorted((r["id"], r["step"]) for r in I.contained(left, steps, "t", 4).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_doubling_doubles(spark):
    ev = spark.createDataFrame([(i, "device", "comm", f"n{i % 3}", i * 10, 5, i * 10 + 5, i % 2, i % 2) for i in range(30)], "idx long, device string, category string, name string, ts long, dur long, te long, stream int, rank int")
    one = {r["name"]: r["total_us"] for r in D.operator_stats(ev).collect()}
    two = {r["name"]: r["total_us"] for r in D.operator_stats(ev.withColumn("dur", F.expr("dur * 2"))).collect()}
    assert two == {k: 2 * v for k, v in one.items()}
    assert sum(r["total_us"] for r in D.category_totals(ev).collect()) == 150 and len(D.category_totals(ev).collect()) == 5
    assert sum(r["share_pct"] for r in D.category_totals(ev).collect()) == 100
    head = D.with_overflow(D.operator_stats(ev), 1).collect()
    assert sum(r["count"] for r in head) == 30 and [r["folded"] for r in head if r["name"] == "(other)"] == [2]


def test_contained_is_a_plain_range_join(spark):
    r = random.Random(8)
    steps = [(i, s := r.randrange(-5000, 5000), s + r.choice([-3, 0, 1, 2, 17, 100, 900, 9000])) for i in range(120)] + [(500, -(10**15), 10**15), (501, 2, 3)]  # nested, overlapping, empty, huge, tiny
    events = [(i, r.choice([None, r.randrange(-6000, 6000), 10**14])) for i in range(400)]
    got = I.contained(spark.createDataFrame(events, "idx int, ts long"), spark.createDataFrame(steps, "step int, ws long, we long"), "ts")
    assert got.columns == ["idx", "ts", "step"]
    want = sorted((i, t, k) for i, t in events for k, a, b in steps if t is not None and a <= t < b)
    assert sorted(tuple(x) for x in got.collect()) == want
    assert I.contained(spark.createDataFrame(events, "idx int, ts long"), spark.createDataFrame([], "step int, ws long, we long"), "ts").count() == 0


def test_range_join_of_short_steps_has_no_common_key(spark):
    """A capture of a second with thousands of steps: keys hold a few steps each, events a single key."""
    steps = spark.range(5000).selectExpr("id as step", "id * 200 as ws", "id * 200 + 100 as we")
    events = spark.range(200_000).selectExpr("id as idx", "(id * 7919) % 1000000 as ts")
    got = I.contained(events, steps, "ts")
    assert got.count() == 100_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in plan and "Cartesian" not in plan
    level = (100).bit_length() - I.BLOCKS.bit_length() & ~1
    each = steps.selectExpr(f"explode(sequence(shiftright(ws, {level}), shiftright(we - 1, {level}))) as b").groupBy("b").count()
    assert each.agg(F.max("count")).first()[0] <= 2


def test_parts_follow_crowded_times(spark):
    """Half of all events in a hundredth of the span, and an instant with a tenth of them."""
    ev = spark.range(60_000).selectExpr("case when id % 2 = 0 then 500000 + id % 10000 when id % 10 = 1 then 700000 else (id * 7919) % 1000000 end as ts").withColumn("te", F.expr("ts + 5"))
    sizes = [r["count"] for r in I.in_parts(ev.where("ts <> 700000"), "ts", buckets=64).groupBy("__part").count().collect()]
    assert len(sizes) > 50 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    rows = [(r["ts"], r["te"]) for r in ev.distinct().collect()]
    assert sorted((r["start"], r["end"]) for r in I.islands(ev, [], "ts", "te", 64).collect()) == merged(rows)
    assert I.islands(ev, [], "ts", "te", 64).agg(F.sum("n")).first()[0] >= 60_000


@pytest.mark.parametrize("seed,buckets", [(1, 1), (2, 6), (3, 64), (4, 300)])
def test_one_sweep_for_all_scopes(spark, seed, buckets):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), s := r.randrange(2000), s + r.choice([0, 0, 1, 5, 40, r.randrange(300)])) for _ in range(90)]
    scopes = [("all", 0, 2600), ("early", 0, 700), ("late", 1200, 2000), ("none", 9000, 9100)]
    got = I.sweeps_in(spark.createDataFrame(rows, "side string, ts long, te long"), scopes, {"x": "side = 'a'", "y": "side = 'b'"}, {"left": "x > 0", "only": "x > 0 and y = 0", "both": "x > 0 and y > 0"}, "x", 10, "ts", "te", buckets)
    found = {g["scope"]: g for g in got.collect()}
    for name, lo, hi in scopes:
        own = {k: [(s, e) for side, s, e in rows if side == k and lo <= s < hi] for k in "ab"}
        x, y = ({t for s, e in own[k] for t in range(s, e)} for k in "ab")
        ends = [(lo, lo), *merged(own["a"]), (hi, hi)]
        gaps = [d for p, q in zip(ends, ends[1:], strict=False) if (d := q[0] - p[1]) > 10]
        g = found[name]
        assert (g["left"], g["only"], g["both"], g["idle"], g["longest"], g["pauses"]) == (len(x), len(x - y), len(x & y), sum(gaps), max(gaps, default=0), len(gaps))


def test_exact_quantiles_without_a_buffer(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 0, r.randrange(-50, 50), r.randrange(10**6), 10**12 + r.randrange(5)])) for _ in range(3000)] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v long").withColumn("x", F.expr("v / 8"))
    shares = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    for value in ("v", "x"):
        exact = df.where("v is not null").groupBy("k").agg(*(F.expr(f"percentile_disc({q}) within group (order by {value})").alias(n) for n, q in shares.items())).collect()
        assert {g["k"]: tuple(g)[1:] for g in D.quantiles(df, ["k"], value, shares).collect()} == {g["k"]: tuple(g)[1:] for g in exact}
        exact = df.where("v is not null").groupBy("k").agg(F.expr(f"percentile({value}, 0.5)").alias("m"), F.expr(f"percentile({value}, 0.25)").alias("w")).collect()
        got = {g["k"]: (g["m"], g["w"]) for g in D.quantiles(df, ["k"], value, {"m": 0.5, "w": 0.25}, middle=True).collect()}
        assert got == {e["k"]: (pytest.approx(e["m"]), pytest.approx(e["w"])) for e in exact}
    assert D.quantiles(df.where("k = 'none'"), ["k"], "v", shares).count() == 0


def test_quotas_keep_the_longest_without_ranking_all(spark):
    from spindrift.operators import view as V

    r = random.Random(9)
    rows = [("device", "same", i, 5) for i in range(5000)] + [("host", "any", 10_000 + i, r.choice([None, 0, 1, 2, r.randrange(1000)])) for i in range(2000)] + [("host", "few", 90_000 + i, i) for i in range(4)] + [("host", None, 95_000 + i, i % 3) for i in range(50)]
    quota = {("device", "same"): 1500, ("host", "any"): 333, ("host", "few"): 10, ("host", None): 20}
    df = spark.createDataFrame(rows, "device string, name string, idx long, dur long")
    got = V.within_quota(df, spark.createDataFrame([(*k, q) for k, q in quota.items()], "device string, name string, quota long")).collect()
    for k, q in quota.items():
        own = sorted((-(d if d is not None else -1), i) for a, b, i, d in rows if (a, b) == k)[:q]
        assert sorted(x["idx"] for x in got if (x["device"], x["name"]) == k) == sorted(i for _, i in own)
