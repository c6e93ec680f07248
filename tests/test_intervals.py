"""Intervals: golden lists, and random lists against a point-by-point evaluation."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.operators import intervals as iv
from tidewell.operators.fluents import Program, cyclic
from tidewell.operators.ordered import last_known, running_sum

K = ["k"]


def pts(spark, ups, downs, key="x"):
    return spark.createDataFrame([(key, t, True) for t in ups] + [(key, t, False) for t in downs], "k string, t long, initiates boolean")


def lists(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["k"]].append((r["start"], r["end"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("ups", "downs", "want"), [
    ([9, 13, 18], [13, 16, 21], [(10, 14), (19, 22)]),
    ([9, 14, 18], [13, 16, 21], [(10, 14), (15, 17), (19, 22)]),
    ([9], [13, 17], [(10, 14)]), ([9, 11], [], [(10, iv.INF)]), ([], [5], []), ([5], [5], []),
])
@pytest.mark.parametrize("width", [None, 3])
def test_inertia_golden(spark, ups, downs, want, width):
    got = iv.from_points(pts(spark, ups, downs), K, width=width)
    assert lists(got).get("x", []) == want


def test_rules_golden(spark):
    """rich ∪ pub, pub ∩ rich, pub \\ rich."""
    p = Program(K)
    for name, ts in {"win": [13], "lose": [19], "pub": [17], "home": [21]}.items():
        p.event(name, spark.createDataFrame([("x", t) for t in ts], "k string, t long"))
    p.simple("rich", ["win"], ["lose"])
    p.simple("at_pub", ["pub"], ["home"])
    p.tree("happy", ("or", "rich", "at_pub"))
    p.tree("beers", ("and", "at_pub", "rich"))
    p.tree("short", ("and", "at_pub", ("not", "rich")))
    got = p.evaluate("happy", "beers", "short")
    assert [lists(got[n])["x"] for n in ("happy", "beers", "short")] == [[(14, 22)], [(18, 20)], [(20, 22)]]
    p.derived("loop", ["loop2"], lambda e: e["loop2"])
    p.derived("loop2", ["loop"], lambda e: e["loop"])
    with pytest.raises(ValueError):
        p.order()


def random_lists(r, n=4, top=40):
    """Maximal lists per key."""
    out = {}
    for k in ["a", "b", None][: r.randrange(1, 4)]:
        cuts = sorted(r.sample(range(top), 2 * r.randrange(0, n + 1)))
        ivs = [(cuts[i], cuts[i + 1]) for i in range(0, len(cuts), 2)]
        if ivs and r.random() < 0.3:
            ivs[-1] = (ivs[-1][0], iv.INF)
        if ivs:
            out[k] = ivs
    return out


def frame(spark, x):
    return spark.createDataFrame([(k, a, b) for k, v in x.items() for a, b in v], "k string, start long, end long")


def inside(v, t):
    return any(a <= t < b for a, b in v)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("width", [None, 5])
def test_sweeps_point_by_point(spark, seed, width):
    r = random.Random(seed)
    x, y = random_lists(r), random_lists(r)
    a, b = frame(spark, x), frame(spark, y)
    ops = {
        "union": (iv.union_all([a, b], K, width), lambda p, q: p or q), "both": (iv.intersect_all([a, b], K, width), lambda p, q: p and q),
        "minus": (iv.relative_complement_all(a, [b], K, width), lambda p, q: p and not q), "not": (iv.complement_all([a, b], K, 0, width), lambda p, q: not (p or q)),
    }
    for name, (df, rule) in ops.items():
        got = lists(df)
        for k in {*x, *y}:
            v = got.get(k, [])
            assert all(e < s for (_, e), (s, _) in zip(v, v[1:])), name  # disjoint and not touching
            for t in range(-1, 45):
                want = rule(inside(x.get(k, []), t), inside(y.get(k, []), t)) and (name != "not" or t >= 0)
                assert inside(v, t) == want, (name, k, t)


def relation(name, s1, e1, s2, e2):
    return {
        "before": s2 >= e1, "meets": e1 - 1 == s2 and e1 - s1 > 1, "starts": s1 == s2 and e1 < e2, "finishes": s1 > s2 and e1 == e2,
        "during": s1 > s2 and e1 < e2, "overlaps": s1 < s2 and e1 - 1 > s2 and e1 < e2, "equal": s1 == s2 and e1 == e2,
    }[name]


@pytest.mark.parametrize("name", iv.RELATIONS)
def test_allen(spark, name):
    r = random.Random(name)
    x, y = random_lists(r, 8, 60), random_lists(r, 8, 60)
    got = sorted((str(p["k"]), p["start_1"], p["end_1"], p["start_2"], p["end_2"]) for p in iv.allen(frame(spark, x), frame(spark, y), name, K, width=7).collect())
    want = sorted((str(k), *a, *b) for k in x for a in x[k] for b in y.get(k, []) if relation(name, *a, *b))
    assert got == want


def test_allen_vectors(spark):
    a, b = frame(spark, {"x": [(5, 11)]}), frame(spark, {"x": [(1, 4), (4, 6), (10, 18), (18, 20)]})
    of = lambda n: [(p["start_2"], p["end_2"]) for p in iv.allen(a, b, n, K).collect()]
    assert of("meets") == [(10, 18)] and of("before") == [(18, 20)]
    o = frame(spark, {"x": [(5, 15)]})
    modes = {m: lists(iv.allen_intervals(o, b, "overlaps", K, m))["x"] for m in ("source", "target", "union", "intersection", "relative_complement", "relative_complement_inverse")}
    assert modes == {"source": [(5, 15)], "target": [(10, 18)], "union": [(5, 18)], "intersection": [(10, 15)], "relative_complement": [(5, 10)], "relative_complement_inverse": [(15, 18)]}


@pytest.mark.parametrize("width", [None, 4])
def test_holds_at(spark, width):
    r = random.Random(3)
    x = random_lists(r, 6)
    p = spark.createDataFrame([(k, t) for k in ("a", "b", None, "c") for t in range(45)], "k string, t long")
    yes = {(q["k"], q["t"]) for q in iv.holds_at(p, frame(spark, x), K, width=width).collect()}
    no = {(q["k"], q["t"]) for q in iv.holds_at(p, frame(spark, x), K, negated=True, width=width).collect()}
    want = {(k, t) for k in ("a", "b", None, "c") for t in range(45) if inside(x.get(k, []), t)}
    assert yes == want and not yes & no and len(yes | no) == 180


def brute_fixed(ups, downs, d):
    out, since = [], None
    for t in sorted({*ups, *downs}):
        if since is not None and t >= since + d:
            out.append(since + d)
            since = None
        if t in downs:
            since = None
        elif since is None:
            since = t
    return sorted(out + ([since + d] if since is not None else []))


@pytest.mark.parametrize("seed", range(5))
def test_deadlines(spark, seed):
    r = random.Random(seed)
    ups, downs = [r.sample(range(120), n) for n in (25, 6)]
    f = lambda ts: spark.createDataFrame([("x", t) for t in ts], "k string, t long")
    got = sorted(x["t"] for x in iv.fixed_deadlines(f(ups), f(downs), K, 6, width=10).collect())
    assert got == brute_fixed(ups, downs, 6)
    ext, run = [], sorted(ups)
    for i, t in enumerate(run):
        if i + 1 == len(run) or run[i + 1] - t > 6:
            ext.append(t + 6)
    assert sorted(x["t"] for x in iv.extendable_deadlines(f(ups), K, 6, width=10).collect()) == ext
    taken = []
    for t in run:
        if not taken or t - taken[-1] > 6:
            taken.append(t)
    assert sorted(x["t"] for x in iv.greedy_starts(f(ups), K, 6, strict=True, width=10).collect()) == taken


def test_small_rules(spark):
    x = frame(spark, {"x": [(1, 4), (6, 20), (30, iv.INF)]})
    assert lists(iv.longer_than(x, 3, 35))["x"] == [(6, 20), (30, iv.INF)]
    assert lists(iv.shorter_than(x, 4))["x"] == [(1, 4)]
    assert lists(iv.clip(x, 3, 8))["x"] == [(3, 4), (6, 8)]
    assert sorted((r["event"], r["t"]) for r in iv.boundaries(x, K).collect()) == [("end", 3), ("end", 19), ("start", 0), ("start", 5), ("start", 29)]
    p = spark.createDataFrame([("x", t) for t in (0, 5, 10, 30, 33)], "k string, t long")
    assert lists(iv.from_samples(p, K, step=5))["x"] == [(0, 15), (30, 35)]
    empty = frame(spark, {})
    assert iv.union_all([empty], K).count() == iv.intersect_all([x, empty], K).count() == 0
    bad = spark.createDataFrame([("x", 5, 5), ("x", None, 7), ("x", 9, 3)], "k string, start long, end long")
    assert iv.union_all([bad], K).count() == 0


def test_cyclic(spark):
    d = spark.createDataFrame([("x", 1, "on"), ("x", 5, "off"), ("x", 5, "on"), ("x", 9, "on"), ("y", 2, "on")], "k string, t long, event string")
    got = cyclic(d, K, lambda s, e: {"f": e == "on"}, ["f"])
    assert sorted((r["k"], r["start"], r["end"]) for r in got.collect()) == [("x", 2, 6), ("x", 10, iv.INF), ("y", 3, iv.INF)]


def test_windows_see_late_events(spark):
    d = spark.createDataFrame([(5, 5), (5, 25), (12, 12)], "t long, arrival long")
    got = sorted((r["q"], r["t"], r["arrival"]) for r in iv.query_windows(d, "t", "arrival", 10, 40, 10, 20).collect())
    assert got == [(10, 5, 5), (20, 5, 5), (20, 12, 12), (30, 12, 12)]


@pytest.mark.parametrize("width", [None, 7])
def test_ordered_scans(spark, width):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), t, r.choice([None, r.randrange(-5, 6)])) for t in range(80)]
    d = spark.createDataFrame(rows, "k string, t long, v long")
    got = {(x["k"], x["t"]): (x["s"], x["l"]) for x in last_known(running_sum(d.withColumn("w", F.coalesce("v", F.lit(0))), K, "t", "w", "s", width), K, ["t"], "v", "l", width).collect()}
    total, last = defaultdict(int), {}
    for k, t, v in rows:
        total[k] += v or 0
        assert got[k, t] == (total[k], last.get(k))
        if v is not None:
            last[k] = v
