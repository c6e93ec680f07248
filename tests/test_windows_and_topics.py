"""Windowed fluents against a step-by-step evaluation; topics, folds, orders, hot entities."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.operators import entity_features as ef
from tidewell.operators import forecast as fc
from tidewell.operators import intervals as iv
from tidewell.session import shared_dir
from tidewell.sources import tables, topics


def inertia(points):
    """Maximal intervals of one key from (t, up); a termination wins."""
    at = {}
    for t, up in points:
        at[t + 1] = min(at.get(t + 1, 1), int(up))
    out, on = [], None
    for t in sorted(at):
        if at[t] and on is None:
            on = t
        elif not at[t] and on is not None:
            out.append((on, t))
            on = None
    return out + ([(on, iv.INF)] if on is not None else [])


def brute_windows(points, queries, memory):
    """Query after query: what was known before is carried over as a start, older points are forgotten."""
    known, out = [], []
    for q in queries:
        low = q - memory
        seen = [(t, up) for t, arrival, up in points if low < t <= q and arrival <= q]
        carried = [(s - 1, True) for s, e in known if s <= low + 1 < e]
        known = [(s, e) for s, e in inertia(seen + carried) if e > low + 1]
        out += [(q, s, e) for s, e in known]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_windows_match_a_step_by_step_evaluation(spark, seed):
    r = random.Random(seed)
    rows = [(k, t, t + r.choice([0, 0, 3, 12, 40]), r.random() < 0.5) for k in "ab" for t in (r.randrange(0, 120) for _ in range(30))]
    first, step, memory = 10, 7, r.choice([7, 14, 20])
    last = first + step * 18
    d = spark.createDataFrame([*rows, ("a", None, 3, True), ("a", 4, None, True)], "k string, t long, arrival long, initiates boolean")
    got = sorted((x["k"], x["q"], x["start"], x["end"]) for x in iv.windowed_fluent(d, ["k"], first, last, step, memory).collect())
    want = sorted((k, *x) for k in "ab" for x in brute_windows([p[1:] for p in rows if p[0] == k], range(first, last + 1, step), memory))
    assert got == want


def test_late_arrivals_as_published(spark):
    """A fluent on from 14 to 15 and from 29 to 33, queries every 9 points: the older interval is known
    until it has left the window, with a longer window longer."""
    rows = [("c", 13, 13, True), ("c", 14, 14, False), ("c", 28, 28, True), ("c", 32, 32, False)]
    d = spark.createDataFrame(rows, "k string, t long, arrival long, initiates boolean")
    for memory, want in ((36, [(14, 15), (29, 33)]), (18, [(29, 33)])):
        x = iv.windowed_fluent(d, ["k"], 9, 36, 9, memory)
        assert sorted((r["start"], r["end"]) for r in x.filter("q = 36").collect()) == want
    kept = iv.windowed_fluent(d, ["k"], 9, 36, 9, 18, keep=18)
    assert sorted((r["start"], r["end"]) for r in kept.filter("q = 36").collect()) == [(14, 15), (29, 33)]
    b = iv.windowed_boundaries(iv.windowed_fluent(d, ["k"], 9, 36, 9, 18), ["k"], 18)
    assert sorted((r["event"], r["t"]) for r in b.filter("q = 27").collect()) == [("end", 14), ("start", 13)]
    assert iv.windowed_fluent(d.limit(0), ["k"], 9, 36, 9, 18).count() == 0
    with pytest.raises(ValueError):
        iv.windowed_fluent(d, ["k"], 9, 36, 9, 3)


def test_windows_are_written_one_by_one(spark):
    path = shared_dir(spark)
    a = spark.createDataFrame([("x", 1, 5, 9), ("x", 2, 5, 12)], "k string, q long, start long, end long")
    tables.write_windows(a, path)
    tables.write_windows(a.filter("q = 2").withColumn("end", F.lit(99).cast("long")), path)
    assert sorted((r["q"], r["end"]) for r in tables.read_windows(spark, path).collect()) == [(1, 9), (2, 99)]


def test_topic(spark):
    t = topics.FileTopic(spark, shared_dir(spark))
    assert t.end() == 0
    rows = spark.range(250_000).withColumn("id", F.col("id") * 3)
    t.produce(rows, "id", F.col("id"), key=F.lit("k"))
    t.produce(spark.createDataFrame([(1, "terminate"), (2, "after")], "id long, v string"), "id", F.lit(0), value=F.col("v"))
    assert t.end() == 250_002 and t.consume().count() == 250_000 and t.consume(stop=False).count() == 250_002
    some = t.consume(100, most=50).agg(F.min("offset"), F.max("offset"), F.count("*"), F.sum(F.get_json_object("value", "$.id").cast("long"))).first()
    assert tuple(some) == (100, 149, 50, sum(3 * i for i in range(100, 150)))
    assert topics.position_sync(t, 9).count() == 10


def test_folds_are_even(spark):
    d = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(500)] + [(1000 + i, "") for i in range(7)], "id long, label string")
    n = defaultdict(Counter)
    for r in fc.stratified_folds(d, "id", 5, "label").collect():
        n[r["label"]][r["fold"]] += 1
    assert set(n) == {"a", None, ""}
    assert all(max(c.values()) - min(c[k] for k in range(5)) <= 1 for c in n.values())
    assert fc.stratified_folds(d.limit(0), "id", 5, "label").count() == 0


def test_disambiguated_automata_accept_the_same_words():
    r = random.Random(3)
    table, finals = [[r.randrange(4) for _ in range(3)] for _ in range(4)], {2}
    for order in (0, 1, 2, 3):
        more, ends, labels = fc.disambiguate(table, finals, order)
        q = p = 0
        word = [r.randrange(3) for _ in range(200)]
        for i, s in enumerate(word):
            q, p = table[q][s], more[p][s]
            assert labels[p] == (q, tuple(word[max(0, i + 1 - order) : i + 1])) and (q in finals) == (p in ends)


def test_a_hot_entity_is_collapsed_while_it_comes(spark, monkeypatch):
    monkeypatch.setattr(ef, "CONTAINER_ROWS", 50)
    monkeypatch.setattr(ef, "COMBINE_ROWS", 20)
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.8 else r.choice("xyz"), r.randrange(-1, 30), r.choice([0, 1, None]), r.randrange(-50, 50), r.choice([None, r.randrange(10**6)])) for _ in range(3000)]
    d = spark.createDataFrame(rows, "e string, c int, f int, v long, t long").repartition(40)
    want = defaultdict(lambda: [0, 0, None])
    for e, c, f, v, t in rows:
        if c > 0:
            w = want[e, c, f]
            w[0] += 1
            w[1] += v
            w[2] = t if w[2] is None else max(w[2], t) if t is not None else w[2]
    got = {}
    for x in ef.entity_features(d, "e", "c", "f", "v", "t", F.lit(10**7), 0).collect():
        assert x["n_events"] == sum(1 for y in rows if y[0] == x["e"])
        for y in x["features"]:
            got[x["e"], y["code"], y["flag"]] = [y["n"], int(y["total"]), None if y["since_ms"] is None else 10**7 - y["since_ms"]]
    assert got == dict(want)
