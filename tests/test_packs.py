"""Forecasting, adaptation, series, dataflow, placement, text, monitors, explanations, sources, streams."""

from __future__ import annotations

import itertools
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import adapt, dataflow, explain, forecast, monitors, placement, series, textmine
from tidewell.operators.patterns import Stream, automaton
from tidewell.plans.pattern import parse
from tidewell.session import shared_dir
from tidewell.sources import events as ev
from tidewell.sources import tables as tb
from tidewell.streaming import engine

# -- forecasting ---------------------------------------------------------------------------------


def simulate(m, finals, start, horizon, n=20000):
    r = np.random.default_rng(1)
    out = np.zeros(horizon)
    for _ in range(n):
        q = start
        for h in range(horizon):
            q = r.choice(len(m), p=m[q])
            if q in finals:
                out[h] += 1 / n
                break
    return out


def test_waiting_times_match_a_simulation():
    m = np.array([[0.6, 0.4, 0.0], [0.3, 0.3, 0.4], [0.5, 0.5, 0.0]])
    w = forecast.waiting_times(m, {2}, 12)
    for q in (0, 1, 2):
        assert np.abs(w[q] - simulate(m, {2}, q, 12, 4000)).max() < 0.03
    assert forecast.inconsistent_states(m) == []
    assert forecast.inconsistent_states(np.array([[0.5, 0.2], [0.0, 0.0]])) == [0, 1]
    assert forecast.distances([[0, 1], [0, 2], [2, 2]], {2}) == {0: 2, 1: 1, 2: 1}


@pytest.mark.parametrize("seed", range(40))
def test_two_pointers_find_the_shortest_interval(seed):
    r = random.Random(seed)
    k = [r.randrange(0, 16) for _ in range(r.randrange(1, 15))]
    w = np.array(k) / 64  # exact fractions: sums compare without rounding
    a, b = forecast.shortest_forecast(w, 0.4), forecast.two_pointer_forecast(w, 0.4)
    assert (a is None) == (b is None)
    if a:
        assert (a.end - a.start, a.prob) == (b.end - b.start, b.prob)


def test_forecast_shapes():
    w = np.array([0.1, 0.2, 0.4, 0.2, 0.1])
    f = forecast.argmax_forecast(w, 0.7, 4)
    assert (f.start, f.end, f.middle) == (2, 4, 3)
    assert forecast.argmax_forecast(w, 0.7, 1) is None
    assert forecast.fixed_spread_forecast(w, 0.5, 1).start in (2, 3)
    assert forecast.fixed_spread_forecast(w, 0.7, 1) is None
    assert forecast.next_k_forecast(w, 0.5, 3).positive and not forecast.next_k_forecast(w, 0.9, 3).positive
    assert forecast.window_forecast(w, 0.5, 1, 4).start == 1
    assert abs(forecast.expected_value(w) - 3) < 1e-9
    assert abs(forecast.gaussian_waiting(5, 1, 20).sum() - 1) < 1e-3 and forecast.gaussian_waiting(2, 0, 3).tolist() == [0, 1, 0]


def test_suffix_tree_of_abracadabra(spark):
    word = "abracadabra"
    d = spark.createDataFrame([(i, i, ord(c) - 97) for i, c in enumerate(word)], "event_id long, ts long, s int").withColumn("k", F.lit("x"))
    counts = {tuple(r[0]): r[1] for r in forecast.context_counts(d, ["k"], "s", ["ts"], F.floor(F.col("ts") / 4), 3, chunk=4).toLocalIterator()}
    want = Counter()
    for i in range(len(word)):
        for n in range(1, 4):
            if i + 1 >= n:
                want[tuple(ord(c) - 97 for c in reversed(word[i + 1 - n : i + 1]))] += 1
    assert counts == dict(want)
    t = forecast.learn_suffix_tree(counts, len(word), 18, 2)
    assert () in t.nodes and all(abs(p.sum() - 1) < 1e-6 for p in t.nodes.values())
    assert np.argmax(t.predict([0, 1])) == 17  # after "ab" comes "r"
    table = [[0] * 18, [0] * 18]
    table[0][17] = 1
    w = forecast.tree_waiting_times(t, [0, 1], 0, table, {1}, 3, 2)
    assert w[0] > 0.9 and w.sum() <= 1 + 1e-9
    assert forecast.tree_waiting_times(t, [0, 1], 0, table, {1}, 3, 2, 0.01).sum() <= w.sum() + 1e-9


def test_metrics_and_hits(spark):
    c = spark.createDataFrame([(8, 2, 1, 9), (0, 0, 0, 5)], "tp long, fp long, fn long, tn long")
    a, b = forecast.classification_metrics(c).collect()
    assert abs(a["precision"] - 0.8) < 1e-9 and abs(a["mcc"] - (8 * 9 - 2 * 1) / (10 * 9 * 11 * 10) ** 0.5) < 1e-9
    assert b["precision"] == -1.0 and b["mcc"] == 0.0 and b["f1"] == -1.0
    f = spark.createDataFrame([("x", 1, 2, 4), ("x", 1, 5, 6), ("y", 1, 1, 9)], "k string, pos long, from_pos long, to_pos long")
    d = spark.createDataFrame([("x", 4), ("x", 9)], "k string, pos long")
    got = {(r["k"], r["from_pos"]): (r["hit"], r["next_pos"]) for r in forecast.forecast_hits(f, d, ["k"]).collect()}
    assert got == {("x", 2): (True, 4), ("x", 5): (False, 9), ("y", 1): (False, None)}
    m = forecast.regression_metrics(forecast.forecast_hits(f, d, ["k"]), 0.5).first()
    assert m["misses"] == 1 and m["spread"] == 1.5


def test_order_selection():
    seq = [0, 1] * 60
    counts = Counter(tuple(reversed(seq[i + 1 - n : i + 1])) for i in range(len(seq)) for n in (1, 2, 3) if i + 1 >= n)
    assert forecast.order_by_cross_validation({0: dict(counts), 1: dict(counts)}, {0: seq[:40], 1: seq[:40]}, 2, [0, 1]) == 1


# -- adaptation ----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_bucket_starts(spark, seed):
    r = random.Random(seed)
    ts = sorted(r.randrange(0, 3000) for _ in range(200))
    want = []
    for t in ts:
        if not want or t - want[-1] > 130:
            want.append(t)
    d = spark.createDataFrame([(t,) for t in ts] + [(None,)], "t long")
    assert adapt.bucket_starts(d, "t", 130) == want
    b = {x["t"]: x["bucket"] for x in adapt.with_bucket(d, "t", want).collect()}
    assert all(want[b[t]] <= t for t in ts) and b[None] is None
    assert adapt.bucket_starts(d.limit(0), "t", 10) == []


def test_policy_and_search():
    p = adapt.Policy("difference", max_fall=0.1, low=0.2, grace=2)
    rows = [(0.8, None, None), (0.6, None, -0.2), (0.4, None, -0.2), (0.41, None, 0.01), (0.42, None, 0.01), (0.43, None, 0.01), (0.3, None, -0.13), (0.1, None, -0.2)]
    assert p.decide(rows) == ["none", "train", "optimise", "none", "none", "none", "train", "optimise"]
    s = adapt.Search([0.0], [1.0])
    log = adapt.command_log("optimise", lambda x: abs(x[0] - 0.3), s, 40)
    assert [c["type"] for c in log][::41] == ["opt_initialise", "opt_finalise"] and min(y for _, y in s.seen) < 0.05
    s.next_round()
    assert len(s.seen) == 5 and adapt.command_log("none", None, s, 1) == [] and len(adapt.command_log("train", None, s, 1)) == 1


def test_cut_off_json(spark):
    d = spark.createDataFrame([(1, 1, " Retrain ", '{"mcc": 0.5, "tp": 1', None), (1, 1, " Retrain ", '{"mcc": 0.5, "tp": 1', None), (2, 1, None, None, '{"mcc": 0.25}')], "timestamp long, model_version int, creation_method string, batch_metrics string, runtime_metrics string")
    got = sorted(adapt.readable_scores(d).collect())
    assert [(r["timestamp"], r["method"], r["mcc"]) for r in got] == [(1, "retrain", None), (2, None, 0.25)]


# -- series --------------------------------------------------------------------------------------


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(2)
    v = {i: r.normal(size=6).round(2).tolist() for i in range(40)}
    d = spark.createDataFrame([(i, x) for i, x in v.items()] + [(None, [1.0]), (99, None)], "id long, vec array<double>")
    for measure in ("euclid", "cosine"):
        got = series.nearest(d.filter("id % 10 = 0"), d, 3, measure, [2, 6], block=7).collect()
        for q, p in itertools.product((0, 10, 20, 30), (2, 6)):
            a = np.array(v[q][:p])
            dist = sorted(((round(float(np.linalg.norm(a - np.array(x[:p])) if measure == "euclid" else 1 - a @ np.array(x[:p]) / np.linalg.norm(a) / np.linalg.norm(x[:p])), 6), i) for i, x in v.items() if i != q))[:3]
            mine = sorted((x["rank"], x["neighbour"]) for x in got if x["query"] == q and x["prefix"] == p)
            assert [n for _, n in mine] == [i for _, i in dist]
    assert series.nearest(d.limit(0), d, 3).count() == 0


@pytest.mark.parametrize("kind", ["ects", "stopping", "truncation"])
def test_early_classifiers_learn(kind):
    r = np.random.default_rng(0)
    y = np.arange(120) % 2
    x = r.normal(size=(120, 40)) * 0.3
    x[:, 8:] += np.where(y[:, None] == 1, 1.0, -1.0) * np.sin(np.arange(32) / 3)
    fit = {"ects": lambda: series.Ects.fit(x[:80], y[:80]), "stopping": lambda: series.Stopping.fit(x[:80], y[:80]), "truncation": lambda: series.Truncation.fit(x[:80], y[:80])}[kind]
    got = fit().predict(x[80:])
    assert np.mean([c == t for (_, c), t in zip(got, y[80:])]) > 0.8
    assert np.mean([p for p, _ in got]) < 40


def test_series_repair_and_votes(spark):
    d = spark.createDataFrame([(1, [None, 2.0, None, 4.0, float("nan")]), (2, []), (3, None)], "id int, v array<double>")
    got = {r["id"]: r["f"] for r in d.select("id", series.fill_gaps(F.col("v")).alias("f")).collect()}
    assert got == {1: [0.0, 2.0, 3.0, 4.0, 4.0], 2: [], 3: None}
    v = spark.createDataFrame([(1, 1, 5), (1, 3, 5), (1, 9, 5), (2, 1, 5), (2, 3, 6), (2, 9, 6), (3, 1, 5), (3, 3, 6), (3, 9, 7)], "id int, t int, predicted int")
    assert {r["id"]: (r["t"], r["predicted"]) for r in series.vote(v, "id", 3).collect()} == {1: (3, 5), 2: (9, 6), 3: (9, 7)}
    long = spark.createDataFrame([(1, t, float(t)) for t in range(7)], "id int, t int, value double")
    assert sorted((r["segment"], r["value"]) for r in series.paa(long, ["id"], "t", "value", 3, 7).collect()) == [(0, 0.5), (1, 2.5), (2, 5.0)]


# -- dataflow and placement ----------------------------------------------------------------------


def test_dataflow_verbs(spark):
    d = spark.createDataFrame([("a", t, v) for t, v in enumerate([None, 1.0, None, 3.0, None])] + [("b", 0, None)], "k string, t long, v double")
    got = {(r["k"], r["t"]): r["v"] for r in dataflow.interpolate(d, ["k"], "t", "v", width=2).collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 1.0, ("a", 2): 2.0, ("a", 3): 3.0, ("a", 4): 3.0, ("b", 0): None}
    k = dataflow.kalman(d, ["k"], ["t"], "v").filter("k = 'a'").orderBy("t").collect()
    assert k[0]["smoothed"] is None and 1.0 < k[3]["smoothed"] < 3.0 and k[4]["smoothed"] == k[3]["smoothed"]
    n = spark.range(1000).withColumn("x", F.col("id") * 3)
    assert [r["x"] for r in dataflow.filter_range(n, "x", 5, 7).orderBy("x").collect()] == [12, 15, 18]
    m = spark.range(0, 50)
    kept = dataflow.bloom_filter(n, "id", m, "id", bits=4096)
    assert kept.filter("id < 50").count() == 50 and kept.count() < 100
    assert dataflow.range_filter(d, "v", 2.0, None).count() == 1
    a, b = dataflow.hash_split(n, "id", 0.3)
    assert a.count() + b.count() == 1000 and 230 < a.count() < 370
    est = dataflow.count_min_estimates(dataflow.count_min_table(n.select((F.col("id") % 7).alias("v")), "v"), n.select((F.col("id") % 9).alias("v")), "v").collect()
    assert {r["v"]: r["estimate"] for r in est} == {**{i: 1000 // 7 + (i < 1000 % 7) for i in range(7)}, 7: 0, 8: 0}


def test_placement_is_optimal():
    net = placement.Network.of([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 9.0), ("c", "d", 1.0)])
    w = placement.Workflow([1, 2, 3, 4], [(1, 3), (2, 3), (3, 4)], {1: "a", 2: "d"})
    costs = net.all_costs()
    assert costs["a"]["d"] == 4.0
    for agg in ("max", "sum"):
        plan, cost, _ = placement.search(w, net, agg)
        best = min(placement.plan_cost(w, costs, {1: "a", 2: "d", 3: x, 4: y}, agg) for x in "abcd" for y in "abcd")
        assert cost == best == placement.plan_cost(w, costs, plan, agg)
        assert placement.search(w, net, agg, keep=2)[1] >= best
        assert placement.random_walk(w, net, aggregate=agg)[1] >= best and placement.spring_relaxation(w, net, aggregate=agg)[1] >= best
    again, cost, new = placement.replan(w, net, plan, [("b", "c", 50.0)])
    assert cost == placement.plan_cost(w, new.all_costs(), again)


# -- text ----------------------------------------------------------------------------------------


def test_text_functions(spark):
    d = spark.createDataFrame([(1, "mail a.b@c.org and @me now"), (2, None), (3, "The river is near the town and it has not moved")], "id int, t string")
    got = {r["id"]: (r["a"], r["l"]) for r in d.select("id", textmine.anonymise(F.col("t")).alias("a"), textmine.detect_language(F.col("t")).alias("l")).collect()}
    assert got[1][0] == "mail <EMAIL> and <USERNAME> now" and got[2] == (None, "unknown") and got[3][1] == "en"
    langs = {"es": "el agua de la ciudad no ha subido hasta hoy", "de": "der fluss ist nicht in die stadt gekommen und das ist gut", "nl": "het water is niet over de dijk en dat is goed voor ons", "ca": "els bombers han buidat tots els soterranis d'aquesta ciutat amb una bomba"}
    x = spark.createDataFrame(list(langs.items()), "l string, t string").select("l", textmine.detect_language(F.col("t")).alias("g")).collect()
    assert all(r["l"] == r["g"] for r in x)
    t = spark.createDataFrame([("flood water rises", "flood")] * 5 + [("smoke and flames", "fire")] * 5 + [(None, "fire"), ("x", None)], "t string, c string")
    m = textmine.fit_naive_bayes(t, "t", "c")
    assert m.predict(["water", "flames", None]) == ["flood", "fire", m.predict([""])[0]]
    r = {x["class"]: x for x in series.class_report(textmine.classify(t, "t", m), "c", "predicted").collect()}
    assert r["flood"]["recall"] == 1.0 and r["fire"]["support"] == 6
    b = textmine.batches(spark.range(0, 100, 7), "id", 4).collect()
    assert Counter(x["batch"] for x in b) == {0: 4, 1: 4, 2: 4, 3: 3}


# -- monitors ------------------------------------------------------------------------------------


def test_monitors(spark):
    r = np.random.default_rng(3)
    x = {g: r.normal(size=(6, 20)) + g for g in (0, 2)}
    d = spark.createDataFrame([(g, v.tolist()) for g, m in x.items() for v in m], "g int, vec array<double>")
    var = {a["g"]: a["variance"] for a in monitors.exact_variance(d, ["g"]).collect()}
    lin = {a["g"]: a["estimate"] for a in monitors.linear(d, [1.0] * 20, ["g"]).collect()}
    nai = {a["g"]: a["estimate"] for a in monitors.naive(d, ["g"]).collect()}
    big = {a["g"]: a["estimate"] for a in monitors.largest(d, ["g"]).collect()}
    for g, m in x.items():
        want = (m**2).sum(1).mean() - (m.mean(0) ** 2).sum()
        assert abs(var[g] - want) < 1e-6 and var[g] <= lin[g] + 1e-9 <= nai[g] + 1e-8 <= big[g] + 1e-7
    s = {a["g"]: a["norm2"] for a in monitors.sketch_estimate(d, ["g"], width=400, depth=5).collect()}
    assert abs(s[2] - (x[2].mean(0) ** 2).sum()) < 0.2 * (x[2].mean(0) ** 2).sum()
    n = spark.range(400).withColumn("label", F.col("id") % 4)
    o = monitors.label_ordered_shards(n, "id", "label", 4).groupBy("client").agg(F.count("*").alias("n"), F.countDistinct("label").alias("l")).collect()
    assert sorted((a["client"], a["n"], a["l"]) for a in o) == [(i, 100, 1) for i in range(4)]
    assert spark.range(1).select(monitors.readable_bytes(F.lit(1536)).alias("x")).first()["x"] == "1.5 KB"


# -- explanations --------------------------------------------------------------------------------


def test_explanations(spark):
    d = spark.createDataFrame([(1.5, "a", "low"), (None, "b", "high"), (3.0, None, "mid")], "x double, c string, o string")
    e = explain.Encoder.fit(d, ["x"], ["c"], {"o": ["low", "mid", "high"]})
    back = e.decode(e.encode(d).select("x", F.col("x").alias("keep")) if False else e.encode(d, "z").select("z"), "z").collect()
    assert sorted((r["o"], r["c"]) for r in back if r["c"]) == [("high", "b"), ("low", "a")] and len(e.names()) == 4
    r = np.random.default_rng(1)
    x = r.uniform(0, 10, (400, 2))
    y = ((x[:, 0] > 4) & (x[:, 1] <= 6)).astype(int)
    rules = explain.rules(explain.grow(x, y), ["a", "b"])
    mine, others = explain.explain({"a": 8.0, "b": 2.0}, 1, rules)
    assert mine[1] == 1 and all(o[1] == 0 for o in others)
    low = dict(((n, op), v) for n, op, v in mine[0])
    assert abs(low["a", ">"] - 4) < 0.3 and abs(low["b", "<="] - 6) < 0.3
    v = np.arange(20.0)
    c = np.stack([(v < 8) * 10, (v >= 8) * 10], axis=1)
    assert explain.mdlp_cuts(v, c) == [7.5] and explain.mdlp_cuts(v, np.ones((20, 2))) == []
    q = spark.range(1000).select((F.col("id") / 100).alias("x"), (F.col("id") >= 300).cast("string").alias("l"))
    cuts = explain.discretise(q, ["x"], "l", 64)
    assert len(cuts["x"]) >= 1 and min(abs(t - 3.0) for t in cuts["x"]) < 0.2
    assert explain.to_bins(q, cuts).select("x").distinct().count() == len(cuts["x"]) + 1
    n = explain.random_neighbourhood(spark, 500, {"a": (1.0, 2.0)}, {"c": ["u", "v"]}).agg(F.min("a"), F.max("a"), F.countDistinct("c")).first()
    assert n[0] >= 1.0 and n[1] <= 2.0 and n[2] == 2


# -- sources and streams -------------------------------------------------------------------------


def test_lines(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    c = ev.DOMAINS["csv"](lines("A,5", "B,-1", "junk", "")).collect()
    assert [(r["event_type"], r["ts"]) for r in c] == [("A", 5), ("RESET", 0), ("junk", None), ("", None)]
    s = ev.DOMAINS["stock"](lines("SELL(id=1,name=X Y,volume=3,price=2.5,ts=9)", "nonsense")).collect()
    assert tuple(s[0])[:6] == ("SELL", 9, 1, "X Y", 3, 2.5) and s[1]["event_type"] is None
    t = ev.DOMAINS["taxi"](lines("TRIP(id=1,dropoffDatetime=7,pickupZone=East Side/N,dropoffZone=B,totalAmount=x)")).first()
    assert (t["pickup_zone"], t["total_amount"]) == ("EastSideN", None)
    p = ev.piped(lines("go|1|2|x|y", "far|5|0|5|true|p", "at|6|6|true|i|7", "unknown|1", ""), {"go"}, {"far"}, {"at"})
    assert tuple(p["events"].first()) == ("go", 1, 2, ["x", "y"]) and tuple(p["intervals"].first()) == ("far", 5, 0, 5, "true", ["p"]) and tuple(p["points"].first()) == ("at", 6, 6, "true", ["i", "7"])
    a = spark.createDataFrame([(0, "@relation x"), (1, "@DATA"), (2, "% no"), (3, "1,?,c1"), (4, "2,3,c2")], "line long, value string")
    assert [(r["vec"], r["label"]) for r in tb.arff(a).orderBy("line").collect()] == [([1.0, None], "c1"), ([2.0, 3.0], "c2")]
    x = tb.series_lines(spark.createDataFrame([(0, "a,1,NaN"), (1, "a,3,4")], "line long, value string"), dims=2).orderBy("dim").collect()
    assert [(r["id"], r["dim"], r["label"], r["vec"]) for r in x] == [(0, 0, "a", [1.0, None]), (0, 1, "a", [3.0, 4.0])]
    with pytest.raises(ValueError):
        ev.read(spark, "nope", "/x")


def test_splits(spark):
    d = spark.range(0, 200, 2).withColumnRenamed("id", "o")
    a, b = ev.split(d, "o", 0.25)
    assert (a.count(), b.count()) == (25, 75) and a.agg(F.max("o")).first()[0] < b.agg(F.min("o")).first()[0]
    train, test = ev.fold(d, "o", 4, 1)
    assert (train.count(), test.count()) == (75, 25)


def test_streaming_automaton_equals_batch(spark):
    r = random.Random(6)
    rows = [(i, i * 10, r.choice("ABC"), r.choice("xy")) for i in range(120)]
    d = spark.createDataFrame(rows, "event_id long, t long, event_type string, k string").withColumn("ts", F.timestamp_seconds("t"))
    path = shared_dir(spark)
    for k in range(3):
        d.filter((F.col("event_id") >= k * 40) & (F.col("event_id") < (k + 1) * 40)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    p = ";(IsEventTypePredicate(A),*(IsEventTypePredicate(B)),IsEventTypePredicate(C)){partitionBy:k}"
    live = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    got = engine.run_to_end(engine.detections(Stream(live), p), f"t_{uuid.uuid4().hex}")
    want = automaton(Stream(d), parse(p)[0], overlap=False)
    assert sorted(x["event_id"] for x in got.collect()) == sorted(x["event_id"] for x in want.collect())


def test_sessions_and_windows_in_a_stream(spark):
    d = spark.createDataFrame([("x", 0), ("x", 10), ("x", 21), ("y", 5), ("x", 500)], "k string, t long").select("k", F.timestamp_seconds("t").alias("ts"))
    path = shared_dir(spark)
    d.coalesce(1).write.parquet(f"{path}/in")
    live = spark.readStream.schema(d.schema).parquet(f"{path}/in")
    s = engine.run_to_end(engine.extendable_sessions(live, "ts", ["k"], "10 seconds", "1 second"), f"t_{uuid.uuid4().hex}")
    got = sorted((r["k"], r["start"].second, r["initiations"]) for r in s.collect() if r["initiations"] != 1 or r["k"] == "y" or r["start"].minute == 0)
    assert ("x", 0, 2) in got and ("y", 5, 1) in got
