"""Pattern language, automata and plans against a naive matcher."""

from __future__ import annotations

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidewell.functions import geo
from tidewell.functions.predicates import REGISTRY, build
from tidewell.operators.patterns import Stream, automaton, chain, detect, runs, skip_any, skip_next, strategy, with_substreams
from tidewell.plans.pattern import TRUE, Atom, Call, Compiler, Op, atoms, minimised, parse, rewrite


def ev(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts long, event_type string, k string, attr double")


def stream(spark, word, key="k", **more):
    return Stream(ev(spark, [(i, i * 10, s, key, float(i % 3)) for i, s in enumerate(word)]), **more)


def lang(f, word):
    """Does the formula accept the whole word? By definition, without automata."""
    if isinstance(f, Atom):
        return len(word) == 1 and (f.test == TRUE.test or word[0] == f.test.args[0])
    if f.kind == "seq":
        if not f.parts:
            return not word
        return any(lang(f.parts[0], word[:i]) and lang(Op("seq", f.parts[1:]), word[i:]) for i in range(len(word) + 1))
    if f.kind == "choice":
        return any(lang(p, word) for p in f.parts)
    if f.kind == "iter":
        return not word or any(lang(f.parts[0], word[:i]) and lang(f, word[i:]) for i in range(1, len(word) + 1))
    return not lang(f.parts[0], word)


def random_formula(r, depth):
    if depth == 0 or r.random() < 0.3:
        return Atom(Call("IsEventTypePredicate", (r.choice("ABC"),)))
    kind = r.choice(["seq", "choice", "iter", "neg"])
    return Op(kind, tuple(random_formula(r, depth - 1) for _ in range(2 if kind in ("seq", "choice") else 1)))


@pytest.mark.parametrize("seed", range(60))
def test_automaton_accepts_what_the_formula_does(seed):
    r = random.Random(seed)
    f = random_formula(r, 2)
    c = Compiler(f)
    kinds = [t.args[0] for t in c.tests]
    table, finals = c.determinise(c.nfa(f))
    small, small_finals = minimised(table, finals)
    for n in range(5):
        for word in product("ABC", repeat=n):
            q = s = 0
            for x in word:
                m = sum(1 << i for i, k in enumerate(kinds) if k == x)
                q, s = table[q][m], small[s][m]
            assert (q in finals) == (s in small_finals) == lang(f, list(word))


@pytest.mark.parametrize("seed", range(20))
def test_skip_strategies_nest(seed):
    """any accepts what next accepts, next what strict accepts."""
    r = random.Random(seed)
    steps = tuple(Atom(Call("IsEventTypePredicate", (r.choice("ABC"),))) for _ in range(r.randrange(2, 4)))
    strict = Op("seq", steps)
    nxt, some = rewrite(Op("next", (strict,))), rewrite(Op("any", (strict,)))
    for n in range(5):
        for word in product("ABC", repeat=n):
            a, b, c = (lang(f, list(word)) for f in (strict, nxt, some))
            assert (not a or b) and (not b or c)


def test_parser_and_checks():
    p = parse('#(;(^(IsEventTypePredicate(SELL),EQStr(name,INTC))["x"],^(EQStr(name,RIMM),GTAttr(price,"x")))){order:1}{partitionBy:name}{window:500}{windowType:time}&;(A,-B)')
    assert len(p) == 2 and (p[0].order, p[0].partition, p[0].window, p[0].window_type) == (1, "name", 500, "time")
    for bad in (";(A)", ";(A,", "A{windowType:x}", ';(EQAttr(a,"x"),A["x"])', ';(A["x"],B["x"])', "A B", "a", "A{other:1}", ";(GT(a,5),A)"):
        with pytest.raises(ValueError):
            parse(bad)


@pytest.mark.parametrize("hot", [0, 10**9])
def test_strict_sequence(spark, hot):
    s = stream(spark, "ABAABB", hot_rows=hot, block_seconds=25)
    spec = parse(";(IsEventTypePredicate(A),IsEventTypePredicate(B)){partitionBy:k}")[0]
    assert strategy(spec) == "chain"
    assert sorted((x["id_1"], x["id_2"]) for x in chain(s, spec).collect()) == [(0, 1), (3, 4)]
    no = parse(";(IsEventTypePredicate(A),IsEventTypePredicate(B)){partitionBy:k}{window:1}")[0]
    assert chain(s, no).count() == 0  # the window is strict
    assert chain(Stream(s.df.limit(0), hot_rows=hot), spec).count() == 0


def brute_paths(word, want, window, nearest):
    out = []

    def go(i, path):
        if len(path) == len(want):
            if path[-1] - path[0] < window:
                out.append(tuple(path))
            return
        for j in range(i, len(word)):
            if word[j] == want[len(path)]:
                go(j + 1, [*path, j])
                if nearest:
                    break

    for i, x in enumerate(word):
        if x == want[0]:
            go(i + 1, [i])
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_skips_against_brute_force(spark, seed):
    r = random.Random(seed)
    word = "".join(r.choice("ABC") for _ in range(40))
    s = stream(spark, word, block_seconds=70)
    body = ";(IsEventTypePredicate(A),IsEventTypePredicate(B),IsEventTypePredicate(C))"
    a = skip_any(s, parse(f"#({body}){{partitionBy:k}}{{window:7}}")[0]).collect()
    assert sorted((x["id_1"], x["id_2"], x["id_3"]) for x in a) == brute_paths(word, "ABC", 7, False)
    t = skip_any(s, parse(f"#({body}){{partitionBy:k}}{{window:70}}{{windowType:time}}")[0]).collect()
    assert sorted(map(str, t)) == sorted(map(str, a))
    n = skip_next(s, parse(f"@({body}){{partitionBy:k}}{{window:9}}")[0]).collect()
    assert sorted((x["id_1"], x["id_2"], x["id_3"]) for x in n) == brute_paths(word, "ABC", 9, True)
    with pytest.raises(ValueError):
        skip_any(s, parse(f"#({body}){{partitionBy:k}}")[0])


@pytest.mark.parametrize("overlap", [True, False])
def test_automaton_over_chunks(spark, overlap):
    r = random.Random(11)
    rows = [(i, i * 10, r.choice("ABC"), r.choice(["hot", "hot", "hot", "b", None]), 0.0) for i in range(300)]
    s = Stream(ev(spark, rows), block_seconds=130)
    spec = parse(";(IsEventTypePredicate(A),*(IsEventTypePredicate(B)),IsEventTypePredicate(C)){partitionBy:k}")[0]
    want = []
    for key in ("hot", "b", None):
        armed = False
        for i, _, x, k, _ in rows:
            if k == key:
                if x == "C" and armed:
                    want.append(i)
                armed = x == "A" or (armed and x == "B")
    assert sorted(x["event_id"] for x in automaton(s, spec, overlap=overlap, chunk=9).collect()) == sorted(want)


def test_runs_with_registers(spark):
    word = [("A", 1.0), ("B", 2.0), ("B", 0.0), ("B", 3.0), ("C", 5.0), ("A", 2.0), ("C", 1.0)]
    d = ev(spark, [(i, i, t, "k", v) for i, (t, v) in enumerate(word)])
    p = ';(IsEventTypePredicate(A)["x"],*(GTAttr(attr,"x")),IsEventTypePredicate(C)){partitionBy:k}{window:5}'
    spec = parse(p)[0]
    assert strategy(spec) == "runs"
    got = sorted(x["ids"] for x in runs(Stream(d), spec, chunk=3).collect())
    assert got == [[5, 6]]  # 0..4 is broken by the B with 0.0
    wide = parse(p.replace("{window:5}", "{window:2}"))[0]
    assert [x["ids"] for x in runs(Stream(d), wide, chunk=2).collect()] == [[5, 6]]


def test_resets_cut_matches(spark):
    d = ev(spark, [(i, i, t, "k", 0.0) for i, t in enumerate(["A", "RESET", "B", "A", "B"])])
    s = with_substreams(Stream(d), ["k"]).withColumn("sub", F.concat_ws("-", "k", "substream"))
    got = detect(Stream(s), ";(IsEventTypePredicate(A),IsEventTypePredicate(B)){partitionBy:sub}").collect()
    assert [(x["id_1"], x["id_2"]) for x in got] == [(3, 4)]


def test_predicates_are_never_null(spark):
    d = spark.createDataFrame([(None,) * 6, (None, 1, "junk", 5.0, None, "x")], "event_type string, ts long, mmsi string, speed double, lon double, within string")
    s = Stream(d, groups={"Fishing": ["1"]}).scope()
    calls = [("IsEventTypePredicate", ["A"]), ("GT", ["mmsi", 1.0]), ("EQStr", ["mmsi", "1"]), ("HighSpeedPredicate", []), ("InPortPredicate", [4.0]), ("IsVesselType", ["Fishing"])]
    for n, a in calls:
        assert d.filter(build(n, s, a).isNull()).count() == 0
    with pytest.raises(ValueError):
        build("NoSuchPredicate", s, [])
    with pytest.raises(ValueError):
        build("GT", s, ["nope", 1.0])
    assert len(REGISTRY) > 50 and len(atoms(parse(";(A,B)")[0].formula)) == 2


def test_geometry(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    d = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0)], "lon double, lat double")
    r = d.select(geo.in_polygon(F.col("lon"), F.col("lat"), square).alias("a"), geo.ring_distance(F.col("lon"), F.col("lat"), square).alias("b"), geo.segments_meet((F.col("lon"), F.col("lat"), 3.0, 3.0), (0.0, 2.0, 4.0, 2.0)).alias("c"), geo.segment_meets_ring((F.col("lon"), F.col("lat"), 4.0, 1.0), square).alias("d")).collect()
    assert [tuple(x) for x in r] == [(True, 1.0, True, True), (False, 1.0, True, False)]
    km = d.select(geo.haversine_km(0.0, 0.0, 1.0, 0.0).alias("x")).first()["x"]
    assert abs(km - 111.19) < 0.01
    x, y = geo.project_point(F.lit(0.0), F.lit(0.0), 3600, F.lit(60.0), F.lit(90.0))
    p = d.select(x.alias("x"), y.alias("y")).first()
    assert abs(p["x"] - 1.0) < 0.01 and abs(p["y"]) < 1e-6
