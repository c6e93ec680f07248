"""p1, p2, p4, p5: definitions, edge cases and brute-force comparisons on small fixtures."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.operators.entity_features import BitSliced, accumulate, entity_features, sliced, widened
from tidewell.operators import redelivery
from tidewell.operators.redelivery import ConcurrentLoad, MessageStore
from tidewell.operators.rolling import rolling_totals
from tidewell.operators.skew import merge_states, overlapped, per_key_runs, positions
from tidewell.plans.messages import clean_pan, event_ms, messages, number_of, units
from tidewell.session import shared_dir

STREAM = "delivery_id long, batch_id long, key_trx_no long, trx_no long, timestamp long, pan string, amount double, is_fraud long, fraud_type long"


def make(n=600, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        num = r.choice([None, -1, *range(200)])
        pan = r.choice(["hot"] * 6 + [None, "", " - ", "A-b 1", "ab1", "c2", "D3"])
        ts = r.choice([None, -1, 0, 1_709_251_200 + r.randrange(40 * 86400), (1_709_251_200 + r.randrange(40 * 86400)) * 1000, 300_000_000_000_000])
        amount = r.choice([None, float("nan"), float("inf"), -3.25, round(r.uniform(-50, 90), 2)])
        rows.append((i, i // 50, num, r.choice([None, 7]), ts, pan, amount, r.choice([0, 1, None, 5]), r.choice([None, 0, 1, 2, 200])))
    return rows


def brute_messages(rows):
    best = {}
    for r in rows:
        num = r[2] if r[2] is not None else r[3]
        if num == -1:
            continue
        key = ("none", r[0]) if num is None else num
        if key not in best or r[0] < best[key][0]:
            best[key] = r
    return list(best.values())


def py_pan(p):
    q = None if p is None else "".join(c for c in p.lower() if c not in " -\t\n")
    return q or None


def py_ms(t):
    if t is None or t <= 0 or t > 253402300799999:
        return None
    return t * 1000 if t < 10**11 else t


def py_units(a):
    return 0 if a is None or a != a or abs(a) > 9e13 else round(a * 100)


def test_messages_and_fields(spark):
    rows = make()
    d = spark.createDataFrame(rows, STREAM)
    got = messages(d, {"pan": clean_pan("pan"), "ms": event_ms("timestamp"), "u": units("amount")}).collect()
    want = sorted((r[0], py_pan(r[5]), py_ms(r[4]), py_units(r[6])) for r in brute_messages(rows))
    assert sorted((r["delivery_id"], r["pan"], r["ms"], r["u"]) for r in got) == want


def test_messages_null_and_equal_orders(spark):
    d = spark.createDataFrame([(None, 0, 5, None, 1, "a", 1.0, 0, 0), (3, 0, 5, None, 1, "b", 1.0, 0, 0), (3, 0, 5, None, 1, "a", 1.0, 0, 0), (None, 0, None, None, 1, "x", 1.0, 0, 0), (None, 0, None, None, 1, "x", 1.0, 0, 0)], STREAM)
    got = messages(d, {"pan": F.col("pan")}).collect()
    assert sorted((r["number"] or 0, r["pan"]) for r in got) == [(0, "x"), (0, "x"), (5, "a")]
    assert messages(d.limit(0), {"pan": F.col("pan")}).count() == 0


def brute_rolling(rows, windows):
    daily = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for e, d, v in rows:
        if e is not None and d is not None:
            daily[e][d][0] += v or 0
            daily[e][d][1] += 1
    out = {}
    for e, days in daily.items():
        for d in range(min(days), max(days) + 1):
            out[e, d] = [tuple(sum(days[x][k] for x in range(d - w + 1, d + 1) if x in days) for k in (0, 1)) for w in windows]
    return out


@pytest.mark.parametrize("windows", [(7, 30), (1, 2, 5)])
def test_rolling_against_brute_force(spark, windows):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", "ü", None, "hot", "hot"]), r.choice([None, r.randrange(-40, 120)]), r.choice([None, r.randrange(-900, 900)])) for _ in range(400)]
    d = spark.createDataFrame([(*x, 1, 2) for x in rows], "who string, day int, v long, n long, e long")
    got = {(x["who"], x["cal_day"]): [(x[f"units_{w}"], x[f"n_{w}"]) for w in windows] for x in rolling_totals(d, "who", "day", "v", windows).collect()}
    want = {(e, date(1970, 1, 1) + timedelta(days=k)): v for (e, k), v in brute_rolling(rows, windows).items()}
    assert got == want


def test_rolling_small_batches_and_edges(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("a", i * 3, 1) for i in range(10)] + [("b", 5, 2)] + [("c", i, i) for i in range(7)]
        d = spark.createDataFrame(rows, "who string, day int, v long")
        got = {(x["who"], (x["cal_day"] - date(1970, 1, 1)).days): (x["units_7"], x["n_7"]) for x in rolling_totals(d, "who", "day", "v", (7,)).collect()}
        assert got == {k: v[0] for k, v in brute_rolling(rows, (7,)).items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rolling_totals(d.limit(0), "who", "day", "v").count() == 0
    far = spark.createDataFrame([("a", 0, 1), ("a", 40_000, 1)], "who string, day int, v long")
    assert rolling_totals(far, "who", "day", "v").count() == 40_001
    with pytest.raises(ValueError):
        rolling_totals(d, "who", "day", "v", ())
    by_date = d.withColumn("day", F.date_from_unix_date("day"))
    assert rolling_totals(by_date, "who", "day", "v").count() == rolling_totals(d, "who", "day", "v").count()


def test_bit_sliced_addition():
    import numpy as np

    r = np.random.default_rng(1)
    c, want = BitSliced(3), np.zeros(192, int)
    for _ in range(20):
        v = r.integers(0, 1000, 192)
        k = np.arange(192)
        c.add(sliced(v, k >> 6, (k & 63).astype(np.uint64), 3))
        want += v
    assert (c.decode(np.arange(192) >> 6, (np.arange(192) & 63).astype(np.uint64)) == want).all()
    key = r.integers(0, 300, 500)
    n, t, at = r.integers(1, 5, 500), r.integers(-500, 500, 500), r.integers(0, 99, 500)
    cells, cn, ct, cat = accumulate(key, n, t, at)
    for i, k in enumerate(cells):
        m = key == k
        assert (cn[i], ct[i], cat[i]) == (n[m].sum(), t[m].sum(), at[m].max())


def test_entity_features_against_brute_force(spark):
    rows = make(900, 4)
    d = spark.createDataFrame(rows, STREAM)
    m = messages(d, {"pan": clean_pan("pan"), "fraud_type": F.col("fraud_type"), "is_fraud": F.col("is_fraud"), "u": units("amount"), "ms": event_ms("timestamp")})
    f = entity_features(m, "pan", "fraud_type", "is_fraud", "u", "ms", F.lit(10**13))
    want = defaultdict(lambda: [0, 0, None])
    events = defaultdict(int)
    for r in brute_messages(rows):
        pan = py_pan(r[5])
        if pan is None:
            continue
        events[pan] += 1
        if r[8] is not None and r[8] > 0:
            w = want[pan, r[8], r[7] if r[7] in (0, 1) else None]
            w[0] += 1
            w[1] += py_units(r[6])
            ms = py_ms(r[4])
            w[2] = ms if w[2] is None else max(w[2], ms or 0)
    got, n = {}, {}
    for r in f.collect():
        n[r["pan"]] = r["n_events"]
        for x in r["features"]:
            got[r["pan"], x["code"], x["flag"]] = [x["n"], round(x["total"] * 100), None if x["since_ms"] is None else 10**13 - x["since_ms"]]
    assert n == dict(events)
    assert got == dict(want)
    wide = widened(f, [1, 2]).filter("pan = 'hot'").first()
    assert wide["n_1_1"] == want["hot", 1, 1][0] and wide["n_2_0"] == want["hot", 2, 0][0]
    assert entity_features(m.limit(0), "pan", "fraud_type", "is_fraud", "u", "ms", F.lit(1)).count() == 0


def load_in_parts(spark, rows, parts, extra=False):
    store = MessageStore(spark, shared_dir(spark))
    d = spark.createDataFrame(rows, STREAM)
    if extra:  # names that a careless plan would use itself
        d = d.withColumns({"part": F.lit("x/y z"), "n": F.lit(1), "row": F.lit(2), "__number": F.lit(3), "copies": F.lit(4)})
    for k in range(parts):
        store.load(d.filter(F.col("delivery_id") % parts == k), number_of(), F.floor(F.col("batch_id") / 2))
    return store, d


@pytest.mark.parametrize("parts", [1, 3])
def test_store_keeps_one_copy(spark, parts):
    rows = make(500, 8)
    store, d = load_in_parts(spark, rows, parts, extra=parts == 3)
    best = {r[0] for r in brute_messages(rows)}
    assert sorted(r["delivery_id"] for r in store.current().collect()) == sorted(best)
    assert store.current().columns == d.columns
    lost = sorted((r[2] if r[2] is not None else r[3], r[0]) for r in rows if (r[2] if r[2] is not None else r[3]) not in (None, -1) and r[0] not in best)
    assert sorted(map(tuple, store.superseded().collect())) == lost


def test_store_touches_affected_partitions_only(spark):
    rows = [(i, i, i, None, 1, "p", 1.0, 0, 0) for i in range(10)]
    store = MessageStore(spark, shared_dir(spark))
    first = store.load(spark.createDataFrame(rows, STREAM), number_of(), F.col("batch_id"))
    again = store.load(spark.createDataFrame([(100, 50, 4, None, 1, "p", 1.0, 0, 0)], STREAM), number_of(), F.col("batch_id"))
    changed = {k for k in first.versions if first.versions[k] != again.versions[k]}
    assert changed == {"4"} and "50" not in again.versions
    assert [tuple(r) for r in store.superseded().collect()] == [(4, 100)]
    older = store.load(spark.createDataFrame([(-5, 60, 4, None, 1, "q", 1.0, 0, 0)], STREAM), number_of(), F.col("batch_id"))
    assert store.current(["4"]).first()["pan"] == "q" and older.load == 2
    assert sorted(r["delivery_id"] for r in store.superseded().collect()) == [4, 100]


def test_store_empty_and_repeated(spark):
    store = MessageStore(spark, shared_dir(spark))
    with pytest.raises(ValueError):
        store.current()
    d = spark.createDataFrame([(1, 0, 5, None, 1, "p", 1.0, 0, 0)] * 3 + [(None, None, 5, None, None, None, None, None, None)], STREAM)
    store.load(d.limit(0), number_of(), F.col("batch_id"))
    assert store.current().count() == 0
    store.load(d, number_of(), F.col("batch_id"))
    store.load(d.limit(0), number_of(), F.col("batch_id"))
    assert store.current().count() == 1
    assert sorted(str(r["delivery_id"]) for r in store.superseded().collect()) == ["1", "1", "None"]


def brute_runs(rows):
    by = defaultdict(list)
    for k, o, u, m in rows:
        if k is not None:
            by[k].append((o, u, m))
    out = {}
    for k, v in by.items():
        v.sort()
        marks = [x[2] for x in v]
        best = run = 1
        changes = 0
        for a, b in zip(marks, marks[1:]):
            run = run + 1 if a == b else 1
            changes += a != b
            best = max(best, run)
        out[k] = (len(v), sum(x[1] for x in v), v[0][0], v[-1][0], changes, best)
    return out


@pytest.mark.parametrize("chunk", [7, 1000])
def test_per_key_runs(spark, chunk):
    r = random.Random(2)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None, "c"]), i * 3, r.randrange(-9, 9), r.choice([0, 0, 1])) for i in range(700)]
    d = spark.createDataFrame(rows, "k string, o long, u long, m long")
    got = per_key_runs(d, "k", "o", F.col("u"), F.col("m"), block_rows=50, chunk=chunk)
    assert {x[0]: tuple(x)[1:] for x in got.collect()} == brute_runs(rows)
    assert per_key_runs(d.limit(0), "k", "o", F.col("u"), F.col("m")).count() == 0


def test_positions_are_dense_and_ordered(spark):
    r = random.Random(1)
    rows = [(r.choice("aaaab"), i) for i in range(200)]
    d = positions(spark.createDataFrame(rows, "k string, o long"), "k", "o", F.floor(F.col("o") / 13), 3)
    by = defaultdict(list)
    for x in d.collect():
        by[x["__bucket"]].append((x["__pos"], x["k"], x["o"]))
    for v in by.values():
        v.sort()
        assert [p for p, _, _ in v] == list(range(len(v)))
        assert [x[1:] for x in v] == sorted(x[1:] for x in v)


def test_overlap_shows_what_follows(spark):
    rows = [("a", i) for i in range(50)]
    d = overlapped(spark.createDataFrame(rows, "k string, o long"), "k", "o", F.floor(F.col("o") / 9), 3, 10).collect()
    assert sorted(x["o"] for x in d if x["__own"]) == list(range(50))
    for c in {x["__chunk"] for x in d}:
        own = [x["__pos"] for x in d if x["__chunk"] == c and x["__own"]]
        rest = [x["__pos"] for x in d if x["__chunk"] == c and not x["__own"]]
        assert all(max(own) < p <= max(own) + 3 for p in rest)


def test_merge_is_the_same_for_any_tree(spark):
    r = random.Random(9)
    rows = [("k", i, 1, r.choice([0, 1])) for i in range(300)]
    d = spark.createDataFrame(rows, "k string, o long, u long, m long")
    from tidewell.operators.skew import STATE, chunked, run_states

    x = d.select(F.col("k").alias("key"), F.col("o").alias("id"), F.col("u").alias("units"), F.col("m").alias("mark"))
    s = chunked(x, "key", "id", F.floor(F.col("id") / 40), run_states, STATE, chunk=11)
    a = merge_states(s, fan_in=3, levels=3).first()
    assert (a["n"], a["changes"], a["best_run"]) == tuple(brute_runs(rows)["k"][i] for i in (0, 4, 5))


def test_two_writers_one_wins(spark):
    path = shared_dir(spark)
    one, two = MessageStore(spark, path), MessageStore(spark, path)
    rows = spark.createDataFrame([(1, 1, 4, None, 1, "p", 1.0, 0, 0)], STREAM)
    commit = two._commit
    two._commit = lambda m: (one.load(rows, number_of(), F.col("batch_id")), commit(m))[1]  # the other one is faster
    with pytest.raises(ConcurrentLoad):
        two.load(rows.withColumn("pan", F.lit("late")), number_of(), F.col("batch_id"))
    assert [r["pan"] for r in one.current().collect()] == ["p"] and one.manifest().load == 0
    two._commit = commit
    two.load(rows.withColumn("pan", F.lit("late")), number_of(), F.col("batch_id"))
    assert two.current().count() == 1 and two.superseded().count() == 1


def test_index_reads_met_buckets_only(spark, monkeypatch):
    monkeypatch.setattr(redelivery, "BUCKET_NUMBERS", 10)
    store = MessageStore(spark, shared_dir(spark))
    stream = lambda ids: spark.createDataFrame([(1000 * k + i, k, i, None, 1, "p", 1.0, 0, 0) for k, i in ids], STREAM)
    store.load(stream([(1, i) for i in range(60)]), number_of(), F.col("batch_id"))
    read = []
    plain = store._read
    store._read = lambda paths, schema: (read.extend(paths), plain(paths, schema))[1]
    store.load(stream([(2, 3), (2, 4), (2, 77)]), number_of(), F.col("batch_id"))
    assert {x.rsplit("=", 1)[1] for x in read if "/index/" in x} == {"0"}
    assert store.current().count() == 61 and store.superseded().count() == 2


def test_compaction_keeps_everything(spark):
    rows = [(i, i % 4, i % 37, None, 1, "p", 1.0, 0, 0) for i in range(120)]
    store = MessageStore(spark, shared_dir(spark))
    for k in range(4):
        store.load(spark.createDataFrame(rows[k::4], STREAM), number_of(), F.col("batch_id"))
    before, lost = sorted(map(str, store.current().collect())), sorted(map(str, store.superseded().collect()))
    m = store.compact(1)
    assert all(len(v) == 1 for v in [*m.versions.values(), *m.index.values(), m.log])
    gone = store.vacuum(1)
    assert gone and sorted(map(str, store.current().collect())) == before and sorted(map(str, store.superseded().collect())) == lost
    store.load(spark.createDataFrame([(500, 9, 5, None, 1, "p", 1.0, 0, 0)], STREAM), number_of(), F.col("batch_id"))
    assert sorted(map(str, store.current().collect())) == before and store.superseded().count() == len(lost) + 1
