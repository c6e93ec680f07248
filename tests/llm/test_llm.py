"""p3, p6, p7, p8: brute-force comparisons and edge cases."""

from __future__ import annotations

import heapq
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import abuse, leakage, packing, sampling
from tidewell.llm.grammar import Machine, Pattern
from tidewell.llm.text import located_words, words

# -- sampling ------------------------------------------------------------------------------------


def brute_seats(available, share, floor, rows):
    low = [min(a, f) for a, f in zip(available, floor)]
    got = list(low)
    heap = []
    for i, (a, s) in enumerate(zip(available, share)):
        if s > 0:
            for r in range(low[i] + 1, a + 1):
                heapq.heappush(heap, ((r - 0.5) / (s * rows), i))
    while heap and sum(got) < rows:
        got[heapq.heappop(heap)[1]] += 1
    return got


@pytest.mark.parametrize("seed", range(30))
def test_seats_match_the_priorities(seed):
    r = random.Random(seed)
    n = r.randrange(1, 8)
    share = [r.random() * r.choice([0, 1, 1, 5]) for _ in range(n)]
    total = sum(share) or 1
    share = [s / total for s in share]
    available, floor, rows = [r.randrange(0, 60) for _ in range(n)], [r.randrange(0, 5) for _ in range(n)], r.randrange(0, 150)
    got = sampling.seats(np.array(available), np.array(share), np.array(floor), rows)
    assert got.tolist() == brute_seats(available, share, floor, rows)


def test_sample(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 7)
    r = random.Random(1)
    rows = [(r.choice([None, *range(300)]), r.choice([None, "", " Fire", "flood", "FIRE ", "none", "none", "none"]), r.choice([None, "en", "EN-x", "es_MX", "de", " "]), r.choice([None, "t"])) for _ in range(900)]
    d = spark.createDataFrame(rows, "tweet_id long, event string, tweet_language string, tweet_text string").withColumns({"rank": F.lit(1), "__count": F.lit(1), "available": F.lit(2)})
    targets = spark.createDataFrame([(1, "fire", "en", 0.5, 60, 2), (1, "none", "es", 0.3, 60, 2), (1, "none", "xx", 0.2, 60, 2), (2, "none", "en", 1.0, 10**6, 0), (3, "fire", "de", None, None, None)], "request_id long, event string, tweet_language string, target_share double, sample_rows long, min_rows long").withColumns({"available": F.lit("x"), "selected": F.lit("y")})
    cand = sampling.candidates(d, "tweet_id", {"event": sampling.clean_label("event"), "tweet_language": sampling.clean_language("tweet_language")})
    sample, report = sampling.stratified_sample(cand, targets, "tweet_id", ["event", "tweet_language"])
    have = defaultdict(set)
    for t, e, lang, _ in rows:
        e = (e or "").strip().lower()
        lang = (lang or "").strip().lower().split("-")[0].split("_")[0]
        if e and lang and t is not None:
            have[e, lang].add(t)
    rep = {(x["request_id"], x["event"], x["tweet_language"]): x for x in report.collect()}
    assert rep[1, "fire", "en"]["available"] == len(have["fire", "en"]) and rep[1, "fire", "en"]["asked"] == 30
    assert rep[1, "none", "xx"]["shortfall"] == 12
    got = sample.collect()
    n = Counter((x["request_id"], x["event"], x["tweet_language"]) for x in got)
    for k, x in rep.items():
        assert n.get(k, 0) == x["selected"]
        ids = [y["tweet_id"] for y in got if (y["request_id"], y["event"], y["tweet_language"]) == k]
        assert len(set(ids)) == len(ids) and set(ids) <= have[k[1], k[2]]
        assert sorted(y["rank"] for y in got if (y["request_id"], y["event"], y["tweet_language"]) == k) == list(range(1, len(ids) + 1))
    assert n[2, "none", "en"] == len(have["none", "en"])
    again = sampling.stratified_sample(cand, targets, "tweet_id", ["event", "tweet_language"])[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    s0, r0 = sampling.stratified_sample(cand.limit(0), targets, "tweet_id", ["event", "tweet_language"])
    assert s0.count() == 0 and {x["available"] for x in r0.collect()} == {0}
    assert sampling.stratified_sample(cand, targets.limit(0), "tweet_id", ["event", "tweet_language"])[0].count() == 0


def test_candidates_keep_the_smallest_payload(spark):
    d = spark.createDataFrame([(1, "a", "z"), (1, "a", "b"), (1, "a", "b"), (2, None, "q"), (None, "a", "q")], "id long, s string, text string")
    assert [tuple(x) for x in sampling.candidates(d, "id", {"s": F.col("s")}, ["text", "s"]).collect()] == [("a", 1, "b")]


# -- packing -------------------------------------------------------------------------------------


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, shard string, size int")


def check_packing(rows, texts, caps):
    for job, cap in caps.items():
        mine = [r for r in rows if r["job_id"] == job]
        used = defaultdict(int)
        pieces = defaultdict(list)
        for r in mine:
            used[r["shard"], r["container"]] += r["tokens"]
            pieces[r["doc_id"]].append((r["start"], r["tokens"], r["piece"]))
        assert all(u <= cap for u in used.values())
        assert set(pieces) == {i for i, t in enumerate(texts) if t is not None}
        for i, ps in pieces.items():
            size, at = len(texts[i].encode()), 0
            for k, (start, n, piece) in enumerate(sorted(ps)):
                assert start == at and piece == k
                at += n
            assert at == size
            assert len(ps) == (1 if size <= cap else -(-size // cap))


@pytest.mark.parametrize("bound", [30_000, 1 << 25])
def test_packing_is_a_partition_within_capacity(spark, bound):
    r = random.Random(4)
    texts = [None, "", "ü" * 700, "word " * 5000, "same text"] + ["same text"] * 100 + [""] * 90 + [" ".join(r.choice(["flood", "fire", "river", "card", "port"]) for _ in range(r.randrange(1, 90))) for _ in range(150)]
    jobs = spark.createDataFrame([(1, 500), (2, 4096), (3, 0), (4, None), (2, 4096)], "job_id long, capacity long")
    got = packing.packed(docs_of(spark, texts), jobs, shard_bytes=bound).collect()
    check_packing(got, texts, {1: 500, 2: 4096})
    assert {r["job_id"] for r in got} == {1, 2}
    sizes = [len(t.encode()) for t in texts if t is not None]
    boxes = len({(r["shard"], r["container"]) for r in got if r["job_id"] == 2})
    shards = {r["shard"] for r in got}
    assert boxes <= sum(sizes) / 4096 * 1.1 + len(shards)
    if bound == 30_000:
        held = defaultdict(int)
        for x in got:
            if x["job_id"] == 1:
                held[x["shard"]] += x["tokens"]
        assert len(shards) > 2 and max(held.values()) <= bound + 25_000
    assert packing.packed(docs_of(spark, texts), jobs.limit(0)).count() == 0


def test_packing_of_nothing(spark):
    jobs = spark.createDataFrame([(1, 500)], "job_id long, capacity long")
    assert packing.packed(spark.createDataFrame([(1, None)], "doc_id long, text string"), jobs).count() == 0
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), jobs).count() == 0


def test_shards_do_not_depend_on_file_splits(spark):
    r = random.Random(8)
    texts = [" ".join(r.choices([f"w{i % 7}x{k}" for k in range(9)], k=r.randrange(2, 30))) for i in range(300)]
    jobs = spark.createDataFrame([(1, 700)], "job_id long, capacity long")
    one = packing.packed(docs_of(spark, texts).repartition(1), jobs, shard_bytes=20_000).collect()
    many = packing.packed(docs_of(spark, texts).repartition(5), jobs, shard_bytes=20_000).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_packing_prefers_lexical_neighbours():
    texts = [f"{w} {w}" * 3 + f" {i}" for w in ("flood", "bread") for i in range(6)]
    index = packing.Index(packing.Docs.of([packing.slots_of(t) for t in texts]), np.ones(packing.SLOTS, np.float32), 5.0)
    size = np.array([len(t) for t in texts])
    boxes = defaultdict(set)
    for box, d, *_ in packing.pack(size, int(size.sum() // 2) + 2, index).tolist():
        boxes[box].add(d // 6)
    assert len(boxes) == 2 and all(len(b) == 1 for b in boxes.values())


@pytest.mark.parametrize("slim", [False, True])
def test_bm25_scores_match_the_formula(slim):
    r = random.Random(3)
    docs = [np.array([r.randrange(12) for _ in range(r.randrange(1, 20))]) for _ in range(15)]
    idf = np.zeros(packing.SLOTS)
    idf[:12] = [r.random() for _ in range(12)]
    index = packing.Index(packing.Docs.of(docs), idf, 7.0)
    free = np.array([not slim or i % 3 == 0 for i in range(15)])
    index.slim(free)
    for q in range(15):
        want = [sum(idf[t] * (c := (d == t).sum()) * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / 7.0)) for t in set(docs[q].tolist())) if free[i] else 0 for i, d in enumerate(docs)]
        assert np.allclose(index.scores(q), want, rtol=1e-5)
        sized = packing.Index(packing.Docs.of(docs), idf, 7.0, np.arange(15))
        assert np.allclose(sized.scores(q, 6), [x if i <= 6 else 0 for i, x in enumerate(want)], rtol=1e-5) or slim


# -- leakage -------------------------------------------------------------------------------------

SENTENCE = "The gate keeper of Naël wrote that the river fell twelve metres within a day"


def grams(text, n):
    w = words(text or "")
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute_leaks(items, docs, n):
    held = {i: grams(t, n) for i, t in items}
    out = set()
    for d, t in docs:
        g = grams(t, n)
        out |= {(i, d) for i, h in held.items() if h & g}
    return out


def test_leaks_in_any_dress(spark):
    items = [(1, SENTENCE + "."), (2, "  " + SENTENCE.upper() + " and more"), (3, "too short to be met"), (4, None), (5, "")]
    docs = [
        (1, "Before. " + SENTENCE + " after"), (2, "<p>" + SENTENCE.replace(" ", "&nbsp;<b>", 3) + "</p>"), (3, SENTENCE.replace("keeper", "kee­p​er").replace("Naël", "NAEL")),
        (4, SENTENCE.replace("metres", "me-\nt-\n> res")), (5, SENTENCE.replace("river", "lake")), (6, None), (7, ""), (8, SENTENCE.replace("fi", "ﬁ") + " &amp; " + SENTENCE), (9, "x " * 50_000 + SENTENCE), (None, SENTENCE),
    ]
    got = leakage.leaks(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, words int"))
    rows = got.collect()
    assert {(r["item_id"], r["doc_id"]) for r in rows} == brute_leaks(items, [d for d in docs if d[0] is not None], 10)
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 8, 9}
    texts = dict(docs)
    for r in rows:  # offsets point into the original text
        assert words(texts[r["doc_id"]][r["begin"] : r["end"]])[:10] == words(SENTENCE)[:10]


def test_leaks_random_against_brute_force(spark, monkeypatch):
    r = random.Random(7)
    vocab = ["a", "b", "c", "d"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randrange(0, 12))) for i in range(30)]
    docs = [(i, text(r.randrange(0, 60))) for i in range(60)]
    di, dd = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_leaks(items, docs, 4)
    assert {(x[0], x[1]) for x in leakage.leaks(di, dd, 4).collect()} == want
    whole = sorted(map(str, leakage.leaks(di, dd, 4).collect()))
    for most in (1, 7, 40):  # several automata, items cut into pieces
        monkeypatch.setattr(leakage, "ITEM_WORDS", most)
        assert sorted(map(str, leakage.leaks(di, dd, 4).collect())) == whole
    assert leakage.leaks(di.limit(0), dd).count() == 0 and leakage.leaks(di, dd.limit(0)).count() == 0


def test_words_are_counted_once_over_groups(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(1, text), (1, text), (2, text[:200])], "item_id long, text string")
    docs = spark.createDataFrame([(5, "x " + text + " y"), (5, "x " + text + " y"), (5, text[40:])], "doc_id long, text string")
    want = None
    for most in (10**6, 25, 15, 11):
        monkeypatch.setattr(leakage, "ITEM_WORDS", most)
        got = sorted(tuple(r) for r in leakage.leaks(items, docs).collect())
        assert want in (None, got)
        want = got
    assert [(r[0], r[4], r[5]) for r in want if r[0] == 1 and r[4] == 40] == [(1, 40, 31)]


@pytest.mark.parametrize("t", ["", "A&lt;b&gt;c <i>x</i>", "ﬁne ½ Å-\nb", "a­​b&#x41;&#8203;c", "ÀÉ́ İx ẞ", "<!-- no --> 3 < 4 > 2"])
def test_located_words_agree(t):
    assert [w for w, _, _ in located_words(t)] == words(t)


# -- abuse ---------------------------------------------------------------------------------------

BAD = [
    "You are a worthless moron.", "you are an 1d10t", "What a filthy coward!", "Shut your dumb mouth.", "I will break your legs.", "I hope you drown.", "Eres un idiota.", "Eres un іdіоtа", "Cállate ya, imbécil.", "Du bist ein Feigling.",
    "Halt die Fresse!", "Hou je bek, achterlijke eikel.", "Wat ben jij een sukkel", "Ets un imbècil.", "They are vermin.", "Los forasteros son ratas.", "Die Fremden sind Ungeziefer.", "De vreemden zijn ongedierte", "Els forasters són paràsits",
    "Why waste sandbags on refugees?", "send me nudes", "i am so h0rny", "Hot sluts want to f*ck tonight", "You are a m o r o n", "you​ are a mo­ron", "YOU ARE A STUUUPID LOSER",
]
GOOD = [
    "", "The clown at the fair drew five children.", "I feel stupid, I parked on the A7.", "Cock crow at 5, first dry morning.", "Sex of the 4 stranded fish was not recorded.", "Rats left the sewers.", "A pig and 3 rats swam across.", "Kill the engine before you board.",
    "The word idiot was painted on the wall.", "Police look into hate mail against newcomers.", "This damn rain.", "An ass pulled the cart.", "We will fight this fire and beat it!", "Ratten schwammen durch die Stadt.", "La perra de los vecinos tuvo cachorros.",
    "Wat een idioot weer.", "Refugees helped to fill sandbags.", "W A R N I N G gate opens", "Breast cancer screening is cancelled.", "Nude colours sell best.", "You are welcome to the market.", "Du bist herzlich eingeladen.", "The suction hose sucks air, bang on the valve twice.",
]


@pytest.mark.parametrize("t", BAD)
def test_abusive_sentences(t):
    assert max(abuse.judge(t)[0].values()) >= abuse.THRESHOLD, abuse.judge(t)


@pytest.mark.parametrize("t", GOOD)
def test_harmless_sentences(t):
    assert max(abuse.judge(t)[0].values()) < abuse.THRESHOLD, abuse.judge(t)


def test_reports_weigh_less():
    direct, report = abuse.judge("you are a moron")[0]["abusive"], abuse.judge("He shouted you are a moron")[0]["abusive"]
    assert report < abuse.THRESHOLD <= direct


def test_scores_and_rates(spark):
    d = spark.createDataFrame([(1, "You are a moron.", "a", 1), (1, "You are a moron.", "a", 1), (2, None, None, 1), (3, "", "a", 1), (4, "fine " * 20_000 + ". I hope you drown.", "b", 1)], "doc_id long, text string, source string, score int")
    s = abuse.scored(d, keep=["source"])
    assert sorted((r["doc_id"], r["flagged"]) for r in s.collect()) == [(1, True), (1, True), (2, False), (3, False), (4, True)]
    r = {x["source"]: (x["documents"], x["flagged"]) for x in abuse.rates(s).collect()}
    assert r == {"a": (3, 2), None: (1, 0), "b": (1, 1)}
    assert abuse.scored(d.limit(0)).count() == 0
    assert abuse.scored(d, keep=["score"]).filter("doc_id = 4").first()["score_given"] == 1


def test_machine_against_backtracking():
    import re

    rng = random.Random(5)
    pats = ["a b? c", "a _{0,2} c", "b* a|c", "a b{1,3} c"]
    regs = ["ab?c", "a[abcd]{0,2}c", "b*[ac]", "ab{1,3}c"]
    m = Machine([Pattern("x", 1.0, p) for p in pats])
    for _ in range(300):
        s = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12)))
        got = set(m.run([frozenset([c]) for c in s]))
        want = {(k, e - 1) for k, p in enumerate(regs) for b in range(len(s)) for e in range(b + 1, len(s) + 1) if re.fullmatch(p, s[b:e])}
        assert got == want
        for k, e in got:
            assert re.fullmatch(regs[k], s[m.begin(k, [frozenset([c]) for c in s], e) : e + 1])


def test_registered():
    from tidewell.llm import register

    q = register.queries()
    assert {"p3_found", "p6_found", "p7_found", "p8_found"} <= set(q) and set(register.oracle_sql()) <= set(q)
