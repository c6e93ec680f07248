"""Façade, hooks, listeners, nests, sockets, hidden Markov models, early classifiers, search."""

from __future__ import annotations

import socket
import threading
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import facade
from tidewell.operators import adapt, fluents, series
from tidewell.operators import forecast as fc
from tidewell.operators.patterns import Stream
from tidewell.session import shared_dir
from tidewell.streaming import engine


def events(spark, n=400):
    kinds = ["view", "click", "error", "view", "purchase"]
    return spark.createDataFrame([(i, i % 3, kinds[(i * 7 + i // 5) % 5], i) for i in range(n)], "event_id long, user_id long, event_type string, ts long").withColumn("ts", F.timestamp_seconds("ts"))


PATTERN = ';(IsEventTypePredicate("view"),*(IsEventTypePredicate("error")),IsEventTypePredicate("click")){partitionBy:userId}'


def test_facade(spark):
    s = Stream(events(spark))
    model = facade.train(s, PATTERN, theta=0.3)
    assert model.forecasts(spark).count() >= 1 and facade.run(s, PATTERN).count() > 0
    m = facade.test(s, model, "event_id", ["user_id"]).first()
    assert m["tp"] + m["fp"] + m["fn"] + m["tn"] > 0


def test_preprocessing_hook(spark):
    p = fluents.Program(["k"])
    p.preprocess(lambda name, d: d.filter("t > 5") if name == "up" else d)
    p.event("up", spark.createDataFrame([("a", 3), ("a", 8)], "k string, t long"))
    p.event("down", spark.createDataFrame([("a", 4), ("a", 12)], "k string, t long"))
    p.simple("on", ["up"], ["down"])
    assert [tuple(r) for r in p.evaluate("on")["on"].collect()] == [("a", 9, 13)]


def test_listeners_and_nest(spark):
    path = shared_dir(spark)
    events(spark, 90).repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events(spark, 1).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    got = []
    engine.listen(stream, [lambda d, n: got.append((n, d.count())), lambda d, n: got.append((n, -1))], f"{path}/c1")
    assert sum(c for _, c in got if c > 0) == 90 and [n for n, _ in got] == sorted(n for n, _ in got)
    engine.nest(stream, [lambda d: d.filter("event_type = 'view'"), lambda d: d.withColumn("twice", F.col("event_id") * 2)], f"{path}/out", f"{path}/c2")
    engine.nest(stream, [lambda d: d.filter("event_type = 'view'"), lambda d: d.withColumn("twice", F.col("event_id") * 2)], f"{path}/out", f"{path}/c2")
    assert spark.read.parquet(f"{path}/out").count() == events(spark, 90).filter("event_type = 'view'").count()


def test_socket_source(spark):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        c, _ = server.accept()
        c.sendall(b"a,1\nb,2\n")
        time.sleep(4)
        c.close()

    threading.Thread(target=serve, daemon=True).start()
    d = engine.socket_lines(spark, "127.0.0.1", server.getsockname()[1], "csv").select("event_type", "ts")
    name = f"s_{uuid.uuid4().hex}"
    q = d.writeStream.format("memory").queryName(name).option("checkpointLocation", shared_dir(spark)).start()
    try:
        for _ in range(40):
            if spark.table(name).count() == 2:
                break
            time.sleep(0.25)
        assert sorted(tuple(r) for r in spark.table(name).collect()) == [("a", 1), ("b", 2)]
    finally:
        q.stop()
        server.close()


def test_hidden_markov_model():
    rng = np.random.default_rng(3)
    move, show = np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.9, 0.1, 0.0], [0.0, 0.2, 0.8]])

    def draw(n):
        h, out = 0, []
        for _ in range(n):
            out.append(int(rng.choice(3, p=show[h])))
            h = int(rng.choice(2, p=move[h]))
        return out

    train, held = [draw(60) for _ in range(30)], [draw(60) for _ in range(10)]
    score = lambda m: sum(m.log_likelihood(s) for s in held)
    fits = [fc.HiddenMarkov.fit(train, 3, 2, r) for r in (1, 5, 30)]
    assert score(fits[0]) < score(fits[1]) <= score(fits[2]) + 1e-6
    w = fits[2].waiting(held[0], {2}, 200)
    assert 0.95 < w.sum() <= 1 + 1e-9 and (w >= 0).all()


@pytest.mark.parametrize("kind", [series.Economy, series.Stopping, series.Truncation])
def test_early_classifiers_learn(kind):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 160)
    x = rng.normal(size=(160, 24)) + np.where(y[:, None] == 1, 1.5, -1.5) * (np.arange(24) >= 4)
    m = kind.fit(x[:120], y[:120], kernels=15)
    got = m.predict(x[120:])
    assert np.mean([c == t for (_, c), t in zip(got, y[120:], strict=True)]) > 0.85
    assert np.mean([p for p, _ in got]) < 24


def test_search_by_expected_improvement():
    f = lambda x: (x[0] - 0.3) ** 2 + (x[1] + 1) ** 2
    for removal in ("oldest", "random", "worst"):
        s = adapt.BayesSearch([-2, -2], [2, 2], initial=5, keep=4, removal=removal)
        for _ in range(25):
            x = s.ask()
            assert all(-2 <= v <= 2 for v in x)
            s.tell(x, f(x))
        best = min(y for _, y in s.seen)
        assert best < 0.05
        s.next_round()
        assert len(s.seen) == 4 and min(y for _, y in s.seen) == best
    with pytest.raises(ValueError):
        adapt.BayesSearch([0], [1], removal="newest")
