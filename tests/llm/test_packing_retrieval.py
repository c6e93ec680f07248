"""Retrieval through content shards and cells, against a scan of the whole corpus."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import packing


def topical(topics, n, seed=2):
    r = random.Random(seed)
    words = [[f"w{t}x{k}" for k in range(12)] for t in range(topics)]
    return [" ".join(r.choices(words[i % topics], k=12)).ljust(80, ".") for i in range(n)]


def test_containers_take_neighbours_of_one_topic(spark):
    docs = spark.createDataFrame(list(enumerate(topical(20, 400))), "doc_id long, text string")
    jobs = spark.createDataFrame([(1, 800)], "job_id long, capacity long")
    boxes = defaultdict(list)
    for x in packing.packed(docs, jobs, shard_bytes=12_000).collect():
        boxes[x["shard"], x["container"]].append(x["doc_id"] % 20)
    pure = sum(max(b.count(t) for t in set(b)) for b in boxes.values())
    assert pure >= 0.9 * 400


def test_recall_of_shards_and_cells_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_DOCS", 16)
    docs = spark.createDataFrame(list(enumerate(topical(12, 900))), "doc_id long, text string")
    r = packing.neighbour_recall(docs, docs.filter("doc_id % 10 = 0"), shard_bytes=40_000).agg(F.avg("recall").alias("r"), F.avg("score_ratio").alias("s"), F.count("*").alias("n")).first()
    assert r["n"] == 90 and r["r"] >= 0.9 and r["s"] >= 0.95


def test_one_shard_and_few_documents_have_full_recall(spark):
    docs = spark.createDataFrame(list(enumerate(topical(5, 60))), "doc_id long, text string")
    r = packing.neighbour_recall(docs, docs).agg(F.min("recall").alias("r")).first()
    assert r["r"] == 1.0


def test_cells_of_equal_documents():
    d = packing.Docs.of([np.array([1, 2, 3])] * 50)
    w = d.weights(np.ones(packing.SLOTS, np.float32), 3.0)
    assert len(packing.Cells.fit(d, w, 8).centre) == 1
    some = packing.Cells.fit(packing.Docs.of([np.array([k]) for k in range(4)] * 5), np.ones(20, np.float32), 8)
    assert len(some.centre) == 4
    again = packing.Cells.load(some.save())
    assert np.array_equal(again.centre, some.centre)
