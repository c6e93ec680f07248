from __future__ import annotations

import pytest

from tidewell.operators import series


def test_early_measures_hold_every_class(spark):
    rows = [("a", "a", 2, 4), ("a", "b", 2, 4), ("b", "b", 4, 4), ("b", "b", 4, 4), (None, "a", 1, 4)]
    d = spark.createDataFrame(rows, "label string, predicted string, prefix int, length int")
    got = {x["class"]: x for x in series.early_measures(d).collect()}
    assert set(got) == {"a", "b"} and all(x["accuracy"] == 0.75 and x["earliness"] == 0.75 for x in got.values())
    assert [got["a"][c] for c in ("support", "precision", "recall", "f1")] == [2, 1.0, 0.5, pytest.approx(2 / 3)]
    assert [got["b"][c] for c in ("support", "precision", "recall", "f1")] == [2, pytest.approx(2 / 3), 1.0, pytest.approx(0.8)]
