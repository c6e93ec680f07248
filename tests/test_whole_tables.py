"""Queries read their tables to both ends."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidewell.queries.registry import all_queries
from tidewell.session import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_event_that_arrives_in_time_is_in_a_window(spark):
    e = table(spark, SF, "events").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t")).filter("t IS NOT NULL").collect()
    want = 0
    for x in e:
        arrival = x["t"] + x["event_id"] % 5 * 40000
        want += len([q for q in range(x["t"] // 86400 * 86400, x["t"] + 172800, 86400) if q >= max(x["t"], arrival)])
    got = all_queries()["b40_all_windows"](spark, SF).agg(F.sum("n"), F.max("q")).first()
    assert got[0] == want and got[1] >= max(x["t"] for x in e)
