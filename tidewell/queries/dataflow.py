"""Placement (F-01 … F-05), dataflows (F-06 … F-15) and visual verbs (I-01 … I-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import dataflow as df_
from tidewell.operators import placement as pl
from tidewell.operators.ordered import width_if_hot
from tidewell.queries import Registry
from tidewell.session import table

R = Registry()
SEC = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long"))


def _network(spark: SparkSession, sf: str) -> tuple[pl.Workflow, pl.Network]:
    """Nations as sites, linked inside their region and in a ring over the regions."""
    sites = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    if sites.count() > 1000:
        raise ValueError("placement is a search on the driver, for networks of up to 1,000 sites")
    rows = sorted((r[0], r[1]) for r in sites.collect())
    links = [(f"s{a}", f"s{b}", 1.0 + (a * 7 + b * 3) % 5) for a, ra in rows for b, rb in rows if a < b and ra == rb]
    heads = sorted({r: a for a, r in reversed(rows)}.items())
    links += [(f"s{a[1]}", f"s{b[1]}", 10.0) for a, b in zip(heads, heads[1:] + heads[:1], strict=True)]
    w = pl.Workflow([1, 2, 3, 4, 5, 6], [(1, 3), (2, 3), (3, 4), (4, 5), (4, 6)], {1: "s0", 2: "s8", 6: "s12"})
    return w, pl.Network.of(links)


LINKS = """n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), heads AS (SELECT min(k) AS k, r FROM n GROUP BY r),
ring AS (SELECT k AS a, coalesce(lead(k) OVER (ORDER BY r), first_value(k) OVER (ORDER BY r)) AS b FROM heads),
links AS (SELECT a.k AS a, b.k AS b, 1.0 + (a.k * 7 + b.k * 3) % 5 AS c FROM n a JOIN n b ON a.r = b.r AND a.k < b.k UNION ALL SELECT a, b, 10.0 FROM ring),
both_ AS (SELECT a, b, min(c) AS c FROM (SELECT a, b, c FROM links UNION ALL SELECT b, a, c FROM links) GROUP BY 1, 2)"""


@R.add("f01_shortest_paths", f"""WITH RECURSIVE {LINKS}, p(source, target, cost, hops) AS (SELECT k, k, 0.0::DOUBLE, 0 FROM n UNION SELECT * FROM (SELECT p.source, l.b, min(p.cost + l.c)::DOUBLE, p.hops + 1 FROM p JOIN both_ l ON l.a = p.target WHERE p.hops < 14 GROUP BY p.source, l.b, p.hops))
SELECT 's' || source AS source, 's' || target AS target, min(cost) AS cost FROM p GROUP BY 1, 2""")
def f01_shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    _, net = _network(spark, sf)
    return spark.createDataFrame([(a, b, float(c)) for a, x in sorted(net.all_costs().items()) for b, c in sorted(x.items())], "source string, target string, cost double")


@R.add("f02_placement")
def f02_placement(spark: SparkSession, sf: str) -> DataFrame:
    """Search (F-02), k-best pruning (F-03), re-planning (F-04) and the baselines (F-05) side by side."""
    w, net = _network(spark, sf)
    rows = []
    for agg in ("max", "sum"):
        best, cost, n = pl.search(w, net, agg)
        pruned, pcost, pn = pl.search(w, net, agg, keep=3)
        again, rcost, _ = pl.replan(w, net, best, [("s0", best[3], 50.0)] if best[3] != "s0" else [("s0", "s5", 0.5)], agg)
        rnd, spring = pl.random_walk(w, net, aggregate=agg), pl.spring_relaxation(w, net, aggregate=agg)
        for name, place, c, k in (("search", best, cost, n), ("k-best", pruned, pcost, pn), ("re-plan", again, rcost, 0), ("random", *rnd, 0), ("spring", *spring, 0)):
            rows += [(agg, name, o, s, float(c), k) for o, s in sorted(place.items())]
    return spark.createDataFrame(rows, "aggregation string, method string, operator int, site string, cost double, expanded int")


@R.add("f06_etl", f"""WITH e AS (SELECT *, {SEC} AS t FROM events), k AS (SELECT user_id, t, event_id, CASE WHEN value >= 5 AND value <= 80 THEN value END AS value FROM e),
c AS (SELECT k.* FROM k WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
SELECT c.event_id, n.n_name FROM c JOIN customer cu ON cu.c_custkey = c.user_id JOIN nation n ON n.n_nationkey = cu.c_nationkey WHERE value IS NOT NULL""")
def f06_etl(spark: SparkSession, sf: str) -> DataFrame:
    """Range filter, set filter, join, annotate."""
    e = df_.range_filter(_events(spark, sf), "value", 5.0, 80.0)
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    e = df_.set_filter(e, "user_id", c.filter("c_acctbal > 0"), "c_custkey")
    return e.join(c, F.col("user_id") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("event_id", "n_name")


@R.add("f06_bloom", "SELECT count(*) AS members_kept FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def f06_bloom(spark: SparkSession, sf: str) -> DataFrame:
    """The approximate filter loses no member."""
    c = table(spark, sf, "customer").filter("c_acctbal > 5000")
    kept = df_.bloom_filter(_events(spark, sf), "user_id", c, "c_custkey")
    return df_.set_filter(kept, "user_id", c, "c_custkey").agg(F.count("*").alias("members_kept"))


@R.add("f06_interpolate", f"""WITH e AS (SELECT user_id, event_id, {SEC} * 1000000 + event_id % 1000000 AS t, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
x AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER w AS ta, last_value(v IGNORE NULLS) OVER w AS va, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS tb, first_value(v IGNORE NULLS) OVER f AS vb FROM e
 WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN ta IS NOT NULL AND tb IS NOT NULL THEN va + (vb - va) * (t - ta) / (tb - ta) ELSE coalesce(va, vb) END, 4) AS value FROM x""")
def f06_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("user_id", "event_id", (F.col("t") * 1000000 + F.col("event_id") % 1000000).alias("t"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return df_.interpolate(e, ["user_id"], "t", "value", width=width_if_hot(e, ["user_id"], 10 * 86400 * 1000000)).select("event_id", F.round("value", 4).alias("value"))


@R.add("f10_moving", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING), 6) AS moving_average FROM events")
def f10_moving(spark: SparkSession, sf: str) -> DataFrame:
    return df_.moving_average(_events(spark, sf), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("moving_average", 6).alias("moving_average"))


@R.add("f10_regression", f"""SELECT event_id, round(CASE WHEN count(*) OVER w >= 2 THEN regr_slope(value, k) OVER w END, 4) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS k FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS 9 PRECEDING)""")
def f10_regression(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("double"))
    return df_.sliding_regression(e, ["user_id"], ["k"], "k", "value").select("event_id", F.round("slope", 4).alias("slope"))


@R.add("f10_kalman", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {SEC} AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY {SEC}, event_id) AS k FROM events),
f(user_id, k, event_id, t, value, x, p) AS (SELECT user_id, k, event_id, t, value, value, 1.0::DOUBLE FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.event_id, e.t, e.value,
 CASE WHEN e.value IS NULL THEN f.x WHEN f.x IS NULL THEN e.value ELSE f.x + (f.p + 0.001) / (f.p + 0.101) * (e.value - f.x) END, CASE WHEN e.value IS NULL OR f.x IS NULL THEN f.p ELSE (f.p + 0.001) * (1 - (f.p + 0.001) / (f.p + 0.101)) END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, round(x, 4) AS smoothed FROM f""")
def f10_kalman(spark: SparkSession, sf: str) -> DataFrame:
    return df_.kalman(_events(spark, sf).select("user_id", "event_id", "t", "value"), ["user_id"], ["t", "event_id"], "value").select("event_id", F.round("smoothed", 4).alias("smoothed"))


@R.add("f13_distinct", "SELECT event_type, count(DISTINCT user_id) AS n, true AS within FROM events GROUP BY 1")
def f13_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate distinct users by two sketches, held against the exact number: within 10 percent."""
    g = _events(spark, sf).groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 14)).alias("b"), F.countDistinct("user_id").alias("n"))
    return g.select("event_type", "n", ((F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n") + 1) & (F.abs(F.col("b") - F.col("n")) <= 0.1 * F.col("n") + 1)).alias("within"))


@R.add("f14_train", f"""SELECT {SEC} // 86400 AS period, round(regr_slope(value, user_id::DOUBLE), 6) AS slope, round(regr_intercept(value, user_id::DOUBLE), 4) AS intercept, regr_count(value, user_id::DOUBLE) AS n FROM events GROUP BY 1""")
def f14_train(spark: SparkSession, sf: str) -> DataFrame:
    m = df_.periodic_models(_events(spark, sf), F.floor(F.col("t") / 86400), "user_id", "value")
    return m.select("period", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@R.add("f15_predict")
def f15_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Classify by a tree, regress by the day's model, residual against the moving average."""
    e = _events(spark, sf).withColumn("period", F.floor(F.col("t") / 86400))
    m = df_.periodic_models(e, F.col("period"), "user_id", "value")
    tree = df_.tree_model(e.withColumn("u", F.col("user_id").cast("double")), ["value", "u"], "event_type")
    got = tree.transform(e.withColumn("u", F.col("user_id").cast("double"))).join(m, "period").withColumn("regressed", F.col("slope") * F.col("user_id") + F.col("intercept"))
    return df_.residual(got, "regressed", ["user_id"], ["t", "event_id"], "value").select("event_id", "prediction", "regressed", "residual")


@R.add("i01_bounded_read", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events) WHERE k BETWEEN 101 AND 600")
def i01_bounded_read(spark: SparkSession, sf: str) -> DataFrame:
    """A bounded number of records from an offset on (I-01), which is also a filter by row range (I-04)."""
    return df_.filter_range(_events(spark, sf), "event_id", 101, 600).select("event_id")


@R.add("i03_json", "SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def i03_json(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to JSON texts and back, with a nested text read too (I-02, I-03)."""
    j = df_.to_json(_events(spark, sf).select("event_id", "user_id", "props"))
    back = df_.from_json(j, "value", "event_id long, user_id long, props string")
    return back.select("event_id", "user_id", F.from_json("props", "k long")["k"].alias("k"))


@R.add("i04_filter", "SELECT event_id FROM events WHERE value > 10 AND event_type IN ('view', 'click') AND props LIKE '%1%' AND regexp_matches(props, '[0-9]{2}')")
def i04_filter(spark: SparkSession, sf: str) -> DataFrame:
    return df_.filter_rows(_events(spark, sf), [("value", "gt", 10), ("event_type", "is_in", ["view", "click"]), ("props", "contains", "1"), ("props", "matches", "[0-9]{2}")]).select("event_id")


@R.add("i08_unpivot", "SELECT c_custkey, 'acctbal' AS attribute, round(c_acctbal, 2) AS value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer")
def i08_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """Select, generate, de-pivot (I-05 … I-08)."""
    c = table(spark, sf, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("acctbal"), F.col("c_nationkey").cast("double").alias("nation"))
    return df_.de_pivot(c, ["c_custkey"], ["acctbal", "nation"])


@R.add("i09_dates", """SELECT delivery_id, strftime(make_timestamp("timestamp" * 1000), '%Y-%m-%d %H:%M:%S') AS at FROM input_stream WHERE "timestamp" > 100000000000""")
def i09_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = df_.numeric_to_date(table(spark, sf, "input_stream").filter("timestamp > 100000000000"), "timestamp", "at")
    return d.select("delivery_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@R.add("i10_forest")
def i10_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Split by hash, a forest, scores of the held-out part."""
    o = table(spark, sf, "orders").withColumn("cust", F.col("o_custkey").cast("double"))
    train, test = df_.hash_split(o, "o_orderkey", 0.7)
    m = df_.tree_model(train, ["o_totalprice", "cust"], "o_orderstatus", forest=5)
    return m.transform(test).groupBy("o_orderstatus", "prediction").agg(F.count("*").alias("n"))


CELLS = "SELECT {by}user_id, d, CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), d * 6 + 1, 6) AS BIGINT) % 2048 AS w FROM events, (SELECT unnest(range(5)) AS d)"


@R.add("i12_count_min", f"WITH c AS ({CELLS.format(by='')}), n AS (SELECT d, w, count(*) AS n FROM c GROUP BY 1, 2) SELECT user_id, min(n.n) AS estimate FROM (SELECT DISTINCT user_id, d, w FROM c) q JOIN n USING (d, w) GROUP BY 1")
def i12_count_min(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates of every user from the synopsis."""
    e = table(spark, sf, "events")
    return df_.count_min_estimates(df_.count_min_table(e, "user_id"), e, "user_id")


@R.add("i12_sketch", f"WITH c AS ({CELLS.format(by='event_type, ')}) SELECT event_type, CAST(d AS INTEGER) AS d, w, count(*) AS n FROM c GROUP BY ALL")
def i12_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """The synopsis of each type of event, as its cells."""
    return df_.count_min_table(table(spark, sf, "events"), "user_id", by=["event_type"])
