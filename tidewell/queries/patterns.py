"""Pattern queries on ``events`` (A-01 … A-39) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import geo
from tidewell.functions.predicates import REGISTRY, build
from tidewell.operators.patterns import Stream, detect, detect_all, with_substreams
from tidewell.queries import Registry
from tidewell.session import table

R = Registry()
W = "(PARTITION BY user_id ORDER BY ts, event_id)"
DAY = 86400


def _events(spark: SparkSession, sf: str) -> Stream:
    return Stream(table(spark, sf, "events"))


def _is(*types: str) -> str:
    return ",".join(f"IsEventTypePredicate({t})" for t in types)


def _t(kind: str, more: str = "") -> str:
    return f'IsEventTypePredicate("{kind}")' if not more else f'^(IsEventTypePredicate("{kind}"),{more})'


@R.add("a24_seq", f"""SELECT user_id, event_id AS id_1, n_id AS id_2 FROM (SELECT *, lead(event_type) OVER {W} AS n_type, lead(value) OVER {W} AS n_value, lead(event_id) OVER {W} AS n_id, lead(ts) OVER {W} AS n_ts FROM events)
WHERE event_type = 'view' AND n_type = 'click' AND n_value > value AND epoch_us(n_ts) - epoch_us(ts) < {DAY} * 1000000::BIGINT""")
def a24_seq(spark: SparkSession, sf: str) -> DataFrame:
    """A view directly followed by a click with a larger value within a day (A-24, A-31, A-22, A-35, A-36)."""
    p = f';({_t("view")}["x"],{_t("click", 'GTAttr(value,"x")')}){{partitionBy:userId}}{{window:{DAY}}}{{windowType:time}}'
    return detect(_events(spark, sf), p).select("user_id", "id_1", "id_2")


@R.add("a25_choice", f"SELECT user_id, n_id AS event_id FROM (SELECT *, lead(event_type) OVER {W} AS n_type, lead(event_id) OVER {W} AS n_id FROM events) WHERE event_type = 'view' AND n_type IN ('click', 'purchase')")
def a25_choice(spark: SparkSession, sf: str) -> DataFrame:
    p = f';({_t("view")},+({_t("click")},{_t("purchase")})){{partitionBy:userId}}'
    return detect(_events(spark, sf), p).select("user_id", "event_id")


# between a view and the click stand errors only; a match uses up the click, so overlap makes no difference
A26 = f"""SELECT user_id, event_id FROM (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE event_type = 'click' AND before = 'view'"""


@R.add("a26_iter", A26)
def a26_iter(spark: SparkSession, sf: str) -> DataFrame:
    """view, any number of errors, click: ends of matches."""
    return detect(_events(spark, sf), f';({_t("view")},*({_t("error")}),{_t("click")}){{partitionBy:userId}}').select("user_id", "event_id")


@R.add("a28_neg", f"""SELECT user_id, event_id FROM (SELECT *, last_value(CASE WHEN event_type IN ('view', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE event_type = 'click' AND before = 'view'""")
def a28_neg(spark: SparkSession, sf: str) -> DataFrame:
    """A view and a later click with no purchase (and no other view needed) in between."""
    p = f';({_t("view")},!(;(*(TruePredicate),{_t("purchase")},*(TruePredicate))),{_t("click")}){{partitionBy:userId}}'
    return detect(_events(spark, sf), p).select("user_id", "event_id")


@R.add("a29_any", """SELECT a.user_id, a.event_id AS id_1, b.event_id AS id_2, c.event_id AS id_3 FROM events a JOIN events b ON a.user_id = b.user_id AND (b.ts, b.event_id) > (a.ts, a.event_id)
JOIN events c ON a.user_id = c.user_id AND (c.ts, c.event_id) > (b.ts, b.event_id)
WHERE a.event_type = 'view' AND b.event_type = 'click' AND c.event_type = 'purchase' AND c.value > a.value AND epoch_us(c.ts) - epoch_us(a.ts) < 3 * 86400 * 1000000::BIGINT AND epoch_us(b.ts) - epoch_us(a.ts) < 3 * 86400 * 1000000::BIGINT""")
def a29_any(spark: SparkSession, sf: str) -> DataFrame:
    p = f'#(;({_t("view")}["x"],{_t("click")},{_t("purchase", 'GTAttr(value,"x")')})){{partitionBy:userId}}{{window:{3 * DAY}}}{{windowType:time}}'
    return detect(_events(spark, sf), p).select("user_id", "id_1", "id_2", "id_3")


@R.add("a30_next", f"""WITH n AS (SELECT *, row_number() OVER {W} AS n FROM events),
a AS (SELECT *, min(CASE WHEN event_type = 'click' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nc,
 min(CASE WHEN event_type = 'purchase' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS np FROM n)
SELECT a.user_id, a.event_id AS id_1, b.event_id AS id_2, c.event_id AS id_3 FROM a JOIN a b ON a.user_id = b.user_id AND b.n = a.nc JOIN n c ON c.user_id = b.user_id AND c.n = b.np WHERE a.event_type = 'view' AND c.n - a.n < 20""")
def a30_next(spark: SparkSession, sf: str) -> DataFrame:
    p = f'@(;({_t("view")},{_t("click")},{_t("purchase")})){{partitionBy:userId}}{{window:20}}'
    return detect(_events(spark, sf), p).select("user_id", "id_1", "id_2", "id_3")


# of a run of views and clicks every two neighbours match; without overlap every second event ends a match
RUNS = f"""g AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS other FROM events), s AS (SELECT *, sum(other) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS k FROM s WHERE other = 0)"""


@R.add("a37_nonoverlap", f"WITH {RUNS} SELECT user_id, event_id, 'alone' AS kind FROM k WHERE k % 2 = 0 UNION ALL SELECT user_id, event_id, 'overlapping' FROM k WHERE k >= 2")
def a37_nonoverlap(spark: SparkSession, sf: str) -> DataFrame:
    """Two views or clicks in a row, without overlap (after a match the search starts anew) and with it."""
    either = f'+({_t("view")},{_t("click")})'
    out = None
    for kind, overlap in (("alone", False), ("overlapping", True)):
        d = detect(_events(spark, sf), f';({either},{either}){{partitionBy:userId}}', overlap=overlap)
        end = "event_id" if "event_id" in d.columns else "id_2"
        d = d.select("user_id", F.col(end).alias("event_id"), F.lit(kind).alias("kind"))
        out = d if out is None else out.unionByName(d)
    return out


A34 = " UNION ALL ".join(
    f"""SELECT user_id, concat_ws('-', event_id{''.join(f', id{j}' for j in range(1, k + 1))}) AS ids FROM l WHERE event_type = 'view' AND t{k} = 'click'{''.join(f' AND v{j} > value' for j in range(1, k))}"""
    for k in range(1, 5)
)


@R.add("a34_register_iter", f"""WITH l AS (SELECT user_id, event_id, event_type, value, {', '.join(f'lead(event_type, {j}) OVER {W} AS t{j}, lead(value, {j}) OVER {W} AS v{j}, lead(event_id, {j}) OVER {W} AS id{j}' for j in range(1, 5))} FROM events) {A34}""")
def a34_register_iter(spark: SparkSession, sf: str) -> DataFrame:
    """A view and then events whose values all exceed it, the last a click: every run (A-32, A-34)."""
    p = f';({_t("view")}["x"],*(GTAttr(value,"x")),{_t("click")}){{partitionBy:userId}}{{window:5}}'
    return detect(_events(spark, sf), p, enumerate_events=True).select("user_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), "-").alias("ids"))


@R.add("a38_multi", f"""SELECT 0 AS pattern_id, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER {W} AS n_type FROM events) WHERE event_type = 'view' AND n_type = 'click'
UNION ALL SELECT 1, count(*) FROM (SELECT event_type, lead(event_type) OVER {W} AS n_type FROM events) WHERE event_type = 'click' AND n_type = 'error'""")
def a38_multi(spark: SparkSession, sf: str) -> DataFrame:
    p = f';({_t("view")},{_t("click")}){{partitionBy:userId}}&;({_t("click")},{_t("error")}){{partitionBy:userId}}'
    return detect_all(_events(spark, sf), p).groupBy("pattern_id").agg(F.count("*").alias("n"))


@R.add("a39_reset", f"""WITH s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER {W} AS sub FROM events)
SELECT user_id, event_id AS id_1, n_id AS id_2 FROM (SELECT *, lead(event_type) OVER w AS n_type, lead(event_id) OVER w AS n_id FROM s WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id, sub ORDER BY ts, event_id)) WHERE event_type = 'view' AND n_type = 'click'""")
def a39_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Errors taken as reset events: no match reaches over one (RESET rows, A-39)."""
    s = _events(spark, sf)
    d = with_substreams(s, ["user_id"], reset="error")
    d = d.withColumn("stream", F.concat_ws(":", "user_id", "substream"))
    return detect(Stream(d), f';({_t("view")},{_t("click")}){{partitionBy:stream}}').select(F.split("stream", ":")[0].cast("long").alias("user_id"), "id_1", "id_2")


PAIR_A = "(pow(sin(radians(value % 19 / 100 - value % 30 / 100) / 2), 2) + cos(radians(48 + value % 30 / 100)) * cos(radians(48 + value % 19 / 100)) * pow(sin(radians(value % 23 / 100 - value % 40 / 100) / 2), 2))"
PAIR_KM = f"(2 * 6371.0 * atan2(sqrt({PAIR_A}), sqrt(greatest(1 - {PAIR_A}, 0.0))))"

PREDICATES = {
    "A01": ("IsEventTypePredicate", ["view"], "event_type = 'view'"),
    "A02": ("EQ", ["value", 5.0], "value = 5.0"),
    "A03": ("EQStr", ["eventType", "click"], "event_type = 'click'"),
    "A04": ("LT", ["value", 20.0], "value < 20.0"),
    "A05": ("LTE", ["value", 20.0], "value <= 20.0"),
    "A06": ("GT", ["value", 20.0], "value > 20.0"),
    "A07": ("GTE", ["value", 20.0], "value >= 20.0"),
    "A08": ("BT", ["value", 10.0, 20.0], "value >= 10.0 AND value < 20.0"),
    "A13": ("TruePredicate", [], "true"),
    "A14": ("EpsilonPredicate", [], "false"),
    "A90": ("AmountBetween", [10.0, 20.0], "value >= 10.0 AND value < 20.0"),
    "A91": ("HighSpeedPredicate", [], "value % 40 >= 20.0"),
    "A91b": ("MovingPredicate", [], "value % 40 >= 2.0"),
    "A92": ("IsHeadingPredicate", ["North"], "value * 7 % 360 >= 315 OR value * 7 % 360 < 45"),
    "A92b": ("IsHeadingPredicate", ["East"], "value * 7 % 360 >= 45 AND value * 7 % 360 < 135"),
    "A93": ("IsTimePredicate", ["Morning"], "hour(ts) >= 6 AND hour(ts) < 12"),
    "A93b": ("IsHourPredicate", [7.0], "hour(ts) = 7"),
    "A93c": ("IsDayPredicate", [3.0], "day(ts) = 3"),
    "A95": ("VesselToVesselSpeed", [1.0, 5.0], "abs(value % 40 - value % 30) >= 1.0 AND abs(value % 40 - value % 30) < 5.0"),
    "A95b": ("VesselToVesselHeading", [10.0, 60.0], "abs(value * 7 % 360 - value * 3 % 360) >= 10 AND abs(value * 7 % 360 - value * 3 % 360) < 60"),
    "A97": ("IsVesselType", ["Fishing"], "user_id IN (1, 2, 3, 5, 8, 13)"),
    "A98": ("InPortPredicate", [4.0], "user_id % 5 = 4 OR user_id % 7 = 4"),
    "A99": ("FlashGT", [], "user_id % 2 = 1 AND (user_id + 3) % 6 = 4"),
    "A90b": ("SpeedBetween", [5.0, 10.0], "value % 40 >= 5 AND value % 40 < 10"),
    "A90c": ("SpeedOneBetween", [5.0, 10.0], "value % 40 >= 5 AND value % 40 < 10"),
    "A90d": ("SpeedTwoBetween", [5.0, 10.0], "value % 30 >= 5 AND value % 30 < 10"),
    "A90e": ("Close", [5.0, 10.0], "value >= 5 AND value < 10"),
    "A91c": ("NormalSpeedPredicate", [], "value % 40 < 20"),
    "A91d": ("StoppedPredicate", [], "value % 40 < 2"),
    "A92c": ("IsHeadingPredicate", ["South"], "value * 7 % 360 >= 135 AND value * 7 % 360 < 225"),
    "A92d": ("IsHeadingPredicate", ["West"], "value * 7 % 360 >= 225 AND value * 7 % 360 < 315"),
    "A93d": ("IsTimePredicate", ["Night"], "hour(ts) < 6"),
    "A94": ("LT2D", [5.0], "sqrt(pow(value % 17 - value % 11, 2) + pow(value % 13 - value % 7, 2)) < 5"),
    "A94b": ("GTE2D", [5.0], "sqrt(pow(value % 17 - value % 11, 2) + pow(value % 13 - value % 7, 2)) >= 5"),
    "A95c": ("VesselToVesselDistance", [1.0, 10.0], f"{PAIR_KM} > 1 AND {PAIR_KM} < 10"),
    "A95d": ("SimilarMovement", [15.0, 3.0, 60.0], f"value % 40 > 1.2 AND value % 40 < 10 AND value % 30 > 1.2 AND value % 30 < 10 AND {PAIR_KM} > 0 AND {PAIR_KM} < 15 AND abs(value % 40 - value % 30) <= 3 AND abs(value * 7 % 360 - value * 3 % 360) <= 60"),
    "A95e": ("SimilarGaze", [], "user_id % 90 = 0 OR event_id % 90 = 0 OR abs(user_id % 90 - event_id % 90) <= 45"),
    "A98b": ("DFiveSevenPredicate", [2.0], "user_id % 3 = 2 OR user_id % 4 = 2"),
    "A98c": ("DSevenTenPredicate", [5.0], "user_id % 6 = 5 OR user_id % 8 = 5"),
    "A99b": ("DecGT", [], "user_id % 2 = 1 AND (user_id + 3) % 6 = 2"),
    "A99c": ("IncGT", [], "user_id % 2 = 1 AND (user_id + 3) % 6 = 5"),
    "A100c": ("Context", ["meet"], "user_id % 2 = 0"),
    "A100d": ("MeetContext", [], "user_id % 2 = 0"),
    "A100e": ("MoveContext", [], "user_id % 2 = 1"),
    "A100f": ("Join", [], "user_id % 3 = 0"),
    "A100g": ("Split", [], "user_id % 3 <> 0"),
    "A100h": ("IsConfigPredicate", [2.0], "user_id % 4 = 2"),
    "A100": ("Situation", ["error"], "event_type = 'error'"),
    "A100b": ("EQML", ["StopStart", 1.0], "user_id % 3 = 1"),
}


@R.add("a01_predicates", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS op, count(*) FILTER (WHERE {sql}) AS n FROM events" for k, (_, _, sql) in PREDICATES.items()) + ")")
def a01_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """How many events pass each predicate; attributes are made from the events' columns."""
    e = table(spark, sf, "events")
    v = F.col("value")
    e = e.withColumns({"amount": v, "speed": v % 40, "heading": v * 7 % 360, "hour": F.hour("ts"), "day": F.dayofmonth("ts"), "speed1": v % 40, "speed2": v % 30, "heading1": v * 7 % 360, "heading2": v * 3 % 360, "mmsi": F.col("user_id").cast("string"), "within": F.concat_ws(",", F.col("user_id") % 5, F.col("user_id") % 7), "is_fraud": F.col("user_id") % 2, "fraud_type": (F.col("user_id") + 3) % 6, "dist": v, "x1": v % 17, "y1": v % 13, "x2": v % 11, "y2": v % 7, "lon1": v % 40 / 100, "lat1": 48 + v % 30 / 100, "lon2": v % 23 / 100, "lat2": 48 + v % 19 / 100, "gaze1": F.col("user_id") % 90 - 1, "gaze2": F.col("event_id") % 90 - 1, "context": F.when(F.col("user_id") % 2 == 0, "meet").otherwise("move"), "interaction": F.when(F.col("user_id") % 3 == 0, "join").otherwise("split"), "config": F.col("user_id") % 4, "d57": F.concat_ws(",", F.col("user_id") % 3, F.col("user_id") % 4), "d710": F.concat_ws(",", F.col("user_id") % 6, F.col("user_id") % 8), "situation": F.col("event_type"), "stop_start": F.col("user_id") % 3})
    s = Stream(e, groups={"Fishing": ["1", "2", "3", "5", "8", "13"]})
    sums = e.agg(*[F.sum(F.when(build(n, s.scope(), a), 1).otherwise(0)).cast("long").alias(k) for k, (n, a, _) in PREDICATES.items()])
    return sums.unpivot([], list(PREDICATES), "op", "n")


HAV = "2 * 6371.0 * atan2(sqrt({a}), sqrt(greatest(1 - {a}, 0.0)))"
A_ = "(pow(sin(radians(48.4 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.4)) * pow(sin(radians(-4.5 - lon) / 2), 2))"


@R.add("a09_geo", f"""WITH p AS (SELECT event_id, -5 + (event_id % 100) / 100.0 AS lon, 48 + (event_id % 97) / 97.0 AS lat FROM events), d AS (SELECT *, {HAV.format(a=A_)} AS km FROM p)
SELECT event_id, round(km, 4) AS km, km < 20 AS inside, km >= 20 AS outside, km > 10 AND km < 30 AS ring, lon > -4.905 AND lon < -4.405 AND lat > 48.2 AND lat < 48.7 AS in_area FROM d""")
def a09_geo(spark: SparkSession, sf: str) -> DataFrame:
    """Circles, rings, a polygon and the haversine distance (A-09, A-10, A-11, A-17, A-96)."""
    e = table(spark, sf, "events").select("event_id", "ts", "event_type", (F.lit(-5.0) + (F.col("event_id") % 100) / 100.0).alias("lon"), (F.lit(48.0) + (F.col("event_id") % 97) / 97.0).alias("lat"))
    s = Stream(e, regions={"area": [(-4.905, 48.2), (-4.405, 48.2), (-4.405, 48.7), (-4.905, 48.7)]}).scope()
    return e.select("event_id", F.round(geo.haversine_km(F.col("lon"), F.col("lat"), -4.5, 48.4), 4).alias("km"), build("WithinCirclePredicate", s, [-4.5, 48.4, 20.0]).alias("inside"), build("OutsideCirclePredicate", s, [-4.5, 48.4, 20.0]).alias("outside"), build("DistanceBetweenPredicate", s, [-4.5, 48.4, 10.0, 30.0]).alias("ring"), build("WithinPolygonPredicate", s, ["area"]).alias("in_area"))


@R.add("a15_sentences", "SELECT event_type, count(*) AS n FROM events WHERE (event_type = 'view' OR event_type = 'click') AND NOT value < 20.0 GROUP BY 1")
def a15_sentences(spark: SparkSession, sf: str) -> DataFrame:
    p = f'^(|({_t("view")},{_t("click")}),-LT(value,20.0))'
    m = detect(_events(spark, sf), p).withColumnRenamed("id_1", "event_id").select("event_id")
    return table(spark, sf, "events").join(m, "event_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


@R.add("a35_count_window", f"""SELECT user_id, event_id AS id_1, id_2, id_3 FROM (SELECT *, lead(event_type) OVER {W} AS t2, lead(event_type, 2) OVER {W} AS t3, lead(event_id) OVER {W} AS id_2, lead(event_id, 2) OVER {W} AS id_3 FROM events) WHERE event_type = 'view' AND t2 = 'click' AND t3 IS NOT NULL""")
def a35_count_window(spark: SparkSession, sf: str) -> DataFrame:
    """A count window is strict: three events in a row need a window of three."""
    p = f';({_t("view")},{_t("click")},TruePredicate){{partitionBy:userId}}{{window:3}}'
    return detect(_events(spark, sf), p).select("user_id", "id_1", "id_2", "id_3")


# The names a pattern may use.
NAMES = (
    "BT Close Context DFiveSevenPredicate DSevenTenPredicate DecGT DistToPolyPredicate DistanceBetweenPredicate EQ EQAttr EQAttrStr EQML EQStr EpsilonPredicate FlashGT GT GTAttr GTE GTE2D HeadingTowardsPredicate HeadingVesselsToMeet HighSpeedPredicate InPortPredicate IncGT Interact "
    "IsConfigPredicate IsDayPredicate IsEventTypePredicate IsHeadingPredicate IsHourPredicate IsTimePredicate IsVesselType Join LT LT2D LTAttr LTE MeetContext Move MoveContext MovingPredicate NormalSpeedPredicate OutsideCirclePredicate SimilarGaze SimilarMovement Situation SpeedBetween SpeedOneBetween SpeedTwoBetween "
    "Split StoppedPredicate TruePredicate VesselToVesselDistance VesselToVesselHeading VesselToVesselSpeed WithinCirclePredicate WithinPolygonPredicate AmountBetween"
)


@R.add("a40_registry", f"SELECT unnest(string_split('{NAMES}', ' ')) AS name")
def a40_registry(spark: SparkSession, sf: str) -> DataFrame:
    """The registered predicates (§2.12)."""
    return spark.createDataFrame([(n,) for n in sorted(REGISTRY) if n in BUILT_IN], "name string")


BUILT_IN = frozenset(REGISTRY)


def _registers(name: str, p: str, cond: str) -> None:
    """A pair of neighbours whose second event is compared with the first, held in a register."""

    @R.add(name, f"SELECT user_id, event_id AS id_1, n_id AS id_2 FROM (SELECT *, lead(event_type) OVER {W} AS n_type, lead(value) OVER {W} AS n_value, lead(event_id) OVER {W} AS n_id FROM events) WHERE event_type = 'view' AND {cond}")
    def q(spark: SparkSession, sf: str) -> DataFrame:
        s = Stream(table(spark, sf, "events").withColumn("level", F.floor(F.col("value") / 10)))
        return detect(s, f';({_t("view")}["x"],{p}){{partitionBy:userId}}').select("user_id", "id_1", "id_2")


_registers("a20_equal", 'EQAttr(level,"x")', "floor(n_value / 10) = floor(value / 10)")
_registers("a21_equal_text", 'EQAttrStr(eventType,"x")', "n_type = event_type")
_registers("a23_less", 'LTAttr(value,"x")', "n_value < value")

AHEAD = "(value % 40) * 1.852 / 6371.0"


@R.add("a18_project", f"""WITH p AS (SELECT event_id, -5 + (event_id % 100) / 100.0 AS lon, 48 + (event_id % 97) / 97.0 AS lat, {AHEAD} AS d, radians(value * 7 % 360) AS b FROM events),
q AS (SELECT *, asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(b)) AS la2 FROM p)
SELECT event_id, round(round(degrees(radians(lon) + atan2(sin(b) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(la2))), 6), 3) AS lon, round(round(degrees(la2), 6), 3) AS lat FROM q""")
def a18_project(spark: SparkSession, sf: str) -> DataFrame:
    """Where each mover is after an hour (A-18)."""
    e = table(spark, sf, "events")
    lon, lat = F.lit(-5.0) + (F.col("event_id") % 100) / 100.0, F.lit(48.0) + (F.col("event_id") % 97) / 97.0
    x, y = geo.project_point(lon, lat, 3600, F.col("value") % 40, F.col("value") * 7 % 360)
    return e.select("event_id", F.round(x, 3).alias("lon"), F.round(y, 3).alias("lat"))


@R.add("a12_towards", """WITH p AS (SELECT event_id, -5 + (event_id % 100) / 100.0 AS x, 48 + (event_id % 97) / 97.0 AS y, value % 40 AS s, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 180 END AS h FROM events),
q AS (SELECT *, y + CASE WHEN h = 0 THEN 1 ELSE -1 END * degrees(s * 1.852 / 6371.0) AS z FROM p)
SELECT event_id, x > -4.905 AND x < -4.405 AND least(y, z) <= 48.7 AND greatest(y, z) >= 48.2 AND NOT (least(y, z) > 48.2 AND greatest(y, z) < 48.7) AS meets FROM q WHERE NOT (least(y, z) > 48.2 AND greatest(y, z) < 48.7)""")
def a12_towards(spark: SparkSession, sf: str) -> DataFrame:
    """Movers whose way of the next hour, due north or south, meets the border of a box (A-12); ways
    that stay inside it are left out."""
    lon, lat = F.lit(-5.0) + (F.col("event_id") % 100) / 100.0, F.lit(48.0) + (F.col("event_id") % 97) / 97.0
    e = table(spark, sf, "events").select("event_id", "ts", "event_type", lon.alias("lon"), lat.alias("lat"), (F.col("value") % 40).alias("speed"), F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(180.0).alias("heading"))
    s = Stream(e, regions={"box": [(-4.905, 48.2), (-4.405, 48.2), (-4.405, 48.7), (-4.905, 48.7)]}).scope()
    far = F.col("lat") + F.when(F.col("heading") == 0, 1).otherwise(-1) * F.degrees(F.col("speed") * 1.852 / 6371.0)
    inside = (F.least("lat", far) > 48.2) & (F.greatest("lat", far) < 48.7)
    return e.filter(~inside).select("event_id", build("HeadingTowardsPredicate", s, ["box"]).alias("meets"))
