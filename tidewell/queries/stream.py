"""Queries on the card stream: p1, p2, p4 and p5."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.entity_features import entity_features
from tidewell.operators.redelivery import MessageStore
from tidewell.operators.rolling import rolling_totals
from tidewell.operators.skew import per_key_runs
from tidewell.plans.messages import DAY_MS, clean_pan, event_ms, messages, number_of, units
from tidewell.queries import Registry
from tidewell.session import shared_dir, table

R = Registry()

# The definitions of TESTDATA.md in SQL.
MESSAGES = r"""
rows AS (SELECT *, coalesce(key_trx_no, trx_no) AS number FROM input_stream),
kept AS (SELECT *, row_number() OVER (PARTITION BY number, CASE WHEN number IS NULL THEN delivery_id END ORDER BY delivery_id) AS rn
         FROM rows WHERE number IS NULL OR number <> -1),
msg AS (SELECT delivery_id, number,
          nullif(regexp_replace(lower(pan), '[\s\-]+', '', 'g'), '') AS pan,
          CASE WHEN "timestamp" > 0 AND "timestamp" < 100000000000 THEN "timestamp" * 1000 WHEN "timestamp" > 0 THEN "timestamp" END AS ms,
          CASE WHEN amount IS NULL OR isnan(amount) THEN 0 ELSE CAST(round(amount * 100) AS BIGINT) END AS units,
          is_fraud, fraud_type
        FROM kept WHERE rn = 1)"""
DAYS = """
daily AS (SELECT pan, CAST(floor(ms / 86400000.0) AS BIGINT) AS d, sum(units) AS v, count(*) AS n FROM msg WHERE pan IS NOT NULL AND ms IS NOT NULL GROUP BY 1, 2),
span AS (SELECT pan, min(d) AS a, max(d) AS b FROM daily GROUP BY 1),
cal AS (SELECT pan, unnest(range(a, b + 1)) AS d FROM span),
full_ AS (SELECT cal.pan, cal.d, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM cal LEFT JOIN daily USING (pan, d)),
roll AS (SELECT pan, d,
   sum(v) OVER (PARTITION BY pan ORDER BY d ROWS 6 PRECEDING) AS v7, sum(n) OVER (PARTITION BY pan ORDER BY d ROWS 6 PRECEDING) AS n7,
   sum(v) OVER (PARTITION BY pan ORDER BY d ROWS 29 PRECEDING) AS v30, sum(n) OVER (PARTITION BY pan ORDER BY d ROWS 29 PRECEDING) AS n30
  FROM full_)"""


def _daily_messages(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(table(spark, sf, "input_stream"), {"pan": clean_pan("pan"), "day": F.floor(event_ms("timestamp") / F.lit(DAY_MS)).cast("int"), "units": units("amount")})
    return m.filter(F.col("pan").isNotNull() & F.col("day").isNotNull())


def _rolling(spark: SparkSession, sf: str) -> DataFrame:
    return rolling_totals(_daily_messages(spark, sf), "pan", "day", "units", (7, 30))


@R.add("p1_found", f"WITH {MESSAGES}, {DAYS} SELECT pan, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS cal_day FROM roll WHERE v7 >= v30 + 1")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _rolling(spark, sf).filter(F.col("units_7") >= F.col("units_30") + 1).select("pan", F.date_format("cal_day", "yyyy-MM-dd").alias("cal_day"))


@R.add("p1_rolling", f"""WITH {MESSAGES}, {DAYS} SELECT pan, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS cal_day,
 CAST(n7 AS BIGINT) AS n_7, round(v7 / 100.0, 2) AS total_7, round(v7 / 100.0 / 7, 6) AS avg_7,
 CAST(n30 AS BIGINT) AS n_30, round(v30 / 100.0, 2) AS total_30, round(v30 / 100.0 / 30, 6) AS avg_30 FROM roll""")
def p1_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return _rolling(spark, sf).select("pan", F.date_format("cal_day", "yyyy-MM-dd").alias("cal_day"), *[c for w in (7, 30) for c in (F.col(f"n_{w}"), F.round(f"total_{w}", 2).alias(f"total_{w}"), F.round(f"avg_{w}", 6).alias(f"avg_{w}"))])


def _features(spark: SparkSession, sf: str) -> DataFrame:
    stream = table(spark, sf, "input_stream")
    m = messages(stream, {"pan": clean_pan("pan"), "fraud_type": F.col("fraud_type"), "is_fraud": F.col("is_fraud"), "units": units("amount"), "ms": event_ms("timestamp")})
    as_of = stream.filter(F.coalesce(number_of(), F.lit(0)) != -1).agg(F.max(event_ms("timestamp")))
    return entity_features(m, "pan", "fraud_type", "is_fraud", "units", "ms", as_of.scalar())


@R.add("p2_found", f"WITH {MESSAGES} SELECT pan, fraud_type FROM msg WHERE pan IS NOT NULL AND fraud_type > 0 AND is_fraud = 1 GROUP BY 1, 2 HAVING count(*) >= 2")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("pan", F.inline("features")).filter("flag = 1 AND n >= 2").select("pan", F.col("code").alias("fraud_type"))


@R.add("p2_features", f"""WITH {MESSAGES}, until_ AS (SELECT max(CASE WHEN "timestamp" > 0 AND "timestamp" < 100000000000 THEN "timestamp" * 1000 WHEN "timestamp" > 0 THEN "timestamp" END) AS t FROM rows WHERE coalesce(number, 0) <> -1),
ent AS (SELECT pan, count(*) AS n_events, max(ms) AS last FROM msg WHERE pan IS NOT NULL GROUP BY 1),
cell AS (SELECT pan, fraud_type, CASE WHEN is_fraud IN (0, 1) THEN is_fraud END AS is_fraud, count(*) AS n, round(sum(units) / 100.0, 2) AS total, max(ms) AS last FROM msg WHERE pan IS NOT NULL AND fraud_type > 0 GROUP BY ALL)
SELECT e.pan, n_events, t - e.last AS since_ms, fraud_type, is_fraud, n, total, t - cell.last AS type_since_ms FROM ent e LEFT JOIN cell ON e.pan = cell.pan CROSS JOIN until_""")
def p2_features(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf).select("pan", "n_events", "since_ms", F.explode_outer("features").alias("x"))
    return f.select("pan", "n_events", "since_ms", F.col("x.code").alias("fraud_type"), F.col("x.flag").alias("is_fraud"), F.col("x.n").alias("n"), F.round("x.total", 2).alias("total"), F.col("x.since_ms").alias("type_since_ms"))


def _stored(spark: SparkSession, sf: str, loads: int = 3) -> MessageStore:
    """The stream taken in as deliveries come: the batches in ``loads`` runs one after another."""
    stream = table(spark, sf, "input_stream")
    low, high = stream.agg(F.min("batch_id"), F.max("batch_id")).first()
    store = MessageStore(spark, shared_dir(spark))
    step = ((high or 0) + 1 - (low or 0)) / (loads + 1)
    # the first run takes half of the time range, the others equal parts of the rest; bounds on the
    # column itself, so the scan of a run skips the row groups of the others
    cuts = [math.ceil((low or 0) + step * (k + 2)) for k in range(loads - 1)]
    for k in range(loads):
        run = F.lit(True) if loads == 1 else F.col("batch_id") >= cuts[k - 1] if k == loads - 1 else F.col("batch_id").isNull() | (F.col("batch_id") < cuts[0]) if k == 0 else (F.col("batch_id") >= cuts[k - 1]) & (F.col("batch_id") < cuts[k])
        store.load(stream.filter(run), number_of(), F.floor(F.col("batch_id") / 24))
    return store


@R.add("p4_found", "WITH r AS (SELECT coalesce(key_trx_no, trx_no) AS trx_no, delivery_id FROM input_stream) SELECT trx_no, delivery_id FROM r WHERE trx_no IS NOT NULL AND trx_no <> -1 QUALIFY row_number() OVER (PARTITION BY trx_no ORDER BY delivery_id) > 1")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).superseded().select(F.col("number").alias("trx_no"), "delivery_id")


@R.add("p4_messages", """WITH r AS (SELECT *, coalesce(key_trx_no, trx_no) AS number FROM input_stream) SELECT delivery_id, batch_id, key_trx_no, trx_no, "timestamp", pan, CASE WHEN isnan(amount) THEN NULL ELSE amount END AS amount, is_fraud, fraud_type FROM r
WHERE number IS NULL OR number <> -1 QUALIFY row_number() OVER (PARTITION BY number, CASE WHEN number IS NULL THEN delivery_id END ORDER BY delivery_id) = 1""")
def p4_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).current().select("delivery_id", "batch_id", "key_trx_no", "trx_no", "timestamp", "pan", F.expr("nullif(amount, double('NaN'))").alias("amount"), "is_fraud", "fraud_type")


def _per_pan(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "input_stream").select(clean_pan("pan").alias("pan"), "delivery_id", "amount", "is_fraud")
    return per_key_runs(rows, "pan", "delivery_id", units("amount"), F.col("is_fraud"))


@R.add("p5_found", r"SELECT nullif(regexp_replace(lower(pan), '[\s\-]+', '', 'g'), '') AS pan FROM input_stream GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(*) FROM input_stream) AND nullif(regexp_replace(lower(any_value(pan)), '[\s\-]+', '', 'g'), '') IS NOT NULL")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    total = table(spark, sf, "input_stream").agg(F.count("*").alias("n"))
    return _per_pan(spark, sf).withColumn("all", total.scalar()).filter(F.col("n") * 50 >= F.col("all")).select("pan")


@R.add("p5_pan_runs", r"""WITH r AS (SELECT nullif(regexp_replace(lower(pan), '[\s\-]+', '', 'g'), '') AS pan, delivery_id, CASE WHEN amount IS NULL OR isnan(amount) THEN 0 ELSE CAST(round(amount * 100) AS BIGINT) END AS units, coalesce(is_fraud, -1) AS mark FROM input_stream),
c AS (SELECT *, CASE WHEN mark <> lag(mark) OVER w THEN 1 ELSE 0 END AS ch FROM r WHERE pan IS NOT NULL WINDOW w AS (PARTITION BY pan ORDER BY delivery_id)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY pan ORDER BY delivery_id ROWS UNBOUNDED PRECEDING) AS grp FROM c),
len AS (SELECT pan, grp, count(*) AS k FROM g GROUP BY ALL)
SELECT a.pan, a.n, CAST(a.units AS BIGINT) AS units, first_id, last_id, CAST(changes AS BIGINT) AS changes, best_run FROM
 (SELECT pan, count(*) AS n, sum(units) AS units, min(delivery_id) AS first_id, max(delivery_id) AS last_id, sum(ch) AS changes FROM c GROUP BY 1) a JOIN (SELECT pan, max(k) AS best_run FROM len GROUP BY 1) b USING (pan)""")
def p5_pan_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _per_pan(spark, sf)
