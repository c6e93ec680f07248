"""Run-time adaptation queries (C-01 … C-12) with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import adapt
from tidewell.queries import Registry
from tidewell.session import table

R = Registry()
WEEK = 7 * 86_400_000

BUCKETS = f"""WITH RECURSIVE t AS (SELECT DISTINCT "timestamp" AS t FROM model_runtime_scores WHERE "timestamp" IS NOT NULL),
s(i, t) AS (SELECT 0, min(t) FROM t UNION ALL SELECT i + 1, (SELECT min(t.t) FROM t WHERE t.t > s.t + {WEEK}) FROM s WHERE (SELECT min(t.t) FROM t WHERE t.t > s.t + {WEEK}) IS NOT NULL),
b AS (SELECT i, t, lead(t, 1, 9223372036854775807) OVER (ORDER BY i) AS e FROM s),
r AS (SELECT m.*, b.i AS bucket FROM model_runtime_scores m JOIN b ON m."timestamp" >= b.t AND m."timestamp" < b.e)"""


def _bucketed(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "model_runtime_scores")
    return adapt.with_bucket(s, "timestamp", adapt.bucket_starts(s, "timestamp", WEEK))


@R.add("c01_buckets", f'{BUCKETS} SELECT bucket, min("timestamp") AS ts, max("timestamp") AS te, count(*) AS records FROM r GROUP BY 1')
def c01_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return adapt.bucket_summary(_bucketed(spark, sf), "timestamp")


@R.add("c02_last_k", f'{BUCKETS} SELECT bucket, greatest(bucket - 3, 0) AS first, bucket AS last FROM r GROUP BY 1')
def c02_last_k(spark: SparkSession, sf: str) -> DataFrame:
    return adapt.last_k_datasets(adapt.bucket_summary(_bucketed(spark, sf), "timestamp"), 4)


MCC = """CASE WHEN json_valid(runtime_metrics) THEN CAST(json_extract(runtime_metrics, '$.mcc') AS DOUBLE) END"""


@R.add("c03_score_based", f"""{BUCKETS}, m AS (SELECT bucket, round(avg({MCC}), 9) AS mcc FROM (SELECT DISTINCT * FROM r) GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY bucket DESC) AS k FROM m),
o AS (SELECT *, row_number() OVER (ORDER BY coalesce(mcc, 0) DESC, bucket DESC) AS j FROM n WHERE k > 3) SELECT bucket, 'newest' AS why FROM n WHERE k <= 3 UNION ALL SELECT bucket, 'best' FROM o WHERE j <= 3""")
def c03_score_based(spark: SparkSession, sf: str) -> DataFrame:
    s = adapt.readable_scores(table(spark, sf, "model_runtime_scores"))
    starts = adapt.bucket_starts(s, "timestamp", WEEK)
    b = adapt.with_bucket(s, "timestamp", starts).groupBy("bucket").agg(F.round(F.avg("mcc"), 9).alias("mcc")).filter("bucket IS NOT NULL")
    return adapt.score_based_dataset(b, 6).select("bucket", "why")


@R.add("c04_score_bucket", f'{BUCKETS}, u AS (SELECT bucket, min("timestamp") AS ts, max("timestamp") AS te FROM r GROUP BY 1) SELECT "timestamp", model_version, bucket FROM (SELECT DISTINCT * FROM model_runtime_scores) m JOIN u ON m."timestamp" >= ts AND m."timestamp" <= te')
def c04_score_bucket(spark: SparkSession, sf: str) -> DataFrame:
    b = adapt.bucket_summary(_bucketed(spark, sf), "timestamp")
    return adapt.score_buckets(table(spark, sf, "model_runtime_scores").distinct(), b).select("timestamp", "model_version", "bucket")


@R.add("c05_assemble", f"""WITH e AS (SELECT CAST(floor(epoch_us(ts) / 1e6 / 86400) - 19723 AS INTEGER) AS bucket, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS t FROM events),
v AS (SELECT version, unnest(range(buckets_range[1], buckets_range[-1] + 1)) AS bucket FROM dataset_versions WHERE buckets_range IS NOT NULL)
SELECT version, count(*) AS records, min(t) AS first_ts, max(t) AS last_ts, count(DISTINCT v.bucket) AS buckets FROM v JOIN e USING (bucket) GROUP BY 1""")
def c05_assemble(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"))
    e = e.withColumn("bucket", (F.floor(F.col("t") / 86400) - 19723).cast("int"))
    return adapt.assemble(e, table(spark, sf, "dataset_versions"), t="t")


@R.add("c06_trend", f"""WITH s AS (SELECT DISTINCT "timestamp", model_version, lower(trim(creation_method)) AS method, batch_metrics, {MCC} AS mcc FROM model_runtime_scores),
x AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY "timestamp", mcc)::DOUBLE AS i FROM s WHERE mcc IS NOT NULL)
SELECT method, "timestamp", mcc, round(CASE WHEN count(*) OVER w >= 2 THEN regr_slope(mcc, i) OVER w END, 6) AS slope, round(mcc - lag(mcc) OVER (PARTITION BY method ORDER BY "timestamp", mcc), 6) AS change FROM x WINDOW w AS (PARTITION BY method ORDER BY "timestamp", mcc ROWS 3 PRECEDING)""")
def c06_trend(spark: SparkSession, sf: str) -> DataFrame:
    s = adapt.readable_scores(table(spark, sf, "model_runtime_scores"))
    t = adapt.trends(s, 4, ["method"])
    return t.select("method", "timestamp", "mcc", F.round("slope", 6).alias("slope"), F.round("change", 6).alias("change"))


@R.add("c06_policy", f"""WITH RECURSIVE s AS (SELECT DISTINCT "timestamp", model_version, lower(trim(creation_method)) AS method, batch_metrics, {MCC} AS mcc FROM model_runtime_scores),
x AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY "timestamp", mcc) AS i FROM s WHERE mcc IS NOT NULL),
t AS (SELECT method, "timestamp" AS ts, mcc, i, CASE WHEN count(*) OVER w >= 2 THEN regr_slope(mcc, i::DOUBLE) OVER w END AS slope, mcc - lag(mcc) OVER (PARTITION BY method ORDER BY i) AS change FROM x WINDOW w AS (PARTITION BY method ORDER BY i ROWS 2 PRECEDING)),
f AS (SELECT *, coalesce(change < -0.05, false) OR coalesce(slope < -0.05, false) AS falls FROM t),
p(method, i, ts, mcc, instruction, since) AS (SELECT DISTINCT method, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::VARCHAR, 3::BIGINT FROM f UNION ALL
 SELECT f.method, f.i, f.ts, f.mcc, CASE WHEN f.mcc < 0.2 THEN 'optimise' WHEN f.falls THEN CASE WHEN p.since + 1 <= 2 THEN 'optimise' ELSE 'train' END ELSE 'none' END, CASE WHEN f.mcc < 0.2 OR f.falls THEN 0 ELSE p.since + 1 END FROM p JOIN f ON f.method IS NOT DISTINCT FROM p.method AND f.i = p.i + 1)
SELECT method, ts AS "timestamp", mcc AS score, instruction FROM p WHERE i > 0""")
def c06_policy(spark: SparkSession, sf: str) -> DataFrame:
    """The instructions of the hybrid policy, per way of creation."""
    return adapt.instructions(adapt.readable_scores(table(spark, sf, "model_runtime_scores")), adapt.Policy(), ["method"])


@R.add("c07_commands")
def c07_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Commands of one optimisation over the model parameters on record (C-07, C-08)."""
    p = table(spark, sf, "model_versions").select(F.from_json("model_params", "order int, confidence double, gamma double").alias("p")).select("p.*")
    low, high = p.agg(F.min("confidence"), F.min("gamma")).first(), p.agg(F.max("confidence"), F.max("gamma")).first()
    search = adapt.BayesSearch([low[0] or 0.0, low[1] or 0.0], [high[0] or 1.0, high[1] or 1.0], initial=4)
    log = adapt.command_log("optimise", lambda x: (x[0] - 0.3) ** 2 + x[1], search, 10)
    return spark.createDataFrame([(c["id"], c["type"], json.dumps(c["params"]), c["best_i"]) for c in log], "id int, type string, params string, best_i int")


@R.add("c09_objective", """SELECT id, round(-(0.5 * CAST(json_extract(model_params, '$.confidence') AS DOUBLE) - 0.5 * tanh(pt / 50000.0 - 1)), 6) AS objective FROM model_versions WHERE json_valid(model_params)""")
def c09_objective(spark: SparkSession, sf: str) -> DataFrame:
    p = F.from_json("model_params", "confidence double")
    return table(spark, sf, "model_versions").filter("model_params IS NOT NULL").select("id", F.round(adapt.objective(p["confidence"], F.col("pt"), 50000.0), 6).alias("objective"))


@R.add("c10_mcc", """WITH s AS (SELECT DISTINCT "timestamp", model_version, lower(trim(creation_method)) AS method, runtime_metrics, batch_metrics FROM model_runtime_scores WHERE json_valid(batch_metrics)),
c AS (SELECT "timestamp", model_version, CAST(json_extract(batch_metrics, '$.tp') AS DOUBLE) AS tp, CAST(json_extract(batch_metrics, '$.fp') AS DOUBLE) AS fp, CAST(json_extract(batch_metrics, '$.fn') AS DOUBLE) AS fn, CAST(json_extract(batch_metrics, '$.tn') AS DOUBLE) AS tn FROM s)
SELECT "timestamp", model_version, round(CASE WHEN tp+fp > 0 AND tp+fn > 0 AND tn+fp > 0 AND tn+fn > 0 THEN sqrt(tp/(tp+fp) * tp/(tp+fn) * tn/(tn+fp) * tn/(tn+fn)) - sqrt((1-tp/(tp+fp)) * (1-tp/(tp+fn)) * (1-tn/(tn+fp)) * (1-tn/(tn+fn))) ELSE 0 END, 5) AS mcc FROM c WHERE tp IS NOT NULL AND fp IS NOT NULL AND fn IS NOT NULL AND tn IS NOT NULL""")
def c10_mcc(spark: SparkSession, sf: str) -> DataFrame:
    s = adapt.readable_scores(table(spark, sf, "model_runtime_scores"))
    return adapt.scores_from_counts(s.drop("mcc")).select("timestamp", "model_version", F.round("mcc", 5).alias("mcc"))


@R.add("c12_improvement", f"""WITH s AS (SELECT DISTINCT "timestamp", model_version, lower(trim(creation_method)) AS method, batch_metrics, {MCC} AS mcc FROM model_runtime_scores), w AS (SELECT "timestamp" // {WEEK} AS week, method, round(avg(mcc), 9) AS mcc FROM s WHERE mcc IS NOT NULL GROUP BY 1, 2)
SELECT a.week, a.mcc AS base, b.mcc AS other, round(100 * (b.mcc - a.mcc) / greatest(abs(a.mcc), 0.05), 5) AS percent FROM w a JOIN w b ON a.week = b.week AND a.method = 'retrain' AND b.method = 'optimisation'""")
def c12_improvement(spark: SparkSession, sf: str) -> DataFrame:
    s = adapt.readable_scores(table(spark, sf, "model_runtime_scores")).filter("mcc IS NOT NULL")
    w = s.groupBy(F.floor(F.col("timestamp") / WEEK).alias("week"), "method").agg(F.round(F.avg("mcc"), 9).alias("mcc"))
    out = adapt.improvement(w.filter("method = 'retrain'"), w.filter("method = 'optimisation'"), "week", "mcc")
    return out.withColumn("percent", F.round("percent", 5))
