"""Time-series queries (D-01 … D-14) on ``embeddings``, taken as labelled series of 64 values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import forecast, series
from tidewell.queries import Registry
from tidewell.session import table

R = Registry()


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select("id", "label", F.posexplode("vec").alias("t", "value")).withColumn("value", F.col("value").cast("double"))


PAIRS = """q AS (SELECT vec_id AS query, embedding AS a FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT unnest([8, 32, 64]) AS prefix),
d AS (SELECT query, prefix, vec_id AS neighbour, round(sqrt(list_sum(list_transform(range(1, prefix + 1), lambda i: (a[i]::DOUBLE - embedding[i]::DOUBLE) * (a[i]::DOUBLE - embedding[i]::DOUBLE)))), 9) AS distance FROM q, p, embeddings WHERE vec_id <> query)"""


@R.add("d01_prefix_nn", f"WITH {PAIRS} SELECT query, prefix, neighbour, CAST(rank AS INTEGER) AS rank, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query, prefix ORDER BY distance, neighbour) AS rank FROM d) WHERE rank <= 3")
def d01_prefix_nn(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest neighbours on prefixes, of every row whose id is divisible by 100 against all rows."""
    r = _rows(spark, sf)
    return series.nearest(r.filter("id % 100 = 0"), r, 3, prefixes=[8, 32, 64]).withColumn("distance", F.round("distance", 5))


def _early(spark: SparkSession, sf: str, fit) -> DataFrame:  # noqa: ANN001
    r = _rows(spark, sf)
    x, y = series.training_sample(r, 400)
    return series.classify_early(r, fit(x, y))


@R.add("d02_ects")
def d02_ects(spark: SparkSession, sf: str) -> DataFrame:
    """Early classification by nearest neighbours (D-02, D-03, D-04), trained on 400 series."""
    return _early(spark, sf, lambda x, y: series.Ects.fit(x, y))


@R.add("d05_stopping")
def d05_stopping(spark: SparkSession, sf: str) -> DataFrame:
    return _early(spark, sf, lambda x, y: series.Stopping.fit(x, y))


@R.add("d06_truncation")
def d06_truncation(spark: SparkSession, sf: str) -> DataFrame:
    return _early(spark, sf, lambda x, y: series.Truncation.fit(x, y))


@R.add("d07_economy")
def d07_economy(spark: SparkSession, sf: str) -> DataFrame:
    return _early(spark, sf, lambda x, y: series.Economy.fit(x, y))


@R.add("d13_measures")
def d13_measures(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, q in (("ects", d02_ects), ("stopping", d05_stopping), ("truncation", d06_truncation), ("economy", d07_economy)):
        m = series.early_measures(q(spark, sf)).withColumn("method", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


@R.add("d09_paa", "WITH x AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings) SELECT id, least(t // 6, 9) AS segment, round(avg(value), 6) AS value FROM x GROUP BY 1, 2")
def d09_paa(spark: SparkSession, sf: str) -> DataFrame:
    return series.paa(_long(spark, sf), ["id"], "t", "value", 10, 64).withColumn("value", F.round("value", 6))


@R.add("d10_merge", "WITH x AS (SELECT vec_id // 4 AS id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings) SELECT id, CAST(t AS INTEGER) AS t, round(avg(value), 6) AS value FROM x GROUP BY 1, 2")
def d10_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Four neighbouring rows taken as the dimensions of one series."""
    return series.merge_dimensions(_long(spark, sf).withColumn("id", F.floor(F.col("id") / 4)), "id", "t", "value").withColumn("value", F.round("value", 6))


@R.add("d11_vote")
def d11_vote(spark: SparkSession, sf: str) -> DataFrame:
    d = d06_truncation(spark, sf).select(F.floor(F.col("id") / 4).alias("id"), F.col("prefix").alias("t"), "predicted")
    return series.vote(d, "id", 4)


@R.add("d12_fill", """WITH RECURSIVE x AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), g AS (SELECT id, i, CASE WHEN (i * 7 + id) % 5 <> 0 THEN v END AS v FROM x),
n AS (SELECT *, first_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM g),
f(id, i, v, filled) AS (SELECT id, i, v, coalesce(v, 0.0) FROM n WHERE i = 1 UNION ALL SELECT n.id, n.i, n.v, coalesce(n.v, CASE WHEN n.later IS NULL THEN f.filled ELSE (f.filled + n.later) / 2 END) FROM f JOIN n ON n.id = f.id AND n.i = f.i + 1)
SELECT id, count(*) - count(v) AS gaps, round(sum(filled * i), 4) AS checksum FROM f GROUP BY 1""")
def d12_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth value is taken out and filled again."""
    v = F.transform("vec", lambda x, i: F.when(((i + 1) * 7 + F.col("id")) % 5 != 0, x.cast("double")))
    d = _rows(spark, sf).select("id", v.alias("v")).withColumn("filled", series.fill_gaps(F.col("v")))
    return d.select("id", F.size(F.filter("v", lambda x: x.isNull())).cast("long").alias("gaps"), F.round(F.aggregate(F.transform("filled", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("checksum"))


@R.add("d14_folds", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), f AS (SELECT unnest(range(10)) AS fold) SELECT label, CAST(fold AS INTEGER) AS fold, n // 10 + CASE WHEN fold < n % 10 THEN 1 ELSE 0 END AS n FROM c, f WHERE n // 10 + CASE WHEN fold < n % 10 THEN 1 ELSE 0 END > 0")
def d14_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Ten folds, each class spread over all of them as evenly as its number allows."""
    return forecast.stratified_folds(_rows(spark, sf), "id", 10, "label").groupBy("label", "fold").agg(F.count("*").alias("n"))
