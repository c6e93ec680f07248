"""Queries p3, p6, p7 and p8 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import abuse, leakage, packing, sampling
from tidewell.queries import Registry
from tidewell.session import table, written

R = Registry()
STRATA = ["event", "tweet_language"]

CLEAN = r"""
lab AS (SELECT *, nullif(lower(regexp_replace(event, '^\s+|\s+$', '', 'g')), '') AS e,
  nullif(regexp_replace(split_part(split_part(lower(regexp_replace(tweet_language, '^\s+|\s+$', '', 'g')), '-', 1), '_', 1), '^\s+|\s+$', '', 'g'), '') AS l FROM {t})"""
HAVE = f"""WITH {CLEAN.format(t='train_df')}, n AS (SELECT e, l, count(DISTINCT tweet_id) AS have FROM lab WHERE e IS NOT NULL AND l IS NOT NULL GROUP BY 1, 2),
want AS (SELECT request_id, event, tweet_language, greatest(min_rows, CAST(round(target_share * sample_rows) AS BIGINT)) AS asked FROM sample_targets),
rep AS (SELECT w.*, coalesce(have, 0) AS available FROM want w LEFT JOIN n ON w.event = n.e AND w.tweet_language = n.l)"""


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "sample_targets")
    return t.select("request_id", F.col("event").alias("event_as_given"), F.col("tweet_language").alias("language_as_given"), sampling.clean_label("event").alias("event"), sampling.clean_language("tweet_language").alias("tweet_language"), "target_share", "sample_rows", "min_rows")


def _sampled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "train_df")
    cand = sampling.candidates(rows, "tweet_id", {"event": sampling.clean_label("event"), "tweet_language": sampling.clean_language("tweet_language")})
    # written once: counts, ranks and the report all read it, and it is a fraction of the table
    return sampling.stratified_sample(written(cand), _targets(spark, sf), "tweet_id", STRATA)


@R.add("p3_found", f"{HAVE} SELECT request_id, event, tweet_language FROM rep WHERE available < asked")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that the ranked records could not supply."""
    report = _sampled(spark, sf)[1]
    return report.filter("shortfall > 0").select("request_id", F.col("event_as_given").alias("event"), F.col("language_as_given").alias("tweet_language"))


# floors first, then the smallest priorities of each request until the sample is full
SEATS = f"""{HAVE}, cat AS (SELECT r.request_id, r.event AS e, r.tweet_language AS l, max(available) AS have, sum(t.target_share) * max(t.sample_rows) AS target, least(max(available), max(t.min_rows)) AS low, max(t.sample_rows) AS rows_
  FROM rep r JOIN sample_targets t USING (request_id, event, tweet_language) GROUP BY 1, 2, 3),
more AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY (r - 0.5) / target, e, l) AS k FROM (SELECT *, unnest(range(CAST(low AS BIGINT) + 1, CAST(have AS BIGINT) + 1)) AS r FROM cat WHERE target > 0)),
open_ AS (SELECT request_id, max(rows_) - sum(low) AS n FROM cat GROUP BY 1),
got AS (SELECT m.request_id, e, l, count(*) AS n FROM more m JOIN open_ o ON o.request_id = m.request_id AND k <= o.n GROUP BY 1, 2, 3),
sel AS (SELECT c.request_id, c.e, c.l, CAST(c.low + coalesce(g.n, 0) AS BIGINT) AS selected FROM cat c LEFT JOIN got g ON c.request_id = g.request_id AND c.e = g.e AND c.l = g.l)"""


@R.add("p3_report", f"{SEATS} SELECT r.request_id, event, tweet_language, available, asked, selected, greatest(asked - available, 0) AS shortfall FROM rep r JOIN sel s ON s.request_id = r.request_id AND s.e = r.event AND s.l = r.tweet_language")
def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf)[1].select("request_id", F.col("event_as_given").alias("event"), F.col("language_as_given").alias("tweet_language"), "available", "asked", "selected", "shortfall")


@R.add("p3_seats", f"{SEATS} SELECT request_id, e AS event, l AS tweet_language, selected AS n, selected AS tweets, selected AS last_rank FROM sel WHERE selected > 0")
def p3_seats(spark: SparkSession, sf: str) -> DataFrame:
    """Per request and pair the records of the sample: rows, distinct tweets and the last rank."""
    return _sampled(spark, sf)[0].groupBy("request_id", *STRATA).agg(F.count("*").alias("n"), F.countDistinct("tweet_id").alias("tweets"), F.max("rank").alias("last_rank"))


@R.add("p3_sample")
def p3_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf)[0].select("request_id", *STRATA, "tweet_id", "rank", "priority")


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents"), table(spark, sf, "packing_jobs"))


@R.add("p6_found", "SELECT job_id, doc_id FROM packing_jobs, documents WHERE strlen(text) > capacity")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that stand in more than one container of a job."""
    return _packed(spark, sf).filter("start > 0 AND tokens > 0").select("job_id", "doc_id").distinct()


@R.add("p6_containers")
def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


@R.add("p6_pieces", "SELECT job_id, doc_id, greatest(1, CAST(ceil(strlen(text) / capacity) AS BIGINT)) AS pieces, strlen(text) AS tokens, 1 AS whole FROM packing_jobs, documents WHERE text IS NOT NULL")
def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Per job and document its pieces and tokens; ``whole`` if the pieces join without gap or overlap."""
    p = _packed(spark, sf).groupBy("job_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.min("start").alias("low"))
    return p.select("job_id", "doc_id", "pieces", "tokens", ((F.col("end") == F.col("tokens")) & (F.col("low") == 0)).cast("int").alias("whole"))


@R.add("p6_full", "SELECT job_id, CAST(sum(strlen(text)) AS BIGINT) AS tokens, 0 AS over, 1 AS tight FROM packing_jobs, documents WHERE text IS NOT NULL GROUP BY 1")
def p6_full(spark: SparkSession, sf: str) -> DataFrame:
    """Per job its tokens, the containers above the capacity, and whether it took at most 3 percent and one
    container per shard more than the least possible number."""
    boxes = _packed(spark, sf).groupBy("job_id", "shard", "container").agg(F.sum("tokens").alias("tokens"))
    jobs = table(spark, sf, "packing_jobs").select("job_id", "capacity")
    b = boxes.join(jobs, "job_id").groupBy("job_id", "capacity").agg(F.sum("tokens").alias("tokens"), F.sum((F.col("tokens") > F.col("capacity")).cast("int")).alias("over"), F.count("*").alias("n"), F.countDistinct("shard").alias("shards"))
    return b.select("job_id", "tokens", "over", (F.col("n") <= F.ceil(F.col("tokens") / F.col("capacity")) * 1.03 + F.col("shards")).cast("int").alias("tight"))


@R.add("p6_unused")
def p6_unused(spark: SparkSession, sf: str) -> DataFrame:
    """Per job: containers, tokens and the share of unused space."""
    boxes = _packed(spark, sf).groupBy("job_id", "shard", "container").agg(F.sum("tokens").alias("tokens"))
    jobs = table(spark, sf, "packing_jobs").select("job_id", "capacity")
    return boxes.groupBy("job_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens")).join(jobs, "job_id").withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity")))


# the normal form of words, and the runs of ten, as SQL writes them; wide letters by a fixed table
WIDE = "".join(chr(c) for c in range(0xFF10, 0xFF5B))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF10, 0xFF5B)).replace("'", "''")
RUNS = rf"""WITH src AS (SELECT 'i' AS kind, item_id AS id, text FROM eval_items WHERE text IS NOT NULL UNION ALL SELECT 'd', doc_id, text FROM documents WHERE text IS NOT NULL),
t1 AS (SELECT kind, id, regexp_replace(text, '<!--.*?-->|</?[A-Za-z][^<>]*>', ' ', 'gs') AS t FROM src),
t2 AS (SELECT kind, id, replace(replace(replace(replace(replace(replace(t, '&#32;', ' '), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM t1),
t3 AS (SELECT kind, id, regexp_replace(t, '[\x{{AD}}\x{{34F}}\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g') AS t FROM t2),
t4 AS (SELECT kind, id, regexp_replace(t, '([\p{{L}}\p{{N}}])[-\x{{2010}}\x{{2011}}][ \t]*\r?\n[ \t>|]*([\p{{L}}\p{{N}}])', '\1\2', 'g') AS t FROM t3),
t5 AS (SELECT kind, id, regexp_replace(strip_accents(lower(replace(translate(t, '{WIDE}³²ºª', '{NARROW}32oa'), '¼', '1/4'))), '\p{{M}}', '', 'g') AS t FROM t4),
w AS (SELECT kind, id, row_number() OVER () AS row_, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') AS w FROM t5),
g AS (SELECT kind, id, row_, unnest(range(1, len(w) - 8)) AS pos, w FROM w WHERE len(w) >= 10),
n AS (SELECT kind, id, row_, pos, array_to_string(w[pos:pos + 9], ' ') AS run FROM g),
hit AS (SELECT DISTINCT i.id AS item_id, d.id AS doc_id, d.row_, d.pos FROM n i JOIN n d ON i.kind = 'i' AND d.kind = 'd' AND i.run = d.run),
pair AS (SELECT item_id, doc_id, row_, count(DISTINCT pos) AS runs FROM hit GROUP BY 1, 2, 3),
cover AS (SELECT item_id, doc_id, row_, count(DISTINCT p) AS words FROM (SELECT *, unnest(range(pos, pos + 10)) AS p FROM hit) GROUP BY 1, 2, 3)"""


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "eval_items"), table(spark, sf, "documents"))


@R.add("p7_found", f"{RUNS} SELECT DISTINCT item_id, doc_id FROM hit")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("item_id", "doc_id").distinct()


@R.add("p7_leaks")
def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """With ranges of the original text, which the SQL of p7_words leaves out."""
    return _leaks(spark, sf)


@R.add("p7_words", f"{RUNS} SELECT DISTINCT item_id, doc_id, words, runs FROM pair JOIN cover USING (item_id, doc_id, row_)")
def p7_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words covered and runs met, per pair."""
    return _leaks(spark, sf).select("item_id", "doc_id", "words", "runs").distinct()


@R.add("p7_items", f"{RUNS} SELECT item_id, any_value(split) AS split, count(DISTINCT doc_id) AS documents, max(words) AS most_words FROM cover JOIN eval_items USING (item_id) GROUP BY 1")
def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which items leaked: documents per item."""
    pairs = _leaks(spark, sf).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("most_words"))
    return table(spark, sf, "eval_items").select("item_id", "split").join(pairs, "item_id")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.scored(table(spark, sf, "documents"), keep=["source"])


@R.add("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).filter("flagged").select("doc_id")


@R.add("p8_scores")
def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("doc_id", "source", F.round("score", 4).alias("score"), "abusive", "hateful", "sexual", "flagged", "clause")


@R.add("p8_rates")
def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.rates(_scored(spark, sf), "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(R.queries)


def oracle_sql() -> dict[str, str]:
    return dict(R.sql)
