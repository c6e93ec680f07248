"""Text (E-01 … E-11), monitors (G-01 … G-09) and explanations (H-01 … H-11)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import explain as ex
from tidewell.operators import monitors as mo
from tidewell.operators import series
from tidewell.operators import textmine as tm
from tidewell.queries import Registry
from tidewell.session import table

R = Registry()

# -- text ----------------------------------------------------------------------------------------


@R.add("e01_anonymise", r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[\w.+\-]+@[\w\-]+(\.[\w\-]+)+', '<EMAIL>', 'g'), '@\S+', '<USERNAME>', 'g') AS text FROM documents""")
def e01_anonymise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tm.anonymise(F.col("text")).alias("text"))


E02 = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '@\S+', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'), '#\S+', ' ', 'g'), '&#?\w+;', ' ', 'g'), '\s+', ' ', 'g'))"""


@R.add("e02_strip", f"SELECT doc_id, {E02.format(c='text')} AS text FROM documents WHERE text IS NOT NULL")
def e02_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", tm.strip_marks(F.col("text")).alias("text"))


def _language_sql() -> str:
    """Per language the share of its function words; the largest wins, equal ones by name."""
    lists = ", ".join(f"{{'share': len(list_filter(w, lambda x: x IN ({', '.join(repr(y) for y in words.split())}))) / len(w), 'lang': '{k}'}}" for k, words in tm.STOPWORDS.items())
    return rf"""WITH d AS (SELECT regexp_extract(lower(trim(tweet_language)), '^([a-z]*)', 1) AS given, list_filter(regexp_split_to_array(lower({E02.format(c='tweet_text')}), '[^\p{{L}}]+'), lambda x: x <> '') AS w FROM train_df WHERE tweet_text IS NOT NULL),
s AS (SELECT given, w, list_reverse_sort([{lists}]) AS s FROM d)
SELECT given, CASE WHEN len(w) > 0 AND s[1].share > s[2].share THEN s[1].lang ELSE 'unknown' END AS detected, count(*) AS n FROM s GROUP BY 1, 2"""


@R.add("e03_language", _language_sql())
def e03_language(spark: SparkSession, sf: str) -> DataFrame:
    """The detected language against the given tag, cleaned; null texts are left out (E-03, E-04)."""
    d = table(spark, sf, "train_df").na.drop(subset=["tweet_text"])
    tag = F.regexp_extract(F.lower(F.trim("tweet_language")), r"^([a-z]*)", 1)
    return d.groupBy(tag.alias("given"), tm.detect_language(F.col("tweet_text")).alias("detected")).agg(F.count("*").alias("n"))


def _tweets(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "train_df").dropDuplicates(["tweet_id"]).na.drop(subset=["tweet_text"])
    event = F.lower(F.trim(F.regexp_replace("event", r"[\r\n\t]", "")))
    return t.withColumns({"event": F.when(event != "", event), "tweet_language": F.regexp_extract(F.lower(F.trim("tweet_language")), r"^([a-z]*)", 1), "text": tm.anonymise(F.col("tweet_text"))})


@R.add("e05_classify")
def e05_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Train on 70 percent, report precision, recall and F1 per language and class on the rest."""
    t = _tweets(spark, sf)
    held = F.pmod(F.xxhash64("tweet_id"), F.lit(10)) < 3
    m = tm.fit_naive_bayes(t.filter(~held), "text", "event")
    got = tm.classify(t.filter(held), "text", m)
    return series.class_report(got, "event", "predicted", ["tweet_language"])


@R.add("e05_report", """WITH r AS (SELECT rater_id, abusive AS l, hateful AS p FROM review_labels WHERE abusive IS NOT NULL AND hateful IS NOT NULL), c AS (SELECT DISTINCT rater_id, l AS class FROM r UNION SELECT DISTINCT rater_id, p FROM r),
s AS (SELECT c.rater_id, c.class, sum(CASE WHEN l = class THEN 1 ELSE 0 END) AS support, sum(CASE WHEN p = class THEN 1 ELSE 0 END) AS given, sum(CASE WHEN l = class AND p = class THEN 1 ELSE 0 END) AS right_ FROM c JOIN r ON c.rater_id = r.rater_id GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN given > 0 THEN right_ / given ELSE 0 END AS pr, CASE WHEN support > 0 THEN right_ / support ELSE 0 END AS re FROM s)
SELECT rater_id, class, CAST(support AS BIGINT) AS support, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM m""")
def e05_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report on given labels, per rater."""
    r = series.class_report(table(spark, sf, "review_labels"), "abusive", "hateful", ["rater_id"])
    return r.select("rater_id", "class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


COS = """q AS (SELECT vec_id AS query, embedding AS a FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id AS neighbour, round(1 - list_sum(list_transform(range(1, 65), lambda i: a[i]::DOUBLE * embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS distance FROM q, embeddings WHERE vec_id <> query)"""


@R.add("e06_retrieve", f"WITH {COS} SELECT query, neighbour, CAST(rank AS INTEGER) AS rank, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM s) WHERE rank <= 20")
def e06_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """Top 20 by cosine for every row whose id is divisible by 100, against all rows."""
    v = _vectors(spark, sf)
    return series.nearest(v.filter("id % 100 = 0"), v, 20, "cosine").select("query", "neighbour", "rank", F.round("distance", 5).alias("distance"))


@R.add("e06_context", "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY 1, 2) SELECT label, round(sum(v * i), 4) AS checksum FROM m GROUP BY 1")
def e06_context(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of context vectors as a query."""
    m = tm.mean_vector(_vectors(spark, sf), ["label"])
    return m.select("label", F.round(F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("checksum"))


@R.add("e07_gate", f"WITH {COS}, t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM s), r AS (SELECT t.*, row_number() OVER (PARTITION BY query ORDER BY rank) AS k FROM t JOIN embeddings e ON e.vec_id = neighbour WHERE rank <= 20 AND e.label % 3 = 0) SELECT query, neighbour, CAST(rank AS INTEGER) AS rank FROM r WHERE k <= 5")
def e07_gate(spark: SparkSession, sf: str) -> DataFrame:
    hits = e06_retrieve(spark, sf).join(_vectors(spark, sf).select(F.col("id").alias("neighbour"), "label"), "neighbour")
    return tm.relevance_gate(hits, "query", "rank", F.col("label") % 3 == 0).select("query", "neighbour", "rank")


VOTES = "v AS (SELECT user_id % 50 AS query, event_type AS voter, event_id % 20 AS doc, max(value) AS score FROM events GROUP BY 1, 2, 3)"


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy((F.col("user_id") % 50).alias("query"), F.col("event_type").alias("voter"), (F.col("event_id") % 20).alias("doc")).agg(F.max("value").alias("score"))


@R.add("e08_comb_sum", f"WITH {VOTES}, n AS (SELECT *, min(score) OVER w AS a, max(score) OVER w AS z FROM v WINDOW w AS (PARTITION BY query, voter)), s AS (SELECT query, doc, sum(CASE WHEN z > a THEN (score - a) / (z - a) ELSE 1 END) AS fused FROM n GROUP BY 1, 2) SELECT query, doc, round(fused, 6) AS fused, CAST(row_number() OVER (PARTITION BY query ORDER BY round(fused, 9) DESC, doc) AS INTEGER) AS rank FROM s")
def e08_comb_sum(spark: SparkSession, sf: str) -> DataFrame:
    return tm.comb_sum(_votes(spark, sf), "query", "voter", "doc", "score").withColumn("fused", F.round("fused", 6))


@R.add("e08_outranking", f"""WITH {VOTES}, r AS (SELECT query, voter, doc, row_number() OVER (PARTITION BY query, voter ORDER BY score DESC, doc) AS rank FROM v), d AS (SELECT DISTINCT query, doc FROM r), w AS (SELECT DISTINCT query, voter FROM r),
f AS (SELECT d.query, d.doc, w.voter, coalesce(rank, 2147483647) AS rank FROM d JOIN w ON d.query = w.query LEFT JOIN r ON r.query = d.query AND r.voter = w.voter AND r.doc = d.doc),
p AS (SELECT a.query, a.doc, b.doc AS o, count(*) AS n FROM f a JOIN f b ON a.query = b.query AND a.voter = b.voter AND a.rank < b.rank GROUP BY 1, 2, 3), o AS (SELECT query, doc, count(*) AS k FROM p WHERE n * 2 > 5 GROUP BY 1, 2) SELECT d.query, d.doc, coalesce(k, 0) AS outranks FROM d LEFT JOIN o ON d.query = o.query AND d.doc = o.doc""")
def e08_outranking(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    v = _votes(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("query", "voter").orderBy(F.desc("score"), "doc"))).drop("score")
    return tm.outranking(v, "query", "voter", "doc", "rank", 5)


@R.add("e09_batches", "WITH b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 150 AS batch FROM documents), n AS (SELECT batch, count(*) AS added FROM b GROUP BY 1) SELECT batch, added, CAST(sum(added) OVER (ORDER BY batch) AS BIGINT) AS indexed FROM n")
def e09_batches(spark: SparkSession, sf: str) -> DataFrame:
    return tm.cumulative_counts(tm.batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 150))


@R.add("e10_history", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS answers FROM events WHERE event_type = 'signup' GROUP BY 1")
def e10_history(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("event_type = 'signup'").withColumn("at", F.struct("ts", "event_id"))
    h = tm.history(e, "user_id", "at", "event_id")
    return h.select("user_id", F.array_join(F.transform("answers", lambda x: x.cast("string")), ",").alias("answers"))


@R.add("e11_pairs", "SELECT user_id, event_type, max(value) AS value FROM events GROUP BY 1, 2")
def e11_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tm.distinct_pairs(table(spark, sf, "events"), ["user_id", "event_type"], "value")


# -- monitors ------------------------------------------------------------------------------------

NORM = "list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))"


@R.add("g01_estimates", f"""WITH m AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), mm AS (SELECT label, sum(v * v) AS s, sum(v) AS along FROM m GROUP BY 1),
n AS (SELECT label, avg({NORM}) AS a, max({NORM}) AS z FROM embeddings GROUP BY 1) SELECT n.label, round(a, 5) AS naive, round(a - along * along / 64, 5) AS linear, round(z, 5) AS largest, round(a - s, 5) AS variance FROM n JOIN mm ON n.label = mm.label""")
def g01_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """The naive, linear and largest-norm estimates beside the exact variance (G-01, G-02, G-03)."""
    v, by = _vectors(spark, sf), ["label"]
    out = mo.naive(v, by).withColumnRenamed("estimate", "naive")
    out = out.join(mo.linear(v, [1.0] * 64, by).withColumnRenamed("estimate", "linear"), by)
    out = out.join(mo.largest(v, by).withColumnRenamed("estimate", "largest"), by).join(mo.exact_variance(v, by), by)
    return out.select("label", *[F.round(c, 5).alias(c) for c in ("naive", "linear", "largest", "variance")])


def _sketch_sql(width: int, depth: int) -> str:
    """The AMS sketch in whole-number SQL: the coefficients are the operator's, the arithmetic is not."""
    p = 2_147_483_647
    rows = " UNION ALL ".join(f"SELECT {d} AS d, {a}::HUGEINT AS a, {b}::HUGEINT AS b, {c}::HUGEINT AS c, {e}::HUGEINT AS e, {f}::HUGEINT AS f, {g}::HUGEINT AS g" for d, (a, b, c, e, f, g) in enumerate(mo._hashes(depth, 1)))
    return f"""WITH h AS ({rows}), x AS (SELECT label, i::HUGEINT AS i, sum(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2),
c AS (SELECT label, d, ((f * i + g) % {p}) % {width} AS w, CASE WHEN ((((a * i + b) % {p} * i + c) % {p} * i + e) % {p}) % 2 = 0 THEN v ELSE -v END AS v FROM x, h),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), s AS (SELECT c.label, d, w, sum(v) / max(n) AS v FROM c JOIN n ON n.label = c.label GROUP BY 1, 2, 3), r AS (SELECT label, d, sum(v * v) AS s FROM s GROUP BY 1, 2)
SELECT label, round(median(s), 5) AS norm2 FROM r GROUP BY 1"""


@R.add("g04_cells", _sketch_sql(64, 7))
def g04_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The squared norm of each group's mean from its sketch."""
    s = mo.sketched_norm(mo.ams_sketch(_vectors(spark, sf), ["label"], 64, 7), ["label"])
    return s.select("label", F.round("norm2", 5).alias("norm2"))


@R.add("g04_sketch", "WITH m AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) SELECT label, round(sum(v * v), 5) AS exact, true AS close FROM m GROUP BY 1")
def g04_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """The sketched squared norm of the mean against the exact one: within the sketch's error."""
    v = _vectors(spark, sf)
    s = mo.sketch_estimate(v, ["label"], width=512, depth=7)
    m = mo.mean_model(v, ["label"]).select("label", mo.square_norm(F.col("mean")).alias("exact"))
    return s.join(m, "label").select("label", F.round("exact", 5).alias("exact"), (F.abs(F.col("norm2") - F.col("exact")) <= 0.3 * F.col("exact")).alias("close"))


@R.add("g05_sync", f"SELECT label, round(avg({NORM}), 5) AS estimate, 64 AS weights FROM embeddings GROUP BY 1 HAVING avg({NORM}) > 0.5")
def g05_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that must synchronise, and the length of the model they go on with."""
    v = _vectors(spark, sf)
    return mo.synchronise(v, 0.5, mo.naive(v, ["label"]), ["label"]).select("label", F.round("estimate", 5).alias("estimate"), F.size("mean").alias("weights"))


@R.add("g06_ordered", "WITH p AS (SELECT vec_id, label, (row_number() OVER (ORDER BY CAST(label AS VARCHAR), vec_id) - 1) * 8 // (SELECT count(*) FROM embeddings) AS client FROM embeddings) SELECT client, label, count(*) AS n, min(vec_id) AS low, max(vec_id) AS high FROM p GROUP BY 1, 2")
def g06_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """Shards in the order of labels."""
    s = mo.label_ordered_shards(_vectors(spark, sf).select("id", "label"), "id", "label", 8)
    return s.groupBy("client", "label").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


@R.add("g06_shards")
def g06_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Shards by hash, and shards in the order of labels, side by side."""
    v = _vectors(spark, sf).select("id", "label")
    a = mo.shards(v, "id", "label", 8, 0.6).groupBy("client").agg(F.count("*").alias("rows"), F.countDistinct("label").alias("labels")).withColumn("kind", F.lit("biased"))
    b = mo.label_ordered_shards(v, "id", "label", 8).groupBy("client").agg(F.count("*").alias("rows"), F.countDistinct("label").alias("labels")).withColumn("kind", F.lit("ordered"))
    return a.unionByName(b)


EPOCHS = """e AS (SELECT o_custkey % 6 + 2 AS num_clients, CASE o_orderkey % 3 WHEN 0 THEN 'sketch' WHEN 1 THEN 'linear' ELSE 'naive' END AS fda_name, 62006 AS nn_num_weights, 250 AS sketch_width, 5 AS sketch_depth, o_orderkey % 100 AS epoch, o_orderkey % 50 AS total_rounds, o_orderkey % 400 AS total_fda_steps, o_totalprice / 500000 AS accuracy FROM orders)"""


def _epochs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select((F.col("o_custkey") % 6 + 2).alias("num_clients"), F.when(k % 3 == 0, "sketch").when(k % 3 == 1, "linear").otherwise("naive").alias("fda_name"), F.lit(62006).alias("nn_num_weights"), F.lit(250).alias("sketch_width"), F.lit(5).alias("sketch_depth"), (k % 100).alias("epoch"), (k % 50).alias("total_rounds"), (k % 400).alias("total_fda_steps"), (F.col("o_totalprice") / 500000).alias("accuracy"))


@R.add("g07_cost", f"WITH {EPOCHS} SELECT num_clients, fda_name, CAST(sum(8 * num_clients * nn_num_weights * total_rounds) AS BIGINT) AS sync_bytes, CAST(sum(4 * num_clients * CASE fda_name WHEN 'sketch' THEN 1251 WHEN 'linear' THEN 2 ELSE 1 END * total_fda_steps) AS BIGINT) AS monitor_bytes FROM e GROUP BY 1, 2")
def g07_cost(spark: SparkSession, sf: str) -> DataFrame:
    return mo.communication(_epochs(spark, sf)).groupBy("num_clients", "fda_name").agg(F.sum("sync_bytes").alias("sync_bytes"), F.sum("monitor_bytes").alias("monitor_bytes"))


@R.add("g08_first_reaching", f"WITH {EPOCHS} SELECT num_clients, fda_name, min(epoch) AS epoch FROM e WHERE accuracy >= 0.6 GROUP BY 1, 2")
def g08_first_reaching(spark: SparkSession, sf: str) -> DataFrame:
    return mo.first_reaching(_epochs(spark, sf), ["num_clients", "fda_name"], "epoch", "accuracy", 0.6).select("num_clients", "fda_name", "epoch")


@R.add("g09_grid", "SELECT c AS clients, t AS theta, f AS fda FROM (SELECT unnest([2::BIGINT, 4, 8]) AS c), (SELECT unnest([0.5::DOUBLE, 1.0]) AS t), (SELECT unnest(['naive', 'sketch']) AS f)")
def g09_grid(spark: SparkSession, sf: str) -> DataFrame:
    return mo.grid(spark, clients=[2, 4, 8], theta=[0.5, 1.0], fda=["naive", "sketch"])


# -- explanations --------------------------------------------------------------------------------


@R.add("h01_descriptor", "SELECT feature, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std FROM (SELECT 'l_quantity' AS feature, l_quantity::DOUBLE AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY 1")
def h01_descriptor(spark: SparkSession, sf: str) -> DataFrame:
    d = ex.describe_numeric(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return d.select("feature", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@R.add("h01_quartiles", "SELECT feature, quantile_disc(v, 0.5) AS median, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM (SELECT 'l_quantity' AS feature, l_quantity::DOUBLE AS v FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY 1")
def h01_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return ex.describe_numeric(table(spark, sf, "lineitem"), ["l_quantity", "l_linenumber", "l_discount"]).select("feature", "median", "q1", "q3")


@R.add("h01_categories", "SELECT 'l_returnflag' AS feature, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def h01_categories(spark: SparkSession, sf: str) -> DataFrame:
    return ex.describe_categories(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


def _encoder(spark: SparkSession, sf: str) -> tuple[ex.Encoder, DataFrame]:
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"), "l_discount", "l_returnflag", "l_linestatus")
    return ex.Encoder.fit(d, ["l_quantity", "l_discount"], ["l_returnflag", "l_linestatus"]), d


@R.add("h02_round_trip", "SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity, l_discount, l_returnflag, l_linestatus, l_quantity::DOUBLE AS x0, l_discount AS x1, " + ", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS x{k}" for k, (c, v) in enumerate([("l_linestatus", "F"), ("l_linestatus", "O"), ("l_returnflag", "A"), ("l_returnflag", "N"), ("l_returnflag", "R")], 2)) + " FROM lineitem")
def h02_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded, with every place of the code, and decoded again."""
    e, d = _encoder(spark, sf)
    x = e.encode(d).select("l_orderkey", "l_linenumber", "x")
    at = {n: k for k, n in enumerate(e.names())}
    order = ["l_quantity", "l_discount", "l_linestatus=F", "l_linestatus=O", "l_returnflag=A", "l_returnflag=N", "l_returnflag=R"]
    return e.decode(x).select("*", *[F.col("x")[at[n]].alias(f"x{k}") for k, n in enumerate(order)]).drop("x")


@R.add("h03_neighbourhood")
def h03_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    """Random neighbours in the ranges of the descriptor, balanced by a black box's class (H-03, H-11)."""
    s = {r["feature"]: (r["min"], r["max"]) for r in ex.describe_numeric(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]).collect()}
    n = ex.random_neighbourhood(spark, 5000, s, {"flag": ["A", "N", "R"]})
    n = n.withColumn("label", (F.col("l_quantity") > 30).cast("int"))
    n = ex.balanced(n, "label", "row")
    return ex.weighted_neighbourhood(n, "flag", {"A": {"A": 3.0, "N": 1.0}}, "row", "flag_next")


def _surrogate(spark: SparkSession, sf: str):  # noqa: ANN202
    low, high = np.array([1.0, 0.0]), np.array([50.0, 0.1])
    box = lambda z: ((z[:, 0] > 25) & (z[:, 1] < 0.05)).astype(int)
    x = np.array([30.0, 0.04])
    pop = np.vstack([ex.genetic_neighbourhood(x, box, low, high, same=s) for s in (True, False)])
    return x, ex.rules(ex.grow(pop, box(pop)), ["l_quantity", "l_discount"])


@R.add("h07_rules")
def h07_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Genetic neighbourhood, surrogate tree, its rules, the explanation and counterfactuals, and how
    many rows each rule covers (H-04, H-06 … H-09)."""
    x, rs = _surrogate(spark, sf)
    mine, others = ex.explain({"l_quantity": x[0], "l_discount": x[1]}, 1, rs)
    d = table(spark, sf, "lineitem")
    sums = d.agg(*[F.sum(ex.covered(r[0], F.col).cast("long")).alias(f"r{i}") for i, r in enumerate(rs)]).first()
    rows = [(i, " and ".join(f"{n} {o} {v:.3f}" for n, o, v in r[0]), r[1], "explains" if r == mine else "counterfactual" if r in others else "other", sums[f"r{i}"]) for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "rule int, premises string, label int, part string, covered long")


VAR = "(list_sum(list_transform({v}, lambda z: z * z)) / 64 - pow(list_sum({v}) / 64, 2))"


@R.add("h05_distances", f"""WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings), m AS (SELECT label, list(v ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS v FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT id, e.label, v, m, list_transform(range(1, 65), lambda i: v[i] - m[i]) AS r FROM e JOIN m ON m.label = e.label), x AS (SELECT id, label, 0.5 * {VAR.format(v='r')} / ({VAR.format(v='v')} + {VAR.format(v='m')} + 1e-7) AS d FROM d)
SELECT id, round(d, 5) AS d, round(0.7 * d + CASE WHEN label = 1 THEN 0 ELSE 0.3 END, 5) AS mixed, round(1 / (1 + exp(-10 * (d - 0.5))), 4) AS weight FROM x""")
def h05_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of every series to the mean of its class."""
    v = _vectors(spark, sf).withColumn("vec", F.col("vec").cast("array<double>"))
    m = mo.mean_model(v, ["label"])
    d = v.join(m, "label").withColumn("d", ex.normalised_euclid(F.col("vec"), F.col("mean")))
    return d.select("id", F.round("d", 5).alias("d"), F.round(ex.mixed_distance(F.col("d"), [F.col("label") == 1], 0.7), 5).alias("mixed"), F.round(ex.sigmoid(F.col("d")), 4).alias("weight"))


@R.add("h10_discretise")
def h10_discretise(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy cuts of two features and the means their bins take."""
    d = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") > 40000).cast("string").alias("big"))
    cuts = ex.discretise(d, ["l_quantity", "l_extendedprice"], "big", 128)
    b = ex.to_bins(d.withColumn("l_quantity", F.col("l_quantity").cast("double")), cuts)
    return b.groupBy(F.round("l_quantity", 3).alias("l_quantity"), F.round("l_extendedprice", 2).alias("l_extendedprice")).agg(F.count("*").alias("n"))
