"""Learning and forecasting queries (A-40 … A-67) with their SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import forecast as fc
from tidewell.operators.ordered import width_if_hot
from tidewell.operators.patterns import Stream, automaton
from tidewell.plans.pattern import Compiler, Spec, parse, rewrite
from tidewell.queries import Registry
from tidewell.session import table, written

R = Registry()
PATTERN = ';(IsEventTypePredicate("view"),*(IsEventTypePredicate("error")),IsEventTypePredicate("click")){partitionBy:userId}'
HORIZON = 40


@cache
def _model() -> tuple[Spec, list[list[int]], set[int]]:
    spec = parse(PATTERN)[0]
    return (spec, *Compiler(rewrite(spec.formula)).dfa())


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    s = Stream(table(spark, sf, "events"))
    return automaton(s, _model()[0], states_too=True)


def _positioned(spark: SparkSession, sf: str) -> DataFrame:
    # event ids rise with time, so they serve as positions of their user
    return _steps(spark, sf).withColumn("pos", F.col("event_id"))


def _w(spark: SparkSession, sf: str) -> int | None:
    """Blocks of a million positions if a user has too many events for one task."""
    return width_if_hot(table(spark, sf, "events"), ["user_id"], 1_000_000)


# the automaton of the pattern as a rule: state 0 nothing, 1 a view is open, 2 just matched
KNOWN = """st AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s2 AS (SELECT *, CASE WHEN event_type = 'view' THEN 'open' WHEN event_type = 'click' AND b = 'view' THEN 'match' WHEN event_type = 'error' AND b = 'view' THEN 'open' ELSE 'none' END AS nxt FROM st),
s3 AS (SELECT *, lag(nxt, 1, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM s2)"""


def _name(c: str):  # noqa: ANN202
    _, table_, finals = _model()
    opened = table_[0][1]
    return F.when(F.col(c).isin(*sorted(finals)), "match").when(F.col(c) == opened, "open").otherwise("none")


@R.add("a40_mle", f"WITH {KNOWN} SELECT was AS prev, nxt AS cur, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY was), 6) AS p FROM s3 GROUP BY 1, 2")
def a40_mle(spark: SparkSession, sf: str) -> DataFrame:
    """Transition matrix between the states of the pattern's automaton."""
    s = _steps(spark, sf).select(_name("state").alias("state"), _name("next_state").alias("next_state"))
    c = fc.transition_counts(s)
    return c.join(fc.transition_probabilities(c), ["prev", "cur"]).select("prev", "cur", "n", F.round("p", 6).alias("p"))


def _matrix(spark: SparkSession, sf: str):  # noqa: ANN202
    return fc.matrix(fc.transition_probabilities(fc.transition_counts(_steps(spark, sf))), len(_model()[1]))


@R.add("a42_waiting_times", f"""WITH RECURSIVE {KNOWN}, p AS (SELECT was, nxt, count(*) / sum(count(*)) OVER (PARTITION BY was) AS p FROM s3 GROUP BY 1, 2),
w(state, step, p) AS (SELECT was, 1, coalesce(sum(p) FILTER (WHERE nxt = 'match'), 0)::DOUBLE FROM p GROUP BY was UNION ALL SELECT * FROM (SELECT p.was, w.step + 1, sum(p.p * w.p)::DOUBLE FROM p JOIN w ON p.nxt = w.state AND p.nxt <> 'match' WHERE w.step < {HORIZON} GROUP BY p.was, w.step))
SELECT state, step, round(p, 6) AS p, CASE state WHEN 'open' THEN 1 ELSE 2 END AS distance, true AS consistent FROM w WHERE state <> 'match'""")
def a42_waiting_times(spark: SparkSession, sf: str) -> DataFrame:
    """Waiting-time distribution per state (A-42), with the check of the matrix (A-43) and the
    distance to a final state (A-64)."""
    m = _matrix(spark, sf)
    bad, dist = set(fc.inconsistent_states(m)), fc.distances(_model()[1], _model()[2])
    finals, opened = _model()[2], _model()[1][0][1]
    name = {q: "match" if q in finals else "open" if q == opened else "none" for q in range(len(_model()[1]))}
    rows = [(name[q], t + 1, round(float(p), 6), dist.get(q), q not in bad) for q, w in fc.waiting_times(m, finals, HORIZON).items() if q not in finals for t, p in enumerate(w)]
    return spark.createDataFrame(rows, "state string, step int, p double, distance int, consistent boolean")


@R.add("a44_contexts", """WITH x AS (SELECT user_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS s, ts, event_id FROM events),
l AS (SELECT s, lag(s) OVER w AS s1, lag(s, 2) OVER w AS s2 FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT CAST(s AS VARCHAR) AS word, count(*) AS n FROM l GROUP BY 1 UNION ALL SELECT s || '.' || s1, count(*) FROM l WHERE s1 IS NOT NULL GROUP BY 1 UNION ALL SELECT s || '.' || s1 || '.' || s2, count(*) FROM l WHERE s2 IS NOT NULL GROUP BY 1""")
def a44_contexts(spark: SparkSession, sf: str) -> DataFrame:
    w = _contexts(spark, sf, 3)
    return w.select(F.array_join(F.transform("word", lambda x: x.cast("string")), ".").alias("word"), "n")


SYMBOLS = ("view", "click", "purchase", "signup")


def _contexts(spark: SparkSession, sf: str, depth: int) -> DataFrame:
    e = table(spark, sf, "events")
    code = F.lit(4)
    for i, name in enumerate(SYMBOLS):
        code = F.when(F.col("event_type") == name, i).otherwise(code)
    s = Stream(e)
    return fc.context_counts(e.withColumn("sym", code), ["user_id"], "sym", ["ts", "event_id"], s.block(), depth)


@R.add("a45_suffix_tree")
def a45_suffix_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of the learnt tree with their distributions; ``variant`` is the two-sided test (A-45, A-46)."""
    # as many words as contexts of the given depth over 5 symbols, not as events
    counts = {tuple(r[0]): r[1] for r in _contexts(spark, sf, 3).toLocalIterator()}
    n = sum(v for k, v in counts.items() if len(k) == 1)
    rows = []
    for variant in (False, True):
        tree = fc.learn_suffix_tree(counts, n, 5, 2, two_sided=variant)
        rows += [("two-sided" if variant else "one-sided", ".".join(map(str, c)), s, float(p)) for c, d in sorted(tree.nodes.items()) for s, p in enumerate(d)]
    return spark.createDataFrame(rows, "variant string, context string, symbol int, p double")


@R.add("a48_tree_waiting")
def a48_tree_waiting(spark: SparkSession, sf: str) -> DataFrame:
    """Waiting times from the suffix tree, exhaustive and pruned (A-48)."""
    counts = {tuple(r[0]): r[1] for r in _contexts(spark, sf, 3).toLocalIterator()}
    tree = fc.learn_suffix_tree(counts, sum(v for k, v in counts.items() if len(k) == 1), 5, 2)
    spec, dfa, finals = _model()
    comp = Compiler(rewrite(spec.formula))
    kinds = [t.args[0] if isinstance(t.args[0], str) else t.args[0].name for t in comp.tests]
    masks = [sum(1 << i for i, k in enumerate(kinds) if k == s) for s in (*SYMBOLS, "error")]
    over = [[row[m] for m in masks] for row in dfa]
    rows = []
    for cutoff in (0.0, 0.001):
        for q in range(len(over)):
            if q not in finals:
                w = fc.tree_waiting_times(tree, [], q, over, finals, 8, 2, cutoff)
                rows += [(cutoff, q, t + 1, float(p)) for t, p in enumerate(w)]
    return spark.createDataFrame(rows, "cutoff double, state int, step int, p double")


@R.add("a50_remaining", f"""WITH {KNOWN}, h AS (SELECT nxt, was, k, user_id, min(CASE WHEN nxt = 'match' THEN event_id END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - event_id + 1 AS left_ FROM s3)
SELECT was AS state, round(avg(left_), 4) AS mean, round(stddev_samp(left_), 4) AS std, count(*) AS n FROM h WHERE left_ IS NOT NULL GROUP BY 1""")
def a50_remaining(spark: SparkSession, sf: str) -> DataFrame:
    s = _positioned(spark, sf).withColumn("state", _name("state"))
    return fc.mean_remaining(s, "pos", ["user_id"], width=_w(spark, sf)).select("state", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@R.add("a52_forecasts")
def a52_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Every way to turn a distribution into a forecast (A-52 … A-58), per state."""
    waits = fc.waiting_times(_matrix(spark, sf), _model()[2], HORIZON)
    dist = fc.distances(_model()[1], _model()[2])
    rows = []
    for q, w in waits.items():
        made = {
            "argmax": fc.argmax_forecast(w, 0.4, 30), "full scan": fc.shortest_forecast(w, 0.4), "smart scan": fc.two_pointer_forecast(w, 0.4),
            "fixed spread": fc.fixed_spread_forecast(w, 0.1, 5), "next k": fc.next_k_forecast(w, 0.3, 5), "window": fc.window_forecast(w, 0.3, dist.get(q, 1), 4),
        }
        rows += [(q, k, f.start, f.end, float(f.prob), float(f.middle), f.positive, fc.expected_value(w)) for k, f in made.items() if f]
    return spark.createDataFrame(rows, "state int, method string, f_start int, f_end int, p double, middle double, positive boolean, expected double")


def _forecasts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    steps = _steps(spark, sf)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = written(steps.withColumn("pos", F.row_number().over(w)))
    m = fc.matrix(fc.transition_probabilities(fc.transition_counts(steps)), len(_model()[1]))
    waits = fc.waiting_times(m, _model()[2], HORIZON)
    t = fc.forecast_table(spark, waits, lambda q, x: fc.shortest_forecast(x, 0.3), _model()[2])
    return fc.emit_forecasts(steps, t, "pos"), steps.filter("detected")


@R.add("a61_evaluation")
def a61_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts at run time (A-59) against later detections (A-61): counts and measures (A-60)."""
    f, d = _forecasts(spark, sf)
    hits = fc.forecast_hits(f, d, ["user_id"], width=_w(spark, sf))
    return fc.classification_metrics(fc.confusion(hits, F.col("f_positive"), F.col("hit")))


@R.add("a62_regression")
def a62_regression(spark: SparkSession, sf: str) -> DataFrame:
    f, d = _forecasts(spark, sf)
    return fc.regression_metrics(fc.forecast_hits(f, d, ["user_id"], width=_w(spark, sf)), 0.3, ["next_state"])


METRICS = """round(CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE -1 END, 6) AS precision, round(CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE -1 END, 6) AS recall,
round(CASE WHEN tn+fp > 0 THEN tn/(tn+fp) ELSE -1 END, 6) AS specificity, round(CASE WHEN tp+fp+fn+tn > 0 THEN (tp+tn)/(tp+fp+fn+tn) ELSE -1 END, 6) AS accuracy,
round(CASE WHEN tp+fp > 0 AND tp+fn > 0 AND tn+fp > 0 AND tn+fn > 0 THEN sqrt(tp/(tp+fp) * tp/(tp+fn) * tn/(tn+fp) * tn/(tn+fn)) - sqrt((1-tp/(tp+fp)) * (1-tp/(tp+fn)) * (1-tn/(tn+fp)) * (1-tn/(tn+fn))) ELSE 0 END, 6) AS mcc"""


@R.add("a60_metrics", f"""WITH c AS (SELECT rater_id, sum(CASE WHEN abusive = 1 AND hateful = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN abusive = 1 AND hateful <> 1 THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN abusive <> 1 AND hateful = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN abusive <> 1 AND hateful <> 1 THEN 1 ELSE 0 END)::DOUBLE AS tn
FROM review_labels WHERE abusive IS NOT NULL AND hateful IS NOT NULL GROUP BY 1) SELECT rater_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {METRICS} FROM c""")
def a60_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The measures on given labels: one verdict taken as a forecast of another."""
    c = fc.confusion(table(spark, sf, "review_labels"), F.col("abusive") == 1, F.col("hateful") == 1, ["rater_id"])
    m = fc.classification_metrics(c)
    return m.select("rater_id", "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "specificity", "accuracy", "mcc")])


@R.add("a63_log_loss")
def a63_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Mean log loss of the order-m models, over all events, from word counts alone (A-51, A-63)."""
    counts = {tuple(r[0]): r[1] for r in _contexts(spark, sf, 4).toLocalIterator()}
    n = sum(v for k, v in counts.items() if len(k) == 1)
    import numpy as np

    rows = []
    for m in (0, 1, 2, 3):
        tree = fc.learn_suffix_tree(counts, n, 5, m, ratio=1.0)
        words = {w: c for w, c in counts.items() if len(w) == m + 1}
        loss = sum(-c * np.log2(tree.predict(list(reversed(w[1:])))[w[0]]) for w, c in words.items()) / max(sum(words.values()), 1)
        rows.append((m, len(tree.nodes), float(loss)))
    return spark.createDataFrame(rows, "model_order int, contexts int, loss double")


WORDS = """x AS (SELECT user_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS s, ts, event_id FROM events),
l AS (SELECT user_id % 4 AS fold, s, lag(s) OVER w AS s1, lag(s, 2) OVER w AS s2 FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
w AS (SELECT fold, 0 AS m, '' AS c, s, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT fold, 1, CAST(s1 AS VARCHAR), s, count(*) FROM l WHERE s1 IS NOT NULL GROUP BY ALL UNION ALL SELECT fold, 2, s1 || '.' || s2, s, count(*) FROM l WHERE s2 IS NOT NULL GROUP BY ALL)"""


def _fold_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of up to three symbols per fold; a fold holds a quarter of the users."""
    e = table(spark, sf, "events")
    code = F.lit(4)
    for i, name in enumerate(SYMBOLS):
        code = F.when(F.col("event_type") == name, i).otherwise(code)
    out = None
    for k in range(4):
        part = e.filter(F.col("user_id") % 4 == k)
        d = fc.context_counts(part.withColumn("sym", code), ["user_id"], "sym", ["ts", "event_id"], Stream(part).block(), 3).withColumn("fold", F.lit(k))
        out = d if out is None else out.unionByName(d)
    return out


@R.add("a51_order", f"""WITH {WORDS}, p AS (SELECT *, (sum(n) OVER (PARTITION BY m, c, s) - n + 1) / (sum(n) OVER (PARTITION BY m, c) - sum(n) OVER (PARTITION BY m, c, fold) + 5) AS p FROM w),
o AS (SELECT m, sum(-log2(p) * n) / sum(n) AS loss, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1) SELECT m AS "order", round(loss, 6) AS loss, n, row_number() OVER (ORDER BY round(loss, 9), m) = 1 AS best FROM o""")
def a51_order(spark: SparkSession, sf: str) -> DataFrame:
    """The order of the model by cross-validation (A-51)."""
    return fc.order_losses(_fold_words(spark, sf), 5).withColumn("loss", F.round("loss", 6))


@R.add("a63_next_symbol", f"""WITH {WORDS}, t AS (SELECT m, c, s, sum(n) AS n FROM w GROUP BY ALL), b AS (SELECT m, c, max(n) AS hit, sum(n) AS n FROM t GROUP BY ALL) SELECT m AS "order", count(*) AS contexts, round(sum(hit) / sum(n), 6) AS accuracy FROM b GROUP BY 1""")
def a63_next_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """How well the next symbol is foreseen (A-63)."""
    return fc.next_symbol_accuracy(_fold_words(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@R.add("a41_disambiguated", f"WITH {KNOWN} SELECT nxt AS state, event_type AS last, count(*) AS n FROM s3 GROUP BY 1, 2")
def a41_disambiguated(spark: SparkSession, sf: str) -> DataFrame:
    """Visits of the states that also hold the last symbol (A-41); a state that the disambiguated
    automaton does not have would be missing."""
    spec, dfa, finals = _model()
    comp = Compiler(rewrite(spec.formula))
    kinds = [t.args[0] if isinstance(t.args[0], str) else t.args[0].name for t in comp.tests]
    names = (*SYMBOLS, "error")
    masks = [sum(1 << i for i, k in enumerate(kinds) if k == s) for s in names]
    labels = fc.disambiguate([[row[m] for m in masks] for row in dfa], finals, 1)[2]
    opened = dfa[0][1]
    known = spark.createDataFrame(sorted({("match" if q in finals else "open" if q == opened else "none", names[r[-1]]) for q, r in labels if r}), "state string, last string")
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("last"))
    steps = _steps(spark, sf).select("event_id", _name("next_state").alias("state")).join(e, "event_id")
    return steps.groupBy("state", "last").agg(F.count("*").alias("n")).join(known, ["state", "last"])


@R.add("a66_baselines")
def a66_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """Baselines: a seeded random forecaster and one that always expects the next event (A-66)."""
    f, d = _forecasts(spark, sf)
    rnd = f.withColumn("f_positive", F.pmod(F.xxhash64(F.lit(7), "event_id"), F.lit(100)) < 30)
    nxt = f.withColumns({"from_pos": F.col("pos") + 1, "to_pos": F.col("pos") + 1, "f_positive": F.lit(True)})
    out = None
    for name, x in (("random", rnd), ("next", nxt)):
        m = fc.classification_metrics(fc.confusion(fc.forecast_hits(x, d, ["user_id"], width=_w(spark, sf)), F.col("f_positive"), F.col("hit"))).withColumn("baseline", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out
