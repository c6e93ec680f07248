"""Run-time adaptation of models: buckets of a stream, training sets, score trends, commands."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.forecast import classification_metrics

# -- buckets -------------------------------------------------------------------------------------


def bucket_starts(events: DataFrame, t: str, size: int) -> list[int]:
    """Starts of buckets: the first record opens one, and so does every record more than ``size``
    after the start of its bucket.

    The chain of starts is sequential, but as long as the time range over the size only. Cells of a
    64th of the size are summed up once (their number is bounded by the time range, not by the
    records); a start that falls inside a cell is looked up in that cell alone.
    """
    cell = max(1, size // 64)
    e = events.select(F.col(t).cast("long").alias("t")).filter("t IS NOT NULL")
    cells = {r[0]: (r[1], r[2]) for r in e.groupBy(F.floor(F.col("t") / F.lit(cell)).alias("c")).agg(F.min("t"), F.max("t")).sort("c").toLocalIterator()}
    if not cells:
        return []
    order = sorted(cells)
    out = [cells[order[0]][0]]
    at = 0
    while True:
        x = out[-1] + size
        while at < len(order) and cells[order[at]][1] <= x:
            at += 1
        if at == len(order):
            return out
        low, high = cells[order[at]]
        out.append(low if low > x else e.filter((F.col("t") > x) & (F.col("t") <= high)).agg(F.min("t")).first()[0])


def with_bucket(events: DataFrame, t: str, starts: list[int], out: str = "bucket") -> DataFrame:
    """The bucket number of each record; null before the first.

    The starts stand in a small table, each under the cells of the axis that its bucket touches up to
    the next start; a record meets the starts of its own cell by an equality join, so the work does
    not grow with their number.
    """
    if not starts:
        return events.withColumn(out, F.lit(None).cast("int"))
    spark = events.sparkSession
    table = spark.createDataFrame([(i, s, starts[i + 1] if i + 1 < len(starts) else 2**63 - 1) for i, s in enumerate(starts)], "__b int, __s long, __e long")
    gaps = sorted(b - a for a, b in zip(starts, starts[1:], strict=False))
    cell = max(gaps[len(gaps) // 2] if gaps else 1, (starts[-1] - starts[0]) // (8 * len(starts)), 1)
    # from the last start on every cell is the same, so one number stands for all of them
    top = starts[-1] // cell
    at = lambda c: F.least(F.floor(c / F.lit(cell)).cast("long"), F.lit(top))
    cells = table.withColumn("__c", F.explode(F.sequence(at(F.col("__s")), at(F.col("__e") - 1))))
    d = events.withColumn("__c", at(F.col(t).cast("long")))
    on = (F.col("l.__c") == F.col("r.__c")) & (F.col(f"l.`{t}`") >= F.col("r.__s")) & (F.col(f"l.`{t}`") < F.col("r.__e"))
    return d.alias("l").join(cells.alias("r"), on, "left").select(*[F.col(f"l.`{c}`") for c in events.columns if c != out], F.col("r.__b").alias(out))


def bucket_summary(bucketed: DataFrame, t: str, bucket: str = "bucket") -> DataFrame:
    """Per bucket: first and last time and number of records."""
    return bucketed.filter(F.col(bucket).isNotNull()).groupBy(bucket).agg(F.min(t).alias("ts"), F.max(t).alias("te"), F.count("*").alias("records"))


def last_k_datasets(buckets: DataFrame, k: int, bucket: str = "bucket") -> DataFrame:
    """Per bucket, the training set of it and the k-1 before: ``first`` and ``last`` bucket."""
    return buckets.select(bucket, F.greatest(F.col(bucket) - (k - 1), F.lit(0)).alias("first"), F.col(bucket).alias("last"))


def score_buckets(scores: DataFrame, buckets: DataFrame, t: str = "timestamp", bucket: str = "bucket") -> DataFrame:
    """Scores with the bucket in whose range (both ends included) they lie; others are left out.
    Buckets are disjoint ranges, so this is one as-of lookup."""
    from tidewell.operators.intervals import lookup

    b = buckets.select(F.lit(0).alias("__k"), F.col("ts").alias("start"), (F.col("te") + 1).alias("end"), bucket)
    hit = lookup(scores.withColumn("__k", F.lit(0)), b, ["__k"], t, carry=[bucket], width=10**9)
    return hit.filter(F.col(t) < F.col("hold_end")).drop("hold_start", "hold_end", "__k")


def score_based_dataset(buckets: DataFrame, k: int, bucket: str = "bucket", score: str = "mcc") -> DataFrame:
    """The newest k/2 buckets and, of the older ones, the k/2 with the best score; a missing score is
    0, equal scores go to the newer bucket."""
    half = k // 2
    newest = buckets.orderBy(F.desc(bucket)).limit(k - half)
    older = buckets.join(newest.select(bucket), bucket, "left_anti")
    best = older.orderBy(F.desc(F.coalesce(score, F.lit(0.0))), F.desc(bucket)).limit(half)
    return newest.withColumn("why", F.lit("newest")).unionByName(best.withColumn("why", F.lit("best")))


def assemble(events: DataFrame, versions: DataFrame, bucket: str = "bucket", t: str = "timestamp") -> DataFrame:
    """Per dataset version with a range of buckets (``buckets_range``: first and last): records and
    the first and last time. Buckets are summed up before versions meet them, so overlapping
    versions do not read the records again. Versions without a range are left out."""
    per = events.filter(F.col(bucket).isNotNull()).groupBy(bucket).agg(F.count("*").alias("n"), F.min(t).alias("a"), F.max(t).alias("b"))
    v = versions.filter("buckets_range IS NOT NULL AND size(buckets_range) > 0").withColumn(bucket, F.explode(F.sequence(F.element_at("buckets_range", 1), F.element_at("buckets_range", -1))))
    return v.join(per, bucket).groupBy("version").agg(F.sum("n").alias("records"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"), F.count("*").alias("buckets"))


# -- scores and policy ---------------------------------------------------------------------------


def readable_scores(scores: DataFrame) -> DataFrame:
    """Parsed score messages, each once: timestamp, model_version, method (trimmed, lower case), batch
    and run-time mcc and the counts. A cut-off or missing JSON gives nulls."""
    schema = "mcc double, tp long, fp long, fn long, tn long"
    b, r = F.from_json("batch_metrics", schema), F.from_json("runtime_metrics", schema)
    method = F.lower(F.trim("creation_method"))
    return scores.distinct().select("timestamp", "model_version", method.alias("method"), b["mcc"].alias("batch_mcc"), r["mcc"].alias("mcc"), *[b[c].alias(c) for c in ("tp", "fp", "fn", "tn")])


def trends(scores: DataFrame, k: int, keys: list[str], t: str = "timestamp", score: str = "mcc") -> DataFrame:
    """Adds ``slope``, the least-squares slope of the last k scores over their index, and ``change``
    against the previous score. Scores are one per report, not one per event, so a key's are few."""
    w = Window.partitionBy(*keys).orderBy(t, score)
    last = w.rowsBetween(-(k - 1), 0)
    d = scores.filter(F.col(score).isNotNull()).withColumn("__i", F.row_number().over(w).cast("double"))
    d = d.withColumns({"slope": F.when(F.count("*").over(last) >= 2, F.regr_slope(F.col(score), F.col("__i")).over(last)), "change": F.col(score) - F.lag(score).over(w)})
    return d.drop("__i")


@dataclass
class Policy:
    """kind: difference, regression or hybrid. A fall beyond ``max_fall`` asks for training, unless
    the last training is at most ``grace`` reports ago: then it asks for optimisation; a score below
    ``low`` asks for optimisation at once."""

    kind: str = "hybrid"
    k: int = 3
    max_fall: float = 0.05
    low: float = 0.2
    grace: int = 2

    def decide(self, rows: list[tuple[float, float | None, float | None]]) -> list[str]:
        out, since = [], self.grace + 1
        for score, slope, change in rows:
            falls = {"difference": change is not None and change < -self.max_fall, "regression": slope is not None and slope < -self.max_fall}
            falls["hybrid"] = falls["difference"] or falls["regression"]
            since += 1
            if score < self.low:
                out.append("optimise")
            elif falls[self.kind]:
                out.append("optimise" if since <= self.grace else "train")
            else:
                out.append("none")
                continue
            since = 0
        return out


def instructions(scored: DataFrame, policy: Policy, keys: list[str], t: str = "timestamp", score: str = "mcc") -> DataFrame:
    """The policy's instruction for every report of a key. The grace period is a small state machine,
    so a key's reports stream through it in order."""
    d = trends(scored, policy.k, keys, t, score).select(*keys, t, F.col(score).alias("score"), "slope", "change")
    types = dict(d.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []

        def flush() -> pd.DataFrame:
            what = policy.decide([tuple(None if pd.isna(x) else x for x in r[-3:]) for r in rows])
            return pd.DataFrame([(*r[:-2], w) for r, w in zip(rows, what, strict=True)], columns=[*keys, t, "score", "instruction"])

        for b in batches:
            for r in b.itertuples(index=False, name=None):
                k = tuple(None if pd.isna(x) else x for x in r[: len(keys)])
                if k != key:
                    if rows:
                        yield flush()
                    key, rows = k, []
                rows.append(r)
        if rows:
            yield flush()

    ddl = ", ".join(f"`{c}` {types[c]}" for c in [*keys, t]) + ", score double, instruction string"
    return d.repartition(*keys).sortWithinPartitions(*keys, t, "score").mapInPandas(run, ddl)


def objective(mcc: Column, x: Column, x_max: float, w0: float = 0.5, w1: float = 0.5) -> Column:
    """-(w0·mcc - w1·tanh(x/x_max - 1)): small models with good scores are best."""
    return -(F.lit(w0) * mcc - F.lit(w1) * F.tanh(x / x_max - 1))


def improvement(base: DataFrame, other: DataFrame, on: str, score: str) -> DataFrame:
    """Percent gain of other over base; the divisor is at least 0.05."""
    b, o = base.select(on, F.col(score).alias("base")), other.select(on, F.col(score).alias("other"))
    return b.join(o, on).withColumn("percent", 100 * (F.col("other") - F.col("base")) / F.greatest(F.abs("base"), F.lit(0.05)))


def scores_from_counts(scores: DataFrame) -> DataFrame:
    """The counts of a report turned into the measures of classification."""
    return classification_metrics(scores.filter("tp IS NOT NULL AND fp IS NOT NULL AND fn IS NOT NULL AND tn IS NOT NULL"))


# -- commands and search -------------------------------------------------------------------------


@dataclass
class Search:
    """Ask/tell search over a box of parameters: random proposals around kept evaluations. ``keep``
    bounds the evaluations carried into the next round: the best are kept, or with keep_random any."""

    low: list[float]
    high: list[float]
    seed: int = 1
    keep: int = 5
    keep_random: bool = False
    seen: list[tuple[list[float], float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rng = random.Random(self.seed)

    def ask(self) -> list[float]:
        if len(self.seen) < 3 or self.rng.random() < 0.3:
            return [self.rng.uniform(a, b) for a, b in zip(self.low, self.high, strict=True)]
        best = min(self.seen, key=lambda s: s[1])[0]
        return [min(b, max(a, x + self.rng.gauss(0, (b - a) / 10))) for x, a, b in zip(best, self.low, self.high, strict=True)]

    def tell(self, x: list[float], y: float) -> None:
        self.seen.append((x, y))

    def next_round(self) -> None:
        kept = self.rng.sample(self.seen, min(self.keep, len(self.seen))) if self.keep_random else sorted(self.seen, key=lambda s: s[1])[: self.keep]
        self.seen = kept


class BayesSearch:
    """Ask/tell minimisation over a box by a Gaussian process with expected improvement.

    The first ``initial`` proposals are random; after that the candidate with the largest expected
    improvement is asked for. ``keep`` bounds the evaluations carried into the next round: the oldest
    are removed first, with ``removal="random"`` any, with ``"worst"`` the worst; the best one stays.
    Evaluations are few by nature, so the model is solved on the driver.
    """

    def __init__(self, low: list[float], high: list[float], *, initial: int = 10, keep: int = 5, removal: str = "oldest", seed: int = 1, candidates: int = 2_000) -> None:
        if removal not in ("oldest", "random", "worst"):
            raise ValueError("removal is oldest, random or worst")
        self.low, self.high = np.array(low, float), np.array(high, float)
        self.initial, self.keep, self.removal, self.candidates = initial, keep, removal, candidates
        self.rng = np.random.default_rng(seed)
        self.seen: list[tuple[list[float], float]] = []
        self.asked = 0

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) / np.maximum(self.high - self.low, 1e-12)

    def ask(self) -> list[float]:
        self.asked += 1
        c = self.rng.random((self.candidates, len(self.low)))
        if self.asked <= self.initial or len(self.seen) < 2:
            return (self.low + c[0] * (self.high - self.low)).tolist()
        x = self._unit(np.array([s[0] for s in self.seen]))
        y = np.array([s[1] for s in self.seen])
        mean, std = y.mean(), y.std() or 1.0
        y = (y - mean) / std
        best = x[int(np.argmin(y))]
        c[: self.candidates // 4] = np.clip(best + self.rng.normal(size=(self.candidates // 4, len(best))) * 0.05, 0, 1)
        k = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(2) / 0.2**2)
        inner = np.linalg.cholesky(k(x, x) + 1e-6 * np.eye(len(x)))
        cross = np.linalg.solve(inner, k(x, c))
        mu = cross.T @ np.linalg.solve(inner, y)
        sd = np.sqrt(np.maximum(1 - (cross**2).sum(0), 1e-12))
        z = (y.min() - mu) / sd
        phi, cdf = np.exp(-0.5 * z**2) / math.sqrt(2 * math.pi), np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
        return (self.low + c[int(np.argmax(sd * (z * cdf + phi)))] * (self.high - self.low)).tolist()

    def tell(self, x: list[float], y: float) -> None:
        self.seen.append((list(x), float(y)))

    def next_round(self) -> None:
        """Remove evaluations down to ``keep``; the next round starts with random proposals again."""
        self.asked = 0
        while len(self.seen) > self.keep:
            best = int(np.argmin([s[1] for s in self.seen]))
            others = [i for i in range(len(self.seen)) if i != best]
            if not others:
                break
            i = others[0] if self.removal == "oldest" else int(self.rng.choice(others)) if self.removal == "random" else max(others, key=lambda i: self.seen[i][1])
            del self.seen[i]


def command_log(instruction: str, evaluate, search: Search | BayesSearch, rounds: int, start_id: int = 0) -> list[dict]:  # noqa: ANN001
    """Commands that an instruction leads to: one train, or opt_initialise, opt_step … and
    opt_finalise with the number of the best evaluation."""
    if instruction == "train":
        return [{"id": start_id, "type": "train", "params": "{}", "best_i": -1}]
    if instruction != "optimise":
        return []
    out = [{"id": start_id, "type": "opt_initialise", "params": "{}", "best_i": -1}]
    best, best_i = math.inf, -1
    for i in range(rounds):
        x = search.ask()
        y = evaluate(x)
        search.tell(x, y)
        if y < best:
            best, best_i = y, i
        out.append({"id": start_id + 1 + i, "type": "opt_step", "params": json.dumps(x), "best_i": best_i})
    return [*out, {"id": start_id + 1 + rounds, "type": "opt_finalise", "params": "{}", "best_i": best_i}]
