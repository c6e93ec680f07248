"""Learning from event streams and forecasting the completion of patterns.

Counts over events are DataFrame aggregations; the models themselves (chains over automaton states,
suffix trees over symbols) are small and are solved with numpy on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- chains over automaton states ----------------------------------------------------------------


def transition_counts(steps: DataFrame, prev: str = "state", cur: str = "next_state") -> DataFrame:
    """prev, cur, n: steps between states; null states (resets) are skipped."""
    return steps.filter(F.col(prev).isNotNull() & F.col(cur).isNotNull()).groupBy(F.col(prev).alias("prev"), F.col(cur).alias("cur")).agg(F.count("*").alias("n"))


def transition_probabilities(counts: DataFrame) -> DataFrame:
    """Maximum likelihood estimates; states never left have no row (a zero row of the matrix)."""
    total = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    return counts.join(total, "prev").select("prev", "cur", (F.col("n") / F.col("total")).alias("p"))


def matrix(probabilities: DataFrame, states: int) -> np.ndarray:
    """The transition matrix; as large as the automaton, not as the data."""
    m = np.zeros((states, states))
    for r in probabilities.select("prev", "cur", "p").toLocalIterator():
        m[r[0], r[1]] = r[2]
    return m


def inconsistent_states(m: np.ndarray, tolerance: float = 0.05) -> list[int]:
    """States whose row neither sums to 1 nor is an unreachable zero row."""
    rows = m.sum(axis=1)
    reachable = m.sum(axis=0) - np.diag(m) > 0
    return [int(i) for i in range(len(m)) if abs(rows[i] - 1) > tolerance and not (rows[i] == 0 and not reachable[i])]


def waiting_times(m: np.ndarray, finals: set[int], horizon: int) -> dict[int, np.ndarray]:
    """Per state, the probability that a final state is first reached after h = 1..horizon steps.

    From a final state the first step leaves it by its own row. A state whose distribution is all
    zero has none and is left out; negative rounding errors become 0.
    """
    n = len(m)
    inner = [i for i in range(n) if i not in finals]
    to_final = m[:, sorted(finals)].sum(axis=1)
    stay = m[np.ix_(inner, inner)]
    out = np.zeros((n, horizon))
    out[:, 0] = to_final
    reach = to_final[inner]
    for h in range(1, horizon):
        out[:, h] = m[:, inner] @ reach
        reach = stay @ reach
    out = np.maximum(out, 0)
    return {i: out[i] for i in range(n) if out[i].any()}


def mean_remaining(steps: DataFrame, order: str, keys: list[str], state: str = "state", detected: str = "detected", width: int | None = None) -> DataFrame:
    """Per state: mean and standard deviation of the steps until the next detection.

    The next detection's position is looked up backwards in order; events after the last detection
    of their key have none and are left out. ``order`` is the position inside the key; ``width`` splits
    hot keys, see ``ordered``.
    """
    from tidewell.operators.ordered import last_known

    d = steps.withColumn("__hit", F.when(F.col(detected), F.col(order))).withColumn("__back", -F.col(order))
    d = last_known(d, keys, ["__back"], "__hit", "__next", width, include=True).filter("__next IS NOT NULL")
    left = (F.col("__next") - F.col(order) + 1).cast("double")
    return d.groupBy(state).agg(F.avg(left).alias("mean"), F.stddev_samp(left).alias("std"), F.count("*").alias("n"))


def gaussian_waiting(mean: float, std: float, horizon: int) -> np.ndarray:
    """Gaussian mass around each step; a zero deviation puts all mass on the nearest step."""
    from math import erf, sqrt

    if not std:
        return np.array([1.0 if round(mean) == t else 0.0 for t in range(1, horizon + 1)])
    cdf = [0.5 * (1 + erf((t - 0.5 - mean) / (std * sqrt(2)))) for t in range(1, horizon + 2)]
    return np.diff(cdf)


def distances(table: list[list[int]], finals: set[int]) -> dict[int, int]:
    """Fewest steps from each state to a final one (1 or more)."""
    back: dict[int, set[int]] = {}
    for q, row in enumerate(table):
        for r in row:
            back.setdefault(r, set()).add(q)
    out, level, d = {}, set(finals), 0
    while level:
        d += 1
        level = {q for r in level for q in back.get(r, ())} - set(out)
        out |= dict.fromkeys(level, d)
    return out


# -- contexts of symbols -------------------------------------------------------------------------


def context_counts(events: DataFrame, keys: list[str], symbol: str, order: list[str], block: Column, depth: int, chunk: int = 100_000) -> DataFrame:
    """How often every word of up to ``depth`` symbols ends at an event: ``word`` (newest symbol
    first) and ``n``. Words do not reach over keys. A hot key is cut into overlapping chunks."""
    from pyspark.sql import Window

    from tidewell.operators.patterns import _key
    from tidewell.operators.skew import overlapped

    d = events.select(_key(keys).alias("__key"), F.col(symbol).cast("int").alias("__s"), *order, block.alias("__blk")).filter("__s IS NOT NULL")
    d = overlapped(d, "__key", order, F.col("__blk"), depth - 1, chunk)
    w = Window.partitionBy("__bucket", "__chunk", "__key").orderBy("__pos")
    # an event is the oldest symbol of the words that begin at it; the newest lies k steps ahead
    words = [F.when(F.lead("__s", k).over(w).isNotNull() if k else F.lit(True), F.array(*[F.lead("__s", j).over(w) if j else F.col("__s") for j in range(k, -1, -1)])) for k in range(depth)]
    d = d.withColumn("__w", F.array(*words)).filter("__own")
    return d.select(F.explode("__w").alias("word")).filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))


@dataclass
class SuffixTree:
    """A prediction suffix tree: contexts (newest symbol first) with next-symbol distributions."""

    nodes: dict[tuple[int, ...], np.ndarray]

    def predict(self, recent: list[int]) -> np.ndarray:
        """Distribution of the next symbol after ``recent`` (newest last): the longest known context."""
        ctx = tuple(reversed(recent))
        for k in range(len(ctx), -1, -1):
            if ctx[:k] in self.nodes:
                return self.nodes[ctx[:k]]
        raise KeyError("the tree has no root")

    def log_loss(self, symbols: list[int], order: int) -> float:
        """Mean of -log2 p over a sequence."""
        loss = [-np.log2(self.predict(symbols[max(0, i - order) : i])[s]) for i, s in enumerate(symbols)]
        return float(np.mean(loss)) if loss else 0.0


def learn_suffix_tree(counts: dict[tuple[int, ...], int], events: int, symbols: int, order: int, p_min: float = 0.001, alpha: float = 0.0, gamma: float = 0.001, ratio: float = 1.05, two_sided: bool = False) -> SuffixTree:
    """From word counts (newest first). A context c is a candidate while P(c) >= p_min; it is added if
    some symbol has P(s|c) >= (1+alpha)*gamma and its probability differs from the shorter context's
    by more than the ratio (two_sided: also if it is smaller by the ratio). Suffixes of an added
    context are added too. Distributions are smoothed towards gamma."""

    def after(c: tuple[int, ...]) -> np.ndarray:
        seen = np.array([counts.get((s, *c), 0) for s in range(symbols)], float)
        return seen / seen.sum() if seen.sum() else np.full(symbols, 1 / symbols)

    def likely(c: tuple[int, ...]) -> bool:
        return counts.get(c, 0) / max(events - len(c) + 1, 1) >= p_min

    keep = {()}
    todo = [(s,) for s in range(symbols) if likely((s,))]
    while todo:
        c = todo.pop(0)
        here, parent = after(c), after(c[:-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(parent > 0, here / parent, np.inf)
        differs = (r >= ratio) | (r <= 1 / ratio) if two_sided else r > ratio
        if ((here >= (1 + alpha) * gamma) & differs).any():
            keep |= {c[:k] for k in range(len(c) + 1)}
        if len(c) < order:
            todo += [(*c, s) for s in range(symbols) if likely((*c, s))]
    return SuffixTree({c: (1 - symbols * gamma) * after(c) + gamma for c in keep})


def tree_waiting_times(tree: SuffixTree, recent: list[int], state: int, table: list[list[int]], finals: set[int], horizon: int, order: int, cutoff: float = 0.0) -> np.ndarray:
    """Waiting-time distribution from a suffix tree and an automaton over symbols: sequences are
    expanded breadth first; those that become less likely than ``cutoff`` are dropped."""
    out = np.zeros(horizon)
    level: dict[tuple[tuple[int, ...], int], float] = {(tuple(recent[-order:]) if order else (), state): 1.0}
    for h in range(horizon):
        nxt: dict[tuple[tuple[int, ...], int], float] = {}
        for (ctx, q), p in level.items():
            for s, ps in enumerate(tree.predict(list(ctx))):
                mass, r = p * ps, table[q][s]
                if r in finals:
                    out[h] += mass
                elif mass > cutoff:
                    key = ((*ctx, s)[-order:] if order else (), r)
                    nxt[key] = nxt.get(key, 0.0) + mass
        level = nxt
    return out


# -- forecasts from a waiting-time distribution --------------------------------------------------


@dataclass(frozen=True)
class Forecast:
    start: int
    end: int
    prob: float
    middle: float = -1.0
    positive: bool = True


def conditional_expectation(wt: np.ndarray, start: int, end: int) -> float:
    """Expected step given that it lies in [start, end]."""
    t = np.arange(max(start, 1), min(end, len(wt)) + 1)
    p = wt[t - 1] if len(t) else np.zeros(0)
    return float((t * p).sum() / p.sum()) if p.sum() else -1.0


def argmax_forecast(wt: np.ndarray, theta: float, max_spread: int) -> Forecast | None:
    """Grow an interval around the mode until it holds theta; none if it gets wider than allowed."""
    mode = int(np.argmax(wt))
    a = b = mode
    p = float(wt[mode])
    while p < theta and (a > 0 or b < len(wt) - 1):
        if a > 0:
            a -= 1
            p += float(wt[a])
        if b < len(wt) - 1:
            b += 1
            p += float(wt[b])
    return Forecast(a + 1, b + 1, p, mode + 1) if b - a <= max_spread else None


def shortest_forecast(wt: np.ndarray, theta: float, max_spread: int | None = None) -> Forecast | None:
    """The shortest interval that holds theta; of equally short ones the most probable, then the first."""
    cum = np.concatenate([[0.0], np.cumsum(wt)])
    for spread in range(len(wt)):
        if max_spread is not None and spread > max_spread:
            return None
        p = cum[spread + 1 :] - cum[: len(wt) - spread]
        k = int(np.argmax(p))
        if p[k] >= theta:
            return Forecast(k + 1, k + 1 + spread, float(p[k]), conditional_expectation(wt, k + 1, k + 1 + spread))
    return None


def two_pointer_forecast(wt: np.ndarray, theta: float) -> Forecast | None:
    """The same interval by one pass of two pointers."""
    best, a, p = None, 0, 0.0
    for b in range(len(wt)):
        p += wt[b]
        while a < b and p - wt[a] >= theta:
            p -= wt[a]
            a += 1
        if p >= theta and (best is None or (b - a, -p) < (best[1] - best[0], -best[2])):
            best = (a, b, p)
    return Forecast(best[0] + 1, best[1] + 1, float(best[2]), conditional_expectation(wt, best[0] + 1, best[1] + 1)) if best else None


def fixed_spread_forecast(wt: np.ndarray, theta: float, spread: int) -> Forecast | None:
    """The most probable interval of a given spread, if it exceeds theta."""
    if spread >= len(wt):
        raise ValueError("the spread must be below the horizon")
    cum = np.concatenate([[0.0], np.cumsum(wt)])
    p = cum[spread + 1 :] - cum[: len(wt) - spread]
    k = int(np.argmax(p))
    return Forecast(k + 1, k + 1 + spread, float(p[k]), conditional_expectation(wt, k + 1, k + 1 + spread)) if p[k] > theta else None


def next_k_forecast(wt: np.ndarray, theta: float, k: int) -> Forecast:
    """Will it happen in the next k steps?"""
    p = float(wt[:k].sum())
    return Forecast(1, k, p, conditional_expectation(wt, 1, k), p >= theta)


def window_forecast(wt: np.ndarray, theta: float, center: int, length: int) -> Forecast:
    """Will it happen in a window around the given step?"""
    a, b = max(1, center - length // 2), center + length // 2
    p = float(wt[a - 1 : b].sum())
    return Forecast(a, b, p, conditional_expectation(wt, a, b), p >= theta)


def expected_value(wt: np.ndarray) -> float:
    return float((np.arange(1, len(wt) + 1) * wt).sum())


def forecast_table(spark, waits: dict[int, np.ndarray], make, finals: set[int], in_finals: bool = False):  # noqa: ANN001, ANN201
    """One row per state with a forecast: state, f_start, f_end, f_prob, f_positive; as small as the
    automaton."""
    rows = []
    for q, wt in sorted(waits.items()):
        f = make(q, wt)
        if f is not None and (in_finals or q not in finals):
            rows.append((q, f.start, f.end, float(f.prob), bool(f.positive)))
    return spark.createDataFrame(rows, "state int, f_start int, f_end int, f_prob double, f_positive boolean")


def emit_forecasts(steps: DataFrame, table: DataFrame, position: str, state: str = "next_state", distance: dict[int, int] | None = None, within: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """The forecast of each event's state, in positions of its key. The table has one row per state,
    so the join ships it as far as Spark's own size check allows.

    With ``distance`` (events to the nearest final state, see ``distances``) only states forecast whose
    share of the largest distance lies in ``within``, both ends included; unreachable ones never do."""
    t = table.withColumnRenamed("state", "__q")
    if distance is not None:
        far = max(distance.values(), default=0) or 1
        t = t.filter(F.col("__q").isin([q for q, d in distance.items() if within[0] <= d / far <= within[1]]))
    return steps.join(t, F.col(state) == F.col("__q")).drop("__q").withColumns({"from_pos": F.col(position) + F.col("f_start"), "to_pos": F.col(position) + F.col("f_end")})


# -- evaluation ----------------------------------------------------------------------------------


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn; rows where either is null are left out."""
    d = df.select(*(by or []), predicted.alias("__p"), actual.alias("__a")).filter("__p IS NOT NULL AND __a IS NOT NULL")
    n = {"tp": F.col("__p") & F.col("__a"), "fp": F.col("__p") & ~F.col("__a"), "fn": ~F.col("__p") & F.col("__a"), "tn": ~F.col("__p") & ~F.col("__a")}
    return d.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in n.items()])


def classification_metrics(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, specificity, accuracy, npv, informedness (each -1 where undefined) and
    mcc (0 where undefined; from the products of rates)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(-1.0))

    d = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "accuracy": ratio(tp + tn, tp + tn + fp + fn), "npv": ratio(tn, tn + fn)})
    p, r, s, v = (F.col(c) for c in ("precision", "recall", "specificity", "npv"))
    good = (p >= 0) & (r >= 0) & (s >= 0) & (v >= 0)
    mcc = F.sqrt(p * r * s * v) - F.sqrt((1 - p) * (1 - r) * (1 - s) * (1 - v))
    return d.withColumns({
        "f1": F.when((p >= 0) & (r >= 0) & (p + r > 0), 2 * p * r / (p + r)).otherwise(F.lit(-1.0)),
        "informedness": F.when((r >= 0) & (s >= 0), r + s - 1).otherwise(F.lit(-1.0)),
        "mcc": F.when(good, mcc).otherwise(F.lit(0.0)),
    })


def forecast_hits(forecasts: DataFrame, detections: DataFrame, keys: list[str], position: str = "pos", width: int | None = None) -> DataFrame:
    """Adds ``hit``: a detection of the same key lies in [from_pos, to_pos]; and ``next_pos``, the
    first detection at or after from_pos. One ordered scan, backwards, instead of a range join."""
    from tidewell.operators.ordered import last_known

    f = forecasts.select(*keys, (-F.col("from_pos")).alias("__t"), F.lit(1).alias("__o"), F.struct(*forecasts.columns).alias("__f"))
    d = detections.select(*keys, (-F.col(position)).alias("__t"), F.lit(0).alias("__o"), F.col(position).alias("__d"))
    both = last_known(f.unionByName(d, allowMissingColumns=True), keys, ["__t", "__o"], "__d", "next_pos", width).filter("__f IS NOT NULL")
    return both.select("__f.*", "next_pos").withColumn("hit", F.coalesce(F.col("next_pos") <= F.col("to_pos"), F.lit(False)))


def regression_metrics(hits: DataFrame, theta: float, by: list[str] | None = None) -> DataFrame:
    """Of forecasts with a next detection: mean spread, interval score, deviation from the interval,
    rmse, mae and mare of its middle; and ``misses``, forecasts without one."""
    width = F.col("to_pos") - F.col("from_pos")
    dev = F.greatest(F.col("from_pos") - F.col("next_pos"), F.col("next_pos") - F.col("to_pos"), F.lit(0))
    err = (F.col("from_pos") + F.col("to_pos")) / 2 - F.col("next_pos")
    left = F.col("next_pos") - F.col("pos")
    known = F.col("next_pos").isNotNull()
    a = 1 - theta

    def mean(c: Column) -> Column:
        return F.avg(F.when(known, c))

    return hits.groupBy(*(by or [])).agg(
        mean(width).alias("spread"), mean(width + F.lit(2 / a) * dev).alias("interval_score"), mean(dev).alias("deviation"),
        F.sqrt(mean(err * err)).alias("rmse"), mean(F.abs(err)).alias("mae"), mean(F.when(left > 0, F.abs(err) / left)).alias("mare"),
        F.sum((~known).cast("long")).alias("misses"),
    )


def stratified_folds(df: DataFrame, key: str, folds: int, label: str | None = None, seed: int = 1) -> DataFrame:
    """Adds ``fold``, the same on every run. Without a label it is a hash of the key and needs no
    shuffle. With one, the rows of every class are numbered in a random order, exactly and without a
    task that sees a whole class, and dealt out in turn: folds of a class differ by one row at most.
    A null label is a class of its own."""
    mixed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 1)
    if label is None:
        return df.withColumn("fold", F.pmod(mixed, F.lit(folds)).cast("int"))
    d = df.withColumns({"__l": F.coalesce(F.col(label).cast("string"), F.lit("")), "__isnull": F.col(label).isNull(), "__r": mixed})
    d = d.withColumn("__l", F.concat_ws(":", F.col("__isnull").cast("string"), "__l"))
    sizes = d.groupBy("__l").agg(F.count("*").alias("__c"))
    d = d.join(sizes, "__l").withColumn("__b", F.floor(F.col("__r") / F.lit(float(2**63)) * F.ceil(F.col("__c") / F.lit(20_000))))
    parts = d.groupBy("__l", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__l").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__l", "__b").orderBy("__r", key)) - 1
    d = d.withColumn("__i", inside).join(parts, ["__l", "__b"])
    return d.withColumn("fold", F.pmod(F.col("__o") + F.col("__i"), F.lit(folds)).cast("int")).select(*df.columns, "fold")


def order_by_cross_validation(words_by_fold: dict[int, dict[tuple[int, ...], int]], held_out: dict[int, list[int]], symbols: int, orders: list[int]) -> int:
    """The order whose suffix trees have the smallest mean log loss on the held-out folds."""
    def score(m: int) -> float:
        total = []
        for k, seq in held_out.items():
            counts: dict[tuple[int, ...], int] = {}
            for j, c in words_by_fold.items():
                if j != k:
                    for w, n in c.items():
                        if len(w) <= m + 1:
                            counts[w] = counts.get(w, 0) + n
            events = sum(n for w, n in counts.items() if len(w) == 1)
            total.append(learn_suffix_tree(counts, events, symbols, m, ratio=1.0).log_loss(seq, m))
        return float(np.mean(total))

    return min(orders, key=score)


# -- word counts as models -----------------------------------------------------------------------


def fold_words(words: DataFrame) -> DataFrame:
    """Counts of words per fold (fold, word, n; word[0] is the symbol, the rest its context, newest first)
    as rows (fold, order, context, symbol, n). As many rows as words, not as events."""
    c = F.array_join(F.transform(F.slice("word", 2, F.size("word")), lambda x: x.cast("string")), ".")
    return words.select("fold", (F.size("word") - 1).alias("order"), c.alias("context"), F.col("word")[0].alias("symbol"), "n")


def order_losses(words: DataFrame, symbols: int) -> DataFrame:
    """Per order the mean log loss of held-out words (A-51): each fold is predicted from the words of the
    others, by counts with one added; ``best`` marks the order that loses least, the smaller of equals."""
    w = fold_words(words)
    by = lambda *c: Window.partitionBy("order", "context", *c)
    own = F.sum("n").over(by("fold"))
    train = F.sum("n").over(by("symbol")) - F.col("n")
    p = (train + 1) / (F.sum("n").over(by()) - own + symbols)
    loss = w.withColumn("__l", -F.log2(p) * F.col("n")).groupBy("order").agg((F.sum("__l") / F.sum("n")).alias("loss"), F.sum("n").alias("n"))
    return loss.withColumn("best", F.row_number().over(Window.orderBy(F.round("loss", 9), "order")) == 1)  # one row per order


def next_symbol_accuracy(words: DataFrame) -> DataFrame:
    """Per order how often the most frequent symbol after a context is the one that comes (A-63, A-67)."""
    w = fold_words(words).groupBy("order", "context", "symbol").agg(F.sum("n").alias("n"))
    c = w.groupBy("order", "context").agg(F.max("n").alias("hit"), F.sum("n").alias("n"))
    return c.groupBy("order").agg(F.count("*").alias("contexts"), (F.sum("hit") / F.sum("n")).alias("accuracy"))


def disambiguate(table: list[list[int]], finals: set[int], order: int) -> tuple[list[list[int]], set[int], list[tuple[int, tuple[int, ...]]]]:
    """The automaton whose states also hold the last ``order`` symbols (A-41): its table over the same
    symbols, its final states, and for each state the old one with its symbols, oldest first. It
    accepts the same words; only reachable states exist, the first is the start."""
    labels: list[tuple[int, tuple[int, ...]]] = [(0, ())]
    number = {labels[0]: 0}
    out: list[list[int]] = []
    for q, recent in labels:  # grows while it is walked
        row = []
        for symbol, to in enumerate(table[q]):
            x = (to, (*recent, symbol)[-order:] if order else ())
            if x not in number:
                number[x] = len(labels)
                labels.append(x)
            row.append(number[x])
        out.append(row)
    return out, {i for i, (q, _) in enumerate(labels) if q in finals}, labels


@dataclass
class HiddenMarkov:
    """A hidden Markov model whose observations are the states of an automaton (A-49)."""

    start: np.ndarray
    move: np.ndarray
    show: np.ndarray

    @classmethod
    def fit(cls, sequences: list[list[int]], observations: int, hidden: int, rounds: int = 20, seed: int = 1) -> HiddenMarkov:
        """Expectation maximisation on a bounded sample of sequences, which the caller chooses."""
        rng = np.random.default_rng(seed)
        norm = lambda m: m / m.sum(-1, keepdims=True)
        h = cls(norm(rng.random(hidden) + 1), norm(rng.random((hidden, hidden)) + 0.5), norm(rng.random((hidden, observations)) + 0.5))
        for _ in range(rounds):
            start, move, show = np.full(hidden, 1e-6), np.full((hidden, hidden), 1e-6), np.full((hidden, observations), 1e-6)
            for s in sequences:
                if not s:
                    continue
                a, scale = h._forward(s)
                b = np.ones((len(s), hidden))
                for i in range(len(s) - 2, -1, -1):
                    b[i] = h.move @ (h.show[:, s[i + 1]] * b[i + 1]) / scale[i + 1]
                g = norm(a * b)
                start += g[0]
                for i in range(len(s) - 1):
                    move += a[i][:, None] * h.move * (h.show[:, s[i + 1]] * b[i + 1])[None] / scale[i + 1]
                np.add.at(show.T, s, g)
            h = cls(norm(start), norm(move), norm(show))
        return h

    def _forward(self, s: list[int]) -> tuple[np.ndarray, np.ndarray]:
        a, scale = np.zeros((len(s), len(self.start))), np.zeros(len(s))
        now = self.start
        for i, o in enumerate(s):
            now = (now if i == 0 else now @ self.move) * self.show[:, o]
            scale[i] = max(now.sum(), 1e-300)
            now = a[i] = now / scale[i]
        return a, scale

    def log_likelihood(self, s: list[int]) -> float:
        return float(np.log(self._forward(s)[1]).sum()) if s else 0.0

    def waiting(self, seen: list[int], finals: set[int], horizon: int) -> np.ndarray:
        """Probability that the next final observation comes after 1, 2, … steps, given what was seen."""
        now = self._forward(seen)[0][-1] @ self.move if seen else self.start
        hit = self.show[:, sorted(finals)].sum(1)
        out = np.zeros(horizon)
        for t in range(horizon):
            out[t] = now @ hit
            now = (now * (1 - hit)) @ self.move
        return out
