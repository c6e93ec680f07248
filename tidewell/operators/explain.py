"""Local explanations of black-box models: descriptor, encoding, neighbourhood, surrogate, rules."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories that a descriptor lists per feature; more make the feature's count only.
MOST_CATEGORIES = 10_000


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per feature: min, max, mean, std, median, q1, q3; nulls are skipped. Medians are
    approximate to 1/10000, so the summary is one pass with bounded state."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    q = F.percentile_approx("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000)).alias("q")
    g = long.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), q)
    return g.select("feature", "min", "max", "mean", "std", F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"))


def describe_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (feature, value, n); null is a value."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    return long.groupBy("feature", "value").agg(F.count("*").alias("n"))


@dataclass
class Encoder:
    """One-hot for categories, order numbers for ordinals, numbers as they are; invertible."""

    numeric: list[str]
    categories: dict[str, list[str]] = field(default_factory=dict)
    ordinal: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, numeric: list[str], categorical: list[str], ordinal: dict[str, list[str]] | None = None) -> Encoder:
        cats: dict[str, list[str]] = {c: [] for c in categorical}
        if categorical:
            for r in describe_categories(df, categorical).filter("value IS NOT NULL").sort("feature", "value").limit(MOST_CATEGORIES * len(categorical) + 1).collect():
                cats[r["feature"]].append(r["value"])
        if any(len(v) > MOST_CATEGORIES for v in cats.values()):
            raise ValueError("a feature with more than 10,000 categories can't be one-hot encoded")
        return cls(numeric, cats, ordinal or {})

    def names(self) -> list[str]:
        return [*self.numeric, *self.ordinal, *[f"{c}={v}" for c, vs in self.categories.items() for v in vs]]

    def encode(self, df: DataFrame, out: str = "x", missing: float = 0.0) -> DataFrame:
        """Adds the encoded array; unknown categories are all zero, missing numbers ``missing``."""
        cols = [F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in self.numeric]
        cols += [F.array_position(F.array(*[F.lit(v) for v in vs]), F.col(c).cast("string")).cast("double") - 1 for c, vs in self.ordinal.items()]
        cols += [F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0) for c, vs in self.categories.items() for v in vs]
        return df.withColumn(out, F.array(*[F.coalesce(c, F.lit(missing)) for c in cols]))

    def decode(self, df: DataFrame, x: str = "x") -> DataFrame:
        """The original columns from the encoded array."""
        out, k = {}, 0
        for c in self.numeric:
            out[c] = F.col(x)[k]
            k += 1
        for c, vs in self.ordinal.items():
            out[c] = F.try_element_at(F.array(*[F.lit(v) for v in vs]), (F.round(F.col(x)[k]) + 1).cast("int"))
            k += 1
        for c, vs in self.categories.items():
            part = F.slice(F.col(x), k + 1, len(vs))
            at = F.array_position(part, F.array_max(part))
            out[c] = F.when(F.array_max(part) > 0, F.try_element_at(F.array(*[F.lit(v) for v in vs]), at.cast("int")))
            k += len(vs)
        return df.withColumns(out)


def random_neighbourhood(spark, n: int, ranges: dict[str, tuple[float, float]], categories: dict[str, list[str]], seed: int = 1) -> DataFrame:  # noqa: ANN001
    """n rows with uniform numbers in their ranges and uniform categories, from seeded hashes."""
    def u(i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed * 1000 + i), F.col("row")), F.lit(2**40)) / F.lit(float(2**40))

    cols, i = {}, 0
    for c, (a, b) in ranges.items():
        cols[c] = u(i) * (b - a) + a
        i += 1
    for c, vs in categories.items():
        cols[c] = F.element_at(F.array(*[F.lit(v) for v in vs]), (F.floor(u(i) * len(vs)) + 1).cast("int"))
        i += 1
    return spark.range(n).withColumnRenamed("id", "row").withColumns(cols)


def balanced(df: DataFrame, label: str, key: str, seed: int = 1) -> DataFrame:
    """Every class thinned to about the size of the smallest, by a hash of the key."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    low = n.agg(F.min("__n")).scalar()
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2**40)) / F.lit(float(2**40))
    return df.join(n.withColumn("__low", low), label).filter(u <= F.col("__low") / F.col("__n")).drop("__n", "__low")


def weighted_neighbourhood(df: DataFrame, column: str, weights: dict[str, dict[str, float]], key: str, out: str, seed: int = 1) -> DataFrame:
    """A new category drawn with weights that depend on the old one; categories without weights stay."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2**40)) / F.lit(float(2**40))
    pick = F.col(column)
    for old, to in weights.items():
        total, acc, choice = sum(to.values()), 0.0, F.lit(None).cast("string")
        steps = []
        for v, w in to.items():
            acc += w / total
            steps.append((acc, v))
        for a, v in reversed(steps):
            choice = F.when(u < a, v).otherwise(F.coalesce(choice, F.lit(steps[-1][1])))
        pick = F.when(F.col(column) == old, choice).otherwise(pick)
    return df.withColumn(out, pick)


def genetic_neighbourhood(x: np.ndarray, predict, low: np.ndarray, high: np.ndarray, size: int = 200, generations: int = 10, same: bool = True, a1: float = 0.5, a2: float = 0.5, seed: int = 1) -> np.ndarray:  # noqa: ANN001
    """Points near x that get the same (or another) class: a small population evolves on the driver."""
    rng = np.random.default_rng(seed)
    goal = predict(x[None, :])[0]
    span = np.where(high > low, high - low, 1.0)
    pop = np.clip(x + rng.normal(size=(size, len(x))) * span * 0.1, low, high)
    for _ in range(generations):
        d = np.sqrt((((pop - x) / span) ** 2).mean(1))
        hit = (predict(pop) == goal) == same
        fit = a1 / (1 + np.exp(-10 * (0.5 - d))) * (d > 0) + a2 * hit
        best = pop[np.argsort(-fit, kind="stable")[: size // 2]]
        mates = best[rng.integers(len(best), size=(size - len(best), 2))]
        mask = rng.random((len(mates), len(x))) < 0.5
        kids = np.where(mask, mates[:, 0], mates[:, 1])
        kids += (rng.random(kids.shape) < 0.2) * rng.normal(size=kids.shape) * span * 0.1
        pop = np.vstack([best, np.clip(kids, low, high)])
    return pop[((predict(pop) == goal) == same)]


def normalised_euclid(a: Column, b: Column) -> Column:
    """0.5 · var(a-b) / (var a + var b + 1e-7), over array columns."""
    def var(v: Column) -> Column:
        n = F.size(v)
        m = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n

    return 0.5 * var(F.zip_with(a, b, lambda x, y: x - y)) / (var(a) + var(b) + 1e-7)


def mixed_distance(numeric: Column, same: list[Column], share: float) -> Column:
    """``share`` of the numeric distance and the rest the share of differing categories."""
    differ = sum([F.when(s, 0.0).otherwise(1.0) for s in same], F.lit(0.0)) / max(len(same), 1)
    return share * numeric + (1 - share) * differ


def sigmoid(x: Column, at: float = 0.5, slope: float = 10.0) -> Column:
    return 1 / (1 + F.exp(-slope * (x - at)))


# -- surrogate tree and rules --------------------------------------------------------------------


@dataclass
class Node:
    label: int
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 4, least: int = 2) -> Node:
    """A small decision tree by Gini impurity; leaves that decide alike are merged."""
    values, counts = np.unique(y, return_counts=True)
    node = Node(int(values[np.argmax(counts)]))
    if depth == 0 or len(values) < 2 or len(y) < 2 * least:
        return node
    best = (1e-12, -1, 0.0)
    total = 1 - ((counts / len(y)) ** 2).sum()
    onehot = (y[:, None] == values[None, :]).astype(float)
    for f in range(x.shape[1]):
        o = np.argsort(x[:, f], kind="stable")
        v, left = x[o, f], np.cumsum(onehot[o], axis=0)
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(y) - cut - 1 >= least)]
        if not len(cut):
            continue
        n = (cut + 1).astype(float)
        a, b = left[cut] / n[:, None], (left[-1] - left[cut]) / (len(y) - n)[:, None]
        gain = total - (n * (1 - (a**2).sum(1)) + (len(y) - n) * (1 - (b**2).sum(1))) / len(y)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if best[1] < 0:
        return node
    m = x[:, best[1]] <= best[2]
    node.feature, node.cut = best[1], best[2]
    node.low, node.high = grow(x[m], y[m], depth - 1, least), grow(x[~m], y[~m], depth - 1, least)
    if node.low.feature < 0 and node.high.feature < 0 and node.low.label == node.high.label:
        node.feature, node.low, node.high = -1, None, None
    return node


def rules(node: Node, names: list[str], path: tuple = ()) -> list[tuple[tuple[tuple[str, str, float], ...], int]]:
    """(premises, class) of every leaf; premises are compact: per feature one ≤ and one >."""
    if node.feature < 0:
        low: dict[str, float] = {}
        high: dict[str, float] = {}
        for n, op, v in path:
            if op == "<=":
                low[n] = min(v, low.get(n, math.inf))
            else:
                high[n] = max(v, high.get(n, -math.inf))
        return [(tuple(sorted([(n, "<=", v) for n, v in low.items()] + [(n, ">", v) for n, v in high.items()])), node.label)]
    n = names[node.feature]
    return rules(node.low, names, (*path, (n, "<=", node.cut))) + rules(node.high, names, (*path, (n, ">", node.cut)))


def covered(premises: tuple, column) -> Column:  # noqa: ANN001
    """Does a row meet all premises? A missing value doesn't."""
    out = F.lit(True)
    for n, op, v in premises:
        out = out & F.coalesce(column(n) <= v if op == "<=" else column(n) > v, F.lit(False))
    return out


def explain(x: np.ndarray, label: int, all_rules: list) -> tuple[tuple, list[tuple]]:
    """The rule that covers x, and the rules of other classes with the fewest premises x fails (all
    ties are kept)."""
    def fails(premises: tuple, row: dict[str, float]) -> int:
        return sum(not (row[n] <= v if op == "<=" else row[n] > v) for n, op, v in premises)

    row = x if isinstance(x, dict) else dict(enumerate(x))
    mine = next((r for r in all_rules if fails(r[0], row) == 0), ((), label))
    others = [(fails(r[0], row), r) for r in all_rules if r[1] != mine[1]]
    best = min((f for f, _ in others), default=0)
    return mine, [r for f, r in others if f == best]


# -- discretisation ------------------------------------------------------------------------------


def mdlp_cuts(value: np.ndarray, counts: np.ndarray) -> list[float]:
    """Recursive entropy splits of sorted distinct values with class counts, stopped by description
    length."""
    def entropy(c: np.ndarray) -> np.ndarray:
        p = c / np.maximum(c.sum(-1, keepdims=True), 1)
        return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)

    total = counts.sum(0)
    n = total.sum()
    if len(value) < 2 or n < 2:
        return []
    left = np.cumsum(counts, axis=0)[:-1]
    right = total - left
    nl, nr = left.sum(1), right.sum(1)
    e = (nl * entropy(left) + nr * entropy(right)) / n
    k = int(np.argmin(e))
    gain = entropy(total[None])[0] - e[k]
    c, cl, cr = (total > 0).sum(), (left[k] > 0).sum(), (right[k] > 0).sum()
    delta = np.log2(3.0**c - 2) - (c * entropy(total[None])[0] - cl * entropy(left[k][None])[0] - cr * entropy(right[k][None])[0])
    if gain <= (np.log2(n - 1) + delta) / n:
        return []
    return [*mdlp_cuts(value[: k + 1], counts[: k + 1]), float((value[k] + value[k + 1]) / 2), *mdlp_cuts(value[k + 1 :], counts[k + 1 :])]


def _at_least(low: Column):  # noqa: ANN202
    return lambda x: x >= low


def discretise(df: DataFrame, columns: list[str], label: str, cells: int = 512) -> dict[str, list[float]]:
    """Cut points per feature. Values are first counted in at most ``cells`` quantile cells per feature
    (one pass, over all rows), so that what the splits see is bounded by cells and classes."""
    num = [F.col(c).cast("double").alias(c) for c in columns]
    edges = df.select(*num).agg(*[F.percentile_approx(c, F.array(*[F.lit((i + 1) / cells) for i in range(cells)]), F.lit(20_000)).alias(c) for c in columns]).first()
    out: dict[str, list[float]] = {}
    for c in columns:
        e = sorted(set(edges[c] or []))
        if len(e) < 2:
            out[c] = []
            continue
        now = F.col(c).cast("double")
        up = F.try_element_at(F.filter(F.array(*[F.lit(float(x)) for x in e]), _at_least(now)), F.lit(1))
        got = df.filter(F.col(c).isNotNull() & F.col(label).isNotNull()).groupBy(up.alias("v"), F.col(label).cast("string").alias("l")).agg(F.count("*").alias("n")).toPandas()
        t = got.pivot_table(index="v", columns="l", values="n", aggfunc="sum", fill_value=0).sort_index()
        out[c] = mdlp_cuts(t.index.to_numpy(float), t.to_numpy(float))
    return out


def to_bins(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Every value replaced by the mean of its bin (null stays null)."""
    d = df
    for c, cs in cuts.items():
        b = sum([F.when(F.col(c) > x, 1).otherwise(0) for x in cs], F.lit(0))
        d = d.withColumn("__b", F.when(F.col(c).isNotNull(), b))
        m = d.groupBy("__b").agg(F.avg(c).alias("__m"))
        d = d.join(m, "__b", "left").withColumn(c, F.col("__m")).drop("__b", "__m")
    return d
