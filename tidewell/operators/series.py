"""Time series: nearest neighbours on prefixes, early classification, reduction, measures.

Series are rows (id, values array<double>, label) or long rows (id, dim, t, value). Training sets of
classifiers are bounded samples of labelled rows; the bound is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block of a nearest-neighbour search, on either side.
BLOCK = 2_000


def _matrix(values: list, length: int | None = None) -> np.ndarray:
    n = length or max((len(v) for v in values), default=0)
    out = np.zeros((len(values), n))
    for i, v in enumerate(values):
        x = np.nan_to_num(np.array([0.0 if a is None else a for a in v[:n]], float))
        out[i, : len(x)] = x
    return out


def nearest(queries: DataFrame, rows: DataFrame, k: int, measure: str = "euclid", prefixes: list[int] | None = None, block: int = BLOCK) -> DataFrame:
    """The k nearest rows of every query, per prefix length: query, prefix, neighbour, rank, distance
    (cosine: 1 - similarity). Both sides have ``id`` and ``vec``; a row is no neighbour of its own id.

    Exact and blockwise: queries and rows are cut into blocks, each pair of blocks is one matrix
    product whose k best per query go on to a final top k. Equal distances rank by id. Rows with a
    null id or vector are left out; missing values count as 0.
    """
    q = queries.select(F.col("id").cast("long"), F.col("vec").cast("array<double>").alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
    r = rows.select(F.col("id").cast("long"), F.col("vec").cast("array<double>").alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
    nq, nr = q.count(), r.count()
    bq, br = max(1, -(-nq // block)), max(1, -(-nr // block))
    left = q.withColumn("bq", F.pmod(F.xxhash64("id"), F.lit(bq))).withColumn("br", F.explode(F.sequence(F.lit(0), F.lit(br - 1))))
    right = r.withColumn("br", F.pmod(F.xxhash64("id"), F.lit(br)).cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bq - 1).cast("long"))))

    def run(_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        ia, ib = a.column("id").to_numpy(), b.column("id").to_numpy()
        va, vb = a.column("vec").to_pylist(), b.column("vec").to_pylist()
        n = max([len(v) for v in va + vb], default=0)
        va, vb = _matrix(va, n), _matrix(vb, n)
        out: list[pa.Table] = []
        for p in prefixes or [n]:
            x, y = va[:, :p], vb[:, :p]
            if not len(x) or not len(y):
                continue
            if measure == "cosine":
                nx, ny = np.linalg.norm(x, axis=1, keepdims=True), np.linalg.norm(y, axis=1, keepdims=True)
                d = 1 - (x / np.where(nx > 0, nx, 1)) @ (y / np.where(ny > 0, ny, 1)).T
            else:
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))
            d = np.where(ia[:, None] == ib[None, :], np.inf, np.round(d, 9))
            best = np.lexsort((np.broadcast_to(ib, d.shape), d), axis=1)[:, :k]
            dist = np.take_along_axis(d, best, 1)
            ok = np.isfinite(dist)
            who = np.repeat(ia, best.shape[1]).reshape(best.shape)
            out.append(pa.table({"query": who[ok], "prefix": np.full(int(ok.sum()), p, np.int32), "neighbour": ib[best[ok]], "distance": dist[ok]}))
        schema = pa.schema([("query", pa.int64()), ("prefix", pa.int32()), ("neighbour", pa.int64()), ("distance", pa.float64())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    found = left.groupBy("bq", "br").cogroup(right.groupBy("bq", "br")).applyInArrow(run, "query long, prefix int, neighbour long, distance double")
    w = Window.partitionBy("query", "prefix").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# -- early classification ------------------------------------------------------------------------


@dataclass
class Ects:
    """Early classification by nearest neighbours: a training series may vote from the prefix on from
    which its set of reverse neighbours stays what it is at full length."""

    x: np.ndarray
    y: np.ndarray
    mpl: np.ndarray

    @staticmethod
    def neighbours(x: np.ndarray, p: int) -> np.ndarray:
        z = x[:, :p]
        d = (z * z).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2 * z @ z.T
        d = np.round(d, 9)
        np.fill_diagonal(d, np.inf)
        return np.argmin(d, axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, clusters: bool = True) -> Ects:
        n, length = x.shape
        nn = np.stack([cls.neighbours(x, p) for p in range(1, length + 1)])
        sets = [[frozenset(np.flatnonzero(nn[p] == i)) for i in range(n)] for p in range(length)]
        mpl = np.full(n, length)
        for i in range(n):
            if sets[-1][i]:
                p = length - 1
                while p > 0 and sets[p - 1][i] == sets[-1][i]:
                    p -= 1
                mpl[i] = p + 1
        if clusters:
            mpl = cls._by_clusters(x, y, nn, mpl)
        return cls(x, y, mpl)

    @staticmethod
    def _by_clusters(x: np.ndarray, y: np.ndarray, nn: np.ndarray, mpl: np.ndarray) -> np.ndarray:
        """Mutually nearest clusters of one class merge; a cluster may vote from the prefix on from
        which its reverse neighbours stay and its members' neighbours lie inside it."""
        n, length = x.shape
        d = (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T
        np.fill_diagonal(d, np.inf)
        groups = {i: {i} for i in range(n)}
        out = mpl.copy()
        link = d.copy()
        alive = set(range(n))
        while len(alive) > 1:
            ids = sorted(alive)
            sub = link[np.ix_(ids, ids)]
            near = {ids[i]: ids[int(j)] for i, j in enumerate(np.argmin(sub, axis=1))}
            pairs = [(a, b) for a, b in near.items() if a < b and near[b] == a and len({*y[list(groups[a] | groups[b])]}) == 1]
            if not pairs:
                break
            for a, b in pairs:
                groups[a] |= groups.pop(b)
                link[a] = np.minimum(link[a], link[b])
                link[:, a] = link[a]
                link[a, a] = np.inf
                link[b], link[:, b] = np.inf, np.inf
                alive.discard(b)
                inside = np.array(sorted(groups[a]))
                full = frozenset(np.flatnonzero(np.isin(nn[-1], inside))) - frozenset(inside.tolist())
                p = length
                while p > 1:
                    now = frozenset(np.flatnonzero(np.isin(nn[p - 2], inside))) - frozenset(inside.tolist())
                    if now != full or not np.isin(nn[p - 2][inside], inside).all():
                        break
                    p -= 1
                out[inside] = np.minimum(out[inside], p)
        return out

    def predict(self, z: np.ndarray) -> list[tuple[int, int]]:
        """(prefix used, class) per row: the first prefix whose nearest training series may vote."""
        out, open_ = [None] * len(z), np.ones(len(z), bool)
        length = self.x.shape[1]
        for p in range(1, length + 1):
            a, b = z[:, :p], self.x[:, :p]
            near = np.argmin((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, axis=1)
            ok = open_ & ((self.mpl[near] <= p) | (p == length))
            for i in np.flatnonzero(ok):
                out[i] = (p, int(self.y[near[i]]))
            open_ &= ~ok
        return out


def random_kernels(length: int, count: int, rng: np.random.Generator) -> list[tuple[np.ndarray, float, int]]:
    out = []
    for _ in range(count):
        size = int(rng.choice([3, 5, 7, 9]))
        w = rng.normal(size=size)
        most = max(1, (length - 1) // (size - 1))
        out.append((w - w.mean(), float(rng.uniform(-1, 1)), int(2 ** rng.uniform(0, np.log2(most))) if most > 1 else 1))
    return out


def kernel_features(x: np.ndarray, kernels: list[tuple[np.ndarray, float, int]]) -> np.ndarray:
    """Share of positive values and maximum of each dilated convolution."""
    cols = []
    for w, bias, dil in kernels:
        pad = (len(w) - 1) * dil // 2
        z = np.pad(x, ((0, 0), (pad, pad + 1)))
        n = z.shape[1] - (len(w) - 1) * dil
        conv = sum(w[j] * z[:, j * dil : j * dil + n] for j in range(len(w))) + bias
        cols += [(conv > 0).mean(axis=1), conv.max(axis=1)]
    return np.stack(cols, axis=1)


@dataclass
class Ridge:
    """Multi-class ridge regression with soft scores."""

    classes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    @classmethod
    def fit(cls, f: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> Ridge:
        classes = np.unique(y)
        mean, scale = f.mean(0), f.std(0) + 1e-9
        g = np.hstack([(f - mean) / scale, np.ones((len(f), 1))])
        t = np.where(y[:, None] == classes[None, :], 1.0, -1.0)
        return cls(classes, mean, scale, np.linalg.solve(g.T @ g + alpha * np.eye(g.shape[1]), g.T @ t))

    def proba(self, f: np.ndarray) -> np.ndarray:
        s = np.hstack([(f - self.mean) / self.scale, np.ones((len(f), 1))]) @ self.w
        e = np.exp(2 * (s - s.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


@dataclass
class KernelRidge:
    """Regression by Gaussian kernels around the rows it was fitted on."""

    rows: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, alpha: float = 0.1) -> KernelRidge:
        mean, scale = x.mean(0), x.std(0) + 1e-9
        rows = (x - mean) / scale
        k = cls._kernel(rows, rows)
        return cls(rows, mean, scale, np.linalg.solve(k + alpha * np.eye(len(k)), y))

    @staticmethod
    def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).mean(2))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._kernel((x - self.mean) / self.scale, self.rows) @ self.weight


def temperature(p: np.ndarray, right: np.ndarray) -> float:
    """The power of probabilities under which the true classes (column numbers) are most likely."""
    best = min(np.geomspace(0.2, 5, 25), key=lambda t: -float(np.log(np.maximum(_tempered(p, t)[np.arange(len(p)), right], 1e-12)).mean()))
    return float(best)


def _tempered(p: np.ndarray, t: float) -> np.ndarray:
    q = np.maximum(p, 1e-12) ** t
    return q / q.sum(1, keepdims=True)


@dataclass
class Stopping:
    """Early classification with a delay penalty: at each checkpoint a classifier with calibrated
    probabilities, and a kernel regression of what waiting is worth, trained backwards; stop where
    waiting is not worth its cost."""

    checkpoints: list[int]
    models: list[tuple[list, Ridge, float]]
    waits: list[KernelRidge | None]
    delay: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, delay: float = 0.5, checkpoints: int = 20, kernels: int = 40, seed: int = 1) -> Stopping:
        rng = np.random.default_rng(seed)
        length = x.shape[1]
        cps = sorted({max(3, round(length * (i + 1) / checkpoints)) for i in range(checkpoints)})
        half = rng.permutation(len(x))
        a, b = half[: len(x) // 2], half[len(x) // 2 :]
        models, costs, confs = [], [], []
        for c in cps:
            ks = random_kernels(c, kernels, rng)
            m = Ridge.fit(kernel_features(x[a, :c], ks), y[a])
            p = m.proba(kernel_features(x[b, :c], ks))
            heat = temperature(p, np.searchsorted(m.classes, y[b]).clip(0, len(m.classes) - 1))
            p = _tempered(p, heat)
            models.append((ks, m, heat))
            costs.append((m.classes[p.argmax(1)] != y[b]).astype(float) + delay * c / length)
            confs.append(cls._inputs(p))
        waits: list[KernelRidge | None] = [None] * len(cps)
        best = costs[-1]
        for i in range(len(cps) - 2, -1, -1):
            g = confs[i]
            waits[i] = KernelRidge.fit(g, best - costs[i])
            best = np.where(waits[i](g) < 0, best, costs[i])
        return cls(cps, models, waits, delay)

    @staticmethod
    def _inputs(p: np.ndarray) -> np.ndarray:
        s = np.sort(p, axis=1)
        return np.stack([s[:, -1], s[:, -1] - (s[:, -2] if p.shape[1] > 1 else 0), np.ones(len(p))], axis=1)

    def predict(self, z: np.ndarray) -> list[tuple[int, int]]:
        out, open_ = [None] * len(z), np.ones(len(z), bool)
        for i, (c, (ks, m, heat)) in enumerate(zip(self.checkpoints, self.models, strict=True)):
            idx = np.flatnonzero(open_)
            if not len(idx):
                break
            p = _tempered(m.proba(kernel_features(z[idx, :c], ks)), heat)
            stop = np.ones(len(idx), bool) if self.waits[i] is None else self.waits[i](self._inputs(p)) >= 0
            for j, k in zip(idx[stop], m.classes[p.argmax(1)][stop], strict=True):
                out[j] = (c, int(k))
            open_[idx[stop]] = False
        return out


@dataclass
class Truncation:
    """One prefix length for all: the one whose classifier does best on held-out splits."""

    length: int
    kernels: list
    model: Ridge

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, metric: str = "harmonic", splits: int = 3, first: int = 9, step: int = 1, kernels: int = 40, seed: int = 1) -> Truncation:
        rng = np.random.default_rng(seed)
        total = x.shape[1]
        lengths = sorted({*range(min(first, total), total + 1, step), total})
        score = dict.fromkeys(lengths, 0.0)
        for _ in range(splits):
            held = np.concatenate([rng.permutation(np.flatnonzero(y == c))[: max(1, round(0.2 * (y == c).sum()))] for c in np.unique(y)])
            train = np.setdiff1d(np.arange(len(x)), held)
            for p in lengths:
                ks = random_kernels(p, kernels, rng)
                m = Ridge.fit(kernel_features(x[train, :p], ks), y[train])
                acc = float((m.classes[m.proba(kernel_features(x[held, :p], ks)).argmax(1)] == y[held]).mean())
                early = 1 - p / total
                score[p] += {"accuracy": acc, "harmonic": 2 * early * acc / (early + acc) if early + acc else 0.0}[metric]
        best = max(lengths, key=lambda p: (score[p], -p))
        ks = random_kernels(best, kernels, rng)
        return cls(best, ks, Ridge.fit(kernel_features(x[:, :best], ks), y))

    def predict(self, z: np.ndarray) -> list[tuple[int, int]]:
        p = self.model.proba(kernel_features(z[:, : self.length], self.kernels))
        return [(self.length, int(c)) for c in self.model.classes[p.argmax(1)]]


@dataclass
class Economy:
    """Early classification by expected cost: series are grouped by k-means; per group and checkpoint the
    error to be expected is counted on held-out series. A series stops at the first checkpoint from
    which no later one promises less error plus delay, groups weighted by how near they are."""

    checkpoints: list[int]
    models: list[tuple[list, Ridge]]
    centres: np.ndarray
    errors: np.ndarray
    delay: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, delay: float = 0.5, groups: int = 3, checkpoints: int = 20, kernels: int = 40, seed: int = 1) -> Economy:
        rng = np.random.default_rng(seed)
        length = x.shape[1]
        cps = sorted({max(3, round(length * (i + 1) / checkpoints)) for i in range(checkpoints)})
        half = rng.permutation(len(x))
        a, b = half[: len(x) // 2], half[len(x) // 2 :]
        centres = x[rng.choice(len(x), min(groups, len(x)), replace=False)].astype(float)
        for _ in range(20):
            near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.stack([x[near == g].mean(0) if (near == g).any() else centres[g] for g in range(len(centres))])
        group = ((x[b][:, None] - centres[None]) ** 2).sum(2).argmin(1)
        models, errors = [], np.zeros((len(cps), len(centres)))
        for i, c in enumerate(cps):
            ks = random_kernels(c, kernels, rng)
            m = Ridge.fit(kernel_features(x[a, :c], ks), y[a])
            wrong = m.classes[m.proba(kernel_features(x[b, :c], ks)).argmax(1)] != y[b]
            errors[i] = [(wrong[group == g].sum() + wrong.mean()) / ((group == g).sum() + 1) for g in range(len(centres))]
            models.append((ks, m))
        return cls(cps, models, centres, errors, delay)

    def predict(self, z: np.ndarray) -> list[tuple[int, int]]:
        out, open_ = [None] * len(z), np.ones(len(z), bool)
        cost = self.errors + self.delay * np.array(self.checkpoints)[:, None] / z.shape[1]
        for i, (c, (ks, m)) in enumerate(zip(self.checkpoints, self.models, strict=True)):
            idx = np.flatnonzero(open_)
            if not len(idx):
                break
            d = ((z[idx, None, :c] - self.centres[None, :, :c]) ** 2).mean(2)
            w = np.exp(-(d - d.min(1, keepdims=True)) / (d.mean() + 1e-12))
            expected = (w / w.sum(1, keepdims=True)) @ cost[i:].T
            stop = expected.argmin(1) == 0
            if stop.any():
                p = m.proba(kernel_features(z[idx[stop], :c], ks))
                for j, k in zip(idx[stop], m.classes[p.argmax(1)], strict=True):
                    out[j] = (c, int(k))
            open_[idx[stop]] = False
        return out


def training_sample(rows: DataFrame, bound: int = 1_000, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """At most ``bound`` labelled series, chosen by a hash of their ids: the documented training set."""
    d = rows.filter("label IS NOT NULL AND vec IS NOT NULL AND id IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("vec"), "label").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(bound)
    got = d.collect()
    return _matrix([r["vec"] for r in got]), np.array([r["label"] for r in got])


def classify_early(rows: DataFrame, model) -> DataFrame:  # noqa: ANN001
    """Every series with the prefix it needed and its class: id, label, prefix, length, predicted."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            if len(b):
                x = _matrix(b["vec"].tolist())
                got = shared.value.predict(x)
                yield pd.DataFrame({"id": b["id"], "label": b["label"], "prefix": [g[0] for g in got], "length": x.shape[1], "predicted": [g[1] for g in got]})

    d = rows.filter("vec IS NOT NULL").select(F.col("id").cast("long"), F.col("vec").cast("array<double>").alias("vec"), F.col("label").cast("int").alias("label"))
    return d.mapInPandas(run, "id long, label int, prefix int, length int, predicted int")


def early_measures(predicted: DataFrame) -> DataFrame:
    """accuracy, earliness (mean prefix over length), their harmonic mean and, in one row per class,
    its support, precision, recall and F1. An unlabelled series is left out."""
    d = predicted.filter("label IS NOT NULL")
    total = d.agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg(F.col("prefix") / F.col("length")).alias("earliness"))
    total = total.withColumn("harmonic", F.when(F.col("accuracy") + 1 - F.col("earliness") > 0, 2 * (1 - F.col("earliness")) * F.col("accuracy") / (1 - F.col("earliness") + F.col("accuracy"))))
    return total.join(class_report(d, "label", "predicted"), F.lit(True), "left")


def class_report(d: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Per class (and group): support, precision, recall and F1; 0 where undefined."""
    by = by or []
    pairs = d.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by, F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    both = pairs.select(*by, F.inline(F.array(F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).cast("long").alias("right")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given"), F.lit(0).cast("long").alias("right")))))
    g = both.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "given", "right")])
    p = F.when(F.col("given") > 0, F.col("right") / F.col("given")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("right") / F.col("support")).otherwise(0.0)
    return g.select(*by, "class", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


# -- reduction and repair ------------------------------------------------------------------------


def paa(long: DataFrame, keys: list[str], t: str, value: str, segments: int, length: int) -> DataFrame:
    """Means of equal segments; the last one takes the remainder."""
    size = max(1, length // segments)
    seg = F.least(F.floor(F.col(t) / F.lit(size)), F.lit(segments - 1))
    return long.groupBy(*keys, seg.alias("segment")).agg(F.avg(value).alias("value"))


def merge_dimensions(long: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """The mean over all dimensions of a series at each time."""
    return long.groupBy(key, t).agg(F.avg(value).alias("value"))


def fill_gaps(values: Column) -> Column:
    """Missing values of an array become the mean of the (filled) value before and the next known one;
    0 at the head, the value before where nothing follows."""
    v = F.transform(values, lambda x: F.when(x.isNotNull() & ~F.isnan(x), x))

    def step(acc: Column, i: Column) -> Column:
        now = F.element_at(v, i)
        later = F.try_element_at(F.filter(F.slice(v, i, F.size(v)), lambda x: x.isNotNull()), F.lit(1))
        before = F.try_element_at(acc, F.lit(-1))
        guess = F.when(F.size(acc) == 0, 0.0).when(later.isNull(), before).otherwise((before + later) / 2)
        return F.concat(acc, F.array(F.coalesce(now, guess)))

    return F.when(F.size(v) > 0, F.aggregate(F.sequence(F.lit(1), F.size(v)), F.array().cast("array<double>"), step)).otherwise(v)


def vote(predictions: DataFrame, key: str, dims: int) -> DataFrame:
    """One verdict per series from those of its dimensions (``t`` when given, ``predicted``): where all
    agree, the middle time; else the first time at which one class has a majority; else the latest
    verdict."""
    p = F.sort_array(F.collect_list(F.struct("t", "predicted")))
    g = predictions.groupBy(key).agg(p.alias("v"))
    need = dims // 2 + 1
    counted = F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: F.struct(F.element_at("v", i)["t"].alias("t"), F.element_at("v", i)["predicted"].alias("c"), F.size(F.filter(F.slice("v", 1, i), lambda x: x["predicted"] == F.element_at(F.col("v"), i)["predicted"])).alias("n")))
    g = g.withColumn("__c", F.filter(counted, lambda x: x["n"] >= need))
    same = F.size(F.array_distinct(F.transform("v", lambda x: x["predicted"]))) == 1
    mid = F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int"))
    pick = F.when(same, F.struct(mid["t"].alias("t"), mid["predicted"].alias("c"))).when(F.size("__c") > 0, F.struct(F.try_element_at("__c", F.lit(1))["t"].alias("t"), F.try_element_at("__c", F.lit(1))["c"].alias("c"))).otherwise(F.struct(F.element_at("v", -1)["t"].alias("t"), F.element_at("v", -1)["predicted"].alias("c")))
    return g.select(key, pick["t"].alias("t"), pick["c"].alias("predicted"))
