"""Maximal intervals of fluents: from points, combined, compared, looked up.

An interval is right-open, [start, end), over whole numbers; an open end is ``INF``. A list of
maximal intervals of one key is sorted, disjoint and non-touching. All functions take and give plain
DataFrames with the key columns, ``start`` and ``end``; null keys are keys of their own; rows with a
null bound or an empty interval are ignored. ``width`` splits hot keys, see ``ordered``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as from_spark

from tidewell.operators.ordered import last_known, running_sum

#: An interval that has not ended.
INF = 2**63 - 1


def next_point(t: Column, step: int = 1) -> Column:
    """The next point of a grid of the given step; INF stays."""
    return F.when(t == INF, F.lit(INF)).otherwise(t + step - F.pmod(t, F.lit(step)))


def prev_point(t: Column, step: int = 1) -> Column:
    """The grid point before an aligned point, else the one below."""
    off = F.pmod(t, F.lit(step))
    return F.when(t == INF, F.lit(INF)).when(off == 0, t - step).otherwise(t - off)


def _clean(x: DataFrame, keys: list[str]) -> DataFrame:
    return x.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter("start IS NOT NULL AND end IS NOT NULL AND start < end")


def from_points(points: DataFrame, keys: list[str], t: str = "t", initiates: str = "initiates", step: int = 1, width: int | None = None) -> DataFrame:
    """Initiation and termination points → maximal intervals by inertia.

    Both take effect at the next point. Where both fall together the termination wins. A repeated
    initiation changes nothing; without a later termination the interval stays open.
    """
    p = points.filter(F.col(t).isNotNull() & F.col(initiates).isNotNull()).select(*keys, next_point(F.col(t).cast("long"), step).alias("__t"), F.col(initiates).alias("__i"))
    p = p.groupBy(*keys, "__t").agg(F.min(F.col("__i").cast("int")).alias("__state"))
    p = last_known(p, keys, ["__t"], "__state", "__was", width).filter(F.col("__state") != F.coalesce("__was", F.lit(0)))
    return _paired(p.withColumn("__up", F.col("__state") == 1), keys, width)


def _paired(changes: DataFrame, keys: list[str], width: int | None) -> DataFrame:
    """Alternating starts (``__up``) and ends at ``__t`` → intervals: the k-th start meets the k-th end."""
    c = running_sum(changes.withColumn("__u", F.col("__up").cast("int")), keys, "__t", "__u", "__k", width)
    out = c.groupBy(*keys, "__k").agg(F.max(F.when(F.col("__up"), F.col("__t"))).alias("start"), F.max(F.when(~F.col("__up"), F.col("__t"))).alias("end"))
    return out.select(*keys, "start", F.coalesce("end", F.lit(INF)).alias("end")).filter("start IS NOT NULL AND start < end")


def _sweep(parts: list[tuple[str, DataFrame]], keys: list[str], rule: Column, width: int | None) -> DataFrame:
    """Count the intervals open at each point, by name (``__c_<name>``), and keep where the rule on the
    counts holds."""
    names = sorted({n for n, _ in parts})
    deltas = None
    for name, x in parts:
        x = _clean(x, keys)
        ends = x.select(*keys, F.inline(F.array(F.struct(F.col("start").alias("__t"), F.lit(1).alias("__d")), F.struct(F.col("end").alias("__t"), F.lit(-1).alias("__d")))))
        ends = ends.filter(F.col("__t") != INF).select(*keys, "__t", *[(F.col("__d") if n == name else F.lit(0)).alias(f"__d_{n}") for n in names])
        deltas = ends if deltas is None else deltas.unionByName(ends)
    net = deltas.groupBy(*keys, "__t").agg(*[F.sum(f"__d_{n}").alias(f"__d_{n}") for n in names])
    for n in names:
        net = running_sum(net, keys, "__t", f"__d_{n}", f"__c_{n}", width)
    net = net.withColumn("__now", rule)
    was = net.withColumns({f"__c_{n}": F.col(f"__c_{n}") - F.col(f"__d_{n}") for n in names}).withColumn("__was", rule)
    return _paired(was.filter("__now <> __was").withColumn("__up", F.col("__now")), keys, width)


def union_all(parts: list[DataFrame], keys: list[str], width: int | None = None) -> DataFrame:
    """Where at least one part holds; touching intervals become one."""
    return _sweep([("a", p) for p in parts], keys, F.col("__c_a") >= 1, width)


def intersect_all(parts: list[DataFrame], keys: list[str], width: int | None = None) -> DataFrame:
    """Where every part holds. Each part's own list is made maximal first."""
    named = [(f"p{i}", p) for i, p in enumerate(parts)]
    rule = reduce(lambda x, y: x & y, [F.col(f"__c_{n}") >= 1 for n, _ in named])
    return _sweep(named, keys, rule, width)


def relative_complement_all(base: DataFrame, parts: list[DataFrame], keys: list[str], width: int | None = None) -> DataFrame:
    """Where the base holds and no part does."""
    if not parts:
        return union_all([base], keys, width)
    return _sweep([("a", base), *[("b", p) for p in parts]], keys, (F.col("__c_a") >= 1) & (F.col("__c_b") == 0), width)


def complement_all(parts: list[DataFrame], keys: list[str], begin: int, width: int | None = None) -> DataFrame:
    """Where no part holds, from ``begin`` on, for every key that occurs in the parts."""
    known = reduce(lambda a, b: a.unionByName(b), [p.select(*keys) for p in parts]).distinct()
    return relative_complement_all(known.withColumns({"start": F.lit(begin).cast("long"), "end": F.lit(INF)}), parts, keys, width)


def from_samples(points: DataFrame, keys: list[str], t: str = "t", step: int = 1, width: int | None = None) -> DataFrame:
    """Points at which a fluent holds → intervals: points at most ``step`` apart belong together; the
    end is the next grid point after the last one."""
    p = points.filter(F.col(t).isNotNull()).select(*keys, F.col(t).cast("long").alias("start")).withColumn("end", next_point(F.col("start"), step))
    p = p.withColumn("end", F.greatest("end", F.col("start") + step))
    out = union_all([p], keys, width)
    if step == 1:
        return out
    return out.withColumn("end", next_point(F.col("end") - step, step))


def longer_than(x: DataFrame, d: int, now: int) -> DataFrame:
    """Strictly longer than ``d``; an open interval is measured up to ``now``."""
    return x.filter(F.least("end", F.lit(now)) - F.col("start") > d)


def shorter_than(x: DataFrame, d: int) -> DataFrame:
    """Strictly shorter than ``d``, closed intervals only."""
    return x.filter((F.col("end") != INF) & (F.col("end") - F.col("start") < d))


def boundaries(x: DataFrame, keys: list[str], step: int = 1, at_bound: bool = False) -> DataFrame:
    """``start`` and ``end`` events: at the point before the bound (when the change was caused), or
    with ``at_bound`` at the bound itself. Open ends give no event."""
    f = (lambda c: c) if at_bound else (lambda c: prev_point(c, step))
    rows = x.select(*keys, F.inline(F.array(F.struct(F.lit("start").alias("event"), F.col("start").alias("t")), F.struct(F.lit("end").alias("event"), F.col("end").alias("t")))))
    return rows.filter(F.col("t") != INF).withColumn("t", f(F.col("t")))


def clip(x: DataFrame, low: int, high: int = INF) -> DataFrame:
    """The parts inside [low, high)."""
    return x.withColumn("start", F.greatest("start", F.lit(low))).withColumn("end", F.least("end", F.lit(high))).filter("start < end")


def lookup(points: DataFrame, x: DataFrame, keys: list[str], t: str = "t", carry: list[str] | None = None, width: int | None = None, before: bool = False) -> DataFrame:
    """Each point with ``hold_start``, ``hold_end`` (and the columns ``carry``) of the last interval
    that starts at or before it (``before``: strictly before), whether or not it still holds.

    An as-of lookup in one ordered scan: lists are disjoint, so no other interval can hold there.
    """
    carry = carry or []
    s = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), *carry)
    side = x.select(*keys, F.col("start").alias("__t"), F.lit(1 if before else -1).alias("__side"), s.alias("__iv"))
    rows = points.select(*keys, F.col(t).cast("long").alias("__t"), F.lit(0).alias("__side"), F.struct(*[F.col(c) for c in points.columns]).alias("__row"))
    both = side.unionByName(rows, allowMissingColumns=True)
    both = last_known(both, keys, ["__t", "__side"], "__iv", "__hit", width).filter("__row IS NOT NULL")
    return both.select("__row.*", F.col("__hit.s").alias("hold_start"), F.col("__hit.e").alias("hold_end"), *[F.col(f"__hit.{c}").alias(c) for c in carry])


def holds_at(points: DataFrame, x: DataFrame, keys: list[str], t: str = "t", negated: bool = False, width: int | None = None) -> DataFrame:
    """The points at which the fluent holds; negated: those at which it doesn't (also if it never
    does for the key)."""
    h = lookup(points, x, keys, t, width=width)
    holds = F.coalesce(F.col(t) < F.col("hold_end"), F.lit(False))
    return h.filter(~holds if negated else holds).drop("hold_start", "hold_end")


# -- Allen relations -----------------------------------------------------------------------------

RELATIONS = ("before", "meets", "starts", "finishes", "during", "overlaps", "equal")


def allen(source: DataFrame, target: DataFrame, relation: str, keys: list[str], width: int | None = None) -> DataFrame:
    """Pairs (keys, start_1, end_1, start_2, end_2) of source and target in the relation.

    Lists are maximal. before: every later target of a source. All others have at most one target
    per source, found by an equality join or by an as-of lookup - never by comparing all pairs.
    """
    a = _clean(source, keys).withColumnsRenamed({"start": "start_1", "end": "end_1"})
    b = _clean(target, keys).withColumnsRenamed({"start": "start_2", "end": "end_2"})
    out = [*keys, "start_1", "end_1", "start_2", "end_2"]
    s1, e1, s2, e2 = (F.col(c) for c in out[-4:])
    if relation in ("meets", "starts", "finishes", "equal", "before"):
        on = {"meets": e1 - 1 == s2, "starts": s1 == s2, "finishes": e1 == e2, "equal": (s1 == s2) & (e1 == e2), "before": s2 >= e1}[relation]
        more = {"meets": e1 - s1 > 1, "starts": e1 < e2, "finishes": s1 > s2}.get(relation, F.lit(True))
        b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
        return a.join(b, same & on & more).select(*out)
    at = {"during": s1, "overlaps": e1 - 1}[relation]
    hit = lookup(a.withColumn("__at", at), target.select(*keys, "start", "end"), keys, "__at", width=width, before=True)
    hit = hit.withColumnsRenamed({"hold_start": "start_2", "hold_end": "end_2"})
    cond = {"during": (s1 > s2) & (e1 < e2), "overlaps": (s1 < s2) & (e1 - 1 > s2) & (e1 < e2)}[relation]
    return hit.filter(cond).select(*out)


def allen_intervals(source: DataFrame, target: DataFrame, relation: str, keys: list[str], mode: str, width: int | None = None) -> DataFrame:
    """Intervals made of the pairs of a relation: mode source, target, union, intersection,
    relative_complement (source without target) or relative_complement_inverse (target without
    source)."""
    pairs = allen(source, target, relation, keys, width)
    one = pairs.select(*keys, F.col("start_1").alias("start"), F.col("end_1").alias("end")).distinct()
    two = pairs.select(*keys, F.col("start_2").alias("start"), F.col("end_2").alias("end")).distinct()
    if mode in ("source", "target"):
        return one if mode == "source" else two
    return {
        "union": lambda: union_all([one, two], keys, width),
        "intersection": lambda: intersect_all([one, two], keys, width),
        "relative_complement": lambda: relative_complement_all(one, [two], keys, width),
        "relative_complement_inverse": lambda: relative_complement_all(two, [one], keys, width),
    }[mode]()


# -- deadlines -----------------------------------------------------------------------------------


def _islands(p: DataFrame, keys: list[str], t: str, gap: int, width: int | None) -> DataFrame:
    """``isle``: number of the run of points that are at most ``gap`` apart."""
    d = last_known(p.withColumn("__v", F.col(t)), keys, [t], "__v", "__p", width)
    d = d.withColumn("__n", F.when(F.col(t) - F.col("__p") <= gap, 0).otherwise(1))
    return running_sum(d, keys, t, "__n", "isle", width).drop("__v", "__p", "__n")


def extendable_deadlines(initiations: DataFrame, keys: list[str], delay: int, t: str = "t", width: int | None = None) -> DataFrame:
    """When a fluent expires if every re-initiation, also one exactly at the deadline, moves its
    deadline: keys, ``t`` = last initiation of a run plus the delay."""
    p = initiations.filter(F.col(t).isNotNull()).select(*keys, F.col(t).cast("long").alias("t")).distinct()
    return _islands(p, keys, "t", delay, width).groupBy(*keys, "isle").agg((F.max("t") + delay).alias("t")).drop("isle")


def greedy_starts(points: DataFrame, keys: list[str], span: int, t: str = "t", strict: bool = False, width: int | None = None) -> DataFrame:
    """The first point of each key, then always the first one at least ``span`` (strict: more than
    ``span``) after the one taken: keys, ``t``.

    Runs of points with larger gaps do not depend on each other and are folded apart, so a hot key is
    split wherever it pauses.
    """
    p = points.filter(F.col(t).isNotNull()).select(*keys, F.col(t).cast("long").alias("t")).distinct()
    d = _islands(p, keys, "t", span, width)

    def taken(t: np.ndarray, _: np.ndarray, state: tuple) -> tuple[list[int], tuple]:
        out, i = [], 0
        if state:
            i = int(np.searchsorted(t, state[0] + span, "right" if strict else "left"))
        while i < len(t):
            out.append(int(t[i]))
            state = (int(t[i]),)
            i = int(np.searchsorted(t, t[i] + span, "right" if strict else "left"))
        return out, state

    return _folded(d.withColumn("up", F.lit(1)), keys, taken, lambda _: [])


def _folded(d: DataFrame, keys: list[str], fold: Callable[[np.ndarray, np.ndarray, tuple], tuple[list[int], tuple]], close: Callable[[tuple], list[int]]) -> DataFrame:
    """Fold the points (t, up) of every run ``isle`` in order: rows stream sorted through a task, which
    holds one batch and the state of one run, and jumps from one point taken to the next."""
    types = dict(d.dtypes)
    d = d.select(*keys, "isle", "t", F.col("up").cast("int").alias("up")).repartition(*keys, "isle").sortWithinPartitions(*keys, "isle", "t")
    n = len(keys)
    schema = pa.schema([*[pa.field(k, from_spark(d.schema[k].dataType)) for k in keys], pa.field("t", pa.int64())])

    def run(batches):  # noqa: ANN001, ANN202
        who, state, last = None, (), None
        for b in batches:
            if not b.num_rows:
                continue
            t, up = b.column(n + 1).to_numpy(False), b.column(n + 2).to_numpy(False)
            ids = [c.dictionary_encode().indices.fill_null(-1).to_numpy(False) for c in b.columns[: n + 1]]
            new = np.zeros(len(t), bool)
            for c in ids:
                new[1:] |= c[1:] != c[:-1]
            heads = np.flatnonzero(np.append(True, new[1:]))
            rows, out = [], []
            for h, e in zip(heads.tolist(), np.append(heads[1:], len(t)).tolist(), strict=True):
                me = tuple(c[h].as_py() for c in b.columns[: n + 1])
                if me != who:
                    if who is not None:
                        end = close(state)
                        out += end
                        rows += [last] * len(end)
                    who, state = me, ()
                got, state = fold(t[h:e], up[h:e], state)
                last = me[:n]
                out += got
                rows += [last] * len(got)
            if out:
                yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], schema.field(i).type) for i in range(n)], pa.array(out, pa.int64())], schema=schema)
        end = close(state) if who is not None else []
        if end:
            yield pa.RecordBatch.from_arrays([*[pa.array([last[i]] * len(end), schema.field(i).type) for i in range(n)], pa.array(end, pa.int64())], schema=schema)

    return d.mapInArrow(run, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "t long"]))


def fixed_deadlines(initiations: DataFrame, terminations: DataFrame, keys: list[str], delay: int, t: str = "t", width: int | None = None) -> DataFrame:
    """When a fluent expires ``delay`` after the initiation that started it: re-initiations while it
    holds are ignored, a termination in between cancels the deadline. keys, ``t``.

    Points are folded in order per run; a pause longer than the delay starts a new run.
    """
    marks = initiations.select(*keys, F.col(t).cast("long").alias("t"), F.lit(1).alias("up")).unionByName(terminations.select(*keys, F.col(t).cast("long").alias("t"), F.lit(0).alias("up")))
    p = marks.filter("t IS NOT NULL").groupBy(*keys, "t").agg(F.min("up").alias("up"))
    d = _islands(p, keys, "t", delay, width)

    def due(t: np.ndarray, up: np.ndarray, state: tuple) -> tuple[list[int], tuple]:
        out, i = [], 0
        ups, downs = np.flatnonzero(up == 1), np.flatnonzero(up == 0)
        since = state[0] if state else None
        while True:
            if since is None:  # the next initiation
                k = int(np.searchsorted(ups, i))
                if k == len(ups):
                    return out, ()
                i = int(ups[k])
                since, i = int(t[i]), i + 1
            end = int(np.searchsorted(t, since + delay))  # the first point at or after the deadline
            k = int(np.searchsorted(downs, i))
            if k < len(downs) and downs[k] < end:  # ended before it
                since, i = None, int(downs[k]) + 1
            elif end < len(t):
                out.append(since + delay)
                since, i = None, max(end, i)
            else:
                return out, (since,)

    return _folded(d, keys, due, lambda s: [s[0] + delay] if s else [])


# -- sliding query windows -----------------------------------------------------------------------


def query_windows(events: DataFrame, t: str, arrival: str, first: int, last: int, step: int, memory: int) -> DataFrame:
    """One row per event and query time that sees it: query times are first, first+step, ..., last;
    the window (q - memory, q] holds events that happened in it and have arrived by q. With memory
    above the step, late events count in later queries; older ones are forgotten."""
    if step < 1 or memory < 1:
        raise ValueError("step and memory are positive")
    low = F.ceil((F.greatest(F.col(t), F.col(arrival)) - first) / F.lit(step))
    low = F.greatest(low, F.lit(0))
    high = F.least(F.ceil((F.col(t) + memory - first) / F.lit(step)) - 1, F.lit((last - first) // step))
    return events.withColumns({"__a": low.cast("int"), "__z": high.cast("int")}).filter("__a <= __z").withColumn("q", F.explode(F.sequence("__a", "__z"))).withColumn("q", F.col("q").cast("long") * step + first).drop("__a", "__z")


def _seen_by(lo: Column, hi: Column, first: int, last: int, step: int) -> Column:
    """The query times in [lo, hi) as an array."""
    a = F.greatest(F.ceil((lo - first) / F.lit(step)), F.lit(0)).cast("long")
    z = F.least(F.ceil((hi - first) / F.lit(step)) - 1, F.lit((last - first) // step)).cast("long")
    return F.when(a <= z, F.transform(F.sequence(a, z), lambda i: i * step + first))


def windowed_fluent(points: DataFrame, keys: list[str], first: int, last: int, step: int, memory: int, *, t: str = "t", arrival: str = "arrival", initiates: str = "initiates", keep: int = 0, width: int | None = None) -> DataFrame:
    """A fluent as it is known at each query time: keys, ``q``, ``start``, ``end``.

    The window of a query is (q - memory, q] and sees what has arrived by q. An interval that holds at
    the window's first point is carried over with its start, so a fluent stays on although its
    initiation is forgotten; a point that arrives after its time has left the window has no effect.
    Intervals that ended before the window are forgotten, with ``keep`` only that much later.

    A point counts from the first query that sees it. All points that ever count and lie before a
    window are known to the query before, so what is carried over follows from one list of intervals:
    no query waits for another. Each point is repeated for memory / step queries.
    """
    if step < 1 or memory < step:
        raise ValueError("the step is positive and the memory no smaller")
    p = points.filter(F.col(t).isNotNull() & F.col(arrival).isNotNull() & F.col(initiates).isNotNull())
    p = p.select(*keys, F.col(t).cast("long").alias("t"), F.col(arrival).cast("long").alias("arrival"), F.col(initiates).cast("boolean").alias("initiates"))
    seen = F.greatest(F.ceil((F.greatest("t", "arrival") - first) / F.lit(step)), F.lit(0)) * step + first
    counted = p.filter((seen <= last) & (F.col("t") > seen - memory))
    base = from_points(counted, keys, width=width)
    after = lambda c, d: F.when(c == INF, F.lit(last + 1)).otherwise(F.least(c + d, F.lit(last + 1)))
    carried = base.withColumn("q", F.explode(_seen_by(F.col("start") + memory - 1, after(F.col("end"), memory - 1), first, last, step)))
    carried = carried.select(*keys, "q", (F.col("start") - 1).alias("t"), F.lit(True).alias("initiates"))
    inside = query_windows(p, "t", "arrival", first, last, step, memory).select(*keys, "q", "t", "initiates")
    out = from_points(inside.unionByName(carried), [*keys, "q"], width=width)
    if keep:
        ended = base.filter(F.col("end") != INF)
        ended = ended.withColumn("q", F.explode(_seen_by(F.col("end") + memory - 1, F.col("end") + memory - 1 + keep, first, last, step)))
        out = out.unionByName(ended.select(out.columns))
    return out


def windowed_boundaries(x: DataFrame, keys: list[str], memory: int, step: int = 1) -> DataFrame:
    """start and end events of a windowed fluent: keys, q, event, t. An interval that only continues from
    before the window gives no start."""
    b = boundaries(x, [*keys, "q"], step)
    return b.filter((F.col("event") == "end") | (F.col("t") > F.col("q") - memory)).filter(F.col("t") <= F.col("q"))
