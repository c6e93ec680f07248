"""Recognition of patterns in event streams.

The plan follows the shape of the pattern:
- a strict sequence of single events: one window with a ``lead`` per step;
- skip till next over single events: the next event that passes each step's test, by a windowed
  minimum, one step after another;
- skip till any over single events: range joins on the key inside the pattern's window;
- everything else without registers: an automaton over event masks, run on equal-sized chunks whose
  transition functions are composed, so a hot key is spread over many tasks (end points only);
- everything else with registers or when matched events are asked for: enumeration of runs on chunks
  that overlap by the pattern's window.

Events are ordered by (order columns); ties beyond them are broken by all other columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.geo import Ring
from tidewell.functions.predicates import Scope
from tidewell.operators.ordered import last_known
from tidewell.operators.skew import largest_key, overlapped, positions
from tidewell.plans.pattern import REGISTER_TESTS, TRUE, Atom, Bool, Compiler, Op, Spec, atoms, calls, parse, reads, rewrite, test_column


@dataclass
class Stream:
    """An event table: names of its time, id and (integer) order columns. ``order`` rises with the
    order of events and is unique; ``seconds`` turns the time column into a number for windows."""

    df: DataFrame
    time: str = "ts"
    id: str = "event_id"
    kind: str = "event_type"
    regions: dict[str, Ring] = field(default_factory=dict)
    groups: dict[str, list[str]] = field(default_factory=dict)
    #: seconds of one block of a hot key; rows of a key above which a plan splits keys (0: always)
    block_seconds: int = 86_400
    hot_rows: int = 2_000_000

    def scope(self, at=F.col, bound: dict | None = None) -> Scope:  # noqa: ANN001
        return Scope(frozenset(self.df.columns), at, bound or {}, self.regions, self.groups)

    def stamp(self, c: Column | None = None) -> Column:
        c = F.col(self.time) if c is None else c
        kind = dict(self.df.dtypes)[self.time]
        return F.unix_micros(c.cast("timestamp")) / 1e6 if kind.startswith("timestamp") else c.cast("double")

    def axis(self) -> Column:
        """Time as a whole number (microseconds, or the column's own unit)."""
        kind = dict(self.df.dtypes)[self.time]
        return F.unix_micros(F.col(self.time).cast("timestamp")) if kind.startswith("timestamp") else F.col(self.time).cast("long")

    def width(self) -> int:
        kind = dict(self.df.dtypes)[self.time]
        return self.block_seconds * (1_000_000 if kind.startswith("timestamp") else 1)

    def block(self) -> Column:
        return F.floor(self.axis() / F.lit(self.width()))

    def hot(self, keys: list[str]) -> bool:
        """Does a key hold more rows than one task should scan?"""
        return self.hot_rows == 0 or largest_key(self.df, keys) > self.hot_rows

    def partition(self, spec: Spec) -> list[str]:
        return [] if spec.partition in (None, "$") else [self.scope().column(spec.partition)]


def with_substreams(s: Stream, keys: list[str], reset: str = "RESET") -> DataFrame:
    """Drops reset events; ``substream`` counts those before an event, for its keys. A pattern must
    not reach over a reset, so the count is one more key."""
    w = Window.partitionBy(*keys).orderBy(s.time, s.id)
    d = s.df.withColumn("substream", F.sum(F.when(F.col(s.kind) == reset, 1).otherwise(0)).over(w))
    return d.filter(F.coalesce(F.col(s.kind) != reset, F.lit(True)))


def _steps(spec: Spec) -> tuple[str, list[Atom]] | None:
    """(strategy, steps) if the pattern is a sequence of single events under one strategy."""
    f = spec.formula
    if isinstance(f, Atom):
        return "strict", [f]
    kind = {"any": "any", "next": "next"}.get(f.kind, "strict")
    if kind != "strict":
        f = f.parts[0]
    if isinstance(f, Op) and f.kind == "seq" and all(isinstance(p, Atom) for p in f.parts):
        return kind, list(f.parts)
    return None


def strategy(spec: Spec, enumerate_events: bool = False) -> str:
    """Which plan a pattern gets: chain, next, any, automaton or runs."""
    s = _steps(spec)
    if s:
        return {"strict": "chain", "next": "next", "any": "any"}[s[0]]
    return "runs" if enumerate_events or any(a.register or reads(a) for a in atoms(spec.formula)) else "automaton"


def _within(spec: Spec, n0: Column, n1: Column, t0: Column, t1: Column) -> Column:
    """The window test is strict: a distance below the window."""
    if not spec.window:
        return F.lit(True)
    return (n1 - n0 < spec.window) if spec.window_type == "count" else (t1 - t0 < spec.window)


def chain(s: Stream, spec: Spec) -> DataFrame:
    """Strict sequence of single events: keys, id_1..id_n, start and end time. All matches."""
    steps = _steps(spec)[1]
    keys, cols = s.partition(spec), s.df.columns
    out, parts = s.df, keys
    if len(steps) > 1 and s.hot(keys):
        out = overlapped(out.withColumn("__key", _key(keys)), "__key", [s.time, s.id], s.block(), len(steps) - 1)
        parts = ["__bucket", "__chunk", "__key"]
    w = Window.partitionBy(*parts).orderBy(s.time, s.id)
    for k in range(1, len(steps)):
        out = out.withColumn(f"__{k}", F.lead(F.struct(*cols), k).over(w))
    if parts is not keys:
        out = out.filter("__own")

    def at(k: int):  # noqa: ANN202
        return (lambda c: F.col(c)) if k == 0 else (lambda c: F.col(f"__{k}")[c])

    bound, cond = {}, F.lit(True)
    for k, a in enumerate(steps):
        cond = cond & (F.lit(True) if k == 0 else F.col(f"__{k}").isNotNull()) & test_column(a.test, s.scope(at(k), dict(bound)))
        if a.register:
            bound[a.register] = at(k)
    last = len(steps) - 1
    cond = cond & _within(spec, F.lit(0), F.lit(last), s.stamp(), s.stamp(at(last)(s.time)))
    return out.filter(cond).select(*keys, *[at(k)(s.id).alias(f"id_{k + 1}") for k in range(len(steps))], at(0)(s.time).alias("start_ts"), at(last)(s.time).alias("end_ts"))


def skip_next(s: Stream, spec: Spec) -> DataFrame:
    """Skip till next: each step takes the first later event that passes its test. One pass per step
    over the same partitioning; a register is read from the event it is bound to."""
    steps = _steps(spec)[1]
    keys = s.partition(spec)
    if any(reads(a) for a in steps):
        return skip_any(s, spec, nearest=True)
    count = spec.window and spec.window_type == "count"
    d = s.df
    if count:
        buckets = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        d = positions(d.withColumn("__key", _key(keys)), "__key", [s.time, s.id], s.block(), buckets)
    here = F.struct((F.col("__pos") if count else F.lit(0)).alias("n"), F.col(s.time).alias("t"), F.col(s.id).alias("i"))
    width = s.width() if s.hot(keys) else None
    # time runs backwards here, so "the next event with" is "the last one known with": one linear scan
    d = d.withColumns({"__e": here, "__back": -s.axis(), "__bid": -F.col(s.id)}).withColumn("__p", F.array(F.col("__e")))
    for a in reversed(steps[1:]):
        # the path that starts with the first later event passing this step, if it can be completed
        d = d.withColumn("__ok", F.when(test_column(a.test, s.scope()), F.col("__p")))
        d = last_known(d, keys, ["__back", "__bid"], "__ok", "__f", width)
        d = d.withColumn("__p", F.when(F.col("__f").isNotNull(), F.concat(F.array("__e"), F.col("__f"))))
    # a step's own path may be incomplete (null) and then the first later event passing it is skipped
    # only if no path follows it; as paths end at the end of the stream, later ones cannot be complete
    n = len(steps)
    last = F.col("__p")[n - 1]
    cond = test_column(steps[0].test, s.scope()) & (F.size("__p") == n) & _within(spec, F.col("__p")[0]["n"], last["n"], s.stamp(F.col("__p")[0]["t"]), s.stamp(last["t"]))
    return d.filter(cond).select(*keys, *[F.col("__p")[k]["i"].alias(f"id_{k + 1}") for k in range(n)], F.col("__p")[0]["t"].alias("start_ts"), last["t"].alias("end_ts"))


def skip_any(s: Stream, spec: Spec, nearest: bool = False) -> DataFrame:
    """Skip till any: every combination of events in order inside the window, by range joins.

    Each side is filtered by its own test first. Keys are cut into buckets as long as the window, so
    a join key holds the events of two buckets at most, however many a partition key has. Without a
    window the number of combinations has no bound, and the pattern is refused.
    """
    if not spec.window:
        raise ValueError("skip till any needs a window")
    steps, keys = _steps(spec)[1], s.partition(spec)
    if spec.window_type == "count":
        buckets = int(s.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        d = positions(s.df.withColumn("__key", _key(keys)), "__key", [s.time, s.id], s.block(), buckets)
        d = d.withColumn("__n", F.struct(F.col("__pos").alias("a"), F.lit(0).alias("b"))).withColumn("__t", F.col("__pos"))
    else:
        d = s.df.withColumn("__n", F.struct(F.col(s.time).alias("a"), F.col(s.id).alias("b"))).withColumn("__t", s.stamp())
    d = d.withColumn("__b", F.floor(F.col("__t") / F.lit(spec.window)).cast("long"))
    out, bound = None, {}
    for k, a in enumerate(steps):
        free = not reads(a)
        side = d.filter(test_column(a.test, s.scope())) if free else d
        side = side.select(*[F.col(c).alias(f"__k_{c}") for c in keys], F.struct(*s.df.columns, "__n", "__t").alias(f"__{k}"), F.col("__b").alias(f"__b{k}"))
        if out is None:
            out = side.withColumn("__b", F.explode(F.array(F.col("__b0"), F.col("__b0") + 1)))
        else:
            p, q, o = F.col(f"__{k - 1}"), F.col(f"__{k}"), F.col("__0")
            cond = (F.col("__b") == F.col(f"__b{k}")) & (p["__n"] < q["__n"]) & _within(spec, o["__t"], q["__t"], o["__t"], q["__t"])
            right = side
            for c in keys:
                right = right.withColumnRenamed(f"__k_{c}", f"__r_{c}")
                cond = cond & (F.col(f"__k_{c}") == F.col(f"__r_{c}"))
            out = out.join(right, cond).drop(*[f"__r_{c}" for c in keys])
            if not free:
                out = out.filter(test_column(a.test, s.scope(lambda c, k=k: F.col(f"__{k}")[c], dict(bound))))
            out = out.drop("__b", f"__b{k}")  # a path meets an event in one bucket only, so it is here once
            if nearest:
                mine = Window.partitionBy(*[f"__k_{c}" for c in keys], *[F.col(f"__{j}")["__n"] for j in range(k)]).orderBy(F.col(f"__{k}")["__n"])
                out = out.withColumn("__r", F.row_number().over(mine)).filter("__r = 1").drop("__r")
            if k < len(steps) - 1:  # the next step is looked up from the first event again
                out = out.withColumn("__b", F.explode(F.array(F.col("__b0"), F.col("__b0") + 1)))
        if a.register:
            bound[a.register] = lambda c, k=k: F.col(f"__{k}")[c]
    n = len(steps)
    return out.select(*[F.col(f"__k_{c}").alias(c) for c in keys], *[F.col(f"__{k}")[s.id].alias(f"id_{k + 1}") for k in range(n)], F.col("__0")[s.time].alias("start_ts"), F.col(f"__{n - 1}")[s.time].alias("end_ts"))


def _key(keys: list[str]) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]) if keys else F.lit("")


def automaton(s: Stream, spec: Spec, *, overlap: bool = False, chunk: int = 50_000, states_too: bool = False) -> DataFrame:
    """Detections of any pattern without registers: keys, event id and time of each match's end.

    ``states_too``: every event instead, with ``state`` before it, ``next_state`` after it and
    ``detected``. Three steps: every chunk's transition
    function (the end state for each start state) is computed by itself; the functions of a key are
    composed in order, which gives each chunk's start state; each chunk is run once from there.
    """
    comp = Compiler(rewrite(spec.formula))
    table, finals = comp.dfa(overlap)
    t, fin = np.array(table, np.int32), np.array([q in finals for q in range(len(table))])
    states, keys = len(table), s.partition(spec)
    d = s.df.select(_key(keys).alias("__key"), F.col(s.time).alias("__at"), F.col(s.id).alias("__id"), s.block().alias("__blk"), comp.mask_column(s.scope()).alias("__mask"), F.struct(*keys, s.time, s.id).alias("__row"))
    buckets = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = positions(d, "__key", ["__at", "__id"], F.col("__blk"), buckets).drop("__at", "__id", "__blk").withColumn("__chunk", F.floor(F.col("__pos") / F.lit(chunk)))

    def parts(x: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        k = x.column("__key").combine_chunks().dictionary_encode().indices.to_numpy(False)
        return np.flatnonzero(np.append(True, k[1:] != k[:-1])), x.column("__mask").to_numpy()

    def functions(group: tuple, x: pa.Table) -> pa.Table:
        x = x.sort_by([("__pos", "ascending")])
        heads, mask = parts(x)
        names = x.column("__key").combine_chunks().take(pa.array(heads))
        maps = []
        for a, b in zip(heads, np.append(heads[1:], len(mask)), strict=True):
            f = np.arange(states, dtype=np.int32)
            for m in mask[a:b]:
                f = t[f, m]
            maps.append(f.tolist())
        n = len(heads)
        return pa.table({"__bucket": pa.repeat(group[0].cast(pa.int32()), n), "__chunk": pa.repeat(group[1].cast(pa.int64()), n), "__key": names, "__f": pa.array(maps, pa.list_(pa.int32()))})

    f = placed.select("__bucket", "__chunk", "__key", "__pos", "__mask").groupBy("__bucket", "__chunk").applyInArrow(functions, "__bucket int, __chunk long, __key string, __f array<int>")
    # several chunks only where a key is long; the fold runs over chunks, not events
    maps = F.sort_array(F.collect_list(F.struct("__chunk", "__f")))
    folded = f.groupBy("__bucket", "__key").agg(maps.alias("__m")).withColumn("__q", F.aggregate("__m", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(x["__f"][F.element_at(acc, -1)]))))
    starts = folded.select("__bucket", "__key", F.explode(F.arrays_zip(F.col("__m.__chunk").alias("c"), F.slice("__q", 1, F.size("__m")).alias("q"))).alias("z")).select("__bucket", "__key", F.col("z.c").alias("__chunk"), F.col("z.q").alias("__q"))
    # most chunks start at the start state, so only the others need to be told
    late = starts.filter("__q <> 0").groupBy("__bucket", "__chunk").agg(F.map_from_entries(F.collect_list(F.struct("__key", "__q"))).alias("__starts"))

    def run(group: tuple, x: pa.Table, told: pa.Table) -> pa.Table:
        x = x.sort_by([("__pos", "ascending")])
        heads, mask = parts(x)
        names = x.column("__key").combine_chunks().take(pa.array(heads)).to_pylist()
        begin = dict(told.column("__starts")[0].as_py()) if told.num_rows else {}
        to = np.zeros(len(mask), np.int32)
        was = np.zeros(len(mask), np.int32)
        for name, a, b in zip(names, heads, np.append(heads[1:], len(mask)), strict=True):
            q = begin.get(name, 0)
            for i in range(a, b):
                was[i] = q
                q = to[i] = table[q][mask[i]]
        out = x.select(["__row"]).append_column("state", pa.array(was)).append_column("next_state", pa.array(to)).append_column("detected", pa.array(fin[to]))
        return out if states_too else out.filter(pa.array(fin[to]))

    row = dict(d.dtypes)["__row"]
    found = placed.groupBy("__bucket", "__chunk").cogroup(late.groupBy("__bucket", "__chunk")).applyInArrow(run, f"__row {row}, state int, next_state int, detected boolean")
    return found.select("__row.*", *(["state", "next_state", "detected"] if states_too else []))


def runs(s: Stream, spec: Spec, *, chunk: int = 20_000) -> DataFrame:
    """All matches of any pattern with a count window, with their events: keys, ``ids`` in order and
    the end time. Registers may be read inside iterations.

    Chunks overlap by the window, so each match lies whole inside the chunk of its last event.
    """
    if not spec.window or spec.window_type != "count":
        raise ValueError("the enumeration of runs needs a count window")
    f, w, keys = rewrite(spec.formula), spec.window, s.partition(spec)
    steps = list(dict.fromkeys(atoms(f)))
    plain = [a for a in steps if not reads(a)]
    compared = sorted({c.args[0] for a in steps for c in _reading(a)})
    compared = [(n, s.scope().column(n)) for n in compared]
    d = s.df.select(
        _key(keys).alias("__key"), F.col(s.time).alias("__at"), F.col(s.id).cast("long").alias("__id"), s.block().alias("__blk"), F.struct(*keys, F.col(s.time).alias("end_ts")).alias("__row"),
        F.array(*[test_column(a.test, s.scope()) for a in plain], F.lit(True)).alias("__t"), F.array(*[F.col(c).cast("string") for _, c in compared], F.lit(None).cast("string")).alias("__v"),
    )
    buckets = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = positions(d, "__key", ["__at", "__id"], F.col("__blk"), buckets).drop("__at", "__blk")
    own = F.floor(F.col("__pos") / F.lit(chunk))
    into = F.explode(F.sequence(own, F.floor((F.col("__pos") + (w - 1)) / F.lit(chunk))))
    placed = placed.withColumn("__chunk", into)

    def enumerate_(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__pos")
        lo = int(pdf["__chunk"].iloc[0]) * chunk
        out = []
        for _, g in pdf.groupby("__key", sort=False):
            tests, vals, ids, pos, rows = g["__t"].tolist(), g["__v"].tolist(), g["__id"].tolist(), g["__pos"].tolist(), g["__row"].tolist()
            for i in range(len(ids)):
                for last, used in _matches(f, i, plain, [n for n, _ in compared], tests, vals, min(len(ids), i + w)):
                    if pos[last] >= lo:
                        out.append((rows[last], [ids[j] for j in used]))
        return pd.DataFrame(out, columns=["__row", "ids"])

    row = dict(d.dtypes)["__row"]
    return placed.groupBy("__bucket", "__chunk").applyInPandas(enumerate_, f"__row {row}, ids array<long>").select("__row.*", "ids").distinct()


def _reading(a: Atom) -> list:
    return [c for c in calls(a.test) if c.name in REGISTER_TESTS]


def _matches(f, start: int, plain: list, names: list[str], tests: list, vals: list, stop: int) -> list[tuple[int, tuple[int, ...]]]:  # noqa: ANN001
    """(last event, events taken) of every match that begins at ``start``; events before ``stop``."""
    def holds(test, i: int, regs: tuple) -> bool:  # noqa: ANN001
        if isinstance(test, Bool):
            if test.op == "-":
                return not holds(test.parts[0], i, regs)
            got = [holds(p, i, regs) for p in test.parts]
            return all(got) if test.op == "^" else any(got)
        if test.name not in REGISTER_TESTS:
            return leaf(test, i)
        bound = dict(regs).get(test.args[1].name)
        if bound is None:
            return False
        k = names.index(test.args[0])
        a, b = vals[i][k], vals[bound][k]
        if a is None or b is None:
            return False
        if test.name == "EQAttrStr":
            return a == b
        try:
            a, b = float(a), float(b)
        except ValueError:
            return False
        return {"EQAttr": a == b, "GTAttr": a > b, "LTAttr": a < b}[test.name]

    by_test = {a.test: k for k, a in enumerate(plain)}

    def leaf(test, i: int) -> bool:  # noqa: ANN001
        if test in by_test:
            return bool(tests[i][by_test[test]])
        raise ValueError(f"{test.name} cannot be combined with a register comparison in one sentence here")

    def walk(g, i: int, regs: tuple):  # noqa: ANN001, ANN202
        """Positions after g, with registers and events, from position i."""
        if isinstance(g, Atom):
            if i < stop:
                ok = bool(tests[i][by_test[g.test]]) if g.test in by_test else holds(g.test, i, regs)
                if ok:
                    yield i + 1, (*regs, (g.register, i)) if g.register else regs, () if g.test == TRUE.test else (i,)
            return
        if g.kind == "seq":
            yield from seq(g.parts, i, regs)
        elif g.kind == "choice":
            for p in g.parts:
                yield from walk(p, i, regs)
        elif g.kind == "iter":
            yield i, regs, ()
            for j, r, used in walk(g.parts[0], i, regs):
                if j > i:
                    for k, r2, more in walk(g, j, r):
                        yield k, r2, used + more
        elif g.kind == "neg":
            inside = {j for j, _, _ in walk(g.parts[0], i, regs)}
            for j in range(i, stop + 1):
                if j not in inside:
                    yield j, regs, ()

    def seq(parts, i: int, regs: tuple):  # noqa: ANN001, ANN202
        if not parts:
            yield i, regs, ()
            return
        for j, r, used in walk(parts[0], i, regs):
            for k, r2, more in seq(parts[1:], j, r):
                yield k, r2, used + more

    out = {(end - 1, used) for end, _, used in walk(f, start, ()) if end > start and used and used[0] == start}
    return sorted(out)


def detect(s: Stream, pattern: str | Spec, *, enumerate_events: bool = False, overlap: bool = True) -> DataFrame:
    """One pattern, by the plan its shape asks for."""
    spec = parse(pattern)[0] if isinstance(pattern, str) else pattern
    how = strategy(spec, enumerate_events)
    if how == "chain" and overlap:
        return chain(s, spec)
    if how == "next" and overlap:
        return skip_next(s, spec)
    if how == "any":
        return skip_any(s, spec)
    if how == "runs":
        return runs(s, spec)
    return automaton(s, spec, overlap=overlap)


def detect_all(s: Stream, text: str, *, overlap: bool = True) -> DataFrame:
    """Every pattern of a text: pattern_id (from 0), start and end of each match. The start is null
    where the plan knows only the end."""
    out = None
    for k, spec in enumerate(parse(text)):
        d = detect(s, spec, overlap=overlap)
        start = F.col("start_ts") if "start_ts" in d.columns else F.lit(None).cast(dict(s.df.dtypes)[s.time])
        end = F.col("end_ts") if "end_ts" in d.columns else F.col(s.time)
        d = d.select(F.lit(k).alias("pattern_id"), start.alias("start_ts"), end.alias("end_ts"))
        out = d if out is None else out.unionByName(d)
    return out
