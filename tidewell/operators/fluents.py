"""Rules over events and fluents: a program of named definitions, evaluated as one lazy plan.

Definitions may use each other; they are ordered by their dependencies (definitions that depend on
each other in a circle are refused here and folded by ``cyclic``). Every entity is a DataFrame with
the key columns, events with ``t``, fluents with ``start`` and ``end``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import intervals as iv

Rule = Callable[[dict[str, DataFrame]], DataFrame]


@dataclass
class _Definition:
    kind: str
    needs: list[str]
    rule: Rule


@dataclass
class Program:
    """keys: columns that name the entity. step: grid of time points. width: see ``ordered``."""

    keys: list[str]
    step: int = 1
    width: int | None = None
    defs: dict[str, _Definition] = field(default_factory=dict)
    facts: dict[str, DataFrame] = field(default_factory=dict)
    hooks: list[Callable[[str, DataFrame], DataFrame]] = field(default_factory=list)

    def preprocess(self, rule: Callable[[str, DataFrame], DataFrame]) -> None:
        """A hook over every input event and fluent before definitions read it: (name, rows) → rows."""
        self.hooks.append(rule)

    def _input(self, name: str, df: DataFrame) -> DataFrame:
        for rule in self.hooks:
            df = rule(name, df)
        return df

    def event(self, name: str, df: DataFrame) -> None:
        """An input event: rows with the keys and ``t``."""
        self._put(name, "event", [], lambda _: self._input(name, df))

    def fluent(self, name: str, df: DataFrame) -> None:
        """An input fluent with intervals."""
        self._put(name, "fluent", [], lambda _: iv.union_all([self._input(name, df)], self.keys, self.width))

    def fact(self, name: str, df: DataFrame) -> None:
        """Static knowledge; rules join it like any table."""
        self.facts[name] = df

    def derived(self, name: str, needs: list[str], rule: Rule) -> None:
        """A derived event: ``rule`` makes its points from what it needs."""
        self._put(name, "event", needs, rule)

    def simple(self, name: str, initiated: list[str], terminated: list[str], *, initially: DataFrame | None = None, values: list[str] | None = None, deadline: int | None = None, extend: bool = True) -> None:
        """A fluent with inertia. ``values``: initiations of these other values of the same fluent end
        it. ``initially``: keys for which it holds from 0. ``deadline``: it ends by itself that long
        after its initiation, with ``extend`` after the last one."""

        def rule(e: dict[str, DataFrame]) -> DataFrame:
            ups = _points(e, initiated, self.keys)
            downs = _points(e, [*terminated, *(values or [])], self.keys) if terminated or values else None
            if initially is not None:
                ups = ups.unionByName(initially.select(*self.keys, F.lit(-1).cast("long").alias("t")))
            if deadline is not None:
                if extend or downs is None:
                    due = iv.extendable_deadlines(ups, self.keys, deadline, width=self.width) if extend else iv.fixed_deadlines(ups, ups.limit(0), self.keys, deadline, width=self.width)
                else:
                    due = iv.fixed_deadlines(ups, downs, self.keys, deadline, width=self.width)
                downs = due if downs is None else downs.unionByName(due)
            marks = ups.withColumn("initiates", F.lit(True))
            if downs is not None:
                marks = marks.unionByName(downs.withColumn("initiates", F.lit(False)))
            return iv.from_points(marks, self.keys, step=self.step, width=self.width)

        self._put(name, "fluent", [*initiated, *terminated, *(values or [])], rule)

    def static(self, name: str, needs: list[str], rule: Rule) -> None:
        """A fluent given by an expression over the intervals of others."""
        self._put(name, "fluent", needs, rule)

    def tree(self, name: str, expr: tuple | str) -> None:
        """A fluent from a tree of ("and"|"or"|"not", ...) over fluent names; "not" stands inside an
        "and", next to what it is taken away from."""
        self._put(name, "fluent", sorted(_names(expr)), lambda e: self._tree(expr, e))

    def _tree(self, x: tuple | str, e: dict[str, DataFrame]) -> DataFrame:
        if isinstance(x, str):
            return e[x]
        op, *parts = x
        if op == "or":
            return iv.union_all([self._tree(p, e) for p in parts], self.keys, self.width)
        if op == "and":
            yes = [self._tree(p, e) for p in parts if not (isinstance(p, tuple) and p[0] == "not")]
            no = [self._tree(p[1], e) for p in parts if isinstance(p, tuple) and p[0] == "not"]
            if not yes:
                raise ValueError("a conjunction needs a part that isn't negated")
            base = yes[0] if len(yes) == 1 else iv.intersect_all(yes, self.keys, self.width)
            return iv.relative_complement_all(base, no, self.keys, self.width) if no else base
        raise ValueError("a negation stands inside a conjunction")

    def _put(self, name: str, kind: str, needs: list[str], rule: Rule) -> None:
        if name in self.defs:
            raise ValueError(f"{name} is defined twice")
        self.defs[name] = _Definition(kind, needs, rule)

    def order(self) -> list[str]:
        """Definitions, each after what it needs."""
        try:
            return list(TopologicalSorter({n: d.needs for n, d in self.defs.items()}).static_order())
        except CycleError as e:
            raise ValueError(f"definitions depend on each other: {e.args[1]}") from e

    def evaluate(self, *names: str) -> dict[str, DataFrame]:
        """The asked entities and what they need."""
        done: dict[str, DataFrame] = dict(self.facts)
        want, todo = set(), list(names)
        while todo:
            n = todo.pop()
            if n not in want:
                want.add(n)
                todo += self.defs[n].needs
        for n in self.order():
            if n in want:
                done[n] = self.defs[n].rule(done)
        return done


def _names(x: tuple | str) -> set[str]:
    return {x} if isinstance(x, str) else {n for p in x[1:] for n in _names(p)}


def _points(e: dict[str, DataFrame], names: list[str], keys: list[str]) -> DataFrame:
    out = None
    for n in names:
        d = e[n].select(*keys, F.col("t").cast("long").alias("t"))
        out = d if out is None else out.unionByName(d)
    return out


def cyclic(events: DataFrame, keys: list[str], fold: Callable[[dict[str, bool], str], dict[str, bool]], fluents: list[str], t: str = "t", name: str = "event") -> DataFrame:
    """Fluents whose definitions depend on each other: one fold per key in order of time.

    ``fold`` gets the truth of every fluent and the name of an event and returns the new truth; a
    change takes effect at the next point. Events of one point are folded in order of their names
    from the same state, and a fluent that one of them ends is off. Each fold is sequential by
    nature, so it runs where the key is; rows are streamed through it sorted, not collected.
    """
    types = dict(events.dtypes)
    out = ", ".join(f"`{k}` {types[k]}" for k in keys)
    d = events.filter(F.col(t).isNotNull()).select(*keys, F.col(t).cast("long").alias("__t"), F.col(name).cast("string").alias("__e"))
    d = d.repartition(*keys).sortWithinPartitions(*keys, "__t", "__e")

    def run(batches):  # noqa: ANN001, ANN202
        who = at = None
        state, begun = dict.fromkeys(fluents, False), {}
        pending: dict[str, set[bool]] = {}
        rows: list[tuple] = []

        def settle() -> None:
            for f, vs in pending.items():
                now = False not in vs
                if now and not state[f]:
                    begun[f] = at + 1
                elif not now and state[f]:
                    rows.append((*who, f, begun[f], at + 1))
                state[f] = now
            pending.clear()

        def close() -> None:
            if who is not None:
                settle()
                rows.extend((*who, f, begun[f], iv.INF) for f in fluents if state[f])

        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                key, point, event = r[:-2], r[-2], r[-1]
                if key != who:
                    close()
                    who, at, state, begun = key, point, dict.fromkeys(fluents, False), {}
                elif point != at:
                    settle()
                    at = point
                for f, v in fold(dict(state), event).items():
                    if v != state[f]:
                        pending.setdefault(f, set()).add(v)
            if len(rows) > 10_000:
                yield pd.DataFrame(rows, columns=[*keys, "fluent", "start", "end"])
                rows = []
        close()
        yield pd.DataFrame(rows, columns=[*keys, "fluent", "start", "end"])

    return d.mapInPandas(run, f"{out}, fluent string, start long, end long")
