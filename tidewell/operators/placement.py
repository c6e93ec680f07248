"""Placing the operators of a dataflow on the sites of a network. Graphs are small: driver-side."""

from __future__ import annotations

import heapq
import itertools
import math
import random
from dataclasses import dataclass, field


@dataclass
class Network:
    """Sites and latencies; links work in both directions."""

    links: dict[str, dict[str, float]]

    @classmethod
    def of(cls, links: list[tuple[str, str, float]]) -> Network:
        out: dict[str, dict[str, float]] = {}
        for a, b, c in links:
            out.setdefault(a, {})[b] = min(c, out.get(a, {}).get(b, math.inf))
            out.setdefault(b, {})[a] = out[a][b]
        return cls(out)

    def costs(self, source: str) -> dict[str, float]:
        """Cheapest way from a site to every other."""
        best, todo = {source: 0.0}, [(0.0, source)]
        while todo:
            d, u = heapq.heappop(todo)
            if d > best[u]:
                continue
            for v, c in self.links.get(u, {}).items():
                if d + c < best.get(v, math.inf):
                    best[v] = d + c
                    heapq.heappush(todo, (d + c, v))
        return best

    def all_costs(self) -> dict[str, dict[str, float]]:
        return {s: self.costs(s) for s in self.links}


@dataclass
class Workflow:
    """Operators in order, edges, and sites of operators that may not move."""

    operators: list[int]
    edges: list[tuple[int, int]]
    fixed: dict[int, str] = field(default_factory=dict)

    def order(self) -> list[int]:
        from graphlib import TopologicalSorter

        deps: dict[int, set[int]] = {o: set() for o in self.operators}
        for a, b in self.edges:
            deps[b].add(a)
        return list(TopologicalSorter(deps).static_order())

    def inputs(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {o: [] for o in self.operators}
        for a, b in self.edges:
            out[b].append(a)
        return out


def plan_cost(w: Workflow, costs: dict[str, dict[str, float]], place: dict[int, str], aggregate: str = "max", factor: float = 1.0) -> float:
    """Latency until every operator has its input: the largest (max) or total (sum) way in."""
    done: dict[int, float] = {}
    for o in w.order():
        ins = [done[a] + factor * costs[place[a]].get(place[o], math.inf) for a in w.inputs()[o]]
        done[o] = (max(ins) if aggregate == "max" else sum(ins)) if ins else 0.0
    outs = set(w.operators) - {a for a, _ in w.edges}
    return max(done[o] for o in outs) if aggregate == "max" else sum(done[o] for o in outs)


def search(w: Workflow, net: Network, aggregate: str = "max", factor: float = 1.0, keep: int | None = None) -> tuple[dict[int, str], float, int]:
    """Best-first search over partial plans in topological order. A partial plan's bound is its cost so
    far (latencies only grow); ``keep`` expands the k cheapest sites of each step only. Returns the
    plan, its cost and the number of expanded plans."""
    costs, order, ins = net.all_costs(), w.order(), w.inputs()
    sites, tick = sorted(net.links), itertools.count()
    outs = set(w.operators) - {a for a, _ in w.edges}
    heap: list[tuple[float, int, int, dict[int, str], dict[int, float]]] = [(0.0, 0, next(tick), {}, {})]
    expanded = 0
    while heap:
        bound, depth, _, place, done = heapq.heappop(heap)
        if -depth == len(order):
            return place, bound, expanded
        expanded += 1
        o = order[-depth]
        nxt = []
        for s in [w.fixed[o]] if o in w.fixed else sites:
            way = [done[a] + factor * costs[place[a]].get(s, math.inf) for a in ins[o]]
            d = {**done, o: (max(way) if aggregate == "max" else sum(way)) if way else 0.0}
            known = [d[x] for x in outs if x in d]
            low = max(d.values()) if aggregate == "max" else max(sum(known), max(d.values()))
            nxt.append((low, depth - 1, next(tick), {**place, o: s}, d))
        nxt.sort(key=lambda x: x[0])
        for x in nxt[:keep] if keep else nxt:
            heapq.heappush(heap, x)
    raise ValueError("the fixed sites cannot be connected")


def replan(w: Workflow, net: Network, place: dict[int, str], changed: list[tuple[str, str, float]], aggregate: str = "max") -> tuple[dict[int, str], float, Network]:
    """After latencies change: a plan that keeps operators whose ways do not use a changed cost and places
    the others anew, unless a full search, which is run as well, finds a cheaper one."""
    links = {a: dict(b) for a, b in net.links.items()}
    for a, b, c in changed:
        links.setdefault(a, {})[b] = c
        links.setdefault(b, {})[a] = c
    new = Network(links)
    before, after = net.all_costs(), new.all_costs()
    moved = {o for a, b in w.edges for o in (a, b) if before[place[a]].get(place[b]) != after[place[a]].get(place[b])}
    stay = {o: s for o, s in place.items() if o not in moved}
    got, cost, _ = search(Workflow(w.operators, w.edges, {**stay, **w.fixed}), new, aggregate)
    full, best, _ = search(w, new, aggregate)
    return (got, cost, new) if cost <= best else (full, best, new)


def random_walk(w: Workflow, net: Network, seed: int = 1, aggregate: str = "max") -> tuple[dict[int, str], float]:
    """Baseline: every free operator on a site drawn at random from all."""
    rng, sites = random.Random(seed), sorted(net.links)
    place = {o: w.fixed.get(o) or rng.choice(sites) for o in w.operators}
    return place, plan_cost(w, net.all_costs(), place, aggregate)


def spring_relaxation(w: Workflow, net: Network, steps: int = 50, aggregate: str = "max") -> tuple[dict[int, str], float]:
    """Baseline: edges are springs whose force is latency; every free operator moves to the site where
    its springs are shortest, until nothing moves."""
    costs, sites = net.all_costs(), sorted(net.links)
    place = {o: w.fixed.get(o, sites[0]) for o in w.operators}
    near: dict[int, list[int]] = {o: [] for o in w.operators}
    for a, b in w.edges:
        near[a].append(b)
        near[b].append(a)
    for _ in range(steps):
        still = True
        for o in w.operators:
            if o not in w.fixed and near[o]:
                best = min(sites, key=lambda s: (sum(costs[s].get(place[x], math.inf) ** 2 for x in near[o]), s))
                still &= best == place[o]
                place[o] = best
        if still:
            break
    return place, plan_cost(w, costs, place, aggregate)
