"""Train, test and run in three calls (§2.12, A-67): what a service or a notebook needs of the pattern engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import forecast as fc
from tidewell.operators.patterns import Stream, automaton, detect
from tidewell.plans.pattern import Compiler, Spec, parse, rewrite


@dataclass
class Trained:
    """A pattern with its automaton, transition matrix and forecast table."""

    spec: Spec
    table: list[list[int]]
    finals: set[int]
    waits: dict
    theta: float

    def forecasts(self, spark):  # noqa: ANN001, ANN201
        """One forecast per state: the shortest interval whose probability reaches theta."""
        return fc.forecast_table(spark, self.waits, lambda _, w: fc.shortest_forecast(w, self.theta), self.finals)


def train(events: Stream, pattern: str, *, theta: float = 0.5, horizon: int = 40) -> Trained:
    """Learn how long a pattern takes from its states, over all events."""
    spec = parse(pattern)[0]
    table, finals = Compiler(rewrite(spec.formula)).dfa()
    m = fc.matrix(fc.transition_probabilities(fc.transition_counts(automaton(events, spec, states_too=True))), len(table))
    return Trained(spec, table, finals, fc.waiting_times(m, finals, horizon), theta)


def run(events: Stream, pattern: str) -> DataFrame:
    """Detections."""
    return detect(events, pattern)


def test(events: Stream, model: Trained, position: str, keys: list[str]) -> DataFrame:
    """Precision, recall and the like of a model's forecasts over events with a position per key."""
    steps = automaton(events, model.spec, states_too=True)
    if position not in steps.columns:
        steps = steps.join(events.df.select(F.col(events.id).alias("event_id"), position), "event_id")
    f = fc.emit_forecasts(steps, model.forecasts(events.df.sparkSession), position)
    hits = fc.forecast_hits(f, steps.filter("detected"), keys, position)
    return fc.classification_metrics(fc.confusion(hits, F.col("f_positive"), F.col("hit")))
