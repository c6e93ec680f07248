"""Streaming: automata and runs with state, extendable deadlines, sliding windows, model swaps.

Batch and streaming share the pattern language and the predicates. State is per key: an automaton's
state number, or the open partial matches of a windowed pattern.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators.patterns import Stream
from tidewell.plans.pattern import Compiler, parse, rewrite
from tidewell.sources.events import DOMAINS


def detections(s: Stream, pattern: str, *, overlap: bool = False, expire: str | None = None) -> DataFrame:
    """The automaton of a pattern over a stream: keys, event id and time of each match's end.

    Events of one micro-batch are put in order of (time, id); the state of a key is one number. With
    ``expire`` (a number of seconds as text) a key idle for that long of event time is forgotten, and
    events that come so late are left out.
    """
    spec = parse(pattern)[0]
    comp = Compiler(rewrite(spec.formula))
    table, finals = comp.dfa(overlap)
    keys = s.partition(spec)
    if not keys:
        raise ValueError("a streaming pattern needs partitionBy")
    types = dict(s.df.dtypes)
    d = s.df.select(*keys, F.col(s.id).cast("long").alias("event_id"), F.col(s.time).cast("timestamp").alias("at"), comp.mask_column(s.scope()).alias("mask"))
    if expire:
        d = d.withWatermark("at", f"{expire} seconds")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        q = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for i, at, m in zip(rows["event_id"], rows["at"], rows["mask"], strict=True):
            q = table[q][m]
            if q in finals:
                out.append((*key, i, at))
        state.update((int(q),))
        if expire:
            last = pd.Timestamp(rows["at"].max()).value // 1_000_000
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(float(expire) * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=[*keys, "event_id", "at"])

    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", event_id long, at timestamp"
    timeout = GroupStateTimeout.EventTimeTimeout if expire else GroupStateTimeout.NoTimeout
    return d.groupBy(*keys).applyInPandasWithState(step, ddl, "state int", "append", timeout)


def window_counts(events: DataFrame, time: str, by: list[str], memory: str, step: str, late: str) -> DataFrame:
    """Counts over sliding windows with late events up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, memory, step), *by).agg(F.count("*").alias("n"))


def extendable_sessions(initiations: DataFrame, time: str, keys: list[str], delay: str, late: str) -> DataFrame:
    """Fluents whose deadline every initiation moves: session windows, closed by the watermark."""
    w = F.session_window(time, delay)
    return initiations.withWatermark(time, late).groupBy(*keys, w).agg(F.count("*").alias("initiations")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "initiations")


class ModelSwap:
    """A ``foreachBatch`` function that scores every micro-batch with the newest model known by then.

    ``models``: a callable that returns (model id, columns → columns) for a batch number; metrics of
    each batch and of all batches so far go to ``path`` as parquet, by batch, so a batch that runs
    again overwrites its own result.
    """

    def __init__(self, models, path: str, measure) -> None:  # noqa: ANN001
        self.models, self.path, self.measure = models, path, measure

    def __call__(self, batch: DataFrame, number: int) -> None:
        model_id, apply = self.models(number)
        scored = apply(batch).withColumn("model", F.lit(model_id))
        self.measure(scored).withColumn("batch", F.lit(number)).withColumn("model", F.lit(model_id)).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def cumulative(self, spark, sums: list[str]) -> DataFrame:  # noqa: ANN001
        """The measured counts added up over batches, per batch: one row per batch."""
        from pyspark.sql import Window

        d = spark.read.option("recursiveFileLookup", "true").parquet(self.path)
        w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
        return d.select("batch", "model", *sums, *[F.sum(c).over(w).alias(f"{c}_so_far") for c in sums])


def listen(df: DataFrame, listeners: list[Callable[[DataFrame, int], None]], checkpoint: str, *, to_end: bool = True):  # noqa: ANN201
    """Run a stream and hand every micro-batch of its results to the listeners, in order: (rows, number of
    the batch). A batch may come again after a failure, with the same number and rows."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for f in listeners:
                f(batch, number)
        finally:
            batch.unpersist()

    w = df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if to_end else w).start()
    if to_end:
        q.awaitTermination()
    return q


def nest(source: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], sink: str, checkpoint: str):  # noqa: ANN201
    """A workflow of verbs over a streaming source into a folder of parquet files, exactly once: the
    sink's log goes with the checkpoint."""
    for step in steps:
        source = step(source)
    q = source.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def socket_lines(spark: SparkSession, host: str, port: int, kind: str | None = None) -> DataFrame:
    """Lines from a live socket as a stream; with ``kind`` parsed as events of that domain. A socket can't
    be read twice, so this is for trials; a topic survives failures."""
    d = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return DOMAINS[kind](d) if kind else d


def run_to_end(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there now into a memory table, and return it: for tests and
    replays of files."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return df.sparkSession.table(name)
