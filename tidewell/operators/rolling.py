"""Totals over trailing periods per entity and day, by block decomposition.

For a period of W days, the days of an entity are cut into blocks of W days. Inside each block a
prefix sum and a suffix sum are formed; the W days that end on day d are the suffix of the block
before (from d-W+1 on) and the prefix of d's block (up to d). So each trailing total is one
addition, whatever W is, and needs no window frame over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a block grid that are computed at once; bounds the memory of a task.
CELLS = 1_000_000


def trailing(days: np.ndarray, values: np.ndarray, starts: np.ndarray, first: np.ndarray, span: np.ndarray, w: int) -> np.ndarray:
    """Trailing totals of the last ``w`` days for every day of each entity, entities one after another.

    days, values: daily totals sorted by entity and day; starts: where each entity begins in them;
    first, span: each entity's first day and number of days.
    """
    base = first // w * w
    blocks = (first + span - 1 - base) // w + 2  # one empty block in front: no sum reaches into another entity
    at = (np.cumsum(blocks) - blocks) * w + w - base  # grid position of a day is at + day
    counts = np.diff(np.append(starts, len(days)))
    grid = np.zeros(int(blocks.sum()) * w, values.dtype)
    grid[np.repeat(at, counts) + days] = values
    grid = grid.reshape(-1, w)
    prefix = np.cumsum(grid, axis=1)
    suffix = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1]
    prefix[1:, :-1] += suffix[:-1, 1:]
    offset = np.cumsum(span) - span
    dense = np.arange(int(span.sum())) - np.repeat(offset - first - at, span)
    return prefix.reshape(-1)[dense]


def _roll(batches: Iterator[pa.RecordBatch], windows: tuple[int, ...], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (entity, day) → one row per entity and day. The last, perhaps unfinished,
    entity of a batch waits for the next batch."""
    keep = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if keep is None else pa.concat_tables([keep, pa.Table.from_batches([batch])])
        t = t.combine_chunks()
        n = t.num_rows
        if not n:
            continue
        ent = t.column(0).combine_chunks()
        change = np.flatnonzero(np.asarray(pc.not_equal(ent[1:], ent[:-1]))) + 1 if n > 1 else np.zeros(0, int)
        if not len(change):
            keep = t
            continue
        yield from _entities(t.slice(0, int(change[-1])), np.concatenate([[0], change[:-1]]), windows, schema)
        keep = t.slice(int(change[-1]))
    if keep is not None and keep.num_rows:
        yield from _entities(keep, np.array([0]), windows, schema)


def _entities(t: pa.Table, starts: np.ndarray, windows: tuple[int, ...], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    days, total, n = (t.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
    ends = np.append(starts[1:], len(days))
    first, span = days[starts], days[ends - 1] - days[starts] + 1
    cost = np.cumsum(span + 2 * max(windows))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + CELLS, "right")))
        a, b = starts[lo], ends[hi - 1]
        d, s, f, w = days[a:b], starts[lo:hi] - a, first[lo:hi], span[lo:hi]
        who = t.column(0).take(pa.array(np.repeat(starts[lo:hi], w)))
        cal = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w - f, w)
        cols = [who.combine_chunks() if isinstance(who, pa.ChunkedArray) else who, pa.array(cal.astype(np.int32))]
        for size in windows:
            cols += [pa.array(trailing(d, total[a:b], s, f, w, size)), pa.array(trailing(d, n[a:b], s, f, w, size))]
        out = pa.RecordBatch.from_arrays([c.cast(x.type) for c, x in zip(cols, schema, strict=True)], schema=schema)
        for k in range(0, out.num_rows, 65_536):
            yield out.slice(k, 65_536)
        lo = hi


def rolling_totals(events: DataFrame, entity: str, day: str, value: str, windows: tuple[int, ...] = (7, 30), scale: int = 2) -> DataFrame:
    """One row per entity and calendar day from the entity's first to its last day.

    ``day`` is a date or a day number (days since 1970-01-01), ``value`` a whole number of
    10^-scale units. Returns ``entity``, ``cal_day`` (date) and, for each window w, ``n_w``,
    ``total_w`` and ``avg_w`` (per day, over all w days), also on days without an event.

    Rows with a null entity or day are left out; a null value counts as 0. An empty input gives an
    empty result. Other columns of ``events`` are ignored, so names cannot clash.

    Daily totals are aggregated with a map-side combine, so a hot entity crosses the network as one
    row per day and map task; what follows is bounded by the calendar, not by the events.
    """
    if not windows or any(int(w) != w or w < 1 for w in windows):
        raise ValueError("windows must be whole numbers of days, 1 or more")
    kind = dict(events.dtypes)[day]
    number = F.unix_date(F.col(day)) if kind == "date" else F.col(day).cast("int")
    daily = (
        events.select(F.col(entity).cast("string").alias("e"), number.alias("d"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("v"))
        .filter(F.col("e").isNotNull() & F.col("d").isNotNull())
        .groupBy("e", "d")
        .agg(F.sum("v").alias("v"), F.count("*").alias("n"))
        .repartition("e")
        .sortWithinPartitions("e", "d")
    )
    schema = pa.schema([("e", pa.string()), ("d", pa.int32())] + [(f"{p}{w}", pa.int64()) for w in windows for p in ("v", "n")])
    ws = tuple(int(w) for w in windows)
    ddl = "e string, d int, " + ", ".join(f"v{w} long, n{w} long" for w in ws)
    dense = daily.mapInArrow(lambda it: _roll(it, ws, schema), ddl)

    def cols(w: int) -> list[Column]:
        total = F.col(f"v{w}") / F.lit(float(10**scale))
        return [F.col(f"n{w}").alias(f"n_{w}"), total.alias(f"total_{w}"), (total / F.lit(float(w))).alias(f"avg_{w}"), F.col(f"v{w}").alias(f"units_{w}")]

    return dense.select(F.col("e").alias(entity), F.date_from_unix_date("d").alias("cal_day"), *[c for w in ws for c in cols(w)])
