"""Per-key results when a few keys hold most rows: exact offset chunking.

1. Count rows per (input partition, key). 2. A prefix sum of these counts over (key, partition)
gives each group's first position. 3. Rows are numbered inside their (partition, key) group; first
position plus number is the exact position of a row in (key, order). 4. Positions are cut into
chunks of equal size, so a hot key fills many chunks and many rare keys share one; each chunk is
processed by itself to one boundary state per key. 5. The states of a key are merged in order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, key: str, order: str | list[str], block: Column, buckets: int) -> DataFrame:
    """Adds ``__bucket`` and ``__pos``, the row's exact 0-based position in (key, order) among the
    keys of its bucket. ``block`` is the input partition: it must not fall as ``order`` rises."""
    rows = rows.withColumn("__block", block)
    counts = rows.groupBy("__block", key).agg(F.count("*").alias("__n"))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    before = Window.partitionBy("__bucket").orderBy(key, "__block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("__bucket", bucket).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("__block", key, "__bucket", "__base")
    numbered = rows.withColumn("__i", F.row_number().over(Window.partitionBy("__block", key).orderBy(*([order] if isinstance(order, str) else order))))
    joined = numbered.join(base.hint("shuffle_merge"), ["__block", key])
    return joined.withColumn("__pos", F.col("__base") + F.col("__i") - 1).drop("__base", "__i", "__block")


def overlapped(rows: DataFrame, key: str, order: str | list[str], block: Column, after: int, chunk: int = 100_000) -> DataFrame:
    """Rows in chunks of equal size, each with the first ``after`` rows of what follows it in its
    bucket: a window over (``__bucket``, ``__chunk``, key) sees for every row with ``__own`` the next
    ``after`` rows of its key."""
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if after > chunk:
        raise ValueError("the overlap is larger than a chunk")
    d = positions(rows, key, order, block, buckets)
    own = F.floor(F.col("__pos") / F.lit(chunk))
    also = F.floor((F.col("__pos") - after) / F.lit(chunk))
    return d.withColumn("__o", own).withColumn("__chunk", F.explode(F.array_distinct(F.array(F.col("__o"), F.greatest(also, F.lit(0)))))).withColumn("__own", F.col("__chunk") == F.col("__o")).drop("__o")


def largest_key(rows: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most; one aggregation with a map-side combine over the keys alone."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] if keys else rows.count()
    return int(n or 0)


def chunked(rows: DataFrame, key: str, order: str, block: Column, process: Callable[[pa.Table], pa.Table], state: str, *, chunk: int = 20_000, buckets: int | None = None) -> DataFrame:
    """Run ``process`` on equal-sized chunks: it gets a chunk's rows sorted by (key, order) and
    gives one state row per key. Returns ``__bucket``, ``__chunk`` and the columns of ``state``."""
    buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = positions(rows, key, order, block, buckets).withColumn("__chunk", F.floor(F.col("__pos") / F.lit(chunk)))

    def run(k: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("__pos", "ascending")])
        out = process(t)
        n = out.num_rows
        return out.add_column(0, "__chunk", pa.repeat(k[1].cast(pa.int64()), n)).add_column(0, "__bucket", pa.repeat(k[0].cast(pa.int32()), n))

    return placed.groupBy("__bucket", "__chunk").applyInArrow(run, f"__bucket int, __chunk long, {state}")


STATE = "pan string, n long, units long, first_id long, last_id long, head long, tail long, changes long, head_run long, tail_run long, best_run long"


def run_states(t: pa.Table) -> pa.Table:
    """Boundary states of the keys in a chunk with columns key, id, units, mark (sorted by key, id):
    count, total, first and last id, first and last mark, changes of the mark, and the lengths of
    the first, last and longest run of equal marks."""
    n = t.num_rows
    code = t.column("key").combine_chunks().dictionary_encode()
    k = code.indices.to_numpy(False)
    ids, units, mark = (t.column(c).to_numpy() for c in ("id", "units", "mark"))
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    end = np.append(head[1:], n)
    run = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (mark[1:] != mark[:-1])))
    length = np.diff(np.append(run, n))
    first_run = np.searchsorted(run, head)
    last_run = np.append(first_run[1:], len(run)) - 1
    cols = [code.dictionary.take(pa.array(k[head])), end - head, np.add.reduceat(units, head), ids[head], ids[end - 1], mark[head], mark[end - 1], last_run - first_run, length[first_run], length[last_run], np.maximum.reduceat(length, first_run)]
    names = [c.split()[0] for c in STATE.split(", ")]
    return pa.table([cols[0], *[pa.array(c.astype(np.int64)) for c in cols[1:]]], names=names)


def _merge(a: Column, b: Column) -> Column:
    same = a["tail"] == b["head"]
    joint = F.when(same, a["tail_run"] + b["head_run"]).otherwise(F.lit(0).cast("long"))
    return F.struct(
        (a["n"] + b["n"]).alias("n"), (a["units"] + b["units"]).alias("units"), a["first_id"].alias("first_id"), b["last_id"].alias("last_id"), a["head"].alias("head"), b["tail"].alias("tail"),
        (a["changes"] + b["changes"] + F.when(same, 0).otherwise(1)).alias("changes"),
        F.when(same & (a["changes"] == 0), joint).otherwise(a["head_run"]).alias("head_run"),
        F.when(same & (b["changes"] == 0), joint).otherwise(b["tail_run"]).alias("tail_run"),
        F.greatest(a["best_run"], b["best_run"], joint).alias("best_run"),
    )


def merge_states(states: DataFrame, key: str = "pan", fan_in: int = 4096, levels: int = 2) -> DataFrame:
    """Merge a key's boundary states in chunk order. The merge is associative, so it runs as a tree:
    a task never holds more than ``fan_in`` states of one key before the last level."""
    fields = [c.split()[0] for c in STATE.split(", ") if not c.startswith(f"{key} ")]
    s = states
    for level in range(levels):
        group = F.floor(F.col("__chunk") / F.lit(fan_in)) if level < levels - 1 else F.lit(0).cast("long")
        keys = [key, "__chunk"] if level < levels - 1 else [key]
        s = s.withColumn("__was", F.col("__chunk")).withColumn("__chunk", group)
        s = s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__was", *fields))).alias("__s"))
        first = F.struct(*[F.col("__s")[0][f].alias(f) for f in fields])
        rest = F.slice("__s", 2, F.greatest(F.size("__s") - 1, F.lit(0)))
        s = s.withColumn("__m", F.aggregate(rest, first, _merge)).select(*keys, *[F.col(f"__m.{f}").alias(f) for f in fields])
    return s


def per_key_runs(rows: DataFrame, key: str, order: str, units: Column, mark: Column, *, block_rows: int = 100_000, chunk: int = 20_000) -> DataFrame:
    """Per key: ``n`` rows, ``units`` total, ``first_id``, ``last_id``, ``changes`` of the mark in
    the order given and ``best_run``, the longest run of equal marks.

    ``order`` is a whole number that is unique (ties: any order among equal ones, the counts and
    totals do not depend on it); rows without order come first, by a hash of their units and mark, which
    also spreads them over blocks. Null marks are a value of their
    own (-1). Null keys are left out. Each task works on ``chunk`` rows, whatever a key holds.
    """
    spread = F.pmod(F.xxhash64(units, mark), F.lit(1 << 40)) - F.lit(2**62)
    spare = F.coalesce(F.col(order).cast("long"), spread)
    r = rows.select(F.col(key).cast("string").alias("key"), spare.alias("id"), units.cast("long").alias("units"), F.coalesce(mark.cast("long"), F.lit(-1)).alias("mark")).filter(F.col("key").isNotNull())
    states = chunked(r, "key", "id", F.floor(F.col("id") / F.lit(block_rows)), run_states, STATE, chunk=chunk)
    return merge_states(states.withColumn("__chunk", F.col("__chunk"))).select("pan", "n", "units", "first_id", "last_id", "changes", "best_run")
