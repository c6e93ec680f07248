"""One feature row per entity from events: count, total and recency for each event type.

Entities of a container get ordinals 0, 1, 2, ... A counter of all entities for one type is kept
bit-sliced: slice j is a bitmap over the ordinals, holding bit j of every entity's counter.
Adding one value to many entities at once is a carry addition over the slices (xor, and), whatever
the number of entities. Bitmaps are compressed: only 64-bit words with at least one entity exist.
Latest event times are arrays aligned with the same cells; together they are decoded to rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the map-side combine holds, and partial rows of one container of entities.
COMBINE_ROWS = 400_000
CONTAINER_ROWS = 200_000
NO_TIME = np.iinfo(np.int64).min
ONE = np.uint64(1)


class BitSliced:
    """Unsigned counters for many cells, stored as bit slices over compressed words."""

    def __init__(self, words: int) -> None:
        self.words, self.slices = words, []

    def add(self, addend: list[np.ndarray]) -> None:
        """Carry addition of another bit-sliced vector over the same words."""
        carry = np.zeros(self.words, np.uint64)
        for j in range(max(len(addend), len(self.slices))):
            if j == len(self.slices):
                self.slices.append(np.zeros(self.words, np.uint64))
            a = self.slices[j]
            if j < len(addend):
                half = a ^ addend[j]
                self.slices[j], carry = half ^ carry, (a & addend[j]) | (carry & half)
            else:
                if not carry.any():
                    return
                self.slices[j], carry = a ^ carry, a & carry
        if carry.any():
            self.slices.append(carry)

    def decode(self, word: np.ndarray, bit: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word), np.int64)
        for j, s in enumerate(self.slices):
            out |= (((s[word] >> bit) & ONE) << np.uint64(j)).astype(np.int64)
        return out


def sliced(values: np.ndarray, word: np.ndarray, bit: np.ndarray, words: int) -> list[np.ndarray]:
    """Bit slices of distinct cells' values; cells sorted by word."""
    out = []
    if not len(values):
        return out
    heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    for j in range(int(values.max()).bit_length()):
        has = ((values >> j) & 1).astype(np.uint64) << bit
        s = np.zeros(words, np.uint64)
        s[word[heads]] = np.bitwise_or.reduceat(has, heads)
        out.append(s)
    return out


def accumulate(key: np.ndarray, n: np.ndarray, total: np.ndarray, latest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (type × ordinal, 64 ordinals a word) with their count, total and latest time.

    The i-th partial of every key forms layer i; layers are carry-added one after another. Positive
    and negative totals have counters of their own.
    """
    order = np.argsort(key, kind="stable")
    key, n, total, latest = key[order], n[order], total[order], latest[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    layer = np.arange(len(key)) - np.repeat(heads, np.diff(np.append(heads, len(key))))
    cells = key[heads]
    uniq, word_of_cell = np.unique(cells >> 6, return_inverse=True)
    cell = np.repeat(np.arange(len(cells)), np.diff(np.append(heads, len(key))))
    word, bit = word_of_cell[cell], (key & 63).astype(np.uint64)
    count, plus, minus = (BitSliced(len(uniq)) for _ in range(3))
    by_layer = np.argsort(layer, kind="stable")
    cuts = np.flatnonzero(np.diff(layer[by_layer])) + 1
    for rows in np.split(by_layer, cuts):
        for to, v in ((count, n[rows]), (plus, np.maximum(total[rows], 0)), (minus, np.maximum(-total[rows], 0))):
            to.add(sliced(v, word[rows], bit[rows], len(uniq)))
    w, b = word_of_cell, (cells & 63).astype(np.uint64)
    return cells, count.decode(w, b), plus.decode(w, b) - minus.decode(w, b), np.maximum.reduceat(latest, heads)


PARTIAL = pa.schema([("e", pa.string()), ("c", pa.int32()), ("n", pa.int64()), ("v", pa.int64()), ("t", pa.int64())])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side combine: partial count, total and latest time per (entity, type) of a bounded buffer."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by(["e", "c"], use_threads=False).aggregate([("n", "sum"), ("v", "sum"), ("t", "max")])
        t = t.select(["e", "c", "n_sum", "v_sum", "t_max"]).rename_columns(PARTIAL.names).cast(PARTIAL)
        yield from t.combine_chunks().to_batches(max_chunksize=65_536)

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= COMBINE_ROWS:
            yield from flush(held)
            held, rows = [], 0
    if rows:
        yield from flush(held)


def _containers(batches: Iterator[pa.RecordBatch], flags: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches sorted by entity → feature rows, one bounded container of whole entities at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= CONTAINER_ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            e = t.column(0).combine_chunks()
            ends = np.flatnonzero(np.asarray(pc.not_equal(e[1:], e[:-1])))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:  # all but the last entity are complete
                yield from _decode(t.slice(0, cut), flags, schema)
            # what is there of the last one is carry-added to one row per cell
            held = [_collapsed(t.slice(cut))]
            rows = held[0].num_rows
    if rows:
        yield from _decode(pa.Table.from_batches(held).combine_chunks(), flags, schema)


def _collapsed(t: pa.Table) -> pa.RecordBatch:
    """The partial rows of one entity as one row per cell."""
    c, n, v, at = (t.column(i).combine_chunks() for i in (1, 2, 3, 4))
    cells, count, total, latest = accumulate((c.to_numpy(False).astype(np.int64) + 1) * 64, n.to_numpy(False), v.to_numpy(False), pc.fill_null(at, NO_TIME).to_numpy(False))
    cols = [pa.repeat(t.column(0)[0].as_py(), len(cells)), pa.array(cells // 64 - 1), pa.array(count), pa.array(total), pa.array(latest, mask=latest == NO_TIME)]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, PARTIAL, strict=True)], schema=PARTIAL)


def _decode(t: pa.Table, flags: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    e = t.column(0).combine_chunks()
    new = np.append(True, np.asarray(pc.not_equal(e[1:], e[:-1])).astype(bool)) if len(e) > 1 else np.array([True])
    ordinal = np.cumsum(new) - 1
    entities = int(ordinal[-1]) + 1
    stride = (entities + 63) // 64 * 64
    c, n, v, at = (t.column(i).combine_chunks() for i in (1, 2, 3, 4))
    c, n, v, at = c.to_numpy(False).astype(np.int64), n.to_numpy(False), v.to_numpy(False), pc.fill_null(at, NO_TIME).to_numpy(False)
    cells, count, total, latest = accumulate(c * stride + ordinal, n, v, at)
    code, who = cells // stride, cells % stride
    everything = np.zeros(entities, np.int64)
    np.add.at(everything, who, count)
    last = np.full(entities, NO_TIME)
    np.maximum.at(last, who, latest)
    shown = np.flatnonzero(code >= 0)
    shown = shown[np.lexsort((code[shown], who[shown]))]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(who[shown], minlength=entities))]).astype(np.int32)
    code, flag = code[shown] // flags, code[shown] % flags
    item = schema.field("features").type.value_type
    feats = pa.StructArray.from_arrays(
        [
            pa.array(code.astype(np.int64)),
            pa.array(flag - 1, pa.int64(), mask=flag == 0),
            pa.array(count[shown]),
            pa.array(total[shown]),
            pa.array(latest[shown], mask=latest[shown] == NO_TIME),
        ],
        fields=list(item),
    )
    out = pa.RecordBatch.from_arrays([e.filter(pa.array(new)), pa.array(everything), pa.array(last, mask=last == NO_TIME), pa.ListArray.from_arrays(pa.array(offsets), feats, type=schema.field("features").type)], schema=schema)
    for k in range(0, out.num_rows, 8_192):
        yield pa.RecordBatch.from_struct_array(out.slice(k, 8_192).to_struct_array())


def entity_features(events: DataFrame, entity: str, code: str, flag: str, value: str, time: str, as_of: Column, scale: int = 2) -> DataFrame:
    """One row per entity: ``n_events``, ``since_ms`` and ``features``, an array of
    (code, flag, n, total, since_ms) for every (code, flag) the entity has, in that order.

    code: whole numbers; only those above 0 become features, but every event counts in ``n_events``.
    flag: 0 or 1 splits the features, null is a third group of its own (other values: likewise null).
    value: whole number of 10^-scale units, null counts as 0. time: epoch milliseconds or null;
    ``since_ms`` is as_of minus the latest time, null if no event of the group is dated.
    Null entities are left out. Absent (code, flag) pairs mean n = 0; ``widened`` spells them out.

    Events are combined on the map side before the one shuffle by entity, so a hot entity arrives
    as one partial row per type and map task. A task holds a bounded container at a time: what has
    come of an entity that is larger is carry-added to one row per type before more is read.
    """
    flags = 3
    f = F.when(F.col(flag).isin(0, 1), F.col(flag).cast("int") + 1).otherwise(F.lit(0))
    c = F.when(F.col(code) > 0, F.col(code).cast("int") * flags + f).otherwise(F.lit(-1))
    rows = events.select(F.col(entity).cast("string").alias("e"), c.alias("c"), F.lit(1).cast("long").alias("n"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("v"), F.col(time).cast("long").alias("t")).filter(F.col("e").isNotNull())
    partial = rows.mapInArrow(_combine, "e string, c int, n long, v long, t long").repartition("e").sortWithinPartitions("e")
    item = pa.struct([("code", pa.int64()), ("flag", pa.int64()), ("n", pa.int64()), ("units", pa.int64()), ("latest", pa.int64())])
    schema = pa.schema([("e", pa.string()), ("n_events", pa.int64()), ("latest", pa.int64()), ("features", pa.list_(item))])
    ddl = "e string, n_events long, latest long, features array<struct<code:long,flag:long,n:long,units:long,latest:long>>"
    out = partial.mapInArrow(lambda it: _containers(it, flags, schema), ddl)
    return out.withColumn("__as_of", as_of).select(
        F.col("e").alias(entity),
        "n_events",
        (F.col("__as_of") - F.col("latest")).alias("since_ms"),
        F.transform("features", lambda x: F.struct(x["code"].alias("code"), x["flag"].alias("flag"), x["n"].alias("n"), (x["units"] / F.lit(float(10**scale))).alias("total"), (F.col("__as_of") - x["latest"]).alias("since_ms"))).alias("features"),
    )


def widened(features: DataFrame, codes: list[int], flags: tuple[int, ...] = (0, 1)) -> DataFrame:
    """The same rows with the columns ``n_<code>_<flag>``, ``total_<code>_<flag>`` and
    ``since_<code>_<flag>`` for each asked pair; absent pairs have 0, 0.0 and null."""
    out = features.withColumn("__m", F.map_from_entries(F.transform(F.filter("features", lambda x: x["flag"].isNotNull()), lambda x: F.struct(x["code"] * 2 + x["flag"], x))))
    cols = []
    for c in codes:
        for f in flags:
            x = F.try_element_at(F.col("__m"), F.lit(2 * c + f).cast("long"))
            cols += [F.coalesce(x["n"], F.lit(0)).alias(f"n_{c}_{f}"), F.coalesce(x["total"], F.lit(0.0)).alias(f"total_{c}_{f}"), x["since_ms"].alias(f"since_{c}_{f}")]
    return out.select(*[k for k in features.columns if k != "features"], *cols)
