"""Ordered scans per key that a hot key cannot overload.

With ``width`` a key's axis is cut into blocks of that width: a scan runs inside each (key, block),
and what a block needs from earlier ones (a sum, a last value) comes from a scan over one small row
per block. Without ``width`` it is a plain window, which shares its partitioning with the scans
before and after it. ``width_if_hot`` chooses by the rows of the largest key. The axis is a whole
number. A blocked scan reads its input twice, so the input is persisted (its lineage stays, a lost
executor costs a recomputation only); ``spark.catalog.clearCache()`` lets it go.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.skew import largest_key


_LARGEST: dict[tuple, int] = {}


def width_if_hot(df: DataFrame, keys: list[str], width: int, hot_rows: int = 2_000_000) -> int | None:
    """The width if a key of ``df`` holds more rows than one task should scan, else None. The count of a
    plan is taken once per application: it only chooses between two plans with equal results."""
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(keys))
    if key not in _LARGEST:
        if len(_LARGEST) > 1_000:
            _LARGEST.clear()
        _LARGEST[key] = largest_key(df, keys)
    return width if _LARGEST[key] > hot_rows else None


def _block(t: str, width: int) -> Column:
    return F.floor(F.col(t) / F.lit(width)).cast("long")


def _same(a: list[str]) -> Column:
    """Null-safe equality of the keys of two sides called l and r."""
    return reduce(lambda x, y: x & y, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in a], F.lit(True))


def _with_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    extra = [c for c in carry.columns if c not in keys]
    return df.alias("l").join(carry.alias("r"), _same(keys), "left").select("l.*", *[F.col(f"r.`{c}`") for c in extra])


def running_sum(df: DataFrame, keys: list[str], t: str, value: str, out: str, width: int | None = None) -> DataFrame:
    """``out``: the sum of ``value`` over rows up to and including this one, by ``t``; rows must be
    distinct in (keys, t)."""
    if width is None:
        w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(w))
    d = df.withColumn("__blk", _block(t, width)).persist(StorageLevel.MEMORY_AND_DISK)
    inside = Window.partitionBy(*keys, "__blk").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = d.groupBy(*keys, "__blk").agg(F.sum(value).alias("__s")).withColumn("__c", F.sum("__s").over(before)).drop("__s")
    d = _with_carry(d.withColumn(out, F.sum(value).over(inside)), carry, [*keys, "__blk"])
    return d.withColumn(out, F.col(out) + F.coalesce("__c", F.lit(0))).drop("__c", "__blk")


def last_known(df: DataFrame, keys: list[str], t: list[str], value: str, out: str, width: int | None = None, include: bool = False) -> DataFrame:
    """``out``: the latest non-null ``value`` of the rows before this one (or with ``include`` up to
    it) in the order of ``t``, whose first column is the axis."""
    upto = 0 if include else -1
    if width is None:
        w = Window.partitionBy(*keys).orderBy(*t).rowsBetween(Window.unboundedPreceding, upto)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    d = df.withColumn("__blk", _block(t[0], width)).persist(StorageLevel.MEMORY_AND_DISK)
    inside = Window.partitionBy(*keys, "__blk").orderBy(*t).rowsBetween(Window.unboundedPreceding, upto)
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    ends = d.groupBy(*keys, "__blk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*t))).alias("__l"))
    carry = ends.withColumn("__c", F.last("__l", ignorenulls=True).over(before)).drop("__l")
    d = _with_carry(d.withColumn(out, F.last(value, ignorenulls=True).over(inside)), carry, [*keys, "__blk"])
    return d.withColumn(out, F.coalesce(out, "__c")).drop("__c", "__blk")
