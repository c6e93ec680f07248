"""From delivered rows to messages: one row per message number, cleaned fields.

A delivered row's *number* is ``key_trx_no``, else ``trx_no``. Number -1 marks a control message.
Rows with one number are one message, represented by the row with the smallest ``delivery_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control number, seconds/milliseconds border, last representable day 9999-12-31.
CONTROL = -1
SECONDS_BELOW = 100_000_000_000
LAST_MS = 253_402_300_799_999
DAY_MS = 86_400_000
#: Amounts beyond this have no exact two-decimal double.
LARGEST = 9.0e13


def number_of(key: str = "key_trx_no", value: str = "trx_no") -> Column:
    """The message number of a delivered row; null if both columns are null."""
    return F.coalesce(F.col(key), F.col(value)).cast("long")


def clean_pan(pan: str | Column) -> Column:
    """Lower case without white space and hyphens; blank becomes null."""
    c = F.lower(F.regexp_replace(F.col(pan) if isinstance(pan, str) else pan, r"[\s\p{Z}\-]+", ""))
    return F.when(c != "", c)


def event_ms(ts: str | Column) -> Column:
    """Event time in epoch milliseconds. Values below 10^11 are seconds; null, values up to 0 and
    times after the year 9999 give null (undated)."""
    t = (F.col(ts) if isinstance(ts, str) else ts).cast("long")
    return F.when((t > 0) & (t < SECONDS_BELOW), t * 1000).when((t >= SECONDS_BELOW) & (t <= LAST_MS), t)


def units(amount: str | Column, scale: int = 2) -> Column:
    """An amount as a whole number of 10^-scale units, so that sums are exact in any order.
    Null, NaN, infinite amounts and those beyond 9e13 count as 0."""
    a = (F.col(amount) if isinstance(amount, str) else amount).cast("double")
    ok = a.isNotNull() & ~F.isnan(a) & (F.abs(a) <= F.lit(LARGEST))
    return F.when(ok, F.round(F.when(ok, a) * F.lit(float(10**scale))).cast("long")).otherwise(F.lit(0).cast("long"))


def messages(stream: DataFrame, payload: dict[str, Column], *, number: Column | None = None, order: str = "delivery_id") -> DataFrame:
    """One row per message: ``number``, ``order`` and the payload of the winning row.

    Control rows are left out; a row without number is a message of its own. The winner is the
    smallest (order, payload) tuple, so equal orders give a defined result; a null order loses.
    One aggregation with a map-side combine, so a number that holds a third of all rows is reduced
    before the shuffle; rows without number are spread by their own order value.
    """
    num = number_of() if number is None else number
    rows = stream.select(
        num.alias("number"),
        F.coalesce(F.col(order).cast("long"), F.lit(2**63 - 1)).alias("__order"),
        F.struct(*[c.alias(n) for n, c in payload.items()]).alias("__row"),
    ).filter(F.col("number").isNull() | (F.col("number") != CONTROL))
    own = F.when(F.col("number").isNull(), F.when(F.col("__order") == 2**63 - 1, -1 - F.monotonically_increasing_id()).otherwise(F.col("__order")))
    best = rows.withColumn("__own", own).groupBy("number", "__own").agg(F.min(F.struct("__order", "__row")).alias("__best"))
    return best.select("number", F.col("__best.__order").alias(order), *[F.col(f"__best.__row.{n}").alias(n) for n in payload])
