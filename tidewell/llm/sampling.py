"""A sample whose categories have given shares, by divisor-method priorities.

Every candidate gets a random rank inside its category and, per request, the priority
(rank - 0.5) / target. Records of the minimum floor come first, then those with the globally
smallest priorities until the sample is full. A category that runs out simply has no further
priorities, so its seats fall to the others in proportion.

As the ranks of a category with n records are 1..n, the cut through the priorities follows from the
category counts alone: ``seats`` finds it on that small table, and the records are then picked by
rank, without a global sort. Ranks are exact and distributed: a category is cut into buckets of
its random key, bucket counts are summed up to offsets, and numbering happens inside buckets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Records that one bucket of a category's random key holds on average.
BUCKET_ROWS = 20_000


def clean_label(c: str | Column) -> Column:
    """Without white space at either end, in lower case; blank becomes null."""
    x = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(x != "", x)


def clean_language(c: str | Column) -> Column:
    """A language tag likewise, cut before the first hyphen or underscore."""
    return clean_label(F.regexp_extract(clean_label(c), r"^([^-_]*)", 1))


def seats(available: np.ndarray, share: np.ndarray, floor: np.ndarray, rows: int) -> np.ndarray:
    """Records that each category of one request gets.

    Floors come first, as far as records exist, even if they exceed ``rows`` together. The other
    records are those with the smallest (rank - 0.5) / share; equal priorities go to the category
    listed first. A share of 0 gives no seat beyond the floor.
    """
    low = np.minimum(available, np.maximum(floor, 0)).astype(np.int64)
    target = np.where(share > 0, share, 0.0) * rows
    top = np.where(target > 0, available, low).astype(np.int64)
    if rows <= low.sum():
        return low
    if top.sum() <= rows:
        return np.maximum(top, low)

    def at(x: float) -> np.ndarray:
        return np.clip(np.floor(x * target + 0.5).astype(np.int64), low, np.maximum(top, low))

    a, b = 0.0, 1.0
    while at(b).sum() < rows:
        b *= 2
    for _ in range(200):
        mid = (a + b) / 2
        if mid in (a, b):
            break
        a, b = (a, mid) if at(mid).sum() > rows else (mid, b)
    got = at(a)
    while got.sum() < rows:  # equal priorities at the cut: one step each, in order
        with np.errstate(divide="ignore", invalid="ignore"):
            nxt = np.where(got < top, (got + 0.5) / target, np.inf)
        got[int(np.argmin(nxt))] += 1
    return got


def candidates(rows: DataFrame, key: str, strata: dict[str, Column], payload: list[str] | None = None) -> DataFrame:
    """One row per (strata, key); rows with a null key or a null stratum are left out. Of several
    rows alike in these the one smallest in the payload is kept. All other columns of the input are
    ignored; a payload column named like a stratum gives way to the stratum."""
    payload = [p for p in payload or [] if p not in strata]
    r = rows.select(*[c.alias(n) for n, c in strata.items()], F.col(key), *[F.col(p) for p in payload if p != key])
    r = r.filter(F.col(key).isNotNull())
    for s in strata:
        r = r.filter(F.col(s).isNotNull())
    keep = [p for p in payload if p != key]
    if not keep:
        return r.distinct()
    best = r.groupBy(*strata, key).agg(F.min(F.struct(*keep)).alias("__b"))
    return best.select(*strata, key, *[F.col(f"__b.{p}").alias(p) for p in keep])


def allocation(counts: DataFrame, targets: DataFrame, strata: list[str]) -> DataFrame:
    """Per line of the targets: ``available`` records, ``asked`` (the larger of min_rows and
    target_share × sample_rows, rounded half up) and the ``seats`` of its category.

    targets: request_id, the strata as cleaned, target_share, sample_rows, min_rows. Lines of a
    request that name one category are taken together for the seats: the shares add up, the largest
    floor counts. Null shares, sizes and floors count as 0. Other columns of the targets are kept,
    but for those named like the report's own. A request is as small as its lines.
    """
    targets = targets.drop("available", "asked", "seats", "supplied", "selected", "shortfall", "__count")
    t = targets.join(counts, strata, "left").withColumn("available", F.coalesce(F.col("__count"), F.lit(0)).cast("long")).drop("__count")
    wanted = F.greatest(F.coalesce("min_rows", F.lit(0)), F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("sample_rows", F.lit(0))).cast("long"))
    t = t.withColumn("asked", wanted)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        named = pdf[strata].notna().all(axis=1)
        x = pdf.assign(target_share=pdf["target_share"].fillna(0.0), min_rows=pdf["min_rows"].fillna(0))
        g = x[named].sort_values(strata, kind="stable").groupby(strata, sort=False, as_index=False).agg(available=("available", "first"), target_share=("target_share", "sum"), min_rows=("min_rows", "max"))
        rows = int(pdf["sample_rows"].fillna(0).max() or 0)
        g["seats"] = seats(g["available"].to_numpy(np.int64), g["target_share"].to_numpy(float), g["min_rows"].to_numpy(np.int64), rows)
        out = pdf.merge(g[[*strata, "seats"]], how="left", on=strata)
        out["seats"] = out["seats"].where(out[strata].notna().all(axis=1), 0).fillna(0).astype("int64")
        return out

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema) + ", seats long"
    return t.groupBy("request_id").applyInPandas(solve, ddl)


def ranked(cand: DataFrame, key: str, strata: list[str], counts: DataFrame, seed: int) -> DataFrame:
    """Adds ``rank``, a random order 1..n of the records of each category, the same for the same seed.

    Equal random keys are told apart by the record's key. No task sees more than a bucket of a
    category, however large the category is.
    """
    rnd = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(2**53))
    r = cand.join(counts, strata).withColumn("__u", rnd).withColumn("__bucket", F.floor(F.col("__u") * F.ceil(F.col("__count") / F.lit(BUCKET_ROWS))))
    sizes = r.groupBy(*strata, "__bucket").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*strata).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    inside = Window.partitionBy(*strata, "__bucket").orderBy("__u", key)
    r = r.withColumn("__i", F.row_number().over(inside)).join(offsets, [*strata, "__bucket"])
    return r.withColumn("rank", F.col("__offset") + F.col("__i")).drop("__u", "__bucket", "__count", "__offset", "__i")


def stratified_sample(cand: DataFrame, targets: DataFrame, key: str, strata: list[str], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The sample (request_id, strata, key, payload, rank, priority) and the report per target line.

    The report is counted from the ranked records: ``selected`` is what the sample drew of the
    category, ``supplied`` the records whose rank is within what the line asked for, and
    ``shortfall`` what the line asked for and no record could take. ``available`` is the whole category.

    ``cand`` has one row per (strata, key), see ``candidates``. An empty table gives an empty sample
    and a report with nothing available.
    """
    counts = cand.groupBy(*strata).agg(F.count("*").alias("__count"))
    lines = allocation(counts, targets, strata)
    pick = lines.groupBy("request_id", *strata).agg(F.max("seats").alias("__take"), F.max("asked").alias("__most"), (F.sum(F.coalesce("target_share", F.lit(0.0))) * F.max("sample_rows")).alias("__target"))
    wanted = cand.join(targets.select(*strata).distinct(), strata, "left_semi")
    reached = ranked(wanted, key, strata, counts, seed).join(pick, strata).filter(F.col("rank") <= F.greatest("__take", "__most"))
    drawn = F.col("rank") <= F.col("__take")
    priority = F.when(F.col("__target") > 0, (F.col("rank") - 0.5) / F.col("__target"))
    sample = reached.filter(drawn).withColumn("priority", priority).drop("__take", "__most", "__target")
    met = reached.groupBy("request_id", *strata).agg(F.sum(drawn.cast("long")).alias("selected"), F.sum((F.col("rank") <= F.col("__most")).cast("long")).alias("__within"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("request_id", *strata)]
    report = lines.alias("l").join(met.alias("m"), same, "left").select("l.*", F.coalesce("m.selected", F.lit(0)).alias("selected"), F.least(F.col("l.asked"), F.coalesce("m.__within", F.lit(0))).alias("supplied"))
    return sample, report.drop("seats").withColumn("shortfall", F.col("asked") - F.col("supplied"))
