"""Steps of stream dataflows as DataFrame verbs: parsing, range and set filters, interpolation,
joins, moving statistics, smoothing, regressions, sketches, and the verbs of visual workflows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ordered import last_known

# -- filters and repair --------------------------------------------------------------------------


def range_filter(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """Rows whose value lies in [low, high]; nulls and NaN are out."""
    c = F.col(column)
    keep = c.isNotNull() & (~F.isnan(c.cast("double")))
    if low is not None:
        keep = keep & (c >= low)
    if high is not None:
        keep = keep & (c <= high)
    return df.filter(keep)


def bloom_words(members: Column, bits: int, hashes: int) -> list[Column]:
    """The bit positions of a value."""
    return [F.pmod(F.xxhash64(F.lit(i), members), F.lit(bits)) for i in range(hashes)]


def set_filter(df: DataFrame, column: str, members: DataFrame, member: str) -> DataFrame:
    """Rows whose value is in the member set, exactly: a left semi join, which Spark turns into a
    broadcast or a runtime bloom filter as far as sizes allow."""
    m = members.select(F.col(member).alias("__m")).filter("__m IS NOT NULL").distinct()
    return df.join(m, F.col(column) == F.col("__m"), "left_semi")


def bloom_filter(df: DataFrame, column: str, members: DataFrame, member: str, bits: int | None = None, hashes: int = 3) -> DataFrame:
    """The approximate filter: all members pass and few others. The filter is a table of its set bits;
    without ``bits`` it has ten for each member, as an approximate count finds them, so that a few
    percent of other values pass whatever the number of members is."""
    if bits is None:
        n = members.agg(F.approx_count_distinct(member)).first()[0]
        bits = max(1 << 12, 1 << (10 * n).bit_length())
    pos = F.explode(F.array(*bloom_words(F.col(member), bits, hashes))).alias("bit")
    on = members.filter(F.col(member).isNotNull()).select(pos).distinct()
    d = df.withColumns({f"__h{i}": b for i, b in enumerate(bloom_words(F.col(column), bits, hashes))})
    bitset = on.withColumnRenamed("bit", "__bit")
    for i in range(hashes):
        d = d.join(bitset, F.col(f"__h{i}") == F.col("__bit"), "left_semi")
    return d.drop(*[f"__h{i}" for i in range(hashes)])


def interpolate(df: DataFrame, keys: list[str], t: str, value: str, width: int | None = None) -> DataFrame:
    """Missing values become the line between the known values around them; at an end, the nearest
    known one; null where a key knows none. ``t`` is a whole number."""
    d = df.withColumn("__k", F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v")))).withColumn("__n", -F.col(t))
    d = last_known(d, keys, [t], "__k", "__a", width, include=True)
    d = last_known(d, keys, ["__n"], "__k", "__b", width, include=True)
    a, b = F.col("__a"), F.col("__b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col(t) - a["t"]) / (b["t"] - a["t"])
    x = F.when(F.col("__k").isNotNull(), F.col("__k.v")).when(a.isNotNull() & b.isNotNull(), line).otherwise(F.coalesce(a["v"], b["v"]))
    return d.withColumn(value, x).drop("__k", "__n", "__a", "__b")


# -- moving statistics ---------------------------------------------------------------------------


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 10, out: str = "moving_average") -> DataFrame:
    """Mean of the last n messages of a key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.avg(value).over(w))


def sliding_regression(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, n: int = 10) -> DataFrame:
    """Slope and intercept of the last n messages; null with fewer than two different x."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumns({"slope": F.regr_slope(F.col(y), F.col(x)).over(w), "intercept": F.regr_intercept(F.col(y), F.col(x)).over(w)})


def kalman(df: DataFrame, keys: list[str], order: list[str], value: str, q: float = 1e-3, r: float = 1e-1, out: str = "smoothed") -> DataFrame:
    """A scalar Kalman filter per key: a fold in order. Rows stream through it sorted; a missing value
    keeps the estimate. A key's fold is sequential by nature."""
    d = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = df.columns
    ki, vi = [names.index(k) for k in keys], names.index(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, x, p = None, None, 1.0
        for b in batches:
            est = []
            for row in b.itertuples(index=False, name=None):
                k = tuple(row[i] for i in ki)
                if k != key:
                    key, x, p = k, None, 1.0
                v = row[vi]
                if v is not None and not pd.isna(v):
                    if x is None:
                        x = float(v)
                    else:
                        p += q
                        g = p / (p + r)
                        x += g * (float(v) - x)
                        p *= 1 - g
                est.append(x)
            yield b.assign(**{out: np.array(est, dtype=object)})

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double"
    return d.mapInPandas(run, ddl)


def residual(df: DataFrame, predicted: str, keys: list[str], order: list[str], value: str, n: int = 10) -> DataFrame:
    """Prediction against the moving average of what came."""
    return moving_average(df, keys, order, value, n).withColumn("residual", F.col(predicted) - F.col("moving_average"))


def periodic_models(df: DataFrame, period: Column, x: str, y: str) -> DataFrame:
    """A linear regression per period: slope, intercept, r2, n."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(period.alias("period")).agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"), F.regr_count(a, b).alias("n"))


def tree_model(df: DataFrame, features: list[str], label: str, depth: int = 4, forest: int = 0, seed: int = 1):  # noqa: ANN201
    """A distributed decision tree (or forest) as a fitted pipeline; rows with nulls are left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    kind = RandomForestClassifier(numTrees=forest, maxDepth=depth, seed=seed, labelCol="__label", featuresCol="__x") if forest else DecisionTreeClassifier(maxDepth=depth, seed=seed, labelCol="__label", featuresCol="__x")
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip"), VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip"), kind]).fit(df)


def hash_split(df: DataFrame, key: str, share: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the key: the same on every run and on every executor."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.filter(u), df.filter(~u)


# -- visual verbs --------------------------------------------------------------------------------

COMPARE = {
    "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "equals": lambda c, v: c == v,
    "is_in": lambda c, v: c.isin(*v), "matches": lambda c, v: c.cast("string").rlike(v), "contains": lambda c, v: c.cast("string").contains(v),
}


def filter_rows(df: DataFrame, conditions: list[tuple[str, str, object]]) -> DataFrame:
    """Rows that meet all (column, comparison, value); an unknown outcome is a no."""
    for col, op, v in conditions:
        df = df.filter(F.coalesce(COMPARE[op](F.col(col), v), F.lit(False)))
    return df


def filter_range(df: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """Rows number first..last (from 1) in the order of a unique whole-number column, exactly: ranges
    of the order are counted, and only the ranges that meet the asked numbers are numbered."""
    block = F.floor(F.col(order) / F.lit(100_000))
    counts = df.filter(F.col(order).isNotNull()).groupBy(block.alias("__b")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).filter((F.col("__base") < last) & (F.col("__base") + F.col("__n") >= first))
    d = df.withColumn("__b", block).join(base, "__b")
    n = F.row_number().over(Window.partitionBy("__b").orderBy(order)) + F.col("__base")
    return d.withColumn("__i", n).filter(F.col("__i").between(first, last)).select(*df.columns)


def to_json(df: DataFrame, out: str = "value") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def from_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON texts as columns; unreadable ones give nulls."""
    return df.select(F.from_json(column, schema).alias("__j")).select("__j.*")


def de_pivot(df: DataFrame, ids: list[str], values: list[str], name: str = "attribute", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def numeric_to_date(df: DataFrame, column: str, out: str, unit: str = "ms") -> DataFrame:
    """Epoch numbers as timestamps."""
    c = F.col(column).cast("long")
    return df.withColumn(out, F.timestamp_millis(c) if unit == "ms" else F.timestamp_seconds(c))


def count_min(df: DataFrame, column: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 1, by: list[str] | None = None) -> DataFrame:
    """A count-min sketch per group, as binary; its size depends on eps and confidence alone."""
    s = F.count_min_sketch(F.col(column).cast("string"), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch")
    return df.groupBy(*(by or [])).agg(s)


def _cells(value: Column, width: int, depth: int) -> Column:
    """The cells of a value: six hexadecimal digits of its MD5 per row of the synopsis, so that any
    system that knows MD5 can read a stored one."""
    if depth > 5:
        raise ValueError("a digest has digits for five rows")
    h = F.md5(value.cast("string"))
    return F.array(*[F.struct(F.lit(d).alias("d"), F.pmod(F.conv(F.substring(h, d * 6 + 1, 6), 16, 10).cast("long"), F.lit(width)).alias("w")) for d in range(depth)])


def count_min_table(df: DataFrame, column: str, width: int = 2048, depth: int = 5, by: list[str] | None = None) -> DataFrame:
    """The same synopsis as rows (by, d, w, n): partial sums merge on the map side and over time. Values
    are counted before they are hashed, so a hot one is hashed once a task and not once a row."""
    n = df.filter(F.col(column).isNotNull()).groupBy(*(by or []), F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    return n.select(*(by or []), "__n", F.explode(_cells(F.col("__v"), width, depth)).alias("c")).groupBy(*(by or []), "c.d", "c.w").agg(F.sum("__n").alias("n"))


def count_min_estimates(sketch: DataFrame, values: DataFrame, column: str, width: int = 2048, depth: int = 5) -> DataFrame:
    """Estimated count of each asked value: the least of its cells. Never below the true count."""
    v = values.select(F.col(column).alias("__v")).filter("__v IS NOT NULL").distinct()
    asked = v.select("__v", F.explode(_cells(F.col("__v"), width, depth)).alias("c")).select("__v", F.col("c.d").alias("d"), F.col("c.w").alias("w"))
    return asked.join(sketch, ["d", "w"], "left").groupBy(F.col("__v").alias(column)).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
