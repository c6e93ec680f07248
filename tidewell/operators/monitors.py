"""Monitors of model drift in federated training, and the analysis of their cost.

A drift is a row (client, vec): the difference between a client's model and the shared one.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def square_norm(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def mean_model(drifts: DataFrame, by: list[str] | None = None, vec: str = "vec") -> DataFrame:
    """The average, coordinate by coordinate; coordinates aggregate on the map side."""
    by = by or []
    c = drifts.filter(F.col(vec).isNotNull()).select(*by, F.posexplode(vec).alias("i", "v")).groupBy(*by, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return c.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))


def exact_variance(drifts: DataFrame, by: list[str] | None = None, vec: str = "vec") -> DataFrame:
    """Mean squared norm less the squared norm of the mean: what the estimators bound from above."""
    by = by or []
    m = mean_model(drifts, by, vec)
    s = drifts.groupBy(*by).agg(F.avg(square_norm(F.col(vec))).alias("s"))
    j = s.join(m, by) if by else s.withColumn("mean", m.scalar())
    return j.select(*by, (F.col("s") - square_norm(F.col("mean"))).alias("variance"))


def naive(drifts: DataFrame, by: list[str] | None = None, vec: str = "vec") -> DataFrame:
    """Estimate: mean squared norm."""
    return drifts.groupBy(*(by or [])).agg(F.avg(square_norm(F.col(vec))).alias("estimate"))


def linear(drifts: DataFrame, direction: list[float], by: list[str] | None = None, vec: str = "vec") -> DataFrame:
    """Mean squared norm less the square of the mean along a unit direction."""
    n = sum(x * x for x in direction) ** 0.5 or 1.0
    xi = F.array(*[F.lit(x / n) for x in direction])
    return drifts.groupBy(*(by or [])).agg((F.avg(square_norm(F.col(vec))) - F.pow(F.avg(dot(F.col(vec), xi)), 2)).alias("estimate"))


def largest(drifts: DataFrame, by: list[str] | None = None, vec: str = "vec") -> DataFrame:
    """Estimate: the largest squared norm."""
    return drifts.groupBy(*(by or [])).agg(F.max(square_norm(F.col(vec))).alias("estimate"))


def _hashes(depth: int, seed: int) -> list[tuple[int, int, int, int, int, int]]:
    """Coefficients of a 4-wise independent sign polynomial and of the bucket, per row."""
    rng, p = random.Random(seed), 2_147_483_647
    return [tuple(rng.randrange(1, p) for _ in range(6)) for _ in range(depth)]


def ams_sketch(drifts: DataFrame, by: list[str], width: int = 64, depth: int = 7, seed: int = 1, vec: str = "vec") -> DataFrame:
    """Rows (by, d, w, v) of the AMS sketch of each vector's mean: sketches are linear, so the mean is
    taken over cells, combined on the map side."""
    p = 2_147_483_647
    cells = []
    for d, (a, b, c, e, f, g) in enumerate(_hashes(depth, seed)):
        x = F.col("i").cast("decimal(38,0)")

        def mod(y: Column) -> Column:
            return (y % F.lit(p)).cast("decimal(38,0)")

        sign = mod(mod(mod(mod(F.lit(a) * x + F.lit(b)) * x + F.lit(c)) * x + F.lit(e)))
        w = (mod(F.lit(f) * x + F.lit(g)) % F.lit(width)).cast("int")
        cells.append(F.struct(F.lit(d).alias("d"), w.alias("w"), (F.when(sign % 2 == 0, 1.0).otherwise(-1.0) * F.col("x")).alias("v")))
    n = drifts.filter(F.col(vec).isNotNull()).groupBy(*by).agg(F.count("*").alias("__n")) if by else None
    e = drifts.filter(F.col(vec).isNotNull()).select(*by, F.posexplode(vec).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    # sum per coordinate first: then each coordinate is hashed once, not once per client
    e = e.groupBy(*by, "i").agg(F.sum("x").alias("x"))
    s = e.select(*by, F.explode(F.array(*cells)).alias("c")).groupBy(*by, "c.d", "c.w").agg(F.sum("c.v").alias("v"))
    if by:
        return s.join(n, by).withColumn("v", F.col("v") / F.col("__n")).drop("__n")
    total = drifts.filter(F.col(vec).isNotNull()).agg(F.count("*"))
    return s.withColumn("v", F.col("v") / total.scalar())


def sketched_norm(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Squared norm of the mean: the median of the rows' sums of squares."""
    rows = sketch.groupBy(*by, "d").agg(F.sum(F.col("v") * F.col("v")).alias("s"))
    return rows.groupBy(*by).agg(F.percentile("s", 0.5).alias("norm2"))


def sketch_estimate(drifts: DataFrame, by: list[str], eps: float = 0.1, width: int = 64, depth: int = 7, seed: int = 1, vec: str = "vec") -> DataFrame:
    """Mean squared norm less the sketched squared norm of the mean over 1 + eps."""
    n = sketched_norm(ams_sketch(drifts, by, width, depth, seed, vec), by)
    s = drifts.groupBy(*by).agg(F.avg(square_norm(F.col(vec))).alias("s"))
    return s.join(n, by).select(*by, (F.col("s") - F.col("norm2") / (1 + eps)).alias("estimate"), "norm2")


def synchronise(drifts: DataFrame, theta: float, estimate: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """Groups whose estimate exceeds theta, with the averaged model they go on from."""
    return estimate.filter(F.col("estimate") > theta).join(mean_model(drifts, by, vec), by)


def shards(df: DataFrame, key: str, label: str, clients: int, biased: float = 0.0, seed: int = 1) -> DataFrame:
    """Data for clients: a share ``biased`` goes by label, so equal labels meet at a client, the rest
    evenly at random. All by hashes, without a sort or a shuffle."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1_000_000
    even = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(clients))
    own = F.pmod(F.xxhash64(F.lit(seed + 2), F.col(label)), F.lit(clients))
    return df.withColumn("client", F.when(u < biased, own).otherwise(even).cast("int"))


def label_ordered_shards(df: DataFrame, key: str, label: str, clients: int) -> DataFrame:
    """Data sorted by label and cut into equal parts: ranks come from counts per label and bucket, so
    no task sorts it all."""
    from tidewell.operators.skew import positions

    # one bucket makes positions global; a group is a (block, label) pair, so they stay balanced
    d = positions(df.withColumn("__l", F.coalesce(F.col(label).cast("string"), F.lit(""))), "__l", key, F.floor(F.col(key) / F.lit(100_000)), 1)
    return d.withColumn("client", F.floor(F.col("__pos") * clients / df.select(F.count("*")).scalar()).cast("int")).drop("__pos", "__bucket", "__l")


# -- cost and analysis ---------------------------------------------------------------------------


def communication(df: DataFrame) -> DataFrame:
    """Bytes of a run: synchronisation sends the model there and back for every client and round;
    monitoring sends one number, or a sketch, per client and step."""
    n, w = F.col("num_clients"), F.col("nn_num_weights")
    sync = F.lit(8) * n * w * F.col("total_rounds")
    per = F.when(F.col("fda_name") == "sketch", F.col("sketch_width") * F.col("sketch_depth") + 1).when(F.col("fda_name") == "linear", F.lit(2)).when(F.col("fda_name") == "synchronous", F.lit(0)).otherwise(F.lit(1))
    mon = F.lit(4) * n * per * F.col("total_fda_steps")
    return df.withColumns({"sync_bytes": sync, "monitor_bytes": mon, "total_bytes": sync + mon})


def readable_bytes(c: Column) -> Column:
    """1536 → 1.5 KB."""
    out = F.concat(F.round(c, 1).cast("string"), F.lit(" B"))
    for i, u in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(c >= 1024.0**i, F.concat(F.round(c / 1024.0**i, 1).cast("string"), F.lit(f" {u}"))).otherwise(out)
    return out


def first_reaching(epochs: DataFrame, run: list[str], epoch: str, accuracy: str, goal: float) -> DataFrame:
    """Per run the first epoch that reaches the goal, with its row's other columns; runs that never do
    are left out."""
    rest = [c for c in epochs.columns if c not in run]
    d = epochs.filter(F.col(accuracy) >= goal).groupBy(*run).agg(F.min_by(F.struct(*rest), F.col(epoch)).alias("__r"))
    return d.select(*run, "__r.*")


def grid(spark, **options: list) -> DataFrame:  # noqa: ANN001
    """All combinations of options: a configuration table, as small as its lists."""
    import itertools

    names = list(options)
    kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
    return spark.createDataFrame(list(itertools.product(*options.values())), ", ".join(f"{n} {kinds[type(options[n][0])]}" for n in names))


def running_mean(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return df.withColumn("running_mean", F.avg(value).over(Window.partitionBy(*keys).orderBy(order)))
