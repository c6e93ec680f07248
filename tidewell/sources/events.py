"""Event sources: domain line formats as column expressions, a registry of domains, batch and stream.

Every reader gives a row per line with typed columns; unreadable lines give nulls, never an error.
A time of -1 marks a reset row (``event_type`` RESET).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Parser = Callable[[DataFrame], DataFrame]
DOMAINS: dict[str, Parser] = {}


def domain(name: str) -> Callable[[Parser], Parser]:
    """Register a line format: a function from a DataFrame with ``value`` (the line) to columns. This
    is also how one's own format is added."""

    def put(f: Parser) -> Parser:
        DOMAINS[name] = f
        return f

    return put


def _field(i: int, kind: str = "string") -> Column:
    """The i-th comma-separated field of the line, or null."""
    c = F.trim(F.try_element_at(F.split("value", ","), F.lit(i + 1)))
    return c if kind == "string" else c.try_cast(kind)


def _named(name: str, kind: str = "string") -> Column:
    """``name=value`` inside the parentheses of a line."""
    c = F.regexp_extract("value", rf"[(,]\s*{name}\s*=\s*([^,)]*)", 1)
    c = F.when(c != "", F.trim(c))
    return c if kind == "string" else c.try_cast(kind)


def _with_reset(df: DataFrame, ts: str = "ts") -> DataFrame:
    reset = F.col(ts) == -1
    return df.withColumns({"event_type": F.when(reset, F.lit("RESET")).otherwise(F.col("event_type")), ts: F.when(reset, F.lit(0).cast("long")).otherwise(F.col(ts))})


@domain("csv")
def generic_csv(lines: DataFrame) -> DataFrame:
    """type, timestamp."""
    return _with_reset(lines.select(_field(0).alias("event_type"), _field(1, "long").alias("ts"), *_rest(lines)))


@domain("maritime")
def maritime(lines: DataFrame) -> DataFrame:
    """ts, mmsi, lon, lat, speed, heading, cog, annotation[, time of the next complex event]."""
    d = lines.select(F.lit("SampledCritical").alias("event_type"), _field(0, "long").alias("ts"), _field(1).alias("mmsi"), *[_field(i + 2, "double").alias(c) for i, c in enumerate(("lon", "lat", "speed", "heading", "cog"))], _field(7).alias("annotation"), F.coalesce(_field(8, "long"), F.lit(-1).cast("long")).alias("next_ce_timestamp"), *_rest(lines))
    return _with_reset(d)


@domain("stock")
def stock(lines: DataFrame) -> DataFrame:
    """BUY(id=..,name=..,volume=..,price=..,ts=..) and SELL(..)."""
    return lines.select(F.nullif(F.regexp_extract("value", r"^\s*(BUY|SELL)\s*\(", 1), F.lit("")).alias("event_type"), _named("ts", "long").alias("ts"), _named("id", "long").alias("id"), _named("name").alias("name"), _named("volume", "long").alias("volume"), _named("price", "double").alias("price"), *_rest(lines))


@domain("homes")
def homes(lines: DataFrame) -> DataFrame:
    """LOAD(id=..,plugTimestamp=..,value=..,householdId=..)."""
    return lines.select(F.nullif(F.regexp_extract("value", r"^\s*(LOAD)\s*\(", 1), F.lit("")).alias("event_type"), _named("plugTimestamp", "long").alias("ts"), _named("id", "long").alias("id"), _named("value", "double").alias("load"), _named("householdId", "long").alias("household_id"), *_rest(lines))


@domain("taxi")
def taxi(lines: DataFrame) -> DataFrame:
    """TRIP(id=..,dropoffDatetime=..,pickupZone=..,dropoffZone=..,totalAmount=..); zones lose blanks and slashes."""
    zone = lambda n: F.regexp_replace(_named(n), "[ /]", "")
    return lines.select(F.nullif(F.regexp_extract("value", r"^\s*(TRIP)\s*\(", 1), F.lit("")).alias("event_type"), _named("dropoffDatetime", "long").alias("ts"), _named("id", "long").alias("id"), zone("pickupZone").alias("pickup_zone"), zone("dropoffZone").alias("dropoff_zone"), _named("totalAmount", "double").alias("total_amount"), *_rest(lines))


@domain("json")
def json_lines(lines: DataFrame) -> DataFrame:
    """Any JSON object: attributes as a map of texts; a missing timestamp falls back to the id."""
    m = F.from_json("value", "map<string,string>")
    return lines.select(F.lit("GenericJson").alias("event_type"), F.coalesce(m["timestamp"].try_cast("long"), m["id"].try_cast("long")).alias("ts"), m.alias("attributes"), *_rest(lines))


def _rest(lines: DataFrame) -> list[Column]:
    return [F.col(c) for c in lines.columns if c != "value"]


def with_schema(name: str, schema: str) -> None:
    """Register a JSON domain with a fixed schema (a DDL string); ``event_type`` and ``ts`` included."""
    DOMAINS[name] = lambda lines: lines.select(F.from_json("value", schema).alias("__j"), *_rest(lines)).select("__j.*", *_rest(lines))


def read(spark: SparkSession, kind: str, path: str, streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Events of a domain from text files, as a batch or as a stream."""
    if kind not in DOMAINS:
        raise ValueError(f"unknown domain {kind}; known are {sorted(DOMAINS)}")
    r = spark.readStream if streaming else spark.read
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return DOMAINS[kind](r.text(path))


def from_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """An in-memory source."""
    return spark.createDataFrame(rows, schema)


def kafka(spark: SparkSession, topic: str, servers: str, kind: str | None = None, streaming: bool = True, **options: str) -> DataFrame:
    """A topic as events. Needs Spark's Kafka package on the class path; offsets are Spark's. With
    ``kind`` the values are parsed as lines of that domain."""
    r = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    for k, v in options.items():
        r = r.option(k, v)
    d = r.load().withColumn("value", F.col("value").cast("string"))
    return DOMAINS[kind](d) if kind else d


def bounded_offsets(last: int, topic: str = "topic", partition: int = 0) -> str:
    """``endingOffsets`` of a read that must not pass another reader's position."""
    return f'{{"{topic}":{{"{partition}":{last}}}}}'


# -- reasoner records ----------------------------------------------------------------------------


def piped(lines: DataFrame, events: set[str], interval_fluents: set[str], point_fluents: set[str]) -> dict[str, DataFrame]:
    """Pipe-separated records, routed by their type: events type|arrival|t|args…, fluents with
    intervals type|arrival|start|end|value|args…, fluents with points type|arrival|t|value|args…"""
    f = F.split("value", r"\|")
    d = lines.select(f.alias("f"), F.trim(f[0]).alias("type")).filter("type <> ''")

    def num(i: int) -> Column:
        return F.try_element_at("f", F.lit(i + 1)).try_cast("long")

    def args(i: int) -> Column:
        return F.slice("f", i + 1, F.greatest(F.size("f") - i, F.lit(0))).alias("args")

    def of(names: set[str]) -> DataFrame:
        return d.filter(F.col("type").isin(*sorted(names))) if names else d.filter(F.lit(False))

    value = lambda i: F.try_element_at("f", F.lit(i + 1))
    return {
        "events": of(events).select("type", num(1).alias("arrival"), num(2).alias("t"), args(3)),
        "intervals": of(interval_fluents).select("type", num(1).alias("arrival"), num(2).alias("start"), num(3).alias("end"), value(4).alias("value"), args(5)),
        "points": of(point_fluents).select("type", num(1).alias("arrival"), num(2).alias("t"), value(3).alias("value"), args(4)),
    }


def arrived(records: DataFrame, after: int, upto: int) -> DataFrame:
    """Records that arrived in (after, upto]."""
    return records.filter((F.col("arrival") > after) & (F.col("arrival") <= upto))


# -- splits, replay, random ----------------------------------------------------------------------


def split(df: DataFrame, order: str, share: float) -> tuple[DataFrame, DataFrame]:
    """The first share of a stream and the rest, by exact position in a unique whole-number order."""
    from tidewell.operators.dataflow import filter_range

    n = df.count()
    k = int(n * share)
    return filter_range(df, order, 1, k), filter_range(df, order, k + 1, n)


def fold(df: DataFrame, order: str, folds: int, which: int) -> tuple[DataFrame, DataFrame]:
    """(training, test): the which-th of equal consecutive parts is the test."""
    from tidewell.operators.textmine import batches

    n = df.count()
    b = batches(df, order, max(1, -(-n // folds)), "__fold")
    return b.filter(F.col("__fold") != which).drop("__fold"), b.filter(F.col("__fold") == which).drop("__fold")


def replay(df: DataFrame, t: str, cycles: int, start: int | None = None) -> DataFrame:
    """The stream over and over, each time shifted by its span (plus one tick), from ``start`` on."""
    low, high = df.agg(F.min(t), F.max(t)).first()
    span = (high or 0) - (low or 0) + 1
    c = F.explode(F.sequence(F.lit(0), F.lit(cycles - 1)))
    d = df.withColumn("cycle", c).withColumn(t, F.col(t) + F.col("cycle") * span)
    return d.filter(F.col(t) >= start) if start is not None else d


def random_symbols(spark: SparkSession, n: int, probabilities: dict[str, float], seed: int = 1) -> DataFrame:
    """n independent events with given type probabilities, the same for the same seed."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("event_id")), F.lit(2**40)) / F.lit(float(2**40))
    acc, kind, items = 0.0, F.lit(None).cast("string"), list(probabilities.items())
    steps = []
    for name, p in items:
        acc += p
        steps.append((acc, name))
    kind = F.lit(steps[-1][1])
    for a, name in reversed(steps[:-1]):
        kind = F.when(u < a, name).otherwise(kind)
    return spark.range(1, n + 1).withColumnRenamed("id", "event_id").withColumns({"event_type": kind, "ts": F.col("event_id")})


def markov_symbols(spark: SparkSession, n: int, start: dict[str, float], transitions: dict[str, dict[str, float]], streams: int = 8, seed: int = 1) -> DataFrame:
    """Streams of a Markov chain: each is generated by itself, so they run side by side."""
    import random as rnd

    import pandas as pd

    def gen(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for s in b["id"]:
                r = rnd.Random(seed * 1_000_003 + int(s))
                draw = lambda d: r.choices(list(d), list(d.values()))[0]
                out, x = [], draw(start)
                for i in range(n):
                    out.append((int(s), i + 1, i + 1, x))
                    x = draw(transitions[x])
                yield pd.DataFrame(out, columns=["stream", "event_id", "ts", "event_type"])

    return spark.range(0, streams, 1, min(streams, 64)).mapInPandas(gen, "stream long, event_id long, ts long, event_type string")
