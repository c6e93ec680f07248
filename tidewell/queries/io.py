"""Source, sink and streaming queries (S-01 … S-26 and the streaming parts of A, B, C)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.forecast import confusion
from tidewell.operators.patterns import Stream
from tidewell.queries import Registry
from tidewell.queries.patterns import A26
from tidewell.session import shared_dir, table
from tidewell.sources import events as ev
from tidewell.sources import topics
from tidewell.sources import tables as tb
from tidewell.streaming import engine

R = Registry()


def _lines(spark: SparkSession, sf: str, text) -> DataFrame:  # noqa: ANN001
    """The events of the tables as lines of a domain, with their id."""
    return table(spark, sf, "events").select("event_id", text.alias("value"))


def _sec():  # noqa: ANN202
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)


SEC = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"


@R.add("s02_csv", f"SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'RESET' ELSE event_type END AS event_type, CASE WHEN event_id % 50 = 0 THEN 0 ELSE {SEC} END AS ts FROM events")
def s02_csv(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws(",", "event_type", F.when(F.col("event_id") % 50 == 0, F.lit(-1)).otherwise(_sec()).cast("string"))
    return ev.DOMAINS["csv"](_lines(spark, sf, line)).select("event_id", "event_type", "ts")


@R.add("s03_maritime", f"SELECT event_id, CAST(user_id AS VARCHAR) AS mmsi, {SEC} AS ts, value AS speed, CASE WHEN event_id % 2 = 0 THEN event_id ELSE -1 END AS next_ce_timestamp FROM events")
def s03_maritime(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws(",", _sec(), "user_id", F.lit("-4.5"), F.lit("48.4"), "value", F.lit("90"), F.lit("91"), "event_type", F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")))
    return ev.DOMAINS["maritime"](_lines(spark, sf, line)).select("event_id", "mmsi", "ts", "speed", "next_ce_timestamp")


@R.add("s04_stock", f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS event_type, event_type AS name, user_id AS volume, value AS price, {SEC} AS ts FROM events")
def s04_stock(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL"), F.lit("(id="), "event_id", F.lit(",name="), "event_type", F.lit(",volume="), "user_id", F.lit(",price="), "value", F.lit(",ts="), _sec(), F.lit(")"))
    return ev.DOMAINS["stock"](_lines(spark, sf, line)).select("event_id", "event_type", "name", "volume", "price", "ts")


@R.add("s05_homes", f"SELECT event_id, 'LOAD' AS event_type, user_id AS household_id, value AS load, {SEC} AS ts FROM events")
def s05_homes(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("LOAD(id="), "event_id", F.lit(",plugTimestamp="), _sec(), F.lit(",value="), "value", F.lit(",householdId="), "user_id", F.lit(")"))
    return ev.DOMAINS["homes"](_lines(spark, sf, line)).select("event_id", "event_type", "household_id", "load", "ts")


@R.add("s06_taxi", f"SELECT event_id, event_type || 'North' AS pickup_zone, value AS total_amount, {SEC} AS ts FROM events")
def s06_taxi(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("TRIP(id="), "event_id", F.lit(",dropoffDatetime="), _sec(), F.lit(",pickupZone="), "event_type", F.lit(" / North,dropoffZone=X,totalAmount="), "value", F.lit(")"))
    return ev.DOMAINS["taxi"](_lines(spark, sf, line)).select("event_id", "pickup_zone", "total_amount", "ts")


@R.add("s07_json", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE user_id END AS ts, event_type AS kind FROM events")
def s07_json(spark: SparkSession, sf: str) -> DataFrame:
    """A missing timestamp falls back to the id."""
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("timestamp"), F.col("event_type").alias("kind")))
    return ev.DOMAINS["json"](_lines(spark, sf, line)).select("event_id", "ts", F.col("attributes")["kind"].alias("kind"))


@R.add("s10_random", "SELECT 20000 AS n, 0.5 AS a, 0.3 AS b, 0.67 AS chain")
def s10_random(spark: SparkSession, sf: str) -> DataFrame:
    """The shares of a seeded random stream and of a Markov chain with the stationary share 2/3."""
    d = ev.random_symbols(spark, 20000, {"A": 0.5, "B": 0.3, "C": 0.2})
    m = ev.markov_symbols(spark, 500, {"A": 1.0}, {"A": {"B": 1.0}, "B": {"A": 0.5, "B": 0.5}})
    share = m.agg(F.avg((F.col("event_type") == "B").cast("double"))).scalar()
    of = lambda x: F.round(F.avg((F.col("event_type") == x).cast("double")), 2)
    return d.agg(F.count("*").alias("n"), of("A").alias("a"), of("B").alias("b")).withColumn("chain", F.round(share, 2))


@R.add("s11_split", "WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k, count(*) OVER () AS n FROM events) SELECT CASE WHEN k <= floor(n * 0.7) THEN 'first' ELSE 'rest' END AS part, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM n GROUP BY 1")
def s11_split(spark: SparkSession, sf: str) -> DataFrame:
    a, b = ev.split(table(spark, sf, "events"), "event_id", 0.7)
    agg = lambda d, p: d.agg(F.lit(p).alias("part"), F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))
    return agg(a, "first").unionByName(agg(b, "rest"))


@R.add("s12_round_trip", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def s12_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as CSV and as JSON texts, read back (S-12, S-15, S-22, S-25)."""
    path, e = shared_dir(spark), table(spark, sf, "events").select("event_id", "event_type", "value")
    tb.write_events(e, f"{path}/csv")
    tb.csv_to_parquet(spark, f"{path}/csv", f"{path}/parquet", "event_id long, event_type string, value double")
    tb.write_texts(spark.read.parquet(f"{path}/parquet"), f"{path}/texts")
    ev.with_schema("own", "event_id long, event_type string, value double")
    return ev.read(spark, "own", f"{path}/texts").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@R.add("s16_piped", f"SELECT 'events' AS kind, count(*) AS n, CAST(sum({SEC}) AS BIGINT) AS t FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT 'points', count(*), CAST(sum({SEC}) AS BIGINT) FROM events WHERE event_type = 'error'")
def s16_piped(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the reasoner, routed by type (S-16, S-17, S-18)."""
    line = F.when(F.col("event_type") == "error", F.concat_ws("|", "event_type", _sec(), _sec(), F.lit("true"), "user_id")).otherwise(F.concat_ws("|", "event_type", _sec(), _sec(), "user_id"))
    got = ev.piped(_lines(spark, sf, line), {"view", "click"}, set(), {"error"})
    out = None
    for k in ("events", "points"):
        d = ev.arrived(got[k], 0, 2**60).agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.sum("t").alias("t"))
        out = d if out is None else out.unionByName(d)
    return out


@R.add("s21_replay", "WITH b AS (SELECT event_id, (SELECT max(event_id) - min(event_id) + 1 FROM events) AS span FROM events) SELECT cycle, count(*) AS n, min(event_id + cycle * span) AS low, max(event_id + cycle * span) AS high FROM b, (SELECT unnest(range(3)) AS cycle) GROUP BY 1")
def s21_replay(spark: SparkSession, sf: str) -> DataFrame:
    return ev.replay(table(spark, sf, "events").select("event_id"), "event_id", 3).groupBy("cycle").agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


@R.add("s23_series", "SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, 64 AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) AS total FROM embeddings")
def s23_series(spark: SparkSession, sf: str) -> DataFrame:
    """Series as wide lines and back."""
    e = table(spark, sf, "embeddings")
    lines = e.select(F.col("vec_id").alias("line"), F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ",")).alias("value"))
    return tb.series_lines(lines).select("id", "label", F.size("vec").alias("n"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@R.add("s09_rows", "SELECT * FROM (VALUES (1, 'view', 5), (2, 'click', 6)) t(event_id, event_type, ts)")
def s09_rows(spark: SparkSession, sf: str) -> DataFrame:
    """An in-memory source."""
    return ev.from_rows(spark, [(1, "view", 5), (2, "click", 6)], "event_id int, event_type string, ts int")


@R.add("s13_timed_replay", f"SELECT event_id, CAST(floor(({SEC} - (SELECT min({SEC}) FROM events)) * 1000 / 60.0) AS BIGINT) AS send_ms, {SEC} + 3600 AS t FROM events")
def s13_timed_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A replay at sixty times the real speed, an hour later."""
    e = table(spark, sf, "events").select("event_id", _sec().cast("long").alias("t"))
    return topics.timed_replay(e, "t", 60.0, 3600)


@R.add("s15_statistics", "SELECT event_type, count(*) AS detections, 2 AS runs FROM events GROUP BY 1")
def s15_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of two runs appended to one CSV and read back."""
    path = shared_dir(spark)
    s = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("detections"))
    for run in (1, 2):
        tb.append_statistics(s.withColumn("run", F.lit(run)), path)
    back = spark.read.csv(path, header=True, schema="event_type string, detections long, run int")
    return back.groupBy("event_type").agg((F.sum("detections") / 2).cast("long").alias("detections"), F.countDistinct("run").alias("runs"))


@R.add("s24_tsv", r"SELECT lower(event) AS event, count(*) AS n FROM train_df WHERE tweet_text IS NOT NULL AND event IS NOT NULL AND regexp_matches(event, '^[A-Za-z]+$') GROUP BY 1")
def s24_tsv(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled tweets written as tab-separated text and read back."""
    path = shared_dir(spark)
    t = table(spark, sf, "train_df").filter("tweet_text IS NOT NULL AND event IS NOT NULL AND event RLIKE '^[A-Za-z]+\\\\z'")
    tb.write_tsv(t.select("event", F.regexp_replace("tweet_text", r"[\s\"]+", " ").alias("tweet_text"), "tweet_language"), path)
    return tb.tweets_tsv(spark, path).groupBy(F.lower("event").alias("event")).agg(F.count("*").alias("n"))


@R.add("s26_tabular", "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1")
def s26_tabular(spark: SparkSession, sf: str) -> DataFrame:
    """A table with question marks for missing values; rows with any are dropped."""
    path = shared_dir(spark)
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" "), "c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 7 == 0, "?").otherwise(F.col("c_acctbal").cast("string")).alias("balance"))
    c.write.csv(path, header=True)
    t = tb.tabular_csv(spark, path, "c_custkey long, segment string, balance double")
    return t.groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("total"))


def _topic(spark: SparkSession, sf: str) -> topics.FileTopic:
    t = topics.FileTopic(spark, shared_dir(spark))
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", _sec().cast("long").alias("t"))
    t.produce(e, "event_id", F.col("t"), F.col("user_id"))
    end = spark.createDataFrame([(1,)], "k long")
    t.produce(end, "k", F.lit(0), value=F.lit(topics.TERMINATE))
    t.produce(e.limit(5), "event_id", F.col("t"))
    return t


@R.add("s08_topic", f"SELECT event_type, count(*) AS n, min(k) AS low, max(k) AS high FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) GROUP BY 1")
def s08_topic(spark: SparkSession, sf: str) -> DataFrame:
    """A topic read from its begin until the terminating record (S-08)."""
    d = _topic(spark, sf).consume()
    return d.groupBy(F.get_json_object("value", "$.event_type").alias("event_type")).agg(F.count("*").alias("n"), F.min("offset").alias("low"), F.max("offset").alias("high"))


@R.add("s20_bus", f"SELECT count(*) AS n, min(k) AS low, max(k) AS high, CAST(sum(user_id) AS BIGINT) AS users FROM (SELECT user_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) WHERE k BETWEEN 50 AND 149")
def s20_bus(spark: SparkSession, sf: str) -> DataFrame:
    """A bounded read of a service: a hundred records from an offset on (S-20, I-01)."""
    d = _topic(spark, sf).consume(first=50, most=100)
    return d.agg(F.count("*").alias("n"), F.min("offset").alias("low"), F.max("offset").alias("high"), F.sum(F.col("key").cast("long")).alias("users"))


@R.add("c11_position", f"SELECT event_type, count(*) AS n FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) WHERE k <= (SELECT count(*) // 3 FROM events) GROUP BY 1")
def c11_position(spark: SparkSession, sf: str) -> DataFrame:
    """A collector that stays behind the engine's position, a third of the stream (C-11)."""
    at = table(spark, sf, "events").count() // 3
    d = topics.position_sync(_topic(spark, sf), at)
    return d.groupBy(F.get_json_object("value", "$.event_type").alias("event_type")).agg(F.count("*").alias("n"))


# -- streaming -----------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of files: written in four parts in order of time, then read one by one."""
    path, e = shared_dir(spark), table(spark, sf, "events")
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    part = F.least(F.floor((F.col("event_id") - F.lit(low or 0)) * 4 / F.lit(((high or 0) - (low or 0)) + 1)), F.lit(3))
    for k in range(4):
        e.filter(part == k).withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(e.withColumn("ts", F.col("ts").cast("timestamp")).schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/in")


@R.add("st_detections", A26)
def st_detections(spark: SparkSession, sf: str) -> DataFrame:
    """A streaming automaton; on a replayed file it finds what the batch plan finds (A-33)."""
    p = ';(IsEventTypePredicate("view"),*(IsEventTypePredicate("error")),IsEventTypePredicate("click")){partitionBy:userId}'
    return engine.run_to_end(engine.detections(Stream(_stream(spark, sf)), p), f"st_{uuid.uuid4().hex}").select("user_id", "event_id")


@R.add("st_expire", A26)
def st_expire(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a time after which an idle key is forgotten (A-39b); none is idle so long here."""
    p = ';(IsEventTypePredicate("view"),*(IsEventTypePredicate("error")),IsEventTypePredicate("click")){partitionBy:userId}'
    return engine.run_to_end(engine.detections(Stream(_stream(spark, sf)), p, expire="3456000"), f"st_{uuid.uuid4().hex}").select("user_id", "event_id")


@R.add("st_windows", "SELECT event_type, epoch_us(w) // 1000000 AS start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1, 2")
def st_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sliding windows of two days, a step of one (B-40, B-41)."""
    w = engine.window_counts(_stream(spark, sf), "ts", ["event_type"], "2 days", "1 day", "40 days")
    got = engine.run_to_end(w, f"st_{uuid.uuid4().hex}", "complete")
    return got.select("event_type", F.unix_seconds("window.start").alias("start"), "n")


@R.add("st_model_swap")
def st_model_swap(spark: SparkSession, sf: str) -> DataFrame:
    """Models that change while the stream runs, with the counts of each batch and so far (A-65)."""
    path = shared_dir(spark)
    cuts = [20.0, 40.0]

    def models(n: int):  # noqa: ANN202
        cut = cuts[n % 2]
        return n % 2, lambda d: d.withColumn("p", F.col("value") > cut)

    swap = engine.ModelSwap(models, f"{path}/out", lambda d: confusion(d, F.col("p"), F.col("event_type") == "purchase"))
    q = _stream(spark, sf).writeStream.foreachBatch(swap).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return swap.cumulative(spark, ["tp", "fp", "fn", "tn"])
