"""Topics: numbered records that services write to and read from, with positions and bounded reads.

``FileTopic`` keeps a topic as files on shared storage, for replays, tests and clusters without a broker;
``events.kafka`` reads a broker's topic. Both give rows (offset, timestamp, key, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "offset long, timestamp long, key string, value string"
#: A record with this value ends a bounded read.
TERMINATE = "terminate"


class FileTopic:
    """Records in files, numbered from 0 in the order given; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def produce(self, rows: DataFrame, order: str, timestamp: Column, key: Column | None = None, value: Column | None = None) -> None:
        """Append rows in the order of a unique whole-number column, numbered exactly and without a sort in
        one task. The value is ``value``, else the row as JSON."""
        first = self.end()
        block = F.floor(F.col(order) / F.lit(100_000))
        d = rows.select(F.col(order).alias("__o"), block.alias("__b"), timestamp.cast("long").alias("timestamp"), (key if key is not None else F.lit(None)).cast("string").alias("key"), (value if value is not None else F.to_json(F.struct(*rows.columns))).alias("value"))
        from pyspark.sql import Window

        sizes = d.groupBy("__b").agg(F.count("*").alias("__n"))
        before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
        base = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
        d = d.withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy("__o")) - 1).join(base, "__b")
        d = d.withColumn("offset", (F.col("__base") + F.col("__i") + first).cast("long"))
        d.select("offset", "timestamp", "key", "value").sortWithinPartitions("offset").write.mode("append").parquet(self.path)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def end(self) -> int:
        """The offset that the next record gets."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return 0
        last = self._all().agg(F.max("offset")).first()[0]
        return 0 if last is None else last + 1

    def consume(self, first: int = 0, last: int | None = None, most: int | None = None, stop: bool = True) -> DataFrame:
        """Records from ``first`` to ``last`` (both included), at most ``most`` of them, and none from the
        first terminating record on. Offsets are statistics of the files, so others are not read."""
        d = self._all().filter(F.col("offset") >= first)
        end = last
        if most is not None:
            end = first + most - 1 if end is None else min(end, first + most - 1)
        if end is not None:
            d = d.filter(F.col("offset") <= end)
        if stop:
            halt = d.filter(F.col("value") == TERMINATE).agg(F.min("offset")).first()[0]
            d = d if halt is None else d.filter(F.col("offset") < halt)
        return d

    def stream(self, files_per_trigger: int = 1) -> DataFrame:
        """The topic as a stream of its files."""
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(self.path)


def position_sync(collector: FileTopic, engine: int) -> DataFrame:
    """What a collector may read: never past the engine's position."""
    return collector.consume(0, engine, stop=False)


def timed_replay(events: DataFrame, t: str, rate: float, shift: int = 0) -> DataFrame:
    """When a replay at ``rate`` times the real speed sends each event: ``send_ms`` after its begin, and
    the time the event then carries, ``t`` moved by ``shift``."""
    if rate <= 0:
        raise ValueError("the rate is positive")
    low = events.agg(F.min(t)).scalar()
    d = events.withColumn("send_ms", F.floor((F.col(t) - low) * 1000 / F.lit(float(rate))).cast("long"))
    return d.withColumn(t, F.col(t) + shift)
