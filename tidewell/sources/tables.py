"""Other readers and the sinks: series, tweets, tabular files; texts, JDBC, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def series_csv(spark: SparkSession, path: str, dims: int = 1, label: int = 0, sep: str = ",") -> DataFrame:
    """Wide series files: a line per (example, dimension) with the label in one column → (line_file,
    line, label, vec). Lines keep their file and number, so dimensions of an example stay together:
    ``id`` is the line number over ``dims``, ``dim`` the rest."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    return _series(raw.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")), dims, label, sep)


def series_lines(lines: DataFrame, dims: int = 1, label: int = 0, sep: str = ",") -> DataFrame:
    """The same from a DataFrame with ``value`` and ``line``."""
    return _series(lines.filter(F.trim("value") != "").withColumn("file", F.lit("")), dims, label, sep)


def _series(d: DataFrame, dims: int, label: int, sep: str) -> DataFrame:
    f = F.split("value", sep)
    nums = F.transform(F.filter(f, lambda _, i: i != label), lambda x: F.when(F.lower(F.trim(x)) == "nan", F.lit(None).cast("double")).otherwise(F.trim(x).try_cast("double")))
    return d.select("file", F.floor(F.col("line") / F.lit(dims)).alias("id"), (F.col("line") % dims).cast("int").alias("dim"), F.trim(f[label]).alias("label"), nums.alias("vec"))


def arff(lines: DataFrame) -> DataFrame:
    """ARFF: lines after @data, without comments; ? is missing. The last attribute is the label. Lines
    have ``value`` and ``line`` (their order)."""
    start = lines.filter(F.lower(F.trim("value")) == "@data").agg(F.min("line")).scalar()
    d = lines.withColumn("__s", start).filter((F.col("line") > F.col("__s")) & ~F.trim("value").startswith("%") & (F.trim("value") != "")).drop("__s")
    f = F.split("value", ",")
    nums = F.transform(F.slice(f, 1, F.size(f) - 1), lambda x: F.when(F.trim(x) != "?", F.trim(x).try_cast("double")))
    return d.select("line", nums.alias("vec"), F.trim(F.element_at(f, -1)).alias("label"))


def long_form(series: DataFrame) -> DataFrame:
    """(id, dim, t, value) from series with vectors."""
    return series.select("id", "dim", "label", F.posexplode("vec").alias("t", "value"))


def tweets_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="event string, tweet_text string, tweet_language string")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def tabular_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tables with ``?`` for missing values and blanks after commas; rows with missing values are dropped."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="?", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).na.drop()


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: str) -> None:
    spark.read.csv(source, header=True, schema=schema).write.mode("overwrite").parquet(target)


def write_events(df: DataFrame, path: str) -> None:
    """Events as CSV."""
    df.write.mode("overwrite").csv(path, header=True)


def append_statistics(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def write_texts(df: DataFrame, path: str) -> None:
    """Any rows as JSON lines in text files, the dump of a topic."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def jdbc_batches(url: str, table: str, **options: str):  # noqa: ANN201
    """A ``foreachBatch`` function that appends every batch to a table of a database. The batch number
    goes along, so a batch that runs again can be told."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()

    return put


def write_windows(intervals: DataFrame, path: str, q: str = "q") -> None:
    """Intervals of every query window as pipe-separated lines in a folder of its own (``q=<time>``). Written
    through a rebalancing exchange, so a window is a few files of a fair size; a window that is
    written again replaces itself only."""
    spread = intervals.sparkSession.sql(f"SELECT /*+ REBALANCE({q}) */ * FROM {{rows}}", rows=intervals)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("sep", "|").option("header", True).partitionBy(q).csv(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "|").option("header", True).option("inferSchema", True).csv(path)
