"""Messages delivered more than once: a partitioned store that keeps one copy of each.

The store holds winners in partitions by period of arrival, an identifier index (number →
partition, in buckets of neighbouring numbers) and a log of the superseded rows. A load of incoming rows
1. finds one winner per number among its own rows, which move once,
2. looks its numbers up in the index, of which it reads the buckets it meets, and so finds the
   affected historical partitions,
3. recomputes one winner per number that history and load share, and copies the other rows of an
   affected partition in the same pass that finds them,
4. writes the affected partitions anew beside the old ones and commits by creating one manifest
   file, which lists the current version of every partition: readers see all of a load or nothing,
   and partitions that no incoming number touches are never read or written.

What is read and shuffled is in proportion to the load and the partitions it affects. A number stays in the partition where it was first
stored, so the index only grows until ``compact``.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.plans.messages import CONTROL

#: Rows without order lose against any other.
LAST = 2**63 - 1
#: Neighbouring numbers that share a bucket of the index, and the number of buckets.
BUCKET_NUMBERS, BUCKETS = 1 << 16, 256


class ConcurrentLoad(RuntimeError):
    """Another writer committed first; nothing of this load is visible, and it may be repeated."""


@dataclass
class Manifest:
    """The committed state: versions of partitions, index parts by bucket, and logs."""

    load: int = -1
    schema: str = ""
    versions: dict[str, list[str]] = field(default_factory=dict)
    index: dict[str, list[str]] = field(default_factory=dict)
    log: list[str] = field(default_factory=list)


class MessageStore:
    """See the module. ``path`` must be on storage that all executors share, local (or mounted) or with
    a rename that does not replace, as HDFS has it.

    Rows may have any columns that can be ordered. Of rows with one number the smallest order wins, a
    null order loses; rows alike in order are told apart by all columns in turn, and wholly equal rows
    are copies of which one is kept. Rows without number are messages of their own and always kept,
    so a load that is repeated after its commit stores them again; control rows (number -1) are left
    out. A null period is a partition of its own. An empty load commits and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, *, order: str = "delivery_id") -> None:
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    # -- manifest ------------------------------------------------------------------------------

    def _fs(self):  # noqa: ANN202
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, where: str) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path(where))) if fs.exists(path(where)) else []

    def manifest(self, load: int | None = None) -> Manifest:
        """The last committed state, or that of a load."""
        names = [n for n in self._names(f"{self.path}/manifest") if n.endswith(".json")]
        name = max(names, default=None) if load is None else f"{load:08d}.json"
        if name is None:
            return Manifest()
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/manifest/{name}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _commit(self, m: Manifest) -> None:
        """The one atomic step. The manifest is written whole under a name of its own; taking the
        final name fails if another writer has it: a hard link on local storage, a rename elsewhere."""
        fs, path = self._fs()
        tmp, final = path(f"{self.path}/manifest/.{uuid.uuid4().hex}.tmp"), path(f"{self.path}/manifest/{m.load:08d}.json")
        out = fs.create(tmp, False)
        try:
            out.write(bytearray(json.dumps(m.__dict__).encode()))
        finally:
            out.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(tmp.toUri().getPath(), final.toUri().getPath())
                won = True
            else:
                won = fs.rename(tmp, final)
        except FileExistsError:
            won = False
        fs.delete(tmp, False)
        if not won:
            raise ConcurrentLoad(f"load {m.load} was committed by another writer")

    # -- reading -------------------------------------------------------------------------------

    def _read(self, paths: list[str], schema: str | T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _schema(m: Manifest) -> T.StructType:
        return T.StructType().add("n", "long").add("p", "string").add("row", T.StructType.fromJson(json.loads(m.schema)))

    def current(self, parts: list[str] | None = None) -> DataFrame:
        """The stored messages, or those of some partitions."""
        m = self.manifest()
        if not m.schema:
            raise ValueError("nothing has been loaded")
        paths = [x for k, v in m.versions.items() if parts is None or k in parts for x in v]
        return self._read(paths, self._schema(m)).select("row.*")

    def superseded(self) -> DataFrame:
        """Every row that isn't the winner of its number: ``number`` and ``order``."""
        return self._read(self.manifest().log, f"number long, `{self.order}` long")

    # -- loading -------------------------------------------------------------------------------

    def _kept(self, df: DataFrame, where: str) -> DataFrame:
        """A small result written once, so that later joins plan with its true size."""
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def load(self, incoming: DataFrame, number: Column, period: Column) -> Manifest:
        """Merge incoming rows into the store and commit; returns the new manifest.

        The winner per number comes from an aggregation with a map-side combine, so a number that
        holds a third of all rows is reduced before the shuffle. Whether the table of known numbers is
        broadcast is Spark's choice by its written size. New rows are written through a rebalancing
        exchange, which splits a hot period over many tasks and joins small ones.
        """
        spark, m = self.spark, self.manifest()
        load = m.load + 1
        at = f"{self.path}/load-{load:08d}-{uuid.uuid4().hex[:8]}"
        schema = m.schema or incoming.schema.json()
        row = F.struct(*[F.col(f"`{c}`") for c in incoming.columns])
        new = incoming.select(number.cast("long").alias("n"), F.coalesce(period.cast("string"), F.lit("none")).alias("p"), row.alias("row"))
        new = new.filter(F.col("n").isNull() | (F.col("n") != CONTROL))
        order = F.coalesce(F.col(f"row.`{self.order}`").cast("long"), F.lit(LAST))
        bucket = F.pmod(F.floor(F.col("number") / BUCKET_NUMBERS), F.lit(BUCKETS)).cast("int")

        # one row per number of the load: the rows move once, and their partitioning serves what follows
        seen = new.filter("n IS NOT NULL").select(F.col("n").alias("number"), order.alias("o"))
        best = new.filter("n IS NOT NULL").groupBy("n").agg(F.min(F.struct(order.alias("o"), "row", "p")).alias("b"), F.count("*").alias("copies"))
        mine = best.select("n", F.col("b.p").alias("p"), F.col("b.row").alias("row"), F.col("b.o").alias("win"), "copies")
        # numbers the store knows: only buckets of the index that the load meets are read
        known, affected = None, []
        met = {str(r[0]) for r in seen.select(bucket.alias("b")).distinct().collect()} & m.index.keys() if m.index else set()
        if met:
            index = self._read([x for b in sorted(met) for x in m.index[b]], "number long, part string")
            asked = seen.select("number").filter(bucket.isin(*[int(b) for b in met])).distinct()
            known = self._kept(index.join(asked, "number", "left_semi"), f"{at}/known")
            # partition names are metadata: as many as there are periods, not rows
            affected = sorted(r[0] for r in known.select("part").distinct().collect())

        fresh, settled = mine, None
        if affected:
            names = known.select(F.col("number").alias("n"), F.col("part").alias("home"))
            history = self._read([x for p in affected for x in m.versions[p]], self._schema(m))
            # one pass over the affected partitions: rows to copy, and those of numbers the load has too
            flagged = history.join(names, "n", "left").select("n", "p", "row", F.col("home").isNotNull().alias("hit"), F.col("p").alias("part"))
            flagged = spark.sql("SELECT /*+ REBALANCE(part) */ * FROM {rows}", rows=flagged)
            flagged.write.option("compression", "zstd").partitionBy("hit", "part").parquet(f"{at}/copied")
            hits = [*self._parts(f"{at}/copied/hit=true").values()]
            shared = self._read(hits, self._schema(m)).withColumns({"win": order, "copies": F.lit(1).cast("long")}).withColumn("home", F.col("p"))
            again = mine.join(names, "n")
            both = shared.select("n", "home", "row", "win", "copies").unionByName(again.select("n", "home", "row", "win", "copies"))
            settled = both.groupBy("n", "home").agg(F.min(F.struct(F.col("win").alias("o"), "row")).alias("b"), F.sum("copies").alias("copies"))
            settled = settled.select("n", F.col("home").alias("p"), F.col("b.row").alias("row"), F.col("b.o").alias("win"), "copies")
            fresh = mine.join(names, "n", "left_anti").unionByName(settled)
        lone = new.filter("n IS NULL").select("n", "p", "row", order.alias("win"), F.lit(1).cast("long").alias("copies"))
        spread = spark.sql("SELECT /*+ REBALANCE(p) */ * FROM {rows}", rows=fresh.unionByName(lone))
        spread.sortWithinPartitions("p").withColumn("part", F.col("p")).write.option("compression", "zstd").partitionBy("part").parquet(f"{at}/rows")
        rows, copied = self._parts(f"{at}/rows"), self._parts(f"{at}/copied/hit=false") if affected else {}

        stored = self._read(list(rows.values()), "n long, p string, win long, copies long").filter("n IS NOT NULL").withColumnRenamed("n", "number")
        entries = stored.select("number", F.col("p").alias("part"))
        entries = (entries.join(known, "number", "left_anti") if affected else entries).withColumn("bucket", bucket)
        spread = spark.sql("SELECT /*+ REBALANCE(bucket) */ * FROM {entries}", entries=entries)
        spread.sortWithinPartitions("bucket", "number").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{at}/index")

        # rows that aren't the winner; of those alike with it in order, all but the one kept
        won = stored.filter("copies > 1").select("number", "win")
        log = seen
        if affected:
            log = log.unionByName(shared.select(F.col("n").alias("number"), F.col("win").alias("o")))
        log = log.join(won, "number")
        given = F.when(F.col("o") != LAST, F.col("o")).alias(self.order)
        beaten = log.filter("o <> win").select("number", given)
        ties = log.filter("o = win").groupBy("number", "o").agg(F.count("*").alias("k")).filter("k > 1")
        ties = ties.select("number", given, F.explode(F.sequence(F.lit(2), F.col("k"))).alias("i")).drop("i")
        beaten.unionByName(ties).write.option("compression", "zstd").parquet(f"{at}/log")

        # affected partitions are replaced; others that got new numbers only are added to
        versions = {p: v for p, v in m.versions.items() if p not in affected}
        for p, d in [*copied.items(), *rows.items()]:
            versions[p] = [*versions.get(p, []), d]
        parts = {b: list(v) for b, v in m.index.items()}
        for b, d in self._parts(f"{at}/index", "bucket").items():
            parts.setdefault(b, []).append(d)
        m = Manifest(load, schema, versions, parts, [*m.log, f"{at}/log"])
        self._commit(m)
        for scratch in ("known", "copied/hit=true"):
            self._drop(f"{at}/{scratch}")
        return m

    # -- upkeep --------------------------------------------------------------------------------

    def compact(self, most: int = 4) -> Manifest:
        """Rewrite what lies in more than ``most`` folders - partitions, index buckets, the log - as one
        folder each, and commit that as a load of its own without rows."""
        m = self.manifest()
        at = f"{self.path}/load-{m.load + 1:08d}-{uuid.uuid4().hex[:8]}"
        versions, index, log = dict(m.versions), dict(m.index), list(m.log)
        many = {p: v for p, v in versions.items() if len(v) > most}
        if many:
            rows = self._read([x for v in many.values() for x in v], self._schema(m))
            spread = self.spark.sql("SELECT /*+ REBALANCE(p) */ * FROM {rows}", rows=rows)
            spread.sortWithinPartitions("p").withColumn("part", F.col("p")).write.option("compression", "zstd").partitionBy("part").parquet(f"{at}/rows")
            versions |= {p: [d] for p, d in self._parts(f"{at}/rows").items()}
        wide = {b: v for b, v in index.items() if len(v) > most}
        if wide:
            rows = self._read([x for v in wide.values() for x in v], "number long, part string").withColumn("bucket", F.pmod(F.floor(F.col("number") / BUCKET_NUMBERS), F.lit(BUCKETS)).cast("int"))
            spread = self.spark.sql("SELECT /*+ REBALANCE(bucket) */ * FROM {rows}", rows=rows)
            spread.sortWithinPartitions("bucket", "number").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{at}/index")
            index |= {b: [d] for b, d in self._parts(f"{at}/index", "bucket").items()}
        if len(log) > most:
            self.superseded().write.option("compression", "zstd").parquet(f"{at}/log")
            log = [f"{at}/log"]
        m = Manifest(m.load + 1, m.schema, versions, index, log)
        self._commit(m)
        return m

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the last ``keep`` manifests name, and older manifests. Only for
        times without a load; readers of older states lose their files. Returns what went."""
        loads = sorted(int(n[:8]) for n in self._names(f"{self.path}/manifest") if n.endswith(".json"))
        used: set[str] = set()
        for k in loads[-keep:]:
            m = self.manifest(k)
            used |= {x for v in [*m.versions.values(), *m.index.values(), m.log] for x in v}
        gone = []
        for load in (n for n in self._names(self.path) if n.startswith("load-")):
            for kind in self._names(f"{self.path}/{load}"):
                folder = f"{self.path}/{load}/{kind}"
                inner = [f"{folder}/{n}" for n in self._names(folder) if "=" in n] if folder not in used else []
                inner = [y for x in inner for y in ([f"{x}/{n}" for n in self._names(x)] if "/hit=" in x else [x])]
                if folder not in used and not used & set(inner):
                    gone.append(folder)
                elif inner:
                    gone += [x for x in inner if x not in used]
        for k in loads[:-keep]:
            gone.append(f"{self.path}/manifest/{k:08d}.json")
        for x in gone:
            self._drop(x)
        return gone

    def _drop(self, where: str) -> None:
        fs, path = self._fs()
        fs.delete(path(where), True)

    def _parts(self, where: str, column: str = "part") -> dict[str, str]:
        """Partition → folder."""
        plain = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {plain(n.removeprefix(f"{column}=")): f"{where}/{n}" for n in self._names(where) if n.startswith(f"{column}=")}
