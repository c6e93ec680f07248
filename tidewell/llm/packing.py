"""Filling containers of fixed capacity with texts, by lexical retrieval.

The BM25 inverted index is sharded by content: documents are routed to the shard of the texts they
resemble, by a tree of k-means cells that is fitted on bounded samples and then takes every row. A
shard holds at most SHARD_BYTES of text, so it is packed by one task in bounded memory; cells above
that are divided again, level by level, and copies of one text, which no content tells apart, by a
hash. Document frequencies are counted over the whole corpus.

Inside a shard the index is cut into small cells too. A container starts with the largest unused
document; its words are looked up in the cells nearest to it, and the unused neighbours fill the
container in order of their score as long as they fit; what is left is filled with the largest
unused pieces that fit. A text is split only if it is larger than the capacity: its full pieces take
containers of their own and the rest is packed like a text.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import written

#: Words are hashed to this many slots, so the frequency table has a fixed size (1 MB).
SLOTS = 1 << 18
#: Text of one shard; a document counts for its text and ROW_BYTES, so empty ones count too.
SHARD_BYTES, ROW_BYTES = 32 << 20, 64
#: Cells a level divides into; documents that a level, or a shard's own cells, are fitted on.
BRANCHES, SAMPLE = 6, 4_096
#: Levels that divide by content, enough for 6^12 shards; what is still too large is spread by hash.
LEVELS = 12
#: Slots that k-means looks at; documents of a cell inside a shard; cells a seed looks at.
FEATURES, CELL_DOCS, PROBES = 2_048, 256, 10
#: Sizes that a posting tells apart; larger ones count as this.
SIZES = 1 << 20
K1, B = 1.2, 0.75
_WORD = re.compile(r"[^\W_]+")


def slots_of(text: str) -> np.ndarray:
    """Hash slots of a text's words, one per occurrence."""
    return np.fromiter((zlib.crc32(w.encode()) & (SLOTS - 1) for w in _WORD.findall(text.lower())), np.int64)


class Docs:
    """The words of some documents: slots and their counts, document after document."""

    def __init__(self, slots: list[bytes], counts: list[bytes]) -> None:
        self.slot = np.frombuffer(b"".join(slots), np.int32)
        self.tf = np.frombuffer(b"".join(counts), np.int32)
        n = np.array([len(s) // 4 for s in slots], np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(n)])
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.length = np.bincount(self.doc, self.tf, len(n)) if len(n) else np.zeros(0)

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Docs:
        pairs = [np.unique(t, return_counts=True) for t in texts]
        return cls([u.astype(np.int32).tobytes() for u, _ in pairs], [c.astype(np.int32).tobytes() for _, c in pairs])

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def weights(self, idf: np.ndarray, mean: float) -> np.ndarray:
        """What each (document, word) adds to a BM25 score."""
        long = (K1 * (1 - B + B * self.length / max(mean, 1e-9)))[self.doc]
        return (self.tf * (K1 + 1) / (self.tf + long) * idf[self.slot]).astype(np.float32)

    def dense(self, a: int, b: int, column: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
        """Documents a to b as unit vectors over the slots that have a column."""
        out = np.zeros((b - a, width), np.float32)
        rows = slice(self.ptr[a], self.ptr[b])
        c = column[self.slot[rows]]
        at = c >= 0
        out[self.doc[rows][at] - a, c[at]] = weight[rows][at]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Cells:
    """K-means cells over unit vectors: ``slots`` are the columns, ``centre`` has a row per cell."""

    def __init__(self, slots: np.ndarray, centre: np.ndarray) -> None:
        self.slots, self.centre = slots, centre

    @classmethod
    def fit(cls, docs: Docs, weight: np.ndarray, k: int) -> Cells:
        """Deterministic: starts with the documents farthest from those chosen before. Fewer cells
        come out if the documents differ less."""
        gain = np.bincount(docs.slot, weight.astype(float) ** 2, SLOTS)
        slots = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
        slots = slots[gain[slots] > 0]
        column = np.full(SLOTS, -1, np.int32)
        column[slots] = np.arange(len(slots))
        x = docs.dense(0, len(docs), column, weight, len(slots))
        first = int(np.argmax(x @ x.mean(0))) if len(x) else 0
        centre, near = [x[first]], x @ x[first]
        step = np.random.default_rng(1)
        while len(centre) < min(k, len(x)):
            far = np.maximum(1 - near, 0) ** 2
            if far.max() < 1e-3:
                break
            c = int(step.choice(len(x), p=far / far.sum()))
            centre.append(x[c])
            near = np.maximum(near, x @ x[c])
        m = np.stack(centre)
        for _ in range(10):
            cell = (x @ m.T).argmax(1)
            new = (cell == np.arange(len(m))[:, None]).astype(np.float32) @ x
            size = np.linalg.norm(new, axis=1, keepdims=True)
            m = np.where(size > 0, new / np.maximum(size, 1e-9), m)
        return cls(slots, m)

    def divides(self, docs: Docs, weight: np.ndarray) -> bool:
        """Whether no cell takes nearly all of some documents."""
        cell = self.nearest(docs, weight, 1)[:, 0]
        return bool(np.bincount(cell).max() <= 0.9 * len(cell))

    def nearest(self, docs: Docs, weight: np.ndarray, p: int) -> np.ndarray:
        """The ``p`` nearest cells of every document, nearest first."""
        column = np.full(SLOTS, -1, np.int32)
        column[self.slots] = np.arange(len(self.slots))
        p, out = min(p, len(self.centre)), []
        for a in range(0, len(docs), 2_048):
            s = docs.dense(a, min(a + 2_048, len(docs)), column, weight, len(self.slots)) @ self.centre.T
            out.append(np.argsort(-s, 1, kind="stable")[:, :p])
        return np.concatenate(out).astype(np.int64) if out else np.zeros((0, p), np.int64)

    def save(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, slots=self.slots, centre=self.centre)
        return f.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Cells:
        z = np.load(io.BytesIO(data))
        return cls(z["slots"], z["centre"])


class Index:
    """BM25 inverted index of one shard, in cells: postings by (cell, slot, size) with their weights, so
    that a lookup reads only documents that fit. ``slim`` drops the postings of used documents."""

    def __init__(self, docs: Docs, idf: np.ndarray, mean: float, left: np.ndarray | None = None, cell_docs: int = CELL_DOCS, probes: int = PROBES) -> None:
        self.docs, w = docs, docs.weights(idf, mean)
        n = self.held = len(docs)
        if n > cell_docs * probes:
            pick = np.linspace(0, n - 1, min(n, SAMPLE)).astype(int)
            rows = np.concatenate([np.arange(docs.ptr[i], docs.ptr[i + 1]) for i in pick])
            some = Docs([docs.slot[docs.ptr[i] : docs.ptr[i + 1]].tobytes() for i in pick], [docs.tf[docs.ptr[i] : docs.ptr[i + 1]].tobytes() for i in pick])
            self.near = Cells.fit(some, w[rows], -(-n // cell_docs)).nearest(docs, w, probes)
        else:
            self.near = np.zeros((n, 1), np.int64)
        home = self.near[:, 0].copy()
        self.near.sort(1)
        size = np.minimum(left, SIZES - 1) if left is not None else np.zeros(n, np.int64)
        key = (home[docs.doc] * SLOTS + docs.slot) * SIZES + size[docs.doc]
        o = np.argsort(key, kind="stable")
        self.key, self.post, self.weight = key[o], docs.doc[o], w[o]

    def slim(self, free: np.ndarray) -> None:
        """Drop postings of used documents once these are a third of those held."""
        left = int(free.sum())
        if left < self.held * 2 // 3:
            at = free[self.post]
            self.key, self.post, self.weight, self.held = self.key[at], self.post[at], self.weight[at], left

    def lookup(self, words: np.ndarray, cells: np.ndarray, room: int) -> np.ndarray:
        """BM25 of the documents of some cells that are no larger than a room; elsewhere 0."""
        ask = (cells[:, None] * SLOTS + words[None, :]).ravel() * SIZES
        a, b = np.searchsorted(self.key, ask), np.searchsorted(self.key, ask + min(room, SIZES - 1), "right")
        at = b > a
        a, size = a[at], (b - a)[at]
        rows = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(self.post[rows], self.weight[rows], len(self.docs))

    def scores(self, doc: int, room: int = 2**62) -> np.ndarray:
        """BM25 of the documents in the cells nearest to a document, for its words."""
        return self.lookup(self.docs.slot[self.docs.ptr[doc] : self.docs.ptr[doc + 1]].astype(np.int64), self.near[doc], room)


class Largest:
    """The largest unused document that fits a room, by a list in order of size that skips used ones."""

    def __init__(self, left: np.ndarray, free: np.ndarray) -> None:
        self.order = np.argsort(-left, kind="stable")
        self.negative, self.free = -left[self.order], free
        self.skip = list(range(len(left) + 1))

    def __call__(self, room: int) -> int:
        i = j = int(np.searchsorted(self.negative, -room))
        while j < len(self.order) and not self.free[self.order[j]]:
            j = self.skip[j] if self.skip[j] > j else j + 1
        while i < j:
            self.skip[i], i = j, max(self.skip[i], i + 1)
        return int(self.order[j]) if j < len(self.order) else -1


def left_of(size: np.ndarray, capacity: int) -> np.ndarray:
    """What is packed like a text: all of a text, or what its full pieces leave."""
    return np.where(size > capacity, size % capacity, size)


def pack(size: np.ndarray, capacity: int, index: Index) -> np.ndarray:
    """Rows (container, document, piece, start, length) for documents of the given sizes."""
    whole, left = np.where(size > capacity, size // capacity, 0), left_of(size, capacity)
    large = np.repeat(np.arange(len(size)), whole)
    piece = np.arange(len(large)) - np.repeat(np.cumsum(whole) - whole, whole)
    out = [np.stack([np.arange(len(large)), large, piece, piece * capacity, np.full(len(large), capacity)], 1)]
    box = len(large)
    free = ~((whole > 0) & (left == 0))
    largest = Largest(left, free)
    in_box, member = [], []
    for seed in largest.order.tolist():
        if not free[seed]:
            continue
        free[seed] = False
        members, room = [seed], capacity - int(left[seed])
        if largest(room) >= 0:
            index.slim(free)
            score = index.scores(seed, room)
            near = np.flatnonzero(score)
            near = near[free[near] & (left[near] <= room)]
            near = near[np.argsort(-score[near], kind="stable")]
            while len(near):
                used = np.cumsum(left[near])
                k = int(np.searchsorted(used, room, "right"))
                members += near[:k].tolist()
                free[near[:k]] = False
                room -= int(used[k - 1]) if k else 0
                near = near[k + 1 :]
                near = near[left[near] <= room]
            while (best := largest(room)) >= 0:
                members.append(best)
                free[best] = False
                room -= int(left[best])
        in_box += [box] * len(members)
        member += members
        box += 1
    d = np.array(member, np.int64)
    out.append(np.stack([np.array(in_box, np.int64), d, whole[d], whole[d] * capacity, left[d]], 1))
    return np.concatenate(out)


# -- the words of all documents, and their shards ------------------------------------------------

WORDS_DDL = "doc_id long, size long, slots binary, counts binary"


def words_of(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size in tokens (bytes), word slots and counts; null ids and texts are left out."""
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            pairs = [np.unique(slots_of(t), return_counts=True) for t in texts]
            cols = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), *(pa.array([p[i].astype(np.int32).tobytes() for p in pairs], pa.binary()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "size", "slots", "counts"])

    return rows.mapInArrow(run, WORDS_DDL)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: documents that hold each slot; slot -1 counts documents, -2 words."""
    df = np.zeros(SLOTS, np.int64)
    docs = words = 0
    for b in batches:
        df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=SLOTS)
        words += int(np.frombuffer(b"".join(b.column(1).to_pylist()), np.int32).sum())
        docs += b.num_rows
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([df[some], [docs, words]]))], names=["slot", "n"])


def corpus_statistics(words: DataFrame) -> tuple[float, np.ndarray]:
    """Mean length in words and the idf of every slot, over all documents. The result has SLOTS
    entries, whatever the corpus holds."""
    got = words.select("slots", "counts").mapInArrow(_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    count = int(n[slot == -1].sum())
    df = np.zeros(SLOTS)
    df[slot[slot >= 0]] = n[slot >= 0]
    return int(n[slot == -2].sum()) / max(count, 1), np.log1p((count - df + 0.5) / (df + 0.5)).astype(np.float32)


def _docs(t: pa.Table) -> Docs:
    return Docs(t.column("slots").to_pylist(), t.column("counts").to_pylist())


def sharded(words: DataFrame, mean: float, idf, shard_bytes: int = SHARD_BYTES) -> DataFrame:  # noqa: ANN001
    """Adds ``shard``, the path of cells a document was routed through.

    A level takes the shards above the bound: each is fitted on a sample of about SAMPLE of its rows,
    chosen by hash, and all its rows are routed in blocks of at most a shard's size. Rows a level
    cannot tell apart are spread by hash. Levels are written tables, so a lost executor costs one level.
    """
    load = F.col("size") + ROW_BYTES
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id", "size"), 11) / F.lit(float(2**53))
    rows = words.withColumn("shard", F.lit("0"))
    while True:
        over = rows.groupBy("shard").agg(F.sum(load).alias("load"), F.count("*").alias("n")).filter((F.col("load") > shard_bytes) & ~F.col("shard").contains("="))
        if over.isEmpty():
            return rows
        over = over.withColumn("blocks", F.ceil(F.col("load") / shard_bytes).cast("int"))

        def fit(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by([("doc_id", "ascending"), ("size", "ascending")])
            d = _docs(t)
            w = d.weights(idf.value, mean)
            cells = Cells.fit(d, w, BRANCHES)
            if not cells.divides(d, w):
                cells.centre = cells.centre[:1]
            return pa.table({"shard": [key[0].as_py()], "model": pa.array([cells.save()], pa.binary())})

        some = rows.join(over, "shard").filter(chance * F.col("n") < SAMPLE).select("shard", "doc_id", "size", "slots", "counts")
        models = some.groupBy("shard").applyInArrow(fit, "shard string, model binary").join(over, "shard")
        models = models.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("shard", "block", "blocks", "model")
        split = rows.join(over.select("shard", "blocks"), "shard").withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks")).cast("int")).drop("blocks")

        def route(key: tuple, t: pa.Table, m: pa.Table) -> pa.Table:
            name, block = key[0].as_py(), key[1].as_py()
            cells = Cells.load(m.column("model")[0].as_py()) if m.num_rows else None
            if cells is None or len(cells.centre) < 2 or name.count(".") >= LEVELS:
                path = [f"{name}={block}"] * t.num_rows
            else:
                d = _docs(t)
                path = [f"{name}.{c}" for c in cells.nearest(d, d.weights(idf.value, mean), 1)[:, 0]]
            return t.drop_columns(["shard", "block"]).append_column("shard", pa.array(path, pa.string()))

        moved = split.groupBy("shard", "block").cogroup(models.groupBy("shard", "block")).applyInArrow(route, f"{WORDS_DDL}, shard string")
        rows = written(rows.join(over.select("shard"), "shard", "left_anti").select(*moved.columns).unionByName(moved))


DDL = "job_id long, shard string, container int, doc_id long, piece int, start long, tokens long"
SCHEMA = pa.schema([("job_id", pa.int64()), ("shard", pa.string()), ("container", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64())])


def _prepared(docs: DataFrame, doc: str, text: str, shard_bytes: int) -> tuple[DataFrame, float, object]:
    spark: SparkSession = docs.sparkSession
    words = written(words_of(docs, doc, text))
    mean, idf = corpus_statistics(words)
    shared = spark.sparkContext.broadcast(idf)
    return sharded(words, mean, shared, shard_bytes), mean, shared


def packed(docs: DataFrame, jobs: DataFrame, doc: str = "doc_id", text: str = "text", job: str = "job_id", capacity: str = "capacity", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every document of every job in containers: job_id, shard, container (numbered inside the
    shard), doc_id, piece, start and tokens of the piece.

    A size is the number of tokens of the public byte-level tokenizer, one per UTF-8 byte; starts
    count in the same tokens. Null texts and ids are left out; an empty text takes no room but is
    put somewhere. Rows that repeat an id are packed one by one. Jobs with a null or non-positive
    capacity are left out. Jobs are few (they are a configuration table); more than 10,000 raise.

    A task packs one shard for one job. A shard depends on the rows alone, not on how files are
    split; each leaves at most one container half empty.
    """
    asked = jobs.select(F.col(job).cast("long").alias("job_id"), F.col(capacity).cast("long").alias("capacity")).filter("capacity > 0 AND job_id IS NOT NULL").distinct()
    todo = sorted(tuple(r) for r in asked.limit(10_001).collect())
    if len(todo) > 10_000:
        raise ValueError("more than 10,000 packing jobs")
    rows, mean, shared = _prepared(docs, doc, text, shard_bytes)

    def fill(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("size", "ascending")])
        ids, size = t.column("doc_id").to_numpy(), t.column("size").to_numpy()
        shard, job_id, cap = (k.as_py() for k in key)
        index = Index(_docs(t), shared.value, mean, left_of(size, cap))
        del t
        got = pack(size, cap, index)
        n = len(got)
        cols = [np.full(n, job_id), [shard] * n, got[:, 0], ids[got[:, 1]], got[:, 2], got[:, 3], got[:, 4]]
        return pa.table([pa.array(c, pa.string()) if f.name == "shard" else pa.array(c).cast(f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)

    every = F.explode(F.array(*[F.struct(F.lit(j).cast("long").alias("job_id"), F.lit(c).cast("long").alias("capacity")) for j, c in todo])) if todo else None
    if every is None:
        return docs.sparkSession.createDataFrame([], DDL)
    return rows.withColumn("job", every).select("doc_id", "size", "slots", "counts", "shard", "job.*").groupBy("shard", "job_id", "capacity").applyInArrow(fill, DDL)


def neighbour_recall(docs: DataFrame, asked: DataFrame, k: int = 10, doc: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """How much of the true neighbourhood a seed can see: per asked document the share of its ``k``
    best neighbours by BM25 over the whole corpus (a brute-force scan) that its shard's index
    returns among its own k best, and the ratio of the mean scores. Equal scores count as found.

    ``asked`` has a column doc_id; at most 10,000 are allowed, as their words are broadcast.
    """
    rows, mean, shared = _prepared(docs, doc, text, shard_bytes)
    ids = asked.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    q = rows.join(ids, "doc_id").select("doc_id", "slots").dropDuplicates(["doc_id"]).limit(10_001).toArrow()
    if q.num_rows > 10_000:
        raise ValueError("more than 10,000 documents asked for")
    ask = {i: np.frombuffer(s, np.int32) for i, s in zip(q.column(0).to_pylist(), q.column(1).to_pylist(), strict=True)}

    def best(ids_: np.ndarray, score: np.ndarray, me: int) -> list[float]:
        s = score[ids_ != me]
        return np.sort(np.partition(s, -k)[-k:] if len(s) > k else s)[::-1].astype(float).tolist()

    def scan(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("size", "ascending")])
        own, d = t.column("doc_id").to_numpy(), _docs(t)
        index, out = Index(d, shared.value, mean), []
        whole = Index(d, shared.value, mean, cell_docs=2**40)
        for i, w in ask.items():
            here = np.flatnonzero(own == i)
            found = best(own, index.scores(int(here[0])), i) if len(here) else None
            out.append((i, best(own, whole.lookup(w.astype(np.int64), np.zeros(1, np.int64), SIZES), i), found))
        return pa.table({"doc_id": pa.array([o[0] for o in out], pa.int64()), "score": pa.array([o[1] for o in out], pa.list_(pa.float64())), "found": pa.array([o[2] for o in out], pa.list_(pa.float64()))})

    got = rows.groupBy("shard").applyInArrow(scan, "doc_id long, score array<double>, found array<double>")
    got = got.groupBy("doc_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("score")), asc=False), 1, k).alias("true"), F.max("found").alias("found"))
    got = got.withColumn("true", F.filter("true", lambda x: x > 0)).filter(F.size("true") > 0)
    last = F.element_at("true", -1) * (1 - 1e-6)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return got.select("doc_id", (F.least(F.size(F.filter("found", lambda x: x >= last)), F.size("true")) / F.size("true")).alias("recall"), F.least(F.lit(1.0), total(F.slice("found", 1, F.size("true"))) / total("true")).alias("score_ratio"))
