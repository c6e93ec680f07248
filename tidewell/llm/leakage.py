"""Evaluation passages inside a corpus: one Aho-Corasick automaton over all runs of n words.

The evaluation items are normalised, their words numbered, and every run of n consecutive words
becomes a pattern over word numbers, so a node of the automaton is a word and not a letter. Each
document is normalised and scanned once; the rare documents with a hit are normalised again with
offsets, so every match is given as a range of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.text import WORD, cleaned, located_words, plain

#: Words of the items that one automaton takes. An automaton has at most n nodes a word. Measured
#: with n = 10 on random words: about 0.8 kB a word, so at most some 240 MB in a Python worker.
ITEM_WORDS = 300_000

_BUILT: dict[str, Patterns] = {}


def words(text: str) -> list[str]:
    return WORD.findall(plain(cleaned(text)))


class Patterns:
    """The automaton of some items: word numbers, runs, and for each run the items that hold it."""

    def __init__(self, items: list[tuple[int, str | None]], n: int) -> None:
        self.n, self.numbers = n, {}
        runs: dict[tuple[int, ...], int] = {}
        held: list[tuple[int, int]] = []
        for item, text in items:
            w = [self.numbers.setdefault(x, len(self.numbers) + 1) for x in words(text or "")]
            held += [(runs.setdefault(tuple(w[i : i + n]), len(runs)), item) for i in range(len(w) - n + 1)]
        self.size = len(runs)
        pairs = np.unique(np.array(held, np.int64).reshape(-1, 2), axis=0)
        self.items = pairs[:, 1]
        self.ptr = np.searchsorted(pairs[:, 0], np.arange(len(runs) + 1))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for run, number in runs.items():
            self.automaton.add_word(run, number)
        if runs:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, list[int]]]:
        """(item, begin, end, starts) for every item met: the original range from its first to its
        last matched word, and the numbers of the words at which its runs start."""
        number = self.numbers.get
        flat = tuple([number(w, 0) for w in words(text)])
        if not self.size or len(flat) < self.n:
            return []
        hits = list(self.automaton.iter(flat))
        if not hits:
            return []
        where = located_words(text)
        starts: dict[int, list[int]] = {}
        for end, run in hits:
            for item in self.items[self.ptr[run] : self.ptr[run + 1]].tolist():
                starts.setdefault(item, []).append(end - self.n + 1)
        return [(item, where[s[0]][1], where[s[-1] + self.n - 1][2], s) for item, s in sorted(starts.items())]


def _patterns(key: str, items: list[tuple[int, str | None]], n: int) -> Patterns:
    if key not in _BUILT:
        _BUILT.clear()  # a worker holds one automaton at a time
        _BUILT[key] = Patterns(items, n)
    return _BUILT[key]


DDL = "item_id long, doc_id long, copy long, begin long, end long, starts array<int>"
SCHEMA = pa.schema([(c, pa.int64()) for c in ("item_id", "doc_id", "copy", "begin", "end")] + [("starts", pa.list_(pa.int32()))])


def leaks(items: DataFrame, docs: DataFrame, n: int = 10, item: str = "item_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of item and document that share at least ``n`` consecutive words, with the matched
    range of the document's original text, the ``words`` covered by matches and the number of
    ``runs`` of n words that matched.

    Null and empty texts and items with fewer than n words have no match; null ids are left out.
    Rows of items with one id are one item. Rows of documents with one id give one row per distinct
    match. Items are taken in groups of at most ITEM_WORDS words (a longer item is cut into pieces
    that overlap by n - 1 words), each group has an automaton and a scan of its own, and a worker
    holds one automaton. Runs are joined over the groups before words are counted, so the result
    does not depend on the groups. The driver passes the items' texts on, group by group.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    out = None
    for k, group in enumerate(_groups(items, n, item, text)):
        shared = spark.sparkContext.broadcast(group)
        key = f"{spark.sparkContext.applicationId}-{id(shared)}-{k}-{shared._jbroadcast.id() if shared._jbroadcast else k}"

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            p = _patterns(key, shared.value, n)
            for b in batches:
                rows = [(m[0], d, c, *m[1:]) for d, c, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for m in p.matches(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

        part = corpus.select("doc_id", F.xxhash64("text").alias("copy"), "text").mapInArrow(scan, DDL)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], DDL)
    # equal rows of documents have equal copy numbers; an item's runs may lie in several groups
    one = out.groupBy("item_id", "doc_id", "copy").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("starts")))).alias("starts"))
    gaps = F.zip_with(F.slice("starts", 2, F.size("starts")), F.slice("starts", 1, F.size("starts") - 1), lambda b, a: F.least(b - a, F.lit(n)))
    covered = F.when(F.size("starts") > 1, F.aggregate(gaps, F.lit(n), lambda a, x: a + x)).otherwise(F.lit(n))
    return one.select("item_id", "doc_id", "begin", "end", covered.cast("long").alias("words"), F.size("starts").cast("long").alias("runs")).distinct()


def _groups(items: DataFrame, n: int, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in order of their ids, in groups of at most ITEM_WORDS words."""
    held: list[tuple[int, str]] = []
    size = 0
    rows = items.select(F.col(item).cast("long"), F.col(text).cast("string")).filter(F.col(item).isNotNull() & F.col(text).isNotNull()).sort(item, text)
    for number, given in rows.toLocalIterator():
        w = words(given)
        step = max(ITEM_WORDS - n + 1, 1)
        for a in range(0, max(len(w) - n + 1, 0), step):
            piece = w[a : a + step + n - 1]
            if held and size + len(piece) > ITEM_WORDS:
                yield held
                held, size = [], 0
            held.append((number, " ".join(piece)))
            size += len(piece)
    if held:
        yield held
