"""Short-text mining: anonymise, detect the language, classify, retrieve, fuse rankings."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Frequent function words of each language.
STOPWORDS = {
    "en": "the of and to in is that for it with as was on are be this at by from not have an or you which but has they we been were their there will would can our if after before until no near still",
    "es": "el la de que y en un los se del las por con para una su al lo como más o pero sus le ha este sí porque esta entre cuando muy sin sobre también hasta hay desde es son está no",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war bis seit wieder",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om dan ook als bij door over naar uit nog wel worden heeft deze sinds geen tot was hij ze maar wie iemand",
    "ca": "el la de i a en que un els es per amb una les del al dels no com més ha pel són però sobre entre fins des aquesta hi ho seva també està molt qui si tots",
}


def anonymise(text: Column) -> Column:
    """Addresses first, then user names: ``<EMAIL>`` and ``<USERNAME>``."""
    mail = F.regexp_replace(text, r"[\w.+\-]+@[\w\-]+(\.[\w\-]+)+", "<EMAIL>")
    return F.regexp_replace(mail, r"@\S+", "<USERNAME>")


def strip_marks(text: Column) -> Column:
    """Without mentions, links, hashtags and character references: what a language detector reads."""
    for p in (r"@\S+", r"https?://\S+|www\.\S+", r"#\S+", r"&#?\w+;"):
        text = F.regexp_replace(text, p, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def detect_language(text: Column, languages: list[str] | None = None, margin: float = 0.0) -> Column:
    """The language whose function words are most frequent, if its lead over the next is above the
    margin (share of the words); else ``unknown``, also for null and empty texts."""
    langs = languages or list(STOPWORDS)
    words = F.filter(F.split(F.lower(strip_marks(text)), r"[^\p{L}]+"), lambda w: w != "")
    n = F.size(words)

    def share(lang: str) -> Column:
        known = STOPWORDS[lang].split()
        return F.size(F.filter(words, lambda w: w.isin(*known))) / n

    shares = [F.struct(share(k).alias("share"), F.lit(k).alias("lang")) for k in langs]
    best = F.reverse(F.array_sort(F.array(*shares)))
    top, nxt = best[0], best[1] if len(langs) > 1 else None
    lead = top["share"] - (nxt["share"] if nxt is not None else F.lit(0.0))
    return F.when((n > 0) & (lead > margin), top["lang"]).otherwise(F.lit("unknown"))


# -- classification ------------------------------------------------------------------------------


@dataclass
class NaiveBayes:
    """Multinomial naive Bayes over hashed words; its size depends on slots and classes alone."""

    classes: list[str]
    prior: np.ndarray
    weight: np.ndarray

    def predict(self, texts: list[str | None]) -> list[str]:
        slots = self.weight.shape[1]
        out = []
        for t in texts:
            s = self.prior.copy()
            for w in (t or "").lower().split():
                s += self.weight[:, zlib.crc32(w.encode()) % slots]
            out.append(self.classes[int(np.argmax(s))])
        return out


def fit_naive_bayes(rows: DataFrame, text: str, label: str, slots: int = 1 << 15, smooth: float = 0.5) -> NaiveBayes:
    """Counts over all labelled rows, combined on the map side; null labels and texts are left out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[tuple[str, int], int] = {}
        for b in batches:
            for t, c in zip(b["t"], b["c"], strict=True):
                n[c, -1] = n.get((c, -1), 0) + 1
                for w in t.lower().split():
                    k = (c, zlib.crc32(w.encode()) % slots)
                    n[k] = n.get(k, 0) + 1
        yield pd.DataFrame([(c, s, v) for (c, s), v in n.items()], columns=["c", "s", "n"])

    d = rows.select(F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("c")).filter("t IS NOT NULL AND c IS NOT NULL")
    got = d.mapInPandas(count, "c string, s int, n long").groupBy("c", "s").agg(F.sum("n").alias("n")).toPandas()
    classes = sorted(got["c"].unique()) or ["none"]
    w, prior = np.full((len(classes), slots), smooth), np.ones(len(classes))
    for i, c in enumerate(classes):
        x = got[got["c"] == c]
        words = x[x["s"] >= 0]
        w[i, words["s"].to_numpy()] += words["n"].to_numpy()
        prior[i] += float(x.loc[x["s"] < 0, "n"].sum())
    return NaiveBayes(classes, np.log(prior / prior.sum()), np.log(w / w.sum(1, keepdims=True)))


def classify(rows: DataFrame, text: str, model, out: str = "predicted") -> DataFrame:  # noqa: ANN001
    """Any model with ``predict(list of texts)``, in batches; other columns pass through."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def f(t: pd.Series) -> pd.Series:
        return pd.Series(shared.value.predict([None if pd.isna(x) else x for x in t]), index=t.index)

    return rows.withColumn(out, f(F.col(text).cast("string")))


# -- retrieval and fusion ------------------------------------------------------------------------


def mean_vector(vectors: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """The average of several context vectors per group, coordinate by coordinate."""
    c = vectors.select(*by, F.posexplode(vec).alias("i", "v")).groupBy(*by, "i").agg(F.avg("v").alias("v"))
    return c.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(vec))


def relevance_gate(hits: DataFrame, query: str, rank: str, judge: Column, most: int = 5, of: int = 20) -> DataFrame:
    """The first ``most`` hits judged relevant among the first ``of``."""
    d = hits.filter((F.col(rank) <= of) & judge)
    w = Window.partitionBy(query).orderBy(rank)
    return d.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= most).drop("__k")


def comb_sum(scores: DataFrame, query: str, voter: str, doc: str, score: str) -> DataFrame:
    """Rank aggregation: scores are scaled to 0..1 per query and voter (all equal: 1) and added up per
    document; equal sums rank by document."""
    g = scores.groupBy(query, voter).agg(F.min(score).alias("__a"), F.max(score).alias("__z"))
    s = scores.join(g, [query, voter])
    unit = F.when(F.col("__z") > F.col("__a"), (F.col(score) - F.col("__a")) / (F.col("__z") - F.col("__a"))).otherwise(1.0)
    t = s.withColumn("__u", unit).groupBy(query, doc).agg(F.sum("__u").alias("fused"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round("fused", 9)), doc)))


def outranking(ranks: DataFrame, query: str, voter: str, doc: str, rank: str, voters: int) -> DataFrame:
    """Per document, how many others a majority of voters ranks below it. Compared are the documents
    that were retrieved for a query, a top-k list; a missing rank counts as last."""
    docs = ranks.select(query, doc).distinct()
    full = docs.join(ranks.select(query, voter).distinct(), query).join(ranks, [query, voter, doc], "left").withColumn(rank, F.coalesce(rank, F.lit(2**31 - 1)))
    lists = full.groupBy(query, voter).agg(F.collect_list(F.struct(F.col(doc).alias("d"), F.col(rank).alias("r"))).alias("l"))
    wins = lists.select(query, F.explode("l").alias("x"), "l").select(query, F.col("x.d").alias(doc), F.explode(F.filter("l", lambda y: y["r"] > F.col("x.r"))).alias("y")).groupBy(query, doc, F.col("y.d").alias("__o")).agg(F.count("*").alias("n"))
    out = wins.filter(F.col("n") * 2 > voters).groupBy(query, doc).agg(F.count("*").alias("outranks"))
    return docs.join(out, [query, doc], "left").withColumn("outranks", F.coalesce("outranks", F.lit(0)))


def batches(df: DataFrame, order: str, size: int, out: str = "batch") -> DataFrame:
    """Consecutive batches of equal size in the order of a unique whole number, numbered exactly by
    range counts and offsets."""
    block = F.floor(F.col(order) / F.lit(100_000))
    counts = df.groupBy(block.alias("__b")).agg(F.count("*").alias("__n"))
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = df.withColumn("__b", block).join(base.drop("__n"), "__b")
    n = F.row_number().over(Window.partitionBy("__b").orderBy(order)) + F.col("__base") - 1
    return d.withColumn(out, F.floor(n / F.lit(size))).drop("__b", "__base")


def cumulative_counts(batched: DataFrame, batch: str = "batch") -> DataFrame:
    """Documents of the index after each batch."""
    n = batched.groupBy(batch).agg(F.count("*").alias("added"))
    return n.withColumn("indexed", F.sum("added").over(Window.orderBy(batch)))  # one row per batch


def history(answers: DataFrame, question: str, batch: str, answer: str) -> DataFrame:
    """Answers of each question in the order of their batches, as one list."""
    s = F.sort_array(F.collect_list(F.struct(batch, answer)))
    return answers.groupBy(question).agg(F.transform(s, lambda x: x[answer]).alias("answers"))


def distinct_pairs(pairs: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Each pair once, with its best score, best first."""
    return pairs.groupBy(*keys).agg(F.max(score).alias(score)).orderBy(F.desc(score), *keys)


Judge = Callable[[Column], Column]


def any_word(text: Column, words: list[str]) -> Column:
    """A simple judge: does the text hold one of the words?"""
    return reduce(lambda a, b: a | b, [F.lower(text).contains(w.lower()) for w in words])
