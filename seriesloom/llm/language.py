"""Language identification by known words with back-off to character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from seriesloom.llm.common import columns, in_batches, load, release, sliced, stored
from seriesloom.llm.registry import query

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 100_000
BROADCAST_LANGUAGES = 10_000


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased. Numerals that are no digits, as ½ and Ⅷ, are no letters."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


class Model:
    """Log frequencies of words and character n-grams in each language, and the scores of words made from them."""

    def __init__(self, counts: dict[str, dict[int, dict[str, int]]], longest: int, penalty: float = 7.0):
        """``counts``: by language, then by n (0: whole words), then by word or n-gram."""
        self.languages, self.longest = sorted(counts), longest
        self.tables: list[dict[str, list[float]]] = []
        for n in range(longest + 1):
            table: dict[str, list[float]] = {}
            for k, lang in enumerate(self.languages):
                grams = counts[lang].get(n, {})
                total = log10(max(sum(grams.values()), 1))
                for g, c in grams.items():
                    table.setdefault(g, [penalty] * len(self.languages))[k] = total - log10(c)
            self.tables.append(table)

    def word(self, word: str) -> list[float]:
        """Its negative log frequency by language; for an unknown word the mean over its known n-grams of the
        greatest n that has any; not a number if nothing is known."""
        if word in self.tables[0]:
            return self.tables[0][word]
        padded = f" {word} "
        for n in range(self.longest, 0, -1):
            table = self.tables[n]
            found = [table[g] for g in [padded[i:i + n] for i in range(len(padded) - n + 1)] if g in table]
            if found:
                return [sum(c) / len(found) for c in zip(*found)]
        return [float("nan")] * len(self.languages)


class Scorer(dict):
    """Row numbers of words in a table of their scores, which grows with the words met. When it is full, words
    that were not met since it last filled up are forgotten."""

    def __init__(self, model: Model):
        self.model, self.rows = model, np.empty((REMEMBERED + 1, len(model.languages)))
        self.before: dict[str, int] = {}
        self.rows_before = self.rows

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.rows):  # one text of very many words
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        old = self.before.get(word)
        self.rows[k] = self.model.word(word) if old is None else self.rows_before[old]
        self[word] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        if len(self) > REMEMBERED:
            self.before, self.rows_before = dict(self), self.rows
            self.rows = np.empty((REMEMBERED + 1, len(self.model.languages)))
            self.clear()
        words = words_of(text) if text else []
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        known = self.rows[at]
        known = known[~np.isnan(known[:, 0])]
        if not len(known):
            return self.model.languages[0], 1 / len(self.model.languages)
        mean = known.mean(axis=0)
        best = int(mean.argmin())
        return self.model.languages[best], float(1 / (10.0 ** (mean[best] - mean)).sum())


def train(labelled: DataFrame, rows: int = 5000, words: int = 20_000, grams: int = 5000, longest: int = 5) -> Model:
    """A model from ``text`` and ``lang`` of the given rows; those without either are left out.

    The classifier is fitted on a bounded sample: about ``rows`` rows a language, chosen by a hash of their
    text and, where there is one, doc_id, so that copies of a text are neither all in nor all out. It keeps the
    ``words`` commonest words and, for each n up to ``longest``, the ``grams`` commonest n-grams of each language, so what the driver gathers and the tasks share is bounded by these and the
    number of languages. Ties in frequency go to the smaller string.
    """
    key = [c for c in ("text", "doc_id") if c in labelled.columns]
    usable = labelled.where("lang is not null and text is not null").select("lang", *key)
    per_language = stored(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    if per_language.count() <= BROADCAST_LANGUAGES:  # else joined as Spark sees fit
        per_language = F.broadcast(per_language)
    share = F.pmod(F.xxhash64(*key), F.lit(1 << 20)) < F.col("_rows") / F.col("n") * (1 << 20)
    sample = usable.join(per_language, "lang").withColumn("_rows", F.lit(rows)).where(share)
    counted = sample.select("lang", "text").mapInArrow(_count_words, "lang string, word string, c long")
    word = counted.groupBy("lang", "word").agg(F.sum("c").alias("c"))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    each = [F.expr(f"transform(sequence(1, length(p) - {n - 1}), i -> struct({n} AS n, substring(p, i, {n}) AS g))")
            for n in range(1, longest + 1)]
    long_enough = [F.when(F.length("p") >= n, e).otherwise(F.array().cast("array<struct<n:int,g:string>>")) for n, e in zip(range(1, longest + 1), each)]
    pieces = (word.withColumn("p", padded).select("lang", "c", F.explode(F.concat(*long_enough)).alias("x"))
              .groupBy("lang", "x.n", "x.g").agg(F.sum("c").alias("c")))
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "g"))
    top = lambda df, k: df.withColumn("k", rank).where(F.col("k") <= k).select("lang", "n", "g", "c")
    kept = top(word.select("lang", F.lit(0).alias("n"), F.col("word").alias("g"), "c"), words).union(top(pieces, grams))
    counts: dict = {}
    for r in kept.toLocalIterator():
        counts.setdefault(r.lang, {}).setdefault(r.n, {})[r.g] = r.c
    return Model(counts, longest)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("c", pa.int64())])
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(*columns(batch, "lang", "text")):
            counts.update((lang, w) for w in words_of(text))
        yield from in_batches(((*k, c) for k, c in counts.items()), schema, 50_000)


def identify(df: DataFrame, model: Model, records: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text alone; with ``records``, ``record`` (all
    columns of ``df``) instead of ``doc_id``.

    Each word (run of letters, lower-cased) scores by its log frequency where the model knows it, else by
    ever shorter n-grams; the language with the best mean wins, the first by name among equals, and ``score`` is
    its share of the languages' likelihoods at that mean, 0 to 1. Texts that are null or hold no letter are
    ``und`` with score 0, as is all if nothing was learned; letters the model never met give the first
    language at chance. The model is bounded (:func:`train`), so it is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    carried = df.select(F.struct("*").alias("record")) if records else df.select(F.col("doc_id").cast("long"), "text")
    first = carried.schema.fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("language")
        scorer = Scorer(shared.value)
        for batch in sliced(batches):
            kept = batch.column(0)
            text = kept.field("text") if records else batch.column("text")
            told = [scorer.predict(t) for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([kept, pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())],
                                             names=[first.name, "lang_pred", "score"])
        del scorer
        release()
    schema = StructType([first, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return carried.mapInArrow(run, schema)


def remainder():
    """What tells held-out rows (2) from those to learn from; null without doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


@query("op3_language")
def op3(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    out = identify(docs, train(docs.where(remainder() != 2)))
    return out.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
