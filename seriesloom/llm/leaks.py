"""Benchmark decontamination: rare words and word pairs as seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import U64, columns, in_batches, load, mix64, release, texts, word_hashes
from seriesloom.llm.registry import query

MATCH, MISS = 2, 1  # gained by a word in common; lost by another word, or one left out on either side
HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()),
                 ("end_word", pa.int64())])
DDL = "doc_id long, item_id long, score double, start_word long, end_word long"
FILTER_BITS = 22


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all ``n`` words in a row."""
    k = len(words) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    out = np.full(k, n, dtype=np.uint64)
    for i in range(n):
        out = mix64(out * U64(0xA0761D6478BD642F) + words[i:i + k])
    return out


class Lookup:
    """Finds which of many hashes are among a sorted few: a bit table turns nearly all others away."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.table = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.table[(known >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that are known, and which ones they are."""
        at = np.flatnonzero(self.table[(hashes >> U64(64 - FILTER_BITS)).astype(np.int64)])
        k = np.searchsorted(self.known, hashes[at])
        k[k == len(self.known)] = 0
        good = self.known[k] == hashes[at] if len(self.known) else np.zeros(len(at), bool)
        return at[good], k[good]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman over words with linear gaps: the best local score and the end of its first place in ``text``."""
    n = len(text)
    ramp = MISS * np.arange(n + 1)
    above = np.zeros(n + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        row = np.maximum(above - MISS, 0)
        np.maximum(row[1:], above[:-1] + np.where(text == word, MATCH, -MISS), out=row[1:])
        above = np.maximum.accumulate(row + ramp) - ramp  # a gap in the item costs MISS a word
        k = int(above.argmax())
        if above[k] > best or above[k] == best > 0 and k < end:
            best, end = int(above[k]), k
    return best, end


def passage(item: np.ndarray, window: np.ndarray, least: float) -> tuple[int, int, int] | None:
    """The best alignment of ``item`` in ``window``, if its score, as a share of a whole copy's, is at least
    ``least``: score, first and last-but-one word. The leftmost among equals."""
    m = len(item)
    if m <= len(window):
        for s in np.flatnonzero((window[:len(window) - m + 1] == item[0]) & (window[m - 1:] == item[-1])):
            if (window[s:s + m] == item).all():
                return MATCH * m, int(s), int(s) + m
    score, end = align(item, window)
    if score < least * MATCH * m:
        return None
    _, back = align(item[::-1], window[:end][::-1])
    return score, end - back, end


def runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin with ``first`` and hold ``many`` numbers each."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


class Group:
    """Items of similar length: their words and word pairs that stand in any document, and which of them are seeds.

    An alignment with M equal words, of which P follow their neighbour as in the item, has M - P runs with an edit
    between any two, so its score is at most 2 M - (M - P - 1) = M + P + 1: of an item's words and pairs, ``need``
    stand in its passage. An item's seeds are its rarest, so many that fewer than ``need`` are no seeds.
    A passage is at most ``span`` words long, as words left out or added cost MISS.
    """

    def __init__(self, items: list[int], sizes: list[int], met: list[np.ndarray], need: list[int], counts: np.ndarray, least: float):
        self.items, self.need = np.array(items), np.array(need)
        self.many = np.array([len(g) for g in met])
        self.first = np.cumsum(self.many) - self.many
        self.grams = np.concatenate(met)
        seeds = [g[np.argsort(counts[g], kind="stable")[:len(g) - n + 1]] for g, n in zip(met, need)]
        of = np.repeat(np.arange(len(items)), [len(g) for g in seeds])
        seeds = np.concatenate(seeds)
        order = np.argsort(seeds, kind="stable")
        self.seed_of = of[order]
        self.seed_many = np.bincount(seeds, minlength=len(counts))
        self.seed_first = np.cumsum(self.seed_many) - self.seed_many
        self.span = max(int(m + MATCH * m * max(1 - least, 0) / MISS) for m in sizes)
        self.width = 4 * self.span

    def possible(self, keys: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Items that may align where the words and pairs ``keys`` stand; ``present`` is all false."""
        seeds = keys[self.seed_many[keys] > 0]
        if not len(seeds):
            return self.items[:0]
        some = np.unique(self.seed_of[runs(self.seed_first[seeds], self.seed_many[seeds])])
        many = self.many[some]
        present[keys] = True
        hits = np.add.reduceat(present[self.grams[runs(self.first[some], many)]], np.cumsum(many) - many, dtype=np.int64)
        present[keys] = False
        return self.items[some[hits >= self.need[some]]]


def find_leaks(docs: DataFrame, items: DataFrame, least: float = 0.5, seed_words: int = 3, block: int = 20_000) -> DataFrame:
    """``doc_id, item_id, score, start_word, end_word``: the best passage of each document that aligns with a test item
    (``item_id``, ``text``) with at least ``least`` of a whole copy's score.

    Words are lower-cased runs of letters and digits. The items' words and pairs of words are counted over all
    documents; those that stand in none cannot help an alignment. Of the others an item keeps the rarest as seeds, so
    many that no passage with the asked score is without one, wherever it was edited (:class:`Group`). Documents
    are read in overlapping windows that hold any passage whole. Where a window has a seed, and as many of the item's
    words and pairs as that score takes, an alignment over the window decides.

    The items are the stated query set: they pass in blocks of ``block``, each broadcast with its seeds, and
    documents are neither joined nor shuffled. Items that are null or have fewer than ``seed_words`` words are no
    evidence and match nothing; null and empty texts have no passage. Rows that repeat give repeated
    results; with equal item_ids, each item gives its own row. Empty tables give empty results.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out, held = None, []
    for r in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        words = word_hashes((r.text or "").encode(), letters=True)
        if len(words) >= seed_words:
            held.append((r.item_id, words))
        if len(held) == block:
            found, held = _leaks_of(docs, held, least), []
            out = found if out is None else out.union(found)
    if held:
        found = _leaks_of(docs, held, least)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], DDL) if out is None else out


def _found(lookup: Lookup, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of known words and known pairs in their order, and which ones they are."""
    at, key = (np.concatenate(x) for x in zip(lookup.find(words), lookup.find(grams(words, 2))))
    order = np.argsort(at, kind="stable")
    return at[order], key[order]


def _leaks_of(docs: DataFrame, items: list[tuple[int, np.ndarray]], least: float) -> DataFrame:
    spark = docs.sparkSession
    per_item = [np.concatenate([words, grams(words, 2)]) for _, words in items]
    known = np.unique(np.concatenate(per_item))
    lookup = spark.sparkContext.broadcast(Lookup(known))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("leaks")
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for text in texts(batch.column("text")):
                if text:
                    total[np.unique(_found(lookup.value, word_hashes(text, True))[1])] += 1
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["g", "c"])

    counts = np.zeros(len(known), dtype=np.int64)  # one number a word or pair of the block
    for r in docs.select("text").mapInArrow(count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).collect():
        counts[r.g] = r.c
    known, counts, place = known[counts > 0], counts[counts > 0], np.where(counts > 0, np.cumsum(counts > 0) - 1, -1)
    by_length: dict[int, list[tuple]] = {}
    for k, hashes in enumerate(per_item):
        m = len(items[k][1])
        met = place[np.searchsorted(lookup.value.known, hashes)]
        met, need = met[met >= 0], max(ceil(least * MATCH * m - 1 - 1e-9), 1)
        if len(met) >= need:
            by_length.setdefault(m.bit_length(), []).append((k, m, met, need))
    groups = [Group(*map(list, zip(*rows)), counts, least) for rows in by_length.values()]
    shared = spark.sparkContext.broadcast((Lookup(known), groups, items))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, groups, items = shared.value
        present = np.zeros(len(lookup.known), dtype=bool)

        def rows():
            for batch in batches:
                for doc, text in zip(columns(batch, "doc_id")[0], texts(batch.column("text"))):
                    words = word_hashes(text or b"", True)
                    at, key = _found(lookup, words)
                    for group in groups:
                        best: dict[int, tuple[int, int, int]] = {}
                        for s in range(0, max(len(words) - group.span, 1), group.width - group.span):
                            lo, hi = np.searchsorted(at, (s, s + group.width))
                            for k in group.possible(key[lo:hi], present).tolist():
                                m = len(items[k][1])
                                if k in best and best[k][0] == MATCH * m:
                                    continue
                                hit = passage(items[k][1], words[s:s + group.width], least)
                                if hit and (k not in best or hit[0] > best[k][0]):
                                    best[k] = hit[0], s + hit[1], s + hit[2]
                        for k, (score, first, end) in best.items():
                            yield doc, items[k][0], score / (MATCH * len(items[k][1])), first, end
        yield from in_batches(rows(), HIT)
        release()
    return docs.mapInArrow(meet, DDL)


@query("op4_leaks")
def op4(spark, sf_dir):
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
