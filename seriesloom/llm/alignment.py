"""Alignment of two tokenizers by products of token-byte incidence matrices."""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import columns, load, release, sliced, stored
from seriesloom.llm.registry import query
from seriesloom.llm.tokens import encoder, vocabulary

SPACE = "▁"
REMEMBERED = 300_000  # words of spaces and what follows them
SHIFT = 16  # an id pair as one number: the A id times 2**16 plus the B id
CHUNK = 1 << 18  # bytes whose matrices are multiplied together, up to the next common end
BROADCAST_PAIRS = 1_000_000  # id pairs (16 bytes each) up to which the counts are broadcast

ROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                 ("n_links", pa.int64()), ("n_shared", pa.int64()), ("groups_sha256", pa.string()),
                 ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
ROW_DDL = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, "
           "pairs array<long>, times array<int>")


class Csr(NamedTuple):
    """A sparse matrix by rows: row i holds ``data`` at the columns ``indices`` from ``indptr[i]`` to ``indptr[i + 1]``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    width: int


def incidence(ends: np.ndarray, size: np.ndarray | None = None) -> Csr:
    """Rows are neighbouring runs that end at ``ends``; columns are the places they cover, each with its entry of ``size``."""
    width = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]), np.arange(width), np.ones(width, np.int64) if size is None else size, width)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.indices, kind="stable")
    row = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.width))])
    return Csr(indptr, row[order], m.data[order], len(m.indptr) - 1)


def product(a: Csr, b: Csr, most: int = 1 << 20) -> Csr:
    """Row by row: row i of the product is the sum of b's rows k, each times a's entry (i, k). The entries of some rows of
    ``a`` at a time are written out, put in order and added up, ``most`` of them unless one row has more."""
    entries = np.diff(b.indptr)[a.indices]
    before = np.concatenate([[0], np.cumsum(entries)])[a.indptr]  # entries written out before each row of a
    counts, indices, data = [], [], []
    at, rows = 0, len(a.indptr) - 1
    while at < rows:
        end = max(int(np.searchsorted(before, before[at] + most, side="right")) - 1, at + 1)
        cells = slice(a.indptr[at], a.indptr[end])
        n = entries[cells]
        row = np.repeat(np.repeat(np.arange(end - at), np.diff(a.indptr[at:end + 1])), n)
        place = np.arange(len(row)) + np.repeat(b.indptr[a.indices[cells]] - (np.cumsum(n) - n), n)
        key = row * b.width + b.indices[place]
        value = np.repeat(a.data[cells], n) * b.data[place]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
        counts.append(np.bincount(key[first] // b.width, minlength=end - at) if len(first) else np.zeros(end - at, int))
        indices.append(key[first] % b.width if len(first) else key)
        data.append(np.add.reduceat(value, first) if len(first) else value)
        at = end
    joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (counts, indices, data)]
    return Csr(np.concatenate([[0], np.cumsum(joined[0])]).astype(np.int64), joined[1], joined[2], b.width)


class Pieces:
    """Text to piece ids as little-endian unsigned 32-bit integers, as the model gives them for the whole text.

    No piece holds a space after another character, so runs of spaces with the word behind them are encoded
    by themselves, each distinct one once as long as it is remembered."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.words = re.compile(" +[^ ]*").findall
        self.space = np.array([self.model.piece_to_id(SPACE)], "<u4").tobytes()
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            self.words = lambda text: [text]  # such pieces may join words: every text by itself
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.known: dict[str, bytes] = {" ": self.space}
        self.before: dict[str, bytes] = {}
        self.lossy: set[str] = set()  # words whose pieces' bytes are others than theirs

    def ids(self, text: str) -> tuple[bytes, bool]:
        """The ids, and whether every word is kept by its pieces."""
        known = self.known
        if len(known) > REMEMBERED:
            self.before, self.known = known, {" ": self.space}
            known = self.known
            self.lossy &= self.before.keys()
        words = self.words(" " + text)
        new = set(words).difference(known)
        if new:
            known.update([(w, self.before[w]) for w in new if w in self.before])
            learn = [w for w in new if w not in self.before]
            if learn:
                found = self.model.encode([w[1:] for w in learn], num_threads=1)
                known.update(zip(learn, [array("I", ids).tobytes() for ids in found]))
                pieces = self.bytes
                self.lossy.update(w for w, ids in zip(learn, found) if b"".join([pieces[k] for k in ids]) != w.encode())
        return b"".join(map(known.__getitem__, words)), not self.lossy or self.lossy.isdisjoint(words)


class Vocabularies:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, a: str, b: str, folder: str | None = None):
        self.a = encoder(a, "byte", folder, plain=True)
        self.b = Pieces(vocabulary(b, folder))
        byte_of = _byte_letters()
        size = self.a.tokenizer.get_vocab_size()
        special = {t.content for t in self.a.tokenizer.get_added_tokens_decoder().values()}
        entries = [self.a.tokenizer.id_to_token(k) or "" for k in range(size)]
        self.a_bytes = [e.encode() if e in special else bytes(byte_of[c] for c in e) for e in entries]
        self.b_bytes = self.b.bytes
        # Nothing is rewritten and every byte has an entry, so the joined bytes of A's entries are always the text's.
        self.a_whole = self.a.tokenizer.normalizer is None and {bytes([k]) for k in range(256)} <= set(self.a_bytes)
        self.a_size, self.b_size = (np.array([len(e) for e in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # An id's decimal digits and what follows it: "," inside a side, "|" after A's last, ";" after B's last.
        most = max(size, len(self.b_bytes))
        self.told = np.array([f"{k}{c}" for c in ",|;" for k in range(most)], dtype=object).reshape(3, most)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """A text's ids on both sides; none where the joined bytes of either differ from a space and the text."""
        if text:
            (b, kept), a = self.b.ids(text), self.a.ids(" " + text)
            a, b = (np.frombuffer(x, "<u4").astype(np.int64) for x in (a, b))
            whole = (" " + text).encode()
            if (self.a_whole or b"".join([self.a_bytes[k] for k in a.tolist()]) == whole) and (
                    kept or b"".join([self.b_bytes[k] for k in b.tolist()]) == whole):
                return a, b
        return np.empty(0, np.int64), np.empty(0, np.int64)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others,
    in ascending order, for the code points from 256 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Alignment(NamedTuple):
    """``a`` and ``b`` index the tokens of a link, ``overlap`` is its number of shared bytes; ``group_a`` and ``group_b`` give each
    token's group, ``cuts`` the groups' ends, ``shared`` the
    number of B tokens in each A token's group."""

    a: np.ndarray
    b: np.ndarray
    overlap: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    cuts: np.ndarray
    shared: np.ndarray


def align(a_size: np.ndarray, b_size: np.ndarray) -> Alignment:
    """Links of two token sequences over the same bytes, from their tokens' sizes in bytes.

    A·Bᵀ of the token-byte incidence matrices holds, for each A and B token, the bytes they share; neighbouring bytes
    that no token end parts have equal columns, which are kept once, with their number as A's entry. Groups
    lie between offsets where tokens of both end; Gaᵀ·Gb of the group-token incidence matrices holds the pairs of one
    group. Long sequences are worked off in pieces that end at a common offset, so memory does not grow with their square."""
    ends_a, ends_b = np.cumsum(a_size), np.cumsum(b_size)
    before_a, before_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)  # the other side's ends below each end
    common = [np.append(other, -1)[k] == own for own, other, k in ((ends_a, ends_b, before_a), (ends_b, ends_a, before_b))]
    cuts = ends_a[common[0]]
    group_a, group_b = (np.cumsum(c) - c for c in common)
    column_a, column_b = (np.arange(len(g)) + k - g for g, k in ((group_a, before_a), (group_b, before_b)))  # ends at columns' ends
    out, start, at = [], 0, 0
    while at < len(cuts):
        last = min(max(int(np.searchsorted(cuts, start + CHUNK)), at), len(cuts) - 1)
        (a0, a1), (b0, b1) = (np.searchsorted(g, [at, last + 1]) for g in (group_a, group_b))
        first = column_a[a0 - 1] + 1 if a0 else 0
        in_a, in_b = column_a[a0:a1] + 1 - first, column_b[b0:b1] + 1 - first
        stops = np.empty(in_a[-1], np.int64)
        stops[in_a - 1], stops[in_b - 1] = ends_a[a0:a1], ends_b[b0:b1]
        links = product(incidence(in_a, np.diff(stops, prepend=start)), transposed(incidence(in_b)))
        of_a, of_b = (incidence(np.searchsorted(g[x:y], np.arange(at, last + 1), side="right")) for g, x, y in ((group_a, a0, a1), (group_b, b0, b1)))
        out.append((np.repeat(np.arange(a0, a1), np.diff(links.indptr)), links.indices + b0, links.data, np.diff(product(transposed(of_a), of_b).indptr)))
        start, at = int(cuts[last]), last + 1
    a, b, overlap, shared = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 4
    return Alignment(a, b, overlap, group_a, group_b, cuts, shared)


def groups_words(told: np.ndarray, a: np.ndarray, b: np.ndarray, found: Alignment) -> list[str]:
    """``a1,a2|b1;a3|b2,b3;`` as a list with an entry an id: per group its A ids, then its B ids."""
    end_a = np.append(found.group_a[1:] != found.group_a[:-1], True)
    end_b = np.append(found.group_b[1:] != found.group_b[:-1], True)
    words = np.concatenate([told[end_a.astype(np.int64), a], told[2 * end_b.astype(np.int64), b]])
    order = np.argsort(np.concatenate([2 * found.group_a, 2 * found.group_b + 1]), kind="stable")
    return words[order].tolist()


def align_texts(both: Vocabularies, texts: list[str | None]) -> Iterator[tuple]:
    """Per text (n_a, n_b, n_groups, n_links, n_shared, groups_sha256, pairs, times). The texts are laid end to end, where both sides end,
    and aligned together."""
    ids = [both.encode(t) for t in texts]
    n_a, n_b = (np.array([len(x[side]) for x in ids], np.int64) for side in (0, 1))
    a, b = (np.concatenate([x[side] for x in ids]) if ids else np.empty(0, np.int64) for side in (0, 1))
    found = align(both.a_size[a], both.b_size[b])
    doc_of_a = np.repeat(np.arange(len(ids)), n_a)
    doc_of_link = doc_of_a[found.a]
    n_links = np.bincount(doc_of_link, minlength=len(ids))
    last_of_group = np.flatnonzero(np.append(found.group_a[1:] != found.group_a[:-1], True)) if len(a) else np.empty(0, np.int64)
    n_groups = np.bincount(doc_of_a[last_of_group], minlength=len(ids))
    n_shared = np.bincount(doc_of_a, weights=found.shared, minlength=len(ids)).astype(np.int64)
    pair, times = np.unique((doc_of_link << 2 * SHIFT) | (a[found.a] << SHIFT) | b[found.b], return_counts=True)
    first = np.searchsorted(pair >> 2 * SHIFT, np.arange(len(ids) + 1))
    pair &= (1 << 2 * SHIFT) - 1
    words, at = groups_words(both.told, a, b, found) if len(a) else [], 0
    for k, n in enumerate((n_a + n_b).tolist()):
        told = "".join(words[at:at + n])[:-1]
        at += n
        here = slice(first[k], first[k + 1])
        yield (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), int(n_shared[k]),
               hashlib.sha256(told.encode()).hexdigest() if n else "", pair[here], times[here].astype(np.int32))


def align_documents(df: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """One row per row of ``df`` (``doc_id``, ``text``): its tokens by both vocabularies (``n_a``, ``n_b``), groups, links (pairs of tokens
    that share bytes), ``n_shared`` (pairs in one group), ``groups_sha256``, and each linked pair of ids (``pairs``, A id * 2**16 + B id)
    with the ``times`` it is linked there; ``row`` is a number of its own.

    Special tokens' strings are plain text. Texts that are null, empty, or whose joined bytes on either side differ from a
    space and the text have no tokens: zeros, no pairs and an empty ``groups_sha256``. Rows with the same or no doc_id are documents
    of their own; other columns are not read; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("tokens")
        both = Vocabularies(a, b, folder)
        gc.disable()  # very many small lists and no cycles

        def some() -> Iterator[tuple[list, list, list]]:
            held, size = ([], [], []), 0
            for batch in sliced(batches):
                for row in zip(*columns(batch, "row", "doc_id", "text")):
                    for column, value in zip(held, row):
                        column.append(value)
                    size += len(row[2] or "")
                    if size >= CHUNK or len(held[0]) == 1000:
                        yield held
                        held, size = ([], [], []), 0
            yield held

        for rows, docs, texts in some():
            out = [(*keys, *x) for keys, x in zip(zip(rows, docs), align_texts(both, texts))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out) if out else [[]] * len(ROW), ROW)], schema=ROW)
        gc.enable()
        release()

    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, ROW_DDL)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n`` (documents that hold it linked), ``best`` (whether no pair with its A id has more)."""
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    a = F.shiftright("pair", SHIFT).alias("a")
    top = counts.groupBy(a).agg(F.max("n").alias("top"))  # a row an A id: bounded by the vocabulary
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def score_links(aligned: DataFrame) -> DataFrame:
    """``aligned`` (stored) with ``n_best``, the links whose pair is its A id's most frequent one, ties included, and
    ``count_sum``, the sum of the pairs' counts over the links.

    Counts of few pairs are broadcast and summed where the documents lie; more of them (the vocabularies allow
    many) are joined by shuffle, where skewed pairs may be split."""
    counts = stored(pair_counts(aligned), "pair-best")
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
    scored = each.join(counts, F.col("pairs") == F.col("pair")).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return (aligned.drop("pairs", "times").join(scored, "row", "left")
            .withColumn("n_best", F.coalesce("n_best", F.lit(0)).cast("long")).withColumn("count_sum", F.coalesce("count_sum", F.lit(0)).cast("long")))


@query("op13_token_alignment")
def op13(spark, sf_dir):
    aligned = stored(align_documents(load(spark, sf_dir, "documents")), "aligned")
    return score_links(aligned).drop("row")
