"""Packing of token sequences into fixed windows, online and in bounded space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import columns, in_batches, load, release, sliced, stored
from seriesloom.llm.registry import query
from seriesloom.llm.tokens import encoder

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                   ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("open", pa.bool_()), ("part", pa.int64())])
DDL = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean, part long")
MERGE = 512  # partitions whose leftovers meet in one task


class Packer:
    """A fixed number of open windows. A run of ids goes to the window with the least room that holds
    it; where none does, the fullest window is topped up with the run's first ids and emitted, and the
    rest of the run is placed anew. So an emitted window is full and a run is cut only there."""

    def __init__(self, size: int, windows: int, prefix: int):
        self.size, self.windows, self.next = size, windows, prefix
        self.open: list[list] = []  # [used, pieces]

    def _close(self, window: list, left: bool = False) -> Iterator[tuple]:
        offset = 0
        for doc, start, total, ids in window[1]:
            n = len(ids) // 4
            yield doc, start, n, total, self.next, offset, ids, left, None
            offset += n
        self.next += 1

    def add(self, doc: int | None, start: int, total: int, ids: bytes) -> Iterator[tuple]:
        while ids:
            n = len(ids) // 4
            if n >= self.size:
                yield from self._close([self.size, [(doc, start, total, ids[:4 * self.size])]])
                start, ids = start + self.size, ids[4 * self.size:]
                continue
            fits = [w for w in self.open if self.size - w[0] >= n]
            if fits:
                best = max(fits, key=lambda w: w[0])
                best[0] += n
                best[1].append((doc, start, total, ids))
                ids = b""
                if best[0] == self.size:
                    self.open.remove(best)
                    yield from self._close(best)
            elif len(self.open) < self.windows:
                self.open.append([n, [(doc, start, total, ids)]])
                return
            else:
                full = max(self.open, key=lambda w: w[0])
                room = self.size - full[0]
                full[1].append((doc, start, total, ids[:4 * room]))
                start, ids = start + room, ids[4 * room:]
                self.open.remove(full)
                yield from self._close(full)

    def merge(self) -> Iterator[tuple]:
        """The open windows poured into each other; what is left of the last one is marked as open."""
        rest = sorted(self.open, key=lambda w: -w[0])
        self.open, self.windows = [], 1
        for _, pieces in rest:
            for piece in pieces:
                yield from self.add(*piece)
        for window in self.open:
            yield from self._close(window, True)
        self.open = []


def pack(tokens: DataFrame, size: int = 2048, windows: int = 32) -> DataFrame:
    """Pack rows ``doc_id, ids`` (little-endian unsigned 32-bit integers) into sequences of ``size`` ids.

    Returns one row per piece: ``doc_id``, ``start`` (its document's ids before it), ``length``,
    ``doc_tokens``, ``sequence_id`` (unique, not gapless), ``offset`` in the sequence, ``ids``.

    Every partition packs what it reads with ``windows`` open windows (:class:`Packer`) and merges them at
    its end, which leaves less than one window. The leftovers of ``MERGE`` partitions are merged in one
    task, and so on until one is left: the only sequence of all that is not full. Memory holds one
    document and the open windows. Rows without ids give no piece; rows without doc_id or with the
    same one are packed like others; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows():
            packer = Packer(size, windows, part << 32)
            for batch in batches:
                for doc, ids in zip(*columns(batch, "doc_id", "ids")):
                    if ids:
                        yield from packer.add(doc, 0, len(ids) // 4, ids)
            for row in packer.merge():
                yield *row[:-1], part
        yield from in_batches(rows(), PIECE, 500)

    spark = tokens.sparkSession
    pieces = stored(tokens.select("doc_id", "ids").mapInArrow(run, DDL), "pieces")
    done, level = [pieces.where("not open")], 0
    left = pieces.where("open")
    while left.select("part").distinct().limit(2).count() > 1:
        level += 1
        pieces = stored(left.withColumn("part", F.expr(f"part div {MERGE}")).groupBy("part")
                        .applyInArrow(_merged(size, level), DDL), "leftovers")
        done.append(pieces.where("not open"))
        left = pieces.where("open")
    out = left
    for d in done:
        out = out.union(d)
    return out.drop("open", "part")


def _merged(size: int, level: int):
    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        part = table.column("part")[0].as_py()
        packer = Packer(size, 1, (level << 56) + (part << 32))
        names = ("doc_id", "start", "doc_tokens", "ids")
        rows = [r for piece in zip(*(table.column(n).to_pylist() for n in names)) for r in packer.add(*piece)]
        rows += packer.merge()
        rows = [(*r[:-1], part) for r in rows]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*rows), PIECE)], schema=PIECE)
    return merge


def tokenized(df: DataFrame, file: str, kind: str, end: int) -> DataFrame:
    """``doc_id, ids``: every whole text (null: empty) as ids, then the id ``end``."""
    last = np.array([end], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("tokens")
        ids = encoder(file, kind).ids

        def rows():
            for batch in sliced(batches):
                for doc, text in zip(*columns(batch, "doc_id", "text")):
                    yield doc, ids(text or "") + last
        yield from in_batches(rows(), schema, 500)
        release()
    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


@query("op6_packing")
def op6(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    pieces = pack(tokenized(docs, "word_bpe_49k.json", "word", 1))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
