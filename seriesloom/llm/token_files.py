"""Token files: independent zstandard frames with a trailing seek table and a checksum a frame.

A file is, in this order: a skippable frame with the format's name and the bytes of an id; frames of ids; a
skippable frame with the documents (doc_id and number of ids each, compressed); and a skippable frame with the
seek table of the public zstandard seekable format: per frame its compressed size, its size and a checksum.
Any zstandard reader can inflate the whole; ours inflates the frames that a document lies in.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import columns, file_system, in_batches, load, sliced, stored
from seriesloom.llm.registry import query
from seriesloom.llm.tokens import encoder
from seriesloom.session import scratch_folder

#: Fixed values of the zstandard frame format and its seekable form.
SKIPPABLE_HEAD, SKIPPABLE_DOCS, SKIPPABLE_SEEK = 0x184D2A50, 0x184D2A51, 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

NAME = b"idframes1"
FRAME_IDS = 1 << 16
NULL_ID = -(2**63)  # stands for a missing doc_id in a file
FILE = pa.schema([("path", pa.string()), ("part", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
DOCUMENT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _skippable(magic: int, data: bytes) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


class FrameWriter:
    """Writes documents to an open stream. A frame ends with the document that fills it; a document of more
    than twice a frame's ids is cut into several frames, so memory holds two frames."""

    def __init__(self, stream, width: int, level: int):
        self.stream, self.width = stream, width
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int]] = []
        self.held, self.n_held = [], 0
        self.bytes = stream.write(_skippable(SKIPPABLE_HEAD, NAME + bytes([width])))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NULL_ID if doc_id is None else doc_id, len(ids)))
        ids = ids.astype(f"<u{self.width}")
        while self.n_held + len(ids) > 2 * FRAME_IDS:
            cut = FRAME_IDS - self.n_held if self.n_held < FRAME_IDS else 0
            self._hold(ids[:cut])
            self._flush()
            ids = ids[cut:]
        self._hold(ids)
        if self.n_held >= FRAME_IDS:
            self._flush()

    def _hold(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)

    def _flush(self) -> None:
        data = np.concatenate(self.held).tobytes() if self.held else b""
        self.held, self.n_held = [], 0
        if data:
            frame = self.pack(data)
            self.bytes += self.stream.write(frame)
            self.frames.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        table = np.array(self.docs, dtype="<i8").reshape(-1, 2).T.tobytes()
        self.bytes += self.stream.write(_skippable(SKIPPABLE_DOCS, self.pack(table)))
        seek = b"".join(struct.pack("<III", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.bytes += self.stream.write(_skippable(SKIPPABLE_SEEK, seek + foot))
        self.stream.close()


class FrameReader:
    """Random access to a token file through its seek table."""

    def __init__(self, path: str):
        fs, path = file_system(path)
        self.path, self.file = path, fs.open_input_file(path)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{path} has no seek table with checksums")
        seek = end - 9 - 12 * n - 8
        self.frames = list(struct.iter_unpack("<III", self._at(seek + 8, 12 * n)))
        magic, size = struct.unpack("<II", self._at(0, 8))
        head = self._at(8, size)
        if magic != SKIPPABLE_HEAD or head[:-1] != NAME:
            raise ValueError(f"{path} is no token file")
        self.width = head[-1]
        self.offsets = list(accumulate((f[0] for f in self.frames), initial=8 + size))
        self.ends = np.cumsum([f[1] for f in self.frames]) // self.width
        table = zstandard.decompress(self._at(self.offsets[-1] + 8, seek - self.offsets[-1] - 8))
        self.docs = np.frombuffer(table, "<i8").reshape(2, -1)
        self.starts = np.concatenate([[0], np.cumsum(self.docs[1])])
        self.last: tuple[int, np.ndarray] | None = None

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> np.ndarray:
        """The ids of frame ``k``; a wrong checksum raises."""
        if self.last is None or self.last[0] != k:
            packed, size, checksum = self.frames[k]
            data = zstandard.decompress(self._at(self.offsets[k], packed), max_output_size=size)
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {k} of {self.path} is damaged")
            self.last = k, np.frombuffer(data, f"<u{self.width}")
        return self.last[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        """The file's ids [start, end); only the frames they lie in are inflated."""
        out = []
        k = int(np.searchsorted(self.ends, start, side="right"))
        while start < end:
            first = int(self.ends[k - 1]) if k else 0
            out.append(self.frame(k)[start - first:end - first])
            start, k = int(self.ends[k]), k + 1
        return np.concatenate(out) if out else np.empty(0, f"<u{self.width}")

    def document(self, nth: int) -> np.ndarray:
        return self.ids(int(self.starts[nth]), int(self.starts[nth + 1]))


def write_token_files(df: DataFrame, folder: str, file: str, kind: str, end: int, level: int = 3) -> DataFrame:
    """Encode every whole text (null: empty), append the id ``end`` and write token files in ascending doc_id
    order: the order of files by ``part`` and of documents in a file. Returns path, part, documents, ids, bytes.

    Documents are range-partitioned by doc_id (null first, equal ids by their text) before they are encoded,
    so that texts are shuffled and ids never. A file takes its name when it is whole; a task that is
    repeated writes the same file again. No documents, no files.
    """
    width = 2 if end < 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            encode = encoder(file, kind)
            small = width == 2 and encode.tokenizer.get_vocab_size() <= 1 << 16
            part, out = TaskContext.get().partitionId(), None
            for batch in sliced(batches):
                for doc, text in zip(*columns(batch, "doc_id", "text")):
                    if out is None:
                        fs, path = file_system(f"{folder}/part-{part:06d}.ids")
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        temporary = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
                        out = FrameWriter(fs.open_output_stream(temporary), 2 if small else 4, level)
                    ids = np.frombuffer(encode.ids(text or ""), "<u4")
                    out.add(doc, np.append(ids, np.uint32(end)))
            if out is not None:
                out.close()
                fs.move(temporary, path)
                yield f"{folder}/part-{part:06d}.ids", part, len(out.docs), sum(n for _, n in out.docs), out.bytes
        yield from in_batches(rows(), FILE)

    docs = df.select(F.col("doc_id").cast("long"), "text")
    order = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return stored(order.mapInArrow(write, "path string, part long, documents long, ids long, bytes long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``
    (little-endian unsigned 32-bit). The driver sums one number a file to tell each file where it starts."""
    spark = files.sparkSession
    parts = files.orderBy("part").select("path", "ids").collect()
    starts = accumulate((r.ids for r in parts), initial=0)
    listed = spark.createDataFrame([(r.path, s) for r, s in zip(parts, starts)], "path string, first long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, first in zip(*columns(batch, "path", "first")):
                    reader = FrameReader(path)
                    for k, (doc, n) in enumerate(reader.docs.T.tolist()):
                        yield None if doc == NULL_ID else doc, first + int(reader.starts[k]), n, reader.document(k).astype("<u4").tobytes()
        yield from in_batches(rows(), DOCUMENT, 500)
    return listed.repartition(max(1, len(parts))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


@query("op1_token_files")
def op1(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    files = write_token_files(docs, scratch_folder(spark, "tokens"), "byte_bpe_50k.json", "byte", 2)
    return read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
