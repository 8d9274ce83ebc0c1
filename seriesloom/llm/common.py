"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from seriesloom.session import scratch_folder

U64 = np.uint64


#: What a worker process keeps from task to task, by the name of its owner: how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def release(owner: str | None = None) -> None:
    """Gives freed memory back to the system. Worker processes outlive a stage, so an operator names itself (``owner``)
    when its task begins, and what others keep is dropped first."""
    if owner is not None:
        for name, drop in KEPT.items():
            if name != owner:
                drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to a new table in the shared scratch folder and read it back: the lineage is
    cut, and a lost executor costs a re-read."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's URI or absolute path; any store that Arrow can reach."""
    if uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:").replace("//", "/", 1) if not uri.startswith("file:///") else uri
    return pafs.FileSystem.from_uri(uri)


def texts(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of ``size`` rows; one empty batch if there are none."""
    empty = True
    while chunk := list(itertools.islice(rows, size)):
        empty = False
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*chunk), schema, strict=True)], schema=schema)
    if empty:
        yield pa.RecordBatch.from_arrays([pa.array([], type=f.type) for f in schema], schema=schema)


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows, sorted by ``keys``, in tables that never part rows with equal keys (no key is null)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if held and any(held[-1].column(k)[-1].as_py() != v[0] for k, v in zip(keys, now)):
            yield pa.Table.from_batches(held)
            held = []
        changes = np.flatnonzero(np.any([v[1:] != v[:-1] for v in now], axis=0))
        if len(changes):
            cut = int(changes[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.astype(np.uint64, copy=False).view(np.int64)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
BYTE_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of a fixed odd number, or of its inverse, modulo 2**64."""
    got = _powers.get(inverse)
    if got is None or len(got) < n:
        size = max(n, 1 << 17)
        step = np.full(size, _INVERSE if inverse else _BASE, dtype=np.uint64)
        step[0] = 1
        got = _powers[inverse] = np.multiply.accumulate(step)
    return got[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` gets the hash of any span."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal contents give equal values, wherever they stand."""
    return mix64((prefix[end] - prefix[start]) * powers(len(prefix), True)[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_VALUES = BYTE_VALUES[_LOWER]
_NO_LETTER = np.zeros(256, dtype=bool)
_NO_LETTER[[b for b in range(128) if not chr(b).isalnum()]] = True
_PIECE = 1 << 20


def word_hashes(text: bytes, letters: bool = False) -> np.ndarray:
    """64-bit hashes of the words (runs without ASCII white space, A-Z lower-cased) in their order; with
    ``letters``, ASCII punctuation parts words too. Long texts are worked off in pieces that end between words."""
    out, at = [], 0
    gap = _NO_LETTER if letters else _SPACE
    while at < len(text):
        end = min(at + _PIECE, len(text))
        while end < len(text) and not gap[text[end]]:
            end += 1
        raw = np.frombuffer(text, np.uint8, end - at, at)
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = ~gap[raw]
        edge = np.diff(inside)
        prefix = prefix_hash(_LOWER_VALUES[raw])
        out.append(span_hash(prefix, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` words in a row; of all words, if there are fewer; none without words."""
    if not len(words):
        return words
    n = max(len(words) - size + 1, 1)
    k = min(size, len(words))
    rolled = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        rolled = mix64(rolled * U64(0xD6E8FEB86659FD93) + words[i:i + n])
    return np.unique(rolled)
