"""Removal of long byte strings that occur more than once in a corpus, by suffix sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import (BYTE_VALUES, U64, columns, in_batches, load, mix64, powers, prefix_hash, signed, sliced, span_hash,
                                   stored, texts)
from seriesloom.llm.registry import query
from seriesloom.llm.suffix_sort import suffix_array

BLOCK = 8  # bytes of a symbol
PIECE_STARTS = 1 << 20  # window starts of a text that are looked at together
SORT_BYTES = 1 << 20  # of pieces that are sorted together; the pieces under a key that has more are cut further
SHORTER = 8  # times, the pieces of such a key

ANCHOR = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()),
                    ("off", pa.int32()), ("n", pa.int32())])
PIECE = pa.schema([("core", pa.int64()), ("pd", pa.int64()), ("h", pa.int64()), ("d", pa.int64()), ("copies", pa.int64()),
                   ("off", pa.int32()), ("shift", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
RANGE = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def gram_of(length: int) -> int:
    """Bytes of an anchor."""
    return min(32, length // 2)


def chunk_of(length: int) -> int:
    """Window starts of a piece."""
    return min(64, length // 4)


def anchors(text: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Groups the starts of all ``length``-byte windows by the window's anchor, the leftmost of its grams with the
    least hash: arrays of anchor hash, anchor place, first start and number of starts. The anchor depends on
    the window's content alone, so equal windows have equal anchors at equal distances."""
    gram = gram_of(length)
    span = length - gram + 1
    for base in range(0, max(len(text) - length + 1, 0), PIECE_STARTS):
        part = np.frombuffer(text, np.uint8)[base:base + PIECE_STARTS + length - 1]
        starts = len(part) - length + 1
        prefix = prefix_hash(BYTE_VALUES[part])
        at = np.arange(len(part) - gram + 1)
        grams = mix64((prefix[gram:] - prefix[:-gram]) * powers(len(prefix), True)[:-gram])
        keys = (grams & ~U64((1 << 24) - 1)) | at.astype(np.uint64)
        rows = -(-len(keys) // span)
        grid = np.full(rows * span, ~U64(0), dtype=np.uint64)
        grid[:len(keys)] = keys
        grid = grid.reshape(rows, span)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen = (np.minimum(back[:starts], ahead[span - 1:span - 1 + starts]) & U64((1 << 24) - 1)).astype(np.int64)
        lo = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
        n = np.diff(np.concatenate([lo, [starts]]))
        yield grams[chosen[lo]], chosen[lo] + base, lo + base, n


def repeated_starts(pieces: list[tuple[bytes, int, int]], length: int) -> list[np.ndarray]:
    """For each piece (bytes, offset of its anchor from its first byte, number of window starts): which of
    its starts begin a window of ``length`` bytes that starts somewhere else in these pieces too.

    Bytes are read as symbols of 8 bytes counted from the anchor, and the suffixes of the symbol sequence are
    sorted. Windows with the same whole symbols are neighbours there; their bytes before the first and
    after the last whole symbol are compared as they are.
    """
    whole = (length - BLOCK + 1) // BLOCK  # symbols inside a window, wherever it starts
    rows, place, first_symbol = [], [], []
    total = 0
    for data, anchor, _ in pieces:
        pad = -anchor % BLOCK  # so that the anchor begins a symbol
        size = -(-(pad + len(data)) // BLOCK) + 1
        raw = np.zeros(size * BLOCK, np.uint8)
        raw[pad:pad + len(data)] = np.frombuffer(data, np.uint8)
        rows.append(raw.view(">u8"))
        place.append(pad)
        first_symbol.append(total)
        total += size + 1
    symbols = np.zeros(total + whole + 2, dtype=np.uint64)
    used = np.zeros(len(symbols), dtype=bool)
    for at, r in zip(first_symbol, rows):
        symbols[at:at + len(r)] = r
        used[at:at + len(r)] = True
    _, rank = np.unique(symbols, return_inverse=True)
    rank = np.where(used, rank + 1, 0)  # 0 ends a piece and sorts before all
    order = suffix_array(rank[:total])
    # The windows: their place in bytes, counted in symbols' bytes over all pieces.
    window = np.concatenate([at * BLOCK + pad + np.arange(n) for at, pad, (_, _, n) in zip(first_symbol, place, pieces)])
    head = -window % BLOCK  # bytes before the first whole symbol
    symbol = (window + head) // BLOCK
    needed = np.zeros(len(symbols), dtype=bool)
    needed[symbol] = True
    order = order[needed[order]]
    views = np.lib.stride_tricks.sliding_window_view(rank, whole)
    same = np.zeros(max(len(order) - 1, 0), dtype=bool)
    for at in range(0, len(same), 4096):
        near = order[at:at + 4097]
        same[at:at + 4096] = (views[near[:-1]] == views[near[1:]]).all(axis=1)
    group = np.full(len(symbols), -1)
    group[order] = np.cumsum(np.concatenate([[0], ~same]))[:len(order)]
    tail = length - head - whole * BLOCK
    before = symbols[symbol - 1] & ((U64(1) << (U64(8) * head.astype(np.uint64))) - U64(1))
    after_bits = (U64(8) * (BLOCK - tail).astype(np.uint64))
    next_symbol = symbols[symbol + whole]
    over = symbols[symbol + whole + 1]
    # A window's end may reach into a second symbol, where head + tail exceed one symbol.
    more = np.maximum(tail - BLOCK, 0).astype(np.uint64)
    after = np.where(tail >= BLOCK, next_symbol, np.where(tail > 0, next_symbol >> np.minimum(after_bits, U64(63)), U64(0)))
    extra = np.where(more > 0, over >> (U64(8) * (U64(BLOCK) - np.maximum(more, U64(1)))), U64(0))
    parts = (group[symbol], head, before, after, extra)
    by = np.lexsort(parts)
    equal = np.ones(len(by) - 1, dtype=bool)
    for c in parts:
        equal &= c[by][1:] == c[by][:-1]
    repeated = np.zeros(len(by), dtype=bool)
    repeated[by[1:][equal]] = True
    repeated[by[:-1][equal]] = True
    return np.split(repeated, np.cumsum([n for _, _, n in pieces])[:-1])


def _hash_of(data: bytes, *more: int) -> int:
    prefix = prefix_hash(BYTE_VALUES[np.frombuffer(data, np.uint8)])
    x = span_hash(prefix, np.array([0]), np.array([len(data)]))
    for m in more:
        x = mix64(x + U64(m & 0xFFFFFFFFFFFFFFFF))
    return int(signed(x)[0])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def pieces_of(data: bytes, h: int, off: int, n: int, length: int, chunk: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """Cuts ``n`` window starts from the first byte of ``data`` on, whose anchor ``h`` lies ``off`` bytes after it, where the
    distance to the anchor is a multiple of ``chunk``. For each piece: hashes of the bytes that all its windows share and of
    its own, offset of the anchor, first start, number of starts and bytes."""
    end = n
    while end > 0:
        nearest = off - (end - 1)
        c = nearest // chunk
        begin = max(end - 1 - (chunk * (c + 1) - 1 - nearest), 0)
        core = data[off - chunk * c:off - chunk * (c + 1) + 1 + length]
        piece = data[begin:end - 1 + length]
        yield _hash_of(core, h, c), _hash_of(piece, off - begin), off - begin, begin, end - begin, piece
        end = begin


def remove_repeated_strings(df: DataFrame, length: int = 400) -> DataFrame:
    """One row per row of ``df`` (``doc_id``, ``text``): ``doc_id``, ``n_bytes``, ``spans`` (maximal removed runs
    [start, end) of UTF-8 bytes) and ``kept`` (the other bytes). A byte goes if a string of ``length`` bytes that
    covers it also starts anywhere else, in the same text or another; matches stay within a text.

    1. Every window of ``length`` bytes belongs to its anchor, a gram chosen by the window's content. The
       windows of one anchor form a slice of the text. Slices whose anchor occurs once hold no repeat; of
       equal slices, all windows repeat, and one of them stands for all.
    2. Different slices of one anchor are cut into pieces of a few window starts, keyed by the bytes that all
       windows of the piece share. Keys that occur once hold no repeat. Different pieces under one key of more than
       ``SORT_BYTES`` are cut into shorter pieces with longer keys, in the end into single windows, whose keys are
       equal only where they are; so a frequent string may have any number of different surroundings.
    3. The pieces under a key are suffix-sorted (:mod:`suffix_sort`) and windows that are neighbours in that
       order are compared whole. Sorting works on the pieces of some keys at a time, so its memory does not
       grow with the corpus.
    4. The ranges found are merged in each text.

    Null texts are empty; texts shorter than ``length`` stay whole. Every row is a text of its own, so rows
    with the same text lose it (from ``length`` bytes on), doc_id or not. ``length`` is at least 16.
    """
    if length < 16:
        raise ValueError("length must be 16 or more")
    chunk = chunk_of(length)
    docs = df.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = columns(batch, "id", "th")
            for doc, th, text in zip(ids, ths, texts(batch.column("text"))):
                raw = np.frombuffer(text, np.uint8)
                for h, at, lo, n in anchors(text, length):
                    base, end = int(lo[0]), int(lo[-1] + n[-1]) + length - 1
                    prefix = prefix_hash(BYTE_VALUES[raw[base:end]])
                    d = mix64(span_hash(prefix, lo - base, lo - base + n + length - 1) + (at - lo).astype(np.uint64))
                    k = len(h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(h)), pa.array(signed(d)), pa.array([doc] * k, pa.int64()), pa.array([th] * k, pa.int64()),
                         pa.array(lo), pa.array((at - lo).astype(np.int32)), pa.array(n.astype(np.int32))], schema=ANCHOR)

    found = stored(docs.where(F.octet_length("text") >= length).mapInArrow(find, ddl(ANCHOR)), "anchors")
    frequent = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("d").alias("x"), F.max("d").alias("y"))
                      .where("c > 1").select("h", (F.col("x") != F.col("y")).alias("mixed")), "frequent")
    # Stored, and grouped by another name of h: the join has plain exchanges below it and its layout is not kept, so a
    # large h may be split and its copies are merged before they move. Any of equal slices may stand for them.
    place = ("id", "th", "lo", "off", "n")
    slices = stored(found.join(frequent, "h").withColumn("g", F.bitwise_not("h")).groupBy("g", "d")
                    .agg(F.count(F.lit(1)).alias("copies"), F.first("mixed").alias("mixed"),
                         *[F.first(c).alias(c) for c in place])
                    .select(F.bitwise_not("g").alias("h"), "d", "copies", "mixed", F.struct(*place).alias("one")), "slices")
    whole = slices.where("copies > 1").select("h", "d", F.lit(0).alias("first"), (F.col("one.n") - 1).alias("last"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                (lists,) = columns(batch, "slices")
                for wanted, text in zip(lists, texts(batch.column("text"))):
                    for s in wanted:
                        data = text[s["lo"]:s["lo"] + s["n"] - 1 + length]
                        for core, pd, off, begin, n, piece in pieces_of(data, s["h"], s["off"], s["n"], length, chunk):
                            yield core, pd, s["h"], s["d"], s["copies"], off, begin, n, piece
        yield from in_batches(rows(), PIECE, 5000)

    by_text = (slices.where("mixed").groupBy("one.id", "one.th")
               .agg(F.collect_list(F.struct("h", "d", "copies", "one.lo", "one.off", "one.n")).alias("slices")).toDF("_id", "_th", "slices"))
    # One of several equal rows is enough, and a text is read once.
    pieces = stored(docs.join(by_text, docs.id.eqNullSafe(F.col("_id")) & (docs.th == F.col("_th")))
                    .select("slices", "text").mapInArrow(cut, ddl(PIECE)), "pieces")

    def shorten(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for batch in sliced(batches):
                    for r in batch.to_pylist():
                        for core, pd, off, begin, n, piece in pieces_of(r["data"], r["h"], r["off"], r["n"], length, size):
                            # of a single window the key says all
                            yield core, pd if size > 1 else core, r["h"], r["d"], r["copies"], off, r["shift"] + begin, n, piece if size > 1 else None
            yield from in_batches(rows(), PIECE, 5000)
        return run

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(block: dict[tuple, list]) -> Iterator[tuple]:
            keys = list(block)
            of = dict(zip(keys, repeated_starts([(b[0]["data"], b[0]["off"], b[0]["n"]) for b in block.values()], length)))
            for key, same in block.items():
                flags = np.ones(same[0]["n"], bool) if len(same) > 1 or same[0]["copies"] > 1 else of[key]
                for first, last in _runs(flags):
                    for row in same:
                        yield row["h"], row["d"], row["shift"] + first, row["shift"] + last

        def rows():
            block, size, core = {}, 0, None
            for batch in batches:
                for row in batch.to_pylist():
                    if row["core"] != core and size >= SORT_BYTES:
                        yield from answers(block)
                        block, size = {}, 0
                    core = row["core"]
                    same = block.setdefault((core, row["pd"]), [])
                    if same:
                        row["data"] = None
                    else:
                        size += len(row["data"])
                    same.append(row)
            if block:
                yield from answers(block)
        yield from in_batches(rows(), RANGE, 20000)

    ranges = whole
    while True:
        cores = stored(pieces.groupBy("core").agg(F.sum("copies").alias("c"), F.min("pd").alias("x"), F.max("pd").alias("y"),
                                                  F.sum(F.col("n") + (length - 1)).alias("size"))
                       .where("c > 1").select("core", (F.col("x") != F.col("y")).alias("differ"), (F.col("size") > SORT_BYTES).alias("large")), "cores")
        large = cores.where("differ and large").select("core")
        met = pieces.join(cores.where("not (differ and large)").drop("large") if chunk > 1 else cores.drop("large"), "core")
        equal = met.where("not differ").select("h", "d", F.col("shift").alias("first"), (F.col("shift") + F.col("n") - 1).alias("last"))
        ranges = ranges.union(equal)
        if chunk > 1:
            ranges = ranges.union(met.where("differ").drop("differ").repartition("core").sortWithinPartitions("core", "pd")
                                  .mapInArrow(sort, ddl(RANGE)))
        if chunk == 1 or large.isEmpty():
            break
        chunk = max(chunk // SHORTER, 1)
        pieces = stored(pieces.join(large, "core").select(*PIECE.names).mapInArrow(shorten(chunk), ddl(PIECE)), "pieces")
    ranges = stored(ranges, "ranges")
    marked = (found.join(ranges, ["h", "d"]).groupBy("id", "th")
              .agg(F.collect_list(F.struct((F.col("lo") + F.col("first")).alias("a"),
                                           (F.col("lo") + F.col("last") + length).alias("b"))).alias("marks")).toDF("_id", "_th", "marks"))

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc, marks, text in zip(*columns(batch, "id", "marks"), texts(batch.column("text"))):
                    spans: list[list[int]] = []
                    for a, b in sorted((m["a"], m["b"]) for m in marks or ()):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                    kept = [text[x:y] for x, y in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)])]
                    yield doc, len(text), spans, b"".join(kept)
        yield from in_batches(rows(), RESULT, 500)

    return (docs.join(marked, docs.id.eqNullSafe(F.col("_id")) & (docs.th == F.col("_th")), "left")
            .select("id", "marks", "text").mapInArrow(strike, "doc_id long, n_bytes long, spans array<array<long>>, kept binary"))


@query("op9_repeated_strings", """
WITH b AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, pos, md5_number(substr(x, 2 * pos + 1, 800)) AS h
      FROM (SELECT doc_id, x, unnest(range(greatest(n - 399, 0))) AS pos FROM b)),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
e AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS step FROM r),
i AS (SELECT doc_id, pos, sum(CASE WHEN step <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM e),
s AS (SELECT doc_id, k, min(pos) AS a, max(pos) + 400 AS z FROM i GROUP BY 1, 2),
g AS (SELECT doc_id, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS following FROM s),
t AS (SELECT g.doc_id, sum(z - a)::BIGINT AS gone, count(*) AS spans,
        any_value(substr(x, 1, 2 * first_a)) || string_agg(substr(x, 2 * z + 1, 2 * (coalesce(following, n) - z)), '' ORDER BY a) AS kept
      FROM g JOIN b ON b.doc_id = g.doc_id
      JOIN (SELECT doc_id, min(a) AS first_a FROM s GROUP BY 1) m ON m.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT b.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256, coalesce(spans, 0) > 0 AS has_repeat
FROM b LEFT JOIN t ON t.doc_id = b.doc_id
""")
def op9(spark, sf_dir):
    out = remove_repeated_strings(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                      (F.size("spans") > 0).alias("has_repeat"))
