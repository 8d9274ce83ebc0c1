"""WARC archives: written as one gzip stream a file, normalised to one gzip member a record with an index."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import columns, file_system, in_batches, load, stored, texts
from seriesloom.llm.registry import query
from seriesloom.session import scratch_folder

#: Fixed values of the WARC 1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"

PAGE_URN, GZIP, CHUNK = "urn:page:", 31, 1 << 20
FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORDS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()),
                     ("record_type", pa.string()), ("target", pa.string()), ("refers_to", pa.string()),
                     ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double", pa.int32(): "int"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload`` (null html: empty), and ``first_id``: for a page whose payload of at least
    ``min_bytes`` bytes also stands under a smaller page_id, the smallest such id, else null.

    Equal payloads are counted by digest before the join, so a payload shared by a third of all pages
    is one row there; the join's large side may be split. Rows without page_id refer to others, never
    the reverse; rows that agree in page_id and payload are one page, each a response or each a revisit.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload"))
    shared = (p.where(F.octet_length("payload") >= min_bytes).groupBy("sha1")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    other = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull())
    return p.join(shared, "sha1", "left").select("page_id", "url", "payload", F.when(other, F.col("first_id")).alias("first_id"))


def _clean(value: str) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, date: str) -> bytes:
    """One WARC record: a response, or a revisit of page ``first_id`` that keeps the HTTP head only."""
    head = [("WARC-Type", "response" if first_id is None else "revisit"), ("WARC-Record-ID", f"<{PAGE_URN}{page_id}>"),
            ("WARC-Date", date), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first_id is None:
        block += payload
    else:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{PAGE_URN}{first_id}>")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Out:
    """A file that takes its final name only when it is whole, so a lost or repeated task leaves no partial file."""

    def __init__(self, path: str):
        self.fs, self.path = file_system(path)
        self.part = f"{self.path}.{TaskContext.get().taskAttemptId()}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.file = self.fs.open_output_stream(self.part)

    def done(self) -> None:
        self.file.close()
        self.fs.move(self.part, self.path)


def write_monolithic(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write the rows of :func:`with_revisits` as WARC files, each one gzip stream. Returns path, records, bytes."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            out, n, size = None, 0, 0
            for batch in batches:
                for row in zip(*columns(batch, "page_id", "url", "payload", "first_id")):
                    if out is None:
                        path = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.gz"
                        out, packer = _Out(path), zlib.compressobj(level, wbits=GZIP)
                    size += out.file.write(packer.compress(record_bytes(*row, date)))
                    n += 1
            if out is not None:
                size += out.file.write(packer.flush())
                out.done()
                yield path, n, size
        yield from in_batches(rows(), FILES)
    return stored(pages.mapInArrow(write, ddl(FILES)), "warc-files")


def _inflated(path: str) -> Iterator[bytes]:
    """The content of a gzip file, of one member or many, in chunks."""
    fs, path = file_system(path)
    with fs.open_input_stream(path, compression=None) as f:
        unpack = zlib.decompressobj(wbits=GZIP)
        while data := f.read(CHUNK):
            while data:
                out = unpack.decompress(data, CHUNK)
                yield out
                while not unpack.eof and (unpack.unconsumed_tail or len(out) == CHUNK):
                    out = unpack.decompress(unpack.unconsumed_tail, CHUNK)
                    yield out
                data = unpack.unused_data
                if unpack.eof:
                    unpack = zlib.decompressobj(wbits=GZIP)


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and the bytes of every record of an inflated stream. Holds one record."""
    held = bytearray()

    def more() -> bool:
        for chunk in chunks:
            if chunk:
                held.extend(chunk)
                return True
        return False
    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("WARC stream ends inside a record head")
                return
        fields = parse_head(bytes(held[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("WARC stream ends inside a record")
        yield fields, bytes(held[:size])
        del held[:size]


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def normalise(files: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Inflate every archive of ``files`` (column ``path``) once, as a stream, and write it anew with each
    record a gzip member of its own, plus ``<archive>.idx``: one JSON line a record with its offset, length,
    id, type and digest. Returns path, records, bytes of the new archives. Memory holds one record."""
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for (old,) in zip(*columns(batch, "path")):
                    path = f"{folder}/{old.rpartition('/')[2]}"
                    out, index, offset, n = _Out(path), _Out(f"{path}.idx"), 0, 0
                    for fields, record in split_records(_inflated(old)):
                        packer = zlib.compressobj(level, wbits=GZIP)
                        member = packer.compress(record) + packer.flush()
                        out.file.write(member)
                        line = {"offset": offset, "length": len(member), "id": fields.get("warc-record-id"),
                                "type": fields.get("warc-type"), "digest": fields.get("warc-payload-digest")}
                        index.file.write(json.dumps(line).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
                    out.done()
                    index.done()
                    yield path, n, offset
        yield from in_batches(rows(), FILES)
    spread = files.select("path").repartition(max(1, files.count()))
    return stored(spread.mapInArrow(rewrite, ddl(FILES)), "warc-normal")


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of normalised archives, found through the sidecar index and inflated alone. For a
    revisit, ``payload`` is null while ``digest`` and ``payload_bytes`` are those of the full payload.
    A response whose payload does not have its digest raises."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for (path,) in zip(*columns(batch, "path")):
                    fs, local = file_system(path)
                    with fs.open_input_stream(f"{local}.idx", compression=None) as f:
                        lines = f.read().splitlines()
                    with fs.open_input_file(local) as f:
                        for x in map(json.loads, lines):
                            f.seek(x["offset"])
                            yield path, x["offset"], x["length"], *_parsed(f.read(x["length"]), payloads)
        yield from in_batches(rows(), RECORDS, 256)
    spread = files.select("path").repartition(max(1, files.count()))
    return spread.mapInArrow(read, ddl(RECORDS))


def _parsed(member: bytes, payloads: bool) -> tuple:
    head, _, block = zlib.decompress(member, wbits=GZIP).partition(b"\r\n\r\n")
    fields = parse_head(head)
    http, _, payload = block[:int(fields["content-length"])].partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(parse_head(http)["content-length"])
    if fields["warc-type"] == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
            raise ValueError(f"{fields['warc-record-id']} does not have its digest")
    return (fields["warc-record-id"].strip("<>"), fields["warc-type"], fields.get("warc-target-uri"),
            fields.get("warc-refers-to", "").strip("<>") or None, digest, size,
            payload if payloads and fields["warc-type"] == "response" else None)


def page_number(urn):
    """The page_id inside a record's URN; null where the page had none."""
    return F.expr(f"try_cast(substring({urn}, {len(PAGE_URN) + 1}) AS bigint)")


@query("op10_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS n, sha1(payload) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
""")
def op10(spark, sf_dir):
    folder = scratch_folder(spark, "warc")
    files = write_monolithic(with_revisits(load(spark, sf_dir, "pages")), f"{folder}/monolithic")
    records = read_archives(normalise(files, f"{folder}/normal"), payloads=False)
    return records.select(page_number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                          "record_type", page_number("refers_to").alias("refers_to"))
