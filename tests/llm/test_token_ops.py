"""Token files, packing and sharding: exact round trips and edge rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from seriesloom.llm import packing, sharding, token_files
from seriesloom.llm.tokens import Encoder, vocabulary
from seriesloom.session import scratch_folder

SCHEMA = "doc_id long, text string, shard string, record int, slot int, ids int, kept string"


def edge_rows():
    long = " ".join(f"word{i % 97} Ünïcode" for i in range(30_000))
    rows = [(1, "a first text"), (2, None), (3, ""), (None, "no id"), (5, long), (7, "same"), (7, "same"), (8, "漢字 <|endoftext|> ²"),
            (6, " \n\t "), (None, None)]
    return [(*r, "x", 1, 2, 3, None) for r in rows]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def fresh(file):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary(file))


@pytest.mark.parametrize("file,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_tokenizer(file, kind):
    e, plain, t = Encoder(vocabulary(file), kind), Encoder(vocabulary(file), kind, plain=True), fresh(file)
    literal = fresh(file)
    literal.encode_special_tokens = True
    rng = random.Random(5)
    parts = [*"aB 'st\n\t 7.,_-Éßÿſİ漢́²½<|>Σ\x1c", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "word", " the"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(e.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(plain.ids(text), "<u4").tolist() == literal.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(Encoder(vocabulary("byte_bpe_50k.json"), "byte").ids("hello <|endoftext|> x"), "<u4")


def test_registered_rows_equal_the_plain_tokenizers(spark):
    """Every row of op1 and op6 on the small table, from tokenizers that share no code with the library."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    t = fresh("byte_bpe_50k.json")
    start = 0
    got = {r.doc_id: r for r in token_files.op1(spark, sf).collect()}
    assert set(got) == set(texts)
    for k in sorted(texts):
        ids = [*t.encode(texts[k], add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    t = fresh("word_bpe_49k.json")
    pieces: dict = {}
    for p in packing.op6(spark, sf).collect():
        pieces.setdefault(p.doc_id, []).append(p)
    for k, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[k], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)


def test_token_files_round_trip(spark, edges):
    folder = scratch_folder(spark, "t-tokens")
    files = token_files.write_token_files(edges, folder, "byte_bpe_50k.json", "byte", 2)
    got = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
    e = Encoder(vocabulary("byte_bpe_50k.json"), "byte")
    want = sorted(((r[0], np.array([*np.frombuffer(e.ids(r[1] or ""), "<u4"), 2], "<u4").tobytes()) for r in edge_rows()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(d), i) for d, i in want)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]


def test_reader_inflates_only_what_is_asked_for(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x.ids")
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (10, 400_000, 0, 70_000, 5)]
    w = token_files.FrameWriter(open(path, "wb"), 2, 3)
    for k, d in enumerate(docs):
        w.add(k, d)
    w.close()
    reader = token_files.FrameReader(path)
    seen = []
    inner = token_files.FrameReader.frame
    monkeypatch.setattr(token_files.FrameReader, "frame", lambda self, k: (seen.append(k), inner(self, k))[1])
    assert (reader.document(4) == docs[4]).all() and len(set(seen)) == 1
    for k, d in enumerate(docs):
        assert (reader.document(k) == d).all()
    assert len(reader.frames) > 4 and max(f[1] for f in reader.frames) <= 4 * token_files.FRAME_IDS
    import zstandard
    raw = open(path, "rb").read()
    whole = b"".join(zstandard.ZstdDecompressor().decompress(raw[o:o + f[0]]) for o, f in zip(reader.offsets, reader.frames))
    assert whole == np.concatenate(docs).astype("<u2").tobytes()
    at = reader.offsets[1] + reader.frames[1][0] // 2
    open(path, "wb").write(raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1:])
    with pytest.raises(Exception):
        token_files.FrameReader(path).document(1)


def check_packed(pieces, docs, size):
    by_doc: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for doc, ids in docs.items():
        got = sorted(by_doc.get(doc, []), key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in got) == ids
        assert [p.start for p in got] == [0, *np.cumsum([p.length for p in got])[:-1]][:len(got)]
    by_sequence: dict = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    used = []
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [0, *np.cumsum([p.length for p in s])[:-1]]
        used.append(sum(p.length for p in s))
    assert max(used) <= size and sum(u < size for u in used) <= 1


def test_packing_covers_every_id_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 3)  # several rounds of merging
    rng = np.random.default_rng(3)
    docs = {k: rng.integers(0, 9, int(n)).astype("<u4").tobytes() for k, n in enumerate(rng.integers(0, 90, 300))}
    docs[300] = rng.integers(0, 9, 5000).astype("<u4").tobytes()
    df = spark.createDataFrame([(k, v) for k, v in docs.items()], "doc_id long, ids binary").repartition(11)
    check_packed(packing.pack(df, size=64, windows=4).collect(), docs, 64)


def test_packing_edges(spark, edges):
    tokens = packing.tokenized(edges, "word_bpe_49k.json", "word", 1)
    out = packing.pack(tokens).collect()
    assert sum(p.length for p in out) == sum(len(r.ids) // 4 for r in tokens.collect())
    assert sum(zlib.crc32(bytes(p.ids)) >= 0 for p in out) == len(out)
    assert packing.pack(tokens.limit(0)).count() == 0


def test_shards_differ_by_one_row(spark, edges):
    for df, n in ((edges, 10), (edges.limit(0), 0), (edges.unionAll(edges).unionAll(edges), 30)):
        out = sharding.shuffle_into_shards(df, scratch_folder(spark, "t-shards"), shards=4).collect()
        assert len(out) == n
        counts = [sorted(r.slot for r in out if r.shard == s) for s in range(4)]
        assert all(c == list(range(len(c))) for c in counts)
        assert max(map(len, counts)) - min(map(len, counts)) <= 1
    assert sorted(str(r.record.text) for r in out) == sorted(3 * [str(r[1]) for r in edge_rows()])


def test_shard_order_is_seeded(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "'t' || id AS text")
    order = [[r.record.doc_id for r in sorted(sharding.shuffle_into_shards(df, scratch_folder(spark, "t-shards"), seed=s).collect(),
                                              key=lambda r: (r.shard, r.slot))] for s in (1, 1, 2)]
    assert order[0] == order[1] != order[2] and order[0] != sorted(order[0])
    assert abs(np.corrcoef(order[0], np.arange(500))[0, 1]) < 0.2
