"""Hard negatives, near-duplicate vectors and cross-tokenizer alignment, against brute force."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from seriesloom.llm import alignment, negatives, vector_links

SF = "/root/testdata/sf0.001"


# ---- near-duplicate vectors ----------------------------------------------------
def brute_links(rows, cosine=0.9):
    """(n_links, component_id) of each row by comparing all pairs."""
    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        a = np.zeros(16)
        a[:len(v)] = np.array(v, float) / np.abs(v).max()
        return a / np.sqrt(a @ a)
    x = [unit(v) for _, v in rows]
    linked = [[i != j and x[i] is not None and x[j] is not None and float(x[i] @ x[j]) >= cosine for j in range(len(rows))] for i in range(len(rows))]
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *(label[j] for j in range(len(rows)) if linked[i][j])]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((vec_id, sum(linked[i]), min(ids) if ids else None))
    return out


def found_links(spark, rows, **settings):
    df = spark.createDataFrame([(k, v, "clash", 1.0) for k, v in rows], "vec_id long, embedding array<float>, x string, node double")
    return sorted(map(tuple, vector_links.near_vectors(df, **settings).collect()), key=str)


def test_clusters_of_every_width_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for spread in (0.01, 0.05, 0.1, 0.14, 0.2):  # from tight copies to groups whose balls touch
        centre = rng.normal(size=16)
        centre /= np.linalg.norm(centre)
        rows += [(len(rows) + k, (centre + rng.normal(size=16) * spread).astype(np.float32).tolist()) for k in range(40)]
    rows += [(len(rows) + k, rng.normal(size=16).astype(np.float32).tolist()) for k in range(60)]
    want = sorted(brute_links(rows), key=str)
    assert max(n for _, n, _ in want) > 30
    assert found_links(spark, rows, miss=1e-9) == want
    assert found_links(spark, rows, miss=1e-9, block=7) == want  # groups of seven


def test_vectors_nulls_copies_and_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, a), (3, a), (9, [2.0, 0.0, 0.0]), (None, [1.0, 0.01, 0.0]), (7, b), (7, [0.0, 1.0]), (8, None), (10, []), (11, [0.0, 0.0, 0.0]),
            (12, [1.0, None, 0.0]), (13, [math.inf, 0.0, 0.0]), (14, [math.nan, 1.0, 0.0]), (None, [0.0, 0.0, 1.0]), (15, [0.0, -1.0, 0.0]), (2, [1e30, 1e29, 0.0])]
    assert found_links(spark, rows) == sorted(brute_links(rows), key=str)
    assert found_links(spark, []) == []
    assert found_links(spark, [(1, a)]) == [(1, 0, 1)]


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(6)
    hot = rng.normal(size=12).tolist()
    rows = [(k, hot if k % 3 == 0 else rng.normal(size=12).tolist()) for k in range(600)]
    got = {r[0]: r[1:] for r in found_links(spark, rows)}
    assert all(got[k] == (199, 0) for k in range(0, 600, 3))


def test_tables_grow_with_rows_and_keep_the_miss():
    for rows in (10, 10_000, 10**9):
        bits, tables = vector_links.tables_for(rows, 0.9, 1e-3)
        assert (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables <= 1e-3
    assert vector_links.tables_for(10**9, 0.9, 1e-3)[0] == 26


# ---- hard negatives --------------------------------------------------------------
def brute_negatives(rows, is_anchor, k=5):
    ok = sorted({(i, label, tuple(math.floor(256 * c) for c in v)) for i, label, v in rows
                 if i is not None and label is not None and v is not None and None not in v and np.isfinite(v).all()})
    out = []
    for i, label, x in ok:
        if not is_anchor(i):
            continue
        def score(y):
            return sum(a * b for a, b in zip(x, y))
        other = [(-score(y), j, m) for j, m, y in ok if j != i]
        for s, p, _ in sorted(o for o in other if o[2] == label)[:k]:
            inside = sorted(o for o in other if o[2] != label and 80 * -s <= 100 * -o[0] <= 100 * -s)[:k]
            out += [(i, p, r, n, -s, -t) for r, (t, n, _) in enumerate(inside, 1)]
    return sorted(out)


def found_negatives(spark, rows, is_anchor, **settings):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, label int, embedding array<float>, part string")
    vectors = negatives.labelled_vectors(df)
    return sorted(map(tuple, negatives.hard_negatives(vectors, vectors.where(is_anchor), **settings).collect()))


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 60)  # several parts and groups
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 10))
    rows = [(k, int(rng.integers(3)), (centres[k % 6] + rng.normal(size=10) * 0.7).astype(np.float32).tolist()) for k in range(400)]
    rows += [(400 + k, k % 2, rows[0][2]) for k in range(150)]  # ties in one cell
    want = brute_negatives(rows, lambda i: i % 20 == 0)
    assert len(want) > 200 and found_negatives(spark, rows, "vec_id % 20 = 0") == want
    assert found_negatives(spark, rows, "vec_id % 20 = 0", sample=5) == want  # any codebook gives the same rows


def test_hard_negatives_nulls_and_repeated_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.9, 0.4]), (3, 2, [0.8, 0.4]), (3, 2, [0.8, 0.4]), (4, None, [1.0, 1.0]), (None, 2, [1.0, 0.4]),
            (5, 2, None), (6, 2, [None, 1.0]), (7, 2, [math.nan, 1.0]), (8, 2, [math.inf, 1.0]), (9, 1, [-1.0, -1.0]), (10, 2, [])]
    rows = [r for r in rows if r[2] != []]
    assert found_negatives(spark, rows, "vec_id = 0") == brute_negatives(rows, lambda i: i == 0)
    assert found_negatives(spark, [], "vec_id = 0") == []
    assert found_negatives(spark, [(0, 1, [1.0])], "vec_id = 0") == []  # no positive


def test_cells_are_visited_by_descending_bounds():
    rng = np.random.default_rng(8)
    x = rng.integers(-200, 200, (300, 8)).astype(float)
    books = negatives.codebook(x[:, :4], 5), negatives.codebook(x[:, 4:], 5)
    code = [((x[:, h] - b[:, None]) ** 2).sum(axis=2).argmin(axis=0) for h, b in ((slice(0, 4), books[0]), (slice(4, 8), books[1]))]
    radius = [np.sqrt(((x[:, h] - b[c]) ** 2).sum(axis=1)) for h, b, c in ((slice(0, 4), books[0], code[0]), (slice(4, 8), books[1], code[1]))]
    cells = negatives.Cells(books, 8, np.arange(300), np.zeros(300, int), [r.tobytes() for r in x], *code, *radius)
    a = rng.integers(-200, 200, 8).astype(float)
    seen, last = 0, math.inf
    for bound, least, first, end in cells.visit(a):
        score = cells.x[first:end] @ a
        assert bound <= last and score.max() <= bound + 1e-6 and score.min() >= least - 1e-6
        last, seen = bound, seen + end - first
    assert seen == 300


# ---- cross-tokenizer alignment ---------------------------------------------------
@pytest.fixture(scope="module")
def both():
    return alignment.Vocabularies("byte_bpe_50k.json", "piece_bpe_32k.model")


def brute_alignment(both, text):
    """Tokens by the plain libraries, links and groups by loops over bytes."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    if not hasattr(brute_alignment, "kept"):
        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        brute_alignment.kept = t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tokenizer, pieces = brute_alignment.kept
    none = (0, 0, 0, 0, ""), Counter()
    if not text:
        return none
    whole = (" " + text).encode()
    a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    at_byte = []
    for ids, entries in ((a, both.a_bytes), (b, both.b_bytes)):
        if b"".join(entries[k] for k in ids) != whole:
            return none
        at_byte.append([n for n, k in enumerate(ids) for _ in entries[k]])
    links = dict.fromkeys(zip(*at_byte))
    cuts = [k for k in range(1, len(whole) + 1) if k == len(whole) or (at_byte[0][k] != at_byte[0][k - 1] and at_byte[1][k] != at_byte[1][k - 1])]
    told, start = [], 0
    for cut in cuts:
        sides = [",".join(str(ids[n]) for n in dict.fromkeys(at[start:cut])) for ids, at in ((a, at_byte[0]), (b, at_byte[1]))]
        told.append("|".join(sides))
        start = cut
    return (len(a), len(b), len(cuts), len(links), hashlib.sha256(";".join(told).encode()).hexdigest()), Counter((a[x], b[y]) for x, y in links)


ODD = [None, "", " ", "  ", "a  b", " lead", "trail ", "x<|endoftext|>y <s></s><unk>", "日本語 é\n\n  b\t c", "a ▁ b", " nbsp \n \n z", "ﬁ 🙂🙂", "\x00 nul", "ab" * 3000, "same", "same"]


def test_alignment_equals_brute_force(spark, both):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = [(None if k == 5 else k // 2, t, "clash", k) for k, t in enumerate(texts)]  # repeated and missing ids
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a int")
    aligned = alignment.stored(alignment.align_documents(df.repartition(3)), "test-aligned")
    got = Counter(map(tuple, alignment.score_links(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()))
    brute = [brute_alignment(both, t) for t in texts]
    count = Counter(p for _, pairs in brute for p in pairs)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    want = Counter((rows[k][0], *facts, sum(n for p, n in pairs.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in pairs.items()))
                   for k, (facts, pairs) in enumerate(brute))
    assert got == want
    assert brute[7][0][0] > 0 and brute[9][0] == (0, 0, 0, 0, "")  # special strings are text; U+2581 is not kept by B


def test_alignment_without_broadcast_and_of_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    aligned = alignment.stored(alignment.align_documents(df), "test-aligned")
    small = sorted(alignment.score_links(aligned).collect())
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    assert sorted(alignment.score_links(aligned).collect()) == small
    assert alignment.score_links(alignment.stored(alignment.align_documents(df.limit(0)), "test-aligned")).count() == 0


def test_long_text_in_pieces_gives_the_same(both, monkeypatch):
    text = "wörter und noch mehr, 12.5 % " * 400
    whole = list(alignment.align_texts(both, [text]))[0]
    monkeypatch.setattr(alignment, "CHUNK", 50)
    piece = list(alignment.align_texts(both, ["", text, "b"]))[1]
    assert whole[:6] == piece[:6] and (whole[6] == piece[6]).all() and (whole[7] == piece[7]).all()


def test_sparse_product_equals_dense():
    rng = np.random.default_rng(9)
    def random(rows, width):
        dense = rng.integers(0, 3, (rows, width)) * (rng.random((rows, width)) < 0.3)
        at = np.nonzero(dense)
        return dense, alignment.Csr(np.concatenate([[0], np.cumsum((dense != 0).sum(axis=1))]), at[1], dense[at], width)
    def full(m):
        out = np.zeros((len(m.indptr) - 1, m.width), int)
        out[np.repeat(np.arange(len(out)), np.diff(m.indptr)), m.indices] = m.data
        return out
    for _ in range(20):
        (a, sa), (b, sb) = random(7, 9), random(9, 5)
        for most in (1, 10, 1 << 20):
            assert (full(alignment.product(sa, sb, most)) == a @ b).all()
        assert (full(alignment.transposed(sa)) == a.T).all()


def test_overlaps_are_shared_bytes():
    found = alignment.align(np.array([2, 3, 1]), np.array([1, 3, 2]))
    assert list(zip(found.a.tolist(), found.b.tolist(), found.overlap.tolist())) == [(0, 0, 1), (0, 1, 1), (1, 1, 2), (1, 2, 1), (2, 2, 1)]
    assert found.cuts.tolist() == [6] and found.shared.tolist() == [3, 3, 3]
