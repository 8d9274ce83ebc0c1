"""Language, leaks, search and web archives."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

from seriesloom.llm import language, leaks, search, warc
from seriesloom.session import scratch_folder

SF = "/root/testdata/sf0.001"


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.where(language.remainder() != 2), rows=40)
    held = docs.where(language.remainder() == 2)
    out = language.identify(held, model, records=True).collect()
    assert len(out) > 20 and np.mean([r.record.lang == r.lang_pred for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    rows = [(1, "aaa bbb", "x"), (2, "ccc ddd", "y"), (3, None, "x"), (4, "zzz", None)] * 3
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(1, "aaa"), (2, "DDD!"), (3, None), (4, ""), (5, "12 %"), (6, "漢"), (7, "aad"), (None, "ccc"), (8, "aaa ccc"), (9, "bbb " * 50_000)]
    df = spark.createDataFrame([(*t, "q", 1.0) for t in texts], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: (r.lang_pred, round(r.score, 3)) for r in language.identify(df, model).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5, 6, 7, None, 8, 9)] == ["x", "y", "und", "und", "und", "x", "x", "y", "x", "x"]
    assert got[3][1] == 0 and got[6][1] == 0.5 and got[8][1] == 0.5
    nothing = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_numerals_are_no_letters(spark):
    rows = [(1, "aaa bbb", "x"), (2, "ccc ddd", "y")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ ① 3"), (3, "aaa½²"), (4, "²ccc")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "x" and got[4][0] == "y"


def test_scores_equal_a_plain_loop(spark):
    """Every document of the small table scored by dictionaries, letter by letter."""
    import math
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.where(language.remainder() != 2), rows=60)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    for r in docs.collect():
        words, word = [], ""
        for c in (r.text or "").lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                words.append(word)
                word = ""
        total, n = [0.0] * len(model.languages), 0
        for w in words:
            costs = model.word(w)
            if not math.isnan(costs[0]):
                total, n = [a + b for a, b in zip(total, costs)], n + 1
        if not words:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        mean = [t / n for t in total]
        best = min(range(len(mean)), key=mean.__getitem__)
        assert got[r.doc_id][0] == model.languages[best]
        assert got[r.doc_id][1] == pytest.approx(1 / sum(10 ** (mean[best] - m) for m in mean))


def test_language_learns_from_few_distinct_texts(spark):
    rows = [(k * 1000 + i, f"word{chr(97 + k)} same text{chr(97 + k)}", f"l{k}") for k in range(6) for i in range(400)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=20)
    assert model.languages == [f"l{k}" for k in range(6)]


def test_word_backs_off_to_shorter_grams():
    model = language.Model({"a": {0: {"tree": 2}, 2: {"tr": 4}, 1: {"t": 9}}, "b": {0: {}, 2: {}, 1: {"t": 1, "q": 8}}}, 3)
    assert model.word("tree") == [0.0, 7.0]
    assert model.word("tram") == [0.0, 7.0]  # by its two-letter gram
    assert model.word("tq")[1] < 7.0 and np.isnan(model.word("zz")).all()


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max(), np.flatnonzero(h.max(axis=0) == h.max())


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(1, 20))
        (score, end), (best, ends) = leaks.align(a, b), brute_align(a, b)
        assert score == best and end in ends


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [w, "inserted"] if x < 2 * share / 3 else ["changed"] if x < share else [w]
    return out


def test_leaks_find_copies_and_edited_copies_only(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(40)) for k in range(30)]
    docs, want = [], set()
    for d in range(300):
        words = text(rng.randint(0, 200))
        if d % 3 == 0:  # a passage that a third of all documents hold
            words[5:5] = edited(rng, items[0][1], 0.15)
            want.add((d, 0))
        if d % 10 == 1:
            k = rng.randint(1, 29)
            words += edited(rng, items[k][1], 0.2 if d % 20 == 1 else 0)
            want.add((d, k))
        docs.append((d, ", ".join(words).upper()))
    docs += [(900, None), (901, ""), (902, " ".join(items[3][1][:12])), (None, " ".join(items[4][1]))]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item_id int, score int").repartition(3)
    it = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(77, None), (78, ""), (79, "two words")], "item_id long, text string")
    got = leaks.find_leaks(df, it, block=11).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 4)} and len(got) == len(want) + 1
    whole = next(r for r in got if r.doc_id is None)
    assert (whole.score, whole.start_word, whole.end_word) == (1.0, 0, 40)
    assert leaks.find_leaks(df.limit(0), it).count() == 0 and leaks.find_leaks(df, it.limit(0)).count() == 0


def spoiled(words, every, kind):
    """Every so many words, one is replaced, left out or followed by a new one."""
    out = []
    for i, w in enumerate(words):
        here = i % every == every - 1
        out += [] if here and kind == "less" else [f"new{i}"] if here and kind == "other" else [w, f"new{i}"] if here else [w]
    return out


@pytest.mark.parametrize("least", [0.5, 0.3, 0.7])
def test_leaks_equal_brute_alignment_under_regular_edits(spark, least):
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(200)]
    text = lambda n: [rng.choice(common if rng.random() < 0.4 else rare) for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate([8, 13, 20, 30, 45])]
    docs = [(900 + k, w) for k, w in items[:3]]  # whole copies elsewhere
    for k, words in items:
        for every in (1, 2, 3, 4, 5):
            for kind in ("other", "less", "more"):
                docs.append((len(docs), text(rng.choice([0, 3, 400])) + spoiled(words, every, kind) + text(rng.choice([0, 50]))))
    want = {}
    for d, words in docs:
        for k, item in items:
            number = {w: i for i, w in enumerate(dict.fromkeys(words + item))}
            a, b = np.array([number[w] for w in item]), np.array([number[w] for w in words] or [-1])
            score, _ = leaks.align(a, b)
            if score >= least * 2 * len(item):
                want[d, k] = score / (2 * len(item))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(3)
    it = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = leaks.find_leaks(df, it, least=least).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == want and len(got) == len(want) > 30
    texts, of = dict(docs), dict(items)
    for r in got:  # the passage named holds the score
        number = {w: i for i, w in enumerate(dict.fromkeys(texts[r.doc_id] + of[r.item_id]))}
        a, b = ([number[w] for w in x] for x in (of[r.item_id], texts[r.doc_id][r.start_word:r.end_word]))
        assert leaks.align(np.array(a), np.array(b))[0] == round(r.score * 2 * len(a))


@pytest.mark.parametrize("kind", ["small", "huge", "hot"])
def test_search_equals_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    scale = {"small": 1.0, "huge": 1e12, "hot": 1.0}[kind]
    rows = [(i, (rng.standard_normal(6) * scale * rng.choice([0.1, 1, 5])).tolist()) for i in range(120)]
    if kind == "hot":
        rows = [(i, rows[0][1] if i % 3 else v) for i, v in rows]
    bad = [(500, None), (550, [1.0, None]), (600, [float("nan")]), (650, [float("inf")] * 6), (None, [1.0] * 6)]
    more = [(700, []), (750, [2.0, 1.0]), rows[50]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad + more], "vec_id long, embedding array<double>, score int, rank int").repartition(4)
    v = search.integer_vectors(df)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_products(v, v.where("vec_id % 50 = 0"), block=2, lead=10).collect()]
    ints = {i: [int(np.floor(256 * c)) for c in x] for i, x in rows + more[:2]}
    want = []
    for q in (i for i in ints if i % 50 == 0):
        scores = sorted((-min(max(sum(a * b for a, b in zip(ints[q], x)), -2**63), 2**63 - 1), i) for i, x in ints.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted(got) == sorted(want)


def test_search_edges(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (3, [0.5])], "vec_id long, embedding array<float>")
    v = search.integer_vectors(df)
    out = search.top_products(v, v.where("vec_id = 50")).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in out) == [(1, 0, 512 * 256), (2, 3, 512 * 128)]
    assert search.top_products(v.limit(0), v.limit(0)).count() == 0


def pages(spark):
    rows = [(4, "http://a/\n?x", "<p>one</p>"), (2, None, "<p>one</p>"), (9, "u", None), (7, "u", ""), (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 3),
            (None, "u", "<p>one</p>"), (5, "u", "z" * 3_000_000), (2, None, "<p>one</p>"), (11, "u", "only")]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha1 string, first_id int").repartition(2)


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    folder = scratch_folder(spark, "t-warc")
    old = warc.write_monolithic(warc.with_revisits(df), f"{folder}/old")
    new = warc.normalise(old, f"{folder}/new")
    out = warc.read_archives(new).collect()
    first = {"<p>one</p>": 2, "": 7}
    want = []
    for page, _, html in rows:
        payload = (html or "").encode()
        other = first.get(html or "", page)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kind = "response" if other == page else "revisit"
        want.append((f"urn:page:{page}", kind, f"urn:page:{other}" if kind == "revisit" else None, digest, len(payload),
                     payload if kind == "response" else None))
    assert sorted(((r.record_id, r.record_type, r.refers_to, r.digest, r.payload_bytes, r.payload and bytes(r.payload) if r.payload is not None else None)
                   for r in out), key=str) == sorted(want, key=str)
    for a, b in zip(sorted(r.path for r in old.collect()), sorted(r.path for r in new.collect())):
        from seriesloom.llm.common import file_system
        x, y = (open(file_system(p)[1], "rb").read() for p in (a, b))
        one = zlib.decompressobj(wbits=31)
        assert one.decompress(x) == gzip.decompress(y) and not one.unused_data  # one member before, many after
    assert warc.read_archives(warc.normalise(new, f"{folder}/again")).count() == len(rows)  # an archive of many members normalises too


def test_archives_of_no_pages(spark):
    _, df = pages(spark)
    folder = scratch_folder(spark, "t-warc")
    files = warc.write_monolithic(warc.with_revisits(df.limit(0)), f"{folder}/old")
    assert warc.read_archives(warc.normalise(files, f"{folder}/new")).count() == 0


def test_damaged_archive_raises():
    record = warc.record_bytes(1, "u", b"abc", None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        list(warc.split_records(iter([record[:-10]])))
    with pytest.raises(ValueError):
        warc._parsed(gzip.compress(record.replace(b"abc", b"abd")), True)


def test_search_counts_a_repeated_id_once(spark):
    rng = np.random.default_rng(4)
    vectors = [(1, rng.standard_normal(6).tolist()) for _ in range(1)] + [(k, (rng.standard_normal(6) * 0.5).tolist()) for k in range(2, 40)]
    vectors += [(500 + k % 2, (np.array(vectors[0][1]) * (3 + 0.1 * k)).tolist()) for k in range(20)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    v = search.integer_vectors(df)
    whole = lambda x: np.floor(256 * np.array(x)).astype(int)
    best: dict = {}
    for k, x in vectors:
        if k != 1:
            best[k] = max(best.get(k, -10**18), int(whole(x) @ whole(vectors[0][1])))
    want = sorted(((k, s) for k, s in best.items()), key=lambda r: (-r[1], r[0]))[:5]
    for lead in (1, 1000):
        got = search.top_products(v, v.where("vec_id = 1"), lead=lead).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == want
