"""The corpus pipeline, stage by stage, on hand-made documents; and its registration."""

from __future__ import annotations

import random

import numpy as np

import __spark_entry__ as entry_module
import corpus_pipeline as C
from seriesloom.llm.tokens import Encoder, vocabulary


def prose(rng, letters, words):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(words))


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    item = prose(rng, "aeiostr", 40)
    texts = {i: prose(rng, "aeiostr" if i % 2 else "äöünmgk", 60) for i in range(40)}
    block = "\n".join(prose(rng, "aeiostr", 8) for _ in range(3))
    texts[50] = texts[1] + "\n" + block
    texts[51] = texts[3] + " tail\n" + block + "\nlast line"  # loses the block
    words = texts[5].split()
    texts[52] = " ".join(words[:-1] + ["changed"])  # near copy of 5
    texts[53] = prose(rng, "aeiostr", 20) + " " + item.upper() + " " + prose(rng, "aeiostr", 20)
    texts |= {54: None, 55: "", 56: "123 456"}
    rows = [(k, v, "x" if v and set(v) & set("eio") else "y", "s", len(v or "")) for k, v in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    for name, stage in C.STAGES:
        docs = C.stored(stage(spark, docs, str(tmp_path)), name)
        seen.append({r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect())
    language, lines, near, leaks, packed = seen
    assert all(list(docs_of.values())[0].asDict().keys() == set(C.COLUMNS) for docs_of in (language, lines, near, leaks))
    assert set(language) == set(texts) - {54, 55, 56} and language[2].lang == "y" and language[1].lang == "x"
    assert lines[51].text == texts[3] + " tail\nlast line" and lines[50].text == texts[50] and lines[51].n_chars == len(lines[51].text)
    assert set(lines) == set(language)
    assert set(lines) - set(near) == {51, 52} and set(near) - set(leaks) == {53}
    encoder = Encoder(vocabulary("word_bpe_49k.json"), "word")
    want = {k: len(np.frombuffer(encoder.ids(r.text), "<u4")) + 1 for k, r in leaks.items()}
    got: dict = {}
    for p in packed:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
        assert p.doc_tokens == want[p.doc_id]
    assert got == want


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in C.STAGES:
        docs = C.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0 and (name == "packing" or docs.columns == C.COLUMNS)


def test_repeated_rows_and_long_texts(spark, tmp_path):
    """One of equal rows stays, with the same doc_id, without one, or with others; very long texts go through whole."""
    rng = random.Random(4)
    a, b, c = (prose(rng, "aeiostr", 60) for _ in range(3))
    long = prose(rng, "aeiostr", 60_000)
    rows = [(7, a)] * 3 + [(None, b)] * 2 + [(9, c), (None, c), (4, c), (4, c)] + [(11, long)]
    docs = spark.createDataFrame([(k, t, "x", f"s{i}", len(t)) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = C.near(spark, docs.repartition(4), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(7, a), (None, b), (4, c), (11, long)], key=str)
    spark.createDataFrame([(1, prose(rng, "öäü", 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    for name, stage in C.STAGES:
        docs = C.stored(stage(spark, docs, str(tmp_path)), name)
        seen.append(docs.count())
    assert seen[0] == len(rows) and seen[2] == 4
    want = Encoder(vocabulary("word_bpe_49k.json"), "word")
    got: dict = {}
    for p in docs.collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == {k: len(want.ids(t)) // 4 + 1 for k, t in ((7, a), (None, b), (4, c), (11, long))}


def test_all_operators_are_registered():
    names = entry_module.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and names["pipeline"] is C.run
    assert "pipeline" not in entry_module.oracle_sql() and set(entry_module.oracle_sql()) <= set(names)
