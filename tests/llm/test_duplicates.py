"""Near duplicates, repeated lines and repeated strings against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import near
from seriesloom.llm.components import connected
from seriesloom.llm.lines import remove_repeated_lines
from seriesloom.llm.substrings import remove_repeated_strings
from seriesloom.llm.suffix_sort import suffix_array

SCHEMA = "doc_id long, text string, h int, node int, record int, marks int, _id int, component_id int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(3)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))
        text = s.tolist()
        assert suffix_array(s).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_components(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    label = [d for d, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if sets[i] and sets[j] and label[j] < label[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    label[i], changed = label[j], True
    return {d: (len(s), c) for (d, _), s, c in zip(rows, sets, label)}


def families(rng, bases, copies, words=60):
    rows = []
    for b in range(bases):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(words)] = f"x{rng.randrange(1000)}"
            rows.append(" ".join(text))
            base = text if rng.random() < 0.3 else base  # chains, too
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent,group_sets", [(85, 1000), (80, 7)])
def test_near_duplicates(spark, percent, group_sets):
    rng = random.Random(percent)
    rows = families(rng, 6, 25) + [(1000 + i, t) for i, t in enumerate(
        ["", None, "One two", "one  TWO\n", "ONE two three", " \t ", "É é", "é é", "lone words that stand by themselves here"])]
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in near.near_duplicates(frame(spark, rows), percent, group_sets=group_sets).collect()}
    assert got == brute_components(rows, percent)


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A B C D E F"), (None, None), (None, "alone " * 9), (5, "")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in near.near_duplicates(frame(spark, rows)).collect())
    assert got == sorted([("None", 2, 4), ("4", 2, 4), ("4", 2, 4), ("9", 2, 4), ("None", 0, None), ("None", 1, None), ("5", 0, 5)], key=str) or \
        sorted(got, key=str) == sorted([("None", 2, 4), ("4", 2, 4), ("4", 2, 4), ("9", 2, 4), ("None", 0, None), ("None", 1, None), ("5", 0, 5)], key=str)
    assert near.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_links_among_large_and_small_groups():
    rng = np.random.default_rng(2)
    base = np.arange(60, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.08, rng.integers(100, 400, 60).astype(np.uint64), base)) for _ in range(80)]
    label = near.links_among(sets, 85)
    want = np.arange(80)
    for _ in range(80):
        for i in range(80):
            for j in range(80):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    want[i] = min(want[i], want[j])
    assert label.tolist() == want.tolist()


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(200, 240)] + [(7, 7), (5, 4), (239, 61)]
    got = dict(connected(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 61 for i in [100, *range(200, 240)])
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_lines(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "a\nb"), (203, "\n\n\n\n")]
    seen: set = set()
    want = {}
    for doc, text in rows:
        lines = text.split("\n") if text is not None else []
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i:i + 3])
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        want[doc] = (None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    got = {r.record.doc_id: (r.kept, r.n_lines, r.n_removed) for r in remove_repeated_lines(frame(spark, rows)).collect()}
    assert got == want


def test_repeated_lines_edges(spark):
    rows = [(3, "a\nb\nc"), (3, "a\nb\nc"), (None, "a\nb\nc\nd"), (2, "x\ny\nz"), (5, "p\nq"), (5, "p\nq"), (6, None), (6, None)]
    rows += [(4, "k\nl\nm\nk")] * 200 + [(None, "t\nu\nv")] * 3  # of equal rows one keeps its lines
    got = sorted(((str(r.record.doc_id), r.n_removed, r.kept) for r in remove_repeated_lines(frame(spark, rows).repartition(5)).collect()), key=lambda r: (r[0], r[1], r[2] or ""))
    want = [("2", 0, "x\ny\nz"), ("3", 3, ""), ("3", 3, ""), ("None", 0, "a\nb\nc\nd"), ("5", 0, "p\nq"), ("5", 0, "p\nq"), ("6", 0, None), ("6", 0, None)]
    want += [("4", 0, "k\nl\nm\nk")] + [("4", 4, "")] * 199 + [("None", 0, "t\nu\nv")] + [("None", 3, "")] * 2
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2] or ""))
    long = "\n".join(f"line {i % 50_000}" for i in range(100_000))
    (r,) = remove_repeated_lines(frame(spark, [(1, long)])).collect()
    assert (r.n_lines, r.n_removed) == (100_000, 50_000)  # the second half; windows across the middle occur once
    assert remove_repeated_lines(frame(spark, rows).limit(0)).count() == 0


def brute_strings(rows, length):
    places: dict = {}
    for k, (_, text) in enumerate(rows):
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            places.setdefault(b[i:i + length], []).append((k, i))
    gone = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for where in places.values():
        if len(where) > 1:
            for k, i in where:
                gone[k][i:i + length] = True
    return [(d, len(g), int((np.diff(np.concatenate([[0], g])) == 1).sum()), bytes(np.frombuffer((t or "").encode(), np.uint8)[~g]))
            for (d, t), g in zip(rows, gone)]


@pytest.mark.parametrize("length", [16, 29, 64])
def test_repeated_strings(spark, length):
    rng = random.Random(length)
    shared = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(length - 3, 3 * length))) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 2 * length))) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, len(s) // 2)
            parts.insert(rng.randint(0, len(parts)), s[cut:])
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 5 * length), (101, "ab" * 2 * length), (102, None), (103, ""), (104, "short"), (None, rows[7][1]), (7, rows[7][1])]
    got = sorted(((str(r.doc_id), r.n_bytes, len(r.spans), bytes(r.kept)) for r in remove_repeated_strings(frame(spark, rows), length).collect()))
    assert got == sorted((str(a), b, c, d) for a, b, c, d in brute_strings(rows, length))


def test_repeated_strings_in_a_very_long_text(spark, monkeypatch):
    from seriesloom.llm import substrings
    monkeypatch.setattr(substrings, "PIECE_STARTS", 1000)
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 101, 6000).astype(np.uint8)).decode()
    rows = [(1, text), (2, text[2950:4100] + "zz"), (3, "y" + text[900:1010])]
    anchors = [x for part in substrings.anchors(text.encode(), 40) for x in zip(*part)]
    assert sum(int(n) for *_, n in anchors) == 6000 - 39
    got = sorted((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in remove_repeated_strings(frame(spark, rows), 40).collect())
    assert got == brute_strings(rows, 40)
    assert remove_repeated_strings(frame(spark, rows).limit(0), 40).count() == 0


def test_a_string_in_very_many_surroundings_is_sorted_in_small_groups(spark, monkeypatch):
    from seriesloom.llm import substrings
    monkeypatch.setattr(substrings, "SORT_BYTES", 4000)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    hot = word(90)
    rows = [(i, word(rng.randint(0, 120)) + hot[rng.randint(0, 3):] + word(rng.randint(0, 120))) for i in range(400)]
    rows += [(500 + i, rows[i][1][:150] + word(40)) for i in range(20)]
    df, largest = frame(spark, rows), []
    plain = type(df).repartition

    def spied(self, *how):
        if how == ("core",):
            largest.append(self.groupBy("core").agg(F.sum(F.octet_length("data")).alias("n")).agg(F.max("n")).first()[0] or 0)
        return plain(self, *how)
    monkeypatch.setattr(type(df), "repartition", spied)
    got = sorted((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in remove_repeated_strings(df, 64).collect())
    assert got == brute_strings(rows, 64)
    assert len(largest) > 1 and max(largest) <= 4000
