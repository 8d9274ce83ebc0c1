"""How trees are grown from blocks: counts, sums and walks against plain ones, and what is left on disk."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from seriesloom.operators import trees as T
from seriesloom.session import shared_folder

NAMES = ["x", "z", "w"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    x, z = rng.uniform(0, 10, 5000), rng.integers(0, 4, 5000).astype(float)
    y = 20 * x + 30 * z + 10 * rng.exponential(1 + x)
    return spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "w": rng.normal(size=5000), "y": y})).repartition(3)


def left_behind(spark) -> set[str]:
    return {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("seriesloom-blocks-*")}


def test_counts_of_nodes_equal_brute_force(spark, frame):
    edges = T.bin_edges(frame, NAMES)
    held, folder = T.blocks(frame, NAMES, edges, 100.0, signed=True)
    pdf = frame.select("y", *NAMES).toPandas()
    bins, under = T.binned(pdf[NAMES].to_numpy(), edges), pdf.y.to_numpy() < 100
    chosen = np.array([[0, 1], [1, 2], [0, 2]])
    root = (0, 30, 1)  # above bin 30 of x
    paths = [[()], [(root, (1, 2, 0)), (root, (1, 2, 1))], [((1, 2, 0), root)]]  # the last one holds the rows of the second tree's first
    got = T._node_counts(held, chosen, paths)
    for k, of_tree in enumerate(paths):
        for slot, path in enumerate(of_tree):
            here = np.all([(bins[:, j] > cut) == bool(side) for j, cut, side in path] or [np.ones(len(bins), bool)], axis=0)
            for c, j in enumerate(chosen[k]):
                for sign in (0, 1):
                    assert got[k][slot][c, sign].tolist() == np.bincount(bins[here & (under == sign), j], minlength=T.BINS).tolist()
    T.drop_folder(spark, folder)


@pytest.mark.parametrize("bits", [0, 2, 20])
def test_random_trees_do_not_depend_on_blocks_or_on_how_rows_walk(frame, monkeypatch, bits):
    settings = {"trees": 6, "depth": 9, "leaves": 512, "share": 1.0}
    plain = T.extra_trees(frame, NAMES, **settings)
    monkeypatch.setattr(T, "BLOCK_ROWS", 1)  # every stored block is walked by itself
    monkeypatch.setattr(T, "BIT_LEVELS", bits)
    other = T.extra_trees(frame, NAMES, **settings)
    for name in ("feature", "cut", "left", "value"):
        assert getattr(plain, name).tolist() == getattr(other, name).tolist()


def test_places_are_the_leaves(frame):
    model = T.extra_trees(frame, NAMES, trees=3, depth=6, leaves=256, share=1.0)
    bins = model.binned(frame.select(*NAMES).toPandas().to_numpy())
    block = T.Block(len(bins), bins)
    for root, leaf in zip(model.roots, model.leaves(bins)):
        at, nodes = block.places(model.feature.tolist(), model.cut.tolist(), model.left.tolist(), int(root), model.depth)
        assert np.array(nodes)[at].tolist() == leaf.tolist()


def test_blocks_are_dropped_when_they_are_not_read_any_more(spark, frame):
    before = left_behind(spark)
    T.boost(frame, NAMES, 0.5, trees=80, depth=2, share=1.0)
    T.extra_trees(frame, NAMES, trees=2, depth=2)
    assert left_behind(spark) == before


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.77, 1.0])
def test_start_is_the_exact_percentile(spark, frame, q):
    from pyspark.sql import functions as F
    values = frame.select("y").union(spark.createDataFrame([(None,), (7.5,), (7.5,)], "y double"))
    assert T._quantile(values, "y", q) == pytest.approx(values.agg(F.percentile("y", F.lit(q))).first()[0], abs=1e-12)
    assert T._quantile(values.where("false"), "y", q) is None


def test_information_is_counted_without_a_row_a_feature(spark):
    from seriesloom.operators import pooled as PO
    rng = np.random.default_rng(9)
    x = np.where(rng.random(4000) < 0.2, np.nan, rng.normal(size=4000))
    pdf = pd.DataFrame({"x": x, "z": rng.integers(0, 3, 4000).astype(float), "y": np.nan_to_num(x) + rng.normal(size=4000)})
    frame = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(3)
    told = PO.binned_information(frame, ["x", "z"])
    edges = frame.selectExpr(*[f"percentile_approx({c}, array({','.join(str(k / 16) for k in range(1, 16))}), 1000) AS {c}" for c in pdf]).first()
    of = {c: np.where(pdf[c].isna(), 0, [sum(e < v for e in edges[c]) for v in pdf[c]]) for c in pdf}
    for r in told.collect():
        n = np.zeros((16, 16))
        np.add.at(n, (of[r["feature"]], of["y"]), 1 / 4000)
        apart = n.sum(axis=1, keepdims=True) * n.sum(axis=0, keepdims=True)
        assert r["mi"] == pytest.approx((n[n > 0] * np.log(n[n > 0] / apart[n > 0])).sum())
    assert "Expand" not in told._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["Ridge", "Huber"])
def test_lines_are_fitted_without_writing_their_rows(spark, monkeypatch, name):
    import datetime as dt

    from seriesloom.operators import pooled as PO
    monkeypatch.setattr(PO, "materialize", lambda df: pytest.fail("rows were written"))
    days = [("a", dt.date(2022, 1, 3) + dt.timedelta(k), 10.0 + k % 7) for k in range(80)]
    views = spark.createDataFrame([(*d, "train") for d in days], "series_id string, ds date, y double, part string")
    wanted = spark.createDataFrame([("a", "future", k, dt.date(2022, 3, 24) + dt.timedelta(k)) for k in range(1, 8)], "series_id string, kind string, step int, ds date")
    rows = views.select("series_id", views.part.alias("kind"), "ds", "y").replace("train", "future")
    told, _ = PO.fit_pooled(name, views, rows, wanted)
    assert [r["step"] for r in told.orderBy("step").collect()] == [*range(1, 8)]
