"""Tree models over the rows of all series, grown from sums that Spark aggregates.

Features are cut into at most 64 bins, whose edges come from bounded sketches, and rows are stored as blocks of
bin numbers. One pass over the blocks grows one level of many trees at once: every task adds up its rows' sums
per node and cut, Spark adds the tasks' sums, and the driver sees sums or chosen cuts only, whose number depends on the
trees and not on the rows. So a boosted model of 300 trees takes some 120 passes, and one of 200 random trees takes 15.

Within a block, the rows above a cut are one string of bits, made once and shared by all trees; the rows of a node are
such strings and-ed together, and the node of each row is read off their digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seriesloom.session import drop_folder, scratch_folder

BINS = 64  # bin 0 holds missing values
RESIDUAL_BINS = 512
NODES_A_GROUP = 512
LEAST_ROWS = 8192  # of a task that writes blocks, where there are as many
BLOCK_ROWS = 1 << 17
FILE_ROWS = 1 << 20  # a file of blocks is read at once
BIT_LEVELS = 8  # levels of a tree that are walked in bits; their nodes double, so rows walk the rest one by one
PACK = np.uint64(0x0102040810204080)  # gathers the low bits of eight bytes in the highest byte
MODEL_BYTES = 64 << 20  # a fitted model is sent to every task

BLOCK = pa.schema([("n", pa.int32()), ("bins", pa.binary()), ("y", pa.binary()), ("f", pa.binary())])
BLOCK_DDL = "n int, bins binary, y binary, f binary"
SIGNED = BLOCK.append(pa.field("under", pa.binary()))
SIGNED_DDL = BLOCK_DDL + ", under binary"
COUNTS = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
PART = pa.schema([("tree", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])
BEST = pa.schema([("tree", pa.int32()), ("part", pa.int32()), ("choice", pa.binary())])


@dataclass
class Trees:
    """Trees as arrays: rows with ``bin[feature[k]] > cut[k]`` go from node k of the concatenated trees to ``left[k] + 1``
    and the others to ``left[k]``. A leaf points at itself and no bin is above its cut."""

    edges: list[np.ndarray]
    start: float  # the sum starts here
    weight: float  # of each tree
    roots: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.empty(0, np.int16))
    cut: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint8))
    left: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.empty(0, np.float64))
    importance: np.ndarray | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.edges)

    depth: int = 0  # of the deepest tree

    def leaves(self, bins: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaf of each row of ``bins`` (rows, features)."""
        flat, row = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        for root in self.roots:
            node = np.full(len(bins), root, np.int64)
            for _ in range(self.depth):
                node = self.left[node] + (flat[row + self.feature[node]] > self.cut[node])
            yield node

    def sums(self, bins: np.ndarray) -> np.ndarray:
        """The weighted sum of the trees."""
        out = np.zeros(len(bins))
        for leaf in self.leaves(bins):
            out += self.value[leaf]
        return out * self.weight

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.sums(self.binned(x))

    def checked(self) -> Trees:
        size = sum(a.nbytes for a in (self.roots, self.feature, self.cut, self.left, self.value))
        if size > MODEL_BYTES:
            raise ValueError(f"the model takes {size} bytes, over {MODEL_BYTES}: fewer trees or larger leaves")
        return self


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """(rows, features): 0 for a missing value, else one more than the number of edges below it."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j]) + 1)
    return out


def bin_edges(frame: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """At most 62 edges a feature, at the quantiles of a bounded sketch."""
    cuts = [k / (BINS - 2) for k in range(1, BINS - 2)]
    got = frame.agg(*[F.percentile_approx(F.col(f).cast("double"), cuts, 2000).alias(f"_{j}") for j, f in enumerate(features)]).first()
    return [np.unique(np.array(q, dtype=float)) if q else np.empty(0) for q in got]


def blocks(frame: DataFrame, features: Sequence[str], edges: list[np.ndarray], start: float, target: str = "y", signed: bool = False) -> tuple[DataFrame, str]:
    """The rows of ``frame`` as stored blocks: bins by row, target, the sum of the trees so far, and where ``signed`` a bit for
    each row whose target lies under that sum: counts do not depend on how rows are blocked, while sums of targets are added
    a batch of rows at a time. Also their folder, to be dropped when they are not read any more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            y, bins = (np.concatenate(part) for part in zip(*held))
            held.clear()
            return _block(len(y), bins.tobytes(), y, np.full(len(y), start), signed)
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
                y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                if held and (not signed or sum(len(v) for v, _ in held) + len(y) > BLOCK_ROWS):
                    yield block()
                held.append((y, binned(x, edges)))
        if held:
            yield block()
    rows = frame.select(F.col(target).cast("double").alias("_target"), *[F.col(f).cast("double") for f in features]).where("_target is not null")
    n = rows.count()
    spread = max(1, min(-(-n // LEAST_ROWS), 4 * frame.sparkSession.sparkContext.defaultParallelism), -(-n // FILE_ROWS))
    return _stored(rows.repartition(spread).mapInArrow(run, SIGNED_DDL if signed else BLOCK_DDL))


def _block(n: int, bins: bytes, y: np.ndarray, f: np.ndarray, signed: bool) -> pa.RecordBatch:
    schema = SIGNED if signed else BLOCK
    values = [n, bins, y.tobytes(), f.tobytes()] + ([np.packbits(y < f).tobytes()] if signed else [])
    return pa.RecordBatch.from_arrays([pa.array([v], type=t.type) for v, t in zip(values, schema)], schema=schema)


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    folder = scratch_folder(df.sparkSession, "blocks")
    df.write.option("compression", "lz4").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


class Block:
    """The bins of a block's rows by column, and which rows lie above a cut."""

    def __init__(self, n: int, bins: np.ndarray):
        self.n, self.columns = n, np.ascontiguousarray(bins.reshape(n, -1).T)
        self.all = np.packbits(np.ones(n, bool))
        self._above: dict[tuple[int, int], np.ndarray] = {}

    def above(self, feature: int, cut: int) -> np.ndarray:
        got = self._above.get((feature, cut))
        if got is None:
            got = self._above[feature, cut] = np.packbits(self.columns[feature] > cut)
        return got

    def spelled(self, planes: Sequence[np.ndarray | None]) -> np.ndarray:
        """The number of each row, whose binary digits are given from the highest on; None is a digit of zeros."""
        out = np.zeros(self.n, np.uint8 if len(planes) <= 8 else np.uint32)
        for plane in planes:
            out <<= 1
            if plane is not None:
                out |= np.unpackbits(plane, count=self.n)
        return out

    def places(self, feature: Sequence[int], cut: Sequence[int], left: Sequence[int], root: int, levels: int) -> tuple[np.ndarray, list[int]]:
        """Each row's place among the nodes ``levels`` below ``root``, and the node of each place. A leaf points at itself and
        stays, at the left."""
        nodes, masks, planes = [root], [self.all], []
        for level in range(levels):
            below, parts, plane = [], [], None
            for node, mask in zip(nodes, masks):
                first = left[node]
                if first == node:
                    below += [node, node]
                    parts += [mask, None]
                    continue
                below += [first, first + 1]
                if mask is None or cut[node] == 255:
                    parts += [mask, None]
                    continue
                right = mask & self.above(feature[node], cut[node])
                plane = right if plane is None else plane | right
                parts += [mask ^ right, right] if level + 1 < levels else [None, None]
            nodes, masks = below, parts
            planes.append(plane)
        return self.spelled(planes), nodes


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The block of each row, and its further columns as buffers."""
    for batch in batches:
        n = batch.column(0).to_pylist()
        for k, size in enumerate(n):
            bins, *more = (c[k].as_buffer() for c in batch.columns[1:])
            yield Block(size, np.frombuffer(bins, np.uint8)), *more


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """Stored blocks walked as one, their targets, and where each of them begins and the last one ends."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def one() -> tuple[Block, np.ndarray, np.ndarray]:
        y, bins = (np.concatenate(part) for part in zip(*held))
        starts = np.cumsum([0, *(len(v) for v, _ in held)])
        held.clear()
        return Block(len(y), bins), y, starts
    for batch in batches:
        for bins, y in zip(*(batch.column(c) for c in ("bins", "y"))):
            values = np.frombuffer(y.as_buffer())
            if held and sum(len(v) for v, _ in held) + len(values) > BLOCK_ROWS:
                yield one()
            held.append((values, np.frombuffer(bins.as_buffer(), np.uint8)))
    if held:
        yield one()


def _counted(held: DataFrame, columns: Sequence[str], count, sizes: Sequence[int]) -> list[np.ndarray]:
    """Counts of as many cells as ``sizes`` tells, in parts, added up by tasks and then by Spark. ``count`` fills a task's
    arrays from a block and its ``columns``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, used = [np.zeros(size, np.int64) for size in sizes], False
        for block in _unpacked(batches):
            count(*block, found)
            used = True
        if used:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int32()), pa.array([a.tobytes() for a in found], pa.binary())], schema=COUNTS)

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), np.int64) for c in group.column("counts"))
        return pa.table([pa.array([group.column("part")[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=COUNTS)
    ddl = "part int, counts binary"
    rows = held.select("n", "bins", *columns).mapInArrow(run, ddl).groupBy("part").applyInArrow(add, ddl).collect()
    out = [np.zeros(size, np.int64) for size in sizes]
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return out


def _quantile(frame: DataFrame, target: str, q: float) -> float | None:
    """The exact quantile, as ``percentile`` gives it: only values near its rank, which a bounded sketch brackets, are
    sorted."""
    values = frame.select(F.col(target).cast("double").alias("v")).where("v is not null")
    slack = 0.0004
    n, bounds, most, least = values.agg(F.count("*"), F.percentile_approx("v", [max(0.0, q - slack), min(1.0, q + slack)], 10000), F.max("v"), F.min("v")).first()
    if not n:
        return None
    low, high = (least if q <= slack else bounds[0]), (most if q >= 1 - slack else bounds[1])
    near = values.groupBy(F.when(F.col("v") < low, F.lit(None)).otherwise(F.col("v")).alias("v")).agg(F.count("*").alias("c")).where(F.col("v").isNull() | (F.col("v") <= high))
    rows = sorted(((r["v"], r["c"]) for r in near.collect()), key=lambda r: (r[0] is not None, r[0] is not None and math.isnan(r[0]), r[0]))
    at, ranks = q * (n - 1), np.cumsum([c for _, c in rows])
    first, last = (rows[int(np.searchsorted(ranks, rank, side="right"))][0] for rank in (math.floor(at), math.ceil(at)))
    return first if math.floor(at) == math.ceil(at) or first == last else (math.ceil(at) - at) * first + (at - math.floor(at)) * last


def boost(frame: DataFrame, features: Sequence[str], quantile: float, trees: int = 300, depth: int = 6, leaves: int = 31, shrink: float = 0.05,
          abreast: int = 20, least: int = 20, share: float = 0.5, seed: int = 42, target: str = "y") -> Trees:
    """Gradient boosting of the pinball loss: a forecast that a share ``quantile`` of the targets lies below.

    ``abreast`` trees of a round are grown side by side from the same gradients, each on a random ``share`` of the
    features, and their mean moves the sum as far as as many single rounds with ``shrink`` would. A node is cut where the
    counts of rows below and above the present sum give the greatest gain, at ``least`` rows a side; a level's
    nodes with the greatest gains are cut first, until the tree has ``leaves`` leaves or is ``depth`` deep. A leaf's value
    is the quantile of its rows' residuals. After a round the sums are stored anew with the rows.

    Nodes of several trees that hold the same rows are counted once, and of two nodes below a cut the smaller one is
    counted, for the counts of the other are what is left of those above the cut.
    """
    edges = bin_edges(frame, features)
    start = _quantile(frame, target, quantile)
    model = Trees(edges, float(start or 0.0), (1 - (1 - shrink) ** abreast) / abreast, importance=np.zeros(len(features)))
    if start is None:
        return model
    top = frame.agg(F.max(F.abs(target))).first()[0]
    held, folder = blocks(frame, features, edges, model.start, target, signed=True)
    rng = np.random.default_rng(seed)
    columns = max(1, round(share * len(features)))
    reach = float(np.arcsinh(50 * 4 * max(top, 1e-9)))
    grid = np.sinh(np.linspace(-reach, reach, RESIDUAL_BINS + 1)) / 50  # edges of residual bins, finer near 0
    inner, width = 2**depth - 1, 2**depth
    below_node = [2 * m + 1 if m < inner else m for m in range(inner + width)]  # nodes are laid out by level
    for _ in range(-(-trees // abreast)):
        chosen = np.array([np.sort(rng.choice(len(features), columns, replace=False)) for _ in range(abreast)])
        feature, cut = np.zeros((abreast, inner), np.int16), np.full((abreast, inner), 255, np.uint8)  # uncut: all rows go left
        has = np.ones(abreast, np.int64)  # leaves, by tree
        # by tree the nodes of a level that may be cut, their cuts from the root on, and what their counts follow from: the
        # counts above the cut and whether the left one is counted
        open_: list[list[int]] = [[0] for _ in range(abreast)]
        paths: list[list[tuple]] = [[()] for _ in range(abreast)]
        above: list[list[tuple[np.ndarray, bool]]] = [[] for _ in range(abreast)]
        for level in range(depth):
            nodes = max(map(len, open_))
            if not nodes:
                break
            n, below = np.zeros((2, abreast, nodes, columns, BINS), np.int64)
            counted = [p if level == 0 else [p[2 * i + (not left)] for i, (_, left) in enumerate(above[k])] for k, p in enumerate(paths)]
            found = _node_counts(held, chosen, counted)
            for k in range(abreast):
                cells = found[k]
                if level:
                    cells = [c for (whole, left), part in zip(above[k], cells) for c in ((part, whole - part) if left else (whole - part, part))]
                for slot, c in enumerate(cells):
                    n[k, slot], below[k, slot] = c.sum(axis=1), c[:, 1]
            slope = quantile * n - below  # the gradient's sum of each bin
            n_low, low = n.cumsum(axis=3)[..., :-1], slope.cumsum(axis=3)[..., :-1]
            n_all, all_ = n.sum(axis=3, keepdims=True), slope.sum(axis=3, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = low**2 / n_low + (all_ - low) ** 2 / (n_all - n_low) - all_**2 / n_all
            gain[(n_low < least) | (n_all - n_low < least)] = -np.inf
            flat = gain.reshape(abreast, nodes, -1)
            best = flat.argmax(axis=2)
            top_gain = np.take_along_axis(flat, best[..., None], axis=2)[..., 0]
            for k in range(abreast):
                by_gain = np.argsort(-top_gain[k, :len(open_[k])], kind="stable")
                cut_now = [slot for slot in by_gain if top_gain[k, slot] > 1e-9][:max(leaves - int(has[k]), 0)]
                has[k] += len(cut_now)
                held_nodes, held_paths = open_[k], paths[k]
                open_[k], paths[k], above[k] = [], [], []
                for slot in cut_now:
                    j, b = divmod(int(best[k, slot]), BINS - 1)
                    feature[k, 2**level - 1 + held_nodes[slot]], cut[k, 2**level - 1 + held_nodes[slot]] = chosen[k][j], b
                    model.importance[chosen[k][j]] += top_gain[k, slot]
                for slot in sorted(cut_now) if has[k] < leaves else ():
                    j, b = divmod(int(best[k, slot]), BINS - 1)
                    open_[k] += [2 * held_nodes[slot], 2 * held_nodes[slot] + 1]
                    paths[k] += [(*held_paths[slot], (int(chosen[k][j]), b, side)) for side in (0, 1)]
                    whole = np.stack([n[k, slot] - below[k, slot], below[k, slot]], axis=1)
                    above[k].append((whole, bool(2 * n_low[k, slot, j, b] <= n_all[k, slot, j, 0])))
        used = [np.unique(_reached(feature[k], cut[k], depth)) for k in range(abreast)]
        compact = np.full((abreast, width), 0, np.int64)
        for k in range(abreast):
            compact[k, used[k]] = np.arange(len(used[k]))
        grown = [(feature[k].tolist(), cut[k].tolist()) for k in range(abreast)]

        def spread(block, y, f, found, grown=grown, compact=compact):
            rest = np.searchsorted(grid, np.frombuffer(y) - np.frombuffer(f)) - 1
            rest = np.clip(rest, 0, RESIDUAL_BINS - 1)
            for k, tree in enumerate(grown):
                at, _ = block.places(*tree, below_node, 0, depth)
                found[k] += np.bincount((RESIDUAL_BINS * compact[k]).take(at) + rest, minlength=len(found[k]))
        cells = _counted(held, ["y", "f"], spread, [len(u) * RESIDUAL_BINS for u in used])
        value = np.zeros((abreast, width))
        for k in range(abreast):
            value[k, used[k]] = _quantiles(cells[k].reshape(1, -1, RESIDUAL_BINS), grid, quantile)[0]
        model = _grown(model, feature, cut, value)
        if len(model.roots) < trees:
            before = folder
            held, folder = _added(held, grown, below_node, value, model.weight, depth)
            drop_folder(frame.sparkSession, before)
    drop_folder(frame.sparkSession, folder)
    return model.checked()


def _node_counts(held: DataFrame, chosen: np.ndarray, paths: list[list[tuple]]) -> list[list[np.ndarray]]:
    """Per tree and node, which is given by the cuts above it, the rows of each bin that lie above the present sum and
    under it: (features, 2, bins) of the features ``chosen`` for the tree. Nodes of the same cuts hold the same rows."""
    owners: dict[frozenset, tuple[tuple, list[int]]] = {}
    for k, of_tree in enumerate(paths):
        for path in of_tree:
            owners.setdefault(frozenset(path), (path, []))[1].append(k)
    together: dict[tuple[int, ...], list[tuple]] = {}  # the nodes of the same trees have no row in common
    for path, trees in owners.values():
        together.setdefault(tuple(trees), []).append(path)
    asked = [(np.unique(chosen[list(trees)]), units) for trees, units in together.items()]

    def count(block, under, found):
        low, masks = np.unpackbits(np.frombuffer(under, np.uint8), count=block.n), {(): block.all}

        def mask(path: tuple) -> np.ndarray:
            if path not in masks:
                before, (feature, cut, side) = mask(path[:-1]), path[-1]
                right = before & block.above(feature, cut)
                masks[path], masks[(*path[:-1], (feature, cut, 1 - side))] = (right, before ^ right) if side else (before ^ right, right)
            return masks[path]
        for (columns, units), cells in zip(asked, found):
            planes: list[np.ndarray | None] = [None] * len(units).bit_length()
            for number, path in enumerate(units, 1):
                for digit in range(len(planes)):
                    if number >> digit & 1:
                        at = len(planes) - 1 - digit
                        planes[at] = mask(path) if planes[at] is None else planes[at] | mask(path)
            if units == [()]:
                here, base = None, low.astype(np.int64)
            else:
                number = block.spelled(planes)
                here = np.flatnonzero(number)
                base = 2 * number.take(here).astype(np.int64) - 2 + low.take(here)
            base *= BINS
            size = 2 * BINS * len(units)
            for c, j in enumerate(columns):
                bins = block.columns[j] if here is None else block.columns[j].take(here)
                cells[c * size:(c + 1) * size] += np.bincount(base + bins, minlength=size)
    got = _counted(held, ["under"], count, [2 * BINS * len(columns) * len(units) for columns, units in asked])
    by_node = {}
    for (trees, units), (columns, _), cells in zip(together.items(), asked, got):
        cells = cells.reshape(len(columns), len(units), 2, BINS)
        for k in trees:
            of_tree = cells[np.searchsorted(columns, chosen[k])]
            by_node |= {(k, frozenset(path)): of_tree[:, u] for u, path in enumerate(units)}
    return [[by_node[k, frozenset(path)] for path in of_tree] for k, of_tree in enumerate(paths)]


def _reached(feature: np.ndarray, cut: np.ndarray, depth: int) -> list[int]:
    """The leaves of the last level that rows can reach: below an uncut node, its leftmost."""
    at = [0]
    for level in range(depth):
        at = [2 * m + side for m in at for side in ((0, 1) if cut[2**level - 1 + m] < 255 else (0,))]
    return at


def _quantiles(n: np.ndarray, grid: np.ndarray, q: float) -> np.ndarray:
    """Per tree and leaf the residual with a share ``q`` below it, between the edges of its bin by the counts."""
    total = n.sum(axis=2)
    goal = q * total
    so_far = n.cumsum(axis=2)
    at = np.minimum((so_far < goal[..., None]).sum(axis=2), n.shape[2] - 1)
    inside = np.take_along_axis(n, at[..., None], axis=2)[..., 0]
    before = np.take_along_axis(so_far, at[..., None], axis=2)[..., 0] - inside
    part = np.divide(goal - before, inside, out=np.zeros_like(goal), where=inside > 0)
    return np.where(total > 0, grid[at] + part * (grid[at + 1] - grid[at]), 0.0)


def _grown(model: Trees, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> Trees:
    """``model`` with the trees of a round, whose nodes are laid out by level, behind its own."""
    trees, inner = feature.shape
    size = inner + value.shape[1]
    base = len(model.left) + size * np.arange(trees)
    left = base[:, None] + np.arange(size)
    left[:, :inner] = base[:, None] + 2 * np.arange(inner) + 1
    new = [np.zeros((trees, size), np.int16), np.full((trees, size), 255, np.uint8), left, np.zeros((trees, size))]
    new[0][:, :inner], new[1][:, :inner], new[3][:, inner:] = feature, cut, value
    old = model.feature, model.cut, model.left, model.value
    names = "feature", "cut", "left", "value"
    return replace(model, roots=np.concatenate([model.roots, base.astype(np.int32)]), depth=max(model.depth, int(np.log2(inner + 1))),
                   **{n: np.concatenate([o, v.ravel()]) for n, o, v in zip(names, old, new)})


def _added(held: DataFrame, grown: list[tuple[list[int], list[int]]], left: list[int], value: np.ndarray, weight: float, depth: int) -> tuple[DataFrame, str]:
    """The blocks with a round's trees added to their sums, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (block, y, f, _) in enumerate(_unpacked([batch])):
                total = np.zeros(block.n)
                for tree, values in zip(grown, value):
                    total += values.take(block.places(*tree, left, 0, depth)[0])
                yield _block(block.n, batch.column(1)[k].as_py(), np.frombuffer(y), np.frombuffer(f) + total * weight, signed=True)
    return _stored(held.mapInArrow(run, SIGNED_DDL))


def extra_trees(frame: DataFrame, features: Sequence[str], trees: int = 200, depth: int = 15, leaves: int = 2048, share: float = 1 / 3,
                seed: int = 42, target: str = "y") -> Trees:
    """Extremely randomised trees: each level draws a ``share`` of the features for a tree and, at each of its nodes, one
    random cut a feature inside the bins the node spans; the cut with the greatest drop in variance stands. All rows
    serve every tree; a prediction is the mean of its leaves.

    All trees grow together, one level a pass. A node of fewer than two in ``leaves`` of all rows is not cut, which bounds
    the model whatever the number of rows. The sums of some nodes of a tree meet in one group, where
    the best cut is chosen; the driver gets the chosen cuts.
    """
    edges = bin_edges(frame, features)
    held, folder = blocks(frame, features, edges, 0.0, target)
    total = held.agg(F.sum("n")).first()[0] or 0
    model = Trees(edges, 0.0, 1 / trees, np.arange(trees, dtype=np.int32), np.zeros(trees, np.int16), np.full(trees, 255, np.uint8),
                  np.arange(trees), np.zeros(trees), importance=np.zeros(len(features)))
    if not total:
        drop_folder(frame.sparkSession, folder)
        return model
    least = max(1, total // leaves)
    columns = max(1, round(share * len(features)))
    rng = np.random.default_rng(seed)
    spans = np.array([[1, max(len(e) + 1, 1)] for e in edges], np.int16)
    open_ = [np.array([t]) for t in range(trees)]  # the nodes that may be cut, by tree
    parent = np.arange(trees)
    boxes = [np.broadcast_to(spans, (1, *spans.shape)).copy() for _ in range(trees)]  # bins each of them spans
    for _ in range(depth):
        active = [t for t in range(trees) if len(open_[t])]
        if not active:
            break
        drawn = {t: np.sort(rng.choice(len(features), columns, replace=False)) for t in active}
        cuts = {}
        for t in active:
            low, high = boxes[t][:, drawn[t], 0], boxes[t][:, drawn[t], 1]
            # a cut c sends bins up to c to the left: low - 1 parts missing values from the others
            cuts[t] = (low - (low == 1) + np.floor(rng.random(low.shape) * np.maximum(high - low + (low == 1), 1))).astype(np.uint8)
        place = np.full(len(model.left), -1, np.int64)
        for t in active:
            place[open_[t]] = np.arange(len(open_[t]))
        # a node without an open one below it counts as a leaf, where its rows drop out
        shared = held.sparkSession.sparkContext.broadcast((model.feature, model.cut, _pruned(model.left, parent, open_), model.depth, place, drawn, cuts))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            feature, cut, left, depth, place, drawn, cuts = shared.value
            found = {t: np.zeros((2 * columns + 2, len(c))) for t, c in cuts.items()}  # rows and targets, of all and left of each cut
            leaf = left == np.arange(len(left))
            shut, cut = leaf & (place < 0), np.where(leaf, np.uint8(255), cut)
            nodes = feature.tolist(), cut.tolist(), left.tolist()
            groups = [slice(k, min(k + 8, columns)) for k in range(0, columns, 8)]
            packed = {t: [_packed(c[:, g]) for g in groups] for t, c in cuts.items()}
            for block, y, starts in _together(batches):
                flat, first = block.columns.ravel(), feature.astype(np.int64) * block.n
                for t, s in found.items():
                    levels = min(depth, BIT_LEVELS)
                    at, reached = block.places(*nodes, t, levels)
                    node, row = np.array(reached).take(at), None
                    for level in range(levels, depth + 1):
                        if (level - levels) % 3 == 0 or level == depth:  # rows whose node is not cut any more drop out
                            stay = np.flatnonzero(~shut.take(node))
                            if len(stay) < len(node):
                                node, row = node.take(stay), stay if row is None else row.take(stay)
                            elif row is None:
                                row = stay
                        if level < depth:
                            higher = flat.take(first.take(node) + row) > cut.take(node)
                            node = left.take(node)
                            node += higher
                    here, size = place.take(node), s.shape[1]
                    some = len(row) < block.n
                    value = y.take(row) if some else y
                    ends = np.searchsorted(row, starts)
                    pieces = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
                    for k, (group, limits) in enumerate(zip(groups, packed[t])):
                        chosen = drawn[t][group]
                        bins = np.ones((len(row), 8), np.uint8)
                        for c, j in enumerate(chosen):
                            bins[:, c] = block.columns[j].take(row) if some else block.columns[j]
                        lower = bins <= limits.take(here).view(np.uint8).reshape(-1, 8)
                        code = (lower.view(np.uint64).ravel() * PACK) >> np.uint64(56)  # a bit for each cut that the row is left of
                        cell, width = (here << len(chosen)) + code.astype(np.int64), 1 << len(chosen)
                        n = np.bincount(cell, minlength=size * width).reshape(size, width)
                        bit = (np.arange(width)[:, None] >> np.arange(len(chosen)) & 1).astype(float)
                        s[2 + 2 * group.start:2 + 2 * group.stop:2] += (n @ bit).T
                        if k == 0:
                            s[0] += n.sum(axis=1)
                        # targets are added in the order of rows, a stored block at a time: ties of cuts hang on the last digit
                        for p in pieces:
                            if k == 0:
                                s[1] += np.bincount(here[p], value[p], minlength=size)
                            for c in range(len(chosen)):
                                s[3 + 2 * (group.start + c)] += np.bincount(here[p], np.where(lower[p, c], value[p], 0.0), minlength=size)
            for t, s in found.items():
                parts = range(0, s.shape[1], NODES_A_GROUP)
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(parts), pa.int32()) if k == 0 else pa.array(v, PART[k].type) for k, v in enumerate(
                    (t, [p // NODES_A_GROUP for p in parts], [s[:, p:p + NODES_A_GROUP].tobytes() for p in parts]))], schema=PART)

        def choose(group: pa.Table) -> pa.Table:
            s = sum(np.frombuffer(b).reshape(2 * columns + 2, -1) for b in group.column("sums").to_pylist())
            n, y = s[0], s[1]
            n_low, low = s[2::2], s[3::2]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = low**2 / n_low + (y - low) ** 2 / (n - n_low) - y**2 / n
            gain[(n_low < least) | (n - n_low < least)] = -np.inf
            best = gain.argmax(axis=0)
            pick = best[None, :]
            choice = np.stack([n, y, best, *(np.take_along_axis(a, pick, axis=0)[0] for a in (gain, n_low, low))])
            return pa.table([pa.array([group.column(c)[0].as_py()], BEST.field(c).type) for c in ("tree", "part")] + [pa.array([choice.tobytes()], pa.binary())], schema=BEST)

        chosen = held.select("n", "bins", "y").mapInArrow(sums, "tree int, part int, sums binary").groupBy("tree", "part").applyInArrow(choose, "tree int, part int, choice binary").collect()
        shared.destroy()
        by_tree: dict[int, dict[int, np.ndarray]] = {}
        for r in chosen:
            by_tree.setdefault(r.tree, {})[r.part] = np.frombuffer(r.choice).reshape(6, -1)
        grown = {k: [getattr(model, k)] for k in ("feature", "cut", "left", "value")}
        size = len(model.left)
        for t in active:
            n, y, best, gain, n_low, low = np.concatenate([by_tree[t][p] for p in sorted(by_tree[t])], axis=1)
            node, box = open_[t], boxes[t]
            model.value[node] = np.divide(y, n, out=np.zeros_like(y), where=n > 0)
            split = np.flatnonzero(gain > 1e-12 * np.maximum(y * y, 1e-300))
            j = drawn[t][best[split].astype(int)]
            c = cuts[t][split, best[split].astype(int)]
            model.feature[node[split]], model.cut[node[split]] = j, c
            model.left[node[split]] = size + 2 * np.arange(len(split))
            np.add.at(model.importance, j, gain[split])
            child_n = np.stack([n_low[split], n[split] - n_low[split]], axis=1).ravel()
            child_y = np.stack([low[split], y[split] - low[split]], axis=1).ravel()
            child_box = np.repeat(box[split], 2, axis=0)
            child_box[0::2][np.arange(len(split)), j, 1] = np.maximum(c, 1)
            child_box[1::2][np.arange(len(split)), j, 0] = c.astype(np.int16) + 1
            child = size + np.arange(2 * len(split))
            size += len(child)
            keep = child_n >= 2 * least
            open_[t], boxes[t] = child[keep], child_box[keep]
            for k, v in (("feature", np.zeros(len(child), np.int16)), ("cut", np.full(len(child), 255, np.uint8)),
                         ("left", child), ("value", child_y / np.maximum(child_n, 1))):
                grown[k].append(v)
        inner = np.flatnonzero(grown["left"][0] != np.arange(len(grown["left"][0])))
        parent = np.concatenate([parent, np.empty(size - len(parent), parent.dtype)])
        for side in (0, 1):
            parent[model.left[inner] + side] = inner
        model = replace(model, depth=model.depth + 1, **{k: np.concatenate(v) for k, v in grown.items()})
    drop_folder(frame.sparkSession, folder)
    return model.checked()


def _pruned(left: np.ndarray, parent: np.ndarray, open_: list[np.ndarray]) -> np.ndarray:
    """``left`` where only open nodes and those above one are left; the others point at themselves."""
    out, node = np.arange(len(left)), np.concatenate(open_)
    while len(node):
        out[node] = left[node]
        node = np.unique(parent[node])
        node = node[out[node] != left[node]]
    return out


def _packed(cuts: np.ndarray) -> np.ndarray:
    """Up to eight cuts a node as one number; the bytes behind them are 0, under all bins they are compared with."""
    out = np.zeros((len(cuts), 8), np.uint8)
    out[:, :cuts.shape[1]] = cuts
    return out.view(np.uint64).ravel()
