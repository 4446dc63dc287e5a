"""Many trees grown together, a level at a time, from histograms of binned rows.

A level is one job for all trees: forests of any number, every fold and every setting.
Tasks walk their rows down the trees grown so far, sum two statistics of the rows per
(node, feature, bin) and send the sums of a tree's open nodes, without the zeros, to one
of many reducers, which find the best cut of each node. The driver holds the trees, as
any tree model does, and receives a row per open node.

Nothing depends on what else grows: the rows a tree draws, and the features a node looks
at, come from hashes of (seed, tree, row) and (seed, tree, path), and statistics are
whole numbers or fixed-point ones, whose sums have no order. So a tree grown alone, in a
forest, or beside other folds and settings is the same tree, a shallow tree is the top of
a deep one, and ten trees are the first ten of fifty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finchlab.plans.binned import Chunk, Cuts, chunks, whole

GINI, ENTROPY, SECOND_ORDER = 0, 1, 2
KINDS = {"gini": GINI, "entropy": ENTROPY}
MAX_DEPTH = 30
# cells of histograms a task holds before it sends them, and cells of one reducer's unit
_HELD_CELLS = 1 << 22
_UNIT_CELLS = 1 << 20
_BLOCK = 1 << 21
# cells of histograms that are made at once of rows held as a whole: they stay in the cache
_HELD_UNIT_CELLS = 1 << 16
# beyond so many tasks, sums are combined in groups of tasks first
_WIDE = 64
FIXED = 2.0**24


def fixed(x: np.ndarray) -> np.ndarray:
    """Rounded to multiples of 2**-24: sums are exact, whatever their order."""
    return np.rint(x * FIXED) / FIXED


def mix(x: np.ndarray) -> np.ndarray:
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53


# P(X <= k) of a Poisson distribution with mean 1
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def drawn(hashes: np.ndarray, seed: int) -> np.ndarray:
    """How often a bootstrap sample holds each row."""
    u = uniform(hashes.view(np.uint64) ^ mix(np.array([seed], np.uint64)))
    return np.searchsorted(_POISSON, u, side="right").astype(np.float64)


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def looked_at(path: np.ndarray, seed: int, wanted: int, features: int) -> np.ndarray:
    """(nodes, wanted) different features of each node; -1 where a draw is void."""
    if wanted >= features:
        return np.broadcast_to(np.arange(features), (len(path), features))
    p = _prime(max(features, 2))
    own = mix(path.astype(np.uint64) ^ mix(np.array([seed], np.uint64)))
    first = (mix(own ^ np.uint64(1)) % np.uint64(p)).astype(np.int64)
    step = (mix(own ^ np.uint64(2)) % np.uint64(p - 1)).astype(np.int64) + 1
    # an affine permutation of a prime number of places; the few places beyond the features are skipped
    spare = p - features
    at = (first[:, None] + step[:, None] * np.arange(wanted + spare)) % p
    good = at < features
    order = np.argsort(~good, axis=1, kind="stable")[:, :wanted]
    return np.take_along_axis(np.where(good, at, -1), order, axis=1)


@dataclass(frozen=True)
class Growth:
    """What to grow: one entry per tree in each array."""

    seed: np.ndarray
    held_out: np.ndarray  # the fold whose rows a tree does not see; -1: sees all
    kind: np.ndarray
    min_leaf: np.ndarray
    depth: np.ndarray
    features: int  # looked at per node
    penalty: float = 1.0  # of squared leaf values, second order only

    @property
    def trees(self) -> int:
        return len(self.seed)

    def one(self, tree: int) -> Growth:
        """One of the trees."""
        names = ("seed", "held_out", "kind", "min_leaf", "depth")
        return replace(self, **{name: getattr(self, name)[[tree]] for name in names})


@dataclass
class Grove:
    """The nodes of many trees. The right child of a node follows its left one."""

    root: np.ndarray
    feature: np.ndarray  # -1: a leaf
    cut: np.ndarray
    left: np.ndarray
    sums: np.ndarray  # (nodes, 2): statistics of the rows in the node
    path: np.ndarray
    tree: np.ndarray
    depth: np.ndarray

    @classmethod
    def roots(cls, n: int) -> Grove:
        at = np.arange(n)
        return cls(
            at, np.full(n, -1, np.int32), np.zeros(n, np.uint8), np.full(n, -1, np.int64),
            np.zeros((n, 2)), np.ones(n, np.int64), at.copy(), np.zeros(n, np.int32),
        )

    def share(self) -> np.ndarray:
        """Share of the second statistic in each node."""
        total = self.sums.sum(axis=1)
        return np.divide(self.sums[:, 1], total, out=np.zeros(len(total)), where=total > 0)

    def walk(self, x: np.ndarray, root: int, rows: np.ndarray | None = None) -> np.ndarray:
        """The leaf each row (or each of `rows`) comes to."""
        rows = np.arange(len(x)) if rows is None else rows
        at = np.full(len(rows), root)
        live = np.arange(len(rows))
        while len(live):
            node = at[live]
            feature = self.feature[node]
            inner = feature >= 0
            live, node, feature = live[inner], node[inner], feature[inner]
            at[live] = self.left[node] + (x[rows[live], feature] > self.cut[node])
        return at

    def steps(self, x: np.ndarray, root: int, depth: int) -> np.ndarray:
        """(depth + 1, rows): the node of each row after each step; a leaf stays."""
        out = np.empty((depth + 1, len(x)), dtype=np.int64)
        out[0] = root
        rows = np.arange(len(x))
        for k in range(depth):
            feature = self.feature[out[k]]
            inner = feature >= 0
            go = self.left[out[k]] + (x[rows, np.maximum(feature, 0)] > self.cut[out[k]])
            out[k + 1] = np.where(inner, go, out[k])
        return out

    def select(self, trees: np.ndarray) -> Grove:
        """Some of the trees, as a grove of their own."""
        number = np.full(len(self.root), -1)
        number[trees] = np.arange(len(trees))
        keep = np.flatnonzero(number[self.tree] >= 0)
        at = np.full(len(self.tree), -1)
        at[keep] = np.arange(len(keep))
        left = self.left[keep]
        return Grove(
            at[self.root[trees]], self.feature[keep], self.cut[keep], np.where(left >= 0, at[left], -1),
            self.sums[keep], self.path[keep], number[self.tree[keep]], self.depth[keep],
        )


def joined(groves: Sequence[Grove]) -> Grove:
    """Groves one after another as one."""
    if len(groves) == 1:
        return groves[0]
    nodes = np.cumsum([0, *[len(g.tree) for g in groves]])
    trees = np.cumsum([0, *[len(g.root) for g in groves]])
    return Grove(
        np.concatenate([g.root + a for g, a in zip(groves, nodes[:-1], strict=True)]),
        *[np.concatenate([getattr(g, name) for g in groves]) for name in ("feature", "cut")],
        np.concatenate([np.where(g.left >= 0, g.left + a, -1) for g, a in zip(groves, nodes[:-1], strict=True)]),
        *[np.concatenate([getattr(g, name) for g in groves]) for name in ("sums", "path")],
        np.concatenate([g.tree + a for g, a in zip(groves, trees[:-1], strict=True)]),
        np.concatenate([g.depth for g in groves]),
    )


# (chunk, tree) to the two statistics of every row; rows with zeros in both are left out
Statistics = Callable[[Chunk, int], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class ClassCounts:
    """Rows of each class, as often as the tree's bootstrap sample holds them."""

    seed: np.ndarray
    held_out: np.ndarray
    bootstrap: bool

    def __call__(self, chunk: Chunk, tree: int) -> tuple[np.ndarray, np.ndarray]:
        y, fold, hashes = (chunk.columns[c] for c in ("y", "fold", "hash"))
        weight = drawn(hashes, int(self.seed[tree])) if self.bootstrap else np.ones(len(y))
        weight = np.where(fold == self.held_out[tree], 0.0, weight) if self.held_out[tree] >= 0 else weight
        return weight * (y == 0), weight * (y == 1)


@dataclass
class _Level:
    """The open nodes of a level, ranked inside their trees."""

    nodes: np.ndarray
    rank: np.ndarray = field(init=False)
    first: dict[int, np.ndarray] = field(init=False)

    def __init__(self, grove: Grove, nodes: np.ndarray):
        order = np.argsort(grove.tree[nodes], kind="stable")
        self.nodes = nodes[order]
        tree = grove.tree[self.nodes]
        new = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
        size = np.diff(np.concatenate((new, [len(tree)])))
        self.rank = np.full(len(grove.tree), -1)
        self.rank[self.nodes] = np.arange(len(tree)) - np.repeat(new, size)
        self.first = {int(t): self.nodes[a : a + n] for t, a, n in zip(tree[new], new, size, strict=True)}


UNIT = "unit bigint, part int, cells binary, sums binary"
BEST = "node bigint, feature int, cut int, l0 double, l1 double, r0 double, r1 double"


def _per_unit(width: int, bins: int) -> int:
    """Open nodes of one unit."""
    return max(1, _UNIT_CELLS // (width * bins))


def _entry_sums(
    chunk: Chunk, rows: np.ndarray, node: np.ndarray, nodes: int, statistics: tuple[np.ndarray, ...], cuts: Cuts
) -> np.ndarray:
    """(2, nodes * features * bins): histograms of all features from the entries of the rows alone.

    What the entries of a feature leave of a node's sums belongs to its rows at zero;
    sums are exact, so the difference is.
    """
    features, bins = cuts.features, cuts.bins
    at = np.full(len(chunk), -1)
    at[rows] = node
    own = at[chunk.row]
    some = slice(None) if len(rows) == len(chunk) else np.flatnonzero(own >= 0)
    row = chunk.row[some]
    code = (own[some] * features + chunk.at[some]) * bins + chunk.bin[some]
    out = np.empty((2, nodes, features, bins))
    for k, s in enumerate(statistics):
        out[k] = np.bincount(code, s[row], nodes * features * bins).reshape(nodes, features, bins)
        rest = np.bincount(node, s[rows], nodes)[:, None] - out[k].sum(axis=2)
        out[k][:, np.arange(features), cuts.zero] += rest
    return out.reshape(2, -1)


def _summed(level: _Level, grove: Grove, growth: Growth, cuts: Cuts, statistics: Statistics):
    """Histograms of a task's rows, by unit: a tree's open nodes, or as many as fit."""
    bins = cuts.bins
    width = min(growth.features, cuts.features)
    per = _per_unit(width, bins)
    looks_at_all = growth.features >= cuts.features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[int, np.ndarray] = {}
        cells = 0

        def sent() -> pa.RecordBatch:
            units, places, sums = [], [], []
            for unit, table in held.items():
                some = np.flatnonzero(table.any(axis=0))
                units.append(unit)
                places.append(some.astype("<i4").tobytes())
                sums.append(np.ascontiguousarray(table[:, some]).tobytes())
            return pa.record_batch(
                [
                    pa.array(units, pa.int64()),
                    pa.array([part] * len(units), pa.int32()),
                    pa.array(places, pa.binary()),
                    pa.array(sums, pa.binary()),
                ],
                names=["unit", "part", "cells", "sums"],
            )

        for chunk in chunks(batches, cuts):
            for tree, nodes in level.first.items():
                s0, s1 = statistics(chunk, tree)
                rows = np.flatnonzero((s0 != 0) | (s1 != 0))
                rank = level.rank[grove.walk(chunk.x, int(grove.root[tree]), rows)]
                rows, rank = rows[rank >= 0], rank[rank >= 0]
                if not len(rows):
                    continue
                looked = looked_at(grove.path[nodes], int(growth.seed[tree]), width, cuts.features)
                for low in range(0, len(nodes), per):
                    n = min(per, len(nodes) - low)
                    inside = (rank >= low) & (rank < low + n) if n < len(nodes) else slice(None)
                    own, at = rows[inside], rank[inside] - low
                    if not len(own):
                        continue
                    unit = tree << 32 | low
                    if unit not in held:
                        held[unit] = np.zeros((2, n * width * bins))
                        cells += held[unit].size
                    if looks_at_all and len(own) * width > max(held[unit].shape[1], len(chunk.row)):
                        held[unit] += _entry_sums(chunk, own, at, n, (s0, s1), cuts)
                        continue
                    step = max(1, _BLOCK // width)
                    for begin in range(0, len(own), step):
                        r, a = own[begin : begin + step], at[begin : begin + step]
                        seen = looked[low + a]
                        bin_ = chunk.x[r[:, None], np.maximum(seen, 0)].astype(np.int64)
                        code = (((a * width)[:, None] + np.arange(width)) * bins + bin_).ravel()
                        for k, s in enumerate((s0, s1)):
                            held[unit][k] += np.bincount(code, np.repeat(s[r], width), held[unit].shape[1])
                if cells > _HELD_CELLS:
                    yield sent()
                    held.clear()
                    cells = 0
        yield sent()

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[bytes, bytes]]]]:
    """Rows of one unit together; they come sorted. Each list holds a part of them."""
    for batch in batches:
        unit = batch.column(0).to_pylist()
        for i, u in enumerate(unit):
            yield u, (batch.column(2)[i].as_buffer(), batch.column(3)[i].as_buffer())


def _added(n_cells: Callable[[int], int]):
    """Sums over the rows of each unit, one unit at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        last, table = None, None
        for unit, (cells, sums) in _units(batches):
            if unit != last:
                if last is not None:
                    yield last, table
                last, table = unit, np.zeros((2, n_cells(unit)))
            at = np.frombuffer(cells, dtype="<i4")
            table[:, at] += np.frombuffer(sums, dtype=np.float64).reshape(2, -1)
        if last is not None:
            yield last, table

    return run


def _impurity(kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = a / n, b / n
        if kind == GINI:
            out = 1.0 - p * p - q * q
        else:
            out = -np.where(a > 0, p * np.log2(p), 0.0) - np.where(b > 0, q * np.log2(q), 0.0)
    return np.where(n > 0, out, 0.0)


def gains(kind: int, left: np.ndarray, total: np.ndarray, min_leaf: float, penalty: float) -> np.ndarray:
    """Gain of every cut, -1 where it is not allowed. `left` is (2, nodes, features, bins).

    Rounded, so that cuts of equal gain are equal, and the first of them is taken.
    """
    a, b = left
    c, d = total[0] - a, total[1] - b
    if kind == SECOND_ORDER:
        g, h = total
        gain = a * a / (b + penalty) + c * c / (d + penalty) - g * g / (h + penalty)
        allowed = (b >= min_leaf) & (d >= min_leaf)
    else:
        n_left, n_right = a + b, c + d
        n = n_left + n_right
        gain = (
            _impurity(kind, *total)
            - n_left / np.maximum(n, 1e-300) * _impurity(kind, a, b)
            - n_right / np.maximum(n, 1e-300) * _impurity(kind, c, d)
        )
        allowed = (n_left >= min_leaf) & (n_right >= min_leaf) & (n_left > 0) & (n_right > 0)
    gain = np.round(gain, 9)
    return np.where(allowed & (gain > 0), gain, -1.0)


def _best_cuts(
    table: np.ndarray, looked: np.ndarray, growth: Growth, tree: int, bins: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none) and cut of each node of a tree from its histograms, and (4, nodes) sums on both sides."""
    nodes, width = looked.shape
    left = table.reshape(2, nodes, width, bins).cumsum(axis=3)
    total = left[:, :, :, -1:]
    gain = gains(int(growth.kind[tree]), left, total, float(growth.min_leaf[tree]), growth.penalty)
    gain[looked < 0] = -1.0
    flat = gain.reshape(nodes, -1)
    best = flat.argmax(axis=1)
    at = np.arange(nodes)
    slot, cut = best // bins, best % bins
    some = flat[at, best] > 0
    whole = total[:, at, np.argmax(looked >= 0, axis=1), 0]
    low_sums = np.where(some, left[:, at, slot, cut], whole)
    return np.where(some, looked[at, slot], -1), cut, np.concatenate((low_sums, whole - low_sums))


def _best(level: _Level, grove: Grove, growth: Growth, cuts: Cuts):
    """The best cut of every open node of the units that come, and the sums on both sides."""
    bins = cuts.bins
    width = min(growth.features, cuts.features)
    per = _per_unit(width, bins)

    def size(unit: int) -> int:
        return min(per, len(level.first[unit >> 32]) - (unit & 0xFFFFFFFF))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, table in _added(lambda u: size(u) * width * bins)(batches):
            tree, low = unit >> 32, unit & 0xFFFFFFFF
            nodes = level.first[tree][low : low + size(unit)]
            looked = looked_at(grove.path[nodes], int(growth.seed[tree]), width, cuts.features)
            feature, cut, sums = _best_cuts(table, looked, growth, tree, bins)
            yield pa.record_batch(
                [
                    pa.array(nodes.astype(np.int64)),
                    pa.array(feature.astype(np.int32)),
                    pa.array(cut.astype(np.int32)),
                    *[pa.array(s) for s in sums],
                ],
                names=["node", "feature", "cut", "l0", "l1", "r0", "r1"],
            )

    return run


def _recombined(level: _Level, growth: Growth, cuts: Cuts):
    """The sums of a group of tasks as one row per unit."""
    bins = cuts.bins
    width = min(growth.features, cuts.features)
    per = _per_unit(width, bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def size(u: int) -> int:
            return min(per, len(level.first[u >> 32]) - (u & 0xFFFFFFFF)) * width * bins

        for unit, table in _added(size)(batches):
            some = np.flatnonzero(table.any(axis=0))
            yield pa.record_batch(
                [
                    pa.array([unit], pa.int64()),
                    pa.array([0], pa.int32()),
                    pa.array([some.astype("<i4").tobytes()], pa.binary()),
                    pa.array([np.ascontiguousarray(table[:, some]).tobytes()], pa.binary()),
                ],
                names=["unit", "part", "cells", "sums"],
            )

    return run


def _next_level(rows: DataFrame, level: _Level, grove: Grove, growth: Growth, cuts: Cuts, statistics: Statistics):
    sums = rows.mapInArrow(_summed(level, grove, growth, cuts, statistics), UNIT)
    tasks = rows.rdd.getNumPartitions()
    if tasks > _WIDE:
        group = F.pmod("part", F.lit(int(tasks**0.5)))
        sums = sums.repartition("unit", group).sortWithinPartitions("unit")
        sums = sums.mapInArrow(_recombined(level, growth, cuts), UNIT)
    sums = sums.repartition("unit").sortWithinPartitions("unit")
    return sums.mapInArrow(_best(level, grove, growth, cuts), BEST).toArrow()


def _extended(
    grove: Grove, growth: Growth, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, sums: np.ndarray
) -> tuple[Grove, np.ndarray]:
    """The grove with the cuts of a level, nodes ascending, and the nodes that are open then. `sums` is (nodes, 4)."""
    first = grove.depth[node] == 0
    grove.sums[node[first]] = sums[first, :2] + sums[first, 2:]
    node, feature, cut, sums = (a[feature >= 0] for a in (node, feature, cut, sums))
    left = len(grove.tree) + 2 * np.arange(len(node))
    grove.feature[node], grove.cut[node], grove.left[node] = feature, cut, left
    both = np.repeat(node, 2)
    side = np.tile([0, 1], len(node))
    child = np.arange(len(both)) + len(grove.tree)
    grove = Grove(
        grove.root,
        np.concatenate((grove.feature, np.full(len(both), -1, np.int32))),
        np.concatenate((grove.cut, np.zeros(len(both), np.uint8))),
        np.concatenate((grove.left, np.full(len(both), -1, np.int64))),
        np.concatenate((grove.sums, sums.reshape(-1, 2))),
        np.concatenate((grove.path, 2 * grove.path[both] + side)),
        np.concatenate((grove.tree, grove.tree[both])),
        np.concatenate((grove.depth, grove.depth[both] + 1)),
    )
    tree, own = grove.tree[child], grove.sums[child]
    go = grove.depth[child] < growth.depth[tree]
    classes = growth.kind[tree] != SECOND_ORDER
    size = np.where(classes, own.sum(axis=1), own[:, 1])
    go &= size >= 2 * growth.min_leaf[tree]
    go &= ~classes | (own.min(axis=1) > 0)
    return grove, child[go]


def grow(rows: DataFrame, growth: Growth, cuts: Cuts, statistics: Statistics) -> Grove:
    """All trees of `growth`, level by level. `rows` are `binned` rows with what `statistics` reads."""
    grove = Grove.roots(growth.trees)
    open_ = np.flatnonzero(growth.depth > 0) if growth.trees else np.zeros(0, np.int64)
    leaves_only = np.flatnonzero(growth.depth == 0)
    if len(leaves_only):
        raise ValueError("a tree has at least one level")
    while len(open_):
        level = _Level(grove, open_)
        found = _next_level(rows, level, grove, growth, cuts, statistics)
        node, feature, cut = (found.column(c).to_numpy() for c in ("node", "feature", "cut"))
        sums = np.stack([found.column(c).to_numpy() for c in ("l0", "l1", "r0", "r1")], axis=1)
        # in the order of their nodes, not of their arrival
        order = np.argsort(node)
        node, feature, cut, sums = node[order], feature[order], cut[order], sums[order]
        grove, open_ = _extended(grove, growth, node, feature, cut, sums)
    return grove


def grow_here(chunk: Chunk, growth: Growth, tree: int, cuts: Cuts, statistics: Statistics) -> Grove:
    """One tree over rows that are held as a whole: the tree that `grow` gives."""
    seed, growth = int(growth.seed[tree]), growth.one(tree)
    bins, width = cuts.bins, min(growth.features, cuts.features)
    per = max(1, _HELD_UNIT_CELLS // (width * bins))
    s0, s1 = statistics(chunk, tree)
    rows = np.flatnonzero((s0 != 0) | (s1 != 0))
    rank = np.zeros(len(rows), dtype=np.int64)
    grove, open_ = Grove.roots(1), np.zeros(1, dtype=np.int64)
    while len(open_) and len(rows):
        order = np.argsort(rank, kind="stable")
        rows, rank = rows[order], rank[order]
        found = []
        for low in range(0, len(open_), per):
            n = min(per, len(open_) - low)
            a, b = np.searchsorted(rank, (low, low + n))
            own, at = rows[a:b], rank[a:b] - low
            looked = looked_at(grove.path[open_[low : low + n]], seed, width, cuts.features)
            if growth.features >= cuts.features and len(own) * width > max(n * width * bins, len(chunk.row)):
                table = _entry_sums(chunk, own, at, n, (s0, s1), cuts)
            else:
                table = _cell_sums(chunk, own, at, looked, (s0, s1), bins)
            found.append(_best_cuts(table, looked, growth, 0, bins))
        feature, cut, sums = (np.concatenate(c, axis=-1) for c in zip(*found, strict=True))
        before = open_
        grove, open_ = _extended(grove, growth, before, feature, cut, sums.T)
        live = feature[rank] >= 0
        rows, rank = rows[live], rank[live]
        number = np.full(len(grove.tree), -1)
        number[open_] = np.arange(len(open_))
        rank = number[grove.left[before[rank]] + (chunk.x[rows, feature[rank]] > cut[rank])]
        rows, rank = rows[rank >= 0], rank[rank >= 0]
    return grove


def _cell_sums(
    chunk: Chunk, rows: np.ndarray, node: np.ndarray, looked: np.ndarray, statistics: tuple[np.ndarray, ...], bins: int
) -> np.ndarray:
    """(2, nodes * width * bins): histograms of the features that each node looks at."""
    nodes, width = looked.shape
    size = nodes * width * bins
    out = np.zeros((2, size))
    step = max(1, _HELD_UNIT_CELLS // width)
    base = (np.arange(nodes * width) * bins).reshape(nodes, width)
    seen = np.maximum(looked, 0)
    for begin in range(0, len(rows), step):
        r, a = rows[begin : begin + step], node[begin : begin + step]
        code = (base[a] + chunk.x[r[:, None], seen[a]]).ravel()
        for k, s in enumerate(statistics):
            out[k] += np.bincount(code, np.repeat(s[r], width), size)
    return out


NODES = "tree bigint, feature binary, cut binary, left binary, sums binary, path binary, depth binary"
_KINDS = {"feature": np.int32, "cut": np.uint8, "left": np.int64, "sums": np.float64, "path": np.int64, "depth": np.int32}


def grow_held(spark: SparkSession, table: Broadcast, growth: Growth, cuts: Cuts, statistics: Statistics) -> Grove:
    """The trees of `grow` over a held table: a task grows some of them from the root to the leaves."""
    parts = max(1, min(growth.trees, 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        for batch in batches:
            for first in batch.column(0).to_pylist():
                chunk = whole(table, cuts) if chunk is None else chunk
                for tree in range(first, growth.trees, parts):
                    grove = grow_here(chunk, growth, tree, cuts, statistics)
                    packed = [np.ascontiguousarray(getattr(grove, c), k).tobytes() for c, k in _KINDS.items()]
                    yield pa.record_batch(
                        [pa.array([tree], pa.int64()), *[pa.array([b], pa.binary()) for b in packed]],
                        names=["tree", *_KINDS],
                    )

    found = spark.range(0, parts, 1, parts).mapInArrow(run, NODES).toArrow().sort_by("tree")
    groves = []
    for row in found.to_pylist():
        own = {c: np.frombuffer(row[c], k).copy() for c, k in _KINDS.items()}
        own["sums"] = own["sums"].reshape(-1, 2)
        groves.append(Grove(root=np.zeros(1, np.int64), tree=np.zeros(len(own["cut"]), np.int64), **own))
    return joined(groves) if groves else Grove.roots(0)
