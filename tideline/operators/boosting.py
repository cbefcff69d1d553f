"""Gradient-boosted trees for a binary target over quantised features: leaf-wise, depth-wise and oblivious growth.

Rows stay in a table of bins. A pass is one job over it: every task routes its rows through the trees grown so far and
adds up gradients, hessians and rows by leaf, feature and bin; tasks' sums meet by blocks of features, and the driver
gets sums whose size depends on leaves, features and bins alone. Of two new leaves only the smaller one is summed up, its
sibling is what is left of the parent. The models of all folds grow in the same passes, each row counting for the folds
that don't hold it out, and the scores of held-out rows after each tree tell when a model stops.

Gradients and losses are rounded to multiples of 2 ** -26 and added as integers, so for given bins trees don't depend on partitions.

A leaf-wise tree opens its best leaf first. Since the order in which leaves are summed up doesn't change the tree, a pass
sums up the children of all leaves that may still be opened: as many passes as the tree is deep, not as it has leaves.

Missing values (null, NaN) have a bin of their own, below all others. Ties of gain go to the lower feature and bin.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from contextlib import ExitStack
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.plans.settled import settled

#: Gradients' unit; rows of a batch; features of a block; tasks whose sums meet first; trees between two writes of margins;
#: leaves of a model that a pass sums up at most, so that the driver holds no more at once.
UNIT, ROWS, BLOCK, TASKS, WRITE, ASK = 1 << 26, 8192, 32, 64, 16, 32


@dataclass(frozen=True)
class Boosting:
    """Settings of a model. ``symmetric`` trees have one split for each level, of ``depth`` levels."""

    trees: int = 100
    rate: float = 0.1
    leaves: int = 31
    depth: int = 12
    symmetric: bool = False
    min_rows: int = 20
    min_weight: float = 1e-3
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 1.0
    subsample: float = 1.0
    sample_every: int = 1
    colsample: float = 1.0
    colsample_level: float = 1.0
    bins: int = 64
    positive_weight: float = 1.0
    patience: int | None = None
    seed: int = 42

    def check(self) -> None:
        if not (self.trees >= 1 and 0 < self.rate <= 1 and self.leaves >= 2 and 1 <= self.depth <= 60 and 3 <= self.bins <= 512 and self.sample_every >= 1):
            raise ValueError("trees >= 1, 0 < rate <= 1, leaves >= 2, a depth of 1 to 60 and 3 to 512 bins are needed")
        if not (0 < self.subsample <= 1 and 0 < self.colsample <= 1 and 0 < self.colsample_level <= 1 and self.l1 >= 0 and self.l2 >= 0 and self.min_gain >= 0):
            raise ValueError("samples lie in (0, 1], penalties aren't negative")
        if self.symmetric and self.depth > 10:
            raise ValueError("symmetric trees have ten levels at most")


@dataclass
class Tree:
    """Nodes in arrays: rows whose bin of ``feature`` is at most ``bin`` go left; a leaf leads to itself."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: int) -> int:
        k = len(self.value)
        for column, x in ((self.feature, -1), (self.bin, 0), (self.left, k), (self.right, k), (self.value, value), (self.cover, cover), (self.gain, 0.0)):
            column.append(x)
        return k

    def split(self, node: int, feature: int, at: int, left: int, right: int, gain: float) -> None:
        self.feature[node], self.bin[node], self.left[node], self.right[node], self.gain[node] = feature, at, left, right, gain

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        return Routes(self).leaf(x)


class Routes:
    """A tree as masks of leaves: for each feature and bin those that no split on the feature rules out. What the masks of a
    row's features have in common is its leaf, so rows needn't be led from node to node. A word holds 62 leaves."""

    WORD = 62

    def __init__(self, tree: Tree):
        order, span = [], {}

        def down(node: int) -> None:
            first = len(order)
            if tree.feature[node] < 0:
                order.append(node)
            else:
                down(tree.left[node])
                down(tree.right[node])
            span[node] = first, len(order)

        down(0)
        inner = [n for n in span if tree.feature[n] >= 0]
        self.value, self.words = np.array(tree.value), []
        for at in range(0, len(order), self.WORD):
            bits = lambda a, b, at=at: (1 << min(max(b - at, 0), self.WORD)) - (1 << min(max(a - at, 0), self.WORD))
            masks: dict[int, np.ndarray] = {}
            for f in dict.fromkeys(tree.feature[n] for n in inner):  # bins beyond the last split's are like the next one
                masks[f] = np.full(2 + max(tree.bin[n] for n in inner if tree.feature[n] == f), bits(0, len(order)), "i8")
            for n in inner:
                mask = masks[tree.feature[n]]
                mask[: tree.bin[n] + 1] &= ~bits(*span[tree.right[n]])
                mask[tree.bin[n] + 1 :] &= ~bits(*span[tree.left[n]])
            self.words.append((np.array([0, *order[at : at + self.WORD]]), masks))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins; quickest if columns are contiguous."""
        at = np.zeros(len(x), int)
        for leaves, masks in self.words:
            left = None
            for f, mask in masks.items():
                found = mask.take(x[:, f], mode="clip")
                left = found if left is None else np.bitwise_and(left, found, out=left)
            if left is not None:
                at += leaves.take(np.frexp(left.astype("f8"))[1])  # a power of two, or 0 where the leaf lies in another word
        return at

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.value.take(self.leaf(x))


@dataclass
class Model:
    """Trees over bins of ``columns``, with the margin they start from and what each feature gained."""

    columns: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)
    best: int = 0

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += Routes(t).values(x)
        return out

    def importances(self) -> list[float]:
        """Each feature's share of all gain."""
        out = np.zeros(len(self.columns))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    out[f] += g
        return (out / out.sum() if out.sum() else out).tolist()

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Model:
        found = json.loads(text)
        return cls(**found | {"trees": [Tree(**t) for t in found["trees"]]})


# ---------------------------------------------------------------- bins


def fit_edges(df: DataFrame, columns: Sequence[str], bins: int = 64) -> list[list[float]]:
    """Upper ends of each column's bins: quantiles of a bounded sketch, all columns in one pass."""
    shares = F.array(*(F.lit(k / (bins - 1)) for k in range(1, bins - 1)))
    number = lambda k: F.nanvl(F.col(f"c{k}"), F.lit(None).cast("double"))
    row = df.select(*numbered(columns)).agg(*(F.percentile_approx(number(k), shares, 100 * bins).alias(f"c{k}") for k in range(len(columns)))).first()
    return [sorted(set(row[i] or [])) for i in range(len(columns))]


def numbered(columns: Sequence[str]) -> list[Column]:
    """Columns as doubles named c0, c1, ..., so that no name is odd or clashes."""
    return [F.col("`" + c.replace("`", "``") + "`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)]


def binned(batch: pa.RecordBatch, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """The bins of a batch of ``numbered`` columns, a row each (columns are contiguous): 0 for missing values."""
    out = np.zeros((len(edges), batch.num_rows), "<u2").T
    for k, e in enumerate(edges):
        x = np.asarray(batch.column(f"c{k}").fill_null(math.nan))
        out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x))
    return out


def _as_bytes(rows: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype="i4") * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _from_bytes(column: pa.Array, kind: str, n: int) -> np.ndarray:
    """The rows that ``_as_bytes`` made: a view of the column, whose values lie one behind the other."""
    _, ends, data = column.buffers()
    first = np.frombuffer(ends, "i8" if pa.types.is_large_binary(column.type) else "i4")[column.offset]
    return np.frombuffer(data, kind, len(column) * n, first).reshape(-1, n)


def _kind(bins: int) -> str:
    return "u1" if bins <= 256 else "<u2"


def _table(edges: list[list[float]], base: list[float], kind: str):
    def run(batches):
        for batch in _slices(batches):
            x = binned(batch, edges).astype(kind)
            margins = np.tile(np.array(base), (batch.num_rows, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "y", "fold")), _as_bytes(x), _as_bytes(margins)], names=["h", "y", "fold", "x", "margins"])

    return run


_ROWS = "h long, y int, fold int, x binary, margins binary"


# ---------------------------------------------------------------- a pass over the rows


@dataclass
class Request:
    """What a pass does for a model: the trees since margins were written, the growing tree and the leaves to sum up."""

    trees: list[Tree]
    growing: Tree
    wanted: list[int]
    features: list[int]
    number: int
    judge: bool


def sampled(h: np.ndarray, number: int, share: float, seed: int) -> np.ndarray:
    """Whether rows take part in a tree, by a hash of their key, the tree and the seed."""
    x = h.view("u8") ^ np.uint64((number * 0x9E3779B97F4A7C15 + seed * 0xD1342543DE82EF95) & (1 << 64) - 1)
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ x >> np.uint64(30)) * np.uint64(by)
    return (x >> np.uint64(11)).astype("f8") < share * (1 << 53)


def gradients(margin: np.ndarray, y: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the weighted log loss, in units."""
    p = 1 / (1 + np.exp(-margin))
    w = np.where(y == 1, weight, 1.0)
    return np.rint(w * (p - y) * UNIT), np.rint(w * p * (1 - p) * UNIT)


def losses(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each row's log loss, in units."""
    p = np.clip(1 / (1 + np.exp(-margin)), 1e-15, 1 - 1e-15)
    return np.rint(-np.where(y == 1, np.log(p), np.log(1 - p)) * UNIT)


def _read(batch: pa.RecordBatch, n_features: int, n_models: int, kind: str):
    """The columns of a slice; bins and margins with contiguous columns."""
    h, y, fold = (np.asarray(batch.column(c)) for c in ("h", "y", "fold"))
    return h, y, fold, np.asfortranarray(_from_bytes(batch.column("x"), kind, n_features)), np.asfortranarray(_from_bytes(batch.column("margins"), "f8", n_models))


def _slices(batches):
    """Batches in even parts of at most ROWS rows."""
    for batch in batches:
        size = max(1, -(-batch.num_rows // max(1, -(-batch.num_rows // ROWS))))
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


_SUMS = "model int, node int, block int, part int, sums binary"


def _pass(requests: dict[int, Request], n_features: int, n_models: int, s: Boosting):
    """Sums by leaf, feature and bin. Only rows that lie in a leaf to sum up go through the trees since margins were written."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() // TASKS
        sums: dict[int, np.ndarray] = {}
        lost = {k: np.zeros(2, "i8") for k, r in requests.items() if r.judge}
        routes, places = {}, {}
        for k, r in requests.items():
            routes[k] = Routes(r.growing) if r.wanted else None, [Routes(t) for t in r.trees]
            places[k] = np.full(len(r.growing.value), -1)
            places[k][r.wanted] = np.arange(len(r.wanted))
        seen = False
        for batch in _slices(batches):
            h, y, fold, x, margins = _read(batch, n_features, n_models, _kind(s.bins))
            seen = True

            def moved(k: int, rows: np.ndarray, x=x, margins=margins) -> tuple[np.ndarray, np.ndarray]:
                own, m = x.T.take(rows, 1).T, margins[:, k].take(rows)
                for t in routes[k][1]:
                    m += t.values(own)
                return own, m

            for k, r in requests.items():
                if r.judge:
                    held = np.flatnonzero(fold == k)
                    lost[k] += np.array([losses(moved(k, held)[1], y[held]).sum(), len(held)]).astype("i8")
                if not r.wanted:
                    continue
                place = places[k].take(routes[k][0].leaf(x))
                counts = (place >= 0) & (fold != k)
                if s.subsample < 1:
                    counts &= sampled(h, r.number // s.sample_every, s.subsample, s.seed)
                rows = np.flatnonzero(counts)
                own, m = moved(k, rows)
                g, w = gradients(m, y[rows], s.positive_weight)
                first, size = place.take(rows) * s.bins, len(r.wanted) * s.bins
                found = np.empty((len(r.features), size, 3), "i8")
                for j, f in enumerate(r.features):
                    at = first + own[:, f]
                    found[j, :, 0], found[j, :, 1], found[j, :, 2] = np.bincount(at, g, size), np.bincount(at, w, size), np.bincount(at, minlength=size)
                sums[k] = found if k not in sums else np.add(sums[k], found, out=sums[k])
        rows = [(k, -1, 0, part, found.tobytes()) for k, found in lost.items() if seen]
        for k, found in sums.items():
            by_leaf = found.reshape(len(found), -1, s.bins, 3)
            for i, node in enumerate(requests[k].wanted):
                rows += [(k, node, block, part, by_leaf[at : at + BLOCK, i].tobytes()) for block, at in enumerate(range(0, len(found), BLOCK))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["model", "node", "block", "part", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "i8") for x in table.column("sums").to_pylist())
    first = table.slice(0, 1)
    return pa.table([*(first.column(c) for c in ("model", "node", "block", "part")), pa.array([total.tobytes()], pa.binary())], names=["model", "node", "block", "part", "sums"])


def _summed(rows: DataFrame, tasks: int, requests: dict[int, Request], n_features: int, n_models: int, s: Boosting) -> dict[tuple[int, int], np.ndarray]:
    """The sums of a pass by model and node: tasks' sums meet by 64 tasks, then all."""
    found = rows.mapInArrow(_pass(requests, n_features, n_models, s), _SUMS)
    by = ["model", "node", "block"]
    if tasks > TASKS:
        found = found.groupBy(*by, "part").applyInArrow(_added, _SUMS)
    found = found.groupBy(*by).applyInArrow(_added, _SUMS)
    out: dict[tuple[int, int], list] = {}
    for r in sorted(found.collect(), key=lambda r: r.block):  # leaves x features x bins
        out.setdefault((r.model, r.node), []).append(np.frombuffer(bytes(r.sums), "i8"))
    return {key: np.concatenate(blocks) for key, blocks in out.items()}


def _moved(requests: dict[int, list[Tree]], n_features: int, n_models: int, kind: str):
    """Margins after further trees."""

    def run(batches):
        routes = {k: [Routes(t) for t in trees] for k, trees in requests.items()}
        for batch in _slices(batches):
            *_, x, margins = _read(batch, n_features, n_models, kind)
            margins = np.array(margins, order="F")
            for k, trees in routes.items():
                for t in trees:
                    margins[:, k] += t.values(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "y", "fold", "x")), _as_bytes(margins)], names=["h", "y", "fold", "x", "margins"])

    return run


# ---------------------------------------------------------------- growth


def score(g, h, s: Boosting):
    """What a leaf of these sums takes off the loss, doubled."""
    g, h = np.asarray(g) / UNIT, np.asarray(h) / UNIT
    pull = np.maximum(np.abs(g) - s.l1, 0)
    return np.divide(pull * pull, h + s.l2, out=np.zeros_like(pull), where=h + s.l2 > 0)


def leaf_value(g: int, h: int, s: Boosting) -> float:
    g, h = g / UNIT, h / UNIT
    return -math.copysign(max(abs(g) - s.l1, 0.0), g) / (h + s.l2) * s.rate if h + s.l2 > 0 else 0.0


def _gains(hist: np.ndarray, s: Boosting) -> np.ndarray:
    """The gain of each split (feature, bin) of a node; -inf where a side is too small."""
    left = hist.cumsum(1)[:, :-1]
    total = hist[0].sum(0)
    right = total - left
    gain = score(left[..., 0], left[..., 1], s) + score(right[..., 0], right[..., 1], s) - score(total[0], total[1], s)
    if s.symmetric:
        return gain
    small = np.minimum(left[..., 2], right[..., 2]) < s.min_rows
    light = np.minimum(left[..., 1], right[..., 1]) < s.min_weight * UNIT
    return np.where(small | light, -np.inf, gain)


class _Leaf:
    def __init__(self, node: int, path: str, sums: np.ndarray, hist: np.ndarray | None = None):
        self.node, self.path, self.sums, self.hist, self.children, self.split = node, path, sums, hist, None, None


class _Growing:
    """A tree between passes: ``request`` names the leaves to sum up, ``accept`` takes their sums."""

    def __init__(self, s: Boosting, features: list[int], number: int):
        self.s, self.features, self.number, self.tree, self.done = s, features, number, Tree(), False
        self.tree.add(0.0, 0)
        self.root: _Leaf | None = None
        self.asked: list[tuple[_Leaf, _Leaf]] = []
        self.open: list[_Leaf] = []
        self.leaves = 1

    def request(self) -> list[int]:
        return [0] if self.root is None else [small.node for small, _ in self.asked]

    def _shaped(self, sums: np.ndarray) -> np.ndarray:
        return sums.reshape(len(self.features), self.s.bins, 3)

    def accept(self, found: dict[int, np.ndarray]) -> None:
        if self.root is None:
            hist = self._shaped(found[0])
            self.root = _Leaf(0, "", hist[0].sum(0), hist)
            self._set(self.root)
            self.open = [self.root]
            self._judged(self.root)
        for small, big in self.asked:
            parent = small.parent
            small.hist = self._shaped(found[small.node])
            big.hist = parent.hist - small.hist
            parent.hist = None
            self._judged(small)
            self._judged(big)
        self.asked = []
        self._grow()

    def _set(self, leaf: _Leaf) -> None:
        self.tree.value[leaf.node], self.tree.cover[leaf.node] = leaf_value(int(leaf.sums[0]), int(leaf.sums[1]), self.s), int(leaf.sums[2])

    def _gains(self, leaf: _Leaf) -> np.ndarray:
        gains = _gains(leaf.hist, self.s)
        if self.s.colsample_level < 1:
            rng = np.random.default_rng([self.s.seed, self.number, len(leaf.path)])
            seen = rng.permutation(len(gains))[: max(1, round(self.s.colsample_level * len(gains)))]
            gains[np.setdiff1d(np.arange(len(gains)), seen)] = -np.inf
        return gains

    def _judged(self, leaf: _Leaf) -> None:
        """The leaf's best split, if it gains anything."""
        gains = self._gains(leaf)
        k = int(gains.argmax())
        f, b = divmod(k, gains.shape[1])
        leaf.split = (float(gains[f, b]), f, b) if gains[f, b] > max(1e-9, 2 * self.s.min_gain) else None

    def _opened(self, leaf: _Leaf, f: int, b: int, gain: float) -> tuple[_Leaf, _Leaf]:
        """Two new leaves, of known sums; the tree routes rows to them from now on."""
        if leaf.children is None:
            left = leaf.hist[f, : b + 1].sum(0)
            made = []
            for side, sums in (("L", left), ("R", leaf.sums - left)):
                child = _Leaf(self.tree.add(0.0, 0), leaf.path + side, sums)
                child.parent = leaf
                self._set(child)
                made.append(child)
            self.tree.split(leaf.node, self.features[f], b, made[0].node, made[1].node, gain)
            leaf.children = tuple(made)
        return leaf.children

    def _ask(self, leaf: _Leaf) -> None:
        a, b = leaf.children
        self.asked.append((a, b) if a.sums[2] <= b.sums[2] else (b, a))

    def _grow(self) -> None:
        """Opens the best leaf as long as it is known what to do with it, and asks for the sums of what may come next."""
        s = self.s
        ready = lambda: sorted((x for x in self.open if x.split), key=lambda x: (-x.split[0], x.path))
        while self.leaves < s.leaves and (order := ready()):
            best = order[0]
            last = self.leaves + 1 == s.leaves or len(best.path) + 1 == s.depth
            if best.children is None and not last:
                break
            gain, f, b = best.split
            children = self._opened(best, f, b, gain)
            self.open.remove(best)
            self.open += children
            self.leaves += 1
        order = ready() if self.leaves < s.leaves else []
        for leaf in order[: min(ASK, s.leaves - self.leaves)]:
            if leaf.children is None and len(leaf.path) + 1 < s.depth:
                gain, f, b = leaf.split
                self._opened(leaf, f, b, gain)
                self._ask(leaf)
        self.done = not self.asked

    def finished(self) -> Tree:
        """The tree without leaves that were summed up but not opened."""
        out, final = Tree(), {x.node for x in self.open}

        def copy(node: int) -> int:
            k = out.add(self.tree.value[node], self.tree.cover[node])
            if node not in final:
                a, b = copy(self.tree.left[node]), copy(self.tree.right[node])
                out.split(k, self.tree.feature[node], self.tree.bin[node], a, b, self.tree.gain[node])
                out.value[k] = 0.0
            return k

        copy(0)
        return out


class _Level(_Growing):
    """An oblivious tree: one split for all leaves of a level, that of the largest gain in sum."""

    def _judged(self, leaf: _Leaf) -> None:
        pass

    def _grow(self) -> None:
        gains = sum(self._gains(leaf) for leaf in self.open)
        f, b = divmod(int(gains.argmax()), gains.shape[1])
        deep = len(self.open[0].path)
        if deep >= self.s.depth or gains[f, b] <= max(1e-9, 2 * self.s.min_gain):
            self.done = True
            return
        level = self.open
        self.open = [c for leaf in level for c in self._opened(leaf, f, b, float(gains[f, b]) / len(level))]
        if deep + 1 == self.s.depth:
            self.done = True
        else:
            for leaf in level:
                self._ask(leaf)


def _features(n: int, s: Boosting, number: int) -> list[int]:
    """The features of a tree."""
    if s.colsample == 1:
        return list(range(n))
    rng = np.random.default_rng([s.seed, number])
    return sorted(rng.permutation(n)[: max(1, round(s.colsample * n))].tolist())


class _Fit:
    """One fold's model while it grows."""

    def __init__(self, model: Model, s: Boosting, uses: list[int], held_out: bool):
        self.model, self.s, self.uses, self.held_out = model, s, uses, held_out
        self.pending, self.growing, self.judge, self.over = [], None, False, False

    def start(self) -> None:
        number = len(self.model.trees)
        features = [self.uses[k] for k in _features(len(self.uses), self.s, number)]
        self.growing = (_Level if self.s.symmetric else _Growing)(self.s, features, number)

    def request(self) -> Request:
        number = len(self.model.trees)
        if self.growing is None and number < self.s.trees:
            self.start()
        wanted = self.growing.request() if self.growing else []
        return Request(self.pending, self.growing.tree if self.growing else Tree(), wanted, self.growing.features if self.growing else [], number, self.judge)

    def accept(self, k: int, found: dict[tuple[int, int], np.ndarray]) -> None:
        if self.judge:
            loss, n = found[k, -1].tolist()
            self.model.losses.append(loss / UNIT / n if n else math.inf)
            self.judge = False
            best = int(np.argmin(self.model.losses)) + 1
            self.model.best = best
            late = self.s.patience is not None and len(self.model.losses) - best >= self.s.patience
            if late or self.growing is None:
                self.over = True
                return
        if self.growing:
            self.growing.accept({node: x for (model, node), x in found.items() if model == k})
            if self.growing.done:
                tree = self.growing.finished()
                self.model.trees.append(tree)
                self.pending.append(tree)
                self.growing, self.judge = None, self.held_out
                self.over = not self.held_out and len(self.model.trees) == self.s.trees


def fit(data: DataFrame, columns: Sequence[str], s: Boosting, n_folds: int = 0, edges: list[list[float]] | None = None, uses: Sequence[Sequence[str]] | None = None) -> list[Model]:
    """A model for each fold, trained on the rows of the others (or one model, on all rows, without folds).

    ``data`` has id, y (0 or 1), fold if there are folds, and the columns; rows without a label are left out. With
    ``patience`` a model keeps the trees up to its best score on the held-out rows. ``uses`` names a model's columns where
    it may not see all of them.
    """
    s.check()
    columns = list(columns)
    n_models = max(1, n_folds)
    known = data.where(F.col("y").isin(0, 1))
    fold = F.col("fold").cast("int") if n_folds else F.lit(-1)
    edges = edges if edges is not None else fit_edges(known, columns, s.bins)
    by_fold = {(r.fold, r.y): r.n for r in known.groupBy(fold.alias("fold"), F.col("y").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    base = []
    for k in range(n_models):
        n1, n0 = (sum(n for (of, y), n in by_fold.items() if of != k and y == label) for label in (1, 0))
        if not n1 or not n0:
            raise ValueError(f"model {k} has rows of one class only")
        base.append(math.log(s.positive_weight * n1 / n0))
    rows = known.select(F.xxhash64("id").alias("h"), F.col("y").cast("int").alias("y"), fold.alias("fold"), *numbered(columns))
    seen = [[columns.index(c) for c in uses[k]] if uses else list(range(len(columns))) for k in range(n_models)]
    fits = [_Fit(Model(columns, edges, b, []), s, seen[k], n_folds > 0) for k, b in enumerate(base)]
    with ExitStack() as old:
        table = old.enter_context(settled(rows.mapInArrow(_table(edges, base, _kind(s.bins)), _ROWS)))
        tasks = table.rdd.getNumPartitions()
        while active := {k: f for k, f in enumerate(fits) if not f.over}:
            if sum(len(f.pending) for f in fits) >= WRITE * len(active):
                fresh = ExitStack()
                moved = fresh.enter_context(settled(table.mapInArrow(_moved({k: f.pending for k, f in enumerate(fits)}, len(columns), n_models, _kind(s.bins)), _ROWS)))
                old.close()
                old.push(fresh.pop_all())
                table, tasks = moved, moved.rdd.getNumPartitions()
                for f in fits:
                    f.pending = []
            found = _summed(table, tasks, {k: f.request() for k, f in active.items()}, len(columns), n_models, s)
            for k, f in active.items():
                f.accept(k, found)
    for f in fits:
        if s.patience is not None and n_folds:
            f.model.trees = f.model.trees[: f.model.best]
    return [f.model for f in fits]


# ---------------------------------------------------------------- scores


def _scored(models: list[Model], kept: Sequence[str]):
    def run(batches):
        for batch in _slices(batches):
            x = binned(batch, models[0].edges)
            p = [1 / (1 + np.exp(-m.margins(x))) for m in models]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, p)], names=[*kept, *(f"p{k}" for k in range(len(models)))])

    return run


def _fold_means(models: list[tuple[list[Model], list[int]]], lines: list[tuple[np.ndarray, np.ndarray, list[int]]], kept: list[str]):
    def run(batches):
        for batch in _slices(batches):
            out = []
            for own, places in models:
                x = binned(batch.select([f"c{k}" for k in places]).rename_columns([f"c{k}" for k in range(len(places))]), own[0].edges)
                out.append(pa.array(sum(1 / (1 + np.exp(-m.margins(x))) for m in own) / len(own)))
            for weights, intercepts, places in lines:
                z = np.tile(intercepts, (batch.num_rows, 1))
                for k, w in zip(places, weights, strict=True):  # column by column: sums don't depend on the batch
                    z += np.asarray(batch.column(f"c{k}").fill_null(math.nan))[:, None] * w
                p = (1 / (1 + np.exp(-z))).mean(1)
                out.append(pa.array(p, mask=np.isnan(p)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out], names=[*kept, *(f"m{k}" for k in range(len(out)))])

    return run


def fold_means(df: DataFrame, models: Mapping[str, Sequence[Model]], keep: Sequence[str], lines: Mapping[str, Sequence[tuple[Mapping[str, float], float]]] | None = None) -> DataFrame:
    """The columns ``keep`` and each model's mean probability over its folds, under the model's name: one pass for all.

    ``lines`` are logistic models: weights by column and an intercept for each fold; a missing value makes their score null.
    """
    lines = lines or {}
    columns = list(dict.fromkeys([*(c for own in models.values() for c in own[0].columns), *(c for own in lines.values() for w, _ in own for c in w)]))
    at = {c: k for k, c in enumerate(columns)}
    for name, own in models.items():
        if any(m.columns != own[0].columns or m.edges != own[0].edges for m in own):
            raise ValueError(f"the folds of {name} don't share columns and edges")
    kept = [f"k{k}" for k in range(len(keep))]
    x = df.select(*(F.col("`" + c.replace("`", "``") + "`").alias(k) for c, k in zip(keep, kept, strict=True)), *numbered(columns))
    schema = T.StructType([*x.schema.fields[: len(kept)], *(T.StructField(f"m{k}", T.DoubleType()) for k in range(len(models) + len(lines)))])
    straight = []
    for own in lines.values():
        names = list(dict.fromkeys(c for w, _ in own for c in w))
        straight.append((np.array([[w.get(c, 0.0) for w, _ in own] for c in names]), np.array([b for _, b in own]), [at[c] for c in names]))
    out = x.mapInArrow(_fold_means([(list(own), [at[c] for c in own[0].columns]) for own in models.values()], straight, kept), schema)
    return out.toDF(*keep, *models, *lines)


def predict(df: DataFrame, models: list[Model], keep: Sequence[str] = ("id",)) -> DataFrame:
    """The columns ``keep`` and ``p0, p1, ...``: each model's probability; the models share columns and edges (those of one fit)."""
    columns = models[0].columns
    if any(m.columns != columns or m.edges != models[0].edges for m in models):
        raise ValueError("the models don't share columns and edges")
    x = df.select(*keep, *numbered(columns))
    schema = T.StructType([*x.schema.fields[: len(keep)], *(T.StructField(f"p{k}", T.DoubleType()) for k in range(len(models)))])
    return x.mapInArrow(_scored(models, keep), schema)


def out_of_fold(data: DataFrame, models: list[Model]) -> DataFrame:
    """``id, fold, y, p``: each row's score by the model that held it out."""
    scored = predict(data, models, ("id", "fold", "y"))
    p = F.element_at(F.array(*(f"p{k}" for k in range(len(models)))), F.col("fold").cast("int") + 1)
    return scored.select("id", "fold", "y", p.alias("p"))
