"""Boosted trees over a binned matrix: one booster for all classes, grown depth-wise or best leaf first.

The training table is binned once, by quantiles of each feature, into blocks of up to ``BLOCK_ROWS`` rows that stay on the
executors. One pass over the blocks sums gradient and hessian histograms of every open node of every class tree, of
all boosters that are fitted together; tasks fold their blocks, Spark folds the tasks, and only the folded
histograms (nodes x features x bins, whatever the number of rows) reach the driver, which picks the splits. Of two
sibling nodes the lighter one is summed, the other is the parent less it. A node's children are counted one pass
ahead of their turn, so best-first growth needs about as many passes as the tree has levels.

Rows keep no state between passes that could be lost: the scores follow from the trees. A Python worker remembers the
scores of blocks it has met and goes on from there; after the loss of an executor they are computed again.
"""

from __future__ import annotations

import base64
import heapq
import json
import math
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from emberfield.session import materialize

BLOCK_ROWS = 16_384
#: Rows up to which a matrix is fitted inside one task per booster (a few MB of bins).
TASK_ROWS = 200_000
#: Bytes of scores that a Python worker remembers.
MEMORY = 256 << 20
#: Finished rounds that travel as one broadcast.
CHUNK = 20
#: Tasks whose histograms the driver adds by itself; above, Spark folds them first.
DIRECT_TASKS = 16


@dataclass(frozen=True)
class Settings:
    """How a booster grows its trees."""

    rounds: int = 300
    rate: float = 0.08
    depth: int | None = 6
    leaves: int | None = None
    l2: float = 1.0
    least_hessian: float = 1.0
    least_rows: int = 1
    row_share: float = 1.0
    column_share: float = 1.0
    #: The factor of p(1 - p) in the hessian of a class score.
    curvature: float = 2.0
    #: Start from the log shares of the classes instead of 0.
    prior: bool = False
    #: Stop when the loss of a held-out tenth has not improved for ``patience`` rounds, on more than ``stop_above`` rows.
    patience: int = 10
    stop_above: int | None = None
    tolerance: float = 1e-7
    seed: int = 42


#: The published definitions of the two boosters.
SOFTPROB = Settings(row_share=0.9, column_share=0.9)
LEAF_WISE = Settings(
    depth=None, leaves=31, l2=0.0, least_hessian=1e-3, least_rows=20, curvature=1.0, prior=True, stop_above=10_000
)


# -- binned matrix ---------------------------------------------------------------------------------------------


@dataclass
class Matrix:
    """Blocks on the executors, and what the driver knows about them."""

    blocks: DataFrame
    names: list[str]
    cuts: list[np.ndarray]
    rows: int
    classes: int
    shares: np.ndarray
    tasks: int

    @property
    def bins(self) -> int:
        """Bins that any feature has."""
        return max(len(c) for c in self.cuts) + 1

    def release(self) -> None:
        self.blocks.unpersist()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) per key, the same in every pass."""
    return (_mixed(keys ^ np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)) >> np.uint64(11)) * 2.0**-53


_BLOCK = "block string, n int, codes binary, label binary, weight binary, key binary"


def binned(table: DataFrame, names: list[str], classes: int, bins: int = 256) -> Matrix:
    """Bin the columns ``names`` of a table with ``label``, ``weight`` and ``key`` (a long that spreads well).

    Up to ``bins - 1`` cut points per feature: the distinct values where there are few, else quantiles. A value
    belongs to the bin of the first cut that is not below it; missing values go to the first bin.
    """
    shares = [i / bins for i in range(1, bins)]
    stats = table.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.percentile_approx(n, shares, 10_000).alias(f"q{i}") for i, n in enumerate(names)],
        *[F.sum(F.when(F.col("label") == c, F.col("weight")).otherwise(F.lit(0.0))).alias(f"w{c}") for c in range(classes)],
    ).first()
    cuts = [np.unique(np.array(stats[f"q{i}"] or [0.0], np.float64)) for i in range(len(names))]
    weights = np.array([stats[f"w{c}"] or 0.0 for c in range(classes)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = BLOCK_ROWS - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == BLOCK_ROWS:
                    yield made(held)
                    held = []
        if held:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held)
        codes = np.empty((len(names), part.num_rows), np.uint8)
        for i, name in enumerate(names):
            values = part.column(name).to_numpy()
            codes[i] = np.where(np.isnan(values), 0, np.searchsorted(cuts[i], values))
        columns = [
            codes.tobytes(),
            part.column("label").to_numpy().astype(np.int8).tobytes(),
            part.column("weight").to_numpy().astype(np.float64).tobytes(),
            part.column("key").to_numpy().astype(np.int64).tobytes(),
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([part.num_rows], pa.int32()), *[pa.array([c], pa.binary()) for c in columns]],
            ["block", "n", "codes", "label", "weight", "key"],
        )

    rows = table.select(*[F.col(n).cast("double").alias(n) for n in names], "label", "weight", "key").where("label is not null")
    # Evenly dealt, so that no task has more than its share of blocks.
    tasks = max(1, min(math.ceil(stats["rows"] / BLOCK_ROWS), max(table.sparkSession.sparkContext.defaultParallelism, stats["rows"] // (64 * BLOCK_ROWS))))
    dealt = rows.repartition(tasks, "key") if stats["rows"] else rows
    blocks = materialize(dealt.mapInArrow(pack, _BLOCK), "binned").repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    blocks.count()
    total = weights.sum() or 1.0
    return Matrix(blocks, list(names), cuts, stats["rows"], classes, weights / total, tasks)


# -- trees ------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes as arrays: feature (-1 at leaves), last bin that goes left, left child (right is next), value, gain."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int, gain: float) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, bin, first, gain
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.value, 0.0), (self.gain, 0.0)):
            column += [empty, empty]
        return first, first + 1

    @property
    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return (
            np.array(self.feature, np.int16), np.array(self.bin, np.uint8), np.array(self.left, np.int16), np.array(self.value, np.float64)
        )


def _walked(tree: tuple[np.ndarray, ...], codes: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
    """The node in which each row of binned codes (features x rows) ends, from the root or from given nodes on."""
    feature, last, left, _ = tree
    if node is None:
        node = np.zeros(codes.shape[1], np.int16)
    at = np.flatnonzero(feature[node] >= 0)
    while len(at):
        own = node[at]
        own = left[own] + (codes[feature[own], at] > last[own])
        node[at] = own
        at = at[feature[own] >= 0]
    return node


@dataclass
class _Booster:
    """One booster that is being fitted."""

    settings: Settings
    columns: np.ndarray
    start: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    done: bool = False
    # The round that grows: a tree, its open histograms and split candidates per class.
    growing: list[_Growth] = field(default_factory=list)

    @property
    def held_out(self) -> bool:
        return self.settings.stop_above is not None


class _Growth:
    """One class tree in the round that grows: which nodes are known, and what must be counted next."""

    def __init__(self, settings: Settings, columns: np.ndarray):
        self.settings, self.columns = settings, columns
        self.tree = Tree()
        self.sums: dict[int, np.ndarray] = {}
        self.best: dict[int, tuple[float, int, int]] = {}
        self.depth = {0: 0}
        self.wanted: list[int] = [0]
        self.parent: dict[int, tuple[int, int]] = {}

    def take(self, histograms: dict[int, np.ndarray]) -> None:
        """Fold in counted nodes, derive their siblings, find the best splits and open the next nodes."""
        for node, sums in histograms.items():
            self.sums[node] = sums
            if node in self.parent:
                above, sibling = self.parent[node]
                self.sums[sibling] = self.sums[above] - sums
        for node in [n for n in self.sums if n not in self.best]:
            self.best[node] = self._split(self.sums[node])
        self._grow()

    def _split(self, sums: np.ndarray) -> tuple[float, int, int]:
        """Gain, feature and last left bin of the best split of a node (gain 0: none)."""
        s = self.settings
        _, hessian, rows = sums[:, 0].sum(axis=1)
        if hessian < 2 * s.least_hessian or (s.least_rows > 1 and rows < 2 * s.least_rows):
            return 0.0, -1, 0
        g, h = np.cumsum(sums[:2], axis=2)
        gt, ht = g[:1, -1:], h[:1, -1:]
        allowed = (h >= s.least_hessian) & (ht - h >= s.least_hessian)
        if s.least_rows > 1:
            c = np.cumsum(sums[2], axis=1)
            allowed &= (c >= s.least_rows) & (c[:1, -1:] - c >= s.least_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g**2 / (h + s.l2) + (gt - g) ** 2 / (ht - h + s.l2) - gt**2 / (ht + s.l2)
        gain = np.where(allowed & np.isfinite(gain), gain, 0.0)
        at = int(gain.argmax())
        feature, bin = divmod(at, gain.shape[1])
        best = float(gain.flat[at])
        return (best, feature, bin) if best > 1e-10 else (0.0, -1, 0)

    def _grow(self) -> None:
        """Replay best-first growth as far as nodes are known; ask for the children it needs.

        Depth-wise growth is the same without a limit of leaves. Nodes keep their numbers from pass to pass.
        """
        s, tree = self.settings, self.tree
        leaves, queue = 1, [(-self.best[0][0], 0)]
        self.wanted, self.kept = [], set()
        while queue and (s.leaves is None or leaves < s.leaves):
            gain, node = heapq.heappop(queue)
            if gain >= 0 or (s.depth is not None and self.depth[node] >= s.depth):
                continue
            if tree.feature[node] < 0:
                _, feature, bin = self.best[node]
                children = tree.split(node, int(self.columns[feature]), bin, -gain)
                for child in children:
                    self.depth[child] = self.depth[node] + 1
                weights = self.sums[node][1, feature]
                light = weights[: bin + 1].sum() <= weights[bin + 1 :].sum()
                counted, derived = children if light else children[::-1]
                self.parent[counted] = (node, derived)
            leaves += 1
            self.kept.add(node)
            left = tree.left[node]
            last = s.depth is not None and self.depth[left] >= s.depth
            for child in (left, left + 1):
                if child in self.best:
                    heapq.heappush(queue, (-self.best[child][0], child))
            # Children at the last level need sums for their values, not splits; they are counted all the same.
            if left not in self.best and not (last and self._known(node)):
                self.wanted.append(left if left in self.parent else left + 1)

    def _known(self, node: int) -> bool:
        """Value both children of a last-level split from the parent's histogram."""
        tree = self.tree
        feature = int(np.flatnonzero(self.columns == tree.feature[node])[0])
        sums, bin, left = self.sums[node][:, feature], tree.bin[node], tree.left[node]
        for child, part in ((left, sums[:, : bin + 1]), (left + 1, sums[:, bin + 1 :])):
            self.sums[child] = part.sum(axis=1)[:, None, None]
            self.best[child] = (0.0, -1, 0)
        return True

    def finished(self) -> tuple[Tree, np.ndarray]:
        """The tree with the splits that growth kept and leaf values, and the value of every grown node."""
        s, old, new = self.settings, self.tree, Tree()
        values = np.zeros(len(old.feature))
        todo = [(0, 0)]
        while todo:
            node, own = todo.pop()
            if node in self.kept:
                pair = new.split(own, old.feature[node], old.bin[node], old.gain[node])
                todo += [(old.left[node], pair[0]), (old.left[node] + 1, pair[1])]
            else:
                g, h, _ = self.sums[node][:, 0].sum(axis=1)
                new.value[own] = float(-s.rate * g / (h + s.l2)) if h + s.l2 > 0 else 0.0
                below = [node]
                while below:
                    one = below.pop()
                    values[one] = new.value[own]
                    if old.feature[one] >= 0:
                        below += [old.left[one], old.left[one] + 1]
        return new, values


# -- passes -----------------------------------------------------------------------------------------------------

#: Scores of blocks in this Python worker: (fit, block) to (rounds, scores per booster).
_SCORES: OrderedDict[tuple[str, str], list] = OrderedDict()


def _round(booster: dict, number: int) -> list[tuple]:
    """The trees of a finished round: older ones come from broadcasts, which are read only when asked for."""
    chunk, at = divmod(number, CHUNK)
    trees = booster["old"][chunk].value if chunk < len(booster["old"]) else booster["trees"]
    return trees[at]


def _remembered(fit: str, block: str, boosters: list, codes: np.ndarray) -> list[np.ndarray]:
    """Scores (classes x rows) of a block after all finished rounds, from the last remembered ones."""
    held = _SCORES.pop((fit, block), None) or [[0, None] for _ in boosters]
    for entry, booster in zip(held, boosters):
        if entry[1] is None:
            entry[1] = np.repeat(booster["start"][:, None], codes.shape[1], axis=1)
        while entry[0] < booster["rounds"]:
            for k, tree in enumerate(_round(booster, entry[0])):
                entry[1][k] += tree[3][_walked(tree, codes)]
            entry[0] += 1
    _SCORES[fit, block] = held
    size = sum(e[1].nbytes for v in _SCORES.values() for e in v)
    while size > MEMORY and len(_SCORES) > 1:
        _, old = _SCORES.popitem(last=False)
        size -= sum(e[1].nbytes for e in old)
    return [e[1] for e in held]


def _probabilities(scores: np.ndarray) -> np.ndarray:
    if len(scores) == 1:
        return 1.0 / (1.0 + np.exp(-scores))
    e = np.exp(scores - scores.max(axis=0))
    return e / e.sum(axis=0)


def _histogram(codes: np.ndarray, columns: np.ndarray, slots: np.ndarray, n: int, g: np.ndarray, h: np.ndarray, counted: bool, bins: int) -> np.ndarray:
    """Sums of gradients, hessians and rows by (slot, sum, column, bin); rows with slot -1 are left out.

    Rows are only counted where the settings ask for a least number of them.
    """
    at = np.flatnonzero(slots >= 0)
    base, g, h = slots[at] * bins, g[at], h[at]
    out = np.zeros((n, 3, len(columns), bins))
    for i, column in enumerate(columns):
        index = base + codes[column][at]
        out[:, 0, i] = np.bincount(index, g, n * bins).reshape(n, bins)
        out[:, 1, i] = np.bincount(index, h, n * bins).reshape(n, bins)
        if counted:
            out[:, 2, i] = np.bincount(index, minlength=n * bins).reshape(n, bins)
    return out


def _unpack(block: dict) -> dict:
    """A block as arrays: codes (features x rows), label, weight, key."""
    n = block["n"]
    return {
        "codes": np.frombuffer(block["codes"], np.uint8).reshape(-1, n),
        "label": np.frombuffer(block["label"], np.int8),
        "weight": np.frombuffer(block["weight"], np.float64),
        "key": np.frombuffer(block["key"], np.uint64),
    }


def _pass(tasks: dict, block: dict, scores: Callable[[int], np.ndarray], nodes: Callable[[int, int, tuple], np.ndarray]) -> dict:
    """Histograms of the asked nodes and held-out losses of one block.

    ``scores`` gives a booster's scores after all finished rounds, ``nodes`` the node of each row in a growing tree.
    """
    codes, label, weight, key = (block[c] for c in ("codes", "label", "weight", "key"))
    out = {}
    for b, booster in enumerate(tasks["boosters"]):
        if not booster["ask"] and not booster["loss"]:
            continue
        p = _probabilities(scores(b))
        kept = np.ones(len(label), bool)
        if booster["held_out"]:
            out_row = _uniform(key, booster["seed"] + 1) < 0.1
            kept = ~out_row
            if booster["loss"]:
                own = p[label, np.arange(len(label))] if len(p) > 1 else np.where(label == 1, p[0], 1 - p[0])
                w = weight[out_row]
                out[b, -1, 0] = np.array([-(w * np.log(np.maximum(own[out_row], 1e-15))).sum(), w.sum()])
        if booster["row_share"] < 1:
            kept = kept & (_uniform(key, booster["seed"] + 7919 * (booster["rounds"] + 1)) < booster["row_share"])
        for k, tree, columns, asked in booster["ask"]:
            lookup = np.full(len(tree[0]), -1, np.int64)
            lookup[asked] = np.arange(len(asked))
            slots = np.where(kept, lookup[nodes(b, k, tree)], -1)
            target = label == k if len(p) > 1 else label == 1
            g = weight * (p[k] - target)
            h = np.maximum(booster["curvature"] * weight * p[k] * (1 - p[k]), 1e-16)
            sums = _histogram(codes, columns, slots, len(asked), g, h, booster["counted"], booster["bins"])
            for node, one in zip(asked, sums):
                out[b, k, node] = one
    return out


_SUMS = "booster int, k int, node int, sums binary"


def _run(matrix: Matrix, fit: str, tasks: dict) -> dict[tuple, np.ndarray]:
    """One pass over all blocks: folded sums by (booster, class, node)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for block in batch.to_pylist():
                arrays = _unpack(block)
                codes = arrays["codes"]
                held = _remembered(fit, block["block"], tasks["boosters"], codes)
                found = _pass(tasks, arrays, held.__getitem__, lambda b, k, tree, codes=codes: _walked(tree, codes))
                for at, one in found.items():
                    folded[at] = folded[at] + one if at in folded else one
        if folded:
            keys = np.array(list(folded), np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(keys[:, i]) for i in range(3)], pa.array([x.tobytes() for x in folded.values()], pa.binary())],
                ["booster", "k", "node", "sums"],
            )

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s) for s in group["sums"]], axis=0)
        return group.iloc[:1].assign(sums=[total.tobytes()])

    found = matrix.blocks.mapInArrow(sums, _SUMS)
    if matrix.tasks > DIRECT_TASKS:
        found = found.groupBy("booster", "k", "node").applyInPandas(added, _SUMS)
    out: dict[tuple, np.ndarray] = {}
    for row in found.collect():
        at, one = (row["booster"], row["k"], row["node"]), np.frombuffer(row["sums"])
        out[at] = out[at] + one if at in out else one
    return out


def _start(settings: Settings, matrix: Matrix) -> np.ndarray:
    scores = matrix.classes if matrix.classes > 2 else 1
    if not settings.prior:
        return np.zeros(scores)
    shares = np.clip(matrix.shares, 1e-15, 1)
    if scores == 1:
        return np.array([math.log(shares[1] / shares[0])])
    logs = np.log(shares)
    return logs - logs.mean()


def _stalled(losses: list[float], settings: Settings) -> bool:
    """Whether none of the last ``patience`` losses is better than the one before them."""
    if len(losses) <= settings.patience:
        return False
    reference = losses[-settings.patience - 1]
    return not any(x < reference - settings.tolerance for x in losses[-settings.patience :])


class _Blocks:
    """Passes by Spark: one job per pass over the blocks."""

    def __init__(self, matrix: Matrix, boosters: list[_Booster]):
        self.matrix, self.name = matrix, uuid.uuid4().hex
        self.context = matrix.blocks.sparkSession.sparkContext
        self.old: list[list] = [[] for _ in boosters]
        self.recent: list[list] = [[] for _ in boosters]

    def run(self, tasks: dict) -> dict:
        for i, booster in enumerate(tasks["boosters"]):
            booster.update(trees=self.recent[i], old=self.old[i])
        return _run(self.matrix, self.name, tasks)

    def add(self, i: int, growing: list[_Growth], grown: list[tuple[Tree, np.ndarray]]) -> None:
        self.recent[i].append([tree.packed() for tree, _ in grown])
        if len(self.recent[i]) == CHUNK:
            self.old[i].append(self.context.broadcast(self.recent[i]))
            self.recent[i] = []


class _InTask:
    """Passes inside one task that holds a small matrix: scores and nodes stay between passes."""

    def __init__(self, block: dict, boosters: list[_Booster]):
        self.block = block
        rows = block["codes"].shape[1]
        self.scores = [np.repeat(b.start[:, None], rows, axis=1) for b in boosters]
        self.nodes: dict[tuple[int, int], np.ndarray] = {}

    def _node(self, b: int, k: int, tree: tuple) -> np.ndarray:
        self.nodes[b, k] = _walked(tree, self.block["codes"], self.nodes.get((b, k)))
        return self.nodes[b, k]

    def run(self, tasks: dict) -> dict:
        return _pass(tasks, self.block, self.scores.__getitem__, self._node)

    def add(self, i: int, growing: list[_Growth], grown: list[tuple[Tree, np.ndarray]]) -> None:
        for k, (growth, (_, values)) in enumerate(zip(growing, grown)):
            # The last level of a grown tree may not have been walked yet.
            node = _walked(growth.tree.packed(), self.block["codes"], self.nodes.pop((i, k), None))
            self.scores[i][k] += values[node]


def _fitted(boosters: list[_Booster], bins: int, passes: _Blocks | _InTask) -> None:
    """Grow all boosters together, pass by pass."""
    while not all(b.done for b in boosters):
        asks_loss = []
        for b in boosters:
            b.growing = [] if b.done else [_Growth(b.settings, _columns(b, len(b.trees), k)) for k in range(len(b.start))]
            asks_loss.append(b.held_out and not b.done)
        while any(g.wanted for b in boosters for g in b.growing) or any(asks_loss):
            tasks = {
                "boosters": [
                    {
                        "start": b.start, "rounds": len(b.trees), "held_out": b.held_out, "loss": asks_loss[i], "seed": b.settings.seed,
                        "row_share": b.settings.row_share, "curvature": b.settings.curvature, "bins": bins, "counted": b.settings.least_rows > 1,
                        "ask": [(k, g.tree.packed(), g.columns, np.array(g.wanted)) for k, g in enumerate(b.growing) if g.wanted],
                    }
                    for i, b in enumerate(boosters)
                ]
            }
            sums = passes.run(tasks)
            for i, b in enumerate(boosters):
                if asks_loss[i]:
                    loss, weight = sums.pop((i, -1, 0), np.array([0.0, 0.0]))
                    b.losses.append(loss / weight if weight else 0.0)
                    asks_loss[i] = False
                for k, g in enumerate(b.growing):
                    shape = (3, len(g.columns), bins)
                    if g.wanted:
                        g.take({n: sums[i, k, n].reshape(shape) if (i, k, n) in sums else np.zeros(shape) for n in g.wanted})
        for i, b in enumerate(boosters):
            if b.done:
                continue
            if b.held_out and _stalled(b.losses, b.settings):
                b.done = True
                continue
            grown = [g.finished() for g in b.growing]
            b.trees.append([tree for tree, _ in grown])
            passes.add(i, b.growing, grown)
            b.done = len(b.trees) >= b.settings.rounds
            b.growing = []


_MODEL = "booster int, model string"


def _fitted_in_tasks(matrix: Matrix, boosters: list[_Booster]) -> list[str]:
    """Every booster in a task of its own, for a matrix of at most ``TASK_ROWS`` rows."""
    names, cuts, bins = matrix.names, matrix.cuts, matrix.bins

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["booster"], []).append(row)
        for i, rows in held.items():
            # Sorted, so that sums are added in one order.
            parts = [_unpack(r) for r in sorted(rows, key=lambda r: r["block"])]
            block = {c: np.ascontiguousarray(np.concatenate([p[c] for p in parts], axis=-1)) for c in parts[0]}
            _fitted([boosters[i]], bins, _InTask(block, [boosters[i]]))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_text(boosters[i], names, cuts)])], ["booster", "model"])

    each = matrix.blocks.withColumn("booster", F.explode(F.sequence(F.lit(0), F.lit(len(boosters) - 1))))
    dealt = each.repartitionByRange(len(boosters), "booster")
    found = {r["booster"]: r["model"] for r in dealt.mapInArrow(grow, _MODEL).collect()}
    # Without rows a model is its start.
    return [found.get(i) or _text(b, names, cuts) for i, b in enumerate(boosters)]


def fit(matrix: Matrix, wanted: list[tuple[Settings, list[str]]], task_rows: int | None = None) -> list[BoostedTrees]:
    """Fit boosters with their settings and features on one matrix.

    Larger matrices are fitted together, on the same passes over the blocks. A matrix of at most ``task_rows`` (``TASK_ROWS``)
    rows fits in one task, where a pass takes less time than starting a job: each booster then has a task. The trees are the same.
    """
    boosters = []
    for settings, names in wanted:
        if settings.stop_above is not None and matrix.rows <= settings.stop_above:
            settings = replace(settings, stop_above=None)
        columns = np.array([matrix.names.index(n) for n in names])
        boosters.append(_Booster(settings, columns, _start(settings, matrix)))
    if matrix.rows <= (TASK_ROWS if task_rows is None else task_rows):
        return [BoostedTrees(trees=t) for t in _fitted_in_tasks(matrix, boosters)]
    _fitted(boosters, matrix.bins, _Blocks(matrix, boosters))
    return [BoostedTrees(trees=_text(b, matrix.names, matrix.cuts)) for b in boosters]


def _columns(booster: _Booster, round_: int, k: int) -> np.ndarray:
    """The features that a tree may use."""
    share, columns = booster.settings.column_share, booster.columns
    if share >= 1:
        return columns
    count = max(1, int(share * len(columns)))
    keys = np.arange(len(columns), dtype=np.uint64) + np.uint64((round_ * 64 + k + 1) << 20)
    return np.sort(columns[np.argsort(_uniform(keys, booster.settings.seed))[:count]])


# -- model ------------------------------------------------------------------------------------------------------


def _text(booster: _Booster, names: list[str], cuts: list[np.ndarray]) -> str:
    """A fitted booster as text: thresholds in place of bins, features by their place in the booster's list."""
    place = {int(c): i for i, c in enumerate(booster.columns)}
    flat = [t for trees in booster.trees for t in trees]
    feature, threshold, left, value, gain = [], [], [], [], []
    for t in flat:
        feature += [place[f] if f >= 0 else -1 for f in t.feature]
        threshold += [float(cuts[f][b]) if f >= 0 and b < len(cuts[f]) else math.inf for f, b in zip(t.feature, t.bin)]
        left, value, gain = left + t.left, value + t.value, gain + t.gain
    parts = {
        "sizes": np.array([len(t.feature) for t in flat], np.int32), "feature": np.array(feature, np.int16),
        "threshold": np.array(threshold, np.float64), "left": np.array(left, np.int16), "value": np.array(value, np.float64),
        "gain": np.array(gain, np.float64), "start": booster.start,
    }
    return json.dumps({k: [str(v.dtype), base64.b64encode(v.tobytes()).decode()] for k, v in parts.items()} | {"width": len(booster.columns)})


def _unpacked(text: str) -> dict:
    return {k: np.frombuffer(base64.b64decode(v[1]), v[0]) if isinstance(v, list) else v for k, v in json.loads(text).items()}


def _scored(model: dict, x: np.ndarray) -> np.ndarray:
    """Class scores (classes x rows) of raw features (rows x features); NaN goes with the first bin."""
    x = np.where(np.isnan(x), -np.inf, x)
    k = len(model["start"])
    scores = np.repeat(model["start"][:, None], len(x), axis=1)
    rows = np.arange(len(x))
    first = 0
    for i, size in enumerate(model["sizes"]):
        feature, threshold, left, value = (model[c][first : first + size] for c in ("feature", "threshold", "left", "value"))
        first += size
        node = np.zeros(len(x), np.int16)
        active = rows if feature[0] >= 0 else rows[:0]
        while len(active):
            own = node[active]
            node[active] = left[own] + (x[active, feature[own]] > threshold[own])
            active = active[feature[node[active]] >= 0]
        scores[i % k] += value[node]
    return scores


class BoostedTrees(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted boosted trees: adds ``probability`` (a vector, one element per class) and ``prediction``."""

    trees = Param(Params._dummy(), "trees", "the trees and their thresholds as text", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees: str | None = None):
        super().__init__()
        if trees is not None:
            self._set(trees=trees)

    @property
    def rounds(self) -> int:
        model = _unpacked(self.getOrDefault("trees"))
        return len(model["sizes"]) // len(model["start"])

    @property
    def leaf_counts(self) -> list[int]:
        """Leaves of every tree."""
        model = _unpacked(self.getOrDefault("trees"))
        ends = np.cumsum(model["sizes"])
        return [int((model["feature"][e - s : e] < 0).sum()) for s, e in zip(model["sizes"], ends)]

    @property
    def featureImportances(self):
        """Mean gain of a feature's splits, scaled to sum to 1."""
        model = _unpacked(self.getOrDefault("trees"))
        inner = model["feature"] >= 0
        gains = np.bincount(model["feature"][inner], model["gain"][inner], model["width"])
        mean = gains / np.maximum(np.bincount(model["feature"][inner], minlength=model["width"]), 1)
        return Vectors.dense(mean / mean.sum() if mean.sum() else mean)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = self.getOrDefault("trees")
        held: dict = {}

        @F.pandas_udf("array<double>")
        def probabilities(features: pd.Series) -> pd.Series:
            if not held:
                held.update(_unpacked(text))
            p = _probabilities(_scored(held, np.stack(features.to_numpy())))
            p = np.vstack([1 - p, p]) if len(p) == 1 else p
            return pd.Series(list(p.T))

        rows = dataset.withColumn("probability", array_to_vector(probabilities(vector_to_array("features"))))
        best = vector_to_array("probability")
        return rows.withColumn("prediction", (F.array_position(best, F.array_max(best)) - F.lit(1)).cast("double"))
