"""Boosted trees by second-order histograms, over a binned matrix that stays on the executors.

Each level of a tree is one job. Tasks read batches of bins, follow the tree so far, and sum gradients and hessians by node, feature and
bin; the sums of all tasks meet by node and feature, where the best split is found, with a learnt direction for missing values; the driver sees one
split a node. Margins of the trees before are a column that is brought up to date every ``STORE`` trees; those since are added on the way.
Boosting ends after ``rounds`` trees, or when the weighted average precision of the validation rows has not risen for ``stop`` trees; the best
number of trees is kept. Rows and features of a tree are drawn by a hash, the same at every run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.metrics import average_precision
from tidemark.operators.sampling import mix
from tidemark.sources.binned import MISSING, binned, cuts_of, matrix_of
from tidemark.sources.scratch import stored
from tidemark.sources.tables import read_settings, write_settings

#: Trees after which the stored margins are brought up to date.
STORE = 20


@dataclass
class Settings:
    rounds: int = 600
    depth: int = 8
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    least_weight: float = 1.0
    gamma: float = 0.0
    alpha: float = 0.0
    l2: float = 1.0
    stop: int = 50
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number: 0 is the root, children of k are 2k + 1 and 2k + 2. A row goes left if its bin is at most the node's, or where missing values go."""

    feature: dict[int, int] = field(default_factory=dict)
    bin: dict[int, int] = field(default_factory=dict)
    missing_left: dict[int, bool] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        at = np.zeros(len(bins), np.int64)
        size = max([0, *self.value, *(2 * k + 2 for k in self.feature)]) + 1
        feature, cut, left = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool)
        for k, f in self.feature.items():
            feature[k], cut[k], left[k] = f, self.bin[k], self.missing_left[k]
        live = np.arange(len(bins))
        while len(live := live[feature[at[live]] >= 0]):
            k = at[live]
            code = bins[live, feature[k]]
            goes_left = np.where(code == MISSING, left[k], code <= cut[k])
            at[live] = 2 * k + np.where(goes_left, 1, 2)
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        values = np.zeros(max(self.value) + 1)
        values[list(self.value)] = list(self.value.values())
        return values[self.nodes(bins)]


@dataclass
class Booster:
    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree]

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees[first:]:
            out += tree.margins(bins)
        return out


def _chosen(ids: np.ndarray, share: float, seed: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 2**64 - 1)) >> np.uint64(11)).astype(float) / 2.0**53 < share


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def gain_of(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return _shrunk(g, s.alpha) ** 2 / (h + s.l2)


def best_split(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[float, int, bool]:
    """Gain, bin and missing direction of a node's best split by one feature, from its sums of gradients and hessians by bin (missing last)."""
    total_g, total_h = g.sum(), h.sum()
    best = (0.0, -1, True)
    for left in (True, False):
        gl, hl = np.cumsum(g[:-1])[:-1] + (g[-1] if left else 0.0), np.cumsum(h[:-1])[:-1] + (h[-1] if left else 0.0)
        gr, hr = total_g - gl, total_h - hl
        gains = 0.5 * (gain_of(gl, hl, s) + gain_of(gr, hr, s) - gain_of(total_g, total_h, s)) - s.gamma
        gains[(hl < s.least_weight) | (hr < s.least_weight)] = -np.inf
        at = int(np.argmax(gains))
        if gains[at] > best[0]:
            best = (float(gains[at]), at, left)
    return best


def _gradients(margin: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return weight * (p - target), weight * np.maximum(p * (1 - p), 1e-16)


def _level(rows: DataFrame, recent: list[Tree], tree: Tree, open_nodes: list[int], columns: list[int], features: int, round_: int, s: Settings) -> list:
    """Best split and sums of each open node: node, g, h, gain, feature, bin, left."""
    shared = rows.sparkSession.sparkContext.broadcast((recent, tree))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now = shared.value
        place = {k: i for i, k in enumerate(open_nodes)}
        total = np.zeros((2, len(open_nodes), len(columns), 256))
        for batch in batches:
            bins = matrix_of(batch, features)
            chosen = _chosen(batch.column("row").to_numpy(), s.rows, s.seed + round_)
            at = now.nodes(bins)
            slot = np.full(int(max(at.max(initial=0), *open_nodes)) + 1, -1)
            slot[open_nodes] = [place[k] for k in open_nodes]
            take = np.flatnonzero(chosen & (slot[at] >= 0))
            bins, node = bins[take], slot[at[take]]
            margin = batch.column("margin").to_numpy()[take] + sum(t.margins(bins) for t in before)
            both = _gradients(margin, batch.column("target").to_numpy()[take].astype(float), batch.column("sample_weight").to_numpy()[take].astype(float))
            for j, c in enumerate(columns):
                key = node * 256 + bins[:, c]
                for k in (0, 1):
                    total[k, :, j] += np.bincount(key, both[k], len(open_nodes) * 256).reshape(-1, 256)
        seen = [(i, j) for i in range(len(open_nodes)) if total[1, i].any() for j in range(len(columns))]
        out = [[open_nodes[i] for i, _ in seen], [columns[j] for _, j in seen], *[[total[k, i, j].tobytes() for i, j in seen] for k in (0, 1)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["node", "feature", "g", "h"])

    def split(table: pa.Table) -> pa.Table:
        g, h = (sum(np.frombuffer(x, float) for x in table.column(c).to_pylist()) for c in ("g", "h"))
        gain, at, left = best_split(g, h, s)
        return pa.table({"node": [table["node"][0].as_py()], "feature": [table["feature"][0].as_py()], "g": [g.sum()], "h": [h.sum()], "gain": [gain], "bin": [at], "left": [left]})

    each = rows.where("NOT validation").select("row", "target", "sample_weight", "margin", "bins").mapInArrow(sums, "node long, feature long, g binary, h binary")
    found = each.groupBy("node", "feature").applyInArrow(split, "node long, feature long, g double, h double, gain double, bin long, left boolean")
    order = F.struct("gain", -F.col("feature"))  # of equal gains the first feature
    return found.groupBy("node").agg(F.max_by(F.struct("g", "h", "gain", "feature", "bin", "left"), order).alias("best")).select("node", "best.*").collect()


def with_margins(rows: DataFrame, trees: list[Tree], features: int) -> DataFrame:
    """The rows with the trees added to their margin."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = matrix_of(batch, features)
            margin = batch.column("margin").to_numpy() + sum(t.margins(bins) for t in shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(margin) if n == "margin" else batch.column(n) for n in names], names=names)

    return rows.mapInArrow(run, rows.schema)


def _grow(rows: DataFrame, recent: list[Tree], features: int, round_: int, s: Settings) -> Tree:
    r = np.random.default_rng([s.seed, round_])
    columns = sorted(r.choice(features, max(1, round(s.columns * features)), replace=False).tolist())
    tree, open_nodes = Tree(), [0]
    for depth in range(s.depth + 1):
        found = _level(rows, recent, tree, open_nodes, columns if depth < s.depth else columns[:1], features, round_, s)
        open_nodes = []
        for n in found:
            if depth < s.depth and n.bin >= 0:
                tree.feature[n.node], tree.bin[n.node], tree.missing_left[n.node] = n.feature, n.bin, n.left
                open_nodes += [2 * n.node + 1, 2 * n.node + 2]
            else:
                tree.value[n.node] = float(-s.rate * _shrunk(np.float64(n.g), s.alpha) / (n.h + s.l2))
        if not open_nodes:
            break
    for k in [c for n in tree.feature for c in (2 * n + 1, 2 * n + 2) if c not in tree.feature]:
        tree.value.setdefault(k, 0.0)  # no drawn row came here
    tree.value.setdefault(0, 0.0)
    return tree


def train(df: DataFrame, features: list[str], settings: Settings | None = None) -> Booster:
    """Fits on the rows without ``validation``; columns target (0 or 1), sample_weight, validation and the features. Without validation rows all rounds are run."""
    s = settings or Settings()
    cuts = cuts_of(df.where("NOT validation"), features)
    ready = df.select(F.monotonically_increasing_id().alias("row"), F.col("target").cast("double"), F.col("sample_weight").cast("double"), F.col("validation").cast("boolean"), F.lit(0.0).alias("margin"), *features)
    rows = stored(binned(ready, features, cuts, ["row", "target", "sample_weight", "validation", "margin"]))
    booster = Booster(features, [c.tolist() for c in cuts], [])
    watched = not rows.where("validation").isEmpty()
    best, best_size, kept = -1.0, 0, 0
    for round_ in range(s.rounds):
        booster.trees.append(_grow(rows, booster.trees[kept:], len(features), round_, s))
        if watched:
            scored = with_margins(rows.where("validation"), booster.trees[kept:], len(features)).select(F.col("margin").alias("score"), "target", "sample_weight")
            precision = average_precision(scored, weight="sample_weight").first().average_precision or 0.0
            if precision > best:
                best, best_size = precision, len(booster.trees)
            elif len(booster.trees) - best_size >= s.stop:
                break
        if len(booster.trees) - kept >= STORE:
            rows, kept = stored(with_margins(rows, booster.trees[kept:], len(features))), len(booster.trees)
    if watched:
        del booster.trees[best_size:]
    return booster


def scored(booster: Booster, df: DataFrame) -> DataFrame:
    """Adds ``score`` (probability) and ``predict`` (margin)."""
    names = df.columns
    keep = [F.col(c).alias(f"_k{i}") for i, c in enumerate(names)]
    flat = df.select(*keep, F.lit(0.0).alias("margin"), *booster.features)
    rows = with_margins(binned(flat, booster.features, [np.array(c) for c in booster.cuts], [*[f"_k{i}" for i in range(len(names))], "margin"]), booster.trees, len(booster.features))
    return rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)], (1 / (1 + F.exp(-F.col("margin")))).alias("score"), F.col("margin").alias("predict"))


def save(booster: Booster, path: str) -> None:
    write_settings(SparkSession.getActiveSession(), {"features": booster.features, "cuts": booster.cuts, "trees": [asdict(t) for t in booster.trees]}, path)


def load(spark: SparkSession, path: str) -> Booster:
    found = read_settings(spark, path, {})
    numbered = lambda d: {int(k): v for k, v in d.items()}
    return Booster(found["features"], found["cuts"], [Tree(**{n: numbered(d) for n, d in t.items()}) for t in found["trees"]])
