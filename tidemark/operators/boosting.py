"""Newton-boosted trees over grouped candidates, with histograms summed by Spark.

A group (a client) is one row with the binned features of its candidates. The softmax objective makes the
candidates of a group compete; the binary objective takes each by itself. Each level of each tree is one
job: tasks compute gradients under the trees so far and histograms of the open nodes, Spark sums them by
(node, feature, bin), and the driver, which sees one row for each of these, picks the splits. Missing
values have a bin of their own and go the way that gains more.

Features are binned once, and the scores under the trees so far are written with them every KEEP trees, so a
job walks through KEEP trees at most and the work of a tree does not grow with their number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.storage import stored

BINS = 32
MISSING = 255
#: Trees after which the running scores are written.
KEEP = 10


@dataclass
class Settings:
    objective: str = "softmax"
    rounds: int = 40
    depth: int = 4
    rate: float = 0.1
    l2: float = 1.0
    least_hessian: float = 1.0
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 0


@dataclass
class Model:
    """features; edges of each feature's bins; trees as lists of nodes [feature, bin, missing_left, left, right, value, gain]."""

    features: list[str]
    edges: list[list[float]]
    settings: Settings
    base: float = 0.0
    trees: list[list[list[float]]] = field(default_factory=list)

    def bin(self, x: np.ndarray) -> np.ndarray:
        """Bins of (rows, features)."""
        out = np.empty(x.shape, np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(edges, x[:, j], side="left"))
        return out

    def score(self, binned: np.ndarray) -> np.ndarray:
        return self.base + _scored(self.trees, binned)

    def contributions(self, binned: np.ndarray) -> np.ndarray:
        """(rows, features + 1): what each split on the way to a leaf changed, by feature, and the rest."""
        out = np.zeros((len(binned), len(self.features) + 1))
        out[:, -1] = self.base
        for tree in self.trees:
            at = np.zeros(len(binned), int)
            out[:, -1] += tree[0][5]
            for _ in range(self.settings.depth):
                after = _down(tree, binned, at)
                moved = np.flatnonzero(after != at)
                value = np.array([n[5] for n in tree])
                split = np.array([int(n[0]) for n in tree])
                np.add.at(out, (moved, split[at[moved]]), value[after[moved]] - value[at[moved]])
                at = after
        return out

    def importance(self) -> dict[str, float]:
        """Gain of each feature's splits."""
        gains = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for n in tree:
                if n[0] >= 0:
                    gains[self.features[int(n[0])]] += n[6]
        return gains

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"features": self.features, "edges": self.edges, "settings": self.settings.__dict__, "base": self.base, "trees": self.trees}, f, sort_keys=True)

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path) as f:
            d = json.load(f)
        if set(d) != {"features", "edges", "settings", "base", "trees"}:
            raise TypeError(f"{path} holds no boosted model")
        return cls(d["features"], d["edges"], Settings(**d["settings"]), d["base"], d["trees"])


def _down(tree: list[list[float]], binned: np.ndarray, at: np.ndarray) -> np.ndarray:
    t = np.array([n[:5] for n in tree])
    node = t[at]
    split = node[:, 0].astype(int)
    b = binned[np.arange(len(binned)), np.maximum(split, 0)]
    left = np.where(b == MISSING, node[:, 2] > 0, b <= node[:, 1])
    return np.where(split < 0, at, np.where(left, node[:, 3], node[:, 4]).astype(int))


def leaves(tree: list[list[float]], binned: np.ndarray) -> np.ndarray:
    at = np.zeros(len(binned), int)
    while True:
        after = _down(tree, binned, at)
        if (after == at).all():
            return at
        at = after


def _gradients(scores: np.ndarray, y: np.ndarray, sizes: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray]:
    if objective == "binary":
        p = 1 / (1 + np.exp(-scores))
        return p - y, np.maximum(p * (1 - p), 1e-6)
    starts = np.cumsum(sizes) - sizes
    e = np.exp(scores - np.repeat(np.maximum.reduceat(scores, starts), sizes))
    p = e / np.repeat(np.add.reduceat(e, starts), sizes)
    return p - y, p * (1 - p) + 1e-6


def grouped(rows: DataFrame, features: list[str], target: str | None = None, key: str = "client_id", candidate: str = "family_id") -> DataFrame:
    """key, x (features of its candidates one after the other), y (0 or 1 for each), candidates (their numbers)."""
    entry = F.struct(F.col(candidate).alias("c"), F.array(*(F.col(f"`{f}`").cast("double") for f in features)).alias("x"), (F.col(target).cast("double") if target else F.lit(0.0)).alias("y"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return listed.select(F.col(key).alias("key"), F.flatten(F.transform("e", lambda e: e["x"])).alias("x"), F.transform("e", lambda e: e["y"]).alias("y"), F.transform("e", lambda e: e["c"]).alias("candidates"))


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    y = batch.column("y")
    return x, y.flatten().to_numpy(zero_copy_only=False), np.diff(y.offsets.to_numpy())


def _edges(rows: DataFrame, features: list[str]) -> list[list[float]]:
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*(F.percentile_approx(F.col(f"`{f}`").cast("double"), shares, 10_000).alias(f"q{i}") for i, f in enumerate(features))).first()
    return [sorted({float(v) for v in q or [] if v == v}) for q in found]


def fit(rows: DataFrame, features: list[str], target: str, settings: Settings, key: str = "client_id", candidate: str = "family_id") -> Model:
    """rows: one for each candidate, with target 0 or 1."""
    model = Model(list(features), _edges(rows, features), settings)
    if settings.objective == "binary":
        share = rows.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        model.base = float(np.log(share / (1 - share)))
    groups = _binned(grouped(rows, features, target, key, candidate), model)
    rng = np.random.default_rng(settings.seed)
    width = len(features)
    for turn in range(settings.rounds):
        if turn and turn % KEEP == 0:
            groups = _advanced(groups, model.trees[-KEEP:], width)
        columns = np.sort(rng.choice(width, max(1, round(settings.column_share * width)), replace=False))
        tree = [[-1, 0, 0, 0, 0, 0.0, 0.0]]
        open_nodes = [0]
        for level in range(settings.depth + 1):
            sums = _histograms(groups, model, tree, open_nodes, columns, turn)
            open_nodes = _split(tree, open_nodes, sums, columns, settings, level == settings.depth)
            if not open_nodes:
                break
        for n in tree:
            n[5] *= settings.rate
        model.trees.append(tree)
    return model


_STATE = "binned binary, y array<double>, scores array<double>"


def _binned(groups: DataFrame, model: Model) -> DataFrame:
    """key, binned (the bins of a group's candidates, a byte each), y, scores (the base), written once."""
    kind, width = dict(groups.dtypes)["key"], len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y, sizes = _arrays(batch, width)
                yield _state(batch.column("key"), model.bin(x), y, np.full(len(y), model.base), sizes)

    return stored(groups.select("key", "x", "y").mapInArrow(run, f"key {kind}, {_STATE}"), "binned")


def _state(keys: pa.Array, binned: np.ndarray, y: np.ndarray, scores: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    packed = pa.array([binned[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(float))) for v in (y, scores)]
    return pa.RecordBatch.from_arrays([keys, packed, *lists], names=["key", "binned", "y", "scores"])


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    binned = np.frombuffer(b"".join(batch.column("binned").to_pylist()), np.uint8).reshape(-1, width)
    y, scores = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("y", "scores"))
    return binned, y, scores, np.diff(batch.column("y").offsets.to_numpy())


def _advanced(groups: DataFrame, trees: list, width: int) -> DataFrame:
    """groups with the scores of the last trees added, written anew."""
    kind = dict(groups.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                binned, y, scores, sizes = _unpacked(batch, width)
                yield _state(batch.column("key"), binned, y, scores + _scored(trees, binned), sizes)

    return stored(groups.mapInArrow(run, f"key {kind}, {_STATE}"), "binned")


def _scored(trees: list, binned: np.ndarray) -> np.ndarray:
    total = np.zeros(len(binned))
    for tree in trees:
        total += np.array([n[5] for n in tree])[leaves(tree, binned)]
    return total


def _histograms(groups: DataFrame, model: Model, tree: list, nodes: list[int], columns: np.ndarray, turn: int) -> dict[int, np.ndarray]:
    """For each open node an array (columns, BINS + 1, 2) of summed gradients and hessians."""
    settings, width = model.settings, len(model.features)
    recent = model.trees[turn - turn % KEEP :]
    slots = BINS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((len(nodes), len(columns) * slots, 2))
        for batch in batches:
            if not len(batch):
                continue
            binned, y, scores, sizes = _unpacked(batch, width)
            g, h = _gradients(scores + _scored(recent, binned), y, sizes, settings.objective)
            chosen = np.array([hash((settings.seed, turn, k)) % 1000 < 1000 * settings.row_share for k in map(_stable, batch.column("key").to_pylist())])
            inside = np.repeat(chosen, sizes)
            at = leaves(tree, binned)
            for i, node in enumerate(nodes):
                rows = np.flatnonzero(inside & (at == node))
                if len(rows):
                    place = (np.arange(len(columns)) * slots + np.minimum(binned[rows][:, columns], BINS)).ravel()
                    for j, v in ((0, g), (1, h)):
                        hist[i, :, j] += np.bincount(place, np.repeat(v[rows], len(columns)), len(columns) * slots)
        node, slot = np.nonzero(hist[:, :, 1])
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(slot, pa.int32()), pa.array(hist[node, slot, 0]), pa.array(hist[node, slot, 1])], names=["node", "slot", "g", "h"])

    found = groups.mapInArrow(run, "node int, slot int, g double, h double").groupBy("node", "slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    sums = {n: np.zeros((len(columns), slots, 2)) for n in nodes}
    for r in found.collect():
        sums[nodes[r["node"]]][r["slot"] // slots, r["slot"] % slots] = (r["g"], r["h"])
    return sums


def _stable(key) -> int:
    import zlib

    return zlib.crc32(str(key).encode())


def _split(tree: list, nodes: list[int], sums: dict[int, np.ndarray], columns: np.ndarray, settings: Settings, last: bool) -> list[int]:
    """Sets the nodes' values and, unless last, their best splits; returns the new open nodes."""
    fresh = []
    for node in nodes:
        s = sums[node]
        total = s[0].sum(axis=0)
        tree[node][5] = float(-total[0] / (total[1] + settings.l2))
        if last:
            continue
        quality = lambda v: v[..., 0] ** 2 / (v[..., 1] + settings.l2)
        best = (1e-9, None)
        prefix, missing = np.cumsum(s[:, :BINS], axis=1), s[:, BINS:]
        for to_left in (1, 0):
            left = prefix + (missing if to_left else 0)
            right = total - left
            gain = quality(left) + quality(right) - quality(total)
            gain[(left[..., 1] < settings.least_hessian) | (right[..., 1] < settings.least_hessian)] = 0
            j, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, b] > best[0]:
                best = (float(gain[j, b]), (int(columns[j]), int(b), to_left))
        if best[1]:
            tree[node][:5] = [*best[1], len(tree), len(tree) + 1]
            tree[node][6] = best[0]
            fresh += [len(tree), len(tree) + 1]
            tree += [[-1, 0, 0, 0, 0, 0.0, 0.0], [-1, 0, 0, 0, 0, 0.0, 0.0]]
    return fresh


def predict(rows: DataFrame, model: Model, key: str = "client_id", candidate: str = "family_id") -> DataFrame:
    """key, candidate, score for every candidate."""
    width = len(model.features)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, _, sizes = _arrays(batch, width)
                keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([keys, batch.column("candidates").flatten().cast(pa.int32()), pa.array(shared.value.score(shared.value.bin(x)))], names=["key", "c", "score"])

    found = grouped(rows, model.features, None, key, candidate).select("key", "x", "y", "candidates").mapInArrow(run, f"key {kind}, c int, score double")
    return found.select(F.col("key").alias(key), F.col("c").alias(candidate), "score")


def explain(rows: DataFrame, model: Model, key: str = "client_id", candidate: str = "family_id") -> DataFrame:
    """key, candidate, feature, contribution for every candidate and feature that moved its score."""
    width, names = len(model.features), [*model.features, "base"]
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, _, sizes = _arrays(batch, width)
                found = shared.value.contributions(shared.value.bin(x))
                row, column = np.nonzero(found)
                keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)[row]))
                numbers = batch.column("candidates").flatten().cast(pa.int32()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([keys, numbers, pa.array([names[c] for c in column], pa.string()), pa.array(found[row, column])], names=["key", "c", "feature", "contribution"])

    found = grouped(rows, model.features, None, key, candidate).mapInArrow(run, f"key {kind}, c int, feature string, contribution double")
    return found.select(F.col("key").alias(key), F.col("c").alias(candidate), "feature", "contribution")
