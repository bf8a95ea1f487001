"""Gradient boosted trees for a yes/no question, fitted to all rows: tasks add up, the driver picks the splits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.llm.common import cut_lineage

#: Slopes are added up as whole numbers of this part of one, so that sums don't depend on the order of the rows.
UNIT = 1 << 24
#: A place in the bins that no value is above.
NEVER = 255
#: So many distinct binned rows at most are added up on the driver, where a pass costs less than a job; the sums are the same.
HERE = 1 << 16


@dataclass(frozen=True)
class Tree:
    """A tree of fixed depth: node i asks ``x[feature[i]] > cut[i]`` and goes to 2i+1 (no) or 2i+2 (yes)."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.value[_walk(x, self.feature, self.cut, self.depth) - (2**self.depth - 1)]


@dataclass(frozen=True)
class Boosted:
    """A sum of trees, as log odds."""

    prior: float
    trees: list[Tree]

    def chance(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.prior)
        for tree in self.trees:
            odds += tree(x)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(x), int)
    for _ in range(depth):
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
    return node


def _sums(model: Boosted, feature: np.ndarray, cut: np.ndarray, level: int, binned: np.ndarray, y: np.ndarray,
          n: np.ndarray, bins: int) -> np.ndarray:
    """Rows, slopes and bends by (node of the level, feature, bin) of ``n`` times each binned row, under the trees so far."""
    odds = np.full(len(y), model.prior)
    for tree in model.trees:
        odds += tree(binned)
    p = 1 / (1 + np.exp(-odds))
    node = _walk(binned, feature, cut, level) - (2**level - 1)
    width = binned.shape[1]
    cell = ((node[:, None] * width + np.arange(width)) * bins + binned).ravel()
    parts = n, n * np.rint((y - p) * UNIT), n * np.rint(np.maximum(p * (1 - p), 1e-6) * UNIT)
    cells = 2**level * width * bins
    return np.stack([np.bincount(cell, np.repeat(v, width), cells) for v in parts]).astype(np.int64)


def _cuts(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """The distinct quantiles that part the values, each of which comes ``counts`` times."""
    order = np.argsort(values)
    upto = np.cumsum(counts[order])
    return np.unique(values[order][np.searchsorted(upto, upto[-1] * np.linspace(0, 1, bins + 1)[1:-1])])


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], 1).astype(np.uint8)


class Local:
    """Rows at hand."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y, self.right = x, y, int(y.sum())

    def __len__(self) -> int:
        return len(self.y)

    def bin(self, bins: int) -> list[np.ndarray]:
        cuts = [_cuts(*np.unique(c, return_counts=True), bins) for c in self.x.T]
        self.rows, self.bins = _binned(self.x, cuts), bins
        return cuts

    def sums(self, *at: object) -> np.ndarray:
        return _sums(*at, self.rows, self.y, np.ones(len(self.y)), self.bins)


class Stored:
    """Rows that Spark keeps, with the columns ``x`` (array of double, of few distinct values) and ``y`` (boolean). The
    driver gets counts of values and of bins, however many rows there are."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.size, self.right = rows.agg(F.count(F.lit(1)), F.count_if("y")).first()

    def __len__(self) -> int:
        return self.size

    def bin(self, bins: int) -> list[np.ndarray]:
        found = self.rows.select(F.posexplode("x").alias("f", "v")).groupBy("f", "v").count().collect()
        values: dict[int, list[tuple]] = {}
        for r in found:
            values.setdefault(r.f, []).append((r.v, r["count"]))
        cuts = [_cuts(*np.array(values[f]).T, bins) for f in sorted(values)]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("x").flatten().to_numpy().reshape(-1, len(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in _binned(x, cuts)], pa.binary()), batch.column("y")], ["b", "y"])

        placed = self.rows.select("x", "y").mapInArrow(place, "b binary, y boolean")
        self.binned, self.bins = cut_lineage(placed.groupBy("b", "y").count()), bins
        self.width, self.few = len(cuts), None
        if self.binned.count() <= HERE:
            rows = self.binned.collect()
            self.few = (np.frombuffer(b"".join(r.b for r in rows), np.uint8).reshape(-1, self.width),
                        np.array([r.y for r in rows], float), np.array([r["count"] for r in rows], float))
        return cuts

    def sums(self, model: Boosted, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        bins, width = self.bins, self.width
        if self.few is not None:
            return _sums(model, feature, cut, level, *self.few, bins)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((3, 2**level * width * bins), np.int64)
            for batch in batches:
                rows = np.frombuffer(b"".join(batch.column("b").to_pylist()), np.uint8).reshape(-1, width)
                out += _sums(model, feature, cut, level, rows, np.array(batch.column("y").to_pylist(), float),
                             batch.column("count").to_numpy().astype(float), bins)
            cells = np.flatnonzero(out[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), *[pa.array(part[cells]) for part in out]], ["cell", "n", "g", "h"])

        found = self.binned.mapInArrow(add, "cell long, n long, g long, h long")
        found = found.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "g", "h")]).collect()
        out = np.zeros((3, 2**level * width * bins), np.int64)
        cell, *parts = np.array(found, np.int64).T
        out[:, cell] = parts
        return out


def boost(x: np.ndarray | Stored, y: np.ndarray | None = None, *, trees: int = 40, depth: int = 3, rate: float = 0.2,
          bins: int = 32) -> Boosted:
    """Fit by second-order boosting of the logistic loss over binned features, to arrays or to stored rows, which have
    their own ``y``. Without rows, or with one class only, the model is the (smoothed) share of that class."""
    rows = x if isinstance(x, Stored) else Local(x, y)
    share = (rows.right + 1) / (len(rows) + 2)
    prior = float(np.log(share / (1 - share)))
    if rows.right in (0, len(rows)):
        return Boosted(prior, [])
    cuts = rows.bin(bins)
    inner, done, out = 2**depth - 1, Boosted(prior, []), []
    for _ in range(trees):
        feature, cut, place = np.zeros(inner, int), np.full(inner, np.inf), np.full(inner, NEVER)
        g, h = np.zeros(inner + 1), np.zeros(inner + 1)
        for level in range(depth):
            found = rows.sums(done, feature, place, level).reshape(3, 2**level, len(cuts), bins)
            sums = np.cumsum(found, -1)
            for at, i in enumerate(range(2**level - 1, 2 ** (level + 1) - 1)):
                n, slope, bend = sums[0, at], sums[1, at] / UNIT, sums[2, at] / UNIT
                best = (1e-9, 0, None)
                for f, q in enumerate(cuts):
                    if n[f, -1] < 10 or not len(q):
                        continue
                    a, b = slope[f], bend[f]
                    gain = a**2 / (b + 1) + (a[-1] - a) ** 2 / (b[-1] - b + 1) - a[-1] ** 2 / (b[-1] + 1)
                    k = int(gain[: len(q)].argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
                feature[i], k = best[1:]
                left = slope[0, -1], bend[0, -1]
                if k is not None:
                    cut[i], place[i] = cuts[feature[i]][k], k
                    left = slope[feature[i], k], bend[feature[i], k]
                if level == depth - 1:
                    leaf = 2 * i + 1 - inner
                    g[leaf], h[leaf] = left
                    g[leaf + 1], h[leaf + 1] = slope[0, -1] - left[0], bend[0, -1] - left[1]
        value = rate * g / (h + 1)
        done.trees.append(Tree(feature, place, value, depth))
        out.append(Tree(feature, cut, value, depth))
    return Boosted(prior, out)
