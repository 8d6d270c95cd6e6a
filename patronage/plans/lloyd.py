"""k-means for many runs and many numbers of clusters at once: one pass over the rows per iteration of all of them.

A pass finds the nearest centre of every run for each row and sums counts, vectors and costs per run and cluster; a
task's sums are one row, merged in a tree, so the driver gets as many numbers as there are centres. Runs whose
centres stay put leave the passes. The starts are drawn by rounds of oversampling, again for all runs together: a row
becomes a candidate by its distance from the run's candidates so far and a random number of its own vector, so a
recomputed partition draws the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.session import durable

ROUNDS = 4  # of oversampling
MOST_PASSES = 100
ROWS_AT_ONCE = 4096
DISTANCES_AT_ONCE = 1 << 20  # in a worker


@dataclass(frozen=True)
class Run:
    """A fitted run: centres in a fixed order, and the sum of squared distances to them."""

    k: int
    centres: np.ndarray
    cost: float

    def label(self, features: DataFrame, name: str, column: str = "features") -> DataFrame:
        """The rows with the number of their nearest centre, from 1."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for values in batches:
                found = nearest_of(np.stack(values.to_numpy()), centres) + 1 if len(values) else []
                yield pd.Series(np.asarray(found, dtype=np.int32))

        return features.withColumn(name, nearest(vector_to_array(column)))


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)[None, :]
    return np.clip(squares, 0, None)


def _rows_at_once(centres: int) -> int:
    """How many rows may meet the centres at a time."""
    return max(1, min(ROWS_AT_ONCE, DISTANCES_AT_ONCE // max(1, centres)))


def nearest_of(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of each row's nearest centre, some rows at a time."""
    step = _rows_at_once(len(centres))
    parts = [_distances(rows[b : b + step], centres).argmin(axis=1) for b in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], centres: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row vectors, as many as may meet the centres at a time, and a random number of each."""
    step = _rows_at_once(centres)
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            part = batch.slice(begin, step)
            rows = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield rows, part.column(1).to_numpy().astype(np.uint64)


def _uniform(draws: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (draws + np.uint64(salt + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _sums(table: DataFrame, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per run: rows and vector sums of each cluster, and the cost; one pass for all runs."""
    every = np.concatenate(centres)
    edges = np.cumsum([0, *map(len, centres)])
    width = every.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cost = np.zeros((len(every), width + 1)), np.zeros(len(centres))
        for rows, _ in _chunks(batches, len(every)):
            apart = _distances(rows, every)
            full = np.column_stack([np.ones(len(rows)), rows])
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                own = apart[:, a:b]
                near = own.argmin(axis=1)
                cost[i] += own[np.arange(len(rows)), near].sum()
                for column in range(width + 1):
                    total[a:b, column] += np.bincount(near, full[:, column], minlength=b - a)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(total.ravel(), cost).tobytes()], pa.binary())], ["sums"])

    parts = table.mapInArrow(run, "sums binary").rdd.map(lambda row: np.frombuffer(row.sums).copy())
    add = lambda a, b: b if a is None else a if b is None else a + b
    merged = parts.treeAggregate(None, add, add, depth=3)
    total, cost = merged[: len(every) * (width + 1)].reshape(len(every), width + 1), merged[len(every) * (width + 1) :]
    return [(total[a:b, 0], total[a:b, 1:], float(c)) for a, b, c in zip(edges, edges[1:], cost)]


def _drawn(table: DataFrame, known: list[np.ndarray], chances: list[float], salts: list[int]) -> list[np.ndarray]:
    """New candidates of every run: rows drawn with a chance of their squared distance times the run's factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, draws in _chunks(batches, max(map(len, known), default=0)):
            for i, (own, chance, salt) in enumerate(zip(known, chances, salts)):
                apart = _distances(rows, own).min(axis=1) if len(own) else np.ones(len(rows))
                picked = rows[_uniform(draws, salt) < chance * apart]
                if len(picked):
                    picked = np.unique(picked, axis=0)
                    arrays = [pa.array([i] * len(picked), pa.int32()), pa.array([r.tobytes() for r in picked], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["run", "row"])

    found: list[list[bytes]] = [[] for _ in known]
    for row in table.mapInArrow(run, "run int, row binary").distinct().collect():
        found[row.run].append(bytes(row.row))
    return [np.array([np.frombuffer(r) for r in sorted(own)]) if own else np.empty((0, 0)) for own in found]


def _chosen(candidates: np.ndarray, weight: np.ndarray, k: int, chance: np.random.Generator) -> np.ndarray:
    """``k`` of the weighted candidates, each drawn by its weight and its squared distance from those before."""
    picks = [int(chance.choice(len(candidates), p=weight / weight.sum()))]
    apart = _distances(candidates, candidates[picks])[:, 0]
    while len(picks) < min(k, len(candidates)):
        odds = weight * apart
        if odds.sum() <= 0:
            break
        picks.append(int(chance.choice(len(candidates), p=odds / odds.sum())))
        apart = np.minimum(apart, _distances(candidates, candidates[picks[-1:]])[:, 0])
    return candidates[picks]


def _starts(table: DataFrame, rows: int, ks: Sequence[int], seeds: Sequence[int]) -> list[np.ndarray]:
    none = [np.empty((0, 0))] * len(ks)
    known = _drawn(table, none, [min(1.0, 8.0 / rows)] * len(ks), [1000 * s for s in seeds])
    if any(len(own) == 0 for own in known):
        first = np.array([table.orderBy("draw").first().row])
        known = [own if len(own) else first for own in known]
    known = [own[:1] for own in known]
    for step in range(1, ROUNDS + 1):
        costs = [cost for _, _, cost in _sums(table, known)]
        chances = [2.0 * k / c if c > 0 else 0.0 for k, c in zip(ks, costs)]
        new = _drawn(table, known, chances, [1000 * s + step for s in seeds])
        known = [np.unique(np.concatenate([a, b]), axis=0) if len(b) else a for a, b in zip(known, new)]
    weights = [count for count, _, _ in _sums(table, known)]
    return [_chosen(c, np.maximum(w, 1e-9), k, np.random.default_rng([s, k])) for c, w, k, s in zip(known, weights, ks, seeds)]


def _table(features: DataFrame, column: str) -> DataFrame:
    row = vector_to_array(column)
    return durable(features.select(row.alias("row"), F.xxhash64(row).alias("draw")))


def micro_clusters(
    features: DataFrame, k: int, seed: int, passes: int, column: str = "features"
) -> tuple[np.ndarray, np.ndarray]:
    """Means and counts of at most ``k`` clusters of the rows after a few passes."""
    table = _table(features, column)
    centres = _starts(table, table.count(), [k], [seed])[0]
    for _ in range(passes):
        count, total, _ = _sums(table, [centres])[0]
        centres = total[count > 0] / count[count > 0, None]
    return centres, _sums(table, [centres])[0][0]


def fit(features: DataFrame, ks: Sequence[int], seeds: Sequence[int], column: str = "features") -> list[Run]:
    """One run per pair of ``ks`` and ``seeds`` over the vector column, all in the same passes.

    A run ends when its centres stay put; an empty cluster keeps its centre. Centres are ordered by their
    coordinates. Fewer distinct rows than ``k`` give fewer centres; an empty table gives none.
    """
    table = _table(features, column)
    rows = table.count()
    if not rows:
        return [Run(k, np.empty((0, 0)), 0.0) for k in ks]
    centres = _starts(table, rows, ks, seeds)
    open_runs, costs = list(range(len(ks))), [0.0] * len(ks)
    for _ in range(MOST_PASSES):
        still = []
        for i, (count, total, cost) in zip(open_runs, _sums(table, [centres[i] for i in open_runs])):
            moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres[i])
            costs[i] = cost
            if np.abs(moved - centres[i]).max() > 1e-9:
                still.append(i)
                centres[i] = moved
        open_runs = still
        if not open_runs:
            break
    # a run that was stopped has moved since its cost was summed
    for i, (_, _, cost) in zip(open_runs, _sums(table, [centres[i] for i in open_runs]) if open_runs else []):
        costs[i] = cost
    ordered = [c[np.lexsort(c.T[::-1])] for c in centres]
    return [Run(k, c, cost) for k, c, cost in zip(ks, ordered, costs)]
