"""Toxicity by a classifier chain over sparse word features.

The categories are predicted one after the other. Each has a logistic model on words, word beginnings and runs of
signs, and on the probabilities of the categories before it. For training, those probabilities are out of fold:
they come from models that have not seen the row, so a later model learns to trust them as far as they deserve.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, those with the smallest key hashes);
every document is scored on its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.session import durable

SAMPLE_ROWS = 12_000
FEATURES = 256  # per category at most, those with the largest likelihood ratio
FOLDS = 3
BEGINNINGS = (4, 5, 6)
ROUNDS = 300
PENALTY = 1e-4

_PARTS = re.compile(r"\w+|[^\w\s]+").findall


def features(text: str) -> set[str]:
    """The distinct features of a text: lower-case words and runs of signs, and beginnings of longer words."""
    parts = set(_PARTS(text.lower()))
    found = set(parts)
    for n in BEGINNINGS:
        found.update([p[:n] + "-" for p in parts if len(p) > n])
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Table:
    """0/1 rows as the places of their ones, with a few dense columns beside them."""

    def __init__(self, row: np.ndarray, column: np.ndarray, shape: tuple[int, int], dense: np.ndarray):
        self.row, self.column, self.shape, self.dense = row, column, shape, dense

    def part(self, kept: np.ndarray) -> "Table":
        number = np.cumsum(kept) - 1
        inside = kept[self.row]
        shape = (int(kept.sum()), self.shape[1])
        return Table(number[self.row[inside]], self.column[inside], shape, self.dense[kept])

    def times(self, weights: np.ndarray) -> np.ndarray:
        n, m = self.shape
        return np.bincount(self.row, weights[:m][self.column], minlength=n) + self.dense @ weights[m:]

    def back(self, values: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.column, values[self.row], minlength=self.shape[1])
        return np.append(sparse, self.dense.T @ values)


def fit_logistic(x: Table, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent; one class alone gives its smoothed rate."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    start = float(np.log(rate / (1 - rate)))
    width = x.shape[1] + x.dense.shape[1]
    weights, before, bias, bias_before = np.zeros(width), np.zeros(width), start, start
    if len(y) == 0 or y.min() == y.max() or not width:
        return weights, start
    step = 4.0 / (1.0 + len(x.row) / len(y) + x.dense.shape[1])
    for t in range(ROUNDS):
        push = t / (t + 3.0)
        ahead, bias_ahead = weights + push * (weights - before), bias + push * (bias - bias_before)
        error = _sigmoid(x.times(ahead) + bias_ahead) - y
        before, bias_before = weights, bias
        weights = ahead - step * (x.back(error) / len(y) + PENALTY * ahead)
        bias = bias_ahead - step * float(error.mean())
    return weights, bias


@dataclass
class Chain:
    """A fitted chain: for each category its feature weights, the weights of earlier ones, intercept and cut."""

    categories: tuple[str, ...]
    index: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    earlier: list[np.ndarray] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)

    def scorer(self):
        """A function from a text to the probabilities of all categories."""
        whole = {f for f in self.index if not (f.endswith("-") and len(f) > 1 and f[:-1].isalnum())}
        begins = [(n, {f for f in self.index if len(f) == n + 1 and f.endswith("-")}) for n in BEGINNINGS]
        rows = {f: np.array([w[i] for w in self.weights]) for f, i in self.index.items()}
        bias = np.array(self.bias, dtype=float)

        def score(text: str) -> list[float]:
            parts = set(_PARTS(text.lower()))
            found = whole & parts
            for n, known in begins:
                if known:
                    found |= known & {p[:n] + "-" for p in parts if len(p) > n}
            total = bias.copy()
            for f in sorted(found):
                total += rows[f]
            out: list[float] = []
            for k, earlier in enumerate(self.earlier):
                z = total[k] + sum(w * p for w, p in zip(earlier, out))
                out.append(float(_sigmoid(np.array(z))))
            return out

        return score


def _best_cut(y: np.ndarray, p: np.ndarray) -> float:
    """The probability from which on rejecting gives the best F1; above 1 if there is nothing to reject."""
    if not y.sum():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(p[order][1:] < p[order][:-1], True)
    best = int(np.argmax(np.where(ends, f1, -1)))
    below = p[order][best + 1] if best + 1 < len(y) else 0.0
    return float((p[order][best] + below) / 2)


def fit_chain(found: list[list[int]], y: np.ndarray, names: list[str], categories: Sequence[str]) -> Chain:
    """``found``: each row's features as places in ``names``; ``y``: rows by categories, 0/1."""
    chain = Chain(tuple(categories), {f: i for i, f in enumerate(names)})
    n, width = len(found), len(names)
    row = np.repeat(np.arange(n), [len(f) for f in found]) if n else np.zeros(0, np.int64)
    column = np.array([c for f in found for c in f], dtype=np.int64)
    fold = np.arange(n) % FOLDS
    earlier = np.zeros((n, 0))
    for k in range(len(categories)):
        x, target = Table(row, column, (n, width), earlier), y[:, k].astype(float)
        unseen = np.zeros(n)
        for f in range(FOLDS):
            weights, bias = fit_logistic(x.part(fold != f), target[fold != f])
            unseen[fold == f] = _sigmoid(x.part(fold == f).times(weights) + bias)
        weights, bias = fit_logistic(x, target)
        chain.weights.append(weights[:width])
        chain.earlier.append(weights[width:])
        chain.bias.append(bias)
        chain.cut.append(_best_cut(target, unseen))
        earlier = np.hstack([earlier, unseen[:, None]])
    return chain


def _sampled(docs: DataFrame, labels: DataFrame, categories: Sequence[str], rows: int) -> DataFrame:
    """(doc_id, categories, _features) of the labelled documents that are fitted on."""
    marks = [F.max(F.col(c).cast("int")).alias(c) for c in categories]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*marks).dropna()
    # Bounded by ``rows``, so it may be sent to every task.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # A doc_id may be repeated: equal rows count once, and of different ones the limit holds for the rows.
    kept = durable(texts.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]))
    if kept.count() > rows:
        order = [F.xxhash64("doc_id", "_hash"), "doc_id", "_hash"]
        kept = kept.join(F.broadcast(kept.select("doc_id", "_hash").orderBy(*order).limit(rows)), ["doc_id", "_hash"])
    schema = ", ".join(["doc_id long", *(f"{c} int" for c in categories), "_features array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(features(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            arrays = [batch.column(0).cast(pa.int64()), *(batch.column(2 + k) for k in range(len(categories))), found]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *categories, "_features"])

    return durable(kept.select("doc_id", "text", *categories).mapInArrow(run, schema))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    sample_rows: int = SAMPLE_ROWS,
    per_category: int = FEATURES,
) -> Chain:
    """A chain fitted on at most ``sample_rows`` of the documents that ``labels`` (doc_id, categories 0/1) labels.

    Label rows of one doc_id count as positive if any is; one with a null label is not used. Equal documents of one
    doc_id are fitted on once. The driver gets the
    sample's chosen features only.
    """
    sample = _sampled(docs, labels, categories, sample_rows)
    totals = sample.agg(F.count(F.lit(1)), *(F.sum(c) for c in categories)).first()
    n, positive = totals[0] or 0, [t or 0 for t in totals[1:]]
    if not n:
        return fit_chain([], np.zeros((0, len(categories))), [], categories)
    pairs = sample.select(*categories, F.explode("_features").alias("_feature"))
    counts = pairs.groupBy("_feature").agg(
        F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_with_{k}") for k, c in enumerate(categories))
    )

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    counts = durable(counts.where("_n >= 2"))
    # A ratio that chance alone would reach for some feature says nothing.
    least = float(np.log(max(counts.count(), 2)))
    chosen: set[str] = set()
    for k in range(len(categories)):
        a, rate = F.col(f"_with_{k}"), max(positive[k], 0.5) / n
        b = F.col("_n") - a
        ratio = term(a, F.col("_n") * rate) + term(b, F.col("_n") * max(1 - rate, 0.5 / n))
        best = counts.select("_feature", ratio.alias("_ratio")).where(F.col("_ratio") > least).orderBy(F.desc("_ratio"), "_feature")
        chosen.update(r[0] for r in best.limit(per_category).collect())
    names = sorted(chosen)
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    kinds = ", ".join(["doc_id long", *(f"{c} int" for c in categories), "_at array<int>"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = wanted.value
        for batch in batches:
            at = [[index[f] for f in own if f in index] for own in batch.column(len(categories) + 1).to_pylist()]
            arrays = [batch.column(k) for k in range(len(categories) + 1)] + [pa.array(at, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *categories, "_at"])

    rows = sample.select("doc_id", *categories, "_features").mapInArrow(reduce, kinds).collect()
    rows.sort(key=lambda r: (r[0], list(r[-1])))
    y = np.array([row[1:-1] for row in rows], dtype=float).reshape(len(rows), len(categories))
    return fit_chain([list(row[-1]) for row in rows], y, names, categories)


def probabilities(text: Column, chain: Chain) -> Column:
    """The categories' probabilities of a text, as an array in the chain's order; null counts as empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = chain.scorer()
        for batch in batches:
            yield pd.Series([score(t) for t in batch])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(F.coalesce(text, F.lit("")))


def is_rejected(found: Column, chain: Chain, category: str) -> Column:
    """Whether a category's probability in ``found`` (see ``probabilities``) reaches its cut."""
    k = chain.categories.index(category)
    return found[k] >= F.lit(chain.cut[k])


def detect(docs: DataFrame, chain: Chain, category: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): each category's probability, and if ``category`` rejects it.

    Null and empty texts get the probabilities of a text without features. Repeated rows give repeated rows,
    other columns are ignored, an empty table gives no rows. A chain fitted without positive rows rejects none.

    Columns: doc_id, p_<category> for each, rejected.
    """
    found = docs.select("doc_id", probabilities(F.col("text"), chain).alias("_found"))
    shown = [F.col("_found")[k].alias(f"p_{c}") for k, c in enumerate(chain.categories)]
    return found.select("doc_id", *shown, is_rejected(F.col("_found"), chain, category).alias("rejected"))
