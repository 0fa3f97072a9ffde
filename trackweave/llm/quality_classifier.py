"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating has a grade 0 (toxic), 1 (of low quality) or 2 (good). One weight vector over
hashed words is shared by all grades; ordered thresholds cut its score, so
``P(grade > j) = sigmoid(score - threshold_j)``. Selection uses the expected grade and the
tail probability of the best grade.

Features are the distinct lower-cased word and mark runs of a text, and whether words in
capitals or words with a tail of marks occur often; rare ones (in fewer than three
training texts) are left out. Weights are learned with an elastic-net penalty on a bounded
sample of rated documents (``sample_rows``, chosen by hash of the id; documents may have
several ratings, the lowest counts).

Null and empty texts have no features and score by the thresholds alone. Ratings with a
null in either column count by the other; with neither they are ignored. Without any
rating all documents get equal probabilities. Equal texts get equal results; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import CACHE_ENTRIES
from trackweave.llm.ftrl import Ftrl, Rows, scores

BITS = 18
GRADES = 3
_TOKENS = re.compile(r"\w+|[^\w\s]+")


def cell(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) & ((1 << BITS) - 1)


def tokens_of(text: str | None) -> set[str]:
    """Distinct features of a text."""
    found = _TOKENS.findall(text or "")
    out = set(map(str.lower, found))
    n = max(1, len(found))
    for name, share in (("\x00capitals", sum(map(str.isupper, found)) / n), ("\x00marks", sum(1 for x in found if len(x) > 1 and not x.isalnum()) / n)):
        if share > 0.02:
            out.add(f"{name}{min(9, int(share * 20))}")
            out.add(name)
    return out


@dataclass
class OrdinalModel:
    weights: np.ndarray  # one for each cell
    thresholds: np.ndarray  # ascending, GRADES - 1


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade of every rated document."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).when(F.coalesce("quality", "toxic").isNotNull(), 2)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(grade).alias("grade")).where("grade is not null")


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> list:
    """(grade, cells) of at most about ``sample_rows`` rated documents."""
    rated = ratings(labels)
    share = min(1.0, sample_rows / max(1, rated.count()))
    drawn = rated.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.unique(np.array([cell(t) for t in tokens_of(x.as_py())], dtype="<i4")).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["grade", "cells"])

    # Bounded by sample_rows, so it may go to every executor.
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("grade", "text")
    return chosen.mapInArrow(features, "grade int, cells binary").collect()


def losses(s: np.ndarray, y: np.ndarray, weight: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Weighted negative log-likelihood of each row's grade under its score."""
    above = np.c_[np.ones(len(s)), sigmoid(s[:, None] - cuts), np.zeros(len(s))]
    i = np.arange(len(s))
    return -weight * np.log(np.maximum(above[i, y] - above[i, y + 1], 1e-9))


def slopes(s: np.ndarray, y: np.ndarray, weight: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's loss: the slope in its score, and in each threshold."""
    above = np.c_[np.ones(len(s)), sigmoid(s[:, None] - cuts), np.zeros(len(s))]
    i = np.arange(len(s))
    p = np.maximum(above[i, y] - above[i, y + 1], 1e-9)
    d = above * (1 - above)  # slope of each tail in the score
    tail = np.zeros((len(s), GRADES + 1))
    np.add.at(tail, (i, y), weight * d[i, y] / p)
    np.add.at(tail, (i, y + 1), -weight * d[i, y + 1] / p)
    return -weight * (d[i, y] - d[i, y + 1]) / p, tail[:, 1:GRADES]


def fitted(sample: list, *, epochs: int = 30, batch: int = 64, alpha: float = 0.3, l1: float = 0.5, l2: float = 0.05, rare: int = 3) -> OrdinalModel:
    cells = [np.frombuffer(r["cells"], dtype="<i4") for r in sample]
    grades = np.array([r["grade"] for r in sample], dtype=int)
    share = np.array([(grades > j).mean() if len(grades) else 0.5 for j in range(GRADES - 1)]).clip(0.01, 0.99)
    thresholds = -np.log(share / (1 - share))
    if not len(grades):
        return OrdinalModel(np.zeros(1 << BITS, np.float32), thresholds)
    common = np.bincount(np.concatenate(cells), minlength=1 << BITS) >= rare
    cells = [c[common[c]] for c in cells]
    data = Rows(cells, [np.ones(len(c)) for c in cells])
    model = Ftrl(1 << BITS, 1, alpha=alpha, l1=l1, l2=l2)
    # The grades weigh alike, however rare.
    weight = (len(grades) / (GRADES * np.bincount(grades, minlength=GRADES).clip(1)))[grades].clip(0.2, 5)
    gap = np.log(np.maximum(np.diff(thresholds), 1e-2))
    low, rng = thresholds[0], np.random.default_rng(11)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(grades)), max(1, len(grades) // batch)):
            rows, ids, values = data.take(part)
            distinct, inverse = np.unique(ids, return_inverse=True)
            s = scores(rows, values, model.weights(distinct)[inverse], len(part))[:, 0]
            cuts = np.r_[low, low + np.cumsum(np.exp(gap))]
            g, by_row = slopes(s, grades[part], weight[part], cuts)
            by_cut = by_row.mean(axis=0)
            low -= 0.05 * by_cut.sum()
            for j in range(len(gap)):
                gap[j] -= 0.05 * by_cut[j + 1 :].sum() * np.exp(gap[j])
            if len(ids):
                model.step(distinct, np.bincount(inverse, weights=values * g[rows], minlength=len(distinct))[:, None] / len(part) ** 0.5)
    return OrdinalModel(model.weights()[:, 0].astype(np.float32), np.r_[low, low + np.cumsum(np.exp(gap))])


def learned(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 12_000) -> OrdinalModel:
    return fitted(training_rows(docs, labels, sample_rows))


class TokenWeights(dict):
    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = self[token] = float(self.weights[cell(token)])
        return out


def grade(docs: DataFrame, model: OrdinalModel, *, least: float = 0.5) -> DataFrame:
    """doc_id, score, expected_grade, p_above_0, p_above_1 and kept (``p_above_1 >= least``) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = TokenWeights(shared.value.weights)
        for batch in batches:
            s = np.array([sum(map(weights.__getitem__, sorted(tokens_of(x.as_py())))) for x in batch.column(1)], dtype=float)
            tails = sigmoid(s[:, None] - shared.value.thresholds[None, :])
            cols = [s, tails.sum(axis=1), tails[:, 0], tails[:, 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.float64()) for c in cols], pa.array(tails[:, 1] >= least)], names=["doc_id", "score", "expected_grade", "p_above_0", "p_above_1", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, expected_grade double, p_above_0 double, p_above_1 double, kept boolean")
