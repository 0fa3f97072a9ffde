"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's features are the hashed 1- to 3-grams of its lower-cased letter runs (with word
ends), weighted by inverse document frequency and scaled to sum to one. Document
frequencies are counted over all training documents. Weights are learned by
follow-the-regularised-leader with an elastic-net penalty on a bounded sample, by
language in equal shares; a fifth of the sample is kept back to fit the temperature of the
predicted probabilities.

Training uses only text and non-null language of rows outside the held-out fifth (CRC-32
of the id as text, modulo 5, is 0). Null texts and texts without a letter get ``und`` with
score 0, as does every text when no language was learned. Equal texts get equal results;
ties of probability go to the alphabetically first language. An empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import cells_batch, mixed, portions, summed_cells
from trackweave.llm.ftrl import Ftrl, Rows, batch_step, scores

BITS = 16
#: Words whose features are remembered; beyond it a cache starts afresh with the next batch.
WORD_CACHE = 300_000
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_FIRST, _LAST = "\x02", "\x03"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def letter_runs(text: str | None) -> list[str]:
    found = _LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    # Fractions, circled digits and Roman numerals are word characters too, but neither decimal digits nor letters.
    return "".join([c if c.isalpha() else " " for c in " ".join(found)]).split()


def gram_cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash cells of the 1- to 3-grams of each word between its ends, one word after the other, and how many each has."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    codes = np.frombuffer("".join([f"{_FIRST}{w}{_LAST}" for w in words]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(n)
    grams, valid = np.zeros((len(codes), 3), dtype=np.uint64), np.ones((len(codes), 3), dtype=bool)
    step = np.uint64(0x110000)
    grams[:, 0] = codes
    grams[:-1, 1] = (codes[:-1] + np.uint64(1)) * step + codes[1:]
    grams[:-2, 2] = (grams[:-2, 1] + np.uint64(1)) * step + codes[2:]
    valid[ends - n, 0] = valid[ends - 1, 1] = valid[ends - 1, 2] = valid[ends - 2, 2] = False
    return (mixed(grams[valid]) & np.uint64((1 << BITS) - 1)).astype(np.int32), 3 * n - 4


class WordCells(dict):
    """word -> its cells."""

    def learn(self, texts: list[list[str]]) -> None:
        """Take in the words of a batch of texts that are new."""
        if len(self) >= WORD_CACHE:
            self.clear()
        new = [w for w in set(chain.from_iterable(texts)) if w not in self]
        cells, n = gram_cells(new)
        self.update(zip(new, np.split(cells, np.cumsum(n)[:-1])))


#: Cells do not depend on a model, so the tasks of a Python worker share them.
_CELLS = WordCells()


@dataclass
class LanguageModel:
    """What scoring needs: languages, inverse document frequencies, weights and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


class WordScores(dict):
    """word -> row of ``rows``: sums of idf * weights by language, and of idf, over the word's cells."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.table = np.c_[model.idf[:, None] * model.weights, model.idf]
        self.rows = np.empty((1024, self.table.shape[1]))

    def learn(self, texts: list[list[str]]) -> None:
        """Take in the words of a batch of texts that are new."""
        if len(self) >= WORD_CACHE:
            self.clear()
        new = [w for w in set(chain.from_iterable(texts)) if w not in self]
        if not new:
            return
        used = len(self)
        while used + len(new) > len(self.rows):
            self.rows = np.r_[self.rows, np.empty_like(self.rows)]
        for at in range(0, len(new), 20_000):
            cells, n = gram_cells(new[at : at + 20_000])
            self.rows[used + at : used + at + len(n)] = np.add.reduceat(self.table[cells], np.r_[0, np.cumsum(n)[:-1]], axis=0)
        self.update(zip(new, range(used, used + len(new))))

    def total(self, words: list[str]) -> np.ndarray:
        """Sum of the rows of all words of a text."""
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return self.rows[ids].sum(axis=0)


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Rows of ``train(text)`` that have each cell, and the number of rows; the result is a fixed 2**BITS counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros((1 << BITS) + 1, dtype=np.int64), np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            df[-1] += batch.num_rows
            for portion in portions(batch.column(0)):
                texts = list(map(letter_runs, portion))
                _CELLS.learn(texts)
                for words in filter(None, texts):
                    seen[np.concatenate(list(map(_CELLS.__getitem__, set(words))))] = True
                    cells = np.flatnonzero(seen)
                    df[cells] += 1
                    seen[cells] = False
        yield cells_batch(df)

    total = summed_cells(train.mapInArrow(count, "part int, counts binary"), (1 << BITS) + 1)
    return total[:-1], int(total[-1])


def training_sample(train: DataFrame, rows: int) -> list:
    """(lang, cells, counts, kept back) of about ``rows`` rows at most, languages in equal shares, chosen by hash of the id."""
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()}
    share = rows / max(1, len(sizes))
    rates = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, share / n))) for k, n in sizes.items())) if sizes else F.create_map().cast("map<string,double>")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = train.withColumn("drawn", drawn).where(F.col("drawn") < rates[F.col("lang")]).select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit(18)), F.lit(5)) == 0).alias("back"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for portion in portions(batch.column(1)):
                texts = list(map(letter_runs, portion))
                _CELLS.learn(texts)
                for words in texts:
                    ids, n = np.unique(np.concatenate(list(map(_CELLS.__getitem__, words))), return_counts=True) if words else (np.empty(0), np.empty(0))
                    found.append((ids.astype("<u2").tobytes(), np.minimum(n, 65535).astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary()), batch.column(2)], names=["lang", "cells", "counts", "back"])

    return chosen.mapInArrow(features, "lang string, cells binary, counts binary, back boolean").collect()


def fitted(df: np.ndarray, n: int, sample: list, *, epochs: int = 8, alpha: float = 0.5, l1: float = 0.2, l2: float = 1e-3, batch: int = 16, scale: float = 60.0) -> LanguageModel:
    languages = sorted({r["lang"] for r in sample if len(r["cells"])})
    idf = np.log((n + 1) / (df + 1)) + 1.0
    index = {x: i for i, x in enumerate(languages)}
    ids, values, wanted, back = [], [], [], []
    for r in sample:
        cells = np.frombuffer(r["cells"], dtype="<u2").astype(np.int32)
        if not len(cells):
            continue
        x = np.frombuffer(r["counts"], dtype="<u2") * idf[cells]
        ids.append(np.r_[cells, 1 << BITS])
        values.append(np.r_[scale * x / x.sum(), 1.0])
        wanted.append(index[r["lang"]])
        back.append(r["back"])
    data, wanted, back = Rows(ids, values), np.array(wanted, dtype=int), np.array(back, dtype=bool)
    model = Ftrl((1 << BITS) + 1, max(1, len(languages)), alpha=alpha, l1=l1, l2=l2)
    rng = np.random.default_rng(5)
    learn = np.flatnonzero(~back) if (~back).any() else np.arange(len(data))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // batch)):
            batch_step(model, data, part, lambda s, part=part: softmax(s) - np.eye(len(languages))[wanted[part]])
    weights = model.weights()
    kept = np.flatnonzero(back) if back.any() else learn
    rows, at, x = data.take(kept)
    logits = scores(rows, x, weights[at], len(kept))
    grid = np.exp(np.linspace(np.log(0.5), np.log(20), 76))
    loss = [-np.log(softmax(logits / t)[np.arange(len(kept)), wanted[kept]] + 1e-12).mean() for t in grid] if len(kept) else [0.0] * len(grid)
    return LanguageModel(languages, idf, scale * weights[:-1], weights[-1], float(grid[int(np.argmin(loss))]))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def learned(docs: DataFrame, *, sample_rows: int = 6000) -> LanguageModel:
    """``sample_rows`` bounds the documents that weights and temperature are fitted on."""
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    df, n = document_frequencies(train.select("text"))
    return fitted(df, n, training_sample(train, sample_rows))


def predicted(model: LanguageModel, words: WordScores, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    languages, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    runs = [letter_runs(text) if model.languages else [] for text in texts]
    known = [i for i, r in enumerate(runs) if r]
    if known:
        words.learn(runs)
        sums = np.stack([words.total(runs[i]) for i in known])
        p = softmax((sums[:, :-1] / sums[:, -1:] + model.bias) / model.temperature)
        best = p.argmax(axis=1)
        score[known] = p[np.arange(len(known)), best]
        for i, b in zip(known, best):
            languages[i] = model.languages[b]
    return languages, score


def identify(docs: DataFrame, model: LanguageModel, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, and the columns in ``keep``; the model (a fixed number of cells a language) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    also = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(shared.value)
        for batch in batches:
            found = [predicted(shared.value, words, portion) for portion in portions(batch.column(2))]
            languages, score = list(chain.from_iterable(f[0] for f in found)), np.concatenate([f[1] for f in found] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(score), *batch.columns[3:]], names=["doc_id", "held_out", "lang_pred", "score", *keep])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("_text"), *keep)
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double{also}")
