"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each category has a logistic model over word counts
and a few measures of the whole text; later models also get the probabilities of the earlier
categories. In training those are out-of-fold predictions, so that a later model sees them with the
error they will have.

Words are chosen where the rows are: Spark counts, for every word of the sampled labelled documents,
how many documents of each category have it, and keeps the ``WORDS`` that tell most for each. The
driver gets the sample's features as one Arrow table of single-precision numbers (at most ``bound``
rows of some 1.2 KB) and fits, adding up each Newton step over blocks of rows; the fitted chain is a
few KB and scores whole texts in one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release, small_batches, with_outputs
from .quality import held_out

WORDS = 150  #: for each category
FOLDS = 5
MEASURES = 4
ROWS = 2000  #: rows of the sample that a Newton step looks at together
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased (ASCII) runs of letters and digits."""
    return data.translate(_LETTERS).split()


def measures(data: bytes, words: list[bytes]) -> list[float]:
    n = max(1, len(data))
    upper = sum(data.count(c) for c in (b"A", b"E", b"I", b"O", b"N", b"R", b"S", b"T"))
    marks = sum(data.count(c) for c in (b"!", b"#", b"$", b"%", b"&", b"*", b"|"))
    return [math.log1p(len(words)), upper / n, marks / n, len(set(words)) / max(1, len(words))]


def row_of(data: bytes, index: dict[bytes, int]) -> np.ndarray:
    """Features of one whole text: measures, then the logarithm of one plus each word's count."""
    words = words_of(data)
    x = np.zeros(MEASURES + len(index))
    x[:MEASURES] = measures(data, words)
    for i, n in Counter([index[w] for w in words if w in index]).items():
        x[MEASURES + i] = math.log1p(n)
    return x


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weight + self.bias, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> Linear:
    """Logistic regression of the given rows of ``x`` and ``y`` by Newton steps. One class, or no
    rows, gives a constant probability."""
    own, width = y[rows], x.shape[1]
    prior = (own.sum() + 0.5) / (len(own) + 1)
    flat = Linear(np.zeros(width), np.ones(width), np.zeros(width), math.log(prior / (1 - prior)))
    if len(own) < 2 or own.min() == own.max():
        return flat
    blocks = [rows[i : i + ROWS] for i in range(0, len(rows), ROWS)]
    mean = sum(x[b].sum(axis=0, dtype=float) for b in blocks) / len(rows)
    scale = np.sqrt(sum(((x[b] - mean) ** 2).sum(axis=0) for b in blocks) / len(rows))
    scale[scale < 1e-9] = 1
    w = np.r_[flat.weight, flat.bias]
    penalty = np.r_[np.full(width, ridge), 1e-6]
    for _ in range(rounds):
        slope, curve = -penalty * w, np.diag(penalty)
        for b in blocks:
            z = np.c_[(x[b] - mean) / scale, np.ones(len(b))]
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope += z.T @ (y[b] - p)
            curve += (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return Linear(mean, scale, w[:-1], float(w[-1]))


@dataclass
class Chain:
    categories: list[str]
    index: dict[bytes, int]
    models: list[Linear]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of each category, one column each."""
        for model in self.models:
            x = np.c_[x, model.predict(x)]
        return x[:, x.shape[1] - len(self.models) :]


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, categories: list[str], index: dict[bytes, int]) -> Chain:
    """``y``: one column for each category; NaN where a row has no label for it."""
    models, width = [], x.shape[1]
    wide = np.zeros((len(x), width + y.shape[1]), x.dtype)
    wide[:, :width] = x
    for c in range(y.shape[1]):
        own, known = wide[:, : width + c], ~np.isnan(y[:, c])
        models.append(fit_linear(own, y[:, c], np.flatnonzero(known)))
        for f in range(FOLDS):
            left = np.flatnonzero(fold == f)
            if len(left):
                wide[left, width + c] = fit_linear(own, y[:, c], np.flatnonzero(known & (fold != f))).predict(own[left])
    return Chain(categories, index, models)


def _bytes(text: Column) -> Column:
    return F.coalesce(text.cast("binary"), F.lit(b""))


def _distinct_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    try:
        for data in batches:
            yield data.map(lambda b: list(set(words_of(b))))
    finally:
        release()


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], bound: int = 20_000) -> Chain:
    """Fit on labelled rows that are not held out, at most ``bound``, chosen by hash. ``categories``:
    name and 0/1 expression over ``labels``, in the chain's order. A key in many rows counts once,
    with the least of its texts, and of contradicting labels the greater one counts."""
    small_batches(docs.sparkSession)
    names = list(categories)
    usable = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(*(F.max(e.cast("double")).alias(f"y{i}") for i, e in enumerate(categories.values())))
    share = min(1.0, bound * 0.97 / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(bound)
    # The sample's texts are cut out once; at most ``bound`` rows.
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = materialize(labelled.groupBy("doc_id").agg(F.min("text").alias("text"), *(F.max(f"y{i}").alias(f"y{i}") for i in range(len(names)))), "labelled")
    words = sample.select(*(f"y{i}" for i in range(len(names))), F.explode(F.pandas_udf(_distinct_words, "array<binary>")(_bytes(F.col("text")))).alias("word"))
    totals = sample.agg(F.count("*"), *(F.sum(f"y{i}") for i in range(len(names)))).first()
    counts = words.groupBy("word").agg(F.count("*").alias("n"), *(F.sum(f"y{i}").alias(f"n{i}") for i in range(len(names)))).filter("n >= 3")
    counts = materialize(counts, "words")
    index: dict[bytes, int] = {}
    for i in range(len(names)):
        # Squared distance from what independence expects, over its variance.
        rate = (totals[i + 1] or 0.0) / max(1, totals[0])
        told = F.pow(F.coalesce(F.col(f"n{i}"), F.lit(0.0)) - F.col("n") * rate, 2) / (F.col("n") * rate * (1 - rate) + 1)
        for r in counts.orderBy(told.desc(), "word").limit(WORDS).collect():
            index.setdefault(bytes(r.word), len(index))

    width = MEASURES + len(index)

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for data in batches:
                yield data.map(lambda b: row_of(b, index).astype("<f4").tobytes())
        finally:
            release()

    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(60)), F.lit(FOLDS))
    asked = sample.select("doc_id", *(f"y{i}" for i in range(len(names))), drawn.alias("fold"), F.pandas_udf(rows, "binary")(_bytes(F.col("text"))).alias("x"))
    got = asked.toArrow()
    discard(sample, counts)
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), "<f4").reshape(-1, width)[order]
    y = np.stack([got.column(f"y{i}").to_numpy() for i in range(len(names))], axis=1)[order]
    return fit_chain(x, y, got.column("fold").to_numpy()[order], names, index)


def add_probabilities(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` for each category of the chain. Null texts count as empty."""
    names = [f"p_{c}" for c in chain.categories]

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for data in batches:
                x = np.array([row_of(b, chain.index) for b in data]).reshape(-1, MEASURES + len(chain.index))
                yield pd.DataFrame(chain.predict(x), columns=names)
        finally:
            release()

    small_batches(docs.sparkSession)

    scored = docs.withColumn("__gw_p", F.pandas_udf(score, ", ".join(f"{n} double" for n in names))(_bytes(F.col(f"`{text}`"))))
    return with_outputs(scored, {n: F.col(f"__gw_p.{n}") for n in names}).drop("__gw_p")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (toxic), predicted and p_low_quality of every document."""
    chain = train(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    scored = add_probabilities(docs.select("doc_id", "text"), chain)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"), "p_low_quality")
