"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Boosting goes round the features and adds, for one
feature at a time, a shallow tree over its bins, so that each feature ends with a lookup table.
Then the pairs with the largest remaining gain get two-dimensional tables the same way. A score
is a sum of table entries: features are binned and added up by columns.

Features come from whole texts and are computed where the rows are. Only a sample of labelled
rows, at most ``bound``, goes to the driver, where tables of a few KB are fitted; these travel
with the scoring function.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, with_outputs

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "symbols", "bangs", "bars", "digits", "stops", "spaces", "wide",
    "distinct_words", "same_as_last", "top_word", "line_bytes", "repeated_lines", "ended_lines", "packed", "entropy", "short_words", "marked_words",
)
_SYMBOLS = np.frombuffer(b"#$%&*<>@^~=+{}[]\\", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)


def text_features(data: bytes) -> list[float]:
    """Features of one whole text; an empty text has zeros."""
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    p = count[count > 0] / n
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    return [
        math.log1p(n), math.log1p(len(words)), (n - int(count[32]) - int(count[10])) / m, float(count[65:91].sum()) / letters, float(count[_SYMBOLS].sum()) / n,
        float(count[33]) / n, float(count[124]) / n, float(count[48:58].sum()) / n, float(count[_STOPS].sum()) / n, float(count[32] + count[10] + count[9]) / n, float(count[128:].sum()) / n,
        len(seen) / m, sum(map(eq, words, words[1:])) / m, max(seen.values(), default=0) / m, n / k, 1 - len(set(lines)) / k, sum(x.rstrip()[-1:] in b".!?" for x in lines) / k,
        len(zlib.compress(data, 1)) / n, float(-(p * np.log2(p)).sum()), sum(len(w) < 4 for w in words) / m, sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:!?" for w in words) / m,
    ]


def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    try:
        for data in batches:
            yield data.map(text_features)
    finally:
        release()


def features(text: Column) -> Column:
    return F.pandas_udf(_features, "array<double>")(F.coalesce(text.cast("binary"), F.lit(b"")))


@dataclass
class AdditiveModel:
    base: float
    cuts: list[np.ndarray]  #: for each feature the upper edges of its bins but the last
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]  #: features, their coarse edges, table

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            z += table[np.searchsorted(cut, x[:, f])]
        for f, g, cf, cg, table in self.pairs:
            z += table[np.searchsorted(cf, x[:, f]), np.searchsorted(cg, x[:, g])]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and position of the best cut of ordered bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least) | (hr < least)] = 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, rate: float, least: float) -> np.ndarray:
    """A tree of depth two over ordered bins, as the value it adds to each bin."""
    out = np.zeros(len(g))
    gain, at = _best_cut(g, h, least)
    for lo, hi in ((0, at), (at, len(g))) if gain > 0 else ((0, len(g)),):
        inner, cut = _best_cut(g[lo:hi], h[lo:hi], least)
        for a, b in ((lo, lo + cut), (lo + cut, hi)) if inner > 0 else ((lo, hi),):
            if b > a:
                out[a:b] = rate * g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, rate: float, least: float) -> tuple[float, np.ndarray]:
    """A tree over two ordered features: one cut by the first, then one by the second on either side."""
    out, total = np.zeros(g.shape), 0.0
    _, at = _best_cut(g.sum(1), h.sum(1), least)
    best = (-1.0, at or 1)
    for a in range(1, g.shape[0]):
        s = sum(_best_cut(g[r].sum(0), h[r].sum(0), least)[0] for r in (slice(0, a), slice(a, None)))
        best = max(best, (s, a))
    for r in (slice(0, best[1]), slice(best[1], None)):
        gain, cut = _best_cut(g[r].sum(0), h[r].sum(0), least)
        total += gain
        for c in (slice(0, cut), slice(cut, None)) if gain > 0 else (slice(None),):
            out[r, c] = rate * g[r, c].sum() / (h[r, c].sum() + 1)
    return total, out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 200, pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 40, rate: float = 0.1, least: float = 2.0) -> AdditiveModel:
    """Fit by cyclic boosting of the logistic loss. One class, or no rows, gives a constant score."""
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    n_features = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        return AdditiveModel(base, [np.zeros(0)] * n_features, [np.zeros(1)] * n_features, [])
    cuts = [_edges(x[:, f], bins) for f in range(n_features)]
    where = [np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(n_features):
            g, h = slopes()
            added = _tree(np.bincount(where[f], g, len(tables[f])), np.bincount(where[f], h, len(tables[f])), rate, least)
            tables[f] += added
            z += added[where[f]]
    coarse = [_edges(x[:, f], pair_bins) for f in range(n_features)]
    at = [np.searchsorted(c, x[:, f]) for f, c in enumerate(coarse)]

    def grid(f: int, g: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        return np.bincount(at[f] * shape[1] + at[g], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_tree2(grid(i, j, g), grid(i, j, h), rate, least)[0], i, j) for i, j in combinations(range(n_features), 2) if len(coarse[i]) and len(coarse[j])), reverse=True)
    chosen = [(i, j) for gain, i, j in ranked[:pairs] if gain > 0]
    plane = {ij: np.zeros((len(coarse[ij[0]]) + 1, len(coarse[ij[1]]) + 1)) for ij in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h = slopes()
            _, added = _tree2(grid(i, j, g), grid(i, j, h), rate, least)
            plane[i, j] += added
            z += added[at[i], at[j]]
    return AdditiveModel(base, cuts, tables, [(i, j, coarse[i], coarse[j], plane[i, j]) for i, j in chosen])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 50_000) -> AdditiveModel:
    """Fit on labelled rows that are not held out, at most ``bound`` of them, chosen by hash.

    Rows without a label or a key are left out. The chosen keys have a proven bound, so they are
    broadcast; a key that stands in many rows counts once, with the least of its feature vectors,
    and of contradicting labels the greater one counts.
    """
    small_batches(docs.sparkSession)
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("__gw_y"))
    n = usable.count()
    share = min(1.0, bound * 0.97 / max(1, n))
    chosen = usable.filter(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000)) < int(share * 1_000_000)).limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "__gw_y", features(F.col("text")).alias("x"))
    got = rows.groupBy("doc_id").agg(F.first("__gw_y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(dtype=float))


def add_score(docs: DataFrame, model: AdditiveModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (0 to 1). Null texts count as empty."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for data in batches:
                x = np.array([text_features(b) for b in data], dtype=float).reshape(-1, len(FEATURES))
                yield pd.Series(model.score(x))
        finally:
            release()

    small_batches(docs.sparkSession)
    return with_outputs(docs, {name: F.pandas_udf(score, "double")(F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")))})


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = add_score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches ``threshold``, with their own columns."""
    scored = add_score(docs, train(docs, labels), name="__gw_score")
    return scored.filter(F.col("__gw_score") >= threshold).drop("__gw_score")
