"""Bootstrap over the rows of groups, one row for each patient.

A draw takes as many rows of a group as it has, with replacement; which ones is integer arithmetic, the
same on every engine. Draws times rows never exist as rows where a group has up to ``HELD`` rows: the
group travels as arrays, every task takes some of the draws, and a draw is a vector of counts whose
products with the rows' terms give all its sums at once. Larger groups are cut into blocks of ``BLOCK``
rows: a task takes some of the draws and one block, and the sums of blocks are added up. Only where ranks are
asked for do larger groups go by rows: pairs of draw and row are counted, joined and aggregated. All
ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import order as O

M = 2147483647
HELD = 1 << 17  #: rows of a group that travels as arrays, 3 MB with two predictions
SHARE = 250  #: draws of a task
CELLS = 1 << 22  #: draws times rows that a task holds at once
SLOTS = 1 << 16  #: slots of a draw in one row of the grid
BLOCK = 1 << 21  #: rows of a large group that a task holds, some 350 MB with two predictions and their terms
PIECE = 1 << 14  #: rows of a block that travel as one row
STEP = 1 << 13  #: slots that are dealt at once
WIDE_SHARE = 1000  #: draws of a task on a block
METRICS = ("mae", "rmse", "r2", "pearson", "tolerance", "spearman")


def draw_index(draw, slot, n):
    """A row number below ``n``: mixed integer arithmetic that gives the same on every engine."""
    z1 = ((draw * n + slot) * 48271 + 11) % M
    z2 = ((z1 * z1) % M * 3 + z1 * 69621 + 7) % M
    return ((z2 * z2) % M + z2 * 16807 + 5) % M % n


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``row``, from 0 on in each group. By ranges of the first order column if that is a
    number; a group of another order is ordered in one task."""
    if isinstance(df.schema[order[0]].dataType, NumericType):
        return O.numbered(df, order[0], *order[1:], name="row", by=by).withColumn("row", F.col("row") - 1)
    return df.withColumn("row", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long") - 1)


def bootstrap_draws(df: DataFrame, order: Sequence[str], draws: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, draw, rows of ``df``, times): each group drawn with replacement as often as it has rows.

    Draws travel as counts: (draw, row) pairs are aggregated before they meet the rows, so repeats cost
    nothing.
    """
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    slots = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOTS).cast("long")))
    grid = sizes.filter("n > 0").crossJoin(df.sparkSession.range(draws).withColumnRenamed("id", "draw")).withColumn("first", slots)
    grid = grid.withColumn("slot", F.explode(F.sequence("first", F.least(F.col("first") + SLOTS, F.col("n")) - 1)))
    picked = grid.withColumn("row", draw_index(F.col("draw"), F.col("slot"), F.col("n"))).groupBy(*by, "draw", "row").agg(F.count("*").alias("times"))
    return picked.join(numbered(df, order, by), [*by, "row"])


def bootstrap_interval(per_draw: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """2.5 and 97.5 percentiles over draws; draws without a value are left out."""
    ok = per_draw.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return ok.groupBy(*by).agg(F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"), F.count("*").alias("draws"))


# ---- what a draw says about predictions ------------------------------------------------------


def draw_ranks(d: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Average ranks in a draw in which a row counts ``times``."""
    for c in columns:
        upto = F.sum("times").over(W.partitionBy(*by).orderBy(c))
        own = F.sum("times").over(W.partitionBy(*by, c))
        d = d.withColumn(f"rank_{c}", upto - (own - 1) / 2)
    return d


def draw_metrics(d: DataFrame, by: Sequence[str], truth: str, pred: str, tolerance: float) -> DataFrame:
    """(by, metrics) of rows that count ``times``; null where a side is flat."""
    t, e = F.col("times"), F.col(pred) - F.col(truth)
    n = F.sum("times")
    mean = lambda x: F.sum(t * x) / n
    cov = lambda a, b: mean(a * b) - mean(a) * mean(b)
    r = lambda a, b: F.when((cov(a, a) > 1e-9) & (cov(b, b) > 1e-9), cov(a, b) / F.sqrt(cov(a, a) * cov(b, b)))
    y, p = F.col(truth), F.col(pred)
    out = {"mae": mean(F.abs(e)), "rmse": F.sqrt(mean(e * e)), "r2": F.when(cov(y, y) > 1e-9, 1 - mean(e * e) / cov(y, y)), "pearson": r(y, p), "tolerance": mean((F.abs(e) <= tolerance).cast("double"))}
    if f"rank_{pred}" in d.columns:
        out["spearman"] = r(F.col(f"rank_{truth}"), F.col(f"rank_{pred}"))
    return d.groupBy(*by).agg(*(c.alias(k) for k, c in out.items()))


def _counts(draws: np.ndarray, n: int) -> np.ndarray:
    """Times that each row is in each draw."""
    if n >= STEP:
        out, at = np.empty((len(draws), n)), np.empty(n, np.int64)
        for row, draw in zip(out, draws):
            _block_counts(int(draw), n, 0, n, row, at)
        return out
    at = draw_index(draws[:, None].astype(np.int64), np.arange(n, dtype=np.int64)[None, :], n)
    return np.bincount((at + np.arange(len(draws))[:, None] * n).ravel(), minlength=len(draws) * n).reshape(len(draws), n).astype(float)


def _draw_ranks(times: np.ndarray, v: np.ndarray) -> np.ndarray:
    order = np.argsort(v, kind="stable")
    first = np.flatnonzero(np.r_[True, v[order][1:] != v[order][:-1]])
    own = np.add.reduceat(times[:, order], first, axis=1)
    rank = np.cumsum(own, axis=1) - (own - 1) / 2
    group = np.empty(len(v), int)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(v)]))
    return rank[:, group]


def _correlation(saa: np.ndarray, sbb: np.ndarray, sab: np.ndarray) -> np.ndarray:
    ok = (saa > 1e-9) & (sbb > 1e-9)
    return np.where(ok, sab / np.sqrt(np.where(ok, saa * sbb, 1.0)), np.nan)


def _statistics(draws: np.ndarray, y: np.ndarray, preds: np.ndarray, tolerance: float, ranks: bool) -> list[np.ndarray]:
    """For each prediction [draw, metric]."""
    times = _counts(draws, len(y))
    mean = lambda x: times @ x / len(y)
    my, vy = mean(y), mean(y * y) - mean(y) ** 2
    place = _draw_ranks(times, y) if ranks else None
    out = []
    for p in preds:
        e = p - y
        mse, mp = mean(e * e), mean(p)
        found = [mean(np.abs(e)), np.sqrt(mse), np.where(vy > 1e-9, 1 - mse / np.where(vy > 1e-9, vy, 1.0), np.nan), _correlation(vy, mean(p * p) - mp * mp, mean(y * p) - my * mp), mean((np.abs(e) <= tolerance) * 1.0)]
        if ranks:
            other = _draw_ranks(times, p)
            weighed = lambda a, b: (times * a * b).sum(axis=1) / len(y) - (times * a).sum(axis=1) * (times * b).sum(axis=1) / len(y) ** 2
            found.append(_correlation(weighed(place, place), weighed(other, other), weighed(place, other)))
        out.append(np.stack(found, axis=1))
    return out


def _fold(z: np.ndarray, spare: np.ndarray) -> None:
    """``z`` in place by a lesser number of the same rest modulo ``M``: its low 31 bits plus the others."""
    np.right_shift(z, 31, out=spare)
    np.bitwise_and(z, M, out=z)
    np.add(z, spare, out=z)


def _block_counts(draw: int, n: int, low: int, high: int, out: np.ndarray, at: np.ndarray) -> None:
    """Times that rows ``low`` to ``high`` are in a draw of ``n`` rows, as :func:`draw_index` deals them; ``at`` is a
    buffer of n numbers. Rests are only taken as far as products stay in 63 bits."""
    steps = np.arange(min(n, STEP), dtype=np.int64) * 48271
    squares, spares = np.empty_like(steps), np.empty_like(steps)
    for first in range(0, n, STEP):
        z = at[first : first + STEP]
        own, spare = squares[: len(z)], spares[: len(z)]
        np.add(steps[: len(z)], (draw * n + first) * 48271 + 11, out=z)
        _fold(z, spare)
        _fold(z, spare)
        for by, more, times in ((69621, 7, 3), (16807, 5, 1)):
            np.multiply(z, z, out=own)
            _fold(own, spare)
            if times > 1:
                own *= times
            z *= by
            z += own
            z += more
            _fold(z, spare)
        _fold(z, spare)
        z[z == M] = 0
        np.floor_divide(z, n, out=spare)
        spare *= n
        z -= spare
    if high - low < n:
        at = at[(at >= low) & (at < high)] - low
    out[:] = np.bincount(at, minlength=high - low)


def _terms(y: np.ndarray, preds: Sequence[np.ndarray], tolerance: float) -> np.ndarray:
    """[row, term]: what the sums of a draw are made of; two terms of the truth and six of each prediction."""
    out = [y, y * y]
    for p in preds:
        e = np.abs(p - y)
        out += [e, e * e, p, p * p, y * p, e <= tolerance]
    return np.stack(out, axis=1).astype(float)


def _wide_statistics(whole: DataFrame, order: Sequence[str], draws: int, keys: Sequence[str], values: Sequence[str], preds: Sequence[str], tolerance: float, groups: int, most: int, block: int) -> DataFrame:
    """:func:`draw_statistics` without ranks of groups of any size, by blocks of rows."""
    names, kinds = [*keys, "draw"], ", ".join([*(f"`{k}` {whole.schema[k].dataType.simpleString()}" for k in keys), "draw long, n long, sums array<double>"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("piece")
        y, *given = (np.concatenate(part[v].to_list()).astype(float) for v in values)
        n, low = int(part["n"].iloc[0]), int(part["block"].iloc[0]) * block
        terms, at = _terms(y, given, tolerance), np.empty(n, np.int64)
        own, out = range(int(part["first"].iloc[0]), min(int(part["first"].iloc[0]) + WIDE_SHARE, draws)), []
        times = np.empty((max(1, CELLS // len(y)), len(y)))
        for b in range(own.start, own.stop, len(times)):
            some = range(b, min(b + len(times), own.stop))
            for i, draw in enumerate(some):
                _block_counts(draw, n, low, low + len(y), times[i], at)
            sums = 0.0
            for r in range(0, len(y), 1024):  # small products, which stay on the task's own core
                sums = sums + times[: len(some), r : r + 1024] @ terms[r : r + 1024]
            out += sums.tolist()
        return pd.DataFrame({**{k: part[k].iloc[0] for k in keys}, "draw": list(own), "n": n, "sums": out})[[*names, "n", "sums"]]

    sizes = whole.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = numbered(whole, order, keys).withColumns({"block": F.expr(f"row div {block}"), "piece": F.expr(f"row div {min(PIECE, block)}")})
    packed = rows.groupBy(*keys, "block", "piece").agg(F.array_sort(F.collect_list(F.struct("row", *values))).alias("__gw_p"))
    packed = packed.join(sizes, list(keys)) if keys else packed.crossJoin(F.broadcast(sizes))
    firsts = F.explode(F.sequence(F.lit(0), F.lit(max(draws, 1) - 1), F.lit(WIDE_SHARE)))
    cells = packed.select(*keys, "n", "block", "piece", *(F.col(f"__gw_p.{v}").alias(v) for v in values), firsts.alias("first"))
    tasks = min(4096, 2 * groups * -(-draws // WIDE_SHARE) * -(-most // block))
    sums = cells.repartition(max(1, tasks), *keys, "block", "first").groupBy(*keys, "block", "first").applyInPandas(run, kinds)
    count = 2 + 6 * len(preds)
    added = sums.groupBy(*names).agg(F.first("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(count)))
    mean = lambda i: F.col(f"s{i}") / F.col("n")
    vy = mean(1) - mean(0) * mean(0)
    out = []
    for k, c in enumerate(preds):
        a, s, p, pp, yp, hit = (mean(2 + 6 * k + i) for i in range(6))
        vp = pp - p * p
        r = F.when((vy > 1e-9) & (vp > 1e-9), (yp - mean(0) * p) / F.sqrt(vy * vp))
        out.append(F.struct(F.lit(c).alias("pred"), a.alias("mae"), F.sqrt(s).alias("rmse"), F.when(vy > 1e-9, 1 - s / vy).alias("r2"), r.alias("pearson"), hit.alias("tolerance")))
    return added.select(*names, F.inline(F.array(*out)))


def draw_statistics(df: DataFrame, order: Sequence[str], draws: int, by: Sequence[str], truth: str, preds: Sequence[str], tolerance: float, ranks: bool = True, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """(by, draw, pred, mae, rmse, r2, pearson, tolerance, spearman) of every draw and prediction column; null
    or nan where a side is flat. Rows without truth or a prediction do not count. Counts the rows of groups first.
    """
    keys, metrics = list(by), list(METRICS if ranks else METRICS[:-1])
    columns = [truth, *preds]
    whole = df.select(*dict.fromkeys([*keys, *order]), *(F.col(c).cast("double").alias(f"__gw_v{i}") for i, c in enumerate(columns))).dropna(subset=[f"__gw_v{i}" for i in range(len(columns))])
    most, groups = whole.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count("*")).first()
    values = [f"__gw_v{i}" for i in range(len(columns))]
    if most > held and not ranks:
        return _wide_statistics(whole, order, draws, keys, values, preds, tolerance, groups, most, block).select(*keys, "draw", "pred", *metrics)
    if most > held:
        d = bootstrap_draws(whole, order, draws, keys)
        d = draw_ranks(d, [*keys, "draw"], values)
        parts = [draw_metrics(d, [*keys, "draw"], values[0], v, tolerance).withColumn("pred", F.lit(c)) for v, c in zip(values[1:], preds)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.select(*keys, "draw", "pred", *metrics)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i in range(len(part)):
                row = part.iloc[i]
                y, *given = (np.asarray(row[v], float) for v in values)
                own = np.arange(row["first"], min(row["first"] + SHARE, draws))
                step = max(1, CELLS // len(y))
                for b in range(0, len(own), step):
                    for c, found in zip(preds, _statistics(own[b : b + step], y, given, tolerance, ranks)):
                        made = pd.DataFrame(found, columns=metrics).assign(draw=own[b : b + step], pred=c, **{k: row[k] for k in keys})
                        yield made[[*keys, "draw", "pred", *metrics]]

    part = lambda v: lambda row: row[v]
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *values)))
    packed = whole.groupBy(*keys).agg(rows.alias("rows")).filter(F.size("rows") > 0).select(*keys, *(F.transform("rows", part(v)).alias(v) for v in values))
    shares = packed.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(max(draws, 1) - 1), F.lit(SHARE)))).repartition(*keys, "first")
    kinds = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "draw long, pred string", *(f"{m} double" for m in metrics)])
    return shares.mapInPandas(run, kinds)
