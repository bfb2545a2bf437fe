"""Ordered computations on long signals: (series columns, idx, value).

Every window is partitioned by the series. Resampling and lags are joins on sample numbers, so a
long series may be spread over tasks by a block column in its key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaitwright.session import small_batches


def _w(by: Sequence[str], order: str):
    return W.partitionBy(*by).orderBy(order)


def difference(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """First difference; the first of a series is 0. Twice applied it gives the second difference."""
    return df.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(_w(by, order)), F.col(value)))


def moving_average(df: DataFrame, by: Sequence[str], order: str, value: str, name: str, k: int, odd: bool = False) -> DataFrame:
    """Centred mean of ``k`` values, edges repeated (k // 2 on the left). ``odd`` makes k odd and
    leaves series under 3 values as they are."""
    k = k + 1 - k % 2 if odd else k
    left, right = k // 2, k - 1 - k // 2
    every, seen = W.partitionBy(*by), _w(by, order)
    row, n = F.row_number().over(seen) - 1, F.count("*").over(every)
    whole = seen.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    short_left, short_right = F.greatest(F.lit(0), left - row), F.greatest(F.lit(0), row + right - (n - 1))
    total = F.sum(value).over(seen.rowsBetween(-left, right)) + short_left * F.first(value).over(whole) + short_right * F.last(value).over(whole)
    return df.withColumn(name, F.when(n < 3, F.col(value)).otherwise(total / k) if odd else total / k)


def running_max(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.max(value).over(_w(by, order).rowsBetween(W.unboundedPreceding, 0)))


def strip_padding(df: DataFrame, by: Sequence[str], order: str, clock: str) -> DataFrame:
    """Rows whose clock is finite and more than 1e-9 past the row before it, as recorded. A row that
    follows a broken clock goes too; the first row stays if its clock is finite."""
    good = F.col(clock).isNotNull() & ~F.isnan(clock) & (F.abs(clock) < float("inf"))
    before = F.lag(clock).over(_w(by, order))
    first = F.row_number().over(_w(by, order)) == 1
    step = F.coalesce(~F.isnan(before) & (F.col(clock) - before > 1e-9), F.lit(False))
    return df.withColumn("__gw_ok", good & (first | step)).filter("__gw_ok").drop("__gw_ok")


def sample_rate(df: DataFrame, by: Sequence[str], clock: str) -> DataFrame:
    """One over the median step of the clock; null for fewer than two samples."""
    steps = df.withColumn("__gw_d", F.col(clock) - F.lag(clock).over(_w(by, clock)))
    return steps.groupBy(*by).agg((1 / F.median("__gw_d")).alias("rate"))


def hudgins(df: DataFrame, by: Sequence[str], order: str, value: str, threshold: float = 1e-5) -> DataFrame:
    """Mean absolute value, waveform length, sign changes and slope sign changes of each series.

    The sign of 0 is 0, so a passage through 0 counts twice. A sign change counts if both sizes add
    up to ``threshold`` at least; slope sign changes all count.
    """
    w = _w(by, order)
    d = df.withColumns({"__gw_p": F.lag(value).over(w), "__gw_d": F.col(value) - F.lag(value).over(w)})
    crossed = (F.signum(value) != F.signum("__gw_p")) & (F.abs(value) + F.abs("__gw_p") >= threshold)
    d = d.withColumns({"__gw_s": crossed, "__gw_t": F.signum("__gw_d") != F.lag(F.signum("__gw_d")).over(w)})
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    return d.groupBy(*by).agg(F.avg(F.abs(value)).alias("mav"), F.coalesce(F.sum(F.abs("__gw_d")), F.lit(0.0)).alias("wl"), count("__gw_s").alias("zc"), count("__gw_t").alias("ssc"))


def time_features(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Mean, population SD, range, bias-corrected skew and excess kurtosis, RMS, zero crossings."""
    d = df.withColumn("__gw_z", (F.signum(value) != F.lag(F.signum(value)).over(_w(by, order))).cast("long"))
    n, g1, g2 = F.count(value), F.skewness(value), F.kurtosis(value)
    skew, kurt = F.sqrt(n * (n - 1)) / (n - 2) * g1, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    flat = F.stddev_pop(value) < 1e-12
    return d.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.when((n < 3) | flat, 0.0).otherwise(skew).alias("skew"),
        F.when((n < 4) | flat, 0.0).otherwise(kurt).alias("kurt"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.coalesce(F.sum("__gw_z"), F.lit(0)).alias("crossings"),
    )


def robust_z(df: DataFrame, by: Sequence[str], value: str, name: str, limit: float) -> DataFrame:
    """(x - median) / (1.4826 MAD), scale 1 for a MAD up to 1e-9, cut at ±limit."""
    centre = df.groupBy(*by).agg(F.median(value).alias("__gw_m"))
    off = df.join(centre, list(by))
    scale = off.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("__gw_m"))).alias("__gw_s"))
    z = (F.col(value) - F.col("__gw_m")) / F.when(F.col("__gw_s") > 1e-9, 1.4826 * F.col("__gw_s")).otherwise(1.0)
    return off.join(scale, list(by)).withColumn(name, F.greatest(F.lit(-limit), F.least(F.lit(limit), z))).drop("__gw_m", "__gw_s")


def z_score(df: DataFrame, by: Sequence[str], value: str, name: str, eps: float = 1e-8, flat_is_zero: bool = False) -> DataFrame:
    """Population z-score; a flat series keeps scale 1, or becomes 0."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("__gw_m"), F.stddev_pop(value).alias("__gw_s"))
    flat = F.col("__gw_s") < eps
    z = (F.col(value) - F.col("__gw_m")) / F.when(flat, 1.0).otherwise(F.col("__gw_s"))
    return df.join(stats, list(by)).withColumn(name, F.when(flat, 0.0).otherwise(z) if flat_is_zero else z).drop("__gw_m", "__gw_s")


def iqr_score(df: DataFrame, by: Sequence[str], value: str, name: str, limit: float = 5.0, eps: float = 1e-8) -> DataFrame:
    """(x - median) / (IQR / 1.349), cut at ±limit."""
    stats = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__gw_q"))
    scale = (F.col("__gw_q")[2] - F.col("__gw_q")[0]) / 1.349
    z = (F.col(value) - F.col("__gw_q")[1]) / F.when(scale < eps, 1.0).otherwise(scale)
    return df.join(stats, list(by)).withColumn(name, F.greatest(F.lit(-limit), F.least(F.lit(limit), z))).drop("__gw_q")


def detrend(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    line = df.groupBy(*by).agg(F.regr_slope(value, order).alias("__gw_a"), F.regr_intercept(value, order).alias("__gw_b"))
    return df.join(line, list(by)).withColumn(name, F.col(value) - (F.coalesce("__gw_a", F.lit(0.0)) * F.col(order) + F.coalesce("__gw_b", F.col(value)))).drop("__gw_a", "__gw_b")


def average_reference(df: DataFrame, frame: Sequence[str], value: str, name: str) -> DataFrame:
    """Subtract the mean over channels of each sample."""
    mean = df.groupBy(*frame).agg(F.avg(value).alias("__gw_m"))
    return df.join(mean, list(frame)).withColumn(name, F.col(value) - F.col("__gw_m")).drop("__gw_m")


def resample(df: DataFrame, by: Sequence[str], idx: str, value: str, length: int) -> DataFrame:
    """(by, k, value): linear interpolation on a grid of ``length`` points over the series' samples.

    Each sample holds the grid points from itself to the next sample, so the join is local: a sample
    yields the points that fall to it.
    """
    n = df.groupBy(*by).agg(F.count("*").alias("__gw_n"))
    w = _w(by, idx)
    pieces = df.join(n, list(by)).withColumns({"__gw_i": F.row_number().over(w) - 1, "__gw_next": F.lead(value).over(w)})
    step = (F.col("__gw_n") - 1) / (length - 1)
    last = F.col("__gw_i") == F.col("__gw_n") - 1
    low = F.when(F.col("__gw_n") == 1, 0).when(last, length - 1).otherwise(F.ceil(F.col("__gw_i") / step - 1e-9))
    high = F.when(last, length - 1).otherwise(F.least(F.lit(length - 2), F.ceil((F.col("__gw_i") + 1) / step - 1e-9) - 1))
    points = pieces.withColumns({"__gw_lo": low.cast("int"), "__gw_hi": high.cast("int"), "__gw_step": step}).filter("__gw_lo <= __gw_hi").withColumn("k", F.explode(F.sequence("__gw_lo", "__gw_hi")))
    part = F.col("k") * F.col("__gw_step") - F.col("__gw_i")
    return points.select(*by, "k", F.when(F.col("__gw_next").isNull(), F.col(value)).otherwise(F.col(value) + part * (F.col("__gw_next") - F.col(value))).alias(value))


def resample_rate(df: DataFrame, by: Sequence[str], clock: str, value: str, rate: float) -> DataFrame:
    """(by, k, t, value): linear interpolation to ``rate`` a second from the first clock on;
    max(2, round(duration * rate) + 1) points, times held inside the recording."""
    ends = df.groupBy(*by).agg(F.min(clock).alias("__gw_t0"), F.max(clock).alias("__gw_t1"))
    w = _w(by, clock)
    pieces = df.join(ends, list(by)).withColumns({"__gw_nt": F.lead(clock).over(w), "__gw_nv": F.lead(value).over(w)})
    count = F.greatest(F.lit(2), (F.round((F.col("__gw_t1") - F.col("__gw_t0")) * rate) + 1).cast("int"))
    a, b = (F.col(clock) - F.col("__gw_t0")) * rate, (F.col("__gw_nt") - F.col("__gw_t0")) * rate
    last = F.col("__gw_nt").isNull()
    low = F.ceil(a - 1e-9).cast("int")
    high = F.when(last, count - 1).otherwise(F.least(count - 1, (F.ceil(b - 1e-9) - 1).cast("int")))
    points = pieces.withColumns({"__gw_lo": low, "__gw_hi": high}).filter("__gw_lo <= __gw_hi").withColumn("k", F.explode(F.sequence("__gw_lo", "__gw_hi")))
    t = F.least(F.col("__gw_t1"), F.col("__gw_t0") + F.col("k") / rate)
    share = (t - F.col(clock)) / (F.col("__gw_nt") - F.col(clock))
    return points.select(*by, "k", t.alias("t"), F.when(last, F.col(value)).otherwise(F.col(value) + share * (F.col("__gw_nv") - F.col(value))).alias(value))


def at_fraction(df: DataFrame, by: Sequence[str], idx: str, value: str, wanted: DataFrame, at: str) -> DataFrame:
    """``wanted`` (by, at: fractional index) with the interpolated value, by joins on floor and ceiling."""
    lo = df.select(*by, F.col(idx).cast("long").alias("__gw_lo"), F.col(value).alias("__gw_a"))
    hi = df.select(*by, F.col(idx).cast("long").alias("__gw_hi"), F.col(value).alias("__gw_b"))
    on = wanted.withColumns({"__gw_lo": F.floor(at), "__gw_hi": F.ceil(at)}).join(lo, [*by, "__gw_lo"]).join(hi, [*by, "__gw_hi"])
    return on.withColumn(value, F.col("__gw_a") + (F.col(at) - F.col("__gw_lo")) * (F.col("__gw_b") - F.col("__gw_a"))).drop("__gw_lo", "__gw_hi", "__gw_a", "__gw_b")


def _products(p: np.ndarray, q: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sum of p at i times q at j over all i - j of ``at``, by one Fourier product."""
    return np.fft.irfft(np.fft.rfft(p, size) * np.conj(np.fft.rfft(q, size)), size)[at % size]


def lag_table(x: np.ndarray, y: np.ndarray, shift: int, reach: int) -> dict[str, np.ndarray]:
    """For each lag up to ``reach`` over which ``x`` and ``y`` (nan: no sample) overlap: the sum of products, the
    overlap, and the correlation over the overlap, nan under four samples or for a flat side.

    ``x`` begins ``shift`` samples after ``y``. Sums over overlaps come from prefix sums; where samples
    are missing, from Fourier products with the other side's mask.
    """
    size = 1 << int(len(x) + len(y)).bit_length()
    lags = np.arange(max(-reach, shift - len(y) + 1), min(reach, shift + len(x) - 1) + 1)
    at = lags - shift
    there = [~np.isnan(v) for v in (x, y)]
    a, b = np.nan_to_num(x), np.nan_to_num(y)
    total = _products(a, b, at, size)
    if there[0].all() and there[1].all():
        low, high = np.maximum(at, 0), np.minimum(at + len(y), len(x))  # places in x that meet y
        n = high - low
        upto = lambda v: np.r_[0.0, np.cumsum(v)]
        part = lambda v, move: upto(v)[high - move] - upto(v)[low - move]
        sums = [part(a, 0), part(a * a, 0), part(b, at), part(b * b, at)]
    else:
        m, k = (t * 1.0 for t in there)
        n = np.rint(_products(m, k, at, size)).astype(int)
        sums = [_products(a, k, at, size), _products(a * a, k, at, size), _products(m, b, at, size), _products(m, b * b, at, size)]
    ok = np.maximum(n, 1)
    spread = [np.maximum(q - s * s / ok, 0) for s, q in (sums[:2], sums[2:])]
    scale = np.sqrt(spread[0]) * np.sqrt(spread[1])
    flat = (spread[0] <= 1e-12 * np.maximum(sums[1], 1)) | (spread[1] <= 1e-12 * np.maximum(sums[3], 1)) | (scale <= 1e-12)
    r = (total - sums[0] * sums[2] / ok) / np.where(flat, 1.0, scale)
    met = n > 0
    return {"lag": lags[met], "total": total[met], "overlap": n[met], "r": np.where((n < 4) | flat, np.nan, np.clip(r, -1, 1))[met]}


_LAGS = "array<struct<lag:int,score:double,overlap:long,total:double,r:double>>"


def _lag_products(reach: int):
    """:func:`lag_table` of pairs of dense series that begin at given sample numbers."""

    def run(a0: pd.Series, a: pd.Series, b0: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for i, x, j, y in zip(a0, a, b0, b):
            t = lag_table(np.asarray(x, float), np.asarray(y, float), int(i - j), reach)
            columns = zip(t["lag"].tolist(), t["total"].tolist(), t["overlap"].tolist(), t["r"].tolist())
            out.append([{"lag": k, "score": s / m, "overlap": m, "total": s, "r": r} for k, s, m, r in columns])
        return pd.Series(out)

    return run


def _dense(df: DataFrame, by: Sequence[str], idx: str, value: str, start: str, name: str) -> DataFrame:
    """(by, start, name): each series as an array from its first sample number on, null where one is missing."""
    held = df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(idx).cast("long"), F.col(value).cast("double")))).alias("m"), F.min(idx).cast("long").alias(start), F.max(idx).cast("long").alias("__gw_z"))
    return held.select(*by, start, F.transform(F.sequence(start, "__gw_z"), lambda i: F.try_element_at("m", i)).alias(name))


def lag_scores(a: DataFrame, b: DataFrame, by: Sequence[str], idx: str, value: str, reach: int) -> DataFrame:
    """(by, lag, score, overlap, total, r) of a at i against b at i - lag, for lags up to ``reach``: sum of
    products (total) and their mean (score) over the overlap, and the centred correlation there (r; nan under four
    samples or for a flat side). Both series of a key meet as arrays and all lags come from one Fourier
    product, so the work does not grow with the reach; a series' length bounds what a task holds."""
    small_batches(a.sparkSession)
    pair = _dense(a, by, idx, value, "__gw_i", "__gw_a").join(_dense(b, by, idx, value, "__gw_j", "__gw_b"), list(by))
    score = F.pandas_udf(_lag_products(reach), _LAGS)
    return pair.select(*by, F.inline(score("__gw_i", "__gw_a", "__gw_j", "__gw_b")))


def best_lag(scores: DataFrame, by: Sequence[str], least: float = 0.2) -> DataFrame:
    """(by, lag, peak, fallback) of each group of ``scores``: the lag of the greatest sum of products, the
    smallest of equals, and the correlation there. A peak that is nan or under ``least`` is weak: its lag is 0.

    The sum and not the mean chooses: a short overlap has a large mean by chance.
    """
    best = scores.groupBy(*by).agg(F.max_by(F.struct("lag", "r"), F.struct("total", -F.col("lag"))).alias("b"))
    weak = F.isnan("b.r") | (F.col("b.r") < least)
    return best.select(*by, F.when(weak, 0).otherwise(F.col("b.lag")).alias("lag"), F.col("b.r").alias("peak"), weak.alias("fallback"))


def common_window(df: DataFrame, by: Sequence[str], stream: str, t: str, lags: DataFrame) -> DataFrame:
    """Rows of all streams inside the time that they share, from 0 on.

    ``lags`` (by, stream, lag in seconds): how much later the stream started; its clock moves by it.
    """
    moved = df.join(lags, [*by, stream], "left").withColumn(t, F.col(t) + F.coalesce("lag", F.lit(0.0))).drop("lag")
    span = moved.groupBy(*by, stream).agg(F.min(t).alias("a"), F.max(t).alias("b")).groupBy(*by).agg(F.max("a").alias("__gw_a"), F.min("b").alias("__gw_b"))
    return moved.join(span, list(by)).filter(F.col(t).between(F.col("__gw_a"), F.col("__gw_b"))).withColumn(t, F.col(t) - F.col("__gw_a")).drop("__gw_a", "__gw_b")


def truncate_to_shortest(df: DataFrame, by: Sequence[str], stream: str, t: str) -> DataFrame:
    shortest = df.groupBy(*by, stream).agg(F.max(t).alias("b")).groupBy(*by).agg(F.min("b").alias("__gw_b"))
    return df.join(shortest, list(by)).filter(F.col(t) <= F.col("__gw_b")).drop("__gw_b")


def pooled(features: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """Mean vector of a subject, as an array in the order of positions."""
    long = features.select(*by, F.posexplode(vector).alias("__gw_p", "__gw_v")).groupBy(*by, "__gw_p").agg(F.avg("__gw_v").alias("__gw_v"))
    return long.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__gw_p", "__gw_v"))), lambda s: s["__gw_v"]).alias(vector))


def rms(value: Column) -> Column:
    return F.sqrt(F.avg(value * value))
