"""Zero-phase filters and cleaning chains on recordings that are longer than a task can hold.

Frames are (by, idx, value) with idx from 0 on, without gaps. A series is cut into chunks, and a chunk is
the largest thing that a task holds of it.

A cascade of sections is one linear system: the state after a chunk is a power of its matrix times
the state before it, plus what the chunk gives from rest. So each chunk is first run from rest; what
that leaves, a few numbers a chunk, is folded along the series in groups of ``FOLD`` chunks, and
groups of groups, which gives every chunk its true start; then chunks are filtered alone. The way
back does the same in the other direction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitwright.session import cut

from . import order as O
from .kernels import band_sections, edge_size, notch, run_section, steady_state

CHUNK = 1 << 14  #: samples
FOLD = 1 << 10  #: chunks that one task folds


class Cascade:
    """Sections in a row as one system with two numbers of state for each."""

    def __init__(self, sections: np.ndarray):
        self.sections = np.asarray(sections, float)
        size = 2 * len(self.sections)
        self.step = np.zeros((size, size))
        feed = np.zeros(size)  # what a section's input takes from the states before it
        for i, (b0, b1, b2, a1, a2) in enumerate(self.sections):
            own = slice(2 * i, 2 * i + 2)
            self.step[own] = np.outer([b1 - a1 * b0, b2 - a2 * b0], feed)
            self.step[own, own] += [[-a1, 1], [-a2, 0]]
            feed = b0 * feed
            feed[2 * i] += 1
        self.rest = np.zeros(size)

    def steady(self, value: float) -> np.ndarray:
        """The state that a constant leaves."""
        out = []
        for c in self.sections:
            state, gain = steady_state(c)
            out.append(state * value)
            value *= gain
        return np.concatenate(out)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = []
        for c, own in zip(self.sections, np.asarray(state, float).reshape(-1, 2)):
            x, end = run_section(x, c, own)
            after.append(end)
        return x, np.concatenate(after)


def _power(cascade: Cascade):
    return cache(lambda n: np.linalg.matrix_power(cascade.step, n))


def _keys(df: DataFrame, by: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)


def _starts(sums: DataFrame, first: DataFrame, by: Sequence[str], cascade: Cascade, chunks: int, fold: int) -> DataFrame:
    """(by, chunk, start) from ``sums`` (by, chunk, n, gives: the state after the chunk from rest) and
    ``first`` (by, start): the state before chunk 0. ``chunks``: of the longest series."""
    names, kinds = list(by), _keys(sums, by)
    grouped = sums.withColumn("__gw_group", F.expr(f"chunk div {fold}"))
    if chunks <= fold:
        starts = first.withColumn("__gw_group", F.lit(0).cast("long"))
    else:

        def whole(part: pd.DataFrame) -> pd.DataFrame:
            power, state = _power(cascade), cascade.rest
            part = part.sort_values("chunk")
            for n, gives in zip(part["n"], part["gives"]):
                state = power(int(n)) @ state + gives
            row = {c: part[c].iloc[0] for c in names}
            return pd.DataFrame([{**row, "chunk": int(part["__gw_group"].iloc[0]), "n": int(part["n"].sum()), "gives": state.tolist()}])

        upper = cut(grouped.groupBy(*names, "__gw_group").applyInPandas(whole, f"{kinds}, chunk long, n long, gives array<double>"))
        starts = _starts(upper, first, by, cascade, -(-chunks // fold), fold).withColumnRenamed("chunk", "__gw_group")

    def each(part: pd.DataFrame) -> pd.DataFrame:
        power, out = _power(cascade), []
        part = part.sort_values("chunk")
        state = np.asarray(part["start"].iloc[0], float)
        for n, gives in zip(part["n"], part["gives"]):
            out.append(state.tolist())
            state = power(int(n)) @ state + gives
        return part[[*names, "chunk"]].assign(start=out)

    return grouped.join(starts, [*names, "__gw_group"]).groupBy(*names, "__gw_group").applyInPandas(each, f"{kinds}, chunk long, start array<double>")


def _one_way(chunks: DataFrame, by: Sequence[str], cascade: Cascade, most: int, fold: int) -> DataFrame:
    """``chunks`` (by, chunk, x) filtered in order of chunk, as a checkpoint."""
    names, kinds = list(by), _keys(chunks, by)

    def from_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            gives = [cascade.run(np.asarray(x, float), cascade.rest)[1].tolist() for x in part["x"]]
            yield part[[*names, "chunk"]].assign(n=[len(x) for x in part["x"]], gives=gives)

    def from_start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            done = [cascade.run(np.asarray(x, float), s)[0].tolist() for x, s in zip(part["x"], part["start"])]
            yield part[[*names, "chunk"]].assign(x=done)

    unit = [float(v) for v in cascade.steady(1.0)]  # the steady state is in proportion to the value
    first = chunks.filter("chunk = 0").select(*names, F.array(*(F.col("x")[0] * v for v in unit)).alias("start"))
    starts = first.withColumn("chunk", F.lit(0).cast("long"))
    if most > 1:  # only series of several chunks are folded
        several = chunks.filter("chunk > 0").select(*names).distinct()
        sums = cut(chunks.join(several, names, "left_semi").mapInPandas(from_rest, f"{kinds}, chunk long, n long, gives array<double>"))
        folded = _starts(sums, first.join(several, names, "left_semi"), by, cascade, most, fold)
        starts = starts.join(several, names, "left_anti").unionByName(folded.select(*starts.columns))
    return cut(chunks.join(starts, [*names, "chunk"]).mapInPandas(from_start, f"{kinds}, chunk long, x array<double>"))


def zero_phase(df: DataFrame, by: Sequence[str], value: str, sections: np.ndarray, chunk: int = CHUNK, fold: int = FOLD) -> DataFrame:
    """(by, idx, value) filtered forward and backward, ends carried on by odd reflection, as
    ``kernels.zero_phase`` does on one array. A series of one sample stays as it is.

    Runs a few jobs at once and keeps checkpoints of the chunks.
    """
    names, cascade = list(by), Cascade(sections)
    if not len(cascade.sections):
        return df.select(*names, "idx", value)
    edge = edge_size(cascade.sections)
    rows = df.select(*names, F.col("idx").cast("long").alias("idx"), F.col(value).cast("double").alias("v"))
    ends = rows.groupBy(*names).agg(F.max("idx").alias("last"), F.min_by("v", "idx").alias("v0"), F.max_by("v", "idx").alias("v1")).withColumn("m", F.least("last", F.lit(edge)))
    at = lambda place, v: F.struct(place.alias("at"), v.alias("v"))
    i, last, m = F.col("idx"), F.col("last"), F.col("m")
    left = F.when((i >= 1) & (i <= m), at(m - i, 2 * F.col("v0") - F.col("v")))
    right = F.when((i < last) & (i >= last - m), at(2 * last - i + m, 2 * F.col("v1") - F.col("v")))
    longer = rows.join(ends, names).select(*names, "last", "m", "v0", F.inline(F.array_compact(F.array(at(i + m, F.col("v")), left, right))))
    place = F.expr(f"at div {chunk}")
    backwards = F.expr(f"(last + 2 * m) div {chunk}") - place  # from the last chunk on
    packed = longer.groupBy(*names, place.alias("chunk"), backwards.alias("back"), "m", "last", "v0").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("x"))
    packed = cut(packed)
    most = packed.agg(F.max("chunk")).first()[0]
    if most is None:
        return df.select(*names, "idx", value)
    forward = _one_way(packed.select(*names, "chunk", "x"), by, cascade, most + 1, fold)
    turned = forward.join(packed.select(*names, "chunk", "back"), [*names, "chunk"]).select(*names, F.col("back").alias("chunk"), F.reverse("x").alias("x"))
    done = _one_way(turned, by, cascade, most + 1, fold)
    placed = done.withColumnRenamed("chunk", "back").join(packed.select(*names, "chunk", "back", "m", "last", "v0"), [*names, "back"])
    out = placed.select(*names, "m", "last", "v0", F.posexplode(F.reverse("x")).alias("p", "v"), F.col("chunk")).withColumn("idx", F.col("chunk") * chunk + F.col("p") - F.col("m"))
    return out.filter((F.col("idx") >= 0) & (F.col("idx") <= F.col("last"))).select(*names, "idx", F.when(F.col("last") == 0, F.col("v0")).otherwise(F.col("v")).alias(value))


def detrended(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, idx, value) less its straight line; a single sample becomes 0."""
    names = list(by)
    line = df.groupBy(*names).agg(F.regr_slope(value, "idx").alias("__gw_a"), F.regr_intercept(value, "idx").alias("__gw_b"), F.avg(value).alias("__gw_m"))
    rest = F.col(value) - F.coalesce(F.col("__gw_a") * F.col("idx") + F.col("__gw_b"), F.col("__gw_m"))
    return df.join(line, names).select(*names, "idx", rest.alias(value))


def robust(df: DataFrame, by: Sequence[str], value: str, limit: float) -> DataFrame:
    """(by, idx, value): distance from the median in 1.4826 MAD, cut at ±limit; medians by ranges of values."""
    names = list(by)
    off = cut(df.join(O.medians(df, names, value, "__gw_c"), names).select(*names, "idx", (F.col(value) - F.col("__gw_c")).alias(value)))
    spread = O.medians(off.select(*names, F.abs(value).alias("__gw_d")), names, "__gw_d", "__gw_s")
    z = F.col(value) / F.when(F.col("__gw_s") > 1e-9, 1.4826 * F.col("__gw_s")).otherwise(1.0)
    return off.join(spread, names).select(*names, "idx", F.greatest(F.lit(-limit), F.least(F.lit(limit), z)).alias(value))


def _finite(value: str) -> Column:
    v = F.col(value).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v).alias(value)


def _hum(df: DataFrame, by: Sequence[str], value: str, rate: float, mains: float | None, chunk: int) -> DataFrame:
    return zero_phase(df, by, value, notch(mains, 30, rate), chunk) if mains and mains < rate / 2 else df


def clean_eeg(df: DataFrame, by: Sequence[str], value: str, rate: float, mains: float | None = 50.0, chunk: int = CHUNK) -> DataFrame:
    """Line taken out, mains notch, 1 to 45 Hz, robust scale; equal to ``kernels.clean_eeg`` of each series."""
    y = detrended(df.select(*by, "idx", _finite(value)), by, value)
    y = zero_phase(_hum(y, by, value, rate, mains, chunk), by, value, band_sections(1, 45, rate), chunk)
    return robust(y, by, value, 6)


def clean_emg(df: DataFrame, by: Sequence[str], value: str, rate: float, mains: float | None = 50.0, chunk: int = CHUNK) -> DataFrame:
    """Mains notch, 20 to 450 Hz, rectified, 6 Hz envelope, robust scale."""
    y = _hum(df.select(*by, "idx", _finite(value)), by, value, rate, mains, chunk)
    y = zero_phase(y, by, value, band_sections(20, min(450, 0.99 * rate / 2), rate), chunk)
    y = zero_phase(y.withColumn(value, F.abs(value)), by, value, band_sections(None, 6, rate), chunk)
    return robust(y, by, value, 8)


def clean_imu(df: DataFrame, by: Sequence[str], value: str, rate: float, chunk: int = CHUNK) -> DataFrame:
    """Line taken out, 20 Hz low-pass, robust scale."""
    y = detrended(df.select(*by, "idx", _finite(value)), by, value)
    return robust(zero_phase(y, by, value, band_sections(None, 20, rate), chunk), by, value, 8)


def power_envelope(df: DataFrame, by: Sequence[str], value: str, rate: float, low: float = 8, high: float = 30, smooth: float = 5, chunk: int = CHUNK) -> DataFrame:
    """Root of the smoothed power in a band; steps that the rate is too low for are left out."""
    nyquist = rate / 2
    low, high, smooth = min(low, 0.9 * nyquist), min(high, 0.95 * nyquist), min(smooth, 0.9 * nyquist)
    y = df.select(*by, "idx", F.col(value).cast("double").alias(value))
    if high > low + 1:
        y = zero_phase(y, by, value, band_sections(low, high, rate), chunk)
    y = y.withColumn(value, F.col(value) * F.col(value))
    if smooth > 0.1:
        y = zero_phase(y, by, value, band_sections(None, smooth, rate), chunk)
    return y.withColumn(value, F.sqrt(F.greatest(F.col(value), F.lit(0.0))))
