"""Transforms by name, and as table functions of SQL.

:func:`register` makes table functions known to a session. Each takes one table argument whose partitions are series
or trials, as in

    SELECT * FROM gait_band_powers(TABLE(SELECT series, idx, value, rate FROM signals) PARTITION BY series)

Rows come as Arrow batches, in any order; a partition is held whole, as by the DataFrame functions of the same work.
A rate, reach or strategy is a column of the table, the same in all rows of a partition. ``series`` is a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf

from gaitwright.operators import alignment as L
from gaitwright.operators import kernels as K
from gaitwright.operators import recordings as R
from gaitwright.operators import series as S

#: DataFrame functions by name, for ``df.transform(by_name(...))``.
TRANSFORMS: dict[str, Callable[..., DataFrame]] = {
    "difference": S.difference, "moving_average": S.moving_average, "running_max": S.running_max, "strip_padding": S.strip_padding, "sample_rate": S.sample_rate, "hudgins": S.hudgins,
    "time_features": S.time_features, "robust_z": S.robust_z, "z_score": S.z_score, "iqr_score": S.iqr_score, "detrend": S.detrend, "average_reference": S.average_reference,
    "resample": S.resample, "resample_rate": S.resample_rate, "pooled": S.pooled, "band_powers": K.spectral_features, "zero_phase": R.zero_phase, "clean_eeg": R.clean_eeg,
    "clean_emg": R.clean_emg, "clean_imu": R.clean_imu, "power_envelope": R.power_envelope, "trial_rows": L.trial_rows, "align": L.aligned_trials, "load_trials": L.load_trials,
}


def by_name(name: str, /, **settings: object) -> Callable[[DataFrame], DataFrame]:
    """The transform of this name with its settings, ready for ``DataFrame.transform``."""
    if name not in TRANSFORMS:
        raise ValueError(f"no transform {name!r}; there are {', '.join(sorted(TRANSFORMS))}")
    return lambda df: TRANSFORMS[name](df, **settings)


class _Partition:
    """Gathers a partition's batches; :meth:`made` gives its rows as columns."""

    def __init__(self) -> None:
        self._held: list[pa.RecordBatch] = []

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        self._held.append(batch)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        held = [b for b in self._held if len(b)]
        if held:
            yield self.made(pa.Table.from_batches(held))

    def made(self, part: pa.Table) -> pa.Table:
        raise NotImplementedError


def _one(part: pa.Table, column: str):
    return part.column(column)[0].as_py()


def _series(part: pa.Table) -> np.ndarray:
    order = np.argsort(part.column("idx").to_numpy(), kind="stable")
    return part.column("value").cast(pa.float64()).to_numpy()[order]


class BandPowers(_Partition):
    """(series, idx, value, rate) to the five band powers of each series."""

    def made(self, part: pa.Table) -> pa.Table:
        powers = K.band_powers(_series(part), float(_one(part, "rate")))
        return pa.table({"series": pa.array([_one(part, "series")], pa.string()), **{b: pa.array([powers[b]], pa.float64()) for b in K.BANDS}})


class BestLag(_Partition):
    """(series, side, idx, value, reach), sides a and b, idx from 0 on, to the lag of a behind b and the peak there."""

    def made(self, part: pa.Table) -> pa.Table:
        x, y = (_series(part.filter(pc.equal(part.column("side"), s))) for s in "ab")
        lag, peak = 0, float("nan")
        if len(x) and len(y):
            table = S.lag_table(x, y, 0, int(_one(part, "reach")))
            best = int(np.argmax(table["total"]))
            lag, peak = int(table["lag"][best]), float(table["r"][best])
        weak = not peak >= L.SYNC_LEAST
        return pa.table({"series": pa.array([_one(part, "series")], pa.string()), "lag": pa.array([0 if weak else lag], pa.int32()), "peak": pa.array([peak], pa.float64()), "fallback": pa.array([weak])})


class Align(_Partition):
    """(series, modality, channel, idx, value, strategy) to the aligned signals (series, modality, channel, k, value); a
    trial that is none gives no row."""

    def made(self, part: pa.Table) -> pa.Table:
        names, out = {}, {k: [] for k in ("modality", "channel", "k", "value")}
        try:
            x = {m: L.pivoted(part.filter(pc.equal(part.column("modality"), m))) for m in L.MODALITIES}
            names = {m: c for m, (_, c) in x.items()}
            signals, _ = L.align_trial(*(x[m][0] for m in L.MODALITIES), _one(part, "strategy"), L.RUNTIME)
        except ValueError:
            signals = {}
        for m, values in signals.items():
            out["modality"] += [m] * values.size
            out["channel"] += np.repeat(names[m], values.shape[1]).tolist()
            out["k"] += list(range(values.shape[1])) * len(values)
            out["value"] += values.ravel().tolist()
        kinds = {"modality": pa.string(), "channel": pa.string(), "k": pa.int32(), "value": pa.float64()}
        return pa.table({"series": pa.array([_one(part, "series")] * len(out["k"]), pa.string()), **{c: pa.array(out[c], t) for c, t in kinds.items()}})


class KnotAlignment(_Partition):
    """(series, modality, channel, idx, value) to what the knot alignment of each trial tells."""

    told = ("alignment_score", "feature_correlation", "path_expansion", "dtw_avg_cost")

    def made(self, part: pa.Table) -> pa.Table:
        try:
            x = [L.pivoted(part.filter(pc.equal(part.column("modality"), m)))[0] for m in L.MODALITIES]
            found = L.align_trial(*x, "knot", L.RUNTIME)[1]
        except ValueError as e:
            found = {"warning": str(e)[:160]}
        numbers = {c: pa.array([found.get(c)], pa.float64()) for c in self.told}
        return pa.table({"series": pa.array([_one(part, "series")], pa.string()), **numbers, **{c: pa.array([found.get(c)], pa.string()) for c in ("fallback", "warning")}})


TABLE_FUNCTIONS = {
    "gait_band_powers": (BandPowers, "series string, " + ", ".join(f"{b} double" for b in K.BANDS)),
    "gait_best_lag": (BestLag, "series string, lag int, peak double, fallback boolean"),
    "gait_align": (Align, "series string, modality string, channel string, k int, value double"),
    "gait_knot_alignment": (KnotAlignment, "series string, " + ", ".join(f"{c} double" for c in KnotAlignment.told) + ", fallback string, warning string"),
}


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session; a name that is known is taken over."""
    for name, (kind, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, arrow_udtf(kind, returnType=schema))
