"""Trials of three modalities on one time grid, and the feature vector of a trial.

A trial is a row with ``eeg``, ``emg`` and ``imu``: arrays of samples, each an array of channels.
:func:`trial_rows` makes such rows from long signals by grouping. Alignment and features then go row
by row in ``mapInPandas`` without another shuffle; the work on one row is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitwright.session import small_batches

from .kernels import BANDS, band_pass, clean_eeg, clean_emg, clean_imu, power_envelope, robust, warp, welch
from .series import lag_table

MODALITIES = ("eeg", "emg", "imu")


@dataclass(frozen=True)
class AlignConfig:
    """Lengths, weights and gates of alignment; the defaults are fixed values."""

    output_length: int = 200
    dtw_length: int = 128
    band_radius: float = 0.15
    alpha: float = 0.7
    beta: float = 0.3
    resample_guided: bool = True
    warp_blend: float = 0.0
    max_path_expansion: float = 1.10
    quality_fallback: float = 0.0
    min_feature_correlation: float = 0.95
    emg_feature_mode: str = "rms"
    feature_combo: str = "rms_env_vel_acc"
    emg_rms_window: int = 9
    kin_smooth_window: int = 5
    slope_weight: float = 0.25
    amplitude_gamma: float = 1.0
    phase_weight: float = 0.35
    event_weight: float = 0.5
    consistency_weight: float = 0.25
    acceleration_weight: float = 0.5
    normalization: str = "zscore"
    robust_clip: float = 5.0
    eps: float = 1e-6


#: What a run uses unless it says otherwise.
RUNTIME = replace(AlignConfig(), output_length=256, dtw_length=32, band_radius=0.15)


def band_width(length: int, band: float) -> int:
    """A share of the length below 1 (one sample at least), else samples; negative bands are an error."""
    if band < 0:
        raise ValueError("a band is not negative")
    return max(1, round(band * length)) if band < 1 else round(band)


def tokens(combo: str | None) -> set[str]:
    """Feature names of "rms_env_vel_acc"; the same four for an empty text."""
    found = {t.strip().lower() for t in (combo or "").split("_")} - {""}
    return found if combo else {"rms", "env", "vel", "acc"}


# ---- parts of a signal -----------------------------------------------------------------------


def checked(name: str, x, channels: int = 1) -> np.ndarray:
    """[time, channels] with 0 for what is not finite; two samples and ``channels`` channels at least."""
    x = np.array(x, float)
    if x.ndim != 2 or x.shape[0] < 2 or x.shape[1] < channels:
        raise ValueError(f"{name} has the shape {x.shape}; 2 samples and {channels} channels are needed")
    return np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)


def stretched(x: np.ndarray, length: int) -> np.ndarray:
    """All channels at ``length`` evenly spread places."""
    return at_places(x, np.linspace(0, len(x) - 1, length))


def at_places(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """All channels at fractional sample numbers."""
    low = np.clip(np.floor(places).astype(int), 0, len(x) - 1)
    high = np.minimum(low + 1, len(x) - 1)
    return x[low] + (places - low)[:, None] * (x[high] - x[low])


def normalised(x: np.ndarray, c: AlignConfig) -> np.ndarray:
    """Channels by mean and population SD, or by median and IQR with a limit; flat ones keep scale 1."""
    if c.normalization == "zscore":
        scale, centre, limit = x.std(axis=0), x.mean(axis=0), np.inf
    elif c.normalization == "robust":
        low, centre, high = np.percentile(x, (25, 50, 75), axis=0)
        scale, limit = (high - low) / 1.349, c.robust_clip if c.robust_clip > 0 else np.inf
    else:
        raise ValueError(f"unknown normalisation: {c.normalization}")
    return np.clip((x - centre) / np.where(scale < c.eps, 1.0, scale), -limit, limit)


def unit(x: np.ndarray, eps: float) -> np.ndarray:
    return (x - x.mean()) / x.std() if x.std() >= eps else np.zeros(len(x))


def smooth(x: np.ndarray, k: int) -> np.ndarray:
    """Centred mean with repeated edges."""
    return np.convolve(np.pad(x, (k // 2, k - 1 - k // 2), "edge"), np.full(k, 1 / k), "valid") if k > 1 else x


def step(x: np.ndarray) -> np.ndarray:
    return np.diff(x, axis=0, prepend=x[:1])


def path_correlation(a: np.ndarray, b: np.ndarray, eps: float) -> float:
    a, b = a - a.mean(), b - b.mean()
    below = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / below) if below > eps else 0.0


# ---- strategies ------------------------------------------------------------------------------


def peripheral_curves(emg: np.ndarray, imu: np.ndarray, c: AlignConfig) -> tuple[np.ndarray, np.ndarray]:
    """Muscle envelope against movement speed, each with its change, 0.7 to 0.3."""

    def mixed(level: np.ndarray) -> np.ndarray:
        parts = (level, np.abs(step(level)))
        level, change = (unit(smooth(p, 5) if len(p) > 2 else p, c.eps) for p in parts)
        return unit(0.7 * level + 0.3 * change, c.eps)

    return mixed(np.abs(normalised(emg, c)).mean(axis=1)), mixed(np.linalg.norm(step(normalised(imu, c)), axis=1))


def knot_places(emg: np.ndarray, imu: np.ndarray, c: AlignConfig, strength: float = 0.01, most: float = 0.08, least_corr: float = -0.2, most_stretch: float = 1.85) -> tuple[list[np.ndarray], dict]:
    """Sample numbers of both streams for an output grid bent by coarse warping knots, and what the
    path tells. A path that correlates badly or stretches too much leaves the plain grid."""
    length, coarse = c.output_length, int(np.clip(c.dtw_length, 8, 96))
    plain = [np.linspace(0, len(x) - 1, length) for x in (emg, imu)]
    if strength <= 0:
        return plain, {}
    a, b = peripheral_curves(stretched(emg, coarse), stretched(imu, coarse), c)
    path, cost = warp((a[:, None] - b) ** 2, band_width(coarse, c.band_radius))
    corr, stretch = path_correlation(a[path[:, 0]], b[path[:, 1]], c.eps), len(path) / coarse
    told = {"feature_correlation": corr, "path_expansion": stretch, "dtw_avg_cost": cost}
    if corr < least_corr or stretch > most_stretch:
        return plain, told | {"fallback": "quality_filter"}
    knots = np.maximum.accumulate(path.sum(axis=1) / (2 * (coarse - 1)))
    knots[0], knots[-1] = 0.0, 1.0
    own = np.r_[True, np.diff(knots) > 1e-6]
    target = np.linspace(0, 1, length)
    bent = []
    for side, grid in enumerate(plain):
        top = grid[-1]
        shift = np.interp(target, knots[own], path[own, side]) * top / (coarse - 1) - grid
        bent.append(np.clip(np.maximum.accumulate(grid + strength * np.clip(shift, -most * top, most * top)), 0, top))
    return bent, told | {"alignment_score": corr - 0.1 * cost - 0.05 * max(0.0, stretch - 1)}


def muscle_curves(emg: np.ndarray, c: AlignConfig) -> dict[str, np.ndarray]:
    x, use = normalised(emg, c), tokens(c.feature_combo)
    if c.emg_feature_mode not in ("rms", "mean_abs"):
        raise ValueError(f"unknown EMG feature: {c.emg_feature_mode}")
    size = np.abs(x).mean(axis=1)
    main = unit(smooth(np.sqrt((x**2).mean(axis=1) + c.eps) if c.emg_feature_mode == "rms" else size, c.emg_rms_window), c.eps)
    out = {"main": main} | ({"env": unit(smooth(size, c.emg_rms_window), c.eps)} if "env" in use else {})
    return out | _changes(main, use, c.emg_rms_window, c)


def movement_curves(kin: np.ndarray, c: AlignConfig) -> dict[str, np.ndarray]:
    x, use = normalised(kin, c), tokens(c.feature_combo)
    curve = lambda rows: unit(smooth(np.linalg.norm(rows, axis=1), c.kin_smooth_window), c.eps)
    vel, acc = curve(step(x)), curve(step(step(x)))
    parts = [(0.5, vel)] * ("vel" in use) + [(0.3, curve(x - np.median(x, axis=0)))] * bool({"disp", "pos"} & use) + [(c.acceleration_weight, acc)] * ("acc" in use)
    parts = parts or [(1.0, vel)]
    main = unit(sum(w * p for w, p in parts) / max(sum(w for w, _ in parts), c.eps), c.eps)
    out = {"main": main} | ({"vel": vel} if "vel" in use else {}) | ({"acc": acc} if "acc" in use else {})
    return out | _changes(main, use, c.kin_smooth_window, c)


def _changes(main: np.ndarray, use: set[str], window: int, c: AlignConfig) -> dict[str, np.ndarray]:
    out = {}
    if {"slope", "phase"} & use:
        out["slope"] = unit(step(main), c.eps)
    if {"event", "peak"} & use:
        out["event"] = unit(smooth(np.abs(step(main)), max(3, window)), c.eps)
    return out


def warping_cost(e: dict[str, np.ndarray], k: dict[str, np.ndarray], c: AlignConfig) -> np.ndarray:
    """Cost of each pair of samples: shape and slope weighted by how salient both are, then amplitude,
    phase, events and consistency."""
    apart = lambda p, q: (p[:, None] - q[None, :]) ** 2
    we, wk = (max(w, c.eps) / (max(c.alpha, c.eps) + max(c.beta, c.eps)) for w in (c.alpha, c.beta))
    size_e, size_k = np.abs(e["main"]), np.abs(k["main"])
    salient = lambda power: we * size_e[:, None] ** power + wk * size_k[None, :] ** power
    shape = apart(e["main"], k["main"]) + c.slope_weight * apart(e.get("slope", e["main"]), k.get("slope", k["main"]))
    phase = (apart(e["event"], k["event"]) if "event" in e and "event" in k else 0.0) + (apart(size_e, np.abs(k["acc"])) if "acc" in k else 0.0)
    event = apart(e["env"], k["vel"]) if "env" in e and "vel" in k else 0.0
    amplitude = c.amplitude_gamma * (1 + salient(2)) * apart(size_e, size_k)
    return (1 + c.amplitude_gamma * salient(1)) * shape + amplitude + c.phase_weight * phase + c.event_weight * event + c.consistency_weight * apart(we * size_e, wk * size_k)


def weighted_pair(emg: np.ndarray, kin: np.ndarray, c: AlignConfig) -> tuple[np.ndarray, np.ndarray, dict]:
    """Both streams at the output length: plain resampling, blended with the warped streams by at most
    0.08 and only as far as correlation and path length allow."""
    length = c.dtw_length
    short = [stretched(x, length) for x in (emg, kin)]
    e, k = muscle_curves(short[0], c), movement_curves(short[1], c)
    cost, band = warping_cost(e, k, c), band_width(length, c.band_radius)
    path, forward = warp(cost, band, 0.0, 0.0)
    back, reverse = warp(cost[::-1, ::-1], band, 0.0, 0.0)
    both = 0.5 * (forward + reverse * len(back) / len(path))
    corr, stretch = path_correlation(e["main"][path[:, 0]], k["main"][path[:, 1]], c.eps), len(path) / length
    blend = float(np.clip(c.warp_blend, 0.0, 0.08))
    if c.resample_guided:
        gates = ((corr - c.min_feature_correlation) / max(1 - c.min_feature_correlation, c.eps), (c.max_path_expansion - stretch) / max(c.max_path_expansion - 1, c.eps))
        bad = stretch > c.max_path_expansion or corr - both < c.quality_fallback or corr < c.min_feature_correlation
        blend = 0.0 if bad else blend * float(np.prod(np.clip(gates, 0, 1)))
    out = [(1 - blend) * stretched(x, c.output_length) + blend * stretched(s[path[:, i]], c.output_length) for i, (x, s) in enumerate(zip((emg, kin), short))]
    return *out, {"feature_correlation": corr, "path_expansion": stretch, "dtw_avg_cost": both, "alignment_score": corr - both}


#: Names of the strategies; fixed values.
STRATEGIES = {
    "resample": ("none", "tri_none", "tri_resample", "resample", "linear", "linear_resample"),
    "knot": ("tri_adk", "tri_adk_knot", "adk", "adk_resample", "adaptive_dtw_knot", "dtw_knot", "knot"),
    "flat_knot": ("adk_no_dtw", "tri_adk_no_dtw", "no_dtw", "no_wby_dtw"),
    "weighted": ("wby_dtw", "weighted"),
}


def align_trial(eeg, emg, imu, strategy: str, c: AlignConfig = RUNTIME) -> tuple[dict[str, np.ndarray], dict]:
    """The modalities as [channel, output_length], each normalised, and what the alignment tells.

    EEG never takes part in warping. A warping that fails leaves plain resampling and a ``warning``.
    """
    kind = next((k for k, names in STRATEGIES.items() if (strategy or "").lower() in names), None)
    if kind is None:
        raise ValueError(f"unknown strategy: {strategy}")
    eeg, emg, imu = (checked(n, x) for n, x in zip(MODALITIES, (eeg, emg, imu)))
    told: dict = {}
    pair = [stretched(x, c.output_length) for x in (emg, imu)]
    try:
        if kind == "weighted":
            *pair, told = weighted_pair(emg, imu, c)
        elif kind != "resample":
            places, told = knot_places(emg, imu, c, strength=0.01 if kind == "knot" else 0.0)
            pair = [at_places(x, p) for x, p in zip((emg, imu), places)]
    except (ValueError, FloatingPointError) as x:
        told = {"warning": str(x)[:160]}
    return {n: normalised(x, c).T for n, x in zip(MODALITIES, (stretched(eeg, c.output_length), *pair))}, told


# ---- loading ---------------------------------------------------------------------------------


def sync_envelopes(eeg: np.ndarray, emg: np.ndarray, eeg_rate: float, emg_rate: float, motor: Sequence[int] = (), rate: float = 100.0) -> tuple[np.ndarray, np.ndarray]:
    """Curves by which EEG and EMG are put in time: 8 to 30 Hz envelope of the motor channels (of all
    if none is given) and the 6 Hz envelope of the muscles, means over channels at ``rate``, as z-scores."""

    def curve(x: np.ndarray, own: float) -> np.ndarray:
        level = x.mean(axis=1)
        n = max(2, round((len(level) - 1) / own * rate) + 1)
        return unit(level if abs(own - rate) < 1e-6 else np.interp(np.arange(n) / rate, np.arange(len(level)) / own, level), 1e-9)

    muscles = band_pass(np.abs(emg), None, 6, emg_rate) if emg_rate > 12 else np.abs(emg)
    return curve(power_envelope(eeg[:, list(motor)] if len(motor) else eeg, eeg_rate), eeg_rate), curve(muscles, emg_rate)


def prepare_trial(eeg, emg, imu, rates: dict[str, float], preprocess: bool = True) -> dict[str, np.ndarray]:
    """Recordings cut to the shortest duration and cleaned, one modality's chain for each."""
    raw = dict(zip(MODALITIES, (checked(n, x) for n, x in zip(MODALITIES, (eeg, emg, imu)))))
    seconds = min(len(x) / rates[n] for n, x in raw.items())
    raw = {n: x[: max(1, int(seconds * rates[n]))] for n, x in raw.items()}
    chains = {"eeg": clean_eeg, "emg": clean_emg, "imu": clean_imu}
    return {n: np.stack([chains[n](ch, rates[n]) for ch in x.T], axis=1) if preprocess else x for n, x in raw.items()}


SYNC_RATE, SYNC_REACH, SYNC_LEAST = 100.0, 15.0, 0.2  #: Hz, seconds, correlation; fixed values


def common_slices(rates: dict[str, float], sizes: dict[str, int], lag: float) -> tuple[dict[str, slice], float, float, float]:
    """The samples of each modality in the time that all share, where EEG leads the other two by ``lag``
    seconds, with the starts of EEG and of the others and the seconds that are left."""
    starts = {"eeg": max(lag, 0.0)} | dict.fromkeys(("emg", "imu"), max(-lag, 0.0))
    left = max(0.0, min((sizes[m] / rates[m] if rates[m] > 0 else 0.0) - starts[m] for m in MODALITIES))
    slices = {}
    for m in MODALITIES:
        first = min(max(0, round(starts[m] * rates[m])), sizes[m])
        slices[m] = slice(first, min(first + round(left * rates[m]), sizes[m]) if left > 0 else first)
    return slices, starts["eeg"], starts["emg"], left


def synced_trial(eeg, emg, imu, rates: dict[str, float], motor: Sequence[int] = (), preprocess: bool = True) -> tuple[dict[str, np.ndarray], dict]:
    """The modalities of a recording whose devices were started apart, on one time axis and scaled, and
    what was found: lag (seconds that EMG began later), peak, fallback, starts and the common seconds.

    EEG comes filtered; EMG and IMU run through their chains first. The lag is that of the envelopes; a weak peak
    leaves it 0. A modality may end up empty if the recordings do not overlap.
    """
    raw = dict(zip(MODALITIES, (checked(n, x) for n, x in zip(MODALITIES, (eeg, emg, imu)))))
    if preprocess:
        for m, chain in (("emg", clean_emg), ("imu", clean_imu)):
            raw[m] = np.stack([chain(ch, rates[m]) for ch in raw[m].T], axis=1)
    brain, muscle = sync_envelopes(raw["eeg"], raw["emg"], rates["eeg"], rates["emg"], motor, SYNC_RATE)
    table = lag_table(muscle, brain, 0, round(SYNC_REACH * SYNC_RATE))
    best = int(np.argmax(table["total"]))
    found, peak = table["lag"][best] / SYNC_RATE, float(table["r"][best])
    weak = not peak >= SYNC_LEAST
    slices, t_eeg, t_rest, left = common_slices(rates, {m: len(x) for m, x in raw.items()}, 0.0 if weak else found)
    out = {m: x[slices[m]] for m, x in raw.items()}
    if preprocess and len(out["eeg"]):
        out["eeg"] = np.stack([robust(ch, 6) for ch in out["eeg"].T], axis=1)
    return out, {"lag": float(found), "peak": peak, "sync_fallback": weak, "eeg_start": t_eeg, "other_start": t_rest, "seconds": left}


# ---- features --------------------------------------------------------------------------------

SIZE = 630  #: of a trial of 30, 4 and 24 channels


def _moments(x: np.ndarray) -> np.ndarray:
    """Mean, SD, range, bias-corrected skew and excess kurtosis, RMS and sign changes of each row."""
    n, d = x.shape[1], x - x.mean(axis=1, keepdims=True)
    m2, m3, m4 = ((d**p).mean(axis=1) for p in (2, 3, 4))
    with np.errstate(all="ignore"):
        skew = np.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6)
    return np.stack([x.mean(axis=1), x.std(axis=1), x.min(axis=1), x.max(axis=1), skew, kurt, np.sqrt((x**2).mean(axis=1)), (np.diff(np.sign(x), axis=1) != 0).sum(axis=1)], axis=1)


def _muscle_counts(x: np.ndarray, least: float = 1e-5) -> np.ndarray:
    """Mean size, length, sign changes where both sizes add up to ``least``, and slope sign changes."""
    d, size = np.diff(x, axis=1), np.abs(x)
    crossed = (np.diff(np.sign(x), axis=1) != 0) & (size[:, 1:] + size[:, :-1] >= least)
    return np.stack([size.mean(axis=1), np.abs(d).sum(axis=1), crossed.sum(axis=1), (np.diff(np.sign(d), axis=1) != 0).sum(axis=1)], axis=1)


def _band_levels(x: np.ndarray, rate: float) -> np.ndarray:
    out = []
    for channel in x:
        freq, power = welch(channel, rate)
        own = [(freq >= lo) & (freq <= hi) for lo, hi in BANDS.values()]
        out.append([np.log1p(max(0.0, np.trapezoid(power[o], freq[o]))) for o in own])
    return np.array(out)


def trial_vector(aligned: dict[str, np.ndarray], eeg_rate: float, size: int | None = SIZE) -> np.ndarray:
    """Features of an aligned trial: eight for each channel of all modalities, five EEG bands for each EEG
    channel, four counts for each muscle. ``size`` is checked unless it is None."""
    parts = [_moments(aligned[m]) for m in MODALITIES] + [_band_levels(aligned["eeg"], eeg_rate), _muscle_counts(aligned["emg"])]
    out = np.concatenate([np.nan_to_num(p, nan=0.0, posinf=0.0, neginf=0.0).ravel() for p in parts])
    if size is not None and len(out) != size:
        raise ValueError(f"a trial has {len(out)} features, not {size}")
    return out


# ---- on frames -------------------------------------------------------------------------------


def trial_rows(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, eeg, emg, imu) of long signals (by, modality, channel, idx, value), channels by name."""
    samples = long.groupBy(*by, "modality", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda c: c["value"].cast("double")).alias("x"))
    series = samples.groupBy(*by, "modality").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"]).alias("x"))
    return series.groupBy(*by).pivot("modality", list(MODALITIES)).agg(F.first("x"))


_TOLD = ("alignment_score", "feature_correlation", "path_expansion", "dtw_avg_cost")
_FLUSH = 64  #: trials of an outgoing batch
_NESTED = pa.list_(pa.list_(pa.float64()))


def _matrix(cell: pa.ListScalar) -> np.ndarray:
    """[time, channels] of an array of samples; an error if it is null or uneven."""
    samples = cell.values
    if samples is None or not len(samples):
        raise ValueError("a modality is missing")
    flat = samples.flatten().to_numpy(zero_copy_only=False)
    if samples.null_count or len(flat) % len(samples) or (samples.value_lengths().to_numpy() != len(flat) // len(samples)).any():
        raise ValueError("samples differ in their channels")
    return flat.reshape(len(samples), -1)


def _nested(matrices: Sequence[np.ndarray | None]) -> pa.ListArray:
    """An array of arrays for each matrix, null for None."""
    held = [m for m in matrices if m is not None]
    flat = np.concatenate([np.asarray(m, float).ravel() for m in held]) if held else np.zeros(0)
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, *(np.full(len(m), m.shape[1]) for m in held)]).astype(np.int32)), pa.array(flat))
    ends = np.cumsum([0] + [0 if m is None else len(m) for m in matrices])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), inner, mask=pa.array([m is None for m in matrices])) if len(matrices) else pa.array([], _NESTED)


def _out_columns(rows: Sequence[dict], names: Sequence[str]) -> list[pa.Array]:
    made = []
    for n in names:
        cells = [r.get(n) for r in rows]
        made.append(_nested(cells) if n in MODALITIES else pa.array(cells, pa.list_(pa.float64()) if n == "vector" else pa.string() if n in ("fallback", "warning") else pa.bool_() if n == "sync_fallback" else pa.float64()))
    return made


def _kind(name: str) -> str:
    kinds = dict.fromkeys(MODALITIES, "array<array<double>>") | {"vector": "array<double>", "fallback": "string", "warning": "string", "sync_fallback": "boolean"}
    return f"{name} {kinds.get(name, 'double')}"


def aligned_trials(trials: DataFrame, by: Sequence[str], strategy: str = "knot", config: AlignConfig = RUNTIME, eeg_rate: float | None = None, size: int | None = SIZE, columns: Sequence[str] | None = None) -> DataFrame:
    """(by, eeg, emg, imu, vector, what alignment tells, fallback, warning) of trials, or only the
    ``columns`` of these that are asked for. ``vector`` is null without ``eeg_rate``. A trial that is no
    trial (a modality missing or too short) has null signals and says why in ``warning``."""
    keys = list(by)
    names = [*MODALITIES, "vector", *_TOLD, "fallback", "warning"]
    names = [n for n in names if columns is None or n in columns]

    def one(cells: list[pa.ListScalar]) -> dict:
        try:
            signals, told = align_trial(*map(_matrix, cells), strategy, config)
        except (ValueError, TypeError) as x:
            return {"warning": str(x)[:160]}
        vector = trial_vector(signals, eeg_rate, size) if eeg_rate and "vector" in names else None
        return signals | {"vector": vector} | told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, len(batch), _FLUSH):
                part = batch.slice(b, _FLUSH)
                rows = [one(list(cells)) for cells in zip(*(part.column(m) for m in MODALITIES))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *_out_columns(rows, names)], [*keys, *names])

    small_batches(trials.sparkSession, _FLUSH)
    kinds = ", ".join([*(f"`{c}` {trials.schema[c].dataType.simpleString()}" for c in keys), *map(_kind, names)])
    return trials.select(*keys, *MODALITIES).mapInArrow(run, kinds)


def pivoted(part: pa.Table) -> tuple[np.ndarray, list[str]]:
    """[time, channels] of the rows (channel, idx, value) of one signal, and the channels in order of name."""
    if not len(part):
        raise ValueError("a modality is missing")
    channels, at = np.unique(np.array(part.column("channel").to_pylist(), str), return_inverse=True)
    times, row = np.unique(part.column("idx").to_numpy(), return_inverse=True)
    x = np.full((len(times), len(channels)), np.nan)
    x[row, at] = part.column("value").cast(pa.float64()).to_numpy()
    return x, channels.tolist()


def load_trials(long: DataFrame, rates: DataFrame, by: Sequence[str], sync: bool = True, motor: Sequence[str] = (), preprocess: bool = True) -> DataFrame:
    """(by, eeg, emg, imu, lag, peak, sync_fallback, eeg_start, other_start, seconds, warning): trial rows, ready for
    :func:`aligned_trials`, of recordings ``long`` (by, modality, channel, idx, value) with ``rates`` (by,
    eeg_rate, emg_rate, imu_rate).

    With ``sync`` devices were started apart: EEG comes filtered, streams are put in time by their envelopes
    (EEG's over the ``motor`` channels, all if none is there), cut to the time they share and scaled.
    Without, they began together: they are cut to the shortest duration and each runs through its chain;
    lag, peak and starts are null. Channels are in order of name. A sample that is missing is 0. A recording
    that lacks a modality or its rates has null signals and a warning; rates without recording give no row.
    """
    keys = list(by)
    names = [*MODALITIES, "lag", "peak", "sync_fallback", "eeg_start", "other_start", "seconds", "warning"]

    def one(part: pa.Table, told: pa.Table) -> dict:
        try:
            if not len(told):
                raise ValueError("no rates")
            own = {m: float(told.column(f"{m}_rate")[0].as_py() or 0) for m in MODALITIES}
            if min(own.values()) <= 0:
                raise ValueError("a rate is missing")
            x = {m: pivoted(part.filter(pc.equal(part.column("modality"), m))) for m in MODALITIES}
            if not sync:
                out = prepare_trial(*(x[m][0] for m in MODALITIES), own, preprocess)
                return out | {"seconds": min(len(out[m]) / own[m] for m in MODALITIES)}
            picked = [i for i, c in enumerate(x["eeg"][1]) if c in motor]
            out, found = synced_trial(*(x[m][0] for m in MODALITIES), own, picked, preprocess)
            return out | found
        except ValueError as e:
            return {"warning": str(e)[:160]}

    def run(key: tuple, part: pa.Table, told: pa.Table) -> pa.Table:
        rows = [one(part, told)] if len(part) else []
        ids = [pa.array([k.as_py()] * len(rows), k.type) for k in key]
        return pa.Table.from_arrays([*ids, *_out_columns(rows, names)], [*keys, *names])

    kinds = ", ".join([*(f"`{c}` {long.schema[c].dataType.simpleString()}" for c in keys), *map(_kind, names)])
    left = long.select(*keys, "modality", "channel", F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))
    right = rates.select(*keys, *(f"{m}_rate" for m in MODALITIES))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, kinds)
