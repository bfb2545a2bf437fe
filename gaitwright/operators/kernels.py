"""Signal steps that go sample by sample: zero-phase filters, spectra and warping paths.

Each runs on one channel, or all channels, of one trial at a time; a trial's length bounds what a
task holds. Recordings of any length are filtered in ``recordings``. Frames are (by, idx, value) unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Hz; fixed values.
BANDS = {"delta": (0.5, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 45)}


def band_edges(low: float | None, high: float | None, rate: float) -> tuple[float | None, float | None]:
    """Cut-offs held between 1e-4 and 0.999 of the Nyquist frequency."""
    hold = lambda f: None if f is None else float(np.clip(f, 1e-4 * rate / 2, 0.999 * rate / 2))
    return hold(low), hold(high)


def butterworth(order: int, cut: float, rate: float, kind: str) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a digital low- or high-pass by the bilinear transform."""
    k = np.tan(np.pi * cut / rate)
    out = []
    for i in range(order // 2):
        q = 1 / (2 * np.cos(np.pi * (2 * i + 1) / (2 * order)))
        n = 1 / (1 + k / q + k * k)
        b = (k * k * n, 2 * k * k * n, k * k * n) if kind == "low" else (n, -2 * n, n)
        out.append((*b, 2 * (k * k - 1) * n, (1 - k / q + k * k) * n))
    return np.array(out)


def band_butterworth(order: int, low: float, high: float, rate: float) -> np.ndarray:
    """Sections of one digital band-pass: each pole of the low-pass prototype becomes two of the band.

    Every section has its zeros at zero and at the Nyquist frequency and gain 1 at the band's centre.
    """
    edges = np.tan(np.pi * np.array([low, high]) / rate)
    width, centre = edges[1] - edges[0], np.sqrt(edges[0] * edges[1])
    middle = np.exp(-2j * np.arctan(centre))
    pairs = []
    for p in np.exp(1j * np.pi * (2 * np.arange(order) + 1 + order) / (2 * order)):
        if p.imag < -1e-12:
            continue  # its conjugate has been taken
        half = p * width / 2
        root = np.sqrt(half * half - centre * centre + 0j)
        two = [half + root, half - root]
        pairs += [two] if abs(p.imag) <= 1e-12 else [[s, s.conjugate()] for s in two]
    out = []
    for pair in pairs:
        z = [(1 + s) / (1 - s) for s in pair]
        a1, a2 = -(z[0] + z[1]).real, (z[0] * z[1]).real
        gain = abs((1 + a1 * middle + a2 * middle**2) / (1 - middle**2))
        out.append((gain, 0.0, -gain, a1, a2))
    return np.array(out)


def notch(freq: float, q: float, rate: float) -> np.ndarray:
    w = 2 * np.pi * freq / rate
    beta = np.tan(w / q / 2)
    g = 1 / (1 + beta)
    return np.array([(g, -2 * g * np.cos(w), g, -2 * g * np.cos(w), 2 * g - 1)])


BLOCK = 128  #: samples filtered by one matrix product


def steady_state(c: np.ndarray) -> tuple[np.ndarray, float]:
    """State of a section that a constant 1 has run through for ever, and its output then."""
    b0, b1, b2, a1, a2 = map(float, c)
    gain = (b0 + b1 + b2) / (1 + a1 + a2)
    return np.array([(b2 - a2 * gain) + (b1 - a1 * gain), b2 - a2 * gain]), gain


@lru_cache(maxsize=256)
def _tables(b0: float, b1: float, b2: float, a1: float, a2: float) -> tuple[np.ndarray, ...]:
    """What a section does to ``BLOCK`` samples: powers of its step, its free and forced output, what samples leave."""
    step, into = np.array([[-a1, 1], [-a2, 0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    free = np.array([p[0] for p in powers[:BLOCK]])
    impulse = np.r_[b0, free[:-1] @ into]
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    forced = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    return np.array(powers), free, forced, np.array([powers[BLOCK - 1 - i] @ into for i in range(BLOCK)]).T


def run_section(x: np.ndarray, c: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One section along the first axis from a given state, for all columns at once and a block of samples
    at a time: the output, and the state after it.

    Two numbers of state pass from block to block. Inside a block the output is a product with the
    impulse response plus what the state at its start gives. Both are kept for later series.
    """
    powers, free, forced, carried = _tables(*map(float, c))
    n, out = BLOCK, np.empty_like(x, float)
    for i in range(0, len(x), n):
        part = x[i : i + n]
        k = len(part)
        out[i : i + k] = np.tensordot(forced[:k, :k], part, 1) + np.tensordot(free[:k], state, 1)
        state = np.tensordot(powers[k], state, 1) + np.tensordot(carried[:, n - k :], part, 1)
    return out, state


def _section(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One section along the first axis; it starts in the steady state of the first value."""
    return run_section(x, c, np.multiply.outer(steady_state(c)[0], x[0]))[0]


def edge_size(sections: np.ndarray) -> int:
    """Samples by which a signal is carried on at both ends."""
    return 3 * (2 * len(sections) + 1)


def zero_phase(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Forward and backward along the first axis through all sections, with odd reflection at the ends."""
    n = min(len(x) - 1, edge_size(sections))
    if len(x) < 2:
        return x.astype(float)
    y = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]]).astype(float)
    for _ in range(2):
        for c in sections:
            y = _section(y, c)
        y = y[::-1]
    return y[n : n + len(x)]


def band_sections(low: float | None, high: float | None, rate: float, order: int = 4) -> np.ndarray:
    """One band-pass, or a high- or low-pass where an edge is None; no section if the band is empty."""
    low, high = band_edges(low, high, rate)
    if low is None or high is None:
        return np.vstack([butterworth(order, f, rate, k) for f, k in ((low, "high"), (high, "low")) if f is not None] or [np.zeros((0, 5))])
    return band_butterworth(order, low, high, rate) if low < high else np.zeros((0, 5))


def band_pass(x: np.ndarray, low: float | None, high: float | None, rate: float, order: int = 4) -> np.ndarray:
    sections = band_sections(low, high, rate, order)
    return zero_phase(x, sections) if len(sections) else x


def linear_rest(x: np.ndarray) -> np.ndarray:
    i = np.arange(len(x))
    return x - np.polyval(np.polyfit(i, x, 1), i) if len(x) > 1 else x - x.mean()


def robust(x: np.ndarray, limit: float) -> np.ndarray:
    m = np.median(x)
    s = np.median(np.abs(x - m))
    return np.clip((x - m) / (1.4826 * s if s > 1e-9 else 1.0), -limit, limit)


def clean_eeg(x: np.ndarray, rate: float, mains: float = 50.0) -> np.ndarray:
    y = linear_rest(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0))
    if mains < rate / 2:
        y = zero_phase(y, notch(mains, 30, rate))
    return robust(band_pass(y, 1, 45, rate), 6)


def clean_emg(x: np.ndarray, rate: float, mains: float = 50.0) -> np.ndarray:
    y = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
    if mains < rate / 2:
        y = zero_phase(y, notch(mains, 30, rate))
    return robust(band_pass(np.abs(band_pass(y, 20, min(450, 0.99 * rate / 2), rate)), None, 6, rate), 8)


def clean_imu(x: np.ndarray, rate: float) -> np.ndarray:
    return robust(band_pass(linear_rest(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)), None, 20, rate), 8)


def power_envelope(x: np.ndarray, rate: float, low: float = 8, high: float = 30, smooth: float = 5) -> np.ndarray:
    """Root of the smoothed power in a band. A rate too low for the band, or for the smoothing, leaves that step out."""
    nyquist = rate / 2
    low, high, smooth = min(low, 0.9 * nyquist), min(high, 0.95 * nyquist), min(smooth, 0.9 * nyquist)
    y = band_pass(x, low, high, rate) if high > low + 1 else x
    power = band_pass(y**2, None, smooth, rate) if smooth > 0.1 else y**2
    return np.sqrt(np.maximum(power, 0))


def welch(x: np.ndarray, rate: float, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Power density by averaged periodograms: Hann window, half overlap, segments freed of their mean."""
    n = min(len(x), size)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    segments = np.lib.stride_tricks.sliding_window_view(x, n)[:: n - n // 2]
    f = np.abs(np.fft.rfft((segments - segments.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (rate * (w * w).sum())
    f[:, 1 : None if n % 2 else -1] *= 2
    return np.fft.rfftfreq(n, 1 / rate), f.mean(axis=0)


def band_powers(x: np.ndarray, rate: float) -> dict[str, float]:
    freq, power = welch(x, rate)
    out = {}
    for name, (lo, hi) in BANDS.items():
        own = (freq >= lo) & (freq <= hi)
        out[name] = float(np.log1p(np.trapezoid(power[own], freq[own]))) if own.sum() > 1 else 0.0
    return out


# ---- warping -------------------------------------------------------------------------------


def warp(cost: np.ndarray, band: int, gap: float = 0.025, pull: float = 0.02) -> tuple[np.ndarray, float]:
    """Cheapest path through a cost matrix inside a band round the diagonal: (path, mean cost).

    Leaving the diagonal costs ``pull`` times the squared share of the band, a step aside ``gap``.
    Of equal ways the one from above comes first, then from the left, then the diagonal. Cells are
    filled along anti-diagonals, whose cells do not depend on each other.
    """
    n, m = cost.shape
    off = np.abs(np.arange(n)[:, None] - np.arange(m)[None, :])
    local = np.where(off <= band, cost + pull * (off / max(band, 1)) ** 2, np.inf)
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    came = np.zeros((n, m), np.int8)
    for d in range(n + m - 1):
        a = np.arange(max(0, d - m + 1), min(n, d + 1))
        b = d - a
        ways = np.stack([total[a, b + 1] + gap, total[a + 1, b] + gap, total[a, b]])
        way = ways.argmin(axis=0)
        came[a, b] = way
        total[a + 1, b + 1] = local[a, b] + ways[way, np.arange(len(a))]
    if not np.isfinite(total[n, m]):
        raise ValueError("no path inside the band")
    path, a, b = [(n - 1, m - 1)], n - 1, m - 1
    while a or b:
        way = came[a, b]
        a, b = int(a - (way != 1)), int(b - (way != 0))
        path.append((a, b))
    return np.array(path[::-1]), float(total[n, m] / len(path))


# ---- on frames -------------------------------------------------------------------------------


def filtered(df: DataFrame, by: Sequence[str], value: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``f`` on each series in order of idx."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        return part.assign(**{value: f(part[value].to_numpy(dtype=float))})

    return df.select(*by, "idx", value).groupBy(*by).applyInPandas(run, df.select(*by, "idx", df[value].cast("double").alias(value)).schema)


def spectral_features(df: DataFrame, by: Sequence[str], value: str, rate: float) -> DataFrame:
    names = list(by)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip(names, key)), **band_powers(part.sort_values("idx")[value].to_numpy(dtype=float), rate)}])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return df.select(*by, "idx", value).groupBy(*by).applyInPandas(run, kinds + "".join(f", {b} double" for b in BANDS))
