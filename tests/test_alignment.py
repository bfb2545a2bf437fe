"""Alignment against loops that go cell by cell and sample by sample; features of a trial."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitwright.operators import alignment as L
from gaitwright.operators import kernels as K
from gaitwright.operators import order

RANDOM = np.random.default_rng(21)


def loop_path(local, band, gap, pull):
    """Cheapest path by plain recursion over cells; of equal ways: from above, from the left, diagonal."""
    n = len(local)
    best = {}
    for i in range(n):
        for j in range(n):
            if abs(i - j) > band:
                continue
            cost = local[i][j] + pull * (abs(i - j) / max(band, 1)) ** 2
            ways = [(best[p][0] + g, k, p) for k, (p, g) in enumerate((((i - 1, j), gap), ((i, j - 1), gap), ((i - 1, j - 1), 0.0))) if p in best]
            if ways:
                w = min(ways, key=lambda x: (x[0], x[1]))
                best[i, j] = (cost + w[0], w[2])
            elif (i, j) == (0, 0):
                best[0, 0] = (cost, None)
    path, at = [], (n - 1, n - 1)
    while at:
        path.append(at)
        at = best[at][1]
    return path[::-1], best[n - 1, n - 1][0] / len(path)


def loop_interp(x, place):
    i = min(int(math.floor(place)), len(x) - 1)
    j = min(i + 1, len(x) - 1)
    return x[i] + (place - i) * (x[j] - x[i])


def loop_smooth(x, k):
    n = len(x)
    return [sum(x[min(max(i + o, 0), n - 1)] for o in range(-(k // 2), k - k // 2)) / k for i in range(n)]


def loop_unit(x):
    m = sum(x) / len(x)
    s = math.sqrt(sum((v - m) ** 2 for v in x) / len(x))
    return [(v - m) / s for v in x]


def loop_change(x):
    return [abs(b - a) for a, b in zip([x[0], *x], x)]


def channels(x):
    return list(zip(*[loop_unit(c) for c in zip(*x.tolist())]))


def test_paths_equal_a_loop_over_cells():
    for n, band, gap, pull in ((8, 2, 0.025, 0.02), (20, 4, 0.025, 0.02), (15, 3, 0.0, 0.0)):
        local = RANDOM.normal(size=(n, n)) ** 2
        path, cost = K.warp(local, band, gap, pull)
        want, mean = loop_path(local.tolist(), band, gap, pull)
        assert [tuple(p) for p in path.tolist()] == want and cost == pytest.approx(mean)
    with pytest.raises(ValueError):
        K.warp(np.ones((9, 3)), 1)


@pytest.mark.parametrize("seed", range(5))
def test_knots_equal_a_loop(seed):
    r = np.random.default_rng(seed)
    t = np.linspace(0, 6, 150)
    emg = np.stack([np.sin(t * (c + 1)) * (1 + 0.2 * r.normal(size=150)) for c in range(3)], axis=1)
    imu = np.stack([np.cos(t[::2] * (c + 1)) + 0.1 * r.normal(size=75) for c in range(4)], axis=1)
    c = L.RUNTIME
    n, out = c.dtw_length, c.output_length
    short = [[[loop_interp(ch, k * (len(x) - 1) / (n - 1)) for ch in x.T.tolist()] for k in range(n)] for x in (emg, imu)]
    e = [sum(abs(v) for v in row) / len(row) for row in channels(np.array(short[0]))]
    moved = channels(np.array(short[1]))
    speed = [math.sqrt(sum((b - a) ** 2 for a, b in zip(p, q))) for p, q in zip([moved[0], *moved], moved)]
    curves = []
    for level in (e, speed):
        a, b = loop_unit(loop_smooth(level, 5)), loop_unit(loop_smooth(loop_change(level), 5))
        curves.append(loop_unit([0.7 * x + 0.3 * y for x, y in zip(a, b)]))
    path, cost = loop_path([[(x - y) ** 2 for y in curves[1]] for x in curves[0]], round(0.15 * n), 0.025, 0.02)
    places, told = L.knot_places(emg, imu, c)
    assert told["dtw_avg_cost"] == pytest.approx(cost, abs=1e-9) and told["path_expansion"] == len(path) / n
    x, y = (np.array([curves[s][p[s]] for p in path]) for s in (0, 1))
    assert told["feature_correlation"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    if "fallback" in told:
        assert told["feature_correlation"] < -0.2 or told["path_expansion"] > 1.85
        return
    knots, last = [], -1.0
    for k, (i, j) in enumerate(path):
        v = 0.0 if k == 0 else 1.0 if k == len(path) - 1 else (i + j) / (2 * (n - 1))
        if v - last > 1e-6 or k == 0:
            knots.append((v, i, j))
        last = v
    for side, raw in enumerate((emg, imu)):
        top, before = len(raw) - 1, 0.0
        for k in range(out):
            at = k / (out - 1)
            want = np.interp(at, [q[0] for q in knots], [q[1 + side] for q in knots]) * top / (n - 1)
            before = min(max(before, at * top + 0.01 * min(max(want - at * top, -0.08 * top), 0.08 * top)), top)
            assert places[side][k] == pytest.approx(before, abs=1e-6)
    assert told["alignment_score"] == pytest.approx(told["feature_correlation"] - 0.1 * cost - 0.05 * max(0, len(path) / n - 1), abs=1e-9)


def test_weighted_cost_equals_a_loop():
    r = np.random.default_rng(4)
    c = L.AlignConfig(feature_combo="rms_env_vel_acc_slope_event")
    e, k = L.muscle_curves(r.normal(size=(30, 12)), c), L.movement_curves(r.normal(size=(30, 63)), c)
    assert set(e) == {"main", "env", "slope", "event"} and set(k) == {"main", "vel", "acc", "slope", "event"}
    got = L.warping_cost(e, k, c)
    for i in range(30):
        for j in range(30):
            x, y = e["main"][i], k["main"][j]
            ax, ay = abs(x), abs(y)
            shape = (1 + 0.7 * ax + 0.3 * ay) * ((x - y) ** 2 + 0.25 * (e["slope"][i] - k["slope"][j]) ** 2)
            phase = (e["event"][i] - k["event"][j]) ** 2 + (ax - abs(k["acc"][j])) ** 2
            want = shape + (1 + 0.7 * ax**2 + 0.3 * ay**2) * (ax - ay) ** 2 + 0.35 * phase + 0.5 * (e["env"][i] - k["vel"][j]) ** 2 + 0.25 * (0.7 * ax - 0.3 * ay) ** 2
            assert got[i, j] == pytest.approx(want)
    emg, kin = r.normal(size=(300, 12)), r.normal(size=(200, 63))
    a, b, told = L.weighted_pair(emg, kin, c)
    assert np.allclose(a, L.stretched(emg, 200)) and told["alignment_score"] == told["feature_correlation"] - told["dtw_avg_cost"]


def test_strategies_and_failures(spark):
    r = np.random.default_rng(5)
    x = [r.normal(size=(80, n)) for n in (3, 2, 4)]
    plain, _ = L.align_trial(*x, "none")
    assert all(np.allclose(plain[m], L.align_trial(*x, "resample")[0][m]) for m in L.MODALITIES)
    assert np.allclose(plain["emg"], L.align_trial(*x, "no_dtw")[0]["emg"]) and plain["eeg"].shape == (3, 256)
    assert np.allclose(plain["imu"].mean(axis=1), 0) and np.allclose(plain["imu"].std(axis=1), 1)
    with pytest.raises(ValueError):
        L.align_trial(*x, "other")
    assert L.tokens("") == {"rms", "env", "vel", "acc"} and L.tokens(" RMS_ vel") == {"rms", "vel"}
    rows = [(1, *(v.tolist() for v in x)), (2, None, *(v.tolist() for v in x[1:])), (3, [[1.0]], [[1.0]], [[1.0]])]
    df = spark.createDataFrame(rows, "s int, eeg array<array<double>>, emg array<array<double>>, imu array<array<double>>")
    got = {q.s: q for q in L.aligned_trials(df, ["s"], "knot").collect()}
    assert len(got[1].emg[0]) == 256 and got[1].warning is None and got[2].emg is None and got[3].warning
    assert L.aligned_trials(df.limit(0), ["s"]).count() == 0


def test_trial_vectors_have_630_numbers():
    r = np.random.default_rng(6)
    got, _ = L.align_trial(r.normal(size=(90, 30)), r.normal(size=(90, 4)), r.normal(size=(90, 24)), "resample")
    v = L.trial_vector(got, 500.0)
    assert len(v) == 630
    x = got["emg"][2].tolist()
    d = [b - a for a, b in zip(x, x[1:])]
    sign = lambda q: (q > 0) - (q < 0)
    want = [sum(map(abs, x)) / 256, sum(map(abs, d)), sum(sign(a) != sign(b) and abs(a) + abs(b) >= 1e-5 for a, b in zip(x, x[1:])), sum(sign(a) != sign(b) for a, b in zip(d, d[1:]))]
    assert v[-8:-4] == pytest.approx(want)
    with pytest.raises(ValueError):
        L.trial_vector({**got, "emg": got["emg"][:3]}, 500.0)


def test_blocks_of_a_filter_equal_the_plain_recursion():
    x, c = RANDOM.normal(size=(1000, 3)), K.butterworth(4, 6, 200.0, "low")[0]
    b0, b1, b2, a1, a2 = map(float, c)
    got = K._section(x, c)
    for ch in range(3):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = (b2 - a2 * gain) * x[0, ch]
        z1 = (b1 - a1 * gain) * x[0, ch] + z2
        for i, v in enumerate(x[:, ch].tolist()):
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            assert got[i, ch] == pytest.approx(y, abs=1e-9)


def test_prepared_trials_are_cut_to_the_shortest():
    x = {"eeg": RANDOM.normal(size=(2000, 2)), "emg": RANDOM.normal(size=(5000, 2)), "imu": RANDOM.normal(size=(300, 3))}
    rates = {"eeg": 200.0, "emg": 1259.4, "imu": 148.1}
    got = L.prepare_trial(*x.values(), rates)
    seconds = 300 / 148.1
    assert {m: len(v) for m, v in got.items()} == {m: int(seconds * rates[m]) for m in x}
    a, b = L.sync_envelopes(x["eeg"], x["emg"], 200.0, 1259.4, [1])
    assert abs(a.mean()) < 1e-9 and b.std() == pytest.approx(1) and len(a) == round(1999 / 200 * 100) + 1


def test_order_statistics_of_large_groups(spark):
    r = np.random.default_rng(7)
    rows = [(int(i % 2), float(v)) for i, v in enumerate(np.r_[r.normal(size=1500), np.full(700, 0.25)])]
    df = spark.createDataFrame(rows, "g int, v double")
    for g, m in order.medians(df, ["g"], "v", "m").collect():
        assert m == pytest.approx(np.median([v for k, v in rows if k == g]))
    got = order.numbered(df.withColumn("id", F.monotonically_increasing_id()), "v", "id", name="at").orderBy("at").collect()
    assert [q["at"] for q in got] == list(range(1, len(rows) + 1)) and [q.v for q in got] == sorted(v for _, v in rows)
    third = order.nth_value(df, [], "v", F.lit(3), "t").first()
    assert third.t == sorted(v for _, v in rows)[2] and third.n == len(rows)


def modulated(r, seconds: float, shift: float) -> dict[str, np.ndarray]:
    """Streams of devices started apart: the muscles' level follows the brain's, ``shift`` seconds off."""
    level = lambda t: 1 + np.abs(np.sin(0.9 * t) + np.sin(2.1 * t + 1) + np.sin(0.37 * t))
    t = {m: np.arange(int(seconds * f)) / f for m, f in (("eeg", 200.0), ("emg", 500.0), ("imu", 100.0))}
    eeg = np.sin(2 * np.pi * 15 * t["eeg"])[:, None] * level(t["eeg"])[:, None] + r.normal(size=(len(t["eeg"]), 3)) / 10
    emg = r.normal(size=(len(t["emg"]), 2)) * level(t["emg"] - shift)[:, None]
    return {"eeg": eeg, "emg": emg, "imu": np.cumsum(r.normal(size=(len(t["imu"]), 2)), axis=0)}


def test_recordings_are_put_in_time_cropped_and_scaled(spark):
    r = np.random.default_rng(31)
    rates = {"eeg": 200.0, "emg": 500.0, "imu": 100.0}
    recordings = {1: modulated(r, 30, 2.0), 2: modulated(r, 24, -1.5), 3: {m: r.normal(size=(400, 2)) for m in L.MODALITIES}}
    rows = [(s, m, f"{m}{c}", i, float(v)) for s, x in recordings.items() for m, a in x.items() for (i, c), v in np.ndenumerate(a)]
    rows += [(4, "eeg", "eeg0", i, 1.0) for i in range(50)] + [(5, m, "a", i, float(i)) for m in L.MODALITIES for i in range(50)]
    long = spark.createDataFrame(rows, "s int, modality string, channel string, idx int, value double").repartition(6)
    known = spark.createDataFrame([(s, *rates.values()) for s in (1, 2, 3, 4)], "s int, eeg_rate double, emg_rate double, imu_rate double")
    got = {q.s: q for q in L.load_trials(long, known, ["s"], motor=["eeg0", "eeg2"]).collect()}
    assert got[4].warning == "a modality is missing" and got[5].warning == "no rates" and got[4].eeg is None
    assert got[1].lag == pytest.approx(2.0, abs=0.5) and got[2].lag == pytest.approx(-1.5, abs=0.5)
    for s in (1, 2, 3):
        x, q = recordings[s], got[s]
        emg, imu = (np.stack([f(c, rates[m]) for c in x[m].T], axis=1) for m, f in (("emg", K.clean_emg), ("imu", K.clean_imu)))
        brain, muscle = L.sync_envelopes(x["eeg"], emg, 200.0, 500.0, [0, 2] if s < 3 else [0])
        best = None
        for lag in range(-1500, 1501):  # every lag for itself
            i = np.arange(max(0, lag), min(len(muscle), len(brain) + lag))
            if len(i) and (best is None or muscle[i] @ brain[i - lag] > best[0] + 1e-9):
                best = muscle[i] @ brain[i - lag], lag, np.corrcoef(muscle[i], brain[i - lag])[0, 1] if len(i) >= 4 else np.nan
        lag = best[1] / 100 if best[2] >= 0.2 else 0.0
        assert (q.lag, q.peak, q.sync_fallback) == (pytest.approx(best[1] / 100), pytest.approx(best[2], abs=1e-8, nan_ok=True), not best[2] >= 0.2)
        begin = {"eeg": max(0, lag), "emg": max(0, -lag), "imu": max(0, -lag)}
        left = max(0.0, min(len(x[m]) / rates[m] - begin[m] for m in x))
        assert (q.seconds, q.eeg_start, q.other_start) == pytest.approx((left, begin["eeg"], begin["emg"]))
        if not left:
            assert q.eeg == q.emg == q.imu == []  # they share no time
            continue
        cut = {m: a[round(begin[m] * rates[m]) :][: round(left * rates[m])] for m, a in (("eeg", x["eeg"]), ("emg", emg), ("imu", imu))}
        scale = cut["eeg"] - np.median(cut["eeg"], axis=0)
        want = np.clip(scale / (1.4826 * np.median(np.abs(scale), axis=0)), -6, 6)
        assert np.allclose(q.eeg, want) and np.allclose(q.emg, cut["emg"]) and np.allclose(q.imu, cut["imu"])
    aligned = L.aligned_trials(L.load_trials(long.filter("s < 3"), known, ["s"]), ["s"], "knot", columns=["emg", "alignment_score"]).collect()
    assert {len(q.emg[0]) for q in aligned} == {256} and aligned[0].asDict().keys() == {"s", "emg", "alignment_score"}
    plain = L.load_trials(long.filter("s = 3"), known, ["s"], sync=False).first()
    want = L.prepare_trial(*recordings[3].values(), rates)
    assert all(np.allclose(plain[m], want[m]) for m in L.MODALITIES) and plain.lag is None
