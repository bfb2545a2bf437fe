"""Hand-sized cases for the rules that decide correctness."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitwright.functions import arrays as V
from gaitwright.functions import text as T
from gaitwright.operators import aggregate as A
from gaitwright.operators import alignment as L
from gaitwright.operators import bootstrap as B
from gaitwright.operators import contracts as P
from gaitwright.operators import estimators as E
from gaitwright.operators import kernels as K
from gaitwright.operators import metrics as M
from gaitwright.operators import recordings as RE
from gaitwright.operators import series as S
from gaitwright.operators import splits as G
from gaitwright.operators import textscores as X
from gaitwright.sources import files
from gaitwright.streaming import windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, **columns):
    return list(spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first())


def test_labels(spark):
    rows = frame(spark, [("1+",), (" 2 ",), ("",), ("nan",), ("3.0",), (None,)], "x string")
    assert [r[0] for r in rows.select(P.normal_label(F.col("x"))).collect()] == ["1+", "2", None, None, "3.0", None]
    assert [r[0] for r in rows.select(P.normal_label(F.col("x"), whole=True)).collect()] == [None, 2, None, None, 3, None]
    with pytest.raises(Exception, match="unknown label"):
        rows.select(P.encode_label(F.col("x"), ["1+"])).collect()


def test_flat_and_short_metrics_are_nan(spark):
    df = frame(spark, [("flat", 5.0, 4.0), ("flat", 5.0, 6.0), ("flat", 5.0, 5.0), ("two", 1.0, 1.0), ("two", 2.0, 2.5)], "g string, y_true double, y_pred double")
    got = {r.g: r for r in M.regression_metrics(df, ["g"], 1.0).collect()}
    assert math.isnan(got["flat"].r2) and math.isnan(got["flat"].pearson) and math.isnan(got["two"].spearman) and got["two"].mae == 0.25


def test_kappa_counts_positions_of_seen_labels(spark):
    df = frame(spark, [(0, 0), (1, 5), (5, 5), (0, 1)], "y_true int, y_pred int").withColumn("g", F.lit(1))
    r = M.class_metrics(M.confusion(df, ["g"], 6), ["g"]).first()
    # Positions 0, 1, 2: distances 0, 1, 0, 1; expected by hand.
    t, p = np.array([0, 1, 2, 0]), np.array([0, 2, 2, 1])
    apart = np.abs(t[:, None] - p[None, :]).sum() / 16
    assert r.weighted_kappa == pytest.approx(1 - np.abs(t - p).mean() / apart)
    same = df.withColumn("y_pred", F.col("y_true"))
    assert M.class_metrics(M.confusion(same, ["g"], 6), ["g"]).first().kappa == 1.0


def test_ties_go_to_the_lowest_class(spark):
    votes = frame(spark, [(1, 3), (1, 2), (1, 2), (1, 3)], "s int, c int")
    assert A.majority(votes, ["s"], "c").first().c == 2
    assert one(spark, a=V.argmax(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)))) == [1]


def test_clip_before_and_after_the_median_differ(spark):
    bags = frame(spark, [("a", 1.0, 18.0), ("a", 1.0, 30.0)], "s string, y_true double, y_pred double")
    assert [A.subject_regression(bags, ["s"], 0, 20, c).first().y_pred for c in (True, False)] == [19.0, 20.0]


def test_moving_average_repeats_edges(spark):
    df = frame(spark, [(1, i, float(v)) for i, v in enumerate([1, 5, 2, 8, 3])], "s int, idx int, v double")
    for k in (3, 4, 5, 9):
        got = [r.m for r in S.moving_average(df, ["s"], "idx", "v", "m", k).orderBy("idx").collect()]
        x = np.pad([1, 5, 2, 8, 3], (k // 2, k - 1 - k // 2), "edge")
        assert got == pytest.approx(np.convolve(x, np.ones(k) / k, "valid"))


def test_resampling_equals_interpolation(spark):
    x = np.random.default_rng(0).normal(size=37)
    df = frame(spark, [(1, i, float(v)) for i, v in enumerate(x)] + [(2, 0, 7.0)], "s int, idx int, v double")
    for length in (8, 36, 37, 100):
        rows = S.resample(df, ["s"], "idx", "v", length).orderBy("s", "k").collect()
        assert [r.v for r in rows if r.s == 1] == pytest.approx(np.interp(np.linspace(0, 36, length), np.arange(37), x))
        assert [r.v for r in rows if r.s == 2] == [7.0] * length
    t = np.sort(np.random.default_rng(1).uniform(0, 3, 25))
    clocked = frame(spark, [(1, float(a), float(b)) for a, b in zip(t, x)], "s int, t double, v double")
    got = S.resample_rate(clocked, ["s"], "t", "v", 50.0).orderBy("k").collect()
    n = max(2, round((t[-1] - t[0]) * 50) + 1)
    grid = np.minimum(t[0] + np.arange(n) / 50, t[-1])
    assert len(got) == n and [r.v for r in got] == pytest.approx(np.interp(grid, t, x[:25]))


def test_known_lag_is_found_and_cropped(spark):
    x = np.sin(np.arange(200) / 5) + np.random.default_rng(2).normal(size=200) / 10
    for lag in (7, -4):
        a = frame(spark, [(1, i, float(v)) for i, v in enumerate(np.roll(x, lag))], "s int, idx int, v double")
        b = frame(spark, [(1, i, float(v)) for i, v in enumerate(x)], "s int, idx int, v double")
        assert S.best_lag(S.lag_scores(a, b, ["s"], "idx", "v", 12), ["s"]).first().lag == lag
    both = frame(spark, [(1, n, float(i)) for n in ("a", "b") for i in range(10)], "s int, stream string, t double")
    lags = frame(spark, [(1, "b", 3.0)], "s int, stream string, lag double")
    cut = S.common_window(both, ["s"], "stream", "t", lags).groupBy("stream").agg(F.min("t"), F.max("t")).collect()
    assert {tuple(r)[1:] for r in cut} == {(0.0, 6.0)}


def test_filters_are_zero_phase_and_halve_at_the_cutoff():
    rate, t = 500.0, np.arange(4000) / 500.0
    for f, want in ((5, 1.0), (40, 0.5), (150, 0.0)):
        y = K.band_pass(np.sin(2 * np.pi * f * t), None, 40, rate)[1000:3000]
        assert np.abs(y).max() == pytest.approx(want, abs=0.03)
    pulse = np.zeros(1001)
    pulse[500] = 1
    y = K.band_pass(pulse, 1, 45, rate)
    assert y.argmax() == 500 and y[480:500] == pytest.approx(y[520:500:-1], abs=1e-4)
    hum = K.zero_phase(np.sin(2 * np.pi * 50 * t), K.notch(50, 30, rate))[1500:2500]
    assert np.abs(hum).max() < 0.02
    assert K.zero_phase(np.full(50, 3.0), K.butterworth(4, 10, rate, "low")) == pytest.approx(np.full(50, 3.0))


def test_welch_finds_the_band():
    x = np.sin(2 * np.pi * 10 * np.arange(2000) / 200.0)
    powers = K.band_powers(x, 200.0)
    assert max(powers, key=powers.get) == "alpha"
    freq, density = K.welch(x, 200.0)
    assert np.trapezoid(density, freq) == pytest.approx(0.5, rel=0.02)


def test_warping_of_equals_is_the_diagonal():
    x = np.random.default_rng(3).normal(size=40)
    path, cost = K.warp((x[:, None] - x[None, :]) ** 2, 6)
    assert (path[:, 0] == path[:, 1]).all() and cost == 0
    assert L.band_width(100, 0.15) == 15 and L.band_width(3, 0.1) == 1 and L.band_width(10, 4) == 4
    with pytest.raises(ValueError):
        L.band_width(10, -1)


def test_bootstrap_draws_look_independent(spark):
    df = frame(spark, [(i, float(i)) for i in range(29)], "id int, v double")
    drawn = B.bootstrap_draws(df, ["id"], 500)
    distinct = drawn.groupBy("draw").count().agg(F.avg("count")).first()[0]
    assert distinct == pytest.approx(29 * (1 - (28 / 29) ** 29), abs=0.4)
    assert drawn.groupBy("draw").agg(F.sum("times").alias("n")).filter("n != 29").count() == 0


def test_folds_are_disjoint_and_complete(spark):
    rows = frame(spark, [(i, i % 4, i % 2) for i in range(31)], "s int, a int, b int")
    folds = G.balanced_folds(G.rarity(rows, "s", ["a", "b"]), "s", 3, ["a", "b"])
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [10, 10, 11]
    split = G.roles(folds, 3).select(F.col("round").alias("fold"), "role", F.col("s").alias("subject_id"))
    assert P.leaking_subjects(split).count() == 0
    assert P.coverage_faults(split, split, "subject_id").count() == 0
    bags = G.bags(frame(spark, [(1, i) for i in range(5)] + [(2, 9)], "s int, t int"), "s", "t", 2, 4, 1).collect()
    assert all(len({r.t for r in bags if r.s == 1 and r.bag == b}) == 4 for b in (0, 1)) and sum(r.s == 2 for r in bags) == 8


def test_array_functions(spark):
    a = F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0))
    got = one(spark, dot=V.dot(a, a), corr=V.correlation(a, a), flat=V.correlation(a, F.array(*[F.lit(1.0)] * 3)), up=V.running_product(a), at=V.holds(a, F.array(F.lit(2.0), F.lit(4.0))))
    assert got == [21.0, pytest.approx(1.0), 0.0, [1.0, 2.0, 8.0], 2]
    logits = F.array(F.lit(5.0), F.lit(2.0), F.lit(-3.0))
    rank, p = one(spark, r=V.ordinal_rank(logits), p=V.ordinal_probabilities(logits))
    assert rank == 2 and sum(p) == pytest.approx(1) and int(np.argmax(p)) == 2


def test_text_rules(spark):
    s = F.lit
    got = one(
        spark, a=T.strip_thinking(s("<think>x</think> Walk daily. <|im_end|> more")), b=T.replace_first(s("2 weeks and 2 weeks"), r"\d+ weeks", "some time"), c=T.composed(s("F"), s("Advice: stretch"), s("rest")),
        d=T.composed(s("F"), s("  "), s("rest.")), e=T.metric_key(s(1.5)), f=T.metric_key(s(10.0)), g=T.rating(s("3")), h=T.rating(s("3.5")), i=T.rating(s("6")), j=T.de_identified(s("Patient 12 improved")),
        k=T.required_groups(s(60), s("0")), m=T.tier(s(4), T.FMA_TIERS, "abcde"), n=T.covered(s("daily dressing"), F.array(s("adl")), {"adl": ["dressing"]}),
    )
    assert got == ["Walk daily.", "some time and 2 weeks", "F\nstretch.", "F\nrest.", "1p5", "10", 3, None, None, "[ID] improved", ["motor", "adl"], "a", True]
    v = spark.range(1).select(T.values_agree(s("FMA 12, later FMA 13"), r"FMA (\d+)", s(12)).alias("v")).first().v
    assert (v.missing, v.wrong) == (False, True)
    flags = one(spark, **T.leak_flags(s("see {slot} of S07 </think>"), s("S01")))
    assert flags == [True, True, False, False, True]
    assert one(spark, t=T.safe_text(s("x"), s(None).cast("boolean"), s(True), s("policy"))) == ["policy"]
    assert one(spark, c=T.rendered(T.chat(s("a"), s("b"), s(" ")))) == ["<|system|>\na\n<|user|>\nb"]


def test_overlap_scores(spark):
    df = frame(spark, [(1, "the cat sat", "the cat sat"), (2, "the the the", "the cat"), (3, "", "a b")], "id int, hyp string, ref string")
    c = X.overlap_counts(df, ["id"], X.words(F.col("hyp")), X.words(F.col("ref")))
    got = {r.id: r for r in c.collect()}
    assert got[2].match_1 == 1 and got[1].match_3 == 1 and got[3].match_1 == 0
    assert {r.id: r.bleu_1 for r in X.sentence_bleu(c, ["id"]).collect()} == {1: 1.0, 2: pytest.approx(1 / 3), 3: 0.0}
    assert X.common_length(list("abcbdab"), list("bdcaba")) == 4
    assert [r[0] for r in df.orderBy("id").select(X.rouge_l(X.words(F.col("hyp")), X.words(F.col("ref")))).collect()] == [1.0, pytest.approx(0.4), 0.0]


def test_estimators(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(90, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    df = frame(spark, [(i, i % 3, [float(v) for v in x[i]], float(y[i])) for i in range(90)], "id int, fold int, x array<double>, label double")
    got = E.cross_fitted("ridge", df, "label", "fold", [0, 1, 2]).collect()
    assert len(got) == 90 and max(abs(g.y_pred - g.label) for g in got) < 0.5
    train = df.filter("fold <> 0")
    own = E.fit_predict("ridge", train, df.filter("fold = 0"), "label").orderBy("id").collect()
    keep = np.arange(90) % 3 != 0
    z = (x - x[keep].mean(0)) / x[keep].std(0)
    w = np.linalg.solve(z[keep].T @ z[keep] + np.eye(3), z[keep].T @ (y[keep] - y[keep].mean()))
    assert [g.y_pred for g in own] == pytest.approx(z[~keep] @ w + y[keep].mean(), abs=1e-6)
    cls = df.withColumn("label", (F.col("label") > 3).cast("double"))
    assert E.fit_predict("logistic", cls, cls, "label").filter("y_pred = label").count() > 80
    assert E.fit_predict("forest", cls, cls, "label").filter("y_pred = label").count() > 80
    cal = E.isotonic(frame(spark, [(1.0, 1.0), (3.0, 2.0), (2.0, 3.0)], "y_true double, y_pred double"), frame(spark, [(2.5,)], "y_pred double")).first()
    assert cal.calibrated == 2.5
    assert E.chain_edges(spark, [3, 2], [(0, 1)]).count() == 2 * (2 + 1 + 6)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "m.csv").write_text("subject_id,trial_id,hand_tone,hand_function,bi,fma_score,eeg_path,emg_path\n1,1,1+,3.0,40,7,e,m\n1,2,nan,,50,7,e,m\n10,1,2,x,60,9,e,m\n")
    rows = files.read_manifest(spark, str(tmp_path / "m.csv"))
    assert [(r.hand_tone, r.hand_function) for r in rows.orderBy("subject_id", "trial_id").collect()] == [("1+", 3), (None, None), ("2", None)]
    (tmp_path / "bad.csv").write_text("subject_id,trial_id,fma_score,eeg_path,emg_path\n1,1,3,e,m\n1,1,3,e,m\n")
    with pytest.raises(ValueError, match="repeated"):
        files.read_manifest(spark, str(tmp_path / "bad.csv"))
    ids = frame(spark, [("10",), ("9",), ("b",), ("a",)], "id string")
    assert [r.id for r in ids.orderBy(*files.numeric_first("id")).collect()] == ["9", "10", "a", "b"]
    (tmp_path / "s.json").write_text(json.dumps({"folds": [{"fold": 1, "train_subjects": ["1"], "val_test_subjects": ["2"]}, {"fold": 2, "train_subjects": ["2"], "val_test_subjects": ["1"]}]}))
    assert files.read_split(spark, str(tmp_path / "s.json")).count() == 4 and files.read_split(spark, str(tmp_path / "s.json"), 2).count() == 2
    (tmp_path / "r/m1").mkdir(parents=True)
    (tmp_path / "r/m1/fold2.json").write_text('{"a": {"b": 0.5}}')
    assert [tuple(r) for r in files.read_reports(spark, str(tmp_path / "r"), "a.b").collect()] == [("m1", 2, 0.5)]
    (tmp_path / "f/module/v1/BI").mkdir(parents=True)
    (tmp_path / "f/module/v1/BI/x_3fold_summary.csv").write_text("fold,mae\n1,2.5\n")
    assert tuple(files.read_fold_summaries(spark, str(tmp_path / "f")).first()) == ("module", "v1", "BI", 1, 2.5)
    wide = frame(spark, [(0.0, 1.0, 0.1, 2.0)], "`X[s]` double, `m: EMG` double, `X[s].1` double, `m: ACC` double")
    assert [tuple(r) for r in files.read_interleaved(wide, ["EMG", "ACC"]).collect()] == [("m: EMG", 0.0, 1.0), ("m: ACC", 0.1, 2.0)]
    (tmp_path / "e.csv").write_text("C3,C4\n1,2\n3,4\n")
    assert files.read_channels(spark, str(tmp_path / "e.csv"), ["C4"]).agg(F.sum("value")).first()[0] == 6
    assert one(spark, i=files.interval(F.lit("[1.5, -2]")))[0] == (1.5, -2.0)
    (tmp_path / "c.json").write_text('{"subjects": {"1": {"source": "human"}}}')
    assert tuple(files.read_cases(spark, str(tmp_path / "c.json"), "source string").first()) == ("1", "human")
    files.write_table(ids, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    key = files.content_key("a", 1)
    assert files.cached_table(ids, str(tmp_path), key).count() == 4 == files.cached_table(ids.limit(0), str(tmp_path), key).count()
    with pytest.raises(ValueError, match="no column"):
        P.first_present(ids, {"x": ["y"]})


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    counts = windows.tumbling(windows.read_events(spark, str(tmp_path / "in"), kinds), "ts", "1 day", "event_type", "value")
    run = counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    want = windows.tumbling(events, "ts", "1 day", "event_type", "value")
    pick = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert pick(spark.table("counts")) == pick(want)
    assert windows.sliding(events, "ts", "2 days", "1 day", "event_type", "value").count() > want.count() * 0.9


def plain_lag(a, b, reach):
    """Lag of the greatest sum over the overlap, and the centred correlation there, lag by lag."""
    best = None
    for lag in range(-reach, reach + 1):
        i = range(max(0, lag), min(len(a), len(b) + lag))
        if not len(i):
            continue
        x, y = a[list(i)], b[[k - lag for k in i]]
        total = float(x @ y)
        if best is None or total > best[0] + 1e-9:
            scale = np.linalg.norm(x - x.mean()) * np.linalg.norm(y - y.mean())
            best = total, lag, float((x - x.mean()) @ (y - y.mean()) / scale) if len(x) >= 4 and scale > 1e-12 else np.nan
    return best[1:]


def test_lags_equal_a_plain_loop_with_reach_near_the_length(spark):
    r = np.random.default_rng(12)
    rows, want = [], {}
    for s in range(100):
        n = int(r.integers(60, 160))
        base = r.normal(size=400).cumsum()
        base -= base.mean()
        shift = int(r.integers(-40, 40))
        a, b = base[100 + shift : 100 + shift + n] + r.normal(size=n), base[100 : 100 + n - int(r.integers(0, 20))]
        a, b = a - a.mean(), b - b.mean()
        want[s] = plain_lag(a, b, n - 3)
        rows += [(s, "a", i, float(v)) for i, v in enumerate(a)] + [(s, "b", i, float(v)) for i, v in enumerate(b)]
        table = S.lag_table(a, b, 0, n - 3)
        assert (table["lag"][table["total"].argmax()], table["r"][table["total"].argmax()]) == (want[s][0], pytest.approx(want[s][1], abs=1e-9))
    df = frame(spark, rows, "s int, side string, idx int, v double")
    for reach in (20, 300):
        got = S.best_lag(S.lag_scores(df.filter("side = 'a'"), df.filter("side = 'b'"), ["s"], "idx", "v", reach), ["s"], 0.2).collect()
        for row in got:
            a, b = (np.array([v for s, side, _, v in rows if s == row.s and side == k]) for k in "ab")
            lag, peak = plain_lag(a, b, reach)
            weak = not peak >= 0.2
            assert row.lag == (0 if weak else lag) and row.fallback == weak
            assert row.peak == pytest.approx(peak, abs=1e-8, nan_ok=True)


def test_gaps_and_flat_sides_of_lags():
    r = np.random.default_rng(3)
    a, b = r.normal(size=50), r.normal(size=44)
    holes = a.copy()
    holes[[3, 20, 21]] = np.nan
    table = S.lag_table(holes, b, 4, 60)
    for lag, total, n, corr in zip(table["lag"], table["total"], table["overlap"], table["r"]):
        pairs = [(holes[i], b[i + 4 - lag]) for i in range(50) if 0 <= i + 4 - lag < 44 and not np.isnan(holes[i])]
        x, y = np.array(pairs).T
        assert n == len(pairs) and total == pytest.approx(x @ y, abs=1e-9)
        assert np.isnan(corr) if n < 4 else corr == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-8)
    assert np.isnan(S.lag_table(np.full(30, 2.0), b, 0, 10)["r"]).all()


@pytest.mark.parametrize("low,high,rate", [(1, 45, 250.0), (8, 30, 200.0), (20, 450, 1259.4), (20, 450, 2000.0)])
def test_band_response_is_the_closed_form(low, high, rate):
    for order in (3, 4):
        sections = K.band_butterworth(order, low, high, rate)
        assert sections.shape == (order, 5)
        k = np.tan(np.pi * np.array([low, high]) / rate)
        for f in np.linspace(low / 3, min(rate / 2 * 0.97, high * 1.8), 20):
            z, w = np.exp(-2j * np.pi * f / rate), np.tan(np.pi * f / rate)
            got = np.prod([abs((b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)) for b0, b1, b2, a1, a2 in sections])
            want = (1 + ((w * w - k[0] * k[1]) / (w * (k[1] - k[0]))) ** (2 * order)) ** -0.5
            assert 20 * np.log10(got / want) == pytest.approx(0, abs=0.01)
        poles = np.concatenate([np.roots([1, a1, a2]) for *_, a1, a2 in sections])
        assert np.abs(poles).max() < 1


def test_chunked_filters_equal_filters_of_whole_series(spark):
    r = np.random.default_rng(7)
    series = {1: r.normal(size=1000).cumsum(), 2: r.normal(size=37), 3: r.normal(size=28), 4: np.array([5.0]), 5: r.normal(size=2), 6: r.normal(size=400)}
    df = frame(spark, [(s, i, float(v)) for s, x in series.items() for i, v in enumerate(x)], "s int, idx int, v double").repartition(5)
    for sections in (K.band_sections(1, 45, 200.0), K.band_sections(None, 6, 200.0), K.notch(50, 30, 200.0)):
        for chunk, fold in ((64, 4), (7, 3), (1 << 14, 1 << 10)):
            got = RE.zero_phase(df, ["s"], "v", sections, chunk, fold).orderBy("s", "idx").collect()
            assert [(q.s, q.idx) for q in got] == [(s, i) for s, x in series.items() for i in range(len(x))]
            for s, x in series.items():
                assert [q.v for q in got if q.s == s] == pytest.approx(K.zero_phase(x, sections), abs=1e-9)


def test_cleaning_of_recordings_equals_cleaning_of_arrays(spark):
    r = np.random.default_rng(4)
    series = {"a": r.normal(size=700).cumsum(), "b": r.normal(size=300)}
    series["b"][5] = np.nan
    df = frame(spark, [(s, i, float(v)) for s, x in series.items() for i, v in enumerate(x)], "s string, idx int, v double")
    for rate, long, whole in ((200.0, RE.clean_eeg, K.clean_eeg), (1259.4, RE.clean_emg, K.clean_emg), (148.1, RE.clean_imu, K.clean_imu), (200.0, RE.power_envelope, K.power_envelope)):
        filled = df if long is not RE.power_envelope else df.filter("s = 'a'")
        got = long(filled, ["s"], "v", rate, chunk=100).orderBy("s", "idx").collect()
        for s in {q.s for q in got}:
            assert [q.v for q in got if q.s == s] == pytest.approx(whole(series[s], rate), abs=1e-7)
    assert RE.clean_imu(df.limit(0), ["s"], "v", 100.0).count() == 0


def plain_draws(rows, draws, tolerance):
    """Statistics of each draw, row by row; ranks by counting."""
    n, out = len(rows), []
    for d in range(draws):
        own = [rows[B.draw_index(d, k, n)] for k in range(n)]
        y, p = (np.array(v) for v in zip(*own))
        rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        r = lambda a, b: np.corrcoef(a, b)[0, 1] if a.var() > 1e-9 and b.var() > 1e-9 else np.nan
        out.append([np.abs(p - y).mean(), np.sqrt(((p - y) ** 2).mean()), 1 - ((p - y) ** 2).mean() / y.var() if y.var() > 1e-9 else np.nan, r(y, p), (np.abs(p - y) <= tolerance).mean(), r(rank(y), rank(p))])
    return np.array(out)


def test_draws_as_vectors_equal_draws_as_rows(spark):
    r = np.random.default_rng(9)
    groups = {"a": 40, "b": 3, "c": 1, "d": 150}
    rows = [(g, i * 3 % 1009, float(r.integers(0, 9)), float(r.integers(0, 9)), float(r.normal())) for g, n in groups.items() for i in range(n)]
    df = frame(spark, rows, "g string, id int, y double, p double, q double").repartition(5)
    names = ["mae", "rmse", "r2", "pearson", "tolerance", "spearman"]
    for held in (1 << 17, 2):
        got = B.draw_statistics(df, ["id"], 60, ["g"], "y", ["p", "q"], 2.0, held=held).orderBy("draw").collect()
        assert len(got) == 60 * 2 * len(groups)
        for g in groups:
            own = sorted((i, y, p, q) for k, i, y, p, q in rows if k == g)
            for pred, at in (("p", 2), ("q", 3)):
                want = plain_draws([(x[1], x[at]) for x in own], 60, 2.0)
                found = np.array([[np.nan if x[m] is None else x[m] for m in names] for x in got if x.g == g and x.pred == pred], float)
                assert np.allclose(found, want, atol=1e-7, equal_nan=True)
    assert B.draw_statistics(df.limit(0), ["id"], 10, [], "y", ["p"], 1.0).count() == 0
    named = B.draw_statistics(df.withColumn("id", F.col("id").cast("string")), ["id"], 5, [], "y", ["p"], 1.0)
    assert named.count() == 5


def test_row_numbers_of_groups(spark):
    rows = [(g, i % 7, i) for g in "xy" for i in range(400)]
    df = frame(spark, rows, "g string, v int, id int").repartition(4)
    got = B.numbered(df, ["v", "id"], ["g"]).collect()
    for g in "xy":
        assert [(q.v, q.id) for q in sorted((q for q in got if q.g == g), key=lambda q: q.row)] == sorted((v, i) for k, v, i in rows if k == g)
