"""What only shows on large groups: order of sums, numbers that meet, frames that are read again and again."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitwright.operators import aggregate as A
from gaitwright.operators import bootstrap as B
from gaitwright.operators import calibration as CA
from gaitwright.operators import cohort as H
from gaitwright.operators import kernels as K
from gaitwright.operators import recordings as R
from gaitwright.plans import QUERIES


def test_draws_in_blocks_are_the_draws_of_plain_loops(spark):
    r = np.random.default_rng(3)
    rows = [(g, i, *map(float, r.normal(size=3))) for g, n in (("a", 90), ("b", 37), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id int, y double, p double, q double").repartition(5)
    for block in (1 << 21, 40, 7):
        got = B.draw_statistics(df, ["id"], 30, ["g"], "y", ["p", "q"], 0.5, ranks=False, held=2, block=block).collect()
        assert len(got) == 30 * 2 * 3
        for q in got:
            own = sorted(x[1:] for x in rows if x[0] == q.g)
            picked = [own[B.draw_index(q.draw, s, len(own))] for s in range(len(own))]
            y, p = (np.array([x[i] for x in picked]) for i in (1, 2 if q.pred == "p" else 3))
            assert q.mae == pytest.approx(np.abs(p - y).mean()) and q.rmse == pytest.approx(math.sqrt(((p - y) ** 2).mean())) and q.tolerance == pytest.approx((np.abs(p - y) <= 0.5).mean())
            assert (q.pearson is None) if y.var() < 1e-9 else q.pearson == pytest.approx(np.corrcoef(y, p)[0, 1])


def test_block_counts_are_those_of_draw_index():
    for draw, n in ((0, 5), (19_999, 40_000), (123, 1 << 17)):
        want = np.bincount([B.draw_index(draw, s, n) for s in range(n)], minlength=n)
        for low, high in ((0, n), (n // 3, n)):
            out = np.empty(high - low)
            B._block_counts(draw, n, low, high, out, np.empty(n, np.int64))
            assert (out == want[low:high]).all()


def test_errors_that_differ_by_rounding_are_equal(spark):
    rows = [(0, i, 0.0, 0.1 + 0.2 if i % 2 else 0.3) for i in range(20)]
    got = H.error_order(spark.createDataFrame(rows, "fold int, subject_id int, y_true double, y_pred double").repartition(4), ["fold"], "subject_id").collect()
    assert [q.subject_id for q in sorted(got, key=lambda q: q.place)] == list(range(20))


def test_review_numbers_of_a_large_key_do_not_meet(spark, tmp_path):
    part = spark.createDataFrame([(k, k % 50) for k in (0, 50, 70, 350, 1000000, 1000070)], "p_partkey long, p_size int")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(q) for q in QUERIES["review_key_faults"](spark, str(tmp_path)).select("rater", "review_id", "problem").collect()}
    missing = {("a", k, "missing") for k in (0, 50, 350, 1000000)}
    assert got == missing | {("b", k + 1000000, "unknown") for k in (0, 70, 350)}


def test_attention_pooling_of_rows_equals_that_of_a_bag(spark):
    r = np.random.default_rng(5)
    bags = {g: r.normal(size=(n, 3)) * 50 for g, n in (("a", 300), ("b", 1))}
    rows = [(g, v.tolist(), float(v[0])) for g, x in bags.items() for v in x]
    got = A.attention_pooled(spark.createDataFrame(rows, "g string, f array<double>, s double").repartition(6), ["g"], "f", "s").collect()
    assert len(got) == 2
    for q in got:
        x = bags[q.g]
        w = np.exp(x[:, 0] - x[:, 0].max())
        assert np.allclose(q.f, np.r_[(w[:, None] * x).sum(axis=0) / w.sum(), x.mean(axis=0), x.max(axis=0)])


def test_attention_query_gathers_no_bag(spark, sf_dir):
    plan = QUERIES["pooled_by_attention"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(transform" not in plan and "posexplode" in plan


def test_calibration_of_many_rows_between_two_steps(spark):
    rows = spark.range(60_000).select(F.lit(0).alias("g"), (0.25 + F.col("id") / 120_000).alias("y_pred"))
    blocks = spark.createDataFrame([(0, 0.0, 0.1, 1.0, 1.0), (0, 0.9, 1.0, 1.0, 3.0)], "g int, low double, high double, weight double, value double")
    done = CA.isotonic_calibrated(rows, blocks, ["g"])
    began = time.time()
    off = done.select(F.max(F.abs(F.col("calibrated") - (1 + 2 * (F.col("y_pred") - 0.1) / 0.8))), F.count("*")).first()
    assert off[0] < 1e-9 and off[1] == 60_000
    assert time.time() - began < 30
    assert "rangeframe, currentrow" not in done._jdf.queryExecution().optimizedPlan().toString().lower()


def test_short_series_are_not_folded_and_share_tables(spark, monkeypatch):
    r = np.random.default_rng(7)
    series = {k: r.normal(size=int(n)) for k, n in enumerate((1, 2, 40, 90, 300))}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "s int, idx long, v double").repartition(4)
    sections = K.band_sections(8, 30, 200.0)
    seen, whole = [], R._starts
    monkeypatch.setattr(R, "_starts", lambda sums, *rest: seen.append({q.s for q in sums.select("s").distinct().collect()}) or whole(sums, *rest))
    for chunk in (1 << 14, 128):
        got = R.zero_phase(df, ["s"], "v", sections, chunk, 2).orderBy("s", "idx").collect()
        for k, x in series.items():
            assert np.allclose([q.v for q in got if q.s == k], K.zero_phase(x, sections) if len(x) > 1 else x, atol=1e-8)
    assert seen and all(0 not in s and 4 in s for s in seen)
    K._tables.cache_clear()
    for x in series.values():
        K.zero_phase(x, sections)
    assert K._tables.cache_info().misses == len(sections)
