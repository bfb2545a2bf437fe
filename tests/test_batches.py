"""Wide rows travel in small batches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaitwright.operators import series as S
from gaitwright.operators import textscores as X

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def large_batches(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, 10_000)
    yield
    spark.conf.set(KEY, before)


def test_texts_and_series_travel_in_small_batches(spark, large_batches):
    pairs = spark.createDataFrame([(1, "a b", "b a")], "k int, h string, r string")
    assert X.overlap_counts(pairs, ["k"], X.words(F.col("h")), X.words(F.col("r")), 1).first().match_1 == 2
    assert int(spark.conf.get(KEY)) <= 256
    spark.conf.set(KEY, 10_000)
    df = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "s int, idx long, v double")
    assert S.lag_scores(df, df, ["s"], "idx", "v", 1).count() == 3
    assert int(spark.conf.get(KEY)) <= 256


def test_long_and_short_pairs_are_counted_alike():
    r = random.Random(3)
    for n, m in ((0, 0), (0, 300), (1, 250), (3, 2), (150, 150), (400, 90)):
        h, ref = ([r.choice("abcdé ") for _ in range(k)] for k in (n, m))
        want = [sum((Counter(zip(*(h[i:] for i in range(k)))) & Counter(zip(*(ref[i:] for i in range(k))))).values()) for k in range(1, 5)]
        assert X.shared_ngrams(h, ref, 4) == want


def test_a_pair_is_counted_once_for_all_its_groups(spark):
    rows = spark.createDataFrame([("a b c d e", "a b c d f", "x", True), ("q r s t", "q r s t", None, True), ("no", "no", "x", False)], "hyp string, ref string, role string, has_human_reference boolean")
    scored = X.scored_groups(rows, ["role"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert {(q.group, q.n): (round(q.rouge1_f, 6), round(q.word_bleu1, 6), round(q.rougeL_f, 6)) for q in scored.collect()} == {("all", 2): (90.0, pytest.approx(800 / 9, abs=1e-5), 90.0), ("x", 1): (80.0, 80.0, 80.0)}
    assert plan.count("ArrowEvalPython") == 1 and plan.index("Generate") < plan.index("ArrowEvalPython")
