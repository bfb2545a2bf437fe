"""Queries over trial predictions: orders are trials of a customer, line items give the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitwright.operators import aggregate as A
from gaitwright.operators import bootstrap as B
from gaitwright.operators import contracts as P
from gaitwright.operators import metrics as M

from .registry import load, query

TOL = 60000.0
BAGS_SQL = """
li AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS y_pred, sum(l_extendedprice) AS plain, sum(l_extendedprice * (1 + l_tax)) AS taxed FROM lineitem GROUP BY 1),
bags AS (SELECT o_custkey % 3 AS fold, o_custkey AS subject_id, o_orderkey AS trial_id, o_totalprice AS y_true, y_pred, plain, taxed FROM orders JOIN li ON o_orderkey = l_orderkey)"""
PATIENTS_SQL = BAGS_SQL + """,
patients AS (SELECT fold, subject_id, min(y_true) AS y_true, median(least(greatest(y_pred, 0), 500000)) AS y_pred, count(*) AS n_bags FROM bags GROUP BY 1, 2)"""
CLASSES_SQL = BAGS_SQL + """,
cls AS (SELECT fold, subject_id, trial_id, CAST(least(5, floor(y_true / 60000)) AS INT) AS y_true, CAST(least(5, floor(y_pred / 60000)) AS INT) AS y_pred FROM bags)"""


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, price = load(spark, sf_dir, "lineitem"), F.col("l_extendedprice")
    sums = li.groupBy("l_orderkey").agg(F.sum(price * (1 - F.col("l_discount"))).alias("y_pred"), F.sum(price).alias("plain"), F.sum(price * (1 + F.col("l_tax"))).alias("taxed"))
    orders = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("fold"), F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("trial_id"), F.col("o_totalprice").alias("y_true"))
    return orders.join(sums, orders.trial_id == sums.l_orderkey).drop("l_orderkey")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.subject_regression(bags(spark, sf_dir), ["fold", "subject_id"], 0, 500000)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda x: F.least(F.lit(5), F.floor(F.col(x) / 60000)).cast("int")
    return bags(spark, sf_dir).select("fold", "subject_id", "trial_id", c("y_true").alias("y_true"), c("y_pred").alias("y_pred"))


def rounded(df: DataFrame, *names: str, digits: int = 5) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


REG = ("mae", "rmse", "r2", "pearson", "spearman", "nmae", "bias", "loa_low", "loa_high", "rounded_acc", "tolerance_acc")
REG_SQL = """
rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY y_true) + (count(*) OVER (PARTITION BY fold, y_true) - 1) / 2.0 AS rt,
              rank() OVER (PARTITION BY fold ORDER BY y_pred) + (count(*) OVER (PARTITION BY fold, y_pred) - 1) / 2.0 AS rp FROM patients),
m AS (SELECT fold, count(*) AS n, avg(abs(y_pred - y_true)) AS mae, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, 1 - sum((y_pred - y_true) ** 2) / regr_syy(y_true, y_true) AS r2,
      corr(y_true, y_pred) AS pearson, corr(rt, rp) AS spearman, avg(abs(y_pred - y_true)) / (max(y_true) - min(y_true)) AS nmae, avg(y_pred - y_true) AS bias,
      avg(y_pred - y_true) - 1.96 * stddev_pop(y_pred - y_true) AS loa_low, avg(y_pred - y_true) + 1.96 * stddev_pop(y_pred - y_true) AS loa_high,
      avg((abs(floor(y_pred / 1000.0 + 0.5) * 1000.0 - floor(y_true / 1000.0 + 0.5) * 1000.0) <= 20000)::INT) AS rounded_acc, avg((abs(y_pred - y_true) <= 60000)::INT) AS tolerance_acc
      FROM rk GROUP BY fold)"""


def _fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.regression_metrics(patients(spark, sf_dir), ["fold"], TOL, 1000.0, 20000.0)


@query("WITH " + PATIENTS_SQL + "," + REG_SQL + " SELECT fold, n, " + ", ".join(f"round({m}, 3) AS {m}" for m in REG) + " FROM m")
def fold_regression_metrics(spark, sf_dir):
    return rounded(_fold_metrics(spark, sf_dir), *REG, digits=3)


@query("WITH " + PATIENTS_SQL + "," + REG_SQL + " SELECT metric, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, count(value) AS n_folds FROM (UNPIVOT (SELECT fold, mae, rmse, r2, pearson FROM m) ON mae, rmse, r2, pearson INTO NAME metric VALUE value) GROUP BY metric")
def metrics_over_folds(spark, sf_dir):
    return rounded(M.over_folds(_fold_metrics(spark, sf_dir), ["mae", "rmse", "r2", "pearson"]), "mean", "std")


@query("WITH " + PATIENTS_SQL + " SELECT fold, subject_id, round(y_true, 7) AS y_true, round(y_pred, 7) AS y_pred, n_bags FROM patients")
def patient_medians(spark, sf_dir):
    return rounded(patients(spark, sf_dir), "y_true", "y_pred", digits=7)


@query("WITH " + BAGS_SQL + " SELECT subject_id, round(least(greatest(median(y_pred), 100000), 150000), 5) AS y_pred FROM bags GROUP BY 1")
def patient_medians_clipped_after(spark, sf_dir):
    return rounded(A.subject_regression(bags(spark, sf_dir), ["subject_id"], 100000, 150000, clip_first=False).select("subject_id", "y_pred"), "y_pred")


@query("WITH " + PATIENTS_SQL + """ SELECT fold, count(*) AS n, round(avg(abs(e)), 5) AS mae, round(avg(e), 5) AS mean_error, round(median(e), 5) AS median_error, round(median(abs(e)), 5) AS median_abs_error,
round(stddev_samp(e), 5) AS sd_error, sum((abs(e) <= 60000)::INT)::BIGINT AS hits FROM (SELECT *, y_pred - y_true AS e FROM patients) GROUP BY fold""")
def patient_error_summary(spark, sf_dir):
    return rounded(M.error_summary(patients(spark, sf_dir), ["fold"], TOL), "mae", "mean_error", "median_error", "median_abs_error", "sd_error")


@query("WITH " + CLASSES_SQL + """, grid AS (SELECT f.fold, t.i AS y_true, p.i AS y_pred FROM (SELECT DISTINCT fold FROM cls) f, (SELECT unnest(range(6))::INT AS i) t, (SELECT unnest(range(6))::INT AS i) p),
n AS (SELECT fold, y_true, y_pred, count(*) AS n FROM cls GROUP BY ALL), c AS (SELECT grid.*, coalesce(n, 0) AS n FROM grid LEFT JOIN n USING (fold, y_true, y_pred))
SELECT *, round(CASE WHEN sum(n) OVER (PARTITION BY fold, y_true) > 0 THEN n / sum(n) OVER (PARTITION BY fold, y_true) ELSE 0 END, 6) AS share FROM c""")
def ordinal_confusion(spark, sf_dir):
    return rounded(M.normalised_confusion(M.confusion(classes(spark, sf_dir), ["fold"], 6), ["fold"]), "share", digits=6)


CELLS_SQL = CLASSES_SQL + ", k AS (SELECT unnest(range(6))::INT AS cls), t AS (SELECT fold, y_true AS cls, count(*) AS support FROM cls GROUP BY 1, 2), g AS (SELECT fold, y_pred AS cls, count(*) AS given FROM cls GROUP BY 1, 2), h AS (SELECT fold, y_true AS cls, count(*) AS tp FROM cls WHERE y_true = y_pred GROUP BY 1, 2), " \
    "r AS (SELECT f.fold, k.cls, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(given, 0) AS given FROM (SELECT DISTINCT fold FROM cls) f CROSS JOIN k LEFT JOIN t ON t.fold = f.fold AND t.cls = k.cls LEFT JOIN g ON g.fold = f.fold AND g.cls = k.cls LEFT JOIN h ON h.fold = f.fold AND h.cls = k.cls)"  # fmt: skip


@query("WITH " + CELLS_SQL + " SELECT fold, cls, round(CASE WHEN given > 0 THEN tp / given ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round(CASE WHEN support + given > 0 THEN 2 * tp / (support + given) ELSE 0 END, 6) AS f1, support FROM r")
def class_report(spark, sf_dir):
    return rounded(M.class_report(M.confusion(classes(spark, sf_dir), ["fold"], 6), ["fold"]), "precision", "recall", "f1", digits=6)


@query("WITH " + CELLS_SQL + """, lab AS (SELECT fold, c, row_number() OVER (PARTITION BY fold ORDER BY c) AS i FROM (SELECT fold, y_true AS c FROM cls UNION SELECT fold, y_pred FROM cls)),
p AS (SELECT cls.fold, a.i AS it, b.i AS ip FROM cls JOIN lab a ON a.fold = cls.fold AND a.c = y_true JOIN lab b ON b.fold = cls.fold AND b.c = y_pred),
o AS (SELECT fold, count(*) AS n, avg((it = ip)::INT) AS accuracy, sum(abs(it - ip)) AS far FROM p GROUP BY fold),
e AS (SELECT x.fold, sum((x.it = y.ip)::INT * x.n * y.n) AS same, sum(abs(x.it - y.ip) * x.n * y.n) AS apart FROM (SELECT fold, it, count(*) AS n FROM p GROUP BY ALL) x JOIN (SELECT fold, ip, count(*) AS n FROM p GROUP BY ALL) y ON x.fold = y.fold GROUP BY x.fold),
f AS (SELECT fold, avg(CASE WHEN support + given > 0 THEN 2 * tp / (support + given) ELSE 0 END) AS macro_f1 FROM r GROUP BY fold)
SELECT o.fold, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round((accuracy - same / (n * n)) / (1 - same / (n * n)), 6) AS kappa, round(1 - far * n / apart, 6) AS weighted_kappa FROM o JOIN e USING (fold) JOIN f USING (fold)""")
def ordinal_metrics(spark, sf_dir):
    return rounded(M.class_metrics(M.confusion(classes(spark, sf_dir), ["fold"], 6), ["fold"]), "accuracy", "macro_f1", "kappa", "weighted_kappa", digits=6)


@query("WITH " + CLASSES_SQL + " SELECT subject_id, y_pred, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, y_pred) AS r FROM (SELECT subject_id, y_pred, count(*) AS n FROM cls GROUP BY 1, 2)) WHERE r = 1")
def majority_votes(spark, sf_dir):
    return A.majority(classes(spark, sf_dir), ["subject_id"], "y_pred")


@query("WITH " + BAGS_SQL + ", p AS (SELECT subject_id, min(CAST(y_true > 150000 AS INT)) AS y_true, avg(y_pred / (plain + taxed + y_pred)) AS p0, avg(plain / (plain + taxed + y_pred)) AS p1, avg(taxed / (plain + taxed + y_pred)) AS p2 FROM bags GROUP BY 1) SELECT subject_id, y_true, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS y_pred FROM p")
def mean_probability_classes(spark, sf_dir):
    total = F.col("plain") + F.col("taxed") + F.col("y_pred")
    b = bags(spark, sf_dir).select("subject_id", (F.col("y_true") > 150000).cast("int").alias("y_true"), (F.col("y_pred") / total).alias("p0"), (F.col("plain") / total).alias("p1"), (F.col("taxed") / total).alias("p2"))
    return rounded(A.subject_classes(b, ["subject_id"], ["p0", "p1", "p2"]), "p0", "p1", "p2", digits=6)


@query("WITH " + PATIENTS_SQL + """, e AS (SELECT fold, list_distinct([quantile_cont(y_pred, 0.0), quantile_cont(y_pred, 0.2), quantile_cont(y_pred, 0.4), quantile_cont(y_pred, 0.6), quantile_cont(y_pred, 0.8), quantile_cont(y_pred, 1.0)]) AS edges FROM patients GROUP BY fold)
SELECT fold, bin, count(*) AS n, round(avg(y_true), 5) AS mean_true, round(avg(y_pred), 5) AS mean_pred, round(avg(abs(y_true - y_pred)), 5) AS mae
FROM (SELECT p.*, greatest(0, len(list_filter(edges, lambda x: x < y_pred)) - 1)::INT AS bin FROM patients p JOIN e USING (fold)) GROUP BY 1, 2""")
def calibration_bins(spark, sf_dir):
    return rounded(M.calibration(patients(spark, sf_dir), ["fold"]), "mean_true", "mean_pred", "mae")


@query("WITH " + PATIENTS_SQL + " SELECT subject_id, round((y_true + y_pred) / 2, 7) AS ba_mean, round(y_pred - y_true, 7) AS ba_diff FROM patients")
def bland_altman_points(spark, sf_dir):
    return rounded(M.bland_altman_points(patients(spark, sf_dir)).select("subject_id", "ba_mean", "ba_diff"), "ba_mean", "ba_diff", digits=7)


@query("WITH " + PATIENTS_SQL + " SELECT fold, round(avg(y_pred - y_true), 5) AS bias, round(avg(y_pred - y_true) - 1.96 * stddev_samp(y_pred - y_true), 5) AS low, round(avg(y_pred - y_true) + 1.96 * stddev_samp(y_pred - y_true), 5) AS high FROM patients GROUP BY fold")
def bland_altman_limits(spark, sf_dir):
    return rounded(M.bland_altman_limits(patients(spark, sf_dir), ["fold"]), "bias", "low", "high")


@query("WITH " + PATIENTS_SQL + " SELECT fold, t::DOUBLE AS threshold, round(avg((abs(y_pred - y_true) <= t)::INT), 6) AS coverage FROM patients, (SELECT unnest([10000, 30000, 60000, 120000]) AS t) GROUP BY 1, 2")
def tolerance_curve(spark, sf_dir):
    return rounded(M.tolerance_curve(patients(spark, sf_dir), ["fold"], [10000, 30000, 60000, 120000]), "coverage", digits=6)


TWO_SQL = BAGS_SQL + ", two AS (SELECT fold, subject_id, min(y_true) AS y_true, median(y_pred) AS a, median(taxed) AS b FROM bags GROUP BY 1, 2)"


def two_models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b, by = bags(spark, sf_dir), ["fold", "subject_id"]
    first = A.subject_regression(b, by, -1e18, 1e18).drop("n_bags")
    return first, A.subject_regression(b.withColumn("y_pred", F.col("taxed")), by, -1e18, 1e18).drop("n_bags")


@query("WITH " + TWO_SQL + """ SELECT fold, transition, count(*) AS n FROM (SELECT fold, CASE WHEN abs(a - y_true) <= 60000 AND abs(b - y_true) <= 60000 THEN 'both' WHEN abs(b - y_true) <= 60000 THEN 'gained'
WHEN abs(a - y_true) <= 60000 THEN 'lost' ELSE 'neither' END AS transition FROM two) GROUP BY 1, 2""")
def paired_transitions(spark, sf_dir):
    return M.transitions(*two_models(spark, sf_dir), ["fold", "subject_id", "y_true"], TOL).groupBy("fold", "transition").agg(F.count("*").alias("n"))


CONF_SQL = PATIENTS_SQL + """, ca AS (SELECT abs(y_pred - y_true) AS e FROM patients WHERE fold = 0), k AS (SELECT count(*) AS n, least(count(*), ceil((count(*) + 1) * 0.9))::BIGINT AS k FROM ca),
rad AS (SELECT e AS radius, n AS n_calibration FROM (SELECT e, row_number() OVER (ORDER BY e) AS i FROM ca), k WHERE i = k.k)"""


@query("WITH " + CONF_SQL + " SELECT round(radius, 5) AS radius, n_calibration, n, round(coverage, 6) AS coverage FROM rad, (SELECT count(*) AS n, avg((y_true >= y_pred - radius AND y_true <= y_pred + radius)::INT) AS coverage FROM patients, rad WHERE fold = 1)")
def conformal_coverage(spark, sf_dir):
    p = patients(spark, sf_dir)
    radius = M.conformal_radius(p.filter("fold = 0"), [], 0.1)
    rows = M.conformal_intervals(p.filter("fold = 1"), radius, [])
    return rounded(rows.groupBy(F.round("radius", 5).alias("radius"), "n_calibration").agg(F.count("*").alias("n"), F.avg(F.col("covered").cast("int")).alias("coverage")), "coverage", digits=6)


@query("WITH " + PATIENTS_SQL + " SELECT subject_id, round(round_even(y_pred / 10000, 0), 5) AS y_pred_rounded, abs(y_pred - y_true) / 10000 <= 6.5 AS within FROM patients")
def patient_rounding_flags(spark, sf_dir):
    scaled = patients(spark, sf_dir).select("subject_id", (F.col("y_true") / 10000).alias("y_true"), (F.col("y_pred") / 10000).alias("y_pred"))
    return M.patient_flags(scaled, 6.0).select("subject_id", "y_pred_rounded", "within")


# ---- ablation and leaderboards ---------------------------------------------------------------

LONG_SQL = """v AS (SELECT l_returnflag AS kind, l_linestatus AS variant, l_linenumber AS fold, avg(l_quantity) AS mae, avg(l_discount) AS r2, avg(l_tax) AS acc FROM lineitem GROUP BY 1, 2, 3),
long AS (UNPIVOT v ON mae, r2, acc INTO NAME metric VALUE value),
tab AS (SELECT kind, variant, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(*) AS n_folds FROM long GROUP BY 1, 2, 3)"""


def ablation_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("variant"), F.col("l_linenumber").alias("fold"))
    return A.long_metrics(v.agg(F.avg("l_quantity").alias("mae"), F.avg("l_discount").alias("r2"), F.avg("l_tax").alias("acc")), ["kind", "variant", "fold"], ["mae", "r2", "acc"])


def _table(spark, sf_dir):
    return A.ablation_table(ablation_long(spark, sf_dir), ["kind", "variant"])


@query("WITH " + LONG_SQL + " SELECT kind, variant, metric, round(mean, 8) AS mean, round(std, 8) AS std, n_folds FROM tab")
def ablation_table(spark, sf_dir):
    return rounded(_table(spark, sf_dir), "mean", "std", digits=8)


@query("WITH " + LONG_SQL + ", ".join([" SELECT kind, variant"] + [f"round(max(CASE WHEN metric = '{m}' THEN {s} END), 8) AS {m}_{s}" for m in ("mae", "r2", "acc") for s in ("mean", "std")]) + " FROM tab GROUP BY 1, 2")
def ablation_wide(spark, sf_dir):
    wide = A.wide_table(_table(spark, sf_dir), ["kind", "variant"], ["mae", "r2", "acc"])
    return rounded(wide, *wide.columns[2:], digits=8)


@query("WITH " + LONG_SQL + ", s AS (SELECT *, min(mean) OVER (PARTITION BY metric) AS lo, max(mean) OVER (PARTITION BY metric) AS hi FROM tab) SELECT kind, variant, metric, round(0.82 + 0.18 * CASE WHEN hi - lo < 1e-12 THEN 1 WHEN metric = 'mae' THEN 1 - (mean - lo) / (hi - lo) ELSE (mean - lo) / (hi - lo) END, 6) AS score, round((mean - lo) / greatest(hi - lo, 1e-9), 6) AS scaled FROM s")
def ablation_radar(spark, sf_dir):
    scored = A.pivot_min_max(A.unified_scores(_table(spark, sf_dir), ["mae"]))
    return rounded(scored.select("kind", "variant", "metric", "score", "scaled"), "score", "scaled", digits=6)


@query("WITH " + LONG_SQL + " SELECT kind, variant, round(mean, 8) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY mean, variant) AS r FROM tab WHERE metric = 'mae') WHERE r = 1")
def best_seed(spark, sf_dir):
    return rounded(A.best_seed(_table(spark, sf_dir).filter("metric = 'mae'"), ["kind"], "variant", "mean", lower=True), "mean", digits=8)


@query("""WITH m AS (SELECT p_brand AS model, avg(p_retailprice) AS mean, coalesce(stddev_samp(p_retailprice), 0) AS std, count(*) AS n FROM part GROUP BY 1)
SELECT model, round(mean, 5) AS mean, round(std, 5) AS std, n, row_number() OVER (ORDER BY mean DESC, model)::INT AS place, round(mean - lead(mean) OVER (ORDER BY mean DESC, model), 5) AS margin FROM m""")
def leaderboard(spark, sf_dir):
    return rounded(A.leaderboard(load(spark, sf_dir, "part").withColumnRenamed("p_brand", "model"), "model", "p_retailprice"), "mean", "std", "margin")


W_SQL = """t AS (SELECT o_custkey AS subject_id, o_orderkey AS trial_id, o_totalprice AS value, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 11 END::DOUBLE AS alignment_score, sqrt(o_orderkey % 13) AS signal_quality, sqrt(o_orderkey % 17) AS prediction_uncertainty FROM orders),
f AS (SELECT * REPLACE (coalesce(alignment_score, (SELECT median(alignment_score) FROM t)) AS alignment_score) FROM t),
s AS (SELECT *, (alignment_score - min(alignment_score) OVER ()) / (max(alignment_score) OVER () - min(alignment_score) OVER ()) AS a, (signal_quality - min(signal_quality) OVER ()) / (max(signal_quality) OVER () - min(signal_quality) OVER ()) AS q,
 1 - (prediction_uncertainty - min(prediction_uncertainty) OVER ()) / (max(prediction_uncertainty) OVER () - min(prediction_uncertainty) OVER ()) AS u FROM f),
w AS (SELECT subject_id, trial_id, value, greatest(1e-3, 0.45 * a + 0.35 * q + 0.2 * u) AS qw, greatest(1e-3, u) AS cw, 0.6 * greatest(1e-3, 0.45 * a + 0.35 * q + 0.2 * u) + 0.4 * greatest(1e-3, u) AS hw FROM s)"""


def weighted_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"), k.alias("trial_id"), F.col("o_totalprice").alias("value"), F.when(k % 7 != 0, k % 11).cast("double").alias("alignment_score"), F.sqrt(k % 13).alias("signal_quality"), F.sqrt(k % 17).alias("prediction_uncertainty"))
    return A.trial_weights(t)


@query("WITH " + W_SQL + " SELECT subject_id, round(avg(value), 7) AS mean, round(median(value), 7) AS median, round(sum(value * qw) / sum(qw), 4) AS quality_weighted, round(sum(value * cw) / sum(cw), 4) AS uncertainty_weighted, round(sum(value * hw) / sum(hw), 4) AS hybrid_weighted, count(value) AS n FROM w GROUP BY 1")
def subject_aggregation(spark, sf_dir):
    return rounded(A.subject_means(weighted_trials(spark, sf_dir), ["subject_id"], "value").withColumns({c: F.round(c, 7) for c in ("mean", "median")}), "quality_weighted", "uncertainty_weighted", "hybrid_weighted", digits=4)


WM_SQL = W_SQL + ", wm AS (SELECT subject_id, min(value) AS weighted_median FROM (SELECT subject_id, value, sum(hw) OVER (PARTITION BY subject_id ORDER BY value) / sum(hw) OVER (PARTITION BY subject_id) AS f FROM w) WHERE f >= 0.5 - 1e-12 GROUP BY 1)"


@query("WITH " + WM_SQL + " SELECT * FROM wm")
def weighted_medians(spark, sf_dir):
    return A.weighted_median(weighted_trials(spark, sf_dir), ["subject_id"], "value", "hybrid_weight")


@query("WITH " + WM_SQL + """, d AS (SELECT w.*, abs(value - weighted_median) AS d FROM w JOIN wm USING (subject_id)), g AS (SELECT subject_id, count(*) AS n, greatest(0.35, 1.4826 * median(d)) AS s, quantile_cont(d, 0.75) AS q, min(d) AS l FROM d GROUP BY 1)
SELECT subject_id, round(sum(value * hw) / sum(hw), 4) AS robust, count(*) AS n_kept FROM d JOIN g USING (subject_id) WHERE n <= 2 OR CASE WHEN l <= 1.75 * s THEN d <= 1.75 * s ELSE d <= q END GROUP BY 1""")
def robust_hybrid(spark, sf_dir):
    return rounded(A.robust_hybrid(weighted_trials(spark, sf_dir), ["subject_id"], "value", "hybrid_weight"), "robust", digits=4)


@query("WITH c AS (SELECT quality AS cls, count(*) AS n FROM labels GROUP BY 1), k AS (SELECT unnest(range(3))::INT AS cls) SELECT k.cls, coalesce(n, 0) AS n, round(CASE WHEN n > 0 THEN (SELECT count(*) FROM labels) / (3 * n) ELSE 0 END, 8) AS weight, round(CASE WHEN n > 0 THEN 1 / sqrt(n) ELSE 0 END, 8) AS sampling_weight FROM k LEFT JOIN c USING (cls)")
def class_weights(spark, sf_dir):
    return rounded(A.class_weights(load(spark, sf_dir, "labels"), "quality", 3), "weight", "sampling_weight", digits=8)


BOOT_SQL = """p AS (SELECT fold, subject_id, y_true, a, b, row_number() OVER (PARTITION BY fold ORDER BY subject_id) - 1 AS row, count(*) OVER (PARTITION BY fold) AS n FROM two),
z AS (SELECT fold, draw, n, ((draw * n + slot) * 48271 + 11) % 2147483647 AS z1 FROM (SELECT DISTINCT fold, n FROM p), (SELECT unnest(range(20000)) AS draw), LATERAL (SELECT unnest(range(n)) AS slot)),
y AS (SELECT fold, draw, n, ((z1 * z1) % 2147483647 * 3 + z1 * 69621 + 7) % 2147483647 AS z2 FROM z),
i AS (SELECT fold, draw, ((z2 * z2) % 2147483647 + z2 * 16807 + 5) % 2147483647 % n AS row FROM y),
dr AS (SELECT i.fold, draw, avg(abs(b - y_true)) - avg(abs(a - y_true)) AS d_mae, avg(abs(a - y_true)) AS mae FROM i JOIN p ON p.fold = i.fold AND p.row = i.row GROUP BY 1, 2)"""


def _draws(spark, sf_dir):
    base, cand = two_models(spark, sf_dir)
    paired = base.join(cand.withColumnRenamed("y_pred", "cand"), ["fold", "subject_id", "y_true"])
    per = B.draw_statistics(paired, ["subject_id"], 20_000, ["fold"], "y_true", ["y_pred", "cand"], 0.0, ranks=False)
    mae = lambda c: F.max(F.when(F.col("pred") == c, F.col("mae")))
    return per.groupBy("fold", "draw").agg(mae("y_pred").alias("mae"), (mae("cand") - mae("y_pred")).alias("d_mae"))


@query("WITH " + TWO_SQL + ", " + BOOT_SQL + " SELECT fold, round(quantile_cont(mae, 0.025), 4) AS low, round(quantile_cont(mae, 0.975), 4) AS high, count(*) AS draws FROM dr GROUP BY fold")
def bootstrap_mae(spark, sf_dir):
    return rounded(B.bootstrap_interval(_draws(spark, sf_dir), ["fold"], "mae"), "low", "high", digits=4)


@query("WITH " + TWO_SQL + ", " + BOOT_SQL + " SELECT fold, round(quantile_cont(d_mae, 0.025), 4) AS low, round(quantile_cont(d_mae, 0.975), 4) AS high, count(*) AS draws FROM dr GROUP BY fold")
def paired_bootstrap(spark, sf_dir):
    return rounded(B.bootstrap_interval(_draws(spark, sf_dir), ["fold"], "d_mae"), "low", "high", digits=4)


@query("WITH " + TWO_SQL + """, g AS (SELECT fold, w / 20 AS w, avg(abs(w / 20 * a + (1 - w / 20) * b - y_true)) AS mae FROM two, (SELECT unnest(range(21)) AS w) GROUP BY ALL)
SELECT fold, w, round(mae, 4) AS mae FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(mae, 6), abs(w - 0.5)) AS r FROM g) WHERE r = 1""")
def ensemble_weight(spark, sf_dir):
    base, cand = two_models(spark, sf_dir)
    on = base.join(cand.withColumnRenamed("y_pred", "cand"), ["fold", "subject_id", "y_true"])
    tried = on.groupBy("fold").agg(F.array(*(F.struct(F.round(F.avg(F.abs(i / 20 * F.col("y_pred") + (1 - i / 20) * F.col("cand") - F.col("y_true"))), 6).alias("mae"), F.lit(abs(i / 20 - 0.5)).alias("off"), F.lit(i / 20).alias("w")) for i in range(21))).alias("g"))
    return tried.select("fold", F.array_min("g").alias("b")).select("fold", "b.w", F.round("b.mae", 4).alias("mae"))


@query("WITH " + PATIENTS_SQL + " SELECT fold, round(regr_slope(y_true, y_pred), 8) AS slope, round(regr_intercept(y_true, y_pred), 4) AS intercept FROM patients GROUP BY fold")
def linear_calibrator(spark, sf_dir):
    return patients(spark, sf_dir).groupBy("fold").agg(F.round(F.regr_slope("y_true", "y_pred"), 8).alias("slope"), F.round(F.regr_intercept("y_true", "y_pred"), 4).alias("intercept"))


# ---- constraints -----------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_trial_keys(spark, sf_dir):
    return P.repeated_keys(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def changing_labels(spark, sf_dir):
    return P.changing_labels(load(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT c_custkey AS id, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'unused' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def missing_and_unused_subjects(spark, sf_dir):
    return P.missing_and_unused(load(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id"), load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id"), "id")


@query("SELECT p_type, p_size, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 3 END AS code, CASE WHEN p_size % 5 = 0 THEN NULL ELSE (['0', '1', '1+'])[p_size % 3 + 1] END AS label FROM part")
def label_codes(spark, sf_dir):
    s = F.col("p_size")
    names = F.when(s % 5 == 0, F.lit(" NaN ")).when(s % 3 == 2, F.lit(" 1+ ")).otherwise((s % 3).cast("string"))
    kept = load(spark, sf_dir, "part").select("p_type", "p_size", P.normal_label(names).alias("name"))
    return kept.select("p_type", "p_size", P.encode_label(F.col("name"), ["0", "1", "1+"]).alias("code")).withColumn("label", P.decode_label(F.col("code"), ["0", "1", "1+"]))


@query("SELECT k.s AS p_size, count(DISTINCT p_brand) AS n_subjects FROM (SELECT unnest(range(60))::INT AS s) k LEFT JOIN part ON p_size = s GROUP BY 1 HAVING count(DISTINCT p_brand) < 20")
def rare_classes(spark, sf_dir):
    return P.rare_classes(load(spark, sf_dir, "part"), "p_brand", "p_size", spark.range(60).select(F.col("id").cast("int").alias("p_size")), 20)
