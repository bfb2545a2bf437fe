"""Evaluation of predictions: regression, ordinal classes, calibration, intervals, comparison.

All take a frame with ``y_true`` and ``y_pred`` and the columns to group by. Counts that a metric
needs per class or rank are aggregated first, so no window runs over all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order

NAN = float("nan")


def average_ranks(df: DataFrame, by: Sequence[str], *values: str) -> DataFrame:
    """``df`` with ``rank_<value>``: average ranks within ``by``. Ties share the mean of their ranks.

    Ranks come from the counts of distinct values, which are joined back; no group is ordered in one task.
    """
    for v in values:
        ranks = order.counts_below(df, by, v).select(*by, v, (F.col("below") + (F.col("n") + 1) / 2).alias(f"rank_{v}"))
        df = df.join(ranks, [*by, v])
    return df


def _correlation(a: str, b: str) -> Column:
    """Pearson's r; null for a flat side, where the plain function divides by zero."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def regression_metrics(df: DataFrame, by: Sequence[str], tolerance: float, bin_step: float = 1.0, rounded_tolerance: float = 0.0) -> DataFrame:
    """MAE, RMSE, R² (NaN for a flat truth), Pearson and Spearman (NaN under 3 rows or for a flat side),
    normalised MAE, Bland-Altman bias and limits with the population SD, shares within tolerances.

    Rounding here is half up (floor of x + 0.5). Null and NaN rows are left out.
    """
    ok = df.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull() & ~F.isnan("y_true") & ~F.isnan("y_pred"))
    e = F.col("y_pred") - F.col("y_true")
    ranked = average_ranks(ok, by, "y_true", "y_pred")
    up = lambda c: F.floor(F.col(c) / bin_step + 0.5) * bin_step
    m = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), F.regr_syy("y_true", "y_true").alias("sst"),
        F.stddev_pop("y_true").alias("st"), F.stddev_pop("y_pred").alias("sp"), _correlation("y_true", "y_pred").alias("r"), _correlation("rank_y_true", "rank_y_pred").alias("rho"),
        (F.max("y_true") - F.min("y_true")).alias("span"), F.avg(e).alias("bias"), F.stddev_pop(e).alias("sd"),
        F.avg((F.abs(up("y_pred") - up("y_true")) <= rounded_tolerance).cast("int")).alias("rounded_acc"), F.avg((F.abs(e) <= tolerance).cast("int")).alias("tolerance_acc"),
    )
    flat = (F.col("n") < 3) | (F.col("st") < 1e-9) | (F.col("sp") < 1e-9)
    return m.select(
        *by, "n", "mae", "rmse", F.when(F.col("sst") / F.col("n") <= 1e-9, NAN).otherwise(1 - F.col("sse") / F.col("sst")).alias("r2"),
        F.when(flat, NAN).otherwise(F.col("r")).alias("pearson"), F.when(flat, NAN).otherwise(F.col("rho")).alias("spearman"),
        F.when(F.col("span") > 0, F.col("mae") / F.col("span")).otherwise(NAN).alias("nmae"), "bias", (F.col("bias") - 1.96 * F.col("sd")).alias("loa_low"), (F.col("bias") + 1.96 * F.col("sd")).alias("loa_high"),
        "rounded_acc", "tolerance_acc",
    )


def error_summary(df: DataFrame, by: Sequence[str], tolerance: float) -> DataFrame:
    """Signed and absolute error summaries with the sample SD, and hits of all. Medians come from ranges of values."""
    e = F.col("y_pred") - F.col("y_true")
    with_error = df.withColumns({"__gw_err": e, "__gw_abs": F.abs(e)})
    out = with_error.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("__gw_abs").alias("mae"), F.avg("__gw_err").alias("mean_error"), F.stddev_samp("__gw_err").alias("sd_error"),
        F.sum((F.col("__gw_abs") <= tolerance).cast("long")).alias("hits"),
    )
    for value, name in (("__gw_err", "median_error"), ("__gw_abs", "median_abs_error")):
        m = order.medians(with_error, by, value, name)
        out = out.join(m, list(by), "left") if by else out.crossJoin(F.broadcast(m))
    return out.select(*by, "n", "mae", "mean_error", "median_error", "median_abs_error", "sd_error", "hits")


def over_folds(per_fold: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample SD over folds of each metric: (by, metric, mean, std, n_folds). SD of one fold is 0.
    A mean over folds is not the pooled value."""
    long = per_fold.unpivot([*by, "fold"], list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("value").alias("n_folds"))


def confusion(df: DataFrame, by: Sequence[str], n_classes: int) -> DataFrame:
    """(by, y_true, y_pred, n) with all cells, empty ones too. Classes are 0 to ``n_classes`` - 1."""
    grid = df.sparkSession.range(n_classes * n_classes).select((F.col("id") / n_classes).cast("int").alias("y_true"), (F.col("id") % n_classes).cast("int").alias("y_pred"))
    counts = df.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    cells = counts.select(*by).distinct().crossJoin(grid) if by else grid
    return cells.join(counts, [*by, "y_true", "y_pred"], "left").fillna(0, ["n"])


def normalised_confusion(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Shares of each true class; 0 where it has no rows."""
    row = F.sum("n").over(W.partitionBy(*by, "y_true"))
    return cells.withColumn("share", F.when(row > 0, F.col("n") / row).otherwise(0.0))


def class_report(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where a denominator is 0."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = cells.select(*by, F.col("y_true").alias("cls"), hit.alias("tp"), F.col("n").alias("t"), F.lit(0).alias("p")).union(cells.select(*by, "y_pred", F.lit(0), F.lit(0), "n"))
    s = sides.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("given"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, t, p = F.col("tp"), F.col("support"), F.col("given")
    return s.select(*by, "cls", over(tp, p).alias("precision"), over(tp, t).alias("recall"), over(2 * tp, t + p).alias("f1"), "support")


def class_metrics(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy, macro-F1 over all classes, Cohen's kappa and linear weighted kappa.

    Kappa counts positions among labels that occur on either side, so a class nobody uses leaves no gap.
    """
    f1 = class_report(cells, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    used = cells.filter("n > 0")
    seen = used.select(*by, F.col("y_true").alias("c")).union(used.select(*by, "y_pred")).distinct()
    place = seen.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy("c")))
    a, b = place.withColumnsRenamed({"c": "y_true", "i": "it"}), place.withColumnsRenamed({"c": "y_pred", "i": "ip"})
    on = used.join(a, [*by, "y_true"]).join(b, [*by, "y_pred"])
    total = on.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("it") == F.col("ip"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum(F.col("n") * F.abs(F.col("it") - F.col("ip"))).alias("far"))
    rows = on.groupBy(*by, "it").agg(F.sum("n").alias("nt"))
    cols = on.groupBy(*by, "ip").agg(F.sum("n").alias("np"))
    both = rows.join(cols, list(by)) if by else rows.crossJoin(cols)  # classes by classes
    chance = both.groupBy(*by).agg(F.sum(F.when(F.col("it") == F.col("ip"), F.col("nt") * F.col("np")).otherwise(0)).alias("same"), F.sum(F.col("nt") * F.col("np") * F.abs(F.col("it") - F.col("ip"))).alias("apart"))
    out = total.join(chance, list(by)).join(f1, list(by)) if by else total.crossJoin(chance).crossJoin(f1)
    pe = F.col("same") / (F.col("n") * F.col("n"))
    kappa = F.when(pe < 1, (F.col("accuracy") - pe) / (1 - pe)).otherwise(NAN)
    weighted = F.when(F.col("apart") > 0, 1 - F.col("far") * F.col("n") / F.col("apart")).otherwise(NAN)
    return out.select(*by, "n", "accuracy", "macro_f1", kappa.alias("kappa"), weighted.alias("weighted_kappa"))


def calibration(df: DataFrame, by: Sequence[str], bins: int = 5) -> DataFrame:
    """Quantile bins of the prediction: rows, mean truth and prediction, MAE.

    There are min(bins, max(2, n // 3)) bins; edges are exact percentiles, equal edges collapse, bins
    are closed on the right. The edges of a group are one short row that is joined to it.
    """
    q = F.least(F.lit(bins), F.greatest(F.lit(2), F.floor(F.col("n") / 3)))
    edges = order.percentiles(df, by, "y_pred", F.transform(F.sequence(F.lit(0).cast("long"), q.cast("long")), lambda i: i / q), "edges")
    edges = edges.withColumn("edges", F.array_distinct("edges"))
    on = df.join(edges, list(by)) if by else df.crossJoin(edges)
    at = F.greatest(F.lit(0), F.size(F.filter("edges", lambda x: x < F.col("y_pred"))) - 1)
    return on.withColumn("bin", at).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("y_true").alias("mean_true"), F.avg("y_pred").alias("mean_pred"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))


def bland_altman_points(df: DataFrame) -> DataFrame:
    return df.withColumns({"ba_mean": (F.col("y_true") + F.col("y_pred")) / 2, "ba_diff": F.col("y_pred") - F.col("y_true")})


def bland_altman_limits(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bias and limits with the sample SD, as figures draw them."""
    d = F.col("y_pred") - F.col("y_true")
    return df.groupBy(*by).agg(F.avg(d).alias("bias"), (F.avg(d) - 1.96 * F.stddev_samp(d)).alias("low"), (F.avg(d) + 1.96 * F.stddev_samp(d)).alias("high"))


def tolerance_curve(df: DataFrame, by: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Share of rows whose absolute error is within each threshold."""
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    sums = df.groupBy(*by).agg(*(F.avg((e <= t).cast("int")).alias(str(i)) for i, t in enumerate(thresholds)))
    pairs = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(str(i)).alias("coverage")) for i, t in enumerate(thresholds)))).alias("p")
    return sums.select(*by, pairs).select(*by, "p.*")


def transitions(base: DataFrame, candidate: DataFrame, key: Sequence[str], tolerance: float) -> DataFrame:
    """Paired rows with who is within the tolerance: both, gained, lost or neither."""
    a, b = base.withColumnRenamed("y_pred", "base_pred"), candidate.select(*key, F.col("y_pred").alias("cand_pred"))
    on = a.join(b, list(key))
    was, is_ = F.abs(F.col("base_pred") - F.col("y_true")) <= tolerance, F.abs(F.col("cand_pred") - F.col("y_true")) <= tolerance
    return on.withColumn("transition", F.when(was & is_, "both").when(is_, "gained").when(was, "lost").otherwise("neither"))


def conformal_radius(calibration_rows: DataFrame, by: Sequence[str], alpha: float) -> DataFrame:
    """Split-conformal radius: order statistic min(n, ceil((n + 1)(1 - alpha))) of the absolute error."""
    e = calibration_rows.select(*by, F.abs(F.col("y_pred") - F.col("y_true")).alias("e"))
    rank = F.least(F.col("n"), F.ceil((F.col("n") + 1) * (1 - alpha)))
    return order.nth_value(e, by, "e", rank, "radius").withColumnRenamed("n", "n_calibration")


def conformal_intervals(df: DataFrame, radius: DataFrame, by: Sequence[str]) -> DataFrame:
    on = df.join(radius, list(by)) if by else df.crossJoin(radius)
    low, high = F.col("y_pred") - F.col("radius"), F.col("y_pred") + F.col("radius")
    return on.withColumns({"low": low, "high": high, "covered": (F.col("y_true") >= low) & (F.col("y_true") <= high)})


def patient_flags(df: DataFrame, tolerance: float) -> DataFrame:
    """Half-even rounded prediction and the flag that allows half a unit beyond the tolerance."""
    return df.withColumns({"y_pred_rounded": F.bround("y_pred", 0), "within": F.abs(F.col("y_pred") - F.col("y_true")) <= tolerance + 0.5})


def within(error: Column, tolerance: float) -> Column:
    return F.abs(error) <= tolerance
