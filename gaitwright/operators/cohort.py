"""From folds, seeds and reviewers to the tables that a study reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order
from .aggregate import subject_classes, subject_regression
from .bootstrap import HELD, METRICS, bootstrap_interval, draw_index, draw_metrics, draw_statistics
from .contracts import repeated_keys, require_columns, require_empty
from .metrics import class_metrics, confusion, regression_metrics

# ---- joins with checks -----------------------------------------------------------------------


def one_to_one(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inner join in which every row of either side has exactly one partner; anything else is an error."""
    for df in (a, b):
        require_empty(repeated_keys(df, *key), "repeated keys")
    require_empty(a.select(*key).join(b, list(key), "left_anti").union(b.select(*key).join(a, list(key), "left_anti")), "keys without partner")
    return a.join(b, list(key))


def merged_predictions(tasks: Mapping[str, DataFrame], key: str, value: str = "y_pred") -> DataFrame:
    """One row for each subject of any task, ``<task>_pred`` null where a task has none."""
    long = None
    for name, df in tasks.items():
        part = df.select(key, F.lit(name).alias("__gw_t"), F.col(value).cast("double").alias("__gw_v"))
        long = part if long is None else long.union(part)
    wide = long.groupBy(key).pivot("__gw_t", list(tasks)).agg(F.first("__gw_v"))
    return wide.withColumnsRenamed({t: f"{t}_pred" for t in tasks})


def overlap_faults(calibration: DataFrame, test: DataFrame, subject: str) -> DataFrame:
    """(subject, problem): ids repeated on a side, or on both sides."""
    sides = calibration.select(F.col(subject).cast("string").alias(subject), F.lit(0).alias("s")).union(test.select(F.col(subject).cast("string"), F.lit(1)))
    n = sides.groupBy(subject).agg(F.sum(1 - F.col("s")).alias("a"), F.sum("s").alias("b"))
    problem = F.when((F.col("a") > 0) & (F.col("b") > 0), "on both sides").when((F.col("a") > 1) | (F.col("b") > 1), "repeated")
    return n.select(subject, problem.alias("problem")).filter("problem is not null")


def variant_deltas(long: DataFrame, plus: str, base: str, by: Sequence[str] = ("metric",)) -> DataFrame:
    """(by, base, plus, delta): mean of a variant less that of another, where both have the metric."""
    mean = lambda v: F.avg(F.when(F.col("variant") == v, F.col("value")))
    both = long.groupBy(*by).agg(mean(base).alias("base"), mean(plus).alias("plus"))
    return both.filter("base is not null and plus is not null").withColumn("delta", F.col("plus") - F.col("base"))


def with_auxiliary(split: DataFrame, auxiliary: DataFrame, subject: str) -> DataFrame:
    """(fold, role, subject): auxiliary subjects join the training side of every fold; one that a fold
    holds on another side is an error."""
    folds = split.select("fold").distinct()
    added = folds.crossJoin(auxiliary.select(subject).distinct()).select("fold", F.lit("train").alias("role"), subject)
    require_empty(split.filter(F.col("role") != "train").join(auxiliary, subject, "left_semi"), "auxiliary subjects held out")
    return split.select("fold", "role", subject).union(added).distinct()


def partition_of(split: DataFrame, fold: int, role: str) -> DataFrame:
    """Subjects of one side of a fold; a fold or side that the split lacks is an error."""
    own = split.filter((F.col("fold") == fold) & (F.col("role") == role)).drop("fold", "role")
    if own.isEmpty():
        raise ValueError(f"no {role} side in fold {fold}")
    return own


# ---- rows of folds ---------------------------------------------------------------------------


def fold_rows(summary: DataFrame, keys: Sequence[str], metrics: Mapping[str, Sequence[str]], labels: DataFrame, order: str, skip: Sequence[str] = ()) -> DataFrame:
    """(keys, variant_label, metric, fold, value) of fold tables.

    Each metric takes the first alias that is there. A table without fold numbers gets 1, 2, ... in
    ``order``. Variants to skip, and those without a label (``labels``: variant, variant_label), go.
    """
    found = {name: [a for a in aliases if a in summary.columns] for name, aliases in metrics.items()}
    rows = summary.filter(~F.col("variant").isin(list(skip))).join(F.broadcast(labels), "variant")
    numbered = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    rows = rows.withColumn("fold", F.coalesce(F.col("fold").cast("int"), numbered) if "fold" in summary.columns else numbered)
    wide = rows.select(*keys, "variant_label", "fold", *(F.coalesce(*a).cast("double").alias(n) for n, a in found.items() if a))
    return wide.unpivot([*keys, "variant_label", "fold"], [n for n, a in found.items() if a], "metric", "value").filter("value is not null")


def as_two_kinds(long: DataFrame, best: DataFrame, task: str = "task") -> DataFrame:
    """Rows of the seed that won a task (``best``: task, variant) as variant "tri" of kind "modality" and
    as "full" of kind "module", with the seed they came from; all other rows of seeds are left out by the caller."""
    won = long.join(best.select(task, "variant"), [task, "variant"])
    names = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("variant")) for k, v in (("modality", "tri"), ("module", "full"))))).alias("__gw_k")
    rest = [c for c in long.columns if c not in ("kind", "variant")]
    return won.select(*rest, F.col("variant").alias("source_seed_variant"), names).select("__gw_k.kind", "__gw_k.variant", *rest, "source_seed_variant")


def label_distribution(rows: DataFrame, by: Sequence[str], classes: Sequence[str], numbers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(by, label, value, n) of class labels, and (by, label, n, sum, mean, min, max) of numeric labels
    rounded to four digits; null labels do not count."""
    named = rows.select(*by, *(F.col(c).cast("string").alias(c) for c in classes)).unpivot(list(by), list(classes), "label", "value")
    counts = named.filter("value is not null").groupBy(*by, "label", "value").agg(F.count("*").alias("n"))
    long = rows.select(*by, *(F.col(c).cast("double").alias(c) for c in numbers)).unpivot(list(by), list(numbers), "label", "v").filter("v is not null")
    four = lambda c: F.round(c, 4)
    stats = long.groupBy(*by, "label").agg(F.count("*").alias("n"), four(F.sum("v")).alias("sum"), four(F.avg("v")).alias("mean"), four(F.min("v")).alias("min"), four(F.max("v")).alias("max"))
    return counts, stats


def category_universe(rows: DataFrame, *labels: str) -> DataFrame:
    """(label, values): the classes that occur, whole numbers first by value, then other names."""
    long = rows.select(*(F.col(c).cast("string").alias(c) for c in labels)).unpivot([], list(labels), "label", "v").filter("v is not null").distinct()
    place = F.struct(F.col("v").try_cast("bigint").isNull().alias("a"), F.coalesce(F.col("v").try_cast("bigint"), F.lit(0)).alias("b"), F.col("v").alias("c"))
    return long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(place)), lambda s: s["c"]).alias("values"))


# ---- predictions -----------------------------------------------------------------------------


def dense_probabilities(df: DataFrame, keys: Sequence[str], cls: str, p: str, n_classes: int) -> DataFrame:
    """(keys, prob_c0, ...): probabilities of the classes a model knew, 0 for the others."""
    return df.groupBy(*keys).pivot(cls, list(range(n_classes))).agg(F.first(p)).fillna(0.0).withColumnsRenamed({str(k): f"prob_c{k}" for k in range(n_classes)})


def one_hot(label: Column, n_classes: int) -> list[Column]:
    """Probabilities of a model that has none: 1 for its label."""
    return [F.when(label == k, 1.0).otherwise(0.0).alias(f"prob_c{k}") for k in range(n_classes)]


def objective(errors: Mapping[str, tuple[Column, float]], f1: Mapping[str, Column]) -> Column:
    """Mean of errors as shares of their ranges and of one less each F1."""
    parts = [e / span for e, span in errors.values()] + [1 - f for f in f1.values()]
    return sum(parts[1:], parts[0]) / len(parts)


def ordinal_loss(df: DataFrame, by: Sequence[str], losses: str) -> DataFrame:
    """(by, loss): the mean over a chain's logits of the mean over the rows that each has; a logit without rows does not
    count, and 0 stands where none has any."""
    each = df.select(*by, F.posexplode(losses).alias("k", "v")).groupBy(*by, "k").agg(F.avg("v").alias("m"))
    return each.groupBy(*by).agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("loss"))


def error_order(df: DataFrame, by: Sequence[str], subject: str, digits: int = 6) -> DataFrame:
    """``df`` with ``place``: patients by absolute error, the least first, equal ones by id. Ranges of errors
    are ordered alone. Errors count as equal to ``digits``: sums differ in their last bits by the order of their rows."""
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    known = df.withColumns({"abs_error": e, "__gw_d": F.round(e, digits)})
    return order.numbered(known, "__gw_d", subject, name="place", by=by).drop("__gw_d")


def evaluated_tasks(scores: Mapping[str, tuple[DataFrame, float, float, float]], classes: Mapping[str, tuple[DataFrame, Sequence[str]]], by: Sequence[str] = ()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All tasks of one model in one evaluation: (task, by, metric, value), and each task's subjects.

    ``scores``: bags (by, subject_id, y_true, y_pred) of a task with its range and tolerance; bags are held in the range
    and a subject has their median. ``classes``: bags (by, subject_id, y_true, prob_c0...) with the labels of
    the classes; a subject has the first class of the largest mean probability, and its truth and
    prediction come back as labels.
    """
    keys, long, subjects = [*by, "subject_id"], [], {}

    def told(task: str, m: DataFrame, names: Sequence[str]) -> None:
        long.append(m.unpivot(list(by), list(names), "metric", "value").select(F.lit(task).alias("task"), *by, "metric", F.col("value").cast("double").alias("value")))

    for task, (bags, low, high, tolerance) in scores.items():
        one = subject_regression(bags, keys, low, high)
        told(task, regression_metrics(one, by, tolerance), ("mae", "rmse", "r2", "pearson", "spearman", "tolerance_acc"))
        subjects[task] = one.withColumns({"error": F.col("y_pred") - F.col("y_true"), "abs_error": F.abs(F.col("y_pred") - F.col("y_true"))})
    for task, (bags, labels) in classes.items():
        one = subject_classes(bags, keys, [f"prob_c{k}" for k in range(len(labels))])
        told(task, class_metrics(confusion(one, by, len(labels)), by), ("accuracy", "macro_f1", "kappa", "weighted_kappa"))
        named = F.array(*map(F.lit, labels))
        subjects[task] = one.withColumns({c: F.element_at(named, F.col(c).cast("int") + 1) for c in ("y_true", "y_pred")})
    out = long[0]
    for part in long[1:]:
        out = out.unionByName(part)
    return out, subjects


def seed_weights(df: DataFrame, by: Sequence[str], seeds: Sequence[str], tolerance: float, steps: int = 20) -> DataFrame:
    """(by, w_<seed>, mae, hits): of all weights in steps of one over ``steps`` that add up to 1 those
    with the least error (to six digits), then the most hits, then nearest to equal weights, then the first by value.

    The grid has a fixed number of weightings and is broadcast; its sums are partial on every task.
    """
    grid = [[k / steps for k in g] for g in product(range(steps + 1), repeat=len(seeds)) if sum(g) == steps]
    away = [round(sum((w - 1 / len(seeds)) ** 2 for w in g), 12) for g in grid]
    ways = df.sparkSession.createDataFrame([(*g, a) for g, a in zip(grid, away)], ", ".join(f"w_{s} double" for s in seeds) + ", away double")
    on = df.crossJoin(F.broadcast(ways))
    e = F.abs(sum((F.col(s) * F.col(f"w_{s}") for s in seeds), F.lit(0.0)) - F.col("y_true"))
    sums = on.groupBy(*by, "away", *(f"w_{s}" for s in seeds)).agg(F.avg(e).alias("mae"), F.sum((e <= tolerance).cast("long")).alias("hits"))
    best = F.min(F.struct(F.round("mae", 6).alias("mae"), (-F.col("hits")).alias("miss"), "away", *(f"w_{s}" for s in seeds))).alias("b")
    return sums.groupBy(*by).agg(best).select(*by, *(f"b.w_{s}" for s in seeds), "b.mae", (-F.col("b.miss")).alias("hits"))


def linear_calibrator(train: DataFrame, by: Sequence[str], ridge: float = 0.0) -> DataFrame:
    """(by, slope, intercept) of y_true on y_pred; ``ridge`` penalises the slope, not the intercept."""
    s = train.groupBy(*by).agg(F.count("*").alias("n"), F.avg("y_pred").alias("mx"), F.avg("y_true").alias("my"), F.covar_pop("y_pred", "y_true").alias("c"), F.var_pop("y_pred").alias("v"))
    slope = F.when(F.col("v") + ridge > 0, F.col("n") * F.col("c") / (F.col("n") * F.col("v") + ridge)).otherwise(0.0)
    return s.select(*by, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def scaled_prediction(y: Column, how: str, low: float, high: float) -> Column:
    """"raw", "clip", or clipped and rounded half up to halves ("round_0.5") or whole numbers ("round_integer")."""
    held = F.least(F.lit(high), F.greatest(F.lit(low), y))
    ways = {"raw": y, "clip": held, "round_0.5": F.floor(held * 2 + 0.5) / 2, "round_integer": F.floor(held + 0.5)}
    return ways[how].cast("double")


# ---- intervals -------------------------------------------------------------------------------

#: Draws of a bootstrap and of a bootstrap over cases; fixed values.
DRAWS, CASE_DRAWS = 20_000, 2000


def endpoint_intervals(df: DataFrame, order: Sequence[str], tolerance: float, by: Sequence[str] = (), draws: int = DRAWS, held: int = HELD) -> DataFrame:
    """(by, metric, low, high): bootstrap intervals of MAE, RMSE, R², Pearson, Spearman and the share within
    the tolerance. A draw without a value (a flat side) does not count."""
    per = draw_statistics(df, order, draws, by, "y_true", ["y_pred"], tolerance, held=held)
    long = per.unpivot([*by, "draw"], list(METRICS), "metric", "value")
    return bootstrap_interval(long, [*by, "metric"], "value").select(*by, "metric", "low", "high")


_DELTAS = ("mae", "r2", "tolerance")


def _deltas(per: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, metric, value): metrics of ``cand`` less those of ``base``."""
    of = lambda m, c: F.max(F.when(F.col("pred") == c, F.col(m)))
    wide = per.groupBy(*by).agg(*((of(m, "cand") - of(m, "base")).alias(f"delta_{m}") for m in _DELTAS))
    return wide.unpivot(list(by), [f"delta_{m}" for m in _DELTAS], "metric", "value")


def paired_intervals(base: DataFrame, candidate: DataFrame, key: Sequence[str], tolerance: float, by: Sequence[str] = (), draws: int = DRAWS, held: int = HELD) -> DataFrame:
    """(by, metric, estimate, low, high, n): MAE, R² and share within the tolerance of a candidate less those of
    the base, on the same drawn patients. Both sides have the same patients with the same truth."""
    ids = [*by, *key]
    pair = one_to_one(base.select(*ids, "y_true", F.col("y_pred").alias("base")), candidate.select(*ids, F.col("y_true").alias("__gw_t"), F.col("y_pred").alias("cand")), ids)
    require_empty(pair.filter("y_true != __gw_t"), "patients whose truth differs")
    once = pair.drop("__gw_t").withColumn("times", F.lit(1))
    whole = [draw_metrics(once, by, "y_true", c, tolerance).withColumn("pred", F.lit(c)) for c in ("base", "cand")]
    point = _deltas(whole[0].unionByName(whole[1]), by).select(*by, "metric", F.col("value").alias("estimate"))
    per = draw_statistics(once, key, draws, by, "y_true", ["base", "cand"], tolerance, ranks=False, held=held)
    spread = bootstrap_interval(_deltas(per, [*by, "draw"]), [*by, "metric"], "value").drop("draws")
    sizes = once.groupBy(*by).agg(F.count("*").alias("n"))
    on = point.join(spread, [*by, "metric"])
    return on.join(sizes, list(by)) if by else on.crossJoin(F.broadcast(sizes))


def case_intervals(scores: DataFrame, by: Sequence[str], case: str, value: str, draws: int = CASE_DRAWS) -> DataFrame:
    """(by, mean, low, high) where cases are drawn and bring all their scores. One case has no interval."""
    sums = scores.groupBy(*by, case).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    placed = sums.withColumn("row", F.row_number().over(W.partitionBy(*by).orderBy(case)) - 1)
    sizes = sums.groupBy(*by).agg(F.count("*").alias("n"), (F.sum("s") / F.sum("c")).alias("mean"))
    grid = sizes.filter("n > 1").crossJoin(sums.sparkSession.range(draws).withColumnRenamed("id", "draw")).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    picked = grid.select(*by, "draw", draw_index(F.col("draw"), F.col("slot"), F.col("n")).cast("int").alias("row")).join(placed, [*by, "row"])
    per = picked.groupBy(*by, "draw").agg((F.sum("s") / F.sum("c")).alias("m"))
    return sizes.select(*by, "mean").join(bootstrap_interval(per, by, "m").drop("draws"), list(by), "left")


def review_summary(ratings: DataFrame, key: DataFrame, raters: Sequence[str], dimensions: Sequence[str], draws: int = CASE_DRAWS) -> DataFrame:
    """(system_id, dimension, n_reports, n_cases, mean_score, ci95_low, ci95_high, <rater>_mean).

    ``ratings``: rater, review_id and one column for each dimension; ``key``: review_id, system_id,
    case_code. A report's score is the mean over raters; intervals draw cases.
    """
    long = ratings.join(key.select("review_id", "system_id", "case_code"), "review_id").unpivot(["rater", "review_id", "system_id", "case_code"], list(dimensions), "dimension", "score")
    by = ["system_id", "dimension"]
    each = long.groupBy(*by).pivot("rater", list(raters)).agg(F.avg("score")).withColumnsRenamed({r: f"{r}_mean" for r in raters})
    report = long.groupBy(*by, "case_code", "review_id").agg(F.avg("score").alias("score"))
    size = report.groupBy(*by).agg(F.count("*").alias("n_reports"), F.countDistinct("case_code").alias("n_cases"))
    spread = case_intervals(report, by, "case_code", "score", draws).withColumnsRenamed({"mean": "mean_score", "low": "ci95_low", "high": "ci95_high"})
    return size.join(spread, by).join(each, by)


def endpoint_table(summary: DataFrame, metrics: Sequence[str] = ("MAE", "R2", "Tolerance")) -> DataFrame:
    """(task, metric, estimate, ci_low, ci_high, hit_n) of a summary with intervals as texts "[low, high]"."""
    bound = lambda c, i: F.regexp_extract(F.col(c), r"\[?\s*([-+0-9.eE]+)\s*,\s*([-+0-9.eE]+)", i).try_cast("double")
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("estimate"), bound(f"{m}_95pct_CI", 1).alias("ci_low"), bound(f"{m}_95pct_CI", 2).alias("ci_high")) for m in metrics))
    return summary.select("task", F.col("`Hit/N`").alias("hit_n"), F.inline(rows)).select("task", "metric", "estimate", "ci_low", "ci_high", "hit_n")


# ---- gates -----------------------------------------------------------------------------------

#: What a frozen summary and its predictions must have; fixed values.
SUMMARY_COLUMNS = ("task", "MAE", "RMSE", "R2", "Spearman", "Tolerance", "Hit/N", "MAE_95pct_CI", "R2_95pct_CI", "Tolerance_95pct_CI")
PREDICTION_COLUMNS = ("patient_id", "fold", "y_true", "seed2024_pred", "seed42_pred", "seed1337_pred", "ensemble_raw_pred", "final_pred", "absolute_error", "signed_error", "tolerance_hit")


def frozen_faults(summary: DataFrame, predictions: DataFrame, tasks: Sequence[str], patients: int, retired: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """(task, problem): tasks that the summary lacks or has more than once, tolerances of tasks that are
    retired, and tasks without exactly ``patients`` rows of as many patients. Missing columns are an error.
    ``predictions`` has a ``task`` column beside its own."""
    require_columns(summary, SUMMARY_COLUMNS)
    require_columns(predictions, ("task", *PREDICTION_COLUMNS))
    due = summary.sparkSession.createDataFrame([(t,) for t in tasks], "task string")
    n = due.join(summary.groupBy("task").agg(F.count("*").alias("n"), F.collect_set(F.col("Tolerance").cast("double")).alias("told")), "task", "left")
    old = F.lit(False)
    for task, values in (retired or {}).items():
        for x in map(float, values):
            near = F.size(F.array_intersect(F.transform("told", lambda v: F.round(v, 6)), F.array(F.round(F.lit(x), 6)))) > 0
            old = old | ((F.col("task") == task) & F.coalesce(near, F.lit(False)))
    rows = due.join(predictions.groupBy("task").agg(F.count("*").alias("rows"), F.countDistinct(F.col("patient_id").cast("string")).alias("ids")), "task", "left")
    first = n.select("task", F.when(F.coalesce("n", F.lit(0)) != 1, "not one summary row").when(old, "retired tolerance").alias("problem"))
    second = rows.select("task", F.when((F.coalesce("rows", F.lit(0)) != patients) | (F.coalesce("ids", F.lit(0)) != patients), "not all patients").alias("problem"))
    return first.union(second).filter("problem is not null")


def square_matrix(df: DataFrame, rows: str, labels: Sequence[str]) -> DataFrame:
    """A confusion table of exactly these labels on both sides; what is no number counts 0."""
    if sorted(c for c in df.columns if c != rows) != sorted(labels):
        raise ValueError(f"columns are not {list(labels)}")
    due = df.sparkSession.createDataFrame([(x,) for x in labels], f"{rows} string")
    require_empty(due.join(df, rows, "left_anti").union(df.select(F.col(rows).cast("string")).join(due, rows, "left_anti")), "rows that are missing or too many")
    require_empty(df.groupBy(rows).count().filter("count > 1").select(rows), "repeated rows")
    return df.select(rows, *(F.coalesce(F.col(f"`{c}`").cast("string").try_cast("double"), F.lit(0.0)).alias(c) for c in labels))


def with_source(cases: DataFrame, source: str) -> DataFrame:
    """Cases whose text a person wrote ("human"), or was made by rule ("auxiliary"), or all; order columns stay."""
    text = F.trim(F.coalesce("rehab_text", F.lit(""))) != ""
    rules = {"all": F.lit(True), "human": F.coalesce("has_human_rehab_text", F.lit(False)) & text, "auxiliary": F.coalesce("has_auxiliary_generated_rehab_text", F.lit(False)) & text}
    return cases.filter(rules[source])


def zeroed(df: DataFrame, keep: Sequence[str], modality: str = "modality", value: str = "value") -> DataFrame:
    """Values of modalities that are not kept become 0."""
    return df.withColumn(value, F.when(F.col(modality).isin(list(keep)), F.col(value)).otherwise(0.0))


def checkpoint_choice(history: DataFrame, by: Sequence[str], epoch: str, value: str, patience: int, lower: bool = True) -> DataFrame:
    """(by, best_epoch, best_value, last_epoch): training stops when ``patience`` epochs brought nothing
    better; the best epoch until then is kept, the first of equals."""
    v = F.col(value) if lower else -F.col(value)
    so_far = W.partitionBy(*by).orderBy(epoch).rowsBetween(W.unboundedPreceding, W.currentRow)
    h = history.withColumn("__gw_v", v).withColumn("__gw_b", F.min(F.struct("__gw_v", epoch)).over(so_far)[epoch])
    stop = h.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col(epoch) - F.col("__gw_b") >= patience, F.col(epoch))), F.max(epoch)).alias("last_epoch"))
    kept = h.join(stop, list(by)).filter(F.col(epoch) <= F.col("last_epoch"))
    return kept.groupBy(*by).agg(F.min_by(epoch, F.struct("__gw_v", epoch)).alias("best_epoch"), F.min_by(value, F.struct("__gw_v", epoch)).alias("best_value"), F.max("last_epoch").alias("last_epoch"))
