"""Patient-disjoint folds, bags and seeded draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import order
from .contracts import require_empty


def fold_sizes(n: int, folds: int) -> list[int]:
    return [n // folds + (i < n % folds) for i in range(folds)]


def rarity(df: DataFrame, subject: str, labels: Sequence[str]) -> DataFrame:
    """Sum over labels of one over the number of subjects that share the value."""
    one = df.groupBy(subject).agg(F.count("*").alias("samples"), *(F.min(c).alias(c) for c in labels))
    for c in labels:
        counts = one.filter(F.col(c).isNotNull()).groupBy(c).agg((1 / F.count("*")).alias(f"__gw_{c}"))
        one = one.join(counts, c, "left")
    return one.select(subject, "samples", *labels, sum((F.coalesce(f"__gw_{c}", F.lit(0.0)) for c in labels), F.lit(0.0)).alias("rarity"))


#: Weights of what folds are balanced by; fixed values.
WEIGHTS = {"samples": 1.0, "fma_ue": 0.6, "bi": 0.05, "hand_tone": 1.5, "hand_function": 1.5, "source": 4.0}


def balanced_folds(stats: DataFrame, subject: str, folds: int, classes: Sequence[str], sums: Sequence[str] = (), score: str | None = None, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(subject, fold): rare subjects first, each to the fold that it brings nearest to its share.

    Balanced are the samples, the sums of numeric labels and the counts of each class. The cost of a
    fold is how much the squared distances from a fold's share of the whole change by the subject, times
    the weights (1 unless given). No fold grows beyond its size. Order: rarity, samples and score from
    the top, then id; ties between folds: samples, size, number. One row per subject goes to the driver,
    as a greedy choice depends on all earlier ones.
    """
    w = {**WEIGHTS, **(weights or {})}
    by = [F.desc("rarity"), F.desc("samples"), *([F.desc(score)] if score else []), F.col(subject).try_cast("bigint").asc_nulls_last(), F.col(subject)]
    rows = stats.orderBy(*by).collect()
    if not 2 <= folds <= len(rows):
        raise ValueError(f"{len(rows)} subjects cannot make {folds} folds")
    sizes, members, out = fold_sizes(len(rows), folds), [0] * folds, []
    share: dict[tuple, float] = {}

    def adds(r) -> list[tuple[tuple, float, float]]:
        """(quantity, amount, weight) that a subject brings."""
        found = [(("samples",), float(r["samples"]), w["samples"])]
        found += [((c,), float(r[c]), w.get(c, 1.0)) for c in sums if r[c] is not None]
        return found + [((c, r[c]), 1.0, w.get(c, 1.0)) for c in classes if r[c] is not None]

    for r in rows:
        for what, amount, _ in adds(r):
            share[what] = share.get(what, 0.0) + amount / folds
    held: list[dict] = [dict.fromkeys(share, 0.0) for _ in range(folds)]
    for r in rows:
        bring = adds(r)

        def cost(k: int) -> tuple:
            change = sum(x * ((held[k][q] + a - share[q]) ** 2 - (held[k][q] - share[q]) ** 2) for q, a, x in bring)
            return change, held[k]["samples",], members[k], k

        k = min((k for k in range(folds) if members[k] < sizes[k]), key=cost)
        for q, a, _ in bring:
            held[k][q] += a
        members[k] += 1
        out.append((r[subject], k))
    return stats.sparkSession.createDataFrame(out, f"{subject} {stats.schema[subject].dataType.simpleString()}, fold int")


def split_mode(asked: str, n_subjects: int, folds: int) -> str:
    """"subject" or "trial"; "auto" goes by subject where every fold can have one."""
    if asked not in ("auto", "subject", "trial"):
        raise ValueError(f"unknown split mode: {asked}")
    if asked == "subject" and n_subjects < folds:
        raise ValueError(f"{n_subjects} subjects cannot make {folds} folds")
    return asked if asked != "auto" else "subject" if n_subjects >= folds else "trial"


def trial_round_robin(df: DataFrame, by: Sequence[str], order: Sequence[str], folds: int) -> DataFrame:
    return df.withColumn("fold", ((F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1) % folds).cast("int"))


def roles(assigned: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """(round, role, ...): in each round one fold is test and all others train."""
    rounds = assigned.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return rounds.withColumn("role", F.when(F.col("round") == F.col(fold), "test").otherwise("train"))


def _hash_order(*parts) -> Column:
    return F.md5(F.concat_ws("/", *parts))


def _place(df: DataFrame, by: Sequence[str], hashed: Column, key: str, name: str) -> DataFrame:
    """``df`` with the place, from 0, of each row in the order of a hash, within ``by``."""
    ranged = df.withColumn("__gw_m", hashed).withColumn("__gw_h", F.conv(F.substring("__gw_m", 1, 8), 16, 10).cast("double"))
    if not by:
        return order.numbered(ranged, "__gw_h", "__gw_m", key, name=name).withColumn(name, F.col(name) - 1).drop("__gw_m", "__gw_h")
    ranged = ranged.withColumn("__gw_r", (F.col("__gw_h") / (1 << 26)).cast("int"))  # 64 even ranges
    sizes = ranged.groupBy(*by, "__gw_r").agg(F.count("*").alias("__gw_n"))
    start = sizes.select(*by, "__gw_r", F.coalesce(F.sum("__gw_n").over(W.partitionBy(*by).orderBy("__gw_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__gw_b"))
    own = F.row_number().over(W.partitionBy(*by, "__gw_r").orderBy("__gw_m", key)) - 1
    return ranged.withColumn(name, own).join(start, [*by, "__gw_r"]).withColumn(name, (F.col(name) + F.col("__gw_b")).cast("long")).drop("__gw_m", "__gw_h", "__gw_r", "__gw_b")


def hashed_split(df: DataFrame, key: str, folds: int, validation: float, seed: int) -> DataFrame:
    """(round, role, key): keys in the order of a hash are dealt to the folds in turn, and each is test
    once; of the others of a round the first max(1, round(share)) in another hash order are validation."""
    dealt = _place(df.select(key).distinct(), [], _hash_order(F.lit(str(seed)), F.col(key).cast("string")), key, "place")
    rounds = dealt.withColumn("fold", (F.col("place") % folds).cast("int")).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).drop("place")
    test = rounds.filter("fold = round").select("round", key, F.lit("test").alias("role"))
    rest = inner_split(rounds.filter("fold != round").select("round", key), ["round"], key, validation, seed, least=1, rest=0)
    return test.unionByName(rest).select("round", key, "role")


def inner_split(df: DataFrame, by: Sequence[str], key: str, share: float, seed: int, least: int = 2, rest: int = 2) -> DataFrame:
    """(by, key, role): max(``least``, round(share of the group)) keys, first in a hash order, are
    validation and the others train. A group that keeps fewer than ``rest`` for training is an error,
    found by a job at once (0: none is run)."""
    hashed = _hash_order(F.lit("v"), F.lit(str(seed)), *(F.col(c).cast("string") for c in by), F.col(key).cast("string"))
    placed = _place(df, by, hashed, key, "__gw_p")
    sizes = df.groupBy(*by).agg(F.greatest(F.lit(least), F.bround(F.count("*") * share, 0)).alias("__gw_v"))
    if rest:
        kept = df.groupBy(*by).agg((F.count("*") - F.greatest(F.lit(least), F.bround(F.count("*") * share, 0))).alias("n"))
        require_empty(kept.filter(F.col("n") < rest), f"groups with fewer than {rest} training keys")
    return placed.join(sizes, list(by)).select(*by, key, F.when(F.col("__gw_p") < F.col("__gw_v"), "validation").otherwise("train").alias("role"))


def bags(trials: DataFrame, subject: str, trial: str, per_subject: int, size: int, seed: int) -> DataFrame:
    """(subject, bag, slot, trial): bags without replacement while a subject has enough trials, else
    round the trials again. The order comes from a hash of seed, bag and trial."""
    n = trials.groupBy(subject).agg(F.count("*").alias("__gw_n"))
    order = W.partitionBy(subject, "bag").orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("bag").cast("string"), F.col(trial).cast("string"))), trial)
    ranked = trials.select(subject, trial).join(n, subject).withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(per_subject - 1)))).withColumn("__gw_r", F.row_number().over(order) - 1)
    slots = F.filter(F.transform(F.sequence(F.lit(0), F.lit((size - 1))), lambda s: F.when(s % F.col("__gw_n") == F.col("__gw_r"), s.cast("int"))), lambda s: s.isNotNull())
    return ranked.select(subject, "bag", F.explode(slots).alias("slot"), trial)


def seeded_order(df: DataFrame, by: Sequence[str], key: str, seed: int, name: str = "place") -> DataFrame:
    """Place of each row in a shuffle that every engine repeats."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), key)))


def weighted_draws(df: DataFrame, by: Sequence[str], key: str, weight: str, draws: int, seed: int = 0) -> DataFrame:
    """(by, draw, key): independent draws with replacement, each key as likely as its weight.

    A draw's number is a hash of seed, group and draw; it falls on the key whose span of cumulated
    weight holds it. Spans are cut into cells of the unit interval and meet draws by the cell, so
    no draw is compared with all rows.
    """
    if isinstance(df.schema[key].dataType, NumericType):
        placed = order.cumulated(df.select(*by, key, weight), by, key, weight, "upto").withColumnsRenamed({"upto": "__gw_b", "upto_before": "__gw_b_before"})
    else:  # a group with keys of another kind is added up in one task
        part = W.partitionBy(*by).orderBy(key)
        placed = df.select(*by, key, weight).withColumn("__gw_b", F.sum(weight).over(part.rowsBetween(W.unboundedPreceding, 0)))
        placed = placed.withColumn("__gw_b_before", F.coalesce(F.lag("__gw_b").over(part), F.lit(0.0)))
    whole = df.groupBy(*by).agg(F.sum(weight).alias("__gw_t"))
    on = placed.join(whole, list(by)) if by else placed.crossJoin(F.broadcast(whole))
    spans = on.select(*by, key, (F.col("__gw_b_before") / F.col("__gw_t")).alias("__gw_a"), (F.col("__gw_b") / F.col("__gw_t")).alias("__gw_b"))
    cells = spans.withColumn("__gw_c", F.explode(F.sequence((F.col("__gw_a") * CELLS).cast("int"), (F.least(F.col("__gw_b"), F.lit(1 - 1e-12)) * CELLS).cast("int"))))
    hashed = _hash_order(F.lit("d"), F.lit(str(seed)), *(F.col(c).cast("string") for c in by), F.col("draw").cast("string"))
    asked = df.select(*by).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__gw_u", F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / float(1 << 32))
    on = asked.withColumn("__gw_c", (F.col("__gw_u") * CELLS).cast("int")).join(cells, [*by, "__gw_c"])
    return on.filter((F.col("__gw_u") >= F.col("__gw_a")) & (F.col("__gw_u") < F.col("__gw_b"))).select(*by, "draw", key)


CELLS = 256


def sampling_weights(df: DataFrame, *labels: str) -> DataFrame:
    """``df`` with ``sampling_weight``: the mean over labels of one over the root of the class count."""
    for c in labels:
        counts = df.groupBy(c).agg((1 / F.sqrt(F.count("*"))).alias(f"__gw_{c}"))
        df = df.join(counts, c, "left")
    mean = sum((F.coalesce(f"__gw_{c}", F.lit(0.0)) for c in labels), F.lit(0.0)) / len(labels)
    return df.withColumn("sampling_weight", mean).drop(*(f"__gw_{c}" for c in labels))
