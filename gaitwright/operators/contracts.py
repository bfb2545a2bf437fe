"""Label rules, filters and constraint checks. Every check is a DataFrame of violations, so that it
runs where the rows are; ``require_empty`` turns one into an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_label(label: Column, whole: bool = False) -> Column:
    """Trimmed label; blank and "nan" become null. ``whole`` reads "3.0" as 3 and keeps ordinals such as "1+" otherwise."""
    text = F.trim(label.cast("string"))
    kept = F.when(F.lower(text).isin("", "nan"), None).otherwise(text)
    return kept.try_cast("double").cast("int") if whole else kept


def encode_label(label: Column, classes: Sequence[str]) -> Column:
    """Position of a label among ``classes``; null for a null label, an error for an unknown one."""
    at = F.array_position(F.array(*map(F.lit, classes)), label.cast("string")).cast("int") - 1
    return F.when(label.isNull(), None).when(at < 0, F.raise_error(F.concat(F.lit("unknown label: "), label.cast("string")))).otherwise(at)


def decode_label(code: Column, classes: Sequence[str]) -> Column:
    return F.try_element_at(F.array(*map(F.lit, classes)), code.cast("int") + 1)


def in_classes(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """Rows whose label is null or one of ``classes``."""
    return df.filter(F.col(label).isNull() | F.col(label).isin(list(classes)))


def rare_classes(df: DataFrame, subject: str, label: str, classes: DataFrame, least: int = 2) -> DataFrame:
    """Classes (of a one-column table) with fewer than ``least`` different subjects, absent ones included."""
    counts = df.groupBy(label).agg(F.countDistinct(subject).alias("n_subjects"))
    return classes.join(counts, label, "left").select(label, F.coalesce("n_subjects", F.lit(0)).alias("n_subjects")).filter(F.col("n_subjects") < least)


def keep_subjects(df: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    return df.join(subjects.select(key), key, "left_semi")


def missing_and_unused(asked: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Keys that are asked for but not there ("missing") or there but not asked for ("unused")."""
    a, b = asked.select(key).distinct(), there.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("missing")).union(b.join(a, key, "left_anti").withColumn("problem", F.lit("unused")))


def clip(value: Column, low: float, high: float) -> Column:
    """Null and NaN stay as they are."""
    return F.when(F.isnan(value), value).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), value)))


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).count().filter("count > 1")


def changing_labels(df: DataFrame, subject: str, *labels: str) -> DataFrame:
    """Subjects whose labels are null somewhere or differ between trials."""
    known = F.col(labels[0]).isNotNull()
    for name in labels[1:]:
        known &= F.col(name).isNotNull()
    seen = df.groupBy(subject).agg(F.bool_and(known).alias("known"), F.min(F.struct(*labels)).alias("lo"), F.max(F.struct(*labels)).alias("hi"))
    return seen.filter(~F.col("known") | (F.col("lo") != F.col("hi"))).select(subject)


def leaking_subjects(split: DataFrame, subject: str = "subject_id", role: str = "role", fold: str = "fold") -> DataFrame:
    """Subjects on more than one side of a fold, of a split table (fold, role, subject)."""
    return split.groupBy(fold, subject).agg(F.countDistinct(role).alias("n_roles")).filter("n_roles > 1")


def coverage_faults(split: DataFrame, rows: DataFrame, key: str, role: str = "role", held_out: str = "test") -> DataFrame:
    """Keys of ``rows`` that are not held out exactly once."""
    times = split.filter(F.col(role) == held_out).groupBy(key).agg(F.count("*").alias("times"))
    return rows.select(key).distinct().join(times, key, "full").select(key, F.coalesce("times", F.lit(0)).alias("times")).filter("times != 1")


def finite(value: Column, other: float = 0.0) -> Column:
    """``value``, or ``other`` where it is null, NaN or infinite."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), other).otherwise(value)


def first_present(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each wanted name the first of its aliases that ``df`` has."""
    found = {name: next((a for a in options if a in df.columns), None) for name, options in aliases.items()}
    if absent := [n for n, c in found.items() if c is None]:
        raise ValueError(f"no column for {', '.join(absent)}")
    return df.select(*(F.col(c).alias(n) for n, c in found.items()))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if absent := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise with the first few violations."""
    if rows := violations.limit(5).collect():
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")


def union_faults(split: DataFrame, rows: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """(fold, key): keys of ``rows`` that no side of a fold has, and keys of a fold that ``rows`` lacks."""
    due = split.select(fold).distinct().crossJoin(rows.select(key).distinct())
    there = split.select(fold, key).distinct()
    return due.join(there, [fold, key], "left_anti").union(there.join(rows.select(key).distinct(), key, "left_anti").select(fold, key))
