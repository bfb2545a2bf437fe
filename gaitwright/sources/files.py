"""Readers and writers of manifests, recordings, splits, reports and tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaitwright.operators import kernels as K
from gaitwright.operators import metrics as M
from gaitwright.operators import series as S
from gaitwright.operators.contracts import changing_labels, normal_label, repeated_keys, require_columns, require_empty

MANIFEST = "subject_id string, trial_id string, task_id int, trial_number int, fma_score double, fma_ue double, bi double, hand_tone string, hand_function string, source string, eeg_path string, emg_path string"


def read_manifest(spark: SparkSession, path: str, label: str = "fma_score") -> DataFrame:
    """Manifest rows with text ids and normalised labels, and a numeric ``task_id`` and ``trial_number``.

    Missing columns, repeated (subject, trial) keys and subjects whose ``label`` is missing or not the
    same in all their trials are errors.
    """
    raw = require_columns(spark.read.option("header", True).csv(path), ["subject_id", "trial_id", label, "eeg_path", "emg_path"])
    kinds = dict(c.split() for c in MANIFEST.split(", "))
    labels = {"hand_tone": normal_label(F.col("hand_tone")), "hand_function": normal_label(F.col("hand_function"), whole=True)} if {"hand_tone", "hand_function"} <= set(raw.columns) else {}
    rows = raw.withColumns({c: F.col(c).try_cast(kinds[c]) for c in raw.columns if kinds.get(c, "string") != "string"}).withColumns(labels)
    require_empty(repeated_keys(rows, "subject_id", "trial_id"), "repeated trials")
    require_empty(changing_labels(rows, "subject_id", label), "subjects with missing or changing labels")
    return rows


def manifest_order(df: DataFrame) -> DataFrame:
    """Rows by subject, task and trial, ids as numbers where they are numbers."""
    return df.orderBy(*numeric_first("subject_id"), F.col("task_id").try_cast("int"), F.col("trial_number").try_cast("int"), *numeric_first("trial_id"))


def subject_stats(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(subject_id, samples, labels) of a manifest, one row for each subject."""
    return rows.groupBy("subject_id").agg(F.count("*").alias("samples"), *(F.min(c).alias(c) for c in labels if c in rows.columns))


def with_files(df: DataFrame, listing: DataFrame, *paths: str) -> DataFrame:
    """Rows all of whose files are in ``listing`` (a ``path`` column, as ``binaryFile`` gives)."""
    for p in paths:
        df = df.join(listing.select(F.col("path").alias(p)).distinct(), p, "left_semi")
    return df


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length) of all files below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")


def numeric_first(key: str) -> list[Column]:
    """Sort order of ids: numbers by value, then other names."""
    return [F.col(key).try_cast("bigint").asc_nulls_last(), F.col(key).asc()]


def read_channels(spark: SparkSession, path: str, channels: Sequence[str] | None = None) -> DataFrame:
    """(path, idx, channel, value) of wide recordings, one file each; ``idx`` counts the rows of a file
    from 0 in their order. A file is one task's work for the numbering: it has no clock to split it by."""
    wide = spark.read.option("header", True).option("inferSchema", True).csv(path)
    names = [c for c in channels or wide.columns if c in wide.columns]
    placed = wide.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__gw_s"), F.monotonically_increasing_id().alias("__gw_i"), *(F.col(f"`{c}`") for c in names))
    # Inside a piece of a file row numbers ascend in order; pieces are ordered by where they start.
    idx = F.row_number().over(W.partitionBy("path").orderBy("__gw_s", "__gw_i")) - 1
    numbered = placed.withColumn("idx", idx.cast("long")).drop("__gw_s", "__gw_i")
    return numbered.unpivot(["path", "idx"], [f"`{c}`" for c in names], "channel", "value").withColumn("value", F.col("value").cast("double"))


def reference_free(df: DataFrame, references: Sequence[str], rate: float, to_rate: float = 500.0, mains: float = 50.0, low: float = 1.0, high: float = 45.0) -> DataFrame:
    """EEG (path, idx, channel, value) without reference channels, against the mean of the others,
    notched, band-passed and at ``to_rate``; no scaling."""

    def chain(x):
        y = K.zero_phase(x, K.notch(mains, 30, rate)) if mains < rate / 2 else x
        return K.band_pass(y, low, high, rate)

    kept = S.average_reference(df.filter(~F.col("channel").isin(list(references))), ["path", "idx"], "value", "value")
    clean = K.filtered(kept, ["path", "channel"], "value", chain)
    return S.resample_rate(clean.withColumn("t", F.col("idx") / rate), ["path", "channel"], "t", "value", to_rate)


def interleaved_channels(columns: Sequence[str], parts: Sequence[str]) -> list[tuple[str, str]]:
    """(clock, signal) columns: signals whose name holds one of ``parts``; the clock stands just before."""
    return [(columns[i - 1], c) for i, c in enumerate(columns) if i and any(p in c for p in parts) and columns[i - 1].startswith("X[")]


def read_interleaved(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """(channel, t, value) of a frame of alternating clock and signal columns."""
    pairs = [F.struct(F.lit(s).alias("channel"), F.col(f"`{c}`").cast("double").alias("t"), F.col(f"`{s}`").cast("double").alias("value")) for c, s in interleaved_channels(df.columns, parts)]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def read_muscles_and_motion(df: DataFrame, muscles: Sequence[str], motion: Sequence[str] = ("ACC.X", "ACC.Y", "ACC.Z", "GYRO.X", "GYRO.Y", "GYRO.Z")) -> tuple[DataFrame, DataFrame]:
    """The high-rate (": EMG") and low-rate (acceleration, rotation) channels of the named muscles."""
    own = [c for c in df.columns if any(m in c for m in muscles)]
    emg, imu = [c for c in own if ": EMG" in c], [c for c in own if any(f": {m}" in c for m in motion)]
    return read_interleaved(df, emg), read_interleaved(df, imu)


def read_fold_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Fold tables under kind/variant/task folders, with what the path says."""
    rows = spark.read.option("header", True).option("inferSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_summary.csv").csv(root)
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/]+)/[^/]+$", i)
    return rows.select(part(1).alias("kind"), part(2).alias("variant"), part(3).alias("task"), *rows.columns)


def read_reports(spark: SparkSession, root: str, metric: str) -> DataFrame:
    """(model, fold, value) of JSON reports model/fold<k>.json; ``metric`` is a dotted path."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "fold*.json").text(root)
    path = F.col("_metadata.file_path")
    return text.select(F.regexp_extract(path, r"([^/]+)/fold\d+\.json$", 1).alias("model"), F.regexp_extract(path, r"fold(\d+)\.json$", 1).cast("int").alias("fold"), F.get_json_object("value", "$." + metric).try_cast("double").alias("value"))


def read_split(spark: SparkSession, path: str, fold: int | None = None) -> DataFrame:
    """(fold, role, subject_id) of a split document with ``folds``, or of one line for each fold as
    :func:`write_split` gives; ``fold`` 0, -1 or null takes all."""
    sides = [("train", "train_subjects"), ("validation", "validation_subjects"), ("validation", "val_subjects"), ("test", "test_subjects"), ("test", "val_test_subjects")]
    kind = "fold: int, " + ", ".join(f"{c}: array<string>" for _, c in sides)
    text = spark.read.option("wholetext", True).text(path).select("value", F.from_json("value", f"folds array<struct<{kind}>>")["folds"].alias("folds"))
    lines = F.transform(F.split("value", "\n"), lambda x: F.from_json(x, f"struct<{kind}>"))
    folds = text.select(F.explode(F.coalesce("folds", lines)).alias("f")).filter("f.fold is not null")
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"f.{c}").alias("ids")) for r, c in sides))
    out = folds.select(F.col("f.fold").alias("fold"), F.explode(roles).alias("s")).select("fold", "s.role", F.explode("s.ids").alias("subject_id"))
    return out.filter(F.col("fold") == fold) if fold and fold > 0 else out


def read_cases(spark: SparkSession, path: str, case_schema: str) -> DataFrame:
    """(subject_id, case columns) of a corpus document with a map of subjects."""
    text = spark.read.option("wholetext", True).text(path)
    cases = text.select(F.explode(F.from_json("value", f"subjects map<string, struct<{case_schema}>>")["subjects"]).alias("subject_id", "c"))
    return cases.select("subject_id", "c.*")


def interval(text: Column) -> Column:
    """struct(low, high) of "[low, high]"."""
    bound = lambda i: F.regexp_extract(text, r"\[\s*([-+0-9.eE]+)\s*,\s*([-+0-9.eE]+)\s*\]", i).try_cast("double")
    return F.struct(bound(1).alias("low"), bound(2).alias("high"))


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Replace a table as Parquet, CSV with a header, or JSON lines; partitions by columns if given."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).format(kind).save(path)


def cached_table(df: DataFrame, root: str, key: str) -> DataFrame:
    """``df`` from the table of this key if it was written whole, else computed and written."""
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{key}"
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_key(*parts: object) -> str:
    import hashlib

    return hashlib.sha256("\n".join(map(repr, parts)).encode()).hexdigest()[:32]


def file_keys(listing: DataFrame, **parameters: object) -> DataFrame:
    """(path, key): sha1 of a file's path, time of change and size and of the parameters that its result depends on."""
    told = [F.lit(f"{k}={v!r}") for k, v in sorted(parameters.items())]
    return listing.select("path", F.sha1(F.concat_ws("\n", "path", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"), *told)).alias("key"))


def rendered_json(df: DataFrame, *columns: str, name: str = "json") -> DataFrame:
    return df.withColumn(name, F.to_json(F.struct(*(columns or df.columns))))


def write_nonempty(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a table of which an empty one would be a mistake."""
    if df.isEmpty():
        raise ValueError(f"no rows for {path}")
    write_table(df, path, kind)


def write_figure_tables(rows: DataFrame, root: str, figures: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> None:
    """One CSV table for each figure: the rows of its tasks and metrics; a figure without rows is an error."""
    for name, (tasks, metrics) in figures.items():
        write_nonempty(rows.filter(F.col("task").isin(list(tasks)) & F.col("metric").isin(list(metrics))), f"{root.rstrip('/')}/{name}")


def write_class_tables(predictions: DataFrame, by: Sequence[str], labels: Sequence[str], root: str) -> None:
    """Per-class metrics as JSON lines, and the confusion with labels for numbers as CSV."""
    cells = M.confusion(predictions, by, len(labels))
    named = F.array(*map(F.lit, labels))
    write_table(M.class_report(cells, by).withColumn("label", F.element_at(named, F.col("cls") + 1)), f"{root}/classes", "json")
    wide = cells.withColumns({"y_true": F.element_at(named, F.col("y_true") + 1), "y_pred": F.element_at(named, F.col("y_pred") + 1)})
    write_table(wide.groupBy(*by, "y_true").pivot("y_pred", list(labels)).agg(F.first("n")), f"{root}/confusion", "csv")


def write_regression_tables(predictions: DataFrame, by: Sequence[str], root: str, bins: int = 5) -> None:
    """Agreement points and calibration bins as CSV."""
    write_table(M.bland_altman_points(predictions), f"{root}/agreement", "csv")
    write_table(M.calibration(predictions, by, bins), f"{root}/calibration", "csv")


def consistency_audit(summary: DataFrame, path: str) -> None:
    write_nonempty(summary.select("task", "MAE", "RMSE", "R2", "Spearman", "Tolerance", "`Hit/N`"), path)


_HELD: dict[tuple[str, str, str], DataFrame] = {}


def held_table(df: DataFrame, root: str, key: str) -> DataFrame:
    """:func:`cached_table`, kept in executor memory as well until :func:`release_tables`; what stopped
    applications held is forgotten."""
    app = df.sparkSession.sparkContext.applicationId
    for old in [k for k in _HELD if k[0] != app]:
        del _HELD[old]
    if (app, root, key) not in _HELD:
        _HELD[app, root, key] = cached_table(df, root, key).persist()
    return _HELD[app, root, key]


def release_tables() -> None:
    """Free the memory of all held tables."""
    while _HELD:
        _HELD.popitem()[1].unpersist()


def write_split(split: DataFrame, path: str, subject: str = "subject_id", **told: object) -> None:
    """One JSON line for each fold with the sorted ids of its sides and what is told of the split;
    :func:`read_split` reads them back."""
    ids = lambda role: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col(subject).cast("string")))).alias(f"{role}_subjects")
    folds = split.groupBy("fold").agg(ids("train"), ids("validation"), ids("test"))
    write_table(folds.withColumns({k: F.lit(v) for k, v in told.items()}) if told else folds, path, "json")


def ensure_split(path: str, make: Callable[[], DataFrame], spark: SparkSession, subject: str = "subject_id", subjects: DataFrame | None = None, **told: object) -> DataFrame:
    """The split written under ``path``; made and written first if it is not there or, where ``subjects`` is given,
    if its ids are not these. A split in which a fold shares subjects between training and held-out
    rows is an error."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    if there and subjects is not None:
        ids = subjects.select(F.col(subject).cast("string").alias("subject_id")).distinct()
        had = read_split(spark, path).select("subject_id").distinct()
        there = ids.exceptAll(had).isEmpty() and had.exceptAll(ids).isEmpty()
    if not there:
        write_split(make(), path, subject, **told)
    out = read_split(spark, path)
    shared = out.groupBy("fold", "subject_id").agg(F.countDistinct(F.col("role") == "train").alias("n")).filter("n > 1")
    require_empty(shared, "subjects on both sides of a fold")
    return out
