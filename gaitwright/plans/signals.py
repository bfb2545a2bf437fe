"""Queries over signals: a user's events in order of time are a series."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaitwright.functions import tables as TF
from gaitwright.operators import alignment as L
from gaitwright.operators import kernels as K
from gaitwright.operators import recordings as R
from gaitwright.operators import series as S
from gaitwright.operators import splits as G
from gaitwright.streaming import windows as ST

from .evaluation import rounded
from .registry import ORACLES, load, query

BY = ["user_id"]
SERIES_SQL = "s AS (SELECT user_id, event_type, value, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS idx FROM events)"
OVER = "OVER (PARTITION BY user_id ORDER BY idx)"


def series(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("user_id", "event_type", "value", t.alias("t"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts")) - 1).cast("long").alias("idx"))


@query("WITH " + SERIES_SQL + f", d AS (SELECT *, value - coalesce(lag(value) {OVER}, value) AS d1 FROM s) SELECT user_id, idx, round(d1, 6) AS d1, round(d1 - coalesce(lag(d1) {OVER}, d1), 6) AS d2 FROM d")
def differences(spark, sf_dir):
    d = S.difference(S.difference(series(spark, sf_dir), BY, "idx", "value", "d1"), BY, "idx", "d1", "d2")
    return rounded(d.select("user_id", "idx", "d1", "d2"), "d1", "d2", digits=6)


@query("WITH " + SERIES_SQL + """, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.user_id, a.idx, least(greatest(a.idx + o, 0), n - 1) AS j FROM s a JOIN n USING (user_id), (SELECT unnest(range(-2, 3)) AS o))
SELECT p.user_id, p.idx, round(sum(s.value) / 5, 6) AS smooth FROM p JOIN s ON s.user_id = p.user_id AND s.idx = p.j GROUP BY 1, 2""")
def moving_average(spark, sf_dir):
    return rounded(S.moving_average(series(spark, sf_dir), BY, "idx", "value", "smooth", 5).select("user_id", "idx", "smooth"), "smooth", digits=6)


@query("WITH " + SERIES_SQL + " SELECT user_id, idx, max(value) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS top FROM s")
def running_maximum(spark, sf_dir):
    return S.running_max(series(spark, sf_dir), BY, "idx", "value", "top").select("user_id", "idx", "top")


@query("WITH " + SERIES_SQL + ", b AS (SELECT *, CASE WHEN idx % 9 = 4 THEN 'nan'::DOUBLE WHEN idx % 9 = 7 THEN t - 1e9 ELSE t END AS c FROM s), q AS (SELECT *, lag(c) " + OVER + " AS p FROM b) SELECT user_id, idx FROM q WHERE NOT isnan(c) AND (idx = 0 OR (NOT isnan(p) AND c - p > 1e-9))")
def padding_strip(spark, sf_dir):
    broken = series(spark, sf_dir).withColumn("c", F.when(F.col("idx") % 9 == 4, float("nan")).when(F.col("idx") % 9 == 7, F.col("t") - 1e9).otherwise(F.col("t")))
    return S.strip_padding(broken, BY, "idx", "c").select("user_id", "idx")


@query("WITH " + SERIES_SQL + ", d AS (SELECT user_id, t - lag(t) " + OVER + " AS d FROM s) SELECT user_id, round(1 / median(d), 10) AS rate FROM d GROUP BY 1")
def sample_rates(spark, sf_dir):
    return rounded(S.sample_rate(series(spark, sf_dir), BY, "t"), "rate", digits=10)


@query("WITH " + SERIES_SQL + ", c AS (SELECT *, value - 34.5 AS v FROM s), d AS (SELECT *, v - lag(v) " + OVER + " AS d, (sign(v) <> lag(sign(v)) " + OVER + " AND abs(v) + abs(lag(v) " + OVER + ") >= 1e-5)::INT AS z FROM c), e AS (SELECT *, (sign(d) <> lag(sign(d)) " + OVER + ")::INT AS s2 FROM d) SELECT user_id, round(avg(abs(v)), 6) AS mav, round(sum(abs(d)), 6) AS wl, coalesce(sum(z), 0)::BIGINT AS zc, coalesce(sum(s2), 0)::BIGINT AS ssc FROM e GROUP BY 1")
def hudgins_features(spark, sf_dir):
    return rounded(S.hudgins(series(spark, sf_dir).withColumn("v", F.col("value") - 34.5), BY, "idx", "v"), "mav", "wl", digits=6)


@query("WITH " + SERIES_SQL + ", z AS (SELECT *, (sign(value - 34.5) <> lag(sign(value - 34.5)) " + OVER + ")::INT AS z FROM s) SELECT user_id, round(avg(value - 34.5), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value - 34.5), 6) AS min, round(max(value - 34.5), 6) AS max, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurt, round(sqrt(avg((value - 34.5) ** 2)), 6) AS rms, sum(z)::BIGINT AS crossings FROM z GROUP BY 1")
def time_features(spark, sf_dir):
    f = S.time_features(series(spark, sf_dir).withColumn("v", F.col("value") - 34.5), BY, "idx", "v")
    return rounded(f, "mean", "std", "min", "max", "skew", "kurt", "rms", digits=6)


@query("WITH " + SERIES_SQL + ", m AS (SELECT user_id, median(value) AS m, mad(value) AS s FROM s GROUP BY 1) SELECT user_id, idx, round(greatest(-6, least(6, (value - m) / CASE WHEN s > 1e-9 THEN 1.4826 * s ELSE 1 END)), 6) AS z FROM s JOIN m USING (user_id)")
def robust_scores(spark, sf_dir):
    return rounded(S.robust_z(series(spark, sf_dir), BY, "value", "z", 6.0).select("user_id", "idx", "z"), "z", digits=6)


@query("WITH " + SERIES_SQL + ", m AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.25) AS a, median(value) AS b, quantile_cont(value, 0.75) AS c FROM s GROUP BY 1) SELECT user_id, idx, round((value - m) / s, 6) AS z, round(greatest(-5, least(5, (value - b) / ((c - a) / 1.349))), 6) AS r FROM s JOIN m USING (user_id)")
def channel_scores(spark, sf_dir):
    z = S.iqr_score(S.z_score(series(spark, sf_dir), BY, "value", "z"), BY, "value", "r")
    return rounded(z.select("user_id", "idx", "z", "r"), "z", "r", digits=6)


@query("WITH " + SERIES_SQL + ", m AS (SELECT user_id, regr_slope(value, idx) AS a, regr_intercept(value, idx) AS b FROM s GROUP BY 1) SELECT user_id, idx, round(value - (a * idx + b), 6) AS flat FROM s JOIN m USING (user_id)")
def detrended(spark, sf_dir):
    return rounded(S.detrend(series(spark, sf_dir), BY, "idx", "value", "flat").select("user_id", "idx", "flat"), "flat", digits=6)


@query("WITH m AS (SELECT event_type, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, epoch(h)::BIGINT AS h, round(v - avg(v) OVER (PARTITION BY h), 9) AS v FROM m")
def average_reference(spark, sf_dir):
    m = load(spark, sf_dir, "events").groupBy("event_type", F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("h")).agg(F.avg("value").alias("x"))
    return rounded(S.average_reference(m, ["h"], "x", "v").select("event_type", "h", "v"), "v", digits=9)


@query("WITH " + SERIES_SQL + ", n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), g AS (SELECT user_id, k, k * (n - 1) / 31.0::DOUBLE AS p, n FROM n, (SELECT unnest(range(32))::INT AS k)) SELECT g.user_id, k, round(a.value + (p - a.idx) * (coalesce(b.value, a.value) - a.value), 6) AS value FROM g JOIN s a ON a.user_id = g.user_id AND a.idx = least(floor(p + 1e-9), n - 1) LEFT JOIN s b ON b.user_id = g.user_id AND b.idx = a.idx + 1")
def resampled(spark, sf_dir):
    return rounded(S.resample(series(spark, sf_dir), BY, "idx", "value", 32), "value", digits=6)


@query("WITH " + SERIES_SQL + ", x AS (SELECT user_id, idx, value - avg(value) OVER (PARTITION BY user_id) AS v FROM s), p AS (SELECT a.user_id, a.idx - b.idx AS lag, sum(a.v * b.v) / count(*) AS score, count(*) AS overlap FROM x a JOIN x b ON a.user_id = b.user_id AND b.idx BETWEEN a.idx - 5 AND a.idx + 5 GROUP BY 1, 2) SELECT user_id, lag::INT AS lag, round(score, 5) AS score, overlap FROM p")
def lag_correlation(spark, sf_dir):
    x = S.z_score(series(spark, sf_dir), BY, "value", "z")
    mean = series(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("m"))
    v = x.join(mean, "user_id").select("user_id", "idx", (F.col("value") - F.col("m")).alias("v"))
    return rounded(S.lag_scores(v, v, BY, "idx", "v", 5).select("user_id", "lag", "score", "overlap"), "score")


@query("WITH " + SERIES_SQL + ", b AS (SELECT user_id, event_type, max(idx) AS b FROM s GROUP BY 1, 2), m AS (SELECT user_id, min(b) AS b FROM b GROUP BY 1) SELECT s.user_id, count(*) AS n FROM s JOIN m ON s.user_id = m.user_id WHERE idx <= b GROUP BY 1")
def truncated(spark, sf_dir):
    return S.truncate_to_shortest(series(spark, sf_dir), BY, "event_type", "idx").groupBy("user_id").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS k FROM embeddings) SELECT label, round(sum(m), 4) AS total, round(max(m), 5) AS top, count(*) AS size FROM (SELECT label, k, avg(v::DOUBLE) AS m FROM p GROUP BY 1, 2) GROUP BY 1")
def pooled_vectors(spark, sf_dir):
    p = S.pooled(load(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return p.select("label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max("embedding"), 5).alias("top"), F.size("embedding").cast("long").alias("size"))


# ---- kernels, splits and windows -------------------------------------------------------------


LAGGED_SQL = SERIES_SQL + ", x AS (SELECT user_id, idx, value - avg(value) OVER (PARTITION BY user_id) AS v FROM s), a AS (SELECT user_id, idx + user_id % 11 AS idx, v + (idx * 7919 % 13 - 6) / 2 AS v FROM x)"


@query("WITH " + LAGGED_SQL + """, p AS (SELECT a.user_id, (a.idx - x.idx)::INT AS lag, sum(a.v * x.v) AS total, corr(a.v, x.v) AS r, count(*) AS n FROM a JOIN x ON a.user_id = x.user_id AND x.idx BETWEEN a.idx - 40 AND a.idx + 40 GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN n < 4 THEN NULL ELSE r END AS peak, row_number() OVER (PARTITION BY user_id ORDER BY round(total, 6) DESC, lag) AS k FROM p)
SELECT user_id, CASE WHEN peak >= 0.2 THEN lag ELSE 0 END AS lag, round(peak, 6) AS peak, coalesce(peak < 0.2, TRUE) AS fallback FROM b WHERE k = 1""")
def best_lags(spark, sf_dir):
    """How late a user's series runs behind itself, moved and disturbed."""
    s = series(spark, sf_dir)
    mean = s.groupBy("user_id").agg(F.avg("value").alias("m"))
    v = s.join(mean, "user_id").select("user_id", "idx", (F.col("value") - F.col("m")).alias("v"))
    a = v.select("user_id", (F.col("idx") + F.col("user_id") % 11).alias("idx"), (F.col("v") + (F.col("idx") * 7919 % 13 - 6) / 2).alias("v"))
    return rounded(S.best_lag(S.lag_scores(a, v, BY, "idx", "v", 40), BY), "peak", digits=6)


@query()
def clean_eeg(spark, sf_dir):
    return R.clean_eeg(series(spark, sf_dir), BY, "value", 200.0)


@query()
def clean_emg(spark, sf_dir):
    return R.clean_emg(series(spark, sf_dir), BY, "value", 1259.4)


@query()
def clean_imu(spark, sf_dir):
    return R.clean_imu(series(spark, sf_dir), BY, "value", 148.1)


@query()
def power_envelopes(spark, sf_dir):
    return R.power_envelope(series(spark, sf_dir), BY, "value", 200.0)


@query()
def loaded_trials(spark, sf_dir):
    """Every user's events as the recording of three devices started apart: on one time axis, cut and scaled."""
    s, long = series(spark, sf_dir), _long(spark, sf_dir)
    rates = s.select(*BY).distinct().select(*BY, F.lit(10.0).alias("eeg_rate"), F.lit(12.0).alias("emg_rate"), F.lit(8.0).alias("imu_rate"))
    t = L.load_trials(long, rates, BY)
    return t.select(*BY, *(F.size(m).alias(f"{m}_samples") for m in L.MODALITIES), "lag", "peak", "sync_fallback", "eeg_start", "other_start", "seconds", "warning")


BANDS = (("delta", 0.5, 4), ("theta", 4, 8), ("alpha", 8, 13), ("beta", 13, 30), ("gamma", 30, 45))


@query("WITH " + SERIES_SQL + """, c AS (SELECT user_id, idx, count(*) OVER (PARTITION BY user_id) AS n, value - avg(value) OVER (PARTITION BY user_id) AS v FROM s),
w AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * idx / n) AS w FROM c), d AS (SELECT user_id, k, any_value(n) AS n, sum(v * w * cos(2 * pi() * k * idx / n)) AS re, sum(v * w * sin(2 * pi() * k * idx / n)) AS im, sum(w * w) AS ww FROM w, (SELECT unnest(range(129)) AS k) WHERE k <= n // 2 GROUP BY 1, 2),
p AS (SELECT user_id, k * 200.0::DOUBLE / n AS f, 200.0::DOUBLE / n AS df, (re * re + im * im) / (200 * ww) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS p FROM d),
q AS (SELECT *, lead(p) OVER (PARTITION BY user_id ORDER BY f) AS p2, lead(f) OVER (PARTITION BY user_id ORDER BY f) AS f2 FROM p) SELECT user_id, """ + ", ".join(f"round(ln(1 + coalesce(sum(CASE WHEN f >= {lo} AND f2 <= {hi} THEN (p + p2) / 2 * df END), 0)), 6) AS {n}" for n, lo, hi in BANDS) + " FROM q GROUP BY 1")
def band_powers(spark, sf_dir):
    return rounded(K.spectral_features(series(spark, sf_dir), BY, "value", 200.0), *(n for n, _, _ in BANDS), digits=6)


def _sql_series(spark, sf_dir, df: DataFrame, columns: str) -> str:
    """The name of a view of a user's series for table functions."""
    TF.register(spark)
    view = "gait_" + "".join(c for c in sf_dir if c.isalnum()) + "_" + columns.replace(", ", "_")
    df.createOrReplaceTempView(view)
    return view


@query(ORACLES["band_powers"].replace("SELECT user_id, round(ln", "SELECT user_id::VARCHAR AS series, round(ln"))
def band_powers_in_sql(spark, sf_dir):
    df = series(spark, sf_dir).select(F.col("user_id").cast("string").alias("series"), "idx", "value", F.lit(200.0).alias("rate"))
    view = _sql_series(spark, sf_dir, df, "series, idx, value, rate")
    return rounded(spark.sql(f"SELECT * FROM gait_band_powers(TABLE(SELECT * FROM {view}) PARTITION BY series)"), *(n for n, _, _ in BANDS), digits=6)


@query()
def knot_alignment_in_sql(spark, sf_dir):
    """The trials of :func:`trials_from_long` by the table function."""
    view = _sql_series(spark, sf_dir, _long(spark, sf_dir).withColumnRenamed("user_id", "series").withColumn("series", F.col("series").cast("string")), "series, modality, channel, idx, value")
    return spark.sql(f"SELECT * FROM gait_knot_alignment(TABLE(SELECT * FROM {view}) PARTITION BY series)")


def _long(spark, sf_dir) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(m).alias("modality"), F.lit(c).alias("channel"), F.lit(f).alias("factor")) for m, c, f in (("eeg", "c1", 1), ("eeg", "c2", 2), ("emg", "m1", 3), ("imu", "x", 5))))
    return series(spark, sf_dir).select(*BY, "idx", "value", F.explode(kinds).alias("k")).select(*BY, "idx", "k.modality", "k.channel", (F.col("value") * F.col("k.factor")).alias("value"))


def trials(spark, sf_dir) -> DataFrame:
    """A trial for each user: 30, 4 and 24 channels that are functions of the events' values."""
    channels = lambda n, f: F.transform(F.sequence(F.lit(1), F.lit(n)), f)
    v, i = F.col("value"), F.col("idx")
    eeg, emg, imu = channels(30, lambda c: F.sin(v * c / 10)), channels(4, lambda c: v - 30 - c), channels(24, lambda c: F.cos(v / 10 + i * c / 50))
    at = series(spark, sf_dir).groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("idx", eeg.alias("eeg"), emg.alias("emg"), imu.alias("imu")))).alias("t"))
    return at.select(*BY, *(F.col(f"t.{m}").alias(m) for m in L.MODALITIES))


def _told(df: DataFrame) -> DataFrame:
    size = F.size("emg") + F.size("imu") + F.size("eeg")
    return df.select(*BY, "alignment_score", "feature_correlation", "path_expansion", "dtw_avg_cost", "fallback", "warning", size.alias("channels"), F.size(F.col("emg")[0]).alias("length"))


@query()
def knot_alignment(spark, sf_dir):
    return _told(L.aligned_trials(trials(spark, sf_dir), BY, "knot"))


@query()
def weighted_alignment(spark, sf_dir):
    return _told(L.aligned_trials(trials(spark, sf_dir), BY, "weighted", replace(L.RUNTIME, warp_blend=0.08)))


@query()
def trial_vectors(spark, sf_dir):
    v = L.aligned_trials(trials(spark, sf_dir), BY, "resample", eeg_rate=500.0, columns=["vector"])
    return v.select(*BY, F.size("vector").alias("size"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("WITH " + SERIES_SQL + ", c AS (SELECT user_id, idx, modality, channel, value * factor AS v FROM s, (VALUES ('eeg', 'c1', 1), ('eeg', 'c2', 2), ('emg', 'm1', 3), ('imu', 'x', 5)) AS k(modality, channel, factor)), m AS (SELECT user_id, modality, count(DISTINCT idx) AS n, count(DISTINCT channel) AS k, sum(v * (idx + 1)) AS s FROM c GROUP BY 1, 2) SELECT user_id, max(n) AS samples, sum(k)::BIGINT AS channels, round(sum(s), 4) AS total FROM m GROUP BY 1")
def trials_from_long(spark, sf_dir):
    t = L.trial_rows(_long(spark, sf_dir), BY)
    total = sum(F.aggregate(F.transform(F.col(m), lambda r, i: F.aggregate(r, F.lit(0.0), lambda a, x: a + x) * (i + 1)), F.lit(0.0), lambda a, x: a + x) for m in L.MODALITIES)
    return t.select(*BY, F.size("eeg").cast("long").alias("samples"), sum(F.size(F.col(m)[0]) for m in L.MODALITIES).cast("long").alias("channels"), F.round(total, 4).alias("total"))


@query("WITH s AS (SELECT c_custkey, min(c_mktsegment) AS m, min(c_nationkey) AS n FROM customer GROUP BY 1) SELECT c_custkey, round(1 / count(*) OVER (PARTITION BY m) + 1 / count(*) OVER (PARTITION BY n), 8) AS rarity FROM s")
def rarity_scores(spark, sf_dir):
    return rounded(G.rarity(load(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment", "c_nationkey"]).select("c_custkey", "rarity"), "rarity", digits=8)


@query()
def balanced_folds(spark, sf_dir):
    stats = G.rarity(load(spark, sf_dir, "supplier").withColumn("sign", F.signum("s_acctbal")), "s_suppkey", ["s_nationkey", "sign"])
    stats = stats.join(load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bi")), "s_suppkey")
    return G.balanced_folds(stats, "s_suppkey", 3, ["s_nationkey", "sign"], ["bi"])


@query("SELECT o_custkey, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3)::INT AS fold FROM orders")
def trial_folds(spark, sf_dir):
    return G.trial_round_robin(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 3)


HEX = "list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr({0}, i, 1)) - 1) * (16 ** (8 - i))))::BIGINT"


@query("WITH p AS (SELECT s_suppkey, ((row_number() OVER (ORDER BY md5('7/' || s_suppkey), s_suppkey) - 1) % 5)::INT AS f FROM supplier), r AS (SELECT s_suppkey, f, r::INT AS round FROM p, (SELECT unnest(range(5)) AS r)), v AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY md5('v/7/' || round || '/' || s_suppkey), s_suppkey) AS i, count(*) OVER (PARTITION BY round) AS n FROM r WHERE f <> round) SELECT round, s_suppkey, 'test' AS role FROM r WHERE f = round UNION ALL SELECT round, s_suppkey, CASE WHEN i <= greatest(1, round_even(n * 0.2, 0)) THEN 'validation' ELSE 'train' END FROM v")
def hashed_splits(spark, sf_dir):
    return G.hashed_split(load(spark, sf_dir, "supplier"), "s_suppkey", 5, 0.2, 7)


@query("WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT o.o_custkey, b::INT AS bag, o_orderkey, n, row_number() OVER (PARTITION BY o.o_custkey, b ORDER BY md5('5/' || b || '/' || o_orderkey), o_orderkey) - 1 AS r FROM orders o JOIN n ON n.o_custkey = o.o_custkey, (SELECT unnest(range(2)) AS b)) SELECT o_custkey, bag, s::INT AS slot, o_orderkey FROM r, (SELECT unnest(range(8)) AS s) WHERE s % n = r")
def trial_bags(spark, sf_dir):
    return G.bags(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 2, 8, 5)


@query("SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('3/' || s_suppkey), s_suppkey)::INT AS place FROM supplier")
def seeded_order(spark, sf_dir):
    return G.seeded_order(load(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], "s_suppkey", 3)


@query("WITH s AS (SELECT p_brand, p_partkey, sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) / sum(p_retailprice) OVER (PARTITION BY p_brand) AS b FROM part), t AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY p_brand ORDER BY p_partkey), 0) AS a FROM s), d AS (SELECT p_brand, d::INT AS draw, " + HEX.format("md5('d/0/' || p_brand || '/' || d)") + " / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest(range(50)) AS d)) SELECT d.p_brand, draw, p_partkey FROM d JOIN t ON t.p_brand = d.p_brand AND u >= a AND u < b")
def weighted_draws(spark, sf_dir):
    return G.weighted_draws(load(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_retailprice", 50)


@query("WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey, count(*) OVER (PARTITION BY c_mktsegment) AS a, count(*) OVER (PARTITION BY c_nationkey) AS b FROM customer) SELECT c_custkey, round((1 / sqrt(a) + 1 / sqrt(b)) / 2, 8) AS weight FROM c")
def two_label_weights(spark, sf_dir):
    w = G.sampling_weights(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_mktsegment", "c_nationkey")
    return w.select("c_custkey", F.round("sampling_weight", 8).alias("weight"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    t = ST.tumbling(load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "event_type", "value")
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("WITH g AS (SELECT *, (ts - lag(ts) OVER w > INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL)::INT AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_counts(spark, sf_dir):
    s = ST.sessions(load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "30 minutes", "user_id", "value")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
