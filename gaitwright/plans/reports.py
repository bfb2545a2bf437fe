"""Queries over texts, reviews, arrays and baselines."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaitwright.functions import arrays as V
from gaitwright.functions import text as T
from gaitwright.operators import cohort as H
from gaitwright.operators import estimators as E
from gaitwright.operators import metrics as M
from gaitwright.operators import textscores as X

from .evaluation import rounded
from .registry import load, query

PAIRS_SQL = "c AS (SELECT conv_id, turn, text AS hyp, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations), p AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(hyp, '\\s+'), lambda w: w <> '') AS h, list_filter(regexp_split_to_array(ref, '\\s+'), lambda w: w <> '') AS r FROM c WHERE ref IS NOT NULL AND hyp IS NOT NULL), " \
    "g AS (SELECT conv_id, turn, n, 'h' AS side, array_to_string(list_slice(h, i, i + n - 1), chr(1)) AS gram FROM (SELECT *, unnest(range(1, len(h) - n + 2)) AS i FROM p, (SELECT unnest(range(1, 5)) AS n) WHERE len(h) >= n) UNION ALL SELECT conv_id, turn, n, 'r', array_to_string(list_slice(r, i, i + n - 1), chr(1)) FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM p, (SELECT unnest(range(1, 5)) AS n) WHERE len(r) >= n)), " \
    "k AS (SELECT conv_id, turn, n, gram, sum((side = 'h')::INT) AS a, sum((side = 'r')::INT) AS b FROM g GROUP BY ALL), m AS (SELECT conv_id, turn, " + ", ".join(f"sum(CASE WHEN n = {n} THEN least(a, b) ELSE 0 END)::BIGINT AS match_{n}" for n in range(1, 5)) + " FROM k GROUP BY 1, 2), " \
    "o AS (SELECT p.conv_id, p.turn, len(h)::BIGINT AS hyp_len, len(r)::BIGINT AS ref_len, " + ", ".join(f"coalesce(match_{n}, 0)::BIGINT AS match_{n}, greatest(0, len(h) - {n - 1})::BIGINT AS hyp_{n}, greatest(0, len(r) - {n - 1})::BIGINT AS ref_{n}" for n in range(1, 5)) + " FROM p LEFT JOIN m USING (conv_id, turn))"  # fmt: skip


def bleu_sql(n: int) -> str:
    logs = " + ".join(f"ln(CASE WHEN match_{i} > 0 THEN match_{i} ELSE 0.1 END / greatest(1, hyp_{i}))" for i in range(1, n + 1))
    return f"CASE WHEN hyp_len = 0 OR match_1 = 0 THEN 0 ELSE CASE WHEN hyp_len >= ref_len THEN 1 ELSE exp(1 - ref_len / hyp_len) END * exp(({logs}) / {n}) END"


def pairs(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").withColumn("ref", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.filter("ref is not null and text is not null").select("conv_id", "turn", F.col("text").alias("hyp"), "ref")


def counts(spark, sf_dir):
    return X.overlap_counts(pairs(spark, sf_dir), ["conv_id", "turn"], X.words(F.col("hyp")), X.words(F.col("ref")))


@query("WITH " + PAIRS_SQL + " SELECT conv_id, turn, " + ", ".join(f"round({bleu_sql(n)}, 8) AS bleu_{n}" for n in range(1, 5)) + " FROM o")
def sentence_bleu(spark, sf_dir):
    return rounded(X.sentence_bleu(counts(spark, sf_dir), ["conv_id", "turn"]), *(f"bleu_{n}" for n in range(1, 5)), digits=8)


@query("WITH " + PAIRS_SQL + ", t AS (SELECT sum(hyp_len) AS hyp_len, sum(ref_len) AS ref_len, " + ", ".join(f"sum(match_{n}) AS match_{n}, sum(hyp_{n}) AS hyp_{n}" for n in range(1, 5)) + " FROM o) SELECT " + ", ".join(f"round(100 * ({bleu_sql(n)}), 6) AS bleu_{n}" for n in range(1, 5)) + " FROM t")
def corpus_bleu(spark, sf_dir):
    return rounded(X.corpus_bleu(counts(spark, sf_dir)), *(f"bleu_{n}" for n in range(1, 5)), digits=6)


def mixed_sql(text: str) -> str:
    """Tokens of :func:`textscores.mixed_tokens` with spaces between, in SQL."""
    for pattern, by in ((f"([{X.IDEOGRAPHS}])", r" \1 "), (r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        pattern = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


MIXED_SQL = PAIRS_SQL.replace("text AS hyp", mixed_sql("text") + " AS hyp").replace("lead(text) OVER", "lead(" + mixed_sql("text") + ") OVER")


def _halved_sql() -> str:
    none = lambda i: " + ".join(f"(match_{k} = 0)::INT" for k in range(1, i + 1))
    logs = " + ".join(f"ln(CASE WHEN match_{i} > 0 THEN match_{i}::DOUBLE ELSE pow(2.0, -({none(i)})) END / hyp_{i})" for i in range(1, 5))
    return f"CASE WHEN match_1 + match_2 + match_3 + match_4 = 0 OR hyp_4 = 0 THEN 0 ELSE CASE WHEN hyp_len >= ref_len THEN 1 ELSE exp(1 - ref_len / hyp_len) END * exp(({logs}) / 4) END"


@query("WITH " + MIXED_SQL + ", t AS (SELECT conv_id % 7 AS part, sum(hyp_len) AS hyp_len, sum(ref_len) AS ref_len, " + ", ".join(f"sum(match_{n}) AS match_{n}, sum(hyp_{n}) AS hyp_{n}" for n in range(1, 5)) + f" FROM o GROUP BY 1) SELECT part, round(100 * ({_halved_sql()}), 6) AS mixed_corpus_bleu FROM t")
def mixed_corpus_bleu(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("part", F.col("conv_id") % 7)
    return rounded(X.mixed_corpus_bleu(p, ["part"]), "mixed_corpus_bleu", digits=6)


@query("WITH c AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '(?s).'), lambda x: x <> '') AS r, list_filter(regexp_extract_all(text, '(?s).'), lambda x: x <> '') AS h, text FROM conversations), l AS (SELECT conv_id, turn, h, r FROM c WHERE r IS NOT NULL AND text IS NOT NULL), g AS (SELECT conv_id, turn, side, unnest(t) AS x FROM (SELECT conv_id, turn, 'h' AS side, h AS t FROM l UNION ALL SELECT conv_id, turn, 'r', r FROM l)), k AS (SELECT conv_id, turn, x, sum((side = 'h')::INT) AS a, sum((side = 'r')::INT) AS b FROM g GROUP BY ALL), m AS (SELECT conv_id, turn, sum(least(a, b)) AS m FROM k GROUP BY 1, 2) SELECT conv_id, turn, len(h)::BIGINT AS hyp_len, len(r)::BIGINT AS ref_len, coalesce(m, 0)::BIGINT AS matches FROM l LEFT JOIN m USING (conv_id, turn)")
def character_overlaps(spark, sf_dir):
    """Single characters that two turns share, white space counted."""
    p = pairs(spark, sf_dir)
    c = X.overlap_counts(p, ["conv_id", "turn"], X.characters(F.col("hyp")), X.characters(F.col("ref")), 1)
    return c.select("conv_id", "turn", "hyp_len", "ref_len", F.col("match_1").alias("matches"))


@query(r"""WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS x, text FROM conversations), f AS (SELECT conv_id, turn, text, regexp_matches(x, '\{[a-z_]+\}|\[[A-Z_]{3,}\]') AS placeholder, regexp_matches(x, '(?i)</?think>') AS thinking, regexp_matches(x, '(?i)<\|im_(start|end)\|>|^\s*(system|user|assistant)\s*:') AS prompt_echo, regexp_matches(x, '(?i)\b(fma|bi|barthel)[^.;]{0,12}\d') AS metric, regexp_matches(x, '\b[SP]\d{2,}\b') AS patient, regexp_matches(x, '(?i)\bwrist\s*\d+\s*points?\b') AS wrist_score,
(contains(lower(x), 'avoid') OR contains(lower(x), 'the')) AND (contains(lower(x), 'and') OR contains(lower(x), 'que')) AS constraint_echo, list_filter(['in', 'pour', 'zz'], lambda c: contains(x, c)) AS claims FROM a)
SELECT conv_id, turn, array_to_string(list_concat(claims, CASE WHEN constraint_echo THEN ['constraint_echo'] ELSE [] END), ',') AS unsupported, placeholder, thinking, prompt_echo, metric, patient, wrist_score, constraint_echo,
text IS NOT NULL AND len(claims) = 0 AND NOT (placeholder OR thinking OR prompt_echo OR metric OR patient OR wrist_score OR constraint_echo) AS safe FROM f""")
def recommendation_audits(spark, sf_dir):
    """Turns as recommendations; the wordings are ones that occur."""
    forbidden = F.array(*map(F.lit, ("in", "pour", "zz")))
    a = T.recommendation_audit(F.col("text"), forbidden, instructions=("avoid", "the"), echoes=("and", "que"))
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", a.alias("a"))
    return c.select("conv_id", "turn", F.array_join("a.unsupported", ",").alias("unsupported"), *(f"a.{n}" for n in ("placeholder", "thinking", "prompt_echo", "metric", "patient", "wrist_score", "constraint_echo", "safe")))


@query("WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 4) AS z FROM embeddings), s AS (SELECT vec_id, label % 6 AS t, z, list_sum(list_transform(z[1:5], lambda x: exp(x - list_max(z[1:5])))) AS q FROM e), v AS (SELECT vec_id, t, list_sum(list_transform(range(1, 6), lambda k: exp(z[k] - list_max(z[1:5])) / q * (k - 1) * 25)) + 25 * tanh(z[6]) AS bounded, least(4, greatest(0, CASE WHEN abs((z[7] * 10 + 50) / 25 - floor((z[7] * 10 + 50) / 25) - 0.5) < 1e-12 THEN 2 * round((z[7] * 10 + 50) / 50) ELSE round((z[7] * 10 + 50) / 25) END))::INT AS bin FROM s) SELECT vec_id, round(bounded, 8) AS bounded, bin FROM v")
def bounded_decoding(spark, sf_dir):
    """Five bins from 0 to 100, a residual, and the bin of a target."""
    z = F.transform("embedding", lambda x: x.cast("double") * 4)
    e = load(spark, sf_dir, "embeddings").select("vec_id", z.alias("z"))
    return e.select("vec_id", F.round(V.bounded_value(F.slice("z", 1, 5), F.col("z")[5], 0.0, 100.0, 25.0), 8).alias("bounded"), V.bin_of(F.col("z")[6] * 10 + 50, 0.0, 100.0, 25.0).alias("bin"))


@query("WITH e AS (SELECT label % 3 AS part, label % 6 AS t, embedding FROM embeddings), k AS (SELECT part, t, unnest(embedding[1:5])::DOUBLE * 4 AS z, unnest(range(5)) AS k FROM e), l AS (SELECT part, k, (greatest(z, 0) - z * (t > k)::INT + ln(1 + exp(-abs(z)))) * (t + 1) / 2.0::DOUBLE AS v FROM k WHERE k = 0 OR t > k - 1), m AS (SELECT part, k, avg(v) AS m FROM l GROUP BY 1, 2) SELECT part, round(avg(m), 8) AS loss FROM m GROUP BY 1")
def ordinal_losses(spark, sf_dir):
    """Loss of a chain of five logits over the rows that each of them has, classes weighed."""
    z = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 4)
    weights = F.array(*(F.lit((t + 1) / 2) for t in range(6)))
    e = load(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("part"), V.ordinal_losses(z, F.col("label") % 6, weights).alias("v"))
    return rounded(H.ordinal_loss(e, ["part"], "v"), "loss", digits=8)


@query("WITH " + PAIRS_SQL + " SELECT conv_id, turn, round(CASE WHEN hyp_1 + ref_1 > 0 THEN 2 * match_1 / (hyp_1 + ref_1) ELSE 0 END, 8) AS rouge1_f, round(CASE WHEN hyp_2 + ref_2 > 0 THEN 2 * match_2 / (hyp_2 + ref_2) ELSE 0 END, 8) AS rouge2_f FROM o")
def rouge_n(spark, sf_dir):
    return rounded(X.rouge_n(counts(spark, sf_dir), ["conv_id", "turn"]), "rouge1_f", "rouge2_f", digits=8)


@query()
def rouge_l(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", X.rouge_l(X.words(F.col("hyp")), X.words(F.col("ref"))).alias("rouge_l_f"))


@query(r"SELECT conv_id, turn, regexp_matches(text, '\{[a-z_]+\}|\[[A-Z_]{3,}\]') AS placeholder, regexp_matches(text, '(?i)</?think>') AS thinking, regexp_matches(text, '(?i)<\|im_(start|end)\|>|^\s*(system|user|assistant)\s*:') AS prompt_echo, regexp_matches(text, '(?i)\b(fma|bi|barthel)[^.;]{0,12}\d') AS metric FROM conversations")
def leak_flags(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", *(c.alias(n) for n, c in T.leak_flags(F.col("text")).items()))


@query("SELECT role, count(*) AS n, round(avg((text LIKE '%the%')::INT), 8) AS has_the, round(avg(CASE WHEN turn > 0 THEN (text LIKE '%and%')::INT END), 8) AS later_and FROM conversations GROUP BY role")
def audit_rates(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("role", F.contains("text", F.lit("the")).alias("has_the"), F.when(F.col("turn") > 0, F.contains("text", F.lit("and"))).alias("later_and"))
    return rounded(X.audit_rates(c, ["role"], ["has_the", "later_and"]), "has_the", "later_and", digits=8)


TIERS = "CASE WHEN {0} <= 4 THEN 'very_severe' WHEN {0} <= 10 THEN 'severe' WHEN {0} <= 15 THEN 'moderate' WHEN {0} <= 19 THEN 'mild' ELSE 'near_normal' END"


@query("SELECT p_partkey, " + TIERS.format("p_size % 23") + " AS motor, CASE WHEN p_size * 2 <= 20 THEN 'total' WHEN p_size * 2 <= 60 THEN 'severe' WHEN p_size * 2 <= 90 THEN 'moderate' ELSE 'mild' END AS dependence, array_to_string(list_filter([CASE WHEN p_size % 23 > 20 THEN 'fma' END, CASE WHEN p_size * 2 > 100 THEN 'bi' END, CASE WHEN p_size % 8 NOT BETWEEN 1 AND 6 THEN 'stage' END], lambda x: x IS NOT NULL), ',') AS out_of_range, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'spasticity' END, CASE WHEN p_size * 2 > 60 THEN 'full_dependence' END, CASE WHEN p_size % 23 <= 10 THEN 'full_recovery' END], lambda x: x IS NOT NULL), ',') AS forbidden FROM part")
def fact_cards(spark, sf_dir):
    s = F.col("p_size")
    card = T.fact_card(s % 23, s * 2, F.when(s % 2 == 0, "0").otherwise("1+"), s % 8)
    c = load(spark, sf_dir, "part").select("p_partkey", card.alias("c"))
    return c.select("p_partkey", "c.motor", "c.dependence", F.array_join("c.out_of_range", ",").alias("out_of_range"), F.array_join("c.forbidden", ",").alias("forbidden"))


@query("WITH r AS (SELECT o_custkey AS item, o_orderkey % 3 AS rater, max(o_orderkey % 5 + 1)::INT AS score FROM orders GROUP BY 1, 2) SELECT a.rater AS a, b.rater AS b, count(*) AS n, round(avg(abs(a.score - b.score)), 8) AS apart FROM r a JOIN r b ON a.item = b.item AND a.rater < b.rater GROUP BY 1, 2")
def rater_pairs(spark, sf_dir):
    p = X.rater_pairs(_ratings(spark, sf_dir), ["item"], "rater", "score")
    return p.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("score_a") - F.col("score_b"))), 8).alias("apart"))


def _ratings(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("item"), (F.col("o_orderkey") % 3).alias("rater")).agg(F.max(F.col("o_orderkey") % 5 + 1).cast("int").alias("score"))


@query("WITH r AS (SELECT o_custkey AS item, o_orderkey % 3 AS rater, max(o_orderkey % 5 + 1)::INT AS score FROM orders GROUP BY 1, 2), p AS (SELECT a.rater AS a, b.rater AS b, a.score AS x, b.score AS y FROM r a JOIN r b ON a.item = b.item AND a.rater < b.rater), u AS (SELECT a, b, s, row_number() OVER (PARTITION BY a, b ORDER BY s) AS i FROM (SELECT a, b, x AS s FROM p UNION SELECT a, b, y FROM p)), q AS (SELECT p.a, p.b, v.i AS x, w.i AS y FROM p JOIN u v ON v.a = p.a AND v.b = p.b AND v.s = x JOIN u w ON w.a = p.a AND w.b = p.b AND w.s = y), far AS (SELECT a, b, count(*) AS n, sum(abs(x - y)) AS far FROM q GROUP BY 1, 2), rows_ AS (SELECT a, b, x, count(*) AS k FROM q GROUP BY ALL), cols AS (SELECT a, b, y, count(*) AS k FROM q GROUP BY ALL), apart AS (SELECT r.a, r.b, sum(r.k * c.k * abs(x - y)) AS apart FROM rows_ r JOIN cols c ON r.a = c.a AND r.b = c.b GROUP BY 1, 2) SELECT a, b, n, round(1 - far * n / apart::DOUBLE, 8) AS weighted_kappa FROM far JOIN apart USING (a, b)")
def rater_kappa(spark, sf_dir):
    p = X.rater_pairs(_ratings(spark, sf_dir), ["item"], "rater", "score").withColumnsRenamed({"score_a": "y_true", "score_b": "y_pred"})
    return M.class_metrics(M.confusion(p, ["a", "b"], 6), ["a", "b"]).select("a", "b", "n", F.round("weighted_kappa", 8).alias("weighted_kappa"))


@query("WITH r AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY md5('9/' || s_suppkey || '/' || s_name), s_suppkey, s_name) AS i, dense_rank() OVER (ORDER BY s_suppkey) AS c FROM supplier) SELECT s_suppkey, format('R{:03d}', i) AS review_id, format('C{:03d}', c) AS case_code FROM r")
def blinded_packet(spark, sf_dir):
    return X.blinded(load(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "s_name", 9).select("s_suppkey", "review_id", "case_code")


@query("SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS sq, (list_position(e, list_max(e)) - 1)::INT AS top FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def vector_stats(spark, sf_dir):
    e = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(V.dot(e, e), 6).alias("sq"), V.argmax(e).alias("top"))


@query("WITH e AS (SELECT vec_id, unnest(embedding[1:5])::DOUBLE * 4 AS x, unnest(range(1, 6)) AS k FROM embeddings), s AS (SELECT *, exp(sum(ln(1 / (1 + exp(-x)))) OVER (PARTITION BY vec_id ORDER BY k)) AS up, exp(x - max(x) OVER (PARTITION BY vec_id)) AS w FROM e), g AS (SELECT vec_id, k, greatest(coalesce(lag(up) OVER (PARTITION BY vec_id ORDER BY k), 1) - up, 1e-6) AS p FROM s UNION ALL SELECT vec_id, 6, greatest(up, 1e-6) FROM s WHERE k = 5), n AS (SELECT vec_id, " + ", ".join(f"round(max(CASE WHEN k = {k} THEN p END) / sum(p), 8) AS p{k}" for k in range(1, 7)) + " FROM g GROUP BY 1), d AS (SELECT vec_id, sum((up > 0.5)::INT)::INT AS rank, round(sum(w * (k - 1) * 5) / sum(w), 8) AS expected FROM s GROUP BY 1) SELECT * FROM d JOIN n USING (vec_id)")
def ordinal_decoding(spark, sf_dir):
    """The first five components are the logits of six ordered classes."""
    logits = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 4)
    d = load(spark, sf_dir, "embeddings").select("vec_id", V.ordinal_rank(logits).alias("rank"), V.ordinal_probabilities(logits).alias("p"), F.round(V.expected_value(logits, 0, 20), 8).alias("expected"))
    return d.select("vec_id", "rank", "expected", *(F.round(F.col("p")[k - 1], 8).alias(f"p{k}") for k in range(1, 7)))


@query("SELECT label, round((SELECT avg(label) FROM embeddings WHERE vec_id % 3 <> 0), 8) AS y_pred, count(*) AS n FROM embeddings WHERE vec_id % 3 = 0 GROUP BY 1")
def constant_baseline(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    out = E.constant(e.filter("vec_id % 3 <> 0"), e.filter("vec_id % 3 = 0"), "label", "regression")
    return out.groupBy("label", F.round("y_pred", 8).alias("y_pred")).agg(F.count("*").alias("n"))


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 3).cast("int").alias("fold"), F.col("label").cast("double").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


@query()
def ridge_folds(spark, sf_dir):
    return E.cross_fitted("ridge", _vectors(spark, sf_dir), "label", "fold", [0, 1, 2], (0, 9)).select("vec_id", "fold", "label", "y_pred")


@query()
def logistic_folds(spark, sf_dir):
    return E.cross_fitted("logistic", _vectors(spark, sf_dir), "label", "fold", [0, 1, 2]).select("vec_id", "fold", "label", "y_pred")


@query()
def validated_history(spark, sf_dir):
    """Penalties of a ridge tried on vectors of inner folds; what was chosen stands beside each."""
    v = _vectors(spark, sf_dir).withColumn("subject", F.col("vec_id") % 50)
    _, history, choice = E.validated("ridge", v, "label", "subject", [{"regParam": 10.0**k} for k in range(-3, 3)], 2, folds=3, seed=4, bounds=(0.0, 9.0))
    return history.join(choice, "model").select("step", "settings", "loss", "spread", "best_epoch", "best_value", "last_epoch")
