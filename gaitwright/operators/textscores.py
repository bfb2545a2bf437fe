"""Overlap of generated and reference texts, and the blinded review of reports."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitwright.session import small_batches

from . import order


def characters(text: Column) -> Column:
    """Every character, white space too."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


#: Characters that are tokens of their own: ideographs, their marks and full-width forms; fixed values.
IDEOGRAPHS = (
    r"\u2600-\u27bf\u2e80-\u2fdf\u2ff0-\u303f\u3100-\u312f\u31a0-\u31bf\u31c0-\u31ef\u3200-\u33ff\u3400-\u4db5\u4e00-\u9fbb"
    r"\uf900-\ufa2d\ufa30-\ufa6a\ufa70-\ufad9\ufe10-\ufe1f\ufe30-\ufe4f\uff00-\uffef\x{20000}-\x{2a6d6}\x{2f800}-\x{2fa1d}"
)


def mixed_tokens(text: Column) -> Column:
    """Tokens of a text of ideographs and other writing: an ideograph is a token, other words stay whole, marks
    are split off as usual for this score: points and commas stay inside numbers, a dash goes after a digit."""
    apart = (
        (f"([{IDEOGRAPHS}])", " $1 "), (r"([{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "),
    )
    for pattern, by in apart:
        text = F.regexp_replace(text, pattern, by)
    return words(text)


#: Tokens of a pair from which its n-grams are numbered and sorted; below it counting them one by one takes less time.
LONG_PAIR = 200


def shared_ngrams(h: list, r: list, most: int) -> list[int]:
    """Clipped matches of the n-grams of two token lists, for each n up to ``most``."""
    if len(h) + len(r) < LONG_PAIR:
        counted = ((Counter(zip(*(t[i:] for i in range(n)))) for t in (h, r)) for n in range(1, most + 1))
        return [sum((a & b).values()) for a, b in counted]
    known: dict = {}
    x, y = (np.array([known.setdefault(t, len(known)) for t in tokens], np.int64) for tokens in (h, r))
    a, b, out = x, y, []
    for n in range(1, most + 1):
        if n > 1:  # the number of the n-gram one shorter, and of its last token
            a, b = a[:-1] * len(known) + x[n - 1 :], b[:-1] * len(known) + y[n - 1 :]
            numbers = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
            a, b = numbers[: len(a)], numbers[len(a) :]
        size = len(x) + len(y)
        out.append(int(np.minimum(np.bincount(a, minlength=size), np.bincount(b, minlength=size)).sum()))
    return out


def _overlaps(most: int):
    def run(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
        out = []
        for h, r in zip(hyp, ref):
            row = [len(h), len(r)]
            for n, match in enumerate(shared_ngrams(list(h), list(r), most), 1):
                row += [match, max(0, len(h) - n + 1), max(0, len(r) - n + 1)]
            out.append(row)
        return pd.DataFrame(out, columns=_count_names(most), dtype="int64")

    return run


def _count_names(most: int) -> list[str]:
    return ["hyp_len", "ref_len", *(f"{k}_{n}" for n in range(1, most + 1) for k in ("match", "hyp", "ref"))]


def overlap_counts(pairs: DataFrame, key: Sequence[str], hyp: Column, ref: Column, most: int = 4) -> DataFrame:
    """(key, hyp_len, ref_len, match_n, hyp_n, ref_n for n up to ``most``): clipped n-gram matches of two
    token arrays. A pair is one row and is counted where it is, without a shuffle."""
    small_batches(pairs.sparkSession)
    return pairs.select(*key, _counts(most)(hyp, ref).alias("__gw_n")).select(*key, "__gw_n.*")


def _counts(most: int = 4):
    return F.pandas_udf(_overlaps(most), ", ".join(f"{c} long" for c in _count_names(most)))


def bleu(n: int, smooth: float = 0.1) -> Column:
    """BLEU-n of counts: a precision without matches counts ``smooth`` matches; brevity penalty."""
    logs = sum((F.log(F.when(F.col(f"match_{i}") > 0, F.col(f"match_{i}")).otherwise(smooth) / F.greatest(F.lit(1), F.col(f"hyp_{i}"))) for i in range(1, n + 1)), F.lit(0.0)) / n
    brevity = F.when(F.col("hyp_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.col("ref_len") / F.col("hyp_len")))
    return F.when((F.col("hyp_len") == 0) | (F.col("match_1") == 0), 0.0).otherwise(brevity * F.exp(logs))


def halved_bleu(n: int = 4) -> Column:
    """BLEU-n of summed counts in which the first order without a match counts half a match, the next a
    quarter and so on; 0 where no order has a match or the texts are too short for one."""
    orders = range(1, n + 1)
    none = lambda i: sum((F.when(F.col(f"match_{k}") == 0, 1).otherwise(0) for k in range(1, i + 1)), F.lit(0))
    share = lambda i: F.when(F.col(f"match_{i}") > 0, F.col(f"match_{i}").cast("double")).otherwise(F.pow(F.lit(2.0), -none(i))) / F.col(f"hyp_{i}")
    logs = sum((F.log(F.when(F.col(f"hyp_{i}") > 0, share(i))) for i in orders), F.lit(0.0)) / n
    brevity = F.when(F.col("hyp_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.col("ref_len") / F.col("hyp_len")))
    empty = sum((F.col(f"match_{i}") for i in orders), F.lit(0)) == 0
    return F.when(empty | (F.col(f"hyp_{n}") == 0), 0.0).otherwise(brevity * F.exp(logs))


def sentence_bleu(counts: DataFrame, key: Sequence[str]) -> DataFrame:
    return counts.select(*key, *(bleu(n).alias(f"bleu_{n}") for n in range(1, 5)))


_SUMMED = ["hyp_len", "ref_len", *(f"{a}_{n}" for a in ("match", "hyp") for n in range(1, 5))]


def summed_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in _SUMMED))


def mixed_corpus_bleu(pairs: DataFrame, by: Sequence[str], hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """(by, mixed_corpus_bleu): BLEU of all pairs of a group by :func:`mixed_tokens`, in percent."""
    counts = overlap_counts(pairs, by, mixed_tokens(F.col(hyp)), mixed_tokens(F.col(ref)))
    return summed_counts(counts, by).select(*by, (100 * halved_bleu()).alias("mixed_corpus_bleu"))


def corpus_bleu(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """BLEU of summed counts."""
    sums = summed_counts(counts, by)
    return sums.select(*by, *((bleu(n) * 100).alias(f"bleu_{n}") for n in range(1, 5)))


def rouge_n(counts: DataFrame, key: Sequence[str]) -> DataFrame:
    """F measure of unigram and bigram overlap; 0 for empty sides."""
    f = lambda n: F.when(F.col(f"hyp_{n}") + F.col(f"ref_{n}") > 0, 2 * F.col(f"match_{n}") / (F.col(f"hyp_{n}") + F.col(f"ref_{n}"))).otherwise(0.0)
    return counts.select(*key, f(1).alias("rouge1_f"), f(2).alias("rouge2_f"))


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit rows."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    for y in b:
        u = row & places.get(y, 0)
        row = (row + u | row - u) & (1 << len(a)) - 1
    return len(a) - row.bit_count()


def _rouge_l(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([2 * common_length(list(h), list(r)) / (len(h) + len(r)) if len(h) and len(r) else 0.0 for h, r in zip(hyp, ref)], dtype=float)


def rouge_l(hyp: Column, ref: Column) -> Column:
    """F measure of the longest common subsequence of two token arrays."""
    return F.pandas_udf(_rouge_l, "double")(hyp, ref)


# ---- blinded review --------------------------------------------------------------------------


def blinded(reports: DataFrame, subject: str, system: str, seed: int) -> DataFrame:
    """``case_code`` by order of subject, ``review_id`` by a seeded shuffle, ids running over all reports.

    A report is one (system, subject); :func:`repeated_reports` finds those that are not.
    """
    whole = F.col(subject).try_cast("double") if reports.schema[subject].dataType.simpleString() == "string" else F.col(subject).cast("double")
    one = reports.select(subject).distinct().withColumn("__gw_v", F.coalesce(whole, F.lit(float("inf"))))
    cases = order.numbered(one, "__gw_v", subject, name="__gw_c").select(subject, F.format_string("C%03d", "__gw_c").alias("case_code"))
    drawn = reports.withColumn("__gw_m", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(subject).cast("string"), F.col(system))))
    drawn = drawn.withColumn("__gw_h", F.conv(F.substring("__gw_m", 1, 8), 16, 10).cast("double"))
    shuffled = order.numbered(drawn, "__gw_h", "__gw_m", subject, system, name="__gw_p")
    return shuffled.withColumn("review_id", F.format_string("R%03d", "__gw_p")).drop("__gw_h", "__gw_m", "__gw_p").join(cases, subject)


def repeated_reports(reports: DataFrame, subject: str, system: str) -> DataFrame:
    return reports.groupBy(system, subject).count().filter("count > 1")


def review_tables(reports: DataFrame, subject: str, system: str, seed: int, shown: Sequence[str], hidden: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What reviewers see, and the key that links it to systems and subjects."""
    both = blinded(reports, subject, system, seed)
    return both.select("review_id", "case_code", *shown), both.select("review_id", "case_code", system, subject, *hidden)


def key_faults(ratings: DataFrame, key: DataFrame, rater: str, review: str = "review_id") -> DataFrame:
    """(rater, review, problem): reviews a rater has not rated ("missing"), rated without being in the
    key ("unknown"), or rated more than once ("repeated")."""
    done = ratings.groupBy(rater, review).agg(F.count("*").alias("n"))
    known = key.select(review).distinct()
    raters = ratings.select(rater).distinct()
    # Only reviews that some rater lacks meet the raters, each of whose pairs is a fault or is taken out again.
    seen = done.groupBy(review).agg(F.count("*").alias("__gw_k"))
    lacking = known.join(seen, review, "left").crossJoin(raters.agg(F.count("*").alias("__gw_r"))).filter(F.coalesce("__gw_k", F.lit(0)) < F.col("__gw_r")).select(review)
    missing = lacking.crossJoin(raters).join(done, [rater, review], "left_anti").select(rater, review, F.lit("missing").alias("problem"))
    unknown = done.join(known, review, "left_anti").select(rater, review, F.lit("unknown").alias("problem"))
    repeated = done.filter("n > 1").join(known, review, "left_semi").select(rater, review, F.lit("repeated").alias("problem"))
    return missing.unionByName(unknown).unionByName(repeated)


def rating_summary(ratings: DataFrame, by: Sequence[str], case: str, score: str) -> DataFrame:
    return ratings.groupBy(*by).agg(F.count(score).alias("n"), F.countDistinct(case).alias("cases"), F.avg(score).alias("mean"))


def rater_pairs(ratings: DataFrame, item: Sequence[str], rater: str, score: str) -> DataFrame:
    """(a, b, score_a, score_b) of all unordered pairs of raters of an item."""
    a = ratings.select(*item, F.col(rater).alias("a"), F.col(score).alias("score_a"))
    b = ratings.select(*item, F.col(rater).alias("b"), F.col(score).alias("score_b"))
    return a.join(b, list(item)).filter("a < b")


def audit_rates(rows: DataFrame, by: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Share of true flags; rows where a flag is null do not count, no such row gives null."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(F.col(f).cast("double")).alias(f) for f in flags))


def scored_groups(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(group, n, char_bleu1..4, mixed_corpus_bleu, word_bleu1..4, rouge1_f, rouge2_f, rougeL_f) of rows
    that have a human reference (hyp, ref, has_human_reference), of all and of each value of ``by``.

    Character BLEU is the mean over reports; BLEU of mixed tokens and of words is of summed counts; all in percent.
    """
    ok = rows.filter(F.coalesce("has_human_reference", F.lit(False)) & (F.trim(F.coalesce("ref", F.lit(""))) != ""))
    small_batches(rows.sparkSession)
    hyp, ref = F.coalesce("hyp", F.lit("")), F.col("ref")
    groups = F.array(F.lit("all"), *(F.col(c).cast("string") for c in by)).alias("groups")
    told = ok.select(groups, *(f(t).alias(f"{n}_{side}") for n, f in (("w", words), ("c", characters), ("m", mixed_tokens)) for side, t in (("h", hyp), ("r", ref))))
    # A pair is counted once, for all of its groups.
    each = told.select("groups", rouge_l(F.col("w_h"), F.col("w_r")).alias("rougeL_f"), *(_counts()(F.col(f"{n}_h"), F.col(f"{n}_r")).alias(n) for n in "wcm"))
    chars, rouge = [f"char_bleu{n}" for n in range(1, 5)], ["rouge1_f", "rouge2_f", "rougeL_f"]
    each = each.select("groups", "rougeL_f", "w", "m", "c.*").select("groups", "rougeL_f", "w", "m", *(bleu(n).alias(c) for n, c in enumerate(chars, 1)))
    each = rouge_n(each.select("*", "w.*"), each.columns)
    sums = [F.struct(*(F.sum(f"{n}.{c}").alias(c) for c in _SUMMED)).alias(n) for n in "wm"]
    g = each.withColumn("group", F.explode("groups")).filter("group is not null").groupBy("group").agg(F.count("*").alias("n"), *((100 * F.avg(c)).alias(c) for c in (*chars, *rouge)), *sums)
    g = g.select("*", "m.*").select(*g.columns, (100 * halved_bleu()).alias("mixed_corpus_bleu"))
    g = g.select("*", "w.*").select(*g.columns, *((100 * bleu(n)).alias(f"word_bleu{n}") for n in range(1, 5)))
    return g.select("group", "n", *chars, "mixed_corpus_bleu", *(f"word_bleu{n}" for n in range(1, 5)), *rouge)


def audited(rows: DataFrame, facts_ok: str, advice_ok: str, whole_ok: str, split: str) -> DataFrame:
    """``rows`` with ``fact_values_complete``, ``recommendation_safe``, ``raw_recommendation_safe``,
    ``policy_covered`` and ``final_report_safe``. Rows without separate sections (``split`` false) are
    judged as a whole, and what only sections can tell is null there."""
    own = F.coalesce(F.col(split), F.lit(False))
    part = lambda c: F.when(own, F.col(c)) if c in rows.columns else F.lit(None).cast("boolean")
    facts, advice = F.when(own, F.col(facts_ok)).otherwise(F.col(whole_ok)), F.when(own, F.col(advice_ok)).otherwise(F.col(whole_ok))
    return rows.withColumns({"fact_values_complete": facts, "recommendation_safe": advice, "raw_recommendation_safe": part("raw_ok"), "policy_covered": part("policy_ok"), "final_report_safe": facts & advice})
