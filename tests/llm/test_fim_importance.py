"""Fill-in-the-middle and importance resampling: SQL, brute force, odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitwright.llm import fim, importance
from gaitwright.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_importance_resampling"])
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert rows(df, *df.columns) == sorted(duck.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall(), key=repr)


# ---- fill in the middle ----------------------------------------------------------------------


def plain_cut(doc_id, text):
    """The transformation of one text, line by line."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def lines(n_docs: int) -> list[tuple]:
    r = random.Random(5)
    pieces = ["\n", "\n\n", "a line", "日本語 text", "<P", "S>", "<", "é́", "\r\n", " ", "\x00", " "]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(n_docs // 3)]
    return [(i, r.choice(texts) if i % 3 else "".join(r.choice(pieces) for _ in range(r.randint(0, 200)))) for i in range(n_docs)] + [(n_docs, "with a <M> mark\nand a line"), (None, "no id\nbut lines\n"), (None, None), (3, None), (4, "")]


def test_cuts_equal_plain_cuts_and_come_back(spark):
    given = lines(400)
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    got = rows(fim.restore(fim.transform(df)), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    assert got == sorted(((i, *plain_cut(i, t), t or "") for i, t in given), key=repr)


def test_texts_that_share_a_key_keep_their_own_boundaries(spark):
    """With a key of three values nearly all texts collide; content decides."""
    given = lines(120)
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    got = fim.transform(df, content=lambda t: F.unhex(F.hex(F.pmod(F.length(t), F.lit(3)).cast("int"))))
    assert rows(got, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == sorted(((i, *plain_cut(i, t)) for i, t in given), key=repr)


def test_index_has_one_list_a_text(spark):
    df = spark.createDataFrame([(i, f"text {i % 7}\nline\n") for i in range(500)], "doc_id long, text string").repartition(6)
    index = fim.boundary_index(df)
    assert index.count() == index.select("__gw_key").distinct().count() == 7
    assert {r["__gw_n"] for r in index.collect()} == {2}


def test_lists_give_every_value_back():
    r = np.random.default_rng(3)
    for n, most in ((1, 1), (1, 10**9), (5, 5), (1000, 1000), (1000, 10**7), (300, 301)):
        values = np.sort(r.choice(most, n, replace=False) + 1) if most < 10**8 else np.array([most])
        width, low, high = fim.ef_encode(values)
        assert [fim.ef_select(width, low, high, k) for k in range(n)] == values.tolist()
        assert len(low) + len(high) <= n * (2 + max(0, math.log2(most / n))) / 8 + 3
    assert fim.ef_encode(np.zeros(0, np.int64)) == (0, b"", b"")


def test_shares_of_forms_and_other_units(spark):
    df = spark.createDataFrame([(i, f"some words of text {i}") for i in range(600)], "doc_id long, text string")
    forms = Counter(r.form for r in fim.transform(df, percent=60, spm=25, unit=r"\w+\s*").collect())
    assert abs(forms["plain"] - 240) < 50 and abs(forms["spm"] - 90) < 35
    assert fim.boundaries("ab, cd!", r"\w+").tolist() == [2, 6, 7]


def test_odd_documents_of_cuts(spark, odd_documents, no_documents):
    out = fim.restore(fim.transform(odd_documents))
    assert out.count() == odd_documents.count() and set(out.columns) >= {"lang", "source", "size", "shard", "score"}
    assert rows(out, "doc_id", "restored") == sorted(((r.doc_id, r.text or "") for r in odd_documents.collect()), key=repr)
    assert fim.transform(no_documents).count() == 0
    clash = odd_documents.withColumns({"form": F.lit(1), "Output": F.lit(2), "restored": F.lit(3)})
    assert rows(fim.restore(fim.transform(clash)), "doc_id", "output") == rows(out, "doc_id", "output")


# ---- importance resampling ---------------------------------------------------------------------


def plain_buckets(text, buckets=10_000):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [crc32(" ".join(words[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_draw(docs, target):
    s = Counter(b for _, t in docs for b in plain_buckets(t)[1])
    t = Counter(b for x in target for b in plain_buckets(x)[1])
    whole_s, whole_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for i, text in docs:
        n, own = plain_buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * whole_s / ((s[b] + 1) * whole_t))) for b in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    placed = [(*x[:4], k + 1 if k < len(order) * 5 // 100 else None) for k, x in enumerate(order)]
    return sorted(placed + [(*x[:4], None) for x in out if x[4] < 20], key=repr)


def corpus(n: int, seed: int = 9) -> list[tuple]:
    r = random.Random(seed)
    words = ["Alpha", "beta", "été", "日本", "x1", "l'eau", "a" * 70, "b" * 300, "the", "of", "-", "."]
    return [(i, " ".join(r.choice(words) for _ in range(r.choice((0, 1, 2, 3, 19, 20, 25, 400))))) for i in range(n)]


@pytest.mark.parametrize("size,long", [(4096, 1 << 15), (7, 50), (1, 0), (3, 500)])
def test_draw_equals_brute_force_with_any_chunks(spark, size, long):
    docs = [*corpus(300), (None, "no id but many words " * 10), (5, None), (6, "")]
    target = [t for _, t in corpus(20, 1)]
    df, goal = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, goal, size=size, long=long)
    assert rows(got, "doc_id", "n_features", "weight", "score", "rank") == plain_draw(docs, target)


def test_chunks_own_every_start_once(spark):
    docs = corpus(60)
    for size in (1, 2, 5, 64):
        found = importance.chunks(spark.createDataFrame(docs, "doc_id long, text string"), size).collect()
        for i, text in docs:
            own = Counter(b for r in found if r.doc_id == i for b in importance.run_buckets(r.words.split(), r.own).tolist() if r.words)
            assert own == Counter(plain_buckets(text)[1])


def test_repeated_rows_and_ties_spread_and_rank(spark):
    """Equal rows each get a place; long texts that repeat come back as often as they came."""
    long_text = " ".join(f"w{i}" for i in range(900))
    docs = [(1, "word " * 25)] * 300 + [(2, long_text)] * 40 + [(3, long_text)] * 2 + [(None, "word " * 25)] * 60
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    goal = spark.createDataFrame([("word word word",)], "text string")
    got = importance.resample(df, goal, percent=50, size=100, long=1000).collect()
    assert Counter(r.doc_id for r in got) == {1: 300, 2: 40, 3: 2, None: 60}
    places = sorted(r.rank for r in got if r.rank)
    assert places == list(range(1, 202))
    best = sorted(got, key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0))
    assert [r.score for r in best[:201]] == [r.score for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)]


def test_odd_tables_of_importance(spark, odd_documents, no_documents, benchmark_items):
    got = importance.resample(odd_documents, benchmark_items)
    assert got.count() == odd_documents.count() and got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert importance.resample(no_documents, benchmark_items).count() == 0
    empty_goal = importance.resample(odd_documents, benchmark_items.limit(0))
    assert empty_goal.filter("weight is null").isEmpty() and empty_goal.count() == odd_documents.count()
    keyed = odd_documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("rank"))
    assert keyed.count() == importance.resample(keyed, benchmark_items.withColumn("doc_id", F.lit("x"))).count()
