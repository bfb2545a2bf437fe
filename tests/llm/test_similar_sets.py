"""Similarity join of shingle sets: SQL, brute force, crowded groups, odd rows."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitwright.llm import adaptjoin
from gaitwright.llm.queries import ORACLES, QUERIES


def plain_set(text) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def plain_components(texts: dict, percent: int = 90) -> dict:
    """Least id of each component, every pair compared."""
    sets = {i: plain_set(t) for i, t in texts.items()}
    top = {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(spark, texts: dict, percent: int = 90) -> dict:
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in adaptjoin.similar_sets(df, percent).collect()}


def edited(seed: int, groups: int, size: int, words: int, edits: int) -> dict:
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    out = {}
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randint(0, edits)):
                at = r.randrange(len(own))
                own[at : at + 1] = r.choice(([r.choice(vocabulary)], [], [own[at], r.choice(vocabulary)]))
            out[len(out)] = " ".join(own)
    return out


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    df = QUERIES["op11_adaptive_prefixes"](spark, sf_dir)
    got = sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(con.execute(f"select doc_id, n_shingles, component_id from ({ORACLES['op11_adaptive_prefixes']})").fetchall())


@pytest.mark.parametrize("percent", [60, 80, 90, 95, 100])
def test_components_equal_brute_force(spark, percent):
    texts = edited(percent, 12, 9, 70, 4)
    texts |= {1000 + i: t for i, t in enumerate(["a", "A", "a b", "b a", "a b c", "a  B\tc", "a b c d", "", "...", ". . .", "x\x0by", "é é é", "É É É"])}
    assert found(spark, texts, percent) == plain_components(texts, percent)


def test_short_sets_equal_brute_force(spark):
    r = random.Random(2)
    texts = {i: " ".join(r.choice("ab") for _ in range(r.randint(1, 7))) for i in range(250)}
    assert found(spark, texts) == plain_components(texts)


def test_a_crowd_below_the_limit_falls_apart_rightly(spark):
    """Texts of one template, most of them just too far apart: the stars find few links, the exact way all."""
    texts = edited(4, 1, 260, 150, 6)
    want = plain_components(texts)
    assert 3 < len({c for _, c in want.values()}) < 250
    assert found(spark, texts) == want


def test_frequent_tokens_and_copies(spark):
    """A passage in every text, one text many times, near copies at the limit."""
    r = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {i: passage + " " + " ".join(f"u{r.randrange(9999)}" for _ in range(40)) for i in range(150)}
    texts |= {200 + i: "one and the same text that very many documents hold " * 3 for i in range(300)}
    base = [f"k{i}" for i in range(100)]
    texts |= {600 + k: " ".join(base[: 100 - k]) for k in range(14)}
    assert found(spark, texts) == plain_components(texts)


def test_prefixes_share_as_many_tokens_as_asked():
    """Linked sets share l tokens in their l-prefixes, for every l and any common order."""
    r = np.random.default_rng(5)
    for _ in range(400):
        n = int(r.integers(3, 80))
        a = r.choice(200, n, replace=False)
        b = np.unique(np.r_[r.choice(a, n - int(r.integers(0, n // 8 + 1)), replace=False), r.choice(np.arange(200, 300), int(r.integers(0, n // 8 + 1)), replace=False)])
        if not adaptjoin.linked(np.sort(a).astype(np.uint64), b.astype(np.uint64)):
            continue
        order = r.permutation(300)
        for level in range(1, adaptjoin.need(max(len(a), len(b)), 90) + 1):
            pre = [set(sorted(s, key=lambda x: order[x])[: len(s) - adaptjoin.need(len(s), 90) + level]) for s in (a.tolist(), b.tolist())]
            assert len(pre[0] & pre[1]) >= level


def test_sketches_never_differ_more_than_sets():
    r = np.random.default_rng(8)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 60, int(r.integers(1, 900)), dtype=np.uint64))
        b = np.unique(np.r_[a[: len(a) // 2], r.integers(0, 1 << 60, int(r.integers(1, 400)), dtype=np.uint64)])
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(adaptjoin._sketch(a), adaptjoin._sketch(b)))
        assert bits <= len(np.setxor1d(a, b))


def test_odd_documents(spark, odd_documents, no_documents):
    got = adaptjoin.similar_sets(odd_documents)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == odd_documents.count()
    rows = {(r.doc_id, r.n_shingles): r.component_id for r in got.collect()}
    assert rows[(1, 0)] == 1 and rows[(None, 0)] is None and rows[(4, 1)] == rows[(5, 1)] == 4
    assert rows[(9, 79999)] == 7
    assert adaptjoin.similar_sets(no_documents).count() == 0
    assert adaptjoin.similar_sets(odd_documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("node"))).count() == got.count()
    with pytest.raises(ValueError):
        adaptjoin.similar_sets(no_documents, 40)


def test_wide_sketches_bound_the_difference_of_large_sets():
    r = np.random.default_rng(17)
    draw = lambda n: np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
    for n in (1100, 4400, 9000, 30_000):
        a, b = draw(n), draw(n + n // 20)
        near = np.unique(np.r_[a[n // 30 :], draw(n // 40)])
        allowed = lambda x, y: len(x) + len(y) - 2 * ((90 * (len(x) + len(y)) + 189) // 190)
        assert adaptjoin.wide_differ(*map(adaptjoin.wide_sketch, (a, near))) <= len(np.setxor1d(a, near)) <= allowed(a, near)
        assert adaptjoin.wide_differ(*map(adaptjoin.wide_sketch, (a, b))) > allowed(a, b)  # sets without a common token never travel
    assert adaptjoin.wide_sketch(draw(1000)) is None and adaptjoin.wide_differ(adaptjoin.wide_sketch(draw(1100)), adaptjoin.wide_sketch(draw(9000))) <= 10_100


def test_unlike_large_sets_that_share_a_token_are_not_read(spark, monkeypatch):
    r = np.random.default_rng(18)
    texts = [" ".join(["one rare start", *(f"w{i}" for i in r.integers(0, 1 << 40, 9000))]) for _ in range(4)]
    texts.append(texts[3].rsplit(" ", 5)[0] + " another end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    monkeypatch.setattr(adaptjoin, "materialize", lambda df, tag, codec="zstd", own=adaptjoin.materialize: seen.append((tag, out := own(df, tag, codec), out.count())) or out)
    got = {x.doc_id: x.component_id for x in adaptjoin.similar_sets(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}
    assert max(n for tag, _, n in seen if tag == "asked") == 2
