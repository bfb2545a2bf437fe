"""Repeated passages and benchmark leaks against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gaitwright.llm import decontam, suffixindex


def brute_strip(texts: list[tuple[int, str | None]], width: int) -> list[tuple]:
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for (key, _), d in zip(texts, data):
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((key, len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.fixture
def passages():
    r = random.Random(9)
    letters = "abcdefghij klmnop"

    def text(n):
        return "".join(r.choice(letters) for _ in range(n))

    shared = [text(700) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [text(r.randint(0, 300))]
        for s in r.sample(shared, r.randint(0, 2)):
            a = r.randint(0, 250)
            parts += [s[a : a + r.randint(380, 450)], text(r.randint(0, 200))]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[5][1]) for i in range(4)] + [(300, "z" * 1500), (301, "ab" * 900), (302, None), (303, ""), (304, "x" * 399), (305, "é" * 500)]
    return rows


def test_strip_equals_brute_force(spark, passages):
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    got = [tuple(r) for r in suffixindex.strip_repeats(docs).collect()]
    assert order(got) == order(brute_strip(passages, 400))


def test_crowded_anchors_equal_brute_force(spark, passages, monkeypatch):
    monkeypatch.setattr(suffixindex, "CROWD", 5)
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    got = [tuple(r) for r in suffixindex.strip_repeats(docs).collect()]
    assert order(got) == order(brute_strip(passages, 400))


def test_real_documents_equal_brute_force(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = [tuple(r) for r in suffixindex.strip_repeats(documents).collect()]
    assert order(got) == order(brute_strip(rows, 400))


def test_strip_odd_rows(spark, odd_documents, no_documents):
    rows = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    short = [(k, t if t is None or len(t) < 50_000 else t[:9000]) for k, t in rows]
    got = [tuple(r) for r in suffixindex.strip_repeats(spark.createDataFrame(short, "doc_id long, text string")).collect()]
    assert order(got) == order(brute_strip(short, 400))
    assert suffixindex.strip_repeats(odd_documents).count() == len(rows)
    assert suffixindex.strip_repeats(no_documents).count() == 0


def test_levels_merge_geometrically():
    family = suffixindex.Family(400)
    for i in range(9):
        for _ in family.add([(bytes([65 + i]) * 400, b"", 0, 0, i)]):
            pass
    assert sorted(map(len, family.levels)) == [1, 8]


AUDIT = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest"


def oracle(docs, items):
    con = duckdb.connect()
    con.register("d", docs.select("doc_id", "text").toPandas().convert_dtypes())
    con.register("b", items.select("item_id", "text").toPandas().convert_dtypes())
    con.execute("create view documents as select * from d; create view benchmark as select * from b")
    return con.execute(f"select {AUDIT} from ({decontam.AUDIT_SQL})").fetchall()


def test_audit_equals_sql(spark, documents, benchmark_items):
    got = decontam.audit_documents(documents, benchmark_items).selectExpr(*AUDIT.split(", ")).collect()
    assert order(map(tuple, got)) == order(oracle(documents, benchmark_items))
    assert any(r.contaminated for r in got)


def test_audit_odd_rows(spark, odd_documents, no_documents, benchmark_items):
    odd = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, "a text without a key and some more words in it"), (4, "café — 日本語"), (None, "some more")], "item_id long, text string")
    short = odd_documents.withColumn("text", F.when(F.length("text") < 20_000, F.col("text")).otherwise(F.substring("text", 1, 9000)))
    short = short.withColumn("text", F.when(F.col("doc_id") == 1, None).otherwise(F.col("text")))
    got = decontam.audit_documents(short, odd).selectExpr(*AUDIT.split(", ")).collect()
    assert order(map(tuple, got)) == order(oracle(short, odd))
    assert decontam.audit_documents(odd_documents, odd).count() == odd_documents.count()
    assert decontam.audit_documents(odd_documents, odd.limit(0)).filter("contaminated").count() == 0
    assert decontam.audit_documents(no_documents, odd).count() == 0
    kept = decontam.remove_contaminated(odd_documents, odd)
    assert kept.columns == odd_documents.columns and 5 not in [r.doc_id for r in kept.collect()]


def test_blocks_of_tests_agree(spark, documents, benchmark_items, monkeypatch):
    whole = order(map(tuple, decontam.audit_documents(documents, benchmark_items).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 4000)
    assert order(map(tuple, decontam.audit_documents(documents, benchmark_items).collect())) == whole


def test_longest_match_goes_past_the_window(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"t{i}" for i in range(25)) + " y")], "doc_id long, text string")
    items = spark.createDataFrame([("q", " ".join(f"t{i}" for i in range(30)))], "item_id string, text string")
    r = decontam.audit_documents(docs, items).first()
    assert (r.n_hit, r.longest) == (25, 25)


def test_longest_match_tries_every_continuation(spark):
    w = " ".join(f"w{i}" for i in range(10))
    x, y = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("x", 20), ("y", 5)))
    docs = spark.createDataFrame([(1, f"a {w} {y} b {w} {x}"), (2, f"{w} {y}"), (3, w[:-3])], "doc_id long, text string")
    items = spark.createDataFrame([("p", f"{w} {x}"), ("q", f"{w} {y}")], "item_id string, text string")
    assert {r.doc_id: r.longest for r in decontam.audit_documents(docs, items).collect()} == {1: 30, 2: 15, 3: 0}
    assert sorted(map(tuple, decontam.locate_tests(docs, items).collect())) == [(1, 1, 15), (1, 17, 30), (2, 0, 15)]
    assert order(map(tuple, decontam.audit_documents(docs, items).selectExpr(*AUDIT.split(", ")).collect())) == order(oracle(docs, items))
