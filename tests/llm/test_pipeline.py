"""Stages one by one against brute force, or SQL, on what came before."""

import re

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaitwright.llm import mixing, quality, rans
from test_media_tokens import brute_tokens
from test_near_duplicates import brute_classes

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def leaks(text: str | None, items: list[str]) -> bool:
    """Whether ten words in a row of an item, or a whole shorter one, stand in the text; by comparing all places."""
    lower = lambda t: [w for w in WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))]
    words = lower(text)
    for item in items:
        own = lower(item)
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        if any(tuple(words[i : i + n]) in windows for i in range(len(words) - n + 1)):
            return True
    return False


@pytest.fixture(scope="module")
def stages(spark, documents, sf_dir):
    """The documents that each stage gets, and what it gave."""
    docs, found = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == documents.columns
        rows = [tuple(r) for r in got.collect()]
        found[name] = (docs, rows)
        docs = spark.createDataFrame(rows, documents.schema)
    found["tokens"] = (docs, [tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).drop("files").collect()])
    return found


def test_quality_keeps_what_the_tables_score_well(spark, stages, labels):
    docs, rows = stages["quality"]
    model = quality.train(docs, labels)

    def score(text):  # one table entry after the other
        x = quality.text_features((text or "").encode())
        at = lambda cut, v: sum(c < v for c in cut)
        z = model.base + sum(t[at(c, v)] for c, t, v in zip(model.cuts, model.tables, x))
        return z + sum(t[at(cf, x[f]), at(cg, x[g])] for f, g, cf, cg, t in model.pairs)

    assert {r[0] for r in rows} == {r.doc_id for r in docs.collect() if score(r.text) >= 0}


def test_one_document_of_each_class_stays(stages):
    docs, rows = stages["near_duplicates"]
    classes = brute_classes({r.doc_id: r.text for r in docs.collect()})
    assert {r[0] for r in rows} == set(classes.values())


def test_no_leak_stays_and_nothing_else_goes(stages, benchmark_items):
    docs, rows = stages["benchmark_leaks"]
    items = [r.text for r in benchmark_items.collect()]
    assert {r[0] for r in rows} == {r.doc_id for r in docs.collect() if not leaks(r.text, items)}


def test_the_mix_takes_what_sql_says(stages):
    docs, rows = stages["source_mix"]
    con = duckdb.connect()
    con.register("d", docs.select("doc_id", "text", "source").toPandas().convert_dtypes())
    con.execute("create view documents as select * from d")
    want = dict(con.execute(f"select doc_id, taken / size from ({mixing.MIX_SQL}) where size > 0").fetchall())
    times = {i: sum(r[0] == i for r in rows) for i in want}
    assert times == {i: int(n) for i, n in want.items()}


def test_tokens_are_those_of_the_library(stages):
    docs, rows = stages["tokens"]
    assert sorted(rows, key=lambda r: r[1]) == brute_tokens([tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()])


def test_run_is_all_stages(spark, stages, sf_dir):
    ran = corpus_pipeline.run(spark, sf_dir)
    folder = ran.first().files
    assert sorted(tuple(r) for r in ran.drop("files").collect()) == sorted(stages["tokens"][1])
    assert rans.read_table(spark, folder).sum() == 1 << rans.BITS and public_tokenizers.path("word_bpe_49k.json")


def test_empty_and_odd_documents(spark, odd_documents, no_documents, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd_documents, sf_dir)
        assert got.columns == odd_documents.columns and stage(spark, no_documents, sf_dir).count() == 0
        ids = sorted(str(r.doc_id) for r in got.collect())
        every = sorted(str(r.doc_id) for r in odd_documents.collect())
        if name == "benchmark_leaks":
            assert ids == every
        elif name == "near_duplicates":
            assert ids.count("4") == 1 and "5" not in ids and "9" not in ids and {"1", "2", "7", "8"} <= set(ids)
        else:
            assert set(ids) <= set(every)
    tokens = corpus_pipeline.STAGES[-1][1]
    assert tokens(spark, odd_documents, sf_dir).count() == odd_documents.count() and tokens(spark, no_documents, sf_dir).count() == 0
