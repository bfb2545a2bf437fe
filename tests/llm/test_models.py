"""Quality and toxicity models: held-out accuracy, rules of the contract, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitwright.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = module.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert auc(got["score"].to_numpy(), got[label].to_numpy()) >= least
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"])


@pytest.mark.parametrize("module", [quality, toxicity])
def test_held_out_labels_are_not_used(spark, module, documents, labels):
    flipped = labels.withColumns({c: F.when(quality.held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    a, b = (module.score_documents(documents, x).select("doc_id", "score").toPandas().sort_values("doc_id") for x in (labels, flipped))
    assert np.allclose(a["score"], b["score"])


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module, odd_documents, no_documents, labels):
    own = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    rows = module.score_documents(odd_documents, own).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert module.score_documents(odd_documents, own.limit(0)).count() == len(rows)
    assert module.score_documents(no_documents, labels).count() == 0


def test_additive_score_is_a_sum_of_tables():
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert auc(model.score(x), y) > 0.9 and any({i, j} == {0, 1} for i, j, *_ in model.pairs)


def test_keep_good_filters_by_score(spark, documents, labels):
    kept = quality.keep_good(documents, labels)
    want = {r.doc_id for r in quality.score_documents(documents, labels).collect() if r.predicted}
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == want


def test_chain_feeds_earlier_probabilities():
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 4))
    first = (x[:, 0] > 0).astype(float)
    chain = toxicity.fit_chain(x.astype(np.float32), np.c_[first, first], np.arange(400) % 5, ["a", "b"], {})
    assert len(chain.models[1].weight) == len(chain.models[0].weight) + 1 and chain.models[1].weight[-1] > 0
