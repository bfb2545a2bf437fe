"""Order MinHash: classes against brute force, edge cases."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import zstandard
from pyspark.sql import functions as F

from gaitwright.llm import omh


def distance(a: list, b: list) -> int:
    """Plain edit distance, row by row of the whole table."""
    places: dict = {}
    x, y = (np.array([places.setdefault(w, len(places)) for w in t], int) for t in (a, b))
    along = np.arange(len(y) + 1)
    row = along.copy()
    for i, w in enumerate(x, 1):
        new = np.r_[i, np.minimum(row[1:] + 1, row[:-1] + (y != w))]
        row = np.minimum.accumulate(new - along) + along
    return int(row[-1])


def near(a: list, b: list, least: float = 0.8) -> bool:
    longer = max(len(a), len(b))
    return abs(len(a) - len(b)) <= (1 - least) * longer + 1e-9 and distance(a, b) <= (1 - least) * longer + 1e-9


def brute_classes(texts: dict[int, str], least: float = 0.8) -> dict[int, int]:
    """Least id of each component of all pairs, compared one by one."""
    words = {i: omh.words_of(t).split() for i, t in texts.items()}
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    sets = {i: set(words[i]) for i in ids}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = words[i], words[j]
            if not (a and b):
                same = not a and not b and texts[i] == texts[j]
            else:  # alike texts have most words in common, whatever their order
                same = a == b or len(sets[i] & sets[j]) >= 0.3 * max(len(sets[i]), len(sets[j])) and near(a, b, least)
            if same:
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i: top(i) for i in ids}


def variants(seed: int, groups: int, size: int) -> dict[int, str]:
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out, n = {}, 0
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 200))]
        for k in range(size):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out[n], n = " ".join(words), n + 1
    return out


def classes(spark, texts: dict[int, str]) -> dict[int, int]:
    return {r.doc_id: r.class_id for r in omh.classify(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}


def test_classes_equal_brute_force(spark):
    texts = variants(3, 25, 8)
    assert classes(spark, texts) == brute_classes(texts)


def test_short_texts_equal_brute_force(spark):
    r = random.Random(11)
    texts, n = {}, 0
    for size in range(1, 60):
        for _ in range(2):
            base = [f"w{r.randrange(500)}" for _ in range(size)]
            for _ in range(4):
                words = list(base)
                for _ in range(r.randint(0, size // (6 if size < 40 else 12))):
                    at = r.randrange(len(words))
                    words[at : at + 1] = r.choice([[], ["x", words[at]], [f"w{r.randrange(500)}"]])
                texts[n], n = " ".join(words), n + 1
    assert classes(spark, texts) == brute_classes(texts)


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(omh, "CLOSE", 3)
    texts = variants(4, 4, 40) | {1000 + i: t for i, t in variants(3, 10, 8).items()}
    assert classes(spark, texts) == brute_classes(texts)


def crowd(seed: int, pairs: int) -> dict[int, str]:
    """Pairs of texts that share most of their words with all others, as pages of one template."""
    r = random.Random(seed)
    words = lambda n: [f"w{r.randrange(9999)}" for _ in range(n)]
    passage, out = words(84), []
    for _ in range(pairs):
        own = words(22)
        out += [" ".join(passage + own + words(14)) for _ in range(2)]
    r.shuffle(out)
    return dict(enumerate(out))


def test_crowded_buckets_lose_no_pair(spark):
    texts = crowd(5, 60)
    want = brute_classes(texts)
    assert len(set(want.values())) == 60
    assert classes(spark, texts) == want


def test_edited_copies_are_found(spark):
    """Share of pairs found by the edits of a hundred words: no pair helps another here."""
    r = random.Random(12)
    texts, n = {}, 0
    for edits in (1, 3, 6, 10):
        for _ in range(50):
            words = [f"w{r.randrange(5000)}" for _ in range(100)]
            other = list(words)
            for at in r.sample(range(100), edits):
                other[at] = f"v{r.randrange(5000)}"
            texts[n], texts[n + 1], n = " ".join(words), " ".join(other), n + 2
    got = classes(spark, texts)
    found = [got[i] == got[i + 1] for i in range(0, n, 2)]
    assert all(found[:100]) and sum(found[100:150]) >= 48 and sum(found[150:]) >= 45


def test_each_class_keeps_one_row_whatever_its_ids(spark):
    r = random.Random(8)
    one, two, three, four = (" ".join(f"w{r.randrange(9999)}" for _ in range(60)) for _ in range(4))
    rows = [(None, one, 1), (None, two, 2), (None, two, 2), (3, three, 3), (5, three, 4), (5, four, 5), (None, four, 6), (None, None, 7), (None, None, 8)]
    kept = omh.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    assert sorted(r.n for r in kept) == [1, 2, 3, 5, 7, 8]
    rows = [(3, one, 0), *((5, t, n) for n, t in enumerate((one, two, three, four)))]
    kept = omh.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    assert sorted((r.doc_id, r.n) for r in kept) == [(3, 0), (5, 1), (5, 2), (5, 3)]


def test_real_documents_equal_brute_force(spark, documents):
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect() if r.text is not None}
    got = {r.doc_id: r.class_id for r in omh.classify(documents).collect()}
    assert got == brute_classes(texts)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = omh.classify(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [r.class_size for r in by[1]] == [1] and {r.class_id for r in by[4]} == {4} == {r.class_id for r in by[5]}
    assert by[7][0].class_id == by[9][0].class_id == 7
    assert omh.classify(no_documents).count() == 0
    kept = omh.drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and 9 not in ids and 1 in ids
    assert omh.drop_near_duplicates(no_documents).count() == 0


def test_banded_distance_equals_the_whole_table():
    r = random.Random(13)
    for _ in range(1500):
        v = r.choice([2, 3, 8])
        a, b = ([r.randrange(v) for _ in range(r.randint(0, 14))] for _ in range(2))
        band = r.randint(0, 12)
        assert omh.banded_distance(a, b, band) == min(distance(a, b), band + 1)


def test_alignment_counts_order():
    words = [b"%d" % i for i in range(100)]
    assert omh.alike(words, words) and not omh.alike(words, words[50:] + words[:50])
    assert omh.alike(words, [*words[:80], *[b"x"] * 20]) and not omh.alike(words, [*words[:79], *[b"x"] * 21])


def test_texts_of_several_common_words_meet_once(spark):
    """Texts of one passage share several rare words; each alike pair meets, and meets at one of them."""
    r = random.Random(21)
    passage, pool = [f"w{i}" for i in range(80)], [f"x{i}" for i in range(60)]
    texts = {b"%02d" % i: " ".join(passage + r.sample(pool, 20)).encode() for i in range(80)}
    packed = spark.createDataFrame([(n, zstandard.compress(t)) for n, t in texts.items()], "node binary, packed binary")
    groups = omh._rare(packed, packed.select("node"), 0.8)
    inside = omh._open_words(groups, packed.select("node", F.col("node").alias("label")))
    drawn = inside.withColumn("draw", F.pmod(F.xxhash64("node", "key"), F.col("n")))
    met = []
    for done, reach in ((0, 8), (8, 1 << 20)):
        met += [frozenset((bytes(q.node), bytes(q.to.node))) for q in omh._meetings(drawn.filter(F.col("draw") >= done), reach, 0.8).collect()]
    alike = {frozenset((a, b)) for a, b in combinations(texts, 2) if omh.alike(texts[a].split(), texts[b].split())}
    assert len(met) == len(set(met)) and alike <= set(met) and len(alike) > 1000
