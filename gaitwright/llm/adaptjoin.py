"""Similarity join of shingle sets by adaptive multi-match prefixes.

A document's set holds its distinct runs of three words. Sets of n tokens link if their Jaccard
similarity is ``percent`` in 100 or more; they then share ``need(n)`` tokens, the share of the larger
set. All sets order tokens alike, rare ones first. The ``l``-prefix of a set is its first
``n - need(n) + l`` tokens, and linked sets share ``l`` tokens inside the ``l``-prefixes of both, for
any ``l``. A longer prefix brings more tokens to look up but asks for more of them together, so each
set takes the ``l`` of the least estimated cost: the tokens' measured lists, plus the verification of the
candidates that those lists can make at ``l`` matches each. The set of more tokens (ties: the greater name)
probes the lists with its own ``l``; lists know from which ``l`` on a token of theirs counts.

The order comes from ``COUNTERS`` counters that tokens share. It may be less sharp than true
frequencies, which costs time and changes no result: any common order is right. A token stands out that occurs in more than
a few of ten thousand documents, at any size of the corpus.

Equal sets are one node, whatever their number. No group yields all its pairs:

- Lists of up to ``SHORT`` sets, by far the most, are one row each and yield their pairs there: nothing is gained by
  asking such pairs for more.
- A longer list is a star first: its members meet ``LEADERS`` of them, drawn by hash. Verified pairs become
  components, so that groups of near copies collapse.
- Then every long list that still holds several components is joined with itself by the rule above, across
  components only. A pair that shares a token of a short list has met there; one that does not has all its
  shared tokens in long lists, so their number is right. So no link between components is lost.

Pairs that cannot link go before they are made: by sizes, by places of the token, and by a parity sketch of ``64 *
LANES`` bits. A token flips one bit of its set's sketch, so sketches differ in at most as many bits
as the sets do in tokens. Large sets fill such a sketch, so those of more than ``WIDE`` tokens have another one of
half as many bits as tokens or more, which is asked once a pair. What is left is verified on the sets themselves; their
words travel for that, packed, which is a fraction of their tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, discard, materialize, small_batches, tidy
from .omh import components, merge_labels

PERCENT = 90
SHINGLE = 3
SHORT = 4  #: sets of a list that meet at once
LEVELS = 8  #: longest prefixes have so many tokens less one beyond the plain ones
LEADERS = 3
LANES = 16  #: longs of a sketch
WIDE = 1024  #: tokens from which a set has a wide sketch too
PLACE_BITS = 24  #: of a token's place, a tenth of a set's tokens
COUNTERS, COUNTER_BLOCK = 1 << 20, 1 << 14
VERIFY = 200  #: cost of a candidate in entries of a list, and one more for each eight tokens
ASKED_BITS = 24  #: of a filter of 2 MB for documents to read again; full, it lets all pass
MET = 100_000  #: nodes that a task remembers
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTORS = [np.uint64(xxhash.xxh64_intdigest(b"run %d" % i) | 1) for i in range(SHINGLE)]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def token_set(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Sorted numbers of the distinct runs of ``width`` words, or of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(w) - width + 1
    h = sum((w[i : i + n] * _FACTORS[i] for i in range(1, width)), w[:n] * _FACTORS[0])
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def node_of(tokens: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def need(n, percent: int):
    """Tokens that two linked sets share at least, the larger one of ``n``."""
    return (n * percent + 99) // 100


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


# ---- one pass over texts ---------------------------------------------------------------------


def _name_sets(batches: Batches) -> Batches:
    """(doc_id, node, n) of each text; then the task's counters in blocks, a set counted once."""
    total, met = np.zeros(COUNTERS, np.int64), set()
    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        nodes, sizes, fresh = [], [], []
        for text in batch.column("text").to_pylist():
            tokens = token_set(words_of(text))
            node = node_of(tokens)
            nodes.append(node), sizes.append(len(tokens))
            if node is not None and node not in met:
                if len(met) >= MET:
                    met.clear()
                met.add(node)
                fresh.append(tokens)
        if fresh:
            total += np.bincount((np.concatenate(fresh) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        yield _named(batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), None)
    blocks = [(i, b) for i, b in enumerate(total.reshape(-1, COUNTER_BLOCK)) if b.any()] if kind is not None else []
    if blocks:
        yield _named(pa.nulls(len(blocks), kind), None, None, blocks)


def _named(ids, nodes, sizes, blocks) -> pa.RecordBatch:
    n = len(ids)
    block = pa.array([i for i, _ in blocks], pa.int32()) if blocks else pa.nulls(n, pa.int32())
    counts = pa.array([b.astype(np.int64).tobytes() for _, b in blocks], pa.binary()) if blocks else pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays([ids, pa.nulls(n, pa.binary()) if nodes is None else nodes, pa.nulls(n, pa.int64()) if sizes is None else sizes, block, counts], ["doc_id", "node", "n", "block", "counts"])


def _sum_blocks(batches: Batches) -> Batches:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            own = np.frombuffer(counts, np.int64)
            total[block] = total[block] + own if block in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def _counters(blocks: DataFrame) -> np.ndarray:
    """The counters of all tasks, 8 MB whatever the input."""
    out = np.zeros(COUNTERS, np.int64)
    summed = blocks.select("block", "counts").repartition("block").mapInArrow(tidy(_sum_blocks), "block int, counts binary").toArrow()
    for block, counts in zip(summed.column("block").to_pylist(), summed.column("counts").to_pylist()):
        out[block * COUNTER_BLOCK : (block + 1) * COUNTER_BLOCK] = np.frombuffer(counts, np.int64)
    return out


def _sketch(tokens: np.ndarray) -> list[int]:
    """Parities of the tokens of each of the sketch's bits, as signed longs."""
    bits = np.bincount((tokens >> np.uint64(17)).astype(np.int64) % (64 * LANES), minlength=64 * LANES) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def wide_sketch(tokens: np.ndarray) -> bytes | None:
    """As :func:`_sketch`, of a power of two of bits that is at least half the number of tokens; None for ``WIDE`` tokens or fewer."""
    if len(tokens) <= WIDE:
        return None
    bits = 1 << (len(tokens) - 1).bit_length() - 1
    return np.packbits(np.bincount((tokens >> np.uint64(17)).astype(np.int64) % bits, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def wide_differ(a: bytes, b: bytes) -> int:
    """Tokens that one of two sets has and the other has not, at least: the wider sketch is folded to the other's width."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


_SKETCH = [f"s{i}" for i in range(LANES)]


def _prefix(counters: Broadcast, percent: int):
    """(node, n, sketch, wide, tokens): the longest prefix of each set, once a task."""

    def run(batches: Batches) -> Batches:
        often, met = counters.value, set()
        for batch in batches:
            nodes, sizes, sketches, wides, prefixes = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = token_set(words_of(text))
                node = node_of(tokens)
                if node is None or node in met:
                    continue
                if len(met) >= MET:
                    met.clear()
                met.add(node)
                n = len(tokens)
                order = np.lexsort((tokens, often[(tokens % np.uint64(COUNTERS)).astype(np.int64)]))
                nodes.append(node), sizes.append(n), sketches.append(_sketch(tokens)), wides.append(wide_sketch(tokens))
                prefixes.append(tokens[order[: n - need(n, percent) + LEVELS]].view(np.int64))
            lanes = [pa.array(x, pa.int64()) for x in (zip(*sketches) if sketches else [()] * LANES)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), *lanes, pa.array(wides, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["node", "n", *_SKETCH, "wide", "tokens"])

    return run


def _sets_of(asked: Broadcast):
    """(node, words) of documents that the filter lets pass, words packed."""

    def run(batches: Batches) -> Batches:
        bits, met, pack = np.unpackbits(np.frombuffer(asked.value, np.uint8), bitorder="little"), set(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            nodes, sets = [], []
            texts = batch.filter(pa.array(bits[batch.column("at").to_numpy()].astype(bool))).column("text")
            for text in texts:
                words = words_of(text.as_py())
                node = node_of(token_set(words))
                if node is not None and node not in met:
                    if len(met) >= MET:
                        met.clear()
                    met.add(node)
                    nodes.append(node), sets.append(pack.compress(b" ".join(words)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "words"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        tokens = lambda words: token_set(unpack.decompress(words.as_py()).split(b" "))
        for batch in batches:
            hits = [linked(tokens(a), tokens(b), percent) for a, b in zip(batch.column("own"), batch.column("other"))]
            yield batch.select(["a", "b"]).filter(pa.array(hits, pa.bool_()))

    return run


def _ask_wide(percent: int):
    """The pairs that sizes and wide sketches let link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for n, m, own, other in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "own", "other"))):
                least = (percent * (n + m) + 99 + percent) // (100 + percent)
                hits.append(own is None or other is None or wide_differ(own, other) <= n + m - 2 * least)
            yield batch.select(["a", "b"]).filter(pa.array(hits, pa.bool_()))

    return run


# ---- joins -------------------------------------------------------------------------------------


def _place(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - ASKED_BITS).cast("int")


def _links(docs: DataFrame, found: DataFrame, prefixes: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs ``met`` (a, b; a table) whose sets link. Reads the texts of one document of each asked node."""
    spark = docs.sparkSession
    nodes = prefixes.select("id", "node")
    one, two = (prefixes.select(F.col("id").alias(c), F.col("n").alias(n), F.col("wide").alias(w)) for c, n, w in (("a", "n", "own"), ("b", "m", "other")))
    told = met.join(one, "a").join(two, "b").select("a", "b", "n", "m", "own", "other")
    pairs = materialize(told.mapInArrow(tidy(_ask_wide(percent)), "a long, b long"), "told")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    asked = materialize(nodes.join(ids, "id"), "asked")
    held = found.join(asked, "node").groupBy("node").agg(F.min(_place(F.col("doc_id"))).alias("at")).select(F.expr("at div 32768").cast("int").alias("part"), (F.col("at") % 32768).cast("long").alias("bit"))
    bits = bytearray(1 << ASKED_BITS - 3)
    for r in held.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # 512 rows of 4 KB at most
        bits[r.part * 4096 : (r.part + 1) * 4096] = r.bits
    sets = docs.select("text", _place(F.col("doc_id")).alias("at")).mapInArrow(tidy(_sets_of(spark.sparkContext.broadcast(bytes(bits)))), "node binary, words binary")
    # Grouped as it is joined, so that the words are dealt out once.
    sets = materialize(sets.join(asked, "node").groupBy("node").agg(F.first("id").alias("id"), F.first("words").alias("words")).select("id", "words"), "sets", "none")
    one = sets.select(F.col("id").alias("a"), F.col("words").alias("own"))
    two = sets.select(F.col("id").alias("b"), F.col("words").alias("other"))
    out = materialize(pairs.join(one, "a").join(two, "b").select("a", "b", "own", "other").mapInArrow(tidy(_verify(percent)), "a long, b long"), "links")
    discard(asked, sets, pairs, met)
    return out


def _n(x: Column) -> Column:
    return F.shiftright(x["np"], PLACE_BITS)


def _pos(x: Column) -> Column:
    return x["np"].bitwiseAND((1 << PLACE_BITS) - 1)


def _least(n: Column, m: Column, percent: int) -> Column:
    """Tokens that two linked sets of these sizes share at least."""
    return F.floor((percent * (n + m) + 99 + percent) / (100 + percent))


def _may_meet(a: Column, b: Column, percent: int) -> Column:
    """Whether sizes and the token's places let two sets link: before it lie at most as many shared tokens as
    places in either, after it as many as are left of either."""
    n, m = _n(a), _n(b)
    most = F.least(n - _pos(a), m - _pos(b)) + F.least(_pos(a), _pos(b))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (most >= _least(n, m, percent))


def _sketches_agree(a: str, b: str, n: Column, m: Column, percent: int) -> Column:
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH), F.lit(0))
    return differ <= n + m - 2 * _least(n, m, percent)


def _entries(prefixes: DataFrame) -> DataFrame:
    """(token, id, np, size): the tokens that several sets have in their longest prefixes, with the number of those
    sets; ``np`` is the size of the set and the token's place in its order. A written table."""
    shared = prefixes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    each = prefixes.select("id", "n", F.posexplode("tokens").alias("pos", "token")).select("token", "id", F.expr(f"n * {1 << PLACE_BITS} + pos").alias("np"))
    return materialize(each.join(shared, "token"), "entries")


def _short_pairs(entries: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """All pairs of the short lists that may link."""
    lists = entries.filter(F.col("size") <= SHORT).groupBy("token").agg(F.collect_list(F.struct("id", "np")).alias("m"))  # SHORT members at most
    pair = lambda x, y: F.struct(x["id"].alias("a"), y["id"].alias("b"))
    met = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (x["id"] < y["id"]) & _may_meet(x, y, percent)), lambda y: pair(x, y))))
    pairs = lists.select(F.inline(met)).distinct()
    x, y = (prefixes.select(F.col("id").alias(c), F.struct("n", *_SKETCH).alias(f"of_{c}")) for c in ("a", "b"))
    told = pairs.join(x, "a").join(y, "b")
    return told.filter(_sketches_agree("of_a", "of_b", F.col("of_a.n"), F.col("of_b.n"), percent)).select("a", "b")


def _long_lists(entries: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Entries of the long lists with sketch, level (least ``l`` of which the token counts) and take (the ``l`` of
    the set), as a written table."""
    n = F.shiftright("np", PLACE_BITS)
    level = F.greatest(F.lit(1).cast("long"), F.col("np").bitwiseAND((1 << PLACE_BITS) - 1) - (n - F.floor((n * percent + 99) / 100)) + 1)
    long = entries.filter(F.col("size") > SHORT).withColumns({"n": n, "level": level.cast("int")})
    # Entries of the lists up to each level: what a probe reads, and by matches what it may have to verify.
    upto = long.groupBy("id").agg(F.first("n").alias("n"), *(F.coalesce(F.sum(F.when(F.col("level") <= k, F.col("size") - 1)), F.lit(0)).alias(f"e{k}") for k in range(1, LEVELS + 1)))
    cost = lambda k: F.col(f"e{k}") + F.col(f"e{k}") / k * (VERIFY + F.col("n") / 8)
    most = F.floor((F.col("n") * percent + 99) / 100)  # no set shares more than that
    best = F.array_min(F.array(*(F.struct(F.when(F.lit(k) <= most, cost(k)).otherwise(F.lit(float("inf"))).alias("cost"), F.lit(k).alias("take")) for k in range(1, LEVELS + 1))))
    told = prefixes.select("id", *_SKETCH).join(upto.select("id", best["take"].alias("take")), "id")
    return materialize(long.drop("size", "n").join(told, "id"), "lists")


def _star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of the members of each long list with leaders drawn by hash, ``LEADERS`` for each member: what passes the
    sketches is mostly linked, and what is left out here meets in :func:`_open_pairs`."""
    kept = F.struct("id", "np", *_SKETCH)
    drawn = lists.groupBy("token").agg(F.array(*(F.min_by(kept, F.xxhash64("id", "token", F.lit(i))) for i in range(LEADERS))).alias("to"))
    m, o = lists.select("token", "id", "np", *_SKETCH).alias("m"), drawn.select("token", F.explode(F.array_distinct("to")).alias("to")).select("token", "to.*").alias("o")
    both = [{"np": F.col(f"{x}.np")} for x in "mo"]
    on = (F.col("m.token") == F.col("o.token")) & (F.col("m.id") != F.col("o.id")) & _may_meet(*both, percent) & _sketches_agree("m", "o", *map(_n, both), percent)
    met = m.join(o, on).groupBy(F.col("m.id").alias("m")).agg(F.array_sort(F.collect_set(F.struct(F.xxhash64("o.id"), F.col("o.id").alias("o")))).alias("to"))  # as many as it has lists
    each = met.select("m", F.explode(F.slice("to", 1, LEADERS)).alias("to"))
    return each.select(F.least("m", "to.o").alias("a"), F.greatest("m", "to.o").alias("b"))


def _open_pairs(lists: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components with as many shared prefix tokens as the probing set asks for."""
    named = lists.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = named.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l != h").select("token")
    inside = materialize(named.join(several, "token"), "open")
    p, i = inside.filter("level <= take").alias("p"), inside.alias("i")
    both = [{"np": F.col(f"{x}.np")} for x in "pi"]
    n, m = map(_n, both)
    on = (
        (F.col("p.token") == F.col("i.token")) & (F.col("p.label") != F.col("i.label")) & (F.col("i.level") <= F.col("p.take")) & ((m < n) | ((m == n) & (F.col("i.id") < F.col("p.id"))))
        & _may_meet(*both, percent) & _sketches_agree("p", "i", n, m, percent)
    )
    met = p.join(i, on).groupBy(F.col("p.id").alias("a"), F.col("i.id").alias("b"), F.col("p.take").alias("take")).agg(F.count("*").alias("matches"))
    pairs = materialize(met.filter("matches >= take").select("a", "b"), "pairs")
    discard(inside)
    return pairs


def similar_sets(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id of all that links reach, itself included) of every row.

    A text that is null or without words has an empty set, no link and its own id. Rows of equal sets are
    linked, rows that repeat among them. Null ids are not least unless a component has no other. Other columns
    of ``docs`` are ignored; an empty table gives no rows. ``percent`` is 50 or more.
    """
    if percent < 50:
        raise ValueError("percent is 50 at least")
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    scanned = materialize(texts.mapInArrow(tidy(_name_sets), f"doc_id {kind}, node binary, n long, block int, counts binary"), "sets")
    found = scanned.filter("block is null").select("doc_id", "node", "n")
    often = docs.sparkSession.sparkContext.broadcast(_counters(scanned.filter("block is not null")))
    each = texts.mapInArrow(tidy(_prefix(often, percent)), "node binary, n long, " + "".join(f"{s} long, " for s in _SKETCH) + "wide binary, tokens array<long>")
    # A node's number is written with it, so it is the same wherever it is read.
    prefixes = materialize(each.dropDuplicates(["node"]).withColumn("id", F.monotonically_increasing_id()), "prefixes")
    nodes = prefixes.select("id", "node")
    entries = _entries(prefixes)
    lists = _long_lists(entries, prefixes, percent)
    pairs = materialize(_short_pairs(entries, prefixes, percent).union(_star_pairs(lists, percent)).distinct(), "pairs")
    discard(entries)
    stars = _links(texts, found, prefixes, pairs, percent)
    label = components(stars)
    discard(stars)
    label = merge_labels(label, _links(texts, found, prefixes, _open_pairs(lists, label, percent), percent))
    discard(lists)
    named = found.join(nodes, "node", "left").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "label", "left")
    own = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


SIMILAR_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT r.a AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
