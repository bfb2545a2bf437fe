"""Near-duplicates by Order MinHash, verified by banded alignment.

Two texts are near-duplicates if the edit distance of their word sequences is at most a fifth
(``1 - least``) of the longer one. Words are runs of letters and digits in lower case.

A text is its sequence of ``K``-word shingles, each labelled with its occurrence so that repeats
differ. A sketch takes, for each of ``SKETCHES`` hash functions, the ``PICKS`` least labelled shingles
and hashes them in text order: texts agree on it if they share those shingles in that order, which
edits far apart leave likely and a changed order does not. Texts that agree on a sketch meet in a bucket.
Shingles of five words are too coarse for short texts: texts of fewer than ``SHORT`` words are
sketched by shingles of two words, and texts of up to ``TINY`` words have as keys all that is left of
them when up to two words go, so that two of them within the distance always share a key. Where the
kinds border on one another, texts have the keys of both.

A bucket never yields all its pairs. First its members are paired with its least member, one row
each. Linked texts get the least name of their component by label propagation with pointer jumping,
over tables in the shared folder. Of buckets that then still hold texts of several components, those
of up to ``CLOSE`` texts are compared text by text, a bounded number of rows for each, and the
members of larger ones are paired with ``LEADERS`` members drawn by hash, which joins what is easily joined.

What larger buckets still hold apart goes through an exact filter. Near-duplicates of at most n words
share ``least * n`` labelled words, and therefore one of the rarest fifth (and one more) of either if
all order words in the same way, here by how many texts have them. Words are counted by ``COUNTERS``
counters, whose size does not grow; words that share one only make the order less sharp. Texts that share such a word meet, and of those only
pairs go on that may share enough of the rarest ``KNOWN`` of their words: how many they share at most
is told by 256 bits of rare words that travel with each text of up to ``KNOWN_SIZE`` words. Texts of a common word meet by rounds of ever more leaders
until each member has met every other that is not of its component by then. Texts that share several of
the commoner ones (``OFTEN``) meet at the first of them: a row has the ``EARLIER`` last of these that the text
has before the row's own word, and what both have there is no reason to meet again. No round and no pair is left out, so texts that share a bucket are linked if they are alike.

Texts of equal words are one node from the start, so a group of copies is one row in all of this.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, tidy

K = 5
SHORT_K = 2
SKETCHES = 32
PICKS = 2
SIMILARITY = 0.8
TINY = 12  #: words up to which keys are deletions; a fifth of them is two
SHORT = 50  #: words from which texts need no sketches of word pairs: near-duplicates of such have 40
CLOSE = 8  #: texts of one bucket that may all meet
LEADERS = 1
KNOWN, KNOWN_SIZE = 0.3, 250  #: share of a text's words, the rarest, that its rows carry as 256 bits, and words up to which they do
ASKED_BITS = 24  #: of a filter of 2 MB, which lets all texts pass when it is full
COUNTERS = 1 << 20  #: of the words of crowded texts; words may share one
OFTEN, EARLIER = 16, 64  #: texts from which on a rare word is a common one, and words of those that a row carries at most
REACH, GROWTH = 64, 64  #: leaders of the first round over rare words, and times those of the round before
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_FACTORS = np.array([xxhash.xxh64_intdigest(b"word %d" % i) | 1 for i in range(K)], np.uint64)
_SEEDS = np.array([xxhash.xxh64_intdigest(b"sketch %d" % i) for i in range(SKETCHES)], np.uint64)
_ODD = np.array([xxhash.xxh64_intdigest(b"odd %d" % i) | 1 for i in range(SKETCHES)], np.uint64)
_ORDERED = np.array([xxhash.xxh64_intdigest(b"pick %d" % i) | 1 for i in range(PICKS)], np.uint64)
_OCCURRENCE = np.uint64(0x9FB21C651E98DF25)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words_of(text: str) -> bytes:
    """The words of a text in lower case, without punctuation, joined by spaces."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_WORDS).split())


def _numbers(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in words], np.uint64)


def shingles_of(w: np.ndarray, k: int = K) -> np.ndarray:
    """Labelled shingles of word numbers in text order; none where there are fewer than ``k`` words."""
    n = len(w) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = _mix(sum((w[i : i + n] * _FACTORS[i] for i in range(1, k)), w[:n] * _FACTORS[0]))
    order = np.argsort(h, kind="stable")
    first = np.r_[True, h[order][1:] != h[order][:-1]]
    if first.all():
        return _mix(h)
    start = np.flatnonzero(first)
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = np.arange(len(h)) - np.repeat(start, np.diff(np.r_[start, len(h)]))
    return _mix(h + occurrence * _OCCURRENCE)


def sketches_of(shingles: np.ndarray) -> np.ndarray:
    """Order MinHash of labelled shingles, a key for each hash function."""
    out = np.zeros(SKETCHES, np.uint64)
    n = len(shingles)
    step = max(1, min(SKETCHES, 1_000_000 // max(1, n)))
    for b in range(0, SKETCHES, step):
        values = (shingles[None, :] ^ _SEEDS[b : b + step, None]) * _ODD[b : b + step, None]
        rows = np.arange(len(values))
        picks = []
        for _ in range(min(PICKS, n)):
            picks.append(values.argmin(axis=1))
            values[rows, picks[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at = np.sort(np.stack(picks, axis=1), axis=1)
        out[b : b + step] = _mix((shingles[at] * _ORDERED[: at.shape[1]]).sum(axis=1, dtype=np.uint64))
    return _mix(out + _SEEDS)


def bucket_keys(words: list[bytes]) -> np.ndarray:
    """The keys of a text; none for texts that are alike only when equal."""
    w = _numbers(words)
    keys = []
    if 5 <= len(words) <= TINY:
        left = {b" ".join(x for i, x in enumerate(words) if i not in gone) for r in range(3) for gone in combinations(range(len(words)), r)}
        keys.append(np.array([xxhash.xxh64_intdigest(x, 3) for x in sorted(left)], np.uint64))
    if TINY - 1 <= len(words) < SHORT:
        keys.append(_mix(sketches_of(shingles_of(w, SHORT_K)) + np.uint64(SHORT_K)))
    if len(words) >= SHORT * 4 // 5:
        keys.append(sketches_of(shingles_of(w)))
    return np.unique(np.concatenate(keys)).view(np.int64) if keys else np.zeros(0, np.int64)


def banded_distance(a: list, b: list, band: int) -> int:
    """Edit distance of two sequences, or ``band + 1`` if it is greater than ``band``.

    Columns of the distance table are bit vectors of vertical steps up and down, cut to the band of
    ``2 * band + 1`` rows about the diagonal, which moves down one row a column.
    """
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return band + 1
    if not n or not m:
        return max(n, m)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << 2 * band + 1) - 1
    up, down = whole & ~((1 << band) - 1), 0
    last = 1 << 2 * band
    # The distance along the lowest diagonal of the band until it meets the last row, then along that row.
    turn = n - band
    found = band if turn >= 0 else n
    for j in range(1, m + 1):
        shift = j - 1 - band
        at = places.get(b[j - 1], 0)
        at = (at >> shift if shift >= 0 else at << -shift) & whole
        diagonal = ((((at & up) + up) ^ up) | at | down) & whole
        right = down | ~(diagonal | up) & whole
        left = diagonal & up
        if j <= turn:
            found += not diagonal & last
        else:
            row = 1 << n - j + band
            found += bool(right & row) - bool(left & row)
        below = diagonal >> 1
        up = (left | ~(below | right)) & whole
        down = below & right
    return min(found, band + 1)


def alike(a: list[bytes], b: list[bytes], least: float = SIMILARITY) -> bool:
    """Whether the edit distance is at most ``1 - least`` of the longer sequence."""
    longer = max(len(a), len(b))
    band = int(longer * (1 - least) + 1e-9)
    if min(len(a), len(b)) < longer - band:
        return False
    # Words that only one of them has are edits.
    if longer - sum((Counter(a) & Counter(b)).values()) > band:
        return False
    return banded_distance(a, b, band) <= band


def _node(words: bytes, text: str) -> bytes:
    return xxhash.xxh3_128_digest(words) if words else xxhash.xxh3_128_digest(text.encode("utf-8", "replace"), 1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, keys, size = [], [], []
        for text in batch.column("text").to_pylist():
            if text is None:
                nodes.append(None), keys.append(None), size.append(0)
                continue
            words = words_of(text)
            each = words.split(b" ") if words else []
            nodes.append(_node(words, text))
            size.append(len(each))
            keys.append(bucket_keys(each))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "size", "keys"])


def _texts(asked: Broadcast):
    """(node, packed words) of texts that the filter lets pass, once a task for each node it has met lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, met, bits = zstandard.ZstdCompressor(level=3), set(), asked.value
        for batch in batches:
            nodes, packed = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text) if text is not None else b""
                if not words:
                    continue
                node = _node(words, text)
                at = int.from_bytes(node[:4], "big") >> 32 - ASKED_BITS
                if bits[at >> 3] >> (at & 7) & 1 and node not in met:
                    if len(met) >= 100_000:
                        met.clear()
                    met.add(node)
                    nodes.append(node)
                    packed.append(pack.compress(words))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(packed, pa.binary())], ["node", "packed"])

    return run


def _asked_bits(asked: DataFrame) -> bytes:
    """A bit for the first ``ASKED_BITS`` bits of each node; its size does not depend on how many there are."""
    at = F.shiftright(F.conv(F.hex(F.substring("node", 1, 4)), 16, 10).cast("long"), 32 - ASKED_BITS)
    pieces = asked.select((at / 32768).cast("int").alias("b"), (at % 32768).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = bytearray(1 << ASKED_BITS - 3)
    for r in pieces:
        out[r.b * 4096 : (r.b + 1) * 4096] = r.bits
    return bytes(out)


def _align(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last, words = None, []
        for batch in batches:
            hits = []
            for node, leader, own, other in zip(*(batch.column(c).to_pylist() for c in ("node", "leader", "own", "other"))):
                if leader != last:
                    last, words = leader, unpack.decompress(other).split(b" ")
                if alike(unpack.decompress(own).split(b" "), words, least):
                    hits.append((node, leader))
            columns = zip(*hits) if hits else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each component of ``edges`` (a, b). Each round is a written
    table; labels halve their distance to the least one in every round."""
    both = materialize(edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = materialize(lower.join(jump, "label").select("node", F.least("label", "beyond").alias("label"), (F.least("label", "beyond") != F.col("old")).alias("moved")), "labels")
        discard(labels)
        if new.filter("moved").isEmpty():
            discard(both)
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, node and label (equal in a class of near-duplicates) of every document.

    Texts of equal words are duplicates. Texts without words are duplicates if they are equal; a null
    text has a null node and label and is nobody's duplicate. Rows that repeat are duplicates.
    Texts of up to four words are duplicates only if their words are equal. ``least`` is 0.8 or more:
    the keys of short texts are made for that.
    """
    if least < SIMILARITY:
        raise ValueError(f"least is {SIMILARITY} at least")
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = materialize(docs.select("doc_id", "text").mapInArrow(tidy(_sketch), f"doc_id {kind}, node binary, size int, keys array<long>"), "sketches")
    nodes = materialize(sketched.filter(F.size("keys") > 0).groupBy("node").agg(F.min("size").alias("size"), F.min("keys").alias("keys")), "nodes")
    members = nodes.select("node", "size", F.explode("keys").alias("key"))
    common = materialize(members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("to")).filter("n > 1"), "common")
    shared = materialize(members.join(common, "key"), "shared")
    discard(nodes, common)
    texts = _packed(docs, shared.select("node").distinct())
    label = merge_labels(None, _links(texts, _pairs(shared, least), least))
    shared = shared.drop("to")
    inside = _open(shared, label, "key")
    label = merge_labels(label, _links(texts, _pairs(_close(inside).union(_drawn(inside)), least), least))
    label = _settle(texts, inside.filter(F.col("n") > CLOSE), label, least)
    discard(inside, shared, texts)
    return sketched.select("doc_id", "node").join(label, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))


def _packed(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """node and packed words of the asked nodes, once each, as a written table."""
    bits = docs.sparkSession.sparkContext.broadcast(_asked_bits(asked))
    texts = docs.select("text").mapInArrow(tidy(_texts(bits)), "node binary, packed binary").join(asked, "node", "left_semi")
    return materialize(texts.groupBy("node").agg(F.first("packed").alias("packed")), "texts", "none")


def merge_labels(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """``label`` (node, label; nodes that it lacks are their own) with what ``links`` (a, b) join made one."""
    if label is None:
        out = components(links)
        discard(links)
        return out
    one = label.select(F.col("node").alias("a"), F.col("label").alias("x"))
    two = label.select(F.col("node").alias("b"), F.col("label").alias("y"))
    named = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    edges = materialize(named.filter("a != b").distinct(), "joined")
    if edges.isEmpty():
        discard(edges, links)
        return label
    found = components(edges)
    joined = found.select(F.col("node").alias("label"), F.col("label").alias("least"))
    moved = label.join(joined, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    new = materialize(moved.union(found.join(label, "node", "left_anti")), "labels")
    discard(edges, links, label, found)
    return new


def _pairs(met: DataFrame, least: float) -> DataFrame:
    """Different pairs whose sizes let them be alike, of ``met`` (node, size, to)."""
    close = F.least("size", "to.size") >= F.greatest("size", "to.size") * least - 1e-6
    pairs = met.filter((F.col("node") != F.col("to.node")) & close).select(F.col("node"), F.col("to.node").alias("leader"))
    return materialize(pairs.select(F.least("node", "leader").alias("leader"), F.greatest("node", "leader").alias("node")).distinct(), "pairs")


def _links(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """a, b: the pairs that alignment confirms."""
    own = pairs.join(texts.withColumnRenamed("packed", "own"), "node")
    placed = own.join(texts.select(F.col("node").alias("leader"), F.col("packed").alias("other")), "leader")
    links = materialize(placed.select("node", "leader", "own", "other").mapInArrow(tidy(_align(least)), "a binary, b binary"), "links")
    discard(pairs)
    return links


def _open(members: DataFrame, label: DataFrame, by: str) -> DataFrame:
    """``members`` with label and n, the members of their group, of the groups of several components."""
    named = members.drop("n", "label").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = named.groupBy(by).agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("n")).filter("l != h").select(by, "n")
    return materialize(named.join(several, by), "open")


def _open_words(groups: DataFrame, label: DataFrame) -> DataFrame:
    """As :func:`_open` for the rows of rare words: a word that few texts have is counted in a window."""
    word = W.partitionBy("key")
    named = groups.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    seen = named.withColumns({"n": F.count("*").over(word), "__gw_l": F.min("label").over(word), "__gw_h": F.max("label").over(word)})
    return materialize(seen.filter("__gw_l != __gw_h").drop("__gw_l", "__gw_h"), "open")


def _close(inside: DataFrame) -> DataFrame:
    """node, size, to: texts of different components in a group of up to ``CLOSE``."""
    close = inside.filter(F.col("n") <= CLOSE)
    to = close.select("key", F.struct("node", "size", "label").alias("to"))
    return close.join(to, "key").filter((F.col("node") < F.col("to.node")) & (F.col("label") != F.col("to.label"))).select("node", "size", "to")


def _drawn(inside: DataFrame) -> DataFrame:
    """node, size, to: members of larger groups with ``LEADERS`` of them, drawn by hash."""
    to = F.struct("node", "size", "label")
    large = inside.filter(F.col("n") > CLOSE)
    drawn = large.groupBy("key").agg(F.array(*(F.min_by(to, F.xxhash64("node", "key", F.lit(i))) for i in range(LEADERS))).alias("to"))
    return large.join(drawn, "key").select("node", "size", "label", F.explode("to").alias("to")).filter(F.col("label") != F.col("to.label")).select("node", "size", "to")


def _labelled_words(packed: bytes, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    return shingles_of(_numbers(unpack.decompress(packed).split(b" ")), 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack, total = zstandard.ZstdDecompressor(), np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for x in batch.column("packed").to_pylist():
            np.add.at(total, (_labelled_words(x, unpack) % np.uint64(COUNTERS)).astype(np.int64), 1)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["counter", "n"])


_RARE = "node binary, size int, rest int, known struct<b0:bigint,b1:bigint,b2:bigint,b3:bigint>, twice int, beyond int, earlier array<bigint>, key bigint"


def _rare_words(counts: Broadcast, least: float):
    """Rows of the rare words of each text; see :func:`_rare`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, often = zstandard.ZstdDecompressor(), counts.value
        names = [c.split()[0] for c in ("node", "size", "rest", "known", "twice", "beyond", "earlier", "key")]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for node, x in zip(batch.column("node").to_pylist(), batch.column("packed").to_pylist()):
                words = _labelled_words(x, unpack)
                texts, size = often[(words % np.uint64(COUNTERS)).astype(np.int64)], len(words)
                order = np.lexsort((words, texts))
                words, common = words[order].view(np.int64), int(np.searchsorted(texts[order], OFTEN))
                own = int((texts == 1).sum())  # no other text has them; they come first
                taken = int(size * (1 - least) + 1e-6) + 1
                if taken <= own:
                    continue
                carried = max(math.ceil(size * KNOWN), own) if size <= KNOWN_SIZE else own
                bits = [0, 0, 0, 0]
                for w in words[own:carried].tolist():
                    bits[w & 3] |= 1 << (w >> 2 & 63)
                known = {f"b{j}": b - (1 << 64) if b >> 63 else b for j, b in enumerate(bits)}
                n = taken - own
                earlier = [words[max(common, i - EARLIER) : i] for i in range(own, taken)]
                told = ([node] * n, [size] * n, [size - i for i in range(own, taken)], [known] * n, [carried - own - sum(b.bit_count() for b in bits)] * n)
                for column, part in zip(columns, (*told, [size - carried if size <= KNOWN_SIZE else size] * n, earlier, words[own:taken].tolist())):
                    column += part
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.struct([(f"b{j}", pa.int64()) for j in range(4)]), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _bound(size, least: float):
    """Labelled words that two alike texts share at least, the longer one of ``size`` words."""
    return size - F.floor(size * (1 - least) + 1e-6)


def _shared_bits(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.b{j}").bitwiseAND(F.col(f"{b}.b{j}"))) for j in range(4)), F.lit(0))


def _rare(texts: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """key, node, size, rest, known, twice, beyond, earlier: for each text of ``asked`` (node) the labelled words of which
    alike texts share one: its rarest among ``asked``, without those that no other text has.

    ``rest`` counts the text's words from this one on. ``known`` has a bit for each of its rarest words that
    other texts may have, ``twice`` counts those words whose bit another one has set, ``beyond`` the words
    after them; a text of more than ``KNOWN_SIZE`` words carries none, and all its words are beyond.
    ``earlier`` has the last common words of the text before this one.
    """
    own = materialize(texts.join(asked, "node", "left_semi"), "crowded", "none")
    counted = own.select("packed").mapInArrow(tidy(_count_words), "counter long, n long").groupBy("counter").agg(F.sum("n").cast("int").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int32)
    often[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    spread = own.repartition("node")
    rare = materialize(spread.mapInArrow(tidy(_rare_words(own.sparkSession.sparkContext.broadcast(often), least)), _RARE), "rare")
    discard(own)
    return rare


def _meetings(drawn: DataFrame, reach: int, least: float) -> DataFrame:
    """node, size, to: members of rare words with those whose draw is below ``reach``, where they may be alike."""
    first = drawn.filter(F.col("draw") < reach).select("key", F.struct("node", "size", "rest", "known", "twice", "beyond", "earlier", "label", "draw").alias("to"))
    longer = F.greatest("size", "to.size")
    alike_size = F.least("size", "to.size") >= _bound(longer, least)
    # The first word that two texts share has all others behind it; what they share lies among the rare
    # words of both or behind those of one.
    enough = F.least("rest", "to.rest") >= _bound(longer, least)
    still = _shared_bits("known", "to.known") + F.least("twice", "to.twice") + F.greatest("beyond", "to.beyond") >= _bound(longer, least)
    once = (F.col("draw") >= reach) | (F.col("node") < F.col("to.node"))
    # At an earlier word of both they meet too, in this round or another: all else that is asked holds there as well.
    fresh = ~F.arrays_overlap("earlier", "to.earlier")
    met = drawn.join(first, "key").filter((F.col("label") != F.col("to.label")) & alike_size & enough & once & still & fresh)
    return met.select("node", "size", "to")


def _settle(texts: DataFrame, large: DataFrame, label: DataFrame, least: float) -> DataFrame:
    """``label`` after all texts that large buckets (``large``: node, size, key) hold apart have met where
    they can be alike."""
    inside = _open(large, label, "key")
    asked = materialize(inside.select("node").distinct(), "asked")
    discard(inside)
    if asked.isEmpty():
        return label
    groups, done, reach = _rare(texts, asked, least), 0, REACH
    while True:
        # A member leads in the round in which ``reach`` passes its draw below n; it has then met all.
        inside = _open_words(groups, label)
        drawn = inside.withColumn("draw", F.pmod(F.xxhash64("node", "key"), F.col("n"))).filter(F.col("draw") >= done)
        if drawn.isEmpty():
            discard(inside, groups, asked)
            return label
        label = merge_labels(label, _links(texts, _pairs(_meetings(drawn, reach, least), least), least))
        discard(inside)
        done, reach = reach, reach * GROWTH


def classify(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size and keep (the class's least doc_id) of
    every document; a null text is a class of its own, of size 1."""
    found = materialize(near_duplicates(docs, least), "classes")
    named = found.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    out = found.join(named, "label", "left")
    class_id = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), class_id.eqNullSafe(F.col("doc_id")).alias("keep"))


def _with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = [_node(words_of(text), text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], [*batch.schema.names, "__gw_node"])


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class, with its own columns: the one of the least doc_id, null after all
    others. Of rows that share it and their words one stays; rows with a null text all stay. An id
    that repeats with other texts is as many documents."""
    texts = docs.filter(F.col("text").isNotNull())
    found = materialize(near_duplicates(texts, least), "kept")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("f"))
    keys = first.select(F.col("f.doc_id").alias("__gw_id"), F.col("f.node").alias("__gw_of"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    noded = texts.mapInArrow(_with_node, f"{kinds}, __gw_node binary")
    kept = noded.join(keys, (F.col("__gw_node") == F.col("__gw_of")) & F.col("doc_id").eqNullSafe(F.col("__gw_id")))
    if not found.groupBy("doc_id", "node").count().filter("count > 1").isEmpty():
        # A class has one node here, so rows of one node are the same document. Aggregated, as copies may be many.
        row = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(F.xxhash64("text"), "text")).alias("row")
        kept = kept.groupBy(F.hex("__gw_node").alias("__gw_at")).agg(row).select("row.*")
    return kept.select(*docs.columns).unionByName(docs.filter(F.col("text").isNull()))
