"""Repeated passages by suffix arrays in a logarithmic family of levels.

A byte is removed if a ``width``-byte string that also starts elsewhere covers it. Which suffixes
enter the index is chosen by content: in every window of ``width`` bytes the least hashed
``GRAM``-byte string is the window's anchor, so equal windows have equal anchors at equal places.
An anchor that occurs once cannot lie in a repeated window and leaves before any text moves; an
anchor whose whole context (all windows that chose it) occurs twice is settled by that count.

What is left is indexed. Each task gets the anchors of its hash range in batches. A batch gets a
suffix array of the texts after its anchors and a mirrored one of the texts before them; it is
merge-scanned against the levels the task holds, and levels no larger than it merge with it, so a
task holds a logarithmic number of them. In a merged array, windows that repeat are runs of equal
rank in both orders.

Anchors that more than ``CROWD`` contexts share (a passage in a third of all documents) are never
brought together. Their windows are halved into nodes whose fingerprints are counted with partial
aggregation: nodes without a twin leave, nodes with equal whole contexts are settled, and only the
few nodes at a passage's ends are counted window by window. All three ways are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

GRAM = 64
CROWD = 200  #: contexts of one anchor that a single task may bring together
NODES = 8
BUFFER = 2 << 20  #: bytes scanned at once
_POS = np.uint64((1 << 24) - 1)
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


def _window_hash(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size``-byte string; ``size`` is a power of two."""
    h, width = _BYTE[data], 1
    while width < size:
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    return _mix(h)


def _window_least(h: np.ndarray, size: int) -> np.ndarray:
    out, width = h, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def find_anchors(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Anchors of joined documents: (place, first window, last window, gram hash, context hash).

    ``ends``: where each document of ``data`` ends; windows stay inside documents.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < width:
        return none
    grams = _window_hash(data, GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    least = _window_least((grams & ~_POS) | place, width - GRAM + 1)
    start = np.arange(len(least))
    valid = start + width <= ends[np.searchsorted(ends, start, side="right").clip(max=len(ends) - 1)]
    start = start[valid]
    if not len(start):
        return none
    anchor = (least[start] & _POS).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(start) != 1)])
    last = np.r_[first[1:], len(start)] - 1
    lo, hi, at = start[first], start[last], anchor[first]
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * _powers(_BASE, len(data) - 1), dtype=np.uint64)]
    # A difference of prefix sums holds a power of the base for where it starts; the inverse takes it out.
    spans = (total[hi + width] - total[lo]) * _powers(pow(_BASE, -1, 1 << 64), len(data))[lo]
    context = _mix(spans + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return at, lo, hi, grams[at].view(np.int64), context.view(np.int64)


def _joined(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in groups of about ``BUFFER`` bytes, with the number of the first."""
    part, weight, first = [], 0, 0
    for i, t in enumerate(texts):
        if part and weight + len(t) > BUFFER:
            yield first, part
            part, weight, first = [], 0, i
        part.append(t)
        weight += len(t)
    if part:
        yield first, part


_ANCHORS = "k1 long, k2 long, at int, lo int, hi int, gram long, context long"


def _scan(width: int):
    """Rows of all anchors. Texts over ``1 << 23`` bytes are cut into overlapping pieces."""
    piece = 1 << 23

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            texts = batch.column("data").to_pylist()
            cut = [(i, o, t[o : o + piece + width - 1]) for i, t in enumerate(texts) for o in range(0, max(1, len(t) - width + 1), piece)]
            for first, part in _joined([c[2] for c in cut]):
                data = np.frombuffer(b"".join(part), np.uint8)
                ends = np.cumsum([len(t) for t in part])
                at, lo, hi, gram, context = find_anchors(data, ends, width)
                if not len(at):
                    continue
                own = np.searchsorted(ends, lo, side="right")
                row = np.array([cut[first + j][0] for j in range(len(part))])[own]
                shift = (np.array([cut[first + j][1] for j in range(len(part))]) - np.r_[0, ends[:-1]])[own]
                columns = [k1[row], k2[row], *((x + shift).astype(np.int32) for x in (at, lo, hi)), gram, context]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _ANCHORS.split(", ")])

    return run


# ---- contexts --------------------------------------------------------------------------------

_CONTEXTS = "k1 long, k2 long, at int, near int, far int, gram long, twin boolean, crowd boolean, before binary, after binary"


def _cut(width: int):
    """Context of each listed anchor. Offsets are counted back from the anchor: near to far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for k1, k2, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "packed", "wanted"))):
                data = unpack.decompress(packed)
                for w in wanted:
                    at, near, far = w["at"], w["at"] - w["hi"], w["at"] - w["lo"]
                    rows.append((k1, k2, at, near, far, w["gram"], w["twin"], w["crowd"], data[at - far : at], data[at : at + width - near]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 5000]), kinds)], [c.split()[0] for c in _CONTEXTS.split(", ")])

    return run


# ---- levels ----------------------------------------------------------------------------------


class Level:
    """Suffixes in order: the texts after anchors, with the mirrored texts before them."""

    def __init__(self, entries: list[tuple]):
        """``entries``: (after, mirrored before, near, far, number); sorted here, in linear time if
        they are a few sorted runs."""
        self.entries = sorted(entries, key=lambda e: e[0])

    def __len__(self) -> int:
        return len(self.entries)

    def merged(self, other: Level) -> Level:
        return Level(self.entries + other.entries)

    def repeated(self, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """(offset, numbers of entries) whose window at the offset occurs in more than one entry."""
        n = len(self)
        if n < 2:
            return
        reach = width - GRAM
        shared_after = _common([e[0] for e in self.entries], width)
        order = sorted(range(n), key=lambda i: self.entries[i][1])
        shared_before = _common([self.entries[i][1] for i in order], reach)
        order = np.array(order)
        near, far, number = (np.array([e[c] for e in self.entries]) for c in (2, 3, 4))
        for block in range(0, reach + 1, 32):
            offsets = np.arange(block, min(block + 32, reach + 1))
            after = np.cumsum(np.vstack([np.zeros((1, len(offsets)), bool), shared_after[:, None] < width - offsets]), axis=0)
            before = np.empty_like(after)
            before[order] = np.cumsum(np.vstack([np.zeros((1, len(offsets)), bool), shared_before[:, None] < offsets]), axis=0)
            key = (after * n + before).T.copy()
            key[(offsets[:, None] < near) | (offsets[:, None] > far)] = -1
            ranked = np.argsort(key, axis=1, kind="stable")
            value = np.take_along_axis(key, ranked, axis=1)
            same = (value[:, 1:] == value[:, :-1]) & (value[:, 1:] >= 0)
            twin = np.zeros(key.shape, bool)
            twin[:, 1:] |= same
            twin[:, :-1] |= same
            for i in np.flatnonzero(same.any(axis=1)):
                yield int(offsets[i]), number[ranked[i][twin[i]]]


def _common(texts: list[bytes], width: int) -> np.ndarray:
    """Bytes that neighbours share, for texts in order. Ends count as bytes of their own, so texts
    that end inside the width differ from there on only if the other goes on."""
    grid = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
    differ = grid[1:] != grid[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), width)


class Family:
    """Levels of a task. Adding a batch reports its repeated windows against all that came before."""

    def __init__(self, width: int):
        self.width, self.levels = width, []

    def add(self, entries: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        new = Level(entries)
        yield from new.repeated(self.width)
        kept = []
        for level in sorted(self.levels, key=len):
            both = new.merged(level)
            yield from both.repeated(self.width)
            if len(level) <= len(new):
                new = both
            else:
                kept.append(level)
        self.levels = [*kept, new]


_MARKS = "k1 long, k2 long, start int, stop int"


def _runs(k1: np.ndarray, k2: np.ndarray, start: np.ndarray, width: int) -> pa.RecordBatch:
    """Half-open byte spans of windows that start at the given places."""
    order = np.lexsort((start, k2, k1))
    k1, k2, start = k1[order], k2[order], start[order]
    head = np.r_[True, (np.diff(k1) != 0) | (np.diff(k2) != 0) | (np.diff(start) > 1)][: len(start)]
    tail = np.r_[head[1:], True][: len(start)]
    return pa.RecordBatch.from_arrays([pa.array(k1[head]), pa.array(k2[head]), pa.array(start[head].astype(np.int32)), pa.array((start[tail] + width).astype(np.int32))], ["k1", "k2", "start", "stop"])


def _index(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(width)
        held: list[tuple[np.ndarray, ...]] = []
        hits: list[np.ndarray] = []
        count = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "at", "twin")))
            columns = (batch.column(c).to_pylist() for c in ("after", "before", "near", "far"))
            entries = [(a, b[::-1], n, f, count + i) for i, (a, b, n, f) in enumerate(zip(*columns))]
            count += len(entries)
            for offset, numbers in family.add(entries):
                hits.append(numbers.astype(np.int64) * 1024 + offset)
        if hits:
            k1, k2, at, twin = (np.concatenate(x) for x in zip(*held))
            found = np.unique(np.concatenate(hits))
            number, offset = found // 1024, found % 1024
            own = ~twin[number].astype(bool)
            yield _runs(k1[number][own], k2[number][own], (at[number] - offset)[own], width)

    return run


# ---- crowded anchors -------------------------------------------------------------------------


def _digest(data: bytes, seed: int) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data, seed)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _bounds(width: int) -> list[tuple[int, int]]:
    reach = width - GRAM
    step = -(-(reach + 1) // NODES)
    return [(i, min(i + step - 1, reach)) for i in range(0, reach + 1, step)]


_NODES = "k1 long, k2 long, at int, node int, twin boolean, c1 long, c2 long, u1 long, u2 long"


def _nodes(width: int):
    """For each node of an anchor's windows: what all of them share, and all they cover if the
    anchor has all of them (else u1 and u2 are null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, at, near, far, twin, before, after in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "at", "near", "far", "twin", "before", "after"))):
                for i, (a, b) in enumerate(_bounds(width)):
                    if a > far or b < near:
                        continue
                    core = _digest(before[len(before) - a :] + after[: width - b], i)
                    whole = _digest(before[len(before) - b :] + after[: width - a], i) if near <= a and b <= far else (None, None)
                    rows.append((k1, k2, at, i, twin, *core, *whole))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)], [c.split()[0] for c in _NODES.split(", ")])

    return run


_WINDOWS = "k1 long, k2 long, start int, twin boolean, w1 long, w2 long"


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, at, near, far, node, twin, before, after in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "at", "near", "far", "node", "node_twin", "before", "after"))):
                a, b = _bounds(width)[node]
                for o in range(max(a, near), min(b, far) + 1):
                    rows.append((k1, k2, at - o, twin, *_digest(before[len(before) - o :] + after[: width - o], 0)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], [c.split()[0] for c in _WINDOWS.split(", ")])

    return run


def _crowded(contexts: DataFrame, width: int) -> DataFrame:
    """Marks of anchors that too many contexts share, by counting fingerprints."""
    entry = ["k1", "k2", "at", "node"]
    nodes = materialize(contexts.mapInArrow(_nodes(width), _NODES), "nodes")
    cores = nodes.groupBy("c1", "c2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    alive = nodes.join(cores, ["c1", "c2"])
    whole = alive.filter("u1 is not null").groupBy("u1", "u2").agg(F.count("*").alias("n"), F.min(F.struct(*entry)).alias("first")).filter("n > 1")
    judged = materialize(alive.join(whole.select("u1", "u2", F.lit(True).alias("settled"), "first"), ["u1", "u2"], "left"), "judged")
    bound = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _bounds(width)))
    span = F.element_at(bound, F.col("node") + 1)
    settled = judged.filter("settled and not twin").select("k1", "k2", (F.col("at") - span["b"]).alias("start"), (F.col("at") - span["a"] + width).alias("stop"))
    open_ = judged.filter("settled is null")
    # A settled context takes part once, for open nodes that share what it shares.
    stand_in = judged.filter(F.col("settled") & (F.struct(*entry) == F.col("first"))).join(open_.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi")
    asked = open_.select(*entry, F.col("twin").alias("node_twin")).union(stand_in.select(*entry, F.lit(True)))
    windows = materialize(contexts.drop("twin").join(asked, ["k1", "k2", "at"]).mapInArrow(_windows(width), _WINDOWS), "windows")
    often = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    marks = windows.filter("not twin").join(often, ["w1", "w2"]).select("k1", "k2", "start", (F.col("start") + width).alias("stop"))
    return settled.union(marks)


# ---- the operator ----------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, data and a 128-bit key of both; equal rows have equal keys and equal results."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", data.alias("data")).withColumns({"k1": F.xxhash64("doc_id", "data", F.lit(1)), "k2": F.xxhash64("data", "doc_id", F.lit(2))})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([pack.compress(d) for d in batch.column("data").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), packed], ["doc_id", "k1", "k2", "packed"])


def repeated_spans(docs: DataFrame, width: int = 400) -> DataFrame:
    """k1, k2, spans (array of start and stop) of every document with repeated windows."""
    keyed = _keyed(docs)
    spark = docs.sparkSession
    anchors = materialize(keyed.select("k1", "k2", "data").mapInArrow(_scan(width), _ANCHORS), "anchors", "none")
    shared = anchors.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    alive = materialize(anchors.join(shared, "gram"), "alive")
    place = F.struct("k1", "k2", "at", "lo", "hi")
    twins = alive.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    judged = materialize(alive.join(twins.select("gram", "context", "first"), ["gram", "context"], "left"), "judged")
    settled = judged.filter("first is not null").select("k1", "k2", F.col("lo").alias("start"), (F.col("hi") + width).alias("stop"))
    open_ = judged.filter("first is null")
    # Settled contexts take part once each, where an open one shares the anchor.
    stand_in = twins.join(open_.select("gram").distinct(), "gram", "left_semi").select("first.*", "gram", F.lit(True).alias("twin"))
    asked = open_.select("k1", "k2", "at", "lo", "hi", "gram", F.lit(False).alias("twin")).unionByName(stand_in).distinct()
    sizes = asked.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram", (F.col("n") > CROWD).alias("crowd"))
    by_doc = asked.join(sizes, "gram").groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "lo", "hi", "gram", "twin", "crowd")).alias("wanted"))
    # Rows that repeat are settled, so at most a stand-in is cut more than once; its windows mark nothing.
    texts = _packed(keyed).join(by_doc, ["k1", "k2"])
    contexts = materialize(texts.select("k1", "k2", "packed", "wanted").mapInArrow(_cut(width), _CONTEXTS), "contexts")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), contexts.count() // 20_000)
    indexed = contexts.filter("not crowd").repartition(parts, "gram").mapInArrow(_index(width), _MARKS)
    marks = settled.union(indexed).union(_crowded(contexts.filter("crowd"), width))
    return marks.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _packed(keyed: DataFrame) -> DataFrame:
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(_pack, f"doc_id {kind}, k1 long, k2 long, packed binary")


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
            data, cut = unpack.decompress(packed), union_of([(s["start"], s["stop"]) for s in spans or []])
            kept, at = [], 0
            for a, b in cut:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            rows.append((len(data), sum(b - a for a, b in cut), len(cut), b"".join(kept)))
        n, removed, count, kept = zip(*rows) if rows else ((),) * 4
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def strip_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Null texts are empty. Documents shorter than ``width`` bytes lose nothing. Rows that repeat are
    copies of one another. ``width`` is at least ``GRAM`` and at most 1023.
    """
    texts = _packed(_keyed(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = texts.join(repeated_spans(docs, width), ["k1", "k2"], "left").select("doc_id", "packed", "spans")
    return placed.mapInArrow(_strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
