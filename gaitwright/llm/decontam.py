"""Benchmark decontamination with suffix arrays of the training text.

Every task is a shard: it turns its documents into word numbers, builds a suffix array over them
and binary-searches every suffix of the test items in it. A range of the array is the places of a
window; following the words past the window gives the longest verbatim match there.

A training suffix that starts with a word no test item has cannot match, so only suffixes inside
runs of test words enter the array; that leaves out nothing. Tests travel to the shards in blocks
of about ``BLOCK`` bytes, one pass and one written table for each block, so what is sent and held has
a bound however large the test set is. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, tidy

BLOCK = 4 << 20
SLICE = 4 << 20  #: bytes of text that one suffix array covers
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or c >= 97 and c not in range(0x7B, 0x80) else 32 for c in range(256))
_END = b"|"  # no word has this byte


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class Tests:
    """The windows of a block of test items."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.numbers: dict[bytes, int] = {}
        self.names: list[str] = []
        suffixes: dict[tuple[int, ...], int] = {}
        ways: list[set[tuple[int, int]]] = []  # (item, place) of each window
        codes = []
        self.suffix: list[np.ndarray] = []  #: all that tests have from a window's first place on
        self.items: list[set[int]] = []
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            code = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int32)
            self.names.append(name)
            codes.append(code)
            size = min(width, len(code))
            for i in range(len(code) - size + 1):
                key = tuple(code[i : i + size].tolist())
                at = suffixes.setdefault(key, len(suffixes))
                if at == len(ways):
                    ways.append(set())
                    self.items.append(set())
                ways[at].add((len(codes) - 1, i))
                self.items[at].add(len(self.names) - 1)
        first = [0]
        for own in ways:
            # Of continuations of which one begins with another, the longer one is enough.
            goes = sorted((codes[k][i:] for k, i in own), key=lambda c: c.tobytes())
            self.suffix += [c for c, d in zip(goes, [*goes[1:], goes[0][:0]]) if d[: len(c)].tobytes() != c.tobytes()] if len(goes) > 1 else goes
            first.append(len(self.suffix))
        self.first = np.array(first)  #: where the continuations of each window begin in ``suffix``
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(k) for k in suffixes}:
            own = [(k, i) for k, i in suffixes.items() if len(k) == size]
            self.windows[size] = (np.array([k for k, _ in own], np.int32), np.array([i for _, i in own]))


def suffix_array(code: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the suffixes of ``code``, compared over ``depth`` numbers or more.

    Prefix doubling: each round ranks by twice as many numbers. ``code`` ends with a 0, and
    ``starts`` are all places whose number is not 0.
    """
    rank = np.zeros(len(code), np.int64)
    rank[starts] = code[starts]
    step = 1
    while True:
        beyond = np.minimum(starts + step, len(code) - 1)
        key = rank[starts] * (len(code) + int(rank.max()) + 2) + rank[beyond]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        place = np.cumsum(np.r_[1, ranked[1:] != ranked[:-1]])
        rank[starts[order]] = place
        step *= 2
        if step >= depth or place[-1] == len(starts):
            return starts[order]


def _bound(code: np.ndarray, array: np.ndarray, windows: np.ndarray, upper: bool) -> np.ndarray:
    """For each window the first place in the array that is not before it (upper: that is after it)."""
    lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(array), np.int64)
    reach = np.arange(windows.shape[1])
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = array[np.minimum(mid, len(array) - 1)]
        there = code[np.minimum(at[:, None] + reach, len(code) - 1)]
        differ = there != windows
        first = np.argmax(differ, axis=1)
        row = np.arange(len(windows))
        some = differ[row, first]
        before = (there[row, first] < windows[row, first]) & some
        if upper:
            before |= ~some
        lo = np.where(open_ & before, mid + 1, lo)
        hi = np.where(open_ & ~before, mid, hi)
    return lo


def search(code: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, window, words of the window, words of the longest match) of every window in ``code``.

    ``code``: word numbers, 0 for words that no test has, -1 at the end of each document.
    """
    none = np.zeros(0, np.int64)
    code = np.r_[np.maximum(code, 0), 0]
    stops = np.flatnonzero(code == 0)
    inside = np.flatnonzero(code)
    if not len(inside) or not tests.windows:
        return none, none, none, none
    run = stops[np.searchsorted(stops, inside)] - inside
    # Whole runs of at least the shortest window, with the stop after each.
    head = np.r_[True, np.diff(inside) > 1]
    whole = run[head][np.cumsum(head) - 1]
    inside = inside[whole >= min(tests.windows)]
    if not len(inside):
        return none, none, none, none
    ends = np.array([len(s) for s in tests.suffix])
    longest = int(ends.max())
    array = suffix_array(code, inside, longest)
    found = []
    for size, (windows, ids) in tests.windows.items():
        for b in range(0, len(windows), 50_000):
            part, own = windows[b : b + 50_000], ids[b : b + 50_000]
            lo, hi = _bound(code, array, part, False), _bound(code, array, part, True)
            n = hi - lo
            which = np.repeat(np.arange(len(part)), n)
            at = array[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            found.append((at, own[which], np.full(len(at), size)))
    at, window, size = (np.concatenate(x) for x in zip(*found))
    # Every continuation of a window is tried at every place of the window.
    n = (tests.first[1:] - tests.first[:-1])[window]
    row = np.repeat(np.arange(len(at)), n)
    way = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(tests.first[window], n)
    place, reach = at[row], size[row]
    going = np.arange(len(row))
    flat, first = np.concatenate(tests.suffix), np.cumsum(ends) - ends
    while len(going := going[reach[going] < ends[way[going]]]):
        same = code[place[going] + reach[going]] == flat[first[way[going]] + reach[going]]
        going = going[same]
        reach[going] += 1
    length = np.zeros(len(at), np.int64)
    np.maximum.at(length, row, reach)
    return at, window, size, length


def _merge(old: list[int], new: list[tuple[int, int]]) -> list[int]:
    """Union of half-open spans as a flat list."""
    spans = sorted([*zip(old[::2], old[1::2]), *new])
    out: list[int] = []
    for a, b in spans:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


_MATCHES = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))


def _widest(starts: list[int], lengths: list[int]) -> list[tuple[int, int]]:
    """(start, words) of the matches that lie in no other one; ``starts`` ascend."""
    out: list[tuple[int, int]] = []
    for a, n in zip(starts, lengths):
        if out and a == out[-1][0]:
            out[-1] = (a, max(n, out[-1][1]))
        elif not out or a + n > sum(out[-1]):
            out.append((a, n))
    return out


def _shard(tests: Tests, text: str):
    """A pass over record batches that adds what ``tests`` hit."""
    numbers = tests.numbers | {_END: -1}

    def look(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set[str], int]]:
        words = (b" " + _END + b" ").join([*(t.translate(_LOWER) for t in texts), b""]).split()
        code = np.fromiter((numbers.get(w, 0) for w in words), np.int32, len(words))
        ends = np.flatnonzero(code == -1)
        begins = np.r_[0, ends[:-1] + 1]
        at, window, size, length = search(code, tests)
        order = np.argsort(at, kind="stable")
        at, window, size, length = at[order], window[order], size[order], length[order]
        edge = np.searchsorted(at, np.r_[begins, len(code) + 1])
        for i, (b, e) in enumerate(zip(begins.tolist(), ends.tolist())):
            own = slice(edge[i], edge[i + 1])
            spans = list(zip((at[own] - b).tolist(), (at[own] - b + size[own]).tolist()))
            places = _widest((at[own] - b).tolist(), length[own].tolist())
            names = {tests.names[k] for w in set(window[own].tolist()) for k in tests.items[w]}
            yield e - b, spans, names, places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column(text).cast(pa.binary()) if whole.num_rows else []
            texts = [b"" if x is None else x for x in (sizes.to_pylist() if whole.num_rows else [])]
            found, part, weight = [], [], 0
            for t in texts:
                part.append(t)
                weight += len(t)
                if weight >= SLICE:
                    found += look(part)
                    part, weight = [], 0
            if part:
                found += look(part)
            names = whole.schema.names
            spans, items, matches = (whole.column(n).to_pylist() for n in ("__gw_spans", "__gw_items", "__gw_matches"))
            new = {
                "__gw_words": pa.array([f[0] for f in found], pa.int64()),
                "__gw_spans": pa.array([_merge(o, f[1]) for o, f in zip(spans, found)], pa.list_(pa.int32())),
                "__gw_items": pa.array([sorted({*o, *f[2]}) for o, f in zip(items, found)], pa.list_(pa.string())),
                "__gw_matches": pa.array([_widest(*zip(*sorted([*((m["start"], m["words"]) for m in o), *f[3]]))) if o or f[3] else [] for o, f in zip(matches, found)], _MATCHES),
            }
            yield pa.RecordBatch.from_arrays([new.get(n, whole.column(n)) for n in names], names)

    return run


def find_tests(docs: DataFrame, tests: DataFrame, width: int = 10, text: str = "text") -> DataFrame:
    """``docs`` with ``__gw_words``, ``__gw_spans`` (flat half-open word spans), ``__gw_items``
    (sorted names of items with a window there) and ``__gw_matches`` (start and words of each verbatim
    match that lies in no longer one).

    A null text has no words. An item without words has no window; a null item_id is the empty
    name; items of one name count as one. Without tests nothing is hit. A block holds whole items,
    so an item over ``BLOCK`` bytes is a block of its own.
    """
    small_batches(docs.sparkSession)
    none = F.array().cast("array<struct<start:int,words:int>>")
    out = docs.withColumns({"__gw_words": F.lit(0).cast("long"), "__gw_spans": F.array().cast("array<int>"), "__gw_items": F.array().cast("array<string>"), "__gw_matches": none})
    named = tests.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    size = named.agg(F.sum(F.length("data"))).first()[0] or 0
    blocks = max(1, -(-size // (BLOCK // 2)))
    dealt = named.withColumn("block", F.pmod(F.xxhash64("item", "data"), F.lit(blocks)))
    for b in range(blocks):
        items = sorted((r.item, bytes(r.data)) for r in dealt.filter(F.col("block") == b).collect())
        before, out = out, out.mapInArrow(tidy(_shard(Tests(items, width), text)), out.schema)
        if b + 1 < blocks:
            out = materialize(out, "hits")
            if b:
                discard(before)
    return out


def audit_documents(docs: DataFrame, tests: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest
    verbatim match) of every document."""
    found = find_tests(docs.select("doc_id", "text"), tests, width)
    hit = F.aggregate("__gw_spans", F.lit(0), lambda a, x: x - a)  # b - (a - 0), and so on: ends minus starts
    return found.select(
        "doc_id", F.col("__gw_words").alias("n_words"), hit.cast("long").alias("n_hit"), F.size("__gw_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__gw_items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("__gw_spans") > 0).alias("contaminated"),
        F.coalesce(F.array_max("__gw_matches.words"), F.lit(0)).cast("long").alias("longest"),
    )


def locate_tests(docs: DataFrame, tests: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, start, words: where the verbatim matches of ``docs`` begin, in words from 0, and how long they are."""
    return find_tests(docs.select("doc_id", "text"), tests, width).select("doc_id", F.inline("__gw_matches"))


def remove_contaminated(docs: DataFrame, tests: DataFrame, width: int = 10) -> DataFrame:
    """The documents in which no window of a test item occurs, with their own columns."""
    return find_tests(docs, tests, width).filter(F.size("__gw_spans") == 0).select(*docs.columns)


AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS bid, coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT bid, item, i AS j, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
       FROM (SELECT bid, item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT rid, dw.n AS n, i, item, bid, j FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
-- Windows in a row, of the text and of one item, are one match.
g AS (SELECT rid, max(n) AS n, count(*) AS steps FROM (SELECT rid, n, bid, i - j AS d, i - row_number() OVER (PARTITION BY rid, bid, i - j ORDER BY i) AS island FROM m) GROUP BY rid, bid, d, island),
l AS (SELECT rid, max(steps + n - 1) AS longest FROM g GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid) LEFT JOIN l USING (rid)
"""
