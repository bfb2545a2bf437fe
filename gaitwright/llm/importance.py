"""Importance resampling towards a target distribution of hashed n-grams.

Documents and target texts are bags of runs of one to three words, hashed into buckets. A bucket's
gain is the scaled log ratio of its smoothed shares in target and corpus; a document's weight is the
sum over its runs, and a document is drawn by weight plus Gumbel noise that its id seeds, which
samples without replacement in proportion to the exponential of the weight.

Long texts are skew: one may hold as many words as thousands of others. A text is therefore cut at
word boundaries into chunks of ``CHUNK`` words, each followed by the ``n - 1`` words after it. A chunk
owns the runs that start in its own words, so every run is counted once and none is lost at a seam.
Chunks of long texts are dealt over all tasks; counts and weights are sums over chunks, by document.

What leaves a counting task is one row a bucket, whatever it has read. Hashes of runs come from the
hashes of their words: a CRC of two strings is a linear map of the first one's, xor the second's.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Batches, materialize, small_batches, tidy

BUCKETS = 10_000
RUNS = 3  #: words of the longest run
CHUNK = 4_096  #: words that a chunk owns
LONG = 1 << 15  #: bytes from which a text's chunks are dealt over all tasks
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or c >= 97 and c not in range(0x7B, 0x80) else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


# ---- hashes of runs ------------------------------------------------------------------------


def _shifts(most: int) -> np.ndarray:
    """For each count of bytes up to ``most`` the map of a CRC over that many zero bytes, by its four bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    out = np.empty((most + 1, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for k in range(most):
        out[k + 1] = (out[k] >> np.uint32(8)) ^ step[out[k] & 255]
    return out


_MOST = 64
_SHIFTS = _shifts(_MOST)
_SPACE = np.uint32(crc32(b" "))


def _shift(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    while True:
        k = np.minimum(size, _MOST)
        crc = _SHIFTS[k, 0, crc & 255] ^ _SHIFTS[k, 1, crc >> 8 & 255] ^ _SHIFTS[k, 2, crc >> 16 & 255] ^ _SHIFTS[k, 3, crc >> 24]
        size = size - k
        if not size.any():
            return crc


def run_buckets(words: list[bytes], own: int, buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """Buckets of the runs that start in the first ``own`` words: CRC-32 of the words joined by one space, modulo."""
    each = np.fromiter(map(crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    one = np.ones(len(words), np.int64)
    crc, out = each, [each[:own]]
    for k in range(1, min(runs, len(words))):
        crc = _shift(_shift(crc[:-1], one[k:]) ^ _SPACE, size[k:]) ^ each[k:]
        out.append(crc[:own])
    return (np.concatenate(out) % np.uint32(buckets)).astype(np.int64)


# ---- chunks --------------------------------------------------------------------------------

_CHUNKS = "doc_id {}, text_key binary, piece int, own int, words binary"


def _chunk(size: int, runs: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text").to_pylist()):
                words = words_of(text)
                key = xxhash.xxh3_128_digest((text or "").encode())
                pieces = range(0, max(1, len(words)), size)
                rows = [(i // size, min(size, len(words) - i), b" ".join(words[i : i + size + runs - 1])) for i in pieces]
                piece, own, held = zip(*rows)
                columns = [pa.array([doc_id.as_py()] * len(rows), batch.schema.field("doc_id").type), pa.array([key] * len(rows), pa.binary()), pa.array(piece, pa.int32()), pa.array(own, pa.int32()), pa.array(held, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "piece", "own", "words"])

    return run


def chunks(docs: DataFrame, size: int = CHUNK, runs: int = RUNS) -> DataFrame:
    """doc_id, text_key, piece, own and words (its own and up to ``runs - 1`` more) of every chunk of every
    text, dealt by a hash of text and piece. A text without words has one empty chunk."""
    kinds = _CHUNKS.format(docs.schema["doc_id"].dataType.simpleString())
    return docs.select("doc_id", "text").mapInArrow(tidy(_chunk(size, runs)), kinds).repartition("text_key", "piece")


def _short_and_long(texts: DataFrame, long: int) -> tuple[DataFrame, DataFrame]:
    is_long = F.coalesce(F.octet_length("text") > long, F.lit(False))
    return texts.filter(~is_long), texts.filter(is_long)


def _count(buckets: int, runs: int):
    def run(batches: Batches) -> Batches:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if "own" in batch.schema.names:
                pieces = ((x.split(), own) for x, own in zip(batch.column("words").to_pylist(), batch.column("own").to_pylist()))
            else:
                pieces = ((w, len(w)) for w in map(words_of, batch.column("text").to_pylist()))
            for words, own in pieces:
                if words:
                    total += np.bincount(run_buckets(words, own, buckets, runs), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, runs: int = RUNS, size: int = CHUNK, long: int = LONG) -> DataFrame:
    """bucket and n, the runs in it over all ``texts`` (doc_id, text), copies counted."""
    short, rest = _short_and_long(texts, long)
    parts = [part.mapInArrow(tidy(_count(buckets, runs)), "bucket int, n long") for part in (short.select("text"), chunks(rest, size, runs).select("own", "words"))]
    return parts[0].union(parts[1]).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))`` of each bucket; the driver gets one
    row a bucket of either side."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, out in ((corpus, s), (target, t)):
        rows = counts.toArrow()
        out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    whole_s, whole_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * whole_s / ((float(a) + 1) * whole_t))) for a, b in zip(s, t)], np.int64)


def _weigh(gain: Broadcast, runs: int, chunked: bool):
    def run(batches: Batches) -> Batches:
        own_gain = gain.value
        for batch in batches:
            if chunked:
                pieces = [(x.split(), own) for x, own in zip(batch.column("words").to_pylist(), batch.column("own").to_pylist())]
            else:
                pieces = ((w, len(w)) for w in map(words_of, batch.column("text").to_pylist()))
            n_words, features, weight = [], [], []
            for words, own in pieces:
                found = own_gain[run_buckets(words, own, len(own_gain), runs)] if words else ()
                n_words.append(own), features.append(len(found)), weight.append(int(np.sum(found)))
            made = [pa.array(c, pa.int64()) for c in (n_words, features, weight)]
            names = ["doc_id", "text_key", "piece"] if chunked else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], [*names, "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, gain: np.ndarray, runs: int = RUNS, size: int = CHUNK, long: int = LONG) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of ``docs``.

    The chunks of a long text are summed by id and text; rows that repeat both come back as many times.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    short, rest = _short_and_long(docs.select("doc_id", "text"), long)
    whole = short.mapInArrow(tidy(_weigh(shared, runs, False)), f"doc_id {kind}, n_words long, n_features long, weight long")
    pieces = chunks(rest, size, runs).mapInArrow(tidy(_weigh(shared, runs, True)), f"doc_id {kind}, text_key binary, piece int, n_words long, n_features long, weight long")
    rows = F.count(F.when(F.col("piece") == 0, 1))
    summed = pieces.groupBy("doc_id", "text_key").agg(rows.alias("rows"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    each = summed.select("doc_id", *(F.expr(f"{c} div rows").alias(c) for c in ("n_words", "n_features", "weight")), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row"))
    return whole.union(each.drop("row"))


def noise(key: Column, seed: int) -> Column:
    """Scaled Gumbel noise of a document, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, runs: int = RUNS, size: int = CHUNK, long: int = LONG) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text), drawn towards
    the texts of ``target`` (text).

    Of the documents of ``least_words`` words or more ``percent`` in 100 (rounded down) are drawn, the highest scores
    first, ties by lesser id, null ids last; the others have a null rank. A null or empty text has no run and
    weight 0. Rows that repeat are documents of their own. Empty tables give no rows, an empty target is
    flat. Other columns of either table are ignored.
    """
    small_batches(docs.sparkSession)
    corpus = docs.select("doc_id", "text")
    gain = gains(bucket_counts(corpus, buckets, runs, size, long), bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), buckets, runs, size, long), buckets)
    weighed = weigh(corpus, gain, runs, size, long)
    eligible = F.col("n_words") >= least_words
    scored = materialize(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), eligible.alias("eligible")), "scores")
    return ranked(scored, percent).select("doc_id", "n_features", "weight", "score", "rank")


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """``scored`` (a table; doc_id, score, eligible) with rank, null for what is not drawn.

    Rows are cut into ranges of the order, each numbered for itself and moved on by the rows of the
    ranges before it. Equal rows may lie in several ranges: a hash of the row's place ends every tie.
    """
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__gw_tie")]
    tied = scored.withColumn("__gw_tie", F.xxhash64(F.monotonically_increasing_id()))
    placed = materialize(tied.repartitionByRange(*order).withColumn("__gw_range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("__gw_range").agg(F.count("*").alias("n"), F.count(F.when(F.col("eligible"), 1)).alias("e"))
    before = W.orderBy("__gw_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    whole = F.sum("e").over(W.partitionBy())
    starts = counts.select("__gw_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__gw_before"), F.floor(whole * percent / 100).alias("__gw_drawn"))
    place = F.row_number().over(W.partitionBy("__gw_range").orderBy(*order)) + F.col("__gw_before")
    numbered = placed.join(F.broadcast(starts), "__gw_range").withColumn("__gw_place", place)
    drawn = F.col("eligible") & (F.col("__gw_place") <= F.col("__gw_drawn"))
    return numbered.withColumn("rank", F.when(drawn, F.col("__gw_place")).cast("long"))


RESAMPLE_SQL = r"""
WITH RECURSIVE
hexes AS (SELECT i::INT AS b, format('{:02X}', i) AS x FROM range(256) r(i)),
step(b, c, k) AS (
  SELECT i::INT, i::BIGINT, 0 FROM range(256) r(i) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
table0 AS (SELECT b, c FROM step WHERE k = 8),
w AS (
  SELECT kind, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 's' AS kind, doc_id, coalesce(text, '') AS text FROM documents
        UNION ALL SELECT 't', NULL, coalesce(text, '') FROM benchmark)),
f AS (
  SELECT kind, doc_id, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i])) AS f FROM w UNION ALL
  SELECT kind, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w UNION ALL
  SELECT kind, doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
d AS (SELECT f, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t, hex(encode(f)) AS x, octet_length(encode(f)) AS n FROM f GROUP BY f),
zeros(k, b, c) AS (
  SELECT 0, b, c FROM table0 UNION ALL
  SELECT z.k + 1, z.b, xor(z.c >> 8, t.c) FROM zeros z JOIN table0 t ON t.b = z.c & 255 WHERE z.k < (SELECT max(n) FROM d)),
init(k, c) AS (
  SELECT 0, 4294967295::BIGINT UNION ALL
  SELECT i.k + 1, xor(i.c >> 8, t.c) FROM init i JOIN table0 t ON t.b = i.c & 255 WHERE i.k < (SELECT max(n) FROM d)),
bytes AS (SELECT f, n, substr(x, (2 * i + 1)::BIGINT, 2) AS x, n - 1 - i AS k FROM d, range(0, n) r(i)),
c AS (SELECT f, n, bit_xor(z.c) AS c FROM bytes y JOIN hexes h USING (x) JOIN zeros z ON z.k = y.k AND z.b = h.b GROUP BY f, n),
b AS (SELECT c.f, xor(xor(c.c, i.c), 4294967295) % 10000 AS bucket FROM c JOIN init i ON i.k = c.n),
g AS (SELECT bucket, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM b JOIN d USING (f) GROUP BY bucket),
q AS (SELECT sum(s)::DOUBLE + 10000 AS s, sum(t)::DOUBLE + 10000 AS t FROM g),
gain AS (SELECT bucket, floor(1000 * ln((g.t::DOUBLE + 1) * q.s / ((g.s::DOUBLE + 1) * q.t)))::BIGINT AS gain FROM g, q),
per AS (SELECT f.doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN b USING (f) JOIN gain USING (bucket) WHERE kind = 's' GROUP BY f.doc_id),
sc AS (
  SELECT w.doc_id, len(w.w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || CAST(w.doc_id AS VARCHAR)), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN per USING (doc_id) WHERE w.kind = 's'),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, sum((words >= 20)::INT) OVER () AS whole FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= floor(5 * whole / 100) THEN place END AS rank
FROM r
"""
