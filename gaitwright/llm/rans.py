"""Token-id output coded with a static range asymmetric numeral system.

All blocks share one frequency table made from every id of the corpus. It is written beside them,
with a manifest that holds its checksum and the coder's parameters, so a folder of token files can
be decoded by anyone who has just the folder. A block holds the ids of
whole documents, dealt in turn to ``LANES`` interleaved coders, so that one NumPy step codes an id
in each lane. Every ``CHECK`` steps a checkpoint keeps the coders' states and the place in the
stream: decoding can start there, and pieces of a block can be decoded side by side. A block
carries checksums of its stream and of its ids and depends on no other block.

Documents are tokenised once and their ids written, packed, to the shared folder. Those rows are
ranged by key, so that ranges stand in ascending order, and each task writes the blocks of its
range. The driver sees the id counts (as many as the vocabulary has) and one number per range.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir, small_batches, tidy

BITS = 20  #: frequencies add up to 1 << BITS
LOW = 1 << 31  #: states stay in [LOW, LOW << 32)
LANES = 1024
CHECK = 256  #: steps between checkpoints
BLOCK = LANES * 512  #: ids after which a block closes at the end of a document
END_ID = 2
_HEAD = struct.Struct("<4sHHIIIIII")  # magic, version, lanes, ids, documents, checkpoints, stream words, stream checksum, ids checksum


# ---- frequency table -------------------------------------------------------------------------


def quantize(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to ``1 << BITS``, at least 1 for every id that occurs."""
    used = np.flatnonzero(counts)
    freq = np.zeros(len(counts), np.int64)
    if not len(used):
        return freq
    share = counts[used].astype(float)
    f = np.maximum(1, np.floor(share / share.sum() * (1 << BITS)).astype(np.int64))
    spare = (1 << BITS) - int(f.sum())
    order = np.argsort(-f, kind="stable")
    while spare:  # the commonest ids take what rounding left or added
        step = np.zeros(len(f), np.int64)
        if spare > 0:
            step[order[0]] = spare
        else:
            step = -np.minimum(f - 1, -(-(-spare) * f // int(f.sum())))
            over = int(step.sum()) - spare
            for i in order[::-1]:
                if over >= 0:
                    break
                back = min(-over, -int(step[i]))
                step[i] += back
                over += back
        f += step
        spare -= int(step.sum())
    freq[used] = f
    return freq


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self._ids: np.ndarray | None = None

    @property
    def ids(self) -> np.ndarray:
        """The id of each slot."""
        if self._ids is None:
            self._ids = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._ids


# ---- blocks ----------------------------------------------------------------------------------


def encode_block(ids: np.ndarray, lengths: list[int], table: Table) -> bytes:
    """The ids of documents with these lengths as one block."""
    n, lanes = len(ids), min(LANES, max(1, len(ids)))
    steps = -(-n // lanes)
    freq, start = table.freq[ids], table.start[ids]
    x = np.full(lanes, LOW, np.uint64)
    out, written, marks = [], 0, []
    limit, low, high = np.uint64(63 - BITS), np.uint64(0xFFFFFFFF), np.uint64(32)
    for s in range(steps - 1, -1, -1):
        f, c = freq[s * lanes : (s + 1) * lanes], start[s * lanes : (s + 1) * lanes]
        y = x[: len(f)]
        full = y >= (f << limit)
        if full.any():
            out.append((y[full] & low).astype("<u4"))
            written += len(out[-1])
            y = np.where(full, y >> high, y)
        q = y // f
        x[: len(f)] = (q << np.uint64(BITS)) + (y - q * f) + c
        if s and s % CHECK == 0:
            marks.append((s, written, x.astype("<u8").tobytes()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    marks.append((0, written, x.astype("<u8").tobytes()))
    points = b"".join(struct.pack("<II", s, written - w) + state for s, w, state in reversed(marks))
    stream = words.tobytes()
    body = np.array(lengths, "<u4").tobytes() + points + stream
    return _HEAD.pack(b"GWRA", 1, lanes, n, len(lengths), len(marks), len(words), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def _decode_part(x: np.ndarray, words: np.ndarray, at: int, first: int, end: int, n: int, lanes: int, table: Table, out: np.ndarray) -> None:
    mask, bits, high = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    for s in range(first, end):
        k = min(lanes, n - s * lanes)
        y = x[:k]
        slot = y & mask
        sym = table.ids[slot]
        out[s * lanes : s * lanes + k] = sym
        y = table.freq[sym] * (y >> bits) + slot - table.start[sym]
        low = np.flatnonzero(y < LOW)
        if len(low):
            y[low] = (y[low] << high) | words[at : at + len(low)]
            at += len(low)
        x[:k] = y


def decode_block(block: bytes, table: Table, parts: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths of its documents). ``parts``: checkpoints to decode, all if None; other ids stay 0.

    Raises ValueError when a checksum does not hold.
    """
    magic, version, lanes, n, docs, points, n_words, crc, ids_crc = _HEAD.unpack_from(block)
    if magic != b"GWRA" or version != 1 or zlib.crc32(block[_HEAD.size :]) != crc:
        raise ValueError("damaged block")
    lengths = np.frombuffer(block, "<u4", docs, _HEAD.size)
    at = _HEAD.size + 4 * docs
    marks = []
    for _ in range(points):
        marks.append((*struct.unpack_from("<II", block, at), np.frombuffer(block, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    words = np.frombuffer(block, "<u4", n_words, at).astype(np.uint64)
    steps, out = -(-n // lanes), np.zeros(n, np.uint32)
    for i in range(points) if parts is None else parts:
        first, word, state = marks[i]
        _decode_part(state.astype(np.uint64), words, word, first, marks[i + 1][0] if i + 1 < points else steps, n, lanes, table, out)
    if parts is None and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("ids checksum")
    return out, lengths


# ---- tokens ----------------------------------------------------------------------------------

#: Words with more than printable ASCII and composed Latin-1 letters are left to the library:
#: for these characters lower case and splitting need no other rules.
_ODD = re.compile(r"[^ -~\n\r\tÀ-ÖØ-öø-ÿ]")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^ \n\r\ta-z0-9à-öø-ÿß]+")
_CACHE, _KEPT = 600_000, 300_000  #: pieces that a worker remembers (some 130 bytes each), and how many of the first it keeps when full
_LONGEST = 64  #: characters of pieces that are remembered
_GROUP = 8 << 20  #: bytes of texts that are cut into words at once
#: The rules that plain texts are cut by; a tokenizer file with others gets whole texts.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
_LE4 = [struct.Struct(f"<{n}I").pack for n in range(16)]


class _Pieces(dict):
    """Ids of the pieces met so far; ``make`` tells those of others."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        found = self.make(piece)
        if len(piece) <= _LONGEST:
            self[piece] = found
        return found


class Encoder:
    """Ids of whole texts by the library, one call for each different piece.

    The tokenizer drops white space and codes each piece between its own word borders alone, so a
    text's ids are its words' ids in order. Words of plain characters are cut into pieces, which go to
    the library's model; odd words, or words with a special token, go to the library whole. A batch is
    cut into words by Arrow and each different word is looked up once. A tokenizer file of other rules
    than ``_RULES`` gets every text whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        told["model"] = {k: v for k, v in told["model"].items() if k not in ("vocab", "merges")}
        self.known_rules = all(told[k] == v for k, v in _RULES.items())
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A special token with white space inside would go over a word's border.
        self.by_word = self.known_rules and not any(re.search(r"\s", s) for s in self.specials)
        self.pieces = _Pieces(self._piece)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))
        return _LE4[len(found)](*[t.id for t in found]) if len(found) < len(_LE4) else np.array([t.id for t in found], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if _ODD.search(word) or any(s in word for s in self.specials):
            return self._whole(word)
        return self._plain(word.lower())

    def _plain(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _SPLIT.findall(word)))

    def _words(self, words: list[str]) -> list[bytes]:
        together = " ".join(words)
        if _ODD.search(together) or any(s in together for s in self.specials):
            return [self._word(w) for w in words]
        return [self._plain(w) for w in together.lower().split(" ")]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each text) of texts, null ones empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            each = [self._whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(each), "<u4"), np.array([len(e) // 4 for e in each], np.int64)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        if len(self.pieces) > _CACHE:
            kept = list(islice(self.pieces.items(), _KEPT))
            self.pieces.clear()
            self.pieces.update(kept)
        own = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts, flat, at = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(own), "<u4"), coded.indices.to_numpy()
        n = sizes[at]
        ends = np.r_[0, np.cumsum(n)]
        place = np.repeat(starts[at] - ends[:-1], n)
        place += np.arange(ends[-1])
        return flat[place], np.diff(ends[np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder: its pieces stay known from task to task."""
    return Encoder(path)


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = _encoder(path), zstandard.ZstdCompressor(level=1)
        small = enc.tokenizer.get_vocab_size() <= 65536
        for group in _grouped(batches):
            ids, n = enc.encode_all(group.column("text").combine_chunks())
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, END_ID).astype("<u2" if small else "<u4")
            raw, ends = memoryview(ids.tobytes()), (ends + np.arange(1, len(n) + 1)) * ids.itemsize
            texts = (raw[b:e] for b, e in zip(np.r_[0, ends][:-1].tolist(), ends.tolist()))
            packed = pa.array([pack.compress(t if small else b"\1" + t) for t in texts], pa.binary())
            yield from group.drop_columns("text").append_column("packed", packed).combine_chunks().to_batches()

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together up to some ``_GROUP`` bytes of texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= _GROUP:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def unpack(packed: bytes) -> np.ndarray:
    """Packed ids: two bytes each, or after a leading byte four."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw, "<u2").astype(np.uint32) if len(raw) % 2 == 0 else np.frombuffer(raw, "<u4", offset=1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        ids = [unpack(p) for p in batch.column("packed").to_pylist()]
        c = np.bincount(np.concatenate(ids)) if ids else total[:0]
        if len(c) > len(total):
            total = np.r_[total, np.zeros(len(c) - len(total), np.int64)]
        total[: len(c)] += c
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


def _pack_blocks(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        part, keys, ids, total, before, number = -1, [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal keys, ids, total, before, number
            block = encode_block(np.concatenate(ids), [len(i) for i in ids], table)
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([total], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([block], pa.binary())]
            keys, ids, before, total, number = [], [], before + total, 0, number + 1
            return pa.RecordBatch.from_arrays(row, ["part", "block", "before", "n_ids", "doc_ids", "data"])

        for batch in batches:
            for p, key, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "packed"))):
                part = p
                keys.append(key)
                ids.append(unpack(packed))
                total += len(ids[-1])
                if total >= BLOCK:
                    yield close()
        if ids:
            yield close()

    return run


def _read_blocks(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for first, keys, data in zip(*(batch.column(c).to_pylist() for c in ("first", "doc_ids", "data"))):
                ids, lengths = decode_block(data, table)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, ranges: int | None = None) -> str:
    """Write the ids of every document, in ascending doc_id order; returns the folder of the files.

    ``blocks`` holds part, block, before (ids that precede it in its part), n_ids, doc_ids, data;
    ``table`` the frequency of each id; ``manifest`` one row with the coder's parameters and the
    table's checksum. Null texts are empty; every document ends with ``END_ID``. Keys are integers;
    null keys stand first, rows of one key in the order of their texts' hashes. An empty table gives
    no block. A task writes its blocks one by one, so its memory does not grow with its range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    tokens = materialize(keyed.mapInArrow(tidy(_tokenize(tokenizer)), "doc_id long, tie long, packed binary"), "tokens", "none")
    counts = tokens.select("packed").mapInArrow(tidy(_count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max((r.id for r in counts), default=0) + 1, np.int64)
    for r in counts:
        total[r.id] = r.n
    freq = quantize(total)
    ranges = ranges or max(1, min(20_000, int(total.sum()) // (4 * BLOCK)))
    ranged = tokens.repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select(F.spark_partition_id().alias("part"), "doc_id", "packed")
    blocks = ranged.mapInArrow(tidy(_pack_blocks(freq)), "part int, block long, before long, n_ids long, doc_ids array<long>, data binary")
    folder = f"{shared_dir(spark)}/gaitwright/token-files-{uuid.uuid4().hex}"
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    discard(tokens)
    table = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(table, "id long, freq long").coalesce(1).write.parquet(f"{folder}/table")
    manifest = [(1, BITS, LANES, CHECK, END_ID, len(freq), int(total.sum()), zlib.crc32(freq.astype("<i8").tobytes()))]
    spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


_MANIFEST = "version int, bits int, lanes int, check int, end_id int, vocabulary long, n_ids long, table_crc32 long"


def read_table(spark: SparkSession, folder: str) -> np.ndarray:
    """The shared frequencies of a folder of token files; as many numbers as the vocabulary has.

    Raises ValueError when they or the coder's parameters are not those of the manifest.
    """
    m = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").first()
    freq = np.zeros(m.vocabulary, np.int64)
    for r in spark.read.schema("id long, freq long").parquet(f"{folder}/table").collect():
        freq[r.id] = r.freq
    if (m.version, m.bits) != (1, BITS) or zlib.crc32(freq.astype("<i8").tobytes()) != m.table_crc32:
        raise ValueError("damaged or unknown token files")
    return freq


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files of ``folder`` alone.

    One task adds up the ids of the parts; it gets one row per part.
    """
    blocks = spark.read.schema("part int, block long, before long, n_ids long, doc_ids array<long>, data binary").parquet(f"{folder}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select(F.col("part"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    placed = blocks.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("before")).alias("first"), "doc_ids", "data")
    return placed.mapInArrow(tidy(_read_blocks(read_table(spark, folder))), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from token files written and read back."""
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer))
