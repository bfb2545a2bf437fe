"""Ogg values and rANS blocks: exact round trips, checksums, edge cases."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaitwright.llm import ogg, rans

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000))
def test_ogg_round_trip(data):
    n, payload, streams = ogg.decode(ogg.encode(data))
    assert n == len(data) and payload.startswith(data) and len(payload) % 192 == 0 and payload[n:].strip(b" ") == b""
    assert ogg.packet_ends(streams[ogg.AUDIO])[-1] == len(payload)


def test_ogg_long_value_and_damage():
    data = bytes(range(256)) * 4000
    media = ogg.encode(data)
    assert ogg.decode(media)[1][: len(data)] == data
    for at in (30, len(media) // 2, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            ogg.decode(bytes(broken))
    with pytest.raises(ValueError):
        ogg.decode(media[:-10])


def test_page_checksum_bit_by_bit():
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc & 1 << 31 else 0)) & 0xFFFFFFFF
        return crc

    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.page_checksum(data) == slow(data)


def test_ogg_query_fields(spark, odd_documents, no_documents):
    docs = odd_documents.select("doc_id", "text")
    got = ogg.add_media_features(ogg.add_media(docs, F.col("text"))).collect()
    assert len(got) == docs.count()
    for r in got:
        data = (r.text or "").encode()
        padded = data + b" " * ((-len(data)) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-16:]) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    assert ogg.add_media_features(ogg.add_media(no_documents, F.col("text"))).count() == 0


def brute_tokens(rows):
    """Rows in order; ``rows`` holds (key, text, hash of the text)."""
    tok, start, out = Tokenizer.from_file(TOKENIZER), 0, []
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_tokens_equal_the_library(spark, documents):
    got = [tuple(r) for r in rans.token_index(documents, TOKENIZER).orderBy("doc_id").collect()]
    assert got == brute_tokens([tuple(r) for r in documents.select("doc_id", "text", F.xxhash64("text")).collect()])


def test_tokens_of_odd_rows(spark, odd_documents, no_documents):
    more = spark.createDataFrame([(20, "<|endoftext|> it's <|startoftext|>x"), (21, "ÀÉ straße ǅ İ ﬁ   a​b 12 3½"), (22, "don't we'll I'm x\u0085y"), (23, "é a퟿")], "doc_id long, text string")
    docs = odd_documents.select("doc_id", "text").unionByName(more)
    docs = docs.unionByName(spark.createDataFrame([(20, "another text of one key"), (20, "and a third"), (None, "a second one without a key")], "doc_id long, text string"))
    got = sorted((tuple(r) for r in rans.token_index(docs, TOKENIZER).collect()), key=lambda r: r[1])
    assert got == brute_tokens([tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()])
    assert rans.token_index(no_documents, TOKENIZER).count() == 0


def test_files_are_enough_to_decode(spark, documents):
    docs = documents.limit(40)
    folder = rans.write_tokens(docs, TOKENIZER)
    table = rans.Table(rans.read_table(spark, folder))
    want = {r[0]: r for r in brute_tokens([tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()])}
    for r in spark.read.parquet(f"{folder}/blocks").collect():
        ids, lengths = rans.decode_block(r.data, table)
        for key, n, part in zip(r.doc_ids, lengths, np.split(ids, np.cumsum(lengths)[:-1])):
            assert (n, zlib.crc32(part.astype("<u4").tobytes())) == want[key][2:]
    spark.createDataFrame([(1, 1 << 20)], "id long, freq long").write.mode("overwrite").parquet(f"{folder}/table")
    with pytest.raises(ValueError):
        rans.read_table(spark, folder)


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Don't split  here: it's 12 o'clock\n\n ok"
    assert np.frombuffer(rans.Encoder(path).encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=400), max_size=6), st.integers(1, 3))
def test_block_round_trip(docs, times):
    ids = np.array([i for d in docs for i in d] * times, np.int64)
    table = rans.Table(rans.quantize(np.bincount(ids, minlength=301)))
    block = rans.encode_block(ids, [len(d) for d in docs] * times, table)
    back, lengths = rans.decode_block(block, table)
    assert back.tolist() == ids.tolist() and lengths.tolist() == [len(d) for d in docs] * times


def test_parts_decode_alone_and_damage_is_found():
    r = np.random.default_rng(1)
    ids = r.zipf(1.4, rans.LANES * (3 * rans.CHECK + 5) + 17) % 5000
    table = rans.Table(rans.quantize(np.bincount(ids, minlength=5000)))
    block = rans.encode_block(ids, [len(ids)], table)
    parts = [rans.decode_block(block, table, range(i, i + 1))[0] for i in range(4)]
    assert (np.sum(parts, axis=0) == ids).all()
    broken = bytearray(block)
    broken[len(block) // 2] ^= 4
    with pytest.raises(ValueError):
        rans.decode_block(bytes(broken), table)


def test_frequencies_add_up():
    for counts in ([1], [1, 0, 10**9], list(range(1, 40_000)), [1] * 60_000 + [10**7]):
        f = rans.quantize(np.array(counts))
        assert f.sum() == 1 << rans.BITS and ((f > 0) == (np.array(counts) > 0)).all()


def test_batches_of_texts_are_cut_into_words_and_looked_up_once(monkeypatch):
    r = random.Random(8)
    parts = ["Word", "word", "É", "ß", "'s", "'S", "7", "½", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", " ", "\n", "\t", "\r", "é", "日本", "İ", "ſ", "<|endoftext|>", "<|", "\x00", "x" * 70, "Tail"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(400)] + [None, "", "   "]
    enc = rans.Encoder(TOKENIZER)
    asked = []
    monkeypatch.setattr(enc, "_words", lambda words, own=enc._words: asked.extend(words) or own(words))
    ids, n = enc.encode_all(pa.array(texts, pa.string()))
    assert len(asked) == len(set(asked)) and np.split(ids, np.cumsum(n)[:-1])[5].tolist() == enc.tokenizer.encode(texts[5], add_special_tokens=False).ids
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(rans, "_CACHE", 3), monkeypatch.setattr(rans, "_KEPT", 2)
    assert enc.encode_all(pa.array(texts, pa.string()))[0].tolist() == ids.tolist()  # what is remembered changes no result
