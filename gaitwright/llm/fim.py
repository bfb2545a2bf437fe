"""Fill-in-the-middle: texts cut at seeded unit boundaries and written with their middle last.

Boundaries depend on the text alone, cuts on the document. So equal texts are grouped first, the
boundary list of a distinct text is made once, as an Elias-Fano list in a written index, and
documents join the index and select the two boundaries that their seed asks for.

Texts are grouped by a content key (SHA-256) and then by their content, byte by byte. Index rows of
texts that share a key carry the text, and only the document with that very text takes them, so a
weak key costs time and changes no result. A task sends a text once, whatever the number of its
copies there; the join back may be split by Spark at a text that very many documents have, as
documents and index are plain sides of it.

Texts travel compressed. Neither a list nor a text is ever gathered over documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Batches, materialize, small_batches, tidy

LINE = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")  #: before prefix, suffix and middle
MET_BYTES = 32 << 20  #: of texts that a task remembers to have sent
OUT_BYTES = 8 << 20  #: of texts in an outgoing batch
_ONES = np.array([i.bit_count() for i in range(256)], np.uint8)


# ---- Elias-Fano lists ----------------------------------------------------------------------


def boundaries(text: str, unit: str = LINE) -> np.ndarray:
    """Ends of the units of a text, in code points. What a pattern leaves out goes to the unit after
    it, at the end of the text to a unit of its own."""
    ends = [m.end() for m in re.finditer(unit, text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.array(ends, np.int64)


def ef_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """(low bits of a value, all low bits, high parts in unary) of ascending values."""
    n = len(values)
    if not n:
        return 0, b"", b""
    width = max(0, int(values[-1] // n).bit_length() - 1)
    low = (values[:, None] >> np.arange(width)) & 1
    high = np.zeros(n + int(values[-1] >> width) + 1, np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    return width, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


def ef_select(width: int, low: bytes, high: bytes, k: int) -> int:
    """Value ``k`` of the list, from 0 on."""
    own = np.frombuffer(high, np.uint8)
    upto = np.cumsum(_ONES[own], dtype=np.int64)
    byte = int(np.searchsorted(upto, k + 1))
    left = k - (int(upto[byte - 1]) if byte else 0)
    bits = int(own[byte])
    for _ in range(left):
        bits &= bits - 1
    at = byte * 8 + (bits & -bits).bit_length() - 1
    first = k * width
    window = int.from_bytes(low[first >> 3 : (first + width + 7 >> 3) + 1], "little") >> (first & 7)
    return (at - k) << width | window & ((1 << width) - 1)


# ---- one document --------------------------------------------------------------------------


def draw(key: str, seed: int, n: int) -> tuple[int, int, int, int]:
    """(units of the prefix, units up to the end of the middle, percent for the transformation,
    percent for the order) of a document."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return a, b, h[2] % 100, h[3] % 100


def compose(form: str, prefix: str, middle: str, suffix: str, marks: Sequence[str] = MARKS) -> str:
    p, s, m = marks
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def rebuild(output: str, form: str, marks: Sequence[str] = MARKS) -> str:
    """The text of an output. No mark is in the text and no mark's start is also a mark's end, so the
    first place of each mark is its own."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    a, _, rest = output[len(first) :].partition(second)
    b, _, middle = rest.partition(m)
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return prefix + middle + suffix


# ---- on frames -----------------------------------------------------------------------------


def content_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _send_once(batches: Batches) -> Batches:
    """(key, packed) of texts that this task has not just sent."""
    pack, met, held = zstandard.ZstdCompressor(level=3), {}, 0
    for batch in batches:
        keys, packed = [], []
        for key, text in zip(batch.column("__gw_key").to_pylist(), batch.column("__gw_text").to_pylist()):
            x = pack.compress(text.encode())
            if met.get(key) == x:
                continue
            if held > MET_BYTES:
                met, held = {}, 0
            met[key], held = x, held + len(x)
            keys.append(key), packed.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["__gw_key", "__gw_packed"])


_INDEX = "__gw_key binary, __gw_twin binary, __gw_n long, __gw_width int, __gw_low binary, __gw_high binary"


def _make_lists(unit: str):
    def run(batches: Batches) -> Batches:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            lists = []
            for x in batch.column("__gw_packed").to_pylist():
                ends = boundaries(unpack.decompress(x).decode(), unit)
                lists.append((len(ends), *ef_encode(ends)))
            n, width, low, high = zip(*lists) if lists else ((), (), (), ())
            twins = [x if several > 1 else None for x, several in zip(batch.column("__gw_packed").to_pylist(), batch.column("__gw_several").to_pylist())]
            columns = [batch.column("__gw_key"), pa.array(twins, pa.binary()), pa.array(n, pa.int64()), pa.array(width, pa.int32()), pa.array(low, pa.binary()), pa.array(high, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _INDEX.split(", ")])

    return run


def boundary_index(docs: DataFrame, text: str = "text", unit: str = LINE, key: Callable[[Column], Column] = content_key) -> DataFrame:
    """The written index: for each distinct text its content key, the count of its units and their
    ends as an Elias-Fano list. A null text counts as empty."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sent = docs.select(key(whole).alias("__gw_key"), whole.alias("__gw_text")).mapInArrow(tidy(_send_once), "__gw_key binary, __gw_packed binary")
    # One shuffle by key serves the grouping by content and the count of contents of a key.
    distinct = sent.repartition("__gw_key").groupBy("__gw_key", "__gw_packed").agg(F.lit(1).alias("__gw_one"))
    several = distinct.select("__gw_key", "__gw_packed", F.count("*").over(W.partitionBy("__gw_key")).alias("__gw_several"))
    return materialize(several.mapInArrow(tidy(_make_lists(unit)), _INDEX), "boundaries")


def _pack(batches: Batches) -> Batches:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at = batch.schema.get_field_index("__gw_text")
        packed = pa.array([pack.compress(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], packed], [*batch.schema.names[:at], "__gw_packed"])


def _cut(names: list[str], seed: int, percent: int, spm: int, marks: Sequence[str]):
    def run(batches: Batches) -> Batches:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            begin, held, rows = 0, 0, []
            seeds, packed, n, width, low, high = (batch.column(c).to_pylist() for c in ("__gw_seed", "__gw_packed", "__gw_n", "__gw_width", "__gw_low", "__gw_high"))
            for i in range(len(seeds)):
                text = unpack.decompress(packed[i]).decode()
                a, b, share, order = draw(seeds[i], seed, n[i])
                if not text or share >= percent or any(m in text for m in marks):
                    rows.append((n[i], "plain", None, None, text))
                else:
                    x, y = (ef_select(width[i], low[i], high[i], k - 1) if k else 0 for k in (a, b))
                    form = "spm" if order < spm else "psm"
                    rows.append((n[i], form, x, y - x, compose(form, text[:x], text[x:y], text[y:], marks)))
                held += len(rows[-1][4])
                if held > OUT_BYTES or i == len(seeds) - 1:
                    part = batch.slice(begin, len(rows))
                    made = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], [*names, "n", "form", "prefix_chars", "middle_chars", "output"])
                    begin, held, rows = i + 1, 0, []

    return run


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, percent: int = 100, spm: int = 50, unit: str = LINE, marks: Sequence[str] = MARKS, content: Callable[[Column], Column] = content_key) -> DataFrame:
    """All rows of ``docs`` without ``text``, with n (units), form (plain, psm or spm), prefix_chars and
    middle_chars (code points; null if plain) and output.

    The prefix ends after the lesser, the middle after the greater of two boundaries drawn by a hash
    of ``seed`` and the row's key; ``percent`` of 100 rows are transformed, ``spm`` of 100 of those
    with the suffix first. A text that is null, empty or holds a mark stays plain; a null key hashes as
    an empty one. Rows that repeat are cut alike, each for itself. Columns named like an output are replaced.
    """
    small_batches(docs.sparkSession)
    index = boundary_index(docs, text, unit, content)
    made = {"n", "form", "prefix_chars", "middle_chars", "output", text.lower()}
    names = [c for c in docs.columns if c.lower() not in made]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(*(F.col(f"`{c}`") for c in names), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("__gw_seed"), content(whole).alias("__gw_key"), whole.alias("__gw_text"))
    kinds = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields}
    packed = own.mapInArrow(tidy(_pack), ", ".join(kinds[c] for c in own.columns[:-1]) + ", __gw_packed binary")
    found = packed.join(index, "__gw_key").filter(F.col("__gw_twin").isNull() | (F.col("__gw_twin") == F.col("__gw_packed")))
    out = ", ".join([*(kinds[c] for c in names), "n long, form string, prefix_chars long, middle_chars long, output string"])
    return found.select(*names, "__gw_seed", "__gw_packed", "__gw_n", "__gw_width", "__gw_low", "__gw_high").mapInArrow(tidy(_cut(names, seed, percent, spm, marks)), out)


def restore(df: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """``df`` with ``restored``, the text rebuilt from output and form."""
    names = [c for c in df.columns if c.lower() != "restored"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [rebuild(o, f, marks) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "restored"])

    kinds = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields}
    return df.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(tidy(run), ", ".join([*(kinds[c] for c in names), "restored string"]))


FIM_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT doc_id, x, regexp_extract_all(x, '[^\n]*\n|[^\n]+') AS lines,
             CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(lines)::BIGINT AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
             greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
             CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, x, n, form, coalesce(array_to_string(list_slice(lines, 1, a), ''), '') AS pre,
             coalesce(array_to_string(list_slice(lines, a + 1, b), ''), '') AS mid,
             coalesce(array_to_string(list_slice(lines, b + 1, n), ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN x ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
