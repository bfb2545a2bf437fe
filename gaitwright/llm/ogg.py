"""Media columns in Ogg: write pages, verify them, rebuild packets, split streams, time them.

A media value holds two logical streams. Stream ``AUDIO`` carries the payload as 8-bit samples at
``RATE`` a second; its granule position counts samples. Stream ``INDEX`` carries the checksum of
each audio packet. Pages of the two alternate, so reading needs demultiplexing, and audio packets
run over page ends, so it needs lacing values.

Each value is made and read in one task from its own row; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_outputs

UNIT = 192
RATE = 8000
AUDIO, INDEX = 0x41554449, 0x494E4458
PACKET = 10 * UNIT
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 04C11DB7, most significant bit first, zero start and no final inversion.

    zlib's CRC is the mirrored one, so bytes and result are mirrored around it.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = page_checksum(head + lacing + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + lacing + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream. ``packets``: (bytes, granule position at its end); the first
    packet has the first page for itself."""
    segments = []  # (lacing value, bytes, granule if the packet ends here, first of its packet)
    pages, number = [], 0

    def close(flags: int) -> None:
        nonlocal segments, number
        ends = [g for _, _, g, _ in segments if g is not None]
        if segments and not segments[0][3]:
            flags |= CONTINUED
        pages.append(page(flags, ends[-1] if ends else -1, serial, number, bytes(s[0] for s in segments), b"".join(s[1] for s in segments)))
        segments, number = [], number + 1

    for k, (data, granule) in enumerate(packets):
        for at in range(0, len(data) + 1, 255):
            if len(segments) == 255:
                close(0)
            part = data[at : at + 255]
            segments.append((len(part), part, granule if len(part) < 255 else None, at == 0))
        if k == 0:
            close(FIRST | (LAST if len(packets) == 1 else 0))
    if segments:
        close(LAST)
    return pages


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def encode(data: bytes) -> bytes:
    payload = pad(data)
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min(i + PACKET, len(payload)) for i in range(0, len(payload), PACKET)]
    audio = [(b"gw-pcm-u8" + struct.pack("<IQ", RATE, len(data)), 0), *zip(parts, ends)]
    index = [(b"gw-crc", 0), *((struct.pack("<I", zlib.crc32(p)), e) for p, e in zip(parts, ends))]
    a, b = stream_pages(AUDIO, audio), stream_pages(INDEX, index)
    # First pages stand before all others, then the streams alternate.
    mixed = [a[0], b[0]]
    for i in range(1, max(len(a), len(b))):
        mixed += a[i : i + 1] + b[i : i + 1]
    return b"".join(mixed)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  #: of each packet's page if it is the page's last, else -1
    pages: int = 0
    part: bytes = b""
    ended: bool = False


def demultiplex(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number. Raises ValueError on a damaged page or a gap."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise ValueError("cut page header")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError("no page starts here")
        lacing = media[at + _HEAD.size : at + _HEAD.size + n]
        body = at + _HEAD.size + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError("cut page")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError("page checksum")
        if flags & FIRST:
            if serial in streams:
                raise ValueError("stream begins twice")
            streams[serial] = Stream()
        s = streams.get(serial)
        if s is None or s.ended or number != s.pages or bool(flags & CONTINUED) != (s.pages > 0 and s.part is not None and s.part != b""):
            raise ValueError("page out of order")
        s.pages += 1
        last = -1
        part = [s.part]
        for v in lacing:
            part.append(media[body : body + v])
            body += v
            if v < 255:
                s.packets.append(b"".join(part))
                s.granules.append(-1)
                part, last = [], len(s.packets) - 1
        s.part = b"".join(part)
        if last >= 0:
            s.granules[last] = granule
        s.ended = bool(flags & LAST)
        at = end
    for s in streams.values():
        if not s.ended or s.part:
            raise ValueError("stream does not end")
    return streams


def packet_ends(stream: Stream) -> list[int]:
    """Granule position at the end of each audio packet after the header.

    A page tells it for the last packet that ends on it; earlier packets of the page are counted
    back by their samples.
    """
    ends = [-1] * len(stream.packets)
    following = -1
    for i in range(len(ends) - 1, 0, -1):
        ends[i] = stream.granules[i] if stream.granules[i] >= 0 else following - len(stream.packets[i + 1])
        following = ends[i]
    return ends[1:]


def decode(media: bytes) -> tuple[int, bytes, dict[int, Stream]]:
    """(unpadded length, payload, streams) of a media value made by :func:`encode`."""
    streams = demultiplex(media)
    audio, index = streams[AUDIO], streams[INDEX]
    parts = audio.packets[1:]
    if [struct.pack("<I", zlib.crc32(p)) for p in parts] != index.packets[1:]:
        raise ValueError("packet checksum")
    rate, length = struct.unpack_from("<IQ", audio.packets[0], 9)
    if rate != RATE:
        raise ValueError("sample rate")
    return length, b"".join(parts), streams


def _encode(data: pd.Series) -> pd.Series:
    return data.map(encode)


_FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(media: pd.Series) -> pd.DataFrame:
    rows = []
    for m in media:
        n, payload, streams = decode(m)
        audio = streams[AUDIO]
        ends = packet_ends(audio)
        x = np.frombuffer(payload, np.uint8)
        level = x.astype(np.int16) - 128
        feature = " ".join([
            f"streams={len(streams)}", f"pages={sum(s.pages for s in streams.values())}", f"packets={len(audio.packets) - 1}",
            f"start_ms={(ends[0] - len(audio.packets[1])) * 1000 // RATE}", f"end_ms={ends[-1] * 1000 // RATE}",
            f"mean={level.mean():.6f}", f"rms={np.sqrt((level.astype(np.int32) ** 2).mean()):.6f}", f"peak={int(np.abs(level).max())}",
            f"turns={int(np.count_nonzero(np.diff(np.signbit(level))))}",
        ])
        rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
    return pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def add_media(df: DataFrame, text: Column, name: str = "media") -> DataFrame:
    """``df`` with the Ogg value of ``text``; null and empty texts give one unit of spaces."""
    return with_outputs(df, {name: F.pandas_udf(_encode, "binary")(F.coalesce(text.cast("binary"), F.lit(b"")))})


def add_media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with what reading ``media`` back gives. A damaged value fails the job with its reason."""
    read = df.withColumn("__gw_read", F.pandas_udf(_read, _FIELDS)(F.col(media)))
    return with_outputs(read, {f.split()[0]: F.col(f"__gw_read.{f.split()[0]}") for f in _FIELDS.split(", ")}).drop("__gw_read")
