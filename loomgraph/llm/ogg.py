"""Media columns in Ogg: write payloads as 8-bit samples in two logical streams, and read pages, packets and timestamps back.

A stored form holds two interleaved logical streams. Blocks of ``PACKET`` samples go to them in turn,
one packet each; a stream begins with a header packet on a page of its own, and each page's granule
position counts the samples of its stream up to the last packet that ends on it.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, map_bytes, slices, whole_texts

UNIT = 192  # a payload is padded to a positive multiple of this
PACKET = 20 * UNIT  # samples in a packet
SEGMENTS = 64  # lacing values on a page at most (the format allows 255)
RATE = 8000  # samples a second of each stream
SERIALS = (1, 2)
CONTINUED, BOS, EOS = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
MAGIC = b"\x7fPCM8"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """The format's checksum (polynomial 04c11db7, high bit first, from zero) through zlib's, which runs low bit first."""
    low = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(_REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def stream_pages(packets: list[bytes], serial: int, segments: int = SEGMENTS) -> list[bytes]:
    """The pages of one logical stream; its first packet is the header."""
    pages = [page(BOS if len(packets) > 1 else BOS | EOS, 0, serial, 0, bytes([len(packets[0])]), packets[0])]
    lacing, ends, done = bytearray(), {}, 0
    for p in packets[1:]:
        lacing += b"\xff" * (len(p) // 255)
        lacing.append(len(p) % 255)
        done += len(p)
        ends[len(lacing) - 1] = done
    body, at, open_packet = b"".join(packets[1:]), 0, False
    for first in range(0, len(lacing), segments):
        part = bytes(lacing[first : first + segments])
        granule = next((ends[i] for i in range(first + len(part) - 1, first - 1, -1) if i in ends), -1)
        flags = CONTINUED * open_packet | EOS * (first + len(part) == len(lacing))
        size = sum(part)
        pages.append(page(flags, granule, serial, len(pages), part, body[at : at + size]))
        at, open_packet = at + size, part[-1] == 255
    return pages


def encode(payload: bytes, packet: int = PACKET, segments: int = SEGMENTS) -> bytes:
    """The stored form of a payload."""
    blocks = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    streams = []
    for k, serial in enumerate(SERIALS):
        header = MAGIC + struct.pack("<BIBB", 1, RATE, k, len(SERIALS))
        streams.append(stream_pages([header, *blocks[k :: len(SERIALS)]], serial, segments))
    longest = max(map(len, streams))
    return b"".join(s[i] for i in range(longest) for s in streams if i < len(s))


def pages_of(media: bytes):
    """Each page as (serial, number, flags, granule, lacing, body, whether the checksum holds); damage is skipped up to the next page."""
    at = media.find(b"OggS")
    while at >= 0:
        nxt = -1
        if at + 27 <= len(media):
            _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
            lacing = media[at + 27 : at + 27 + n]
            end = at + 27 + n + sum(lacing)
            if len(lacing) == n and end <= len(media):
                body = media[at + 27 + n : end]
                good = version == 0 and page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) == crc
                yield serial, number, flags, granule, lacing, body, good
                nxt = end if good else -1
        at = media.find(b"OggS", nxt if nxt > 0 else at + 4)


def packets_of(media: bytes) -> dict[int, list[tuple[bytes, int, int]]]:
    """For each logical stream its whole packets as (data, granule at the end of their page or -1, page number).

    Pages with a wrong checksum are left out; a packet that reaches over a missing page is lost.
    """
    streams: dict[int, list] = {}
    state: dict[int, tuple[int, list[bytes] | None]] = {}
    for serial, number, flags, granule, lacing, body, good in pages_of(media):
        if not good:
            continue
        out = streams.setdefault(serial, [])
        expected, held = state.get(serial, (0, None))
        if number != expected:
            held = None
        if not flags & CONTINUED:
            held = []
        at = size = 0
        last = max((i for i, x in enumerate(lacing) if x < 255), default=-1)
        for i, x in enumerate(lacing):
            size += x
            if x < 255:
                if held is not None:
                    out.append((b"".join([*held, body[at : at + size]]), granule if i == last else -1, number))
                held, at, size = [], at + size, 0
        if size and held is not None:
            held.append(body[at : at + size])
        state[serial] = (number + 1, held)
    return streams


def timed_packets(media: bytes):
    """(serial, packet number, data, start and end in seconds) of each data packet; times come from granule positions, counted back from the page's last packet."""
    for serial, packets in sorted(packets_of(media).items()):
        if not packets or not packets[0][0].startswith(MAGIC):
            continue
        rate = struct.unpack_from("<I", packets[0][0], len(MAGIC) + 1)[0]
        ends, known = [0] * len(packets), None
        for i in range(len(packets) - 1, 0, -1):
            if packets[i][1] >= 0:
                known = packets[i][1]
            elif known is not None:
                known -= len(packets[i + 1][0])
            ends[i] = known if known is not None else -1
        for i in range(1, len(packets)):
            end = ends[i]
            yield serial, i - 1, packets[i][0], (end - len(packets[i][0])) / rate, end / rate


def decode(media: bytes) -> tuple[bytes, float]:
    """The payload, and the seconds that it lasts; packets of the streams follow each other in turn."""
    rows = sorted(timed_packets(media), key=lambda x: (x[1], x[0]))
    return b"".join(x[2] for x in rows), max((x[4] for x in rows), default=0.0)


def features(media: bytes) -> tuple[bytes, str]:
    """The payload, and what its samples look like: page and packet counts, seconds, loudness, zero crossings and the mean magnitude of four bands of a spectrum over blocks."""
    payload, seconds = decode(media)
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    power = int((x.astype(np.int64) ** 2).sum())
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    blocks = x[: len(x) // UNIT * UNIT].reshape(-1, UNIT)
    half = blocks[:, ::2] + blocks[:, 1::2]
    bands = [int(np.abs(half).sum()), int(np.abs(blocks[:, ::2] - blocks[:, 1::2]).sum())]
    text = f"seconds={seconds:.6f};rms={math.sqrt(power / max(1, len(x))):.4f};crossings={crossings};low={bands[0]};high={bands[1]}"
    return payload, text


def payload_of(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def ogg_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text, padded with spaces to a positive multiple of 192 bytes, in its stored form.

    A null or empty text gives 192 spaces; repeated rows give repeated results; an empty table an empty one.
    """

    def make():
        return lambda ids, texts: [ids, [len(t) for t in texts], [encode(payload_of(t)) for t in texts]]

    return map_bytes(whole_texts(df, id_col, text_col), make, "doc_id long, n_bytes long, media binary", [pa.int64(), pa.int64(), pa.binary()])


def _map_media(df: DataFrame, rows_of, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                found = [(i, *row) for i, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for row in rows_of(m or b"")]
                yield pa.RecordBatch.from_pydict({n: [r[k] for r in found] for k, n in enumerate(names)}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def ogg_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each page found in a media column; null media has none."""
    rows = lambda m: [(s, n, f, g, len(lac), len(b), ok) for s, n, f, g, lac, b, ok in pages_of(m)]
    return _map_media(df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")), rows, "doc_id long, serial long, page_no long, flags int, granule long, segments int, body_bytes int, crc_ok boolean")


def ogg_packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each whole data packet of each logical stream, with its times."""
    return _map_media(df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")), timed_packets, "doc_id long, serial long, packet_no long, data binary, start_s double, end_s double")


def ogg_digest(media: DataFrame) -> DataFrame:
    """Read the stored bytes of (doc_id, n_bytes, media) back; digests of what was read, and its features. Null media has nulls."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                ids, sizes, stored = (part.column(i).to_pylist() for i in range(3))
                rows = []
                for m in stored:
                    payload, told = (None, None) if m is None else features(m)
                    rows.append((None,) * 6 if m is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), told))
                columns = [ids, sizes, *([r[k] for r in rows] for k in range(6))]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]
    return media.mapInArrow(run, schema)


def op1_ogg_media(spark, sf_dir):
    return ogg_digest(ogg_encode(documents(spark, sf_dir)))


QUERIES = {"op1_ogg_media": op1_ogg_media}
ORACLES: dict[str, str] = {}
