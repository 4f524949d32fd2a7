import hashlib
import zlib

from loomgraph.llm import ogg


def test_digest(docs, rows, nothing):
    found = {r.doc_id: r for r in ogg.ogg_digest(ogg.ogg_encode(docs)).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    same = [r.media_sha256 for r in found.values() if r.payload_sha256 == found[rows[3][0]].payload_sha256]
    assert len(set(same)) == 1
    assert ogg.ogg_digest(ogg.ogg_encode(nothing)).count() == 0


def reference_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
    return crc


def test_checksum():
    for data in (b"", b"OggS", bytes(range(256))):
        assert ogg.page_crc(data) == reference_crc(data)


def test_round_trip_over_many_pages():
    for n in (192, 3840, 3840 * 2 + 192, 192 * 1000):
        p = bytes((i * 7 + i // 251) % 256 for i in range(n))
        media = ogg.encode(p, segments=8)
        assert ogg.decode(media)[0] == p
        times = list(ogg.timed_packets(media))
        for serial in (1, 2):
            own = [x for x in times if x[0] == serial]
            assert all(a[4] == b[3] for a, b in zip(own, own[1:], strict=False)) and (not own or own[0][3] == 0)


def test_damage_costs_only_its_packets():
    p = bytes(i % 251 for i in range(192 * 400))
    media = bytearray(ogg.encode(p, segments=16))
    at = media.find(b"OggS", len(media) // 2) + 60
    media[at] ^= 255
    pages = list(ogg.pages_of(bytes(media)))
    assert sum(not x[-1] for x in pages) == 1
    whole = {x[2] for x in ogg.timed_packets(ogg.encode(p, segments=16))}
    left = [x[2] for x in ogg.timed_packets(bytes(media))]
    assert 0 < len(left) < len(whole) and set(left) <= whole
    assert list(ogg.pages_of(b"junk" + ogg.encode(p[:192])))[0][-1]


def test_tables(spark, docs):
    media = ogg.ogg_encode(docs)
    pages = ogg.ogg_pages(media)
    assert pages.where("not crc_ok").count() == 0 and pages.where("flags % 4 >= 2").count() == 2 * docs.count()
    packets = ogg.ogg_packets(media)
    assert packets.selectExpr("sum(length(data)) as n").first().n == media.selectExpr("sum(greatest(192, ceil(n_bytes / 192) * 192)) as n").first().n
    assert ogg.ogg_pages(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0
