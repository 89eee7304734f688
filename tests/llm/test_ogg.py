import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from sparsemill.llm import ogg


def plain_crc(data):
    r = 0
    for b in data:
        r ^= b << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r >> 31 else r << 1) & 0xFFFFFFFF
    return r


@settings(max_examples=50, deadline=None)
@given(some.binary(max_size=300))
def test_checksum(data):
    assert ogg.checksum(data) == plain_crc(data)


@settings(max_examples=50, deadline=None)
@given(some.lists(some.one_of(some.binary(max_size=600), some.integers(0, 80_000).map(bytes)), min_size=1, max_size=12), some.integers(1, 5))
def test_packets_come_back(packets, per_page):
    media = b"".join(ogg.write_packets(7, [(p, k) for k, p in enumerate(packets)], per_page))
    s = ogg.read(media)[7]
    assert s.packets == packets and s.closed and s.granules[-1] == len(packets) - 1


def test_streams_may_alternate_and_damage_is_seen():
    a, b = (ogg.write_packets(n, [(bytes([n]) * 700, k) for k in range(4)], 1) for n in (1, 2))
    media = b"".join(x for pair in zip(a, b) for x in pair)
    s = ogg.read(media)
    assert [s[n].packets for n in (1, 2)] == [[bytes([n]) * 700] * 4 for n in (1, 2)]
    for bad in (media[:-1], media[:100] + bytes([media[100] ^ 1]) + media[101:], media[len(a[0]) :], b"".join(a[:2]), b"".join([a[0], a[2], a[3]]), b"xx" + media):
        with pytest.raises(ValueError):
            ogg.read(bad)


def test_timestamps():
    payload = bytes(ogg.FRAME * 200)
    s = ogg.read(ogg.write(payload, 5))[ogg.SAMPLES]
    assert s.pages > 3
    assert ogg.timestamps(s, ogg.RATE, ogg.FRAME).tolist() == [k * ogg.FRAME / ogg.RATE for k in range(1, 201)]


def test_table(spark, make, odd):
    got = ogg.demultiplex(ogg.store(make(odd))).collect()
    want = []
    for r in odd:
        raw = (r[1] or "").encode()
        want.append((r[0], len(raw), raw + b"\xff" * (-len(raw) % ogg.FRAME if raw else ogg.FRAME)))
    assert sorted(repr((r["doc_id"], r["n_bytes"], bytes(r["payload"]))) for r in got) == sorted(map(repr, want))
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"] or "", set()).add((hashlib.sha256(r["media"]).hexdigest(), r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert ogg.store(make([])).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert ogg.demultiplex(null).first()["n_bytes"] == 0


def test_query(spark):
    from tests.conftest import SF

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in ogg.op7_ogg_media(spark, SF).collect():
        raw = docs[r["doc_id"]]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_damaged_rows_can_be_set_aside(spark):
    good = ogg.write(bytes(ogg.FRAME), 5)
    rows = [(1, bytearray(good)), (2, bytearray(good[:-1])), (3, bytearray(b"xx")), (4, None), (5, bytearray(b"".join(ogg.write_packets(9, [(b"other", 0)], 1))))]
    df = spark.createDataFrame(rows, "doc_id long, media binary")
    got = {r["doc_id"]: r for r in ogg.demultiplex(df, strict=False).collect()}
    assert got[1]["n_bytes"] == 5 and bytes(got[1]["payload"]) == bytes(ogg.FRAME) and got[1]["damage"] is None
    assert all(got[k]["payload"] is None and got[k]["feature"] is None and got[k]["damage"] for k in (2, 3))
    assert got[4]["n_bytes"] == 0 and got[4]["damage"] is None and got[5]["feature"].startswith("streams=1")
    with pytest.raises(Exception, match="ValueError"):
        ogg.demultiplex(df).collect()
