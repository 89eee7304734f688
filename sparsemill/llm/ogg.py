"""Media columns: Ogg streams written, checked, reassembled and demultiplexed in binary columns.

Format (public: RFC 3533). A page has the capture pattern, flags, a granule position, a serial number, a
page number, a checksum (CRC-32 of polynomial 0x04c11db7, not reflected, start 0, over the page with
that field zero), and lacing values; a packet is the run of segments up to one shorter than 255.

The writer puts two logical streams in one file: samples (8-bit, FRAME of them a packet, the
granule position counting samples at RATE) and notes (the payload's unpadded length and CRC-32).
The reader takes nothing for granted: it checks every page's checksum and number, rebuilds packets
from lacing values over page borders, keeps streams apart by serial number, and takes timestamps
from granule positions.

Defined results: null text is stored as empty text; payloads are padded with bytes 255 to a positive
multiple of FRAME; equal payloads give equal files; null media read as no streams; damaged media raise
ValueError; other columns are carried along, columns named like the results are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparsemill.llm.common import as_bytes, bounded_batches, load, slices

FRAME, RATE = 576, 8000
SAMPLES, NOTES = 1, 2  # serial numbers
#: Packets of samples on one page: their lacing values (three each) must be 255 at most.
PAGE_PACKETS = 85
_HEADER = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_CONTINUED, _FIRST, _LAST = 1, 2, 4


def checksum(page: bytes) -> int:
    """Ogg's CRC-32, from the reflected one by mirroring bits."""
    r = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(r.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = lambda crc: _HEADER.pack(b"OggS", 0, flags, granule, serial, number, crc, len(lacing)) + lacing
    return head(checksum(head(0) + body)) + body


def write_packets(serial: int, packets: list[tuple[bytes, int]], per_page: int = PAGE_PACKETS) -> list[bytes]:
    """Pages of one logical stream; packets come with the granule position at their end."""
    pages, k, flags = [], 0, _FIRST
    lacing, body, granule, ended, continued = bytearray(), bytearray(), -1, 0, False

    def flush(last: bool, goes_on: bool) -> None:
        nonlocal lacing, body, granule, ended, continued
        kind = (_CONTINUED if continued else 0) | (_FIRST if not pages else 0) | (_LAST if last else 0)
        pages.append(_page(kind, granule, serial, len(pages), bytes(lacing), bytes(body)))
        lacing, body, granule, ended, continued = bytearray(), bytearray(), -1, 0, goes_on

    for k, (packet, at) in enumerate(packets):
        pieces = [255] * (len(packet) // 255) + [len(packet) % 255]
        pos = 0
        for j, n in enumerate(pieces):
            if len(lacing) == 255:
                flush(False, j > 0)
            lacing.append(n)
            body += packet[pos : pos + n]
            pos += n
        granule, ended = at, ended + 1
        last = k == len(packets) - 1
        if last or not pages or ended == per_page:  # a stream's first packet has a page of its own
            flush(last, False)
    return pages


def write(payload: bytes, size: int) -> bytes:
    """One file: the samples, and notes with the unpadded size and the payload's CRC."""
    head = struct.pack("<8sII", b"samples8", RATE, FRAME)
    frames = [(payload[i : i + FRAME], i + FRAME) for i in range(0, len(payload), FRAME)]
    samples = write_packets(SAMPLES, [(head, 0), *frames])
    notes = write_packets(NOTES, [(b"notes", 0), (struct.pack("<QI", size, zlib.crc32(payload)), 0)])
    return b"".join((samples[0], notes[0], samples[1], notes[1], *samples[2:]))  # first pages lead, then streams alternate


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the page on which each packet ends
    pages: int = 0
    closed: bool = False
    partial: bytearray | None = None


def read(media: bytes | None) -> dict[int, Stream]:
    """Logical streams by serial number, in the order of their first pages."""
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(media or b"")
    while at < len(view):
        if len(view) - at < _HEADER.size:
            raise ValueError(f"a page's header is cut off at byte {at}")
        mark, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(view, at)
        body = at + _HEADER.size + n
        lacing = bytes(view[at + _HEADER.size : body])
        end = body + sum(lacing)
        if mark != b"OggS" or version or len(lacing) < n or end > len(view):
            raise ValueError(f"no whole page at byte {at}")
        page = bytearray(view[at:end])
        page[22:26] = bytes(4)
        if checksum(bytes(page)) != crc:
            raise ValueError(f"the checksum of the page at byte {at} is wrong")
        s = streams.get(serial)
        if (s is None) != bool(flags & _FIRST) or s is not None and (s.closed or s.pages != number):
            raise ValueError(f"the page at byte {at} does not follow in stream {serial}")
        s = streams.setdefault(serial, Stream(serial))
        if bool(flags & _CONTINUED) != (s.partial is not None):
            raise ValueError(f"the page at byte {at} breaks a packet off")
        s.pages, s.closed = s.pages + 1, bool(flags & _LAST)
        packet = s.partial if s.partial is not None else bytearray()
        open_ = s.partial is not None
        for k in lacing:
            packet += view[body : body + k]
            body, open_ = body + k, True
            if k < 255:
                s.packets.append(bytes(packet))
                s.granules.append(granule)
                packet, open_ = bytearray(), False
        s.partial = packet if open_ else None
        at = end
    if any(s.partial is not None or not s.closed for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def timestamps(stream: Stream, rate: int, frame: int) -> np.ndarray:
    """Seconds at which each sample packet ends. A page's granule position is of its last packet; earlier ones are a frame before."""
    g = np.array(stream.granules[1:], dtype=np.int64)
    after = np.zeros(len(g), dtype=np.int64)  # packets that end later on the same page
    for k in range(len(g) - 2, -1, -1):
        after[k] = after[k + 1] + 1 if g[k] == g[k + 1] else 0
    return (g - after * frame) / rate


def features(samples: bytes, seconds: np.ndarray, streams: int, packets: int, pages: int) -> str:
    """What describes a file: structure, end time, and the samples' mean, spread and sign changes around 128."""
    x = np.frombuffer(samples, np.uint8)
    mean = x.mean() if len(x) else 0.0
    spread = x.std() if len(x) else 0.0
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"streams={streams};packets={packets};pages={pages};seconds={seconds[-1] if len(seconds) else 0:.4f};mean={mean:.4f};std={spread:.4f};turns={turns}"


# ---------------------------------------------------------------- columns


def _fields(df: DataFrame, new: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name.lower() not in new), *(T.StructField(n, t) for n, t in new.items())])


def _batch(part: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [c for c in part.schema.names if c.lower() not in new]
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new.values()], names=[*kept, *new])


def store(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """df with media: text_col's UTF-8 bytes, padded, as an Ogg file."""
    bounded_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                raw = as_bytes(part.column(text_col))
                files = [write(b + b"\xff" * (-len(b) % FRAME if b else FRAME), len(b)) for b in raw]
                yield _batch(part, {"media": pa.array(files, pa.binary())})

    return df.mapInArrow(work, _fields(df, {"media": T.BinaryType()}))


def contents(media: bytes | None) -> tuple[int, bytes, np.ndarray, str]:
    """(n_bytes, payload, seconds, feature) of one file; damage raises ValueError."""
    streams = read(media)
    payload, size, seconds = b"", 0, np.zeros(0)
    if SAMPLES in streams:
        try:
            kind, rate, frame = struct.unpack("<8sII", streams[SAMPLES].packets[0])
            size, crc = struct.unpack("<QI", streams[NOTES].packets[1])
        except (struct.error, KeyError, IndexError) as e:
            raise ValueError("the streams are not those of samples and notes") from e
        payload = b"".join(streams[SAMPLES].packets[1:])
        if kind != b"samples8" or zlib.crc32(payload) != crc:
            raise ValueError("the samples are not what the notes say")
        seconds = timestamps(streams[SAMPLES], rate, frame)
    return size, payload, seconds, features(payload, seconds, len(streams), sum(len(s.packets) for s in streams.values()), sum(s.pages for s in streams.values()))


def demultiplex(df: DataFrame, *, media_col: str = "media", strict: bool = True) -> DataFrame:
    """df with n_bytes, payload (read back), seconds (the end time of each packet) and feature.

    A damaged file ends the job; if not strict, its row has nulls instead, and a further column, damage, says why (null for whole files).
    """
    new = {"n_bytes": T.LongType(), "payload": T.BinaryType(), "seconds": T.ArrayType(T.DoubleType()), "feature": T.StringType()} | ({} if strict else {"damage": T.StringType()})
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.string(), pa.string())

    def whole(media: bytes | None) -> tuple:
        try:
            return *contents(media), None
        except ValueError as e:
            if strict:
                raise
            return None, None, None, None, str(e)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media_col):
                found = zip(*map(whole, part.column(media_col).to_pylist()))
                yield _batch(part, {n: pa.array(list(x), k) for n, x, k in zip(new, found, kinds)})

    return df.mapInArrow(work, _fields(df, new))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as Ogg and read back, as digests."""
    back = demultiplex(store(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    size: Column = F.octet_length("payload")
    return back.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", F.element_at("seconds", -1).alias("end_seconds"),
    )
