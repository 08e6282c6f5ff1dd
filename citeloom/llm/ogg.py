"""Media columns: bytes as 8-bit samples in an Ogg container, and back by checksums, lacing values, streams and granules."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a packet, samples a second, packets to a mark of the index stream, lacing values of a page.
FRAME, RATE, MARK, SEGMENTS = 576, 8000, 64, 128

# Fixed values of the container: capture pattern, page head, flags of a page.
CAPTURE, HEAD = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

#: Serial numbers of the two logical streams, and the magic words of their first packets.
SAMPLES, INDEX = 1, 2
_IDENT, _MARKS = struct.Struct("<8sBBII"), struct.Struct("<8sI")

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_ZERO = bytes(4)


def checksum(page: bytes) -> int:
    """CRC of a page whose checksum field is zero: polynomial 0x04C11DB7, highest bit first, from 0.

    zlib's CRC has the same polynomial, lowest bit first, from all ones and inverted at its end; mirrored bytes and bits undo the one, and a
    start of all ones, inverted, the other.
    """
    low = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{low:032b}"[::-1], 2)


def _lacing(size: int) -> bytes:
    """Values of a packet: 255 as often as it goes, then the rest, which is 0 where nothing is left."""
    return b"\xff" * (size // 255) + bytes([size % 255])


class Stream:
    """One logical stream of packets, cut into pages."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0
        self.values, self.body, self.open = bytearray(), bytearray(), False
        self.granule = -1

    def packet(self, data: bytes, granule: int) -> Iterator[bytes]:
        """Add a packet, the place after which is ``granule``; pages that it fills."""
        values = _lacing(len(data))
        at = 0
        while values:
            room = SEGMENTS - len(self.values)
            part, values = values[:room], values[room:]
            self.values += part
            size = sum(part)
            self.body += data[at : at + size]
            at += size
            if not values:
                self.granule = granule
            if len(self.values) == SEGMENTS:
                yield self.page(goes_on=bool(values))

    def page(self, flags: int = 0, goes_on: bool = False) -> bytes:
        """The page of what is held; a page on which no packet ends has granule -1."""
        flags |= (CONTINUED if self.open else 0) | (FIRST if self.number == 0 else 0)
        head = HEAD.pack(CAPTURE, 0, flags, self.granule, self.serial, self.number, 0, len(self.values))
        raw = head + bytes(self.values) + bytes(self.body)
        self.number, self.open, self.granule = self.number + 1, goes_on, -1
        self.values.clear()
        self.body.clear()
        return raw[:22] + checksum(raw).to_bytes(4, "little") + raw[26:]


def payload_of(text: bytes) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of FRAME."""
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def write(text: bytes) -> bytes:
    """A file of two streams: the samples of ``payload_of(text)`` in packets of FRAME, and an index with the CRC of each MARK packets.

    The last granule is the length of ``text``, so that a player stops where the text ends. The same text gives the same file.
    """
    payload = payload_of(text)
    sound, index, out = Stream(SAMPLES), Stream(INDEX), []
    for stream, head in ((sound, _IDENT.pack(b"PCM8\0\0\0\0", 1, 1, RATE, FRAME)), (index, _MARKS.pack(b"MARKS\0\0\0", MARK))):
        out += [*stream.packet(head, 0), stream.page()]
    for at in range(0, len(payload), MARK * FRAME):
        part = payload[at : at + MARK * FRAME]
        for i in range(0, len(part), FRAME):
            out += sound.packet(part[i : i + FRAME], min(at + i + FRAME, len(text)))
        out += index.packet(struct.pack("<II", zlib.crc32(part), len(part)), min(at + len(part), len(text)))
    return b"".join([*out, sound.page(LAST), index.page(LAST)])


@dataclass
class Found:
    """A logical stream as read: whole packets, the granule where each ends (or -1), and what was lost."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _next: int = 0
    _open: bytearray | None = None

    def add(self, flags: int, granule: int, number: int, values: bytes, body: memoryview) -> None:
        if number != self._next:
            self.lost += 1
            self._open = None
        self._next = number + 1
        self.pages += 1
        held = self._open if flags & CONTINUED else bytearray()
        if not flags & CONTINUED and self._open is not None:
            self.lost += 1
        at, start = 0, len(self.packets)
        for v in values:
            if held is not None:
                held += body[at : at + v]
            at += v
            if v < 255:
                if held is None:
                    self.lost += 1
                else:
                    self.packets.append(bytes(held))
                    self.granules.append(-1)
                held = bytearray()
        if len(self.packets) > start:
            self.granules[-1] = granule
        self._open = held if values and values[-1] == 255 else None
        self.ended = bool(flags & LAST)


def read(media: bytes) -> tuple[dict[int, Found], int]:
    """Logical streams by serial number, and how many pages or bytes between pages were no good.

    A page with a wrong checksum is left out, and the next capture pattern looked for; the packets that it held parts of are lost.
    """
    view, at, bad, streams = memoryview(media), 0, 0, {}
    while (start := media.find(CAPTURE, at)) >= 0:
        bad += start > at
        at = start + 4
        if start + HEAD.size > len(media):
            break
        _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, start)
        begin = start + HEAD.size + n
        values = media[start + HEAD.size : begin]
        end = begin + sum(values)
        page = media[start:end]
        if version or len(values) < n or len(page) < end - start or checksum(page[:22] + _ZERO + page[26:]) != crc:
            bad += 1
            continue
        streams.setdefault(serial, Found()).add(flags, granule, number, values, view[begin:end])
        at = end
    return streams, bad + (at < len(media))


@dataclass
class Sound:
    """What a file holds: samples (null where any were lost), their number without what pads them, and how it was paged."""

    payload: bytes | None
    samples: int | None
    rate: int | None
    pages: int
    bad: int
    starts: list[int]


def sound(media: bytes) -> Sound:
    """The samples of a file of ``write``, checked against its index; ``starts`` are the granules at which packets begin."""
    streams, bad = read(media)
    pages = sum(s.pages for s in streams.values())
    a, b = streams.get(SAMPLES, Found()), streams.get(INDEX, Found())
    broken = Sound(None, None, None, pages, bad, [])
    if bad or a.lost or b.lost or not (a.ended and b.ended and a.packets and b.packets) or len(a.packets[0]) != _IDENT.size or len(b.packets[0]) != _MARKS.size:
        return broken
    magic, _, _, rate, frame = _IDENT.unpack(a.packets[0])
    if magic.rstrip(b"\0") != b"PCM8":
        return broken
    mark = _MARKS.unpack(b.packets[0])[1]
    payload = b"".join(a.packets[1:])
    sums = [struct.pack("<II", zlib.crc32(payload[i : i + mark * frame]), len(payload[i : i + mark * frame])) for i in range(0, len(payload), mark * frame)]
    if sums != b.packets[1:]:
        return broken
    # A page says where its last packet ends; packets before it end a frame earlier each, and only the last of all is cut short.
    starts, known = [], 0
    for i, end in enumerate(a.granules[1:]):
        starts.append(known)
        known = end if end >= 0 else known + frame
    return Sound(payload, known, rate, pages, bad, starts)


def features(samples: np.ndarray) -> str:
    """Peak, root of the mean square and zero crossings of samples around 128, in whole numbers."""
    if not len(samples):
        return "peak=0;rms=0;crossings=0"
    x = samples.astype(np.int16) - 128
    sign = x >= 0
    rms = int(np.sqrt(float(np.square(x.astype(np.int64)).sum()) / len(x)) * 1000)
    return f"peak={int(np.abs(x).max())};rms={rms};crossings={int((sign[1:] != sign[:-1]).sum())}"


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each whole text, in UTF-8, as a file of ``write``.

    One row for each input row; null texts count as empty and give a file of one packet of padding, rows that repeat an id or a text are
    kept. Other columns are not carried; an empty table gives an empty result.
    """

    @F.arrow_udf("binary")
    def made(text: pa.Array) -> pa.Array:
        return pa.array([write(t.as_py()) for t in text], pa.binary())

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")).select("doc_id", made("body").alias("media"))


def from_media(rows: DataFrame) -> DataFrame:
    """``rows`` with what their ``media`` holds: payload, n_bytes (samples without padding), pages, bad_pages, millis, feature.

    payload, n_bytes, millis and feature are null for a null file, one that is damaged, or one of another kind; nothing fails.
    """

    @F.arrow_udf("struct<payload: binary, n_bytes: long, pages: int, bad_pages: int, millis: long, feature: string>")
    def opened(media: pa.Array) -> pa.Array:
        out: list[tuple] = []
        for m in media:
            s = sound(m.as_py()) if m.is_valid else Sound(None, None, None, 0, 0, [])
            said = None if s.payload is None else features(np.frombuffer(s.payload, np.uint8)[: s.samples])
            out.append((s.payload, s.samples, s.pages, s.bad, None if s.payload is None else s.samples * 1000 // s.rate, said))
        kinds = {"payload": pa.binary(), "n_bytes": pa.int64(), "pages": pa.int32(), "bad_pages": pa.int32(), "millis": pa.int64(), "feature": pa.string()}
        return pa.StructArray.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    return rows.withColumn("_m", opened("media")).select(*rows.columns, "_m.*")


def packets(rows: DataFrame) -> DataFrame:
    """(doc_id, serial, packet, granule, millis, size): each packet after the heads, with the granule and the time at which it begins.

    Of the index stream, granule and millis are null. Lost packets are absent; null files have none.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, media in zip(batch.column("doc_id"), batch.column("media")):
                if not media.is_valid:
                    continue
                data = media.as_py()
                s, streams = sound(data), read(data)[0]
                table = [(serial, i, s.starts[i - 1] if serial == SAMPLES and s.starts else None, len(p)) for serial, f in sorted(streams.items()) for i, p in enumerate(f.packets) if i]
                ms = [None if r[2] is None else r[2] * 1000 // s.rate for r in table]
                yield pa.record_batch(
                    [pa.array([doc_id.as_py()] * len(table), batch.column("doc_id").type), pa.array([r[0] for r in table], pa.int64()), pa.array([r[1] for r in table], pa.int32()), pa.array([r[2] for r in table], pa.int64()), pa.array(ms, pa.int64()), pa.array([r[3] for r in table], pa.int32())],
                    names=["doc_id", "serial", "packet", "granule", "millis", "size"],
                )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "media").mapInArrow(listed, f"doc_id {kind}, serial long, packet int, granule long, millis long, size int")
