import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import ogg
from citeloom.llm.queries import op13_ogg_media

RND = np.random.default_rng(5)
TEXTS = ["", "a", "x" * 575, "x" * 576, "x" * 577, "été " * 1000, "words and more\n" * 9000, "\x00\xff OggS inside OggS", "".join(chr(int(c)) for c in RND.integers(32, 2000, 70_000))]


def slow_crc(data):
    """The checksum by its definition, bit by bit."""
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum_by_definition():
    for n in (0, 1, 27, 400):
        data = RND.integers(0, 256, n, np.uint8).tobytes()
        assert ogg.checksum(data) == slow_crc(data)
    # an empty first page with serial number 0 of a known writer: zeros alone have no checksum
    assert ogg.checksum(bytes(30)) == 0


def pages(media):
    """(start, end, flags, granule, serial, number) by walking the heads."""
    at, out = 0, []
    while at < len(media):
        _, _, flags, granule, serial, number, _, n = ogg.HEAD.unpack_from(media, at)
        end = at + 27 + n + sum(media[at + 27 : at + 27 + n])
        out.append((at, end, flags, granule, serial, number))
        at = end
    return out


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip_and_layout(text):
    body = text.encode()
    media = ogg.write(body)
    assert media == ogg.write(body)
    s = ogg.sound(media)
    assert s.payload == ogg.payload_of(body) and s.samples == len(body) and s.bad == 0
    assert len(s.payload) % 576 == 0 and len(s.payload) > 0
    found = pages(media)
    assert all(ogg.checksum(media[a : a + 22] + bytes(4) + media[a + 26 : b]) == int.from_bytes(media[a + 22 : a + 26], "little") for a, b, *_ in found)
    assert [p[2] & ogg.FIRST for p in found[:2]] == [2, 2] and {p[4] for p in found} == {1, 2} and s.pages == len(found)
    for serial in (1, 2):
        mine = [p for p in found if p[4] == serial]
        assert [p[5] for p in mine] == list(range(len(mine))) and mine[-1][2] & ogg.LAST
    assert s.starts == list(range(0, len(s.payload), 576))


def test_packets_of_all_lengths_are_laced():
    stream, out = ogg.Stream(9), []
    sizes = [0, 1, 254, 255, 256, 509, 510, 511, 255 * 128, 255 * 128 + 1, 255 * 300, 7]
    data = [RND.integers(0, 256, n, np.uint8).tobytes() for n in sizes]
    for i, d in enumerate(data):
        out += stream.packet(d, i)
    found, bad = ogg.read(b"".join([*out, stream.page(ogg.LAST)]))
    assert bad == 0 and found[9].packets == data and found[9].lost == 0 and found[9].ended
    assert any(p[3] == -1 for p in pages(b"".join(out)))  # a page on which no packet ends


def test_damage_is_seen_and_the_rest_is_read():
    body = ("some words " * 40_000).encode()
    media = ogg.write(body)
    found = [p for p in pages(media) if p[4] == 1]
    a, b = found[2][:2]
    hurt = bytearray(media)
    hurt[(a + b) // 2] ^= 1
    streams, bad = ogg.read(bytes(hurt))
    whole = ogg.read(media)[0][1].packets
    assert bad and streams[1].lost and set(streams[1].packets) <= set(whole) and len(streams[1].packets) < len(whole)
    assert ogg.sound(bytes(hurt)).payload is None
    for other in (media[:a] + media[b:], media[:a] + media[a:b] * 2 + media[b:], media[:-5], media[: found[-1][0]], b"", b"junk", media + b"tail", media[:20] + media):
        assert ogg.sound(other).payload is None
    middle = pages(media)
    swapped = b"".join(media[p[0] : p[1]] for p in sorted(middle, key=lambda p: p[4]))  # streams one after another instead of by turns
    assert ogg.sound(swapped).payload == ogg.payload_of(body)


def test_rows_of_the_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, "same id"), (99, None), (None, "no id"), (7, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("payload", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_ogg_media(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = {}
    for doc_id, t in rows:
        body = (t or "").encode()
        p = body + b"\xff" * (-len(body) % 576 if body else 576)
        media = ogg.write(body)
        want.setdefault(doc_id, set()).add((len(body), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest()))
    for r in got:
        assert tuple(r)[1:7] in want[r["doc_id"]]
    by_text = {r["payload_sha256"]: r["feature"] for r in got}
    assert all(by_text[r["payload_sha256"]] == r["feature"] or r["n_bytes"] == 0 for r in got)


def test_packet_times_and_bad_files(spark):
    docs = spark.createDataFrame([(1, "abc " * 2000), (2, None)], "key int, body string")
    media = ogg.to_media(docs, id_col="key", text_col="body")
    rows = ogg.packets(media).filter("doc_id = 1 AND serial = 1").orderBy("packet").collect()
    assert [r["granule"] for r in rows] == list(range(0, 8000, 576)) and rows[7]["millis"] == 7 * 576 * 1000 // 8000
    assert ogg.packets(media).filter("doc_id = 2").count() == 2  # padding and its mark
    bad = spark.createDataFrame([(1, bytearray(b"none")), (2, None)], "doc_id int, media binary")
    assert [r["payload"] for r in ogg.from_media(bad).collect()] == [None, None] and ogg.packets(bad).count() == 0
    assert ogg.from_media(ogg.to_media(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    assert ogg.features(np.array([128, 127, 129, 128], np.uint8)) == "peak=1;rms=707;crossings=2"
