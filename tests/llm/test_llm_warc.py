import struct

import pytest
import zstandard

from threadshelf.llm import warc

SCHEMA = "page_id long, url string, html string, refers_to long, digest string"


def archive(n=30, dictionary=True):
    writer = warc.ArchiveWriter()
    for i in range(n):
        writer.add(warc.record(i, f"http://x/{i}", b"<p>page %d</p>" % i * 40))
    content = writer.close()
    assert dictionary == (content[:4] == struct.pack("<I", warc.DICTIONARY_FRAME))
    return content


def read(spark, *contents):
    df = spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")
    return warc.read_archives(df, with_payload=True).collect()


def test_round_trip(spark):
    rows = [(1, "http://a\r\nX: y", "same", 0, "d"), (2, None, "same", 0, "d"), (5, "u", None, 0, "d"), (4, "u", "", 0, "d"), (3, "ü", "é" * 10, 0, "d"), (None, "u", "same", 0, "d"), (None, "n", "only", 0, "d"), (1, "u", "same", 0, "d"), (9, "u", "x" * 9_000_000, 0, "d")]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    seen = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=str)
    assert seen == sorted(
        [(1, 4, "response", None), (1, 4, "response", None), (2, 4, "revisit", 1), (4, 0, "response", None), (5, 0, "revisit", 4), (3, 20, "response", None), (None, 4, "revisit", 1), (None, 4, "response", None), (9, 9_000_000, "response", None)],
        key=str,
    )
    assert all(r["error"] is None for r in got)
    assert {r["payload_digest"] for r in got if r["page_id"] in (1, 2)} == {warc.base32_sha1(b"same")}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_with_and_without_dictionary(spark):
    got = read(spark, archive(), archive(3, dictionary=False))
    assert len(got) == 33 and not any(r["error"] for r in got)
    assert got[0]["payload"] == b"<p>page 0</p>" * 40 and got[0]["target_uri"] == "http://x/0"


def test_dictionary_that_is_not_compressed_and_other_skippable_frames(spark):
    samples = [warc.record(i, "http://x", b"<p>page %d</p>" % i * 40) for i in range(40)]
    d = zstandard.train_dictionary(4096, samples)
    frame = lambda magic, data: struct.pack("<II", magic, len(data)) + data
    packed = zstandard.ZstdCompressor(dict_data=d).compress(samples[0])
    content = frame(warc.DICTIONARY_FRAME, d.as_bytes()) + frame(0x184D2A51, b"note") + packed
    assert [r["error"] for r in read(spark, content)] == [None]


def test_damage_is_told(spark):
    whole = archive()
    cut_off = read(spark, whole[:-20])
    assert len(cut_off) == 30 and cut_off[-1]["error"] and not any(r["error"] for r in cut_off[:-1])
    good = warc.record(1, "u", b"abc")
    bad = {
        "no WARC header": b"HTTP/1.1 200\r\n\r\n",
        "Content-Length": good.replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 9"),
        "no WARC-Type": good.replace(b"WARC-Type", b"WARC-Tipe"),
        "digest": good.replace(b"abc\r\n", b"abd\r\n"),
        "is no number": good.replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: x"),
        "refers to nothing": warc.record(1, "u", b"abc", 2).replace(b"WARC-Refers-To:", b"WARC-Other:"),
    }
    pack = zstandard.ZstdCompressor().compress
    got = read(spark, *[pack(x) + pack(good) for x in bad.values()])
    for i, said in enumerate(bad):
        mine = [r for r in got if r["path"] == f"f{i}"]
        assert said in mine[0]["error"] and mine[1]["error"] is None
    assert read(spark, b"") == []


def test_revisit_without_its_response(spark):
    df = read_frame(spark, [warc.record(7, "u", b"abc", 1)])
    assert [r["payload_bytes"] for r in warc.resolve_revisits(df).collect()] == [None]


def read_frame(spark, records):
    content = b"".join(zstandard.ZstdCompressor().compress(x) for x in records)
    return warc.read_archives(spark.createDataFrame([("f", bytearray(content))], "path string, content binary"))


def test_parse_needs_a_header_name():
    with pytest.raises(warc.BadRecord):
        warc.parse_record(b"WARC/1.1\r\nnothing here\r\n\r\n\r\n\r\n")


def test_frame_ends_are_those_of_the_library():
    """Frames of every kind of header and block, one behind the other."""
    import os
    import random

    r = random.Random(3)
    datas = [b"", b"a", b"a" * 300_000, os.urandom(200_000), b"ab" * 200, bytes(r.randrange(4) for _ in range(70_000))]
    for options in ({}, {"write_checksum": True}, {"write_content_size": False}, {"level": 19}):
        packed = [zstandard.ZstdCompressor(**options).compress(d) for d in datas]
        streamed = []
        for d in datas:
            one = zstandard.ZstdCompressor(**options).compressobj()
            streamed.append(one.compress(d) + one.flush())
        content = b"".join([*packed, *streamed])
        at, found = 0, []
        while at < len(content):
            end = warc.frame_end(content, at)
            found.append(end - at)
            at = end
        assert found == [len(x) for x in [*packed, *streamed]]
    assert [d for _, d in warc.frames(content)] == [*datas, *datas]
    for cut_off in (3, 6, len(packed[3]) - 1):
        with pytest.raises(warc.BadRecord):
            list(warc.frames(packed[3][:cut_off]))


def test_reading_is_linear_in_the_archive():
    import time

    taken = []
    for n in (4_000, 16_000):
        writer = warc.ArchiveWriter(1 << 40)
        for i in range(n):
            writer.add(warc.record(i, f"http://x/{i}", b"<p>page %d</p>" % i * 40))
        content = writer.close()
        start = time.process_time()
        assert sum(1 for _ in warc.frames(content)) == n
        taken.append(time.process_time() - start)
    assert taken[1] < 7 * taken[0] + 0.1
