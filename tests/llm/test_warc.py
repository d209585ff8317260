import base64
import hashlib
import io
import struct

import zstandard

from marlstone.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def back(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return warc.read_archives(warc.write_archives(df, **more)).collect()


def test_revisits_and_round_trip(spark):
    rows = [(i, f"http://h/{i}\r\nx é", f"<p>page {i % 17} é\r\n\r\n</p>" * 20) for i in range(120)]
    rows += [(200, "u", None), (201, "u", ""), (202, None, "\r\n\r\n"), (3, "again", rows[3][2]), (None, "u", rows[0][2]), (None, "u", "alone"), (300, "u", "X" * 3_000_000)]
    got = back(spark, rows, file_bytes=20_000)
    assert len(got) == len(rows)
    html = {}
    for p, _, h in rows:
        html.setdefault(p, set()).add(h or "")
    for r in got:
        assert any(r.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() and r.payload_bytes == len(h.encode()) for h in html[r.page_id])
        if r.record_type == "response":
            assert bytes(r.payload).decode() in html[r.page_id] and r.refers_to is None
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(i, "response", None) for i in range(17)} <= kinds and {(i, "revisit", i % 17) for i in range(17, 120)} <= kinds
    assert (201, "revisit", 200) in kinds and (None, "revisit", 0) in kinds and (None, "response", None) in kinds
    assert sum(r.page_id == 3 and r.record_type == "response" for r in got) == 2


def test_small_payloads_are_all_responses(spark):
    got = back(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], least_bytes=4)
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)}


def test_empty_table(spark):
    assert back(spark, []) == []


def test_layout():
    records = [warc.record(i, "u", f"<html>{i} same text in every page</html>".encode(), None, False, "d") for i in range(200)]
    content = warc.archive(records)
    magic, size = struct.unpack("<II", content[:8])
    assert magic == 0x184D2A5D
    known = zstandard.ZstdCompressionDict(content[8 : 8 + size])
    assert zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(content[8 + size :]) == records[0]
    assert len([*warc.parse(io.BytesIO(content))]) == 200
    assert len(content) - size < sum(len(zstandard.compress(r)) for r in records) / 2
