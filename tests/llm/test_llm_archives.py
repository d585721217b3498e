"""WARC: round trip, salvage of damaged files, edge rows."""

import gzip
import zlib

import pytest

from reelmart.llm import warc
from reelmart.scratch import scratch_folder

PAGES = "page_id bigint, url string, html string"


def _records(number, payload=b"<p>page %d</p>"):
    return [
        warc.record_bytes(str(i), f"http://x/{i}", payload % i, warc.payload_digest(payload % i), None)
        for i in range(number)
    ]


def _read(data):
    found = list(warc.salvage(data))
    # Records and gaps cover the file but for empty members.
    assert all(a.offset + a.length <= b.offset for a, b in zip(found, found[1:]))
    return [r.record_id for r in found if r.gap_reason is None], [
        (r.offset, r.length) for r in found if r.gap_reason
    ]


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archive(packed):
    data = b"".join(warc.gzip_member(r) if packed else r for r in _records(20))
    assert _read(data) == ([str(i) for i in range(20)], [])


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_one_record(packed):
    parts = [warc.gzip_member(r) if packed else r for r in _records(9)]
    starts = [sum(map(len, parts[:i])) for i in range(10)]
    for victim in range(9):
        for at in (0, 3, len(parts[victim]) // 2, len(parts[victim]) - 9):
            data = bytearray(b"".join(parts))
            data[starts[victim] + at] ^= 0x55
            ids, gaps = _read(bytes(data))
            if gaps:  # a few bytes, such as the time in a gzip header, may change unnoticed
                assert ids == [str(i) for i in range(9) if i != victim]
                assert gaps == [(starts[victim], len(parts[victim]))]
            else:
                assert len(ids) == 9


def test_lost_bytes_and_rubbish():
    parts = [warc.gzip_member(r) for r in _records(6)]
    ids, gaps = _read(parts[0] + parts[1][:-7] + parts[2] + b"\x1f\x8b\x08rubbish WARC/1. " + parts[3])
    assert ids == ["0", "2", "3"] and len(gaps) == 2
    assert _read(parts[0][:-4]) == ([], [(0, len(parts[0]) - 4)])
    assert _read(b"") == ([], [])
    assert _read(b"no archive") == ([], [(0, 10)])


def test_wrong_digest_and_length_are_left_out():
    good = _records(2)
    wrong = good[0].replace(b"page 0", b"page 9")
    assert _read(wrong + good[1]) == (["1"], [(0, len(wrong))])
    short = good[0].replace(b"Content-Length: 13\r\n\r\n<", b"Content-Length: 13\r\n\r\n")
    assert _read(short + good[1])[0] == ["1"]


def test_plain_and_packed_alternate():
    a, b, c = _records(3)
    assert _read(a + warc.gzip_member(b) + c) == (["0", "1", "2"], [])


def test_large_member_ends_in_zero():
    record = warc.record_bytes("1", None, b"x" * (17 << 20), "A" * 32, None)
    member = warc.gzip_member(record)
    assert member[-1] == 0 and gzip.decompress(member) == record
    assert zlib.decompressobj(31).decompress(member) == record


def _archive(spark, rows, **options):
    path = scratch_folder(spark)
    warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(2), path, **options)
    return warc.read_warc(spark, path)


def test_round_trip_of_edge_rows(spark):
    rows = [
        (1, "u1", "same"), (2, "u2", "same"), (3, None, "same"), (4, "u\r\n4", None), (5, "u5", ""),
        (6, "u6", "é€" * 40_000), (None, "u7", "same"), (None, "u8", "alone"), (9, "u9", "WARC/1.1\r\n\r\n"),
        (9, "u9", "WARC/1.1\r\n\r\n"),
    ]
    found = _archive(spark, rows).collect()
    assert all(r.gap_reason is None for r in found) and len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.record_id, []).append(r)
    kinds = {k: [(r.record_type, r.refers_to) for r in v] for k, v in by_id.items()}
    assert kinds["1"] == [("response", None)]
    assert kinds["2"] == kinds["3"] == [("revisit", "1")]
    assert kinds["4"] == [("response", None)] and kinds["5"] == [("revisit", "4")]
    assert kinds["9"] == [("response", None)] * 2
    assert sorted(kinds["None"], key=str) == [("response", None), ("revisit", "1")]
    texts = {str(i): (h or "").encode() for i, _, h in rows if i}
    for r in found:
        if r.record_id in texts:
            assert r.payload_bytes == len(texts[r.record_id])
            assert r.payload_digest == warc.payload_digest(texts[r.record_id])
            assert r.payload is None if r.record_type == "revisit" else r.payload == texts[r.record_id]


def test_small_payloads_are_never_revisits(spark):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")]
    kinds = {r.record_id: r.record_type for r in _archive(spark, rows, min_bytes=4).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_empty_table_and_gap_log(spark):
    assert _archive(spark, []).count() == 0
    path = scratch_folder(spark)
    warc.write_warc(spark.createDataFrame([(i, "u", f"page {i}") for i in range(40)], PAGES).coalesce(1), path)
    files = spark.read.format("binaryFile").load(path)
    content = bytearray(files.first().content)
    middle = len(content) // 2
    content[middle : middle + 40] = bytes(40)
    broken = scratch_folder(spark)
    whole = spark.createDataFrame([(bytes(content[:-1]),)], "member binary")
    whole.selectExpr("cast(member AS string) AS value").write.option("lineSep", "\u0000").text(broken)
    found = warc.read_warc(spark, broken)
    log = warc.gaps(found).collect()
    assert len(log) == 1 and log[0].length > 40 and log[0].file.endswith(".txt")
    assert found.where("gap_reason IS NULL").count() in (38, 39)
