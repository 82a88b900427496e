import hashlib
import io

from talentlake.llm.warc import (SCHEMA, decode_record, encode_record, read_warc, records_in_range, warc_records,
                                 write_warc)

BIG, OTHER = "x" * 1500 + "é", "\x1f y\u008b\x08 " * 400


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string, digest int")


def brute(rows):
    out = []
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "").encode() == body and p is not None]
        first = max(same) if same else None
        revisit = len(body) >= 1000 and page != first
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response",
                    first if revisit else None))
    return sorted(out, key=repr)


def back(spark, rows, path, range_bytes):
    write_warc(warc_records(pages(spark, rows)), path)
    found = read_warc(spark, path, range_bytes).collect()
    page = lambda r: None if r is None or r == "" else int(r.rpartition(":")[2])
    for r in found:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
        else:
            assert r.payload is None
    return found, sorted([(page(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, page(r.refers_to))
                          for r in found], key=repr)


def test_round_trip_by_ranges(spark, tmpdir_path):
    rows = [(1, "http://a", BIG, "p", 1), (2, "http://a", BIG, "p", 1), (3, None, None, None, None), (4, "u\r\nWARC-Type: x", "", "", 0),
            (5, "http://b", "small", "", 0), (6, "http://c", "small", "", 0), (7, "é", OTHER, "", 0), (9, "z", BIG, "", 0),
            (8, "w", "long " * 60_000, "", 0), (None, "n", "null id", "", 0)]
    for k, size in enumerate((300, 5000, 1 << 20)):
        found, got = back(spark, rows, f"{tmpdir_path}/w{k}", size)
        assert got == brute(rows)
    by = {r.record_id: r for r in found}
    assert by["urn:page:4"].target_uri == "u%0D%0AWARC-Type: x" and by["urn:page:3"].target_uri is None
    assert bytes(by["urn:page:8"].payload) == b"long " * 60_000


def test_repeated_rows_are_records_of_their_own(spark, tmpdir_path):
    rows = [(1, "a", BIG, "", 0), (1, "a", BIG, "", 0), (0, "b", BIG, "", 0)]
    _, got = back(spark, rows, f"{tmpdir_path}/w", 1000)
    assert got == brute(rows)


def test_empty_table(spark, tmpdir_path):
    found, got = back(spark, [], f"{tmpdir_path}/w", 1000)
    assert got == []
    assert [f.simpleString().partition(":")[0] for f in read_warc(spark, f"{tmpdir_path}/w").schema.fields] == [
        c.split()[0] for c in SCHEMA.split(", ")]


def test_ranges_own_each_record_once_past_garbage():
    row = {"record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": hashlib.sha1(b"").hexdigest()}
    members = [encode_record(row | {"record_id": f"r{i}", "payload": bytes([i]) * (i * 37 % 4000), "payload_bytes": 0}) for i in range(40)]
    data = b"junk\x1f\x8b\x08junk" + b"".join(m + b"\0" * (i % 3) for i, m in enumerate(members)) + members[0][:-9]
    for size in (1, 7, 64, 500, 10_000, len(data)):
        ids = [f["record_id"] for at in range(0, len(data), size)
               for _, f in records_in_range(io.BytesIO(data), at, min(at + size, len(data)))]
        assert ids == [f"r{i}" for i in range(40)]


def test_unparsable_members_are_no_records():
    assert decode_record(b"hello") is None and decode_record(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n\r\n") is None


def test_writers_leave_each_other_alone(spark, tmpdir_path):
    """A job that commits while another writes to the same folder removes its own files only."""
    from talentlake.llm.warc import WarcWriter

    path = f"{tmpdir_path}/w"
    first, second = (warc_records(pages(spark, [(k, "u", f"page {k}", "", 0)])).toArrow().to_batches() for k in (1, 2))
    a, b = WarcWriter(path), WarcWriter(path)
    waiting = a.write(iter(first))
    b.commit([b.write(iter(second))])
    b.abort([])
    a.commit([waiting])
    assert sorted(r.record_id for r in read_warc(spark, path).collect()) == ["urn:page:1", "urn:page:2"]
