"""Archives: exact round trip, roles of copies, and the format of the files."""

import struct
from collections import defaultdict

import pytest
import zstandard
from helpers import rows_of, text, with_clashes

from tallyframe.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [(i, f"http://h/{i}", f"<p>{text(40, i % 60)}</p>é\U0001f600") for i in range(150)] + [
    (200, "http://h/null", None), (201, None, ""), (202, "http://h/\r\nX-Bad: 1", "x\r\n\r\ny"), (203, "http://h/long", text(40, 1) * 400),
]


def expected(rows):
    by = defaultdict(list)
    for i, _, html in rows:
        by[html or ""].append(i)
    out = []
    for i, _, html in rows:
        last = max(by[html or ""])
        payload = (html or "").encode()
        out.append((i, len(payload), warc.payload_digest(payload), "response" if i == last else "revisit", None if i == last else last))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = with_clashes(pages_of(spark, ROWS), "sha", "payload", "bucket", "kind", "to")
    got = warc.archive_and_read(pages)
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected(ROWS)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in got.where("record_type = 'response'").collect()}
    assert all(payloads[i] == (html or "").encode() for i, _, html in ROWS if i in payloads)
    assert {r["page_id"]: r["url"] for r in got.collect()}[201] is None


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "u", "same"), (5, "u", "same"), (5, "v", "same"), (None, "w", "same"), (None, None, "other"), (None, None, "other")]
    got = rows_of(warc.archive_and_read(pages_of(spark, rows)), "page_id", "url", "record_type", "refers_to")
    assert got == sorted(
        [(5, "v", "response", None), (5, "u", "revisit", 5), (5, "u", "revisit", 5), (None, "w", "revisit", 5), (None, None, "response", None), (None, None, "revisit", None)],
        key=repr,
    )


def test_file_format(spark, tmp_path, monkeypatch):
    manifest = warc.write_archives(pages_of(spark, ROWS), str(tmp_path / "w")).collect()
    assert sum(r["records"] for r in manifest) == len(ROWS)
    seen = []
    for r in manifest:
        raw = (tmp_path / "w" / r["archive"]).read_bytes()
        assert len(raw) == r["bytes"]
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D
        known = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
        rest, at_first = raw[8 + size :], True
        while rest:
            frame = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
            record = frame.decompress(rest)
            rest = frame.unused_data
            fields, block = warc.parse(record)
            assert fields["warc-type"] == "warcinfo" if at_first else fields["warc-type"] in ("response", "revisit")
            assert record.endswith(b"\r\n\r\n") and "x-bad" not in fields
            at_first = False
            seen.append(fields["warc-record-id"])
        assert b"".join(warc.read_records(str(tmp_path / "w"), r["archive"])).count(b"WARC/1.1\r\n") == r["records"] + 1
    assert len(seen) == len(set(seen))


def test_archives_are_split_and_damage_raises(spark, tmp_path, monkeypatch):
    writer = warc.ArchiveWriter(str(tmp_path), b"")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    data = [warc.record("response", i, "http://h", text(100, i).encode(), None) for i in range(20)]
    for d in data:
        writer.add(d)
    writer.close()
    assert len(writer.done) > 3
    back = [r for name, _, _ in writer.done for r in warc.read_records(str(tmp_path), name) if b"warcinfo" not in r]
    assert back == data
    name = writer.done[0][0]
    (tmp_path / name).write_bytes((tmp_path / name).read_bytes()[:-5])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_records(str(tmp_path), name))


def test_empty_table(spark):
    assert warc.archive_and_read(pages_of(spark, [])).count() == 0


def test_a_single_small_page_has_a_dictionary_in_front(spark, tmp_path):
    import struct

    from tallyframe.llm import warc

    pages = spark.createDataFrame([(1, "http://h/1", "<p>x</p>")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archives"
    manifest = warc.write_archives(pages, folder)
    (name,) = [r["archive"] for r in manifest.collect()]
    data = (tmp_path / "archives" / name).read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE_MAGIC and b"<p>x</p>" in data[8 : 8 + size]
    (row,) = warc.read_archives(folder, manifest).collect()
    assert (row["page_id"], bytes(row["payload"])) == (1, b"<p>x</p>")
