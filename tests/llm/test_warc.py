import base64
import hashlib

import pyarrow.fs as pafs
import pytest
import zstandard

from flowloom.llm import common, warc

COLUMNS = "page_id long, url string, html string, sha1 string, nth int, id int"
#: Nulls, empty and long payloads, equal ones, repeated rows, and columns that clash with helper names.
PAGES = [
    (5, "http://a/5", "<p>same</p>"),
    (3, "http://a/3", "<p>same</p>"),
    (3, "http://a/3", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (None, "http://a/n", "<p>same</p>"),
    (1, "http://a/1", None),
    (2, "http://a/2", ""),
    (7, "http://b/\r\nX: y", "ünï\r\n\r\nWARC/1.1 漢字 😀\x00"),
    (8, "http://b/8", "x" * 3_000_000),
    (None, None, "only once"),
    *((100 + k, f"http://c/{k}", f"<html>{k}</html>" * (k % 900)) for k in range(500)),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1, 2) for p in PAGES], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def made(spark, pages):
    folder = common.shared_dir(spark, "test-bundles")
    return warc.archive(pages, folder).collect(), folder


def expected(min_bytes=0):
    """By hand, one page after the other."""
    rows, seen = [], set()
    first = {}
    for key, _, html in PAGES:
        first[html or ""] = min(first.get(html or "", (True, 0)), (key is None, key or 0))
    for key, _, html in PAGES:
        raw = (html or "").encode()
        response = len(raw) < min_bytes or ((key is None, key or 0) == first[html or ""] and html not in seen)
        if response:
            seen.add(html)
        rows.append((key, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else first[html or ""][1]))
    return sorted(map(repr, rows))


def test_each_page_has_its_record(made):
    assert sorted(repr(tuple(r[:5])) for r in made[0]) == expected()


def test_short_payloads_are_all_responses(pages):
    assert sorted(repr(tuple(r[:5])) for r in warc.archive(pages, min_bytes=12).collect()) == expected(12)


def test_bundles_are_plain_warc_files_for_any_reader(made):
    rows, folder = made
    files, root = pafs.FileSystem.from_uri(folder)
    ids = set()
    for name in {r["bundle"] for r in rows}:
        with files.open_input_file(f"{root}/{name}") as f:
            data = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
        at = 0
        while at < len(data):
            fields, _, payload, at = warc.parse_record(data, at)
            assert fields["warc-record-id"] not in ids
            ids.add(fields["warc-record-id"])
            assert fields["warc-type"] == "response" or not payload
    assert ids == {r["record_id"] for r in rows}


def test_a_record_is_reached_through_its_frame_alone(made):
    rows, folder = made
    files, root = pafs.FileSystem.from_uri(folder)
    for r in rows[::25]:
        bundle = warc.BundleReader(files, f"{root}/{r['bundle']}")
        assert sum(e[0] for e in bundle.entries) == bundle.starts[-1] + bundle.entries[-1][0]
        fields, _, payload, end = warc.parse_record(bundle.frame(r["frame"]), r["offset"])
        assert fields["warc-record-id"] == r["record_id"] and end == r["offset"] + r["length"]
        if r["record_type"] == "response":
            assert len(payload) == r["payload_bytes"]
        bundle.close()


def test_records_fill_frames(made):
    rows, folder = made
    files, root = pafs.FileSystem.from_uri(folder)
    for name in {r["bundle"] for r in rows}:
        bundle = warc.BundleReader(files, f"{root}/{name}")
        held = [sum(r["length"] for r in rows if r["bundle"] == name and r["frame"] == k) for k in range(len(bundle.entries))]
        assert held == [e[1] for e in bundle.entries]
        assert all(size <= warc.FRAME_BYTES or sum(r["bundle"] == name and r["frame"] == k for r in rows) == 1 for k, size in enumerate(held))


def test_damage_is_found(made, tmp_path):
    rows, folder = made
    files, root = pafs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{root}/{rows[0]['bundle']}") as f:
        data = bytearray(f.read())
    data[20] ^= 1
    (tmp_path / "b").write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.BundleReader(pafs.LocalFileSystem(), str(tmp_path / "b")).frame(0)


def test_empty_table_and_reruns(pages, made):
    assert warc.archive(pages.limit(0)).count() == 0
    again = {(r["record_id"], r["record_type"]) for r in warc.archive(pages).collect()}
    assert again == {(r["record_id"], r["record_type"]) for r in made[0]}
