import hashlib
import io
import tarfile
import zlib

import pyarrow.fs as pafs
import pytest

from flowloom.llm import common, media


@pytest.fixture(scope="module")
def made(spark, odd):
    folder = common.shared_dir(spark, "test-shards")
    return {(r["doc_id"], r["n_bytes"]): r for r in media.media_columns(odd, folder).collect()}, folder


def test_columns_come_from_what_was_stored(odd, made):
    rows, folder = made
    files, root = pafs.FileSystem.from_uri(folder)
    for r in odd.collect():
        raw = (r["text"] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        got = rows[r["doc_id"], len(raw)]
        assert got["payload_bytes"] == len(payload) and got["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got["tail_crc32"] == zlib.crc32(payload[-16:]) and (got["width"], got["height"], got["bits"]) == (192, len(payload) // 192, 8)
        with files.open_input_file(f"{root}/{got['shard']}") as f:
            stored = f.read_at(got["length"], got["offset"])
        assert hashlib.sha256(stored).hexdigest() == got["media_sha256"] and len(stored) == got["media_bytes"]
        assert media.decode_image(stored) == payload and got["feature"] == media.feature_of(payload)


def test_shards_are_tar_files_named_by_content(made):
    rows, folder = made
    files, root = pafs.FileSystem.from_uri(folder)
    for shard in {r["shard"] for r in rows.values()}:
        with files.open_input_file(f"{root}/{shard}") as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
            for member in tar.getmembers():
                payload = media.decode_image(tar.extractfile(member).read())
                assert member.name == hashlib.sha256(payload).hexdigest() + ".png"


def test_rows_and_copies(spark, odd, empty):
    docs = odd.unionByName(odd).repartition(3)
    rows = media.media_columns(docs).collect()
    assert len(rows) == docs.count()
    places = {}
    for r in rows:
        places.setdefault(r["payload_sha256"], set()).add((r["shard"], r["offset"]))
    assert all(len(p) == 1 for p in places.values())  # equal texts share one object
    assert media.media_columns(empty).count() == 0


def test_metadata_alone_reads_headers(spark, odd):
    folder = common.shared_dir(spark, "test-heads")
    manifest = media.write_shards(odd, folder)
    rows = media.read_objects(media.objects_of(manifest), folder, features=False)
    assert rows.columns == ["digest", "shard", "offset", "length", "width", "height", "bits"] and rows.count() == len({r["digest"] for r in manifest.collect()})
