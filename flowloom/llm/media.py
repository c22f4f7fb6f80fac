"""Media columns over content-addressed payloads in tar shards.

Each task writes the payloads of its rows as image members of one tar shard, named by
the payload's digest; a payload that the task has met before is not written again.
Rows carry digest, shard, offset and length. Copies written by different tasks are
brought to one place per digest (the smallest shard and offset), so that a payload is
read once however many rows share it. Metadata columns come from range reads of the
image header alone; features from range reads of whole members.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm import common

ROW_BYTES = 192
HEADER_BYTES = 33  # the PNG signature and its header chunk
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty), with spaces up to a positive multiple of ROW_BYTES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes) -> bytes:
    """A grey PNG of 8-bit samples, ROW_BYTES wide, without row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    lines = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW_BYTES, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample from the first HEADER_BYTES of an image."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", head[16:25])


def decode_image(stored: bytes) -> bytes:
    """The samples of an image that encode_image made."""
    width, _, _ = read_header(stored[:HEADER_BYTES])
    at, packed = 8, b""
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IDAT":
            packed += stored[at + 8 : at + 8 + size]
        at += size + 12
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, spread and a 16-bin histogram (per mille) of the samples."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"{x.mean():.4f};{x.std():.4f};" + ",".join(map(str, bins))


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the payloads; the manifest: id, n_bytes, digest, shard, offset, length, stored once beside the shards.

    A shard's name holds its attempt, so a task that runs again after a loss leaves an
    unreferenced file, never a torn one.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _folder(folder)
        files.create_dir(root, recursive=True)
        shard, at, seen, out = f"{uuid.uuid4().hex}.tar", 0, {}, None
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                payload = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in seen:
                    member = encode_image(payload)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(member)
                    if out is None:
                        out = files.open_output_stream(f"{root}/{shard}", buffer_size=1 << 20)
                    head = info.tobuf(tarfile.GNU_FORMAT)
                    out.write(head + member + b"\0" * (-len(member) % tarfile.BLOCKSIZE))
                    seen[digest] = (at + len(head), len(member))
                    at += len(head) + len(member) + -len(member) % tarfile.BLOCKSIZE
                rows.append((len(text.encode("utf-8", "surrogatepass")) if text else 0, digest, shard, *seen[digest]))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "n_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
            out.close()

    kind = docs.schema[id_col].dataType.simpleString()
    manifest = source.mapInArrow(run, f"id {kind}, n_bytes long, digest string, shard string, offset long, length long")
    return common.stored(manifest, "media-manifest")


def objects_of(manifest: DataFrame) -> DataFrame:
    """One place for each digest: shard, offset and length."""
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    return manifest.groupBy("digest").agg(place).select("digest", "place.*")


def read_objects(objects: DataFrame, folder: str, features: bool = True) -> DataFrame:
    """Metadata columns by header-only range reads; with ``features`` also what whole members give.

    Members of a shard are read in order of offset by the task that the shard falls to.
    """
    near = objects.repartition("shard").sortWithinPartitions("shard", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _folder(folder)
        name = source = None
        for batch in batches:
            rows = []
            for o in batch.to_pylist():
                if o["shard"] != name:
                    if source is not None:
                        source.close()
                    name, source = o["shard"], files.open_input_file(f"{root}/{o['shard']}")
                width, height, bits = read_header(source.read_at(HEADER_BYTES, o["offset"]))
                row = [o["digest"], o["shard"], o["offset"], o["length"], width, height, bits]
                if features:
                    member = source.read_at(o["length"], o["offset"])
                    payload = decode_image(member)
                    row += [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(member), hashlib.sha256(member).hexdigest(), feature_of(payload)]
                rows.append(row)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=arrow)
        if source is not None:
            source.close()

    kinds = {"digest": "string", "shard": "string", "offset": "long", "length": "long", "width": "int", "height": "int", "bits": "int"}
    if features:
        kinds |= {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    arrow_kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    names, arrow = list(kinds), pa.schema([(k, arrow_kinds[v]) for k, v in kinds.items()])
    return near.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text of ``docs`` as an image and fill the media columns from what was stored.

    Per row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, width, height, shard, offset, length. Null and empty texts give
    one row of spaces; repeated rows and ids keep a row each and share one object; an empty
    table writes no shard; other columns are left out.
    """
    folder = folder or common.shared_dir(docs.sparkSession, "media-shards")
    manifest = write_shards(docs, folder, id_col, text_col)
    found = read_objects(objects_of(manifest), folder)
    return manifest.select("id", "n_bytes", "digest").join(found, "digest").drop("digest").withColumnRenamed("id", id_col)
