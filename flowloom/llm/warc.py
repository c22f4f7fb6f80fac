"""WARC archives in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each holding whole WARC records,
and ends with a seek table in a skippable frame, so that any Zstandard reader sees one
plain WARC file while a record is reached by decompressing its frame alone. The index
maps a record's identifier to bundle, frame, and offset and length within the frame.

A payload is stored once: of the captures of equal payloads the one of the smallest id
is a response, all others are revisits that name it. The response's identifier comes from
the payload's digest, so a revisit is written without looking at its response.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm import common

#: Bytes of records that close a frame, and of frames that close a bundle. A longer record has a frame of its own.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 30
LEVEL = 3

# Numbers of the public Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")  # frames, descriptor, magic
ENTRY = struct.Struct("<III")  # compressed size, size, checksum
CHECKSUMS = 0x80  # of the descriptor

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "id {kind}, record_id string, record_type string, bundle string, frame int, offset long, length long"


def record_id(*parts: object) -> str:
    """An identifier that depends on ``parts`` alone, so that reruns agree."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=4)}>"


def _line(value: object) -> bytes:
    """A header value: line breaks and other control characters would end it, so they are percent-encoded."""
    return b"".join(b"%%%02X" % c if c < 32 or c == 127 else bytes([c]) for c in str(value).encode("utf-8", "surrogatepass"))


def make_record(kind: str, own_id: str, url: str | None, key: object, digest: str, size: int, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A WARC/1.1 record; a revisit's block has the response's HTTP header alone, with the length of the full payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    fields += [("WARC-Target-URI", url)] if url else []
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)] if refers_to else []
    fields += [("X-Capture-Key", key)] if key is not None else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + b"".join(b"%s: %s\r\n" % (k.encode(), _line(v)) for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """Header fields, HTTP fields, payload and the place after the record that starts at ``at``."""
    if data[at : at + 5] != b"WARC/":
        raise ValueError(f"no WARC record at {at}")
    body = data.index(b"\r\n\r\n", at) + 4
    fields = _fields(data[at : body - 4])
    end = body + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has another length than it says")
    split = data.index(b"\r\n\r\n", body) + 4
    return fields, _fields(data[body : split - 4]), data[split:end], end + 4


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The skippable frame with compressed size, size and checksum of every frame."""
    body = b"".join(ENTRY.pack(*f) for f in frames) + FOOTER.pack(len(frames), CHECKSUMS, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def checksum(data: bytes) -> int:
    """The low 32 bits of XXH64, as the format has it."""
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class BundleReader:
    """Random access to the frames of one bundle by its seek table."""

    def __init__(self, files: pafs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        n, descriptor, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE_MAGIC or not descriptor & CHECKSUMS:
            raise ValueError(f"{path} has no seek table with checksums")
        table = self.file.read_at(n * ENTRY.size, size - FOOTER.size - n * ENTRY.size)
        self.entries, self.starts, at = list(ENTRY.iter_unpack(table)), [], 0
        for packed, _, _ in self.entries:
            self.starts.append(at)
            at += packed

    def frame(self, k: int) -> bytes:
        packed, size, check = self.entries[k]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[k]), max_output_size=size)
        if len(data) != size or checksum(data) != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def close(self) -> None:
        self.file.close()


class BundleWriter:
    """Groups records into frames and frames into bundles; ``add`` gives frame, offset and length of a record."""

    def __init__(self, files: pafs.FileSystem, root: str):
        self.files, self.root, self.out = files, root, None
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, record: bytes) -> tuple[str, int, int, int]:
        if self.out is None:
            self.name, self.frames, self.held, self.size, self.written = f"{uuid.uuid4().hex}.warc.zst", [], [], 0, 0
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}", compression=None, buffer_size=1 << 20)
        if self.held and self.size + len(record) > FRAME_BYTES:
            self._close_frame()
        place = (self.name, len(self.frames), self.size, len(record))
        self.held.append(record)
        self.size += len(record)
        if self.size >= FRAME_BYTES:
            self._close_frame()
            if self.written >= BUNDLE_BYTES:
                self.close()
        return place

    def _close_frame(self) -> None:
        data = b"".join(self.held)
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), checksum(data)))
        self.held, self.size, self.written = [], 0, self.written + len(packed)

    def close(self) -> None:
        if self.out is not None:
            if self.held:
                self._close_frame()
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None


def captures(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """Rows with their payload's SHA-1 and whether they are its response.

    Only digests and ids meet to find each payload's smallest id. Payloads move once, by
    digest and id together, so that a payload of very many captures is dealt over all
    tasks. Of repeated rows of that id one is the response.
    """
    payload = common.text_of(payload_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1(F.col("payload").cast("binary")))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    ids = rows.select("sha1", "n_bytes", F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")).alias("key"))
    firsts = ids.filter(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    keyed = rows.withColumn("key", F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    alike = Window.partitionBy("sha1", "key").orderBy(F.col("url").asc_nulls_last())
    found = keyed.join(firsts.hint("merge"), ["sha1", "key"], "left").withColumn("nth", F.row_number().over(alike))
    role = F.when(F.col("n_bytes") < min_bytes, "response").when(F.col("first") & (F.col("nth") == 1), "response").otherwise("revisit")
    return found.select("id", "url", "payload", "sha1", "nth", role.alias("record_type"))


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row; the index: id, record_id, record_type, bundle, frame, offset, length, stored.

    A bundle's name is new in each attempt, so a task that runs again after a loss leaves
    an unreferenced file, never a torn one.
    """
    source = captures(pages, id_col, url_col, payload_col, min_bytes)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        writer = BundleWriter(files, root)
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "sha1", "nth", "record_type")]
            made = []
            for key, url, payload, sha1, nth, role in zip(*columns):
                key, digest, role = key.as_py(), base64.b32encode(sha1.as_py()).decode(), role.as_py()
                raw = payload.as_buffer().to_pybytes()
                first, shared = record_id(digest), len(raw) >= min_bytes
                own = first if shared and role == "response" else record_id(digest, key, nth.as_py())
                record = make_record(role, own, url.as_py(), key, digest, len(raw), raw if role == "response" else b"", first if role == "revisit" else None, date)
                made.append((own, role, *writer.add(record)))
            names, kinds = ("record_id", "record_type", "bundle", "frame", "offset", "length"), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([columns[0], *(pa.array(c, k) for c, k in zip(list(zip(*made)) or [()] * 6, kinds))], ["id", *names])
        writer.close()

    return common.stored(source.mapInArrow(run, INDEX.format(kind=kind)), "warc-index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Read every record of ``index`` back: record_id, what its header says, and what its payload is.

    Frames are dealt over the tasks; each is read by its place in the seek table and
    decompressed once. A response's length and digest are computed from the payload as
    read and must be those that its header states.
    """
    near = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        name = at = bundle = data = None
        for batch in batches:
            rows = []
            for place in batch.to_pylist():
                if place["bundle"] != name:
                    if bundle is not None:
                        bundle.close()
                    name, at, bundle = place["bundle"], None, BundleReader(files, f"{root}/{place['bundle']}")
                if place["frame"] != at:
                    at, data = place["frame"], bundle.frame(place["frame"])
                fields, http, payload, end = parse_record(data, place["offset"])
                digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                if end != place["offset"] + place["length"] or fields["warc-record-id"] != place["record_id"]:
                    raise ValueError(f"{place['record_id']} isn't where the index has it")
                if fields["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"the payload of {place['record_id']} isn't what its header says")
                rows.append((place["record_id"], fields["warc-type"], fields.get("warc-refers-to"), size, digest))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            names = ["record_id", "read_type", "refers_to_record", "payload_bytes", "payload_digest"]
            arrays = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays, *(batch.column(c) for c in PLACE)], ["id", *names, *PLACE])
        if bundle is not None:
            bundle.close()

    kind = index.schema["id"].dataType.simpleString()
    return near.mapInArrow(run, f"id {kind}, record_id string, read_type string, refers_to_record string, payload_bytes long, payload_digest string, bundle string, frame int, offset long, length long")


PLACE = ("bundle", "frame", "offset", "length")


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` into bundles and give what reading them back shows, a row per page.

    Columns: id, payload_bytes, payload_digest (base32 SHA-1), both of the full payload,
    record_type, refers_to (the response's id, for revisits), record_id, bundle, frame,
    offset, length. A null payload is empty. Payloads shorter than ``min_bytes`` are all
    responses. Null ids come last when a response is chosen, and a revisit of one refers to
    null; repeated rows keep a row each; an empty table writes no bundle; other columns
    are left out.
    """
    folder = folder or common.shared_dir(pages.sparkSession, "warc-bundles")
    index = write_bundles(pages, folder, id_col, url_col, payload_col, min_bytes)
    found = common.stored(read_bundles(index, folder), "warc-read")
    responses = found.filter("read_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("id").alias("refers_to"))
    named = found.filter("read_type = 'revisit'").join(responses.hint("merge"), "refers_to_record")
    both = found.filter("read_type = 'response'").withColumn("refers_to", F.lit(None).cast(index.schema["id"].dataType)).unionByName(named)
    return both.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", F.col("read_type").alias("record_type"), "refers_to", "record_id", *PLACE)
