"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with the seek table
of the seekable format, a skippable frame that lists the sizes of all frames. An index
maps every record to its bundle, its frame and its place inside the frame, so one record
costs one seek and one frame.

Each task writes its own bundles under names that hold its attempt, and the index is a
table that Spark commits. A lost or repeated task leaves at most files that no index
row names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.registry import query
from tickweave.llm.shared import documents, lean, materialise, shards, small_batches
from tickweave.session import new_path

# fixed values of the seekable format and of WARC 1.1
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Names record ids; any fixed value will do.
SPACE = uuid.UUID("6f1f4c0e-53b8-4b60-9a6b-2f4f1f6c1d11")
INDEX = "record_id string, page_id long, bundle string, frame int, at int, length int"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}/{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or with ``refers_to`` a revisit that holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": date,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    }
    if url is not None:
        fields["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if page is not None:
        fields["X-Page-Id"] = str(page)
    if refers_to is not None:
        fields["WARC-Profile"] = SAME_PAYLOAD
        fields["WARC-Refers-To"] = record_id(refers_to, digest)
        fields["X-Refers-To-Page-Id"] = str(refers_to)
    fields["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of the record, fields of its HTTP header, and its payload."""
    end = data.index(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
    end = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:end].decode().split("\r\n")[1:])
    return fields, http, block[end + 4 :]


def _number(field: str | None) -> int | None:
    return None if field is None else int(field)


class Bundle:
    """Writes frames and, on closing, the seek table."""

    def __init__(self, uri: str, level: int = 3):
        import zstandard

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.zip, self.sizes, self.written = store.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level), [], 0

    def frame(self, data: bytes) -> None:
        packed = self.zip.compress(data)
        self.out.write(packed)
        self.sizes.append((len(packed), len(data)))
        self.written += len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Seekable:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, uri: str):
        import zstandard

        store, path = fs.FileSystem.from_uri(uri)
        self.file, self.unzip, self.held = store.open_input_file(path), zstandard.ZstdDecompressor(), (-1, b"")
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def read(self, frame: int, at: int, length: int) -> bytes:
        if self.held[0] != frame:
            start, packed, plain = self.frames[frame]
            self.held = frame, self.unzip.decompress(self.file.read_at(packed, start), max_output_size=plain)
        return self.held[1][at : at + length]


def with_originals(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` with ``digest`` and ``refers_to``, the page that holds the same payload in full, else null.

    Payloads of at least ``least`` bytes are compared by SHA-256. Copies are counted by a
    partial aggregation of digests; only groups of two or more are joined back.
    """
    held = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("same", F.when(F.octet_length("html") >= least, F.sha2("html", 256)))
    groups = (
        held.where(F.col("same").isNotNull())
        .groupBy("same")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("original"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    joined = held.join(materialise(groups, "originals"), "same", "left")
    # the null of a missing original compares unequal to every page, so its rows are responses
    other = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", "html", F.sha1("html").alias("digest"), F.when(other, F.col("original")).alias("refers_to")
    )


def write_bundles(
    pages: DataFrame,
    folder: str,
    frame_bytes: int = 256 << 10,
    bundle_bytes: int = 64 << 20,
    least: int = 1000,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row of ``pages`` (``page_id, url, html``) under ``folder``; returns the written index.

    Of records with equal payloads of at least ``least`` bytes, that with the largest
    ``page_id`` is a response and the others revisit it; repeated rows of that page are
    responses all. A null id is never revisited; a null html is an empty payload; a null
    url is left out. Other columns are ignored. No rows give no bundle and an empty index.
    ``folder`` is a URI that all executors reach and that ``pyarrow.fs`` can open.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem, number, bundle, frame = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, []
        rows: list[tuple] = []
        size = 0

        def end_frame() -> None:
            nonlocal frame, size
            if frame:
                bundle.frame(b"".join(frame))
                frame, size = [], 0

        def end_bundle() -> pa.RecordBatch:
            nonlocal bundle, rows, number
            end_frame()
            bundle.close()
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            names = ["record_id", "page_id", "bundle", "frame", "at", "length"]
            bundle, rows, number = None, [], number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in shards(batches, "html"):
            for page, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"{stem}-{number}.warc.zst"
                bundle = bundle or Bundle(name)
                data = record(page, url, html.encode(), digest, refers_to, date)
                rows.append((record_id(page, digest), page, name, len(bundle.sizes), size, len(data)))
                frame.append(data)
                size += len(data)
                if size >= frame_bytes:
                    end_frame()
                    if bundle.written >= bundle_bytes:
                        yield end_bundle()
        if bundle:
            yield end_bundle()

    return materialise(small_batches(with_originals(pages, least)).mapInArrow(lean(write), INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """The records that rows of an index name, read by frame: facts of the full payload, kind, original and url.

    A response whose payload doesn't have the digest of its header is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, bundle = None, None
        for batch in batches:
            rows = []
            for path, frame, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != name:
                    name, bundle = path, Seekable(path)
                fields, http, payload = parse(bundle.read(frame, at, length))
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind = fields["WARC-Type"]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{fields['WARC-Record-ID']} in {path} is damaged")
                page, other = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                n = len(payload) if kind == "response" else int(http["Content-Length"])
                rows.append(
                    (_number(page), n, digest, kind, _number(other), fields.get("WARC-Target-URI"))
                )
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    places = index.select("bundle", "frame", "at", "length")
    return places.repartition("bundle").sortWithinPartitions("bundle", "frame", "at").mapInArrow(lean(read), READ)


@query(
    "op4_warc_bundles",
    """
    with p as (
        select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
               max(page_id) over (partition by coalesce(html, '')) as original
        from pages
    )
    select page_id, payload_bytes, payload_digest,
           case when payload_bytes >= 1000 and page_id <> original then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= 1000 and page_id <> original then original end as refers_to
    from p
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(documents(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_records(index).drop("url")
