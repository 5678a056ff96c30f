"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole records up to about FRAME_BYTES, and a seek
table in a skippable frame at its end (the public seekable format: compressed and plain size of each frame, their number, a magic number). Any
Zstandard reader reads the whole. The index maps a record to its bundle, the number of its frame and its place in that; the footer of the bundle says where
the frame lies, and only that frame is opened. Spark deals the pages,
each task writes one bundle, and its records' places come back as rows of the index.

A file has a name of its own for each attempt, and the index names only files of attempts whose rows were committed, so lost or doubled
tasks leave at most files that nothing names. Files go through the file system of spark.checkpoint.dir.

Payloads with equal bytes are told by SHA-1 and length. The response is the row with the smallest page_id, and the others
revisit it without storing the payload again; counts are combined before the shuffle, so a payload of a
third of all rows is one row for each task. Digests that occur again are broadcast up to BROADCAST_DIGESTS of them; beyond that
digests meet without payloads, the hot ones apart, and a payload meets only the rows of its own page_id.

Defined results: null html is an empty payload; null url gets an empty target; repeated rows of the smallest page_id
are all responses; long payloads are frames of their own; null page_ids never revisit nor are revisited while another row has an id; payloads under
the least size for revisits are all responses; an empty table gives an empty result; other columns of the input don't matter.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, join_hot, new_path, staged

FRAME_BYTES = 1 << 18
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: The skippable frame and the seek table of the seekable format. Fixed values.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame int, offset long, length long"
#: Bytes of records that a task reads back, about.
READ_BYTES = 1 << 24
#: Digests that may be broadcast: about 70 bytes each.
BROADCAST_DIGESTS = 200_000


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries no payload, but its size and digest."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += [f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, in lower case, and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    return headers, rest[:n]


class BundleWriter:
    """Writes records into frames; close() appends the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.size = [], 0
        self.frames: list[tuple[int, int]] = []
        self.places: list[tuple[int, int, int]] = []  # frame, the record's place and length in it

    def add(self, raw: bytes) -> None:
        self.places.append((len(self.frames), self.size, len(raw)))
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            data = self.zstd.compress(b"".join(self.held))
            self.out.write(data)
            self.frames.append((len(data), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of each frame, from the footer alone."""
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - width * count)
    table, at, out = file.read(width * count), 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", table, width * i)
        out.append((at, packed, plain))
        at += packed
    return out


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class BundleReader:
    """Opens a bundle's frames by its seek table, one at a time."""

    def __init__(self, bundle: str):
        system, path = _file_system(bundle)
        self.file, self.zstd, self.frame, self.plain = system.open_input_file(path), zstandard.ZstdDecompressor(), -1, b""
        self.frames = seek_table(self.file, self.file.size())

    def record(self, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        if frame != self.frame:
            at, packed, _ = self.frames[frame]
            self.file.seek(at)
            self.plain, self.frame = self.zstd.decompress(self.file.read(packed)), frame
        return parsed(self.plain[offset : offset + length])


def read_record(bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its entry in the index: reads the footer and one frame."""
    return BundleReader(bundle).record(frame, offset, length)


def write_bundles(rows: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes rows (page_id, url, payload, size, sha1, refers_to), a bundle for each task, and returns the staged index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        out, writer, ids = None, None, []
        for batch in batches:
            for page_id, url, payload, size, sha1, refers_to in zip(*batch.columns, strict=True):
                if writer is None:
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                    writer = BundleWriter(out, frame_bytes)
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                ids.append(page_id.as_py())
                writer.add(record(ids[-1], url.as_py(), (payload.as_py() or "").encode("utf-8", "surrogatepass"), size.as_py(), digest, refers_to.as_py()))
        if writer is not None:
            writer.close()
            out.close()
            places = zip(*writer.places, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64())
            columns = [pa.array(ids, pa.int64()), pa.array([f"{folder}/{name}"] * len(ids)), *(pa.array(x, k) for x, k in zip(places, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in INDEX.split(", ")])

    return staged(rows.mapInArrow(write, INDEX), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload of each record of the index, read from the bundles, each frame once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, reader = None, None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for own, frame, offset, length in zip(*(batch.column(x).to_pylist() for x in ("bundle", "frame", "offset", "length")), strict=True):
                if own != bundle:
                    bundle, reader = own, BundleReader(own)
                headers, payload = reader.record(frame, offset, length)
                number = [headers.get(x, "").removeprefix("<urn:page:").removesuffix(">") for x in ("warc-record-id", "warc-refers-to")]
                values = (int(number[0]) if number[0] else None, int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"])
                values += (int(number[1]) if number[1] else None, headers["warc-target-uri"], payload if headers["warc-type"] == "response" else None)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            keys = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=list(keys))

    tasks = bucket_count(index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], READ_BYTES)
    sorted_frames = index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return sorted_frames.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits), size, sha1, refers_to of each row."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"), F.octet_length(html).cast("long").alias("size"), F.sha1(html).alias("sha1"))
    digests = staged(rows.select("page_id", "size", "sha1", F.concat_ws(":", "sha1", "size").alias("digest")), "digests")
    first = digests.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = staged(first.where("n > 1 and first_id is not null").select("digest", "first_id"), "repeated-digests")
    again = F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(False))
    if first.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        joined = rows.withColumn("digest", F.concat_ws(":", "sha1", "size")).join(F.broadcast(first), "digest", "left").withColumn("refers_to", F.when(again, F.col("first_id")))
    else:
        revisits = join_hot(digests, first, "digest", BROADCAST_DIGESTS).where(again).select("page_id", "sha1", F.col("first_id").alias("refers_to")).distinct()
        joined = rows.join(revisits, ["page_id", "sha1"], "left")
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "sha1", "refers_to")


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages as bundles under the shared folder and returns the index of their records."""
    return write_bundles(with_revisits(pages, least_bytes), new_path(pages.sparkSession, "warc"))


def archive_report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row, as read back from the archives."""
    return read_bundles(archive(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
