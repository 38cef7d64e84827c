"""WARC archives with an embedded Zstandard dictionary.

Writing: a dictionary is built from a bounded sample of the pages to archive
(``sample_rows`` pages by hash order, their first ``sample_bytes`` bytes).
Every archive file begins with a skippable frame (magic 0x184D2A5D) holding
the dictionary, so it can be read alone; then each record is one Zstandard
frame compressed with it, so that records can be read one by one.  Pages with
equal payloads are stored once: the one with the smallest id is a response,
the others are revisits that name it.

Reading: archives are read frame by frame; a record is parsed and its digest
recomputed from the stored payload, so only one record is in memory.

Files are written under a temporary name and renamed when complete; their
names depend on the partition only, so a task repeated after a lost executor
replaces its own file.

Defined results: a null page body is an empty payload; a null url becomes
``urn:page:<id>``; a page without an id is always a response; repeated rows of
one id are all responses (they are one page); payloads below ``least_bytes``
are always responses; an empty table gives no archives and no rows.  Only the
named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import freeze, scratch

SKIPPABLE = 0x184D2A5D
WARC_DATE = "1970-01-01T00:00:00Z"
NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "archive", "frame_offset"]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _field(value: str) -> str:
    """Header values hold no line ends or control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id, url: str | None, payload: bytes, refers_to, date: str = WARC_DATE) -> bytes:
    """One WARC/1.1 record: a response with its HTTP message, or a revisit
    with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = _field(url) if url else f"urn:page:{page_id}"
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers (lower-cased names) and block of one record, checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} has a wrong length")
    fields["block"] = rest[:length]
    return fields


def page_row(fields: dict) -> tuple:
    """Page id, payload length, digest, type and the page it refers to.  A
    response's length and digest are those of the payload read; a revisit's
    are in its HTTP and WARC headers."""
    http, _, payload = fields["block"].partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page = int(fields["x-page-id"]) if "x-page-id" in fields else None
    kind = fields["warc-type"]
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if stated != len(payload) or digest(payload) != said:
            raise ValueError(f"payload of page {page} is damaged")
        return page, len(payload), said, kind, None, fields["warc-target-uri"]
    return page, stated, said, kind, int(fields["x-refers-to-page-id"]), fields["warc-target-uri"]


def build_dictionary(samples: list[bytes], size: int = 32 * 1024) -> bytes:
    """A dictionary trained on the samples; of too few of them, their own
    bytes; of none, nothing."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class ArchiveWriter:
    """Writes the leading dictionary frame, then one frame per record."""

    def __init__(self, sink, dictionary: bytes, level: int = 3):
        self.sink = sink
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=True)
        sink.write(SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
        self.offset = 8 + len(dictionary)

    def add(self, data: bytes) -> int:
        """Where the record's frame begins."""
        frame = self.compressor.compress(data)
        self.sink.write(frame)
        at, self.offset = self.offset, self.offset + len(frame)
        return at


def read_archive(source, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of every record of an archive, in order."""
    head = source.read(8)
    if len(head) != 8 or int.from_bytes(head[:4], "little") != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = source.read(int.from_bytes(head[4:], "little"))
    decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    offset, held = 8 + len(dictionary), b""
    while True:
        held = held or source.read(chunk)
        if not held:
            return
        frame, parts, used = decompressor.decompressobj(), [], 0
        while True:
            parts.append(frame.decompress(held))
            if frame.eof:
                used += len(held) - len(frame.unused_data)
                held = frame.unused_data
                break
            used += len(held)
            held = source.read(chunk)
            if not held:
                raise ValueError("the archive ends within a record")
        yield offset, b"".join(parts)
        offset += used


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    sample_rows: int = 2000,
    sample_bytes: int = 16 * 1024,
    archives: int | None = None,
) -> DataFrame:
    """Write one archive per partition into ``folder`` (which the driver and
    all executors share); returns the written manifest ``path, records,
    bytes``."""
    spark = pages.sparkSession
    src = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    same = src.select("page_id", F.sha2("payload", 256).alias("sha"), F.length("payload").alias("n"))
    groups = freeze(
        same.where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").select(F.col("sha").alias("s"), "first"),
        "payloads",
    )
    # rows of one id may hold different payloads: a revisit is a page and a payload
    revisits = same.join(groups, F.col("sha") == F.col("s")).where("page_id <> first").select(F.col("page_id").alias("p"), F.col("sha").alias("of"), "first").distinct()
    # a bounded sample: hashes below a limit that lets about twice as many rows through, of those the
    # smallest; so a task hands on a few rows, not sample_rows each, and one small task trains
    total = pages.count()
    share = 1 << 20
    limit = share if total <= 2 * sample_rows else max(1, 2 * sample_rows * share // total)
    hashed = src.where("length(payload) > 0").select(
        F.xxhash64("page_id", "payload").alias("h"), "page_id", "url", F.substring("payload", 1, sample_bytes).alias("s")
    )
    sample = hashed.where(F.pmod(F.col("h"), F.lit(share)) < limit).orderBy("h").limit(sample_rows)

    def train(batches):
        # whole records, headers and all; every eighth also as a revisit
        rows = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns[1:]))]
        samples = [record(page, target, s, None) for page, target, s in rows]
        samples += [record(page, target, s, page) for page, target, s in rows[::8] if page is not None]
        yield pa.RecordBatch.from_arrays([pa.array([build_dictionary(samples)], pa.binary())], names=["d"])

    trained = sample.coalesce(1).mapInArrow(train, "d binary").collect()
    dictionary = bytes(trained[0]["d"]) if trained else b""

    def write(batches):
        from pyspark import TaskContext

        writer = sink = None
        n, part = 0, TaskContext.get().partitionId()
        system, root = _open(folder)
        final = f"{root}/part-{part:06d}.warc.zst"
        temporary = f"{final}.{uuid.uuid4().hex}.tmp"
        for batch in batches:
            for page, target, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    sink = system.open_output_stream(temporary, compression=None)
                    writer = ArchiveWriter(sink, dictionary)
                writer.add(record(page, target, payload, first))
                n += 1
        if writer is not None:
            sink.close()
            system.move(temporary, final)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{part:06d}.warc.zst"]), pa.array([n], pa.int64()), pa.array([writer.offset], pa.int64())], names=["path", "records", "bytes"])

    # the join's own partitions become the archives: page texts are shuffled once at most
    told = src.withColumn("sha", F.sha2("payload", 256))
    rows = told.join(revisits, (F.col("page_id") == F.col("p")) & (F.col("sha") == F.col("of")), "left").select("page_id", "url", "payload", "first")
    dealt = rows.repartition(archives) if archives else rows
    return freeze(dealt.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """One row per record of the archives named in ``path``; a file per task
    at a time."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = _open(path)
                rows: list[tuple] = []
                with system.open_input_stream(inner, compression=None) as source:
                    for offset, data in read_archive(source):
                        rows.append((*page_row(parse_record(data)), path.rsplit("/", 1)[1], offset))
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string, frame_offset long"
    return paths.select("path").repartition(width, "path").mapInArrow(read, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=NAMES)


def archive_pages(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write all pages, then read the archives back."""
    spark = pages.sparkSession
    manifest = write_archives(pages, folder or scratch(spark, "warc"), **options)
    return read_archives(spark, manifest)
