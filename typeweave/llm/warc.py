"""Operator 7: a dictionary-compressed WARC writer, and its reader.

Each archive (.warc.zst) begins with a skippable frame that holds a Zstandard dictionary built
from that archive's own records; each record is a Zstandard frame of its own that needs this
dictionary. Records with equal payloads of at least 100 bytes are written once, by the smallest
page id; the others are revisit records that name it. Archives are of a bounded size, written by
the executors to a temporary name in the shared folder and then renamed, so that a task that is
run again, or twice, leaves whole files only.

A dictionary is trained on pieces from the whole archive; where its records are too few or short for
that, the pieces themselves are the dictionary. Record ids, and so the bytes of an archive, depend on
its pages alone, so a task that runs again writes the same archives again. Readers take the archives
that a write has returned, not what else may lie in the folder.

Cases: a null html is an empty payload; a null url gives the target urn:page:<id>; line ends in
a url are dropped; rows with a null page_id are responses, and no other record refers to them;
repeated rows of the smallest page_id are all responses; an empty table gives no archive and an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.llm.common import new_path, redealt, slices, staged

#: Payloads below this are never deduplicated.
MIN_REVISIT_BYTES = 100
#: Payload bytes of an archive, about; what a task holds at a time.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes of an archive that train its dictionary, in pieces that lie evenly over all of it.
TRAIN_BYTES, PIECE_BYTES = 2 << 20, 4 << 10
LEVEL = 3
READ_BYTES = 4096
#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The upper half of the record ids; the lower half is the page id.
_ID_BASE = 0xFE1F5A6C0B3D4C8E << 64


def record_id(page_id: int | None, place: str = "") -> str:
    """A record's id, from which the page id can be read again; without one it is made of a place."""
    number = int.from_bytes(hashlib.md5(place.encode()).digest(), "big") >> 1 if page_id is None else _ID_BASE | page_id & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(record: str) -> int | None:
    number = uuid.UUID(record[len("<urn:uuid:") : -1]).int
    if number >> 64 << 64 != _ID_BASE:
        return None
    low = number & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: str = "") -> bytes:
    """A response record, or a revisit record where refers_to is given; place tells pages without id apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join((url or f"urn:page:{page_id}").splitlines()).encode("utf-8", "replace").decode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, place)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def training_pieces(records: list[bytes]) -> list[bytes]:
    """Pieces of TRAIN_BYTES in all, evenly over the records' bytes; whole records where there are fewer."""
    ends = np.cumsum([len(r) for r in records])
    total = int(ends[-1]) if len(ends) else 0
    if total <= TRAIN_BYTES:
        return records
    pieces = []
    for at in np.linspace(0, total - PIECE_BYTES, TRAIN_BYTES // PIECE_BYTES, dtype=np.int64).tolist():
        k = int(np.searchsorted(ends, at, side="right"))
        first = at - (int(ends[k - 1]) if k else 0)
        pieces.append(records[k][first : first + PIECE_BYTES])
    return pieces


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records; of few or short ones, what they hold is the dictionary."""
    samples = training_pieces(records)
    for step in (None, 512, 64):
        cut = samples if step is None else [s[at : at + step] for s in samples for at in range(0, len(s), step)]
        if len(cut) < 8:
            continue
        size = min(DICTIONARY_BYTES, max(1024, sum(map(len, cut)) // 10))
        try:
            return zstandard.train_dictionary(size, cut, k=200, d=8).as_bytes()
        except zstandard.ZstdError:
            continue
    return b"".join(samples)[:DICTIONARY_BYTES]


def write_archive(records: list[bytes]) -> bytes:
    """The bytes of an archive: the dictionary's skippable frame, then a frame for each record."""
    raw = build_dictionary(records)
    parts = [SKIPPABLE_MAGIC.to_bytes(4, "little"), len(raw).to_bytes(4, "little"), raw]
    made = zstandard.ZstdCompressionDict(raw)
    made.precompute_compress(LEVEL)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=made)
    return b"".join(parts + [compressor.compress(r) for r in records])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    if int.from_bytes(data[:4], "little") != SKIPPABLE_MAGIC:
        raise ValueError("an archive must begin with the frame of its dictionary")
    at = 8 + int.from_bytes(data[4:8], "little")
    raw = data[8:at]
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    while at < len(data):
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("an archive ends early")
            parts.append(one.decompress(data[at : at + READ_BYTES]))
            at += READ_BYTES
        at = min(at, len(data)) - len(one.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a record, in lower case, and its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode().partition(":")
        fields[name.lower()] = value.strip()
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's block is not as long as it says")
    return fields, rest[:length]


def revisits(pages: DataFrame) -> DataFrame:
    """Rows (page_id, digest, refers_to) of pages whose payload a smaller page_id has."""
    slim = pages.where((F.length("payload") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return slim.join(redealt(first, "digest"), "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives into the folder path; rows (archive, records, bytes) of what was written.

    The folder must be one that all executors reach. Each task writes its pages by page_id into
    archives of about archive_bytes, so that a task run again writes the same archives again.
    """
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col).cast("string"), "utf-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    dealt = own.join(revisits(own), ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to").sortWithinPartitions("page_id", "url", "payload")

    def run(batches):
        system, folder = pyarrow.fs.FileSystem.from_uri(path)
        task, written = TaskContext.get().partitionId(), []

        def close(records: list[bytes]) -> None:
            system.create_dir(folder, recursive=True)
            data, name = write_archive(records), f"part-{task:08d}-{len(written):05d}.warc.zst"
            part = f"{folder}/_{uuid.uuid4().hex}"  # readers pass over names with an underscore
            with system.open_output_stream(part) as out:
                out.write(data)
            system.move(part, f"{folder}/{name}")
            written.append((name, len(records), len(data)))

        records, size = [], 0
        for batch in slices(batches):
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = f"{task}/{len(written)}/{len(records)}"
                records.append(write_record(page_id, url, payload, digest, refers_to, place))
                size += len(records[-1])
                if size >= archive_bytes:
                    close(records)
                    records, size = [], 0
        if records:
            close(records)
        yield pa.RecordBatch.from_pylist([{"archive": a, "records": n, "bytes": b} for a, n, b in written], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return dealt.mapInArrow(run, "archive string, records bigint, bytes bigint")


def read(spark: SparkSession, path: str, written: DataFrame | None = None) -> DataFrame:
    """Rows of all records in a folder's archives, or in those that written(archive) names: (archive, record_id, page_id, url, record_type, refers_to, digest, payload_bytes, payload).

    payload is null for revisits; payload_bytes and digest are those of the full payload. A
    response whose payload does not have its digest raises ValueError.
    """
    schema = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        for batch in slices(batches, 1):
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for record in read_archive(data):
                    fields, block = parse_record(record)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    first = fields.get("warc-refers-to")
                    if first is None and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"a payload in {name} does not have its digest")
                    rows.append((name, fields["warc-record-id"], page_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], page_of(first) if first else None, digest, length, None if first else payload))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = "archive string, record_id string, page_id bigint, url string, record_type string, refers_to bigint, digest string, payload_bytes bigint, payload binary"
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.warc.zst").load(path)
    if written is not None:
        files = files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(written.select("archive"), "archive", "left_semi")
    return files.select("path", "content").mapInArrow(run, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder, and read back from there."""
    path = new_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    written = staged(write(pages, path), "written")
    if written.isEmpty():
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return read(spark, path, written).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op7_warc": query}
ORACLES = {
    "op7_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
}
