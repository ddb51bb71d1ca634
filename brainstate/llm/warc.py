"""WARC archives: a writer that keeps each payload once, and a splittable reader.

Writer: each task writes one archive into the shared folder, a gzip member for
each record, and reports its path and size. The report is stored, so that only
archives of tasks that were committed are read; what a lost attempt left behind
has another name and is never listed.

Reader: archives are cut into byte ranges. A task scans its range for the gzip
magic, validates each candidate by decoding the start of the member as a WARC
header, and owns the records whose member starts inside its range; the last one
may end beyond it.

Defined results: a null html counts as empty. Of equal payloads of at least
`min_revisit` bytes the smallest page_id is the response and other ids revisit
it; rows that repeat that id and payload are responses too, and so are pages without an id. Shorter payloads are all
responses. Null urls and ids are left out of the record's header and come back as
null. An empty table gives no archives and no records.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brainstate.llm.common import new_folder, slices, stored

MIN_REVISIT = 100
SPLIT_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"

_MANIFEST = "path string, size long, n_records long"
_RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, path string, start long"
)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """One record as a gzip member; first is the id of the page with the same payload, if another."""
    revisit = first is not None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", len(payload)),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", page_id))
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if revisit:
        head += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", _record_id(first, digest)),
            ("X-Refers-To-Page-ID", first),
        ]
    block = HTTP_HEAD + (b"" if revisit else payload)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    text = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(VERSION + text + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, n = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
        where, local = fs.FileSystem.from_uri(path)
        for batch in slices(batches, "payload"):
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    where.create_dir(posixpath.dirname(local), recursive=True)
                    out = where.open_output_stream(local, compression=None)
                member = _record(*row)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "n_records": [n]})

    return write


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write pages (page_id, url, html) as archives below folder; the stored list of archives."""
    rows = pages.select(
        F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    # Digests and ids find out who revisits whom; payloads are only dealt by id and digest, so that a page which very
    # many others repeat is no hot key.
    ids = rows.filter(F.length("payload") >= min_revisit).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = ids.join(first, "digest").filter("first_id <> page_id").distinct()
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "first_id")
    return stored(rows.mapInArrow(_writer(folder), _MANIFEST), "manifest")


def _begins(data: bytes, at: int) -> bool:
    """True if the bytes at `at` decode to the start of a WARC header, as far as they go."""
    try:
        text = zlib.decompressobj(31).decompress(memoryview(data)[at : at + 4096], len(VERSION))
    except zlib.error:
        return False
    return VERSION.startswith(text)


def _member(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The member that starts at `at` and where it ends; -1 if beyond data, None if it isn't one."""
    unpack, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not unpack.eof and at < len(data):
            out.append(unpack.decompress(view[at : at + 8192]))
            at += len(view[at : at + 8192])
    except zlib.error:
        return None
    return b"".join(out), at - len(unpack.unused_data) if unpack.eof else -1


def _fields(text: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return fields, rest


def _parsed(text: bytes) -> tuple:
    fields, rest = _fields(text)
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda k: int(fields[k]) if k in fields else None
    if fields["WARC-Type"] == "revisit":
        return (
            number("X-Page-ID"),
            fields.get("WARC-Target-URI"),
            "revisit",
            number("X-Refers-To-Page-ID"),
            number("X-Payload-Length"),
            fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            None,
        )
    digest = hashlib.sha256(payload).hexdigest()
    if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
    return (number("X-Page-ID"), fields.get("WARC-Target-URI"), "response", None, len(payload), digest, payload)


def _records(path: str, start: int, end: int, size: int) -> Iterator[tuple]:
    """Records of the members that start in [start, end)."""
    where, local = fs.FileSystem.from_uri(path)
    with where.open_input_file(local) as file:
        data = file.read_at(min(end + len(MAGIC) - 1, size) - start, start)
        at = data.find(MAGIC)
        while at >= 0 and start + at < end:
            found = None
            if _begins(data, at):
                found = _member(data, at)
                while found and found[1] < 0 and start + len(data) < size:  # it ends beyond what was read
                    data += file.read_at(min(max(1 << 16, len(data)), size - start - len(data)), start + len(data))
                    found = _member(data, at)
            if found and found[1] >= 0 and found[0].startswith(VERSION):
                yield *_parsed(found[0]), path, start + at
                at = data.find(MAGIC, found[1])
            else:
                at = data.find(MAGIC, at + 1)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )

    rows, held = [], 0
    for batch in batches:
        for part in batch.to_pylist():
            for record in _records(part["path"], part["start"], part["end"], part["size"]):
                rows.append(record)
                held += len(record[6] or b"")
                if held > 1 << 23 or len(rows) >= 2000:
                    yield made(rows)
                    rows, held = [], 0
    if rows:
        yield made(rows)


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archives in manifest (path, size), by byte ranges of split_bytes."""
    # One task a range: the count is given, else adaptive execution merges these few small rows.
    n = manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))
    ranges = (
        manifest.filter("size > 0")
        .select("path", "size", F.explode(starts).alias("start"))
        .withColumn("end", F.least(F.col("start") + split_bytes, "size"))
        .repartition(int(n), "path", "start")
    )
    return ranges.mapInArrow(_reader, _RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    spark: SparkSession = pages.sparkSession
    return read_archives(write_archives(pages, new_folder(spark, "warc")))
