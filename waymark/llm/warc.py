"""WARC archives, index first.

write_archives() writes one gzip member per record (WARC/1.1) and returns the index: file, offset,
length, URL and digest per record. read_records() sorts the selected index rows by file and offset,
merges neighbours into byte ranges and reads each range once.

Equal payloads (SHA-256 and length; the SHA-1 of the format names them only) of ``min_bytes`` or
more: the record with the least page_id is the response, the others revisit it. The archives go to
the folder that driver and executors share, through pyarrow's file systems; a task that is run
again writes files of new names, and the index, a table of its own, names those of the attempt that
succeeded.

Cases: null html is an empty payload; a null URL is written as an empty one and read as null; rows
that repeat the least page_id of a payload are all responses; a null page_id never is the least of
a payload that has another; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, shared_dir, table

DATE = "1970-01-01T00:00:00Z"
MIN_BYTES, ROLL_BYTES, GZIP_LEVEL = 0, 256 << 20, 4
#: Ranges are merged over gaps up to GAP bytes and up to RANGE bytes in all.
GAP, RANGE = 64 << 10, 8 << 20
#: Archive bytes that one reading task takes; less, down to LEAST_PART, where cores would stay idle.
PART, LEAST_PART = 256 << 20, 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """The bytes of a record, not compressed."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; the payload is None in a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    number = lambda s: None if s == "none" else int(s)
    out = {
        "page_id": number(fields["WARC-Record-ID"][10:-1]), "url": fields["WARC-Target-URI"] or None,
        "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in fields else None,
        "payload": None if fields["WARC-Type"] == "revisit" else payload,
    }
    if out["payload"] is not None and (len(payload) != size or digest(payload) != out["payload_digest"]):
        raise ValueError(f"page {out['page_id']}: payload and digest differ")
    return out


def with_duplicates(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit). The least page_id per payload is combined before
    the shuffle; only payloads that repeat are joined, from a table: if it is small no payload moves,
    else adaptive execution can split a hot one."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload)
    rows = rows.withColumn("key", F.concat(F.unhex(F.sha2("payload", 256)), F.unhex(F.lpad(F.hex(F.octet_length("payload")), 16, "0"))))
    least = rows.groupBy(F.col("key").alias("__k")).agg(F.min("page_id").alias("__first"), F.count("*").alias("__n"))
    least = materialise(least.where("__n > 1").select("__k", "__first"))
    same = F.col("__first").isNotNull() & (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return rows.join(broadcast_if_small(least), F.col("key") == F.col("__k"), "left").select(
        "page_id", "url", "payload", F.when(same, F.col("__first")).alias("refers_to"), same.alias("revisit")
    )


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, date: str = DATE,
                   roll_bytes: int = ROLL_BYTES, level: int = GZIP_LEVEL) -> DataFrame:
    """Writes the archives below ``folder`` (a URI that all executors reach) and returns the index,
    read from a table beside them."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = pafs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            page, url, payload, refers, revisit = b.columns
            rows = []
            for i in range(b.num_rows):
                if out is None or at >= roll_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{path}/{name}", compression=None)
                body = payload[i].as_py()
                raw = record(page[i].as_py(), url[i].as_py(), body, refers[i].as_py(), revisit[i].as_py(), date)
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(raw) + pack.flush()
                out.write(member)
                kind = "revisit" if revisit[i].as_py() else "response"
                rows.append((page[i].as_py(), url[i].as_py(), digest(body), kind, refers[i].as_py(), name, at, len(member)))
                at += len(member)
            types = [pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in INDEX.split(", ")]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
        if out is not None:
            out.close()

    index = materialise(with_duplicates(pages, min_bytes).mapInArrow(run, INDEX))
    return index.withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


def _ranges(rows: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, records) of neighbours that are read together."""
    file, start, end, held = None, 0, 0, []
    for f, offset, length in rows:
        if held and (f != file or offset - end > gap or offset + length - start > most):
            yield file, start, end, held
            held = []
        if not held:
            file, start = f, offset
        end = offset + length
        held.append((offset, length))
    if held:
        yield file, start, end, held


def read_records(index: DataFrame, gap: int = GAP, most: int = RANGE, payloads: bool = True) -> DataFrame:
    """The records that ``index`` (file, offset, length) selects, parsed; payload checked against
    its digest. Without ``payloads`` they stay in the reading task."""
    index = index.select("file", "offset", "length")
    # As many partitions as the archives' bytes ask for; the index itself is far too small to tell.
    size = index.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-size // PART), min(index.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_PART)))
    spread = index.repartitionByRange(parts, F.col("file"), F.col("offset")).sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    fields = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    if payloads:
        schema, fields = f"{schema}, payload binary", [*fields, pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, opened, source = None, None, None
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for file, start, end, held in _ranges(rows, gap, most):
                if file != opened:
                    where, path = pafs.FileSystem.from_uri(file)
                    source, opened = where.open_input_file(path), file
                data = source.read_at(end - start, start)
                got = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in held]
                yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in zip(names, fields, strict=True)], names=names)

    return spread.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"))
    out = read_records(index, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
