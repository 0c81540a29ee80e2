"""WARC archives as a chunked record table.

Writing: pages with equal payloads are found by digest; the copy with the smallest id is a response, the others are
revisit records that refer to it. Each task writes archives of its own (gzip, a member for each record) under a name of
its attempt; only archives in the manifest count, so that a lost or repeated task leaves nothing that is read.

Reading: an archive is streamed; a payload becomes rows of (record id, chunk number), each with the number of bytes
and the digest so far. Nothing holds more than a chunk of a payload, however long it is; the row marked last has the
totals of the whole payload.

Defined cases: null html is an empty payload; payloads shorter than ``least`` are always responses; a null page id is
read back as null and is a response; repeated rows of one page id are a record each, with the same decision; an empty
table gives no records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstore.llm.runtime import cut, scratch, small_batches

CHUNK = 64 << 10
ROLL = 256 << 20
LEAST = 100
#: Parts into which a group of copies is dealt for the join.
SALTS = 16
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store(uri: str):
    """(file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages with digest, payload_bytes and refers_to (null for responses)."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy(F.col("digest").alias("g_digest")).agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    groups = groups.withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.join(groups, (F.col("digest") == F.col("g_digest")) & (F.col("salt") == F.col("g_salt")), "left")
    return met.select("page_id", "url", "html", "digest", "payload_bytes", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def record_id(row_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(row_id))}>"


def _headers(row_id, url: str | None, digest: str, n: int, refers_to) -> tuple[bytes, bytes]:
    """(WARC header, HTTP header) of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(row_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Row-Id: {'' if row_id is None else row_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Row: {refers_to}"]
    head.append(f"Content-Length: {len(http) + (n if refers_to is None else 0)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode(), http


def _write_record(out, row_id, url, payload: memoryview, digest: str, refers_to) -> int:
    """One gzip member; the payload goes through in chunks."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    head, http = _headers(row_id, url, digest, len(payload), refers_to)
    n = out.write(z.compress(head + http))
    if refers_to is None:
        for at in range(0, len(payload), CHUNK):
            n += out.write(z.compress(payload[at : at + CHUNK]))
    return n + out.write(z.compress(b"\r\n\r\n") + z.flush())


def write(decided: DataFrame, root: str, roll: int = ROLL) -> DataFrame:
    """Archives under ``root``; the manifest (path, records, bytes), itself a table there."""
    small_batches(decided.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = store(root)
        files.create_dir(f"{folder}/data", recursive=True)
        done, out, path, records, size = [], None, "", 0, 0
        for b in batches:
            ids, urls, texts, digests, refers = b.columns
            for k in range(b.num_rows):
                if out is None:
                    path, records, size = f"{folder}/data/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path)
                payload = texts[k].as_buffer() if texts[k].is_valid else pa.py_buffer(b"")
                size += _write_record(out, ids[k].as_py(), urls[k].as_py(), memoryview(payload), digests[k].as_py(), refers[k].as_py())
                records += 1
                if size >= roll:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            p, r, s = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(r, pa.int64()), pa.array(s, pa.int64())], ["path", "records", "bytes"])

    rows = decided.select("page_id", "url", "html", "digest", "refers_to")
    return cut(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest", f"{root}/manifest")


class _Stream:
    """The decompressed bytes of a file of gzip members, read in bounded pieces."""

    def __init__(self, file):
        self.file, self.z, self.raw, self.have = file, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.file.read(CHUNK)
                if not self.raw:
                    return False
            got = self.z.decompress(self.raw, CHUNK)
            if not self.z.eof:
                self.raw = self.z.unconsumed_tail
            if got:
                self.have += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with a mark; None at the end of the file."""
        while (at := self.have.find(mark)) < 0:
            if not self._more():
                if self.have:
                    raise ValueError("the archive ends within a record")
                return None
        out, self.have = self.have[: at + len(mark)], self.have[at + len(mark) :]
        return out

    def some(self, most: int) -> bytes:
        if not self.have and not self._more():
            raise ValueError("the archive ends within a record")
        out, self.have = self.have[:most], self.have[most:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(file, chunk: int = CHUNK) -> Iterator[tuple]:
    """(record id, row id, type, refers to, declared digest, declared length, chunk number, chunk, bytes so far, digest so far, last) for each chunk; a record has one chunk at least."""
    s = _Stream(file)
    while (head := s.until(b"\r\n\r\n")) is not None:
        f = _fields(head)
        http = s.until(b"\r\n\r\n")
        declared = int(_fields(http)["content-length"])
        left = int(f["content-length"]) - len(http)
        row = int(f["x-row-id"]) if f["x-row-id"] else None
        refers = int(f["x-refers-to-row"]) if f.get("x-refers-to-row") else None
        digest, so_far, number = hashlib.sha256(), 0, 0
        while True:
            part = b""
            while left and len(part) < chunk:
                got = s.some(min(left, chunk - len(part)))
                part, left = part + got, left - len(got)
            digest.update(part)
            so_far += len(part)
            yield f["warc-record-id"], row, f["warc-type"], refers, f["warc-payload-digest"].rpartition(":")[2], declared, number, part, so_far, digest.hexdigest(), not left
            number += 1
            if not left:
                break
        if s.until(b"\r\n\r\n") != b"\r\n\r\n":
            raise ValueError("a record isn't closed where its length says")


CHUNKS = "record_id string, page_id long, record_type string, refers_to long, declared_digest string, declared_bytes long, chunk_no int, chunk_bytes long, bytes_so_far long, sha256_so_far string, last boolean"


def read_chunks(spark: SparkSession, manifest: DataFrame, root: str, chunk: int = CHUNK, data: bool = False) -> DataFrame:
    """The chunked record table of all archives in the manifest; with ``data`` the bytes of each chunk too."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * data
    names = [x.split()[0] for x in CHUNKS.split(", ")] + ["data"] * data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = store(root)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with files.open_input_stream(path) as file:
                    for *head, number, part, so_far, digest, last in records(file, chunk):
                        rows.append((*head, number, len(part), so_far, digest, last, *([part] if data else [])))
                        held += len(part) * data + 200
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    paths = manifest.select("path").repartition(max(1, manifest.count()))
    return paths.mapInArrow(run, CHUNKS + ", data binary" * data)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all pages and read them back: a row for each record with the totals of its last chunk.

    A revisit has no payload of its own; its length and digest are those that its header declares. A response whose
    payload isn't what its header declares fails the job.
    """
    spark = pages.sparkSession
    root = scratch(spark, "warc")
    manifest = write(decide(pages, least), root)
    last = read_chunks(spark, manifest, root).where("last")
    whole = F.col("record_type") == "response"
    sound = ~whole | ((F.col("bytes_so_far") == F.col("declared_bytes")) & (F.col("sha256_so_far") == F.col("declared_digest")))
    digest = F.when(~sound, F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id")))).when(whole, F.col("sha256_so_far")).otherwise(F.col("declared_digest"))
    return last.select("page_id", F.when(whole, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
