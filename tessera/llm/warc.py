"""WARC archives packed in ZIP files: a writer and a range reader.

Writing: every task writes its records to archives of its own in a shared folder, each a ZIP64 file with two stored members: the
records, every one a gzip member, and an index of them by offset and length. File names hold the task attempt, so a repeated
task leaves no half-written archive behind that anyone reads; the list of archives is stored once, and the reader goes by it.

Reading: the end records, the ZIP64 ones and the central directory locate the members; the index is read, and stretches of
records are read by range from the stored member. Nothing is extracted.

Payloads are the page's text in UTF-8; null is the empty payload. Of records with equal payloads of `least_bytes` or more the one
with the largest id is the response and the others revisit it; if all ids are null all are responses. Rows with equal id and
payload are equal records. A null id is written as no id and read back as null. Empty input: no archive, no rows. Other columns
are not used.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import dealt_join, shared_dir, stored

# Fixed values of the file formats.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    n = name.strip("<>").rpartition(":")[2]
    return int(n) if n else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if url:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if revisit:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parsed(record: bytes) -> dict:
    """The columns of a record; a response's digest and length are those of the payload that is there."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if base32_sha1(payload) != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
        size, refers = len(payload), None
    else:
        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length:")).split(":")[1])
        refers = page_of(fields["WARC-Refers-To"])
    return {"page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers, "payload": payload if kind == "response" else None}


class Archive:
    """One ZIP file on its way out: the records' member is streamed, the index follows at the end."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.uri, self.size, self.index = uri, 0, []
        self.file = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)

    def add(self, data: bytes) -> None:
        self.member.write(data)
        self.index.append(f"{self.size} {len(data)}\n")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as m:
            m.write("".join(self.index).encode())
        self.zip.close()
        self.file.close()
        return self.uri, len(self.index), self.size


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0, archive_bytes: int = 128_000_000) -> DataFrame:
    """Writes archives under the folder and returns their list (uri, records, bytes)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    first = rows.groupBy("digest", "size").agg(F.max(F.when(F.col("size") >= least_bytes, F.col("page_id"))).alias("response"), F.count("*").alias("uses"))
    # A payload that many pages have is dealt over several parts by the page.
    rows = dealt_join(rows, first, ["digest", "size"], "uses", ["page_id", "url"])
    revisit = ~F.col("page_id").eqNullSafe(F.col("response")) & F.col("response").isNotNull()
    rows = rows.select("page_id", "url", "html", "response", F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, done = TaskContext.get().taskAttemptId(), None, []
        for batch in batches:
            for page, url, html, response, revisit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                archive = archive or Archive(f"{folder}/{task}-{len(done)}.zip")
                archive.add(gzipped(warc_record(page, url, html, response, revisit)))
                if archive.size >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["uri", "records", "bytes"])

    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return stored(rows.mapInArrow(write, "uri string, records long, bytes long"), "archives")


def directory(file: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Offset of the data and length of every stored member, by the central directory."""
    size = file.size()
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, at):
        where = tail_at + end - 20
        mark, at64 = struct.unpack_from("<4s4xQ", file.read_at(20, where))
        if mark != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        mark, count, length, at = struct.unpack_from("<4s28xQQQ", file.read_at(56, at64))
        if mark != END64:
            raise ValueError("no ZIP64 end record")
    entries, p, out = file.read_at(length, at), 0, {}
    for _ in range(count):
        mark, method, packed, full, n_name, n_extra, n_note, local = struct.unpack_from("<4s6xH8xIIHHH8xI", entries, p)
        if mark != CENTRAL:
            raise ValueError("no entry of a central directory")
        name = entries[p + 46 : p + 46 + n_name].decode()
        extra, q = entries[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # ZIP64: the values whose 32-bit fields are full, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            q += 4 + n
        if method == zipfile.ZIP_STORED:
            mark, a, b = struct.unpack_from("<4s22xHH", file.read_at(30, local))
            if mark != LOCAL or packed != full:
                raise ValueError(f"{name} isn't a stored member")
            out[name] = (local + 30 + a + b, packed)
        p += 46 + n_name + n_extra + n_note
    return out


def stretches(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive records of about `most` bytes together, as ranges of their numbers."""
    ends, size = [0], 0
    for k, n in enumerate(lengths):
        if size and size + n > most:
            ends.append(k)
            size = 0
        size += n
    ends.append(len(lengths))
    return [(a, b) for a, b in zip(ends, ends[1:], strict=False) if b > a]


def read_archives(archives: DataFrame, stretch_bytes: int = 1_000_000, payloads: bool = False) -> DataFrame:
    """The records of the archives (uri, records, bytes), read in stretches of about `stretch_bytes`: page_id, url, payload_bytes, payload_digest, record_type, refers_to, with payload if asked for."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uri", pa.string()), ("at", pa.int64()), ("lengths", pa.list_(pa.int64()))])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    members = directory(f)
                    at, n = members[INDEX]
                    lines = [tuple(map(int, x.split())) for x in f.read_at(n, at).decode().splitlines()]
                sizes = [n for _, n in lines]
                rows = [{"uri": uri, "at": members[RECORDS][0] + lines[a][0], "lengths": sizes[a:b]} for a, b in stretches(sizes, stretch_bytes)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(fields)
        for batch in batches:
            for uri, at, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    data, p, rows = f.read_at(sum(lengths), at), 0, []
                for n in lengths:
                    rows.append({k: v for k, v in parsed(zlib.decompress(data[p : p + n], 31)).items() if payloads or k != "payload"})
                    p += n
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    found = archives.select("uri").mapInArrow(locate, "uri string, at long, lengths array<long>")
    total = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    tasks = min(100_000, max(1, -(-total // (4 * stretch_bytes))))
    return found.repartition(tasks, "uri", "at").mapInArrow(read, kind)


def archive_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}"
