"""Normalising monolithic gzip WARC files (operator 3)."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..shared import written
from ._dist import Scratch
from ._text import column

BLOCK = 1 << 20
MAGIC, PROBE, TAIL = b"\x1f\x8b\x08", 4096, 1 << 16
LEVEL = 6
INDEX = "file string, record int, offset long, length long, type string, uri string, page_id string, payload_bytes long, payload_sha256 string, status string"
_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _publish(path: str, write) -> object:
    """write(stream) into a file of another name, then rename: a lost or repeated task leaves no half a file."""
    system, name = _open(path)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as f:
        result = write(f)
    system.move(part, name)
    return result


def header(page_id: object, url: str | None, size: int) -> bytes:
    """A resource record's header; line ends in values are escaped, missing values left out."""
    escape = lambda s: str(s).replace("\r", "%0D").replace("\n", "%0A")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}")
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html"]
    lines += [f"WARC-Target-URI: {escape(url)}"] * (url is not None) + [f"X-Page-ID: {escape(page_id)}"] * (page_id is not None) + [f"Content-Length: {size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_monolithic(pages: DataFrame, folder: str, level: int = LEVEL) -> list[str]:
    """Writes each partition of pages (page_id, url, html) as one gzip stream of WARC records; the files' paths.

    A null html is an empty payload; a null url or page_id is left out of the header.
    """

    def write(batches):
        from pyspark import TaskContext

        path, count = f"{folder}/mono-{TaskContext.get().partitionId():06d}.warc.gz", [0]

        def body(f) -> None:
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            for b in batches:
                for i, u, h in zip(column(b, "page_id").to_pylist(), column(b, "url").to_pylist(), column(b, "html").to_pylist()):
                    payload = (h or "").encode()
                    f.write(z.compress(header(i, u, len(payload)) + payload + b"\r\n\r\n"))
                    count[0] += 1
            f.write(z.flush())

        _publish(path, body)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array(count, pa.int64())], ["path", "n"])

    _mkdir(folder)
    return sorted(r.path for r in pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(write, "path string, n long").collect())


def _mkdir(folder: str) -> None:
    system, name = _open(folder)
    system.create_dir(name, recursive=True)


class _Source:
    """The inflated bytes of a file: any number of gzip members, or none; read once, from front to back.

    Each call inflates at most BLOCK bytes, and bytes that have been used are
    dropped once they are a block, so memory holds two blocks however well
    the file is compressed.  ``broken`` is set where the bytes can't be trusted any more: a
    member ends early, fails its check or holds damage, or something else lies
    between members.  What was inflated before that is still given; ``resume``
    goes on at the next member that inflates.
    """

    def __init__(self, stream) -> None:
        self.stream, self.z, self.raw, self.plain, self.broken, self.ended = stream, None, b"", None, False, False
        self.held, self.at, self.tail = bytearray(), 0, b""  # tail: the last bytes of the member that have been inflated

    def more(self) -> bool:
        """More bytes into what is held; False at the end of the file or at damage."""
        while not self.broken:
            if not self.raw:
                self.raw = self.stream.read(BLOCK)
            if not self.raw:
                self.broken, self.ended = self.z is not None, True
                return False
            if self.plain is None:
                self.plain = self.raw[:2] != MAGIC[:2]
            if self.plain:
                self.held += self.raw
                self.raw = b""
                return True
            if self.z is None:
                self.raw = self.raw.lstrip(b"\0")  # padding
                if not self.raw:
                    continue
                self.z = zlib.decompressobj(31)
            got = self._inflated()
            self.held += got
            if got:
                return True
        return False

    def _inflated(self) -> bytes:
        """At most BLOCK bytes; of a call that fails, all that comes before the damage."""
        before = self.z.copy()
        try:
            got = self.z.decompress(self.raw, BLOCK)
            rest = self.z.unused_data or self.z.unconsumed_tail
            self.tail, self.raw = (self.tail + self.raw[: len(self.raw) - len(rest)])[-TAIL:], rest
            if self.z.eof:
                self.z, self.tail = None, b""
            return got
        except zlib.error:
            self.broken = True
        got, size = b"", max(1, len(self.raw) // 2)
        while self.raw:  # the call that failed once more, in pieces down to a byte
            trial = before.copy()
            try:
                part = trial.decompress(self.raw[:size])
            except zlib.error:
                if size == 1:
                    break
                size = max(1, size // 2)
                continue
            got, before, self.tail, self.raw = got + part, trial, (self.tail + self.raw[:size])[-TAIL:], self.raw[size:]
        return got

    def resume(self) -> bool:
        """After damage: drops what is held and goes to the next member that inflates; False if the file has none.

        Damage may make a member's stream run on into the next ones before it fails, so the search begins TAIL bytes back.
        """
        start = int(len(self.tail) < TAIL)  # not the same member again
        self.held, self.at, self.z, self.raw, self.tail = bytearray(), 0, None, self.tail + self.raw, b""
        while not self.ended:
            k = self.raw.find(MAGIC, start)
            if k < 0 or len(self.raw) - k < PROBE:
                k = max(0, len(self.raw) - 2) if k < 0 else k
                more = self.stream.read(BLOCK)
                self.raw, self.ended, start = self.raw[max(start, k) :] + more, not more, 0
                if more:
                    continue
                k = self.raw.find(MAGIC)
                if k < 0:
                    break
            try:
                zlib.decompressobj(31).decompress(self.raw[k : k + PROBE], 64)
            except zlib.error:
                start, self.ended = k + 1, False
                continue
            self.raw, self.broken, self.ended = self.raw[k:], False, False
            return True
        return False

    def peek(self, least: int) -> bool:
        """Whether at least so many bytes are held, after reading as far as needed."""
        while len(self.held) - self.at < least:
            if not self.more():
                return False
        return True

    def find(self, mark: bytes) -> int:
        """How far ahead the mark is, -1 if what can be read doesn't hold it."""
        start = self.at
        while (k := self.held.find(mark, start)) < 0:
            ahead = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self.more():
                return -1
            start = self.at + ahead
        return k - self.at

    def take(self, size: int) -> bytes:
        out = bytes(memoryview(self.held)[self.at : self.at + size])
        self.at += len(out)
        if self.at >= BLOCK:
            del self.held[: self.at]
            self.at = 0
        return out

    def skip_line_ends(self) -> bool:
        """Passes line ends; whether anything follows."""
        while self.peek(1):
            if self.held[self.at] not in b"\r\n":
                return True
            self.take(1)
        return False


def rewrite(stream, out, name: str, level: int = LEVEL) -> list[dict]:
    """Copies every whole record of a WARC stream as a gzip member of its own to out; the index rows.

    Each place where the file is broken, in a record or between two, gives one row with the status "truncated" and nothing
    in out: the record it lies in, as far as its header was read, or no record.  Whole records before it are
    kept, those of the same member whose check fails at its end among them, and so are the records of later members.
    (damage that still inflates shows only at that check: such records are whole, but only the row after them tells that they are unproved).
    After something that isn't a record, the next line "WARC/" after an empty line begins one.
    """
    src, rows, offset = _Source(stream), [], 0
    while True:
        row = {"file": name, "record": len(rows), "offset": offset, "length": 0, "type": None, "uri": None, "page_id": None, "payload_bytes": 0, "payload_sha256": None, "status": "truncated"}
        if src.skip_line_ends():
            rows.append(row)
            offset += _copied(src, out, row, level)
            if row["status"] == "ok":
                continue
            ahead = src.find(b"\r\n\r\nWARC/")  # what isn't a record, in bytes that are sound: on to the next one
            if ahead >= 0:
                src.take(ahead)
                continue
            if not src.broken:
                return rows
        elif not src.broken:
            return rows
        else:
            rows.append(row)
        if not src.resume():
            return rows


def _copied(src: _Source, out, row: dict, level: int) -> int:
    """The bytes written for the record that src stands at; 0, and nothing is written, if it isn't whole."""
    end = src.find(b"\r\n\r\n")
    if end < 0:
        return 0
    head = src.take(end)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    size = int(fields["content-length"]) if fields.get("content-length", "").isdecimal() else -1
    if not head.startswith(b"WARC/") or size < 0:
        return 0
    head += src.take(4)
    row |= {"type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "page_id": fields.get("x-page-id"), "payload_bytes": size}
    z, digest, left = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha256(), size
    made = [z.compress(head)]
    while left:
        if not src.peek(1):
            return 0
        part = src.take(min(left, BLOCK))
        digest.update(part)
        made.append(z.compress(part))
        left -= len(part)
    made.append(z.compress(b"\r\n\r\n") + z.flush())
    for m in made:
        out.write(m)
    row |= {"length": sum(map(len, made)), "payload_sha256": digest.hexdigest(), "status": "ok"}
    return row["length"]


def normalise(spark: SparkSession, files: list[str], folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrites each file below folder with one gzip member a record, and a sidecar ``.idx`` of JSON lines beside it; the rows of all indexes.

    Each file is inflated once, as a stream, by one task.  Memory holds two blocks of BLOCK bytes, one record in its
    compressed form, and the file's index rows.  Output is renamed into place, so a task may be lost or run twice.
    The rows are a table beside the files: reading them again rewrites nothing.  The bytes [offset, offset + length)
    of the new file are the record's member.  No files, or empty ones, give no rows.  A broken file gives its
    whole records and a row for each place where it is broken, see rewrite.
    """
    _mkdir(folder)

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                target = f"{folder}/{path.rsplit('/', 1)[1]}"
                system, name = _open(path)
                with system.open_input_stream(name, compression=None) as f:
                    rows = _publish(target, lambda out, f=f, target=target: rewrite(f, out, target, level))
                _publish(target + ".idx", lambda out, rows=rows: out.write("".join(json.dumps(r) + "\n" for r in rows).encode()))
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([{c: r[c] for c in _NAMES} for r in rows[k : k + 10_000]], schema=schema)

    empty = spark.createDataFrame([], INDEX)
    schema = to_arrow_schema(empty.schema)
    if not files:
        return empty
    frame = spark.createDataFrame([(f,) for f in files], "path string")
    return written(frame.repartition(max(1, len(files)), "path").mapInArrow(run, INDEX), "warc-index")


def normalised_pages(pages: DataFrame, level: int = LEVEL) -> DataFrame:
    """pages as monolithic files below the shared folder, normalised: rows of the index, with page_id and url of each record.

    Null ids and urls stay null, a null html has no payload bytes; repeated rows are records of their own; other columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    files = write_monolithic(pages, scratch.path("mono"), level)
    index = normalise(spark, files, scratch.path("members"), level)
    return index.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType)).withColumnRenamed("uri", "url")


def payloads(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_sha256, status, intact) of the records of pages once normalised.

    intact: the member that the sidecar index points to, read back by itself, is the record.
    """
    index = normalised_pages(pages)
    kind = pages.schema["page_id"].dataType.simpleString()

    def read_back(batches):
        for b in batches:
            ok = []
            for path, offset, length, digest in zip(*(column(b, c).to_pylist() for c in ("file", "offset", "length", "payload_sha256"))):
                system, name = _open(path)
                with system.open_input_file(name) as f:
                    f.seek(offset)
                    z = zlib.decompressobj(31)
                    record = z.decompress(f.read(length))
                ok.append(z.eof and not z.unused_data and hashlib.sha256(record.partition(b"\r\n\r\n")[2][:-4]).hexdigest() == digest)
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("page_id", "url", "payload_bytes", "payload_sha256", "status")), pa.array(ok, pa.bool_())], ["page_id", "url", "payload_bytes", "payload_sha256", "status", "intact"])

    return index.where("status = 'ok'").mapInArrow(read_back, f"page_id {kind}, url string, payload_bytes long, payload_sha256 string, status string, intact boolean")


#: Of payloads: what normalising must keep of every page.
SQL = "SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_sha256, 'ok' AS status, true AS intact FROM pages"
