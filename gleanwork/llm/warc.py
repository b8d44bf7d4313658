"""Zstandard WARC archives: one frame a record, the dictionary in a leading skippable frame.

`read` lists archives without reading them, cuts long ones into byte ranges and streams each range where it is read: the
dictionary comes from the head of the file (magic 0x184D2A5D; itself plain or compressed), each following frame is decoded by
itself and has to hold exactly one whole record. A range begins at the first frame that starts in it; where one starts
is found by its magic number and proved by decoding it into something that begins like a record.

Checked of each record: version line, header syntax, the four mandatory headers, Content-Length against the block's bytes, the
two line ends behind the block, nothing after them, the sha1 of WARC-Block-Digest where there is one, and
the frame's checksum. A record that fails has `error` set and what could be parsed; reading goes on with the next frame.
Frames above `max_record` decoded bytes are reported as errors and not held.

`write` packs rows of (uri, body, id) as response records into archives of about `archive_bytes`, under names of their own for every
attempt of a task, so a task that runs twice leaves a file that no returned row names.

Defined results: null url becomes an empty header value and null html an empty body (both come back as empty strings); empty and
very long bodies are records like others (one above `max_record`, 1 GiB, is written but reported as an error when read); line breaks in a url are percent-encoded; a null id has no record-id suffix and comes
back as null; repeated rows are records each; an empty table gives no archives and an empty result; other columns are not
read. A file without a skippable frame is read without a dictionary; an empty file has no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import fresh_path, isolated, materialize

#: Production parameters.
LEVEL, ARCHIVE_BYTES, SPLIT_BYTES, MAX_RECORD, DICT_BYTES = 3, 128 << 20, 64 << 20, 1 << 30, 64 << 10
#: The dictionary is trained on so many bodies at most, of which it sees so many characters: 6.4 MB on the driver at most (of ASCII).
DICT_SAMPLES, SAMPLE_CHARS = 400, 16 << 10

_SKIPPABLE, _FRAME, _DICT = (0x184D2A5D).to_bytes(4, "little"), (0xFD2FB528).to_bytes(4, "little"), (0xEC30A437).to_bytes(4, "little")
_MANDATORY = ("WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length")
_FIELDS = ["path", "position", "record_id", "warc_type", "date", "target_uri", "content_type", "content_length", "block", "error"]
SCHEMA = "path string, position bigint, record_id string, warc_type string, date string, target_uri string, content_type string, content_length bigint, block binary, error string"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# -- writing


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary trained on samples, or none where they are too few."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # samples too much alike for the trainer
        return b""


def record(record_id: str, uri: str, date: str, body: bytes, content_type: str = "text/html; charset=utf-8") -> bytes:
    """One response record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n" % (content_type.encode(), len(body))
    block = http + body
    uri = uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in uri or "\n" in uri else uri
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {record_id}\r\nWARC-Date: {date}\r\nWARC-Target-URI: {uri}\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def archive_head(trained: bytes) -> bytes:
    """The leading skippable frame, with the dictionary compressed."""
    if not trained:
        return b""
    held = zstandard.ZstdCompressor(level=19, write_checksum=True).compress(trained)
    return _SKIPPABLE + len(held).to_bytes(4, "little") + held


def samples(rows: DataFrame, n: int = DICT_SAMPLES, chars: int = SAMPLE_CHARS) -> list[bytes]:
    """The first n bodies in the order of a hash of id and uri, each up to so many characters. The hashes are picked without
    reading a body, and a body that stands in many rows is brought together where it is read."""
    h = F.xxhash64(F.lit("warc"), "id", "uri")
    picked = [r[0] for r in rows.select(h.alias("h")).distinct().orderBy("h").limit(n).collect()]
    found = rows.filter(h.isin(picked)).select(h.alias("h"), F.substring("body", 1, chars).alias("body")).filter(F.length("body") > 0)
    return [r[1].encode() for r in sorted(found.groupBy("h").agg(F.min("body").alias("body")).collect())]


def write(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL, trained: bytes | None = None) -> DataFrame:
    """Archives of rows (id, uri, body); returns path, n_records and n_bytes of each."""
    if trained is None:
        trained = dictionary(samples(rows))
    head = archive_head(trained)

    def run(batches):
        base = _filesystem(folder)
        coder = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        out, n, size, path = None, 0, 0, ""

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([size])], ["path", "n_records", "n_bytes"])

        for b in batches:
            for i, uri, body in zip(*(b.column(c).to_pylist() for c in ("id", "uri", "body")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    path, n, size = f"{folder}/{name}", 0, len(head)
                    out = base[0].open_output_stream(f"{base[1]}/{name}", compression=None)  # the name would have it compressed again
                    out.write(head)
                frame = coder.compress(record(f"<urn:record:{'' if i is None else i}>", uri or "", date, (body or "").encode()))
                out.write(frame)
                n += 1
                size += len(frame)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    fs, at = _filesystem(folder)
    fs.create_dir(at, recursive=True)
    return materialize(rows.select("id", "uri", "body").mapInArrow(run, "path string, n_records bigint, n_bytes bigint"), "warc-files")


# -- reading


def load_dictionary(stream) -> tuple[bytes, int]:
    """The dictionary of the leading skippable frame and where the frames begin; the stream is at its beginning."""
    head = stream.read(8)
    if head[:4] != _SKIPPABLE:
        return b"", 0
    size = int.from_bytes(head[4:8], "little")
    held = stream.read(size)
    if len(held) < size:
        raise ValueError("the dictionary frame is cut off")
    if held[:4] == _FRAME:
        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
    if held[:4] != _DICT:
        raise ValueError("the skippable frame holds no dictionary")
    return held, 8 + size


def parse(raw: bytes) -> dict:
    """The fields of one record, and what is wrong with it."""
    out: dict = dict.fromkeys(_FIELDS)
    split = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or split < 0:
        return out | {"error": "no WARC version line" if split >= 0 else "headers don't end"}
    lines = raw[:split].decode("utf-8", "replace").split("\r\n")
    headers, last, wrong = {}, None, None
    for line in lines[1:]:
        if line[:1] in " \t" and last:  # a folded header
            headers[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            wrong = wrong or "malformed header line"
            continue
        last = name.lower()
        if last in headers and last != "warc-concurrent-to":
            wrong = wrong or f"repeated header {name}"
        headers.setdefault(last, value.strip())
    missing = [x for x in _MANDATORY if x.lower() not in headers]
    out |= {"record_id": headers.get("warc-record-id"), "warc_type": headers.get("warc-type"), "date": headers.get("warc-date"), "target_uri": headers.get("warc-target-uri"), "content_type": headers.get("content-type")}
    if missing:
        return out | {"error": "missing header " + ", ".join(missing)}
    if not headers["content-length"].isdecimal():
        return out | {"error": "Content-Length is no number"}
    size, begin = int(headers["content-length"]), split + 4
    out["content_length"] = size
    if len(raw) < begin + size:
        return out | {"error": "the block is shorter than Content-Length"}
    out["block"] = raw[begin : begin + size]
    tail = raw[begin + size :]
    if tail != b"\r\n\r\n":
        wrong = wrong or ("bytes behind the record" if tail.startswith(b"\r\n\r\n") else "the record doesn't end in two line ends")
    digest = headers.get("warc-block-digest", "")
    if digest.lower().startswith("sha1:"):
        sha = hashlib.sha1(out["block"]).digest()
        if digest[5:].upper() not in (base64.b32encode(sha).decode(), sha.hex().upper()):
            wrong = wrong or "the block doesn't match its digest"
    return out | {"error": wrong}


class _Source:
    """A stream of known position that can be looked into ahead. What is passed over is dropped in large pieces, not record by record."""

    def __init__(self, stream, at: int):
        self.stream, self.base, self.held, self.at, self.ended = stream, at, b"", 0, False

    def fill(self, size: int) -> int:
        """Looks ahead by so many bytes, or to the end; returns how many there are."""
        if len(self.held) - self.at < size and not self.ended:
            parts, have = [self.held[self.at :]], len(self.held) - self.at
            while have < size and not self.ended:
                more = self.stream.read(max(1 << 20, size - have))
                self.ended = not more
                parts.append(more)
                have += len(more)
            self.held, self.at = b"".join(parts), 0
        return len(self.held) - self.at

    def peek(self, begin: int, end: int) -> memoryview:
        return memoryview(self.held)[self.at + begin : self.at + end]

    def find(self, what: bytes) -> int:
        found = self.held.find(what, self.at)
        return found - self.at if found >= 0 else -1

    def drop(self, n: int) -> None:
        self.at += n
        self.base += n


def _decoder(trained):
    return (zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()).decompressobj()


def _decode(source: _Source, trained, max_record: int) -> tuple[bytes, int, str | None]:
    """The first frame's content, its length in the file, and what is wrong."""
    decoder, parts, held, fed, size = _decoder(trained), [], 0, 0, 1 << 12
    while not decoder.eof:
        source.fill(fed + size)
        piece = source.peek(fed, fed + size)
        if not len(piece):
            return b"".join(parts), fed, "the frame is cut off"
        got = decoder.decompress(piece)
        fed += len(piece) - len(decoder.unused_data)
        held += len(got)
        if held <= max_record:
            parts.append(got)
        size = min(2 * size, 1 << 20)
    if held > max_record:
        return b"", fed, f"the record is longer than {max_record} bytes"
    return b"".join(parts), fed, None


def _next_frame(source: _Source, until: int, trained) -> bool:
    """Moves to the first frame that starts before `until` and decodes like a record."""
    while True:
        have = source.fill(1 << 16)
        at = source.find(_FRAME)
        while at < 0 and not source.ended and source.base < until:
            source.drop(max(0, have - 3))
            have = source.fill(1 << 16)
            at = source.find(_FRAME)
        if at < 0 or source.base + at >= until:
            return False
        source.drop(at)
        source.fill(1 << 16)
        try:
            if _decoder(trained).decompress(source.peek(0, 1 << 16))[:7] == b"WARC/1.":
                return True
        except zstandard.ZstdError:
            pass
        source.drop(1)


def read_range(path: str, begin: int, end: int, max_record: int = MAX_RECORD) -> Iterator[dict]:
    """The records whose frames start in a byte range of an archive."""
    fs, at = _filesystem(path)
    with fs.open_input_file(at) as f:
        try:
            raw, first = load_dictionary(f)
            trained = zstandard.ZstdCompressionDict(raw) if raw else None
        except (ValueError, zstandard.ZstdError) as e:
            if begin == 0:
                yield dict.fromkeys(_FIELDS) | {"path": path, "position": 0, "error": f"dictionary: {e}"}
            return
        f.seek(max(begin, first))
        source = _Source(f, max(begin, first))
        if begin > first and not _next_frame(source, end, trained):
            return
        while source.base < end:
            have = source.fill(8)
            if not have:
                return
            where = source.base
            head = bytes(source.peek(0, 8))
            if have >= 8 and head[1:4] == b"\x2a\x4d\x18" and head[0] & 0xF0 == 0x50:  # any skippable frame
                size = 8 + int.from_bytes(head[4:8], "little")
                source.drop(min(size, source.fill(size)))
                continue
            try:
                raw, used, wrong = _decode(source, trained, max_record)
            except zstandard.ZstdError as e:
                yield dict.fromkeys(_FIELDS) | {"path": path, "position": where, "error": f"frame: {e}"}
                source.drop(1)
                if not _next_frame(source, end, trained):
                    return
                continue
            source.drop(used)
            if wrong:
                yield dict.fromkeys(_FIELDS) | {"path": path, "position": where, "error": wrong}
                continue
            got = parse(raw) | {"path": path, "position": where}
            yield got


def read(spark, paths: str | list[str], split_bytes: int = SPLIT_BYTES, max_record: int = MAX_RECORD) -> DataFrame:
    """The records of all archives in paths (files, folders or patterns)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).filter(F.col("length") > 0).select("path", "length")
    parts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))).alias("begin"))
    parts = parts.select("path", "begin", F.least(F.col("begin") + split_bytes, F.col("length")).alias("end"))
    # a range is a task's work, however few bytes its row has
    tasks = max(1, parts.count())
    kinds = pa.schema([("path", pa.string()), ("position", pa.int64()), *((c, pa.string()) for c in _FIELDS[2:7]), ("content_length", pa.int64()), ("block", pa.binary()), ("error", pa.string())])

    def run(batches):
        for b in batches:
            for path, begin, end in zip(*(b.column(c).to_pylist() for c in ("path", "begin", "end")), strict=True):
                rows, held = [], 0
                for r in read_range(path, begin, end, max_record):
                    rows.append(r)
                    held += len(r["block"] or b"")
                    if held > 16 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return parts.repartition(min(tasks, 100_000), "path", "begin").mapInArrow(run, SCHEMA)


def http_body(block):
    """The body of an HTTP response block, as text."""
    head = F.locate("\r\n\r\n", F.decode(block, "iso-8859-1"))
    return F.decode(F.substring(block, F.when(head > 0, head + 4).otherwise(F.lit(1)), F.octet_length(block)), "utf-8")


@isolated
def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, url, html, body_bytes and error of every page, written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    files = write(pages.select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").alias("body")), folder)
    if not files.limit(1).count():
        return spark.createDataFrame([], "page_id bigint, url string, html string, body_bytes bigint, error string")
    got = read(spark, folder)
    # attempts that were lost may have left files: only those that were reported count
    got = got.join(files.select(F.element_at(F.split("path", "/"), -1).alias("name")), F.element_at(F.split("path", "/"), -1) == F.col("name"), "left_semi")
    html = http_body(F.col("block"))
    page_id = F.regexp_extract("record_id", r"^<urn:record:(-?\d+)>$", 1).try_cast("bigint")
    return got.select(page_id.alias("page_id"), F.coalesce("target_uri", F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("bigint").alias("body_bytes"), "error")


WARC_SQL = """
SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS body_bytes, NULL::VARCHAR AS error
FROM pages"""
