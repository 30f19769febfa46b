"""WARC archives with a two-level capture index.

Writing: every task writes its records, one gzip member each, to a WARC file of
its own in the shared folder; a name holds the task's attempt, so that a lost or
repeated attempt leaves a file that nothing refers to.  Of records with equal
payloads the one with the smallest id is the ``response``, the others are
``revisit`` records that refer to it.  What is committed is the list of captures.

Index: captures sorted by the key of their URL (host labels reversed) and id fill
blocks of some thousand entries, compressed one by one in index files.  The
directory holds only the first key of each block and where the block lies.  A
look-up searches the directory by bisection, reads that one block by its range,
searches the block by bisection, and reads the record by its range.  Many look-ups
are sorted first, so that a task reads a block once, and neighbouring records
are read together.

Edge cases: a null payload is an empty one; a null URL has an empty key; rows that
share an id and a payload are all responses if that id is the smallest; rows
without an id are records like others, but nothing refers to them; characters
that a header cannot hold are percent-encoded; an empty table makes no files and
no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

BLOCK = 3000
#: The directory has this many entries at most; blocks grow beyond that.
DIRECTORY = 500_000
ROLL_BYTES = 256 << 20
_CHUNK = 1 << 18
_FOUND = 10_000
_DATE = "1970-01-01T00:00:00Z"


def _fs(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def url_key(url: Column) -> Column:
    """``https://b.a.com:80/x?y`` -> ``com,a,b:80)/x?y``: captures of a host and its subdomains lie together."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    port = F.regexp_extract(host, r"(:[0-9]*)$", 1)
    labels = F.reverse(F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\."))
    return F.when(rest == "", "").otherwise(F.concat(F.array_join(labels, ","), port, F.lit(")"), F.regexp_replace(rest, r"(?s)^[^/?#]*", "")))


def capture_key(url: Column, page_id: Column) -> Column:
    """The key of one capture: the URL's, then the id in an order that strings keep."""
    number = F.lpad(F.hex(page_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(url_key(url), F.lit("\x01"), F.coalesce(number, F.lit("")))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The parts of one record: headers, HTTP headers, payload."""
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = body[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"warc": fields, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write(pages: DataFrame, root: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the archives below ``root`` and returns the captures (key, page_id, file, offset, length), committed there as a table."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    twice = rows.where(F.octet_length("payload") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    twice = stored(twice.where((F.col("n") > 1) & F.col("first").isNotNull()).select("sha1", "first"), f"{root}/equal")
    rows = rows.join(twice, "sha1", "left").select("page_id", "url", capture_key(F.col("url"), F.col("page_id")).alias("key"), "payload", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = _fs(root)
        fs.create_dir(f"{base}/warc", recursive=True)
        out, name, at, part = None, "", 0, 0
        try:
            for batch in batches:
                files, offsets, lengths = [], [], []
                for page_id, url, _, payload, refers_to in zip(*batch.columns, strict=True):
                    data = payload.as_buffer().to_pybytes()
                    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
                    raw = record(page_id.as_py(), url.as_py(), data, sha1_base32(data), refers_to.as_py())
                    packed = packer.compress(raw) + packer.flush()
                    if out is None or at > ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name, at, part = f"{task.partitionId():06d}-{task.taskAttemptId()}-{part:03d}.warc.gz", 0, part + 1
                        out = fs.open_output_stream(f"{base}/warc/{name}", compression=None)
                    out.write(packed)
                    files.append(name)
                    offsets.append(at)
                    lengths.append(len(packed))
                    at += len(packed)
                if files:
                    yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(files), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return stored(rows.mapInArrow(run, "key string, page_id long, file string, offset long, length long"), f"{root}/captures")


def index(captures: DataFrame, root: str) -> DataFrame:
    """Writes the index files below ``root`` and returns the directory: a row a block (first, file, offset, length)."""
    rows = captures.where(F.col("key").isNotNull())
    size = max(BLOCK, -(-rows.count() // DIRECTORY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = _fs(root)
        fs.create_dir(f"{base}/index", recursive=True)
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.blocks"
        held, out, at, found = [], None, 0, []

        def close(block: list[tuple]) -> None:
            nonlocal out, at
            packed = zlib.compress("\n".join("\t".join(map(str, x)) for x in block).encode(), 6)
            if out is None:
                out = fs.open_output_stream(f"{base}/index/{name}", compression=None)
            out.write(packed)
            found.append((block[0][0], name, at, len(packed)))
            at += len(packed)

        try:
            for batch in batches:
                held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
                while len(held) >= size:
                    close(held[:size])
                    held = held[size:]
            if held:
                close(held)
        finally:
            if out is not None:
                out.close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["first", "file", "offset", "length"])

    ordered = rows.select(_escaped(F.col("key")).alias("key"), "file", "offset", "length").repartitionByRange("key").sortWithinPartitions("key")
    return stored(ordered.mapInArrow(run, "first string, file string, offset long, length long"), f"{root}/directory")


def _escaped(key: Column) -> Column:
    """The key as it is sorted, filed and looked up: no tab or line end, and different for different keys."""
    return F.replace(F.replace(F.replace(key, F.lit("%"), F.lit("%25")), F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0A"))


def lookup(keys: DataFrame, directory: DataFrame, root: str) -> DataFrame:
    """(key, file, offset, length) of all captures that ``keys`` (a column ``key`` of capture keys) name."""
    entries = directory.toArrow().to_pylist()  # DIRECTORY rows at most
    entries.sort(key=lambda x: (x["first"], x["file"], x["offset"]))  # blocks with one first key lie in one file, in order
    sent = keys.sparkSession.sparkContext.broadcast(([x["first"] for x in entries], [(x["file"], x["offset"], x["length"]) for x in entries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(root)
        firsts, places = sent.value
        now, block, block_keys, found = -1, [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["key", "file", "offset", "length"])

        for batch in batches:
            for key, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # The block before the first that begins with the key may end with it; the key may go on over many blocks.
                k = max(0, bisect.bisect_left(firsts, wanted) - 1)
                while k < len(firsts) and firsts[k] <= wanted:
                    if k != now:
                        name, at, length = places[k]
                        with fs.open_input_file(f"{base}/index/{name}") as f:
                            block = [x.split("\t") for x in zlib.decompress(f.read_at(length, at)).decode().split("\n")]
                        now, block_keys = k, [x[0] for x in block]
                    i = bisect.bisect_left(block_keys, wanted)
                    while i < len(block) and block_keys[i] == wanted:
                        found.append((key, block[i][1], int(block[i][2]), int(block[i][3])))
                        i += 1
                    k += 1
                    if len(found) >= _FOUND:
                        yield out()
                        found = []
        if found:
            yield out()

    wanted = keys.select("key", _escaped(F.col("key")).alias("wanted")).where(F.col("key").isNotNull()).distinct()
    return wanted.repartitionByRange("wanted").sortWithinPartitions("wanted").mapInArrow(run, "key string, file string, offset long, length long")


def read(places: DataFrame, root: str) -> DataFrame:
    """The records at ``places`` (file, offset, length): page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    chunk = F.floor(F.col("offset") / _CHUNK)
    ordered = places.select("file", "offset", "length").repartition("file", chunk).sortWithinPartitions("file", "offset")

    def row(raw: bytes) -> tuple:
        got = parsed(raw)
        fields, payload = got["warc"], got["payload"]
        number = lambda x: None if x == "<urn:page:None>" else int(x[10:-1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(got["http"]["Content-Length"])
        if fields["WARC-Type"] == "revisit":
            return number(fields["WARC-Record-ID"]), size, digest, "revisit", number(fields["WARC-Refers-To"]), None
        if len(payload) != size or sha1_base32(payload) != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        return number(fields["WARC-Record-ID"]), size, digest, "response", None, payload.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(root)
        name, source = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            k, found, size = 0, [], 0
            while k < len(rows):
                file, begin, length = rows[k]
                end, j = begin + length, k + 1
                while j < len(rows) and rows[j][0] == file and rows[j][1] <= end + 4096 and rows[j][1] + rows[j][2] - begin <= 4 * _CHUNK:
                    end, j = max(end, rows[j][1] + rows[j][2]), j + 1
                if file != name:
                    name, source = file, fs.open_input_file(f"{base}/warc/{file}")
                data = source.read_at(end - begin, begin)
                for _, at, length in rows[k:j]:
                    found.append(row(zlib.decompress(data[at - begin : at - begin + length], 31)))
                size += end - begin
                k = j
                if size > 4 * _CHUNK or k == len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                    found, size = [], 0

    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")
