"""WARC archives of Zstandard frames: writing them from a table, and reading them.

An archive begins with a skippable frame that holds its dictionary (if it has one), and then has one Zstandard frame per
record.  The reader streams an archive: it loads the dictionary, decodes frame after frame and hands on one row per
record, so a task holds one record and a piece of the file.  It checks the frame's size, checksum and dictionary id, that a
frame is exactly one record, the required header fields, the block's length and digest, the length that the HTTP
header gives, and the payload's digest.  A record that fails is a row with ``error`` set; where a frame cannot be
decoded, the rest of that archive is lost, and its row says so.

The writer makes one record per row: a response, or for a row whose payload another row holds a revisit, which has the
HTTP header but no payload.  Each task writes archives of its own under names that no other attempt uses; only
those of the attempts that succeeded are listed in its result, so lost executors leave at most unlisted files.

Of rows with equal payloads (by SHA-256) of at least ``least`` bytes that with the largest id is the response; rows that share that
id too are all responses.  A null id is the smallest and has null as id when read back.  Ids are integers.  A null payload is empty,
a null url has no target field, control characters and spaces of a url are percent-encoded.  Equal rows are records of their own.
Extra columns are ignored.  An empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityhop.llm.scratch import heavy_join, written
from cityhop.session import ensure_checkpoint_dir

# Fixed values of the two formats.
VERSION = b"WARC/1.1"
FRAME = 0xFD2FB528
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Uncompressed bytes after which a task begins a further archive; bytes that are read at once; Zstandard level.
ARCHIVE_BYTES = 1 << 30
PIECE = 1 << 16
LEVEL = 3
#: The dictionary: its size, and the rows (by hash of the id) and first characters of each that it is trained on.
DICTIONARY_BYTES = 1 << 16
SAMPLE_ROWS = 400
SAMPLE_CHARS = 1 << 14

RECORD = (
    "archive string, offset long, record_type string, record_id string, page_id long, target_uri string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary, error string"
)
_NAMES = [f.strip().split()[0] for f in RECORD.split(",")]
_SPACE = uuid.UUID("6f2d1c7a-0000-8000-8000-000000000000").int
_NULL = 1 << 120


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the id's 64 bits (2 in the middle field, 62 in the last)."""
    bits = 0 if page_id is None else page_id & (2**64 - 1)
    value = _SPACE | (bits >> 62) << 64 | bits & (2**62 - 1)
    return f"<urn:uuid:{uuid.UUID(int=value ^ _NULL if page_id is None else value)}>"


def page_of(urn: str | None) -> int | None:
    """The id in a record id, if :func:`record_id` made it."""
    try:
        value = uuid.UUID((urn or "").strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    if value >> 80 != _SPACE >> 80:
        return None
    bits = (value >> 64 & 3) << 62 | value & (2**62 - 1)
    return bits - 2**64 if bits >> 63 else bits


# --- records -----------------------------------------------------------------------------------------------------


def _fields(fields: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7F-\x9F]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def http_header(payload_bytes: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\n" + _fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(payload_bytes))]) + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record; ``payload`` is left out of a revisit, whose fields describe it all the same."""
    block = http_header(len(payload)) + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _uri(url))] if url is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}")]
    fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(refers_to))] if revisit else []
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"%s\r\n%s\r\n%s\r\n\r\n" % (VERSION, _fields(fields), block)


class Malformed(ValueError):
    """A record or frame that breaks the format."""


def _parse_fields(lines: list[bytes], once: bool = True) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        key, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not key or key != key.strip():
            raise Malformed(f"no header field: {line[:40]!r}")
        name = key.lower()
        if once and name in out:
            raise Malformed(f"{key} occurs twice")
        out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def _length(fields: dict[str, str], of: str) -> int:
    value = fields.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise Malformed(f"{of}: length {value!r}")
    return int(value)


def _sha1(field: str | None) -> str | None:
    """The hex digits of a SHA-1 digest field; those of other kinds are not checked."""
    kind, _, value = (field or "").partition(":")
    return value.lower() if kind.lower() == "sha1" and re.fullmatch(r"[0-9a-fA-F]{40}", value) else None


def parse(data: bytes) -> dict:
    """The checked parts of one record: its fields by lower-case name, payload, payload_bytes, payload_digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/\d+\.\d+", first):
        raise Malformed("no WARC header")
    fields = _parse_fields(lines.split(b"\r\n") if lines else [])
    missing = [f for f in REQUIRED if f not in fields]
    if missing:
        raise Malformed(f"without {', '.join(missing)}")
    n = _length(fields, "record")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Malformed(f"block of {n} bytes in {len(rest)}")
    block = rest[:n]
    want = _sha1(fields.get("warc-block-digest"))
    if want and want != hashlib.sha1(block).hexdigest():
        raise Malformed("block digest")
    out = {"fields": fields, "payload": block, "payload_bytes": n, "payload_digest": _sha1(fields.get("warc-payload-digest"))}
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return out
    header, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise Malformed("no HTTP header")
    http = _parse_fields(header.split(b"\r\n")[1:], once=False)
    revisit = fields["warc-type"] == "revisit"
    length = _length(http, "HTTP header") if "content-length" in http and "transfer-encoding" not in http else None
    if revisit and payload or not revisit and length not in (None, len(payload)):
        raise Malformed(f"payload of {length} bytes is {len(payload)} long")
    length = len(payload) if length is None and not revisit else length
    found = out["payload_digest"] if revisit else hashlib.sha1(payload).hexdigest()
    if out["payload_digest"] not in (None, found):
        raise Malformed("payload digest")
    return {**out, "payload": None if revisit else payload, "payload_bytes": length, "payload_digest": found}


# --- frames ------------------------------------------------------------------------------------------------------


def dictionary_frame(raw: bytes) -> bytes:
    """The leading skippable frame: the dictionary as a Zstandard frame where that is shorter."""
    packed = zstandard.ZstdCompressor(level=19).compress(raw)
    body = min(packed, raw, key=len)
    return struct.pack("<II", DICTIONARY_FRAME, len(body)) + body


class _Source:
    """A file's bytes, read in pieces, with what was read ahead."""

    def __init__(self, file):
        self.file, self.ahead, self.at = file, b"", 0

    def fill(self, n: int) -> bool:
        while len(self.ahead) < n:
            more = self.file.read(max(PIECE, n - len(self.ahead)))
            if not more:
                return False
            self.ahead += more
        return True

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise Malformed("the file ends inside a frame")
        out, self.ahead = self.ahead[:n], self.ahead[n:]
        self.at += n
        return out

    def skip(self, n: int) -> None:
        while n > 0:
            n -= len(self.take(min(n, PIECE)))


def _dictionary(source: _Source) -> zstandard.ZstdCompressionDict | None:
    if not source.fill(8):
        return None
    magic, size = struct.unpack("<II", source.ahead[:8])
    if magic != DICTIONARY_FRAME:
        return None
    source.take(8)
    body = source.take(size)
    if body[:4] == struct.pack("<I", FRAME):
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT)


def _frame(source: _Source, dictionary: zstandard.ZstdCompressionDict | None) -> bytes:
    """The content of the frame that begins here."""
    source.fill(18)
    try:
        about = zstandard.get_frame_parameters(source.ahead)
        if about.dict_id and about.dict_id != (dictionary.dict_id() if dictionary else 0):
            raise Malformed(f"dictionary {about.dict_id} is not the archive's")
        decoder = (zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()).decompressobj()
        out = []
        while not decoder.eof:
            if not source.fill(1):
                raise Malformed("the file ends inside a frame")
            piece = source.take(min(len(source.ahead), PIECE))
            out.append(decoder.decompress(piece))
            if decoder.eof and decoder.unused_data:
                source.ahead = decoder.unused_data + source.ahead
                source.at -= len(decoder.unused_data)
    except zstandard.ZstdError as e:
        raise Malformed(str(e)) from e
    content = b"".join(out)
    if about.content_size not in (len(content), zstandard.CONTENTSIZE_UNKNOWN):
        raise Malformed(f"frame of {about.content_size} bytes holds {len(content)}")
    return content


def read_frames(file) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, content, None) per frame of an open archive; (offset, None, error) ends it where a frame cannot be decoded."""
    source = _Source(file)
    begin = 0
    try:
        dictionary = _dictionary(source)
        while source.fill(1):
            begin = source.at
            if not source.fill(8):
                raise Malformed("the file ends inside a frame")
            magic, size = struct.unpack("<II", source.ahead[:8])
            if magic in SKIPPABLE:
                source.take(8)
                source.skip(size)
            elif magic == FRAME:
                yield begin, _frame(source, dictionary), None
            else:
                raise Malformed(f"no frame: {magic:#x}")
    except (Malformed, zstandard.ZstdError) as e:
        yield begin, None, f"{e}; the rest is not read"


def _open(path: str):
    """The file system and path of a Spark path (``file:/a``, ``file:///a``, ``/a`` or any scheme that Arrow knows)."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


# --- tables ------------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """id, url, payload (bytes), digest (SHA-1), refers_to (the id of the row that holds the payload) and revisit."""
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    groups = rows.where("same is not null").groupBy("same").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1"))
    if groups.isEmpty():
        rows = rows.withColumns({"first": F.lit(None).cast("long"), "n": F.lit(None).cast("long")})
    else:
        rows = heavy_join(rows, groups.withColumn("weight", F.col("n")), ["same"], "weight", ["id", "url", "payload"])
    revisit = F.col("n").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.select("id", "url", "payload", F.sha1("payload").alias("digest"), F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def train(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> bytes:
    """A dictionary from a bounded sample; empty where there is too little to learn from.  It changes sizes, never contents."""
    share = min(1.0, 2 * SAMPLE_ROWS / max(1, pages.count()))
    drawn = pages.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = drawn.select(F.substring(payload_col, 1, SAMPLE_CHARS).alias("t")).where("t is not null").limit(SAMPLE_ROWS)
    texts = [r["t"].encode() for r in sample.collect()]
    texts = [http_header(len(t)) + t for t in texts if t]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = 1000,
    dictionary: bytes | None = None,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write the rows as archives into ``folder`` (seen by all executors); the archives: path, n_records, n_bytes."""
    rows = with_revisits(pages, id_col, url_col, payload_col, least)
    raw = train(pages, id_col, payload_col) if dictionary is None else dictionary
    info = _fields([("software", "cityhop"), ("format", "WARC File Format 1.1")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT) if raw else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True, write_content_size=True)
        done: list[tuple[str, int, int]] = []
        out, name, n, size = None, "", 0, 0

        def begin():
            name = f"{uuid.uuid4().hex}.warc.zst"
            out = system.open_output_stream(f"{base}/{name}", compression=None)
            if raw:
                out.write(dictionary_frame(raw))
            fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name)]
            fields += [("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]
            out.write(compressor.compress(b"%s\r\n%s\r\n%s\r\n\r\n" % (VERSION, _fields(fields), info)))
            return out, name

        for batch in batches:
            for page, url, payload, digest, refers_to, revisit in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if out is None:
                    out, name = begin()
                    n = size = 0
                data = record(page, url, payload, digest, refers_to, revisit, date)
                out.write(compressor.compress(data))
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder.rstrip('/')}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder.rstrip('/')}/{name}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "n_records", "n_bytes"])

    return written(rows.mapInArrow(write, "path string, n_records long, n_bytes long"))


def _rows(path: str, payloads: bool) -> Iterator[tuple]:
    system, at = _open(path)
    with system.open_input_stream(at, compression=None) as file:
        for offset, data, error in read_frames(file):
            if error is None:
                try:
                    got = parse(data)
                    fields = got["fields"]
                    kind = fields["warc-type"]
                    yield (path, offset, kind, fields["warc-record-id"], page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), got["payload_bytes"],
                           got["payload_digest"], page_of(fields.get("warc-refers-to")), got["payload"] if payloads else None, None)
                    continue
                except ValueError as e:
                    error = str(e)
            yield (path, offset, *[None] * 8, error)


def read_archives(archives: DataFrame, payloads: bool = True, path_col: str = "path") -> DataFrame:
    """One row per record (and per fault) of the archives whose paths are given: a task an archive at most.

    ``page_id`` and ``refers_to`` are set where the record ids are those of ``record_id``.
    """
    kind = pa.schema([pa.field(n, t) for n, t in zip(_NAMES, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for row in _rows(path, payloads):
                    rows.append(row)
                    size += len(row[9] or b"") + 200
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    paths = archives.select(F.col(path_col).alias("path")).distinct()
    n = paths.count()
    return paths.repartition(max(1, n), "path").mapInArrow(read, RECORD)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder that anything wrote: path and n_bytes (no content is read)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("n_bytes"))


def dangling(records: DataFrame) -> DataFrame:
    """Revisits (record_id they refer to, digest) whose response is not among the records, each once."""
    held = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    wanted = records.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    same = wanted["refers_to"].eqNullSafe(held["refers_to"]) & (wanted["payload_digest"] == held["payload_digest"])
    return wanted.join(held, same, "left_anti")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """Write the rows as archives into the session's shared folder and read them back: the rows of ``read_archives``, without
    the archives' own info records.  A fault in any record ends the job."""
    folder = f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    records = read_archives(write_archives(pages, folder, id_col, url_col, payload_col, least), payloads=False)
    fault = F.raise_error(F.concat_ws(" ", "archive", F.col("offset").cast("string"), "error")).cast("string")
    checked = records.withColumn("record_type", F.when(F.col("error").isNull(), F.col("record_type")).otherwise(fault))
    return checked.where("record_type <> 'warcinfo'")
