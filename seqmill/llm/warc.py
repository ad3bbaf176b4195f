"""Zstandard WARC archives: written and read in Spark tasks, one frame for each record.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary of all
frames after it, raw or itself compressed. Each later frame is one record. The reader streams
an archive: it loads the dictionary, decodes frame by frame and holds every record's version,
headers, block and payload lengths and payload digest against the content.

Of records with equal payloads of at least `least_bytes`, that with the largest page_id is a
response and the others are revisits of it; smaller ones are all responses.

Cases: a null html is an empty payload; rows with equal page_id and payload are alike, so all
are responses if that page_id is the largest; a null page_id counts below all others, and is a
response if no other page has the payload; a null url is empty; an empty table writes no
archive and reads none; other columns are ignored; very long pages are whole records, held one at
a time, up to Spark's bound of 2 GB a value.

A task writes each archive under a name of its own attempt, so a lost or repeated task leaves
at most files that no list of archives names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, keyed_join, shared_folder, stash

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:seqmill:page:"
DATE = "1970-01-01T00:00:00Z"
#: What may stand unchanged in a header's address.
PLAIN = ";/?:@&=+$,#[]!'()*~%|<>\"\\^`{} "


# ---- records


def http_block(payload: bytes | None, size: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return head + (payload or b"")


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    block = http_block(None if revisit else payload, len(payload))
    own = "" if page_id is None else page_id
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{URN}{own}>"), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url.replace("%", "%25"), safe=PLAIN)), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    headers.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record; error says what does not hold, else it is null."""
    out: dict = {"record_type": None, "page_id": None, "refers_to": None, "url": None, "payload": None, "payload_bytes": None, "payload_digest": None, "error": None}
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != VERSION:
        return out | {"error": "no WARC header"}
    headers = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return out | {"error": "header line without a colon"}
        headers[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in headers]
    if missing:
        return out | {"error": f"no {missing[0]}"}
    size = headers["content-length"]
    if not size.isdigit() or rest[int(size) :] != b"\r\n\r\n":
        return out | {"error": "block length"}
    number = lambda x: int(n) if (n := x.strip("<>").removeprefix(URN)) and n.lstrip("-").isdigit() else None
    out |= {"record_type": headers["warc-type"], "page_id": number(headers["warc-record-id"]), "url": unquote(headers.get("warc-target-uri", ""))}
    if "warc-refers-to" in headers:
        out["refers_to"] = number(headers["warc-refers-to"])
    http, sep, payload = rest[: int(size)].partition(b"\r\n\r\n")
    stated = [line.partition(b":")[2].strip() for line in http.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")]
    if not sep or not http.startswith(b"HTTP/") or len(stated) != 1 or not stated[0].isdigit():
        return out | {"error": "http header"}
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    out |= {"payload_bytes": int(stated[0]), "payload_digest": digest}
    if out["record_type"] == "revisit":
        return out | {"error": None if not payload and "warc-refers-to" in headers else "revisit with a payload or without a reference"}
    if len(payload) != int(stated[0]):
        return out | {"error": "payload length"}
    if hashlib.sha1(payload).hexdigest() != digest:
        return out | {"error": "payload digest"}
    return out | {"payload": payload}


# ---- archives


def make_dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary trained on samples; raw content where they are too few to train on."""
    samples = [s for s in samples if s]
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(sink, records: Iterator[bytes], dictionary: zstandard.ZstdCompressionDict | None, most: int) -> int:
    """Frames of records until `most` bytes are written; how many records that were."""
    content = dictionary.as_bytes() if dictionary else b""
    sink.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True) if dictionary else zstandard.ZstdCompressor(level=3, write_checksum=True)
    written = n = 0
    for r in records:
        frame = packer.compress(r)
        sink.write(frame)
        written, n = written + len(frame), n + 1
        if written >= most:
            break
    return n


def read_archive(source, piece: int = 1 << 17) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, error) of each frame; an undecodable frame ends the archive with an error."""
    held, at, ended = b"", 0, False

    def more(n: int) -> bool:
        nonlocal held, ended
        while len(held) < n and not ended:
            got = source.read(max(piece, n - len(held)))
            ended = not got
            held += got
        return len(held) >= n

    unpacker = zstandard.ZstdDecompressor()
    if more(8) and struct.unpack("<I", held[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", held[4:8])[0]
        if not more(8 + size):
            yield 0, None, "the dictionary is cut off"
            return
        content, held, at = held[8 : 8 + size], held[8 + size :], 8 + size
        if content[:4] == struct.pack("<I", FRAME):
            content = zstandard.ZstdDecompressor().stream_reader(content).read()
        if content:
            unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    while more(1):
        frame, out, begun = unpacker.decompressobj(), [], at
        try:
            while True:
                out.append(frame.decompress(held))
                if frame.eof:
                    at += len(held) - len(frame.unused_data)
                    held = frame.unused_data
                    break
                at, held = at + len(held), b""
                if not more(1):
                    yield begun, None, "the frame is cut off"
                    return
        except zstandard.ZstdError as e:
            yield begun, None, f"no frame: {e}"
            return
        yield begun, b"".join(out), None


def _opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


# ---- Spark


def plan_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, refers_to, revisit of every page.

    Equal payloads are found by SHA-1 and length with partial maxima, so a hot payload is one
    row a task; only payloads that occur again are joined back, by broadcast if they are few,
    else salted.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("key", F.when(F.octet_length("payload") >= least_bytes, F.concat_ws("-", "digest", F.octet_length("payload"))))
    again = rows.filter("key is not null").groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    again = stash(again, "payloads")
    joined = keyed_join(rows, again, "key", again.count(), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(planned: DataFrame, folder: str | None = None, archive_bytes: int = 64 << 20, dictionary_bytes: int = 16 << 10, sample_records: int = 128) -> DataFrame:
    """Write planned rows as archives of about archive_bytes; the table of their paths.

    The dictionary of an archive is trained on its task's first `sample_records` records, of
    which at most 8 KB each are read for it.
    """
    folder = folder or f"{shared_folder(planned.sparkSession)}/seqmill-warc-{uuid.uuid4().hex}"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit")), strict=True):
                    yield record_bytes(*(x.as_py() for x in row))

        task, fs_root = TaskContext.get(), _opened(folder)
        fs, root = fs_root
        fs.create_dir(root, recursive=True)
        source, first = records(), []
        for r in source:
            first.append(r)
            if len(first) >= sample_records:
                break
        if not first:
            return
        dictionary = make_dictionary([r[:8192] for r in first], dictionary_bytes)

        def all_records() -> Iterator[bytes]:
            yield from first
            yield from source

        stream, names, counts = all_records(), [], []
        pending = next(stream, None)
        while pending is not None:
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.warc.zst"
            # chain, unlike a generator, leaves the stream open when an archive is full
            with fs.open_output_stream(f"{root}/{name}") as sink:
                counts.append(write_archive(sink, chain([pending], stream), dictionary, archive_bytes))
            names.append(f"{folder}/{name}")
            pending = next(stream, None)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], names=["path", "records"])

    return stash(bounded(planned).mapInArrow(written, "path string, records bigint"), "archives")


RECORD = "archive string, position bigint, record_type string, page_id bigint, refers_to bigint, url string, payload binary, payload_bytes bigint, payload_digest string, error string"


def read_warc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives that column path names; see RECORD for the columns.

    Archives are dealt over the tasks; each is streamed, so a task holds one record at a time.
    """
    fields = ["archive", "position", "record_type", "page_id", "refers_to", "url", "payload", "payload_bytes", "payload_digest", "error"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def rows(path: str) -> Iterator[dict]:
        fs, at = _opened(path)
        with fs.open_input_stream(at) as source:
            for offset, data, error in read_archive(source):
                yield (parse_record(data) if data is not None else {"error": error}) | {"archive": path, "position": offset}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                block, size = [], 0
                for row in rows(path):
                    if not with_payload:
                        row["payload"] = None
                    block.append(row)
                    size += len(row.get("payload") or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in block], k) for f, k in zip(fields, kinds, strict=True)], names=fields)
                        block, size = [], 0
                if block:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in block], k) for f, k in zip(fields, kinds, strict=True)], names=fields)

    tasks = max(1, min(archives.count(), 4 * archives.sparkSession.sparkContext.defaultParallelism))
    return archives.select("path").repartition(tasks).mapInArrow(read, RECORD)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder, as read_warc() takes them; Spark lists it, no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path")
