"""WARC archives in Zstandard: written with a dictionary of their own, read frame by frame.

An archive begins with a skippable frame that holds the dictionary; each record is one frame
behind it. Archives have a bounded size, so that one is a row of Spark's `binaryFile` reader.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadshelf.llm.common import arrow_schema, slices, type_of
from threadshelf.plans.lineage import cut, work_path

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

# Bytes of records, before compression, after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
# Records and bytes of the sample a dictionary is trained on.
SAMPLE_RECORDS, SAMPLE_BYTES = 200, 1 << 20
DICTIONARY_BYTES = 16 << 10
LEVEL = 3

RECORD_FIELDS = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, error string"


class BadRecord(ValueError):
    pass


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_uri(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "%" + c.encode("utf-8", "replace").hex() for c in value)


def record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit without it that refers to a response."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", page_uri(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url or "")),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", page_uri(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields), "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def trained_dictionary(samples: list[bytes]):
    """A dictionary from a sample of records, or None where they are too few to train one."""
    import zstandard

    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Collects records and gives out whole archives."""

    def __init__(self, most: int = ARCHIVE_BYTES):
        self.most, self.records, self.size = most, [], 0

    def add(self, data: bytes) -> bytes | None:
        """An archive, when this record filled it."""
        self.records.append(data)
        self.size += len(data)
        return self.close() if self.size >= self.most else None

    def close(self) -> bytes | None:
        if not self.records:
            return None
        import zstandard

        sample, total = [], 0
        step = max(1, len(self.records) // SAMPLE_RECORDS)
        for data in self.records[::step]:
            if total + len(data) <= SAMPLE_BYTES:
                sample.append(data)
                total += len(data)
        dictionary = trained_dictionary(sample)
        out = io.BytesIO()
        if dictionary is not None:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        for data in self.records:
            out.write(compressor.compress(data))
        self.records, self.size = [], 0
        return out.getvalue()


def frame_end(content: bytes, at: int) -> int:
    """Where the Zstandard frame at a place ends, from its header and the headers of its blocks."""
    end = len(content)
    if at + 5 > end or content[at : at + 4] != ZSTD_MAGIC:
        raise BadRecord(f"offset {at}: no Zstandard frame")
    described = content[at + 4]
    single = described >> 5 & 1
    at_size = (single, 2, 4, 8)[described >> 6]
    place = at + 5 + (1 - single) + (0, 1, 2, 4)[described & 3] + at_size
    last = False
    while not last:
        if place + 3 > end:
            raise BadRecord(f"offset {at}: the frame is cut off")
        block = int.from_bytes(content[place : place + 3], "little")
        last, kind = bool(block & 1), block >> 1 & 3
        # a run of one byte is stored as that byte
        place += 3 + (1 if kind == 1 else block >> 3)
    place += 4 * (described >> 2 & 1)
    if place > end:
        raise BadRecord(f"offset {at}: the frame is cut off")
    return place


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame, decoded with the dictionary of the leading frame.

    Every byte is read once: a frame's end is known before it is decoded.
    """
    import zstandard

    at, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        (length,) = struct.unpack_from("<I", content, 4)
        held = content[8 : 8 + length]
        if len(held) != length:
            raise BadRecord("the dictionary frame is cut off")
        if held[:4] == ZSTD_MAGIC:
            held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
        dictionary, at = zstandard.ZstdCompressionDict(held), 8 + length
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(content)
    while at < len(content):
        if len(content) - at >= 8 and struct.unpack_from("<I", content, at)[0] in SKIPPABLE_FRAMES:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        end = frame_end(content, at)
        one = reader.decompressobj()
        try:
            data = one.decompress(view[at:end])
        except zstandard.ZstdError as error:
            raise BadRecord(f"offset {at}: {error}") from error
        if not one.eof:
            raise BadRecord(f"offset {at}: the frame is cut off")
        yield at, data
        at = end


def parse_record(data: bytes) -> dict:
    """Headers, block and payload of one record; BadRecord where they are not consistent."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        raise BadRecord("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise BadRecord("a header line without a name")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    missing = [x for x in REQUIRED if x.lower() not in fields]
    if missing:
        raise BadRecord(f"no {missing[0]}")
    length = fields["content-length"]
    if not length.isascii() or not length.isdigit():
        raise BadRecord("Content-Length is no number")
    block, end = rest[: int(length)], rest[int(length) :]
    if len(block) != int(length) or end != b"\r\n\r\n":
        raise BadRecord(f"Content-Length {length} does not fit the record")
    http, blank, payload = block.partition(b"\r\n\r\n")
    if not (http.startswith(b"HTTP/") and blank):
        payload = block
    told = fields.get("warc-block-digest")
    if told and told.startswith("sha1:") and told[5:] != base32_sha1(block):
        raise BadRecord("the block does not have its digest")
    kind = fields["warc-type"]
    told = fields.get("warc-payload-digest")
    if kind == "response" and told and told.startswith("sha1:") and told[5:] != base32_sha1(payload):
        raise BadRecord("the payload does not have its digest")
    if kind == "revisit" and not fields.get("warc-refers-to"):
        raise BadRecord("a revisit that refers to nothing")
    return {"fields": fields, "block": block, "payload": payload}


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    smallest: int = 0, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write every row as a record to archives in `folder`; gives (path, records, bytes).

    Of rows whose payloads are equal and have `smallest` bytes or more, those with the smallest
    id become responses and all others revisits of it (a null id never is the smallest). A null
    html is an empty payload, a null url an empty one. Files get a new name at every attempt, and
    only those that the result names belong to it, so a task may run twice.

    Payloads that come twice are found on their digests, counted before the shuffle; rows are
    then joined with the few digests, which adaptive execution splits where one is hot.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    again = cut(
        rows.where(F.octet_length("html") >= smallest)
        .groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("digest", "first")
    )
    chosen = rows.join(again, "digest", "left").select(
        "id", "url", "html",
        F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder))
        writer, made = ArchiveWriter(archive_bytes), []

        def save(content: bytes | None, records: int) -> None:
            if content:
                name = f"{uuid.uuid4().hex}.warc.zst"
                with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(content)
                made.append((name, records, len(content)))

        n = 0
        system.create_dir(root, recursive=True)
        for batch in slices(batches, 2):
            for row in batch.to_pylist():
                n += 1
                content = writer.add(record(row["id"], row["url"], row["html"].encode(), row["refers_to"]))
                if content:
                    save(content, n)
                    n = 0
        save(writer.close(), n)
        names, counts, sizes = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"]
        )

    return cut(chosen.mapInArrow(write, "path string, records long, bytes long"))


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of archives given as (path, content), such as `binaryFile` rows.

    One row per record: path, offset, record_type, record_id, target_uri, refers_to,
    payload_bytes, payload_digest (bare base32), error, and the payload if asked for. A record
    that is damaged gives a row with `error`; one whose frame cannot be decoded ends its archive
    with such a row, as the next frame cannot be found. A revisit has no payload of its own:
    payload_bytes is null until `resolve_revisits`.
    """
    schema = RECORD_FIELDS + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def decode(path: str, content: bytes) -> Iterator[tuple]:
        at = 0
        try:
            for at, data in frames(content):
                try:
                    found = parse_record(data)
                except BadRecord as error:
                    yield (path, at, *[None] * 6, str(error), None)
                    continue
                fields, payload = found["fields"], found["payload"]
                kind = fields["warc-type"]
                whole = kind == "response"
                digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                if whole and digest is None:
                    digest = base32_sha1(payload)
                yield (
                    path, at, kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-refers-to"),
                    len(payload) if whole else None, digest, None, payload if whole else None,
                )
        except BadRecord as error:
            yield (path, at, *[None] * 6, str(error), None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[i], target.field(i).type) for i in range(len(names))], schema=target)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for row in decode(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""):
                    rows.append(row)
                    size += 200 + (len(row[-1] or b"") if with_payload else 0)
                    if size >= ARCHIVE_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    target = arrow_schema(schema)
    return files.select("path", "content").mapInArrow(read, schema)


def archive_files(manifest: DataFrame, folder: str) -> DataFrame:
    """The files that a manifest of `write_archives` names, as (path, content)."""
    files = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    return named.join(manifest.select("path"), "path", "left_semi")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Revisits get the payload_bytes of the response they refer to, null if it is not there or
    has another digest.

    Only responses that are referred to take part, one row each; adaptive execution splits a hot one.
    """
    wanted = records.where(F.col("record_type") == "revisit").select(F.col("refers_to").alias("record_id")).distinct()
    held = cut(
        records.where((F.col("record_type") == "response"))
        .join(wanted, "record_id", "left_semi")
        .groupBy(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("held_digest"))
        .agg(F.max("payload_bytes").alias("held_bytes"))
    )
    joined = records.join(
        held, (records["refers_to"] == held["refers_to"]) & (records["payload_digest"] == held["held_digest"]), "left"
    )
    return joined.select(
        *[records[c] for c in records.columns if c != "payload_bytes"],
        F.coalesce(records["payload_bytes"], F.col("held_bytes")).alias("payload_bytes"),
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to archives in the shared folder, read them back: (id, payload_bytes,
    payload_digest, record_type, refers_to), one row per page."""
    folder = work_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, id_col, url_col, html_col)
    kind = type_of(pages, id_col)
    if manifest.isEmpty():
        records = pages.sparkSession.createDataFrame([], RECORD_FIELDS)
    else:
        records = cut(read_archives(archive_files(manifest, folder)))
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    # A damaged record stays a row, with its error, rather than a page that is missing.
    return resolve_revisits(records).select(
        number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"), "error",
    )
