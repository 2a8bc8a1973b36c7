"""WARC archives in Zstandard with a dictionary of their own.

Records are dealt into archives of bounded size. Each archive trains a dictionary on its own records (the first
SAMPLE_BYTES of each of evenly spaced records up to TRAIN_BYTES in all, a bounded fitting sample); records too few or alike for
training give their own bytes as a raw-content dictionary. It is stored in a leading
skippable frame, and every record is compressed as a frame of its own, so that one record can be read by its offset.

Of records with equal payloads of at least `least` bytes, the one with the largest id is a response and the others
are revisits of it. Archives are rows (archive, part, content) of a DataFrame, so Spark's writers place them in any
store; save_archives() also writes plain files to a mounted folder.

Cases: a null payload is empty. A null url is written as about:blank, control characters in a url are percent-encoded. Rows that
repeat the largest id are all responses; a null id is never larger than another and is written as `none`. An empty
table gives no archive. Extra columns are not archived. A very long payload is one record; a worker holds one archive at a time.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.common import small_batches, small_reads, written

#: Magic number of the skippable frame that holds a dictionary (fixed value of the published format).
SKIPPABLE = 0x184D2A5D

#: Raw bytes after which an archive is closed; size of a dictionary and of what it is fitted on; the level.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAIN_BYTES, SAMPLE_BYTES, LEVEL = 8 << 20, 16 << 10, 512 << 10, 16 << 10, 3
CHUNK = 16 << 10

ARCHIVE = "archive string, n_records long, content binary"
RECORD = "id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, archive string, offset long, stored_bytes long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_revisits(pages: DataFrame, ident: str, payload: str, least: int = 0) -> DataFrame:
    """pages with refers_to: the largest id of its equals, null for a response. Payloads are compared by SHA-256 and length.

    Payloads are read twice: for a written table of ids and digests, which are then grouped, and with what comes back.
    """
    small_reads(pages.sparkSession)
    content = F.coalesce(F.col(payload), F.lit(""))
    own = pages.withColumns({"__same": F.sha2(content, 256), "__size": F.octet_length(content)})
    keys = written(own.select(F.col(ident).alias("__id"), "__same", "__size"), "warc-keys")
    last = keys.where(F.col("__size") >= least).groupBy("__same", "__size").agg(F.max("__id").alias("__last"))
    pairs = keys.join(last, ["__same", "__size"]).where("__id is null or __id < __last")
    targets = pairs.select("__id", "__same", "__last").distinct()
    return own.join(targets, (own[ident].eqNullSafe(targets["__id"])) & (own["__same"] == targets["__same"]), "left").select(*[own[c] for c in pages.columns], F.col("__last").alias("refers_to"))


def record_bytes(ident: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has no content of its own but its payload's digest and length."""
    target = quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~") or "about:blank"
    kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'none' if ident is None else ident}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained where that works, else the ends of the sampled records themselves."""
    heads = [r[:SAMPLE_BYTES] for r in records]
    heads = heads[:: max(1, sum(map(len, heads)) // TRAIN_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, heads, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(heads)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def build_archive(records: list[bytes]) -> bytes:
    dictionary, out = dictionary_of(records), io.BytesIO()
    frame = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
    out.write(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
    for r in records:
        out.write(pack.compress(r))
    return out.getvalue()


def write_archives(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html", refers_to: str = "refers_to", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive rows; each task packs its own records, so nothing is shuffled."""
    small_batches(pages.sparkSession)
    small_reads(pages.sparkSession)
    rows = pages.select(F.col(ident).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"), F.col(refers_to).cast("long").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            content = build_archive(held)
            name = f"pages-{hashlib.sha256(content).hexdigest()[:24]}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([content], pa.binary())], names=["archive", "n_records", "content"])

        for batch in batches:
            for k, u, p, r in zip(*(batch.column(i) for i in range(4))):
                record = record_bytes(k.as_py(), u.as_py(), p.as_py().encode(), r.as_py(), date)
                held.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return rows.mapInArrow(run, ARCHIVE)


HEAD = re.compile(rb"([^:\r\n]+): ([^\r\n]*)\r\n")


def frames(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Records as (offset, stored bytes, raw bytes), after the leading dictionary if there is one."""
    at, dictionary = 0, None
    if content[:4] == struct.pack("<I", SKIPPABLE):
        size = struct.unpack_from("<I", content, 4)[0]
        raw = content[8 : 8 + size]
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(content)
    while at < len(content):
        d, raw, stop = unpack.decompressobj(), [], at
        while not d.eof and stop < len(content):
            raw.append(d.decompress(view[stop : stop + CHUNK]))
            stop = min(len(content), stop + CHUNK)
        stop -= len(d.unused_data)
        yield at, stop - at, b"".join(raw)
        at = stop


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode() for k, v in HEAD.findall(head + b"\r\n")}
    return fields, rest[: int(fields["content-length"])]


def page_of(value: str | None) -> int | None:
    found = re.search(r"urn:x-page:(-?\d+)", value or "")
    return int(found[1]) if found else None


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record, as RECORD says; a response's length and digest are of the content that was read."""
    small_batches(archives.sparkSession)
    kinds = {"id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "url": pa.string(), "archive": pa.string(), "offset": pa.int64(), "stored_bytes": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(2)):
                rows = []
                for at, used, raw in frames(content.as_py()):
                    h, body = parse_record(raw)
                    if h["warc-type"] == "response":
                        size, digest = len(body), base32_sha1(body)
                    else:
                        size, digest = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((page_of(h["warc-record-id"]), h["warc-type"], page_of(h.get("warc-refers-to")), size, digest, h["warc-target-uri"], name.as_py(), at, used))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    return archives.select("archive", "n_records", "content").mapInArrow(run, RECORD)


def save_archives(archives: DataFrame, folder: str) -> None:
    """Write each archive to a folder that is mounted on every executor; a retried task writes the same bytes."""

    def save(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            part = os.path.join(folder, f".{row.archive}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(row.content)
            os.replace(part, os.path.join(folder, row.archive))

    archives.foreachPartition(save)
