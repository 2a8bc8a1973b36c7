"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

The writer stores 8-bit mono samples as PCM frames with EBML lacing; one tick is one sample. The reader takes any
Matroska bytes: unknown sizes, simple blocks and block groups, all four lacings, cues.

Cases: a null or empty text is stored as one 64-byte block of zeros. Null or damaged media have no packets past the
damage, and the packet table's `error` says where the parser stopped. Equal payloads give equal bytes. Rows may
repeat, and extra columns are left alone. A worker holds one text and its media at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeline.llm.common import small_batches

#: Element ids of the published format (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIME_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, BITS, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE1, 0xB5, 0x9F, 0x6264, 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, DOC_TYPE, MUXER, WRITER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0x4282, 0x4D80, 0x5741
DOC_VERSION, DOC_READ_VERSION, FRAME_DURATION = 0x4287, 0x4285, 0x23E383

#: Bytes of a frame, frames of a block, blocks of a cluster: a cluster's last block starts within 16 signed bits.
FRAME, LACED, BLOCKS = 1024, 8, 4
SAMPLE_RATE, UNIT = 8000, 64


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is kept for unknown."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes with zeros up to a positive multiple of 64."""
    data = (text or "").encode("utf-8")
    return len(data), data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def laced_block(frames: list[bytes], ticks: int) -> bytes:
    """A simple key-frame block; several frames use EBML lacing (first size, then signed differences)."""
    if len(frames) == 1:
        return element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", ticks, 0x80) + frames[0])
    sizes = vint(len(frames[0]))
    for a, b in zip(frames, frames[1:-1]):
        d = len(b) - len(a)
        width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
        sizes += vint(d + (1 << 7 * width - 1) - 1, width)
    return element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hBB", ticks, 0x86, len(frames) - 1) + sizes + b"".join(frames))


def mux(payload: bytes) -> bytes:
    # simple blocks need version 2
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 2) + number(DOC_READ_VERSION, 2))
    info = element(INFO, number(TIME_SCALE, 10**9 // SAMPLE_RATE) + element(DURATION, struct.pack(">d", len(payload))) + element(MUXER, b"tapeline") + element(WRITER, b"tapeline"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(BITS, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FRAME_DURATION, FRAME * 10**9 // SAMPLE_RATE) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    for start in range(0, len(payload), FRAME * LACED * BLOCKS):
        blocks = [number(CLUSTER_TIME, start)]
        for b in range(start, min(len(payload), start + FRAME * LACED * BLOCKS), FRAME * LACED):
            stop = min(len(payload), b + FRAME * LACED)
            blocks.append(laced_block([payload[i : min(i + FRAME, stop)] for i in range(b, stop, FRAME)], b - start))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """Packets as (track, timestamp in ticks, key, byte offset, bytes, cluster); cues as (time, track, byte offset).

    Frames of a lace follow each other by their track's frame duration (frame_ns); without one they all have their block's time.
    """

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[tuple[int, int, str]] = field(default_factory=list)
    packets: list[tuple[int, int, bool, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    frame_ns: dict[int, int] = field(default_factory=dict)
    error: str | None = None


def read_vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int | None, int]:
    """Value and next position; None for an unknown size. keep: with the marker, as in ids."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"cut off at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def children(data: bytes, at: int, end: int, stop: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """Elements as (id, start, end); one of unknown size ends at its parent's next own kind."""
    while at < end:
        ident, body = read_vint(data, at, end, True)
        if ident in stop:
            return
        size, body = read_vint(data, body, end)
        if size is None:
            last = body
            for _, _, last in children(data, body, end, frozenset({CLUSTER, CUES, TRACKS, INFO}) if ident == CLUSTER else frozenset()):
                pass
            size = last - body
        if body + size > end:
            raise ValueError(f"element at {at} runs past its parent")
        yield ident, body, body + size
        at = body + size


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Frame sizes and where the first frame starts."""
    if not lacing:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if lacing == 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            first = at
            n, at = read_vint(data, at, end)
            if k:
                n = sizes[-1] + n - ((1 << 7 * (at - first) - 1) - 1)
        sizes.append(n)
    return [*sizes, end - at - sum(sizes)], at


def demux(data: bytes | None) -> Media:
    out = Media()
    if not data:
        return out
    try:
        for ident, a, b in children(data, 0, len(data)):
            if ident == SEGMENT:
                _segment(data, a, b, out)
    except (ValueError, IndexError, struct.error, TypeError) as e:
        out.error = str(e)
    return out


def _segment(data: bytes, start: int, end: int, out: Media) -> None:
    for ident, a, b in children(data, start, end):
        if ident == INFO:
            for i, x, y in children(data, a, b):
                if i == TIME_SCALE:
                    out.scale = _uint(data, x, y)
                elif i == DURATION:
                    out.duration = _float(data, x, y)
        elif ident == TRACKS:
            for _, x, y in (c for c in children(data, a, b) if c[0] == TRACK_ENTRY):
                got = {i: data[p:q] for i, p, q in children(data, x, y)}
                out.frame_ns[int.from_bytes(got.get(TRACK_NUMBER, b""), "big")] = int.from_bytes(got.get(FRAME_DURATION, b""), "big")
                out.tracks.append((int.from_bytes(got.get(TRACK_NUMBER, b""), "big"), int.from_bytes(got.get(TRACK_TYPE, b""), "big"), got.get(CODEC, b"").decode("ascii", "replace")))
        elif ident == CLUSTER:
            _cluster(data, a, b, out)
        elif ident == CUES:
            for _, x, y in (c for c in children(data, a, b) if c[0] == CUE_POINT):
                time, track, at = 0, 0, 0
                for i, p, q in children(data, x, y):
                    if i == CUE_TIME:
                        time = _uint(data, p, q)
                    elif i == CUE_POSITIONS:
                        for j, r, s in children(data, p, q):
                            track, at = (_uint(data, r, s), at) if j == CUE_TRACK else (track, start + _uint(data, r, s)) if j == CUE_CLUSTER else (track, at)
                out.cues.append((time, track, at))


def _cluster(data: bytes, start: int, end: int, out: Media) -> None:
    time = 0
    for ident, a, b in children(data, start, end):
        if ident == CLUSTER_TIME:
            time = _uint(data, a, b)
        elif ident == SIMPLE_BLOCK:
            _block(data, a, b, time, None, out)
        elif ident == BLOCK_GROUP:
            inner = list(children(data, a, b))
            for i, x, y in inner:
                if i == BLOCK:
                    _block(data, x, y, time, all(j != 0xFB for j, _, _ in inner), out)
    out.clusters += 1


def _block(data: bytes, at: int, end: int, time: int, key: bool | None, out: Media) -> None:
    track, at = read_vint(data, at, end)
    ticks, flags = struct.unpack_from(">hB", data, at)
    sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError(f"bad lacing before {at}")
    for k, n in enumerate(sizes):
        out.packets.append((track, time + ticks + k * out.frame_ns.get(track, 0) // out.scale, bool(flags & 0x80) if key is None else key, at, n, out.clusters))
        at += n


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p[3] : p[3] + p[4]] for p in media.packets if p[0] == track)


PACKETS = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("track", T.LongType()), ("timestamp", T.LongType()), ("keyframe", T.BooleanType()), ("offset", T.LongType()), ("size", T.LongType()), ("cluster", T.LongType()))]))


TRACK_ROWS = T.ArrayType(T.StructType([T.StructField("track", T.LongType()), T.StructField("kind", T.LongType()), T.StructField("codec", T.StringType()), T.StructField("frame_ns", T.LongType())]))
CUE_ROWS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("timestamp", "track", "offset")]))


def write_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """df with each text stored as Matroska bytes."""
    return _mapped(df, text, [(out, T.BinaryType(), pa.binary())], lambda v: (mux(padded(v)[1]),))


def packet_table(df: DataFrame, media: str = "media") -> DataFrame:
    """df without the bytes, with n_packets, n_clusters, n_cues, error, and lists of packets, tracks and cues to explode where wanted."""
    packets = pa.list_(pa.struct([("track", pa.int64()), ("timestamp", pa.int64()), ("keyframe", pa.bool_()), ("offset", pa.int64()), ("size", pa.int64()), ("cluster", pa.int64())]))
    tracks = pa.list_(pa.struct([("track", pa.int64()), ("kind", pa.int64()), ("codec", pa.string()), ("frame_ns", pa.int64())]))
    cues = pa.list_(pa.struct([("timestamp", pa.int64()), ("track", pa.int64()), ("offset", pa.int64())]))
    names = ("track", "timestamp", "keyframe", "offset", "size", "cluster")

    def read(data: bytes | None) -> tuple:
        m = demux(data)
        entries = [{"track": t, "kind": k, "codec": c, "frame_ns": m.frame_ns.get(t, 0)} for t, k, c in m.tracks]
        return len(m.packets), m.clusters, len(m.cues), m.error, [dict(zip(names, p)) for p in m.packets], entries, [dict(zip(("timestamp", "track", "offset"), c)) for c in m.cues]

    cols = [("n_packets", T.LongType(), pa.int64()), ("n_clusters", T.LongType(), pa.int64()), ("n_cues", T.LongType(), pa.int64()), ("error", T.StringType(), pa.string()), ("packets", PACKETS, packets), ("tracks", TRACK_ROWS, tracks), ("cues", CUE_ROWS, cues)]
    return _mapped(df, media, cols, read, drop=True)


def media_digests(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the text, with the contract's columns: each text is stored, read back packet by packet and measured."""

    def measure(value: str | None) -> tuple:
        n, payload = padded(value)
        stored = mux(payload)
        media = demux(stored)
        back = payload_of(stored, media)
        whole = all(p[1] == q for p, q in zip(media.packets, range(0, len(back), FRAME)))
        feature = f"packets={len(media.packets)};clusters={media.clusters};cues={len(media.cues)};ticks={int(media.duration)};last={media.packets[-1][1]};in_order={int(whole)};mean={sum(back) / len(back):.3f}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    cols = [("n_bytes", T.LongType(), pa.int64()), ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string())]
    return _mapped(df, text, cols, measure, drop=True)


def _mapped(df: DataFrame, col: str, new: list[tuple], make, drop: bool = False) -> DataFrame:
    small_batches(df.sparkSession)
    names = [n for n, _, _ in new]
    keep = [f for f in df.schema.fields if f.name not in names and not (drop and f.name == col)]
    kept, at = [df.columns.index(f.name) for f in keep], df.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(v.as_py()) for v in batch.column(at)]
            made = [pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *made], names=[*(f.name for f in keep), *names])

    return df.mapInArrow(run, T.StructType([*keep, *(T.StructField(n, k) for n, k, _ in new)]))
