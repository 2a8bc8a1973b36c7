"""Byte-level BPE by monoid tree reduction.

A byte string is halved until a leaf is short, leaves are merged directly, and neighbours are joined by
re-encoding a window around their boundary. The window grows until the token pairs at its two rims are
*compatible*: a pair (x, y) is compatible if encoding the bytes of x and y together gives x, y back. A token
sequence whose neighbours are all compatible is the encoding of its bytes: the first merge across a token
border would be, in the run over the whole string, the lowest and leftmost one among the two tokens too, so
that pair's own run would make it. Hence tokens outside the window have provably stabilised.

Cases: a null or empty text has no tokens and decodes to no bytes. Texts of any length are encoded whole. Rows
may repeat. Lone surrogates cannot occur in a Spark string. Extra columns are kept by the general operators.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeline.llm.common import small_batches

#: Bytes of a leaf and of a half that is remembered, tokens of a decoding leaf, and pieces remembered by one worker.
LEAF, SHORT, DECODE_LEAF, REMEMBERED = 4, 12, 4096, 400_000

#: Above every rank; two white-space characters in a row, or one at either end; single spaces between other characters.
NEVER, BLANKS, CUT = 1 << 40, re.compile(r"\s\s|\A\s|\s\Z"), re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder for one vocabulary; made once per Python worker."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.bytes_of[v] = k
        self.find = regex.compile(pattern).findall
        self.known = lru_cache(200_000)(lambda data: tuple(self.merge(data)))
        self.halves = lru_cache(200_000)(self.reduce)
        self.compatible = lru_cache(400_000)(self._compatible)
        self.remembered = _Remembered(lambda piece: array("I", self.piece(piece.encode())).tobytes())
        self.spaced = _Remembered(lambda chunk: b"".join(map(self.remembered.__getitem__, self.find(" " + chunk))))

    def merge(self, data: bytes) -> list[int]:
        """Direct merging, lowest rank first and leftmost among equals."""
        n = len(data)
        if n > 64:
            return self._merge_long(data)
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(n)]
        order = [get(data[i : i + 2], NEVER) for i in range(n - 1)]
        while order and (least := min(order)) != NEVER:
            i = order.index(least)
            parts[i] += parts.pop(i + 1)
            del order[i]
            if i < len(order):
                order[i] = get(parts[i] + parts[i + 1], NEVER)
            if i:
                order[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        return [self.ranks[x] for x in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap over a linked list, for windows that have grown large."""
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is swallowed
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _compatible(self, x: int, y: int) -> bool:
        return self.merge(self.bytes_of[x] + self.bytes_of[y]) == [x, y]

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid's operation: the encoding of both byte strings together."""
        if not left or not right:
            return left + right
        if self.compatible(left[-1], right[0]):
            return left + right
        size = 1
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            window = self.known(b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b])))
            if (a == 0 or self.compatible(left[a - 1], window[0])) and (b == len(right) or self.compatible(window[-1], right[b])):
                return left[:a] + window + right[b:]
            size *= 2

    def reduce(self, data: bytes) -> tuple[int, ...]:
        """Halves meet again and again in other words, so what short ones reduce to is remembered."""
        if len(data) <= LEAF:
            return self.known(data)
        half = len(data) // 2
        again = self.halves if half <= SHORT else self.reduce
        return self.join(again(data[:half]), again(data[half:]))

    def piece(self, data: bytes) -> tuple[int, ...]:
        """One match of the pattern; a match that is itself in the vocabulary is that token."""
        found = self.ranks.get(data)
        return self.reduce(data) if found is None else (found,)

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids as little-endian unsigned 32-bit integers.

        The pattern always ends a match before a single space that has no white space beside it, so a text may be
        cut at such spaces, and what follows one is remembered with its ids.
        """
        if not text:
            return np.empty(0, "<u4")
        chunks = CUT.split(text) if BLANKS.search(text) else text.split(" ")
        first = b"".join(map(self.remembered.__getitem__, self.find(chunks[0])))
        return np.frombuffer(first + b"".join(map(self.spaced.__getitem__, chunks[1:])), "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        """Leaves of a few thousand tokens are looked up, then neighbours are concatenated up the tree."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        get = self.bytes_of.__getitem__
        level = [b"".join(map(get, ids[i : i + DECODE_LEAF])) for i in range(0, len(ids), DECODE_LEAF)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


class _Remembered(dict):
    """Ids as bytes by what was encoded; emptied when full, so a worker's memory is bounded."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(key) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = ids
        return ids


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", digests_only: bool = False) -> DataFrame:
    """docs with token_ids array<int> (unless digests_only), n_tokens, ids_sha256 and decoded_sha256.

    The ids are decoded again in the same pass. Columns of these names that docs already has are replaced.
    """
    small_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))  # one vocabulary file, under 1 MB
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if not digests_only:
        new.insert(0, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)))
    keep = [f for f in docs.schema.fields if f.name not in {x.name for x in new} and not (digests_only and f.name == text)]
    kept, at = [f.name for f in keep], docs.columns.index(text)
    arrow = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for batch in batches:
            made: dict[str, list] = {f.name: [] for f in new}
            for text_value in batch.column(at):
                ids = codec.encode(text_value.as_py())
                if not digests_only:
                    made["token_ids"].append(ids.astype(np.int32))
                made["n_tokens"].append(len(ids))
                made["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                made["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
            cols = [batch.column(batch.schema.names.index(k)) for k in kept]
            if not digests_only:
                cols.append(pa.array(made["token_ids"], pa.list_(pa.int32())))
            cols += [pa.array(made[k], arrow[k]) for k in arrow]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *made])

    return docs.mapInArrow(run, T.StructType(keep + new))


def decode_documents(tokens: DataFrame, rank_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """tokens with the bytes that each row's ids stand for; null ids give no bytes."""
    small_batches(tokens.sparkSession)
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    keep = [f for f in tokens.schema.fields if f.name != out]
    kept, at = [f.name for f in keep], tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, r"\S+")
        for batch in batches:
            made = pa.array([codec.decode(x.as_py() or []) for x in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(k)) for k in kept), made], names=[*kept, out])

    return tokens.mapInArrow(run, T.StructType([*keep, T.StructField(out, T.BinaryType())]))
