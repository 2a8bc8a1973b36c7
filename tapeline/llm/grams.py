"""Hashed byte trigrams of whole texts: class counts by grouped aggregation, and mean log-likelihoods per class."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import small_batches

#: Bits of a bucket number: a class's counts are at most 2^15 rows. Bytes that are hashed at once.
BITS, PART = 15, 1 << 20


def gram_buckets(text: str | None, fold: bool) -> np.ndarray:
    """Buckets of all byte trigrams; texts of one or two bytes are padded with zeros; none for an empty text.

    fold: A-Z as a-z, and no trigram with a digit or without a letter (a-z or any byte from 128 on), as for languages.
    """
    data = (text or "").encode("utf-8")
    if fold:
        data = data.lower()
    if not data:
        return np.empty(0, np.uint32)
    b = np.frombuffer(data.ljust(3, b"\0"), np.uint8).astype(np.uint32)
    out = (b[:-2] * np.uint32(0x1F123BB5) + b[1:-1] * np.uint32(0x5BD1E995) + b[2:] * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    if fold:
        digit, letter = b - np.uint32(48) < 10, (b >= 128) | (b - np.uint32(97) < 26)
        out = out[~(digit[:-2] | digit[1:-1] | digit[2:]) & (letter[:-2] | letter[1:-1] | letter[2:])]
    return out


def _count(batches: Iterator[pa.RecordBatch], classes: list[str], fold: bool) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(classes), 1 << BITS), np.int64)
    index = {c: i for i, c in enumerate(classes)}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if (i := index.get(label)) is not None:
                counts[i] += np.bincount(gram_buckets(text.as_py(), fold), minlength=1 << BITS)
    for i in range(len(classes)):
        (at,) = np.nonzero(counts[i])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[i][at])], names=["class", "bucket", "n"])


def class_log_probabilities(labelled: DataFrame, classes: list[str], fold: bool = True, smooth: float = 0.5) -> np.ndarray:
    """labelled (label, text) -> log p(bucket | class); at most classes x 2^15 counts come to the driver."""
    small_batches(labelled.sparkSession)
    counted = labelled.mapInArrow(partial(_count, classes=classes, fold=fold), "class int, bucket int, n long").groupBy("class", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(classes), 1 << BITS), smooth)
    counts[counted["class"].to_numpy(), counted["bucket"].to_numpy()] += counted["n"].to_numpy()
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _score(batches: Iterator[pa.RecordBatch], model, at: int, fold: bool) -> Iterator[pa.RecordBatch]:
    table = model.value
    for batch in batches:
        sizes, means = [], []
        for text in batch.column(at):
            buckets = gram_buckets(text.as_py(), fold)
            total = np.zeros(len(table))
            for i in range(0, len(buckets), PART):
                part = buckets[i : i + PART]
                total += [row.take(part).sum(dtype=np.float64) for row in table]
            sizes.append(len(buckets))
            means.append(total / max(1, len(buckets)))
        rest = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(sizes, pa.int64()), pa.array(means, pa.list_(pa.float64()))], names=[*(batch.schema.names[i] for i in rest), "n_grams", "mean_ll"])


def scored(df: DataFrame, text: str, table: np.ndarray, fold: bool = True) -> DataFrame:
    """df without the text, with n_grams and mean_ll, the mean log-likelihood under each class."""
    small_batches(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(table)  # classes x 2^15 floats
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)
    return df.mapInArrow(partial(_score, model=model, at=df.columns.index(text), fold=fold), f"{schema}, n_grams long, mean_ll array<double>")
