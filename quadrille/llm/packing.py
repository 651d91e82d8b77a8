"""Packing documents into sequences by the sum-of-squares rule.

A bin is a sequence, its gap the room left. A piece goes where the sum over gaps of (open bins with that gap) squared
becomes smallest. The plain rule weighs a new bin against the open ones too (`weigh_new`); by default one is opened only
if no open one has room, which with the longest pieces first leaves fewer bins half empty. Pieces are dealt by a hash into shards of about
`shard` pieces; each is packed on its own, so no task holds more than a shard whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, small_batches

LENGTH = 2048
SHARD = 1 << 15

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = total % length or length
    at = [0, *range(first, total, length)] if total else []
    return [(a, (b - a)) for a, b in zip(at, [*at[1:], total], strict=True)]


def _tokenize(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(bpe.ids(text.as_py() or "", path), np.uint32(0)).astype("<u4")
                out += [(doc, i, a, n, zlib.crc32(ids[a : a + n].tobytes())) for i, (a, n) in enumerate(cut(len(ids), length))]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def place(lengths: np.ndarray, length: int, weigh_new: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each piece, in the order given. Of equal changes the smallest gap is taken, a new bin last."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(length + 1, np.int64)  # open bins by gap; of gap 0 none counts
    open_: list[list[int]] = [[] for _ in range(length + 1)]
    fresh, never = 0, np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        # The change of the sum of squares if the piece goes into a bin of gap s, s + 1, ...
        have = count[s:length]
        change = np.where(have > 0, 2 * (count[: length - s] - have) + 2, never)
        if s < length and have[0]:
            change[0] = 1 - 2 * have[0]
        best = int(change.argmin()) if s < length else 0
        if weigh_new and s < length and change[best] > 2 * count[length - s] + 1:
            change[best] = never
        if s < length and change[best] < never:
            gap = s + best
            b = open_[gap].pop()
            count[gap] -= 1
        else:
            gap, b, fresh = length, fresh, fresh + 1
        bins[i], offsets[i] = b, length - gap
        if gap > s:
            count[gap - s] += 1
            open_[gap - s].append(b)
    return bins, offsets


def _pack(length: int, weigh_new: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = place(pdf["length"].to_numpy(), length, weigh_new)
        return pdf.assign(sequence_id=(pdf["shard"].to_numpy().astype(np.int64) << 32) + bins, offset=offsets).drop(columns="shard")

    return run


def pack(df: DataFrame, length: int = LENGTH, shard: int = SHARD, path: str | None = None, weigh_new: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    weigh_new: the plain rule, which opens a sequence whenever that leaves the smaller sum of squares.

    A document is its text's ids, then id 0; only a longer one than `length` is cut, and its first piece may be shorter.

    * null or empty text: the one id 0. Null doc_id: a document like others; its pieces carry the null.
    * rows that repeat a doc_id: documents of their own, each packed. Empty table: empty. Other columns are ignored.
    * equal lengths: by doc_id, then piece. Reruns agree.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    pieces = materialize(rows.mapInArrow(_tokenize(path or bpe.default_path(), length), _PIECES), "pieces")
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInPandas(_pack(length, weigh_new), schema)
