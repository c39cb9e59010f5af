"""Strict decoding of UTF-8 as a generator: a row for each code point, by arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ship import ship

REPLACEMENT = 0xFFFD
#: By width, the lowest point that needs it.
_LEAST = np.array([0, 0, 0x80, 0x800, 0x10000])
#: Bytes that go through arrays together.
_STEP = 1 << 20


def code_points(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, code points, widths and validity of all units of some bytes.

    A sequence that is overlong, a surrogate, beyond 10FFFF or cut off is invalid: its first byte is a unit of one byte
    with the replacement character, and reading goes on at the next byte.
    """
    b = np.frombuffer(data + b"\0\0\0", np.uint8)
    n = len(data)
    first = b[:n]
    width = np.select([first < 0x80, (first >= 0xC0) & (first < 0xE0), (first >= 0xE0) & (first < 0xF0), (first >= 0xF0) & (first < 0xF8)], [1, 2, 3, 4], 0)
    more = b & 0xC0 == 0x80
    point = np.where(width == 1, first, first & (0x7F >> np.maximum(width, 1))).astype(np.int64)
    good = width > 0
    for k in (1, 2, 3):
        has = width > k
        good &= ~has | more[k : n + k]
        point = np.where(has, point << 6 | b[k : n + k] & 0x3F, point)
    good &= (point >= _LEAST[width]) & (point <= 0x10FFFF) & ~((point >= 0xD800) & (point < 0xE000))
    # Continuations never begin a whole sequence, so whole sequences can't overlap.
    inner = np.zeros(n + 3, bool)
    for k in (1, 2, 3):
        inner[np.flatnonzero(good & (width > k)) + k] = True
    at = np.flatnonzero(~inner[:n])
    valid = good[at]
    return at, np.where(valid, point[at], REPLACEMENT), np.where(valid, width[at], 1), valid


def _stretches(data: bytes) -> Iterator[tuple[int, int]]:
    """Places of about ``_STEP`` bytes that cut no sequence."""
    begin = 0
    while begin < len(data):
        end = min(begin + _STEP, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80 and end - begin < _STEP + 4:
            end += 1  # not within a sequence
        yield begin, end
        begin = end


def decode_rows(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """``id_col``, ``place`` long (of the first byte), ``point`` int, ``width`` int, ``valid``: each unit of a binary column; none for null or empty."""
    ship(df.sparkSession)
    fields = [df.schema[id_col], T.StructField("place", T.LongType()), T.StructField("point", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("valid", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                data = value.as_py() or b""
                for begin, end in _stretches(data):
                    at, point, width, valid = code_points(data[begin:end])
                    ids = batch.column(0).take(pa.array(np.full(len(at), i)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(at + begin), pa.array(point.astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(valid)], names=[f.name for f in fields])

    return df.select(F.col(id_col), F.col(content)).mapInArrow(run, T.StructType(fields))


def count_points(df: DataFrame, content: str) -> DataFrame:
    """``point`` int, ``width`` int, ``n``, ``invalid``: the units of a binary column, counted in each task before the shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, invalid, separators = np.zeros(0x110000, np.int64), 0, 0

        def count(data: bytes) -> None:
            nonlocal invalid
            _, point, _, valid = code_points(data)
            found = np.bincount(point[valid])
            total[: len(found)] += found
            invalid += int((~valid).sum())

        for batch in batches:
            held: list[bytes] = []
            size = 0
            for value in batch.column(0):
                data = value.as_py() or b""
                for begin, end in _stretches(data):
                    held.append(data[begin:end])
                    size += end - begin
                    if size >= _STEP:  # a zero byte between ends a sequence as the end of the data does
                        count(b"\0".join(held))
                        separators += len(held) - 1
                        held, size = [], 0
            if held:
                count(b"\0".join(held))
                separators += len(held) - 1
        total[0] -= separators
        points = np.flatnonzero(total)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        rows = [*zip(points.tolist(), width.tolist(), total[points].tolist(), [0] * len(points), strict=True), *([(REPLACEMENT, 1, invalid, invalid)] if invalid else [])]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["point", "width", "n", "invalid"])

    counted = df.select(F.col(content)).mapInArrow(run, "point int, width int, n long, invalid long")
    return counted.groupBy("point", "width").agg(F.sum("n").alias("n"), F.sum("invalid").alias("invalid"))
