"""Splitting texts into pretokens: JVM regex for text, a byte scanner for what isn't valid UTF-8."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .bytemap import byte_classes
from .classes import Classes, classes

#: What stands for a unit of a class that isn't one ASCII byte.
_STANDS_FOR = {"L": 0xE9, "N": 0x30, "S": 0x09, "O": 0x21}
_BYTE_CLASS = byte_classes()


def pretokens(spark: SparkSession, text: Column) -> Column:
    """The pretokens of a text, an array of strings; empty for an empty text, null for null.

    Only texts with characters that the JVM's own classes don't know take the long pattern.
    """
    c = classes(spark)
    short = F.regexp_extract_all(text, F.lit(c.short), F.lit(0))
    if c.first_new is None:
        return short
    new = text.rlike(f"[\\x{{{c.first_new:X}}}-\\x{{10FFFF}}]")
    return F.when(new, F.regexp_extract_all(text, F.lit(c.full), F.lit(0))).otherwise(short)


def class_at(c: Classes, data: bytes, at: int) -> tuple[str, int]:
    """Class and width of the unit at a byte: a well or badly formed sequence that is structurally whole, or one byte."""
    b = data[at]
    if b < 0xC0 or b > 0xF4 or at + 1 == len(data):
        return _BYTE_CLASS[b], 1
    width = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
    tail = data[at + 1 : at + width]
    if len(tail) < width - 1 or any(x & 0xC0 != 0x80 for x in tail):
        return "O", 1
    point = b & (0x7F >> width)
    for x in tail:
        point = point << 6 | x & 0x3F
    return c.classify(min(point, 0x10FFFF)), width


_SPACE, _LETTER, _NUMBER, _OTHER, _BREAK = range(5)


def _kinds() -> np.ndarray:
    """The class of what stands for a unit."""
    out = np.full(256, _OTHER, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = _SPACE
    out[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xE9]] = _LETTER
    out[0x30:0x3A] = _NUMBER
    return out


class ByteScanner:
    """Pretokens of any bytes, by arrays over many documents at once; equal to the split pattern on valid UTF-8.

    Units: a lead byte is never a continuation, so whole sequences can't overlap, and a byte is a unit of its own unless
    a whole sequence takes it in. Pieces: a run of units of one class begins one; of white space before another run
    the last unit begins one too, and if it is a blank that run doesn't; an apostrophe that begins a piece takes
    the letters of a contraction with it.
    """

    def __init__(self, c: Classes) -> None:
        self.points = np.full(0x110000, _STANDS_FOR["O"], np.uint8)
        for name, ranges in (("N", c.numbers), ("L", c.letters), ("S", c.spaces)):
            for a, b in ranges:
                self.points[a : b + 1] = _STANDS_FOR[name]
        self.single = np.array([b if b < 0x80 else _STANDS_FOR[_BYTE_CLASS[b]] for b in range(256)], np.uint8)
        self.alone = self.single.copy()  # a lead byte that isn't the last and whose sequence isn't whole
        self.alone[0xC0:0xF5] = _STANDS_FOR["O"]
        self.kinds = _kinds()

    def _units(self, b: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands for each unit, and where units begin."""
        shown = self.alone[b]
        last = breaks[1:] - 1
        shown[last] = self.single[b[last]]
        lead = np.flatnonzero((b >= 0xC0) & (b < 0xF5))
        if not len(lead):
            return shown, np.arange(len(b))
        more = np.concatenate([b & 0xC0 == 0x80, np.zeros(3, bool)])
        width = 2 + (b[lead] >= 0xE0) + (b[lead] >= 0xF0)
        whole = more[lead + 1]
        for k in (2, 3):
            whole &= more[lead + k] | (width <= k)
        lead, width = lead[whole], width[whole]
        inner = np.zeros(len(b), bool)
        point = (b[lead] & (0x7F >> width)).astype(np.int64)
        for k in (1, 2, 3):
            has = width > k
            at = lead[has] + k
            point[has] = point[has] << 6 | b[at] & 0x3F
            inner[at] = True
        shown[lead] = self.points[np.minimum(point, 0x10FFFF)]
        starts = np.flatnonzero(~inner)
        return shown[starts], starts

    def starts(self, docs: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All documents with a zero byte before and after each; where pieces and those bytes begin; which of these are those bytes."""
        data = b"\0" + b"\0".join(docs) + b"\0"
        breaks = np.concatenate([[0], np.cumsum(np.array([len(d) + 1 for d in docs], np.int64))])
        shown, at = self._units(np.frombuffer(data, np.uint8), breaks)
        kind = self.kinds[shown]
        broken = np.searchsorted(at, breaks)
        kind[broken] = _BREAK
        begins = np.empty(len(kind), bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins[broken] = True
        runs = np.flatnonzero(begins[1:] & (kind[1:] != _SPACE) & (kind[1:] != _BREAK)) + 1
        after = runs[kind[runs - 1] == _SPACE]
        begins[after - 1] = True
        blank = shown[after - 1] == 0x20
        begins[after] = ~blank
        marks = runs[(shown[runs] == 0x27) & begins[runs]]
        marks = marks[kind[marks + 1] == _LETTER]  # so the apostrophe is a run by itself
        one = shown[marks + 1]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        two = one.astype(np.int64) << 8 | shown[np.minimum(marks + 2, len(shown) - 1)]
        long = ~short & np.isin(two, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
        taken = np.where(short, 1, 2)[short | long]
        marks = marks[short | long]
        begins[marks + 1] = False
        begins[marks + 1 + taken] = True
        firsts = np.flatnonzero(begins)
        return data, at[firsts], kind[firsts] == _BREAK

    def split(self, docs: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The pieces of all documents, and how many each has."""
        if not docs:
            return [], np.zeros(0, np.int64)
        data, at, breaks = self.starts(docs)
        ends = np.append(at[1:], len(data))[~breaks].tolist()
        pieces = [data[a:b] for a, b in zip(at[~breaks].tolist(), ends, strict=True)]
        return pieces, np.diff(np.flatnonzero(breaks)) - 1

    def distinct(self, docs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct pieces of all documents, the number in this list of every piece in order, and how many each document has."""
        if not docs:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        data, at, breaks = self.starts(docs)
        ends = np.append(at[1:], len(data))[~breaks]
        return *_distinct(data, at[~breaks], ends), np.diff(np.flatnonzero(breaks)) - 1


#: Bytes of a piece that fit in two numbers, and odd factors that mix them.
_PACKED = 15
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _distinct(data: bytes, at: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct stretches of data and the number of each one's: short ones are packed in two numbers, hashed and sorted; long ones go one by one."""
    size = ends - at
    number = np.empty(len(at), np.int64)
    out: list[bytes] = []
    packed = np.flatnonzero(size <= _PACKED)
    if len(packed):
        words = np.ndarray((len(data) + 1,), "<u8", data + bytes(16), strides=(1,))
        first, length = at[packed], size[packed]
        low = words[first] & _KEEP[np.minimum(length, 8)]
        high = np.zeros(len(packed), np.uint64)
        wide = np.flatnonzero(length > 8)
        high[wide] = words[first[wide] + 8] & _KEEP[length[wide] - 8]
        high |= length.astype(np.uint64) << np.uint64(56)
        key = (low * _MIX[0]) ^ ((high * _MIX[1]) >> np.uint64(7)) * _MIX[2] ^ high
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.empty(len(order), bool)
        new[0] = True
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
        group = np.cumsum(new) - 1
        leader = order[new]
        number[packed[order]] = group
        if (low[leader[group]] != low[order]).any() or (high[leader[group]] != high[order]).any():  # two pieces of one hash
            _, leader, again = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True, return_inverse=True)
            number[packed] = again.ravel()
        out = [data[a:b] for a, b in zip(first[leader].tolist(), ends[packed][leader].tolist(), strict=True)]
    seen: dict[bytes, int] = {}
    for k in np.flatnonzero(size > _PACKED).tolist():
        number[k] = len(out) + seen.setdefault(data[at[k] : ends[k]], len(seen))
    return out + list(seen), number


def scan_bytes(c: Classes, data: bytes) -> list[bytes]:
    """The pretokens of any bytes."""
    return scanner(c).split([data])[0]


@lru_cache(maxsize=2)
def scanner(c: Classes) -> ByteScanner:
    return ByteScanner(c)
