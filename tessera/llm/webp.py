"""Media columns: lossless WebP.

``decode`` reads a lossless WebP file whole: simple and meta prefix codes, LZ77 back-references with the
distance map, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms
(with pixel packing), and gives an array of height x width x 4 bytes (R, G, B, A). ``encode`` writes such
files from pixel arrays: flat eight-bit codes or prefix codes of measured lengths with back-references,
colour cache and any of the transforms. Both follow the public specification of the format. Pixels
with flat codes and images of one channel are read as arrays; everything else symbol by symbol.

``store`` puts texts into pixels: the payload's bytes are the grey samples of an image, row by row. Images of
up to 16 different samples are written with a palette (and packed pixels), others by ``encode_greys``, with green
subtracted, so that a pixel is one symbol, and references among bytes. Such images are written and read many at a time, in
arrays over all of them, as texts are mostly short; each is its own file, with its own codes and references.

Defined results: a null text is an empty one, with a payload of 64 zeros; equal texts get equal files;
repeated rows give repeated rows; an id of any type passes through; other columns are dropped. A payload
of over 256 MiB, which exceeds the format's sides, takes several files, one behind the other.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_arrow, reader, text_chunks

UNIT = 64
MOST_SIDE = 1 << 14
#: Bytes of a payload in one image.
MOST_PAYLOAD = MOST_SIDE**2
#: Bytes of a back-reference in a grey image, at least, and up to which lengths are found for all places at once.
LEAST_COPY, SURE_COPY = 6, 32
# Fixed values of the format: the order in which code length code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: least and extra bits of the repeats of code lengths.
REPEATS = {16: (3, 2), 17: (3, 3), 18: (11, 7)}
# Fixed values of the format: the (x, y) offsets that the distance codes 1 to 120 stand for.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICT, CROSS, GREEN, PALETTE = 0, 1, 2, 3
FLAT = [8] * 256
# Codes of one symbol each: red 0, blue 0, alpha 255.
GREY_CODES = 0b1_0001_0001 | 0b10 << 9 | 255 << 11
HASH = 0x1E35A7BD
#: Bytes of a file that are read at a time, and symbols that are written at a time.
PIECE = 1 << 16
#: Bytes of a one-channel image that are looked up at a time.
ONE_PIECE = 1 << 14
#: Bytes of grey images that are written together, and of files that are read together.
TOGETHER, READ_TOGETHER = 1 << 17, 1 << 15
#: Bits of a one-channel image that are followed beside others, and how often their begins are mended before it is followed whole.
STRETCH, MENDED = 128, 6
FARTHEST = (1 << 20) - 120
MOST_COPY = 4096
_REVERSED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)

#: Bits of a literal or reference, at most.
MOST_ITEM = 58
_EIGHT = np.arange(8)
_TURNED_BYTES = _REVERSED.tolist()
# Of the prefix symbols of lengths and distances: the number of extra bits, their mask, and the least value.
_EXTRA = np.array([max(0, (s - 2) >> 1) for s in range(40)])
_MORE = (1 << _EXTRA) - 1
_LEAST = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(40)])


class Bits:
    """Reads bits, least significant first; past the end are zeros."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[first:last], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def bytes_from_here(self, n: int) -> np.ndarray:
        """The next n groups of eight bits, as an array."""
        first, shift = self.at >> 3, self.at & 7
        raw = np.frombuffer(self.data, np.uint8, min(n + 1, len(self.data) - first), first).astype(np.uint16)
        raw = np.concatenate([raw, np.zeros(n + 1 - len(raw), np.uint16)]) if len(raw) < n + 1 else raw
        self.at += 8 * n
        return ((raw[:-1] >> shift) | (raw[1:] << (8 - shift))).astype(np.uint8)


class BitWriter:
    def __init__(self) -> None:
        self.value, self.n, self.out = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        while self.n >= 8:
            self.out.append(self.value & 255)
            self.value >>= 8
            self.n -= 8

    def put_long(self, value: int, n: int) -> None:
        whole = value << self.n | self.value
        n += self.n
        self.out += (whole & (1 << (n & ~7)) - 1).to_bytes(n >> 3, "little")
        self.value, self.n = whole >> (n & ~7), n & 7

    def put_bytes(self, data: np.ndarray) -> None:
        """Eight bits each."""
        if not len(data):
            return
        wide = np.zeros(len(data) + 1, np.uint16)
        wide[:-1] = data.astype(np.uint16) << self.n
        low = wide & 255
        low[1:] |= wide[:-1] >> 8
        low[0] |= self.value
        self.out += low[:-1].astype(np.uint8).tobytes()
        self.value = int(low[-1])

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.value & 255]) if self.n else b"")


@functools.cache
def _turned(n: int) -> np.ndarray:
    """The numbers of n bits with their bits in the other order."""
    out = np.zeros(1, np.int64)
    for k in range(n):
        out = np.concatenate([out, out | 1 << (n - 1 - k)])
    return out


class Code:
    """A canonical prefix code for reading: ``entries`` (and ``table``, a list) has, for the next ``bits`` bits, symbol << 4 | length."""

    def __init__(self, lengths: list[int]) -> None:
        n = np.asarray(lengths)
        used = np.flatnonzero(n)
        self.flat = lengths[:256] == FLAT and not any(lengths[256:])
        if len(used) < 2:
            self.bits, self.entries = 0, np.array([int(used[0]) << 4 if len(used) else 0], np.int32)
            return
        if (1 << (15 - n[used])).sum() != 1 << 15:
            raise ValueError("a prefix code that isn't complete")
        used = used[np.argsort(n[used], kind="stable")]
        self.bits = int(n.max())
        self.entries = np.repeat((used << 4 | n[used]).astype(np.int32), 1 << (self.bits - n[used]))[_turned(self.bits)]

    @functools.cached_property
    def table(self) -> list[int]:
        return self.entries.tolist()

    def read(self, bits: Bits) -> int:
        found = self.table[bits.take(self.bits)]
        bits.at -= self.bits - (found & 15)
        return found >> 4


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What to put for each symbol: the canonical code's bits, first one lowest, and their number."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    room = 1 << (15 - lengths[used])
    turned = np.zeros(len(lengths), np.int64)
    turned[used] = _turned(15)[np.cumsum(room) - room]
    return turned, lengths


@functools.lru_cache(maxsize=256)
def _code(lengths: tuple[int, ...]) -> Code:
    return Code(list(lengths))


def _small_table(lengths: list[int]) -> tuple[list[int], int]:
    """``table`` and ``bits`` of a code of few symbols with lengths up to 7."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2:
        return [used[0] << 4 if used else 0], 0
    bits = max(lengths)
    table, code = [0] * (1 << bits), 0  # the code as a number of seven bits
    for n, s in sorted((lengths[s], s) for s in used):
        table[_TURNED_BYTES[(code << 1) & 255] :: 1 << n] = [s << 4 | n] * (1 << (bits - n))
        code += 1 << (7 - n)
        if code > 128:
            break
    if code != 128:
        raise ValueError("a prefix code that isn't complete")
    return table, bits


def _read_code(bits: Bits, alphabet: int) -> Code:
    lengths, short = _read_lengths(bits, alphabet)
    return _code(tuple(lengths)) if short else Code(lengths)


def _read_lengths(bits: Bits, alphabet: int) -> tuple[list[int], bool]:
    """A code's lengths, and whether they came in the short form."""
    lengths = [0] * alphabet
    if bits.take(1):  # one or two symbols
        two, wide = bits.take(1), bits.take(1)
        lengths[bits.take(8 if wide else 1)] = 1
        if two:
            lengths[bits.take(8)] = 1
        return lengths, True
    own = [0] * 19
    many = 4 + bits.take(4)
    packed = bits.take(3 * many)
    for k in LENGTH_ORDER[:many]:
        own[k] = packed & 7
        packed >>= 3
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    table, wide = _small_table(own)
    mask, at, last = (1 << wide) - 1, 0, 8
    p, most, w = bits.at, -1, 0
    while at < alphabet and left:
        if p > most:  # the next bits, as one number
            w, most = int.from_bytes(bits.data[p >> 3 : (p >> 3) + 160], "little") >> (p & 7), p + 1200
        left -= 1
        e = table[w & mask]
        n = e >> 4
        w >>= e & 15
        p += e & 15
        if n < 16:
            lengths[at] = n
            last = n or last
            at += 1
            continue
        least, wide = REPEATS[n]
        repeat = least + (w & ((1 << wide) - 1))
        w >>= wide
        p += wide
        if at + repeat > alphabet:
            raise ValueError("code lengths that run over the alphabet")
        if n == 16:
            lengths[at : at + repeat] = [last] * repeat
        at += repeat
    bits.at = p
    return lengths, False


def _many_entries(lengths: np.ndarray) -> list[np.ndarray]:
    """``Code.entries`` for each row of lengths."""
    row, symbol = np.nonzero(lengths)
    n, used = lengths[row, symbol], np.bincount(row, minlength=len(lengths))
    room = np.bincount(row, 1 << (15 - n), len(lengths))
    if ((used > 1) & (room != 1 << 15)).any():
        raise ValueError("a prefix code that isn't complete")
    key = np.sort(row << 16 | n << 9 | symbol)
    symbol, n = key & 511, np.where(used[row] > 1, key >> 9 & 127, 0)
    wide = np.where(used > 1, lengths.max(1), 0)
    entries = np.repeat((symbol << 4 | n).astype(np.int32), 1 << (wide[row] - n))
    ends = np.cumsum(np.where(used > 0, 1 << wide, 0)).tolist()
    return [entries[a:b][_turned(w)] if b > a else np.zeros(1, np.int32) for a, b, w in zip([0, *ends], ends, wide.tolist(), strict=False)]


def _prefixed(symbol: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.take(extra) + 1


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels, as ARGB numbers."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache that is too large")
    meta, scale = None, 0
    if main and bits.take(1):
        scale = bits.take(3) + 2
        small = _read_image(bits, -(-width >> scale), -(-height >> scale), False)
        meta = ((small >> 8) & 0xFFFF).reshape(-(-height >> scale), -1)
    groups = []
    for _ in range(int(meta.max()) + 1 if meta is not None else 1):
        groups.append([_read_code(bits, n) for n in (256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)])
    out = np.zeros(width * height, np.uint32)
    if meta is None and not cache_bits and all(c.flat for c in groups[0][:4]):
        grba = _REVERSED[bits.bytes_from_here(4 * len(out))].reshape(-1, 4).astype(np.uint32)
        return grba[:, 3] << 24 | grba[:, 1] << 16 | grba[:, 0] << 8 | grba[:, 2]
    if meta is None and not cache_bits and groups[0][0].bits and not any(c.bits for c in groups[0][1:4]):
        return _read_one_channel(bits, width, len(out), groups[0])
    return np.array(_read_symbols(bits, width, len(out), groups, meta, scale, cache_bits), np.uint32)


@functools.lru_cache(maxsize=64)
def _distances(width: int) -> np.ndarray:
    """What the distance codes 0 (none) to 120 stand for."""
    return np.array([0, *(max(1, x + y * width) for x, y in NEAR)])


def _read_one_channel(bits: Bits, width: int, total: int, group: list[Code]) -> np.ndarray:
    """Pixels that differ in green alone, whose other codes take no bits, as of a grey image without its green."""
    red, blue, alpha = (c.table[0] >> 4 for c in group[1:4])
    return _read_channels([(bits, width, total, group[0].entries, group[4].entries)])[0].astype(np.uint32) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)


def _read_channels(images: list[tuple[Bits, int, int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The greens of many such images: where an image's data goes on, its width, its pixels, and the entries of its codes of greens and of distances.

    The images' codes are looked up at every bit of a piece of each one's data at once, and where that gives a reference, so is
    the rest of it. Then ``_followed`` tells which of these items are the image's. Literals are put in their places together,
    references in their order.
    """
    pixels = [np.zeros(image[2], np.uint8) for image in images]
    copies: list[list[tuple[int, int, int]]] = [[] for _ in images]  # place, length and distance of references
    done = [0] * len(images)
    while left := [k for k, image in enumerate(images) if done[k] < image[2]]:
        now = [images[k] for k in left]
        raws = []
        for bits, *_ in now:
            raw = bits.data[bits.at >> 3 : (bits.at >> 3) + ONE_PIECE + 16]
            raws.append(raw.ljust((min(ONE_PIECE, len(raw)) or ONE_PIECE) + 16, b"\0"))  # zeros past the end
        sizes = np.array([len(r) for r in raws])
        begin = np.cumsum(sizes) - sizes
        raw = b"".join(raws)
        n, which = len(raw), np.repeat(np.arange(len(now)), sizes)
        found = np.empty((n, 8), np.int32)
        words = np.ndarray((n,), "<u4", raw + bytes(8), 0, (1,)).astype(np.int64)[:, None]
        for (*_, entries, _), a, many in zip(now, begin.tolist(), sizes.tolist(), strict=True):
            index = words[a : a + many] >> _EIGHT
            index &= len(entries) - 1
            np.take(entries, index, out=found[a : a + many], mode="clip")
        found = found.reshape(-1)
        one = (found & 15).astype(np.uint8)  # bits of the item that begins at each bit
        refs = np.flatnonzero(found >= 4096)
        if len(refs):
            far_many = np.array([len(far) for *_, far in now])
            far, far_base = np.concatenate([far for *_, far in now]), np.cumsum(far_many) - far_many
            words, e, of = np.ndarray((n,), "<u8", raw + bytes(8), 0, (1,)), found[refs], which[refs >> 3]
            symbol, q = (e >> 4) - 256, e & 15
            w = words[refs >> 3] >> (refs & 7).astype(np.uint64)  # 57 bits at least
            length = _LEAST[symbol] + ((w >> q.astype(np.uint64)).astype(np.int64) & _MORE[symbol])
            q = q + _EXTRA[symbol]
            e = far[far_base[of] + ((w >> q.astype(np.uint64)).astype(np.int64) & (far_many - 1)[of])]
            symbol, q = e >> 4, q + (e & 15)
            at = refs + q
            at = np.minimum(at, 8 * n - 1)
            code = _LEAST[symbol] + ((words[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64) & _MORE[symbol])
            one[refs] = q + _EXTRA[symbol]
        end = 8 * (begin + sizes - 16)
        items, after = _followed(one, np.array([bits.at & 7 for bits, *_ in now]) + 8 * begin, end)
        of, kind = which[items >> 3], found[items]
        copy = np.flatnonzero(kind >= 4096)
        size = np.ones(len(items), np.int64)
        if len(copy):
            at = np.searchsorted(refs, items[copy])
            length, code = length[at], code[at]
            size[copy] = length
        edges = np.searchsorted(items, 8 * begin)
        stop = np.cumsum(size)
        stop += np.array([done[k] for k in left])[of] - (stop - size)[edges][of]
        total = np.array([image[2] for image in now])[of]
        inside = stop - size < total  # what comes behind the image can look like items too
        if (inside & (stop > total)).any():
            raise ValueError("a reference out of the image")
        literal = inside & (kind < 4096)
        samples, places = (kind[literal] >> 4).astype(np.uint8), (stop - size)[literal]
        cuts = np.searchsorted(of[literal], np.arange(len(now) + 1)).tolist()
        for k, a, b in zip(left, cuts, cuts[1:], strict=False):
            pixels[k][places[a:b]] = samples[a:b]
        kept = inside[copy]
        if kept.any():
            copy, code, length = copy[kept], code[kept], length[kept]
            near = np.array([_distances(width) for _, width, *_ in now])
            distance, place = np.where(code > 120, code - 120, near[of[copy], np.minimum(code, 120)]), (stop - size)[copy]
            if (distance > place).any():
                raise ValueError("a reference out of the image")
            cuts = np.searchsorted(of[copy], np.arange(len(now) + 1)).tolist()
            found_copies = list(zip(place.tolist(), length.tolist(), distance.tolist(), strict=True))
            for k, a, b in zip(left, cuts, cuts[1:], strict=False):
                copies[k] += found_copies[a:b]
        last = np.searchsorted(of[inside], np.arange(1, len(now) + 1)) - 1
        last = np.flatnonzero(inside)[last]
        ended = stop[last] == total[last]
        next_ = np.where(ended, items[last] + one[items[last]], after) - 8 * begin
        for k, at, p in zip(left, stop[last].tolist(), next_.tolist(), strict=True):
            done[k] = at
            images[k][0].at = (images[k][0].at & ~7) + p
    for k, references in enumerate(copies):
        if not references:
            continue
        out = bytearray(pixels[k])
        for at, length, distance in references:
            if distance >= length:
                out[at : at + length] = out[at - distance : at - distance + length]
            else:
                out[at : at + length] = (out[at - distance : at] * (length // distance + 1))[:length]
        pixels[k] = np.frombuffer(out, np.uint8)
    return pixels


def _followed(one: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items from each ``begin`` up to ``end``, one behind the other by their bits in ``one``, and where what comes after these begins.

    Stretches are followed side by side. What begins amid an item soon meets the items that are right, so where a stretch
    ends is mostly right before it is known where it begins. Its begin is mended by the end of the one before until none changes;
    should that last, all is followed one by one.
    """
    each = np.maximum(1, -(-(end - begin) // STRETCH))
    first = np.cumsum(each) - each
    of = np.repeat(np.arange(len(begin)), each)
    at = begin[of] + STRETCH * (np.arange(len(of)) - first[of])
    stop = np.append(at[1:], 0)
    stop[first + each - 1] = end
    inner = np.ones(len(of), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    for _ in range(MENDED):
        seen, q = np.zeros(len(one), bool), at.copy()
        while True:
            seen[q] = True
            step = one[q]
            step *= q < stop
            if not step.any():
                break
            q += step
        found = q[inner - 1]
        if (found == at[inner]).all():
            seen[q[first + each - 1]] = False
            return np.flatnonzero(seen), q[first + each - 1]
        at[inner] = found
    steps, items, after = one.tobytes(), [], []
    put = items.append
    for q, e in zip(begin.tolist(), end.tolist(), strict=True):
        while q < e:
            put(q)
            q += steps[q]
        after.append(q)
    return np.array(items, np.int64), np.array(after)


def _read_symbols(bits: Bits, width: int, total: int, groups: list[list[Code]], meta: np.ndarray | None, scale: int, cache_bits: int) -> list[int]:
    """Pixels symbol by symbol, from 64-bit windows that begin at each byte of a piece of the data."""
    out, at, put, shift = [0] * total, 0, 0, 32 - cache_bits
    cache = [0] * (1 << cache_bits)
    windows, base, limit, p = [], 0, -1, bits.at
    now = None
    while at < total:
        if meta is not None or now is None:
            group = groups[0 if meta is None else meta[at // width >> scale, at % width >> scale]]
            if group is not now:
                now = group
                (gs, rs, bs, as_), (gm, rm, bm, am) = [c.table for c in group[:4]], [(1 << c.bits) - 1 for c in group[:4]]
                wide = sum(c.bits for c in group[:4]) > 57
        q = p - base
        if q >= limit:
            base = p & ~7
            first = base >> 3
            piece = np.zeros(max(64, min(PIECE, len(bits.data) - first)) + 7, np.uint8)
            known = bits.data[first : first + len(piece)]
            piece[: len(known)] = np.frombuffer(known, np.uint8)
            windows = np.lib.stride_tricks.sliding_window_view(piece, 8).copy().view("<u8").reshape(-1).tolist()
            limit, q = 8 * (len(windows) - 16), p - base
        w = windows[q >> 3] >> (q & 7)
        e = gs[w & gm]
        s, n = e >> 4, e & 15
        if s < 256:
            w >>= n
            red = rs[w & rm]
            w >>= red & 15
            blue = bs[w & bm]
            n += (red & 15) + (blue & 15)
            if wide:
                w = windows[(q + n) >> 3] >> ((q + n) & 7)
            else:
                w >>= blue & 15
            alpha = as_[w & am]
            out[at] = alpha >> 4 << 24 | red >> 4 << 16 | s << 8 | blue >> 4
            at += 1
            p += n + (alpha & 15)
        elif s < 280:
            bits.at = p + n
            length = _prefixed(s - 256, bits)
            code = _prefixed(now[4].read(bits), bits)
            p = bits.at
            distance = code - 120
            if code <= 120:
                x, y = NEAR[code - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > total:
                raise ValueError("a reference out of the image")
            from_ = out[at - distance : at - distance + min(length, distance)]
            out[at : at + length] = (from_ * -(-length // len(from_)))[:length]
            at += length
        else:
            for value in out[put:at]:
                cache[(HASH * value & 0xFFFFFFFF) >> shift] = value
            put = at
            out[at] = cache[s - 280]
            at += 1
            p += n
    bits.at = p
    return out


def _channels(pixels: np.ndarray) -> np.ndarray:
    """ARGB numbers to an array of (A, R, G, B)."""
    return np.stack([(pixels >> s) & 255 for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _packed(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    if mode in (0, 14, 15):
        return np.array([255, 0, 0, 0], np.int32)
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return ((left + top_right >> 1) + top) >> 1
    if mode <= 9:
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return a + b >> 1
    if mode == 10:
        return ((left + top_left >> 1) + (top + top_right >> 1)) >> 1
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = left + top >> 1
    half = mean - top_left
    return np.clip(mean + (np.abs(half) // 2 * np.sign(half)), 0, 255)


def _predictor(pixels: np.ndarray, width: int, modes: np.ndarray, scale: int, inverse: bool) -> np.ndarray:
    """Adds (inverse) or takes away what the neighbours that are known predict."""
    given = _channels(pixels).reshape(-1, width, 4)
    out = given.copy()
    seen = out if inverse else given
    for y in range(len(given)):
        for x in range(width):
            if not y:
                guess = seen[0, x - 1] if x else np.array([255, 0, 0, 0], np.int32)
            elif not x:
                guess = seen[y - 1, 0]
            else:
                right = seen[y - 1, x + 1] if x + 1 < width else seen[y, 0]
                guess = _predicted(int(modes[y >> scale, x >> scale]), seen[y, x - 1], seen[y - 1, x], seen[y - 1, x - 1], right)
            out[y, x] = (given[y, x] + (guess if inverse else -guess)) & 255
    return _packed(out).reshape(-1)


def _cross(pixels: np.ndarray, width: int, codes: np.ndarray, scale: int, inverse: bool) -> np.ndarray:
    """Cross-colour: red and blue by green, blue by red, with a block's multipliers."""
    c = _channels(pixels).reshape(-1, width, 4)
    ys, xs = np.arange(len(c)) >> scale, np.arange(width) >> scale
    m = _channels(codes)[ys][:, xs].astype(np.int8).astype(np.int32)  # (-, red to blue, green to blue, green to red)
    signed = lambda v: v.astype(np.int8).astype(np.int32)
    delta = lambda k, v: signed(k) * signed(v) >> 5
    sign = 1 if inverse else -1
    red = (c[..., 1] + sign * delta(m[..., 3], c[..., 2])) & 255
    blue = c[..., 3] + sign * (delta(m[..., 2], c[..., 2]) + delta(m[..., 1], red if inverse else c[..., 1]))
    return _packed(np.stack([c[..., 0], red, c[..., 2], blue & 255], -1)).reshape(-1)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    pixels = pixels.astype(np.uint32)
    green = (pixels >> np.uint32(8) & np.uint32(255)) * np.uint32(0x00010001)
    ends = pixels & np.uint32(0x00FF00FF)  # a bit above each keeps borrows apart
    ends = ends + green if sign > 0 else (ends | np.uint32(0x01000100)) - green
    return pixels & np.uint32(0xFF00FF00) | ends & np.uint32(0x00FF00FF)


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _signature(data: bytes) -> tuple[Bits, int, int, int]:
    """Where a file's image goes on behind its sides; its width and height, and whether alpha counts."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image in the file")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
    bits = Bits(data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]])
    if bits.take(8) != 0x2F:
        raise ValueError("not a lossless bitstream")
    width, height, alpha = bits.take(14) + 1, bits.take(14) + 1, bits.take(1)
    if bits.take(3):
        raise ValueError("an unknown version")
    return bits, width, height, alpha


def _grey(data: bytes) -> tuple[Bits, int, int, list[int], list[int]] | None:
    """Of a file as ``encode_grey`` writes it: where its pixels begin, its sides, the lengths of the codes of greens and distances. None for any other."""
    bits, width, height, _ = _signature(data)
    if bits.take(6) != 1 | GREEN << 1:  # no further transform, colour cache or meta codes
        return None
    green, _ = _read_lengths(bits, 280)
    if bits.take(19) != GREY_CODES or green.count(0) > 278:
        return None
    return bits, width, height, green, _read_lengths(bits, 40)[0]


def decode_pixels(data: bytes) -> tuple[np.ndarray, int, int]:
    """ARGB numbers, width and height of a lossless WebP file."""
    bits, width, height, alpha = _signature(data)
    steps: list[tuple[int, int, np.ndarray | None, int]] = []
    now = width
    while bits.take(1):
        kind = bits.take(2)
        if kind in [s[0] for s in steps]:
            raise ValueError("a transform that comes twice")
        if kind in (PREDICT, CROSS):
            scale = bits.take(3) + 2
            table = _read_image(bits, -(-now >> scale), -(-height >> scale), False).reshape(-1, -(-now >> scale))
            steps.append((kind, scale, table, now))
        elif kind == GREEN:
            steps.append((kind, 0, None, now))
        else:
            colours = bits.take(8) + 1
            table = _channels(_read_image(bits, colours, 1, False)).cumsum(0) & 255
            scale = _pack_bits(colours)
            steps.append((kind, scale, _packed(table), now))
            now = -(-now >> scale)
    out = _read_image(bits, now, height, True)
    for kind, scale, table, w in reversed(steps):
        if kind == PREDICT:
            out = _predictor(out, w, (table >> 8) & 15, scale, True)
        elif kind == CROSS:
            out = _cross(out, w, table, scale, True)
        elif kind == GREEN:
            out = _green(out, 1)
        else:
            index = ((out >> 8) & 255).reshape(height, -1)
            if scale:
                each = 8 >> scale
                parts = [(index >> (each * k)) & ((1 << each) - 1) for k in range(1 << scale)]
                index = np.stack(parts, -1).reshape(height, -1)[:, :w]
            out = np.concatenate([table, np.zeros(256, np.uint32)])[index.reshape(-1)]
    return (out if alpha else out | np.uint32(0xFF000000)), width, height


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: height x width x (R, G, B, A)."""
    pixels, width, height = decode_pixels(data)
    return pixels.astype("<u4").view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]


def _lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for the counts, none over ``most`` (rare symbols count as more until that holds)."""
    out, used = np.zeros(len(counts), np.int64), np.flatnonzero(counts)
    m, least = len(used), 1
    while m > 1:
        weight = np.maximum(counts[used], least)
        order = np.argsort(weight, kind="stable")
        depth = _depths(weight[order].tolist())
        if max(depth) <= most:
            out[used[order]] = depth
            return out
        least *= 2
    out[used] = 1
    return out


def _depths(weight: list[int]) -> list[int]:
    """Of the leaves of a tree of least weight; weights ascend."""
    m = len(weight)
    above = [0] * (2 * m - 1)
    weight, inner = [*weight, 1 << 62], [1 << 62] * m
    i = j = 0  # the next leaf and the next node that have no parent
    for k in range(m - 1):
        if weight[i] <= inner[j]:
            one = weight[i]
            above[i] = k
            i += 1
        else:
            one = inner[j]
            above[m + j] = k
            j += 1
        if weight[i] <= inner[j]:
            one += weight[i]
            above[i] = k
            i += 1
        else:
            one += inner[j]
            above[m + j] = k
            j += 1
        inner[k] = one
    depth = [0] * m  # of the nodes, then of the leaves
    for k in range(m - 3, -1, -1):
        depth[k] = depth[above[m + k]] + 1
    return [depth[k] + 1 for k in above[:m]]


def _many_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """``_lengths`` for each row."""
    out = np.zeros(counts.shape, np.int64)
    row, symbol = np.nonzero(counts)
    key = np.sort(row << 44 | counts[row, symbol] << 9 | symbol)  # counts stay below 2 ** 29, symbols below 2 ** 9
    weights, edges = ((key >> 9) & ((1 << 35) - 1)).tolist(), np.searchsorted(row, np.arange(len(counts) + 1)).tolist()
    depths, deep = [], []
    for r, (a, b) in enumerate(itertools.pairwise(edges)):
        depth = _depths(weights[a:b]) if b - a > 1 else [1] * (b - a)
        if b - a > most and max(depth) > most:
            deep.append(r)
        depths += depth
    out[row, key & 511] = depths
    for r in deep:
        out[r] = _lengths(counts[r], most)
    return out


def _many_canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes' bits, first one lowest, of each row, which has two symbols at least."""
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol]
    key = np.sort(row << 16 | n << 9 | symbol)
    room = 1 << (15 - ((key >> 9) & 127))
    out = np.zeros(lengths.shape, np.int64)
    out[row, key & 511] = _turned(15)[(np.cumsum(room) - room) & 0x7FFF]  # a complete code fills its 15 bits
    return out


def _write_codes(lengths: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """``_write_code`` for each row: what stands for the codes (row, bits and their number), and what to put for each symbol."""
    used = np.count_nonzero(lengths, 1)
    one = np.argmax(lengths > 0, 1)
    short = (used <= 1) & (one < 256)
    lengths = lengths.copy()
    lengths[(used == 1) & ~short, 0] = 1  # one symbol that the short form can't name gets a partner
    turned, lengths[short] = np.zeros(lengths.shape, np.int64), 0
    rows = np.flatnonzero(short)
    wide = one[rows] > 1
    parts = [(rows, 1 | wide << 2 | one[rows] << 3, np.where(wide, 11, 4))]
    rows = np.flatnonzero(~short)
    if len(rows):
        turned[rows] = _many_canonical(lengths[rows])
        of, symbol, extra, wide = _many_run_lengths(lengths[rows])
        own = _many_lengths(np.bincount(of * 19 + symbol, minlength=19 * len(rows)).reshape(-1, 19), 7)
        order = own[:, LENGTH_ORDER]
        last = np.maximum(4, 19 - np.argmax(order[:, ::-1] > 0, 1))
        parts.append((rows, (last - 4) << 1, np.full(len(rows), 5)))
        parts.append((rows, (order << 3 * np.arange(19)).sum(1), 3 * last + 1))
        several = np.count_nonzero(own, 1) > 1
        own[~several] = 0
        bits = np.zeros(own.shape, np.int64)
        bits[several] = _many_canonical(own[several])
        size = own[of, symbol]
        parts.append((rows[of], bits[of, symbol] | extra << size, size + wide))
    row, value, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    return (row[order], value[order], size[order]), turned, lengths


def _many_run_lengths(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_run_lengths`` for each row: row, symbol, extra bits and their number."""
    flat, across = lengths.reshape(-1), lengths.shape[1]
    begins = np.append(True, flat[1:] != flat[:-1])
    begins[::across] = True
    begin = np.flatnonzero(begins)
    n = flat[begin]
    lead = (n > 0).astype(np.int64)
    most = np.where(n > 0, 6, 138)
    whole, rest = np.divmod(np.diff(np.append(begin, len(flat))) - lead, most)
    steps = lead + whole + np.where(rest >= 3, 1, rest)
    which = np.repeat(np.arange(len(begin)), steps)
    k = np.arange(len(which)) - np.repeat(np.cumsum(steps) - steps + lead, steps)
    n, run = n[which], np.where(k < whole[which], most[which], rest[which])
    repeats = (k >= 0) & (run >= 3)
    kind = np.where(n > 0, 16, np.where(run >= 11, 18, 17))
    symbol = np.where(repeats, kind, n)
    return begin[which] // across, symbol, np.where(repeats, run - np.where(kind == 18, 11, 3), 0), np.where(repeats, np.where(n > 0, 2, np.where(kind == 18, 7, 3)), 0)


def _write_code(w: BitWriter, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a code's lengths; gives what to put for each symbol, and its bits."""
    used = np.flatnonzero(lengths)
    s = int(used[0]) if len(used) else 0
    if len(used) <= 1 and s < 256:
        w.put(1, 1)
        w.put(0, 1)
        w.put(int(s > 1), 1)
        w.put(s, 8 if s > 1 else 1)
        return np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if len(used) == 1:  # one symbol that the short form can't name gets a partner
        lengths = lengths.copy()
        lengths[[0, s]] = 1
    w.put(0, 1)
    steps = _run_lengths(lengths)
    many = [0] * 19
    for n, _, _ in steps:
        many[n] += 1
    own = _lengths(np.array(many), 7)
    order = own[list(LENGTH_ORDER)].tolist()
    last = max(4, max(k for k, n in enumerate(order) if n) + 1)
    w.put(last - 4, 4)
    for n in order[:last]:
        w.put(n, 3)
    w.put(0, 1)
    value, size = (x.tolist() for x in canonical(own)) if np.count_nonzero(own) > 1 else ([0] * 19, [0] * 19)
    all_, at = 0, 0
    for n, extra, wide in steps:
        all_ |= (value[n] | extra << size[n]) << at
        at += size[n] + wide
    w.put_long(all_, at)
    return canonical(lengths)


def _run_lengths(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra bits, their number): 16 repeats the last length, 17 and 18 are runs of zeros."""
    out = []
    for n, same in itertools.groupby(lengths.tolist()):
        run = len(list(same))
        if n:
            out.append((n, 0, 0))
            run -= 1
        while run >= 3:
            most, least, symbol, wide = (6, 3, 16, 2) if n else (138, 11, 18, 7) if run >= 11 else (10, 3, 17, 3)
            out.append((symbol, min(run, most) - least, wide))
            run -= min(run, most)
        out += [(n, 0, 0)] * run
    return out


@functools.cache
def _flat_header() -> tuple[int, int]:
    """The bits that stand for flat codes, and their number."""
    w = BitWriter()
    for n in (280, 256, 256, 256, 40):
        _write_code(w, np.array(([8] * 256 + [0] * (n - 256)) if n >= 256 else [0] * n))
    whole = len(w.out) * 8 + w.n
    return int.from_bytes(w.out + bytes([w.value & 255]), "little"), whole


def _prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number for a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    extra = high - 1
    return 2 * high + (v >> extra & 1), v & ((1 << extra) - 1), extra


def _write_image(w: BitWriter, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False, flat: bool = False, items: Items | None = None) -> None:
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    if flat:
        w.put(*_flat_header())
        p = pixels.astype(np.uint32)
        w.put_bytes(_REVERSED[np.stack([p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24], -1).astype(np.uint8).reshape(-1)])
        return
    items = items or _items(pixels, width, _copies(pixels) if references else [], cache_bits)
    codes = [_write_code(w, _lengths(c, 15)) for c in items.counts()]
    _put_items(w, items, codes)


def _copies(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references, greedily: place, length and distance, to the last place that has the same three pixels."""
    n = len(pixels)
    if n < 4:
        return []
    p = pixels.astype(np.uint64)
    key = (p[:-2] << np.uint64(32) | p[1:-1]) * np.uint64(0x9E3779B97F4A7C15) ^ p[2:] * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key, kind="stable")
    at = order[1:][key[order[1:]] == key[order[:-1]]]
    before = order[:-1][key[order[1:]] == key[order[:-1]]]
    fits = at - before <= FARTHEST
    by_place = np.argsort(at[fits])
    out, free = [], 0
    for i, j in zip(at[fits][by_place].tolist(), before[fits][by_place].tolist(), strict=True):
        if i < free:
            continue
        most, length, step = min(MOST_COPY, n - i), 0, 32
        while length < most:
            end = min(most, length + step)
            other = np.flatnonzero(pixels[i + length : i + end] != pixels[j + length : j + end])
            if len(other):
                length += int(other[0])
                break
            length, step = end, 1024
        if length >= 3:
            out.append((i, length, i - j))
            free = i + length
    return out


def _cached(pixels: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each pixel, its slot of the colour cache and whether that holds it (the last pixel of the slot was the same)."""
    slot = (pixels.astype(np.uint32) * np.uint32(HASH)) >> np.uint32(32 - cache_bits)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    return slot.astype(np.int64), hit


@functools.lru_cache(maxsize=64)
def _near(width: int) -> dict[int, int]:
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


class Items:
    """What an image is written as: ``first`` symbols (green, length or cache) and, by kind, what follows them."""

    def __init__(self, first: np.ndarray, plain: np.ndarray, colours: np.ndarray, copy: np.ndarray, far: list[tuple[int, int, int, int, int]], alphabet: int) -> None:
        self.first, self.plain, self.colours, self.copy, self.far, self.alphabet = first, plain, colours, copy, far, alphabet

    def counts(self) -> list[np.ndarray]:
        n = self.alphabet
        parts = [self.first, *[(self.colours >> k & 255) + n + 256 * j for j, k in enumerate((16, 0, 24))], np.array([f[2] for f in self.far], np.int64) + n + 768]
        return np.split(np.bincount(np.concatenate(parts), minlength=n + 808), (n, n + 256, n + 512, n + 768))


def _items(pixels: np.ndarray, width: int, copies: list[tuple[int, int, int]], cache_bits: int) -> Items:
    n = len(pixels)
    begins, inside = np.zeros(n, bool), np.zeros(n + 1, np.int64)
    far = []
    near = _near(width)
    lengths = []
    for at, length, distance in copies:
        a, b = _prefix_of(length), _prefix_of(near.get(distance, distance + 120))
        lengths.append(256 + a[0])
        far.append((a[1], a[2], b[0], b[1], b[2]))
    if copies:
        at = np.array([c[0] for c in copies])
        begins[at] = True
        inside[at] += 1
        np.subtract.at(inside, at + np.array([c[1] for c in copies]), 1)
    starts = np.flatnonzero(begins | (np.cumsum(inside[:-1]) == 0))
    values, copy = pixels[starts].astype(np.int64), begins[starts]
    first = values >> 8 & 255
    plain = ~copy
    if cache_bits:
        slot, hit = _cached(pixels, cache_bits)
        held = hit[starts] & plain
        first[held] = 280 + slot[starts][held]
        plain &= ~held
    first[copy] = lengths
    return Items(first, plain, values[plain], copy, far, 280 + ((1 << cache_bits) if cache_bits else 0))


def _put_items(w: BitWriter, items: Items, tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Each item is at most 60 bits, which go to one or two of the 64-bit words of a piece."""
    value, size = tables[0][0][items.first], tables[0][1][items.first]
    if items.far:
        far = np.array(items.far, np.int64)
        turned, wide = tables[4]
        for v, n in ((far[:, 0], far[:, 1]), (turned[far[:, 2]], wide[far[:, 2]]), (far[:, 3], far[:, 4])):
            value[items.copy] |= v << size[items.copy]
            size[items.copy] += n
    v, n = value[items.plain], size[items.plain]
    for k, (turned, wide) in zip((16, 0, 24), tables[1:4], strict=True):
        sample = items.colours >> k & 255
        v |= turned[sample] << n
        n += wide[sample]
    value[items.plain], size[items.plain] = v, n
    _put_bits(w, value, size)


def _put_bits(w: BitWriter, value: np.ndarray, size: np.ndarray) -> None:
    """Many values of at most 60 bits each."""
    for start in range(0, len(value), PIECE):
        v, n = np.append(w.value, value[start : start + PIECE]).astype(np.uint64), np.append(w.n, size[start : start + PIECE])
        end = np.cumsum(n)
        word, shift = (end - n) >> 6, ((end - n) & 63).astype(np.uint64)
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
        words[word[begin]] = np.bitwise_or.reduceat(v << shift, begin)
        over = np.where(shift > 0, v >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        words[word[begin] + 1] |= np.bitwise_or.reduceat(over, begin)
        data, whole = words.tobytes(), int(end[-1] >> 3)
        w.out += data[:whole]
        w.n = int(end[-1] & 7)
        w.value = data[whole] & ((1 << w.n) - 1)


def _header(width: int, height: int) -> BitWriter:
    w = BitWriter()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


def encode(image: np.ndarray, flat: bool = True, cache_bits: int = 0, references: bool = True, transforms: tuple[int, ...] = (), modes: np.ndarray | None = None, scale: int = 2) -> bytes:
    """A lossless WebP file of height x width x (R, G, B, A); ``transforms`` in the order in which they are made.

    ``modes`` are the predictor's (a row for each row of blocks of 2 ** scale pixels; 11 everywhere if not given).
    """
    height, width = image.shape[:2]
    if not 0 < height <= MOST_SIDE or not 0 < width <= MOST_SIDE:
        raise ValueError("sides must be from 1 to 16384")
    c = image.astype(np.uint32)
    pixels = (c[..., 3] << 24 | c[..., 0] << 16 | c[..., 1] << 8 | c[..., 2]).reshape(-1)
    w = _header(width, height)
    now = width
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        blocks = (-(-height >> scale), -(-now >> scale))
        if kind in (PREDICT, CROSS):
            w.put(scale - 2, 3)
            if kind == PREDICT:
                table = np.resize(np.array([11], np.uint32) if modes is None else modes.astype(np.uint32), blocks) << 8
                pixels = _predictor(pixels, now, table >> 8, scale, False)
            else:
                table = np.resize(np.array([0x00102030, 0x00F0E0D0], np.uint32), blocks)
                pixels = _cross(pixels, now, table, scale, False)
            _write_image(w, (table.reshape(-1) | np.uint32(0xFF000000)), blocks[1], False)
        elif kind == GREEN:
            pixels = _green(pixels, -1)
        else:
            table, index = np.unique(pixels, return_inverse=True)
            if len(table) > 256:
                raise ValueError("more than 256 colours")
            w.put(len(table) - 1, 8)
            channels = _channels(table.astype(np.uint32))
            _write_image(w, _packed(np.diff(channels, axis=0, prepend=0)), len(table), False)
            bits = _pack_bits(len(table))
            wide = -(-now >> bits)
            grid = np.zeros((height, wide << bits), np.uint32)
            grid[:, :now] = index.reshape(height, now)
            each = 8 >> bits
            parts = grid.reshape(height, wide, 1 << bits)
            pixels = np.uint32(0xFF000000) | (sum(parts[..., k] << np.uint32(each * k) for k in range(1 << bits)) << np.uint32(8)).reshape(-1)
            now = wide
    w.put(0, 1)
    _write_image(w, pixels, now, True, cache_bits, references, flat)
    return _riff([(b"VP8L", w.done())])


def _matches(samples: np.ndarray, edges: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Back-references among the bytes of each image, greedily: places, lengths and distances, to the last place that has the same four, or by runs of three.

    Images lie one behind the other from ``edges`` to ``edges``; ``which`` is each byte's image. No reference leaves its image.
    """
    n, data = len(samples), samples.tobytes()
    words = np.ndarray((n + 1,), "<u8", data + bytes(8), 0, (1,)).copy()
    key = np.sort(words[:n] << np.uint64(32) | np.arange(n, dtype=np.uint64))
    order = key.view("<u4")[::2].astype(np.int64)
    found = words[order]
    # The last place with the same four bytes, where the next two are the same as well, which LEAST_COPY asks for.
    again = np.flatnonzero((found[1:] ^ found[:-1]) << np.uint64(64 - 8 * LEAST_COPY) == 0)
    place, before = order[again + 1], order[again]
    image = which[place]
    near = (place - before <= FARTHEST) & (before >= edges[image]) & (place + 4 <= edges[image + 1])
    last = np.full(n, -1, np.int64)
    last[place[near]] = before[near]
    same = samples[1:] == samples[:-1]
    same[edges[1:-1] - 1] = False
    runs = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) + 1
    last[runs] = runs - 1
    place = np.flatnonzero(last >= 0)
    before = last[place]
    length, active = np.zeros(len(place), np.int64), np.arange(len(place))
    for k in range(0, SURE_COPY, 8):
        differ = words[np.minimum(place[active] + k, n)] ^ words[np.minimum(before[active] + k, n)]
        # The zeros below the lowest bit that differs tell the bytes that don't.
        length[active] += np.bitwise_count(~differ & (differ - np.uint64(1))) >> 3
        active = active[differ == 0]
    length = np.minimum(length, edges[which[place] + 1] - place)
    good = (length >= LEAST_COPY) | (place - before == 1)
    place, before, length = place[good], before[good], length[good]
    # Which comes next after one of the length that is known.
    rank = np.zeros(n + 1, np.int64)
    rank[place + 1] = 1
    np.cumsum(rank, out=rank)
    follow = memoryview(rank[place + length])
    long = (length >= SURE_COPY).tobytes()
    taken, sizes, at = [], [], 0
    while at < len(follow):
        taken.append(at)
        if not long[at]:
            at = follow[at]
            continue
        i, j, most = int(place[at]), int(before[at]), int(length[at])
        end, step = min(MOST_COPY, int(edges[which[i] + 1]) - i), 32
        while most < end and (step := min(step, end - most)):
            if data[i + most : i + most + step] == data[j + most : j + most + step]:
                most, step = most + step, 2 * step
            elif step == 1:
                break
            else:
                step //= 2
        sizes.append((at, most))
        at = int(rank[i + most])
    for at, most in sizes:
        length[at] = most
    return place[taken], length[taken], (place - before)[taken]


def _prefixes_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_prefix_of`` for many: symbols, extra bits and their numbers."""
    v = values - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> extra & 1)), v & ((1 << extra) - 1), extra


@functools.lru_cache(maxsize=16)
def _near_codes(width: int) -> np.ndarray:
    """Codes of the distances that have a short one; 0 elsewhere."""
    out = np.zeros(8 * width + 16, np.int64)
    for distance, code in _near(width).items():
        out[distance] = code
    return out


def encode_grey(samples: np.ndarray, width: int) -> bytes:
    """A lossless WebP file of a grey image (red, green and blue alike): green subtracted, a prefix code and back-references."""
    return encode_greys([samples], width)[0]


def encode_greys(images: list[np.ndarray], width: int) -> list[bytes]:
    """``encode_grey`` for many images of one width, each by itself, in arrays over all of them."""
    many, samples = len(images), np.concatenate(images)
    edges = np.cumsum([0, *map(len, images)])
    n, which = len(samples), np.repeat(np.arange(many, dtype=np.int32), np.diff(edges))
    at, length, distance = _matches(samples, edges, which)
    inside = np.zeros(n + 1, np.int8)
    inside[at] += 1
    inside[at + length] -= 1
    plain = np.cumsum(inside[:-1], dtype=np.int8) == 0
    plain[at] = True
    starts = np.flatnonzero(plain)
    copy = np.zeros(n, bool)
    copy[at] = True
    copy = np.flatnonzero(copy[starts])
    image, first = which[starts].astype(np.int64), samples[starts].astype(np.int64)
    symbol, bits, wide = _prefixes_of(length)
    first[copy] = 256 + symbol
    near = _near_codes(width)
    code = np.where(distance < len(near), near[np.minimum(distance, len(near) - 1)], 0)
    far, far_bits, far_wide = _prefixes_of(np.where(code > 0, code, distance + 120))
    first += 280 * image
    far += 40 * image[copy]
    green, value, size = _write_codes(_many_lengths(np.bincount(first, minlength=280 * many).reshape(-1, 280), 15))
    distances, far_value, far_size = _write_codes(_many_lengths(np.bincount(far, minlength=40 * many).reshape(-1, 40), 15))
    value, size = value.reshape(-1)[first], size.reshape(-1)[first]
    v, k = value[copy], size[copy]
    for more, room in ((bits, wide), (far_value.reshape(-1)[far], far_size.reshape(-1)[far]), (far_bits, far_wide)):
        v |= more << k
        k += room
    value[copy], size[copy] = v, k
    each, full = np.arange(many), np.ones(many, np.int64)
    # Signature and sides, green subtracted, then no further transform, colour cache or meta codes.
    head = 0x2F | (width - 1) << 8 | (np.diff(edges) // width - 1) << 22 | 1 << 36 | 1 << 40 | GREEN << 41
    return [_riff([(b"VP8L", data)]) for data in _joined_bits(many, [(each, head, 46 * full), green, (each, GREY_CODES * full, 19 * full), distances, (image, value, size)])]


def _joined_bits(many: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[bytes]:
    """For each of many files its values of at most 60 bits, part by part; a part has file (ascending), value and number of bits."""
    room = np.array([np.bincount(of, size, many) for of, _, size in parts]).astype(np.int64)
    total = room.sum(0)
    begin = np.cumsum((total + 63) >> 6) - ((total + 63) >> 6)
    words = np.zeros(int(begin[-1] + ((total[-1] + 63) >> 6)) + 2, np.uint64)
    shifts = (begin << 6) + np.cumsum(room, 0) - np.cumsum(room, 1)  # the part's begin, without what its own sums count before
    for (of, value, size), add in zip(parts, shifts, strict=True):
        before = 0
        for start in range(0, len(value), PIECE):
            v, n = value[start : start + PIECE].astype(np.uint64), size[start : start + PIECE]
            end = np.cumsum(n) + before
            place = end - n + add[of[start : start + PIECE]]
            before = int(end[-1])
            word, shift = place >> 6, (place & 63).astype(np.uint64)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            words[word[first]] |= np.bitwise_or.reduceat(v << shift, first)
            over = np.where(shift > 0, v >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
            words[word[first] + 1] |= np.bitwise_or.reduceat(over, first)
    data = words.astype("<u8").tobytes()
    return [data[8 * b : 8 * b + (n + 7 >> 3)] for b, n in zip(begin.tolist(), total.tolist(), strict=True)]


def _riff(chunks: list[tuple[bytes, bytes]]) -> bytes:
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) & 1) for k, v in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def to_media(payload: bytes) -> bytes:
    """A payload (a positive multiple of 64 bytes) as a lossless WebP file.

    A byte is a grey pixel. Rows are 64 pixels wide, or a power of two times that where the image would be too high;
    then the last row may be padded, and a chunk of our own, which readers skip, tells the length. What one
    image can't hold goes on in a further file behind the first.
    """
    return to_medias([payload])[0]


def to_medias(payloads: list[bytes]) -> list[bytes]:
    """``to_media`` for many payloads. Images are written together up to ``TOGETHER`` bytes, which changes no file."""
    parts = [(k, payload[i : i + MOST_PAYLOAD]) for k, payload in enumerate(payloads) for i in range(0, len(payload), MOST_PAYLOAD)]
    files, greys, held, width = [b""] * len(parts), [], 0, UNIT

    def flush() -> None:
        if greys:
            for (i, _), file in zip(greys, encode_greys([samples for _, samples in greys], width), strict=True):
                files[i] = file
            greys.clear()

    for i, (_, payload) in enumerate(parts):
        wide = UNIT
        while -(-len(payload) // wide) > MOST_SIDE:
            wide *= 2
        samples = np.frombuffer(payload + b"\0" * (-len(payload) % wide), np.uint8)
        if len(set(payload[:512])) <= 16 and np.count_nonzero(np.bincount(samples, minlength=256)) <= 16:
            grey = np.repeat(samples, 4).reshape(-1, wide, 4)
            grey[..., 3] = 255
            files[i] = encode(grey, False, 0, True, (PALETTE,))
            continue
        if greys and (wide != width or held + len(samples) > TOGETHER):
            flush()
        held, width = (held if greys else 0) + len(samples), wide
        greys.append((i, samples))
    flush()
    out: list[list[bytes]] = [[] for _ in payloads]
    for (k, payload), file in zip(parts, files, strict=True):
        width, height = _sides(file)
        short = len(payload) < width * height
        out[k].append(_riff([(b"VP8L", file[20 : 20 + struct.unpack_from("<I", file, 16)[0]]), (b"LENG", struct.pack("<Q", len(payload)))]) if short else file)
    return [b"".join(x) for x in out]


def _sides(file: bytes) -> tuple[int, int]:
    sides = int.from_bytes(file[21:25], "little")
    return (sides & 0x3FFF) + 1, (sides >> 14 & 0x3FFF) + 1


def from_media(media: bytes) -> tuple[bytes, list[np.ndarray]]:
    """The payload and the images that hold it."""
    files = _files(media)
    images = [decode(file) for file in files]
    return b"".join(_payload(file, image[..., 1]) for file, image in zip(files, images, strict=True)), images


def from_medias(media: list[bytes]) -> list[tuple[bytes, list[np.ndarray]]]:
    """The payloads and the grey samples (height x width) of the images that hold them. Grey files are read together, others one by one."""
    files = [(k, file) for k, whole in enumerate(media) for file in _files(whole)]
    samples: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(files)
    greys, held = [], 0

    def flush() -> None:
        if greys:
            codes = [_many_entries(np.array(lengths)) for lengths in zip(*[x[-2:] for x in greys], strict=True)]
            images = [(bits, width, width * height, green, far) for (_, bits, width, height, *_), green, far in zip(greys, *codes, strict=True)]
            for (i, _, width, height, *_), found in zip(greys, _read_channels(images), strict=True):
                samples[i] = found.reshape(height, width)
        greys.clear()

    for i, (_, file) in enumerate(files):
        if not (grey := _grey(file)):
            samples[i] = decode(file)[..., 1]
            continue
        if held + len(file) > READ_TOGETHER:
            flush()
            held = 0
        held += len(file)
        greys.append((i, *grey))
    flush()
    out: list[tuple[list[bytes], list[np.ndarray]]] = [([], []) for _ in media]
    for (k, file), image in zip(files, samples, strict=True):
        out[k][0].append(_payload(file, image))
        out[k][1].append(image)
    return [(b"".join(payload), images) for payload, images in out]


def _files(media: bytes) -> list[bytes]:
    files, at = [], 0
    while at < len(media):
        files.append(media[at : at + 8 + struct.unpack_from("<I", media, at + 4)[0]])
        at += len(files[-1])
    return files


def _payload(file: bytes, samples: np.ndarray) -> bytes:
    more = 20 + (struct.unpack_from("<I", file, 16)[0] + 1 & ~1)
    return samples.tobytes()[: struct.unpack_from("<Q", file, more + 8)[0] if file[more : more + 4] == b"LENG" else None]


def feature(images: list[np.ndarray]) -> str:
    """Sides, the mean of the samples, and the number of different ones."""
    return _feature([image[..., 1] for image in images])


def _feature(images: list[np.ndarray]) -> str:
    seen = sum(np.bincount(image.reshape(-1), minlength=256) for image in images)
    sides = " ".join(f"{i.shape[1]}x{i.shape[0]}" for i in images)
    return f"{sides} {(seen @ np.arange(256)) / seen.sum():.3f} {np.count_nonzero(seen)}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_bytes`` and ``media`` binary, a lossless WebP file of each whole text. No shuffle."""
    fields = [df.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                whole = [t or b"" for t in texts]
                media = to_medias([t + b"\0" * (UNIT * max(1, -(-len(t) // UNIT)) - len(t)) for t in whole])
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(map(len, whole), pa.int64()), pa.array(media, pa.binary())], names=[f.name for f in fields])

    return map_arrow(df.select(id_col, text_col), run, T.StructType(fields))


def describe(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads each file back: id, ``n_bytes``, payload and media sizes and digests, ``feature``. No shuffle."""
    kinds = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    fields = [media.schema[id_col], *[T.StructField(k, {"long": T.LongType(), "string": T.StringType()}[v]) for k, v in kinds.items()]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, files in text_chunks(batch, "media"):
                for file, (payload, images) in zip(files, from_medias(files), strict=True):
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), _feature(images)))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_bytes"), *columns], names=[f.name for f in fields])

    return map_arrow(media, run, T.StructType(fields))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store(reader(spark, sf_dir, "documents")))
