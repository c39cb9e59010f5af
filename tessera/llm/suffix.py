"""Suffix-array dedup: bytes in strings of at least ``LENGTH`` bytes that an earlier document holds too.

1. Anchors: of any ``WINDOW`` neighbouring ``GRAM``-byte strings the first one of least hash is an anchor, so two
   equal strings of ``LENGTH`` bytes have equal anchors at equal places. Buckets of hashes (40 bits beside the
   bucket's; a chance match only brings a piece more) find the anchors that several documents have.
2. Each of those is sent, with the strings whose anchor it is, to its shard. Of equal pieces in a blob of
   documents only the first document's goes; the others are covered by it there and then.
3. A shard joins its pieces of text, and sorts their suffixes by induced sorting: suffixes are classified,
   the leftmost smaller substrings are sorted by induction and named, their string is sorted recursively, and
   everything else is induced from it, bucket by bucket in array operations. A string of more than ``MOST_NAMES``
   names, where buckets are small, is sorted in array operations too, by doubling the length that ranks
   stand for; as only ``LENGTH`` bytes count, a few times are enough. The permuted common prefixes of
   neighbours then give the runs of equal strings, whose bytes go in all documents but the first.
4. Each document's covered bytes are joined into spans and cut out.

A text that equals an earlier document's is covered whole if it is long enough, and takes no part.

Defined results: a null text is an empty one and keeps nothing; ids are integers, a null id comes after all
others, equal ids are not earlier than each other; texts of under ``LENGTH`` bytes stay; other columns are
dropped. Strings never cross documents, and are judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, group_arrow, map_arrow, materialize, reader, release, text_chunks
from .shingles import mix64

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
BLOB_ANCHORS, BLOB_DOCS, BLOB_BYTES = 500_000, 60_000, 12 << 20
MOST_BROADCAST = 500_000
MOST_NAMES = 1024
LATEST = (1 << 63) - 1
_STEP = 1 << 20
_U = np.uint64
_BASE = 0xD1342543DE82EF95
#: Room for a step's places below the hashes that they are told apart by.
_PLACE = _U((1 << 21) - 1)
_TEXT, _ANCHOR, _COVER = 0, 1, 2
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, _U(base))
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = least(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return least(x[:-rest], x[rest:]) if rest else x


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's anchors, made in steps of bounded size: places, hashes, and the first and last start of a string whose anchor each is."""
    found: list[tuple[np.ndarray, ...]] = []
    for start in range(0, max(0, len(text) - LENGTH + 1), _STEP):
        b = np.frombuffer(text[start : start + _STEP + LENGTH - 1], np.uint8)
        up, down = _powers(_STEP + LENGTH)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + _U(1)) * up[: len(b)], dtype=np.uint64)])
        h = mix64((total[GRAM:] - total[:-GRAM]) * down[: len(b) - GRAM + 1])
        # The first least of each window: by 43 bits of the hash, and then by place.
        least = _slide(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), WINDOW, np.minimum)
        of = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        place = of[first]
        found.append((place + start, h[place], first + start, np.append(first[1:], len(of)) - 1 + start))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    if len(found) == 1:
        return found[0]
    place, h, first, last = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((first, place))  # an anchor may belong to two steps, and then to all starts between
    place, h, first, last = place[order], h[order], first[order], last[order]
    begins = np.flatnonzero(np.diff(place, prepend=-1))
    return place[begins], h[begins], np.minimum.reduceat(first, begins), np.maximum.reduceat(last, begins)


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the next one; the last is."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    decides = np.where(step != 0, np.arange(n - 1), n)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    out = np.ones(n, bool)
    inner = decides < n
    out[:-1][inner] = step[decides[inner]] > 0
    return out


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array that the leftmost smaller suffixes, in the order given, induce. Batches follow the buckets."""
    n, sigma = len(s), len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    sa = np.full(n, -1, np.int64)
    head, tail = starts.copy(), ends.copy()
    by_char = np.argsort(s[lms], kind="stable")
    chars = s[lms][by_char]
    first = np.searchsorted(chars, np.arange(sigma))
    count = np.searchsorted(chars, np.arange(sigma), "right") - first
    sorted_lms = lms[by_char]

    def put(order: np.ndarray, from_head: bool) -> None:
        """Append to the buckets of their characters, keeping the order."""
        c = s[order]
        at = np.argsort(c, kind="stable")
        c = c[at]
        begins = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        many = np.diff(np.append(begins, len(c)))
        rank = np.arange(len(c)) - np.repeat(begins, many)
        if from_head:
            sa[head[c] + rank] = order[at]
            head[c[begins]] += many
        else:
            sa[tail[c] - 1 - rank] = order[at]
            tail[c[begins]] -= many

    def scan(batch: np.ndarray, want_small: bool) -> None:
        before = batch[batch > 0] - 1
        before = before[small[before] == want_small]
        if len(before):
            put(before, not want_small)

    for c in range(sigma):  # larger suffixes, from the left
        done = starts[c]
        while done < head[c]:
            stop = head[c]
            scan(sa[done:stop], False)
            done = stop
        if count[c]:
            scan(sorted_lms[first[c] : first[c] + count[c]], False)
    for c in range(sigma - 1, -1, -1):  # smaller ones, from the right
        done = ends[c]
        while done > tail[c]:
            stop = tail[c]
            scan(sa[stop:done][::-1], True)
            done = stop
        if head[c] > starts[c]:
            scan(sa[starts[c] : head[c]][::-1], True)
    sa[0] = n - 1
    return sa


def _doubled(names: np.ndarray, reach: int) -> np.ndarray:
    """Places in the order of what follows them, by the first ``reach`` names; those that tie in no particular order."""
    rank, span = names.astype(np.int64), 1
    while True:
        behind = np.zeros(len(rank), np.int64)
        behind[:-span] = rank[span:] + 1
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        span *= 2
        if span >= min(reach, len(rank)) or rank[order[-1]] + 1 == len(rank):
            return order


def suffix_array(s: np.ndarray, sigma: int, depth: int | None = None) -> np.ndarray:
    """Of numbers below ``sigma``, the last of which is 0 and the only 0, by induced sorting; in the order of the first ``depth`` at least."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(s)
    is_lms = np.concatenate([[False], small[1:] & ~small[:-1]])
    lms = np.flatnonzero(is_lms)
    ends = np.cumsum(np.bincount(s, minlength=sigma))
    run = lambda order: _induce(s, small, order, ends)
    sa = run(lms)
    order = sa[is_lms[sa]]
    # Names of the substrings from one leftmost smaller place to the next, both included.
    place = np.full(n, -1, np.int64)
    place[lms] = np.arange(len(lms))
    length = np.append(np.diff(lms), 0)[place[order]]
    same = np.concatenate([[False], length[1:] == length[:-1]])
    active = np.flatnonzero(same)
    for k in range(int(length.max()) + 1 if len(length) else 0):
        active = active[length[active] >= k]
        if not len(active):
            break
        equal = s[order[active] + k] == s[order[active - 1] + k]
        same[active[~equal]] = False
        active = active[equal]
    name = np.cumsum(~same) - 1
    if name[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[place[order]] = name
        names, reach = int(name[-1]) + 1, len(lms) if depth is None else -(-depth // 2)  # a name stands for two at least
        order = lms[_doubled(reduced, reach) if names > MOST_NAMES else suffix_array(reduced, names, None if depth is None else reach)]
    return run(order)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted: for each place, what its suffix has in common with the one before it in the array, ``most`` at most."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    active = np.flatnonzero(before >= 0)
    padded = np.concatenate([s, np.full(most + 8, -1, s.dtype)])
    small = padded.astype(np.uint64)
    words = np.zeros(n + most, np.uint64)
    for k in range(4):
        words |= (small[k : k + n + most] & _U(0xFFFF)) << _U(16 * k)
    for k in range(0, most, 4):
        if not len(active):
            break
        differ = words[active + k] ^ words[before[active] + k]
        same = (differ == 0).astype(np.int64) * 4
        for j in range(3, 0, -1):
            same[(same == 0) & (differ & _U((1 << 16 * j) - 1) == 0)] = j
        out[active] += same
        active = active[same == 4]
    return np.minimum(out, most)


def covered(pieces: list[bytes], owner: np.ndarray) -> list[np.ndarray]:
    """For each piece the places where a string of ``LENGTH`` bytes starts that a piece of a smaller owner holds too."""
    length = np.array([len(p) for p in pieces], np.int64)
    joined = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8).astype(np.int64) + 2
    begin = np.cumsum(length + 1) - (length + 1)
    joined[begin + length] = 1
    s = np.append(joined, 0)
    of = np.append(np.repeat(np.arange(len(pieces)), length + 1), -1)
    left = np.append(np.repeat(begin + length, length + 1), 0) - np.arange(len(s))  # bytes up to the piece's end
    sa = suffix_array(s, 258, LENGTH)
    long = common_prefixes(s, sa, LENGTH)[sa] >= LENGTH
    valid = left[sa] >= LENGTH
    run = np.cumsum(~(long & valid))
    at, run = sa[valid], run[valid]
    who = owner[of[at]]
    begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, int)
    least = np.repeat(np.minimum.reduceat(who, begins), np.diff(np.append(begins, len(run)))) if len(run) else who
    hit = at[who > least]
    hit_of = of[hit]
    order = np.lexsort((hit, hit_of))
    hit, hit_of = hit[order], hit_of[order]
    edges = np.searchsorted(hit_of, np.arange(len(pieces) + 1))
    return [hit[edges[k] : edges[k + 1]] - begin[k] for k in range(len(pieces))]


_TYPES = {"bucket": pa.int64(), "kind": pa.int32(), "blob": pa.int64(), "hashes": pa.binary(), "docs": pa.binary(), "places": pa.binary(), "ends": pa.binary(), "owners": pa.binary(), "text": pa.binary(), "id": pa.int64(), "has_id": pa.bool_(), "size": pa.int64(), "whole": pa.bool_()}
_FLAT = "bucket long, kind int, blob long, hashes binary, docs binary, places binary, ends binary, owners binary, text binary, id long, has_id boolean, size long, whole boolean"


def _narrow(h: np.ndarray) -> bytes:
    """40 bits of each hash, beside those that name the bucket."""
    return np.ascontiguousarray((h >> _U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _widen(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _short(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes as a bucket gives them back."""
    return h >> _U(24) << _U(24) | h & _U(buckets - 1)


def _tight(values: np.ndarray, dtype: str) -> bytes:
    """Numbers that mostly rise a little, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.diff(values.astype(np.int64), prepend=0).astype(dtype).tobytes())


def _loose(data: bytes, dtype: str) -> np.ndarray:
    with zstandard.ZstdDecompressor().stream_reader(data) as f:
        return np.cumsum(np.frombuffer(f.read(), dtype), dtype=np.int64)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([r.get(k) for r in rows], t) for k, t in _TYPES.items()})


def _deal(buckets: int):
    """Texts to blobs: a row for each text, and for each bucket the anchors of the blob's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 24, 0
        pack = zstandard.ZstdCompressor(level=3)
        rows: list[dict] = []
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            blob = task + made
            whole = [r | {"bucket": -1 - blob, "kind": _TEXT, "blob": blob, "docs": i.to_bytes(2, "little")} for i, r in enumerate(rows)]
            for start in range(0, len(whole), 2000):
                yield _batch(whole[start : start + 2000])
            h = np.concatenate(held)
            doc = np.repeat(np.arange(len(held), dtype="<u2"), [len(x) for x in held])
            order = np.argsort(h & _U(buckets - 1), kind="stable")
            h, doc = h[order], doc[order]
            edges = np.searchsorted((h & _U(buckets - 1)).astype(np.int64), np.arange(buckets + 1))
            yield _batch([{"bucket": k, "kind": _ANCHOR, "blob": blob, "hashes": _narrow(h[a:b]), "docs": _tight(doc[a:b], "<i4")} for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a])

        count = total = 0
        for batch in batches:
            for part, texts in text_chunks(batch, "text"):
                for text, id_, copy in zip(texts, part.column("id").to_pylist(), part.column("copy").to_pylist(), strict=True):
                    text = text or b""
                    h = np.zeros(0, np.uint64) if copy else np.unique(anchors(text)[1])
                    rows.append({"text": pack.compress(text), "id": LATEST if id_ is None else id_, "has_id": id_ is not None, "size": len(text), "whole": bool(copy)})
                    held.append(h)
                    count, total = count + len(h), total + len(text)
                    if count >= BLOB_ANCHORS or len(rows) >= BLOB_DOCS or total >= BLOB_BYTES:
                        yield from flush()
                        rows, held, count, total, made = [], [], 0, 0, made + 1
        if rows:
            yield from flush()

    return run


def _several(table: pa.Table) -> pa.Table:
    """A bucket's anchors that several documents have, back to their blobs."""
    rows = table.select(["bucket", "blob", "hashes", "docs"]).to_pylist()
    h = np.concatenate([_widen(r["hashes"]) for r in rows])
    doc = np.concatenate([_loose(r["docs"], "<i4") for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r["hashes"]) // 5 for r in rows])
    order = np.argsort(h, kind="stable")
    t = h[order]
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    many = np.diff(np.append(first, len(t)))
    keep = np.sort(order[np.repeat(many > 1, many)])
    edges = np.searchsorted(of[keep], np.arange(len(rows) + 1))
    out = []
    for k, r in enumerate(rows):
        a, b = edges[k], edges[k + 1]
        if b > a:
            out.append({"bucket": -1 - r["blob"], "kind": _ANCHOR, "blob": r["blob"], "hashes": (h[keep[a:b]] << _U(24) | _U(r["bucket"])).tobytes(), "docs": _tight(doc[keep[a:b]], "<i4")})
    return pa.Table.from_batches([_batch(out)])


def _pieces(buckets: int):
    """A blob's texts and shared anchors to pieces of text for the shards, and places that are covered within the blob."""

    def run(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        rest = table.filter(pa.array(kinds == _ANCHOR)).select(["hashes", "docs"]).to_pylist()
        if not rest:
            return pa.Table.from_batches([_batch([])])
        h = np.concatenate([np.frombuffer(r["hashes"], "<u8") for r in rest])
        doc = np.concatenate([_loose(r["docs"], "<i4") for r in rest])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
        unpack = zstandard.ZstdDecompressor()
        rows = table.filter(pa.array(kinds == _TEXT)).select(["blob", "docs", "text", "id", "size"]).to_pylist()
        blob = table.column("blob")[0].as_py()
        seen: dict[bytes, tuple[int, int, list[tuple[int, int]]]] = {}  # a piece's smallest owner, its bucket and its places
        cover: list[tuple[int, int, int]] = []
        for r in sorted(rows, key=lambda r: r["id"]):
            at, owner = int.from_bytes(r["docs"], "little"), r["id"]
            a, b = np.searchsorted(doc, [at, at + 1])
            if a == b:
                continue
            text = unpack.decompress(r["text"], max_output_size=r["size"])
            _, hashes, first, last = anchors(text)
            hashes = _short(hashes, buckets)
            mine = np.isin(hashes, h[a:b])
            for start, end, bucket in zip(first[mine].tolist(), (last[mine] + LENGTH).tolist(), (hashes[mine] & _U(buckets - 1)).tolist(), strict=True):
                piece = text[start:end]
                found = seen.get(piece)
                if found is None:
                    seen[piece] = (owner, bucket, [(at, start)])
                elif found[0] == owner:
                    found[2].append((at, start))
                else:  # ids come in order, so that one is smaller
                    cover.append((at, start, end - start))
        out = []
        if cover:
            c = np.array(cover, np.int64)
            out.append({"bucket": -1 - blob, "kind": _COVER, "blob": blob, "docs": c[:, 0].astype("<u2").tobytes(), "places": c[:, 1].astype("<i8").tobytes(), "ends": (c[:, 1] + c[:, 2]).astype("<i8").tobytes()})
        by: dict[int, list] = {}
        for piece, (owner, bucket, where) in seen.items():
            by.setdefault(bucket, []).append((piece, owner, where))
        pack = zstandard.ZstdCompressor(level=3)
        for k, items in by.items():
            places = np.array([w for i in items for w in i[2]], np.int64)
            out.append({
                "bucket": k, "kind": _ANCHOR, "blob": blob, "docs": _tight(places[:, 0], "<i4"), "places": _tight(places[:, 1], "<i8"), "ends": _tight(np.array([len(i[2]) for i in items]), "<i4"),
                "owners": np.array([i[1] for i in items], "<i8").tobytes(), "hashes": np.array([len(i[0]) for i in items], "<u2").tobytes(), "text": pack.compress(b"".join(i[0] for i in items)), "size": sum(len(i[0]) for i in items),
            })
        return pa.Table.from_batches([_batch(out)])

    return run


def _shard(table: pa.Table) -> pa.Table:
    """A shard's pieces to the places that are covered, by blob; rows that are that already pass."""
    if table.column("bucket")[0].as_py() < 0:
        return table
    rows = table.select(["blob", "docs", "places", "ends", "owners", "hashes", "text", "size"]).to_pylist()
    unpack = zstandard.ZstdDecompressor()
    distinct: dict[bytes, int] = {}
    owners: list[int] = []
    items: list[tuple[int, int, int, int, int]] = []  # row, its first and last place, owner, piece
    docs, places = [_loose(r["docs"], "<i4") for r in rows], [_loose(r["places"], "<i8") for r in rows]
    for k, r in enumerate(rows):
        data, at, done = unpack.decompress(r["text"], max_output_size=r["size"]), 0, 0
        for many, owner, size in zip(_loose(r["ends"], "<i4").tolist(), np.frombuffer(r["owners"], "<i8").tolist(), np.frombuffer(r["hashes"], "<u2").tolist(), strict=True):
            piece = data[at : at + size]
            at += size
            n = distinct.setdefault(piece, len(distinct))
            if n == len(owners):
                owners.append(owner)
            owners[n] = min(owners[n], owner)
            items.append((k, done, done + many, owner, n))
            done += many
    pieces = list(distinct)
    hits = covered(pieces, np.array(owners, np.int64))
    cover: dict[int, list[tuple[int, int, int]]] = {}
    for k, begin, end, owner, n in items:
        if owner > owners[n]:
            spans = [(0, len(pieces[n]))]
        elif len(hits[n]):
            breaks = np.flatnonzero(np.diff(hits[n]) > LENGTH) + 1
            spans = [(int(x[0]), int(x[-1]) + LENGTH) for x in np.split(hits[n], breaks)]
        else:
            continue
        where = zip(docs[k][begin:end].tolist(), places[k][begin:end].tolist(), strict=True)
        cover.setdefault(k, []).extend((doc, place + a, place + b) for doc, place in where for a, b in spans)
    out = []
    for k, found in cover.items():
        c = np.array(found, np.int64)
        out.append({"bucket": -1 - rows[k]["blob"], "kind": _COVER, "blob": rows[k]["blob"], "docs": c[:, 0].astype("<u2").tobytes(), "places": c[:, 1].astype("<i8").tobytes(), "ends": c[:, 2].astype("<i8").tobytes()})
    return pa.Table.from_batches([_batch(out)])


def _cut(table: pa.Table) -> pa.Table:
    """A blob's texts without the bytes that are covered."""
    kinds = np.asarray(table.column("kind"))
    rest = table.filter(pa.array(kinds == _COVER)).select(["docs", "places", "ends"]).to_pylist()
    cat = lambda k, t: np.concatenate([np.frombuffer(r[k], t) for r in rest]) if rest else np.zeros(0, t)
    doc, start, end = cat("docs", "<u2"), cat("places", "<i8"), cat("ends", "<i8")
    order = np.argsort(doc, kind="stable")
    doc, start, end = doc[order], start[order], end[order]
    unpack = zstandard.ZstdDecompressor()
    out: dict[str, list] = {k: [] for k in ("id", "n_bytes", "n_removed", "n_spans", "kept")}
    for r in table.filter(pa.array(kinds == _TEXT)).select(["docs", "text", "id", "has_id", "size", "whole"]).to_pylist():
        size, text = r["size"], unpack.decompress(r["text"], max_output_size=r["size"]) if r["size"] else b""
        step = np.zeros(size + 1, np.int64)
        if r["whole"] and size >= LENGTH:
            step[[0, size]] = 1, -1
        a, b = np.searchsorted(doc, [int.from_bytes(r["docs"], "little"), int.from_bytes(r["docs"], "little") + 1])
        np.add.at(step, start[a:b], 1)
        np.add.at(step, end[a:b], -1)
        gone = np.cumsum(step)[:size] > 0
        spans = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) > 0)
        for k, v in zip(out, (r["id"] if r["has_id"] else None, size, int(gone.sum()), len(spans), np.frombuffer(text, np.uint8)[~gone].tobytes()), strict=True):
            out[k].append(v)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``df``: ``id``, ``n_bytes``, ``n_removed``, ``n_spans`` longs, ``kept`` binary (the bytes that stay)."""
    spark = df.sparkSession
    buckets = 1 << min(16, max(4, (buckets_for(spark) - 1).bit_length()))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = texts.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), F.col("text"))})
    owner = F.coalesce("id", F.lit(LATEST))
    firsts = keyed.groupBy("h", "g").agg(F.min(owner).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = materialize(firsts, "equal-texts")
    firsts = F.broadcast(firsts) if firsts.count() <= MOST_BROADCAST else firsts
    marked = keyed.join(firsts, ["h", "g"], "left").select("id", "text", F.coalesce(owner > F.col("first"), F.lit(False)).alias("copy"))
    dealt = materialize(map_arrow(marked, _deal(buckets), _FLAT), "texts-anchors")
    texts = dealt.where(F.col("kind") == _TEXT)
    several = materialize(group_arrow(dealt.where(F.col("kind") == _ANCHOR), "bucket", _several, _FLAT), "anchors")
    release(spark)
    found = texts.where(~F.col("whole")).unionByName(several)
    cover = group_arrow(group_arrow(found, "bucket", _pieces(buckets), _FLAT), "bucket", _shard, _FLAT)
    cover = materialize(cover, "covered")
    release(spark)
    sides = texts.unionByName(cover)
    return group_arrow(sides, "bucket", _cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(reader(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
