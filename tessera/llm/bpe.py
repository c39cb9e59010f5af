"""Byte-level BPE encoding and decoding.

The encoder reproduces exact merges in time linear in the text. Bytes are mapped to Latin-1, one
character each, so that a pyahocorasick automaton of all tokens finds the longest token at every
position in one pass. Encoding then takes the longest match, keeps it only if it is compatible with
the token before it (the pair re-encodes to itself, a memoised test on the tokens' merge trees), falls
back to the next shorter token that is a prefix, and steps back over the previous token when none is
left; a position that has failed once is never entered again. Texts are split in arrays, some MB at a time, by
the class of each character; the different pieces that a worker doesn't remember are encoded together, step by step.

Defined results: a null or empty text has no ids and decodes to nothing; repeated rows give repeated
rows; ids of any type, null included, pass through; other columns are dropped.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, reader, text_chunks

#: Pieces that a worker remembers in either of two generations: when one is full, it takes the place of the older.
MEMO_PIECES = 400_000
#: Pairs of tokens whose compatibility it remembers.
MEMO_PAIRS = 1_000_000
#: The same for pieces encoded together: slots, a power of two.
PAIR_BITS = 20
#: Pieces encoded together, at most and at least, and the longest of them.
MOST_TOGETHER, LEAST_TOGETHER, LONGEST_TOGETHER = 1 << 15, 64, 64
#: Bytes of text that are split together.
CHUNK = 4 << 20
FAR = 1 << 31
OTHER, LETTER, NUMBER, SPACE = range(4)


@dataclass(frozen=True)
class BpeModel:
    """Ranks (token bytes by id), each token's last merge (left, right; itself for a byte) and the class of every character."""

    tokens: list[bytes]
    left: list[int]
    right: list[int]
    classes: bytes


def _characters(upto: int) -> Iterator[str]:
    """All characters below ``upto``, some thousands at a time."""
    for start in range(0, upto, 1 << 14):
        yield "".join(chr(c) for c in range(start, min(upto, start + (1 << 14))) if not 0xD800 <= c < 0xE000)


def _alphabet(pattern: str, upto: int) -> set[str]:
    """The characters that a class of the tokenizer library's own regex engine takes (its Unicode version counts)."""
    byte = {bytes([i]): i for i in range(256)}
    probe = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=byte, special_tokens={})
    return {c for part in _characters(upto) for c in probe.decode(probe.encode_ordinary(part))}


def character_classes() -> bytes:
    """``OTHER``, ``LETTER``, ``NUMBER`` or ``SPACE`` for every character."""
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[[ord(c) for c in _alphabet(pattern, 0x110000)]] = kind
    return out.tobytes()


def _last_merges(tokens: list[bytes]) -> tuple[list[int], list[int]]:
    """Each token's two parts: what merging its bytes by all lower ranks leaves."""
    ranks = {t: i for i, t in enumerate(tokens)}
    left, right = list(range(len(tokens))), list(range(len(tokens)))
    for i, token in enumerate(tokens):
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: (ranks.get(parts[k] + parts[k + 1], FAR), k))
            if ranks.get(parts[best] + parts[best + 1], FAR) >= i:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            left[i], right[i] = ranks[parts[0]], ranks[parts[1]]
        elif len(parts) > 2:
            raise ValueError(f"token {i} can't be reached by merges of lower ranks")
    return left, right


@functools.lru_cache(maxsize=4)
def load_model(path: str) -> BpeModel:
    """Read a rank file (one ``base64 rank`` a line, ranks 0, 1, 2 ...) on the driver."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must be 0, 1, 2 ... and hold every byte")
    return BpeModel(tokens, *_last_merges(tokens), character_classes())


class _Automaton:
    """The same Aho-Corasick automaton in arrays, which runs over many pieces at once.

    Nodes are numbered level by level, so that ``keys`` (parent << 8 | byte) ascend and key i leads to node i + 1.
    ``out`` is a node's token, ``link`` the next node along the failures that has one (-1: none).
    """

    def __init__(self, tokens: list[bytes]) -> None:
        many, data = np.array([len(t) for t in tokens], np.int64), np.frombuffer(b"".join(tokens), np.uint8)
        base, node, levels = np.cumsum(many) - many, np.zeros(len(tokens), np.int64), []
        nodes = 1
        for depth in range(int(many.max())):
            on = np.flatnonzero(many > depth)
            keys, back = np.unique(node[on] << 8 | data[base[on] + depth], return_inverse=True)
            node[on] = nodes + back
            levels.append((nodes, keys))
            nodes += len(keys)
        self.keys = np.concatenate([k for _, k in levels] + [[-1]])
        self.sizes = many
        self.out, self.link, self.fail = np.full(nodes, -1, np.int64), np.full(nodes, -1, np.int64), np.zeros(nodes, np.int64)
        self.out[node] = np.arange(len(tokens))
        for first, keys in levels[1:]:
            fail = self._next(self.fail[keys >> 8], keys & 255)
            self.fail[first : first + len(keys)] = fail
            self.link[first : first + len(keys)] = np.where(self.out[fail] >= 0, fail, self.link[fail])

    def _next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(left):
            key = state << 8 | byte
            at = np.searchsorted(self.keys[:-1], key)
            found = self.keys[at] == key
            out[left[found]] = at[found] + 1
            on = ~found & (state > 0)
            left, state, byte = left[on], self.fail[state[on]], byte[on]
        return out

    def longest(self, data: np.ndarray, base: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The longest token that begins at each place of the pieces, which begin at ``base``; 0 elsewhere."""
        out, state, on = np.zeros(len(data) + 1, np.int64), np.zeros(len(base), np.int64), np.arange(len(base))
        for depth in range(int(many.max())):
            on = on[many[on] > depth]
            at = base[on] + depth
            node = state[on] = self._next(state[on], data[at].astype(np.int64))
            node = np.where(self.out[node] >= 0, node, self.link[node])
            while len(node):
                token = self.out[node]
                out[at + 1 - self.sizes[token]] = token  # ends grow, so the last is the longest
                node = self.link[node]
                more = node >= 0
                at, node = at[more], node[more]
        return out


class Encoder:
    """A worker's encoder: automaton, pair compatibility and piece memo."""

    def __init__(self, model: BpeModel, memo_pieces: int = MEMO_PIECES) -> None:
        self.memo_pieces = memo_pieces
        self.tokens, self.left, self.right = model.tokens, model.left, model.right
        self.ranks = {t: i for i, t in enumerate(model.tokens)}
        self.size = [len(t) for t in model.tokens]
        self.merged = {(a, b): i for i, (a, b) in enumerate(zip(model.left, model.right, strict=True)) if self.size[i] > 1}
        self.classes = np.frombuffer(model.classes, np.uint8)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(model.tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.arrays = _Automaton(model.tokens)
        self.shorter = [self._prefix(t) for t in model.tokens]
        self.pairs: dict[tuple[int, int], bool] = {}
        # Pieces to their packed ids; what is still asked for comes over from the older generation.
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.sizes, self.lefts, self.rights, self.shorters = (np.array(x, np.int64) for x in (self.size, self.left, self.right, self.shorter))
        merges = np.flatnonzero(self.sizes > 1)
        keys = self.lefts[merges] * len(self.tokens) + self.rights[merges]
        order = np.argsort(keys)
        self.merge_keys, self.merge_ids = np.append(keys[order], -1), np.append(merges[order], FAR)
        self.pair_keys, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def _prefix(self, token: bytes) -> int:
        """The longest other token that the token begins with; -1 if none."""
        return next((self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), -1)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b ends in exactly those two tokens.

        Going down both merge trees from the border: no pair of neighbours across the border may
        have a merge that would have come before the merges that hide it.
        """
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs.clear()
        fits = self.pairs[a, b] = self._compatible(a, b)
        return fits

    def _compatible(self, a: int, b: int) -> bool:
        merged, left, right = self.merged, self.left, self.right
        limit = FAR
        while True:
            if merged.get((a, b), FAR) < limit:
                return False
            # Undo the later of the two merges; on the right side the border pair loses ties.
            go_left = a > b
            for _ in range(2):
                if go_left:
                    if right[a] != a:
                        limit, a = a, right[a]
                        break
                elif left[b] != b:
                    limit, b = b + 1, left[b]
                    break
                go_left = not go_left
                limit = a if go_left else b + 1
            else:
                return True

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, size, shorter, known, compatible = len(data), self.size, self.shorter, self.pairs.get, self.compatible
        longest = [0] * n
        for end, t in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[t]] = t  # ends grow, so the last is the longest
        open_at = bytearray(b"\1") * (n + 1)
        ids: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + size[token]
            if open_at[end] and (last < 0 or (compatible(last, token) if (fits := known((last, token))) is None else fits)):
                ids.append(token)
                if end == n:
                    return ids
                last, at, token = token, end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[at] = 0
                token = ids.pop()
                last = ids[-1] if ids else -1
                at -= size[token]

    def _all_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_compatible`` for many pairs."""
        out, left = np.zeros(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), FAR, np.int64)
        while len(left):
            key = a * len(self.tokens) + b
            found = np.searchsorted(self.merge_keys[:-1], key)
            merge = np.where(self.merge_keys[found] == key, self.merge_ids[found], FAR)
            on_left, on_right = self.rights[a] != a, self.lefts[b] != b
            go_left = on_left & ((a > b) | ~on_right)
            hidden = merge >= limit
            out[left[hidden & ~on_left & ~on_right]] = True
            on = hidden & (on_left | on_right)
            limit = np.where(go_left, a, b + 1)[on]
            a, b = np.where(go_left, self.rights[a], a)[on], np.where(go_left, b, self.lefts[b])[on]
            left = left[on]
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs."""
        key = a * len(self.tokens) + b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out, new = self.pair_fits[slot], np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            keys, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            fits = self._all_compatible(keys // len(self.tokens), keys % len(self.tokens))
            out[new] = fits[back]
            # Of the keys of one slot the last is remembered, with its own answer.
            at, last = np.unique(slot[new][first][::-1], return_index=True)
            self.pair_keys[at], self.pair_fits[at] = keys[::-1][last], fits[::-1][last]
        return out

    def pieces(self, data: list[bytes]) -> list[bytes]:
        """``piece`` for many, packed: the same steps for all pieces at once, until few are left."""
        if len(data) < LEAST_TOGETHER:
            return [self._packed(p) for p in data]
        many = np.array([len(p) for p in data], np.int64)
        base = np.cumsum(many + 1) - many - 1
        stop, total = base + many, int(many.sum()) + len(many)
        longest = self.arrays.longest(np.frombuffer(b"\0".join(data) + b"\0", np.uint8), base, many)
        open_at, ids = np.ones(total + 1, bool), np.zeros(total + 1, np.int64)
        at, token, last, top = base.copy(), longest[base], np.full(len(many), -1, np.int64), base.copy()
        left = np.arange(len(many))
        while len(left) >= LEAST_TOGETHER:
            now, before = token[left], last[left]
            end = at[left] + self.sizes[now]
            fits = open_at[end]
            ask = np.flatnonzero(fits & (before >= 0))
            fits[ask] = self._fits(before[ask], now[ask])
            taken, end = left[fits], end[fits]
            ids[top[taken]] = last[taken] = now[fits]
            top[taken] += 1
            at[taken], token[taken] = end, longest[end]
            other, less = left[~fits], self.shorters[now[~fits]]
            token[other[less >= 0]] = less[less >= 0]
            back = other[less < 0]
            open_at[at[back]] = False
            top[back] -= 1
            token[back] = ids[top[back]]
            last[back] = np.where(top[back] > base[back], ids[top[back] - 1], -1)
            at[back] -= self.sizes[token[back]]
            left = np.concatenate([taken[end < stop[taken]], other])
        whole = ids.astype("<u4").tobytes()
        out = [whole[4 * a : 4 * b] for a, b in zip(base.tolist(), top.tolist(), strict=True)]
        for i in left.tolist():
            out[i] = self._packed(data[i])
        return out

    def _packed(self, data: bytes) -> bytes:
        ids = self.piece(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _remembered(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of different pieces."""
        if len(self.memo) > self.memo_pieces:
            self.memo, self.older = {}, self.memo
        out = list(map(self.memo.get, pieces))
        missing = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in missing:
            out[i] = self.older.get(pieces[i])
            if out[i] is None:
                new.append(i)
        long = [i for i in new if len(pieces[i]) > LONGEST_TOGETHER]
        # In order, so that neighbours meet the same nodes of the automaton.
        short = sorted((i for i in new if len(pieces[i]) <= LONGEST_TOGETHER), key=pieces.__getitem__)
        for start in range(0, len(short), MOST_TOGETHER):
            some = short[start : start + MOST_TOGETHER]
            for i, ids in zip(some, self.pieces([pieces[i] for i in some]), strict=True):
                out[i] = ids
        for i in long:
            out[i] = self._packed(pieces[i])
        self.memo.update((pieces[i], out[i]) for i in missing)
        return out

    def starts(self, texts: list[bytes], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the matches of the split pattern begin in the texts' joined bytes.

        The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^SLN]+|S+(?!\\S)|S+ with letters L, numbers N and spaces S:
        runs of one class; the last space before something else stands alone, or joins it if it is U+0020; an
        apostrophe that begins a match takes the contraction's letters from the run behind it.
        """
        n = len(data)
        kind = self.classes[:256][data]
        for t in texts:
            if not t.isascii():
                t.decode("utf-8")
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            byte = lambda k: data[np.minimum(lead + k, n - 1)].astype(np.int64) & 0x3F
            first, size = data[lead].astype(np.int64), 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
            two, three = (first & 0x1F) << 6 | byte(1), (first & 0x0F) << 12 | byte(1) << 6 | byte(2)
            four = (first & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)
            of = self.classes[np.where(size == 2, two, np.where(size == 3, three, np.minimum(four, 0x10FFFF)))]
            for k in range(4):
                kind[lead[size > k] + k] = of[size > k]
        text = np.zeros(n + 4, bool)
        text[offsets] = True
        text[n:] = True
        mark = text.copy()
        mark[1:n] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(mark[1:n] & ~text[1:n]) + 1
        after = run[kind[run - 1] == SPACE]
        space = after - 1
        for _ in range(3):
            space -= (data[space] & 0xC0) == 0x80
        mark[after] = data[after - 1] != 0x20
        mark[space] = True
        wide = np.append(data, np.zeros(4, np.uint8))
        quote = np.flatnonzero((data == 0x27) & mark[:n])
        quote = quote[~text[quote + 1]]
        one, two = wide[quote + 1], wide[quote + 2]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = ~text[quote + 2] & (((one == ord("l")) & (two == ord("l"))) | (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))))
        mark[quote[single | double] + 1] = False
        mark[quote[single] + 2] = True
        mark[quote[double] + 3] = True
        return np.flatnonzero(mark[:n])

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids begin (and the last one's end)."""
        offsets = np.cumsum([0, *map(len, texts)])
        joined = b"".join(texts)
        if not joined:
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        starts = self.starts(texts, np.frombuffer(joined, np.uint8), offsets)
        edges = pa.py_buffer(np.append(starts, len(joined)).astype(np.int64))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, edges, pa.py_buffer(joined)]).dictionary_encode()
        different, whole = np.frombuffer(pieces.dictionary.buffers()[1], np.int64, len(pieces.dictionary) + 1).tolist(), pieces.dictionary.buffers()[2].to_pybytes()
        names = [whole[a:b] for a, b in zip(different, different[1:], strict=False)]
        packed = pa.array(self._remembered(names), pa.large_binary()).take(pieces.indices)
        ends = np.frombuffer(packed.buffers()[1], np.int64, len(starts) + 1, 8 * packed.offset) // 4
        ids = np.frombuffer(packed.buffers()[2], "<u4", int(ends[-1]))
        return ids, ends[np.searchsorted(starts, offsets)]

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_texts([text])[0].tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Packing:
    """Ids by how frequent they are in a sample, seven bits a byte, highest first, so that frequent ones take one byte.

    For what is stored and shuffled, where it is compressed as well. Every id below ``len(counts)`` has a code; the
    sample only decides how long that is. A byte below 128 ends an id.
    """

    #: Texts of the sample, and characters of each, at most.
    SAMPLE, SAMPLE_CHARS = 500, 4000
    MOST_BYTES = 4
    #: Ids or bytes that are handled together.
    TOGETHER = 1 << 18

    def __init__(self, counts: np.ndarray) -> None:
        if len(counts) > 1 << 7 * self.MOST_BYTES:
            raise ValueError("too many ids")
        self.ids = np.argsort(-counts, kind="stable").astype(np.uint32)
        self.ranks = np.empty(len(counts), np.int32)
        self.ranks[self.ids] = np.arange(len(counts), dtype=np.int32)

    @classmethod
    def fit(cls, df: DataFrame, model: BpeModel, text_col: str = "text") -> Packing:
        """From the beginnings of the table's first texts; the id past the vocabulary, which ends and pads, comes first."""
        rows = df.select(F.substring(text_col, 1, cls.SAMPLE_CHARS).alias("t")).limit(cls.SAMPLE).collect()
        ids, _ = Encoder(model).encode_texts([(r["t"] or "").encode() for r in rows])
        counts = np.bincount(ids, minlength=len(model.tokens) + 1)
        counts[-1] = len(ids) + 1
        return cls(counts)

    def pack(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' bytes, and where in them the ids number ``edges`` (ascending) begin."""
        parts, begin, size = [], np.zeros(len(edges), np.int64), 0
        for at in range(0, len(ids), self.TOGETHER):
            rank = self.ranks[ids[at : at + self.TOGETHER]]
            many = np.ones(len(rank), np.int64)
            for k in range(1, self.MOST_BYTES):
                many += rank >= 1 << 7 * k
            stop = np.cumsum(np.append(0, many))
            out, last = np.empty(int(stop[-1]), np.uint8), stop[1:] - 1
            out[last] = rank & 127
            on = np.arange(len(rank))
            for k in range(1, self.MOST_BYTES):
                on = on[many[on] > k]
                out[last[on] - k] = 128 | rank[on] >> 7 * k & 127
            here = slice(*np.searchsorted(edges, (at, at + len(rank))))
            begin[here] = size + stop[edges[here] - at]
            size += len(out)
            parts.append(out)
        begin[np.searchsorted(edges, len(ids)) :] = size
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8), begin

    def unpack(self, data: bytes) -> np.ndarray:
        """The ids of packed bytes."""
        read, parts, at = np.frombuffer(data, np.uint8), [], 0
        if len(read) and read[-1] > 127:
            raise ValueError("packed ids that are cut off")
        while at < len(read):
            stop = min(len(read), at + self.TOGETHER)
            while read[stop - 1] > 127:
                stop += 1
            some = read[at:stop]
            last = np.flatnonzero(some < 128)
            rank, many, on = some[last].astype(np.int32), np.diff(last, prepend=-1), np.arange(len(last))
            for k in range(1, self.MOST_BYTES):
                on = on[many[on] > k]
                rank[on] |= (some[last[on] - k] & 127).astype(np.int32) << 7 * k
            parts.append(self.ids[rank])
            at = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


_ENCODERS: dict[object, Encoder] = {}


def _encoder(model, memo_pieces: int = MEMO_PIECES) -> Encoder:
    """One encoder for each broadcast and worker."""
    if model.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model.id] = Encoder(model.value, memo_pieces)
    return _ENCODERS[model.id]


def forget_encoders() -> None:
    """Frees what encoding has left in this worker, for stages that come after."""
    _ENCODERS.clear()


class _Broadcast:
    """A broadcast with its id, which the worker uses as a key."""

    def __init__(self, spark: SparkSession, model: BpeModel) -> None:
        self.held = spark.sparkContext.broadcast(model)
        self.id = f"{spark.sparkContext.applicationId}-{self.held._jbroadcast.id() if self.held._jbroadcast else id(self)}"

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self) -> BpeModel:
        return self.held.value


def encode(df: DataFrame, model: BpeModel, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, check: bool = False, dtype: str = "uint32", packing: Packing | None = None, memo_pieces: int = MEMO_PIECES) -> DataFrame:
    """Ids of every whole text: the id column, ``n_tokens`` long, ``ids`` binary (little-endian unsigned 32-bit, or ``dtype``).

    ``decode`` adds ``decoded`` binary, the bytes that the ids stand for; ``check`` in its stead ``decodes`` boolean,
    whether those are the text's bytes. With ``packing``, ``ids`` are packed by it. The model (its vocabulary's
    size, and a byte for every character, about 3 MB) is broadcast; the executors need no file. No shuffle.
    A worker remembers up to twice ``memo_pieces`` pieces, some 200 bytes each, until another model is encoded with.
    """
    narrow = np.dtype(dtype).newbyteorder("<")
    if len(model.tokens) - 1 > np.iinfo(narrow).max:
        raise ValueError(f"the vocabulary has ids that {dtype} doesn't hold")
    held = _Broadcast(df.sparkSession, model)
    packer = df.sparkSession.sparkContext.broadcast(packing) if packing else None
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("decodes", T.BooleanType())] if check else [T.StructField("decoded", T.BinaryType())] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held, memo_pieces)
        for batch in batches:
            for rows, texts in text_chunks(batch, text_col, CHUNK):
                ids, begin = encoder.encode_texts([t or b"" for t in texts])
                data, edges = packer.value.pack(ids, begin) if packer else (ids.astype(narrow), begin * narrow.itemsize)
                buffers = [None, pa.py_buffer(edges), pa.py_buffer(data)]
                columns = [rows.column(id_col), pa.array(np.diff(begin)), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), buffers).cast(pa.binary())]
                each = (ids[a:b].tobytes() for a, b in zip(begin.tolist(), begin[1:].tolist(), strict=False))
                if check:
                    columns.append(pa.array([encoder.decode(x) == (t or b"") for x, t in zip(each, texts, strict=True)], pa.bool_()))
                elif decode:
                    columns.append(pa.array([encoder.decode(x) for x in each], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return map_arrow(df.select(id_col, text_col), run, T.StructType(fields))


def op2_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = load_model(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = encode(reader(spark, sf_dir, "documents"), model, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
