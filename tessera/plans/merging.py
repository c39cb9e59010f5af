"""Merging many pieces side by side in arrays, each by its own lowest rank a round."""

from __future__ import annotations

import numpy as np

from .model import SHORT, BpeModel

#: Pieces merged together.
TOGETHER = 20_000
#: Rank of a pair without a rule, and id of a symbol without a token.
NONE, MISS = np.int64(1) << 40, -1


class BatchMerger:
    """A model's rules as sorted arrays. Symbols are numbered by their bytes: 0 to 255, then every side and product of a rule."""

    def __init__(self, model: BpeModel) -> None:
        self.model = model
        number = {bytes([b]): b for b in range(256)}
        for pair in model.merges:
            if pair is not None:
                for s in (*pair, pair[0] + pair[1]):
                    number.setdefault(s, len(number))
        self.size = np.int64(len(number))
        rules = sorted((number[a] * int(self.size) + number[b], rank, number[a + b]) for (a, b), rank in model.ranks.items())
        self.keys, self.ranks, product = (np.array([r[k] for r in rules], np.int64) for k in range(3))
        self.product = np.zeros(max(1, len(model.merges)), np.int64)
        self.product[self.ranks] = product
        self.hex = np.array([s.hex().upper() for s in number], object)
        self.ids = np.array([model.ids.get(s, MISS) for s in number], np.int64)
        first = np.arange(256, dtype=np.int64)
        self.of_bytes = self._search((first[:, None] * self.size + first[None, :]).ravel())

    @classmethod
    def of(cls, model: BpeModel) -> BatchMerger:
        """That of a model, made once."""
        if model not in _MADE:
            _MADE.clear()
            _MADE[model] = cls(model)
        return _MADE[model]

    def _search(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), NONE)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as packed longs, ``MISS`` for a symbol that the vocabulary lacks. Pieces aren't empty."""
        short = [k for k, p in enumerate(pieces) if len(p) <= SHORT]
        out: list[bytes] = [b""] * len(pieces)
        for low in range(0, len(short), TOGETHER):
            part = short[low : low + TOGETHER]
            symbols, owner = self._merged([pieces[k] for k in part])
            packed = self.ids[symbols].astype("<i8").tobytes()
            ends, start = np.cumsum(np.bincount(owner, minlength=len(part))) * 8, 0
            for k, end in zip(part, ends.tolist(), strict=True):
                out[k] = packed[start:end]
                start = end
        for k, p in enumerate(pieces):
            if len(p) > SHORT:
                out[k] = np.array([self.model.ids.get(s, MISS) for s in self.model.merge(p)], "<i8").tobytes()
        return out

    def symbols_of(self, pieces: list[bytes]) -> tuple[list[str], np.ndarray]:
        """All pieces' symbols as hex in order, and how many each piece has. Pieces aren't empty."""
        out: list[list[str]] = [[]] * len(pieces)
        short = [k for k, p in enumerate(pieces) if len(p) <= SHORT]
        for low in range(0, len(short), TOGETHER):
            part = short[low : low + TOGETHER]
            symbols, owner = self._merged([pieces[k] for k in part])
            shown, start = self.hex[symbols].tolist(), 0
            for k, end in zip(part, np.cumsum(np.bincount(owner, minlength=len(part))).tolist(), strict=True):
                out[k] = shown[start:end]
                start = end
        for k, p in enumerate(pieces):
            if len(p) > SHORT:
                out[k] = [s.hex().upper() for s in self.model.merge(p)]
        return [s for piece in out for s in piece], np.array([len(piece) for piece in out], np.int64)

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all pieces, and the piece of each, in order."""
        sizes = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.append(self.of_bytes[data[:-1].astype(np.int64) << 8 | data[1:]], NONE)  # of a symbol and the next
        rank[np.cumsum(sizes) - 1] = NONE
        symbols = data.astype(np.int64)
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            change = np.empty(len(owner), bool)
            change[0] = True
            np.not_equal(owner[1:], owner[:-1], out=change[1:])
            starts = np.flatnonzero(change)
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NONE
            of_symbol = np.cumsum(change) - 1
            if done.any():
                gone = done[of_symbol]
                finished.append((symbols[gone], owner[gone]))
                stay = ~gone
                symbols, owner, rank, of_symbol, lowest = symbols[stay], owner[stay], rank[stay], (np.cumsum(~done) - 1)[of_symbol[stay]], lowest[~done]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == lowest[of_symbol])
            # Of places in a row (a symbol paired with itself) every second, from the left. A piece's last place has no rank.
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) - 1
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            symbols[at] = self.product[rank[at]]
            rank[at] = rank[at + 1]  # NONE where the second was the piece's last
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            at = place[at]
            again = np.concatenate([at, at[at > 0] - 1])  # some twice, to the same effect
            again = again[again + 1 < len(owner)]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self._search(symbols[again] * self.size + symbols[again + 1])
        symbols, owner = (np.concatenate([f[k] for f in finished]) if finished else np.array([], np.int64) for k in range(2))
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]


_MADE: dict[BpeModel, BatchMerger] = {}
