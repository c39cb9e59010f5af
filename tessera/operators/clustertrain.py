"""Training on the cluster: words stay in the executors, a job settles several merges, and the driver sees a bounded list.

Words lie in blocks of flat symbol arrays, written to the shared folder. A job takes the blocks through a row of
merges: first those settled since the blocks were written, then a guess at the next ones. It returns how the count of
every pair that this touches moves from step to step, summed over the blocks and added to the pairs' counts, which are
written beside the blocks; the driver takes the ``MOST_PAIRS`` pairs that reach the highest counts at any step. With their
counts at each step it plays the selection: a guessed merge stands if it is the best pair of its step and no pair outside
the list can be better. The first that doesn't ends the run; the next guess begins from the counts of that step.
So a guess never changes the result, only how many merges a job settles. Guesses come from a few words that the driver
takes through the merges (``Guide``): the most frequent, and others by their hash with their weights raised.

Each ``REWRITE`` merges the blocks and counts are written anew, and the old ones dropped. Every job reads written
tables alone, so a lost executor costs its tasks again. Words holding no pair of a merge aren't touched by it: a block
compares its array with the pair and goes on with the words that hold it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import Written
from ..plans.ship import ship

#: Pairs that a job returns to the driver, merges that it tries, and merges after which blocks are written anew.
MOST_PAIRS, MOST_STEPS, REWRITE = 4096, 320, 192
#: Words of a block and their bytes, about; words that the driver guesses by, about, and bytes of the longest of them.
BLOCK_WORDS, BLOCK_BYTES, GUESS_WORDS, GUESS_BYTES = 50_000, 1 << 20, 300_000, 64
_END = -1
_SHIFT = 32

Pair = tuple[int, int]


class Block:
    """Words side by side, each at its place: ``symbols`` with ``_END`` after each word, more of them as it shrinks; ``weight`` of words.

    Words that hold a pair are found by an index, of the pairs at first and of those that each merge makes; some have lost it since.
    """

    def __init__(self, symbols: np.ndarray, weight: np.ndarray) -> None:
        self.symbols, self.weight = symbols.astype(np.int32), weight
        ends = np.flatnonzero(self.symbols == _END) + 1
        self.size = np.diff(ends, prepend=0)
        self.start = ends - self.size
        self.index: tuple[np.ndarray, np.ndarray] | None = None
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def copy(self) -> Block:
        out = object.__new__(Block)
        out.__dict__.update(self.__dict__, symbols=self.symbols.copy(), made=dict(self.made))
        return out

    def _pairs(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and words of all neighbouring symbols."""
        inside = (symbols[:-1] != _END) & (symbols[1:] != _END)
        return symbols[:-1][inside].astype(np.int64) << _SHIFT | symbols[1:][inside], word[:-1][inside]

    def _all(self) -> tuple[np.ndarray, np.ndarray]:
        return self._pairs(self.symbols, np.repeat(np.arange(len(self.size)), self.size))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        keys, word = self._all()
        return _summed(keys, self.weight[word])

    def _holding(self, pair: Pair) -> np.ndarray:
        """Words that may hold a pair, in order."""
        if self.index is None:
            self.index = _by_key(*self._all())
        keys, words = self.made.get(max(pair), self.index)
        key = pair[0] << _SHIFT | pair[1]
        return np.unique(words[np.searchsorted(keys, key) : np.searchsorted(keys, key, "right")])

    def _places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words' symbols, and the word of each."""
        size = self.size[words]
        ends = np.cumsum(size)
        return np.repeat(self.start[words] - (ends - size), size) + np.arange(ends[-1]), np.repeat(words, size)

    def merge(self, pair: Pair, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Joins a pair wherever it stands, from the left. Of the words that it changes: symbols before, which of them it joins, symbols after, the word of each."""
        a, b = pair
        words = self._holding(pair)
        if not len(words):
            return None
        places, word = self._places(words)
        old = self.symbols[places]
        at = np.flatnonzero((old[:-1] == a) & (old[1:] == b))
        if not len(at):
            return None
        if a == b:  # of a run of places every second
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) - 1
            first = np.searchsorted(run, run)
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        touched = np.zeros(len(self.size), bool)
        touched[word[at]] = True
        now, stay, joined = old.copy(), old != _END, np.zeros(len(old), bool)
        now[at] = new
        stay[at + 1] = False
        joined[at] = joined[at + 1] = True
        mine = touched[word]
        if not mine.all():
            places, word, old, now, stay, joined = (x[mine] for x in (places, word, old, now, stay, joined))
        words = np.flatnonzero(touched)
        size = self.size[words]
        kept = np.add.reduceat(stay, np.cumsum(size) - size, dtype=np.int64)
        to = np.repeat((np.cumsum(size) - size) - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum())
        after = np.full(len(now), _END, np.int32)
        after[to] = now[stay]
        self.symbols[places] = after
        keys, of = self._pairs(after, word)
        fresh = (keys >> _SHIFT == new) | (keys & (1 << _SHIFT) - 1 == new)
        self.made[new] = _by_key(keys[fresh], of[fresh])
        return old, joined, after, word

    def packed(self) -> bytes:
        """The symbols with one ``_END`` after each word."""
        more = np.append(False, (self.symbols[1:] == _END) & (self.symbols[:-1] == _END))
        return self.symbols[~more].astype("<i4").tobytes()

    def change(self, pair: Pair, new: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Joins a pair; the keys whose counts change, and by how much."""
        found = self.merge(pair, new)
        if found is None:
            return None
        old, joined, now, word = found  # pairs of symbols that aren't joined stay
        inside = (joined[:-1] | joined[1:]) & (old[:-1] != _END) & (old[1:] != _END)
        minus, minus_word = old[:-1][inside].astype(np.int64) << _SHIFT | old[1:][inside], word[:-1][inside]
        inside = ((now[:-1] == new) | (now[1:] == new)) & (now[:-1] != _END) & (now[1:] != _END)
        plus, plus_word = now[:-1][inside].astype(np.int64) << _SHIFT | now[1:][inside], word[:-1][inside]
        keys, by = _summed(np.concatenate([minus, plus]), np.concatenate([-self.weight[minus_word], self.weight[plus_word]]))
        return keys[by != 0], by[by != 0]


def _by_key(keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], words[order].astype(np.int32)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their values, exact."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    if not len(keys):
        return keys, values
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(values, starts)


_BLOCKS = "block long, symbols binary, weight binary"


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    for number, symbols, weight in zip(*(batch.column(c) for c in ("block", "symbols", "weight")), strict=True):
        yield number.as_py(), Block(np.frombuffer(symbols.as_buffer(), "<i4"), np.frombuffer(weight.as_buffer(), "<i8"))


def _side_by_side(pieces: list[bytes]) -> np.ndarray:
    """The pieces' bytes as symbols, with ``_END`` after each."""
    out = np.full(sum(map(len, pieces)) + len(pieces), _END, "<i4")
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    inside = np.ones(len(out), bool)
    inside[ends.astype(np.int64)] = False
    out[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    return out


def _blocks(words: DataFrame) -> DataFrame:
    """Words ``piece`` (UTF-8 or bytes) and ``n``, in the order of their partitions, as blocks."""
    most, most_bytes = BLOCK_WORDS, BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, pieces, counts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def made() -> pa.RecordBatch:
            columns = [pa.array([part << 32 | number], pa.int64()), pa.array([_side_by_side(pieces).tobytes()], pa.binary()), pa.array([np.array(counts, "<i8").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "symbols", "weight"])

        for batch in batches:
            for piece, n in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist(), strict=True):
                pieces.append(piece)
                counts.append(n)
                size += len(piece)
                if len(pieces) >= most or size >= most_bytes:
                    yield made()
                    pieces, counts, size, number = [], [], 0, number + 1
        if pieces:
            yield made()

    return words.select(F.col("piece").cast("binary").alias("piece"), F.col("n").cast("long").alias("n")).mapInArrow(run, _BLOCKS)


def _rows(keys: np.ndarray, step: int, by: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), step, np.int32)), pa.array(by)], names=["pair", "step", "by"])


_CHANGES = "pair long, step int, by long"


def _changes(blocks: DataFrame, settled: list[Pair], guess: list[Pair], first_new: int) -> DataFrame:
    """``pair``, ``step``, ``by``: changes of counts through the settled merges (step 0) and each guessed one (from 1)."""
    row, before = [*settled, *guess], len(settled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of all blocks of the task, by step
        for batch in batches:
            for _, block in _read(batch):
                parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
                for k, pair in enumerate(row):
                    if found := block.change(pair, first_new + k):
                        parts.setdefault(max(0, k - before + 1), []).append(found)
                for step, found in parts.items():
                    found += [held[step]] if step in held else []
                    held[step] = _summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])) if len(found) > 1 else found[0]
        for step in sorted(held):
            yield _rows(held[step][0], step, held[step][1])

    return blocks.mapInArrow(run, _CHANGES)


def _pair_counts(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block in _read(batch):
                keys, n = block.counts()
                yield _rows(keys, 0, n)

    return blocks.mapInArrow(run, _CHANGES).groupBy("pair").agg(F.sum("by").alias("by"))


def _advance(blocks: DataFrame, settled: list[Pair], first_new: int) -> DataFrame:
    """The blocks after the settled merges."""
    row = list(settled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block in _read(batch):
                for k, pair in enumerate(row):
                    block.merge(pair, first_new + k)
                columns = [pa.array([number], pa.int64()), pa.array([block.packed()], pa.binary()), pa.array([block.weight.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "symbols", "weight"])

    return blocks.mapInArrow(run, _BLOCKS)


def _highest(moves: Column) -> Column:
    """The highest count that a pair reaches after any step, of its (step, by) in order."""
    start = F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("top"))
    to = lambda s, m: F.struct((s["now"] + m["by"]).alias("now"), F.greatest(s["top"], s["now"] + m["by"]).alias("top"))
    return F.aggregate(moves, start, to)["top"]


def _round(base: DataFrame, changes: DataFrame, most: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The ``most`` pairs that reach the highest counts, highest first, each with its (step, change)."""
    every = base.select("pair", F.lit(0).alias("step"), "by").unionByName(changes)
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moves = every.repartition(tasks, "pair").groupBy("pair", "step").agg(F.sum("by").alias("by"))  # one shuffle for both
    found = moves.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("step", "by"))).alias("moves"))
    found = found.withColumn("top", _highest(F.col("moves"))).where("top >= 2").orderBy(F.desc("top"), "pair").limit(most)
    listed = found.select("pair", F.col("moves.step").alias("steps"), F.col("moves.by").alias("by")).collect()
    return [(r["pair"], list(zip(r["steps"], r["by"], strict=True))) for r in listed]


def _split(key: int) -> Pair:
    return key >> _SHIFT, key & (1 << _SHIFT) - 1


class _Play:
    """What the driver knows: the listed pairs' counts at each step, and how far it may trust the best of them."""

    def __init__(self, listed: list[tuple[int, list[tuple[int, int]]]], most: int) -> None:
        self.moves = [(key, dict(moves)) for key, moves in listed]
        self.counts = {key: moves.pop(0, 0) for key, moves in self.moves}
        self.at: dict[int, list[tuple[int, int]]] = {}
        for key, moves in self.moves:
            for step, by in moves.items():
                self.at.setdefault(step, []).append((key, by))
        # A pair that isn't listed never comes before this.
        self.bound = None
        if len(listed) == most:
            key, moves = listed[-1]
            total, top = 0, 0
            for _, by in moves:
                total += by
                top = max(top, total)
            self.bound = (-top, key)

    def step(self, number: int) -> None:
        for key, by in self.at.get(number, ()):
            self.counts[key] += by

    def best(self) -> int | None:
        """The pair to merge; None if there is none, or none that is sure to come before those that aren't listed."""
        top = min(((-n, key) for key, n in self.counts.items() if n >= 2), default=None)
        if top is None or (self.bound is not None and top > self.bound):
            return None
        return top[1]


def few(words: DataFrame) -> DataFrame:
    """About ``GUESS_WORDS`` words to guess by: those that come ``least`` times, and of others as many as their numbers say, by hash, as ``least`` of each. Of up to ``GUESS_BYTES``: they decide nothing."""
    words = words.where(F.octet_length("piece") <= GUESS_BYTES)
    rows = words.groupBy(F.least(F.col("n"), F.lit(4096)).cast("long").alias("n")).count().collect()
    n, words_of = (np.array([r[k] for r in rows], np.int64) for k in ("n", "count"))
    least = 1
    while (np.minimum(1, n / least) * words_of).sum() > GUESS_WORDS and least < 4096:
        least += 1
    held = words.where(F.pmod(F.xxhash64("piece"), F.lit(least)) < F.col("n"))
    return held.withColumn("n", F.greatest(F.col("n"), F.lit(least)).cast("long"))


class Guide:
    """A few words on the driver, taken through the settled merges, that tell what the next ones may be. It decides none."""

    def __init__(self, words: DataFrame, change: Callable[[Block, Pair, int], tuple] = None) -> None:
        self.change = change or (lambda block, pair, new: block.change(pair, new))
        self.low = 2  # the least count of the last guess
        rows = words.select(F.col("piece").cast("binary").alias("piece"), F.col("n").cast("long").alias("n")).toArrow()
        self.block, self.taken = Block(_side_by_side(rows.column("piece").to_pylist()), rows.column("n").to_numpy()), 0
        keys, n = self.block.counts()
        self.counts = dict(zip(keys.tolist(), n.tolist(), strict=True))

    def take(self, pairs: list[Pair]) -> None:
        """The merges settled since the last call."""
        for pair in pairs:
            self._merge(self.block, self.counts, pair, 256 + self.taken)
            self.taken += 1

    def _merge(self, block: Block, counts: dict[int, int], pair: Pair, new: int) -> list[int]:
        """Joins a pair; the pairs that it leaves ready to be merged, of those that it touches."""
        found = self.change(block, pair, new)
        if found is None:
            return []
        keys = found[0].tolist()
        for key, n in zip(keys, found[1].tolist(), strict=True):
            counts[key] = counts.get(key, 0) + n
        return keys if len(found) == 2 else found[0][found[2]].tolist()

    def ahead(self, exact: dict[int, int], most: int, best: int | None = None, only: tuple[set[int], int] | None = None) -> list[Pair]:
        """The next merges as these words have them, where the counts of some pairs and the next merge are known; with ``only``, of
        pairs that come so often none but those, until they are counted up again."""
        block, counts, out = self.block.copy(), {**self.counts, **exact}, []
        heap = [(-n, key) for key, n in counts.items() if n >= 2 and (only is None or n < only[1] or key in only[0])]
        heapq.heapify(heap)
        self.low = 2
        while len(out) < most:
            if out or best is None:
                while heap and counts[heap[0][1]] != -heap[0][0]:
                    heapq.heappop(heap)
                if not heap:
                    break
                best = heapq.heappop(heap)[1]
            out.append(_split(best))
            self.low = max(2, counts.get(best, 2))
            for key in self._merge(block, counts, out[-1], 256 + self.taken + len(out) - 1):
                if counts[key] >= 2:
                    heapq.heappush(heap, (-counts[key], key))
            counts[best] = 0  # whatever is left of a count that these words only estimate
        return out


def spread_words(words: DataFrame) -> int:
    """Parts that words are dealt to, so that every core has some."""
    spark = words.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def train_on_cluster(words: DataFrame, merges: int, report: dict | None = None) -> list[Pair]:
    """Canonical merges of ``words`` (``piece``, ``n``), as symbol numbers; ``report`` takes the number of ``jobs`` of rounds."""
    ship(words.sparkSession)
    guide = Guide(few(words))
    blocks = Written(_blocks(words.repartition(spread_words(words))), "train-blocks")
    counts = Written(_pair_counts(blocks.rows), "train-counts")
    done: list[Pair] = []  # written into the blocks
    settled: list[Pair] = []  # since then
    known = counts.rows.orderBy(F.desc("by"), "pair").limit(MOST_PAIRS).collect()
    guess = guide.ahead({r["pair"]: r["by"] for r in known}, min(merges, MOST_STEPS))
    rounds = rewrites = 0
    try:
        while len(done) + len(settled) < merges:
            if len(settled) >= REWRITE:
                changes = _changes(blocks.rows, settled, [], 256 + len(done)).select("pair", "by")
                moved = counts.rows.unionByName(changes).groupBy("pair").agg(F.sum("by").alias("by")).where("by > 0")
                fresh = Written(moved, "train-counts"), Written(_advance(blocks.rows, settled, 256 + len(done)), "train-blocks")
                counts.drop()
                blocks.drop()
                counts, blocks = fresh
                done, settled, rewrites = done + settled, [], rewrites + 1
            changes = _changes(blocks.rows, settled, guess, 256 + len(done))
            play = _Play(_round(counts.rows, changes, MOST_PAIRS), MOST_PAIRS)
            rounds += 1
            tried, taken = guess, 0
            while taken < len(tried) and len(done) + len(settled) < merges and play.best() == tried[taken][0] << _SHIFT | tried[taken][1]:
                settled.append(tried[taken])
                taken += 1
                play.step(taken)
            guide.take(tried[:taken])
            best = play.best()
            if best is None and tried and not taken:
                guess = []  # the list is the highest counts of this very step then
                continue
            if best is None and not tried:
                break
            left = merges - len(done) - len(settled)
            guess = guide.ahead(play.counts, min(left, MOST_STEPS), best) if best is not None else []
    finally:
        counts.drop()
        blocks.drop()
    if report is not None:
        report.update(jobs=2 + rounds + 2 * rewrites, rounds=rounds)
    return done + settled
