"""Main text of web pages: a bidirectional LSTM reads a page's blocks in order and labels every one.

Each block is a vector: the mean of learned vectors of its path's words (elements, classes, ids, roles; hashed), the mean
of learned vectors of its own words (hashed), and a few measures (length, links, punctuation, place). Two LSTMs read the
whole sequence from either end, so that a block is judged by all of its page. What is labelled article is the text: blocks
in page order with an empty line between. Scripts, styles, comments of the markup and the head are no blocks.

The corpus has no labels, so the network is fitted on ``TRAIN_PAGES`` pages a round that ``blocks.generated_page`` makes
up, whose labels are known; a bounded, seeded fit of some seconds on the driver, once for each process. It sees none of
the corpus. The weights (``PATHS`` and ``WORDS`` rows of a few numbers) are broadcast; pages are labelled where they lie, without
a shuffle, in batches of pages of like length. All blocks and words of a page count, however long it is.

Defined results: a null or empty page, and one without article, gives ''; broken markup is read forgivingly (open elements
end with what holds them, a cut-off script runs to the end); equal pages give equal texts; rows that repeat stay; other
columns are kept by ``extract``, clashing names included (``main_text`` and ``n_chars`` are replaced); an empty table gives no rows.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, generated_page, read_blocks
from .common import map_arrow, reader, text_chunks

PATHS, WORDS, PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 4096, 8192, 20, 10, 12, 24
TRAIN_PAGES, TRAIN_ROUNDS, BATCH, RATE, SEED = 600, 10, 24, 0.01, 7
#: Pages, and blocks with padding, that are labelled together.
MOST_PAGES, MOST_BLOCKS = 256, 32_768
MEMO = 300_000


class _Buckets(dict):
    """Words to their hash buckets; forgotten when too many."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % self.size
        return found


class Vectors:
    """The input of a page: hashed ids of paths and words with where each block's begin, and measures."""

    def __init__(self, blocks: list[Block], paths: _Buckets, words: _Buckets) -> None:
        found = [b.text.lower().split() for b in blocks]
        self.n = len(blocks)
        self.path_ids = np.array([paths[p] for b in blocks for p in b.path], np.int64)
        self.path_counts = np.array([len(b.path) for b in blocks], np.int64)
        self.word_ids = np.array([words[w] for f in found for w in f], np.int64)
        self.word_counts = np.array([len(f) for f in found], np.int64)
        self.measures = self._measures(blocks)

    def _measures(self, blocks: list[Block]) -> np.ndarray:
        texts, n = [b.text for b in blocks], len(blocks)
        count = lambda f: np.array([f(t) for t in texts], float)
        size, words, place = count(len), self.word_counts, np.arange(n)
        linked, heading = np.array([b.linked for b in blocks], float), np.array([b.path[-1][:2] == "=h" for b in blocks], float)
        ends, stops = count(lambda t: t[-1] in ".!?:;"), count(lambda t: t.count(".") + t.count("!") + t.count("?"))
        return np.stack([
            np.log1p(size) / 5, np.log1p(words) / 4, linked / size, ends, np.minimum(stops, 10) / 5, count(lambda t: t.count(",")) / (words + 1),
            place / max(n - 1, 1), 1 / (1 + place), 1 / (n - place), heading, (words < 4).astype(float), np.full(n, np.log1p(n) / 5),
        ], axis=1)


def _means(table: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean of the rows of each block; every block has one at least."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.add.reduceat(table[ids], starts, axis=0) / counts[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """The network: embeddings, an LSTM from either end, a logistic layer on both states and the block itself."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + MEASURES
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.w = {"paths": rng.normal(0, 0.5, (PATHS, PATH_SIZE)), "words": rng.normal(0, 0.3, (WORDS, WORD_SIZE)), "out": normal(2 * HIDDEN + size, 1), "bias": np.zeros(1)}
        for end in "fb":
            self.w["x" + end], self.w["h" + end] = normal(size, 4 * HIDDEN), normal(HIDDEN, 4 * HIDDEN)
            self.w["c" + end] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])  # forget gates begin open

    @staticmethod
    def _places(pages: list[Vectors]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each block of all pages its page, its place, and its place from the end."""
        n = np.array([p.n for p in pages])
        page = np.repeat(np.arange(len(pages)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return page, place, n[page] - 1 - place

    def _inputs(self, pages: list[Vectors]) -> np.ndarray:
        join = lambda name: np.concatenate([getattr(p, name) for p in pages])
        return np.hstack([_means(self.w["paths"], join("path_ids"), join("path_counts")), _means(self.w["words"], join("word_ids"), join("word_counts")), join("measures")])

    def _read(self, end: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (step, page, HIDDEN) of one LSTM over inputs (step, page, size); ``keep`` what the way back needs."""
        steps, pages, _ = x.shape
        gates = x @ self.w["x" + end] + self.w["c" + end]
        h, c, kept = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), []
        states = np.empty((steps, pages, HIDDEN))
        for t in range(steps):
            a = gates[t] + h @ self.w["h" + end]
            s, g = _sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            h_before, h = h, o * tc
            states[t] = h
            if keep:
                kept.append((i, f, o, g, before, tc, h_before))
        return states, kept

    def _forward(self, pages: list[Vectors], keep: bool = False):
        x = self._inputs(pages)
        page, place, from_end = self._places(pages)
        steps = int(place.max()) + 1
        dense, read = np.zeros((2, steps, len(pages), x.shape[1])), []
        both = []
        for k, at in enumerate((place, from_end)):
            dense[k, at, page] = x
            states, kept = self._read("fb"[k], dense[k], keep)
            both.append(states[at, page])
            read.append(kept)
        joined = np.hstack([*both, x])
        return _sigmoid(joined @ self.w["out"] + self.w["bias"])[:, 0], (x, page, place, from_end, dense, read, joined)

    def probabilities(self, pages: list[Vectors]) -> np.ndarray:
        """Of each block of all pages, that it belongs to the article."""
        return self._forward(pages)[0]

    def gradients(self, pages: list[Vectors], labels: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss and its gradients."""
        p, (x, page, place, from_end, dense, read, joined) = self._forward(pages, True)
        n = len(labels)
        loss = -np.mean(np.log(np.where(labels, p, 1 - p) + 1e-12))
        error = ((p - labels) / n)[:, None]
        grad = {"out": joined.T @ error, "bias": error.sum(axis=0)}
        back = error @ self.w["out"].T
        dx = back[:, 2 * HIDDEN :].copy()
        for k, at in enumerate((place, from_end)):
            end, (steps, width) = "fb"[k], dense[k].shape[:2]
            dh_in = np.zeros((steps, width, HIDDEN))
            dh_in[at, page] = back[:, k * HIDDEN : (k + 1) * HIDDEN]
            da = np.empty((steps, width, 4 * HIDDEN))
            dh, dc, dw = np.zeros((width, HIDDEN)), np.zeros((width, HIDDEN)), np.zeros((HIDDEN, 4 * HIDDEN))
            for t in range(steps - 1, -1, -1):
                i, f, o, g, before, tc, h_before = read[k][t]
                dh = dh + dh_in[t]
                dc = dc + dh * o * (1 - tc * tc)
                da[t] = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
                dw += h_before.T @ da[t]
                dh, dc = da[t] @ self.w["h" + end].T, dc * f
            grad["h" + end] = dw
            grad["x" + end] = np.tensordot(dense[k], da, axes=([0, 1], [0, 1]))
            grad["c" + end] = da.sum(axis=(0, 1))
            dx += (da @ self.w["x" + end].T)[at, page]
        for name, low, high, ids, counts in (("paths", 0, PATH_SIZE, "path_ids", "path_counts"), ("words", PATH_SIZE, PATH_SIZE + WORD_SIZE, "word_ids", "word_counts")):
            all_ids, all_counts = (np.concatenate([getattr(q, c) for q in pages]) for c in (ids, counts))
            each = np.repeat(dx[:, low:high] / all_counts[:, None], all_counts, axis=0)
            grad[name] = np.stack([np.bincount(all_ids, weights=each[:, d], minlength=len(self.w[name])) for d in range(high - low)], axis=1)
        return float(loss), grad

    def fit(self, pages: int = TRAIN_PAGES, rounds: int = TRAIN_ROUNDS, seed: int = SEED) -> Labeller:
        """On pages that are made up anew each round, by Adam with a falling rate."""
        rng, paths, words = random.Random(seed), _Buckets(PATHS), _Buckets(WORDS)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step, last = 0, rounds * -(-pages // BATCH)
        for _ in range(rounds):
            made = [(b, y) for b, y in (generated_page(rng) for _ in range(pages)) if b]
            for at in range(0, len(made), BATCH):
                part = made[at : at + BATCH]
                labels = np.array([v for _, y in part for v in y], float)
                _, grad = self.gradients([Vectors(b, paths, words) for b, _ in part], labels)
                step += 1
                rate = RATE * (1 - step / (last + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grad.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.w[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
        return self


@lru_cache(maxsize=1)
def fitted() -> Labeller:
    return Labeller().fit()


def main_texts(model: Labeller, pages: list[str], paths: _Buckets, words: _Buckets) -> list[str]:
    """The main text of each page, labelled in batches of pages of like length."""
    blocks = [read_blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if blocks[k]), key=lambda k: len(blocks[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < MOST_PAGES and (end - at + 1) * len(blocks[order[end]]) <= MOST_BLOCKS:
            end += 1
        part = order[at:end]
        p = model.probabilities([Vectors(blocks[k], paths, words) for k in part])
        for k, mine in zip(part, np.split(p, np.cumsum([len(blocks[k]) for k in part])[:-1]), strict=True):
            out[k] = "\n\n".join(b.text for b, keep in zip(blocks[k], mine >= 0.5, strict=True) if keep)
        at = end
    return out


def extract(df: DataFrame, html: str = "html", model: Labeller | None = None) -> DataFrame:
    """``df`` with ``main_text`` and ``n_chars`` (its code points, long)."""
    held = df.sparkSession.sparkContext.broadcast((model or fitted()).w)
    names = [c for c in df.columns if c not in ("main_text", "n_chars")]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("main_text", T.StringType()), T.StructField("n_chars", T.LongType())])
    # The caller's columns travel in a struct, so that none can clash with ours.
    slim = df.select(F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0)).alias("rest"), F.col(f"`{html}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Labeller()
        network.w = held.value
        paths, words = _Buckets(PATHS), _Buckets(WORDS)
        for batch in batches:
            for part, pages in text_chunks(batch, "html"):
                texts = main_texts(network, [(p or b"").decode("utf-8", "replace") for p in pages], paths, words)
                yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["rest", "main_text", "n_chars"])

    moved = T.StructType([slim.schema["rest"], T.StructField("main_text", T.StringType()), T.StructField("n_chars", T.LongType())])
    found = map_arrow(slim, run, moved)
    return found.select(*[F.col("rest").getField(c).alias(c) for c in names], "main_text", "n_chars").to(schema)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(reader(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), "n_chars")
