"""Language identification by nearest centroid.

A text becomes a vector of hashed byte n-grams (one to three bytes of its lower-cased letters, everything
else a space), TF-IDF weighted and normalised. Each language has several centroids, found by spherical
k-means over a sample of its documents. The prediction is the language of the nearest centroid by cosine.
A text further from every centroid than the limit distance is rejected. Limits come from the sample: short
texts are further from any centroid, so each language has a limit for each size (a power of two of different
n-grams), ``SLACK`` times a low quantile of the cosines of its own documents, thinned to that size.

The classifier is fitted on a bounded sample (``SAMPLE_PER_LANG`` documents of each language, those whose
ids hash lowest, ``SAMPLE_IN_ALL`` at most); prediction covers every whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0, and rejected; with no labelled
row at all every text is ``und``; repeated rows give repeated rows; other columns are kept, but for those that
``predict`` gives new values (``lang_pred``, ``score``, ``rejected``), and all by ``filter_known``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, map_arrow, reader, text_chunks, trim_memory

FEATURES = 1 << 13
SAMPLE_PER_LANG = 800
SAMPLE_IN_ALL = 20_000
CENTROIDS = 4
#: A text is rejected if its cosine with the nearest centroid is below this, whatever the limits of the sample.
LEAST_COSINE = 0.06
#: Limits are this part of this quantile, for sizes that at least so many documents of a language can be thinned to.
SLACK, QUANTILE, LEAST_DOCS = 0.4, 0.01, 20
#: Sizes below this have no limit of their own.
LEAST_SIZE = 16
STEP = 1 << 20
#: Letters, and numerals such as ½, which ``isalpha`` then leaves out.
_LIKELY_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _hashed(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - bits)


def ngram_counts(text: bytes) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text, made in steps of bounded size; None without a letter."""
    s = text.decode("utf-8")
    if not any(m[0].isalpha() for m in _LIKELY_LETTER.finditer(s)):
        return None
    data = b" " + b" ".join(s.lower().encode("utf-8").translate(_FOLD).split()) + b" "
    counts = np.zeros(FEATURES, np.int64)
    for start in range(0, len(data), STEP):
        b = np.frombuffer(data[max(0, start - 2) : start + STEP], np.uint8).astype(np.uint32)
        fresh = min(start, 2)  # bytes of the step before, for n-grams across the border
        two = b[:-1] << np.uint32(8) | b[1:]
        for order, codes in ((1, b[fresh:]), (2, two[max(0, fresh - 1) :] | np.uint32(1 << 24)), (3, two[:-1] << np.uint32(8) | b[2:])):
            counts += np.bincount(_hashed(codes + np.uint32(order << 25), 13), minlength=FEATURES)
    return counts


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    least: float = LEAST_COSINE
    limits: np.ndarray | None = None  # of each centroid and power of two of different n-grams

    def score(self, counts: np.ndarray | None) -> tuple[str, float, bool]:
        if counts is None or not len(self.langs):
            return "und", 0.0, True
        at = np.flatnonzero(counts)
        near = self.centroids[:, at] @ _weighed((at, counts[at]), self.idf)
        best = int(near.argmax())
        cosine = min(1.0, max(0.0, float(near[best])))
        limit = self.least if self.limits is None else max(self.least, float(self.limits[best, len(at).bit_length()]))
        return self.langs[best], cosine, cosine < limit


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the row nearest the mean and then from the farthest rows."""
    chosen = [int((x @ x.mean(0)).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        sums = np.stack([x[of == j].sum(0) if (of == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


Counted = tuple[np.ndarray, np.ndarray]  # the n-grams that a text has, and how often


def _weighed(row: Counted, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(row[1]).astype(np.float32) * idf[row[0]]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def _limits(rows: dict[str, list[Counted]], idf: np.ndarray, centroids: np.ndarray, of: list[str]) -> np.ndarray:
    """For each centroid and size, the limit of its language; sizes without enough documents have that of the next smaller one."""
    out = np.zeros((len(of), FEATURES.bit_length() + 1))
    owner, rng = np.array(of), np.random.default_rng(7)
    for lang in sorted(rows):
        own = np.ascontiguousarray(centroids[owner == lang])
        found: list[list[float]] = [[] for _ in range(out.shape[1])]
        for at, much in rows[lang]:
            whole, much, seen = at, much.astype(np.int64), set()
            while len(whole) >= LEAST_SIZE:
                size = len(whole).bit_length()
                if size not in seen:
                    seen.add(size)
                    found[size].append(float((own[:, whole] @ _weighed((whole, much), idf)).max()))
                much = rng.binomial(much, 0.5)
                whole, much = whole[much > 0], much[much > 0]
        limit = 0.0
        for size, cosines in enumerate(found):
            if len(cosines) >= LEAST_DOCS:
                limit = SLACK * float(np.quantile(cosines, QUANTILE))
            out[owner == lang, size] = limit
    return out


def fit_counts(langs: list[str], counts: list[Counted]) -> Model:
    """Fit on n-gram counts, those of each labelled document. Only one language's vectors are held whole at a time."""
    if not len(langs):
        return Model(np.ones(FEATURES, np.float32), np.zeros((0, FEATURES), np.float32), [])
    many = np.zeros(FEATURES, np.int64)
    rows: dict[str, list[Counted]] = {}
    for lang, row in zip(langs, counts, strict=True):
        many[row[0]] += 1
        rows.setdefault(lang, []).append(row)
    idf = np.log((1 + len(counts)) / (1 + many)).astype(np.float32) + 1
    found = []
    for lang in sorted(rows):
        x = np.zeros((len(rows[lang]), FEATURES), np.float32)
        for i, row in enumerate(rows[lang]):
            x[i, row[0]] = _weighed(row, idf)
        found.append((lang, _kmeans(x, CENTROIDS)))
    centroids, of = np.concatenate([c for _, c in found]), [lang for lang, c in found for _ in c]
    return Model(idf, centroids, of, limits=_limits(rows, idf, centroids, of))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_COSINE) -> Model:
    """Fit on a sample of the rows of ``df`` that have a language and a letter."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(SAMPLE_IN_ALL).collect()}
    if not sizes:
        return fit_counts([], [])
    most = max(1, min(SAMPLE_PER_LANG, SAMPLE_IN_ALL // len(sizes)))
    # Only ids that hash low are ranked at all, about twice as many as are wanted.
    order = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).cast("string"))
    share = F.lit(1.0)
    for n in sorted(set(sizes.values())):
        if n > 2 * most:
            share = F.when(F.col(lang_col).isin([k for k, v in sizes.items() if v == n]), F.lit(2.0 * most / n)).otherwise(share)
    low = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), order.alias("_order"), share.alias("_share"))
    low = low.where((F.col("_order").cast("double") / 2.0**64 + 0.5) <= F.col("_share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, "text"):
                found = [ngram_counts(t) for t in texts]
                at = [np.flatnonzero(c).astype("<u2").tobytes() if c is not None else None for c in found]
                much = [c[c > 0].astype("<u4").tobytes() if c is not None else None for c in found]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("_order"), pa.array(at, pa.binary()), pa.array(much, pa.binary())], names=["lang", "_order", "at", "much"])

    made = map_arrow(low, count, "lang string, _order long, at binary, much binary").where("at is not null")
    ranked = made.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_order", "at")))
    sample = ranked.where(F.col("_rank") <= most).orderBy("lang", "_rank").select("lang", "at", "much").collect()
    counts = [(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["much"], "<u4")) for r in sample]
    model = fit_counts([r["lang"] for r in sample], counts)
    return Model(model.idf, model.centroids, model.langs, least, model.limits)


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` but the text, with ``lang_pred`` string, ``score`` double (cosine), ``rejected`` boolean."""
    held = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if f.name not in (text_col, "lang_pred", "score", "rejected")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                lang, score, rejected = zip(*[model.score(ngram_counts(t) if t is not None else None) for t in texts], strict=True)
                new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *new], names=[*[f.name for f in kept], "lang_pred", "score", "rejected"])

    return map_arrow(df, run, schema)


def filter_known(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the classifier does not reject, with all their columns. No shuffle."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                keep = [not model.score(ngram_counts(t) if t is not None else None)[2] for t in texts]
                yield part.filter(pa.array(keep, pa.bool_()))
        trim_memory()

    return map_arrow(df, run, df.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_of_id(id_col) % 3 == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reader(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
