"""Pretokens, words and pairs: the counts that training starts from.

Texts are strings, split in the JVM, or binary, of any bytes: those are split by arrays in Arrow batches, and pieces are binary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classes import classes, regex_class
from ..functions.pretok import pretokens, scanner
from ..plans.ship import ship
from ..plans.spread import spread

#: Words of more bytes don't take part in training.
MOST_BYTES = 15
#: Bytes that go through arrays together, about, and distinct words that a worker counts before it hands them on.
TOGETHER_BYTES, HELD_WORDS = 2 << 20, 300_000


def shown(piece: bytes) -> str:
    """Bytes with those that don't print as ``\\xNN``."""
    return "".join(chr(b) if 0x20 <= b < 0x7F else f"\\x{b:02x}" for b in piece)


def shown_column(piece: Column) -> Column:
    """``shown`` of a string or binary column, in the JVM."""
    each = F.regexp_extract_all(F.hex(piece), F.lit(".."), F.lit(0))
    return F.array_join(F.transform(each, lambda x: F.when(x.between("20", "7E"), F.decode(F.unhex(x), "UTF-8")).otherwise(F.concat(F.lit("\\x"), F.lower(x)))), "")


def is_binary(df: DataFrame, text: str) -> bool:
    return isinstance(df.schema[text].dataType, T.BinaryType)


def together(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """A batch's texts (empty for null) in stretches of about ``TOGETHER_BYTES``, with the row that each begins at."""
    start, size, docs = 0, 0, []
    for i, value in enumerate(batch.column(column)):
        docs.append(value.as_py() or b"")
        size += len(docs[-1])
        if size >= TOGETHER_BYTES:
            yield start, docs
            start, size, docs = i + 1, 0, []
    if docs:
        yield start, docs


def with_pretokens(df: DataFrame, text: str = "text", out: str = "pieces") -> DataFrame:
    return df.withColumn(out, pretokens(df.sparkSession, F.col(text)))


def explode_pretokens(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``pos`` from 0, ``piece``: a row for each pretoken. No shuffle."""
    spark = df.sparkSession
    slim = spread(df.select(id_col, text))
    if not is_binary(df, text):
        return slim.select(F.col(id_col), F.posexplode(pretokens(spark, F.col(text))).alias("pos", "piece"))
    ship(spark)
    known = classes(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs in together(batch, 1):
                pieces, counts = scanner(known).split(docs)
                at = np.repeat(np.arange(len(docs)), counts)
                pos = np.arange(len(pieces)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start + at)), pa.array(pos.astype(np.int32)), pa.array(pieces, pa.binary())], names=[id_col, "pos", "piece"])

    return slim.mapInArrow(run, T.StructType([df.schema[id_col], T.StructField("pos", T.IntegerType()), T.StructField("piece", T.BinaryType())]))


def word_count(df: DataFrame, text: str = "text", most_bytes: int | None = None) -> DataFrame:
    """``piece``, ``n``: distinct pretokens with their numbers. Counted before the shuffle."""
    spark, slim = df.sparkSession, spread(df.select(text))
    if is_binary(df, text):
        return _byte_words(slim, most_bytes).groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = slim.select(F.explode(pretokens(spark, F.col(text))).alias("piece"))
    if most_bytes is not None:
        pieces = pieces.where(F.octet_length("piece").between(1, most_bytes))
    return pieces.groupBy("piece").agg(F.count("*").alias("n"))


def distinct_pieces(df: DataFrame, text: str = "text") -> DataFrame:
    """``piece`` binary, each once, dealt to all cores; told apart within each worker before the one shuffle. ``df`` isn't spread."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return _byte_words(df.select(F.col(text).cast("binary").alias(text)), None).select("piece").repartition(tasks, "piece").distinct()


def _byte_words(slim: DataFrame, most_bytes: int | None) -> DataFrame:
    """``piece``, ``n`` of a binary column, combined within each worker."""
    ship(slim.sparkSession)
    known = classes(slim.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["piece", "n"])
            held.clear()
            return out

        for batch in batches:
            for _, docs in together(batch, 0):
                pieces, number, _ = scanner(known).distinct(docs)
                for piece, n in zip(pieces, np.bincount(number, minlength=len(pieces)).tolist(), strict=True):
                    if most_bytes is None or len(piece) <= most_bytes:
                        held[piece] += n
                if len(held) > HELD_WORDS:
                    yield rows()
        if held:
            yield rows()

    return slim.mapInArrow(run, "piece binary, n long")


def word_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """One row over words of up to 15 bytes: ``total``, ``distinct_words``, ``singletons``, ``suggested_vocab``."""
    words = word_count(df, text, MOST_BYTES)
    return words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.count("*").alias("distinct_words"),
        F.count_if(F.col("n") == 1).alias("singletons"), (F.count("*") + 256).alias("suggested_vocab"),
    )


def class_of(spark: SparkSession, piece: Column) -> Column:
    """The class of a pretoken by its first character that isn't the leading space."""
    c, core = classes(spark), F.regexp_replace(piece, "^ (?=.)", "")
    return (
        F.when(piece.rlike("^'(?:[stmd]|re|ve|ll)$"), "contraction").when(core.rlike(rf"^[\p{{L}}{regex_class(c.more_letters)}]"), "letter")
        .when(core.rlike(rf"^[\p{{N}}{regex_class(c.more_numbers)}]"), "number").when(core.rlike(f"^[{regex_class(c.spaces)}]"), "space").otherwise("other")
    )


def pair_count(df: DataFrame, text: str = "text") -> DataFrame:
    """Pairs of neighbouring bytes over the words of up to 15 bytes.

    Distinct words are few bytes but many pairs, so they are dealt to every core. A pair stays four hex
    digits until it is counted.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = word_count(df, text, MOST_BYTES).repartition(tasks).select("n", F.hex("piece").alias("h")).where(F.length("h") > 2)
    places = F.sequence(F.lit(1), F.length("h") - 3, F.lit(2))
    pairs = words.select("n", F.explode(F.transform(places, lambda i: F.substring(F.col("h"), i, F.lit(4)))).alias("p"))
    number = lambda at: F.conv(F.substring("p", at, 2), 16, 10).cast("long")
    return pairs.groupBy("p").agg(F.sum("n").cast("long").alias("n")).select(number(1).alias("a"), number(3).alias("b"), "n")


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k most frequent pairs that come twice at least; ties by the lower symbols."""
    return pairs.where("n >= 2").orderBy(F.desc("n"), "a", "b").limit(k)


def corpus_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: ``docs``, ``bytes``."""
    return df.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"))
