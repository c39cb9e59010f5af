"""Writing documents' ids as text, a line a document in the order of ``doc_id``, with the run's figures from the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.encode import encode, ids_text
from ..plans.model import BpeModel


def write_ids(docs: DataFrame, model: BpeModel, path: str | None, text: str = "text") -> dict[str, int]:
    """Encodes ``docs`` (``doc_id``, a text of any bytes; null: input that couldn't be read) into text files in the folder ``path``.

    Files in the order of their names have the lines in the order of ``doc_id``: ids with spaces between, an empty line
    for an empty document, ``ERR`` and a code for one without ids. Documents are dealt by ranges of ``doc_id`` before they
    are encoded, so ids are neither shuffled nor computed twice. Returns ``docs``, ``bytes``, ``tokens``,
    ``checksum``, ``misses`` and ``bad``, observed while the lines are written; without a path nothing is written.
    """
    read, made = Observation("read"), Observation("made")
    slim = docs.select("doc_id", F.col(text).cast("binary").alias("text"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    if path is not None:
        slim = slim.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id")
    slim = slim.observe(read, F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.col("text").isNull()).alias("bad"))
    encoded = encode(slim, model, in_order=path is not None)
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    ids = lambda c: F.coalesce(F.sum(F.when(F.col("ids").isNotNull(), c)), F.lit(0)).cast("long")
    encoded = encoded.observe(made, F.count("*").alias("docs"), ids(F.size("ids")).alias("tokens"), ids(total).alias("checksum"), F.count_if(F.col("status") == "vocab_miss").alias("misses"))
    if path is None:
        encoded.write.format("noop").mode("overwrite").save()
    else:
        bad = F.col("ids").isNull() & (F.col("status") == "ok")
        lines = ids_text(encoded.withColumn("status", F.when(bad, "bad_input").otherwise(F.col("status"))))
        lines.select(F.col("line").alias("value")).write.text(path, lineSep="\n")
    return read.get | made.get
