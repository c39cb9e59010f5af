"""Corpora as DataFrames: newline-separated text, hex lines, nested JSON, whole files, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checkpoints import Written


def split_newlines(df: DataFrame, text: str = "text", keep_empty: bool = True) -> DataFrame:
    """Each text's lines as documents, with ``line_no``: n newlines make n + 1 lines, carriage returns stay.

    ``keep_empty=False`` leaves empty lines out (the numbers stay those of all lines).
    """
    rest = [c for c in df.columns if c not in (text, "line_no")]
    out = df.select(*rest, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", text))
    return out if keep_empty else out.where(F.length(text) > 0)


#: Rows of the table of splits up to which it is broadcast; beyond, lines are shuffled to their splits.
MOST_SPLITS = 100_000
_BOM = b"\xef\xbb\xbf"


def read_documents(spark: SparkSession, path: str, last_empty: bool = True) -> DataFrame:
    """A document for each stretch between newlines: ``doc_id`` from 0 in the order of file names and places, ``file``, ``content`` binary.

    Any bytes; n newlines of a file make n + 1 documents, so an empty file makes one; ``last_empty=False`` leaves an empty one
    after a file's last newline out, and those of empty files, as reading line by line does. Files are read in splits by
    Spark's own reader, from any store. Lines are counted by split first; a line's number is its split's sum of the
    lines before and its place in the split. The reader takes a byte order mark at the beginning of a file away and
    tells nothing of a last empty line: both follow from a file's size and the bytes of its lines.
    """
    reader = spark.read.option("lineSep", "\n").text(path)
    every = spark.createDataFrame([(f,) for f in reader.inputFiles()], "file string")
    at = {"file": F.input_file_name(), "at": F.col("_metadata.file_block_start"), "size": F.col("_metadata.file_size")}
    lines = reader.select(F.col("value").cast("binary").alias("content"), *[c.alias(n) for n, c in at.items()], F.monotonically_increasing_id().alias("row"))
    found = lines.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.sum(F.octet_length("content").cast("long") + 1).alias("bytes"), F.max("size").alias("size"))
    splits = Written(found, "corpus-splits").rows
    files = splits.groupBy("file").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
    mark = F.col("bytes") < F.col("size")  # three bytes short
    whole = F.col("bytes") + F.when(mark, len(_BOM)).otherwise(0)
    empty = F.col("n").isNull() | (whole == F.col("size"))
    # A file that is a mark alone has no lines.
    alone = spark.read.format("binaryFile").load(path).where(F.col("length") <= len(_BOM)).where(F.col("content") == _BOM).select(F.input_file_name().alias("file"), F.lit(True).alias("alone"))
    files = every.join(files, "file", "left").join(alone, "file", "left")
    files = files.select("file", F.coalesce("n", F.lit(0)).alias("n"), empty.alias("empty"), F.coalesce(mark, F.lit(False)).alias("mark"), F.when(F.col("alone") & F.col("n").isNull(), F.lit(_BOM)).otherwise(F.lit(b"")).alias("last"))
    documents = F.col("n") + (F.col("empty").cast("long") if last_empty else 0)
    # One row a file: names and sums, which Spark's own listing holds on the driver too.
    before = F.sum(documents).over(Window.orderBy("file")) - documents
    files = Written(files.withColumn("before", before), "corpus-files").rows
    inside = F.sum("n").over(Window.partitionBy("file").orderBy("at")) - F.col("n")
    starts = splits.join(files.select("file", "before", "mark"), "file").select("file", "at", (F.col("before") + inside - F.col("first")).alias("shift"), (F.col("mark") & (F.col("at") == 0)).alias("mark"), F.col("first").alias("head"))
    placed = lines.join(F.broadcast(starts) if splits.count() <= MOST_SPLITS else starts, ["file", "at"])
    content = F.when(F.col("mark") & (F.col("row") == F.col("head")), F.concat(F.lit(_BOM), "content")).otherwise(F.col("content"))
    out = placed.select((F.col("row") + F.col("shift")).alias("doc_id"), "file", content.alias("content"))
    if not last_empty:
        return out
    return out.unionByName(files.where("empty").select((F.col("before") + F.col("n")).alias("doc_id"), "file", F.col("last").alias("content")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: ``path``, ``content`` binary. Any bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def unhex_strict(line: Column) -> Column:
    """Bytes of a hex line, white space ignored; null for an odd number of digits or another character."""
    digits = F.regexp_replace(line, r"\s", "")
    return F.when(digits.rlike("^(?:[0-9a-fA-F]{2})*$"), F.unhex(digits))


def unhex_lenient(line: Column) -> Column:
    """Bytes of the hex digits in a line; other characters are skipped, an odd last digit is dropped."""
    digits = F.regexp_replace(line, "[^0-9a-fA-F]", "")
    return F.unhex(F.substring(digits, F.lit(1), (F.floor(F.length(digits) / 2) * 2).cast("int")))


def read_hex_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A document a line in hex: ``doc_id`` from 0, ``file``, ``content`` binary and ``status`` ('ok' or 'bad_hex')."""
    lines = read_documents(spark, path, last_empty=False)
    return lines.withColumn("content", unhex_strict(F.col("content").cast("string"))).withColumn("status", F.when(F.col("content").isNull(), "bad_hex").otherwise("ok"))


def flatten_nested(df: DataFrame, json: str = "json", name: str = "name") -> DataFrame:
    """``{book: {chapter: {verse: text}}}`` documents to ``name``, ``book``, ``chapter``, ``verse``, ``text``, ``line``.

    Levels that aren't objects are skipped. ``line`` is ``name|book|chapter|verse<TAB>text``.
    """
    level = T.MapType(T.StringType(), T.StringType())
    down = lambda d, c, key, kept: d.select(*kept, F.explode(F.from_json(F.col(c), level)).alias(key, "_v"))
    books = down(df, json, "book", [F.col(name).alias("name")])
    chapters = down(books, "_v", "chapter", ["name", "book"])
    verses = down(chapters, "_v", "verse", ["name", "book", "chapter"]).withColumnRenamed("_v", "text")
    return verses.withColumn("line", F.concat(F.concat_ws("|", "name", "book", "chapter", "verse"), F.lit("\t"), F.col("text")))


def manifest(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """For each group its documents and bytes."""
    return df.groupBy(group).agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"))


def manifest_totals(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """``manifest`` with a row for all groups together: ``total`` true, ``group`` null. From one pass."""
    sizes = df.select(F.col(group).alias("group"), F.octet_length(text).alias("size"))
    sums = [F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes")]
    return sizes.rollup("group").agg(*sums, (F.grouping("group") == 1).alias("total"))


def manifest_json(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """One row, ``json``: documents and bytes in all, and of each group by its name. ``group`` is a file name or the like: few for their size."""
    rows = manifest_totals(df, group, text)
    each = F.collect_list(F.when(~F.col("total"), F.struct(F.coalesce("group", F.lit("")), F.struct("bytes", "docs"))))
    all_of = lambda c: F.coalesce(F.max(F.when(F.col("total"), F.col(c))), F.lit(0)).alias(c)
    summed = rows.agg(all_of("bytes"), all_of("docs"), F.count_if(~F.col("total")).alias("groups"), F.map_from_entries(F.array_sort(each)).alias("per_group"))
    return summed.select(F.to_json(F.struct("bytes", "docs", "groups", "per_group")).alias("json"))
