"""Streams of lines: the same stateless projections on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pretok import pretokens
from ..operators.encode import encode
from ..plans.model import BpeModel


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of new files in a folder: ``text`` and ``file``."""
    return spark.readStream.option("lineSep", "\n").text(path).select(F.col("value").alias("text"), F.input_file_name().alias("file"))


def pretoken_stream(lines: DataFrame) -> DataFrame:
    """Lines with their pretokens. Stateless."""
    return lines.withColumn("pieces", pretokens(lines.sparkSession, F.col("text")))


def encode_stream(lines: DataFrame, model: BpeModel) -> DataFrame:
    """``text``, ``ids``, ``status`` for each line. Stateless."""
    return encode(lines.withColumn("_line", F.col("text")), model, id_col="_line", text="text").withColumnRenamed("_line", "text")
