"""Mixing sources to target weights, as a time-varying curriculum.

Each source has a target: its weight's share of all words, held to a multiple of the source's own size,
with the excess reshared by weight until no source is above (water filling, in closed form over the
sources sorted by the level at which they fill). A source also has a schedule, its weight over training
time. The integral of the schedule, scaled to the target, is the source's cumulative demand. A source's
documents stand in an order given by a hash of their id; repeats follow as further passes. The copy whose
middle word meets the demand at time t is trained at position t: the demand is inverted in closed form.
Range-sorting the copies by position gives the training order: ``mix`` sorts them without their texts, numbers
them (``places``) and gathers them by document; ``training_order`` sorts them with all of their columns.

Defined results: a null or empty text has size 0; a source without words takes nothing and has target 0;
a null source is a source of its own and comes last; repeated rows count separately (rows that tie are
interchangeable); a null id is hashed as an empty one; columns that only the input has are kept by
``training_order`` and dropped by ``mix``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize, reader, text_chunks

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A schedule for each of those: knots (time, weight factor), linear between, times from 0 to 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 0.8), (1.0, 2.0)))
CAP = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source_col: str, weights: Sequence[int], cap: int) -> DataFrame:
    """A row for each source: ``source_size``, ``target``, ``_turn`` (its place, modulo the weights).

    ``sizes`` has a row per source; the windows below run over that table alone.
    """
    by_name = Window.orderBy(F.col(source_col).asc_nulls_last())
    src = sizes.withColumn("_turn", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    src = src.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("_turn") + 1).cast("long"))
    src = src.withColumn("_full", F.lit(cap) * F.col("source_size")).withColumn("_level", F.col("_full").cast("double") / F.col("_w"))
    by_level = Window.orderBy("_level", F.col(source_col).asc_nulls_last())
    before = F.coalesce(F.sum("_full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    src = src.withColumn("_reach", (F.sum("source_size").over(everything) - before).cast("double") / rest)
    src = src.withColumn("_open", F.col("_level") > F.col("_reach"))
    water = F.max(F.when(F.col("_open"), F.col("_reach"))).over(everything)
    src = src.withColumn("target", F.when(F.col("_open"), F.col("_w") * water).otherwise(F.col("_full").cast("double")))
    return src.select(source_col, "source_size", "target", "_turn")


def _inverse(fraction: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a schedule's integral reaches a fraction of its whole."""
    area = [0.0]
    for (t0, v0), (t1, v1) in zip(knots, knots[1:], strict=False):
        area.append(area[-1] + (t1 - t0) * (v0 + v1) / 2)
    need = fraction * area[-1]
    out = F.lit(float(knots[-1][0]))
    for i in reversed(range(len(knots) - 1)):
        (t0, v0), (t1, v1) = knots[i], knots[i + 1]
        over, slope = F.greatest(need - area[i], F.lit(0.0)), (v1 - v0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(v0 * v0) + 2 * slope * over, F.lit(0.0)))
        step = F.when(over <= 0, F.lit(0.0)).otherwise(2 * over / (v0 + root))
        out = F.when(need <= area[i + 1], F.lit(t0) + step).otherwise(out)
    return out


def _placed(df: DataFrame, slim: DataFrame, weights, schedules, cap: int, digits: int) -> DataFrame:
    """df (with ``_id``, ``_source``, ``_size``) and each row's ``_source_size``, ``_target``, ``_copies``, ``_taken``, ``_positions``.

    The order inside a source is by md5 of the id. Its first ``digits`` hex digits cut a source into
    parts, so that a source with most of the rows is still ordered and summed in many tasks; part sums
    are aggregated first and accumulated in a table of (source, part). Rows that tie go by ``_row``, if there is one.
    """
    part = lambda d: d.withColumn("_hash", F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary"))).withColumn("_part", F.substring("_hash", 1, digits))
    parts = part(slim).groupBy("_source", "_part").agg(F.sum("_size").alias("_sum"))
    so_far = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(so_far), F.lit(0)).alias("_offset"))
    src = targets(slim.groupBy("_source").agg(F.sum("_size").alias("source_size")), "_source", weights, cap)
    src = src.select(F.col("_source").alias("_s2"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_turn")
    offsets = offsets.join(src, F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2")
    within = Window.partitionBy("_source", "_part").orderBy("_hash", "_id", "_size", *[c for c in df.columns if c == "_row"]).rowsBetween(Window.unboundedPreceding, -1)
    rows = part(df).withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    rows = rows.join(offsets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    # A copy is taken if its middle lies within the target.
    middle = 2 * (F.col("_offset") + F.col("_within")) + F.col("_size")
    last = F.floor((2 * F.col("_target") - middle) / (2 * F.col("_source_size")))
    rows = rows.withColumn("_copies", F.when(F.col("_source_size") > 0, F.greatest(F.lit(0), F.least(F.lit(cap), last + 1))).otherwise(0).cast("int"))
    fraction = lambda k: F.least(F.lit(1.0), (middle / 2 + k * F.col("_source_size")) / F.col("_target"))
    at = lambda k: F.coalesce(*[F.when(F.col("_turn") == i, _inverse(fraction(k), s)) for i, s in enumerate(schedules)])
    copies = F.filter(F.array(*[F.when(F.col("_copies") > k, at(F.lit(k))) for k in range(cap)]), lambda x: x.isNotNull())
    return rows.withColumn("_positions", copies).withColumn("_taken", F.col("_copies") * F.col("_size"))


def mix(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Sequence[int] = WEIGHTS, schedules=SCHEDULES, cap: int = CAP, digits: int = 3,
) -> DataFrame:
    """What the mix takes of each document: id, source, ``size``, ``source_size``, ``target``, ``copies``, ``taken``, ``positions``, ``places``.

    ``places`` are the copies' numbers in the training order, from 0. The text is read once, for the sizes, which
    are written; nothing else is shuffled but those.
    """
    sizes = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size_of(F.col(text_col)).alias("_size"), F.monotonically_increasing_id().alias("_row"))
    slim = materialize(sizes, "mix-sizes")
    copies = _numbered(_placed(slim, slim, weights, schedules, cap, digits))
    kept = ["_id", "_source", "_size", "_source_size", "_target"]
    out = copies.groupBy("_row").agg(*[F.first(c).alias(c) for c in kept], F.count("_at").cast("int").alias("_copies"), F.sort_array(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_place")))).alias("_all"))
    out = out.withColumn("_taken", F.col("_copies") * F.col("_size")).withColumn("_positions", F.col("_all._at")).withColumn("_places", F.col("_all._place"))
    names = ("size", "source_size", "target", "copies", "taken", "positions", "places")
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), *[F.col(f"_{n}").alias(n) for n in names])


def _numbered(rows: DataFrame) -> DataFrame:
    """A row for each copy, range-sorted by position, with ``_at`` and its number ``_place``; documents without copies have one row, last, with nulls.

    The sorted copies are written with their partition and their place in it; the partitions' counts, a
    row each, are accumulated to the partitions' first numbers.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_at").asc_nulls_last(), F.col("_hash"), F.col("_row")]
    rows = rows.select("_row", "_id", "_source", "_size", "_source_size", "_target", "_hash", F.explode_outer("_positions").alias("_at"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_hash")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialize(rows.withColumn("_in", F.spark_partition_id()).withColumn("_nth", inside), "mix-order")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("_in").alias("_p")).agg(F.count(F.lit(1)).alias("_many"))
    firsts = counts.select("_p", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_first"))
    rows = rows.join(F.broadcast(firsts), F.col("_in") == F.col("_p"))
    return rows.withColumn("_place", F.when(F.col("_at").isNotNull(), F.col("_first") + F.col("_nth")))


def _packed(rows: DataFrame, pack: bool) -> DataFrame:
    """``_text`` compressed, row by row, or as it was. The text is shuffled twice, by part and by position."""
    schema = T.StructType([T.StructField("_text", T.BinaryType() if pack else T.StringType()) if f.name == "_text" else f for f in rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = zstandard.ZstdCompressor(level=3).compress if pack else zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part, texts in text_chunks(batch, "_text"):
                made = pa.array([None if t is None else change(t) for t in texts], pa.binary())
                made = made if pack else made.cast(pa.string())
                yield pa.RecordBatch.from_arrays([made if c == "_text" else part.column(c) for c in part.schema.names], names=part.schema.names)

    return map_arrow(rows, run, schema)


def training_order(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Sequence[int] = WEIGHTS, schedules=SCHEDULES, cap: int = CAP, digits: int = 3,
) -> DataFrame:
    """The rows of ``df`` with its own columns, each as often as the mix takes it, range-sorted by training position.

    The caller's columns travel in a struct, so that none can clash with ours, and the text compressed.
    """
    ours = [F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size_of(F.col(text_col)).alias("_size")]
    slim = materialize(df.select(*ours), "mix-sizes")
    rest = F.struct(*[F.col(c) for c in df.columns if c != text_col])
    rows = _placed(_packed(df.select(*ours, F.col(text_col).alias("_text"), rest.alias("_rest")), True), slim, weights, schedules, cap, digits)
    rows = rows.select("_rest", "_text", F.explode("_positions").alias("_at"), "_hash")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "_at", "_hash").sortWithinPartitions("_at", "_hash").select("_rest", "_text")
    return _packed(rows, False).select(*[F.col("_text").alias(c) if c == text_col else F.col("_rest").getField(c).alias(c) for c in df.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(reader(spark, sf_dir, "documents"))
    first = F.when(F.size("positions") > 0, F.round(F.element_at("positions", 1), 9))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", first.alias("position"))


def _inverse_sql(knots: Sequence[tuple[float, float]]) -> str:
    area, arms = 0.0, []
    whole = math.fsum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    for (t0, v0), (t1, v1) in zip(knots, knots[1:], strict=False):
        slope, over = (v1 - v0) / (t1 - t0), f"greatest(c * {whole!r} - {area!r}, 0.0)"
        area += (t1 - t0) * (v0 + v1) / 2
        arms.append(f"WHEN c * {whole!r} <= {area!r} THEN {t0!r} + CASE WHEN {over} <= 0 THEN 0.0 ELSE 2 * {over} / ({v0!r} + sqrt(greatest({v0 * v0!r} + {2 * slope!r} * {over}, 0.0))) END")
    return f"CASE {' '.join(arms)} ELSE {float(knots[-1][0])!r} END"


OP1_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS turn
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE turn {' '.join(f'WHEN {i} THEN {w}' for i, w in enumerate(WEIGHTS))} END::BIGINT AS w FROM src),
levels AS (
  SELECT *, ({CAP} * source_size)::DOUBLE / w AS level FROM weighted),
reached AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum({CAP} * source_size) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
            / (sum(w) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS reach
  FROM levels),
targets AS (
  SELECT source, source_size, turn,
         CASE WHEN level > reach THEN w * max(CASE WHEN level > reach THEN reach END) OVER () ELSE ({CAP} * source_size)::DOUBLE END AS target
  FROM reached),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.turn,
         (2 * coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size)::BIGINT AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, CASE WHEN source_size > 0 THEN greatest(0, least({CAP}, floor((2 * target - middle) / (2 * source_size)) + 1)) ELSE 0 END::INTEGER AS copies,
         least(1.0, middle / 2 / target) AS c
  FROM placed)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies,
       CASE WHEN copies > 0 THEN round(CASE turn {' '.join(f'WHEN {i} THEN {_inverse_sql(s)}' for i, s in enumerate(SCHEDULES))} END, 9) END AS position
FROM counted
"""
