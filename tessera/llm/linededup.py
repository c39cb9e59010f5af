"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an earlier line of the corpus (by document id, then line number) is equal, or is within one
edit of it: one character inserted, deleted or replaced. Lines are judged on the input, not on what is left, and
the bound is one edit for lines of every length.

Variants are hashed keys. Lines of equal length that differ in character i agree in the line without
character i; a line that has one character more than another agrees, without it, with the other. So
all lines under one key of the first kind are within one edit of each other, and under one of the second
kind every whole line is of every longer one: a key needs only the earliest line of either role, never its
pairs, and a group of any size costs as much as its rows. The earliest line found is verified by its edit distance.

Only variants that can meet are made. Lines within one edit agree outside one of any segments that they
are cut into. Keys of the halves, of all lines, leave the lines that share one with a different line;
keys of segments of about the root of the length, of those, leave the segments that hold the edit; and the
variants are made for the characters of those segments. Nothing is lost by this, and a line of n characters
costs n ** 1.5 and not n ** 2.

Defined results: null text stays null and has no lines; blank lines always stay; rows that agree in id and
text are one document; a null id comes before all others; other columns are kept by ``dedup``. Lines are
told apart by 128 bits of hash, and so are variants, so a key's earliest line is a partner of every line under it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, reader

#: Rows that may be broadcast (as long, 8 bytes each); beyond, joins shuffle.
MOST_BROADCAST = 500_000


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line: ``_id``, ``_row``, ``_no``, ``_line``, ``_n`` (characters), ``_h`` and ``_g`` (its hashes)."""
    rows = df.select(F.col(id_col).alias("_id"), _row_key(id_col, text_col).alias("_row"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_no", "_line"))
    return rows.withColumns({"_n": F.char_length("_line"), "_h": F.xxhash64("_line"), "_g": F.xxhash64(F.lit(1), F.col("_line"))})


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")) == ""


def _segment_keys(lines: DataFrame, size: Column) -> DataFrame:
    """A row for each segment that may hold an edit, in both roles (``_m`` is the shorter line's length): ``_key`` of the rest."""
    roles = lines.withColumn("_m", F.explode(F.array(F.col("_n"), F.col("_n") - 1))).where(F.col("_m") >= 1)
    cut = roles.withColumn("_size", size.cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_m") / F.col("_size")).cast("int") - 1)))
    before = F.col("_line").substr(F.lit(1), F.col("_j") * F.col("_size"))
    after = F.right("_line", F.greatest(F.lit(0), F.col("_m") - (F.col("_j") + 1) * F.col("_size")))
    return cut.withColumn("_key", F.xxhash64("_m", "_j", before, F.lit("\n"), after))


def _shared(keys: DataFrame) -> DataFrame:
    """Keys that different lines have."""
    both = keys.groupBy("_key").agg(F.min("_h").alias("_low"), F.max("_h").alias("_high"))
    return both.where(F.col("_low") != F.col("_high")).select("_key")


def _bounded(df: DataFrame) -> DataFrame:
    """Marks a written table of one or two longs for broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def near_lines(lines: DataFrame, first: DataFrame) -> DataFrame:
    """For each distinct line that has an earlier line within one edit: ``_h``, ``_g`` and ``_near``, the earliest's place.

    ``first`` holds each distinct line's first place (``_first``, a struct that orders as places do).
    """
    half = F.ceil(F.col("_m") / 2)
    halves = materialize(_segment_keys(lines, half).select("_key", "_h"), "line-half-keys")  # texts are cut once, and two longs of each read twice
    shared = _bounded(materialize(_shared(halves), "line-halves"))
    likely = materialize(halves.join(shared, "_key").select("_h").distinct(), "lines-likely")
    some = lines.select("_h", "_g", "_line", "_n").join(_bounded(likely), "_h", "left_semi").dropDuplicates(["_h", "_g"])
    some = materialize(some.join(first, ["_h", "_g"]), "lines-some")
    keys = _segment_keys(some, F.ceil(F.sqrt(F.col("_m")))).select("_key", "_h", "_g", "_m", "_j", "_size")
    hit = keys.join(_bounded(materialize(_shared(keys), "line-segments")), "_key", "left_semi").drop("_key")
    cut = hit.join(some, ["_h", "_g"])  # texts come in only here
    # The variants. Kind 1: without character i, lines of one length. Kind 2: the whole of the shorter line, and the longer without character i.
    longer = F.col("_m") < F.col("_n")
    last = F.least((F.col("_j") + 1) * F.col("_size"), F.col("_m")) - 1 + longer.cast("int")
    at = cut.withColumn("_i", F.explode(F.sequence(F.col("_j") * F.col("_size"), last)))
    without = F.concat(F.col("_line").substr(F.lit(1), F.col("_i")), F.col("_line").substr(F.col("_i") + 2, F.col("_n")))
    kept = ["_h", "_g", "_first"]
    hashes = lambda f: [f(0).alias("_key"), f(4).alias("_key2")]
    made = at.select(*kept, longer.alias("_longer"), *hashes(lambda k: F.when(longer, F.xxhash64(F.lit(2 + k), without)).otherwise(F.xxhash64(F.lit(1 + k), F.col("_i"), without))))
    whole = cut.where(~longer).select(*kept, F.lit(None).cast("boolean").alias("_longer"), *hashes(lambda k: F.xxhash64(F.lit(2 + k), F.col("_line"))))
    variants = materialize(made.unionByName(whole), "line-variants")
    # Most variants are one line's alone; half of their hash is enough to tell.
    variants = variants.join(_bounded(materialize(_shared(variants), "variants-shared")), "_key", "left_semi")
    # Roles under a key: same (false), longer (true), whole (null). The partner of "same" is "same", of the others each other.
    place = F.struct("_first", "_h", "_g")
    best = variants.groupBy("_key", "_key2").agg(
        F.min(F.when(~F.col("_longer"), place)).alias("_same"), F.min(F.when(F.col("_longer"), place)).alias("_long"), F.min(F.when(F.col("_longer").isNull(), place)).alias("_whole")
    )
    partner = F.when(F.col("_longer").isNull(), F.col("_long")).when(F.col("_longer"), F.col("_whole")).otherwise(F.col("_same"))
    found = variants.join(best, ["_key", "_key2"]).select("_h", "_g", "_first", partner.alias("_p")).where(F.col("_p").isNotNull() & (F.col("_p._first") < F.col("_first")))
    found = found.groupBy("_h", "_g").agg(F.min("_p").alias("_p")).select("_h", "_g", F.col("_p._first").alias("_near"), F.col("_p._h").alias("_ph"), F.col("_p._g").alias("_pg"))
    texts = some.select("_h", "_g", "_line")
    other = texts.select(F.col("_h").alias("_ph"), F.col("_g").alias("_pg"), F.col("_line").alias("_other"))
    checked = found.join(texts, ["_h", "_g"]).join(other, ["_ph", "_pg"])
    return checked.where(F.levenshtein("_line", "_other", 1).between(0, 1)).select("_h", "_g", "_near")


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with its lines' fates: ``_id``, ``_row``, ``_gone`` (an array of booleans by line number)."""
    lines = _lines(df, id_col, text_col)
    slim = materialize(lines.select("_id", "_row", "_no", "_h", "_g", _blank(F.col("_line")).alias("_blank")), "lines")
    place = F.struct("_id", "_no")
    first = slim.where(~F.col("_blank")).groupBy("_h", "_g").agg(F.min(place).alias("_first"))
    near = near_lines(lines.where(~_blank(F.col("_line"))), first)
    # What stays is the first occurrence of a line that has no earlier one near: one place a line. Lines find out by their
    # own places, not by their texts, so a line that a third of all documents hold is no group of its own.
    stay = first.join(near, ["_h", "_g"], "left_anti").select(F.col("_first._id").alias("_at"), F.col("_first._no").alias("_at_no"), F.col("_h").alias("_at_h"), F.col("_g").alias("_at_g"))
    found = F.col("_id").eqNullSafe(F.col("_at")) & (F.col("_no") == F.col("_at_no")) & (F.col("_h") == F.col("_at_h")) & (F.col("_g") == F.col("_at_g"))
    judged = slim.join(stay, found, "left").select("_id", "_row", "_no", (~F.col("_blank") & F.col("_at_h").isNull()).alias("_out"))
    # A set, as rows that agree in id and text say the same of each line.
    return judged.groupBy("_id", "_row").agg(F.array_sort(F.collect_set(F.struct("_no", "_out"))).alias("_all")).select("_id", "_row", F.col("_all._out").alias("_gone"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``df`` with the lines that go taken out of its text; ``counts`` adds ``n_lines`` and ``n_removed`` longs."""
    gone = removed_lines(df, id_col, text_col).select(F.col("_id").alias("_gone_id"), F.col("_row").alias("_gone_row"), "_gone")
    # The caller's columns travel in a struct, so that none can clash with ours.
    keyed = df.select(F.struct(*[F.col(c) for c in df.columns if c != text_col], F.lit(0)).alias("_rest"), F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), _row_key(id_col, text_col).alias("_row"))
    # By a shuffle at every size: the fates of all lines grow with the corpus.
    joined = keyed.join(gone.hint("merge"), (F.col("_row") == F.col("_gone_row")) & F.col("_id").eqNullSafe(F.col("_gone_id")), "left")
    pairs = F.arrays_zip(F.split(F.col("_text"), "\n", -1).alias("line"), F.col("_gone").alias("gone"))
    stay = F.transform(F.filter(pairs, lambda x: ~x["gone"]), lambda x: x["line"])
    names = [c for c in df.columns if not (counts and c in ("n_lines", "n_removed"))]
    columns = [F.array_join(stay, "\n").alias(c) if c == text_col else F.col("_rest").getField(c).alias(c) for c in names]
    if counts:
        n = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
        columns += [F.when(F.col("_gone").isNull(), 0).otherwise(n(F.col("_gone"))).cast("long").alias("n_lines")]
        columns += [F.when(F.col("_gone").isNull(), 0).otherwise(n(F.filter("_gone", lambda x: x))).cast("long").alias("n_removed")]
    return joined.select(*columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(reader(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
marked AS (
  SELECT *, trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    ')) = '' AS blank FROM lines),
firsts AS (
  SELECT line, length(line) AS n, min({'a': doc_id, 'b': no}) AS first FROM marked WHERE NOT blank GROUP BY line),
cut AS (
  SELECT line, first, n, i, substr(line, 1, i) || substr(line, i + 2) AS rest
  FROM (SELECT *, unnest(range(n)) AS i FROM firsts)),
same AS (
  SELECT line, min(first) OVER (PARTITION BY i, rest) AS near FROM cut),
longer AS (
  SELECT c.line AS long_line, c.first AS long_first, f.line AS whole, f.first AS whole_first
  FROM cut c JOIN firsts f ON f.line = c.rest),
bars AS (
  SELECT line, min(bar) AS bar FROM (
    SELECT line, first AS bar FROM firsts UNION ALL SELECT line, near FROM same
    UNION ALL SELECT long_line, whole_first FROM longer UNION ALL SELECT whole, long_first FROM longer) GROUP BY line),
judged AS (
  SELECT m.doc_id, m.no, m.line, NOT blank AND {'a': doc_id, 'b': no} > bar AS gone
  FROM marked m LEFT JOIN bars b ON m.line = b.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY no), '')) AS kept_sha256
FROM judged GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
