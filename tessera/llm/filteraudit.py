"""Filter interaction audit: what five filters remove together, in every order that they could stand in.

Every document is replayed through all 120 orders: its flags meet a broadcast table of the orders, its first
failing step in each is computed once, the five steps are exploded, and what happened at each step is counted by
conditional sums, combined before the shuffle. Nothing that grows with the corpus is broadcast or collected.

Failure conditions (``FILTERS``), words being maximal runs of ``[^\\x20\\x09-\\x0D]``:
A under 50 words; B fewer than 65 distinct words a hundred; C more than 5 of ``[A-Z]`` a hundred code points;
D any of ``#$%&*|``; E a document of smaller id has the same text, whether it is removed or not.

Columns, counted in documents of the part: ``kept`` after the step, ``removed`` at it, ``redundant`` (failing its
filter, removed earlier), ``unique_fails`` (failing its filter only), ``good_lost`` and ``toxic_lost`` (removed here,
labelled quality 1, toxic 1), ``shapley`` (removed by its filter over all 120 orders, at any step).

Texts meet by their SHA-256. A document is the first of its text if its id and text are among the (smallest id, text)
pairs, so copies are joined by their own ids and a text that a third of all rows share has no key of its own in a join.

Defined results: a null text is empty; a null source is the part ''; a document without a label loses nothing that is
good or toxic; of labels that come twice any with the value counts; rows that repeat are each a document, and of
rows with one id and text none is a copy of the other; a document with a null id is no copy, makes no copy and has no
label; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, reader

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_WORD = "[^\\x20\\x09-\\x0D]+"
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def _own_flags(text: Column, words: Column) -> dict[str, Column]:
    """The filters that need only the document."""
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long"),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each document: ``_id``, ``part``, and ``A`` to ``E``, true where the document fails the filter."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(source_col, F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(_WORD), F.lit(0)))
    own = _own_flags(F.col("_text"), F.col("_words"))
    rows = rows.select("_id", "part", F.unhex(F.sha2("_text", 256)).alias("_same"), *[c.alias(name) for name, c in own.items()])
    # Written, texts aside: texts are read once, and no later loop over orders can put off their expressions into it.
    rows = materialize(rows, "filter-flags")
    first = rows.where(F.col("_id").isNotNull()).groupBy("_same").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    return rows.join(first, ["_id", "_same"], "left").select("_id", "part", *own, (F.col("_id").isNotNull() & F.col("_first").isNull()).alias("E"))


def _with_labels(flagged: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    known = known.agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    joined = flagged.join(known, "_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_good", "_toxic")})


def replay(flagged: DataFrame) -> DataFrame:
    """The audit of documents with ``part``, flags ``A`` to ``E``, ``_good`` and ``_toxic``: a row for each part, order and step.

    A document's flags become five bits, and an order's steps are the bits of their filters.
    """
    spark = flagged.sparkSession
    places = [(number, order, *[1 << FILTERS.index(f) for f in order]) for number, order in enumerate(ORDERS)]
    orders = spark.createDataFrame(places, "_order int, filter_order string, " + ", ".join(f"_f{k} int" for k in range(1, 6)))
    bits = sum((F.col(f).cast("int") * (1 << k) for k, f in enumerate(FILTERS)), F.lit(0))
    slim = flagged.select("part", bits.cast("int").alias("_bits"), "_good", "_toxic")
    every = slim.crossJoin(F.broadcast(orders.drop("filter_order")))  # 120 rows, always
    fails = [F.col("_bits").bitwiseAND(F.col(f"_f{k}")) != 0 for k in range(1, 6)]
    first = F.lit(9)
    for k in range(5, 0, -1):
        first = F.when(fails[k - 1], k).otherwise(first)
    every = every.withColumn("_first", first)
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"_f{k}").alias("f")) for k in range(1, 6)]))
    each = every.select("part", "_order", "_bits", "_good", "_toxic", "_first", steps.alias("_s")).select("*", F.col("_s.step").alias("step"), F.col("_s.f").alias("_f"))
    here = F.col("_first") == F.col("step")
    failing = F.col("_bits").bitwiseAND(F.col("_f")) != 0
    counted = each.groupBy("part", "_order", "step", "_f").agg(
        F.count_if(F.col("_first") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(failing & (F.col("_first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("_bits") == F.col("_f")).alias("unique_fails"),
        F.count_if(here & F.col("_good")).alias("good_lost"),
        F.count_if(here & F.col("_toxic")).alias("toxic_lost"),
    )
    # From here on 600 rows a part.
    shapley = F.sum("removed").over(Window.partitionBy("part", "_f")).alias("shapley")
    named = counted.select("*", shapley).join(F.broadcast(orders.select("_order", "filter_order")), "_order")
    return named.select("part", "filter_order", "step", *_COUNTS, "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The filters' interaction for each source of ``docs``; ``labels`` has ``id_col``, ``quality`` and ``toxic``."""
    return replay(_with_labels(flags(docs, id_col, text_col, source_col), labels, id_col))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(reader(spark, sf_dir, "documents"), reader(spark, sf_dir, "labels"))


_BITS = " + ".join(f"(CASE WHEN {f} THEN {1 << k} ELSE 0 END)" for k, f in enumerate(FILTERS))
_ORDER_ROWS = ", ".join(f"('{o}', {k + 1}, {FILTERS.index(f)}, {sum(1 << FILTERS.index(x) for x in o[:k])})" for o in ORDERS for k, f in enumerate(o))

OP13_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
marked AS (
  SELECT doc_id, part, len(w) < 50 AS A, 100 * len(list_distinct(w)) < 65 * len(w) AS B,
         100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E FROM texts),
known AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
kinds AS (
  SELECT part, {_BITS} AS bits, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
  FROM marked LEFT JOIN known USING (doc_id) GROUP BY ALL),
orders(filter_order, step, f, earlier) AS (VALUES {_ORDER_ROWS}),
audit AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN bits & (earlier | (1 << f)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN bits & earlier = 0 AND bits & (1 << f) <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN bits & earlier <> 0 AND bits & (1 << f) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN bits = 1 << f THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN bits & earlier = 0 AND bits & (1 << f) <> 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN bits & earlier = 0 AND bits & (1 << f) <> 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
  FROM kinds CROSS JOIN orders GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM audit
"""
