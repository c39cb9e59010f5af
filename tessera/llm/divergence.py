"""Source divergence audit: how the terms of each source differ from those of every other source of its language.

A language keeps the terms that at least ``LEAST_DOCS`` of its documents hold. Every (language, source) group, and each
language as a whole, gives each kept term the share p = 1 + floor(10^9 (count + 1) / (N + V)). A group differs from another
by the sum of floor((p - q)^2 / q) over all kept terms, and by term from its language where p is above q.

Method. Workers count terms by group before the one large shuffle, by (language, term). Kept terms are dealt by a hash
to chunks of about ``CHUNK_TERMS``; a chunk's task holds its terms as a sorted array, finds occurrences' ids by
``searchsorted`` and sums them into a dense vector for each group by ``bincount``. Ids follow UTF-8 order, so ties among a
chunk's terms fall to the smaller id. A chunk needs the totals N and V of its language's groups, which are joined to
it; its sums for pairs and its best ``TOP_TERMS`` terms a group are added and ranked over all chunks. All arithmetic
is on integers; 10^9 (count + 1) is divided in three steps of 10^3, so counts up to 9 * 10^15 stay exact.

A frequent term is one row a source for each task of workers and is summed before anything is gathered, a chunk's rows are
bounded by its terms and sources, and groups are dense only ``GROUPS_AT_ONCE`` at a time. Nothing is broadcast or collected.

Defined results: null text, lang and source are ''; a group without terms counts 0 of each kept term; a language without
kept terms has pairs of value 0 and no terms; rows that repeat are each a document; an empty table gives no rows; a
term can be of any length. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ship import ship
from .common import map_arrow, materialize, reader, text_chunks

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE_STEPS = (1000, 1000, 1000)
#: Kept terms, and rows, of a chunk, about.
CHUNK_TERMS, CHUNK_ROWS = 8192, 400_000
GROUPS_AT_ONCE = 128
#: Distinct terms that a worker counts before it hands them on.
HELD_TERMS = 200_000
#: On bytes: characters beyond ASCII are whole in it, and ``bytes.lower`` changes A to Z alone.
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_PARTIAL = "lang string, source string, term binary, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, summed over a task's rows in parts of ``HELD_TERMS``."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            k = len(times)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(times.keys(), pa.binary()), pa.array(times.values(), pa.int64()), pa.array([docs[t] for t in times], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        for part, texts in text_chunks(batch, "text"):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), texts, strict=True):
                found = _TERM.findall((text or b"").lower())
                times, docs = held[lang, source]
                times.update(found)
                docs.update(set(found))
            if sum(len(t) for t, _ in held.values()) > HELD_TERMS:
                yield from rows()
    yield from rows()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang``, ``source``, ``term`` (UTF-8), ``n``, ``lead``: kept terms with their occurrences by group, over 0; ``lead`` is true of one row a term."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by term alone, which serves the sums by source and those over all sources.
    dealt = map_arrow(slim, _count, _PARTIAL).repartition(tasks, "lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    marked = summed.select("lang", "source", "term", "n", F.sum("docs").over(over).alias("in_docs"), (F.row_number().over(over.orderBy("source")) == 1).alias("lead"))
    return marked.where(F.col("in_docs") >= least_docs).drop("in_docs")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (counts + 1) / total), exact."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for scale in SCALE_STEPS:
        whole, rest = np.divmod(rest * scale, total)
        out = out * scale + whole
    return out + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _first(column: pa.ChunkedArray) -> object:
    return column[0].as_py() if len(column) else None


def _chunk(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
    """A chunk's part of every pair's sum, and the best terms of each group there."""
    lang = key[0].as_py()
    sources = np.array(groups.column("source").to_pylist(), object)
    order = np.argsort(sources)
    sources, totals = sources[order], groups.column("total").to_numpy()[order]
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
    if not rows.num_rows:
        terms = np.array([], object)
    else:
        found = np.array(rows.column("term").to_pylist(), object)
        terms = np.unique(found)
        ids = np.searchsorted(terms, found)
        of_group = np.searchsorted(sources, np.array(rows.column("source").to_pylist(), object))
        n = rows.column("n").to_numpy()
        by_group = np.argsort(of_group, kind="stable")
        starts = np.searchsorted(of_group[by_group], np.arange(len(sources) + 1))

    def vectors(low: int, high: int) -> np.ndarray:
        """Dense counts of groups ``low`` to ``high``, a row each."""
        own = by_group[starts[low] : starts[high]]
        halves = [np.bincount((of_group[own] - low) * len(terms) + ids[own], weights=part, minlength=(high - low) * len(terms)) for part in (n[own] >> 31, n[own] & (1 << 31) - 1)]
        return ((halves[0].astype(np.int64) << 31) + halves[1].astype(np.int64)).reshape(high - low, len(terms))

    blocks = [(a, min(a + GROUPS_AT_ONCE, len(sources))) for a in range(0, len(sources), GROUPS_AT_ONCE)]
    if len(terms):
        whole = np.zeros(len(terms), np.int64)
        for a, b in blocks:
            whole += vectors(a, b).sum(axis=0)
        language = shares(whole, np.int64(_first(groups.column("lang_total"))))
        for a, b in blocks:
            counts = vectors(a, b)
            p = shares(counts, totals[a:b, None])
            for i in range(b - a):
                above = np.flatnonzero((counts[i] > 0) & (p[i] > language))
                values = _apart(p[i][above], language[above])
                best = np.argsort(-values, kind="stable")[:TOP_TERMS]
                out["source"] += [sources[a + i]] * len(best)
                out["part"] += ["term"] * len(best)
                out["item"] += terms[above[best]].tolist()
                out["value"] += values[best].tolist()
            for c, d in blocks:
                q = p if a == c else shares(vectors(c, d), totals[c:d, None])
                for i in range(b - a):
                    sums = _apart(p[i], q).sum(axis=1)
                    others = [j for j in range(d - c) if a + i != c + j]
                    out["source"] += [sources[a + i]] * len(others)
                    out["part"] += ["pair"] * len(others)
                    out["item"] += [s.encode("utf-8") for s in sources[c:d][others]]
                    out["value"] += sums[others].tolist()
    k = len(out["value"])
    return pa.table({"lang": pa.array([lang] * k, pa.string()), "source": pa.array(out["source"], pa.string()), "part": pa.array(out["part"], pa.string()), "item": pa.array(out["item"], pa.binary()), "value": pa.array(out["value"], pa.int64())})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang``, ``source``, ``part`` ('pair' or 'term'), ``item``, ``value`` long, ``rank`` int; see the module."""
    ship(docs.sparkSession)
    kept = materialize(term_counts(docs, text_col, lang_col, source_col, least_docs), "divergence-terms")
    size = kept.agg(F.count("*").alias("rows"), F.count_if("lead").alias("terms")).first()
    chunks = max(1, -(-size["terms"] // CHUNK_TERMS), -(-size["rows"] // CHUNK_ROWS))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    # A row for each group, then for each group and chunk: as many as a chunk's own output for it at least.
    counted = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("lead").alias("v"))
    totals = groups.join(counted, ["lang", "source"], "left").na.fill(0, ["n", "v"])
    lang = Window.partitionBy("lang")
    terms = F.sum("v").over(lang)
    totals = totals.select("lang", "source", (F.col("n") + terms).alias("total"), (F.sum("n").over(lang) + terms).alias("lang_total"), terms.alias("v"))
    totals = materialize(totals, "divergence-groups")
    left = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("chunk"), "source", "term", "n")
    right = totals.where("v > 0").select("lang", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "source", "total", "lang_total")
    parts = left.groupBy("lang", "chunk").cogroup(right.groupBy("lang", "chunk")).applyInArrow(_chunk, "lang string, source string, part string, item binary, value long")
    parts = materialize(parts, "divergence-parts")
    other = totals.select("lang", F.col("source").alias("item"))
    none = totals.where("v = 0").select("lang", "source").join(other, "lang").where("source != item").select("lang", "source", F.col("item").cast("binary").alias("item"), F.lit(0).cast("long").alias("value"))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(none).withColumn("part", F.lit("pair"))
    ranked = pairs.unionByName(parts.where("part = 'term'"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = ranked.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
    return ranked.select("lang", "source", "part", F.decode("item", "UTF-8").alias("item"), "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(reader(spark, sf_dir, "documents"))


OP11_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
words AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM rows) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM words GROUP BY ALL HAVING sum(docs) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM rows),
totals AS (SELECT g.lang, g.source, coalesce(sum(w.n), 0) AS n FROM groups g LEFT JOIN (SELECT lang, source, w.n FROM words w SEMI JOIN kept USING (lang, term)) w USING (lang, source) GROUP BY ALL),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(w.n, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(w.n, 0) + 1)) // (g.n + s.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.n + 1)) // (s.n + s.v))::BIGINT AS q
  FROM totals g JOIN sizes s USING (lang) JOIN kept k USING (lang) LEFT JOIN words w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every)
WHERE part = 'pair' OR rank <= 200
"""
