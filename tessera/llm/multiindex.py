"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, and each half is quantised by a codebook of its own; a pair of codewords is
a cell. A query takes the cells in the order of the sum of its halves' inner products with the codewords
(both lists sorted, the next pair from a heap) until they hold the share of all vectors that the
calibration asks for, and reranks what is in them by the inner product of the whole vectors.

Codebooks and calibration come from a bounded sample (``SAMPLE`` vectors, those whose ids hash lowest; the share
is what ``RECALL`` of the sample's own neighbours need, with a margin; as many neighbours of a vector count as
are likely to be among its ``k`` in the whole table, one at least). Every vector is indexed. Cells are
packed into blocks of about ``BLOCK`` vectors, and a cell that holds more is cut by a hash of the id. Queries
come in blocks too, of neighbouring cells. A block of each meets in one task if one of the queries visits
one of the cells, and only the pairs of a query and a cell that it visits are scored there. So what is shuffled
and scored follows the share, which the data decide: vectors without clusters need a large one.

Defined results: a vector that is null, zero, of another length than most, or has a component that is null
or not finite takes no part, nor does a row without an id; of equal nearness, the smaller id comes first; rows
that repeat an id are candidates of their own, and one query; fewer candidates than asked for are all
returned; other columns are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ship import ship
from .common import map_arrow, materialize, reader

SAMPLE, SAMPLE_QUERIES = 12_000, 400
MOST_WORDS = 1024
#: Vectors in a cell, as long as there are fewer words than that.
IN_CELL = 8
RECALL, MARGIN = 0.95, 1.1
BLOCK, QUERY_BLOCK = 4096, 1024


@dataclass(frozen=True)
class Index:
    """Codebooks, the share of all vectors that a query looks at, and the cells' blocks."""

    first: np.ndarray
    second: np.ndarray
    share: float
    sizes: np.ndarray | None = None  # of the cells
    block: np.ndarray | None = None  # a cell's first block
    cuts: np.ndarray | None = None  # and their number

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        near = lambda v, c: ((c * c).sum(1) - 2 * v @ c.T).argmin(1)
        return near(x[:, : self.half], self.first) * len(self.second) + near(x[:, self.half :], self.second)

    def visit(self, q: np.ndarray, least: int) -> list[int]:
        """Cells in the order of summed inner products until they hold at least ``least`` vectors."""
        a, b = self.first @ q[: self.half], self.second @ q[self.half :]
        one, two = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b, out, held = a[one].tolist(), b[two].tolist(), [], 0
        heap, width = [(-a[0] - b[0], 0, 0)], len(self.second)
        while heap and held < least:
            _, i, j = heapq.heappop(heap)
            cell = int(one[i]) * width + int(two[j])
            if self.sizes[cell]:
                out.append(cell)
                held += int(self.sizes[cell])
            # A pair comes in from its left neighbour; the first of a row also brings the next row's first.
            if j + 1 < len(b):
                heapq.heappush(heap, (-a[i] - b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-a[i + 1] - b[0], i + 1, 0))
        return out


def _codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    c = x[np.random.default_rng(11).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        many = np.bincount(of, minlength=len(c))[:, None]
        c = np.where(many > 0, sums / np.maximum(many, 1), c)
    return c


def train(sample: np.ndarray, total: int, k: int) -> Index:
    """Fit codebooks for ``total`` vectors on a sample, and the share that ``k`` neighbours need."""
    words = int(min(MOST_WORDS, max(2, round((total / IN_CELL) ** 0.5)), len(sample)))
    half = sample.shape[1] // 2
    index = Index(_codebook(sample[:, :half], words), _codebook(sample[:, half:], words), 1.0)
    if len(sample) <= 4 * k:
        return index
    cells = index.cells(sample)
    sizes = np.bincount(cells, minlength=len(index.first) * len(index.second))
    index = Index(index.first, index.second, 1.0, sizes)
    need, k = [], max(1, round(k * len(sample) / total))
    for i in np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int):
        score = sample @ sample[i]
        score[i] = -np.inf
        top = np.argpartition(-score, k)[:k]
        order = index.visit(sample[i], len(sample))
        seen = np.zeros(len(sizes))
        seen[order] = np.cumsum(sizes[order])
        need.append(seen[cells[top]] / len(sample))
    share = float(np.quantile(np.concatenate(need), RECALL))
    return Index(index.first, index.second, min(1.0, share * MARGIN))


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (an array of doubles), of vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where((F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["d"] if size else 0))


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def build(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Index | None]:
    """The index: a written table of ``id``, ``cell``, ``v``, and its codebooks."""
    rows = _valid(df, id_col, vector_col)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    total = rows.count()
    if not total:
        return rows.withColumn("cell", F.lit(0)), None
    index = train(_rows(picked.column("v").combine_chunks()), total, k)
    held = df.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = held.value.cells(_rows(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell, pa.int32()), batch.column("v")], names=["id", "cell", "v"])

    table = materialize(map_arrow(rows, assign, "id long, cell int, v array<double>"), "vectors")
    sizes = np.zeros(len(index.first) * len(index.second), np.int64)  # at most MOST_WORDS ** 2 cells
    for r in table.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    return table, Index(index.first, index.second, index.share, sizes, *_blocks(sizes, BLOCK))


def _blocks(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first block, and into how many it is cut; neighbouring cells share a block of ``most`` rows."""
    block, cuts, at, room = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most)), 0, most
    for c in np.flatnonzero(sizes):
        if cuts[c] > 1:
            at, room = at + (room < most), most
            block[c] = at
            at += int(cuts[c])
        else:
            if sizes[c] > room:
                at, room = at + 1, most
            block[c] = at
            room -= int(sizes[c])
    return block, cuts


def _best(q: np.ndarray, qid: np.ndarray, visited: list[np.ndarray], v: np.ndarray, vid: np.ndarray, cell: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k nearest of a block's vectors for each query, among the cells that it visits."""
    order = np.argsort(cell, kind="stable")
    v, vid, cell = v[order], vid[order], cell[order]
    # Cell by cell, the queries that visit it.
    of, asked = np.repeat(np.arange(len(q)), [len(x) for x in visited]), np.concatenate(visited)
    by_cell = np.argsort(asked, kind="stable")
    of, asked = of[by_cell], asked[by_cell]
    rough = np.full((len(q), len(v)), -np.inf)
    edges = np.append(np.flatnonzero(np.diff(asked, prepend=-1)), len(asked))
    for begin, end in zip(edges, edges[1:], strict=False):
        a, b = np.searchsorted(cell, [asked[begin], asked[begin] + 1])
        rough[of[begin:end], a:b] = q[of[begin:end]] @ v[a:b].T
    ids, found, scores = [], [], []
    for i in range(len(q)):
        row = rough[i]
        row[vid == qid[i]] = -np.inf
        least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
        at = np.flatnonzero((row >= least - 1e-9 * max(1.0, abs(least))) & (row > -np.inf) if least > -np.inf else row > -np.inf)
        exact = (v[at] * q[i]).sum(1)  # the same sum for equal vectors, wherever they stand
        order = np.lexsort((vid[at], -exact))[:k]
        ids += [int(qid[i])] * len(order)
        found += vid[at][order].tolist()
        scores += exact[order].tolist()
    return ids, found, scores


def search(table: DataFrame, index: Index | None, queries: DataFrame, k: int) -> DataFrame:
    """``query_id`` long, ``rank`` int, ``vec_id`` long, ``score`` double: for each query (``id``, ``v``) the nearest found."""
    spark = table.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ship(spark)
    held = spark.sparkContext.broadcast(index)
    one = queries.groupBy("id").agg(F.min("v").alias("v"))
    least = max(k + 1, int(np.ceil(index.share * index.sizes.sum())))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.cells(_rows(batch.column("v"))), pa.int32())], names=["id", "v", "cell"])

    one = materialize(map_arrow(one, assign, "id long, v array<double>, cell int"), "queries")
    many = np.zeros(len(index.sizes), np.int64)
    for r in one.groupBy("cell").count().collect():  # at most MOST_WORDS ** 2 cells
        many[r["cell"]] = r["count"]
    blocks = spark.sparkContext.broadcast(_blocks(many, QUERY_BLOCK))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            rows, b, cells = [], [], []
            cell = np.asarray(batch.column("cell"))
            block, cuts = (x[cell] for x in blocks.value)
            qb = pa.array(block + (np.asarray(batch.column("hash")).astype(np.uint64) % cuts.astype(np.uint64)).astype(np.int64))
            for i, q in enumerate(_rows(batch.column("v"))):
                by: dict[int, list[int]] = {}
                for c in index.visit(q, least):
                    for cut in range(int(index.cuts[c])):
                        by.setdefault(int(index.block[c]) + cut, []).append(c)
                rows += [i] * len(by)
                b += list(by)
                cells += [np.array(x, "<i4").tobytes() for x in by.values()]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), qb.take(at), batch.column("id").take(at), batch.column("v").take(at), pa.array(cells, pa.binary())], names=["b", "qb", "id", "v", "cells"])

    asked = materialize(map_arrow(one.withColumn("hash", F.xxhash64("id")), visit, "b long, qb long, id long, v array<double>, cells binary"), "queries-asked")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            cell = np.asarray(batch.column("cell"))
            cut = np.asarray(batch.column("hash")).astype(np.uint64) % index.cuts[cell].astype(np.uint64)
            b = index.block[cell] + cut.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(b), *[batch.column(c) for c in ("id", "v", "cell")]], names=["b", "id", "v", "cell"])

    placed = map_arrow(table.withColumn("hash", F.xxhash64("id")), place, "b long, id long, v array<double>, cell int")
    meeting = asked.select(F.col("b").alias("block"), F.col("qb").alias("queries")).distinct()
    placed = placed.join(meeting, F.col("b") == F.col("block")).select("b", F.col("queries").alias("qb"), "id", "v", "cell")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        whole = lambda t, c: t.column(c).combine_chunks()
        visited = [np.frombuffer(x, "<i4") for x in left.column("cells").to_pylist()]
        out = _best(_rows(whole(left, "v")), np.asarray(left.column("id")), visited, _rows(whole(right, "v")), np.asarray(right.column("id")), np.asarray(right.column("cell")), k)
        return pa.table(dict(zip(schema.names, (pa.array(x, t) for x, t in zip(out, schema.types, strict=True)), strict=True)))

    found = asked.groupBy("b", "qb").cogroup(placed.groupBy("b", "qb")).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    table, index = build(reader(spark, sf_dir, "embeddings"), k)
    return search(table, index, table.where(F.col("id") % 20 == 0).select("id", "v"), k)
