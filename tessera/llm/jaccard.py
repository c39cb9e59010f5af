"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents link when their sets of word shingles have a Jaccard similarity of at least ``PERCENT`` / 100. The
join is exact, up to 64-bit hashes:

1. Each set's shingles below a hash level are dealt to buckets by hash, packed in blobs; a bucket finds those
   that several documents have, with their number. A pair of n and m shingles misses at most n - ceil(0.8 n)
   of n, so a level that is passed by more than that many decides as well as the whole set. Small sets
   are dealt whole, and all are if one should have too few below its level; each band of sizes has a
   level, and sizes near a border belong to both bands.
2. A set's prefix holds its rarest shingles: n - ceil(0.8 n) + l of them, and a pair must share l of both
   prefixes (of the smaller set's first n - ceil(8 / 9 n) + l even, and more the closer their sizes are). l is chosen for each document by the cost that its shingles' numbers let expect: common ones
   make a longer prefix with more matches cheaper than verifying what one match would bring.
3. Rounds pair each document of a shingle's group with a few heads of the group, rows per document and not per
   pair, verify, and join what links into components. The result is the components, so a link inside one
   needs no test.
4. A large group that still holds several components gets a pivot, with which all of its sets are compared. Sets
   that share x with the pivot and need more than that to link share a shingle that the pivot lacks: they
   are sought by those, which few sets have, and leave the group. The rest are paired; pairs that share l, and
   whose places in both prefixes leave room for a link, are verified.

Equal sets are one set throughout. A shingle that very many documents of one blob have is marked as hot there
and isn't gathered: every document treats it as the most common. Sets are told apart by 128 bits.

Defined results: null and empty texts, and texts without words, have no shingles and link with nothing; a
text of fewer than five words is one shingle; a null id takes part, counts as larger than any other and is
the component's id only where there is no other; rows that repeat an id are rows of their own, in
``representatives`` too, which keeps one row a component and all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, group_arrow, map_arrow, materialize, reader, release, text_chunks
from .components import components
from .shingles import mix64, shingle_hashes

PERCENT = 80
#: Sizes at which bands begin; the last goes on.
BANDS = (1, 256, 1024, 4096, 16384, 65536)
MOST_MATCHES = 4
#: Cost of verifying a pair, in shingles read from a group.
VERIFY = 8
#: Shingles in a blob, documents in a blob, and documents of a blob from which a shingle is hot.
BLOB_SHINGLES, BLOB_DOCS, HOT = 1_000_000, 60_000, 256
HOTTEST = (1 << 31) - 1
MOST_BROADCAST = 500_000
STAR_ROUNDS = 2
#: Sets of a group that are paired without a pivot.
FEW = 32
#: Heads of a group, and partners of a set, in a round.
HEADS = 6
_U = np.uint64
_DOC, _SHARED = 0, 1


def missing(n):
    """The most shingles of n that a linked set may lack."""
    return n - (n * PERCENT + 99) // 100


def missing_of_larger(n):
    """The most shingles of n that a linked set at least as large may lack."""
    return n - -(-2 * PERCENT * n // (100 + PERCENT))


def level(band: int, whole: bool = False) -> float:
    """The share of hashes that decides in a band: nine deviations above what may be missing, so hardly ever too few; ``whole`` is all."""
    return 1.0 if whole or not band else 0.2 + 9 * (0.25 / BANDS[band]) ** 0.5


def bands_of(n: int) -> list[int]:
    """A pair's smaller size names its band; the larger size is under 5 / 4 of that."""
    return [k for k, low in enumerate(BANDS) if low <= n and (k + 1 == len(BANDS) or n * PERCENT < BANDS[k + 1] * 100)]


def _below(share: float) -> int:
    return (1 << 48) if share >= 1 else int(share * (1 << 48))


def identity(h: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set (ascending hashes) from others."""
    if not len(h):
        return 0, 0
    a = int(np.add.reduce(mix64(h ^ _U(0x5851F42D4C957F2D)))) & 0xFFFFFFFFFFFFFFFF
    b = int(np.add.reduce(mix64(h + _U(0x14057B7EF767814F)))) & 0xFFFFFFFFFFFFFFFF
    a = (a * 0x9E3779B97F4A7C15 + len(h)) & 0xFFFFFFFFFFFFFFFF
    return a - (1 << 63), b - (1 << 63)


_FLAT = "bucket long, kind int, blob long, tokens binary, docs binary, numbers binary, marks binary, s long, s2 long, n int, many string, short boolean, id string, has_id boolean"


def _pack(batch: list[dict]) -> pa.RecordBatch:
    types = {"bucket": pa.int64(), "kind": pa.int32(), "blob": pa.int64(), "tokens": pa.binary(), "docs": pa.binary(), "numbers": pa.binary(), "marks": pa.binary(), "s": pa.int64(), "s2": pa.int64(), "n": pa.int32(), "many": pa.string(), "short": pa.bool_(), "id": pa.string(), "has_id": pa.bool_()}
    return pa.RecordBatch.from_pydict({k: pa.array([r.get(k) for r in batch], t) for k, t in types.items()})


def _narrow(t: np.ndarray) -> bytes:
    return np.ascontiguousarray(t.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _widen(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _deal(buckets: int, text_col: str, whole: bool):
    """Texts to blob rows: for each bucket the shingles of about a million, and a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 24, 0
        held: list[np.ndarray] = []
        rows: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            blob = task + made
            out = [r | {"bucket": -1 - blob, "kind": _DOC, "blob": blob, "docs": int(i).to_bytes(2, "little")} for i, r in enumerate(rows)]
            for start in range(0, len(out), 5000):
                yield _pack(out[start : start + 5000])
            h = np.concatenate(held) if held else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(held), dtype="<u2"), [len(x) for x in held]) if held else np.zeros(0, "<u2")
            order = np.lexsort((h, h & _U(buckets - 1)))
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            run_of = np.diff(np.append(first, len(h)))
            hot = np.repeat(run_of > HOT, run_of)
            cut = (h >> _U(16) << _U(16)) | (h & _U(buckets - 1))  # as the buckets give them back
            if hot.any():  # known here to be hot: goes straight to the documents' side
                yield _pack([{"bucket": -1 - blob, "kind": _SHARED, "blob": blob, "tokens": cut[hot].tobytes(), "docs": doc[hot].tobytes(), "numbers": np.full(int(hot.sum()), HOTTEST, "<i4").tobytes()}])
            marked = h[first[run_of > HOT]]
            h, doc = h[~hot], doc[~hot]
            bucket = (h & _U(buckets - 1)).astype(np.int64)
            marked_bucket = (marked & _U(buckets - 1)).astype(np.int64)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            out = []
            for k in range(buckets):
                a, b = edges[k], edges[k + 1]
                own = marked[marked_bucket == k] if len(marked) else marked
                if b > a or len(own):
                    out.append({"bucket": k, "kind": _SHARED, "blob": blob, "tokens": _narrow(h[a:b] >> _U(16)), "docs": doc[a:b].tobytes(), "marks": _narrow(own >> _U(16))})
            yield _pack(out)

        count = 0
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                ids, has = part.column("_id").to_pylist(), part.column("_has").to_pylist()
                for text, id_, has_id in zip(texts, ids, has, strict=True):
                    h = shingle_hashes(text or b"")
                    s, s2 = identity(h)
                    bands = bands_of(len(h))
                    shares = [h >> _U(16) < _U(_below(level(k, whole))) for k in bands]
                    many = [int(x.sum()) for x in shares]
                    rows.append({"s": s, "s2": s2, "n": len(h), "many": ",".join(f"{k}:{m}" for k, m in zip(bands, many, strict=True)), "short": min(many, default=0) < min(len(h), missing(len(h)) + MOST_MATCHES), "id": id_, "has_id": has_id})
                    held.append(h[shares[0]] if bands else h)
                    count += len(held[-1])
                    if count >= BLOB_SHINGLES or len(rows) >= BLOB_DOCS:
                        yield from flush()
                        held, rows, count, made = [], [], 0, made + 1
        if rows:
            yield from flush()

    return run


def _shared(buckets: int):
    """A bucket's shingles that several documents have, as blobs for the documents' side; other rows pass."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table
        rows = table.select(["bucket", "blob", "tokens", "docs", "marks"]).to_pylist()
        tokens = np.concatenate([_widen(r["tokens"]) for r in rows])
        docs = np.concatenate([np.frombuffer(r["docs"], "<u2") for r in rows])
        of = np.repeat(np.arange(len(rows)), [len(r["docs"]) // 2 for r in rows])
        marks = np.unique(np.concatenate([_widen(r["marks"] or b"") for r in rows]))
        order = np.argsort(tokens, kind="stable")
        t = tokens[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, int)
        many = np.diff(np.append(first, len(t)))
        number = np.where(np.isin(t[first], marks), HOTTEST, many)
        number = np.repeat(number, many)
        keep = number > 1
        order, t, number = order[keep], t[keep], number[keep]
        by_row = np.argsort(of[order], kind="stable")
        order, t, number = order[by_row], t[by_row], number[by_row]
        edges = np.searchsorted(of[order], np.arange(len(rows) + 1))
        out = []
        for k, r in enumerate(rows):
            a, b = edges[k], edges[k + 1]
            if b > a:
                whole = t[a:b] << _U(16) | _U(r["bucket"])
                out.append({"bucket": -1 - r["blob"], "kind": _SHARED, "blob": r["blob"], "tokens": whole.tobytes(), "docs": docs[order[a:b]].tobytes(), "numbers": np.minimum(number[a:b], HOTTEST).astype("<i4").tobytes()})
        return pa.Table.from_batches([_pack(out)])

    return run


def matches_for(numbers: np.ndarray, own: int, n: int) -> int:
    """How many matches to ask for: what is expected to cost least.

    ``numbers`` are those of the set's shared shingles in the order of the prefix, ``own`` how many it shares with none.
    """
    best, least = 1, None
    for many in range(1, MOST_MATCHES + 1):
        taken = numbers[: max(0, missing(n) + many - own)].astype(float)
        read = float((taken - 1).sum())
        cost = read + VERIFY * read / many**2
        if least is None or cost < least:
            best, least = many, cost
    return best


def _prefixes(whole: bool):
    """A blob's documents and their shared shingles to prefix rows: band, shingle, set, size, matches, shingles of its own, place."""
    return lambda table: _prefixes_of(table, whole)


def _prefixes_of(table: pa.Table, whole: bool) -> pa.Table:
    kinds = np.asarray(table.column("kind"))
    docs = table.filter(pa.array(kinds == _DOC)).select(["docs", "s", "n", "many"]).to_pylist()
    rest = table.filter(pa.array(kinds == _SHARED)).select(["tokens", "docs", "numbers"]).to_pylist()
    cat = lambda k, t: np.concatenate([np.frombuffer(r[k], t) for r in rest]) if rest else np.zeros(0, t)
    token, doc, number = cat("tokens", "<u8"), cat("docs", "<u2"), cat("numbers", "<i4")
    order = np.lexsort((token, number, doc))
    token, doc, number = token[order], doc[order], number[order]
    found: list[tuple] = []
    for d in docs:
        n, at = d["n"], int.from_bytes(d["docs"], "little")
        a, b = np.searchsorted(doc, [at, at + 1])
        if a == b:
            continue
        for item in d["many"].split(","):
            band, size = map(int, item.split(":"))
            inside = token[a:b] >> _U(16) < _U(_below(level(band, whole)))
            t, c = token[a:b][inside], number[a:b][inside]
            own = size - len(t)
            many = matches_for(c, own, n)
            t = t[: max(0, missing(n) + many - own)]
            if len(t):
                found.append((band, t, d["s"], n, many, own, own + np.arange(len(t))))
    length = [len(f[1]) for f in found]
    column = lambda i, t: pa.array(np.repeat(np.array([f[i] for f in found], t), length))
    tokens = np.concatenate([f[1] for f in found]).view(np.int64) if found else np.zeros(0, np.int64)
    return pa.table({"band": column(0, np.int32), "token": pa.array(tokens), "s": column(2, np.int64), "n": column(3, np.int32), "many": column(4, np.int32), "own": column(5, np.int32), "at": pa.array(np.concatenate([f[6] for f in found]) if found else np.zeros(0, np.int64), pa.int32())})


def _sets(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_chunks(batch, text_col):
                sets = [shingle_hashes(t or b"").view(np.int64) for t in texts]
                ids = [identity(x.view(np.uint64)) for x in sets]
                yield pa.RecordBatch.from_pydict({"s": pa.array([i[0] for i in ids], pa.int64()), "s2": pa.array([i[1] for i in ids], pa.int64()), "hashes": pa.array(sets, pa.list_(pa.int64()))})

    return run


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (``a``, ``b``), those that link."""
    left = sets.select(F.col("s").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("s").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= PERCENT * (F.size("x") + F.size("y") - common)).select("a", "b")


def _alike(n: str, m: str):
    return (100 * F.col(n) >= PERCENT * F.col(m)) & (100 * F.col(m) >= PERCENT * F.col(n))


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with the ``root`` of their set ``s``."""
    if roots is None:
        return rows.withColumn("root", F.col("s"))
    return rows.join(roots.select(F.col("u").alias("s"), "root"), "s", "left").withColumn("root", F.coalesce("root", "s"))


def _star(prefixes: DataFrame, salt: int) -> DataFrame:
    """Pairs of each set with heads of the groups that it is in: those it shares most prefix shingles with.

    A group's heads are the set with the smallest share of shingles of its own (what copies were made of comes
    first so) and the first ones by some hashes of the round, whatever the group's size.
    """
    place = lambda first: F.min(F.struct(first.alias("h"), "s", "n", "root"))
    orders = [(1000 * F.col("own") / F.col("n")).cast("long"), *[F.xxhash64(F.lit(salt * HEADS + k), F.col("s")) for k in range(1, HEADS)]]
    heads = prefixes.groupBy("band", "token").agg(*[place(o).alias(f"h{k}") for k, o in enumerate(orders)], F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1")
    heads = heads.select("band", "token", F.explode(F.array_distinct(F.array(*[F.struct(f"h{k}.s", f"h{k}.n", f"h{k}.root") for k in range(HEADS)]))).alias("head"))
    met = prefixes.join(heads.select("band", "token", F.col("head.s").alias("hs"), F.col("head.n").alias("hn"), F.col("head.root").alias("hr")), ["band", "token"])
    met = met.where((F.col("root") != F.col("hr")) & _alike("n", "hn")).groupBy("s", "hs").agg(F.count("*").alias("c"))
    best = met.withColumn("place", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("c"), "hs"))).where(F.col("place") <= HEADS)
    return best.select(F.least("s", "hs").alias("a"), F.greatest("s", "hs").alias("b")).distinct()


def _common(n: str, m: str):
    """The shingles that sets of n and m shingles share at least if they link."""
    return F.ceil(PERCENT * (F.col(n) + F.col(m)) / F.lit(100 + PERCENT))


def _mixed(rows: DataFrame, key: list[str], *more) -> DataFrame:
    """Keys of the groups whose sets are in different components."""
    return rows.groupBy(*key).agg(F.min("root").alias("r0"), F.max("root").alias("r1"), *more).where("r0 != r1").drop("r0", "r1")


def _pivots(prefixes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of groups that hold several components, and each set measured against the pivots of its large groups.

    A group of over ``FEW`` sets has a pivot ``h``, its set with the most shingles that others have too. The
    second table has, for a set and each of its pivots, ``x`` (the shingles they share), both sizes, and
    ``rest``: the set's shingles that the pivot lacks, in the order of their hashes, as many as a prefix needs.
    """
    first = F.min(F.struct((F.col("own") - F.col("n")).alias("o"), F.xxhash64("s").alias("k"), "s"))
    groups = _mixed(prefixes, ["band", "token"], F.count("*").alias("f"), F.min("n").alias("low"), first.alias("p"))
    groups = groups.select("band", "token", "low", F.when(F.col("f") > FEW, F.col("p.s")).alias("h"))
    rows = materialize(prefixes.join(groups, ["band", "token"]), "prefixes-mixed")
    met = rows.where("h is not null and s != h").select("s", "h").distinct()
    both = met.join(sets.select(F.col("s").alias("h"), F.col("hashes").alias("y")), "h").join(sets.select("s", F.col("hashes").alias("v")), "s")
    apart = F.sort_array(F.array_except("v", "y"))
    most = (F.size("v") - F.ceil(PERCENT * F.size("v") / F.lit(100)) + MOST_MATCHES).cast("int")
    measured = both.select("s", "h", F.size("v").alias("n"), F.size("y").alias("m"), (F.size("v") - F.size(apart)).alias("x"), F.slice(apart, 1, most).alias("rest"))
    return rows, materialize(measured, "pivots")


def _cross(rows: DataFrame, pivots: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs of sets in different components that may link, beside those of a set with a pivot.

    Sets a and b that link share ``_common`` shingles. Of those at most ``x`` are the pivot's; if they must share
    more, they share one that the pivot lacks too. So such pairs are sought among the shingles that the
    pivot lacks (edits, which few have), and only the others among the pivot's (which all of a large group
    have): a row whose set can't link by them with a set of any size in the group leaves it.

    Elsewhere the smaller set's inner prefix meets the larger set's whole one. How many shingles of the two a
    link shares, and how far down the last of them may stand in either set, follows from the sizes.
    """
    within = F.least(F.coalesce("x", "n"), F.col("n") - F.col("own"))
    low = F.greatest(F.col("low"), F.ceil(PERCENT * F.col("n") / F.lit(100)))
    some = rows.join(pivots.select("s", "h", "x"), ["s", "h"], "left").withColumn("x", within)
    some = some.where((100 + PERCENT) * F.col("x") >= PERCENT * (F.col("n") + low))
    some = some.withColumn("inner", F.col("at") < F.col("n") - F.ceil(2 * PERCENT * F.col("n") / F.lit(100 + PERCENT)) + F.col("many")).select("band", "token", "s", "n", "many", "own", "at", "x", "root", "inner")
    some = some.join(_mixed(some, ["band", "token"], F.max("inner").alias("any")).where("any").drop("any"), ["band", "token"])
    side = lambda k: [F.col("s").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "many", "own", "at", "x", "root")]]
    one, two = some.where("inner").select("band", "token", *side("a")), some.select("band", "token", *side("b"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    need = _common("n_a", "n_b")
    apart = smaller & (F.col("root_a") != F.col("root_b")) & _alike("n_a", "n_b") & (need <= F.least("x_a", "x_b"))
    # What stands before a match and isn't its own may match too; what stands behind it, as far as both go on.
    before = lambda k: F.col(f"at_{k}") - F.col(f"own_{k}")
    behind = lambda k: F.col(f"n_{k}") - F.col(f"at_{k}") - 1
    fits = need <= 1 + F.least(before("a"), before("b")) + F.least(behind("a"), behind("b"))
    met = one.join(two, ["band", "token"]).where(apart & fits)
    whole = F.least(F.col("n_b"), F.col("n_b") - F.ceil(PERCENT * F.col("n_b") / F.lit(100)) + F.col("many_b"))
    inner = F.least(F.col("n_a"), F.col("n_a") - F.ceil(2 * PERCENT * F.col("n_a") / F.lit(100 + PERCENT)) + F.col("many_a"))
    least = F.greatest(F.lit(1), F.least(inner - F.col("n_a") + need, whole - F.col("n_b") + need))
    counted = met.groupBy("band", "a", "b").agg(F.count("*").alias("c"), F.min(least).alias("l"), F.min(need).alias("need"), F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    enough = counted.where((F.col("c") >= F.col("l")) & (F.col("need") <= F.col("c") + F.least(behind("a"), behind("b"))) & (F.col("need") <= F.col("c") + behind("a")) & (F.col("need") <= F.col("c") + behind("b")))
    # The shingles that the pivot lacks.
    rest = _rooted(pivots, roots).select("h", F.explode("rest").alias("token"), "s", "n", "x", "root", F.size("rest").alias("size"))
    rest = rest.join(_mixed(rest, ["h", "token"]), ["h", "token"])
    own = Window.partitionBy("h", "s")
    rest = rest.withColumn("at", F.row_number().over(own.orderBy("token")) - 1)
    rest = materialize(rest.withColumn("r", F.col("n") - F.col("x") - F.col("size") + F.count("*").over(own)), "pivots-rest")
    side = lambda k: ["h", "token", F.col("s").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "x", "root", "at", "r")]]
    most = need - F.least("x_a", "x_b")
    apart = smaller & (F.col("root_a") != F.col("root_b")) & _alike("n_a", "n_b") & (most > 0)
    behind = F.least(F.col("r_a") - F.col("at_a"), F.col("r_b") - F.col("at_b")) - 1
    met = rest.select(*side("a")).join(rest.select(*side("b")), ["h", "token"]).where(apart & (most <= 1 + F.least("at_a", "at_b") + behind))
    more = met.groupBy("h", "a", "b").agg(F.count("*").alias("c"), F.min(most).alias("need"), F.min(behind).alias("behind"))
    more = more.where((F.col("c") >= F.least(F.lit(MOST_MATCHES), "need")) & (F.col("need") <= F.col("c") + F.col("behind")))
    pairs = enough.select("a", "b").unionByName(more.select("a", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every row's set, and the sets' components.

    The first: ``id`` (as text), ``has_id``, ``s`` and ``s2`` (the set), ``n``. The second: ``u`` and ``root``, sets
    by ``s``, for the sets that link with another and aren't the root themselves.
    """
    spark = df.sparkSession
    buckets = 1 << min(16, max(4, (buckets_for(spark) - 1).bit_length()))
    slim = df.select(F.col(id_col).cast("string").alias("_id"), F.col(id_col).isNotNull().alias("_has"), F.col(text_col))
    for whole in (False, True):  # whole sets, if a level should have left too few shingles of one to decide
        dealt = map_arrow(slim, _deal(buckets, text_col, whole), _FLAT)
        found = materialize(group_arrow(dealt, "bucket", _shared(buckets), _FLAT), "shingles-shared")
        release(spark)
        if not found.where("short").limit(1).count():
            break
    docs = found.where(F.col("kind") == _DOC).select("id", "has_id", "s", "s2", "n", "blob", "docs", "many")
    clashes = materialize(docs.where("n > 0").groupBy("s").agg(F.min("s2").alias("c0"), F.max("s2").alias("c1")).where("c0 != c1").select("s"), "sets-clashing")
    some = clashes.limit(1).count()
    apart = lambda d: d.join(clashes.select("s", F.lit(True).alias("_c")), "s", "left").withColumn("s", F.when(F.col("_c"), F.xxhash64("s", "s2")).otherwise(F.col("s"))).drop("_c") if some else d
    docs = apart(docs)
    # One row stands for each set.
    stand = docs.where("n > 0").groupBy("s").agg(F.min(F.struct("blob", "docs", "n", "many")).alias("d"))
    stand = stand.select((-1 - F.col("d.blob")).alias("bucket"), F.lit(_DOC).alias("kind"), "d.docs", "s", "d.n", "d.many")
    shared = found.where(F.col("kind") == _SHARED).select("bucket", "kind", "tokens", "docs", "numbers")
    sides = shared.unionByName(stand, allowMissingColumns=True)
    prefixes = group_arrow(sides, "bucket", _prefixes(whole), "band int, token long, s long, n int, many int, own int, at int")
    prefixes = materialize(prefixes, "prefixes")
    several = prefixes.groupBy("band", "token").agg(F.min("s").alias("s0"), F.max("s").alias("s1")).where("s0 != s1").select("band", "token")
    prefixes = materialize(prefixes.join(several, ["band", "token"]), "prefixes-shared")
    release(spark)
    # The whole sets of those that may link.
    wanted = prefixes.select("s").distinct()
    ids = docs.join(wanted, "s").groupBy("s").agg(F.min("id").alias("_want"), F.max(F.col("id").isNull()).alias("_null"))
    ids = materialize(ids.select("_want", "_null").where("_want is not null or _null").distinct(), "sets-wanted")
    few = ids.count() <= MOST_BROADCAST
    keyed = F.col("_id") == F.col("_want")
    texts = slim.join(F.broadcast(ids) if few else ids, keyed, "left_semi")
    if ids.where("_null").limit(1).count():  # sets that only rows without an id may have
        texts = texts.unionByName(slim.where(F.col("_id").isNull()))
    sets = apart(map_arrow(texts, _sets(text_col), "s long, s2 long, hashes array<long>")).drop("s2")
    sets = materialize(sets.join(F.broadcast(wanted) if few else wanted, "s", "left_semi").dropDuplicates(["s"]), "sets")
    release(spark)
    roots = None
    for salt in range(STAR_ROUNDS + 1):
        labelled = _rooted(prefixes, roots)
        if salt < STAR_ROUNDS:
            new = _verify(materialize(_star(labelled, salt), "pairs"), sets)
        else:
            rows, pivots = _pivots(labelled, sets)
            linked = pivots.where((100 + PERCENT) * F.col("x") >= PERCENT * (F.col("n") + F.col("m"))).select(F.col("s").alias("a"), F.col("h").alias("b"))
            new = _verify(materialize(_cross(rows, pivots, roots), "pairs"), sets).unionByName(linked)
        new = materialize(new, "links").select(F.col("a").alias("u"), F.col("b").alias("v"))
        release(spark)
        if roots is not None:  # between components one link counts, however many there are
            ends = roots.select(F.col("u").alias("_u"), "root")
            for end in ("u", "v"):
                new = new.join(ends, F.col(end) == F.col("_u"), "left").withColumn(end, F.coalesce("root", end)).select("u", "v")
            new = new.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().unionByName(roots.withColumnRenamed("root", "v"))
        roots = components(new)
    return docs.select("id", "has_id", "s", "s2", "n"), roots


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``df``: the id, ``n_shingles`` long, ``component_id`` (the smallest id reachable by links, itself included)."""
    kind = df.schema[id_col].dataType
    docs, roots = classes(df, id_col, text_col)
    labelled = docs.join(roots.withColumnRenamed("u", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    labelled = labelled.withColumn("key", F.col("id").cast(kind))
    low = labelled.where("n > 0").groupBy("root").agg(F.min("key").alias("component_id"))
    out = labelled.join(low, "root", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stand for their component, one each: that of the smallest id; rows without shingles all stay.

    Rows are told apart by a key of their own and not by id. Of rows that tie for the smallest id, and of a
    component without an id, the row that comes first in the table stays.
    """
    row = "_row"
    while row in df.columns:
        row += "_"
    rows = materialize(df.withColumn(row, F.monotonically_increasing_id()), "rows-keyed")
    docs, roots = classes(rows, row, text_col)
    labelled = docs.where("n > 0").select(F.col("id").cast("long").alias("_key"), "s")
    labelled = labelled.join(roots.withColumnRenamed("u", "s"), "s", "left").select("_key", F.coalesce("root", "s").alias("_root"))
    ids = rows.select(F.col(row).alias("_key"), F.col(id_col).alias("_given"))
    ranked = labelled.join(ids, "_key").groupBy("_root").agg(F.min(F.struct(F.col("_given").isNull().alias("_none"), "_given", "_key")).alias("_first"))
    gone = labelled.join(ranked.select("_root", F.col("_first._key").alias("_kept")), "_root").where("_key != _kept").select(F.col("_key").alias(row))
    return rows.join(gone, row, "left_anti").select(*df.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(reader(spark, sf_dir, "documents"))
