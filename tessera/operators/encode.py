"""Encoding documents to token ids.

``encode`` splits and merges in Arrow batches: pieces are found by arrays over a batch's bytes, told apart, and those that
the worker's memo lacks are merged side by side; one pass over the documents and no shuffle, but for tables that are
too small to fill the cores. Under ``encode_by_join`` and ``explain_stages`` distinct pieces are found by a shuffle and merged once;
``encode_by_join`` joins their ids back to the distinct pieces of some MB of documents at a time, ``explain_stages`` looks symbols up by
a broadcast join (``merge_pieces``) and joins them back to every pretoken.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classes import Classes, classes
from ..functions.pretok import ByteScanner, pretokens, scanner
from ..functions.trie import trie_pattern
from ..plans.merging import MISS, BatchMerger
from ..plans.model import BpeModel
from ..plans.ship import ship
from ..plans.spread import spread
from .words import distinct_pieces, explode_pretokens, together, word_count

MEMO_PIECES = 100_000
#: Bytes of text that go through arrays together, and that a batch of results comes from, about; ids that are decoded together.
TOGETHER_BYTES, CHUNK_BYTES, DECODED_IDS = 1 << 20, 2 << 20, 500_000
#: Bytes of documents whose distinct pieces are told apart together before a join, about.
SHEET_BYTES = 8 << 20
#: Rows of a model's tables up to which they are broadcast; beyond, they are shuffled as the pieces are.
MOST_BROADCAST = 2_000_000
#: Where a long document can be cut: a blank between an ASCII letter or digit and a letter begins a piece whatever is around.
_CUT = re.compile(rb"[0-9A-Za-z](?= [A-Za-z])")


def special_pattern(model: BpeModel) -> str:
    """One pattern for the JVM, of all special tokens; the leftmost match, and the longest there."""
    return trie_pattern([s.content.decode("utf-8") for s in model.specials], lambda c: f"\\x{{{ord(c):X}}}")


def split_specials(model: BpeModel, text: Column) -> Column:
    """A text's parts in order, as an array of (``special`` boolean, ``part``): special tokens, and what stands between them."""
    part = lambda special, p: F.struct(special.alias("special"), p.alias("part"))
    if not model.specials:
        return F.when(F.length(text) > 0, F.array(part(F.lit(False), text))).otherwise(F.array().cast("array<struct<special:boolean,part:string>>"))
    pattern = special_pattern(model)
    parts = F.regexp_extract_all(text, F.lit(f"(?s)(?:{pattern})|(?:(?!{pattern}).)+"), F.lit(0))
    return F.transform(parts, lambda p: part(p.rlike(pattern), p))  # what stands between holds none


class Encoder:
    """A worker's encoder, with its memo of pieces and their ids (packed longs, ``MISS`` for a symbol that the vocabulary lacks)."""

    def __init__(self, merger: BatchMerger, known: Classes) -> None:
        self.merger, self.scanner = merger, ByteScanner(known)
        self.memo: dict[bytes, bytes] = {}
        self.special_ids = {s.content: s.id for s in merger.model.specials}
        # Bytes as Latin-1 characters; a pattern of bytes is made of them.
        tokens = [c.decode("latin-1") for c in self.special_ids]
        self.pattern = re.compile(trie_pattern(tokens, lambda c: f"\\x{ord(c):02x}").encode("ascii")) if tokens else None

    def parts(self, doc: bytes) -> Iterator[tuple[bytes, int]]:
        """A document's parts in order: a stretch of text with -1, or an empty one with the id of a special token."""
        at = 0
        for m in self.pattern.finditer(doc) if self.pattern else ():
            yield from self._stretches(doc, at, m.start())
            yield b"", self.special_ids[m[0]]
            at = m.end()
        yield from self._stretches(doc, at, len(doc))

    @staticmethod
    def _stretches(doc: bytes, at: int, end: int) -> Iterator[tuple[bytes, int]]:
        while end - at > TOGETHER_BYTES:
            cut = _CUT.search(doc, at + TOGETHER_BYTES // 2, end)
            if cut is None:
                break
            yield doc[at : cut.end()], -1
            at = cut.end()
        if end > at:
            yield doc[at:end], -1

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids in order; for each document its numbers of ids, of pieces and special tokens together, and of special tokens."""
        ids: list[np.ndarray] = []
        counts = np.zeros((3, len(docs)), np.int64)
        held: list[bytes] = []
        special: list[int] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            found, n_ids, n_pieces = self._together(held, np.array(special, np.int64))
            ids.append(found)
            at = np.array(owner, np.int64)
            for row, n in enumerate((n_ids, n_pieces, np.array(special) >= 0)):
                np.add.at(counts[row], at, n)
            held.clear(), special.clear(), owner.clear()

        for k, doc in enumerate(docs):
            for part, token in self.parts(doc):
                held.append(part)
                special.append(token)
                owner.append(k)
                size += len(part) + 32
                if size >= TOGETHER_BYTES:
                    flush()
                    size = 0
        if held:
            flush()
        return np.concatenate(ids) if ids else np.zeros(0, np.int64), *counts

    def _together(self, parts: list[bytes], special: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts in order; for each part its numbers of ids and of pieces."""
        pieces, number, n_pieces = self.scanner.distinct(parts)
        packed = self._known(pieces)
        marks = np.flatnonzero(special >= 0)
        tokens, which = np.unique(special[marks], return_inverse=True)
        number = np.insert(number, (np.cumsum(n_pieces) - n_pieces)[marks], len(pieces) + which)
        n_pieces = n_pieces + (special >= 0)
        table = np.concatenate([np.frombuffer(b"".join(packed), "<i8"), tokens])
        sizes = np.concatenate([np.array([len(x) // 8 for x in packed], np.int64), np.ones(len(tokens), np.int64)])
        starts = np.cumsum(sizes) - sizes
        each = sizes[number]
        ends = np.cumsum(each)
        ids = table[np.repeat(starts[number] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_pieces)])]
        return ids, np.diff(before), n_pieces

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        memo = self.memo
        fresh = [p for p in pieces if p not in memo]
        if len(memo) + len(fresh) > MEMO_PIECES:
            memo.clear()
            fresh = pieces
        memo.update(zip(fresh, self.merger.ids_of(fresh), strict=True))
        return [memo[p] for p in pieces]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, merger: BatchMerger, known: Classes) -> Encoder:
    """A worker's encoder, kept from task to task of a query."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(merger, known)
    return _ENCODERS[key]


def encode(df: DataFrame, model: BpeModel, id_col: str = "doc_id", text: str = "text", stats: bool = False, in_order: bool = False) -> DataFrame:
    """``id_col``, ``ids`` array<long>, ``status``: 'ok', or 'vocab_miss' with null ids. ``text`` is string or binary.

    Bytes that aren't valid UTF-8 are split as the byte scanner has it. A null text has null ids. ``stats`` adds
    ``n_pretokens``, ``mapped_cps``, ``merged_symbols``, ``vocab_hits``, ``vocab_misses`` (special tokens aside).
    ``in_order`` keeps the rows in the partitions and order that they have, however few partitions these are.
    """
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(BatchMerger.of(model))
    known, key = classes(spark), uuid.uuid4().hex
    extra = ("n_pretokens", "mapped_cps", "merged_symbols", "vocab_hits", "vocab_misses") if stats else ()
    fields = [df.schema[id_col], T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("status", T.StringType()), *[T.StructField(n, T.LongType()) for n in extra]]
    lengths = {s.id: len(s.content) for s in model.specials}

    def rows(encoder: Encoder, batch: pa.RecordBatch, docs: list[bytes | None]) -> pa.RecordBatch:
        ids, size, pieces, special = encoder.encode([d or b"" for d in docs])
        ends = np.cumsum(size)
        bad = np.concatenate([[0], np.cumsum(ids == MISS)])
        missing = bad[ends] - bad[ends - size]
        gone = (missing > 0) | np.array([d is None for d in docs], bool)
        offsets = np.concatenate([[0], np.cumsum(np.where(gone, 0, size))])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(gone, False)), pa.array(ids[np.repeat(~gone, size)]))
        columns = [lists, pa.array(np.where(missing > 0, "vocab_miss", "ok").tolist(), pa.string())]
        if extra:
            marks = sum((np.bincount(np.repeat(np.arange(len(docs)), size), ids == i, len(docs)) * n for i, n in lengths.items()), np.zeros(len(docs))) if special.any() else 0
            octets = np.array([len(d or b"") for d in docs]) - np.int64(marks)
            columns += [pa.array(np.asarray(x, np.int64)) for x in (pieces - special, octets, size - special, size - special - missing, missing)]
        return pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, held.value, known)
        for batch in batches:
            start, total, docs = 0, 0, []
            for i, value in enumerate(batch.column("text")):
                docs.append(value.as_py())
                total += len(docs[-1] or b"")
                if total >= CHUNK_BYTES:
                    yield rows(encoder, batch.slice(start, len(docs)), docs)
                    start, total, docs = i + 1, 0, []
            if docs:
                yield rows(encoder, batch.slice(start, len(docs)), docs)

    # Spread as it is read: the plan expects more bytes of a binary column than of a string.
    slim = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return (slim if in_order else spread(slim)).select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, T.StructType(fields))


def _joinable(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= MOST_BROADCAST else table


def merge_pieces(pieces: DataFrame, model: BpeModel) -> DataFrame:
    """``piece`` and ``symbols``, an array of hex strings, of each distinct ``piece`` (string or binary), for any rules.

    Distinct pieces are dealt to all cores once and merged side by side in Arrow batches, each by its own lowest rank a round.
    """
    spark = pieces.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ship(spark)
    held = spark.sparkContext.broadcast(BatchMerger.of(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = held.value
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            symbols, sizes = merger.symbols_of([p for p in raw if p])
            counts = np.array([len(p) > 0 for p in raw], np.int64)
            counts[counts > 0] = sizes
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(symbols, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("piece"), lists], names=["piece", "symbols"])

    distinct = pieces.select("piece").distinct().repartition(tasks, "piece")
    return distinct.select("piece", F.col("piece").cast("binary").alias("raw")).mapInArrow(run, T.StructType([pieces.schema["piece"], T.StructField("symbols", T.ArrayType(T.StringType()))]))


def bpe_words(words: DataFrame, model: BpeModel, piece: str = "piece") -> DataFrame:
    """``words`` with ``symbols``, an array of hex strings."""
    return words.join(merge_pieces(words.select(F.col(piece).alias("piece")), model).withColumnRenamed("piece", piece), piece)


def _known_symbols(pieces: DataFrame, model: BpeModel) -> DataFrame:
    """``piece``, ``sym_pos``, ``symbol`` (hex), ``token_id`` (null: a miss) of each distinct piece."""
    flat = merge_pieces(pieces, model).select("piece", F.posexplode("symbols").alias("sym_pos", "symbol"))
    vocab = model.vocab_table(pieces.sparkSession).select(F.col("token").alias("symbol"), F.col("id").alias("token_id"))
    return flat.join(_joinable(vocab, model.vocab_size), "symbol", "left")


def symbol_rows(df: DataFrame, model: BpeModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each symbol: id, ``pos`` of the pretoken, ``piece``, ``sym_pos``, ``symbol`` (hex), ``token_id`` (null: a miss).

    Distinct pieces are merged once. Special tokens aren't applied. ``text`` is string or binary.
    """
    pieces = explode_pretokens(df, id_col, text)
    return pieces.join(_known_symbols(pieces, model), "piece").select(id_col, "pos", "piece", "sym_pos", "symbol", "token_id")


def missing_symbols(df: DataFrame, model: BpeModel, text: str = "text") -> DataFrame:
    """``symbol`` (hex), ``n``: how often each symbol comes that the vocabulary lacks. Pieces are counted before they are joined."""
    words = word_count(df, text)
    missed = _known_symbols(words, model).where("token_id is null").select("piece", "symbol")
    return words.join(missed, "piece").groupBy("symbol").agg(F.sum("n").cast("long").alias("n"))


def explain_stages(df: DataFrame, model: BpeModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """What each stage makes of a document: ``symbol_rows`` with ``piece_hex`` and ``mapped`` (the symbol in the byte alphabet)."""
    from ..functions.bytemap import to_mapped

    rows = symbol_rows(df, model, id_col, text)
    return rows.withColumn("piece_hex", F.hex("piece")).withColumn("mapped", to_mapped(F.unhex("symbol"))).drop("piece")


class _Sheet:
    """Documents whose distinct pieces are told apart together: the pieces, and every document's as numbers of them."""

    def __init__(self, known: Classes) -> None:
        self.scanner = scanner(known)
        self.seen: dict[bytes, int] = {}
        self.numbers: list[np.ndarray] = []
        self.keys: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: pa.Array, docs: list[bytes]) -> None:
        parts = [(part, k) for k, doc in enumerate(docs) for part, _ in Encoder._stretches(doc, 0, len(doc))]
        pieces, number, counts = self.scanner.distinct([part for part, _ in parts])
        seen = self.seen
        self.numbers.append(np.array([seen.setdefault(p, len(seen)) for p in pieces], np.int32)[number])
        n = np.zeros(len(docs), np.int64)
        np.add.at(n, [k for _, k in parts], counts)
        self.keys.append(keys)
        self.counts.append(n)
        self.size += sum(map(len, docs)) + 32 * len(docs)

    def rows(self, sheet: int) -> pa.RecordBatch:
        """A row for each piece; any one of them holds the documents: keys, numbers of pieces, and pieces as numbers, the frequent ones low."""
        numbers, n = np.concatenate(self.numbers), len(self.seen)
        rank = np.empty(n, np.int64)
        rank[np.argsort(-np.bincount(numbers, minlength=n), kind="stable")] = np.arange(n)
        bearer = zlib.crc32(sheet.to_bytes(8, "little")) % n  # not the same piece in every sheet
        keys, counts, packed = pa.concat_arrays(self.keys), np.concatenate(self.counts), _pack(rank[numbers])
        held = lambda size: pa.array(np.where(np.arange(n + 1) > bearer, size, 0), pa.int32())
        docs = [pa.ListArray.from_arrays(held(len(keys)), keys), pa.ListArray.from_arrays(held(len(counts)), pa.array(counts, pa.int32())), pa.array([packed if k == bearer else b"" for k in range(n)], pa.binary())]
        docs = pa.StructArray.from_arrays(docs, names=["keys", "counts", "numbers"], mask=pa.array(np.arange(n) != bearer))
        return pa.RecordBatch.from_arrays([pa.array(list(self.seen), pa.binary()), pa.array(np.full(n, sheet)), pa.array(rank, pa.int32()), docs], names=["piece", "sheet", "number", "docs"])


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers by the places of their bytes, compressed."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


def _sheets(df: DataFrame, known: Classes) -> DataFrame:
    """``piece``, ``sheet``, ``number``, ``docs`` (``keys``, ``counts``, ``numbers``; null but once a sheet) of the columns ``id`` and ``text`` (binary, not empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, sheet = TaskContext.get().partitionId() << 32, _Sheet(known)
        for batch in batches:
            for start, docs in together(batch, 1):
                sheet.add(batch.column(0).slice(start, len(docs)), docs)
                if sheet.size >= SHEET_BYTES:
                    yield sheet.rows(number)
                    number, sheet = number + 1, _Sheet(known)
        if sheet.size:
            yield sheet.rows(number)

    docs = T.StructType([T.StructField("keys", T.ArrayType(df.schema["id"].dataType)), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("numbers", T.BinaryType())])
    fields = [("piece", T.BinaryType()), ("sheet", T.LongType()), ("number", T.IntegerType()), ("docs", docs)]
    return df.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def _piece_ids(pieces: DataFrame, model: BpeModel) -> DataFrame:
    """``piece``, ``packed`` (ids as longs, ``MISS`` for a symbol that the vocabulary lacks) of distinct pieces that aren't empty."""
    held = pieces.sparkSession.sparkContext.broadcast(BatchMerger.of(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = held.value.ids_of(batch.column("piece").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(found, pa.binary())], names=["piece", "packed"])

    return pieces.mapInArrow(run, "piece binary, packed binary")


def encode_by_join(df: DataFrame, model: BpeModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows as ``encode`` without special tokens, by joins. Rows that repeat an id stay apart.

    Distinct pieces are merged once and joined to those of each sheet, some ``SHEET_BYTES`` of documents, so that neither the
    join nor the grouping after it shuffles a row for each pretoken.
    """
    spark = df.sparkSession
    ship(spark)
    known = classes(spark)
    empty = F.coalesce(F.octet_length(text), F.lit(0)) == 0
    full = df.where(~empty).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    dealt = (lambda d: d) if len(df.inputFiles()) >= spark.sparkContext.defaultParallelism else spread  # texts are most of what would be shuffled
    sheets = _sheets(dealt(full).select("id", F.col("text").cast("binary").alias("text")), known)
    ids = _piece_ids(distinct_pieces(dealt(full.select("text")), "text"), model)
    fields = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("status", T.StringType())])

    def whole(rows: pa.Table) -> pa.Table:
        docs = rows["docs"].filter(pc.is_valid(rows["docs"]))[0]
        keys, counts = docs["keys"].values, np.array(docs["counts"].as_py(), np.int64)
        numbers = _unpack(docs["numbers"].as_py(), int(counts.sum()))
        order = np.argsort(rows["number"].to_numpy())
        packed = rows["packed"].take(pa.array(order)).to_pylist()
        table = np.frombuffer(b"".join(packed), "<i8")
        sizes = np.array([len(x) // 8 for x in packed], np.int64)
        starts, each = (np.cumsum(sizes) - sizes)[numbers], sizes[numbers]
        ends = np.cumsum(each)
        found = table[np.repeat(starts - (ends - each), each) + np.arange(ends[-1])]
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        missed = np.diff(np.concatenate([[0], np.cumsum(found == MISS)])[before]) > 0
        size = np.diff(before)
        offsets = np.concatenate([[0], np.cumsum(np.where(missed, 0, size))])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(missed, False)), pa.array(found[np.repeat(~missed, size)]))
        return pa.Table.from_arrays([keys, lists, pa.array(np.where(missed, "vocab_miss", "ok").tolist(), pa.string())], names=fields.names)

    found = sheets.join(ids, "piece").drop("piece").groupBy("sheet").applyInArrow(whole, fields)
    none = F.when(F.col(text).isNotNull(), F.array().cast("array<long>"))
    return found.unionByName(df.where(empty).select(id_col, none.alias("ids"), F.lit("ok").alias("status")))


#: The codes of a document without ids, by its status.
ERRORS = {"bad_input": 7, "vocab_miss": 11}


def ids_text(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A line for each document: ids with spaces between, an empty line for an empty document, ``ERR`` and a code for one without ids."""
    line = F.coalesce(F.array_join(F.transform("ids", lambda x: x.cast("string")), " "), F.lit(""))
    for status, code in ERRORS.items():
        line = F.when(F.col("status") == status, f"ERR {code}").otherwise(line)
    return encoded.select(id_col, line.alias("line"))


def run_summary(encoded: DataFrame) -> DataFrame:
    """One row: ``docs``, ``tokens``, ``checksum`` (the sum of all ids)."""
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return encoded.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("checksum"))


def decode(encoded: DataFrame, model: BpeModel, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``content`` binary: the bytes that ids stand for; null if one is unknown. An extension."""
    ship(encoded.sparkSession)
    held = encoded.sparkSession.sparkContext.broadcast(sorted(model.tokens.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tokens = np.array([i for i, _ in held.value], np.int64), pa.array([t for _, t in held.value], pa.large_binary())
        sizes = np.array([len(t) for _, t in held.value], np.int64)
        for batch in batches:
            sizes_of = np.asarray(batch.column("ids").value_lengths().fill_null(0))
            start = 0
            while start < len(sizes_of):  # rows of about so many ids
                n = max(1, int(np.searchsorted(np.cumsum(sizes_of[start:]), DECODED_IDS, "right")))
                yield stretch(batch.slice(start, n), known, tokens, sizes)
                start += n

    def stretch(batch: pa.RecordBatch, known: np.ndarray, tokens: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        lists = batch.column("ids")
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        counts = np.asarray(lists.value_lengths().fill_null(0))
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        ends = np.cumsum(counts)
        wrong = np.concatenate([[0], np.cumsum(known[at] != ids)])
        null = np.asarray(lists.is_null()) | (wrong[ends] > wrong[ends - counts])
        data = tokens.take(pa.array(at)).buffers()[2]
        places = np.concatenate([[0], np.cumsum(sizes[at])])
        first, last = places[ends - counts], places[ends]
        data = memoryview(data) if data is not None else b""
        out = [None if n else bytes(data[a:b]) for n, a, b in zip(null.tolist(), first.tolist(), last.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "content"])

    return encoded.select(id_col, "ids").mapInArrow(run, T.StructType([encoded.schema[id_col], T.StructField("content", T.BinaryType())]))


def scan_binary(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """``id_col``, ``pos``, ``piece`` binary, ``valid``: pretokens of any bytes; text through the JVM, the rest through the scanner."""
    spark = df.sparkSession
    rows = df.where(F.col(content).isNotNull()).select(F.col(id_col), F.col(content), F.is_valid_utf8(F.col(content).cast("string")).alias("valid"))
    good = rows.where("valid").select(id_col, F.posexplode(F.transform(pretokens(spark, F.col(content).cast("string")), lambda p: F.encode(p, "UTF-8"))).alias("pos", "piece"), F.lit(True).alias("valid"))
    return good.unionByName(explode_pretokens(rows.where("not valid"), id_col, content).withColumn("valid", F.lit(False)))
