"""Training-order materialisation: token ids in a keyed random order, in fixed-stride binary shards.

Each text's tokens, with an end token, are cut into sequences of ``stride`` tokens, the last one padded.
Sequences are numbered 0 to n - 1 (partition by partition of the table, by a hash of the id inside one). A keyed Feistel network over the smallest even number of bits that holds n, walked
along its cycle until the value is below n, is a permutation of the numbers: a sequence's slot. Shard k
holds the slots from k * per_shard on, each at ``offset`` = (slot - first slot) * stride * width bytes, so a reader
that has taken s sequences goes on at slot s by arithmetic alone. Nothing is sorted globally: a shard is a
range of slots, goes to one task whole, and is ordered and written there. Sequences travel by the batch, compressed.
With a ``bpe.Packing``, ids are stored and travel with frequent ones in one byte, which compresses better; shards hold
them in their fixed width all the same.

Tokens are ids of a fixed width: a column of little-endian ids with its ``dtype`` (uint8, uint16 or uint32), and the
id ``end`` that ends a text and pads. The default takes a text's bytes as ids (uint8; 255, which UTF-8 never holds,
is the end). ``token_ids`` makes the ids of the BPE vocabulary, whose end is the first id past the vocabulary, in
the least width that holds it; the query stores those. A column that isn't whole ids raises an error.

Defined results: a null or empty text is one sequence of end and padding; null ids hash as empty ones;
repeated rows each get slots of their own; an empty table makes no shard; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import map_arrow, materialize, new_path, reader, text_chunks

STRIDE = 512
PER_SHARD = 8192
#: Bytes of text whose sequences are dealt to shards together.
BATCH_BYTES = 16 << 20
#: Of zstd, for packed ids that are stored or shuffled.
LEVEL = 6
END = 255
DTYPE = "uint8"
ROUNDS = 6
_U = np.uint64


def permute(x: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of the numbers ``x`` (each below ``n``): a permutation of 0 .. n - 1 that ``key`` picks."""
    if n <= 1:
        return np.zeros(len(x), np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)
    keys = [_U(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little")) for r in range(rounds)]
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> _U(half), v & mask
        for k in keys:
            mixed = (right ^ k) * _U(0x9E3779B97F4A7C15)
            mixed ^= mixed >> _U(29)
            mixed *= _U(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> _U(32)
            left, right = right, left ^ (mixed & mask)
        out[todo] = left << _U(half) | right
        todo = todo[out[todo] >= _U(n)]
    return out.astype(np.int64)


def width_of(dtype: str) -> int:
    if dtype not in ("uint8", "uint16", "uint32"):
        raise ValueError("ids are uint8, uint16 or uint32")
    return np.dtype(dtype).itemsize


def token_ids(df: DataFrame, model: bpe.BpeModel, id_col: str = "doc_id", text_col: str = "text", packing: bpe.Packing | None = None) -> tuple[DataFrame, str, int]:
    """The id column and ``ids`` binary, the BPE ids of each whole text; their dtype; the end id. No shuffle.

    With ``packing``, ``ids`` are packed, and ``n_tokens`` long, their number, comes between the two.
    """
    end = len(model.tokens)
    dtype = "uint16" if end < 1 << 16 else "uint32"
    return bpe.encode(df, model, id_col, text_col, dtype=dtype, packing=packing).select(id_col, *["n_tokens"] * bool(packing), "ids"), dtype, end


def sequences(df: DataFrame, ids: list[str], text_col: str = "text", stride: int = STRIDE, dtype: str = DTYPE) -> tuple[DataFrame, int]:
    """``df``'s ids and text with ``_first`` (the number of its first sequence), and the number of sequences."""
    rows, run, schema, total = _numbering(df, ids, text_col, stride, dtype)
    return map_arrow(rows, run, schema), total


def _numbering(df: DataFrame, ids: list[str], text_col: str, stride: int, dtype: str, count_col: str | None = None):
    """The rows to number, in order, and the function that does, with its schema and the number of sequences.

    Numbers are dense: the sums of the table's own partitions (one row each) give every partition its
    first number, and rows are ordered and numbered inside their partition, so that the text isn't
    shuffled. ``df`` must give the same partitions each time, as a table read from files does; a
    partition that doesn't hold what was counted raises an error. ``count_col`` has the number of ids where
    their size doesn't tell it.
    """
    spark, width = df.sparkSession, width_of(dtype)
    size = F.col(count_col) if count_col else F.floor(F.coalesce(F.octet_length(text_col), F.lit(0)) / F.lit(width))
    many = F.ceil((size + 1) / F.lit(stride)).cast("long")
    counted = df.select(F.spark_partition_id().alias("p"), many.alias("m")).groupBy("p").agg(F.sum("m").alias("m")).orderBy("p").collect()
    starts, total = {}, 0
    for r in counted:
        starts[r["p"]] = (total, r["m"])
        total += r["m"]
    held = spark.sparkContext.broadcast(starts)
    order = [F.xxhash64(*ids), *[F.col(c) for c in ids if not isinstance(df.schema[c].dataType, T.MapType)], F.xxhash64(text_col)]
    rows = df.select(*ids, *[count_col] * bool(count_col), F.col(text_col)).sortWithinPartitions(*order)
    schema = T.StructType([*rows.schema.fields, T.StructField("_first", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget_encoders()
        at, whole = held.value.get(TaskContext.get().partitionId(), (0, 0))
        stop = at + whole
        for batch in batches:
            if count_col:
                size = np.asarray(batch.column(count_col))
            else:
                size, over = np.divmod(np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0), np.int64), width)
                if over.any():
                    raise ValueError("a row that isn't whole ids")
            many = (size + stride) // stride
            first = at + np.cumsum(many) - many
            at += int(many.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int64())], names=schema.names)
        if at != stop:
            raise RuntimeError(f"a partition held {at - stop:+d} sequences against the count")

    return rows, run, schema, total


def slots(df: DataFrame, ids: list[str], n: int, key: int, text_col: str = "text", stride: int = STRIDE, per_shard: int = PER_SHARD, dtype: str = DTYPE, end: int = END) -> DataFrame:
    """Sequences by shard: each row holds those of a batch of texts that fall to one shard, their tokens compressed.

    ``shard``; arrays of the ids, ``seq``, ``part`` (the place in the text) and ``slot``; ``tokens`` binary.
    """
    rows = df.select(*ids, text_col, "_first")
    return map_arrow(rows, *_dealing(rows.schema, ids, n, key, text_col, stride, per_shard, dtype, end))


def _dealing(schema: T.StructType, ids: list[str], n: int, key: int, text_col: str, stride: int, per_shard: int, dtype: str, end: int, count_col: str | None = None, packer=None):
    """The function that ``slots`` applies to numbered rows, and its schema; ``packer`` is a broadcast ``bpe.Packing``."""
    width, narrow = width_of(dtype), np.dtype(dtype).newbyteorder("<")
    last, size = end.to_bytes(width, "little"), stride * width
    arrays = [*[T.StructField(c, T.ArrayType(schema[c].dataType)) for c in ids], T.StructField("seq", T.ArrayType(T.LongType())), T.StructField("part", T.ArrayType(T.IntegerType())), T.StructField("slot", T.ArrayType(T.LongType()))]
    fields = [T.StructField("shard", T.LongType()), *arrays, T.StructField("tokens", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL if packer else 3)
        for batch in batches:
            # A packed id takes a byte at least.
            for rows, texts in text_chunks(batch, text_col, BATCH_BYTES // width if packer else BATCH_BYTES):
                if packer:
                    whole, held = packer.value.unpack(b"".join(t or b"" for t in texts)).astype(narrow).tobytes(), np.asarray(rows.column(count_col))
                    stop = np.cumsum(held) * width
                    if len(whole) != stop[-1]:
                        raise ValueError("rows whose ids aren't as many as their count")
                    texts = [whole[a:b] for a, b in zip((stop - held * width).tolist(), stop.tolist(), strict=True)]
                many = np.array([(len(t or b"") // width + stride) // stride for t in texts], np.int64)
                of = np.repeat(np.arange(len(texts)), many)
                part = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                seq = np.asarray(rows.column("_first"))[of] + part
                slot = permute(seq, n, key)
                order = np.argsort(slot, kind="stable")
                of, part, seq, slot = of[order], part[order], seq[order], slot[order]
                shard = slot // per_shard
                edges = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
                cut = [(texts[i] or b"")[p * size : (p + 1) * size] for i, p in zip(of.tolist(), part.tolist(), strict=True)]
                tokens = [t + last * ((size - len(t)) // width) for t in cut]
                offsets = pa.array(edges, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (*[rows.column(c).take(pa.array(of)) for c in ids], pa.array(seq), pa.array(part, pa.int32()), pa.array(slot))]
                if packer:
                    data, places = packer.value.pack(np.frombuffer(b"".join(tokens), narrow), edges * stride)
                    packed = [pack.compress(data[a:b]) for a, b in zip(places.tolist(), places[1:].tolist(), strict=False)]
                else:
                    packed = [pack.compress(b"".join(tokens[a:b])) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]]), *lists, pa.array(packed, pa.binary())], names=[f.name for f in fields])

    return run, T.StructType(fields)


def write_shards(rows: DataFrame, ids: list[str], path: str, n: int, stride: int = STRIDE, per_shard: int = PER_SHARD, dtype: str = DTYPE, packer=None) -> DataFrame:
    """Write ``path``/shard-########.bin and give what was read back: ids, seq, part, slot, shard, offset, crc.

    ``path`` is a folder that all executors share. A task holds one shard at a time (``stride * per_shard``
    ids), writes it under a name of its own and renames it when it is whole, so that a task that is run
    again leaves the same files. ``packer`` is the broadcast by which the tokens are packed, if they are.
    """
    if "://" in path.removeprefix("file://"):
        raise ValueError("shards are written by plain file calls: the folder must be mounted on every executor")
    row, narrow = stride * width_of(dtype), np.dtype(dtype).newbyteorder("<")
    shards = max(1, -(-n // per_shard))
    tasks = min(shards, max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    folder = path.removeprefix("file://")
    inner = [*ids, "seq", "part", "slot"]
    fields = [*[T.StructField(c, rows.schema[c].dataType.elementType) for c in inner], *[T.StructField(c, T.LongType()) for c in ("shard", "offset", "crc")]]

    def write(shard: int, blocks: list[pa.RecordBatch]) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor()
        columns = [pa.concat_arrays([b.column(c).flatten() for b in blocks]) for c in inner]
        slot = np.asarray(columns[-1])
        data = b"".join(unpack.decompress(x.as_py(), max_output_size=4 * stride * per_shard) for b in blocks for x in b.column("tokens"))
        if packer:
            data = packer.value.unpack(data).astype(narrow)
        order = np.argsort(slot)
        name, final = os.path.join(folder, f".{shard:08d}-{uuid.uuid4().hex}"), os.path.join(folder, f"shard-{shard:08d}.bin")
        with open(name, "wb") as f:
            f.write(np.frombuffer(data, np.uint8).reshape(-1, row)[order].tobytes())
        os.replace(name, final)
        with open(final, "rb") as f:
            crcs = [zlib.crc32(f.read(row)) for _ in order]
        at = pa.array(order)
        return pa.RecordBatch.from_arrays([*[c.take(at) for c in columns], pa.array(np.full(len(order), shard)), pa.array(slot[order] % per_shard * row), pa.array(crcs, pa.int64())], names=[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget_encoders()
        os.makedirs(folder, exist_ok=True)
        now, blocks = None, []
        for batch in batches:  # ordered by shard
            for i, shard in enumerate(batch.column("shard").to_pylist()):
                if shard != now and blocks:
                    yield write(now, blocks)
                    blocks = []
                now = shard
                blocks.append(batch.slice(i, 1))
        if blocks:
            yield write(now, blocks)

    # Ranges of shards by id: task k takes shards k * size and on.
    size = -(-shards // tasks)
    dealt = rows.repartitionById(tasks, (F.col("shard") / F.lit(size)).cast("int")).sortWithinPartitions("shard")
    return map_arrow(dealt, run, T.StructType(fields))


def read_slots(path: str, start: int, count: int, n: int, stride: int = STRIDE, per_shard: int = PER_SHARD, dtype: str = DTYPE) -> Iterator[bytes]:
    """Sequences start .. start + count - 1 in training order, read sequentially from where they lie."""
    folder, row = path.removeprefix("file://"), stride * width_of(dtype)
    slot, stop = start, min(n, start + count)
    while slot < stop:
        shard, inside = divmod(slot, per_shard)
        with open(os.path.join(folder, f"shard-{shard:08d}.bin"), "rb") as f:
            f.seek(inside * row)
            for _ in range(min(stop - slot, per_shard - inside)):
                yield f.read(row)
                slot += 1


def materialise(df: DataFrame, path: str, key: int, ids: list[str], text_col: str = "text", stride: int = STRIDE, per_shard: int = PER_SHARD, dtype: str = DTYPE, end: int = END, packing: bpe.Packing | None = None, count_col: str = "n_tokens") -> DataFrame:
    """All of the above: shards under ``path``; returns the index of what they hold.

    With ``packing``, ``text_col`` holds packed ids, as many as ``count_col`` says.
    """
    packer = df.sparkSession.sparkContext.broadcast(packing) if packing else None
    counted = count_col if packing else None
    rows, number, numbered, n = _numbering(df, ids, text_col, stride, dtype, counted)
    deal, schema = _dealing(numbered, ids, n, key, text_col, stride, per_shard, dtype, end, counted, packer)
    dealt = map_arrow(rows, lambda batches: deal(number(batches)), schema)  # in one worker for each task
    return write_shards(dealt, ids, path, n, stride, per_shard, dtype, packer)


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = bpe.load_model(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = reader(spark, sf_dir, "documents")
    packing = bpe.Packing.fit(docs, model)
    encoded, dtype, end = token_ids(docs, model, packing=packing)
    # Written once: ids are read twice, to be counted and to be dealt.
    stored = materialize(encoded, "token-ids", level=LEVEL)
    out = materialise(stored, new_path(spark, "shards"), key=20240607, ids=["doc_id"], text_col="ids", dtype=dtype, end=end, packing=packing)
    return out.withColumnRenamed("crc", "tokens_crc32")
