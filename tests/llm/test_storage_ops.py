"""Training order, media, nearest neighbours, the pipeline."""

import hashlib
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, feistel, multiindex, queries, webp


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation(n):
    a, b = feistel.permute(np.arange(n), n, 5), feistel.permute(np.arange(n), n, 6)
    assert sorted(a.tolist()) == list(range(n)) == sorted(b.tolist())
    assert n < 10 or not np.array_equal(a, b)


def test_shards(spark, tmp_path):
    docs = [(1, "abc"), (2, None), (3, ""), (None, "x" * 3000), (4, "y" * 511), (5, "y" * 512), (6, "é" * 700), (6, "é" * 700)]
    path = str(tmp_path / "in")
    spark.createDataFrame([(*d, 9, "k") for d in docs], "doc_id long, text string, seq long, shard string").repartition(3).write.parquet(path)
    df, out = spark.read.parquet(path), str(tmp_path / "out")
    rows = feistel.materialise(df, out, 3, ["doc_id"], per_shard=5).toPandas()
    n = len(rows)
    assert n == sum(len((t or "").encode()) // 512 + 1 for _, t in docs)
    assert sorted(rows.slot) == list(range(n)) and (rows.offset == rows.slot % 5 * 512).all()
    stored = list(feistel.read_slots(out, 0, n, n, per_shard=5))
    assert list(feistel.read_slots(out, 7, 4, n, per_shard=5)) == stored[7:11]
    texts = sorted(b"".join(stored[s] for s in part.sort_values("seq").slot).rstrip(b"\xff") for _, part in rows.assign(first=rows.seq - rows.part).groupby("first"))
    assert texts == sorted((t or "").encode() for _, t in docs)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none"))
    assert feistel.materialise(spark.read.parquet(str(tmp_path / "none")), str(tmp_path / "o2"), 3, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        feistel.write_shards(df, ["doc_id"], "hdfs://x/y", 1)


@pytest.mark.parametrize("dtype", ["uint16", "uint32"])
def test_shards_of_vocabulary_ids(spark, tmp_path, dtype):
    """BPE ids, most of them above 255, come back from the shards as the encoder gave them."""
    import public_tokenizers

    model = bpe.load_model(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [(1, "the cat and the dog"), (2, None), (3, ""), (4, "été " * 900), (5, "word" * 4), (5, "word" * 4), (None, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in bpe.encode(df, model).collect())
    assert max(map(max, filter(None, want))) > 255
    ids, narrow, end = feistel.token_ids(df, model)
    assert narrow == "uint16" and end == len(model.tokens)
    if dtype == "uint32":
        ids = bpe.encode(df, model).select("doc_id", "ids")
    path, out = str(tmp_path / "ids"), str(tmp_path / "out")
    ids.write.parquet(path)
    df = spark.read.parquet(path)
    rows = feistel.materialise(df, out, 3, ["doc_id"], "ids", 16, 5, dtype, end).toPandas()
    n, width = len(rows), np.dtype(dtype).itemsize
    assert n == sum(len(x) // 16 + 1 for x in want) and (rows.offset == rows.slot % 5 * 16 * width).all()
    stored = [np.frombuffer(x, "<" + np.dtype(dtype).str[1:]).tolist() for x in feistel.read_slots(out, 0, n, n, 16, 5, dtype)]
    got = []
    for _, part in rows.assign(first=rows.seq - rows.part).groupby("first"):
        whole = [i for s in part.sort_values("seq").slot for i in stored[s]]
        assert end in whole and set(whole[whole.index(end) :]) == {end}
        got.append(whole[: whole.index(end)])
    assert sorted(got) == want
    with pytest.raises(ValueError):
        feistel.width_of("int8")


WAYS = [
    {}, {"flat": False}, {"flat": False, "cache_bits": 4}, {"flat": False, "cache_bits": 9, "references": False}, {"flat": False, "transforms": (2,)}, {"flat": False, "transforms": (1, 2, 0)},
    {"flat": True, "transforms": (3,)}, {"flat": False, "transforms": (3,), "cache_bits": 3}, *[{"flat": False, "transforms": (0,), "modes": np.array([m])} for m in range(14)],
]


@pytest.mark.parametrize("way", WAYS)
def test_webp_round_trip(way):
    rng = np.random.default_rng(1)
    for colours in (1, 2, 3, 16, 17, 200):
        h, w = rng.integers(1, 14), rng.integers(1, 19)
        image = rng.integers(0, 256, (colours, 4))[rng.integers(0, colours, (h, w))].astype(np.uint8)
        assert np.array_equal(webp.decode(webp.encode(image, **way)), image)
    image = np.resize(np.arange(50, dtype=np.uint8), (20, 20, 4))
    assert np.array_equal(webp.decode(webp.encode(image, **way)), image)


def test_webp_refuses():
    for bad in (b"", b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0", webp.encode(np.zeros((1, 1, 4), np.uint8))[:20] + b"\0" * 9):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_media_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "é" * 40, 3), (None, "x" * 1_100_000, 4), (3, "é" * 40, 5)], "doc_id long, text string, n_bytes long")
    rows = webp.describe(webp.store(df)).collect()
    by = {(r["doc_id"], r["n_bytes"]): r for r in rows}
    assert by[(1, 0)]["payload_bytes"] == 64 and by[(1, 0)]["media_sha256"] == by[(2, 0)]["media_sha256"]
    assert by[(3, 80)]["payload_bytes"] == 128 and by[(None, 1_100_000)]["payload_bytes"] == 1_100_032
    assert len(rows) == 5 and webp.describe(webp.store(df.limit(0))).count() == 0


def test_media_query_against_plain_digests(spark, tmp_path):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 64), (-4, "é" * 32 + "y"), (-5, "ab" * 70_000)], texts.schema)
    texts.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in webp.op9_media(spark, str(tmp_path)).collect()}
    media = {r["doc_id"]: r["media"] for r in webp.store(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    rows = texts.unionByName(odd).collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media[doc_id]), hashlib.sha256(media[doc_id]).hexdigest())
        assert r["feature"] == f"64x{len(payload) // 64} {np.mean(list(payload)):.3f} {len(set(payload))}"


def test_media_in_several_files(monkeypatch):
    monkeypatch.setattr(webp, "MOST_PAYLOAD", 640)
    payload = np.random.default_rng(4).bytes(640 * 3 + 128)
    got, images = webp.from_media(webp.to_media(payload))
    assert got == payload and [i.size for i in images] == [2560, 2560, 2560, 512]
    assert webp.feature(images).startswith("64x10 64x10 64x10 64x2 ")


def test_media_is_compressed():
    rng = np.random.default_rng(3)
    words = ["der", "la", "running", "été", "house", "x"]
    prose = " ".join(words[i] for i in rng.integers(0, 6, 4000)).encode()
    gray = np.repeat(rng.integers(0, 256, 3000), 4).astype(np.uint8).tobytes()  # red, green and blue alike
    noise = rng.bytes(70_016)
    few = bytes(rng.choice([1, 2, 3], 128)) + b"abcd" * 5000
    far = rng.bytes(300_032) + prose[:4000]
    for payload, most in ((prose, 0.6), (prose + prose, 0.45), (gray, 0.7), (noise, 1.02), (few, 0.05), (far + far, 0.52), (b"\0" * 64, 1.0), (b"\0" * 640_000, 0.001)):
        payload += b"\0" * (-len(payload) % 64)
        media = webp.to_media(payload)
        assert webp.from_media(media)[0] == payload
        assert len(media) <= most * len(payload) + 40
    assert webp.decode_pixels(webp.to_media(gray))[1] == 64


def test_grey_files_by_the_general_reader(monkeypatch):
    """What ``encode_grey`` writes, read symbol by symbol by the reader of all images, and by its own."""
    rng = np.random.default_rng(5)
    for n, of in ((64, 256), (6400, 20), (64_000, 256), (12_800, 3)):
        samples = rng.integers(0, of, n).astype(np.uint8)
        samples[n // 2 :] = np.resize(samples[: n // 3], n - n // 2)
        samples[: n // 8] = 7
        file = webp.encode_grey(samples, 64)
        want = np.repeat(samples, 3).reshape(-1, 64, 3)
        assert np.array_equal(webp.decode(file)[..., :3], want)
        with monkeypatch.context() as m:
            m.setattr(webp, "_read_one_channel", lambda bits, width, total, group: np.array(webp._read_symbols(bits, width, total, [group], None, 0, 0), np.uint32))
            assert np.array_equal(webp.decode(file)[..., :3], want)


def exact(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        s[i] = -np.inf
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]
    return out


def test_neighbours(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").limit(3000).toPandas()
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    index, cells = multiindex.build(df, 20)
    want = exact(ids, x, 20)
    got = {}
    for r in sorted(multiindex.search(index, cells, index.where("id % 20 = 0").select("id", "v"), 20).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    scores = {(q, a): s for q, rows in got.items() for a, s in rows}
    by = dict(zip(ids.tolist(), x, strict=True))
    assert all(s == (by[a] * by[q]).sum() for (q, a), s in scores.items())


def test_neighbours_of_clustered_vectors(spark):
    """Where vectors have clusters, a small share of them is visited; cells and blocks are cut."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(400, 32))
    x = centres[rng.integers(0, 400, 20_000)] + 0.25 * rng.normal(size=(20_000, 32))
    x[5000:9000] = x[5000]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    table, index = multiindex.build(df, 20)
    assert index.share < 0.1
    some = [i for i in range(0, 20_000, 200) if not 5000 <= i < 9000] + [5000, 7000]
    got = {}
    for r in multiindex.search(table, index, table.where(F.col("id").isin(some)).select("id", "v"), 20).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hit = 0
    for q in some:
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(len(x)), -score))[:20].tolist()) & set(got[q]))
        assert all(s == score[v] for v, s in got[q].items())
    assert hit >= 0.9 * 20 * len(some)


def test_neighbours_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (7, [1.0]), (8, [float("inf"), 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cell int")
    index, cells = multiindex.build(df, 3)
    got = sorted(map(tuple, multiindex.search(index, cells, index.where("id % 20 = 0").select("id", "v"), 3).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 2, 9, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 9, 0.5)]
    index, cells = multiindex.build(df.limit(0), 3)
    assert multiindex.search(index, cells, index.select("id", "v"), 3).count() == 0


def test_index_takes_cells_in_order():
    rng = np.random.default_rng(0)
    index = multiindex.Index(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)), 1.0, rng.integers(0, 4, 35))
    q = rng.normal(size=6)
    score = ((index.first @ q[:3])[:, None] + (index.second @ q[3:])[None]).reshape(-1)
    want = [c for c in np.argsort(-score).tolist() if index.sizes[c]]
    assert index.visit(q, 10**9) == want
    some = index.visit(q, 10)
    assert some == want[: len(some)] and index.sizes[some].sum() >= 10 > index.sizes[some[:-1]].sum()


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mixing", "bpe"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == corpus_pipeline.COLUMNS, name
        now = corpus_pipeline.materialize(now, "test")
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) == now.count() and all(r["decodes"] for r in out)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, near copies; each stage against plain code."""
    from test_dedup_ops import jaccard_brute, near

    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    long = " ".join(real)[:60_000]
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(real)]
    rows += [rows[3], rows[3], (3, "another text under an id that is taken, with words of its own", None, None, None), (None, real[5], "fr", "a", 1), (None, None, None, None, None)]
    rows += [(50, "", "en", "a", 0), (51, " \n\t", "en", "a", 3), (52, long, "en", None, len(long)), (53, long + " and more", "en", "b", 1), (54, real[7] + " changed", None, "c", 2), (55, "x" * 70_000, "de", "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda r: tuple(str(x) for x in r)
    stages = dict(corpus_pipeline.STAGES)
    # 1: rows go or stay whole; what is null or has no letter goes.
    kept = stages["language_id"](spark, df, "").collect()
    assert set(map(key, kept)) <= set(map(key, rows)) and not any(r["text"] is None or not r["text"].strip() for r in kept)
    assert sum(r["text"] in real for r in kept) == sum(r[1] in real for r in rows)
    # 2: lines against all earlier lines.
    got = stages["line_dedup"](spark, df, "").collect()
    place = sorted(((i is not None, i or 0), n, line) for i, t, *_ in set(rows) if t is not None for n, line in enumerate(t.split("\n")) if line.strip(" \t"))
    want = []
    for r in rows:
        mine = [] if r[1] is None else r[1].split("\n")
        left = "\n".join(x for n, x in enumerate(mine) if not x.strip(" \t") or not any(p[:2] < ((r[0] is not None, r[0] or 0), n) and abs(len(p[2]) - len(x)) < 2 and near(x, p[2]) for p in place))
        if left:
            want.append((r[0], left, r[2], r[3], len(left)))
    assert sorted(map(key, got)) == sorted(map(key, want))
    # 3: one row for each component, of the smallest id.
    got = stages["jaccard_join"](spark, df, "").collect()
    parts = [(k, r[1]) for k, r in enumerate(rows)]
    groups: dict[str, list[int]] = {}
    for i, n, c in jaccard_brute(parts):
        groups.setdefault(c if n else f"own {i}", []).append(int(i))
    least = lambda g: min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(rows[least(g)][0]), str(rows[least(g)][1])) for g in groups.values())
    # 4: rows come whole, three times at most. 5: ids decode to the texts.
    got = stages["mixing"](spark, df, "").collect()
    assert set(map(key, got)) <= set(map(key, rows)) and all(n <= 3 * sum(key(r) == k for r in rows) for k, n in Counter(map(key, got)).items())
    got = stages["bpe"](spark, df, "").collect()
    assert len(got) == len(rows) and all(r["decodes"] for r in got) and {str(r["doc_id"]) for r in got} == {str(r[0]) for r in rows}


def test_training_order_against_plain_slots(spark, tmp_path):
    """Slots by a Feistel network on plain numbers, and digests of the sequences that the shards hold."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, bytearray(rng.integers(0, 60_000, int(rng.integers(0, 90))).astype("<u2").tobytes())) for i in range(50)], "doc_id long, ids binary")
    index = feistel.materialise(df, f"file://{tmp_path}/o", 77, ["doc_id"], "ids", stride=16, per_shard=8, dtype="uint16", end=60_001).collect()
    n = len(index)
    half = ((n - 1).bit_length() + 1) // 2

    def plain(x):
        while True:
            left, right = x >> half, x & (1 << half) - 1
            for r in range(feistel.ROUNDS):
                v = (right ^ int.from_bytes(hashlib.sha256(f"77/{r}".encode()).digest()[:8], "little")) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                v = (v ^ v >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
                left, right = right, left ^ (v ^ v >> 32) & (1 << half) - 1
            x = left << half | right
            if x < n:
                return x

    texts = {r["doc_id"]: bytes(r["ids"]) for r in df.collect()}
    end = (60_001).to_bytes(2, "little")
    assert sorted(r["seq"] for r in index) == list(range(n))
    for r in index:
        tokens = texts[r["doc_id"]][r["part"] * 32 : r["part"] * 32 + 32]
        assert r["slot"] == plain(r["seq"]) and r["crc"] == zlib.crc32(tokens + end * ((32 - len(tokens)) // 2))
        assert (r["shard"], r["offset"]) == (r["slot"] // 8, r["slot"] % 8 * 32)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.queries()} and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("piece", [3, 64, 1 << 14])
def test_one_channel_equals_the_general_reader_across_pieces(monkeypatch, piece):
    rng = random.Random(6)
    words = [bytes(rng.randrange(97, 123) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    payloads = [b" ".join(rng.choice(words) for _ in range(1200)), bytes(rng.randrange(256) for _ in range(640)), b"abcdefghijklmnopqrstuvw" * 400, b"x" * 3000 + bytes(range(64)) + b"y" * 500]
    payloads = [p + b"\0" * (-len(p) % 64) for p in payloads]
    files = [webp.to_media(p) for p in payloads]
    monkeypatch.setattr(webp, "ONE_PIECE", piece)
    found = [webp.from_media(f) for f in files]
    assert [p for p, _ in found] == payloads
    monkeypatch.setattr(webp, "_read_one_channel", lambda bits, width, total, group: np.array(webp._read_symbols(bits, width, total, [group], None, 0, 0), np.uint32))
    for (_, images), f in zip(found, files, strict=True):
        assert all((a == b).all() for a, b in zip(images, webp.from_media(f)[1], strict=True))


def test_packed_ids_give_the_same_shards_in_less_room(spark, tmp_path):
    """Ids stored and sent as one to four bytes: index and shards as without, whatever the sample holds."""
    import public_tokenizers

    model = bpe.load_model(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "\U0001f9ff☃" * 600), (-4, "x" * 2000)], "doc_id long, text string")
    docs = odd.unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    docs.repartition(2).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = {}
    for name, packing in (("plain", None), ("fitted", bpe.Packing.fit(docs, model)), ("unfitted", bpe.Packing(np.zeros(len(model.tokens) + 1)))):
        ids, dtype, end = feistel.token_ids(docs, model, packing=packing)
        ids.coalesce(1).write.option("compression", "zstd").parquet(f"{tmp_path}/{name}")
        stored = spark.read.parquet(f"{tmp_path}/{name}")
        index = feistel.materialise(stored, f"{tmp_path}/{name}-out", 3, ["doc_id"], "ids", 64, 512, dtype, end, packing).collect()
        assert not packing or sum(r["n_tokens"] // 64 + 1 for r in stored.collect()) == len(index)
        size = sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
        found[name] = size, sorted(tuple(r.asDict().values()) for r in index), list(feistel.read_slots(f"{tmp_path}/{name}-out", 0, len(index), len(index), 64, 512, dtype))
    assert found["plain"][1:] == found["fitted"][1:] == found["unfitted"][1:]
    assert found["fitted"][0] < 0.9 * found["plain"][0]
    with pytest.raises(Exception, match="as many as their count"):
        feistel.materialise(stored.withColumn("n_tokens", F.col("n_tokens") + 1), f"{tmp_path}/bad", 3, ["doc_id"], "ids", 64, 512, dtype, end, packing).count()


def test_packing():
    ids = np.array([0, 127, 128, 16383, 16384, 2097151, 2097152, 2999999, 5] * 40_000)
    edges = np.array([0, 0, 1, 3, 1 << 18, (1 << 18) + 1, len(ids), len(ids)])
    packing = bpe.Packing(np.zeros(3_000_000))
    data, begin = packing.pack(ids, edges)
    assert packing.unpack(data.tobytes()).tolist() == ids.tolist()
    for (a, b), (p, q) in zip(zip(edges, edges[1:]), zip(begin, begin[1:])):
        assert packing.unpack(data[p:q].tobytes()).tolist() == ids[a:b].tolist()
    assert len(packing.unpack(b"")) == 0 and packing.pack(ids[:0], np.array([0, 0]))[1].tolist() == [0, 0]
    with pytest.raises(ValueError):
        packing.unpack(b"\x01\x80")


def test_references_are_found_and_read_in_arrays():
    """Lines of Python that run for a reference stay few: the search steps from one to the next, the reader follows items by fours."""
    rng = random.Random(8)
    words = [bytes(rng.randrange(97, 123) for _ in range(rng.randint(5, 9))) for _ in range(300)]
    payload = b" ".join(rng.choice(words) for _ in range(6000))
    payload += b"\0" * (-len(payload) % 64)
    lines: Counter = Counter()

    def tracer(frame, event, _):
        name = frame.f_code.co_name
        if name not in ("_matches", "_read_one_channel"):
            return None
        lines[name] += event == "line"
        return tracer

    before = sys.gettrace()
    sys.settrace(tracer)
    try:
        media = webp.to_media(payload)
        assert webp.from_media(media)[0] == payload
    finally:
        sys.settrace(before)
    references = 5000
    assert len(media) < 0.4 * len(payload)
    assert lines["_matches"] < 6 * references and lines["_read_one_channel"] < 8 * references, lines


def odd_payloads() -> list[bytes]:
    rng = np.random.default_rng(9)
    words = [rng.integers(97, 123, rng.integers(2, 10)).astype(np.uint8).tobytes() for _ in range(400)]
    out = [b" ".join(words[i] for i in rng.integers(0, 400, n)) for n in (20, 200, 90, 3000, 1, 60)]
    out += [rng.bytes(640), bytes(64), b"\0" * 40 + bytes(range(24)), b"z" * 61 + bytes(range(67)) + b"z" * 64, bytes(range(1, 65)), bytes(range(256)) * 9, (b"abc\n" + bytes(range(65, 90))) * 2000]
    out += [np.repeat(rng.integers(0, 99, 64), k).astype(np.uint8).tobytes() for k in (1, 3, 4, 9)]
    out += [rng.geometric(p, 1280).clip(0, 255).astype(np.uint8).tobytes() for p in (0.02, 0.1, 0.6)]
    out.append(rng.bytes(webp.UNIT * webp.MOST_SIDE + 64))  # rows of 128 pixels, the last one padded
    return [p + b"\0" * (-len(p) % 64) for p in out] * 2


@pytest.mark.parametrize("together", [1, 5000, 1 << 17])
def test_media_written_and_read_together_are_those_of_each(monkeypatch, together):
    """No file depends on what is written beside it, and no payload on what is read beside it, where images end in bytes that the next begin with too."""
    payloads = odd_payloads()
    alone = [webp.to_media(p) for p in payloads]
    monkeypatch.setattr(webp, "TOGETHER", together)
    monkeypatch.setattr(webp, "READ_TOGETHER", together)
    assert webp.to_medias(payloads) == alone
    monkeypatch.setattr(webp, "ONE_PIECE", 1 << 11)
    for mended in (6, 0):  # 0: what is not found side by side is followed one by one
        monkeypatch.setattr(webp, "MENDED", mended)
        found = webp.from_medias(alone)
        assert [p for p, _ in found] == payloads
    assert webp.to_medias([]) == [] == webp.from_medias([])
    for (_, images), file in zip(found[:20], alone, strict=False):
        assert all((a == b[..., 1]).all() and a.shape == b.shape[:2] for a, b in zip(images, webp.from_media(file)[1], strict=True))


def test_grey_images_against_codes_of_single_images():
    """Codes built and told for many images at once are those that are built for one."""
    rng = np.random.default_rng(10)
    counts = np.where(rng.random((60, 280)) < np.linspace(0, 0.5, 60)[:, None], rng.geometric(0.05, (60, 280)), 0)
    counts[-1, :30] = 2 ** np.minimum(np.arange(30), 24)  # deeper than 15 without the limit
    counts[0] = 0
    counts[1], counts[2] = np.arange(280) == 7, np.arange(280) == 270
    lengths = webp._many_lengths(counts, 15)
    assert all((a == webp._lengths(c, 15)).all() for a, c in zip(lengths, counts, strict=True))
    (row, value, size), turned, sizes = webp._write_codes(lengths)
    for k, own in enumerate(lengths):
        alone, together = webp.BitWriter(), webp.BitWriter()
        want = webp._write_code(alone, own)
        for v, n in zip(value[row == k].tolist(), size[row == k].tolist(), strict=True):
            together.put_long(v, n)
        assert together.done() == alone.done() and together.n == alone.n
        assert (turned[k] == want[0]).all() and (sizes[k] == want[1]).all()
    for entries, own in zip(webp._many_entries(lengths), lengths, strict=True):
        assert (entries == webp.Code(own.tolist()).entries).all()


def test_media_of_short_texts_take_few_calls():
    """Short texts are written and read in arrays over many of them: calls for each stay few (187; 1301 where each was by itself)."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    payloads = [" ".join(rng.choice(words) for _ in range(150)).encode() for _ in range(200)]
    payloads = [p + b"\0" * (-len(p) % 64) for p in payloads]
    calls: Counter = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        found = webp.from_medias(webp.to_medias(payloads))
    finally:
        sys.setprofile(None)
    assert [p for p, _ in found] == payloads
    assert calls["call"] + calls["c_call"] < 400 * len(payloads), calls
