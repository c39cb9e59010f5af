import json

import pytest

from tessera.operators.encode import decode, encode, encode_by_join, explain_stages, ids_text, merge_pieces, run_summary, scan_binary, split_specials
from tessera.operators.train import merge_words, to_model, train
from tessera.plans.fixture import fixture_model
from tessera.plans.model import AddedToken, BpeModel, ModelError, dump_model, load_model, parse_model, save_model


def model_of(rules, added=()):
    tokens = [bytes([b]) for b in range(256)]
    for a, b in rules:
        if a + b not in tokens:
            tokens.append(a + b)
    return BpeModel(tuple((t, i) for i, t in enumerate(tokens)), tuple(rules), tuple(added))


def test_merge_vectors():
    m = model_of([(b"a", b"b"), (b"ab", b"c")])
    assert m.merge(b"abc") == [b"abc"] and m.merge(b"xy") == [b"x", b"y"]
    assert model_of([]).merge(b"abc") == [b"a", b"b", b"c"]
    tricky = model_of([(b"a", b"b"), (b"abc", b"d"), (b"ab", b"c")])
    assert tricky.merge(b"abcd") == [b"abcd"] and not tricky.folds
    assert model_of([(b"a", b"a")]).merge(b"aaa") == [b"aa", b"a"]


def plain_merge(m, data):
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        found = [(m.ranks[p], p) for p in zip(parts, parts[1:], strict=False) if p in m.ranks]
        if not found:
            return parts
        pair, i = min(found)[1], 0
        while i + 1 < len(parts):
            if (parts[i], parts[i + 1]) == pair:
                parts[i : i + 2] = [b"".join(pair)]
            i += 1


def test_merge_against_plain_merging():
    """Rules in any order, such as those whose product has a lower rank than a side."""
    import random

    rng = random.Random(6)
    for _ in range(300):
        tokens, rules = [b"a", b"b", b"c"], []
        for _ in range(rng.randint(1, 12)):
            rules.append((rng.choice(tokens), rng.choice(tokens)))
            tokens.append(b"".join(rules[-1]))
        rng.shuffle(rules)
        m = model_of(list(dict.fromkeys(rules)))
        for _ in range(6):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90)))
            assert m._merge_short(data) == m._merge_long(data) == plain_merge(m, data)
    assert b"".join(m.merge(b"abc" * 50_000)) == b"abc" * 50_000


def test_repeated_ids_stay_apart(spark):
    m = fixture_model()
    df = spark.createDataFrame([(1, "the"), (1, "cat"), (1, "cat"), (2, ""), (2, None), (None, "the cat")], "doc_id long, text string")
    got = lambda d: sorted(str(tuple(r)) for r in d.collect())
    assert got(encode_by_join(df, m)) == got(encode(df, m)) and encode(df, m).count() == 6


def test_splits_by_arrays_and_in_the_jvm_agree(spark):
    """Latin-1, the first plane and beyond, with characters that the JVM's own classes lack; many documents at once."""
    import random

    from pyspark.sql import functions as F

    from tessera.functions.classes import classes
    from tessera.functions.pretok import pretokens, scanner

    rng = random.Random(5)
    letters = "ab1 \n\t'\u00a0\u0085é²!\u0870\u1c89\u2003日本٣\U0001f600\U00010d40\U00010d6f\U0001e5d0\U00016d40"
    texts = ["".join(rng.choice(letters[: rng.choice([12, 20, len(letters)])]) for _ in range(rng.randint(0, 40))) + rng.choice(["", "'s it", "x're'll ", " 's's", "''ve"]) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pretokens(spark, F.col("t")).alias("p")).collect()
    pieces, counts = scanner(classes(spark)).split([r["t"].encode() for r in rows])
    assert pieces == [p.encode() for r in rows for p in r["p"]] and counts.tolist() == [len(r["p"]) for r in rows]
    found, number, again = scanner(classes(spark)).distinct([r["t"].encode() for r in rows])
    assert [found[k] for k in number] == pieces and len(set(found)) == len(found) and again.tolist() == counts.tolist()


def test_merging_by_arrays_and_by_rounds_of_joins(spark):
    """Rules in any order, such as those that can't be applied in the order of ranks, and long pieces, against plain merging."""
    import random

    import numpy as np

    from tessera.plans.merging import MISS, BatchMerger

    rng = random.Random(8)
    for turn in range(60):
        tokens, rules = [b"a", b"b", b"c"], []
        for _ in range(rng.randint(0, 12)):
            rules.append((rng.choice(tokens), rng.choice(tokens)))
            tokens.append(b"".join(rules[-1]))
        rng.shuffle(rules)
        m = model_of(rules) if turn else model_of([(b"a", b"b"), (b"abc", b"d"), (b"ab", b"c")])
        words = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.choice([1, 2, 5, 12, 40, 70, 90]))) for _ in range(30)} | {b"abcd"})
        want = [plain_merge(m, w) for w in words]
        assert BatchMerger(m).ids_of(words) == [np.array([m.ids.get(s, MISS) for s in w], "<i8").tobytes() for w in want]
        if turn < 2:
            df = spark.createDataFrame([(bytearray(w),) for w in [*words, *words]], "piece binary")
            got = {bytes(r["piece"]): [bytes.fromhex(s) for s in r["symbols"]] for r in merge_pieces(df, m).collect()}
            assert got == dict(zip(words, want, strict=True)) and (turn or got[b"abcd"] == [b"abcd"])
    assert [r["symbols"] for r in merge_pieces(spark.createDataFrame([("ab",)], "piece string"), model_of([])).collect()] == [["61", "62"]]
    assert merge_pieces(spark.createDataFrame([], "piece string"), model_of([(b"a", b"b")])).count() == 0


def test_stages_of_a_real_model(spark):
    """All ways of encoding agree under 50 thousand rules, text or bytes, and stages hold every symbol."""
    public = pytest.importorskip("public_tokenizers")
    m = load_model(spark, public.path("byte_bpe_50k.json"))
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    df = df.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 200 + " naïve 'll"), (5, "twice")], "doc_id long, text string"))
    got = lambda d: sorted(str(tuple(r)) for r in d.collect())
    whole = got(encode(df, m))
    assert got(encode_by_join(df, m)) == whole
    rows = explain_stages(df.where("doc_id != 5"), m).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["pos"], r["sym_pos"])):
        ids.setdefault(r["doc_id"], []).append(r["token_id"])
        assert r["symbol"] in r["piece_hex"] and m.ids[bytes.fromhex(r["symbol"])] == r["token_id"]
    want = {r["doc_id"]: r["ids"] for r in encode(df, m).collect()}
    assert ids == {k: v for k, v in want.items() if v and k != 5}
    raw = df.select("doc_id", df["text"].cast("binary").alias("text")).unionByName(spark.createDataFrame([(-9, bytearray(b"ab \xff\xe9 cd\xc3"))], "doc_id long, text binary"))
    assert got(encode_by_join(raw, m)) == got(encode(raw, m)) != whole


def test_long_documents_are_cut_where_a_piece_begins(spark, monkeypatch):
    from tessera.functions.classes import classes
    from tessera.operators import encode as enc
    from tessera.plans.merging import BatchMerger

    m = fixture_model(True)
    text = ("the cat 's " * 3 + " 12 don't<|endoftext|>  x\n") * 400
    df = spark.createDataFrame([(0, text), (1, ""), (2, text[5:] + "ab " * 3000)], "doc_id long, text string")
    want = encode(df, m, stats=True).collect()
    monkeypatch.setattr(enc, "TOGETHER_BYTES", 100)
    encoder = enc.Encoder(BatchMerger.of(m), classes(spark))
    ids, size, pieces, special = encoder.encode([r["text"].encode() for r in df.collect()])
    assert ids.tolist() == [i for r in want for i in r["ids"]] and size.tolist() == [len(r["ids"]) for r in want]
    assert (pieces - special).tolist() == [r["n_pretokens"] for r in want]
    assert len(list(encoder.parts(text.encode()))) > 400


@pytest.fixture
def small_rounds(monkeypatch):
    """Blocks, lists, guesses and spans between rewrites so small that all of their borders are crossed."""
    from tessera.operators import clusterreference, clustertrain

    for module in (clustertrain, clusterreference):
        for name, value in (("BLOCK_WORDS", 4), ("MOST_PAIRS", 6), ("MOST_STEPS", 4), ("REWRITE", 5)):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, value)


def test_training_on_the_cluster_against_plain_training(spark, small_rounds):
    import random

    from tessera.operators.clusterreference import train_reference_on_cluster
    from tessera.operators.clustertrain import train_on_cluster

    rng = random.Random(4)
    words = list({bytes(rng.choice(b"abc\xff") for _ in range(rng.randint(1, 9))): rng.randint(1, 6) for _ in range(40)}.items())
    df = spark.createDataFrame([(bytearray(w), n, k) for k, (w, n) in enumerate(words)], "piece binary, n long, first long").repartition(3)
    assert train_on_cluster(df, 14) == merge_words(words, 14) == brute(words, 14)
    assert train_reference_on_cluster(df, 9) == merge_words(words, 9, "reference")
    few = spark.createDataFrame([(bytearray(b"aaab"), 3, 0), (bytearray(b"xy"), 1, 1)], "piece binary, n long, first long")
    assert train_on_cluster(few, 50) == merge_words([(b"aaab", 3), (b"xy", 1)], 50)
    assert train_reference_on_cluster(few, 50) == merge_words([(b"aaab", 3), (b"xy", 1)], 50, "reference")
    assert train_on_cluster(few.limit(0), 5) == train_reference_on_cluster(few.limit(0), 5) == []
    lost = spark.createDataFrame([(bytearray(w), n, k) for k, (w, n) in enumerate([(b"ab", 10), (b"abc", 3), (b"bc", 4)])], "piece binary, n long, first long")
    assert train_on_cluster(lost, 9) == [(97, 98), (98, 99), (256, 99)] and train_reference_on_cluster(lost, 9) == [(97, 98), (256, 99)]


def test_a_round_settles_many_merges_and_leaves_nothing_behind(spark):
    """On real words: the same merges as the driver's loop, in a fifth as many jobs, with the written tables gone."""
    import glob

    from tessera.operators.clustertrain import train_on_cluster
    from tessera.operators.words import word_count

    words = word_count(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), most_bytes=15)
    rows = [(r["piece"].encode(), r["n"]) for r in words.orderBy("piece").collect()]
    report = {}
    assert train_on_cluster(words, 120, report) == merge_words(rows, 120)
    assert report["jobs"] <= 24
    assert not glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/tessera-train-*")


def test_the_driver_trains_on_few_words_and_its_guesses_settle_a_run(spark):
    """The driver's lane ends at a number of words that its memory holds; guessing by all words, one round settles all merges."""
    from tessera.operators import train as tr
    from tessera.operators.clustertrain import train_on_cluster
    from tessera.operators.words import word_count

    assert tr.MOST_WORDS <= 100_000
    words = word_count(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), most_bytes=15)
    report = {}
    assert len(train_on_cluster(words, 60, report)) == 60
    assert report["rounds"] == 1


def test_guesses_by_few_words_change_no_result(spark, monkeypatch):
    from tessera.operators import clusterreference, clustertrain
    from tessera.operators.train import train_pairs

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    monkeypatch.setattr(clustertrain, "GUESS_WORDS", 50)
    monkeypatch.setattr(clusterreference, "LAST_WORDS", 20)
    for mode in ("canonical", "reference"):
        assert train_pairs(docs, 12, mode, lane="cluster") == train_pairs(docs, 12, mode, lane="driver")


def test_lanes_and_bytes_train_alike(spark):
    """Both lanes, both modes, text and bytes; bytes that aren't UTF-8 are counted as they are."""
    from tessera.operators.train import train_pairs
    from tessera.operators.words import word_count, word_stats

    df = spark.createDataFrame([(0, "ab ab abc"), (1, "bc abc é"), (2, None), (3, ""), (4, "bc " * 9)], "doc_id long, text string")
    raw = df.select("doc_id", df["text"].cast("binary").alias("text"))
    for mode in ("canonical", "reference"):
        want = train_pairs(df, 6, mode)
        assert want and all(train_pairs(d, 6, mode, lane=lane) == want for d, lane in ((df, "driver"), (raw, "driver"), (raw, "cluster")))
    with pytest.raises(ValueError):
        train_pairs(df, 9, lane="other")
    counted = lambda d: sorted((bytes(r["piece"]) if not isinstance(r["piece"], str) else r["piece"].encode(), r["n"]) for r in d.collect())
    assert counted(word_count(raw)) == counted(word_count(df)) and word_stats(raw).first() == word_stats(df).first()
    broken = spark.createDataFrame([(0, bytearray(b"\xff \xe9 ab")), (1, bytearray(b"\xff\xff" * 20 + b" ab"))], "doc_id long, text binary")
    assert counted(word_count(broken, most_bytes=15)) == [(b" ab", 2), (b" \xe9", 1), (b"\xff", 1)]
    assert train(broken, 258).merges == ((b" ", b"a"), (b" a", b"b"))


def test_train_vectors():
    words = [(b"ab", 10), (b"abc", 3), (b"bc", 4)]
    assert merge_words(words, 9) == [(97, 98), (98, 99), (256, 99)]
    assert merge_words(words, 9, "reference") == [(97, 98), (256, 99)]


def brute(words, merges):
    seqs, out = [(list(w), n) for w, n in words], []
    for k in range(merges):
        count = {}
        for s, n in seqs:
            for p in zip(s, s[1:], strict=False):
                count[p] = count.get(p, 0) + n
        best = min(((-n, *p) for p, n in count.items() if n >= 2), default=None)
        if best is None:
            break
        _, a, b = best
        out.append((a, b))
        for s, _ in seqs:
            i = 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == (a, b):
                    s[i : i + 2] = [256 + k]
                i += 1
    return out


def test_canonical_training_against_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(30):
        words = list({bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 8))): rng.randint(1, 5) for _ in range(12)}.items())
        assert merge_words(words, 20) == brute(words, 20)


def test_train_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "ab ab"), (1, "ab"), (2, None), (3, "")], "doc_id long, text string")
    m = train(df, 257, ("<s>",))
    assert m.merges == ((b"a", b"b"),) and m.vocab_size == 258 and m.ids[b"<s>"] == 257
    save_model(spark, m, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    assert back.ids == m.ids and back.merges == m.merges
    got = {r["doc_id"]: r["ids"] for r in encode(df, back).collect()}
    assert got == {0: [256, 32, 256], 1: [256], 2: None, 3: []}
    with pytest.raises(ValueError):
        train(df, 256)


def test_json_rules():
    base = json.loads(dump_model(model_of([(b"a", b"b")])))
    text = lambda **k: json.dumps(base | k)
    assert parse_model(text()).merges == ((b"a", b"b"),)
    for bad in (dict(normalizer={"type": "NFC"}), dict(pre_tokenizer={"type": "Whitespace"}), dict(pre_tokenizer=None), dict(model=None), dict(model=base["model"] | {"type": "WordPiece"}), dict(model=base["model"] | {"vocab": {}})):
        with pytest.raises(ModelError):
            parse_model(text(**bad))
    change = lambda **k: parse_model(text(model=base["model"] | k))
    assert change(merges=[]).merges == () and change(merges=[["a", "b"]]).merges == ((b"a", b"b"),)
    assert change(merges=["a b c"]).merges == (None,)
    for bad in (["ab"], [" b"], ["a "], ["a ń"], ["a b", ["a", "b"]]):
        with pytest.raises(ModelError):
            change(merges=bad)
    for bad in (-1, 1 << 32, 1.5, "7"):
        with pytest.raises(ModelError):
            change(vocab={"a": bad})
    twice = text().replace('"vocab": {', '"vocab": {"a": 900, ')
    assert parse_model(twice).ids[b"a"] == 97
    with pytest.raises(ModelError):
        parse_model("{")


def test_specials(spark):
    added = [AddedToken(500, b"<s>"), AddedToken(501, b"<s>x"), AddedToken(502, b"plain", False), AddedToken(503, b""), AddedToken(504, b"<s>")]
    m = model_of([], added)
    df = spark.createDataFrame([(0, "a<s>xb<s>"), (1, "plain"), (2, "<s>"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in encode(df, m).collect()}
    assert got == {0: [97, 501, 98, 500], 1: list(b"plain"), 2: [500], 3: []}
    raw = spark.createDataFrame([(0, bytearray(b"a<s>\xff"))], "doc_id long, text binary")
    assert encode(raw, m).first()["ids"] == [97, 500, 255]
    parts = df.select(split_specials(m, df["text"]).alias("p")).collect()
    assert [tuple(x) for x in parts[0]["p"]] == [(False, "a"), (True, "<s>x"), (False, "b"), (True, "<s>")]


def test_miss_and_text_sink(spark):
    m = fixture_model(vocab_size=256)
    df = spark.createDataFrame([(0, "the"), (1, "q"), (2, ""), (3, None)], "doc_id long, text string")
    out = encode(df, m, stats=True)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[0]["status"] == "vocab_miss" and rows[0]["ids"] is None and rows[0]["vocab_misses"] == 1
    lines = {r["doc_id"]: r["line"] for r in ids_text(out).collect()}
    assert lines == {0: "ERR 11", 1: "113", 2: "", 3: ""}


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_lanes_and_partitions_agree(spark, partitions):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(partitions)
    m = fixture_model()
    a = {r["doc_id"]: r["ids"] for r in encode(df, m).collect()}
    summary = run_summary(encode(df, m)).first()
    assert summary["tokens"] == sum(map(len, a.values())) and summary["checksum"] == sum(map(sum, a.values()))
    if partitions == 4:
        assert a == {r["doc_id"]: r["ids"] for r in encode_by_join(df, m).collect()}
        text = {r["doc_id"]: r["text"] for r in df.collect()}
        assert {r["doc_id"]: bytes(r["content"]).decode() for r in decode(encode(df, m), m).collect()} == text


def test_golden_ids(spark):
    public = pytest.importorskip("public_tokenizers")
    m = load_model(spark, public.path("byte_bpe_50k.json"))
    cases = {b"": [], b"ab": [397], b"hello": [31373], b"Hello": [15496], b"a\0b": [64, 188, 65], b"a\xffb": [64, 187, 65], b"a<|endoftext|>b": [64, 50256, 65]}
    df = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(cases)], "doc_id int, text binary")
    assert {r["doc_id"]: r["ids"] for r in encode(df, m).collect()} == dict(enumerate(cases.values()))
    every = spark.createDataFrame([(0, bytearray(range(256)))], "doc_id int, text binary")
    assert len(encode(every, m).first()["ids"]) == 222


def test_scan_binary(spark):
    df = spark.createDataFrame([(0, bytearray(b"a b")), (1, bytearray(b"a \xffb")), (2, None), (3, bytearray(b""))], "k int, content binary")
    got = sorted((r["k"], r["pos"], bytes(r["piece"]), r["valid"]) for r in scan_binary(df, "k", "content").collect())
    assert got == [(0, 0, b"a", True), (0, 1, b" b", True), (1, 0, b"a", False), (1, 1, b" \xffb", False)]


def test_queries_at_the_scale_of_real_models(spark, tmp_path):
    """Training past the checkpoint and past a few merges against brute force; a real vocabulary against its library."""
    import random

    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    import __spark_entry__ as entry
    from tessera.functions.classes import classes
    from tessera.functions.pretok import scan_bytes
    from tessera.operators import words as wd

    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(pool) for _ in range(30)) for _ in range(20)] + ["The quick brown fox's 1234 naïve ideas, isn't it?", ""]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    queries = entry.queries()
    counted = [(bytes(r["piece"], "utf-8"), r["n"]) for r in wd.word_count(spark.read.parquet(str(tmp_path / "documents.parquet"))).select(wd.F.col("piece").cast("string"), "n").collect()]
    for name, k in (("train_canonical_300", 300), ("train_cluster_20", 20), ("train_cluster_300", 300)):
        table = queries[name](spark, str(tmp_path)).collect()
        want = brute(counted, k)
        assert len(table) == len(want) > 16
        assert [tuple(r)[-2:] for r in sorted(table)] == want
    first = {}
    for _, t in rows:
        for p in (x.decode() for x in scan_bytes(classes(spark), t.encode())):
            first.setdefault(p, [len(first), 0])[1] += 1
    in_order = [(p.encode(), n) for p, (_, n) in sorted(first.items(), key=lambda x: x[1][0]) if len(p.encode()) <= wd.MOST_BYTES]
    for name, k in (("train_reference_k", 300), ("train_reference_cluster", 80)):
        assert [tuple(r)[-2:] for r in sorted(queries[name](spark, str(tmp_path)).collect())] == merge_words(in_order, k, "reference")
    split = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    library = tiktoken.Encoding("b", pat_str=split, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in queries["encode_ids_50k"](spark, str(tmp_path)).collect()}
    assert got == {k: " ".join(map(str, library.encode_ordinary(t))) for k, t in rows}


def test_pieces_are_merged_without_rounds_of_joins_and_misses_counted_before_the_join(spark):
    from tessera.operators.encode import missing_symbols, symbol_rows
    from tessera.plans.fixture import fixture_model

    df = spark.createDataFrame([(0, "the the thing \u00e9t\u00e9 of"), (1, None), (2, ""), (3, "the " * 50 + "x" * 300)], "doc_id long, text string")
    assert "Join" not in merge_pieces(df.selectExpr("text AS piece"), fixture_model())._jdf.queryExecution().optimizedPlan().toString()
    model = fixture_model(vocab_size=258)
    want = symbol_rows(df, model).where("token_id is null").groupBy("symbol").count().collect()
    assert want and sorted(map(tuple, missing_symbols(df, model).collect())) == sorted(map(tuple, want))


def test_ids_are_decoded_and_encoded_in_small_stretches(spark, monkeypatch):
    from tessera.operators import encode as enc
    from tessera.plans.fixture import fixture_model

    assert enc.MEMO_PIECES <= 100_000 and enc.CHUNK_BYTES <= 2 << 20
    monkeypatch.setattr(enc, "DECODED_IDS", 3)
    df = spark.createDataFrame([(0, "the thing"), (1, None), (2, ""), (3, "ab" * 40), (4, "x")], "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["content"] for r in enc.decode(encode(df, fixture_model()), fixture_model()).collect()}
    assert {k: v and bytes(v) for k, v in found.items()} == {0: b"the thing", 1: None, 2: b"", 3: b"ab" * 40, 4: b"x"}


def test_encoding_by_join_shuffles_distinct_pieces_of_sheets(spark, monkeypatch):
    """No row for each pretoken; sheets of a few documents, keys of any type, misses, long pieces and bytes give what one pass gives."""
    from pyspark.sql import functions as F

    from tessera.operators import encode as enc

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert "Generate" not in enc.encode_by_join(docs, fixture_model())._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(enc, "SHEET_BYTES", 5000)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 9000 + " q"), (5, "twice"), (5, "twice")], "doc_id long, text string")
    docs = docs.unionByName(odd).select(F.struct("doc_id", F.lit("k").alias("k")).alias("key"), "text").coalesce(2)
    got = lambda d: sorted(str(tuple(r)) for r in d.collect())
    for m in (fixture_model(), fixture_model(vocab_size=300)):
        assert got(enc.encode_by_join(docs, m, "key")) == got(encode(docs, m, "key"))
    raw = spark.createDataFrame([(k, bytearray(b"ab \xff\xe9 cd\xc3" * k)) for k in range(900)], "doc_id long, text binary")
    assert got(enc.encode_by_join(raw, fixture_model())) == got(encode(raw, fixture_model()))


@pytest.fixture
def long_words(spark, tmp_path):
    """A folder with documents some of whose words are of over 15 bytes, and the same texts."""
    texts = ["the internationalisation the thing", "n" * 3000 + " internationalisation's \u00e9t\u00e9", "", "the " * 20 + "counterrevolutionaries counterrevolutionaries", "-" * 40 + " of the things"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), texts


def by_sql(sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet/*.parquet'")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_words_of_any_length_are_merged(spark, long_words):
    import __spark_entry__ as entry

    got = {r["piece"]: (r["n"], r["symbols"]) for r in entry.queries()["bpe_words"](spark, long_words[0]).collect()}
    assert got[" counterrevolutionaries"][0] == 2 and got["n" * 3000] == (1, " ".join(["6E"] * 3000)) and len(got["-" * 40][1].split()) == 40
    assert sorted((p, *v) for p, v in got.items()) == by_sql(long_words[0], "bpe_words")


@pytest.mark.parametrize("name", ["train_canonical_300", "train_cluster_300", "train_reference_k"])
def test_words_of_any_length_are_trained_on(spark, long_words, name):
    """Against plain training over all words, the repeated ones of over 15 bytes among them."""
    import __spark_entry__ as entry
    from tessera.functions.classes import classes
    from tessera.functions.pretok import scan_bytes

    words = {}
    for text in long_words[1]:
        for piece in scan_bytes(classes(spark), text.encode()):
            words[piece] = words.get(piece, 0) + 1
    got = [tuple(r)[1:] for r in sorted(entry.queries()[name](spark, long_words[0]).collect())]
    assert got == merge_words(list(words.items()), 300, "reference" if "reference" in name else "canonical") and got[0] == (110, 110)


def test_long_words_are_dealt_to_blocks_and_lanes_by_their_bytes(spark, monkeypatch):
    from tessera.operators import clustertrain as ct
    from tessera.operators import train as tr

    words = [(bytes([97 + k]) * 700 + b"xyz", 2) for k in range(6)]
    df = spark.createDataFrame([(bytearray(w), n) for w, n in words], "piece binary, n long").coalesce(1)
    monkeypatch.setattr(ct, "BLOCK_BYTES", 1000)
    assert ct._blocks(df).count() == 3 and ct.train_on_cluster(df, 20) == merge_words(words, 20)
    assert tr._fits_driver(df)
    monkeypatch.setattr(tr, "MOST_WORDS_BYTES", 1000)
    assert not tr._fits_driver(df)


@pytest.mark.parametrize("name", ["train_cluster_k", "train_canonical_k"])
def test_training_on_words_of_any_length_is_what_sql_gives(spark, long_words, name):
    import __spark_entry__ as entry

    got = sorted(map(tuple, entry.queries()[name](spark, long_words[0]).collect()))
    assert got == by_sql(long_words[0], name) and got[0] == (0, 110, 110)


def test_training_with_sql_goes_past_where_the_modes_part(spark):
    """Order-dependent training can part from the canonical one late, at merge 194 of the reference's corpus."""
    import __spark_entry__ as entry

    docs = "/root/testdata/sf0.001"
    got = [tuple(r) for r in sorted(entry.queries()["train_canonical_k"](spark, docs).collect())]
    assert len(got) >= 300 and got == [tuple(r) for r in sorted(entry.queries()["train_canonical_300"](spark, docs).collect())]
