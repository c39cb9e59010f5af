import time

from pyspark.sql import functions as F

from tessera.operators import words
from tessera.plans.fixture import fixture_model
from tessera.sources import corpus
from tessera.streaming.encode import encode_stream, pretoken_stream, read_lines


def test_newlines(spark, tmp_path):
    df = spark.createDataFrame([(0, "a\r\n\nb\n"), (1, ""), (2, None)], "doc_id long, text string")
    rows = sorted(map(tuple, corpus.split_newlines(df).collect()))
    assert rows == [(0, 0, "a\r"), (0, 1, ""), (0, 2, "b"), (0, 3, ""), (1, 0, "")]
    assert corpus.split_newlines(df, keep_empty=False).count() == 2
    (tmp_path / "c.txt").write_bytes(b"a\r\nb\rc\n\nd")
    assert bytes(corpus.read_files(spark, str(tmp_path / "c.txt")).first()["content"]) == b"a\r\nb\rc\n\nd"


def test_documents_between_newlines(spark, tmp_path):
    """n newlines of a file make n + 1 documents of any bytes, numbered in order, whatever splits the files are read in."""
    import random

    rng = random.Random(3)
    made = [b"a\r\nb\xff\xc3\n\nd", b"\n", b"", b"\xef\xbb\xbfmark\nx\n", b"\xef\xbb\xbf", b"one", b"\n\n\n", bytes(rng.choice(b"ab\n\xe9\x00") for _ in range(60_000)), b"\xef\xbb\xbf\n", b"x" * 30_000 + b"\n" + b"y" * 30_000 + b"\n"]
    for k, data in enumerate(made):
        (tmp_path / f"{k} é%20.txt").write_bytes(data)
    want = [d for data in made for d in data.split(b"\n")]
    lines = [d for data in made for d in (data[:-1] if data.endswith(b"\n") else data).split(b"\n") if data and data != b"\xef\xbb\xbf"]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "7000b", "1000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = sorted((r["doc_id"], bytes(r["content"])) for r in corpus.read_documents(spark, str(tmp_path)).collect())
            assert found == list(enumerate(want)), size
            found = sorted((r["doc_id"], bytes(r["content"])) for r in corpus.read_documents(spark, str(tmp_path), last_empty=False).collect())
            assert found == list(enumerate(lines)), size
        assert corpus.read_documents(spark, str(tmp_path / "7 é%20.txt")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_manifest(spark):
    import json

    df = spark.createDataFrame([("a", "é"), ("a", None), ("b", "xy"), (None, "z")], "g string, text string")
    got = sorted(map(str, map(tuple, corpus.manifest_totals(df, "g").collect())))
    assert got == sorted(map(str, [("a", 2, 2, False), ("b", 1, 2, False), (None, 1, 1, False), (None, 4, 5, True)]))
    assert json.loads(corpus.manifest_json(df, "g").first()["json"]) == {"bytes": 5, "docs": 4, "groups": 3, "per_group": {"": {"bytes": 1, "docs": 1}, "a": {"bytes": 2, "docs": 2}, "b": {"bytes": 2, "docs": 1}}}
    assert json.loads(corpus.manifest_json(df.limit(0), "g").first()["json"])["docs"] == 0


def test_hex(spark, tmp_path):
    (tmp_path / "h.txt").write_text("61 62\n\n6\nzz\nFFfe\n")
    found = corpus.read_hex_corpus(spark, str(tmp_path / "h.txt")).orderBy("doc_id").collect()
    rows = [(None if r["content"] is None else bytes(r["content"]), r["status"]) for r in found]
    assert [r["doc_id"] for r in found] == [0, 1, 2, 3, 4]
    assert rows == [(b"ab", "ok"), (b"", "ok"), (None, "bad_hex"), (None, "bad_hex"), (b"\xff\xfe", "ok")]
    lenient = spark.createDataFrame([("6x1-6",), ("",)], "l string").select(corpus.unhex_lenient(F.col("l")).alias("b")).collect()
    assert [bytes(r["b"]) for r in lenient] == [b"a", b""]


def test_nested(spark):
    df = spark.createDataFrame([('{"Gen": {"1": {"1": "In", "2": "And"}, "x": 5}, "note": "skip"}', "KJV")], "json string, name string")
    rows = sorted(r["line"] for r in corpus.flatten_nested(df).collect())
    assert rows == ["KJV|Gen|1|1\tIn", "KJV|Gen|1|2\tAnd"]
    assert corpus.manifest(spark.createDataFrame([("a", "é"), ("a", None)], "g string, text string"), "g").first()["bytes"] == 2


def test_nested_query_takes_whole_texts(spark, tmp_path):
    import __spark_entry__ as entry

    texts = ["été 12, \"quoted\" \\ back\nnew\tline\r\u0001", "Все люди 日本 🎉", "word " * 5000 + "end", "", "{\"a\": {\"b\": 1}}"]
    rows = [(k, t, "en", "web") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, entry.queries()["nested_corpus"](spark, str(tmp_path)).collect()))
    assert got == [("T", "en", "web", str(k), t, f"T|en|web|{k}\t{t}") for k, t in enumerate(texts)]


def test_counts(spark):
    df = spark.createDataFrame([(0, "aaa aaa bb"), (1, None), (2, "aaa" + "x" * 20)], "doc_id long, text string")
    stats = words.word_stats(df).first()
    assert tuple(stats) == (3, 3, 3, 259)
    pairs = {(r["a"], r["b"]): r["n"] for r in words.pair_count(df).collect()}
    assert pairs[(97, 97)] == 4 and pairs[(32, 97)] == 1
    assert words.word_stats(df.limit(0)).first()["total"] == 0


def test_classes_beyond_the_jvm_and_contractions(spark, tmp_path):
    """The class and contraction queries over texts that hold what the driver's lack."""
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "\u0870\u0871 it's we'll I'm 1\u0663 \U00010d40 \u2003x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: {r[0]: r["n"] for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert run("contraction_count") == {"'s": 1, "'ll": 1, "'m": 1}
    assert run("pretoken_class_hist") == {"letter": 5, "contraction": 3, "number": 2, "space": 2}


def test_plan_prunes_and_aggregates_first(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = words.word_count(df)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan and "partial_count" in plan


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("the cat\n\nthe")
    lines = read_lines(spark, str(tmp_path / "in"))
    for name, df in (("p", pretoken_stream(lines).select("text", "pieces")), ("e", encode_stream(lines, fixture_model()))):
        q = df.writeStream.format("memory").queryName(f"s_{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        time.sleep(0.1)
    assert sorted(r["text"] for r in spark.table("s_p").collect()) == ["", "the", "the cat"]
    got = {r["text"]: r["ids"] for r in spark.table("s_e").collect()}
    assert got[""] == [] and len(got["the"]) < 3


def test_entry_without_llm(tmp_path):
    """The entry module, the queries and the library import where the llm folder and the pipeline are absent."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'encode_ids' in q and not any(k.startswith('op') for k in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
