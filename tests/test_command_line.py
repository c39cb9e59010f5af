import json

from tessera.__main__ import arguments, main, run


def lines_of(folder):
    """Lines of the text files of a folder, in the order of their names."""
    return [x for p in sorted(folder.glob("part-*")) for x in p.read_text().split("\n")[:-1]]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "c.txt").write_bytes(b"ab ab\nab\n\nthe cat\n")
    (tmp_path / "h.txt").write_bytes(b"6162\n61 FF 62\nzz\n\n")
    text, model = str(tmp_path / "c.txt"), str(tmp_path / "m.json")
    go = lambda *a: run(spark, arguments(list(a)))
    assert go("train", text, "--vocab-size", "257", "--out", model)[0]["merges"] == 1
    done = go("encode", text, "--model", model, "--out", str(tmp_path / "ids"))[0]
    assert done["docs"] == 5 and done["misses"] == 0 and done["rc"] == 0 and done["bytes"] == 14
    assert lines_of(tmp_path / "ids") == ["256 32 256", "256", "", "116 104 101 32 99 97 116", ""]
    assert sum(int(i) for x in lines_of(tmp_path / "ids") for i in x.split()) == done["checksum"]
    assert {k: v for k, v in go("encode", text, "--model", model)[0].items() if k not in ("seconds", "mb_per_s")} == {k: v for k, v in done.items() if k not in ("seconds", "mb_per_s")}
    done = go("encode", "--hex", str(tmp_path / "h.txt"), "--model", model, "--out", str(tmp_path / "hex_ids"))[0]
    assert (done["docs"], done["bad"], done["rc"]) == (4, 1, 1) and lines_of(tmp_path / "hex_ids") == ["256", "97 255 98", "ERR 7", ""]
    assert go("words", text, "--top", "1")[1] == {"piece": "ab", "n": 2}
    assert go("words", "--hex", str(tmp_path / "h.txt"), "--top", "9")[1:] == [{"piece": p, "n": 1} for p in ("ab", "a\\xffb")]
    assert [(r["pos"], r["symbol"]) for r in go("stages", text, "--model", model, "--limit", "3")] == [(0, "6162"), (1, "20"), (1, "6162")]
    assert [r["symbol"] for r in go("stages", "--hex", str(tmp_path / "h.txt"), "--model", model)] == ["6162", "61", "FF", "62"]
    (made,) = go("manifest", text, "--out", str(tmp_path / "manifest"))
    assert (made["docs"], made["bytes"], made["groups"]) == (5, 14, 1) and json.loads(lines_of(tmp_path / "manifest")[0]) == made
    assert main(["words", text]) == 0 and json.loads(capsys.readouterr().out)["total"] == 5


def test_encoded_lines_keep_the_order_of_documents(spark, tmp_path):
    """Many documents of several files, read in many splits: line by line, with misses where the vocabulary lacks a symbol."""
    import random

    from tessera.plans.fixture import fixture_model
    from tessera.plans.model import dump_model

    rng = random.Random(2)
    docs = [b" ".join(rng.choice([b"the", b"cat", b"\xff", b"of"]) for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_bytes(b"\n".join(docs[1000 * k : 1000 * k + 1000]))
    m = fixture_model(vocab_size=260)
    (tmp_path / "m.json").write_text(dump_model(m))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        done = run(spark, arguments(["encode", str(tmp_path / "in"), "--model", str(tmp_path / "m.json"), "--out", str(tmp_path / "ids")]))[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    from tessera.functions.classes import classes
    from tessera.functions.pretok import scan_bytes

    want = []
    for d in docs:
        ids = [m.ids.get(s) for p in scan_bytes(classes(spark), d) for s in m.merge(p)]
        want.append("ERR 11" if None in ids else " ".join(map(str, ids)))
    assert lines_of(tmp_path / "ids") == want and done["docs"] == 3000 and done["misses"] == want.count("ERR 11") > 0
    assert done["tokens"] == sum(len(w.split()) for w in want if w != "ERR 11") and done["bytes"] == sum(map(len, docs))
