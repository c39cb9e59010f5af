"""BPE, mixing, language ID, quality: against other implementations, brute force and held-out accuracy."""

import hashlib
import math
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, _hash string"


def odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names clash with the operators' own."""
    rows = [
        (1, "the cat and the dog", "en", "a", 19, 7, 0.5, "x"), (1, "the cat and the dog", "en", "a", 19, 7, 0.5, "x"), (2, None, "en", "a", None, None, None, None),
        (3, "", None, None, 0, 0, None, None), (None, "le chat et le chien", "fr", "b", 19, 1, None, None), (4, "12 34 !!", "fr", None, 8, 1, None, None),
        (5, "word " * 30000, "en", "b", 150000, 1, None, None), (6, "x" * 70000, None, "c", 70000, 1, None, None), (7, "日本 ½  é", "en", "c", 7, 1, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def model():
    return bpe.load_model(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(model):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(model.tokens)}, special_tokens={})


def test_bpe_equals_the_library(model, library):
    rng, encoder = random.Random(1), bpe.Encoder(model)
    parts = ["a", "b", "e", "th", " ", "  ", "\n", "é", "ß", "漢", "́", "🎉", "1", "½", "'s", "'ll", "'", "!", "%%%", "\x1c", "\x85", "\xa0", "　", "\U00020000", "\U00032000", "the", "tion", "aaaaaaaa", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 50000, " " * 5000 + "x", "ab" * 20000]
    for t in texts:
        ids = encoder.encode(t.encode())
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t), t[:50]
        assert encoder.decode(ids) == t.encode()


def test_bpe_of_texts_encoded_together_equals_the_library(model, library):
    rng, encoder = random.Random(2), bpe.Encoder(model)
    parts = ["'s", "'re", "'ve", "'l", "'ll", "'r", "'", "e", "l", " ", "  ", "\n", "\xa0", "　", "é", "ß", "漢", "🎉", "1", "½", "!", "the", "\0", "schheit", "thwhlyou", "x" * 80]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    for _ in range(2):  # the second time from memory
        ids, begin = encoder.encode_texts([t.encode() for t in texts])
        assert len(begin) == len(texts) + 1 and begin[-1] == len(ids)
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]
    words = sorted({"".join(rng.choice("abcdeinrst") for _ in range(rng.randint(2, 30))).encode() for _ in range(3000)})
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.pieces(words)] == [encoder.piece(w) for w in words]


def test_bpe_rows(spark, model, library):
    out = bpe.encode(odd_rows(spark), model, decode=True).collect()
    assert len(out) == 9
    by = {(r["doc_id"], r["n_tokens"]): bytes(r["decoded"]) for r in out}
    assert by[(2, 0)] == b"" and by[(3, 0)] == b"" and (None, len(library.encode_ordinary("le chat et le chien"))) in by
    assert bpe.encode(odd_rows(spark).limit(0), model, check=True).count() == 0


def mix_brute(rows, weights=mixing.WEIGHTS, cap=mixing.CAP):
    size = {}
    for _, s, n in rows:
        size[s] = size.get(s, 0) + n
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, left = sum(size.values()), {}, set(names)
    while left:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > cap * size[s]}
        if not over:
            target |= share
            break
        target |= {s: cap * size[s] for s in over}
        left -= over
    return size, target


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "a", "b", "c", "B", "é"] + ["hot"] * 6), rng.randint(0, 40)) for i in range(800)]
    df = spark.createDataFrame([(i, s, "w " * n if n else None) for i, s, n in rows], "doc_id long, source string, text string")
    out = mixing.mix(df).collect()
    size, target = mix_brute(rows)
    n = {i: k for i, _, k in rows}
    taken = dict.fromkeys(size, 0)
    for r in out:
        assert r["size"] == n[r["doc_id"]] and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 40
    again = {r["doc_id"]: tuple(r) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: tuple(r) for r in out}
    ordered = mixing.training_order(df)
    assert ordered.columns == df.columns and ordered.count() == sum(r["copies"] for r in out)


def test_mixing_follows_the_schedule(spark):
    df = spark.createDataFrame([(i, s, "w " * 10) for i, s in enumerate("abc" * 400)], "doc_id long, source string, text string")
    out = [(p, r["source"]) for r in mixing.mix(df).collect() for p in r["positions"]]
    early = lambda s: sum(p < 0.5 for p, x in out if x == s) / sum(x == s for _, x in out)
    assert early("a") == pytest.approx(0.625, abs=0.01) and early("b") == pytest.approx(0.5, abs=0.01) and early("c") == pytest.approx(0.3, abs=0.01)


def test_training_order_by_position_and_with_clashing_columns(spark):
    names = ["doc_id", "source", "text", "_hash", "_size", "_part", "_id", "_at", "_rest", "_positions"]
    rows = [(i, "abc"[i % 3], "w " * (1 + i % 7) if i % 11 else None, *[f"{i}{c}" for c in names[3:]]) for i in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    placed = sorted((p, hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]) for r in mixing.mix(df).collect() for p in r["positions"])
    got = [tuple(r) for r in mixing.training_order(df).collect()]
    assert [r[0] for r in got] == [i for _, _, i in placed] and set(got) <= set(rows)


def test_mix_numbers_copies_by_range_sort(spark):
    rows = [(i % 290 if i % 13 else None, "abc"[i % 3] if i % 17 else None, "w " * (i % 7) if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    out = mixing.mix(df).collect()
    assert len(out) == 300
    copies = sorted((place, at, r["doc_id"], r["source"]) for r in out for at, place in zip(r["positions"], r["places"], strict=True))
    assert [c[0] for c in copies] == list(range(sum(r["copies"] for r in out)))
    assert [c[1] for c in copies] == sorted(c[1] for c in copies)
    unique = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    placed = sorted((place, r["doc_id"]) for r in mixing.mix(unique).collect() for place in r["places"])
    assert [r["doc_id"] for r in mixing.training_order(unique).collect()] == [i for _, i in placed]


def test_mixing_odd_rows_and_sql(spark):
    df = odd_rows(spark)
    assert mixing.mix(df).count() == 9 and mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text is null")).first()["taken"] == 0
    assert mixing.training_order(df).columns == df.columns
    con = duckdb.connect()
    con.register("documents", df.dropDuplicates(["doc_id"]).toPandas().astype({"doc_id": "Int64"}))
    want = {r[0]: r[1:5] for r in con.execute(mixing.OP1_SQL).fetchall()}
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(df.dropDuplicates(["doc_id"])).collect()}
    assert got == {k: (v[0], v[1], pytest.approx(v[2]), v[3]) for k, v in want.items()}


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    held = langid.predict(docs.where(langid.held_out()), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and not r["rejected"] for r in held)
    odd = odd_rows(spark)
    rows = langid.predict(odd.drop("score"), model).collect()
    for r in rows:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4))
    assert langid.filter_known(odd, model).columns == odd.columns
    assert {r["doc_id"] for r in langid.filter_known(odd, model).collect()} >= {1, None, 5}
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs.limit(5), nothing).collect()} == {"und"}


def test_language_rejects_what_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    rng = random.Random(4)
    strange = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve kardeşçe hareket etmelidirler.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        *["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(n)) for n in (200, 2000, 20_000)],
        *[rng.randbytes(n).hex() for n in (1000, 10_000)],
    ]
    df = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    assert [r["doc_id"] for r in langid.predict(df, model).collect() if not r["rejected"]] == []
    assert langid.filter_known(df, model).count() == 0
    assert langid.filter_known(docs, model).count() == docs.count()


def test_language_against_plain_cosines(spark):
    """Counts, TF-IDF, cosines and limits of the fitted model, gram by gram."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    table = docs.select("doc_id", "text").where("doc_id % 25 = 0").unionByName(odd_rows(spark).select("doc_id", "text").where("length(text) < 1000 or text is null"))
    slot = lambda code: (code * 2654435761 & 0xFFFFFFFF) >> 19

    def plain(text):
        if text is None or not any(c.isalpha() for c in text):
            return "und", 0.0, True
        words = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode()).split()
        data, counts = b" " + b" ".join(words) + b" ", {}
        for order in (1, 2, 3):
            for i in range(len(data) - order + 1):
                code = int.from_bytes(data[i : i + order], "big") + (order << 25) + (1 << 24 if order == 2 else 0)
                counts[slot(code)] = counts.get(slot(code), 0) + 1
        weight = {g: math.log1p(n) * float(model.idf[g]) for g, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in weight.values()))
        cosines = [sum(v * float(c[g]) for g, v in weight.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        return model.langs[best], cosines[best], cosines[best] < max(model.least, float(model.limits[best, len(counts).bit_length()]))

    want = sorted((str(r["doc_id"]), *plain(r["text"])) for r in table.collect())
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"], r["rejected"]) for r in langid.predict(table, model).collect())
    assert len(got) == len(want) > 40
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-4) and g[3] == w[3]


def test_language_counts_whole_texts():
    rng = random.Random(2)
    text = "".join(rng.choice("abc dé") for _ in range(2_500_000)).encode()
    data = b" " + b" ".join(text.decode().lower().encode().translate(langid._FOLD).split()) + b" "
    n = len(data)
    assert langid.ngram_counts(text).sum() == n + (n - 1) + (n - 2)


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where(~quality.held_out()))
    held = quality.score(docs.where(quality.held_out()).join(labels, "doc_id"), model).collect()
    good, bad = ([r["score"] for r in held if r["quality"] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    rows = quality.score(odd_rows(spark), model).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["doc_id"]: r["score"] for r in rows}
    assert empty[2] == empty[3]
    one = quality.fit(docs, labels.where("quality = 1"))
    assert quality.score(docs.limit(2), one).first()["score"] == 1.0
    assert quality.score(docs.limit(2), quality.fit(docs, labels.limit(0))).first()["score"] == 0.5


def test_quality_against_plain_margins(spark):
    """Indicators, class ratios, margins and the curve, gram by gram."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    hashed = lambda code: (code * 2654435761 & 0xFFFFFFFF) >> 16

    def grams(text):
        b = (text or "").encode()
        turn = lambda k: 0 if k == 1 else k * 0x9E3779B1 & 0xFFFFFFFF
        return sorted({hashed(int.from_bytes(b[i : i + k], "big") ^ turn(k)) for k in (1, 2, 3, 4) for i in range(len(b) - k + 1)})

    known = [(r["quality"], grams(r["text"])) for r in docs.join(labels, "doc_id").collect()]
    counts = [[1.0] * quality.FEATURES for _ in range(2)]
    for label, at in known:
        for g in at:
            counts[label][g] += 1
    whole = [sum(c) for c in counts]
    ratio = [math.log(counts[1][g] / whole[1]) - math.log(counts[0][g] / whole[0]) for g in range(quality.FEATURES)]
    assert model.ratio == pytest.approx(np.array(ratio), abs=1e-9)
    rows = docs.select("doc_id", "text").limit(40).collect() + [(-1, None), (-2, ""), (-3, "é")]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for doc_id, text in rows:
        at = grams(text)
        norm = max(math.sqrt(sum(ratio[g] ** 2 for g in at)), 1e-12)
        margin = sum(float(model.weights[g]) * ratio[g] / norm for g in at) + float(model.weights[-1])
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.offset))), abs=1e-9)


def test_numerals_are_no_letters_and_odd_columns_are_kept(spark):
    """Texts of numerals alone are undetermined; structs with odd names and clashing columns pass; empty tables give none."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    odd = F.struct(F.lit(1).alias("a b"), F.array(F.struct(F.lit("x").alias("c,d: e"))).alias("`"))
    rows = spark.createDataFrame([(1, "½ ²", "k", True), (2, "Ⅷ 7 _", "k", False), (3, "the and of é", "k", None)], "doc_id long, text string, lang_pred string, rejected boolean").withColumn("rest", odd)
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(rows, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2)] == ["und"] * 2 and got[3]["lang_pred"] in {"en", "fr", "de", "es"}
    assert got[3]["rest"]["a b"] == 1 and langid.filter_known(rows, model).columns == rows.columns
    assert langid.predict(rows.limit(0), model).count() == langid.filter_known(rows.limit(0), model).count() == 0
    judge = quality.fit(docs, labels)
    scored = quality.score(rows.withColumn("score", F.lit("k")), judge)
    assert scored.columns == ["doc_id", "lang_pred", "rejected", "rest", "score"] and all(r["rest"]["`"][0]["c,d: e"] == "x" for r in scored.collect())
    assert quality.score(rows.limit(0), judge).count() == 0


def test_quality_curve_comes_from_unseen_labels():
    """With labels that mean nothing, margins of held-out rows are even, so scores stay near the share."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(quality.FEATURES, 60, replace=False)) for _ in range(240)]
    label = (rng.random(240) < 0.5).astype(int)
    model = quality.fit_indicators(rows, label, 0.5)
    scores = [1 / (1 + math.exp(-(model.slope * model.margin(r) + model.offset))) for r in rows]
    assert max(abs(x - 0.5) for x in scores) < 0.25


def test_registered_text_queries(spark, tmp_path, library):
    """op2, op3 and op6 over a small table with odd rows: ids and digests by the library, folds by crc32, columns and types."""
    import zlib

    import __spark_entry__ as entry

    base = [(i, t) for i, t in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t, ["en", "fr", None][i % 3], "s") for i, t in base[:120]] + [(9001, None, "en", None), (9002, "", None, "s"), (9003, "½ ²", "fr", "s"), (9004, "a\x00b \U0001f600", "en", "s"), rows_twice(base)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, i % 2, 0) for i, *_ in rows if i % 3]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    queries = entry.queries()
    crc = lambda i: zlib.crc32(str(i).encode())
    got = queries["op2_bpe_encode"](spark, str(tmp_path))
    assert dict(got.dtypes) | {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} == dict(got.dtypes)
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)
    got = queries["op3_language_id"](spark, str(tmp_path))
    assert dict(got.dtypes) | {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"} == dict(got.dtypes)
    found = got.collect()
    assert sorted((r["doc_id"], r["held_out"]) for r in found) == sorted((i, crc(i) % 3 == 1) for i, *_ in rows)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (9001, 9002, 9003)) and 0 <= r["score"] <= 1 for r in found)
    learned = {lang for i, t, lang, _ in rows if crc(i) % 3 != 1 and lang and t}
    assert {r["lang_pred"] for r in found} <= learned | {"und"}
    got = queries["op6_quality"](spark, str(tmp_path))
    assert dict(got.dtypes) | {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"} == dict(got.dtypes)
    model = quality.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.createDataFrame([m for m in marks if crc(m[0]) % 4 != 2], "doc_id long, quality int, toxic int"))
    want = sorted((i, crc(i) % 4 == 2, model.score((t or "").encode())) for i, t, *_ in rows)
    found = sorted((r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in got.collect())
    assert [f[:2] for f in found] == [w[:2] for w in want] and [f[2] for f in found] == pytest.approx([w[2] for w in want])
    assert all(f[3] == int(f[2] >= 0.7) for f in found)


def rows_twice(base):
    return (base[3][0], base[3][1], "en", "s")


def test_quality_optimum():
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(50, 8, replace=False)), rng.normal(size=8)) for _ in range(40)]
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    w = quality.dual_coordinate_descent(rows, y, np.ones(40), epochs=500)
    loss = lambda w: w @ w / 2 + sum(max(0, 1 - t * (w[a] @ v + w[-1])) for (a, v), t in zip(rows, y, strict=True))
    best = loss(w)
    for _ in range(200):
        assert loss(w + rng.normal(size=len(w)) * 1e-3) >= best - 1e-4
    assert F is not None
