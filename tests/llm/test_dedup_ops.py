"""Line dedup, Jaccard join, suffix arrays: against brute force on small tables."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import jaccard, linededup, shingles, suffix
from tessera.llm.components import components


def words(rng, n, of=200):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def changed(rng, w, rate):
    return [f"c{rng.randrange(10**6)}" if rng.random() < rate else x for x in w]


def corpus(seed=4, n=120):
    """Texts, near and exact copies, one large group, a shared passage, odd ones."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        texts.append(" ".join(words(rng, rng.choice([1, 3, 4, 5, 6, 30, 80, 300]), 5000)))
    base = words(rng, 90, 5000)
    texts += [" ".join(changed(rng, base, 0.02)) for _ in range(60)]
    for _ in range(40):
        texts.append(" ".join(changed(rng, rng.choice(texts).split(), rng.choice([0, 0.01, 0.03, 0.1]))))
    passage = " ".join(words(rng, 60, 5000))
    texts += [passage + " " + " ".join(words(rng, 30, 5000)) for _ in range(30)]
    texts += [texts[3].upper(), texts[3], texts[3], "", None, " \t\n", "one", "One", "a b c d", "x " * 3000, None]
    rng.shuffle(texts)
    return texts


def jaccard_brute(rows):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k in sets:
        i = rows[k][0]
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted((str(rows[k][0]), len(sets[k]), str(low.get(find(k)) if sets[k] else rows[k][0])) for k in sets)


@pytest.mark.parametrize("hot", [256, 8])
def test_jaccard(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = [(i * 3 if i % 50 else None, t) for i, t in enumerate(corpus())]
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, root string, n long")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(df).collect())
    assert got == jaccard_brute(rows)
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns


def test_jaccard_representatives_by_row(spark):
    """Null ids, ids that repeat with the same and other texts, exact and near copies: one row a component."""
    rng = random.Random(5)
    a, b, c, d, e, f = (words(rng, 60, 5000) for _ in range(6))
    near = lambda w: [*w[:-1], "other"]
    texts = [
        (1, a), (None, near(a)), (None, b), (None, b), (2, c), (2, c), (3, d), (2, near(d)), (4, e), (4, near(c)), (4, words(rng, 60, 5000)),
        (None, f), (None, near(f)), (None, words(rng, 60, 5000)), (5, near(b)), (6, []), (6, []), (None, None), (None, None),
    ]
    rows = [(i, None if w is None else " ".join(w), k) for k, (i, w) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long")
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    got = {r["_row"] for r in kept.collect()}
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if w else set() for _, w in texts]
    left, groups = {k for k in range(len(texts)) if shingles[k]}, []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            new = {y for y in left if 100 * len(shingles[x] & shingles[y]) >= 80 * len(shingles[x] | shingles[y])}
            left, todo = left - new, todo + list(new)
        groups.append(group)
    assert sorted(map(len, groups)) == [1, 1, 1, 2, 2, 2, 3, 3]
    for group in groups:
        (stands,) = got & group
        assert stands == min(group, key=lambda k: (texts[k][0] is None, texts[k][0] or 0, k))
    assert {k for k in range(len(texts)) if not shingles[k]} <= got


def test_jaccard_bands_and_matches(spark):
    """Sizes in the first band, in the second, whose level is below the whole set, and in both."""
    rng = random.Random(9)
    rows = []
    for i in range(40):
        base = words(rng, rng.choice([60, 70, 80, 90, 250, 300, 340]), 5000)
        for j in range(3):
            w = changed(rng, base, 0.01 * j)
            rows.append((i * 3 + j, " ".join(w[: len(w) - rng.randrange(12)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(df).collect())
    assert got == jaccard_brute(rows)


def near_group(seed=8):
    """A large group of near copies around the limit: by changes, cuts, insertions, chains and shared edits; and a common passage."""
    rng = random.Random(seed)
    base = words(rng, 120, 5000)
    texts = [changed(rng, base, rng.choice([0.005, 0.02, 0.03, 0.04, 0.06])) for _ in range(110)]
    for _ in range(40):  # parts of it, and more behind it
        a, b = rng.randrange(40), rng.randrange(80, 121)
        texts.append(base[a:b] + words(rng, rng.choice([0, 0, 5, 20]), 5000))
    for _ in range(6):  # whole clusters that share edits
        other = changed(rng, base, 0.06)
        texts += [changed(rng, other, 0.01) for _ in range(8)]
    last = base
    for _ in range(20):
        last = changed(rng, last, 0.02)
        texts.append(last)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize(("few", "rounds"), [(32, 2), (4, 0), (8, 1), (1, 0)])
def test_jaccard_large_near_group(spark, monkeypatch, few, rounds):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    rows = list(enumerate(near_group()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(df).collect())
    want = jaccard_brute(rows)
    assert got == want
    assert 30 < len({c for _, _, c in want}) < 200


def test_jaccard_sets_that_a_level_leaves_short_and_hashes_that_clash(spark, monkeypatch):
    rng = random.Random(9)
    long = words(rng, 700, 5000)
    texts = [" ".join(changed(rng, long, r)) for r in (0, 0.01, 0.02, 0.2, 0.01)] + corpus(n=30)[:60]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = jaccard.level
    monkeypatch.setattr(jaccard, "level", lambda band, all_=False: 0.05 if band and not all_ else whole(band, all_))
    one = jaccard.identity
    monkeypatch.setattr(jaccard, "identity", lambda h: (one(h)[0] % 11, one(h)[1]))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(df).collect())
    assert got == jaccard_brute(rows)


def test_jaccard_representatives_keep_clashing_columns(spark):
    names = ["doc_id", "text", "_gone", "_key", "_row", "s", "root", "n"]
    df = spark.createDataFrame([(i, "a b c d e f", i, i, i, i, i, i) for i in range(3)], ", ".join(f"{c} {'string' if c == 'text' else 'long'}" for c in names))
    assert [tuple(r) for r in jaccard.representatives(df).collect()] == [(0, "a b c d e f", 0, 0, 0, 0, 0, 0)]


def test_jaccard_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_matches_for_grows_with_cost():
    assert jaccard.matches_for(np.array([2, 2, 2, 2]), 100, 50) == 1
    assert jaccard.matches_for(np.full(60, 500), 0, 100) > 1


def test_shingle_steps(monkeypatch):
    rng = random.Random(1)
    text = " ".join(words(rng, 3000)).encode()
    whole = shingles.shingle_hashes(text)
    monkeypatch.setattr(shingles, "_STEP", 100)
    assert np.array_equal(whole, shingles.shingle_hashes(text))
    assert len(shingles.shingle_hashes(b" \n ")) == 0 and len(shingles.shingle_hashes(b"a b")) == 1
    assert np.array_equal(shingles.word_hashes(b"\n a  B"), shingles.word_hashes(b"A b"))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: find(k) for k in root if find(k) != k}


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a == b or a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def test_line_dedup(spark):
    rng = random.Random(8)
    letters = "abcdefghé ß日"
    bases = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 19, 20, 21, 22, 40, 41, 90]))) for _ in range(25)]

    def edit(s):
        i = rng.randrange(len(s) + 1)
        return rng.choice([s, s, s[:i] + rng.choice(letters) + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i + 1 :]])

    rows = []
    for i in range(60):
        lines = [edit(edit(rng.choice(bases)) if rng.random() < 0.3 else rng.choice(bases)) for _ in range(rng.randint(1, 6))]
        rows.append((i if i % 20 else None if not i else i, "\n".join([*lines, "", " "][: rng.randint(1, 8)])))
    rows += [(100, None), (101, ""), rows[7]]
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id long, text string, _row string, n_lines long")
    place = [((i is not None, i or 0), n, line) for i, t in rows if t is not None for n, line in enumerate(t.split("\n")) if line.strip(" \t")]
    want = []
    for i, t in rows:
        if t is None:
            want.append((str(i), None, 0, 0))
            continue
        mine = t.split("\n")
        kept = [x for n, x in enumerate(mine) if not x.strip(" \t") or not any(near(x, y) and (j, m) < ((i is not None, i or 0), n) for j, m, y in place)]
        want.append((str(i), "\n".join(kept), len(mine), len(mine) - len(kept)))
    got = [(str(r["doc_id"]), r["text"], r["n_lines"], r["n_removed"]) for r in linededup.dedup(df, counts=True).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert linededup.dedup(df).columns == df.columns
    assert linededup.dedup(df.limit(0)).count() == 0


def test_line_dedup_keeps_clashing_columns(spark):
    names = ["doc_id", "text", "_gone", "_row", "_id", "_rest", "_text", "_kept"]
    df = spark.createDataFrame([(i, "one line\ntwo lines and more", *[f"{i}{c}" for c in names[2:]]) for i in range(3)], ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    want = [(i, "" if i else "one line\ntwo lines and more", *[f"{i}{c}" for c in names[2:]]) for i in range(3)]
    assert sorted(tuple(r) for r in linededup.dedup(df).collect()) == want


def test_line_dedup_runs_no_python(spark):
    plan = linededup.dedup(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("most", [1024, 2])
def test_suffix_array(monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST_NAMES", most)  # beyond, ranks are doubled
    rng = random.Random(2)
    for k in range(120):
        s = [rng.randint(1, 1 + k % 6) for _ in range(rng.randint(1, 120))]
        s = np.array((s * 5)[:300] + [0] if k % 3 == 0 else s + [0])
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        for sigma in (8, 2000):
            assert suffix.suffix_array(s, sigma).tolist() == want
        for depth in (1, 4, 9):
            cut = [s[i : i + depth].tolist() for i in suffix.suffix_array(s, 8, depth)]
            assert cut == sorted(cut) and len(cut) == len(s)
        got = suffix.common_prefixes(s, np.array(want), 20)
        for i, j in zip(want[1:], want, strict=False):
            n = 0
            while n < 20 and max(i, j) + n < len(s) and s[i + n] == s[j + n]:
                n += 1
            assert got[i] == n


def test_every_long_string_holds_equal_anchors(monkeypatch):
    rng = random.Random(6)
    text = bytes(rng.choice(b"ab c") for _ in range(3000)) + b"z" * 200
    found = suffix.anchors(text)
    at: dict[bytes, tuple[int, int]] = {}
    for p, h, first, last in zip(*map(np.ndarray.tolist, found), strict=True):
        for i in range(first, last + 1):
            assert i <= p <= i + suffix.LENGTH - suffix.GRAM
            assert at.setdefault((i, text[i : i + suffix.LENGTH]), (p - i, h)) == (p - i, h)
    assert sorted(i for i, _ in at) == list(range(len(text) - suffix.LENGTH + 1))
    by_string: dict[bytes, tuple[int, int]] = {}
    assert all(by_string.setdefault(string, x) == x for (_, string), x in at.items())
    monkeypatch.setattr(suffix, "_STEP", 300)
    assert all(map(np.array_equal, suffix.anchors(text), found))


def suffix_brute(rows):
    first = {}
    late = 1 << 62
    order = sorted(((late if i is None else i), (t or "").encode(), i) for i, t in rows)
    for i, b, _ in order:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = []
    for i, b, real in order:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        out.append((str(real), len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefé hi") for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 70, 400)]
    rows = []
    for i in range(60):
        rows.append((i if i != 17 else None, "".join(rng.choice([text(rng.randint(0, 80)), rng.choice(passages)]) for _ in range(rng.randint(0, 5)))))
    rows += [(70, rows[5][1] + "x" * 60), (71, rows[5][1] + "x" * 60), (71, rows[9][1] + "y" * 300), (72, None), (73, ""), (74, "z" * 500), (75, "z" * 99), (None, "z" * 60)]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, bucket long, kind string")
    got = [(str(r["id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.dedup(df).collect()]
    assert sorted(got) == suffix_brute(rows)
    assert suffix.dedup(df.limit(0)).count() == 0


def test_suffix_dedup_of_long_runs_and_a_passage_in_all(spark):
    """A text of one letter, and an anchor that all documents have with different surroundings."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = text(55)
    rows = [(i, text(rng.randint(0, 60)) + passage[rng.randint(0, 8) :] + text(40)) for i in range(300)]
    rows += [(400, "z" * 20_000), (401, text(30) + "z" * 300 + text(30)), (402, "ab" * 3000), (403, "ba" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(str(r["id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.dedup(df).collect()]
    assert sorted(got) == suffix_brute(rows)
