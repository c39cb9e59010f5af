"""Filter audit, source divergence, main texts: against brute force on odd rows and against pages whose text is known."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tessera.llm import blocklabel, divergence, filteraudit
from tessera.llm.blocks import generated_page, read_blocks


def odd_documents(seed=1, n=90):
    """Copies, nulls in any column, rows that repeat, shouted, repetitive and marked texts, clashing extra columns."""
    rng = random.Random(seed)
    pool = [f"{rng.choice(['Wort', 'mot', 'é', '日本', 'x1y', 'ÀB', 'q'])}{rng.choice('abcdefgh')}" for _ in range(40)]
    rows = []
    for i in range(n):
        words = [rng.choice(pool) for _ in range(rng.choice([0, 1, 30, 50, 60, 120]))]
        if rng.random() < 0.3:
            words = words[:5] * 12
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words.append("a|b")
        rows.append((i, rng.choice([" ", "\t", "\n ", "\x0b", " "]).join(words), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S", "", None])))
    rows += [(1000 + k, rows[3 * k][1], "en", "s1") for k in range(20)] + [rows[5], rows[5], (None, rows[6][1], "en", "s1"), (None, "only here", None, None), (2000, None, "de", "lone"), (2001, None, "de", "other"), (2002, "w " * 50_000, "en", "s1"), (-1, "", "en", None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def test_filter_audit_against_brute_force(spark):
    rows = odd_documents()
    labels = [(i, q, x) for i, q, x in zip(range(0, 1015, 3), [0, 1, 1, None] * 90, [1, 0, None] * 120, strict=False)] + [(0, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], SCHEMA + ", step int, _bits string")
    got = sorted(map(tuple, filteraudit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, _, s in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        copy = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _, _ in rows)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        parts[s or ""].append((fails, i in good, i in toxic))
    want = []
    for part, docs in parts.items():
        shapley, mine = Counter(), []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                early = [any(d[0][x] for x in order[:k]) for d in docs]
                here = [d[0][f] and not e for d, e in zip(docs, early, strict=True)]
                shapley[f] += sum(here)
                both = list(zip(docs, early, here, strict=True))
                mine.append((part, "".join(order), k + 1, sum(not e and not h for _, e, h in both), sum(here), sum(d[0][f] and e for d, e, _ in both), sum(sum(d[0].values()) == 1 and d[0][f] for d in docs), sum(h and d[1] for d, _, h in both), sum(h and d[2] for d, _, h in both), f))
        want += [(*m[:-1], shapley[m[-1]]) for m in mine]
    assert got == sorted(want) and {r[0] for r in got} == {"s1", "s2", "S", "", "lone", "other"}
    none = filteraudit.audit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 0


def divergence_brute(rows):
    docs = [((lang or ""), (s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for _, t, lang, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, n in held.items() if n >= 3}
        counts = {s: Counter(w for d in mine if d[1] == s for w in d[2] if w in kept) for s in {d[1] for d in mine}}
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        by, q = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in by:
            pairs = [(-sum(f(by[s][w], by[o][w]) for w in kept), o.encode(), o) for o in by if o != s]
            terms = [(-f(by[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and by[s][w] > q[w]]
            out += [(lang, s, part, item, -v, k + 1) for part, found, most in (("pair", pairs, None), ("term", terms, 200)) for k, (v, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize("chunk, groups", [(8192, 128), (3, 2)])
def test_divergence_against_brute_force(spark, monkeypatch, chunk, groups):
    """Also with chunks and groups so small that every sum is put together from several."""
    monkeypatch.setattr(divergence, "CHUNK_TERMS", chunk)
    monkeypatch.setattr(divergence, "GROUPS_AT_ONCE", groups)
    monkeypatch.setattr(divergence, "HELD_TERMS", 30 if chunk == 3 else 200_000)
    rows = odd_documents(2) + [(3000 + k, "ties aa bb cc dd " + "z" * 30_000, "en", f"t{k % 3}") for k in range(6)]
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], SCHEMA + ", term binary, rank int")
    assert sorted(map(tuple, divergence.audit(df).collect())) == divergence_brute(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_over_many_terms_and_equal_values(spark):
    """More terms above the language's share than ranks, most of them equal: ties fall by UTF-8."""
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}é" for k in range(1500)]
    rows = [(k, " ".join(words), "en", "a") for k in range(3)] + [(9, " ".join(words[::2] + ["\U00010400x", "ﬀx"]), "en", "b"), (10, "\U00010400x ﬀx", "en", "b"), (11, "\U00010400x ﬀx", "en", "b")]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect())) == divergence_brute(rows)


def test_shares_are_exact():
    n = 9 * 10**15
    counts = [0, 1, 2, 10**9, 10**12 + 7, n - 1]
    assert divergence.shares(np.array(counts), np.int64(n)).tolist() == [1 + 10**9 * (c + 1) // n for c in counts]


@pytest.mark.parametrize("page, want", [
    ("<p>a&amp;b&nbsp;<b>c\n d</b><p>e</p>f", ["a&b c d", "e", "f"]),
    ("<ul><li>x<li>y <a href='>'>z</a></ul><br>w<br/>v", ["x", "y z", "w v"]),
    ('<script>var a="<p>no</p>";</script><style>p{}</style><!-- <p>no --><title>no</title>yes', ["yes"]),
    ("<p>cut <script>var x = '</p>", ["cut"]),
    ("2 < 3 <p>a <3 b", ["2 < 3", "a <3 b"]),
    ("<p class=x id='y z'>q</p></div></p>r", ["q", "r"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<p title=\"a > b\">t</p><p title=\"never closed>u</p>", ["t", "u"]),
    ("", []), (" \n ", []), ("&#x41;&eacute;&bogus;", ["Aé&bogus;"]),
])
def test_blocks_of_odd_markup(page, want):
    assert [b.text for b in read_blocks(page)] == want


def test_block_paths():
    (b,) = read_blocks('<body><div id="site-nav" class="Menu x"><ul><li>text <a href=#>link</a></ul></div>')
    assert b.path == ("<body", "<div", "site", "nav", "menu", "x", "<ul", "<li", "=li") and b.linked == 4


def test_labeller_gradients():
    rng = random.Random(5)
    pages = [p for p in (generated_page(rng) for _ in range(3)) if p[0]]
    paths, words = blocklabel._Buckets(blocklabel.PATHS), blocklabel._Buckets(blocklabel.WORDS)
    made, labels = [blocklabel.Vectors(b, paths, words) for b, _ in pages], np.array([v for _, y in pages for v in y], float)
    model = blocklabel.Labeller()
    _, grad = model.gradients(made, labels)
    for name, g in grad.items():
        at = np.unravel_index(np.argmax(abs(g)), g.shape)
        was, losses = model.w[name][at], []
        for step in (1e-5, -1e-5):
            model.w[name][at] = was + step
            losses.append(model.gradients(made, labels)[0])
        model.w[name][at] = was
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[at], rel=1e-4)


def test_labeller_on_pages_not_seen():
    """Blocks of generated pages, in any batching, and the texts of the given pages, whose article is marked."""
    model, rng = blocklabel.fitted(), random.Random(1234)
    paths, words = blocklabel._Buckets(blocklabel.PATHS), blocklabel._Buckets(blocklabel.WORDS)
    pages = [p for p in (generated_page(rng) for _ in range(200)) if p[0]]
    together = model.probabilities([blocklabel.Vectors(b, paths, words) for b, _ in pages])
    alone = np.concatenate([model.probabilities([blocklabel.Vectors(b, paths, words)]) for b, _ in pages])
    assert np.abs(together - alone).max() < 1e-9
    assert np.mean((together >= 0.5) == np.array([v for _, y in pages for v in y])) > 0.975
    html = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    truth = ["\n\n".join(b.text for b in read_blocks(h[h.index("<article>") :].split("</article>")[0])) for h in html]
    got = blocklabel.main_texts(model, html, paths, words)
    assert sum(a == b for a, b in zip(got, truth, strict=True)) >= 0.99 * len(html)


SITE = """<html><body><header class="site-header"><h1>Daily</h1><p>All the news of the town, every day.</p></header>
<nav><ul><li><a href=/>Home</a><li><a href=/b>Sports</a></ul></nav><div class="cookie-notice"><p>We use cookies to make this site work.</p></div>
<main><article><h1>A bridge is built</h1><p>The town has built a bridge, and many people came to see it on Sunday.</p>
<div class="advert">Buy a new car now, it is cheap.</div><h2>Costs</h2><ul><li>Stone, two thousand.</li><li>Wood, four hundred.</li></ul>
<p>Short.</p><p>It will be open to everyone from next week on, the mayor said &mdash; &amp; stay so.</p></article></main>
<aside><h3>Related</h3><p>Another story that is not about the bridge, with a full sentence.</p></aside>
<form action=/s><label>Your email</label><button>Subscribe</button></form>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I went there and it was a great day for all of us.</p></div></section>
<footer><p>&copy; 2024 Daily. All rights reserved.</p></footer></body></html>"""


def test_main_text_of_a_site_and_odd_rows(spark):
    rows = [(1, SITE, "u", 5), (1, SITE, "u", 5), (2, None, None, None), (3, "", "u", 0), (4, "<script>x", "u", 1), (None, SITE[: SITE.index("Short.")], "u", 2)]
    df = spark.createDataFrame(rows, "page_id long, html string, main_text string, n_chars int").withColumn("rest", df_struct())
    got = blocklabel.extract(df).collect()
    assert blocklabel.extract(df).columns == ["page_id", "html", "rest", "main_text", "n_chars"]
    text = "A bridge is built\n\nThe town has built a bridge, and many people came to see it on Sunday.\n\nCosts\n\nStone, two thousand.\n\nWood, four hundred.\n\nShort.\n\nIt will be open to everyone from next week on, the mayor said — & stay so."
    found = sorted((str(r["page_id"]), r["main_text"], r["n_chars"], r["rest"]["a b"]) for r in got)
    assert [f for f in found if f[0] == "1"] == [("1", text, len(text), 1)] * 2
    assert [f[1:3] for f in found if f[0] in "234"] == [("", 0)] * 3
    assert [f[1] for f in found if f[0] == "None"] == [text.split("\n\nShort")[0]]
    assert blocklabel.extract(df.limit(0)).count() == 0


def df_struct():
    from pyspark.sql import functions as F

    return F.struct(F.lit(1).alias("a b"), F.lit("x").alias("rest"))


def test_a_very_long_page():
    page = "<nav><a>x</a></nav><article><h1>Long</h1>" + "".join(f"<p>Sentence number {k} of the long story, told in full.</p>" for k in range(20_000)) + "</article><footer>&copy; all</footer>"
    paths, words = blocklabel._Buckets(blocklabel.PATHS), blocklabel._Buckets(blocklabel.WORDS)
    (text,) = blocklabel.main_texts(blocklabel.fitted(), [page], paths, words)
    assert text.count("\n\n") == 20_000 and text.startswith("Long\n\nSentence number 0") and "all" not in text


def test_registered_queries(spark, tmp_path):
    """The queries' columns, and main texts as brute force has them from the marked articles."""
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")
    pq.write_table(pages, tmp_path / "pages.parquet")
    spark.createDataFrame(odd_documents(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    queries = entry.queries()
    assert sorted(map(tuple, queries["op11_source_divergence"](spark, str(tmp_path)).collect())) == divergence_brute(odd_documents())
    assert queries["op13_filter_audit"](spark, str(tmp_path)).count() == 6 * 600
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries["op12_main_text"](spark, str(tmp_path)).collect()}
    want = {}
    for r in pages.to_pylist():
        h = r["html"]
        text = "\n\n".join(b.text for b in read_blocks(h[h.index("<article>") :].split("</article>")[0]))
        want[r["page_id"]] = (r["url"], text, len(text))
    assert sum(got[k] == v for k, v in want.items()) >= 0.99 * len(want) and got.keys() == want.keys()
