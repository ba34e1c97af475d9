"""Word runs, vector codes and main text, and brute-force versions of mixing and of the union sketch."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import dom, mainhtml, minhash, mixing, pagegen, queries, runs, topk, vecdedup, vectorcodes
from tests.parity import SF


# Runs of words.


def runs_by_hand(words, least=6, periods=4):
    """All runs by trying every period at every place."""
    n, out = len(words), set()
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q) and not any(all(words[x] == words[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.add((i, j - i + q, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, periods", [(6, 4), (3, 2), (8, 3), (1, 2)])
def test_runs_equal_those_by_hand(least, periods):
    rng = random.Random(least)
    for _ in range(60):
        docs = []
        for _ in range(6):
            words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(60))]
            turn = [b"%d" % rng.randrange(3) for _ in range(rng.randint(1, 8))]
            words[len(words) // 2 : len(words) // 2] = (turn * 9)[: rng.randrange(40)]
            docs.append(words)
        got = runs.runs_of_documents(docs, least, periods)
        for words, (start, length, period) in zip(docs, got):
            assert list(zip(start.tolist(), length.tolist(), period.tolist())) == runs_by_hand(words, least, periods)


def test_mask_lets_no_run_go():
    """The k of the mask is the smallest overlap; words it drops lie in no run."""
    assert runs.gram_length(6, 4) == 5 and runs.gram_length(12, 2) == 6
    rng = random.Random(1)
    for _ in range(40):
        words = [rng.randrange(4) for _ in range(80)] + [1, 2] * 5
        live = runs.surviving(np.array(words), np.zeros(len(words), np.int64), 5)
        assert all(live[i] for start, length, _ in runs_by_hand(words) for i in range(start, start + length))


def digest_by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs_by_hand(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    four = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *four, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len((r["text"] or "").split()) < 700]
    got = {r["doc_id"]: tuple(r) for r in queries.op12_word_runs(spark, SF).collect()}
    assert len(got) == len(rows) and len(short) > 100
    for r in short:
        assert got[r["doc_id"]] == digest_by_hand(r["doc_id"], r["text"])
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_runs_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20_000)) + " x y" * 4000
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "\n\t ", "c"), (4, "la " * 6, "d"), (4, "la " * 6, "d"), (5, long, None), (None, "x y z " * 3, "e")], "doc_id long, text string, runs string")
    rows = rows.withColumn("N_Words", F.lit("own")).withColumn("pr_text", F.lit("mine"))
    got = runs.find_runs(rows)
    assert set(got.columns) >= {"doc_id", "pr_text", "n_words", "runs", "collapsed"} and "text" not in got.columns
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"], r["pr_text"]))
    assert by[1] == by[2] == by[3] == [(0, [], "", "mine")]
    assert by[4] == [(6, [(0, 6, 1)], "la", "mine")] * 2
    assert by[5][0][:2] == (28_000, [(20_000, 8000, 2)]) and by[5][0][2].endswith("w19999 x y")
    assert by[None][0][0] == 6 and got.limit(0).count() == 0 and runs.find_runs(rows.limit(0)).count() == 0
    assert runs.run_digest(rows.limit(0)).count() == 0


# Vector codes.


def codes_by_hand(vectors, parts=16, entries=64, rounds=2):
    """Lloyd's rounds by scanning everything."""
    kept = sorted((i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    part = lambda v, b: v[b * width : (b + 1) * width]
    far = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c))
    books = [[part(v, b) for _, v in kept[:entries]] for b in range(parts)]
    nearest = lambda b, v: min(range(len(books[b])), key=lambda k: (far(part(v, b), books[b][k]), k))
    for _ in range(rounds):
        held = [defaultdict(list) for _ in range(parts)]
        for _, v in kept:
            for b in range(parts):
                held[b][nearest(b, v)].append(part(v, b))
        books = [[[sum(c) // len(held[b][k]) for c in zip(*held[b][k])] if k in held[b] else old for k, old in enumerate(books[b])] for b in range(parts)]
    out = {}
    for i, v in kept:
        code = [nearest(b, v) for b in range(parts)]
        out[i] = bytes(code).hex(), sum(far(part(v, b), books[b][k]) for b, k in enumerate(code))
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


@pytest.mark.parametrize("block, dim, n", [(7, 16, 120), (4096, 32, 90)])
def test_codes_equal_full_scans(spark, block, dim, n):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, dim) / 4 + rng.normal(0, 0.02, dim) * (i % 2)], i % 4) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * dim, 1), (n + 2, [float("nan")] * dim, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    held = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, sha = codes_by_hand(held)
    coded, books = vectorcodes.encode(df, block=block)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in coded.collect()} == want
    assert [b.digest() for b in books.values()] == [sha]


def test_heaps_scan_less_and_miss_nothing():
    """From the second round on parts are left unscanned, and each of those has kept its nearest entry."""
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-20, 20, (400, 4)) + 1000 * k for k in range(8)])
    book = vectorcodes.Codebooks([[p.tolist() for p in points[::50]]], 4)
    code = heaps = None
    totals, scanned = np.zeros((2, 64, 5), np.int64), []
    for _ in range(5):
        code, heaps, change, n = vectorcodes.assign(points, book.entries[0], book.drift[0], code, heaps)
        heaps = vectorcodes.Heaps.unpacked(*heaps.packed())
        assert (code == vectorcodes.distances(points, book.entries[0]).argmin(axis=1)).all()
        totals += change
        assert (totals == vectorcodes.sums_of(points, code, 64)).all()
        scanned.append(n)
        flat = {k: int(h << 32) + int(x) for k, (h, x) in enumerate(zip(totals[0].ravel(), totals[1].ravel()))}
        book = vectorcodes._moved(book, flat)
    assert scanned[0] == len(points) and scanned[-1] < 0.6 * len(points)  # as entries settle, fewer are let through


def test_codes_of_odd_rows(spark):
    kind = "vec_id long, embedding array<double>, label string, code string"
    rows = spark.createDataFrame([(1, [1e30] * 16, None, "x"), (1, [1.0] * 16, None, "x"), (None, [0.5] * 16, "a", "x"), (3, [0.25] * 20, "b", "x"), (4, [], "b", "x"), (5, [2.0, 3.0], "b", "x"), (6, [float("inf")] * 16, "b", "x")], kind)
    got = vectorcodes.code_digest(rows).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 2, None: 1, 3: 1, 4: 1, 5: 1}
    assert all(len(r["code"]) == 32 and r["error"] == 0 for r in got)  # fewer vectors than entries: each is its own
    assert vectorcodes.code_digest(rows.limit(0)).count() == 0 and vectorcodes.code_digest(rows.where("vec_id = 6")).count() == 0
    same = spark.createDataFrame([(i, [0.5] * 16, "a") for i in range(70)], "vec_id long, embedding array<float>, label string")
    assert {(r["code"], r["label_error"]) for r in vectorcodes.code_digest(same).collect()} == {("00" * 16, 0)}
    with pytest.raises(ValueError):
        vectorcodes.encode(rows, entries=300)


# Main text.


@pytest.fixture(scope="module")
def model(spark):
    return mainhtml.fit(spark)


def test_generated_pages_parse_as_labelled():
    for seed in range(300):
        html, truth = pagegen.labelled_page(seed)
        page = dom.Page(html)
        assert [page.text[i] for i in sorted(page.text)] == [t for t, _ in truth]


def test_held_out_accuracy(model):
    """On layouts that the fit has not seen: characters kept and left out rightly."""
    right = wrong = lost = 0
    for seed in range(500_000, 500_300):
        html, truth = pagegen.labelled_page(seed)
        page = dom.Page(html)
        kept = set(model.blocks([page])[0])
        for i, (text, good) in zip(sorted(page.text), truth):
            right += len(text) * (good and i in kept)
            wrong += len(text) * (not good and i in kept)
            lost += len(text) * (good and i not in kept)
    assert right / (right + wrong) > 0.97 and right / (right + lost) > 0.99


def test_pages_of_the_tables(spark, model):
    """Every page's article, as its own tags bound it, and nothing around it."""
    import html as entities

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op11_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


ARTICLE = "The council met on Monday to discuss the bridge, which has been closed since the flood in early spring."
PAGE = f"""<html><head><title>Bridge</title><style>p{{}}</style></head><body>
<div class="cookie-banner">We use cookies to improve your visit. <a href="/p">Policy</a></div>
<header class="site-header"><a href="/">Daily News</a></header><nav><a href="/a">Home</a> <a href="/b">World</a></nav>
<div id="wrap"><div class="article-body"><h1>Bridge to open</h1><p>{ARTICLE}</p><div class="ad-slot">Buy new tyres today at half the price!</div>
<p>{ARTICLE}&nbsp;&amp; more</p><script>var x = "<p>no</p>";</script><!-- <p>no</p> --><p>Final   words,<br>on two lines.</p></div>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">A story</a></li><li><a href="/2">Another story</a></li></ul></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I think that {ARTICLE}</p></div></section>
<form action="/s"><p>Subscribe to our newsletter</p><input name="e"></form></div>
<footer class="site-footer"><p>&copy; Daily News. All rights reserved.</p></footer></body></html>"""


def test_a_page_with_everything(model):
    (got,) = model.texts([PAGE])
    assert got.split("\n\n") == ["Bridge to open", ARTICLE, f"{ARTICLE} & more", "Final words, on two lines."]


def test_choices_agree(model):
    """Nothing is kept below what is dropped, and the choice is the best of all consistent ones."""
    rng = np.random.default_rng(2)
    page = dom.Page("<div><p>a</p><p>b</p><div><p>c</p><p>d</p></div></div><p>e</p>")
    holds = np.arange(len(page.tag))

    def value(state, margin):
        total = sum(m if s else -m for s, m in zip(state, margin))
        for p in range(len(state)):
            if state[p]:
                inner = [c for c in range(len(state)) if page.parent[c] == p]
                total -= sum(2.0 for a, b in zip(inner, inner[1:]) if page.tag[a] and page.tag[a] == page.tag[b] and state[a] != state[b])
        return total

    for _ in range(30):
        margin = rng.normal(0, 1.5, len(holds))
        kept = mainhtml.decode(page, holds, margin, agree=2.0)
        best = None
        for bits in range(1 << (len(holds) - 1)):
            state = [True] + [bool(bits >> k & 1) for k in range(len(holds) - 1)]
            if any(state[c] and not state[page.parent[c]] for c in range(1, len(state))) or any(state[page.parent[c]] != state[c] for c in page.text):
                continue
            v = value(state, margin)
            if best is None or v > best[0]:
                best = (v, [c for c in sorted(page.text) if state[c]])
        assert kept == best[1]


def test_markup_of_every_kind():
    blocks = lambda h: [dom.Page(h).text[i] for i in sorted(dom.Page(h).text)]
    assert blocks("") == blocks("<p> \n </p>") == blocks("<script>never ends <p>x") == []
    assert blocks("1 < 2 & 3 > 2 &lt;b&gt; &#233;&eacute;") == ["1 < 2 & 3 > 2 <b> éé"]
    assert blocks("<p>a<p>b<li>c<li>d<td>e") == ["a", "b", "c", "d", "e"]
    assert blocks("<head><title>t</title><body><p>a</p>") == ["a"] and blocks("<head><title>t</title><p>a</p>") == ["a"]
    assert blocks("<p title='>'>a</p><p title=\"x>y\">b</p><!-- <p>c</p> --><P>d") == ["a", "b", "d"]
    assert blocks("<div><noscript><div>n</div></noscript>a<button>b</div>c") == ["a", "c"]
    assert blocks("<textarea><p>x</p></textarea><p>y</p></div></p></section>z") == ["y", "z"]
    assert len(blocks("<div>" * 5000 + "deep")) == 1 and blocks("<p>" * 3 + "<!--") == []
    assert dom.attribute_tokens(' class="siteNav top_bar" ID=Main2 aria-hidden="true" style="display: none"') == ["site", "nav", "top", "bar", "main", "hidden", "hidden"]


def test_main_text_of_odd_rows(spark, model):
    rows = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "plain words and no markup at all", None), (4, PAGE, "u"), (4, PAGE, "u"), (None, "<p>" + "word " * 50_000, "u")], "page_id long, html string, text string")
    rows = rows.withColumn("MT_html", F.lit(1))
    got = mainhtml.main_text(rows, model=model)
    assert got.columns == ["page_id", "MT_html", "text"]
    by = defaultdict(list)
    for r in got.collect():
        by[r["page_id"]].append(r["text"])
    assert by[1] == by[2] == [""] and len(by[4]) == 2 and by[4][0] == by[4][1] and len(by[3]) == len(by[None]) == 1
    assert mainhtml.main_text(rows.limit(0), model=model).count() == 0


# Union sketches, targets, clashing columns, ties.


def test_union_sketch_equals_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 390), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 50)).astype(np.uint64)])) for _ in range(40)]
    i, j = np.triu_indices(len(sets), 1)
    size, both = minhash.union_estimates([s[:64] for s in sets], i, j, 64)
    for a, b, n, m in zip(i, j, size, both):
        union = np.union1d(sets[a], sets[b])[:64]
        assert (n, m) == (len(union), len(np.intersect1d(np.intersect1d(sets[a], sets[b]), union)))
    assert minhash.least_in_union(100, 100, 128, 75, 1e-7) == 75 and minhash.least_in_union(9000, 9000, 128, 75, 1e-7) < 96


def water_by_steps(sizes, weights, total, most):
    """Pour a little at a time; a source that is full takes no more."""
    target, left, open_ = dict.fromkeys(sizes, 0.0), total, {s for s in sizes if sizes[s]}
    while left > 1e-9 and open_:
        unit = min(left / sum(weights[s] for s in open_), min((most * sizes[s] - target[s]) / weights[s] for s in open_))
        for s in open_:
            target[s] += unit * weights[s]
        left -= unit * sum(weights[s] for s in open_)
        open_ = {s for s in open_ if target[s] < most * sizes[s] - 1e-9}
    return target


def test_targets_and_sizes_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lone = spark.createDataFrame([(10**6, "one two three " * 40, "en", "zz-alone", 0), (10**6 + 1, "x " * 30, "en", None, 0), (10**6 + 2, None, "en", "none", 0)], docs.schema)
    docs = docs.union(lone).union(lone.where("source = 'zz-alone'"))  # a repeated row
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = water_by_steps(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2.0)
    rows, by = mixing.mix_digest(docs).collect(), docs.select("doc_id", "source").distinct().collect()
    source, taken = {r["doc_id"]: r["source"] for r in by}, Counter()
    assert len(rows) == docs.count()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-9) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    same = [r for r in rows if r["doc_id"] == 10**6]
    assert len(same) == 2 and same[0] == same[1]  # repeated rows are drawn alike
    largest = {s: max(r["size"] for r in rows if source[r["doc_id"]] == s) * (2 if s == "zz-alone" else 1) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)


def test_vectors_with_clashing_columns_and_ties(spark):
    rows = [(i, [1.0, float(i % 2)], 1) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit(9).alias(c) for c in ("id", "cell", "native", "others", "node", "score", "rank", "b", "q", "dim", "v")])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vecdedup.near_duplicates(df).collect()}
    assert got == {i: (19, i % 2) for i in range(40)}
    top = topk.top_k(df, df.where("vec_id = 3"), k=4).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in top) == [(1, 1), (2, 5), (3, 7), (4, 9)]


def test_links_are_counted_once(spark):
    """Vectors that lie near each other in every block, in one, and across chunks: degrees and components against all pairs."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 24))
    x = np.concatenate([b + rng.normal(0, s, (25, 24)) for b, s in zip(base, (0.02, 0.08, 0.12, 0.15, 0.2, 0.4))])
    df = spark.createDataFrame([(i, [float(v) for v in r], int(i % 2)) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None, :] % 2) & ~np.eye(len(x), dtype=bool)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(x))])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vecdedup.near_duplicates(df).collect()}
    assert got == {i: (int(link[i].sum()), int(comp[i])) for i in range(len(x))} and link.sum() > 100
