"""Importance resampling, HTML extraction and centroid clustering against plain versions; their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracesift.llm import centroid_clustering as cc
from tracesift.llm import html_extraction as hx
from tracesift.llm import importance_resampling as ir
from tracesift.llm import queries
from tracesift.llm.html_blocks import leaf_blocks

from ..conftest import SF_SMALL

CLASH = ["rank", "score", "weight", "n_features", "found", "n_words", "bucket", "at", "tie", "cluster", "distance", "inertia", "own", "x", "v", "h", "ids", "n_chars", "n_blocks", "n_kept"]


def _clashing(df):
    return df.withColumns({c: F.lit(f"old {c}") for c in CLASH if c not in df.columns})


# ---- importance resampling ------------------------------------------------------------------------
def _plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def _plain_resample(docs, target, percent, max_n, buckets, min_words, seed):
    def found(text):
        w = _plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(found(text))
    for text in target:
        t.update(found(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    rows = []
    for k, (i, text) in enumerate(docs):
        f = found(text)
        weight = math.floor(Fraction(sum(gain[b] for b in f), len(f))) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, len(_plain_words(text)), k])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    return Counter(tuple(r[:5]) for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aBz09 .,-'\x00\n\t[{é門"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=3), st.integers(1, 3))
def test_features_are_the_runs_of_words(texts, max_n):
    work = ir.Featurizer(max_n, 97)
    for t in texts:
        w = _plain_words(t)
        n, found = work(t)
        assert n == len(w)
        assert Counter(found.tolist()) == Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 97 for k in range(1, max_n + 1) for i in range(len(w) - k + 1))


def test_splitter_gives_words_with_offsets():
    text = ir.lowered("Hello, WÖRLD a1_b\n日本")
    assert ir.splitter().pre_tokenize_str(text) == [(w, (text.index(w), text.index(w) + len(w))) for w in ("hello", "wÖrld", "a1", "b", "日本")]


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "one two  three-four " * 50 + "x" * 300 + " end"
    whole = ir.Featurizer(3, 1000)(text)
    monkeypatch.setattr(ir, "_PIECE", 64)
    cut = ir.Featurizer(3, 1000)(text)
    assert whole[0] == cut[0] and Counter(whole[1].tolist()) == Counter(cut[1].tolist())


RESAMPLED = [
    (1, "the quick brown fox jumps over the lazy dog " * 3), (2, None), (3, ""), (4, "!!! ... ???"), (None, "the end of the story is here and it goes on and on for a while more until it is over"),
    (5, "word " * 400_000), (6, "the quick brown fox jumps over the lazy dog " * 3), (6, "the quick brown fox jumps over the lazy dog " * 3), (7, "short text"),
    *((10 + i, f"alpha beta {i} gamma delta epsilon " * (i % 7)) for i in range(60)),
]


@pytest.mark.parametrize("max_n", [1, 2])
def test_resample_equals_the_plain_version(spark, max_n):
    docs = _clashing(spark.createDataFrame(RESAMPLED, "doc_id long, text string")).repartition(3)
    target = _clashing(spark.createDataFrame([(1, "Alpha beta gamma, delta!"), (None, None), (2, "")], "item_id long, text string"))
    got = ir.resample(docs, target, 30, max_n, 50, 20, 7).collect()
    want = _plain_resample(RESAMPLED, ["Alpha beta gamma, delta!", None, ""], 30, max_n, 50, 20, 7)
    assert Counter(tuple(r) for r in got) == want
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_resample_edges(spark):
    docs = spark.createDataFrame(RESAMPLED[:8], "doc_id long, text string")
    none = docs.limit(0)
    assert ir.resample(none, docs, 10).collect() == []
    assert len(ir.resample(docs, none, 50, buckets=20).collect()) == 8
    report = ir.resample(docs, docs, 100, buckets=20)
    assert sorted(r["rank"] for r in report.collect() if r["rank"]) == [1, 2, 3, 4, 5]
    assert {r["doc_id"] for r in ir.drawn(docs, report).collect()} == {1, 5, 6}


# ---- HTML -----------------------------------------------------------------------------------------
def _texts(html):
    return [b[1] for b in leaf_blocks(html)]


def test_leaf_blocks():
    assert _texts("") == [] and _texts("plain &amp; simple") == ["plain & simple"]
    assert _texts("<p>a<b>b</b>c<br>d<p>e\n\t f&nbsp;g<!-- <p>no</p> -->h</p>") == ["abc", "d", "e f gh"]
    assert _texts("<script>if (a<b) '<p>x</p>'</script>y<style>p{}</style><STYLE>p{}</StyLe>z<textarea>t</textarea>") == ["yz"]
    assert _texts("3 < 4 and 5 <6 <p>x") == ["3 < 4 and 5 <6", "x"]
    assert _texts("<p>&amp;amp; &lt;b&gt; &#65;&#x42; &eacute; &copy; 1</p>") == ["&amp; <b> AB é © 1"]
    assert _texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert _texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert _texts("<a title='>' href=\"x>y\">link</a> <img alt='<p>'>tail") == ["link tail"]
    assert _texts("<title>t</title><p>unclosed <!-- comment") == ["unclosed"]
    assert _texts("</p></div>x</body>y<p a=\"b>c</p>") == ["x", "y", "c"]
    path, text, linked = leaf_blocks('<div class="Cookie-Notice topBar" id=\'x\'><p>see <a href=u>this</a></div>')[0]
    assert path == ("div cookie notice top bar x", "p") and text == "see this" and linked == 4
    assert len(_texts("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after")) == 2


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/!-\"'=&;# abpdivscriptli\n"), max_size=200))
def test_any_text_is_parsed(html):
    for path, text, linked in leaf_blocks(html):
        assert text and text == " ".join(text.split()) and 0 <= linked <= len(text)


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    pages = hx.drawn_pages(["some words to put into pages", "more of them. And 3 numbers"], 3, seed=5)
    paths = {}
    coded = [hx.Page(b[:9], paths) for b, _ in pages]
    labels = [y[:9] for _, y in pages]
    hot = hx._multi_hot(list(paths))
    w = {k: x + rng.normal(0, 0.1, x.shape) for k, x in hx.new_weights(rng).items()}  # doubles
    _, grads = hx._gradients(w, coded, labels, hot)
    used = np.flatnonzero(hot.any(0))
    for k, g in grads.items():
        at = (int(used[3]), 7) if k.endswith("path") else tuple(int(n) // 2 for n in g.shape)
        losses = []
        for step in (1e-2, -1e-2):
            moved = {n: x.copy() for n, x in w.items()}
            moved[k][at] += step
            losses.append(hx._gradients(moved, coded, labels, hot)[0])
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(g[at], abs=2e-4, rel=0.02), k


def _article(html):
    inner = re.search(r"<article>(.*)</article>", html, re.S).group(1)
    inner = re.sub(r"</?b>", "", re.sub(r"<(?:/?p|/?h1|br)>", " ", inner))
    return " ".join(unescape(inner).split())


@pytest.fixture(scope="module")
def labeller(spark):
    return hx.fit_on_pages(hx.sample_pages(spark.read.parquet(f"{SF_SMALL}/pages.parquet")))


def test_pages_give_their_articles(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = queries.op12_html_extraction(spark, SF_SMALL).collect()
    assert len(got) == len(pages)
    assert all(tuple(r) == (r["page_id"], pages[r["page_id"]]["url"], t := _article(pages[r["page_id"]]["html"]), len(t)) for r in got)


def test_held_out_layouts(labeller):
    pages = hx.drawn_pages(["a few words of text that no page has had so far, and some more", "Other words. They end here!", "1 2 3 go"], 600, seed=77)
    found = hx.Labeller(labeller).scores([b for b, _ in pages])
    right = np.concatenate([(p > 0.5) == (y > 0.5) for p, (_, y) in zip(found, pages)])
    assert right.mean() > 0.985


PAGE = """<html><head><title>T</title></head><body class="home"><header><h1>Site name</h1><p>All the news of the day</p></header>
<div class="cookie-notice"><p>We use cookies on this site to make it work better for you. Please accept them.</p><button>OK</button></div>
<nav><ul><li><a href="/">Home</a><li><a href=/x>Other pages</a></ul></nav><div id=main><article><h1>A &amp; B</h1><p>First paragraph of the text, which is long enough
to be one.<p>Second, <em>with</em> emphasis.<div class="ad">Buy now!</div><h2>Part two</h2><p>It ends here: 3 < 4.</p></article>
<aside class="sidebar"><h3>More</h3><p>A sidebar sentence that is just as long as the others.</p></aside>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with any of this, and I have said so before.</p></div></section>
<form action=x><label>Your name</label><input name=a><textarea>abc</textarea><button>Send</button></form></div>
<footer><p>&copy; 2020 All rights reserved</p></footer><script>var a = "<p>x</p>";</script></body></html>"""


def test_parts_of_a_page_that_training_pages_do_not_have(labeller):
    text = "A & B First paragraph of the text, which is long enough to be one. Second, with emphasis. Part two It ends here: 3 < 4."
    assert hx.Labeller(labeller).main_texts([PAGE])[0][0] == text


def test_document_wide_context_decides(labeller):
    """The same block, told apart by what stands around it alone."""
    block = (("html", "body", "div", "p"), "a few words", 0)
    menu = [(("html", "body", "footer", "p"), "a few words", 0)] * 3
    main = [(("html", "body", "article", "p"), "A long sentence of the article, with a lot of words in it.", 0)] * 6
    first, second = hx.Labeller(labeller).scores([main + [block] + main, menu + [block] + menu])
    assert abs(float(first[6]) - float(second[3])) > 1e-3


def test_html_edges(spark, labeller):
    long = "<article>" + "<p>some words of a long page</p>" * 30_000 + "</article>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", long), (4, "w", "   "), (5, "w", "<nav><a>x</a></nav>")]
    pages = _clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("text", F.lit("old"))
    got = hx.extract_main_text(pages, labeller).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[3]["n_chars"] == 30_000 * len("some words of a long page ") - 1 and by[3]["n_kept"] == 30_000
    assert by[2]["text"] == by[None]["text"] == by[4]["text"] == by[5]["text"] == "" and by[2]["url"] is None
    assert sum(r["text"].startswith("A & B") for r in got) == 2
    assert hx.extract_main_text(pages.limit(0), labeller).collect() == []
    assert hx.sample_pages(pages.limit(0)) == [] and len(hx.sample_pages(pages)) == 5
    hx.Labeller(hx.fit_on_pages([])).main_texts([PAGE])


# ---- clusters -------------------------------------------------------------------------------------
def _plain_clusters(rows, k, rounds, dims, seed):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) and abs(c) < cc.LIMIT // 1024 for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    cents = [v for _, v in order[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        own = [nearest(v)[0] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, *nearest(v)) for i, v in kept]
    per = Counter()
    for _, j, d in out:
        per[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, j, d, per[j], sum(per.values()), sha[j]) for i, j, d in out)


def _vectors(n, dims, seed, hot=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (5, dims))
    rows = [(i, [float(np.float32(c)) for c in centers[i % 5] + rng.normal(0, 0.4, dims)]) for i in range(n)]
    return rows + [(1000 + i, rows[0][1]) for i in range(hot)]


@pytest.mark.parametrize("k,rounds,n,hot", [(8, 10, 300, 150), (1, 3, 40, 0), (4, 0, 30, 0), (8, 20, 120, 0)])
def test_clusters_equal_the_plain_version(spark, monkeypatch, k, rounds, n, hot):
    monkeypatch.setattr(cc, "BLOCK", 16)
    rows = _vectors(n, 6, k, hot)
    df = _clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(4)
    got = Counter(tuple(r) for r in cc.clustering_report(df, k, rounds, 6, 3).collect())
    assert got == _plain_clusters(rows, k, rounds, 6, 3)


def test_cluster_edges(spark):
    good = _vectors(5, 4, 1)
    bad = [(50, None), (51, [1.0, 2.0]), (52, [1.0, None, 2.0, 3.0]), (53, [1.0, float("nan"), 0.0, 0.0]), (54, [1.0, float("inf"), 0.0, 0.0]), (55, [1e30, 0.0, 0.0, 0.0]), (56, [])]
    rows = good + bad + [(None, good[0][1]), good[1], good[1], (60, [-0.5, 1e5, -1e5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (3, 20):
        assert Counter(tuple(r) for r in cc.clustering_report(df, k, 4, 4, 3).collect()) == _plain_clusters(rows, k, 4, 4, 3)
    assert cc.clustering_report(df.limit(0), 3, 4, 4, 3).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<double>")
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in cc.clustering_report(same, 3, 2, 2, 0).collect()} == {(0, 0, 0)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5), st.sampled_from([3, 1000, 1 << 26]))
def test_bounds_never_change_an_assignment(seed, k, size):
    rng = np.random.default_rng(seed)
    x = rng.integers(-size, size + 1, (60, 3)).astype("<i4")
    history = [rng.integers(-size, size + 1, (k, 3))]
    state = cc.Assigner(np.stack(history)).first(x)
    for r in range(6):
        step = rng.integers(-(size // 4**r) - 1, size // 4**r + 2, (k, 3))
        history.append(np.clip(history[-1] + step, -size, size))
        cc.Assigner(np.stack(history)).again(x, *state)
        d = ((x.astype(object)[:, None] - history[-1].astype(object)[None]) ** 2).sum(2)
        assert state[0].tolist() == [min(range(k), key=lambda j: (row[j], j)) for row in d]


def test_bounds_use_total_displacement_and_save_scans():
    """Centroids that wander off and come back: the summed drifts would force scans, the total displacement none."""
    rng = np.random.default_rng(0)
    centers = np.array([[0, 0], [10_000, 0], [0, 10_000]])
    x = (centers[rng.integers(0, 3, 500)] + rng.integers(-400, 400, (500, 2))).astype("<i4")
    history = [centers]
    state = cc.Assigner(np.stack(history)).first(x)
    for r in range(1, 8):
        history.append(centers + (2000 if r % 2 else 0))
        work = cc.Assigner(np.stack(history))
        work.again(x, *state)
        assert work.rescanned == 0
    assert (state[4] == 0).all()  # the lower bounds are still those of the first round
