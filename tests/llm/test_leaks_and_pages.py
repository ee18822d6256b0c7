"""Decontamination against all pairs, HTML extraction, and the pipeline."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from veldra.llm import decontam, html_extract, queries


def items_of(rnd, count, words, low=6, high=60):
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(low, high))) for _ in range(count)]


def scores(index, terms):
    """Every item's score by the plain sum over its postings."""
    out = np.zeros(len(index.ids))
    for t in terms:
        for d, x in zip(*index.postings[t]):
            out[d] += x
    return out


@pytest.mark.parametrize("seed", range(4))
def test_wand_retrieves_all_above_the_threshold(seed):
    rnd = random.Random(seed)
    words = [f"t{int(60 * rnd.random() ** 3)}" for _ in range(200)]
    (index,) = decontam.build_indexes([(i, t, t, "") for i, t in enumerate(items_of(rnd, 150, words))])
    for _ in range(120):
        terms = sorted(rnd.sample(range(len(index.terms)), rnd.randint(1, min(25, len(index.terms)))))
        for threshold in (0.2, 0.5, 0.9):
            want = scores(index, terms)
            got = dict(index.retrieve(terms, threshold))
            assert set(got) == set(np.flatnonzero(want >= threshold - 1e-9).tolist())
            assert all(math.isclose(got[d], want[d]) for d in got)


def test_no_passage_is_skipped_that_reaches_the_threshold():
    rnd = random.Random(7)
    words = [f"t{i}" for i in range(300)] + ["the"] * 100
    items = items_of(rnd, 60, words)
    (index,) = decontam.build_indexes([(i, t, t, "") for i, t in enumerate(items)])
    texts = []
    for _ in range(40):
        own = [rnd.choice(words) for _ in range(rnd.randint(0, 700))]
        for _ in range(rnd.randint(0, 3)):
            item = rnd.choice(items).split()
            at = rnd.randint(0, len(own))
            own[at:at] = item[: rnd.randint(1, len(item))]
        texts.append(" ".join(own))
    vocabulary = pa.array(index.terms)
    got = {(row, item) for row, item, *_ in decontam.search_chunk(index, vocabulary, pa.array(texts), 0.4)}
    codes = {t: i for i, t in enumerate(index.terms)}
    want = set()
    for row, text in enumerate(texts):
        own = text.split()
        for start in range(0, max(1, len(own)), index.stride):
            terms = sorted({codes[w] for w in own[start : start + 2 * index.stride] if w in codes})
            want |= {(row, int(d)) for d in np.flatnonzero(scores(index, terms) >= 0.4 - 1e-9)}
    assert got == want and want


def test_leaks_are_found_and_clean_documents_left(spark, docs_of):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    items = [". ".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 15))) for _ in range(3)) + "." for _ in range(50)] + ["short one", "long " + " ".join(rnd.choice(words) for _ in range(300)) + "\nthe answer is here"]
    filler = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [f"{filler(rnd.randint(0, 300))} {items[i].upper() if i % 2 else items[i].replace('.', ' ,')} {filler(rnd.randint(0, 300))}" for i in range(52)]
    clean = [filler(400) for _ in range(30)]
    halves = [" ".join(items[i].split()[: len(items[i].split()) // 2]) for i in range(5)]
    docs = docs_of([*texts, *clean, *halves, None, "", texts[0]])
    bench = spark.createDataFrame([*enumerate(items), (900, None), (901, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect())
    assert got == sorted([*((i, i) for i in range(52)), (89, 0)])
    assert decontam.contaminated(docs, bench.where("false")).count() == 0
    assert decontam.contaminated(docs.where("false"), bench).count() == 0


def test_one_edit_is_still_a_leak(spark, docs_of):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    items = [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(20)]
    edited = [t.split() for t in items]
    for k, own in enumerate(edited):
        own[2 * k] = "changed"
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of([f"x y {' '.join(own)} z" for own in edited]), bench).collect()}
    assert found == {(k, k) for k in range(20)}


def test_several_parts_of_the_benchmark_give_the_same(spark, docs_of, monkeypatch):
    rnd = random.Random(5)
    items = items_of(rnd, 40, [f"w{i}" for i in range(500)], 10, 40)
    docs, bench = docs_of([f"before {t} after" for t in items]), spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    whole = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontam, "INDEX_BYTES", 1500)
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()) == whole and len(whole) >= 40


def test_planted_passages_of_the_tables(spark, sf_dir):
    docs, bench = pd.read_parquet(f"{sf_dir}/documents.parquet"), pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    want = {(d, i) for d, t in zip(docs.doc_id, docs.text) for i, x in zip(bench.item_id, bench.text) if x in t}
    assert {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, sf_dir).collect()} >= want


def test_any_white_space_parts_words(spark, docs_of):
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    items = [f"how large is the town{c}? it was{c}measured in the spring. the answer is{c}twelve miles wide number {i}" for i, c in enumerate(spaces)]
    plain = [" ".join(t.split()) for t in items]
    assert all(set(c) <= {" "} | set(decontam.MARKS) for c in spaces)
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    for texts in (items, plain):
        found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of([f"before it {t} after it" for t in texts]), bench).collect()}
        assert found >= {(i, i) for i in range(len(items))}


def test_question_and_answer():
    assert decontam.question_answer("What is it?\n\nA thing.") == ("What is it?", "A thing.")
    assert decontam.question_answer("One two. Three four.") == ("One two.", " Three four.")
    assert decontam.question_answer("a b c d e f") == ("a b c d", "e f")


# Pages


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


def test_unseen_layouts(model):
    wrong = total = 0
    for page, labels in html_extract.labelled_pages(150, seed=1234):
        blocks = html_extract.leaf_blocks(page)
        assert len(blocks) == len(labels)
        wrong += sum(a != b for a, b in zip(model.decode(blocks), labels))
        total += len(labels)
    assert wrong < 0.02 * total


def test_viterbi_finds_the_best_path(model):
    import itertools

    blocks = html_extract.leaf_blocks("<nav>a</nav><p>Some text that is here.</p><div class=comment>b</div><p>More text.</p>")
    rows = [model.emit[[model.names[f] for f in html_extract.features(b) if f in model.names]].sum(axis=0) for b in blocks]

    def score(path):
        return model.start[path[0]] + sum(r[y] for r, y in zip(rows, path)) + sum(model.step[a, b] for a, b in zip(path, path[1:]))

    assert score(model.decode(blocks)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=len(blocks)))))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<header><h1>Site name</h1><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav></header>
<div class="cookie-banner"><p>We use cookies.</p><button>OK</button></div>
<article><h1>The  title &amp; more</h1><p>First <b>para</b>graph&nbsp;of the\n text, it is long enough to be read &lt;here&gt;.<p>Second paragraph, not closed at all, but it is text.<!-- gone -->
<div class="ad"><p>Buy this now</p></div><p>Third one ends the article, as it should be.</p></article>
<aside class=sidebar><h3>Related</h3><ul><li><a href=/x>Other story</a></li></ul></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I think that this is a very nice article indeed.</p></div></section>
<form><label>Mail</label><input name=q><textarea>typed</textarea></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_a_whole_page(model):
    assert html_extract.main_text(PAGE, model).split("\n") == ["The title & more", "First paragraph of the text, it is long enough to be read <here>.", "Second paragraph, not closed at all, but it is text.", "Third one ends the article, as it should be."]


def test_any_markup_is_a_page(spark, model):
    pages = [None, "", "<", "<p", "plain text only", "<p>a<p>b</div></p></p>", "<script>x", "<!-- open", "<a href='x>y</a>", "a<br>b", "<p>" * 3000 + "deep", "&#x41;&nbsp;&bogus;", "<![CDATA[x]]>", "<div " + "a='1' " * 20_000 + ">x</div>", "<article><p>" + "word " * 200_000 + "</p></article>"]
    frame = spark.createDataFrame([(i, f"u{i}", p, "x") for i, p in enumerate([*pages, PAGE, PAGE])], "page_id long, url string, html string, text string")
    rows = {r.page_id: r.text for r in html_extract.extract(frame, model=model).collect()}
    assert len(rows) == len(pages) + 2 and rows[0] == rows[1] == "" and rows[len(pages)] == rows[len(pages) + 1] == html_extract.main_text(PAGE, model)
    assert rows[14] == " ".join(["word"] * 200_000)
    assert html_extract.extract(frame.where("false"), model=model).count() == 0


def test_pages_of_the_tables(spark, sf_dir):
    import html as h
    import re

    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    rows = queries.op8_html(spark, sf_dir).toPandas().set_index("page_id")
    for page_id, page in zip(pages.page_id, pages.html):
        article = re.sub(r"</?(b|br)>", "", re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S).group(1))
        parts = [re.sub(r"\s+", " ", h.unescape(x)).strip() for x in re.split(r"<[^>]*>", article)]
        text = "\n".join(x for x in parts if x)
        assert rows.text[page_id] == text and rows.n_chars[page_id] == len(text)


# The pipeline


def test_stages(spark, sf_dir):
    from test_dedup import brute, measures

    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    columns = list(docs.columns)
    bench = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = corpus_pipeline.stored(stage(spark, frame, sf_dir), "test-stage")
        rows = frame.toPandas()
        if k < 4:
            assert frame.columns == columns
        if k == 0:
            kept = {i for i, t in zip(before.doc_id, before.text) for m in [measures(t)] if m[0] >= 20 and 100 * m[4] <= 30 * m[0]}
            assert set(rows.doc_id) == kept
        elif k == 1:
            assert set(rows.doc_id) == set(before.doc_id) and (rows.n_chars == rows.text.str.len()).all()
        elif k == 2:
            _, own = brute(list(zip(before.doc_id.tolist(), before.text)))
            assert set(rows.doc_id) == set(own)
        elif k == 3:
            leaked = {d for d, t in zip(before.doc_id, before.text) if any(x in t for x in bench.text)}
            assert set(rows.doc_id) == set(before.doc_id) - leaked
        else:
            assert set(rows.doc_id) == set(before.doc_id) and (rows.n_tokens == rows.ids.map(len)).all()
        before = rows
    assert corpus_pipeline.run(spark, sf_dir).count() == len(before)


def test_an_empty_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "empty")
    assert docs.count() == 0


def brute_pairs(docs, items):
    """All (doc, item) pairs at or above the threshold with their best measures, by the plain BM25 sum over every passage."""
    norm = lambda t: decontam.words_of("".join(" " if c in decontam.MARKS else c for c in t or "").lower())
    words = [norm(t) for _, t in items]
    filled = [w for w in words if w]
    n, average = len(filled), sum(map(len, filled)) / max(1, len(filled))
    df = {t: sum(t in w for w in map(set, filled)) for w in filled for t in w}

    def impact(t, own):
        tf = own.count(t)
        return math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (decontam.K1 + 1) / (tf + decontam.K1 * (1 - decontam.B + decontam.B * len(own) / average))

    out = {}
    for d, text in docs:
        own = norm(text)
        for (item, raw), w in zip(items, words):
            if not w:
                continue
            stride = 64
            while stride < len(w):
                stride *= 2
            full = sum(impact(t, w) for t in set(w))
            parts = [norm(p) for p in decontam.question_answer(raw)]
            for start in range(0, max(1, len(own)), stride):
                score = sum(impact(t, w) for t in set(own[start : start + 2 * stride]) & set(w)) / full
                if score < decontam.THRESHOLD - 1e-9:
                    continue
                near = own[max(0, start - len(w)) : start + 2 * stride + len(w)]
                grams = lambda x, k: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)] if k else []
                both, shares, hit, total = parts[0] + parts[1], [], 0, 0
                k = min(5, len(both))
                across = {i + j for i, g in enumerate(grams(both, k)) if g in set(grams(near, k)) for j in range(k)}
                for p, offset in ((parts[0], 0), (parts[1], len(parts[0]))):
                    k = min(5, len(p))
                    there = set(grams(near, k))
                    seen = {i + j for i, g in enumerate(grams(p, k)) if g in there for j in range(k)} | {i - offset for i in across if offset <= i < offset + len(p)}
                    shares.append(len(seen) / len(p) if p else 1.0)
                    hit, total = hit + len(set(grams(p, k)) & there), total + len(set(grams(p, k)))
                found = (min(shares) >= decontam.PART_OVERLAP, hit / total, *shares, score)
                out[d, item] = max(out.get((d, item), found), found)
    return out


def leaky(rnd):
    words = [f"w{i}" for i in range(400)] + ["the", "of", "is"] * 30
    items = [(i, ". ".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 20))) for _ in range(2))) for i in range(30)]
    items += [(30, "long " + " ".join(rnd.choice(words) for _ in range(150)) + "\nthe answer"), (None, " ".join(rnd.choice(words) for _ in range(20))), (-1, " ".join(rnd.choice(words) for _ in range(20))), (50, None), (51, "")]
    docs = []
    for i in range(60):
        own = [rnd.choice(words) for _ in range(rnd.randint(0, 400))]
        for _, text in rnd.sample(items[:33], rnd.randint(0, 2)):
            part = text.split()
            for _ in range(rnd.randint(0, 3)):
                part[rnd.randrange(len(part))] = "changed"
            at = rnd.randint(0, len(own))
            own[at:at] = part[: rnd.choice([len(part), len(part), len(part) // 2 + 1])]
        docs.append((i, " ".join(own)))
    return docs, items


def test_query_pairs_equal_brute_force_however_many_indexes(spark, docs_of, monkeypatch):
    docs, items = leaky(random.Random(17))
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    want = brute_pairs(docs, items)
    sure = {k for k, (ok, overlap, *_) in want.items() if ok and overlap >= decontam.OVERLAP}
    assert sure and len(sure) < len(want)
    for most in (decontam.INDEX_BYTES, 1500, 200):
        monkeypatch.setattr(decontam, "INDEX_BYTES", most)
        got = {(r.doc_id, r.item_id): (r.overlap, r.question_overlap, r.answer_overlap, r.score) for r in decontam.retrieve(docs_of(docs), bench).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k][1:]) for k in want)
        assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(docs), bench).collect()} == sure


def test_a_question_without_its_answer_is_no_leak(spark, docs_of):
    rnd = random.Random(4)
    question = " ".join(f"q{rnd.randrange(900)}" for _ in range(60)) + "?"
    items = [(0, f"{question}\nthe answer is forty two"), (1, f"{' '.join(f'z{rnd.randrange(900)}' for _ in range(50))}.\nblue")]
    texts = [f"so {question} and nobody knows", f"so {items[0][1]} they say", items[1][1], items[1][1].replace("blue", "green")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in decontam.retrieve(docs_of(texts), bench).collect()}
    assert rows[0, 0].question_overlap == 1 and rows[0, 0].answer_overlap == 0 and rows[0, 0].overlap > 0.8
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(texts), bench).collect()} == {(1, 0), (2, 1)}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>First</p><svg/><p>Second</p>", ["First", "Second"]),
        ("<p>First</p><svg viewBox='0 0 1 1'><path d='M0'/><text>drawn</text><p>Second</p>", ["First", "Second"]),
        ("<p>a</p><svg><title>no<p>Second</p>", ["a", "Second"]),
        ("<p>one <svg><g><title>x</title><style>p{}</style></g></svg>word</p>", ["one word"]),
        ("<p>a</p><svg><foreignObject><p>in it</p></foreignObject><svg/><svg></svg></svg><p>b</p>", ["a", "b"]),
        ("<div>a<svg><path></div><p>b</p>", ["a", "b"]),
        ("<p>First</p><iframe src=x><p>Second</p>", ["First", "Second"]),
        ("<p>First</p><iframe src=x><p>not shown</p></iframe><p>Second</p>", ["First", "Second"]),
        ("<p>a</p><object data=x><param name=y><p>prose instead</p></object><p>b</p>", ["a", "prose instead", "b"]),
        ("<p>a</p><canvas>instead</canvas>", ["a", "instead"]),
        ("<p>a</p><noscript><p>without scripts</p></noscript>b", ["a", "without scripts", "b"]),
        ("<p>a</p><template><p>x</p><template>y</template>z</template><p>b</p>", ["a", "b"]),
        ("<p>a</p><template><p>x</p>", ["a", "x"]),
        ("<p>a</p><script>if (a</b) '<p>'</SCRIPT ><p>b", ["a", "b"]),
        ("<p>a</p><script>x", ["a"]),
        ("<?xml version='1.0'?><html><p>a</p><script src='x'/><p>b</p>", ["a", "b"]),
        ("<p>a</p><textarea>typed <p></textarea><p>b</p>", ["a", "b"]),
        ("<p>x</p><math><mi>y</mi></math>", ["x", "y"]),
        ("<p>a</p>" + "<svg><iframe><template>" * 3000 + "<p>b</p>", ["a", "b"]),
    ],
)
def test_no_text_is_lost_to_odd_elements(page, want):
    assert [b.text for b in html_extract.leaf_blocks(page)] == want


#: Pages written by hand in layouts that the generator of training pages doesn't make; ``[[..]]`` marks the main text.
OTHER_LAYOUTS = [
    """<html><head><title>Harbour notes - The Quay</title></head><body class="single postid-12"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">The Quay</a></p></div>
    <nav id="site-navigation"><div class="menu"><ul><li><a href="/">Home</a></li><li><a href="/about">About us</a></li></ul></div></nav></header><div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-12" class="post hentry"><header class="entry-header"><h1 class="entry-title">[[How the harbour was rebuilt]]</h1></header>
    <div class="entry-content"><p>[[The old harbour wall had stood for two hundred years before the storm of last winter broke it in three places.]]</p><h2>[[What the town decided]]</h2><p>[[After four meetings the council chose to build a new wall of local stone, twelve metres further out.]]</p><ul><li>[[The work takes two summers.]]</li><li>[[Boats use the northern pier until then.]]</li></ul><blockquote><p>[[We have never been so sure of a plan, said the harbour master.]]</p></blockquote></div></article>
    <div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this</h2><ol class="comment-list"><li class="comment"><div class="comment-body"><p>I remember the storm very well, it took our roof away.</p></div></li></ol><div id="respond"><h3>Leave a reply</h3><form><p><label>Name</label></p><button>Post</button></form></div></div></main></div>
    <aside id="secondary" class="widget-area"><section class="widget"><h2 class="widget-title">Recent posts</h2><ul><li><a href="/1">A ferry for the island</a></li></ul></section></aside></div><footer id="colophon" class="site-footer"><div class="site-info">&copy; The Quay. All rights reserved.</div></footer></div></body></html>""",
    """<!doctype html><body><div class="gdpr-consent" role="dialog"><p>We and our partners store data on your device.</p><button>Accept</button></div><div class="topbar"><a href="/login">Sign in</a></div><div class="breadcrumbs"><a href="/">News</a><a href="/w">Weather</a></div>
    <main role="main"><div class="story-body"><h1>[[Snow closes the mountain pass for a third day]]</h1><p>[[Drivers were told to turn back at the valley station on Tuesday morning as the wind picked up again.]]</p><div class="ad-slot"><p>Advertisement</p></div><p>[[The road service hopes to open one lane by Thursday, but more snow is expected in the night.]]</p><figure><img src=a><figcaption>[[Ploughs at work near the tunnel]]</figcaption></figure><p>[["It is the most we have seen since 1999," said a spokesman.]]</p></div></main>
    <div class="related-stories"><h3>More on this</h3><ul><li><a href="/2">Why snow is white</a></li><li><a href="/3">The longest winter</a></li></ul></div><div class="newsletter-signup"><p>Get the news by mail every morning.</p><form><input><button>Subscribe</button></form></div><footer><ul><li><a href="/c">Contact</a></li><li><a href="/t">Terms</a></li></ul><p>Copyright 2023 Daily Valley</p></footer></body>""",
    """<html><body><table width="100%"><tr><td class="header" colspan=2>Old Software Page</td></tr><tr><td class="menu"><a href="a.html">Start</a><br><a href="b.html">Files</a></td><td class="content"><h2>[[Installing the program]]</h2><p>[[Unpack the archive into a folder of your choice and run the setup file from there.]]</p><pre>[[tar xf program.tar]]</pre><p>[[If a library is missing, the setup names it and ends without changing anything.]]</p></td></tr><tr><td colspan=2 class="footer">Last changed in 2003</td></tr></table></body></html>""",
    """<body><nav class="sidebar toc"><ul><li><a href="#a">Overview</a></li><li><a href="#b">Options</a></li></ul></nav><div class="document"><div class="body"><section id="a"><h1>[[Overview]]</h1><p>[[The scheduler takes a list of tasks and gives each of them to the first worker that is free.]]</p></section><section id="b"><h2>[[Options]]</h2><dl><dt>[[retries]]</dt><dd>[[How often a failed task is tried again before it counts as lost.]]</dd></dl></section></div></div><div class="footer">Built with a generator.</div></body>""",
    """<body><header><div class="logo">Cook well</div><form class="search"><input><button>Search</button></form></header><article class="recipe"><h1>[[Lentil soup]]</h1><p>[[A warm soup for four people that is ready in forty minutes.]]</p><h2>[[Ingredients]]</h2><ul><li>[[300 grams of red lentils]]</li><li>[[two carrots and an onion]]</li></ul><h2>[[Method]]</h2><ol><li>[[Fry the onion until it is soft, then add the carrots.]]</li><li>[[Add the lentils and water and let it cook for half an hour.]]</li></ol><div class="social-share"><a href="/f">Share</a><a href="/t">Pin</a></div></article><section class="discussion"><h3>Reviews</h3><div class="reply"><p>My children loved it, thank you for this recipe!</p></div></section><footer><p>Cook well is a family business.</p></footer></body>""",
]


def test_layouts_that_training_pages_do_not_have(model):
    wrong = total = 0
    for page in OTHER_LAYOUTS:
        truth = [int(b.text.startswith("[[")) for b in html_extract.leaf_blocks(page)]
        blocks = html_extract.leaf_blocks(page.replace("[[", "").replace("]]", ""))
        assert len(blocks) == len(truth) and sum(truth) == page.count("[[")
        wrong, total = wrong + sum(a != b for a, b in zip(model.decode(blocks), truth)), total + len(blocks)
    assert wrong <= 0.05 * total


def test_stages_keep_clashing_columns_and_odd_rows(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = [(None, "no id " + " ".join(f"word{i}" for i in range(60)), "en", "s", 1), (900_001, None, "en", None, 0), (900_002, "", None, "s", 0), (900_003, " ".join(f"long{i}" for i in range(30_000)), "en", "s", 9)]
    names = ["leak_id", "leak_hash", "own_id", "own_hash", "row", "hash", "owner", "drops", "fp", "root", "stay_id", "kept", "base", "host", "line", "masked", "n_lines", "n_dropped"]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(3))
    docs = docs.withColumns({n: F.lit(f"x{n}") for n in names})
    frame = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = corpus_pipeline.stored(stage(spark, frame, sf_dir), "odd-stage")
        if k < 4:
            assert frame.columns == docs.columns
            assert all(r[n] == f"x{n}" for r in frame.collect() for n in names)
    ids = [r.doc_id for r in frame.collect()]
    assert None in ids and 900_003 in ids and 900_001 not in ids and len(ids) == len(set(ids)) > 10


def test_tokens_of_the_pipeline_are_the_library_s(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frame = corpus_pipeline.drop_templates(spark, docs, sf_dir)
    lines = {r.doc_id: r.text.split("\n") for r in docs.collect()}
    texts = {r.doc_id: r.text for r in frame.collect()}
    for i, text in texts.items():  # what is left are lines of the document, in order
        rest = iter(lines[i])
        assert text == "" or all(line in rest for line in text.split("\n"))
    rows = corpus_pipeline.to_tokens(spark, corpus_pipeline.stored(frame, "deduped"), sf_dir).collect()
    assert all(list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows) and len(rows) == len(texts)
