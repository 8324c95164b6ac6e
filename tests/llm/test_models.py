import itertools
import math
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zlib

from lettermill.llm import html_density, language_crf, text, toxicity

from .helpers import documents


def test_forward_backward_against_all_paths():
    made = np.random.default_rng(0)
    emitted, moves, sizes = made.normal(size=(9, 3)), made.normal(size=(3, 3)), np.array([4, 1, 3, 1])
    marginals, pairs = language_crf.forward_backward(emitted, sizes, moves)
    start, expected = 0, np.zeros((3, 3))
    for n in sizes:
        seen, steps, total = np.zeros((n, 3)), np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            weight = math.exp(sum(emitted[start + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += weight
            for i, y in enumerate(path):
                seen[i, y] += weight
            for a, b in itertools.pairwise(path):
                steps[a, b] += weight
        assert np.allclose(marginals[start : start + n], seen / total)
        expected += steps / total
        start += n
    assert np.allclose(pairs, expected)


@pytest.mark.parametrize("run", [1, 4, 64])
def test_long_chains_are_not_cut(run):
    made = np.random.default_rng(1)
    sizes = np.array([50, 1, 7, 4, 130, 8])
    emitted, moves = made.normal(size=(sizes.sum(), 3)), 2 * made.normal(size=(3, 3))
    assert np.allclose(language_crf.chain_marginals(emitted, sizes, moves, run), language_crf.forward_backward(emitted, sizes, moves)[0])
    assert language_crf.chain_marginals(np.empty((0, 3)), np.empty(0, np.int64), moves, run).shape == (0, 3)


def test_small_shares_of_many_rows_and_frequent_words(spark):
    from lettermill.llm.work import most_frequent, share_of

    share = 2000 / 1e11
    bound = int(-(2**63) + share * 2**64)
    assert 0.99 < (bound + 2**63) / 2**64 / share < 1.01
    n = spark.range(400_000)
    assert abs(n.where(share_of("id", 0.001)).count() - 400) < 100 and n.where(share_of("id", 0.0)).count() == 0 and n.where(share_of("id", 1.0)).count() == 400_000
    # 900 words above any clip, 300 of them wanted; then many words of one count.
    words = spark.range(900).selectExpr("concat('w', id) as word", "200000 + 5000 * id as n").union(spark.range(5000).selectExpr("concat('r', id) as word", "3L as n"))
    top = [r["n"] for r in words.where(most_frequent(words, "word", "n", 300)).collect()]
    assert 200 < len(top) < 330 and min(top) > 200000 + 5000 * 500
    some = [r["n"] for r in words.where(most_frequent(words, "word", "n", 2000)).collect()]
    assert some.count(3) == len(some) - 900 and 900 < some.count(3) < 1300
    assert words.where(most_frequent(words, "word", "n", 10_000)).count() == 5900 and words.where(most_frequent(words, "word", "n", 0)).count() == 0


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language_crf.op1_language(spark, folder).collect()]
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark, small):
    docs = documents(spark, small)
    model = language_crf.train(docs)
    got = {r["doc_id"]: r for r in language_crf.languages(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0 for i in (900001, 900002, 900003, 900004)) and got[None]["lang_pred"] != "und"
    one = {x: docs.where(f"lang = '{x}' and n_chars > 500").first()["text"][:400] for x in ("de", "fr")}
    mixed = spark.createDataFrame([(1, one["de"]), (2, one["fr"]), (3, one["de"] + "\n" + one["fr"])], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in language_crf.languages(mixed, model).collect()}
    assert (found[1]["lang_pred"], found[2]["lang_pred"]) == ("de", "fr") and found[3]["n_other_words"] > 10
    none = language_crf.train(docs.where("lang is null"))
    assert {r["lang_pred"] for r in language_crf.languages(docs, none).collect()} == {"und"}
    assert language_crf.languages(docs.limit(0), model).count() == 0


def test_sentences():
    data, offsets = text.utf8(pa.array(["Hello there. You!  \nnext? yes", "", "é. b", None, "end."]))
    begins, owner = toxicity.sentences(data, offsets)
    assert owner.tolist() == sorted(owner.tolist()) and set(owner.tolist()) == {0, 1, 2, 3, 4}
    assert [data[b:e].tobytes().decode() for b, e in zip(begins[owner == 0], [*begins[owner == 0][1:], offsets[1]])] == ["Hello there.", " You!", "  \n", "next?", " yes"]


def test_noisy_or_and_its_gradient():
    """Scores against a loop over words, and the fit against numeric slopes of the likelihood."""
    rows = [("good words here. grim day!", 1), ("good day", 0), ("grim grim grim", 1), ("", 0), ("more good words", 0)] * 4
    sample = toxicity.Sample()
    sample.add(pa.array([t for t, _ in rows], pa.large_string()), np.array([y for _, y in rows]))
    model = toxicity.fit(sample)
    from lettermill.llm.word_features import features

    def logit(sentence):
        found = sorted(set(re.findall("[a-z]+", sentence)))
        return model.bias + sum(float(model.weights[f]) for w in found for f in features(pa.array([w.encode()], pa.large_binary()), toxicity.N_FEATURES, toxicity.PREFIXES, toxicity.SUFFIXES)[0])

    def score(text_):
        clean = 1.0
        for part in re.split(r"(?<=[.!?])(?=\s)", text_) or [""]:
            clean *= 1 - 1 / (1 + math.exp(-logit(part)))
        return 1 - clean

    got = model.scores(pa.array([t for t, _ in rows], pa.large_string()))[0]
    assert np.allclose(got, [score(t) for t, _ in rows], rtol=1e-5)
    assert all((s > 0.5) == bool(y) for s, (_, y) in zip(got, rows))

    # The slope of a step: p (1 - y / toxic) for each sentence, against differences of the likelihood.
    def loss(x, y):
        toxic = 1 - np.prod(1 - 1 / (1 + np.exp(-x)))
        return -(y * np.log(toxic) + (1 - y) * np.log(1 - toxic))

    x = np.array([0.3, -1.2, 0.7])
    for y in (0, 1):
        toxic = 1 - np.prod(1 - toxicity.sigmoid(x))
        slope = toxicity.sigmoid(x) * (1 - y / toxic)
        for k in range(3):
            d = np.eye(3)[k] * 1e-6
            assert abs((loss(x + d, y) - loss(x - d, y)) / 2e-6 - slope[k]) < 1e-5


def test_toxic_sentences_are_found_from_document_labels(spark):
    made = np.random.default_rng(4)
    plain = ["".join(made.choice(list("abcdefghijklm"), 5)) for _ in range(300)]

    def sentence(bad):
        words = list(made.choice(plain, 6)) + (["grimlok"] if bad else [])
        return " ".join(made.permutation(words)) + "."

    rows = []
    for i in range(600):
        bad = i % 3 == 0
        parts = [sentence(bad and k == 1) for k in range(4)]
        rows.append((i, " ".join(parts), int(bad)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.scored(docs, model, keep=["doc_id"]).collect()}
    held = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(found[i]["score"] >= 0.5) == bool(y) for i, _, y in held]) > 0.98
    for i, t, y in held:
        if y and found[i]["score"] >= 0.5:
            spans = found[i]["offending"]
            assert any("grimlok" in t[s["begin"] : s["end"]] for s in spans) and len(spans) <= 2
    assert toxicity.accepted(docs, labels).columns == docs.columns


def test_toxicity_of_odd_rows(spark, small):
    docs = documents(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    for some in (labels, labels.where("toxic = 0"), labels.limit(0)):
        rows = toxicity.scored(docs, toxicity.train(docs, some), keep=["doc_id"]).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.scored(docs.limit(0), toxicity.train(docs, labels), keep=["doc_id"]).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style></head><body><header class="site-header"><h1>Site</h1></header>
<div id="cookie-notice">We use cookies to make this better. Accept all of them.</div><div class="layout"><div class="content"><h1>My &amp; title</h1>
<p>One two  three four five six seven eight nine<br>ten eleven.<p>Second paragraph with a <a href=x>link</a> and more words than that, really.</p>
<ul><li>item one is here<li>item two is here</ul><form><input name=q><label>Search</label></form>
<section class="comments"><h2>Comments</h2><p>A reader says hello, and this is a rather long comment of a reader which should go.</p></section></div>
<aside class="sidebar"><p>Side text, a long one, many words in this side bar to be removed for sure.</p></aside></div><footer>foot</footer><script>var a="<p>x</p>";</script></body></html>"""


def test_page_text():
    assert html_density.main_text(PAGE) == "My & title\nOne two three four five six seven eight nine ten eleven.\nSecond paragraph with a link and more words than that, really.\nitem one is here\nitem two is here"
    cases = {None: "", "": "", "plain": "plain", "<p>a<p>b": "a\nb", "<script>x": "", "<div>&lt;x&gt; &#233;&nbsp;y</div>": "<x> é y", "<p>un<b>closed": "unclosed", "<<<": "<<<", "<div " + "a" * 50: "<div " + "a" * 50}
    assert {k: html_density.main_text(k) for k in cases} == cases
    kept = '<body><div class="content has-sidebar"><div class="post-header"><h1>Title here</h1></div><p>The body of the article, long enough to be one.</p><div class="post-comments"><p>not this</p></div></div></body>'
    assert html_density.main_text(kept) == "Title here\nThe body of the article, long enough to be one."
    deep = "<div>" * 3000 + "deep text here" + "</div>" * 3000
    assert html_density.main_text(deep) == "deep text here"


def test_page_text_of_several_sections():
    links = "<ul>" + "".join(f"<li><a href=x>Link {i}</a>" for i in range(10)) + "</ul>"
    for link in ("", "<a href=x>with a link of some words</a>"):
        lines = [f"Paragraph {k} of the page " + "has words and words " * 14 + "to read." for k in range(10)]
        parts = ["<div class=part>" + "".join(f"<p>{x} {link}" for x in lines[k : k + 5]) + "</div>" for k in (0, 5)]
        page = f"<body><div class=top>{links}</div><div class=content>{''.join(parts)}</div></body>"
        assert [x.split(" has ")[0] for x in html_density.main_text(page).split("\n")] == [x.split(" has ")[0] for x in lines]


def test_page_text_inside_wrappers():
    inner = "<h1>Title here</h1><p>The body of the article, long enough to be one, with <math><mi>x</mi></math> in it.</p>"
    want = "Title here\nThe body of the article, long enough to be one, with x in it."
    for name in ("content-with-sidebar", "layout-sidebar", "search-result-article", "post-legal-news", "hidden"):
        assert html_density.main_text(f"<body><div class='{name}'><article>{inner}</article></div></body>") == want
        assert html_density.main_text(f"<body><div class='{name}'><div>{inner}</div></div><div class=sidebar><p>Side text.</p></div></body>") == want
    assert html_density.main_text(f"<body><form action=x><div>{inner}</div><input name=q></form></body>") == want
    sources = "<ul>" + "".join(f"<li><a href=x>Source {i}</a>" for i in range(3)) + "</ul>"
    assert html_density.main_text(f"<body><article>{inner}{sources}</article></body>") == want + "\nSource 0\nSource 1\nSource 2"
    replies = "<div class=comments>" + "<article><p>A long answer of a reader, longer than all of the article above.</article>" * 9 + "</div>"
    assert html_density.main_text(f"<body><div>{inner}</div>{replies}</body>") == want


@pytest.mark.parametrize("page", ["<a " * 333_000, "<div>" * 200_000, "</b>" * 200_000, '<a "' * 250_001 + ">", "<a " * 300_000 + '">"', "<script>" + "</script " * 100_000, "<dd><div>" + "<b>" * 50_000 + "<dd></dd>" * 50_000, "<b>" * 100_000 + "<h1></h1>" * 100_000])
def test_long_and_broken_pages_take_linear_time(page):
    began = time.process_time()
    html_density.main_text(page)
    assert time.process_time() - began < 10


@pytest.mark.parametrize("names", [False, True])
def test_density_finds_articles_by_itself(names):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    right = 0
    for r in pages:
        plain = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        plain = plain if names else re.sub(r' class="[^"]*"', "", plain)
        right += html_density.main_text(plain) == html_density.main_text(r["html"])
    assert len(pages) == 250 and right >= 245


def test_pages(spark, small):
    import html

    pages = spark.read.parquet(f"{small}/pages.parquet").withColumnRenamed("html", "h").selectExpr("page_id", "url", "h as html", "1 as text")
    odd = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 1), (1, "u", PAGE, 1)], "page_id bigint, url string, html string, text int")
    got = html_density.page_texts(pages.unionByName(odd)).collect()
    assert len(got) == pages.count() + 3 and all(r["n_chars"] == len(r["text"]) for r in got)
    text_of = {r["page_id"]: r["text"] for r in html_density.page_texts(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x)))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        assert text_of[r["page_id"]] == "\n".join(x for x in parts if x)
    assert html_density.page_texts(pages.limit(0)).count() == 0
