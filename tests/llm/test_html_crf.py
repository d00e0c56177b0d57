import time
import tracemalloc

import pytest

from tracetide.llm import html_crf, page_samples
from tracetide.llm.queries import page_model


def texts(page):
    return [b.text for b in html_crf.blocks(page)]


def test_blocks():
    assert texts("<p>a &amp; b<p>c<br>d</p>e") == ["a & b", "c d", "e"]
    assert texts("<ul><li>a<li>b <b>c</b>d</ul>") == ["a", "b cd"]
    assert texts("<script>x<p></script>y<style>p</style><!-- <p>no --><p title='a>b'>z") == ["y", "z"]
    assert texts("<textarea>no</textarea><button>no</button><p>a&nbsp;&#8364; \n b</p>") == ["a € b"]
    assert texts("") == [] and texts("a < b") == ["a < b"] and texts("<p>x<!-- open") == ["x"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("</div></p>x<p") == ["x"]


def test_slashes_and_links():
    found = html_crf.blocks("<div/><p>a <a href=/x/>link</a> b<p>c<svg><path d='m'/></svg><a name=q>d<a href=x>e</a> f")
    assert [(b.text, b.linked) for b in found] == [("a link b", 4), ("c", 0), ("de f", 2)]
    assert [b.node.tag for b in found] == ["p", "p", "p"] and [b.node.parent.tag for b in found] == ["div", "div", "div"]


def test_features_are_those_of_the_whole_path():
    (b,) = html_crf.blocks("<div class='main Post'><section id=main><div role=x><b>t</b></div></section></div>")
    assert html_crf.path_features(b.node) == sorted(["bias", "in:div", "in:section", "word:main", "word:post", "word:x", "own:div", "near:x", "depth:3", "pair:section>div"])
    model = page_model()
    whole = sum(model.weights.get(f, 0.0) for f in html_crf.path_features(b.node) + html_crf.text_features(html_crf.text_key(b)))
    assert abs(model.emission(b) - whole) < 1e-9


@pytest.mark.parametrize("piece", ["<div>x", "<p>x<div class='a b'>", "<ul><li>x", "<a href='/'>x", "</div", "<a b='", "<script></script", "&amp", "<table><tr><td>x", "<b>x</i>"])
def test_deep_and_ill_formed_pages_take_linear_time(piece):
    took = []
    for n in (4_000, 40_000):
        began = time.process_time()
        assert isinstance(page_model().extract(piece * n), str)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.05)


def test_a_deep_page_takes_bounded_memory():
    page_model()
    tracemalloc.start()
    page_model().extract("<div>x" * 100_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_held_out_accuracy():
    model, right, total = page_model(), 0, 0
    for found, labels in html_crf.training_set(page_samples.pages(200, seed=9), page_samples.SIGN):
        right += sum(a == b for a, b in zip(model.decode(found), labels))
        total += len(labels)
    assert right / total > 0.985


def test_viterbi_against_brute_force():
    import itertools
    import random

    r, model = random.Random(1), page_model()
    for _ in range(20):
        page = html_crf.blocks(page_samples.Page(r.randint(1, 10**6)).html())[:9]

        def total(labels):
            s = model.begin[labels[0]] + sum(model.emission(b) for b, y in zip(page, labels) if y)
            return s + sum(model.between[a][b] for a, b in zip(labels, labels[1:]))

        if page:
            best = max(itertools.product((0, 1), repeat=len(page)), key=total)
            assert abs(total(tuple(map(int, model.decode(page)))) - total(best)) < 1e-9


def test_edge_cases(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>The &lt;text&gt; itself, with some words.</p><div class=ad>Buy</div></article><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = sorted((r.page_id or -1, r.text) for r in html_crf.extract(df, page_model()).collect())
    assert got == [(-1, ""), (1, "T The <text> itself, with some words."), (1, "T The <text> itself, with some words."), (3, "")]
    assert html_crf.extract(df.limit(0), page_model()).count() == 0
