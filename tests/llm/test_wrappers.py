from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palisark.llm import wrappers

PAGES = "page_id long, url string, html string"
OUT = ("page_id", "url", "text", "n_chars")


@pytest.fixture
def make_pages(spark):
    def make(pages, url="http://one.example/x", parts=3):
        made = [(i, p[0] if isinstance(p, tuple) else url, p[1] if isinstance(p, tuple) else p) for i, p in enumerate(pages)]
        return spark.createDataFrame(made, PAGES).repartition(parts)

    return make


def texts(df):
    return [r.text for r in sorted(df.collect(), key=lambda r: r.page_id)]


def alone(page):
    """The text of a page that is the only one of its host."""
    tree = wrappers.parse(page)
    return wrappers.main_text(tree, wrappers.decide(wrappers.folded(tree)))


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("just   text", "just text"),
        ("<article><h1>A</h1><p>one<br>two<p>three</article><p>four", "A\none two\nthree"),
        ("<article>x<b>y</b>z &amp;&lt;i&gt; &eacute;&#x263a; &am</article>", "xyz &<i> é☺ &am"),
        ("<p>1 < 2 <3 <- a<!-- <p>no</p> -->b</p>", "1 < 2 <3 <- ab"),
        ("<head><title>no</title><style>p{}</style><p>yes", "yes"),
        ("<script>if (a</p>) '</scrip'</script><article><p>a<script>var x='<p>'</script>b</p></article>", "ab"),
        ("<article><p>a</p><div class='ad-box'>no</div><section id=comments><article>no</article></section><p>b</p><footer>no</footer></article>", "a\nb"),
        ("<article><header><h1>Title</h1><p>by someone</p></header><p>a</article>", "Title\na"),
        ("<nav><ul><li>menu<article><p>in an open menu</p></article>", "in an open menu"),
        ("<form id=aspnet><main><p>a</p><aside>no</aside></main></form><p>no</p>", "a"),
        ("<article>a</article><article class='user comment'>no</article><article>b</article>", "a\nb"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>x<li>y</ul><pre> k\n l </pre>", "1\n2\n3\nx\ny\nk l"),
        ("<article><p title='a > b' class=\"x\">a</p><p title=it's>b</p><p data-x=\"unclosed>c</p><p>d</p></article>", "a\nb\nc\nd"),
        ("<div role=main><p>a</p><div role='dialog'>no</div></div><div>no</div>", "a"),
        ("<body class='has-sidebar with-comments'><article><p>a</p></article></body>", "a"),
        ("<div class=content-with-sidebar><article><p>a</p></article></div>", "a"),
        ("<article>a<textarea>no</textarea><button>no</button><span class='comment'>// b</span><noscript>no</noscript></article>", "a// b"),
        ("<article><p>a <svg><text>no</text></svg>b<select><option>no</select><p>c <button>no<p>d</article>", "a b\nc\nd"),
        ("<article><h2>a<h2>b</h3>c", "a\nb\nc"),
        ("<ul><li><a href=x>one</a><li><a href=y>two</a></ul><div>text <a href=z>link</a></div>", "text link"),
    ],
)
def test_single_pages(page, text):
    assert alone(page) == text


def test_furniture_without_names_is_found_by_alignment(make_pages):
    def page(i, ad=False, notes=1):
        notes = "".join(f"<div><b>Note {i} {k}</b></div>" for k in range(notes))
        return f"<body><div>The Daily Example</div>{'<table><tr><td>Buy now</td></tr></table>' if ad else ''}<div><h1>Title {i}</h1><div>Body {i} text.</div>{notes}</div><p>All rights reserved</p></body>"

    found = texts(wrappers.extract(make_pages([page(i, i % 2 == 0, i % 4) for i in range(12)])))
    assert found == ["\n".join([f"Title {i}", f"Body {i} text.", *(f"Note {i} {k}" for k in range(i % 4))]) for i in range(12)]


def test_copies_of_a_page_keep_their_text(make_pages):
    assert texts(wrappers.extract(make_pages(["<body><div>one</div><p>two</p></body>"] * 5))) == ["one\ntwo"] * 5


def test_wrapper_is_a_union_free_expression():
    def show(p):
        name = ("TEXT" if p.same is None else "text") if p.label == "#" else "" if p.label[0] == "(" else p.label
        inner = " ".join(map(show, p.kids))
        return name + (f"({inner})" if inner else "") + "+" * p.repeated + "?" * p.optional

    pages = ["<div><h2>a</h2><p>1</p><h2>b</h2><p>2</p><p>3</p></div>", "<div><h2>c</h2><p>4</p></div><hr>same", "<div><h2>c</h2><p>4</p></div><ul><li>x</ul><hr>same"]
    own = [wrappers.folded(wrappers.parse(p)) for p in pages]
    both = wrappers.joined(wrappers.joined(own[0], own[1]), own[2])
    assert show(both) == "root(div((h2(TEXT) p(TEXT)+)+) ul(li(text))? text?)"
    assert show(wrappers.unpack(wrappers.pack(both))) == show(both)


def test_many_partitions_and_the_join_by_host_agree(make_pages, rows):
    rng = random.Random(2)
    pages = []
    for i in range(120):
        host = "hot.example" if i % 3 else f"h{i % 7}.example"
        extra = rng.choice(["", "<aside>no</aside>", "<ul><li>k</li></ul>", "<form>no</form>"])
        kind = rng.choice(["article", "main", "div"])
        pages.append((f"https://{host}:80/{i}", f"<nav>no</nav><{kind}>{extra}<p>text {i}</p><p>more {i}</p></{kind}>"))
    docs = make_pages(pages, parts=40)
    sent, met = wrappers.extract(docs), wrappers.extract(docs, sent_bytes=0)
    assert rows(sent, *OUT) == rows(met, *OUT)
    assert all(f"text {i}\nmore {i}" in t and "no" not in t for i, t in enumerate(texts(sent)))


def test_nulls_repeated_rows_and_names_that_clash(spark, rows):
    made = [(1, None, "<p>a"), (1, None, "<p>a"), (None, "http://x.example", None), (2, "not a url", ""), (3, "HTTP://User@X.example:8/", "<article>é")]
    df = spark.createDataFrame(made, PAGES)
    for name in ("host", "layout", "wrapper", "text", "origin", "wrappers"):
        df = df.withColumn(name, F.lit("other"))
    want = sorted([(1, None, "a", 1)] * 2 + [(None, "http://x.example", "", 0), (2, "not a url", "", 0), (3, "HTTP://User@X.example:8/", "é", 1)], key=repr)
    assert rows(wrappers.extract(df), *OUT) == want
    assert rows(wrappers.extract(df, sent_bytes=0), *OUT) == want


def test_empty_table(make_pages):
    out = wrappers.extract(make_pages([]))
    assert out.collect() == [] and tuple(out.columns) == OUT


def test_very_long_and_very_deep_pages():
    assert alone("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after") == "deep\nafter"
    long = "<article>" + "".join(f"<p>{i}</p><h2>{i}</h2>" if i % 3 else f"<ul><li>{i}</ul>" for i in range(20_000)) + "</article>"
    assert len(alone(long).split("\n")) == 20_000 + sum(1 for i in range(20_000) if i % 3)
    odd = "<a href=\"" * 3000 + "<p>x"
    assert isinstance(alone(odd), str)


def test_classes_of_their_own_make_wrappers_coarser(monkeypatch):
    monkeypatch.setattr(wrappers, "MAX_PARTS", 30)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pages = [f"<article><div class='{a}{b}x'><p>{a}{b}</p></div></article>" for a in letters for b in letters[:4]]
    trees = [wrappers.parse(p) for p in pages]
    own = wrappers.folded(trees[0])
    for t in trees[1:]:
        own = wrappers.joined(own, wrappers.folded(t))
    assert wrappers.parts_of(own) <= 30
    wrapper = wrappers.decide(own)
    assert [wrappers.main_text(t, wrapper) for t in trees] == [f"{a}{b}" for a in letters for b in letters[:4]]
