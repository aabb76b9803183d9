import html
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from touchline.llm.html_extract import evidence, extract_pages, main_text, minimum_cut, op8_html_extract, read_blocks, smoothness


def article_of(page):
    """Text of the article element of the test pages, by regular expressions for their one layout."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", body)
    return "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts) if t)


def test_whole_table_gives_the_articles(spark):
    d = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in op8_html_extract(spark, d).collect()}
    want = {p.page_id: (p.url, article_of(p.html), len(article_of(p.html))) for p in pages}
    assert got == want


FULL = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header>
<ul class=menu><li><a href="/">Home</a><li><a href="/x">More</a></ul><div class="cookie-notice"><p>We use cookies on this site. Accept them.</p></div>
<main><article><header><h1>A title</h1></header><p>First &eacute; paragraph,
 with   spaces &amp; <b>bold</b>text.<p>Short.<div class="ad">Buy this now, it is a great offer.</div><ul><li>An item of the list.</li></ul>
<blockquote>Quoted words here.</blockquote></article></main><aside><p>Related reading, a long sentence that says nothing of the article.</p></aside>
<form><label>Mail</label><input><button>Send</button></form><section id="comments"><article class="comment"><p>I liked this text very much, thank you.</p></article>
</section><footer>&copy; 2020 Someone.</footer><script>var a="<p>no</p>";</script></body></html>"""


def test_boilerplate_of_many_kinds():
    assert main_text(FULL) == "A title\nFirst é paragraph, with spaces & boldtext.\nShort.\nAn item of the list.\nQuoted words here."


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p", ""), ("<article><p>cut off &am", "cut off &am"), ("<nav><a href='x'>menu</a>", ""),
                                       ("<article>a<br>b</article>", "a b"), ("<article><p>x < y and 3 > 2</p></article>", "x < y and 3 > 2"),
                                       ("<article><p title=\"a>b\">q</p><!-- <p>no</p> --></article>", "q")])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_cut_equals_the_best_labelling():
    rnd = random.Random(4)
    for _ in range(150):
        n = rnd.randint(1, 8)
        costs = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rnd.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.4]

        def price(keep):
            return (sum(c for c, k in zip(costs, keep) if c > 0 and not k) + sum(-c for c, k in zip(costs, keep) if c < 0 and k)
                    + sum(c for i, j, c in edges if keep[i] != keep[j]))

        best = min(price(k) for k in itertools.product([False, True], repeat=n))
        assert price(minimum_cut(costs, edges)) == pytest.approx(best, abs=1e-6)


def test_long_page_and_table_edges(spark):
    rows = [(1, None, None), (2, "u", "<article>" + "<p>Some words here.</p>" * 5000 + "</article>"), (2, "u", ""), (None, "u", "<article><p>Text here</p></article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = [tuple(r) for r in extract_pages(df).collect()]
    assert [(g[0], g[3]) for g in got] == [(1, 0), (2, 5000 * 17 - 1), (2, 0), (None, 9)]
    assert extract_pages(df.limit(0)).count() == 0


LONG = "Some long text of the article, which has so many words in it that one takes it for prose."


@pytest.mark.parametrize("page,text", [
    # a name that only mentions boilerplate
    (f"<div class='post-share-bar-story'><h1>T</h1><p>{LONG}<p>Short.</div>", f"T\n{LONG}\nShort."),
    (f"<div class=featured-header-free><h1>Title</h1><p>{LONG}<p>Short.</div>", f"Title\n{LONG}\nShort."),
    (f"<article><header class=article-header><h1>A title</h1></header><p>{LONG}</article>", f"A title\n{LONG}"),
    # comments in other languages, under several names, and as articles inside the article
    (f"<div><h1>A title</h1><p>{LONG}</div><div class=kommentare><p>{LONG}</div>", f"A title\n{LONG}"),
    (f"<div><h1>A title</h1><p>{LONG}</div><div class='comment-body'><p>{LONG}</div>", f"A title\n{LONG}"),
    (f"<article><h1>A title</h1><p>{LONG}<section id=comentarios><article><p>{LONG}</article></section></article>", f"A title\n{LONG}"),
    (f"<article><h1>A title</h1><p>{LONG}</p><div class='ad-box'>{LONG * 10}</div><p>{LONG}</article>", f"A title\n{LONG}\n{LONG}"),
    (f"<main><h1>A title</h1><p>{LONG}</p><aside><p>{LONG * 10}</p><p>{LONG}</p></aside><p>Short.<p>{LONG}</main>", f"A title\n{LONG}\nShort.\n{LONG}"),
    (f"<article><h1>A title</h1><p>{LONG}<article><p>{LONG}</article></article>", f"A title\n{LONG}"),
])
def test_names_are_read_as_compounds(page, text):
    assert main_text(page) == text


def plain_page(rnd):
    """A page of div and p elements without one name, and the blocks that are its article."""
    def words(a, b):
        return " ".join(rnd.choice("stone river of the and old to walk night was bread sky".split()) + str(len(want) + len(junk)) for _ in range(rnd.randint(a, b)))

    want, junk = [], []

    def keep(a, b, stop):
        want.append(words(a, b) + stop)
        return want[-1]

    def drop(a, b, stop=""):
        junk.append(words(a, b) + stop)
        return junk[-1]

    def links(n):
        return "".join(f"<li><a href=x>{drop(1, 3)}</a></li>" for _ in range(n))

    out = [f"<div><div>{drop(1, 3)}</div><ul>{links(rnd.randint(3, 8))}<li>{drop(2, 5)}</ul></div><div><div>", f"<h1>{keep(3, 8, '')}</h1>"]
    for _ in range(rnd.randint(4, 10)):
        kind = rnd.random()
        if kind < 0.55:
            out.append(f"<p>{keep(25, 90, '.')}</p>")
        elif kind < 0.75:
            out.append(f"<p>{keep(1, 4, rnd.choice(['', '.', '?']))}</p>")
        elif kind < 0.85:
            out.append(f"<h3>{keep(1, 3, '')}</h3>")
        elif kind < 0.95:
            out.append("<ul>" + "".join(f"<li>{keep(1, 6, '')}</li>" for _ in range(rnd.randint(2, 4))) + "</ul>")
        else:
            out.append(f"<p><a href=y>{keep(2, 5, '')}</a></p>")
    out.append(f"<p>{keep(25, 60, '.')}</p></div><div><div>{drop(1, 3)}</div><ul>{links(rnd.randint(2, 5))}</ul><div>{drop(6, 14, '.')}</div></div></div>")
    out.append(f"<div>&copy; {drop(2, 6)}</div>")
    junk[-1] = "© " + junk[-1]
    return "".join(out), set(want)


def test_cut_decides_where_the_evidence_does_not():
    rnd = random.Random(8)
    blocks = turned = by_sign = by_cut = 0
    for _ in range(300):
        page, want = plain_page(rnd)
        read = read_blocks(page)
        costs = [evidence(b) for b in read]
        kept = minimum_cut(costs, smoothness(read))
        truth = [b.text in want for b in read]
        blocks += len(read)
        turned += sum((c > 0) != k for c, k in zip(costs, kept))
        by_sign += sum((c > 0) != t for c, t in zip(costs, truth))
        by_cut += sum(k != t for k, t in zip(kept, truth))
    assert turned > 0.05 * blocks
    assert by_cut < 0.02 * blocks and by_cut < 0.3 * by_sign


@pytest.mark.parametrize("page", ["<div>" * 40000 + "x" + "</section>" * 40000, "<ul><li><ul>" + "<div>a<li>b</li>" * 20000, "<div><article>" * 20000 + "</p>" * 20000])
def test_reading_is_linear_in_stray_tags(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 10
