"""Wrappers: folds and alignments against enumerated streams, main texts against a plain reader, odd pages."""

import html
import re

import pytest

from tidemark.llm import queries as q
from tidemark.llm.wrappers import dump, extract_pages, infer, load, main_slots, parse, slots, slots_in


def shown(items):
    """An expression as text: ? for optional, + for repeated."""
    return " ".join((i.key if not i.children else f"{i.key}{{{shown(i.children)}}}" if i.key[0] != "(" else f"({shown(i.children)})") + ("?" if i.optional else "") + ("+" if i.repeated else "") for i in items)


def test_folds_and_alignment():
    assert shown(parse("<ul><li>a<li>b<li><b>c</b> d</ul>")[0]) == "ul{li{#}+}"
    assert shown(parse("<dl><dt>a<dd>b<dt>c<dd>d<dd>e</dl>")[0]) == "dl{(dt{#} dd{#}+)+}"
    assert shown(parse("<h2>a</h2><p>b<p>c<h2>d</h2><p>e<div>f</div>")[0]) == "(h2{#} p{#}+)+ div{#}"
    one, two, three = (dump(parse(p)[0]) for p in ("<div><h1>a</h1><p>b</p></div>", "<div><h1>a</h1><ul><li>x</ul><p>b<p>c</div><hr>end", "<div><p>b</p></div>"))
    wrapper = infer([one, two, three])
    assert shown(load(wrapper)) == "div{h1{#}? ul{li{#}}? p{#}+} #?"
    assert infer([wrapper, one]) == wrapper and shown(load(infer([three, two, one]))) == shown(load(wrapper))
    assert slots_in(wrapper, one) == [0, 2] and slots_in(wrapper, two) == [0, 1, 2, 3] and slots_in(wrapper, three) == [2]


def test_texts_find_their_slot():
    items, texts = parse("<p>one<p>two &amp;amp; <i>th</i>ree<br>four</p>tail<p>five")
    number = {id(i): k for k, (i, _) in enumerate(slots(items))}
    assert [t for _, t, _ in texts] == ["one", "two &amp; three four", "tail", "five"]
    assert [number[id(i.place())] for i, _, _ in texts] == [0, 0, 1, 2] and shown(items) == "p{#}+ # p{#}"


def plain(page):
    """The article of one of the given pages, by its markup."""
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", article[1] if article else "")
    blocks = [re.sub(r"[ \t-\r]+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip(" ") for b in blocks]
    return " ".join(b for b in blocks if b)


def test_given_pages(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = q.op13_html_extraction(spark, sf).collect()
    assert {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got} == {(k, p["url"], t := plain(p["html"]), len(t)) for k, p in pages.items()}
    assert len(got) == len(pages) and all(r["text"] for r in got)


WORDS = "The river ran past the mill and the old stone bridge, {} and nobody counted the boats that went by in number {}."


def site(k, article="div class='post-body'", notice=""):
    """A page without an article: menu, notice, prose, links, comments, footer."""
    name = article.split()[0]
    prose = "".join(f"<p>{WORDS.format('north' if (k + j) % 2 else 'south', k * 10 + j)}</p>" for j in range(1 + k % 4))
    return f"""<html><head><title>t{k}</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="has-sidebar">
    <div id="top-nav"><a href="/">Home</a> <a href="/x">News {k}</a></div><header><h2>Site</h2></header>{notice}
    <div class="col"><{article}><h1>Title {k} &eacute;</h1>{prose}<ul><li>point {k}</li><li>other <b>point</b></li></ul></{name}>
    <div><a href="/a">See story {k + 1}</a> <a href="/b">See story {k + 2}</a></div><p>All rights are with the people of the mill by the river bridge.</p></div>
    <section class="comments"><article><p>Nice text, reader {k}, I liked it more than the last one, thanks for it.</p></article></section>
    <aside><p>Buy {k}</p></aside><form><label>Mail</label><p>Send us your mail {k}</p></form><footer>(c) {k}</footer></body></html>"""


def main_text(k):
    return " ".join([f"Title {k} é", *(WORDS.format("north" if (k + j) % 2 else "south", k * 10 + j) for j in range(1 + k % 4)), f"point {k}", "other point"])


@pytest.mark.parametrize("most", [2, 256])
def test_sites_without_articles(spark, most):
    """Slots over a host's pages tell prose from link lists and the template; streams differ, and are aligned in chunks."""
    rows = []
    for k in range(24):
        rows.append((k, f"http://A.example/{k}", site(k, notice="<div class='cookie-notice'>We use cookies</div>" if k % 3 else "")))
        rows.append((100 + k, f"http://b.example/{k}?q", site(k, article="article")))
        rows.append((200 + k, f"https://c.example/{k}", site(k, article="div", notice="<p>x</p>" * (k % 2))))
    got = {r["id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), most=most).collect()}
    for k in range(24):
        assert got[k] == got[100 + k] == got[200 + k] == main_text(k)


ODD = [
    (1, None, "<p>a</p>"), (2, "no host", None), (3, "http://h/", ""), (4, "http://h/", " \n "), (5, "http://h/", "plain &lt;text&gt; &#x41;&nbsp;b"), (6, "http://h/", "<article><p>cut he"), (7, "http://h/", "<article>x <a href='1>2'>link</a><!-- no --> y<script>z"),
    (8, "http://h/", "<div>" * 2000 + "deep" + "</div>" * 10), (9, "http://h/", "<p " + "a" * 50_000), (10, "http://h/", "<article>" + "<p>word</p>" * 20_000 + "</article>"), (10, "http://h/", "<p>same id</p>"), (None, "http://h/", "<main><h1>T</h1>body</main>"),
    (11, "http://h/", "<nav>only a menu</nav>"), (12, "http://h/", "</p></div><b>un<i>cl</b>osed</i> < 5"), (13, "http://h/", "<article>" + "".join(f"<h{1 + i % 3}>t{i}</h{1 + i % 3}><p>a</p>" + "<div>b</div>" * (i % 7 % 3) for i in range(3000)) + "</article>"),
]


def test_odd_pages(spark):
    df = spark.createDataFrame([(*r, "x", 1, ["y"], "z") for r in ODD], "page_id long, url string, html string, text string, id int, slot array<string>, host string")
    got = extract_pages(df)
    assert got.columns == ["id", "url", "text", "n_chars"] and got.count() == len(ODD)
    rows = got.collect()
    text = {r["id"]: r["text"] for r in rows if r["id"] != 10}
    assert text[1] == "a" and text[2] == text[3] == text[4] == text[9] == text[11] == "" and text[5] == "plain <text> A b"
    assert text[6] == "cut he" and text[7] == "x link y" and text[8] == "deep" and text[None] == "T body" and text[12] == "unclosed < 5"
    assert sorted(len(r["text"]) for r in rows if r["id"] == 10) == [7, 20_000 * 5 - 1]
    assert text[13].startswith("t0 a t1 a b t2 a b b t3 a") and all(r["n_chars"] == len(r["text"]) for r in rows)
    empty = extract_pages(df.where("false"))
    assert empty.count() == 0 and empty.columns == got.columns


def test_parts_that_stand_apart():
    page = "<body><article><header><h1>H</h1></header><p>text</p><div class='ad'>buy</div><p class='share'>s</p><footer>f</footer><section id='comments'><p>c</p></section></article><p>out</p></body>"
    items, texts = parse(page)
    keep = main_slots(dump(items), {})
    number = {id(i): k for k, (i, _) in enumerate(slots(items))}
    assert [t for i, t, _ in texts if number[id(i.place())] in keep] == ["H", "text"]
