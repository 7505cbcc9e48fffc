"""Main-text extraction: names that must not delete text, hostile pages, and a plain reading of generated sites."""

import html
import random
import time

import pytest

from marketlens.llm import html_extract as H


def text(page):
    return " ".join(t for t, _ in H.Page(page).article())


@pytest.mark.parametrize("page,want", [
    ('<body><div class="layout has-menu"><article><p>Kept text</p></article></div></body>', "Kept text"),
    ('<body><div class="content no-sidebar"><article><p>Kept text</p></article></div></body>', "Kept text"),
    ('<body><div class="sidebar">gone<main><p>Kept text</p></main></div></body>', "Kept text"),
    ('<article><div class="article-header"><h1>Kept</h1></div><p>text</p></article>', "Kept text"),
    ('<article><div class="header"><h1>Kept</h1></div><p>text</p></article>', "Kept text"),
    ('<article><section id="discussion"><p>Kept text</p></section></article>', "Kept text"),
    ('<article><h2 id="related-work">Kept</h2><p id="side-effects">text</p></article>', "Kept text"),
    ('<article><p>Kept</p><div class="reader-comments"><p>gone</p></div><p>text</p></article>', "Kept text"),
    ('<article><p>Kept</p><div class="post ad">gone</div><div id="cookie-notice">gone</div><p>text</p></article>', "Kept text"),
    ('<article><p>Kept<a href="x>y" title=\'">\'> text</a></p></article>', "Kept text"),
    ('<article><p>Kept text <b>1 < 2</b></p></article>', "Kept text 1 < 2"),
])
def test_names_delete_furniture_only(page, want):
    assert text(page) == want


@pytest.mark.parametrize("head,unit,tail", [("", "<a ", ""), ("", "<div>x", ""), ("", '<a "', ">"), ("", "<a b='", ""), ("", "<!-- ", ""),
                                            ("", "<p", ""), ("", "</div", ">"), ("<div class='", "ad ", "'>x"), ("", "<div class=ad><article>", ""),
                                            ("", "<b></i>", ""), ("", "<b><p>", "")])
def test_hostile_pages_take_linear_time(head, unit, tail):
    def took(n):
        t = time.process_time()
        H.Page(head + unit * n + tail).article()
        return time.process_time() - t

    assert took(100_000) < 10 * took(25_000) + 1


def test_generated_sites_give_their_articles(spark):
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choices("abcdeé&<", k=rnd.randint(1, 7)))
    rows, want = [], {}
    for host in range(3):
        slogan, menu = word() + " slogan", [word() for _ in range(4)]
        for i in range(20):
            paragraphs = [" ".join(word() for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 5))]
            body = "".join(f"<p>{html.escape(p)}</p>\n" for p in paragraphs)
            page = (f"<html><head><title>t</title></head><body><nav>{' '.join(map(html.escape, menu))}</nav><div class='x'><div>{html.escape(slogan)}</div></div>"
                    f"<div class='body{i}'>{body}</div><div class='comments'>{html.escape(word())}</div><footer>f</footer></body></html>")
            key = len(rows)
            rows.append((key, f"https://H{host}.example/{i}", page, "clash", 3))
            want[key] = " ".join(" ".join(p.split()) for p in paragraphs)
    rows += [(900, None, None, "c", 1), (901, "x", "", "c", 1), (902, "https://h0.example/z", "<article>" + "<p>long words " * 50_000, "c", 1), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")
    got = [(r.page_id, r.text, r.n_chars) for r in H.extract(df).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    by_id = {i: t for i, t, _ in got}
    assert {i: by_id[i] for i in want} == want and by_id[900] == by_id[901] == "" and len(by_id[902]) == 50_000 * 11 - 1
