"""Template deduction against a plain deduction per host, and what names of elements may and may not do."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import html, templates

PAGES = "page_id long, url string, html string"


def text_of(source):
    return templates.main_text(html.parse(source), templates.Template())


@pytest.mark.parametrize("source, want", [
    ('<div class="content has-sidebar"><article><p>The story goes on.</p></article><div class=sidebar>x y</div></div>', "The story goes on."),
    ("<body><form id=aspnetForm><div><p>Long text of the page here.</p></div><ul><li><a href=x>menu</a></li></ul></form></body>", "Long text of the page here."),
    ('<div class="social-history"><p>Chapter one about life.</p></div>', "Chapter one about life."),
    ("<div class=x><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div>", ""),
    ('<main><p>t</p></main><div class="comments-area"><article class=comment><p>Me too me too</p></article></div>', "t"),
    ('<div class="site-header">Site</div><div><p>Text is here now.</p></div><div id="page-footer">f</div>', "Text is here now."),
    ("<nav>" + "<p>only a menu is here</p>" * 5 + "</nav>", ""),
    ("", "")])
def test_names_drop_what_is_beside_the_text_only(source, want):
    assert text_of(source) == want


def host_pages(count, seed, article):
    """Pages of one host: a plain frame with an unnamed notice and footer, and a story of their own."""
    rng = random.Random(seed)
    words = "river stone walks quiet morning letter window garden seven lamps".split()
    out = []
    for _ in range(count):
        story = "".join(f"<p>{' '.join(rng.choices(words, k=rng.randrange(3, 9)))}.</p>" for _ in range(rng.randrange(1, 4)))
        tag = "article" if article else "div"
        extra = f"<div class=more><span>{rng.choice(words)}</span></div>" if rng.random() < 0.3 else ""
        out.append(f"<html><body><div class=crown><b>The Daily Lamp</b></div><{tag} class=s>{story}</{tag}>{extra}<div class=base><p>All rights reserved by the Lamp and whoever else holds them, here and in all lands.</p></div></body></html>")
    return out


def test_an_unnamed_notice_on_all_pages_is_template_text(spark):
    rows = [(i, f"http://a.org/{i}", h) for i, h in enumerate(host_pages(12, 1, False))]
    docs = spark.createDataFrame(rows, PAGES).repartition(3)
    got = {r.page_id: r.text for r in templates.extracted(docs).collect()}
    for i, _, source in rows:
        page = html.parse(source)
        assert got[i] == "\n\n".join(b.text for b in page.blocks if "div.s" in b.path or "div.more" in b.path)
        assert "rights" in templates.main_text(page, templates.Template())  # without the template it stays


def plain_templates(rows, least_pages=templates.LEAST_PAGES, least_share=templates.LEAST_SHARE, least_tokens=templates.LEAST_TOKENS, nearly=templates.NEARLY):
    """Occurrence vectors as they are, grouped by equality."""
    hosts = defaultdict(dict)
    for _, url, source in rows:
        hosts[url.split("/")[2]][source] = html.parse(source)
    out = {}
    for host, pages in hosts.items():
        pages = list(pages.values())
        if len(pages) < least_pages:
            continue
        vectors = {path: tuple(p.opened.get(path, 0) for p in pages) for p in pages for path in p.opened}
        classes = defaultdict(list)
        for path, vector in vectors.items():
            support = sum(n > 0 for n in vector)
            if support >= least_pages and support >= least_share * len(pages):
                classes[vector].append(path)
        valid = {path for vector, paths in classes.items() if len(paths) >= least_tokens and len({n for n in vector if n}) == 1 for path in paths}
        nested = {p for p in valid if all(p[:k] in valid for k in range(1, len(p)))}
        if not nested:
            continue
        held = defaultdict(list)
        for p in pages:
            slots = defaultdict(list)
            for b in p.blocks:
                path = b.path
                while path and path not in nested:
                    path = path[:-1]
                slots[path].append(b.text)
            for path, texts in slots.items():
                held[path].append(tuple(sorted(texts)))
        constant = {s for s, texts in held.items() if max(texts.count(x) for x in set(texts)) >= nearly * len(pages)}
        chars = lambda slots: sum(len(t) for s in slots for page in held[s] for t in page)
        told = constant != set(held) and (len(pages) >= 2 * least_pages or chars(constant) <= chars(set(held) - constant))
        out[host] = ({templates.path_id(p) for p in nested}, {templates.path_id(s) for s in constant} if told else set())
    return out


def test_templates_are_those_of_a_plain_deduction(spark):
    rows = []
    for k, (host, article, count) in enumerate((("a", False, 9), ("b", True, 14), ("c", False, 2), ("d", False, 3))):
        rows += [(100 * k + i, f"http://{host}/{i}", h) for i, h in enumerate(host_pages(count, k, article))]
    rows += [(900 + i, "http://same/x", "<body><div><p>one</p></div><p>two</p></body>" + " " * (i % 4)) for i in range(8)]  # nothing varies
    rows += [rows[0]] * 3
    docs = spark.createDataFrame(rows, PAGES).repartition(4)
    got = {r.host: (set(r.template), set(r.constant or ())) for r in templates.templates(docs).collect()}
    assert {h: t for h, t in got.items() if t[0]} == plain_templates(rows)
    assert {r.text for r in templates.extracted(docs).where("url = 'http://same/x'").collect()} == {"one\n\ntwo"}


def test_an_article_on_all_pages_is_kept(spark):
    rows = [(i, f"http://h/{i}", f"<body><div><p>{i} o'clock</p></div><main><p>The same story everywhere.</p></main><div><b>end</b></div></body>") for i in range(6)]
    assert {r.text for r in templates.extracted(spark.createDataFrame(rows, PAGES)).collect()} == {"The same story everywhere."}
    assert templates.extracted(spark.createDataFrame([], PAGES)).count() == 0
