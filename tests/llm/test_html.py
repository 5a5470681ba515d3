"""Wrappers: alignment against brute force, wide and deep pages, templates without an article, class words."""

import random
import sys
import time

import pytest
from shapeloom.llm import html


def text(spark, pages, **how):
    rows = [(k, f"http://h{host}/{k}", body) for k, (host, body) in enumerate(pages)]
    return [r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **how).orderBy("page_id").collect()]


def test_common_order_equals_brute_force():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        for bits in (1 << 26, 4):
            got = html.common(a, b, bits)
            assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(p < i and q < j for (p, q), (i, j) in zip(got, got[1:]))


def test_wide_pages_take_bounded_time():
    names = ["".join(random.Random(k).choice("abcdefgh") for _ in range(6)) for k in range(400)]
    r = random.Random(1)
    wide = lambda: "<body>" + "".join(f"<div class={r.choice(names)}>x</div>" for _ in range(50_000))
    began = time.time()
    one, two = (html.folded(html.tree(wide())) for _ in range(2))
    assert len(html.merge(one, two)[2][0][2]) > 50_000 and time.time() - began < 90


def test_wrappers_survive_storage():
    one, two = (html.folded(html.tree(x)) for x in ("<ul class='b a'><li>a<li>b</ul><b>t</b>", "<ul class='a b'><li>c</ul>"))
    node = html.merge(one, two)
    assert html.loads(html.dumps(node)) == node
    deep = html.tree("<div><p>a</p>" * 20_000)
    sys.setrecursionlimit(1_000_000)
    assert html.dumps(html.loads(html.dumps(deep))) == html.dumps(deep) and html.dumps(html.merge(deep, deep)) == html.dumps(deep).replace("#11 ", "#12 ")


@pytest.mark.parametrize("cls", ["single has-sidebar", "no-menu", "with-navigation", "sidebar"])
def test_class_words_of_a_page_hide_nothing(spark, cls):
    page = f"<body class='{cls}'><div class=sidebar>x</div><article class='post newsletter'><p>one</p><section id=related-work>two</section><div class=search-results-analysis>three</div><div class='share-buttons'>no</div></article></body>"
    assert text(spark, [(1, page)]) == ["one\n\ntwo\n\nthree"]


def test_an_article_inside_marked_elements_is_found(spark):
    pages = [(1, "<div class=widget><article>one</article></div><div class=ad>no</div>"), (2, "<div class=widget><article>no</article></div><article>two</article>"), (3, "<div class=notice>three</div>"), (4, "<nav>no</nav>"), (5, "<form id=all><p>five</p><div class=menu>no</div></form><footer>no</footer>"), (6, "<form><main><p>six</main></form>")]
    assert text(spark, pages) == ["one", "two", "three", "", "five\n\nno", "six"]


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0}])
def test_region_is_where_pages_vary(spark, how):
    page = lambda k: f"<body><div class=x>Shop Home</div><div class=c><h1>title {k}</h1><div class=t>{'<p>words ' * k}{k}</div><div>the same</div></div><div class=y>All about us</div></body>"
    pages = [(1, page(k)) for k in (1, 2, 3)] + [(2, page(4))] + [(3, page(5))] * 2 + [(3, None), (3, "")]
    got = text(spark, pages, **how)
    inner = lambda k: "\n\n".join([f"title {k}", *["words"] * (k - 1), f"words {k}", "the same"])
    whole = lambda k: f"Shop Home\n\n{inner(k)}\n\nAll about us"
    assert got == [inner(1), inner(2), inner(3), whole(4), whole(5), whole(5), "", ""]


def test_near_copies_are_not_cut(spark):
    page = lambda x: f"<body><div class=m>Menu</div><div class=c><p>first</p><p>second {x}</p><p>third</p></div></body>"
    assert text(spark, [(1, page("a")), (1, page("b"))]) == ["first\n\nsecond a\n\nthird", "first\n\nsecond b\n\nthird"]


def test_expressions(spark):
    rows = spark.createDataFrame([(1, "http://h/1", "<ul><li>a<li>b</ul><b>t</b>"), (2, "http://h/2", "<ul><li>c</ul>")], "page_id long, url string, html string")
    assert [(r.host, r.pages, r.expression) for r in html.expressions(rows).collect()] == [("h", 2, "(<>(<ul>(<li>(#)</li>)+</ul>)(<b>(text)</b>)?</>)")]


def test_unclosed_and_stray_tags_take_linear_time():
    import time

    for page in ("<p>x<span>" + "</p>y" * 20_000, "<div>" + "<font>x" * 20_000, "<table>" + "<tr><td>x" * 20_000, "<ul>" + "<li>x</b>" * 20_000):
        began = time.time()
        list(html.events(page))
        assert time.time() - began < 2


def test_events_close_as_a_search_of_the_stack_does():
    """Random tags against the rule as it is told: a tag closes the last open one of its name, unless an enclosing element ends the search."""
    import random

    def by_search(page):
        stack, out = [], []
        for m in html._TOKEN.finditer(page):
            tag = m[3].lower()
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] == tag:
                        out += [("close", t) for t in reversed(stack[k:])]
                        del stack[k:]
                        break
                    if (tag not in html.BLOCK or tag == "p") and stack[k] in html._INLINE_STOP:
                        break
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if tag in html._CLOSED_BY.get(stack[k], ()):
                        out += [("close", t) for t in reversed(stack[k:])]
                        del stack[k:]
                        break
                    if stack[k] in html._INLINE_STOP:
                        break
                out.append(("void" if tag in html.VOID else "open", tag))
                if tag not in html.VOID:
                    stack.append(tag)
        return out + [("close", t) for t in reversed(stack)]

    r = random.Random(2)
    tags = ["p", "b", "span", "div", "li", "ul", "td", "tr", "table", "article", "br", "dt", "dd", "option", "th", "tbody"]
    for _ in range(400):
        page = "".join(f"<{r.choice(['', '', '/'])}{r.choice(tags)}>" for _ in range(r.randint(0, 60)))
        assert [(k, t) for k, t, *_ in html.events(page)] == by_search(page)


@pytest.mark.parametrize("pages", [1, 5])
def test_teasers_of_other_articles_are_left_out(spark, pages):
    page = lambda k: f"<body><article><h1>Title {k}</h1><p>{' '.join(f'w{k}x{i}' for i in range(60))}</p></article><article class='teaser'><p>Other story {k}</p></article></body>"
    rows = html.main_text(spark.createDataFrame([(k, f"http://h/{k}", page(k)) for k in range(pages)], "page_id long, url string, html string")).collect()
    assert all("Other story" not in r.text and r.text.startswith(f"Title {r.page_id}") for r in rows)
