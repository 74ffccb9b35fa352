import random
import time

import pytest

from querysmith.llm import html_text as h


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_against_the_table():
    draw = random.Random(0)
    for _ in range(1500):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 14))] for _ in range(2))
        found = sorted(h.common_lines(a, b))
        left = iter(b)
        assert len(found) == lcs(a, b) and all(a[i] in left for i in found)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<body><nav>Menu</nav><article><h1>T</h1><p>A  b\n<b>c</b>d<br>e</article><footer>F</footer>", "T A b cd e"),
        ("<article><p>One<p>Two</article><div class='ad'>Buy</div>", "One Two"),
        ("<main><p>Text</p><section id=comments><p>First!</p></section></main>", "Text"),
        ("<article>x<script>var t='</p><p>';</script>y<style>p{}</style>z</article>", "xyz"),
        ("<article><p>1 < 2 and 3 > 2 &lt;b&gt; &#233;&nbsp;&hellip;</article>", "1 < 2 and 3 > 2 <b> é …"),
        ("<!-- c <article> --><article>a<!-- x -->b</article><div>outside</div>", "ab outside"),
        ("<div class='cookie-notice'>We use cookies</div><div class=content><p>Body</p></div><form>f</form>", "Body"),
        ("<article><aside><p>rel</p></aside><div hidden>no</div><p>yes", "yes"),
        ("<div class=sidebar><div>a</div><div>b</div></div><div>c and d</div>", "c and d"),
        ("<div style='overflow: hidden'><p>Body", "Body"),
        ('<p title="the hidden id">Body', "Body"),
        ("<div class='content has-sidebar'><p>Body</div>", "Body"),
        ("<article class='post comments-open'><p>Body</article>", "Body"),
        ("<div id='search-results'><p>Body</div>", "Body"),
        ("<div class='social'>Like <p>The only text of this page, whatever its class is called.</p></div><p>Short</p>", "The only text of this page, whatever its class is called. Short"),
        ("<p>Body of the page</p><div class='ad-slot'>buy a lot of things here</div><div id=left-nav-2>x</div><div class=related-items>y</div>", "Body of the page"),
    ],
)
def test_single_pages(page, text):
    assert h.assemble(*h.lines(page), set()) == text


def page(body, menu="Home | About us", tail="Contact"):
    return f"<html><body><div>{menu}</div>{body}<div>{tail}</div></body></html>"


def test_differencing(spark):
    rows = [
        (1, "http://x.org/news/1", page("<div>First story is long enough to be text.</div>"), "e"), (2, "http://x.org/news/2", page("<div>Second story, quite another one, also long.</div>"), "e"),
        (3, "http://y.org/a", page("<div>Lone page</div>"), "e"), (4, "http://X.org/copy/1", "<div>A copied text that is everywhere.</div>", "e"), (5, "http://x.org/copy/2", "<div>A copied text that is everywhere.</div>", "e"),
        (6, None, page("<p>no url</p>"), None), (None, "http://z.org/", None, None), (7, "http://z.org/p/1", "<article><p>Kept twice</p><p><a href=/>more</a></p></article>", ""), (8, "http://z.org/p/2", "<article><p>Kept twice</p><p><a href=/>more</a></p></article>", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r.text for r in h.main_text(df).collect()}
    assert got == {1: "First story is long enough to be text.", 2: "Second story, quite another one, also long.", 3: "Home | About us Lone page Contact", 4: "A copied text that is everywhere.", 5: "A copied text that is everywhere.", 6: "Home | About us no url Contact", None: "", 7: "Kept twice", 8: "Kept twice"}
    assert h.main_text(df.limit(0)).count() == 0


def test_neighbours_across_partition_borders(spark):
    from pyspark.sql import functions as F

    urls = [(i, f"http://h.org/{i // 10:03d}/{i % 10}") for i in range(300)] + [(500, "http://other.org/x"), (501, None)] + [(1000 + i, "http://h.org/004/5") for i in range(50)]
    df = spark.createDataFrame(urls, "rid long, url string").filter(F.col("url").isNotNull()).select("rid", *h.located()).repartition(6)
    got = {(r.host, r.path): (r.nearest, r.second) for r in h.neighbours(df).collect()}
    assert len(got) == 301 and got["other.org", "/x"] == (None, None)
    for i in range(300):
        around = (i - 1 if i else None, i + 1 if i < 299 else None)
        assert got["h.org", f"/{i // 10:03d}/{i % 10}"] == (around if i % 10 else around[::-1])


def test_against_brute_force(spark):
    """Sites without an article element or telling names, frames of every size: all pairs, a table for the alignment."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows, want = [], {}
    for host in range(12):
        menu = [f"Menu {host} {i}" for i in range(draw.randint(0, 40))]
        notice = " ".join(draw.choices(words, k=30))
        tail = [f"Foot {host} {i}" for i in range(draw.randint(0, 40))]
        site = {}
        for n in range(draw.randint(1, 9)):
            body = [" ".join(draw.choices(words, k=draw.choice((2, 4, 9, 60)))) for _ in range(draw.randint(1, 4))]
            site[f"/{draw.choice('abc')}/{n}"] = [*menu, notice, *body, *tail]
        if len(site) > 4:  # an article that a neighbour copies
            a, b = sorted(site)[:2]
            copied = " ".join(draw.choices(words, k=50))
            site[a].insert(len(menu) + 1, copied)
            site[b].insert(len(menu) + 1, copied)
        for path, own in site.items():
            rows.append((len(rows), f"http://h{host}.org{path}", "".join(f"<div>{line}</div>" for line in own)))
            common = lambda a, b: len([1 for x, y in zip(a, b, strict=False) if x == y]) if a[: len(b)] == b[: len(a)] else next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)
            before, after = max((p for p in site if p < path), default=None), min((p for p in site if p > path), default=None)
            order = sorted((p for p in (before, after) if p is not None), key=lambda p: (-common(path, p), p))
            keep = own
            if order:
                first, other = site[order[0]], site[order[-1]]
                keep = [line for line in own if line not in first or (len(line.split()) >= 8 and line not in other)]
                if len(order) == 1 and not any(len(line.split()) >= 8 for line in keep) or not keep:
                    keep = [line for line in own if line not in first or len(line.split()) >= 8]
                assert lcs(own, first) == sum(line in first for line in own)  # frames keep their order
            want[len(rows) - 1] = " ".join(keep or own)
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want


def test_alignments_are_the_same_at_every_size():
    """Which lines are shared doesn't depend on how many rows are kept on the way."""
    draw = random.Random(3)
    for _ in range(300):
        a, b = ([draw.choice("abcdef") for _ in range(draw.randint(0, 60))] for _ in range(2))
        found, left = sorted(h.common_lines(a, b)), iter(b)
        assert len(found) == lcs(a, b) and all(a[i] in left for i in found)
        assert len({frozenset(h._subsequence(a, b, every)) for every in (1, 2, 7, 1 << 25)}) == 1


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<!", '<a href="x" ', "<a '\"", "<?"])
def test_odd_markup_takes_linear_time(piece):
    began = time.process_time()
    h.lines(piece * ((1 << 20) // len(piece)))
    assert time.process_time() - began < 8  # by looking at every sign for each tag it would be hours


BODY = "The body of the page is here, and it is longer than that."


@pytest.mark.parametrize("page,text", [
    (f'<form id="aspnetForm"><article><p>{BODY}</form>', BODY), (f"<form><div><p>{BODY}</div></form>", BODY), (f'<div class="job-ad"><p>{BODY}', BODY), ('<div class="post first-reply"><p>Short', "Short"),
    (f'<article><p>Text.<section class="market-share"><p>{BODY}</section></article>', f"Text. {BODY}"), ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.", "Let x=2 be."),
    (f"<div><a>Home</a> <a>About us</a></div><p>{BODY}", BODY), ("<div><a>Home</a> <a>About</a></div><article><p>Text<p><a>one</a> <a>two</a></article>", "Text one two"),
    ("<article><p>Text<form><label>Name</label></form></article>", "Text"), (f"<form><label>Search</label></form><p>{BODY}", BODY), (f'<p>{BODY}<div class="werbung"><p>Kauf jetzt</div><div class="kommentare"><p>Toll</div>', BODY),
])
def test_forms_names_and_menus(page, text):
    assert h.assemble(*h.lines(page), set()) == text


def test_memory_of_long_alignments():
    import tracemalloc

    draw = random.Random(4)
    a, b = ([draw.randrange(50) for _ in range(20_000)] for _ in range(2))
    tracemalloc.start()
    assert len(h.common_lines(a, b)) > 3000
    assert tracemalloc.get_traced_memory()[1] < 30 << 20  # rows of bits for all lines would take 50 MB


def test_repeated_pages_and_names(spark):
    """Pages of one URL have the neighbours of that URL; columns of other names are ignored; a hot URL is one among others."""
    rows = [(1, "http://x.org/a/1", page("<div>First text of its own</div>"), "z")] * 40 + [(2, "http://x.org/a/2", page("<div>Second text of its own</div>"), "z")]
    got = h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, lines string").repartition(4)).collect()
    assert sorted(r.text for r in got) == ["First text of its own"] * 40 + ["Second text of its own"]


def test_very_long_pages(spark):
    long = "<article>" + "<p>line of text</p>" * 40_000 + "</article>"
    frame = "".join(f"<div>frame {i}</div>" for i in range(20_000))
    rows = [(1, "http://a/b", long), (2, "http://c/1", frame + "<div>one</div>" + frame), (3, "http://c/2", frame + "<div>two and three</div>" + frame)]
    got = {r.page_id: r for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].n_chars == 40_000 * 13 - 1 and got[2].text == "one" and got[3].text == "two and three"


def test_an_article_only_protects_its_lines(spark):
    def teasers(n, text):
        cards = "".join(f"<article><a href=/{i}>Card {n + i}</a><p>Teaser {n + i}</p></article>" for i in range(2))
        return page(f"<div><p>{text}</p></div>{cards}", menu="Home and about us")

    rows = [
        (1, "http://x.org/a/1", teasers(10, "The main text stands in a plain div and is long enough.")), (2, "http://x.org/a/2", teasers(20, "Another main text in a plain div, quite unlike the first one.")),
        (3, "http://y.org/a/1", page("<article>Only an article</article><p>Beside it</p>")), (4, "http://y.org/a/2", "<article>The neighbour has nothing else</article>"),
        (5, "http://z.org/a/1", teasers(30, "The same text on both pages, in a plain div, so long that it is most of all they have to say. " * 3)), (6, "http://z.org/a/2", teasers(40, "The same text on both pages, in a plain div, so long that it is most of all they have to say. " * 3)),
        (7, "http://lone.org/", teasers(50, "Main text of a lone page.")),
    ]
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "The main text stands in a plain div and is long enough. Card 10 Teaser 10 Card 11 Teaser 11"
    assert got[2] == "Another main text in a plain div, quite unlike the first one. Card 20 Teaser 20 Card 21 Teaser 21"
    assert got[3] == "Home | About us Only an article Beside it Contact"
    assert got[4] == "The neighbour has nothing else"
    assert got[5].count("The same text") == 3 and got[6].count("The same text") == 3 and "Home" not in got[5]
    assert got[7] == "Home and about us Main text of a lone page. Card 50 Teaser 50 Card 51 Teaser 51 Contact"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p class='notice'>x<p>main text<p>more</article>", "main text more"),
        ("<article><ul><li class='share'>x<li>y</ul><p>main text</article>", "y main text"),
        ("<div><p class=ad>x</div><p>main text", "main text"),
        ("<div><ul><li class=share>a<ul><li>b</ul>c</ul>text</div>", "text"),
        ("<dl><dt class=ad>x<dd>y</dl>z", "y z"),
        ("<table><tr><td class=ad>x<td>y<tr class=menu><td>a<tr><td>b</table>z", "y b z"),
        ("<table><tr><td><p class=ad>x<table><tr><td>i</table></td><td>y</table>z", "i y z"),
        ("<head><title>t</title><body><p>text", "text"),
        ("<div class=ad><p>x<p>y</div><p>text", "text"),
    ],
)
def test_omitted_end_tags(page, text):
    assert h.assemble(*h.lines(page), set()) == text
