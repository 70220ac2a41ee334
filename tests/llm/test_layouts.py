import numpy as np
import pytest

from tessera.llm import html


def extracted(spark, pages):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    return [r.text for r in sorted(html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_each_page_decides_whether_it_has_an_article(spark):
    plain = [f"<body><nav>Menu</nav><div><p>Plain story {i} is told at some length</p></div></body>" for i in range(4)]
    pages = [("http://h.com/a", "<body><p>Aside text</p><article>The article</article></body>"), *(("http://h.com/p", p) for p in plain), (None, "<main>Main text</main>"), (None, "<div>No main here</div>")]
    assert extracted(spark, pages) == ["The article", *(f"Plain story {i} is told at some length" for i in range(4)), "Main text", "No main here"]


def test_copies_are_no_template(spark):
    story = "One story that three pages and more repeat word for word"
    dated = [("http://h.com/", f"<body><div><p>{story}</p></div><ul><li>Seen {i}</li></ul></body>") for i in range(5)]
    assert all(story in t for t in extracted(spark, dated))
    copies = [("http://h.com/", f"<body><div><h1>{story}</h1></div></body>")] * 5 + [("http://h.com/", f"<body><div><p>Other {i} {story}</p></div></body>") for i in range(3)]
    assert extracted(spark, copies) == [story] * 5 + [f"Other {i} {story}" for i in range(3)]
    short = [("http://h.com/", "<body><h1>Short</h1><div><p>Longer text that one other page varies</p></div></body>")] * 3 + [("http://h.com/", "<body><div><p>Varied</p></div></body>")]
    assert extracted(spark, short)[0].startswith("Short ")


def test_wrappers_named_for_what_they_hold_beside_the_article(spark):
    body = lambda i: f"<h1>Title {i}</h1><p>Story {i} is told here at some length</p>"
    want = lambda i: f"Title {i} Story {i} is told here at some length"
    opens = ["<div class='content has-sidebar'>", "<div class=no-sidebar>", "<div id='header-fixed'>", "<div class='share-enabled comments-open'>", "<section class='reviews'>", "<form>"]
    pages = [(f"http://h{k}.com/", f"<body><nav><a>Menu</a></nav>{o}<article>{body(i)}</article></body>") for k, o in enumerate(opens) for i in range(4)]
    pages += [(f"http://p{k}.com/", f"<body><nav><a>Menu</a></nav>{o}<div>{body(i)}</div></body>") for k, o in enumerate(opens) for i in range(4)]
    assert extracted(spark, pages) == [want(i) for _ in range(2) for _ in opens for i in range(4)]


def test_what_is_outside_stays_outside(spark):
    page = lambda i: f"<body><div class='cookie-notice'>We use cookies {i}</div><div><p>The story {i} is longer than the rest of it</p></div><section class=comments><article>Reply {i}</article></section></body>"
    assert extracted(spark, [("http://h.com/", page(i)) for i in range(4)]) == [f"The story {i} is longer than the rest of it" for i in range(4)]


def test_the_wrapper_tells_constant_text_from_slots_of_one_path(spark):
    """Paragraphs of one path: the first and the last are the host's own on every page.
    A set of seen paths can't part them; the wrapper has constants before and after."""
    page = lambda i: f"<body><div><p>Read our guide to houses first</p><p>Story {i} begins here and takes its time</p><p>and {i} goes on for longer than that</p><p>All stories are our own</p></div></body>"
    pages = [(f"http://h.com/{i}", page(i)) for i in range(8)]
    assert extracted(spark, pages) == [f"Story {i} begins here and takes its time and {i} goes on for longer than that" for i in range(8)]
    trees = [html.blocks(h) for _, h in pages]
    own = {html.digest("Read our guide to houses first"), html.digest("All stories are our own")}
    wrapper = None
    for tree, texts in trees:
        node = html.folded(tree, texts, html._symbols_of([html.digest(t) for t, _ in texts], own))
        wrapper = html.merged(wrapper, node) if wrapper else node
    assert html.expression(wrapper) == "(body(div(p(=) p(#)+ p(=))))"


def test_the_block_of_most_varying_text_holds_the_article(spark):
    """No article element and no telling names: text mass decides."""
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    page = lambda i: f"<body><div class=c1>{words(i, 5)}</div><div class=c2><h1>T{i}</h1><p>{words(i + 50, 60)}</p><p>{words(i + 99, 60)}</p></div><div class=c3>{words(i + 7, 4)}</div></body>"
    got = extracted(spark, [(f"http://h.com/{i}", page(i)) for i in range(6)])
    assert got == [f"T{i} {words(i + 50, 60)} {words(i + 99, 60)}" for i in range(6)]


def test_broken_quotes_and_unclosed_elements_lose_no_text(spark):
    odd = {
        "<p title=it's>Hello world</p><p>More</p>": "Hello world More",
        '<p title="it>Hello</p><p>More</p>': "Hello More",
        "<p a=b'c\"d>One</p><p>Two's</p>": "One Two's",
        "<p>One<object data=x>Two</p><p>Three": "OneTwo Three",
        "<p>One</p><svg width=3><p>Two</p>": "One Two",
        "<p>One</p><canvas><p>Two</p><video src=a><p>Three</p>": "One Two Three",
        "<p>One</p><svg><text>no</text></svg><p>Two</p><canvas>no</canvas>": "One Two",
        "<p>One</p><textarea><p>Two</p>": "One Two",
        "<p>One</p><p a='x>y' b=\"p>q\">Two</p>": "One Two",
        "<p>One</p><div/><p>Two</p>": "One Two",
        "<p>One</p><p =>Two</p><p a= >Three</p>": "One Two Three",
    }
    got = extracted(spark, [(f"http://h{k}.com/", h) for k, h in enumerate(odd)])
    assert got == list(odd.values())


def test_what_is_outside_stays_so_at_any_depth(spark):
    deep = lambda n, inner: "<div>" * n + inner + "</div>" * n
    pages = [("http://h.com/a", f"<article>{deep(n, f'<nav>Menu <div>{n}</div></nav><p>Story {n} is told here</p>')}<p>End {n}</p></article>") for n in (3, 140, 149, 150, 151, 160, 400)]
    assert extracted(spark, pages) == [f"Story {n} is told here End {n}" for n in (3, 140, 149, 150, 151, 160, 400)]


@pytest.mark.parametrize("table", [64, 1 << 28])
def test_common_places_are_longest(monkeypatch, table):
    monkeypatch.setattr(html, "TABLE", table)
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = ([str(v) for v in rng.integers(0, 4, rng.integers(0, 30))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        found = html.common(a, b)
        assert len(found) == best[-1, -1] and all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def test_shards_do_not_depend_on_the_layout(spark):
    """One group of 600 equal texts, a third of it one row repeated, over any partitions."""
    from collections import Counter

    from tessera.llm import sharding

    rows = [(i, f"text {i} " * (i % 9)) for i in range(400)] + [(5000 + i, "same words") for i in range(400)] + [(77, "same words")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [Counter(tuple(r) for r in sharding.shard_by_bytes(df.repartition(n), 8, range_rows=50).collect()) for n in (1, 2, 9, 31)]
    assert all(f == found[0] for f in found[1:]) and sum(found[0].values()) == 1000
    slots = {}
    for r, n in found[0].items():
        slots.setdefault(r[3], []).extend([r[4]] * n)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_wrappers_do_not_depend_on_the_layout(spark):
    page = lambda i: f"<body><nav>Menu</nav><div class=c{i % 3}>" + "".join(f"<p>Story {i} part {k}</p>" for k in range(1 + i % 5)) + ("<ul><li>x</li></ul>" if i % 4 else "") + "</div></body>"
    df = spark.createDataFrame([(i, f"http://h.com/{i}", page(i)) for i in range(120)], "page_id long, url string, html string")
    found = []
    for n in (1, 4, 16):
        rows = html.parsed(df.repartition(n), "page_id", "url", "html")
        marked = rows.join(html.constants(rows), "host", "left")
        found.append([r.wrapper for r in html.wrappers(html.shapes(marked), share=7).collect()])
    assert found[0] == found[1] == found[2] and len(found[0]) == 1
