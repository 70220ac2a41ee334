import json
from collections import Counter

import numpy as np
import pytest

from tessera.llm import html, pivots, urls
from tessera.llm.graph import components
from tessera.llm.queries import RULES

# -- graph -------------------------------------------------------------------------


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (101, 103), (7, 7), (None, 3), (200, 199)] + [(500, 500 + i) for i in range(200)]
    out = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert out == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 104)}, 199: 199, 200: 199, **{500 + i: 500 for i in range(200)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


# -- urls --------------------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)).name if fits else None


def test_rules(spark, sf):
    odd = [None, "", "no scheme", "http://", "HTTP://A.ORG/x", "http://example.org/es/1", "http://x.example.org/en/12?q#f", "http://notexample.org/es/", "http://com/de/", "a://b://c/d", "http://É.com/fr/", "x://h\n/p", "http://org", "http://a.org?x=/en/1"]
    pages = [(i, u, None) for i, u in enumerate(odd)] + [(1000 + r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    out = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in out) == Counter((i, *brute_rule(u)) for i, u, _ in pages)
    verdict = {r.name: r.verdict for r in RULES}
    assert all(r.verdict == verdict.get(r.rule, r.verdict) and r.verdict in ("allow", "block") for r in out)


def brute_rank(seeds, edges, damping=0.85):
    """Power iteration to the end; hosts without links return their rank to the seeds."""
    hosts = sorted(set(seeds) | {h for e in edges for h in e})
    at = {h: i for i, h in enumerate(hosts)}
    m, s = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
    for h, x in seeds.items():
        s[at[h]] = x
    for (a, b), w in edges.items():
        m[at[b], at[a]] += w
    out = m.sum(axis=0)
    for i in range(len(hosts)):
        m[:, i] = m[:, i] / out[i] if out[i] else s
    rank = s.copy()
    for _ in range(3000):
        rank = (1 - damping) * s + damping * m @ rank
    return {h: rank[at[h]] for h in hosts if rank[at[h]] > 0}


def ranked(spark, seeds, edges, **how):
    table = spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, weight double")
    return {r.host: r["rank"] for r in urls.page_rank(spark.createDataFrame(list(seeds.items()), "host string, share double"), table, settled=1e-9, **how).collect()}


@pytest.mark.parametrize("hub", [2, 50_000])
def test_page_rank(spark, monkeypatch, hub):
    monkeypatch.setattr(urls, "HUB", hub)
    edges = {("a", "b"): 2.0, ("b", "c"): 1.0, ("a", "c"): 1.0, ("c", "a"): 1.0, ("d", "a"): 5.0, ("a", "end"): 1.0, ("b", "end"): 3.0, ("x", "y"): 1.0} | {("a", f"leaf{k}"): 1.0 for k in range(7)}
    seeds = {"a": 0.75, "d": 0.25}
    want, got = brute_rank(seeds, edges), ranked(spark, seeds, edges)
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-7 for h in want)
    assert ranked(spark, {}, edges) == {} and ranked(spark, {"a": 1.0}, {}) == {"a": 1.0}


def test_page_rank_reaches_the_end_of_a_chain_of_60(spark):
    edges = {(f"h{i}", f"h{i + 1}"): 1.0 for i in range(60)}
    want, got = brute_rank({"h0": 1.0}, edges), ranked(spark, {"h0": 1.0}, edges)
    assert len(got) == 61 and all(abs(got[h] - want[h]) < 1e-7 for h in want)


def test_links_decide_for_other_hosts(spark):
    link = lambda *to: "".join(f'<a class="x" href="{t}">t</a>' for t in to)
    pages = [
        (1, "http://good.org/x", link("https://friend.net/", "/local")), (2, "http://friend.net/en/", link("http://second.net/a")), (3, "http://bad.com/de/1", link("http://good.org/")),
        (4, "http://spam.net/x", link("http://bad.com/de/1", "HTTP://BAD.com/")), (5, "http://spammer.net/y", link("//spam.net/q")), (6, "http://second.net/", ""), (7, "http://lone.net/", None), (None, None, None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'z' host", "1.0D trust", "'q' verdict")
    out = {r.page_id: r for r in urls.filter_urls(df, RULES).collect()}
    assert {i: out[i].verdict for i in out} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", None: "allow"}
    assert out[2].trust > out[6].trust > 0 and out[4].distrust > out[5].distrust > 0
    assert urls.filter_urls(df.limit(0), RULES).collect() == []


# -- html --------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no";</script></head><body><header>Site</header>
<nav><ul><li><a href="/a">Menu</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies</div><aside class=sidebar>Side</aside>
<article><header><h1>Title &amp; more</h1></header><p>One   &lt;b&gt;<b> two</b>.<br>three<p>Four<div class="ad">Buy</div><form><input><p>Mail?</p></form>
<ul><li>x<li>y</ul><!-- c > d --><section class="comments"><p>First!</p></section></article><footer>&copy; me</footer></body></html>"""


def test_extract_leaves_out_what_is_not_the_article(spark):
    pages = [(1, "http://h.com/1", PAGE), (2, "http://h.com/2", PAGE.replace("Four", "Five &amp").replace("</footer></body></html>", "")), (3, "http://h.com/3", None), (4, None, "<p>a</p><p>b &#x41;&nbsp;&eacute"), (5, "http://h.com/5", ""), (None, "http://e.com/", "<article>cut <p>of"), (1, "http://h.com/1", PAGE)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'z' host", "'t' text", "1 main")
    out = html.extract(df).collect()
    assert Counter((r.page_id, r.text) for r in out) == Counter({(1, "Title & more One <b> two. three Four x y"): 2, (2, "Title & more One <b> two. three Five & x y"): 1, (3, ""): 1, (4, "a b A é"): 1, (5, ""): 1, (None, "cut of"): 1})
    assert all(r.n_chars == len(r.text) for r in out)
    assert html.extract(df.limit(0)).collect() == []


def test_without_an_article_density_and_variety_decide(spark):
    page = lambda i: f'<body><div id="x"><a href=1>l{i}</a> <a href=2>m{i}</a></div><div><p>Same words here</p></div><div class=story><p>Story {i} is told at length</p><p>and {i} goes on</p></div></body>'
    df = spark.createDataFrame([(i, f"http://h.net/{i}", page(i)) for i in range(6)], "page_id long, url string, html string")
    assert all(r.text in (f"Story {r.page_id} is told at length and {r.page_id} goes on", f"Same words here Story {r.page_id} is told at length and {r.page_id} goes on") for r in html.extract(df).collect())


def test_wrappers_have_optional_and_repeated_groups():
    trees = [html.folded(html.blocks(p)[0]) for p in ("<article><h1>a</h1><p>b<p>c<p>d</article>", "<article><h1>a</h1><div>x</div><p>b</article>", "<article><h2>a</h2><p>b</p><h2>c</h2><p>d</p></article>")]
    assert html.expression(trees[0]) == "(article(h1(#) p(#)+))"
    assert html.expression(html.merged(trees[0], trees[1])) == "(article(h1(#) div(#)? p(#)+))"
    assert html.expression(trees[2]) == "(article(h2(#)+ p(#)+))"


def test_deep_and_wide_pages(spark):
    mixed = lambda seed, n: "".join(f"<{k}>{i}</{k}>" for i, k in enumerate(np.random.default_rng(seed).choice(["p", "h2", "pre", "ul", "section"], n)))
    wide = {i: f"<body><nav>Menu</nav><article>{mixed(i, 300 + 40 * i)}</article></body>" for i in range(9)}
    tags = "".join(f"<x-{i}>{i}</x-{i}>" for i in range(400))
    odd = {20: "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p></article>", 21: "<article>" + "<ul><li>x" * 900, 22: f"<article>{tags}</article>", 23: f"<article><p>one</p>{tags}</article>", 24: "<article>" + "<" * 50_000}
    want = {i: " ".join(map(str, range(300 + 40 * i))) for i in wide} | {20: "deep after", 21: "x " * 899 + "x", 22: " ".join(map(str, range(400))), 23: "one " + " ".join(map(str, range(400))), 24: "<" * 50_000}
    df = spark.createDataFrame([(i, "http://h.com/", h) for i, h in (wide | odd).items()], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want


@pytest.mark.parametrize("share", [2, 5, 256])
def test_wrappers_by_shares_keep_all_slots(spark, share):
    page = lambda i: "<article>" + "".join(f"<{t}>x</{t}>" for k, t in enumerate(["h1", "p", "pre", "section", "h2"]) if i >> k & 1) + "</article>"
    rows = [(i, f"http://{'hot' if i % 32 else 'cold'}.com/", page(i)) for i in range(64)]
    pages = html.keep(html.parsed(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html"), "pages")
    out = html.wrappers(html.shapes(html.lookup(pages, html.keep(html.constants(pages), "constants"), "host")), share).collect()
    assert sorted(r.host for r in out) == ["cold.com", "hot.com"]
    (article,) = json.loads({r.host: r.wrapper for r in out}["hot.com"])[1]
    assert article[0] in ("article", "article#") or {c[0].split("#")[0] for c in article[1]} == {"h1", "p", "pre", "section", "h2"}


def test_extract_matches_the_articles(spark, sf):
    import html as entities
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


# -- vectors -----------------------------------------------------------------------


def brute_vectors(rows, least=0.9):
    good = {i: np.array(v, dtype=np.float64) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = {i: [j for j in good if j != i and len(good[j]) == len(good[i]) and good[i] @ good[j] >= least * np.linalg.norm(good[i]) * np.linalg.norm(good[j])] for i in good}
    label = {i: i for i in good}
    changed = True
    while changed:
        changed = False
        for i in good:
            for j in near[i]:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
    first = {}
    for i in good:
        if rows[i][0] is not None:
            first[label[i]] = min(first.get(label[i], rows[i][0]), rows[i][0])
    return Counter((ident, len(near[i]), first.get(label[i])) if i in good else (ident, 0, ident) for i, (ident, _) in enumerate(rows))


@pytest.mark.parametrize("block", [7, 2048])
def test_pivots_hard_rows(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * 0.05).tolist()) for i in range(120)]
    rows += [(200, base[0].tolist()), (201, base[0].tolist()), (201, base[0].tolist()), (None, base[1].tolist()), (300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None, *[1.0] * 15]), (304, []), (305, [float("inf"), *[1.0] * 15]), (306, [1.0, 2.0]), (307, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 node", "2L links", "3 copies", "'v' vector")
    out = pivots.near_duplicates(df, pivots=40, near=8, shared=2, block=block).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in out) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)
    assert pivots.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("noise", [0.05, 0.1, 0.2, 0.3])
def test_pivots_recall(spark, noise):
    """Recall of links against brute force, down to pairs near the threshold."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 64))
    x = np.concatenate([base + rng.normal(size=base.shape) * noise * np.sqrt(2) for _ in range(8)] + [rng.normal(size=(800, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = pivots.near_duplicates(df).collect()
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = (y @ y.T >= 0.9).sum(axis=1) - 1
    found = np.zeros(len(x), dtype=int)
    for r in out:
        found[r.vec_id] = r.n_links
    assert (found <= links).all()
    print(f"noise {noise}: {found.sum()} of {links.sum()} links")
    assert links.sum() == 0 or found.sum() >= 0.9 * links.sum()


def test_pivots_recall_in_a_hot_group(spark):
    """A third of all vectors are near-copies of one: pivots from among them must not
    make their orders arbitrary."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=64) + rng.normal(size=(500, 64)) * 0.2, rng.normal(size=(1000, 64))]).astype(np.float32)
    out = pivots.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = (y @ y.T >= 0.9).sum() - len(x)
    assert sum(r.n_links for r in out) >= 0.99 * links > 0
