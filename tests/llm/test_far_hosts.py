import pytest

from tessera.llm import urls
from tessera.llm.queries import RULES


def test_distrust_reaches_hosts_over_twenty_links_away(spark):
    pages = [(i, f"http://h{i}.net/", f'<a href="http://h{i - 1}.net/">x</a>') for i in range(1, 26)] + [(0, "http://h0.net/", '<a href="http://bad.com/de/1">x</a>'), (99, "http://bad.com/de/1", None)]
    out = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()
    assert all(r.verdict == "block" and r.distrust > 0 for r in out)


def test_page_rank_raises_unless_settled(spark):
    seeds = spark.createDataFrame([("a", 1.0)], "host string, share double")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    with pytest.raises(RuntimeError):
        urls.page_rank(seeds, edges, rounds=3)
