import random
import re
from collections import Counter

import pytest

from tessera.llm import divergence
from tests.llm.helpers import docs, hard_rows


def brute(rows, top=10, least=10):
    """By plain loops: every pair over every kept term."""
    used, present, groups = Counter(), Counter(), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
        for term, n in found.items():
            used[lang, source, term] += n
            present[lang, term] += 1
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted((s for g, s in groups if g == lang), key=lambda s: s.encode())
        kept = [t for (g, t), n in present.items() if g == lang and n >= least]
        total = sum(used[lang, s, t] for s in sources for t in kept)
        share = lambda n, size: 1 + 1_000_000_000 * (n + 2) // (size + 2 * len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: {t: share(used[lang, s, t], sum(used[lang, s, u] for u in kept)) for t in kept} for s in sources}
        q = {t: share(sum(used[lang, s, t] for s in sources), total) for t in kept}
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if used[lang, s, t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "été", "日本", "\U0001d49c", "ﬀ", "UPPER", "upper"]
    rows = []
    for i in range(n):
        source = rng.choice(["s0"] * 9 + ["s1", "s2", "", None, "ö", "z"])
        words = rng.choices(vocabulary, [1 + (k * 7 + len(str(source))) % 11 for k in range(len(vocabulary))], k=rng.randrange(40))
        rows.append((i, rng.choice([" ", "-", "9", "_"]).join(words) if i % 17 else None, rng.choice(["en", "en", "de", None]), source, 0))
    return rows


@pytest.mark.parametrize("least", [1, 3, 10])
def test_audit_equals_plain_loops(spark, least):
    rows = made(400, least)
    df = docs(spark, rows, clash=True).selectExpr("*", "1 AS term", "2 AS n", "3 AS total", "4 AS base", "5 AS value", "6 AS rank")
    assert sorted(tuple(r) for r in divergence.audit(df, least=least).collect()) == brute(rows, least=least)


def test_hard_rows(spark):
    rows = hard_rows()
    assert sorted(tuple(r) for r in divergence.audit(docs(spark, rows), least=1).collect()) == brute(rows, least=1)
    none = sorted(tuple(r) for r in divergence.audit(docs(spark, rows), least=50).collect())
    assert none == brute(rows, least=50) and none and all(r[2] == "pair" and r[4] == 0 for r in none)
    assert divergence.audit(docs(spark, [])).collect() == []


def test_tasks_that_pass_counts_on_early_and_dealing(spark):
    rows = made(300, 4)
    want = brute(rows, least=2)
    for parts in (1, 5):
        assert sorted(tuple(r) for r in divergence.audit(docs(spark, rows).repartition(parts), least=2).collect()) == want
    whole = sorted(tuple(r) for r in divergence.counts(docs(spark, rows), 2).collect())
    assert sorted(tuple(r) for r in divergence.counts(docs(spark, rows), 2, held=3, long=50).collect()) == whole


def test_counts_beyond_a_long_times_the_scale(spark):
    big = 5 * 10**11
    row = spark.createDataFrame([(big, 3 * big, 7)], "n long, size long, terms long")
    got = row.select(divergence._share(row.n, row.size, row.terms).cast("long")).first()[0]
    assert got == 1 + 10**9 * (big + 2) // (3 * big + 14)


def test_terms_of_equal_vectors_are_one_row(spark):
    rows = [(i, "aa bb cc" + (" dd" if i % 2 else ""), "en", f"s{i % 2}", 0) for i in range(40)]
    counted = divergence.counts(docs(spark, rows))
    groups = divergence.shares(docs(spark, rows), counted)
    plan = divergence.pair_values(counted, groups)
    assert plan.count() == 1 and counted.count() == 7 and counted.where("once").count() == 4
