"""How the words of each source differ from those of the others and of its language.

Counts of a term over the sources of its language are a sparse vector. Terms of equal
vectors give equal values for every pair of sources, so a pair is worked out once for
each distinct vector and counts as often as there are such terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, slices

#: Letters, and all that is not ASCII: the bytes of UTF-8 from 0x80 on.
WORD = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Terms that a task counts before it passes them on.
HELD = 200_000
#: Bytes from which words are counted as they are found, not listed before.
LONG = 1 << 20
#: Documents of its language in which a term must be.
LEAST = 10
SCALE = 1_000_000_000


Held = dict[tuple[str, str], dict[bytes, list[int]]]


def _counted(held: Held) -> Iterator[pa.RecordBatch]:
    for (lang, source), terms in held.items():
        n, docs = zip(*terms.values(), strict=True)
        k = len(terms)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * k, "source": [source] * k, "term": pa.array(terms, pa.binary()), "n": pa.array(n, pa.int64()), "docs": pa.array(docs, pa.int64())})


def _tally(most: int, long: int):
    """(lang, source, term, n, docs): occurrences, and documents, as far as one task sees."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Held = {}
        size = 0
        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                low = text.lower()  # of bytes: A to Z only
                found = Counter(WORD.findall(low) if len(low) < long else (m.group() for m in WORD.finditer(low)))
                if not found:
                    continue
                terms = held.setdefault((lang, source), {})
                size -= len(terms)
                for term, n in found.items():
                    if (cell := terms.get(term)) is None:
                        terms[term] = [n, 1]
                    else:
                        cell[0] += n
                        cell[1] += 1
                size += len(terms)
                if size > most:
                    yield from _counted(held)
                    held, size = {}, 0
        yield from _counted(held)

    return work


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(`SCALE` (count + 2) / (total + 2 terms)), exactly."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return 1 + F.call_function("div", wide, (total + 2 * terms).cast("decimal(20,0)"))


def _parted(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of shares; they are at most `SCALE` + 1, so longs hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def counts(docs: DataFrame, least: int = LEAST, held: int = HELD, long: int = LONG) -> DataFrame:
    """(lang, source, term, n, total, once): occurrences of each term that is in `least`
    documents of its language or more, there and in the language; `once` marks one row of
    each term. Tasks count what they read, so a source with most rows sends no more than
    its terms; parts of one term meet in one group, one row for each source and task."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    parts = rows.mapInArrow(_tally(held, long), "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))
    summed = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    wide = summed.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("total"), (F.min("source").over(of_term) == F.col("source")).alias("once"))
    return wide.where(F.col("docs") >= least).drop("docs")


def shares(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """(lang, source, size, all_size, terms, base): for every group that occurs, its
    occurrences of kept terms, those of its language, how many terms are kept there, and
    the share of a term that it has not."""
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sizes = counted.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = counted.groupBy("lang").agg(F.sum("n").alias("all_size"), F.sum(F.col("once").cast("long")).alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    met = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("size"), zero("all_size"), zero("terms"))
    base = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("size"), F.col("terms"))).otherwise(1)
    return met.withColumn("base", base.cast("long"))


def pair_values(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for every two sources a < b of a language.

    With f of a term that neither has as the start, each distinct vector adds what it
    changes for every source it holds (whatever the other one is; alike counts at once)
    and what two of its sources change together beyond that. So no source meets the terms
    that it has not, and sums are exact integers throughout."""
    known = counted.join(groups.select("lang", "source", "size", "terms", "base"), ["lang", "source"])
    known = known.select("lang", "source", "term", "n", _share(F.col("n"), F.col("size"), F.col("terms")).cast("long").alias("p"), "base")
    vectors = known.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n", "p", "base"))).alias("vector"))
    vectors = vectors.groupBy("lang", "vector").agg(F.count("*").alias("times"))

    each = vectors.select("lang", "times", "vector", F.posexplode("vector").alias("i", "x"))
    both = each.select("lang", "times", "x", F.explode(F.slice("vector", F.col("i") + 2, F.size("vector"))).alias("y"))
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    beyond = _parted(x("p"), y("p")) - _parted(x("p"), y("base")) - _parted(x("base"), y("p")) + _parted(x("base"), y("base"))
    both = both.select("lang", x("source").alias("a"), y("source").alias("b"), (F.col("times") * beyond).alias("value"))

    alike = known.groupBy("lang", "source", "p", "base").agg(F.count("*").alias("times"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("base").alias("other_base"), "terms")
    alone = alike.join(others, "lang").where("source <> other")
    changed = _parted(F.col("p"), F.col("other_base")) - _parted(F.col("base"), F.col("other_base"))
    alone = alone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("times") * changed).alias("value"))

    start = groups.select("lang", "source", "base").join(others, "lang").where("source < other")
    start = start.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), (F.col("terms") * _parted(F.col("base"), F.col("other_base"))).alias("value"))
    # Each is summed before they meet: one row for a pair and task.
    summed = [part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for part in (both, alone)]
    return start.unionByName(summed[0]).unionByName(summed[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, top: int = 10, least: int = LEAST) -> DataFrame:
    """(lang, source, part, item, value, rank) of `docs` (text, lang, source; null is empty).

    Part `pair`: every other source of the language by how far it is from this one; part
    `term`: the `top` terms that are commoner here than in the language. Values fall with
    rank; ties go by the bytes of the item. Repeated rows are documents of their own; a
    language of no kept term has pairs of value 0; an empty table has no rows; further
    columns are left out. Pairs are the result, so it grows with their number.
    """
    counted = keep(counts(docs, least), "counts")
    groups = keep(shares(docs, counted), "shares")
    pairs = keep(pair_values(counted, groups), "pairs")
    ways = [pairs.select("lang", F.col(s).alias("source"), F.lit("pair").alias("part"), F.col(t).alias("item"), "value") for s, t in (("a", "b"), ("b", "a"))]
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = ways[0].unionByName(ways[1]).withColumn("rank", F.row_number().over(by_value))

    known = counted.join(groups, ["lang", "source"])
    p, q = _share(F.col("n"), F.col("size"), F.col("terms")), _share(F.col("total"), F.col("all_size"), F.col("terms"))
    terms = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.cast("long").alias("p"), q.cast("long").alias("q")).where("p > q")
    terms = terms.select("lang", "source", "part", "item", _parted(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return ranked.unionByName(terms)
