"""Toxic passages: maximum-scoring segments of token log-odds.

Tokens get log-odds under an informative Dirichlet prior; a linear-time scan finds
all maximal segments of a text; their scores become significances by extreme-value
(Karlin-Altschul) statistics, and a logistic curve on those gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import keep, slices

TOKEN = re.compile(r"[^\W\d_]+")
#: Labelled rows to learn from, at most (those of smallest hash).
SAMPLE = 20_000
#: Standard errors a token's log-odds must clear: the calibration picks one of these.
SURE = (2.5, 3.0, 3.5, 4.0, 5.0)
#: Weight of the prior: so many occurrences, or so much of all if that is less.
PRIOR, PART = 10_000.0, 0.08
#: Least weight of a toxic token, and letters of the beginnings that stand for unseen words.
STRONG, STEMS = 2.0, (4, 5, 6)
#: Words of which a worker remembers the weight, at most.
CACHE = 300_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def forms(word: str) -> list[str]:
    """A word, and beginnings of it, which inflected words share."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in order.

    `places` and `scores` are the tokens of positive weight; each token between
    weighs `drift` < 0. One pass with a stack of candidates: of a candidate, the
    cumulative score before it and after it.
    """
    found: list[list] = []  # [first, last, before, after, the nearest candidate of smaller before]
    total, at = 0.0, 0
    for place, score in zip(places, scores):
        before = total + drift * (place - at)
        total, at = before + score, place + 1
        new = [place, place, before, total, -1]
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= new[2]:
                k = found[k][4]  # all between have no smaller one
            if k < 0 or found[k][3] >= new[3]:
                new[4] = k
                break
            new[0], new[2] = found[k][0], found[k][2]
            del found[k:]
        found.append(new)
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass(frozen=True)
class Model:
    """Weights of toxic tokens, drift of all others, extreme-value rate and scale,
    and the logistic curve: bias, slope of the best passage's significance, slope of all."""

    weights: dict[str, float]
    drift: float
    rate: float
    scale: float
    curve: tuple[float, float, float]

    def __post_init__(self) -> None:
        object.__setattr__(self, "_known", {})

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _known={})

    def weight(self, word: str) -> float:
        """The largest weight among a word's forms; 0 for a word like any other."""
        known = self._known
        if len(known) > CACHE:
            known.clear()
        known[word] = w = max((self.weights.get(f, 0.0) for f in forms(word)), default=0.0)
        return w

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and all maximal segments. A word's n-th occurrence weighs
        an n-th, so that a repeated line counts little more than the line."""
        words, known, weight = tokens(text), self._known, self.weight
        hits = [(i, w, x) for i, w in enumerate(words) if (x := known[w] if w in known else weight(w))]
        seen: Counter = Counter()
        places, scores = [], []
        for i, w, x in hits:
            seen[w] += 1
            places.append(i)
            scores.append(x / seen[w])
        return len(words), segments(places, scores, self.drift)

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Tokens of the text, and every significant passage (first, last, significance)."""
        n, found = self.scan(text)
        if not found:
            return n, []
        noise = float(np.log(self.scale * n))
        return n, [(a, b, x) for a, b, s in found if (x := self.rate * s - noise) > 0]

    def features(self, text: str | None) -> tuple[float, float]:
        _, found = self.passages(text)
        return (max(x for _, _, x in found), float(np.log1p(sum(x for _, _, x in found)))) if found else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        return self.of(*self.features(text))

    def of(self, best: float, all_: float) -> float:
        z = self.curve[0] + self.curve[1] * best + self.curve[2] * all_
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fold(ident: str) -> F.Column:
    """crc32 of the ident as text, modulo 5; null for a null ident."""
    return F.pmod(F.crc32(F.col(ident).cast("string")), F.lit(5))


def sample_labels(labels: DataFrame, ident: str, label: str, most: int) -> DataFrame:
    """(ident, label, check) of at most `most` labelled rows outside fold 0."""
    known = labels.where(F.col(ident).isNotNull() & F.col(label).isin(0, 1) & (fold(ident) != 0)).groupBy(ident).agg(F.max(label).alias("label"))
    h = F.xxhash64(F.lit("sample"), ident)
    return known.withColumn("h", h).orderBy("h", ident).limit(most).select(ident, "label", (F.pmod("h", F.lit(4)) == 0).alias("check"))


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows, none of them of fold 0.

    Three quarters give token counts, one quarter the calibration. A document that
    labels call both toxic and clean counts as toxic; null labels and those of no
    document count for nothing; a document's repeated rows each count. Without labels
    of both kinds every text scores as the share of toxic labels (0 without labels).
    """
    chosen = keep(sample_labels(labels, ident, label, sample), "labels")
    # At most `sample` rows of three narrow columns.
    known = keep(docs.select(ident, text).join(F.broadcast(chosen), ident).select(text, "label", "check"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            both = Counter(), Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                both[y].update({f for w in set(tokens(t)) for f in forms(w)})  # once for each text
            words = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([both[1][w] for w in words], pa.int64()), pa.array([both[0][w] for w in words], pa.int64())], names=["token", "bad", "good"])

    counts = known.where("not check").select(text, F.col("label").cast("int")).mapInArrow(count, "token string, bad long, good long")
    counts = keep(counts.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "tokens")
    total = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    bad, good = total["bad"] or 0, total["good"] or 0
    if not bad or not good:
        share = chosen.agg(F.avg("label").alias("p")).first()["p"] or 0.0
        return Model({}, -0.02, 1.0, 1.0, (float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), 0.0, 0.0))
    weight = min(PRIOR, PART * (bad + good))
    prior = F.lit(weight) * (F.col("bad") + F.col("good")) / F.lit(float(bad + good))
    odds = lambda n, of: F.log((n + prior) / (F.lit(of + weight) - n - prior))
    delta = odds(F.col("bad"), bad) - odds(F.col("good"), good)
    error = F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior))
    sure = counts.withColumns({"delta": delta, "error": error}).where((F.col("delta") > SURE[0] * F.col("error")) & (F.col("delta") - F.col("error") > STRONG))
    rows = sure.orderBy(F.desc(F.col("delta") / F.col("error")), "token").collect()  # tokens of at most `sample` texts
    drafts = [_draft([r for r in rows if r["delta"] > z * r["error"]], bad, good, weight) for z in SURE]
    held = known.where("check").select(text, F.col("label").cast("int").alias("label"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(k, *d.scan(t)) for t in b.column(0).to_pylist() for k, d in enumerate(drafts)]
            best = [max((s for _, _, s in f), default=0.0) for _, _, f in found]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array(best, pa.float64())], names=["k", "n", "best"])

    rates = F.element_at(F.array(*[F.lit(d.rate) for d in drafts]), F.col("k") + 1)
    noise = held.where("label = 0").mapInArrow(measure, "k int, n long, best double").groupBy("k").agg(F.count("*").alias("rows"), F.sum(F.col("n") * F.exp(-rates * F.col("best"))).alias("noise"))
    for r in noise.collect():
        drafts[r["k"]] = replace(drafts[r["k"]], scale=r["rows"] / max(r["noise"], 1.0))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [(k, y, *d.features(t)) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, d in enumerate(drafts)]
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            cols = list(zip(*x)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, kinds)], names=["k", "label", "best", "whole"])

    rows = held.mapInArrow(describe, "k int, label int, best double, whole double").groupBy("k", "label", F.round("best", 1).alias("best"), F.round("whole", 1).alias("whole")).count().orderBy("k", "label", "best", "whole").collect()  # of at most `sample` rows
    fitted = []
    for k, draft in enumerate(drafts):
        own = [r for r in rows if r["k"] == k]
        loss, curve = _logistic(np.array([[r["best"], r["whole"]] for r in own]), np.array([r["label"] for r in own]), np.array([r["count"] for r in own])) if own else (0.0, (-2.0, 1.0, 0.0))
        fitted.append((loss, k, replace(draft, curve=curve)))
    return min(fitted, key=lambda x: x[:2])[2]


def _draft(rows: list, bad: int, good: int, weight: float) -> Model:
    """A model of these tokens, not yet calibrated. Weights are lower bounds of the
    log-odds; the other tokens share what is left of either side."""
    weights = {r["token"]: float(r["delta"] - r["error"]) for r in rows}
    left = (bad - sum(r["bad"] for r in rows) + 1) / (bad + 1), (good - sum(r["good"] for r in rows) + 1) / (good + 1)
    drift = min(float(np.log(max(left[0], 1e-9) / max(left[1], 1e-9))), -0.01)
    p = [(weight * (r["bad"] + r["good"]) / (bad + good) + r["good"]) / (weight + good) for r in rows]
    return Model(weights, drift, _rate(p, list(weights.values()), drift), 1.0, (0.0, 1.0, 0.0))


def _rate(p: list[float], s: list[float], drift: float) -> float:
    """The positive root of sum p e^(rate s) = 1 over tokens of clean text."""
    p_, s_ = np.array([*p, max(0.0, 1 - sum(p))]), np.array([*s, drift])
    lo, hi = 1e-6, 1.0
    f = lambda r: float((p_ * np.exp(np.minimum(r * s_, 700))).sum() - 1)
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(lo, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, tuple[float, float, float]]:
    """Loss and curve of a weighted logistic regression with a small ridge, by Newton
    steps; slopes are not let below zero."""
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(3), np.array([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (n * (p - y)) + ridge * w
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9), g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    w[1:] = np.maximum(w[1:], 0)
    z = np.clip(a @ w, -30, 30)
    return float((n * (np.logaddexp(0, z) - y * z)).sum()), (float(w[0]), float(w[1]), float(w[2]))


def score(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text", passages: bool = False) -> DataFrame:
    """(ident, score) of every row, and with `passages` an array of the significant
    ones as (first, last, significance), in tokens.

    Null and empty texts have no tokens and get the curve's bias. Rows are scored
    alone, so repeated rows and ties score alike; further columns are ignored.
    """
    kind = docs.schema[ident].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # weights of tokens of the labelled sample
    more = ", passages array<struct<first:int,last:int,significance:double>>" if passages else ""
    struct = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("significance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches):
            found = [m.passages(t)[1] for t in b.column(1).to_pylist()]
            scores = [m.of(max((x for _, _, x in f), default=0.0), float(np.log1p(sum(x for _, _, x in f)))) for f in found]
            cols, names = [b.column(0), pa.array(scores, pa.float64())], [ident, "score"]
            if passages:
                cols.append(pa.array([[{"first": a, "last": z, "significance": x} for a, z, x in f] for f in found], pa.list_(struct)))
                names.append("passages")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, score double{more}")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of `docs` that score under `most`, with all their columns, whatever their
    names. Null and empty texts have no toxic passage and score the curve's bias;
    repeated rows and ties stay or go alike; an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches):
            yield b.filter(pa.array([m.score(t) < most for t in b.column(at).to_pylist()], pa.bool_()))

    # By place, for names may hold any characters.
    kinds = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    return docs.toDF(*kinds.names).mapInArrow(run, kinds).toDF(*names)
