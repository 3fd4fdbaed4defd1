"""Operator 7, toxicity by non-negative positive-unlabelled learning.

Labels that are read: confirmed toxic examples only (``toxic`` = 1), and only of training rows
(crc32 of the id as text, modulo 3, is not 1).  The unlabelled texts are those of the training rows
that ``labels`` names, toxic or not: the population of which the class prior, the share of toxic
rows among them (a corpus count, kept between 1 and 50 percent), is known.  A zero label is not used
as a negative.

Features are the distinct lower-cased words of the whole text and the words' first three to six
characters (stems, so unseen forms count), hashed to ``1 << BITS`` places.  Only places of at least
``SUPPORT`` toxic examples get a weight.  The linear classifier minimises the class-prior-corrected risk of Kiryo et al. (2017)

    prior * E_P[l(f, +1)] + max(0, E_U[l(f, -1)] - prior * E_P[l(f, -1)])

with the logistic loss, in full-batch proximal Adam steps (numpy).  When the corrected negative
risk falls below zero, its gradient is reversed, as the paper does.  An L1 step keeps the weights of
ordinary words at zero, so a long clean text doesn't add up to a score.

Bounds, as parameters: at most ``max_positive`` toxic examples and ``max_unlabelled`` other rows
are fitted on (the smallest hashes of their ids, so the choice is the same in every run); only their
hashed words come to the driver.  Every document is scored, by whole text, in Arrow batches with
the broadcast weights that are not zero.

Rows: null and empty texts have no words and get the score of the bias alone; repeated rows get a
row each; a null doc_id counts as held out false; extra columns are ignored.  Without a toxic
example nothing can be learned and every score is the prior; empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwise.llm.common import text_batches, text_of

BITS = 22
MAX_POSITIVE = 3000
MAX_UNLABELLED = 8000
STEPS = 150
SUPPORT = 3
STEMS = (3, 4, 5, 6)
#: Words whose places a task remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
RATE = 0.1
L1 = 3e-4
THRESHOLD = 0.7
# ASCII letters lowered; digits and everything above ASCII kept; all else is a break between words
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 97 <= i <= 122 or 48 <= i <= 57 else 32 for i in range(256))


def _words(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())


def _places(word: bytes, bits: int = BITS) -> list[int]:
    """Places of a word and of its stems."""
    whole = word.decode("utf-8", "surrogatepass")
    stems = [b"^" + whole[:k].encode("utf-8", "surrogatepass") for k in STEMS if len(whole) >= k]
    return [zlib.crc32(x) & ((1 << bits) - 1) for x in (word, *stems)]


def word_places(text: str, bits: int = BITS) -> np.ndarray:
    """Sorted distinct places of a text."""
    return np.array(sorted({p for w in _words(text) for p in _places(w, bits)}), np.int32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> tuple[dict[int, float], float]:
    """The weights by place that aren't zero, and the bias, that minimise the non-negative risk."""
    base = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return {}, base
    docs = positive + unlabelled
    n, p, u = len(docs), len(positive), len(unlabelled)
    flat, row = np.concatenate(docs), np.repeat(np.arange(n, dtype=np.int32), [len(d) for d in docs])
    used, support = np.unique(flat[row < p], return_counts=True)
    used = used[support >= SUPPORT]  # a word of one or two documents says nothing about others
    if not len(used):
        return {}, base
    col = np.minimum(np.searchsorted(used, flat), len(used) - 1).astype(np.int32)
    known = used[col] == flat
    col, row, flat = col[known], row[known], None
    is_p = np.arange(n) < p
    w, b = np.zeros(len(used)), base
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        f = b + np.bincount(row, w[col], n)
        s = 1 / (1 + np.exp(-np.clip(f, -60, 60)))
        negative = np.logaddexp(0, f)
        corrected = negative[~is_p].sum() / u - prior * negative[is_p].mean()
        down = np.where(is_p, -prior / p * s, s / u)  # gradient of the corrected negative risk
        g = down + np.where(is_p, prior / p * (s - 1), 0.0) if corrected >= 0 else -down
        gw, gb = np.bincount(col, g[row], len(used)), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = RATE / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w = w - scale * m / (1 - 0.9 ** t)
        w = np.sign(w) * np.maximum(0, np.abs(w) - scale * L1)
        b -= RATE * mb / (1 - 0.9 ** t) / (np.sqrt(vb / (1 - 0.999 ** t)) + 1e-8)
    at = np.flatnonzero(w)
    return dict(zip(used[at].tolist(), w[at].tolist())), float(b)


def _sample(rows: DataFrame, n: int) -> list[np.ndarray]:
    """Hashed words of the n rows whose ids have the smallest hashes."""
    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"places": [word_places(t).astype("<i4").tobytes() for t in b["t"]]})

    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select(text_of().alias("t"))
    return [np.frombuffer(r["places"], "<i4") for r in picked.mapInPandas(places, "places binary").toLocalIterator()]


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED) -> tuple[dict[int, float], float]:
    """Weights and bias learned from the training rows."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")) \
        .where("toxic IS NOT NULL")
    totals = known.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("toxic") == 1, 1)).alias("p")).first()
    prior = min(0.5, max(0.01, totals["p"] / totals["n"] if totals["n"] else 0.01))

    def picked(ids: DataFrame, n: int) -> list[np.ndarray]:
        few = ids.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)  # n ids at most: small enough to broadcast
        return _sample(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id", "left_semi"), n)

    return fit(picked(known.where("toxic = 1"), max_positive), picked(known, max_unlabelled), prior)


def score(docs: DataFrame, weights: dict[int, float], bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast((weights, bias))

    def scores(texts: pd.Series) -> pd.Series:
        w, b = shared.value
        telling: dict[bytes, list[int]] = {}  # a word's places that have a weight, mostly none
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            words, places = _words(t), set()
            for x in words:
                if (at := telling.get(x)) is None:
                    if len(telling) >= REMEMBERED:
                        telling.clear()
                    at = telling[x] = [p for p in _places(x) if p in w]
                if at:
                    places.update(at)
            out[i] = 1 / (1 + np.exp(-np.clip(b + sum(w[p] for p in sorted(places)), -60, 60)))
        return pd.Series(out)

    value = F.pandas_udf(scores, "double")(text_of())
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    return score(docs, *train(docs, labels, **bounds))
