r"""Operator 3, quality rules with cross-document line frequency.

Per row (one pass over the whole text in Arrow batches): words, their characters, symbols, repeated
lines, and words inside 8-word windows that occur twice or more.  Windows are compared by exact
ranks (1, 2, 4, 8 words, each rank a pair of ranks of half the length), not by hashes.

Line frequency: every \n-split line that has a word is normalised (words joined by one space, A-Z
lowered) and named by two independent hashes.  For each host (``source``) and line the distinct
documents are counted; exact copies of a text count as one document, since copies are the business
of deduplication.  A line is above the limit when it stands in more than ``max_docs`` documents of
the host, however large the host is.  Hosts with few documents have a lower limit, the share ``small_share``
of their documents, though never below ``min_docs``.  Such lines are template text and are
removed from every document but the one with the smallest id, so what they say stays in the corpus
once.  A document is depleted, and rejected, when removal leaves fewer than ``min_left`` of its
words (a share) or fewer than ``min_words``.

Scale: a hot host or line is reduced by partial aggregates (first to distinct documents, then to
counts); only hashes and counts are shuffled, never texts.  The join of lines with the frequent
ones is an equi-join whose hot keys AQE splits.

Rows: null text has no words (and fails the base rule); a null source is a host of its own;
repeated rows get a row each and count as one document; a null doc_id stays null (and is the
smallest id only when a line has no other); extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwise.llm.common import ascii_lower, beside, stored, text_batches, text_keys, text_of, unpacked

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_DOCS = 20
SMALL_SHARE = 0.2
MIN_DOCS = 5
MIN_LEFT = 0.5
SYMBOLS = re.compile(rb"[#*$%&|<>]")
SPACE = r"[\x20\x09-\x0D]+"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words covered by windows of ``size`` (a power of two) words that occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    rank = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    step = 1
    while step < size:
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        step *= 2
    often = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def row_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = sum(len(w.decode("utf-8", "surrogatepass")) for w in words) if len(raw) != len(text) else sum(map(len, words))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.split():
            seen.add(line)
    return len(words), chars, len(SYMBOLS.findall(raw)), dup, repeated_words(words)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count_rows(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([row_counts(t) for t in texts], columns=COUNTS, dtype="int64")


def _line_words(line: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(line), SPACE, -1), "")


def facts(docs: DataFrame) -> DataFrame:
    """Per row: keys, counts and the lines as (lh, lm, n) structs; no text.  Stored once."""
    lines = F.transform(F.split("t", "\n", -1), _line_words)
    named = F.transform(F.filter(lines, lambda w: F.size(w) > 0), lambda w: F.struct(
        F.xxhash64(F.concat_ws(" ", w)).alias("lh"), F.hash(F.concat_ws(" ", w)).alias("lm"), F.size(w).alias("n")))
    text_batches(docs.sparkSession)
    counts = F.pandas_udf(_count_rows, ", ".join(f"{c} long" for c in COUNTS))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("host"), text_of().alias("t"))
    return stored(rows.select("doc_id", "host", *text_keys(F.col("t")), counts("t").alias("c"), named.alias("lines"))
                  .select("doc_id", "host", "th", "tm", "c.*", "lines").withColumn("row", F.monotonically_increasing_id()), "line-facts")


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS, small_share: float = SMALL_SHARE, min_docs: int = MIN_DOCS) -> DataFrame:
    """(host, lh, lm, first): lines above the host's limit and the smallest id of a document that has them."""
    seen = rows.select("host", "th", "tm", "doc_id", F.explode("lines").alias("l")) \
        .groupBy("host", "l.lh", "l.lm", "th", "tm").agg(F.min("doc_id").alias("first"))
    lines = seen.groupBy("host", "lh", "lm").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).where(F.col("n") > min_docs)
    hosts = rows.groupBy("host", "th", "tm").agg(F.lit(1).alias("one")).groupBy(F.col("host").alias("_h")).agg(F.count(F.lit(1)).alias("all"))
    limit = F.least(F.lit(float(max_docs)), F.greatest(F.lit(float(min_docs)), small_share * F.col("all")))
    return lines.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).where(F.col("n") > limit) \
        .select(F.col("host").alias("_h"), F.col("lh").alias("_lh"), F.col("lm").alias("_lm"), "first")


def judged(rows: DataFrame, max_docs: int = MAX_DOCS, small_share: float = SMALL_SHARE, min_docs: int = MIN_DOCS,
           min_left: float = MIN_LEFT, min_words: int = MIN_WORDS) -> DataFrame:
    """``rows`` with n_removed (words in removed lines), removed (their line keys), base_failed and kept."""
    often = frequent_lines(rows, max_docs, small_share, min_docs)
    gone = rows.select("row", "host", "doc_id", F.explode("lines").alias("l")) \
        .join(often, F.col("host").eqNullSafe(F.col("_h")) & (F.col("l.lh") == F.col("_lh")) & (F.col("l.lm") == F.col("_lm"))) \
        .where(~F.col("doc_id").eqNullSafe(F.col("first"))) \
        .groupBy("row").agg(F.sum("l.n").alias("n_removed"), F.collect_set(F.struct("l.lh", "l.lm")).alias("removed"))
    left = F.col("n_words") - F.col("n_removed")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.drop("lines").join(gone, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long")) \
        .withColumn("base_failed", failed) \
        .withColumn("kept", ~failed & ((F.col("n_removed") == 0) | ((left >= min_left * F.col("n_words")) & (left >= min_words))))


def line_quality(docs: DataFrame, **limits) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, base_failed, kept, n_removed."""
    return judged(facts(docs), **limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                "base_failed", "kept", "n_removed")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The kept documents with all their columns, without the lines above the limits.

    Verdicts are joined by id and content, so rows with equal ids and different texts stay apart.
    ``n_chars``, where there is one, is counted anew for texts that lost lines."""
    ok = judged(facts(docs), **limits).where("kept").select("doc_id", "th", "tm", "host", "removed").dropDuplicates(["doc_id", "th", "tm", "host"])
    rows = beside(docs, ok, "inner").where(F.col("doc").getField("source").cast("string").eqNullSafe(F.col("host")))
    norm = lambda line: F.concat_ws(" ", _line_words(line))
    stays = F.filter(F.split(F.col("doc").getField("text"), "\n", -1), lambda x: ~F.array_contains(
        F.col("removed"), F.struct(F.xxhash64(norm(x)).alias("lh"), F.hash(norm(x)).alias("lm"))))
    return rows.select(*unpacked(docs, F.array_join(stays, "\n"), F.col("removed").isNotNull()))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM g
        JOIN (SELECT doc_id, win FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, win)) GROUP BY doc_id),
ln AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, host, t, line, list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw FROM ln),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw WHERE len(lw) > 0 GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY host),
often AS (SELECT l.host, lw, min(doc_id) AS first FROM lw l JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host WHERE len(lw) > 0
          GROUP BY l.host, lw, h.n HAVING count(DISTINCT t) > least(20.0, greatest(5.0, CAST(0.2 AS DOUBLE) * h.n))),
gone AS (SELECT doc_id, sum(len(lw.lw)) AS n FROM lw JOIN often o ON lw.host IS NOT DISTINCT FROM o.host AND lw.lw = o.lw WHERE doc_id <> first GROUP BY doc_id),
r AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed
      FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN gone ON w.doc_id = gone.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (n_removed = 0 OR (n_words - n_removed >= 0.5 * n_words AND n_words - n_removed >= 20)) AS kept
FROM r
"""
