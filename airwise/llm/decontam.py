"""Operator 10, benchmark decontamination: a broadcast hash set of the test set's word n-grams.

Every run of ``size`` consecutive words of a benchmark item is a window (an item of fewer words,
but not none, is one window).  A document's word array is exploded into window starts; a window's hash is
computed and probed against the hash set inside one generated stage, and a hit is verified by
comparing the words themselves, so a hash collision can't mark anything.  Hits are stored once;
nothing else is shuffled but counts.

The hash set is broadcast in blocks: windows are counted first, and when there are more than
``block`` of them they are dealt into as many blocks as needed by their hash, each joined with
all documents.  A block is thus of bounded size, and no window is left out.

Rows: null text has no words.  Repeated rows each give a row.  An empty benchmark marks nothing,
an empty corpus gives an empty result, and extra columns are ignored.  A null ``item_id`` counts
as an item whose id is the empty string.  A null ``doc_id`` is kept as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwise.llm.common import beside, stored, text_keys, text_of, unpacked, word_array

WINDOW = 10
#: Windows in one broadcast block: with their words about 150 bytes each, so at most some 75 MB.
BLOCK = 500_000


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, len, h, win): every window of every item, once per item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             word_array(text_of()).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    wins = items.select("item", n.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"), "w") \
        .select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("a"))
    h = F.lit(None).cast("long")
    for k in range(1, size + 1):
        h = F.when(F.col("len") == k, F.xxhash64(*[F.get("a", F.lit(j)) for j in range(k)])).otherwise(h)
    return wins.select("item", "len", h.alias("h"), F.concat_ws(" ", "a").alias("win")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, tm, s, e, h, len): verified occurrences of windows, words [s, e) of the text."""
    words = docs.select("doc_id", text_of().alias("t")).select("doc_id", *text_keys(F.col("t")), word_array(F.col("t")).alias("w"))
    wins = benchmark_windows(benchmark, size).groupBy("len", "h", "win").agg(F.lit(1).alias("one"))
    counts = {r["len"]: r["n"] for r in wins.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    out = None
    for n, total in sorted(counts.items()):
        # one row per window start; its hash is computed in generated code from the words of the row
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n))
        at = words.select("*", F.explode_outer(starts).alias("s")) \
            .withColumn("h", F.xxhash64(*[F.get("w", F.col("s") + k) for k in range(n)]))
        blocks = -(-total // block)
        for b in range(blocks):
            part = wins.where((F.col("len") == n) & (F.pmod(F.col("h"), F.lit(blocks)) == b)).select(F.col("h"), "win")
            found = at.join(F.broadcast(part), "h") \
                .where(F.col("s").isNotNull() & (F.concat_ws(" ", F.slice("w", F.col("s") + 1, F.lit(n))) == F.col("win"))) \
                .select("doc_id", "th", "tm", "s", (F.col("s") + n).alias("e"), "h", F.lit(n).alias("len"), "win")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = words.where(F.lit(False)).select("doc_id", "th", "tm", F.lit(0).alias("s"), F.lit(0).alias("e"),
                                               F.lit(0).cast("long").alias("h"), F.lit(0).alias("len"), F.lit("").alias("win"))
    return out


def covered(spans: Column) -> Column:
    """Words covered by sorted (s, e) spans, overlaps counted once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).cast("long").alias("n"),
        F.greatest(a["to"], x["e"].cast("long")).alias("to"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def _by_content(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the row's content keys; a null id meets a null id."""
    r = right.withColumnsRenamed({"doc_id": "_d", "th": "_th", "tm": "_tm"})
    return left.join(r, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_th")) & (F.col("tm") == F.col("_tm")), "left") \
        .drop("_d", "_th", "_tm")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    spans (word intervals [s, e) of all hits)."""
    found = stored(hits(docs, benchmark, size, block), "benchmark-hits")
    keys = ["doc_id", "th", "tm"]
    spans = found.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))
    owners = benchmark_windows(benchmark, size).select("item", "len", "h", "win")
    items = found.select(*keys, "h", "len", "win").distinct().join(owners, ["h", "len", "win"]) \
        .groupBy(*keys).agg(F.sort_array(F.collect_set("item")).alias("items"))
    base = docs.select("doc_id", text_of().alias("t")).select(
        "doc_id", *text_keys(F.col("t")), F.size(word_array(F.col("t"))).cast("long").alias("n_words"))
    hit = _by_content(spans, items)
    n = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    return _by_content(base, hit).select(
        "doc_id", "n_words", n.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        (n > 0).alias("contaminated"), "spans")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; all columns kept."""
    found = hits(docs, benchmark, size).select("doc_id", "th", "tm").distinct()
    return beside(docs, found, "left_anti").select(*unpacked(docs))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM
       (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM
       (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
