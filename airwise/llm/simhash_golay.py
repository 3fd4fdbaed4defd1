"""Operator 4, SimHash near-duplicates found with Golay-code fuzzy hashing.

Fingerprint: 64 bits over the 3-word shingles of the whole lower-cased text (repeats count); a bit
is set when it is set in over half of the shingles' XXH64 values.  Two fingerprints that differ in
at most two bits are linked, and a component is a set of documents joined by links.

Candidates.  The distinct fingerprints (copies are grouped first) are cut into three segments.
With at most two errors over three segments one segment is free of errors (pigeonhole), and every
segment has at most two.  The segment after the error-free one is decoded with the perfect
(23, 12) Golay code: its keys are the codewords within distance 4, one or six of them.  Two
segments at most two bits apart share such a codeword, since the one within distance 3 of the
middle between them is within distance 4 of both.  A candidate key is thus an exact segment of 21
or 22 bits with a 12-bit codeword index: about 16 keys for a fingerprint, each 33 bits wide, so
buckets stay small when the corpus grows.  Pairs in a bucket are verified by the Hamming distance.

Dense buckets (over ``dense`` fingerprints, as a group of thousands of near copies makes them) are
never expanded into pairs.  Their fingerprints are dealt by all values within one bit of them: two
fingerprints share such a value exactly if they differ in at most two bits, at most 65 share one,
and each is linked to the smallest.  That is exact and linear, so no bucket is cut off.

Rows: a null or empty text has fingerprint zero and is linked like any other.  Repeated rows give
a row each.  A null doc_id stays null, and is never a component's smallest id while there is
another; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwise.llm.common import components, stored, text_batches, text_of, unpacked

SHINGLE = 3
MAX_BITS = 2
SEED = 42
DENSE = 16
#: The segments (offset, bits) of 64 bits, and the generator polynomial of the (23, 12) Golay code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GOLAY = 0b101011100011


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text as a signed 64-bit number.  Shingles are hashed in blocks, so a very long text takes bounded memory."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), seed)).astype(np.int64))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    n = len(words) - size + 1
    stops = ends[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 8192):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[a:min(n, a + 8192)], stops[a:a + 8192])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0].astype(np.int64))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return docs.select("doc_id", of(text_of()).alias("fp"))


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GOLAY << (bit - 11), 0)
    return v


def error_table() -> np.ndarray:
    """For each of the 2048 syndromes its errors of weight 4 or less (one or six, padded with -1)."""
    errors = np.array([sum(1 << b for b in c) for k in range(5) for c in itertools.combinations(range(23), k)], np.int64)
    table, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for e, s in zip(errors, _syndrome(errors)):
        table[s, used[s]] = e
        used[s] += 1
    return table


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row index, key) of every candidate key of signed 64-bit fingerprints."""
    table, u = error_table(), fp.view(np.uint64)
    seg = [(u >> np.uint64(o) & np.uint64((1 << b) - 1)).astype(np.int64) for o, b in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        near = seg[(i + 1) % 3]
        errors = table[_syndrome(near)]
        r, j = np.nonzero(errors >= 0)
        index = (near[r] ^ errors[r, j]) >> 11  # 12 information bits name a codeword
        rows.append(r)
        keys.append((np.int64(i) << 34) | (seg[i][r] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def links(fps: DataFrame, bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """(u, v): links among distinct fingerprints ``fp`` that join every component of pairs at most two bits apart."""
    if bits != 2:
        raise ValueError("the Golay keys are made for two differing bits")

    def key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            r, k = golay_keys(fp)
            yield pd.DataFrame({"k": k, "fp": fp[r]})

    def ball_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            yield pd.DataFrame({"z": (fp.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64), "fp": np.repeat(fp, 65)})

    keys = stored(fps.mapInPandas(key_rows, "k long, fp long"), "golay-keys")
    sizes = stored(keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "golay-sizes")  # AQE can split the join
    shared = keys.join(sizes, "k")
    thin = shared.where(F.col("n") <= dense).groupBy("k").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    # a thin bucket holds `dense` fingerprints at most: its pairs are made inside the row
    pairs = thin.select(F.posexplode("m").alias("i", "u"), "m") \
        .select("u", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("v")) \
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits).distinct()
    crowd = shared.where(F.col("n") > dense).select("fp").distinct()
    balls = crowd.mapInPandas(ball_rows, "z long, fp long").groupBy("z") \
        .agg(F.min("fp").alias("u"), F.collect_list("fp").alias("m")).where(F.size("m") > 1)
    stars = balls.select("u", F.explode("m").alias("v")).where("u != v").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, fingerprint (hex), component_id."""
    fps = stored(fingerprints(docs, size), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct, bits, dense))
    member = distinct.join(roots, F.col("fp") == F.col("node"), "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = member.join(smallest, "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the one with its smallest id.  Repeated rows of
    that id leave one of them; rows with a null id have
    no id to be kept by, and stay."""
    kept = near_duplicates(docs, size, bits).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("own"))
    one = packed.join(kept, F.col("own") == F.col("id"), "left_semi").dropDuplicates(["own"])
    return one.unionByName(packed.where("own is null")).select(*unpacked(docs))
