r"""Operator 12, MinHash near-duplicates by an LSH forest.

A document's set is its distinct 5-word shingles (64-bit hashes).  Equal sets are grouped first; what follows
runs over distinct sets.  A signature has 128 MinHash values of 16 bits.  A tree of the forest is the signature in one fixed
order; sets whose values in that order share a prefix of length k are a region of depth k.

Adaptive depth.  Level by level (depths 3, 4, 6, 8, 12) the trees of the level deal the sets still in play into
regions.  Two sets that must be linked share a region of depth k in one of T(k) trees but for a chance of 1e-7, and T grows with k,
so a level loses nothing that the one before had.  A region of up to ``crowd`` sets is thin: its pairs are compared by signature
inside its row.  Sets in any larger region go on to the next level, where regions are smaller: depth follows the region.
At the last level a crowded region is put in the order of the rest of its signature, and each set is compared with its neighbours,
those of the longest common prefix; groups of near copies hang together by these.  What stays apart in a crowded region is compared in full,
blocks of other components against all blocks, confirmed on the full sets in the task; only links that join two components leave it.  So there is
no cap, and a group of near copies that has become one component is never expanded into pairs.

Confirmation.  Pairs whose signatures agree in fewer than 84 of 128 values are no link (at 85 % similarity the
chance is below 1e-6).  All others are confirmed on the full sets, read again for those documents only: first
each set's first and best partner, then whatever pairs still lie between two components.

Rows: null or empty text has an empty set, its own component and n_shingles 0; under five words the whole sequence is the one
shingle; repeated rows get a row each; very long texts are hashed in blocks; a null doc_id stays null and is a component's smallest
id only when there is no other, kept like any smallest; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwise.llm.common import components, stored, text_batches, text_of, unpacked

SHINGLE = 5
PERCENT = 85
VALUES = 128
AGREE = 84
DEPTHS = (3, 4, 6, 8, 12)
MISS = 1e-7
CROWD = 32
BLOCK = 64
FILTER_BITS = 24
SEED = 12
MASK = (1 << 64) - 1


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[size - 1:].tolist()
    parts = [np.unique(np.fromiter((digest(joined[s:e]) for s, e in zip(starts[a:a + 65536], stops[a:a + 65536])), np.uint64))
             for a in range(0, len(stops), 65536)]
    return np.unique(np.concatenate(parts))


def _draws() -> np.random.Generator:
    return np.random.default_rng(SEED)


MULTIPLIERS = _draws().integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """128 MinHash values of 16 bits: the low half of the least 32-bit product of each hash function."""
    least = np.full(VALUES, (1 << 32) - 1, np.uint32)
    for a in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[a:a + 1024, None] * MULTIPLIERS) >> np.uint64(32)).astype(np.uint32).min(0))
    return (least & np.uint32(0xFFFF)).astype("<u2")


def trees(depth: int, percent: int = PERCENT) -> int:
    """Trees so that a pair at the threshold shares a region of this depth but for a chance of MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** depth))


def order(tree: int) -> np.ndarray:
    """The order of signature values in a tree."""
    return np.random.default_rng([SEED, tree]).permutation(VALUES)


def signed(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, s0, s1, sig): s0 and s1 name the set; null sig for an empty one.  Stored once."""
    text_batches(docs.sparkSession, 200)

    @F.pandas_udf("n_shingles long, s0 long, s1 long, sig binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            h = shingle_hashes(t, size)
            raw = h.tobytes()
            out.append((len(h), *np.array([xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)], np.uint64).view(np.int64).tolist(),
                        signature(h).tobytes() if len(h) else None))
        return pd.DataFrame(out, columns=["n_shingles", "s0", "s1", "sig"])

    return stored(docs.select(F.col("doc_id").alias("doc_id"), of(text_of()).alias("v")).select("doc_id", "v.*"), "forest-signatures")


def _regions(sets: DataFrame, depth: int, percent: int) -> DataFrame:
    """(z, k, o): regions of a depth in all its trees; o orders a region by the four values that follow."""
    orders = [order(t) for t in range(trees(depth, percent))]
    mix = _draws().integers(1, 1 << 63, depth + 1, dtype=np.uint64) | np.uint64(1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sig = np.frombuffer(b"".join(b["sig"]), "<u2").reshape(len(b), VALUES).astype(np.uint64)
            k = b["k"].to_numpy(np.int64)
            for t, at in enumerate(orders):
                z = (sig[:, at[:depth]] + np.uint64(1)) * mix[:depth]
                z = z.sum(1) + np.uint64((t + 1) * int(mix[depth]) & MASK)
                z ^= z >> np.uint64(29)
                z *= mix[0]
                rest = sig[:, at[depth:depth + 4]]
                o = (rest[:, 0] << np.uint64(47)) | (rest[:, 1] << np.uint64(31)) | (rest[:, 2] << np.uint64(15)) | (rest[:, 3] >> np.uint64(1))
                yield pd.DataFrame({"z": z.view(np.int64), "k": k, "o": o.view(np.int64)})

    return sets.select("k", "sig").mapInPandas(deal, "z long, k long, o long")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Agreeing signature values of every row of ``a`` with every row of ``b``."""
    return np.stack([(a == row).sum(1) for row in b], axis=1) if len(b) else np.empty((len(a), 0), int)


def _pairs_inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a thin region whose signatures agree."""
    for b in batches:
        out = [np.empty((0, 3), np.int64)]
        for ks, sigs in zip(b["ks"], b["sigs"]):
            sig = np.frombuffer(b"".join(sigs), "<u2").reshape(-1, VALUES)
            near = _alike(sig, sig)
            i, j = np.nonzero(np.triu(near >= AGREE, 1))
            k = np.asarray(ks)
            out.append(np.stack([np.minimum(k[i], k[j]), np.maximum(k[i], k[j]), near[i, j]], axis=1))
        yield pd.DataFrame(np.concatenate(out), columns=["u", "v", "agree"])


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs next to each other in the order of a crowded region."""
    last_z, last_k, last_sig = None, None, None
    for b in batches:
        if not len(b):
            continue
        sig = np.frombuffer(b"".join(b["sig"]), "<u2").reshape(len(b), VALUES)
        z, k = b["z"].to_numpy(np.int64), b["k"].to_numpy(np.int64)
        if last_z is not None:
            sig, z, k = np.concatenate([last_sig, sig]), np.concatenate([last_z, z]), np.concatenate([last_k, k])
        near = (sig[1:] == sig[:-1]).sum(1)
        at = np.flatnonzero((z[1:] == z[:-1]) & (near >= AGREE))
        yield pd.DataFrame({"u": np.minimum(k[at], k[at + 1]), "v": np.maximum(k[at], k[at + 1]), "agree": near[at]})
        last_z, last_k, last_sig = z[-1:], k[-1:], sig[-1:]


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted arrays share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _across(percent: int):
    """Links that join the components of two blocks of a crowded region: each pair whose signatures agree and that nothing found
    in the task joins already is confirmed on the full sets."""
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ks, cs, sigs, sets, kt, ct, sigt, sett in b[["ks", "cs", "sigs", "sets", "kt", "ct", "sigt", "sett"]].itertuples(index=False):
                up: dict[int, int] = {}

                def top(c: int) -> int:
                    while c in up:
                        c = up[c]
                    return c

                x, y = (np.frombuffer(b"".join(s), "<u2").reshape(-1, VALUES) for s in (sigs, sigt))
                n, m = np.array([len(s) for s in sets]), np.array([len(s) for s in sett])
                close = 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
                for i, j in zip(*np.nonzero(close & (_alike(x, y) >= AGREE) & (np.asarray(cs)[:, None] != np.asarray(ct)[None, :]))):
                    p, q = top(int(cs[i])), top(int(ct[j]))
                    if p != q:
                        both = _same(sets[i], sett[j])
                        if 100 * both >= percent * (n[i] + m[j] - both):
                            up[p] = q
                            out.append((int(ks[i]), int(kt[j])))
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    return links


PAIR = "u long, v long, agree long"


def _forest(sets: DataFrame, percent: int, crowd: int, depths: tuple[int, ...]) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Pairs (u, v, agree) from thin regions and from neighbours, the crowded regions (z, k) of the last level, and the sets of that level."""
    found, rest, alive = None, None, sets
    for level, depth in enumerate(depths):
        keys = stored(_regions(alive, depth, percent), "forest-regions")
        sizes = stored(keys.groupBy("z").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "forest-sizes")
        if level == 0:  # most sets are alone in their regions; later levels hold only sets of crowded ones
            keys = stored(likely(keys, "z", sizes, "z"), "forest-shared")
        within = lambda some: keys.join(sizes.where(some).select("z"), "z", "left_semi")  # noqa: E731  a region's size is one row: no row is multiplied
        thin = within(F.col("n") <= crowd).join(alive.select("k", "sig"), "k").groupBy("z") \
            .agg(F.collect_list("k").alias("ks"), F.collect_list("sig").alias("sigs"))
        pairs = stored(thin.mapInPandas(_pairs_inside, PAIR).distinct(), "forest-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if sizes.where(F.col("n") > crowd).isEmpty():
            return found, None, alive
        full = within(F.col("n") > crowd)
        if level < len(depths) - 1:
            names = full.select("k").distinct()
            alive = stored(alive.select("k", "sig").join(names, "k", "left_semi"), "forest-crowd")
        else:
            rest = stored(full.select("z", "k", "o"), "forest-crowded")
    in_order = rest.join(alive.select("k", "sig"), "k").repartitionByRange("z", "o", "k").sortWithinPartitions("z", "o", "k").select("z", "k", "sig")
    near = stored(in_order.mapInPandas(_neighbours, PAIR).distinct(), "forest-neighbours")
    return found.unionByName(near), rest, alive


def likely(df: DataFrame, c: str, wanted: DataFrame, of: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose ``c`` may be among the values ``of`` of ``wanted``: all that are and, by chance of a hash, few others.  The hashes'
    bits go to the tasks as bitmaps of 32,768 bits, so what is sent is bounded (2 MiB) whatever the input; more values than
    bits only let more rows through.  An exact join follows; this one spares it the shuffle of the rows that it would drop.  The last condition
    holds for each row; it is not deterministic, so the optimizer can't move the semi join that follows below the filter, onto all rows."""
    place = lambda name: F.pmod(F.xxhash64(name), F.lit(1 << bits))  # noqa: E731  null hashes too, so both names are never null
    maps = wanted.groupBy(F.shiftright(place(of), 15).alias("_map")).agg(F.bitmap_construct_agg(place(of) % 32768).alias("_bits"))
    at = (place(c) % 32768).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return df.withColumn("_at", F.shiftright(place(c), 15)).join(F.broadcast(maps), F.col("_at") == F.col("_map")) \
        .where(F.getbit(byte, at % 8) == 1).where(F.spark_partition_id() >= 0).select(*df.columns)


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough."""
    a, b = full.select(F.col("k").alias("u"), F.col("set").alias("a")), full.select(F.col("k").alias("v"), F.col("set").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.select("u", "v").join(a, "u").join(b, "v").where(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("u", "v")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs that lie in two components; sets without a component are their own."""
    of = lambda c: comp.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    return pairs.join(of("u"), "u", "left").join(of("v"), "v", "left") \
        .where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")


def _blocks_apart(rest: DataFrame, sets: DataFrame, full: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) inside crowded regions that hold several components: the blocks of all components but a region's
    largest against all its blocks."""
    named = rest.select("z", "k").join(comp, F.col("k") == F.col("node"), "left").select("z", "k", F.coalesce("root", "k").alias("c"))
    per = stored(named.groupBy("z", "c").agg(F.count(F.lit(1)).alias("n")), "forest-mixed")
    mixed = per.groupBy("z").agg(F.count(F.lit(1)).alias("several"), F.sum("n").alias("all"), F.max(F.struct("n", "c")).alias("top")) \
        .where("several > 1").select("z", "all", F.col("top.c").alias("main"))
    rows = named.join(mixed, "z").join(sets.select("k", "sig"), "k").join(full, "k") \
        .select("z", "k", "c", "sig", "set", (F.col("c") != F.col("main")).alias("other"), F.pmod(F.xxhash64("k"), F.ceil(F.col("all") / BLOCK)).alias("block"))
    parts = [F.collect_list("k").alias("ks"), F.collect_list("c").alias("cs"), F.collect_list("sig").alias("sigs"), F.collect_list("set").alias("sets")]
    blocks = stored(rows.groupBy("z", "other", "block").agg(*parts), "forest-blocks")
    text_batches(sets.sparkSession, 4)
    every = blocks.select("z", F.col("ks").alias("kt"), F.col("cs").alias("ct"), F.col("sigs").alias("sigt"), F.col("sets").alias("sett"))
    found = stored(blocks.where("other").drop("other", "block").join(every, "z").mapInPandas(_across(percent), "u long, v long").distinct(), "forest-late-links")
    text_batches(sets.sparkSession, 200)
    return found


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, crowd: int = CROWD, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows = signed(docs, size)
    name = ["s0", "s1", "n_shingles"]
    sets = stored(rows.where("sig is not null").groupBy(*name).agg(F.min("doc_id").alias("first"), F.min("sig").alias("sig"))
                  .withColumn("k", F.monotonically_increasing_id()), "forest-sets")
    pairs, rest, alive = _forest(sets, percent, crowd, depths)
    pairs = stored(pairs.distinct(), "forest-candidates")

    def full_sets(wanted: DataFrame) -> DataFrame:
        """(k, set) of the named sets, from the texts of their first documents."""
        text_batches(docs.sparkSession, 200)

        def of(texts: pd.Series) -> pd.DataFrame:
            out = []
            for t in texts:
                h = shingle_hashes(t, size)
                raw = h.tobytes()
                out.append((h.view(np.int64), *np.array([xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)], np.uint64).view(np.int64).tolist(), len(h)))
            return pd.DataFrame(out, columns=["set", *name[:2], "n_shingles"])

        # not deterministic: else the join's null checks on its result move it below the semi join, onto all texts
        of = F.pandas_udf(of, "set array<long>, s0 long, s1 long, n_shingles long").asNondeterministic()
        firsts = stored(sets.join(wanted, "k", "left_semi").select("first").distinct(), "forest-firsts")
        texts = likely(docs.select("doc_id", text_of().alias("t")), "doc_id", firsts, "first").join(firsts, F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
        made = texts.select(of("t").alias("v")).select("v.*")
        # one row per set before the join on the same columns: the sets are shuffled once
        return stored(made.groupBy(*name).agg(F.min("set").alias("set")).join(sets.select(*name, "k"), name).select("k", "set"), "forest-full-sets")

    wanted = pairs.select(F.explode(F.array("u", "v")).alias("k"))
    full = full_sets((wanted if rest is None else wanted.unionByName(rest.select("k"))).distinct())
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "agree"))
    picks = both.groupBy("u").agg(F.min("v").alias("low"), F.max(F.struct("agree", -F.col("v"))).alias("best"))
    picks = picks.select("u", F.explode(F.array("low", -F.col("best.col2"))).alias("v")) \
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = stored(_confirmed(picks, full, percent), "forest-links")
    comp = stored(components(links), "forest-components")
    more = stored(_apart(pairs, comp), "forest-apart")
    links = links.unionByName(stored(_confirmed(more, full, percent), "forest-more-links"))
    if rest is not None:
        comp = stored(components(links), "forest-components")
        links = links.unionByName(_blocks_apart(rest, alive, full, comp, percent))
    comp = components(links)
    member = sets.join(comp, F.col("k") == F.col("node"), "left").select(*name, "first", F.coalesce("root", "k").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = member.join(smallest, "root").select(*name, "component_id")
    alone: Column = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.drop("sig").join(ids, name, "left").select("doc_id", "n_shingles", alone.alias("component_id"), F.col("doc_id").eqNullSafe(alone).alias("kept"))


def keep_one(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component (rows with a null id that stand alone stay)."""
    kept = near_duplicates(docs, **limits).where("kept").select(F.col("doc_id").alias("id")).distinct()
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("own"))
    return packed.join(kept, F.col("own").eqNullSafe(F.col("id")), "left_semi").select(*unpacked(docs))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
g AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id AS d, doc_id AS x FROM documents UNION SELECT r.d, g.v FROM r JOIN g ON g.u = r.x),
c AS (SELECT d, min(x) AS component_id FROM r GROUP BY d)
SELECT d AS doc_id, coalesce(n, 0) AS n_shingles, component_id, d = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.d
"""
