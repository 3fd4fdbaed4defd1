"""Operator 13, the prefix trie of rebuilt conversations, by composable monoid fingerprints.

A conversation c is rebuilt from the head of conversation c - c % 5 (its first h turns, h from the
CRC of c) and its own turns after its first h.  Rebuilt texts are never made.  A run of turns has the fingerprint
(length, sum of x_j * s^j mod p over places j from 1), x a hash of role and text; runs compose as
(m, A)(n, B) = (m + n, A + s^m B).  That is a monoid, so the prefix of depth d of a rebuilt
conversation is composed from two numbers a turn that are there already: the base's head and the
conversation's own run after h, the difference of two own prefixes moved by a power of s.  Four
lanes with p = 2^31 - 1 make a fingerprint of 124 bits.

Equality is verified, not trusted.  A rebuilt turn refers to a stored turn by its content name (two 64-bit
hashes).  A name is good if all stored turns under it have one role and one text, compared by minimum and maximum; a node
is good if all turns its members refer to have one name, and by induction over the depth its members share
the whole prefix.  If any check fails, everything is named anew under the next seed.

Aggregates over subtrees need no walk.  Every node stands for its smallest member c, and the nodes
of one c are the last ones of its path.  So the sum over the subtree of a node is the sum over its members of all
nodes each stands for, but for its own smallest member, of which only the nodes from this depth
on count.  Leaves are counted likewise by the conversations that stand for them.

Skew: a long conversation is cut into range slices, whose fingerprints compose too; a head has at most
eight turns and serves the conversations of five ids (nine around zero); a node with many members is a partial
aggregate, and the ids that end in it are hashed in chunks.  Texts are read twice and shuffled
once, by the name check.

Rows: null role or text is empty; rows without a conv_id are left out (no id to rebuild by); turns
are ordered by number, null first, then role, then a hash of the text; repeated rows are turns of
their own; very long texts are hashed in place; extra columns are ignored; an empty table has no
nodes, not even the root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwise.llm.common import stored, text_of
from airwise.llm.ordered import carried, in_slices, plain_sums, sha256_in_order

HEADS = 9  # h is below this
FAMILY = 5  # ids from one base
P = (1 << 31) - 1
#: The base of each lane.
S = (1103515245, 1664525043, 1812433253, 2069069631)
LANES = range(len(S))
G, B = [f"g{j}" for j in LANES], [f"b{j}" for j in LANES]  # prefix with the turn, and before it
KEY = ["depth", "f0", "f1"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def powers(s: int, n: np.ndarray) -> np.ndarray:
    """s^n mod P for non-negative n."""
    out, sq, n = np.ones(len(n), np.int64), s, n.copy()
    while n.any():
        out = np.where(n & 1, out * sq % P, out)
        sq, n = sq * sq % P, n >> 1
    return out


def lane_values(b: pd.DataFrame, nth: np.ndarray) -> np.ndarray:
    """x_j * s^nth mod P of every turn and lane."""
    x, y = b["x"].to_numpy(np.int64).view(np.uint64), b["y"].to_numpy(np.int64).view(np.uint64)
    half = np.uint64(32)
    lanes = [(v % np.uint64(P)).astype(np.int64) for v in (x & np.uint64(2**32 - 1), x >> half, y & np.uint64(2**32 - 1), y >> half)]
    return np.stack([v * powers(s, nth) % P for v, s in zip(lanes, S)], axis=1)


def compose(ends: list[tuple]) -> list[tuple]:
    """Carry of (length, lanes) over slices, with the powers of s that move the next slice."""
    out, n, lanes = [], 0, [0] * len(S)
    for m, *g in ends:
        shift = [pow(s, n, P) for s in S]
        out.append((n, *lanes, *shift))
        lanes = [(a + w * v) % P for a, w, v in zip(lanes, shift, g)]
        n += m
    return out


def turns_of(conversations: DataFrame, seed: int) -> DataFrame:
    """(conv_id, turn, role, text, x, y, bytes): x and y name a turn's content."""
    role, text = text_of("role"), text_of("text")
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.xxhash64(F.lit(2 * seed), role, text).alias("x"), F.xxhash64(F.lit(2 * seed + 1), role, text).alias("y"),
        F.octet_length(text).cast("long").alias("bytes"))


def names_hold(turns: DataFrame) -> bool:
    """Whether every content name has one role and one text."""
    content = F.struct("role", "text")
    bad = turns.groupBy("x", "y").agg(F.min(content).alias("a"), F.max(content).alias("b")).where("a != b")
    return bad.agg(F.count(F.lit(1)).alias("n")).first()["n"] == 0


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, x, y, bytes, lanes with the turn and before it): prefix fingerprints of the stored conversations."""
    light = turns.select("conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("timed"), "role", "x", "y", "bytes") \
        .withColumn("row", F.monotonically_increasing_id())
    rows = in_slices(light, ["conv_id"], ["timed", "turn", "role", "x", "y", "row"], "trie-turns", G, lane_values, B)
    moved = carried(rows, ["conv_id"], G, compose, ["o", *[f"o{j}" for j in LANES], *[f"w{j}" for j in LANES]])
    # at most one carried row a slice: broadcast
    both = rows.join(F.broadcast(moved), ["slice", "conv_id"], "left")
    lane = lambda c, j: F.when(F.col("o").isNull(), F.col(c) % P).otherwise((F.col(f"o{j}") + F.col(f"w{j}") * (F.col(c) % P)) % P).alias(c)
    return both.select("conv_id", (F.coalesce("o", F.lit(0)) + F.col("nth")).alias("pos"), "x", "y", "bytes",
                       *[lane(G[j], j) for j in LANES], *[lane(B[j], j) for j in LANES])


def fingerprint(lanes: list[Column]) -> list[Column]:
    """Two numbers of 62 bits that hold the four lanes."""
    return [(F.shiftleft(lanes[0], 31) + lanes[1]).alias("f0"), (F.shiftleft(lanes[2], 31) + lanes[3]).alias("f1")]


def members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, depth, f0, f1, p0, p1, x, y, bytes), a row a rebuilt turn with its node and parent node; and (c, length) of
    every rebuilt conversation."""
    head = F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS, F.struct("pos", "x", "y", "bytes", *G, *B))))
    heads = rows.groupBy("conv_id").agg(F.max("pos").alias("n"), head.alias("own"))
    convs = heads.select(F.col("conv_id").alias("c"), "n", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
                         (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int").alias("h"))
    bases = heads.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("lent"))
    info = convs.join(bases, "base", "left").withColumn("lent", F.slice(F.coalesce("lent", F.array().cast(convs.schema["own"].dataType)), 1, F.col("h")))
    info = stored(info.select("c", "n", "h", F.size("lent").alias("m"), "lent",
                              F.when(F.size("lent") > 0, F.element_at("lent", F.size("lent"))).alias("a"),
                              F.when((F.col("h") > 0) & (F.col("n") > F.col("h")), F.element_at("own", F.col("h"))).alias("z")), "trie-heads")
    lengths = info.select("c", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"))

    def node(lanes: list[Column], parent: list[Column]) -> list[Column]:
        p = fingerprint(parent)
        return [*fingerprint(lanes), p[0].alias("p0"), p[1].alias("p1")]

    t = F.explode("lent").alias("t")
    borrowed = info.select("c", t).select("c", F.col("t.pos").alias("depth"), *node([F.col(f"t.{g}") for g in G], [F.col(f"t.{b}") for b in B]),
                                          "t.x", "t.y", "t.bytes")
    # own run after h: (prefix - prefix at h) moved from place h to place m, that is by s^(m - h)
    back = [F.element_at(F.array(*[F.lit(pow(pow(s, -1, P), e, P)) for e in range(HEADS)]), F.col("h") - F.col("m") + 1) for s in S]
    zero = F.lit(0).cast("long")
    run = lambda c, j: (F.coalesce(F.col(f"a.{G[j]}"), zero) + back[j] * ((F.col(c) - F.coalesce(F.col(f"z.{G[j]}"), zero) + P) % P)) % P
    late = rows.where(F.col("pos") > F.crc32(F.col("conv_id").cast("string")) % HEADS)
    own = late.join(info.drop("lent", "n"), F.col("conv_id") == F.col("c")) \
        .select("c", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), *node([run(G[j], j) for j in LANES], [run(B[j], j) for j in LANES]),
                "x", "y", "bytes")
    return borrowed.unionByName(own), lengths


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    seed = 0
    while True:
        turns = turns_of(conversations, seed)
        if names_hold(turns):
            paths, lengths = members(prefixes(turns))
            paths = stored(paths, "trie-paths")
            ref = F.struct("x", "y", "p0", "p1")
            nodes = stored(paths.groupBy(*KEY).agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min(ref).alias("ref"),
                                                   F.max(ref).alias("other"), F.min("bytes").alias("bytes")), "trie-nodes")
            if nodes.agg(F.sum(F.when(F.col("ref") != F.col("other"), 1).otherwise(0)).alias("n")).first()["n"] in (None, 0):
                return _aggregates(paths, lengths, nodes.select(*KEY, "conv_id", "n_convs", "bytes", "ref.p0", "ref.p1"))
        seed += 1


def _aggregates(paths: DataFrame, lengths: DataFrame, nodes: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    if not root["n_convs"]:
        return lengths.select(F.col("c").alias("conv_id"), *[zero.alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                                                                   "saved_tokens")], F.lit("").alias("ends_sha256")).limit(0)
    counted = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("f0"), F.col("p1").alias("f1")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    counted = stored(counted, "trie-children")
    nodes = nodes.join(counted, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)) \
        .withColumn("weight", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = stored(nodes, "trie-counted")
    of_root = counted.where("depth = 0").agg(F.sum("n_children").alias("n")).first()["n"] or 0
    # what the nodes that stand under a conversation weigh, and whether it ends in a leaf
    mine = stored(nodes.groupBy(F.col("conv_id").alias("c")).agg(F.sum("weight").alias("held"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf")),
                  "trie-held")
    totals = mine.agg(F.sum("held").alias("held"), F.sum("leaf").alias("leaf")).first()
    below = paths.select("c", *KEY).join(mine, "c").groupBy(*KEY).agg(F.sum("held").alias("all_held"), F.sum("leaf").alias("n_leaves"))
    # the smallest member's own nodes from this depth on; only shared nodes weigh anything
    shared = nodes.where("n_convs > 1").select("conv_id", (-F.col("depth")).alias("up"), "f0", "f1", "weight")
    ran = in_slices(shared, ["conv_id"], ["up"], "trie-weights", ["run"], lambda b, nth: b[["weight"]].to_numpy(np.int64))
    moved = carried(ran, ["conv_id"], ["run"], plain_sums, ["o", "before"])
    tails = ran.join(F.broadcast(moved), ["slice", "conv_id"], "left") \
        .select((-F.col("up")).alias("depth"), "f0", "f1", (F.col("run") + F.coalesce("before", zero)).alias("tail"))
    ends = paths.select("c", *KEY).join(lengths, (lengths["c"] == paths["c"]) & (F.col("depth") == F.col("length"))).select(paths["c"], *KEY)
    lone = lengths.where("length = 0").select("c", *[zero.alias(k) for k in KEY])
    ended = ends.unionByName(lone).withColumn("piece", F.col("c").cast("string"))
    hashes = sha256_in_order(ended, KEY, ["c"], [*KEY, "piece"], ",", "trie-ends")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("f0").alias("p0"), F.col("f1").alias("p1"),
                                                   F.col("conv_id").alias("parent_conv_id"))
    top = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(root["conv_id"]).cast("long"))
    deep = nodes.where("depth > 1").join(parents, ["depth", "p0", "p1"])
    full = top.unionByName(deep).join(mine.withColumnRenamed("c", "conv_id").drop("leaf"), "conv_id").join(below, KEY).join(tails, KEY, "left")
    first = _root(paths.sparkSession, root, of_root, totals)
    out = full.select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      F.when(F.col("n_convs") == 1, 0).otherwise(F.col("all_held") - F.col("held") + F.coalesce("tail", zero)).cast("long").alias("saved_tokens"))
    return out.unionByName(first).join(hashes, KEY, "left") \
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def _root(spark, root, children: int, totals) -> DataFrame:
    """The textless node above all others."""
    long = lambda v, c: F.lit(v).cast("long").alias(c)
    return spark.range(1).select(long(0, "depth"), long(0, "f0"), long(0, "f1"), long(root["conv_id"], "conv_id"), long(None, "parent_conv_id"),
                                 long(root["n_convs"], "n_convs"), long(children, "n_children"), long(totals["leaf"] or 1, "n_leaves"),
                                 long(totals["held"] or 0, "saved_tokens"))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
             {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS e FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(e ORDER BY pos) AS l FROM t GROUP BY conv_id),
h AS (SELECT conv_id, l, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h FROM l),
b AS (SELECT h.conv_id, list_concat(coalesce(base.l[1:h], []), h.l[h + 1:]) AS p FROM h LEFT JOIN l base ON base.conv_id = h.conv_id - h.conv_id % 5),
k AS (SELECT conv_id, d, p[1:d] AS k, d = len(p) AS ends FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM b)),
nodes AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS e FROM k GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, CASE WHEN nodes.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(nodes.k[-1].x) END AS w
          FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.k = nodes.k),
sub AS (SELECT a AS d, k[1:a] AS k, sum(w) AS saved, sum((n_children = 0)::INTEGER) AS leaves FROM (SELECT k, w, n_children, unnest(range(0, d + 1)) AS a FROM full_) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.e, '')) AS ends_sha256
FROM full_ f JOIN sub ON sub.d = f.d AND sub.k = f.k LEFT JOIN nodes up ON up.d = f.d - 1 AND up.k = f.k[1:f.d - 1]
"""
