"""Order inside groups of any size: rows in range slices with running sums, and one SHA-256 over ordered pieces.

A group (a conversation, a trie node) may hold a third of all rows, so no group is gathered in one
task.  Rows are dealt by ranges of (keys, order); a slice is sorted and passed in Arrow batches, and
what a group has in earlier slices is carried over by a table of at most one row a slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwise.llm.common import stored

CHUNK_BYTES = 1 << 18


def _changes(keys: list[np.ndarray], last: tuple | None) -> np.ndarray:
    """Whether a row starts a new group; ``last`` is the key of the row before the batch."""
    new = np.zeros(len(keys[0]), bool)
    new[0] = last is None or any(k[0] != v for k, v in zip(keys, last))
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def in_slices(df: DataFrame, keys: list[str], by: list[str], name: str, sums: list[str] = (),
              values: Callable[[pd.DataFrame, np.ndarray], np.ndarray] | None = None, before: list[str] = ()) -> DataFrame:
    """``df`` stored in the order of (keys, by), with `slice`, `nth` (place among its group's rows in the
    slice, from 1) and the running sums ``sums`` of ``values(batch, nth)`` (a row each, a column a sum; non-negative
    integers) inside the slice; ``before`` names the same sums without the row itself.  Keys are not null.  Equal rows of ``by`` stay in any order: give a total one."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, count, carry = TaskContext.get().partitionId(), None, 0, np.zeros(len(sums), np.int64)
        for b in batches:
            if not len(b):
                continue
            k = [b[c].to_numpy() for c in keys]
            new = _changes(k, last)
            at = np.arange(len(b))
            start = np.maximum.accumulate(np.where(new, at, 0))
            goes_on = np.cumsum(new) == 0  # rows of the group that the last batch ended in
            nth = at - start + 1 + np.where(goes_on, count, 0)
            out = b.assign(slice=part, nth=nth)
            if sums:
                own = values(b, nth)
                total = np.cumsum(own, axis=0)
                run = total - np.where((start > 0)[:, None], total[start - 1], 0) + np.where(goes_on[:, None], carry, 0)
                for j, c in enumerate(sums):
                    out[c] = run[:, j]
                for j, c in enumerate(before):
                    out[c] = run[:, j] - own[:, j]
                carry = run[-1]
            last, count = tuple(c[-1] for c in k), int(nth[-1])
            yield out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["slice int", "nth long", *[f"`{s}` long" for s in (*sums, *before)]])
    return stored(df.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by).mapInPandas(number, schema), name)


def carried(rows: DataFrame, keys: list[str], sums: list[str], compose: Callable[[list[tuple]], list[tuple]], add: list[str]) -> DataFrame:
    """(slice, keys, ``add``): what ``compose`` makes of the (nth, sums) that a group ends each of its slices
    with, for groups in several slices: one row of ``add`` a slice.  Only the first group of a slice
    comes from an earlier one, so there are at most as many such rows that matter as slices."""
    ends = rows.groupBy("slice", *keys).agg(F.max(F.struct("nth", *sums)).alias("e")).select("slice", *keys, "e.*")
    several = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")

    def one(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("slice")
        made = compose([tuple(int(x) for x in r) for r in b[["nth", *sums]].itertuples(index=False)])
        return pd.concat([b[["slice", *keys]].reset_index(drop=True), pd.DataFrame(made, columns=add)], axis=1)

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["slice int", *[f"`{k}` {types[k]}" for k in keys], *[f"{a} long" for a in add]])
    return ends.join(several, keys, "left_semi").groupBy(*keys).applyInPandas(one, schema)


def plain_sums(ends: list[tuple]) -> list[tuple]:
    """Carry of places and sums: the totals of the slices before."""
    out, at = [], [0] * len(ends[0])
    for e in ends:
        out.append(tuple(at))
        at = [a + b for a, b in zip(at, e)]
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, bytes]]:
    """(group, piece) of a table whose last column is the piece and whose other columns name the group."""
    for b in batches:
        for *key, p in b.itertuples(index=False):
            yield tuple(key), p.encode("utf-8", "surrogatepass")


def sha256_in_order(df: DataFrame, keys: list[str], by: list[str], take: list[str], sep: str, name: str,
                    pieces: Callable[[Iterator[pd.DataFrame]], Iterator[tuple[tuple, bytes]]] = _pieces, within: list[str] = ()) -> DataFrame:
    """(keys, sha): hex SHA-256 of a group's pieces in the order of (by, within), joined by ``sep``.

    ``pieces`` makes (group, piece) of batches with the columns ``take``, in order; rows with equal
    ``by`` come to one task.  A small group inside a slice is hashed there.  Others, and those
    at a slice's edges, leave it as chunks: a hash is a chain, so one task reads such a group's chunks in order and one at a time.
    Keys are not null."""
    glue, head = sep.encode(), [*keys, "slice", "chunk", "b", "sha"]

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, out, waiting, last, held, size, n, edge = TaskContext.get().partitionId(), [], 0, None, [], 0, 0, True
        for key, p in pieces(batches):
            if last is not None and (key != last or size >= CHUNK_BYTES):
                text = glue.join(held)
                if key != last and not n and not edge:
                    out.append((*last, part, 0, None, hashlib.sha256(text).hexdigest()))
                else:
                    out.append((*last, part, n, text, None))
                    waiting += size
                held, size, n, edge = [], 0, n + 1 if key == last else 0, edge and key == last
            last = key
            held.append(p)
            size += len(p)
            if len(out) >= 5000 or waiting >= 16 * CHUNK_BYTES:
                yield pd.DataFrame(out, columns=head)
                out, waiting = [], 0
        if last is not None:
            out.append((*last, part, n, glue.join(held), None))
        yield pd.DataFrame(out, columns=head)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, h = None, None
        for b in batches:
            out = []
            for *key, p in b[[*keys, "b"]].itertuples(index=False):
                if key != last:
                    if h:
                        out.append((*last, h.hexdigest()))
                    last, h = key, hashlib.sha256(p)
                else:
                    h.update(glue + p)
            yield pd.DataFrame(out, columns=[*keys, "sha"])
        if h:
            yield pd.DataFrame([(*last, h.hexdigest())], columns=[*keys, "sha"])

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    made = df.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by, *within).select(*take) \
        .mapInPandas(chunks, f"{named}, slice int, chunk long, b binary, sha string")
    made = stored(made, name)
    chained = made.where("sha is null").drop("sha").repartition(*keys).sortWithinPartitions(*keys, "slice", "chunk").mapInPandas(digest, f"{named}, sha string")
    return made.where("sha is not null").select(*keys, "sha").unionByName(chained)
