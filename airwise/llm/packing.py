"""Operator 8, sequence packing by exact complements, then best fit.

1. Tokenise: ids of the whole text and the end id.  A document longer than the capacity is cut
   into full pieces; only its first piece may be shorter.  Every piece gets its number among the
   pieces of its length in its task.  The table is written once to the shared folder.
2. Plan: the counts by length (at most ``capacity`` numbers, whatever the corpus size) are the
   only thing the driver sees.  Sums of single, paired and three lengths are indexed; from the
   longest length down, combinations that fill the gap exactly are consumed as often as their
   lengths are available.  What is left is packed by best fit, decreasing, in bulk.  A plan is a
   list of patterns (lengths in order, how many sequences); each step uses up a length or a
   group of open sequences, so the list is bounded by the capacity too.
3. Deal: the pieces of a length are numbered (number in the task plus the tasks before it), and
   the number picks pattern, sequence and offset from the broadcast plan.  No task sees a whole
   length, and no text is shuffled.

Rows: null text is empty and gives one piece of one id.  Repeated rows are packed each; a null
doc_id stays null.  Very long texts are tokenised whole, chunk by chunk.  An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airwise.llm.common import stored, text_batches, text_of

CAPACITY = 1024
END = 2
#: The byte-level pre-tokenizer's pattern, and what is left to the tokenizers library.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 50_000  # characters from which on a text is searched for long runs
HIGH, RUN = re.compile("[^\x00-\u024F]"), re.compile(r"\s{1000}|\S{10000}")


def _byte_of() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: printable ones for themselves, the
    others for the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a byte-level tokenizers file, as little-endian 32-bit bytes.

    In such a vocabulary ids follow the order of merges, so it is given to tiktoken's faster merger as
    ranks.  A text with characters above Latin, whose classes depend on a library's Unicode version, is
    encoded by tokenizers itself, and so is one with a run of white space or of one word too long for the pattern search,
    and one that holds the content of an added token, which gets that token's id.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        added, byte = self.plain.get_added_tokens_decoder(), _byte_of()
        self.added = [t.content for t in added.values()]
        ranks = {bytes(byte[c] for c in token): i for token, i in self.plain.get_vocab().items() if i not in added}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if (not text.isascii() and HIGH.search(text)) or (len(text) > LONG and RUN.search(text)) \
                or any(t in text for t in self.added):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ids = array("I", self.fast.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nr): the pieces, numbered by length within their task."""
    text_batches(docs.sparkSession)
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task, seen = Encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["t"]):
                ids = encoder.encode(text) + last
                n = len(ids) // 4
                stop = n if n <= capacity else (n % capacity or capacity)
                start = piece = 0
                while start < n:
                    rows.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start:4 * stop]), task, seen[stop - start]))
                    seen[stop - start] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nr"])

    # the id travels as text: pandas would turn a long column with nulls into doubles
    return docs.select(F.col("doc_id").cast("string"), text_of().alias("t")).mapInPandas(
        cut, "doc_id string, piece int, start long, length long, ids_crc32 long, task int, nr long") \
        .withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order, number of sequences) for the counts by length: exact complements, then best fit."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out: list[tuple[tuple[int, ...], int]] = []

    def take(combo: tuple[int, ...]) -> None:
        """Consume a combination as often as its lengths are there."""
        need = np.bincount(combo, minlength=capacity + 1)
        at = np.flatnonzero(need)
        n = int((left[at] // need[at]).min())
        if n:
            left[at] -= n * need[at]
            out.append((combo, n))

    for a in range(capacity, 0, -1):
        gap = capacity - a
        if not left[a]:
            continue
        if gap == 0:
            take((a,))
            continue
        if gap <= a:
            take((a, gap))  # single
        if left[a]:  # pairs b >= c with b + c = gap, longest first
            b = np.arange(min(a, gap - 1), (gap + 1) // 2 - 1, -1)
            for x in b[(left[b] > 0) & (left[gap - b] > 0)].tolist():
                if left[a] and left[x] and left[gap - x]:
                    take((a, x, gap - x))
        if left[a]:  # triples b >= c >= d with b + c + d = gap
            for x in range(min(a, gap - 2), (gap + 2) // 3 - 1, -1):
                if not left[x]:
                    continue
                rest = gap - x
                c = np.arange(min(x, rest - 1), (rest + 1) // 2 - 1, -1)
                for y in c[(left[c] > 0) & (left[rest - c] > 0)].tolist():
                    if left[a] and left[x] and left[y] and left[rest - y]:
                        take((a, x, y, rest - y))
                if not left[a]:
                    break

    # best fit, decreasing: open[gap] holds the patterns of open sequences with that gap
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for a in range(capacity, 0, -1):
        todo = int(left[a])
        while todo:
            gap = min((g for g in open_ if g >= a), default=capacity)
            if gap == capacity:
                combo, n = (), -(-todo // (capacity // a))
            else:
                combo, n = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
            fit = gap // a  # the tightest sequence takes as many as fit before the next is opened
            full = min(n, todo // fit)
            rest = min(todo - full * fit, fit) if full < n else 0
            for k, m in ((fit, full), (rest, 1 if rest else 0), (0, n - full - (1 if rest else 0))):
                if m and (k or combo):
                    open_[gap - k * a].append((combo + (a,) * k, m))
            todo -= full * fit + rest
    return out + [x for group in open_.values() for x in group]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity, end), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows

    # for each length, blocks of places: the first piece number, the first sequence and the offset
    blocks: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used, sequence = defaultdict(int), 0
    for combo, n in plan(counts, capacity):
        offset = 0
        for length in combo:
            blocks[length].append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    places = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in blocks.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, nr: pd.Series) -> pd.DataFrame:
        ids, offsets = np.zeros(len(nr), np.int64), np.zeros(len(nr), np.int64)
        for n, rows in length.groupby(length).indices.items():
            first, seq, off = places.value[n]
            at = nr.to_numpy(np.int64)[rows]
            k = np.searchsorted(first, at, side="right") - 1
            ids[rows], offsets[rows] = seq[k] + at - first[k], off[k]
        return pd.DataFrame({"sequence_id": ids, "offset": offsets})

    numbered = cut.join(before, ["length", "task"]).withColumn("at", place("length", F.col("nr") + F.col("before")))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
