r"""Operator 11, conversation structure repair by bidirectional Dijkstra over the edit lattice.

A lattice node is (rows consumed, grammar state); the grammar is `(s?(ua)+)?` over role initials, so its
states are start, after s, after u, after a.  Edges are edits: Keep (0), Insert a turn (2), Rerole (2),
Delete (3, the only one for blank and duplicate rows); a truncated row that stays adds 1.  The state
fixes the role that an insertion or rerole gives.  A forward heap from the first node and a reverse heap from the
accepting ones are advanced by the cheaper top until no cheaper path can follow; all crossings of equal cost are
finished, and of their concatenated audits (initials of the edits) the ASCII-least one is taken.
Labels are (cost, link to the next label): strings are compared along the links, only for equal costs.

Spark deals the rows by ranges of (conversation, turn) in slices, so that order costs one shuffle of
whole texts.  What the lattice needs of a row (fault, initial, content hash: no text) is packed
in blocks of bounded size and gathered by conversation, since the audit is one value of the conversation.  The edits go back
to the rows block by block, and the repaired text is hashed in order from chunks.  Texts are never gathered.

Rows: a null in any column counts as one space in the damage rule, as role and as text (a role of one space has no place
in the grammar; a text of one space is blank); rows with a null conv_id are a conversation of their own; turns are
ordered null first, then by role and by a hash of the text, repeated rows next to each other;
copies of a row are duplicates; very long texts are looked at by the JVM where they are; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwise.llm.common import stored, text_batches
from airwise.llm.ordered import in_slices, sha256_in_order

BLOCK = 2048
SPACES = r"[\x20\x09-\x0D]"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Faults; a row's code is 4 * fault + the place of its role's initial, and DROPPED for a row that the damage took.
BLANK, DUPLICATE, TRUNCATED, DROPPED = 1, 2, 3, 99
INITIALS = "sua"
#: Costs of the edits, and what a truncated row that stays adds.
INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1
#: Grammar: states 0 start, 1 after system, 2 after user, 3 after assistant; the state a made turn leads to, and its role's initial.
NEXT = (2, 2, 3, 2)
MADE = "uuau"
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
#: Adjacent initials that are in order.
LEGAL = {(0, 1), (1, 2), (2, 1)}
ROLE = {"U": "user", "A": "assistant"}
MADE_LINE = {"u": b"user:", "a": b"assistant:"}


def _step(state: int, row: int) -> list[tuple[str, int, int]]:
    """(initial, state after, cost) of the edits that consume a row; ``row`` is 4 * fault + the place of its role's initial in
    INITIALS (3: any other)."""
    fault, initial = divmod(row, 4)
    out = [("D", state, DELETE)]
    if fault not in (BLANK, DUPLICATE):
        stays = CUT if fault == TRUNCATED else 0
        after = KEEPS.get((state, INITIALS[initial])) if initial < 3 else None
        if after is not None:
            out.append(("K", after, stays))
        out.append(("R", NEXT[state], REROLE + stays))
    return out


#: Edges by row and state, as they are and turned round.
AHEAD = [[_step(s, r) for s in range(4)] for r in range(16)]
BACK = [[[(e, s, w) for s in range(4) for e, t, w in AHEAD[r][s] if t == v] for v in range(4)] for r in range(16)]
INSERTED = [[s for s in range(4) if NEXT[s] == v] for v in range(4)]


class _Side:
    """One direction's labels: cost of each reached lattice node (4 * rows consumed + state), and its (edit, next node) link."""

    def __init__(self, starts: list[int], sign: int):
        self.sign, self.cost, self.link, self.done, self.heap = sign, {}, {}, set(), []
        for v in starts:
            self.offer(v, 0, None)

    def offer(self, v: int, cost: int, link: tuple[str, int] | None) -> None:
        known = self.cost.get(v)
        if known is None or cost < known:
            self.cost[v], self.link[v] = cost, link
            # of equal costs the row next to this side's start first: then a label is final when it is popped, since only keeping is free
            heappush(self.heap, (cost, self.sign * (v >> 2), v))
        elif cost == known and self.less(link, self.link[v]):
            self.link[v] = link

    def top(self) -> int | None:
        while self.heap and (self.heap[0][2] in self.done or self.heap[0][0] > self.cost[self.heap[0][2]]):
            heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def pop(self) -> int:
        v = heappop(self.heap)[2]
        self.done.add(v)
        return v

    def path(self, v: int) -> list[str]:
        out = []
        while self.link[v] is not None:
            edit, v = self.link[v]
            out.append(edit)
        return out


class _Forward(_Side):
    def less(self, a: tuple[str, int], b: tuple[str, int]) -> bool:
        """Which of two paths to one node, at one cost, has the lesser audit: what follows the last node they share decides."""
        left, right, u, v = [a[0]], [b[0]], a[1], b[1]
        while u != v:
            # (cost, row) grows along a path, so the later node is walked back
            x, y = (self.cost[u], u >> 2), (self.cost[v], v >> 2)
            if x >= y:
                edit, u = self.link[u]
                left.append(edit)
            if y >= x:
                edit, v = self.link[v]
                right.append(edit)
        return left[::-1] < right[::-1]


class _Reverse(_Side):
    def less(self, a: tuple[str, int] | None, b: tuple[str, int] | None) -> bool:
        while a is not None and b is not None:
            if a[0] != b[0]:
                return a[0] < b[0]
            if a[1] == b[1]:
                return False
            a, b = self.link[a[1]], self.link[b[1]]
        return a is None and b is not None


def cheapest(rows: list[int]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, the ASCII-least one of equal costs."""
    n = len(rows)
    ahead, back = _Forward([0], 1), _Reverse([4 * n + s for s in ACCEPT], -1)
    best, found = None, []

    def crossing(u: int, edit: str, v: int, cost: int) -> None:
        nonlocal best, found
        total = ahead.cost[u] + cost + back.cost[v]
        if best is None or total < best:
            best, found = total, []
        if total == best:
            found.append((u, edit, v))

    def advance(side: _Side) -> None:
        v = side.pop()
        row, state = divmod(v, 4)
        forth = side is ahead
        other = back if forth else ahead
        if v in other.done:
            crossing(v, "", v, 0)
        if forth:
            edges = [("I", 4 * row + NEXT[state], INSERT)]
            if row < n:
                edges += [(e, 4 * row + 4 + t, w) for e, t, w in AHEAD[rows[row]][state]]
        else:
            edges = [("I", 4 * row + s, INSERT) for s in INSERTED[state]]
            if row:
                edges += [(e, 4 * row - 4 + s, w) for e, s, w in BACK[rows[row - 1]][state]]
        cost = side.cost[v]
        for edit, w, c in edges:
            side.offer(w, cost + c, (edit, v))
            if w in other.done:
                crossing(*((v, edit, w) if forth else (w, edit, v)), c)

    for side in (ahead, back, back):  # the first node and both last ones
        if side.top() == 0:
            advance(side)
    while True:
        x, y = ahead.top(), back.top()
        if x is None or y is None or (best is not None and x + y > best):
            # an empty heap has settled every node it can reach, crossings included
            if best is not None:
                break
        advance(ahead if y is None or (x is not None and x <= y) else back)
    return best, min("".join(ahead.path(u)[::-1]) + edit + "".join(back.path(v)) for u, edit, v in found)


def row_edits(rows: list[int], audit: str) -> list[str]:
    """Per row: initials (u, a) of turns inserted before it, then K, D, or the initial of its new role (U, A); what is
    inserted at the end follows the last row's."""
    out, made, state = [], "", 0
    for e in audit:
        if e == "I":
            made += MADE[state]
            state = NEXT[state]
            continue
        if e == "K":
            state = KEEPS[state, INITIALS[rows[len(out)] % 4]]
        elif e == "R":
            e, state = MADE[state].upper(), NEXT[state]
        out.append(made + e)
        made = ""
    if made:
        out[-1] += made
    return out


CONV = ["named", "g"]
ORDER = ["timed", "turn", "x", "y"]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, with the key of their place (CONV, ORDER), `copies` (0: dropped) and `row` (4 * fault + initial)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn_no"),
                                blank("role").alias("role"), blank("text").alias("text"),
                                (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("k"))
    rows = rows.select("conv_id", "turn_no", "k", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"))
    stripped = F.regexp_replace("text", SPACES + r"+\z", "")
    fault = F.when(F.length(stripped) == 0, BLANK).when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.select(F.col("conv_id").isNotNull().alias("named"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("g"),
                       F.col("turn_no").isNotNull().alias("timed"), F.coalesce("turn_no", F.lit(0)).cast("long").alias("turn"),
                       F.xxhash64(F.lit(1), "role", "text").alias("x"), F.xxhash64(F.lit(2), "role", "text").alias("y"),
                       F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("copies"), (4 * fault + place).alias("code"), "role", "text")


def _settle(packs: list, cache: dict) -> list[tuple]:
    """A conversation's packs with the edits of their rows; its counts stand in the first."""
    codes = [c for p in packs for c in p.codes]
    seen, live, counts = set(), [], [0] * 4
    turns, at = set(), 0
    for p in packs:
        for x, y, t, timed in zip(p.xs, p.ys, p.turns, p.timeds):
            code = codes[at]
            if code != DROPPED:
                if code // 4 != BLANK and (x, y) in seen:
                    code = 4 * DUPLICATE + code % 4
                seen.add((x, y))
                live.append(code)
                counts[code // 4] += 1
                if timed:
                    turns.add(t)
            at += 1
    span = [int(min(turns)), int(max(turns))] if turns else [0, -1]
    key = bytes(live)
    if key not in cache:
        if len(cache) > 50_000:
            cache.clear()
        cost, audit = cheapest(live)
        if len(key) <= 64:  # long ones hardly come twice
            cache[key] = cost, audit, row_edits(live, audit)
    cost, audit, edits = cache.get(key) or (cost, audit, row_edits(live, audit))
    illegal = sum((a % 4, b % 4) not in LEGAL for a, b in zip(live, live[1:]))
    out, i, todo = [], 0, iter(edits)
    for p in packs:
        own = [next(todo) if c != DROPPED else "" for c in codes[i:i + len(p.codes)]]
        lead = not i
        i += len(own)
        head = (span[1] - span[0] + 1 - len(turns), counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost, audit) if lead else (0,) * 6 + ("",)
        out.append((p.named, p.g, p.slice, p.block, own, lead, *head))
    return out


REPAIRS = ["named", "g", "slice", "block", "edits", "lead", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, key, cache = [], None, {}
    for b in batches:
        out = []
        for p in b.itertuples(index=False):
            if held and (p.named, p.g) != key:
                out += _settle(held, cache)
                held = []
            key = p.named, p.g
            held.append(p)
        yield pd.DataFrame(out, columns=REPAIRS)
    if held:
        yield pd.DataFrame(_settle(held, cache), columns=REPAIRS)


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, bytes]]:
    """Repaired lines in order: at each place come the edits of the rows there, then the row (or equal copies of it)."""
    place, edits = None, []
    for b in batches:
        for named, g, timed, turn, x, y, edit, role, text in b.itertuples(index=False):
            here = named, g, timed, turn, x, y
            if edit is not None:
                if here != place:
                    place, edits = here, []
                edits.append(edit)
                continue
            if here != place:
                continue
            for e in edits:
                for c in e:
                    if c in "ua":
                        yield (named, g), MADE_LINE[c]
                    elif c != "D":
                        line = role if c == "K" else ROLE[c]
                        yield (named, g), f"{line}:{text}".encode("utf-8", "surrogatepass")
            edits = []


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    text_batches(conversations.sparkSession)
    rows = damaged(conversations)
    light = rows.select(*CONV, *ORDER, "code", "copies").withColumn("row", F.monotonically_increasing_id()) \
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))) \
        .withColumn("code", F.when(F.col("copies") == 0, DROPPED).otherwise(F.col("code"))).drop("copies")
    placed = in_slices(light, CONV, [*ORDER, "row", "copy"], "repair-places").withColumn("block", F.floor((F.col("nth") - 1) / BLOCK))
    pack = [*CONV, "slice", "block"]
    packs = placed.groupBy(*pack).agg(F.sort_array(F.collect_list(F.struct("nth", "code", "x", "y", "turn", "timed"))).alias("r"))
    packs = packs.select(*pack, *[F.col(f"r.{c}").alias(f"{c}s") for c in ("code", "x", "y", "turn", "timed")])
    repairs = stored(packs.repartition(*CONV).sortWithinPartitions(*pack).mapInPandas(
        _repair, "named boolean, g long, slice int, block long, edits array<string>, lead boolean, gaps long, blank long, duplicate long, "
                 "truncated long, illegal long, cost long, audit string"), "repair-edits")
    none = F.lit(None).cast("string")
    edits = placed.where(F.col("code") != DROPPED).join(repairs.select(*pack, "edits"), pack) \
        .select(*CONV, *ORDER, "slice", "nth", F.element_at("edits", ((F.col("nth") - 1) % BLOCK + 1).cast("int")).alias("edit"),
                none.alias("role"), none.alias("text"))
    texts = rows.where("copies > 0").select(*CONV, *ORDER, F.lit(1 << 30).alias("slice"), F.lit(0).cast("long").alias("nth"), none.alias("edit"), "role", "text")
    hashes = sha256_in_order(edits.unionByName(texts), CONV, ORDER, [*CONV, *ORDER, "edit", "role", "text"], "\n", "repair-hashes", _lines, ["slice", "nth"])
    return repairs.where("lead").join(hashes, CONV, "left").select(
        F.when(F.col("named"), F.col("g")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
