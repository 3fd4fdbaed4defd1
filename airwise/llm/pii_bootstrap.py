r"""Operator 6, personal data: patterns of seed entities, bootstrapped over contexts.

Base spans.  Each kind's expression is matched over the whole text; the pieces between the matches
(``split``) and the matches themselves give every match's start by a running sum per row, in code
points.  Expressions are possessive and anchored at the start of a run, so very long runs are
matched in linear time and without deep recursion.  Validity (IP parts, digit counts, Luhn) is
tested on the match; failing matches are dropped, not retried.

Bootstrapping.  Every base match, and every other token that holds a digit, has ``min_length``
characters and touches no valid base match of its row (an identifier), is an instance.  Its lexical
patterns are the last word and the last ``context`` words before it and the first word after it,
lower-cased, each with the punctuation between word and value and without other instances between.
Seeds, with score 1, are the valid base matches and the identifiers assigned (= or :) to a cue word:
a name of a kind or of a secret.  The graph of distinct (pattern, instance) edges of all patterns is
stored in the shared folder and scored in rounds: a pattern's confidence is the mean score of its
distinct instances times its weight, provided that at least ``support`` of them score as personal; an
instance that is no seed gets the confidence of its best confident pattern.  The weight is the share
of the pattern's places next to instances among all its places in all texts, so a function word, which
mostly stands next to plain words, is never trusted.  Weights only lower confidences, so the rounds
run without them first and the texts are searched for the few patterns trusted then.  After the rounds, identifiers next to a pattern of ``confidence`` or more
are spans of kind ``id``.  The same identifier elsewhere is found only where its context is
confident too, since short numbers recur by chance.

Identifiers that touch a base span are found by running bounds over a row's spans in both orders.
Everything is built of DataFrame functions.  A hot pattern or instance is reduced by partial
aggregates over distinct edges, and joins on it are split by AQE.

Words next to a match are read up to 80 characters away; a word that crosses this bound is left out.

Rows: null text is empty; very long texts are read whole; repeated rows get a row each; a null doc_id stays null; extra columns are
ignored; an empty table gives an empty result.  Where nothing is found base_sha256 is the hash of
the empty string and spans the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airwise.llm.common import ascii_lower, beside, stored, text_keys, text_of, unpacked

KINDS = ("email", "ip", "card", "phone")
#: The kinds' expressions, with possessive repeats and starts at a run's first character.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<![A-Za-z0-9-])(?=[A-Za-z-]*+[0-9])[A-Za-z0-9-]++"
#: A character that every match of a kind holds; the others hold a digit.  Texts without it are not searched for the kind.
HOLDS = {"email": "@", "phone": "+"}
#: Characters of a text looked at for the words next to a match.
LOOK_BACK = 80
CONTEXT = 2
#: Names of kinds and of secrets that seed an identifier assigned to them.
CUES = ("apikey", "card", "email", "ip", "mail", "passwd", "password", "phone", "pwd", "secret", "tel", "token")
MIN_LENGTH = 6
SUPPORT = 3
CONFIDENCE = 0.8
ROUNDS = 3


def _may_match(kind: str, t: Column) -> Column:
    """Whether a text holds what every match of the kind has: a look for one character, before an expression is tried at each place."""
    return F.contains(t, F.lit(HOLDS[kind])) if kind in HOLDS else t.rlike("[0-9]")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    doubled = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    """Whether a match of a kind passes its test; digits and values are only read where the length allows it."""
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    ip = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(_digits(m))
    return F.when(kind == "email", True).when(kind == "ip", ip) \
        .when(kind == "card", F.when(n.between(14, 19), _luhn(m)).otherwise(False)) \
        .when(kind == "phone", n.between(10, 15)) \
        .otherwise((F.length(m) >= MIN_LENGTH) & m.rlike("[0-9]"))


def _marks(between: Column) -> Column:
    """Punctuation between a word and a value, a run of white space as one space."""
    return F.regexp_replace(between, r"\s+", " ")


def _patterns(left: Column, right: Column, context: int) -> Column:
    """patterns and cue of a match: its words with the punctuation next to it, and whether it is assigned to a cue word."""
    near = ascii_lower(F.substring(left, -LOOK_BACK, LOOK_BACK))
    near = F.when(F.length(left) > LOOK_BACK, F.regexp_replace(near, r"^[^\s\p{Punct}]++", "")).otherwise(near)
    words = F.array_remove(F.split(near, r"[\s\p{Punct}]+", -1), "")
    marks = _marks(F.regexp_extract(near, r"[\s\p{Punct}]*+$", 0))
    after = ascii_lower(F.when(F.length(right) > LOOK_BACK, F.substring(right, 1, LOOK_BACK)).otherwise(F.concat(right, F.lit(" "))))
    word = F.regexp_extract(after, r"^[\s\p{Punct}]*+([^\s\p{Punct}]++)(?=[\s\p{Punct}])", 1)
    of = lambda w, m: F.array(*[F.when(F.size(w) >= n, F.concat(F.lit(f"{n}<"), F.concat_ws(" ", F.slice(w, F.size(w) - (n - 1), F.lit(n))), m))
                                for n in sorted({1, context})],
                              F.when(word != "", F.concat(F.lit("1>"), _marks(F.regexp_extract(after, r"^[\s\p{Punct}]*+", 0)), word)))
    both = F.struct(words.alias("w"), marks.alias("m"))
    # the words of the piece are read once, as the variable of a list of one
    return F.get(F.transform(F.array(both), lambda x: F.struct(
        F.filter(of(x["w"], x["m"]), lambda p: p.isNotNull()).alias("patterns"),
        (F.coalesce(F.get(x["w"], F.size(x["w"]) - 1), F.lit("")).isin(*CUES) & x["m"].rlike("[=:]")).alias("cue"))), 0)


def _instances(k: int, kind: str, p: str, context: int):
    """The matches of a kind as structs, given the pieces between them."""
    def of(pieces: Column) -> Column:
        def match(m: Column, i: Column) -> Column:
            left = F.get(pieces, i)
            near = _patterns(left, F.get(pieces, i + 1), context)
            return F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), i.alias("i"), m.alias("m"), F.length(left).alias("glen"),
                            F.length(m).alias("mlen"), (F.when(F.length(m) >= MIN_LENGTH, near) if kind == "id" else near).alias("near"))
        return F.transform(F.regexp_extract_all("t", F.lit(p), F.lit(0)), match)
    return of


def matches(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """One row per match and one (kind null) per row without any: row, doc_id, th, tm, kind, k (its rank),
    s, e, m, patterns, cue, valid (an identifier that touches a valid base match is not).  Written once to
    the shared folder."""
    rows = docs.select("doc_id", text_of().alias("t")).select("doc_id", *text_keys(F.col("t")), "t") \
        .withColumn("row", F.monotonically_increasing_id())
    groups = []
    for k, (kind, p) in enumerate([*PATTERNS.items(), ("id", TOKEN)]):
        # the pieces between the matches are read once, as the variable of a list of one
        groups.append(F.when(_may_match(kind, F.col("t")) & F.col("t").rlike(p), F.get(F.transform(F.array(F.split("t", p, -1)), _instances(k, kind, p, context)), 0))
                      .otherwise(F.array().cast("array<struct<kind:string,k:int,i:int,m:string,glen:int,mlen:int,near:struct<patterns:array<string>,cue:boolean>>>")))
    flat = rows.select("row", "doc_id", "th", "tm", F.explode_outer(F.concat(*groups)).alias("x")).select("row", "doc_id", "th", "tm", "x.*")
    w = Window.partitionBy("row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = flat.repartition("row").withColumn("e", F.sum(F.col("glen") + F.col("mlen")).over(w)).withColumn("s", F.col("e") - F.col("mlen")) \
        .withColumn("valid", F.when(F.col("kind").isNotNull(), _valid(F.col("kind"), F.col("m"))))
    known = F.col("valid") & (F.col("kind") != "id")
    up = Window.partitionBy("row").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(F.desc("s"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    touches = F.coalesce(F.max(F.when(known, F.col("e"))).over(up) > F.col("s"), F.lit(False)) \
        | F.coalesce(F.min(F.when(known, F.col("s"))).over(down) < F.col("e"), F.lit(False))
    return stored(ends.withColumn("touches", touches).select(
        "row", "doc_id", "th", "tm", "kind", "k", "s", "e", "m", "near.patterns", "near.cue",
        F.when(F.col("kind") == "id", F.col("valid") & ~F.col("touches")).otherwise(F.col("valid")).alias("valid")), "pii-matches")


def _scored(edges: DataFrame, seeds: DataFrame, support: int, confidence: float, rounds: int) -> DataFrame:
    """(pattern, confidence) after the rounds, from edges (pattern, x, weight) and seeds (x, score)."""
    scores = seeds
    for r in range(rounds):
        seen = edges.join(scores, "x", "left").groupBy("pattern").agg(
            (F.avg(F.coalesce("score", F.lit(0.0))) * F.first("weight")).alias("confidence"),
            F.count(F.when(F.col("score") >= confidence, 1)).alias("known"))
        trusted = stored(seen.where((F.col("known") >= support) & (F.col("confidence") >= confidence)).select("pattern", "confidence"), "pii-patterns")
        if r + 1 < rounds:
            gained = edges.join(trusted, "pattern").groupBy("x").agg(F.max("confidence").alias("score"))
            scores = stored(seeds.union(gained).groupBy("x").agg(F.max("score").alias("score")), "pii-scores")
    return trusted


def plain_places(docs: DataFrame, patterns: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(pattern, plain): at how many places of all texts each of ``patterns`` stands next to a word that is in no match.

    Words are cut out of a text once.  The places of a text are numbers, and each place makes its pattern from the words around it, so
    no list of words is copied and a place is looked up by the whole pattern."""
    mark = "0" * MIN_LENGTH
    t = F.col("t")
    texts = docs.select(text_of().alias("t"))
    masked = lambda kind, p, may: F.when(may, F.regexp_replace("t", p, mark)).otherwise(t).alias("t")
    email, *others = [*PATTERNS.items(), ("id", TOKEN[:-2] + f"{{{MIN_LENGTH},}}+")]
    # a digit is looked for once: a mark has digits, so no text loses all of them
    texts = texts.select(masked(*email, _may_match(email[0], t))).select("t", t.rlike("[0-9]").alias("digit"))
    for kind, p in others:
        texts = texts.select(masked(kind, p, _may_match(kind, t) if kind in HOLDS else F.col("digit")), "digit")
    # where all characters are of one byte lower() changes A-Z alone
    lowered = texts.select(F.when(F.octet_length("t") == F.length("t"), F.lower("t")).otherwise(ascii_lower(t)).alias("t"))
    texts = lowered.select(F.regexp_replace("t", r"\s\s+|[\t\n\x0B\f\r]", " ").alias("t"))
    # the words, and what stands before, between and behind them
    word = r"[^\s\p{Punct}]++"
    words = texts.select(F.regexp_extract_all("t", F.lit(word), F.lit(0)).alias("w"), F.split("t", word, -1).alias("m")).withColumn("n", F.size("w"))
    counts = sorted({1, context})
    # no filter on the words: it would go down to the scan and make them twice
    rows = words.select("w", "m", "n", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") * (len(counts) + 1) - 1))).alias("i")) \
        .select("w", "m", "n", "i", (F.col("i") % F.col("n")).alias("a"))
    at, marks = lambda k: F.get("w", F.col("a") + k), F.get("m", F.col("a") + 1)
    plain = lambda c: c.isNotNull() & ~F.contains(c, F.lit(mark))
    key = F.when((F.col("i") < F.col("n")) & plain(at(0)), F.concat(F.lit("1>"), marks, at(1)))
    for j, n in enumerate(counts):
        before = [x for k in range(1 - n, 0) for x in (at(k), F.lit(" "))]
        key = key.when((F.col("i") >= F.col("n") * (j + 1)) & (F.col("i") < F.col("n") * (j + 2)) & plain(at(1)), F.concat(F.lit(f"{n}<"), *before, at(0), marks))
    # never null: a filter on null would make every pattern twice
    return rows.select(F.coalesce(key, F.lit("")).alias("pattern")).join(patterns.select("pattern"), "pattern", "left_semi") \
        .groupBy("pattern").agg(F.count(F.lit(1)).alias("plain"))


def confident_patterns(docs: DataFrame, found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence): the patterns that the scored graph trusts."""
    named = found.where("valid")
    seeds = named.where("kind <> 'id' OR cue").select(F.col("m").alias("x"), F.lit(1.0).alias("score")).distinct()
    places = named.select(F.explode("patterns").alias("pattern"), F.col("m").alias("x"))
    edges = stored(places.groupBy("pattern", "x").agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    first = _scored(edges.withColumn("weight", F.lit(1.0)), seeds, support, confidence, rounds).select("pattern")
    kept = edges.join(first, "pattern", "left_semi")
    inside = kept.groupBy("pattern").agg(F.sum("n").alias("inside"))
    weights = stored(inside.join(plain_places(docs, first), "pattern", "left")
                     .select("pattern", (F.col("inside") / (F.col("inside") + F.coalesce("plain", F.lit(0)))).alias("weight")), "pii-weights")
    return _scored(stored(kept.join(weights, "pattern"), "pii-edges"), seeds, support, confidence, rounds)


def spans(docs: DataFrame, **limits) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, th, tm, base (sorted (s, k, kind, e) structs) and all (with the discovered)."""
    found = matches(docs)
    trusted = confident_patterns(docs, found, **limits).select("pattern")
    ids = found.where("kind = 'id' AND valid").select("row", "s", "e", F.explode("patterns").alias("pattern")) \
        .join(trusted, "pattern", "left_semi").select("row", "s", "e").distinct()
    base = found.where("kind <> 'id' AND valid").select("row", "k", "kind", "s", "e")
    new = ids.select("row", F.lit(len(KINDS)).alias("k"), F.lit("id").alias("kind"), "s", "e")
    span = F.struct("s", "k", "kind", "e")
    per_row = base.unionByName(new).groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("kind") != "id", span))).alias("base"),
                                                       F.sort_array(F.collect_list(F.when(F.col("kind") == "id", span))).alias("new"))
    empty = F.array().cast("array<struct<s:bigint,k:int,kind:string,e:bigint>>")
    rows = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.first("tm").alias("tm"))
    return rows.join(per_row.select("row", "base", F.sort_array(F.concat("base", "new")).alias("all")), "row", "left") \
        .withColumn("base", F.coalesce("base", empty)).withColumn("all", F.coalesce("all", empty))


def _listed(xs: str) -> Column:
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans; a row per row of ``docs``."""
    found = spans(docs, **limits)
    return found.select("doc_id", *[_count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("all").alias("spans"), F.size("all").cast("long").alias("n_spans"))


def mask(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; all columns and all rows stay.

    Overlapping spans are merged and take the first one's kind.  ``n_chars``, where there is one, is
    counted anew for texts that changed."""
    found = spans(docs, **limits).where(F.size("all") > 0).dropDuplicates(["doc_id", "th", "tm"])
    first = F.struct(F.lit(0).cast("bigint").alias("to"), F.array().cast("array<struct<s:bigint,e:bigint,kind:string>>").alias("out"))
    piece = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))
    joined = F.aggregate("all", first, lambda a, x: F.when(x["s"] >= a["to"], F.struct(
        x["e"].alias("to"), F.concat(a["out"], F.array(piece(x))).alias("out"))).otherwise(F.struct(
            F.greatest(a["to"], x["e"]).alias("to"),
            F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1),
                     F.transform(F.slice(a["out"], F.size(a["out"]), F.lit(1)), lambda y: F.struct(
                         y["s"].alias("s"), F.greatest(y["e"], x["e"]).alias("e"), y["kind"].alias("kind")))).alias("out"))),
        lambda a: a["out"])
    rows = beside(docs, found.select("doc_id", "th", "tm", joined.alias("at")))
    at, t = F.col("at"), F.coalesce(F.col("doc").getField("text").cast("string"), F.lit(""))
    kept = F.transform(at, lambda x, i: F.concat(
        F.substring(t, (F.when(i == 0, 0).otherwise(F.get(at, i - 1)["e"]) + 1).cast("int"),
                    (x["s"] - F.when(i == 0, 0).otherwise(F.get(at, i - 1)["e"])).cast("int")),
        F.concat(F.lit("["), x["kind"], F.lit("]"))))
    tail = F.substring(t, (F.element_at(at, -1)["e"] + 1).cast("int"), F.length(t))
    return rows.select(*unpacked(docs, F.concat(F.array_join(kept, ""), tail), at.isNotNull()))
