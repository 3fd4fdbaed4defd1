"""Every training-data operator against an independent brute-force version, on the smallest tables and on
fixtures with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import functools
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

import __spark_entry__ as E
from airwise.llm import (bwt_dedup, conv_repair, conv_trie, decontam, license_scan, line_quality, lsh_forest, ordered, packing, pii_bootstrap, queries,
                         simhash_golay, toxicity_pu, url_lists, warc)
from airwise.llm.common import components, scratch_path
from tests.conftest import MEDIUM, SMALL

TALK = "conv_id long, turn long, role string, text string"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with results and with names inside the operators.
CLASH = ", score double, n_words long, fingerprint string, kept boolean, row long, th long, t string, first long, w string, batch long, `at` string" \
        ", removed string, _d long, _h string, _th long, _tm int, _at string, _keep long, doc string, own long, id long, host string, component_id long, k long, sig string, `set` string, u long"


def docs_of(spark, rows, clash=True):
    """(doc_id, text[, source]) rows as a documents table of several partitions."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) + ((None,) * (CLASH.count(",") if clash else 0)) for r in rows]
    return spark.createDataFrame(full, DOC + (CLASH if clash else "")).repartition(3)


def rows_of(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def edge_texts():
    rnd = random.Random(7)
    words = ["the", "MIT", "license", "a@b.co", "1.2.3.4", "Été", "x" * 40, "of", "GNU", "general", "public", "apache", "😀", "4111111111111111"]
    out = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "\n", "\nthe of the of\n"])) for i in range(60)]
    long = " ".join(rnd.choice(words) for _ in range(20000))
    return out + [(100, None), (101, ""), (102, " \n\t "), (103, long), (104, long), (105, out[3][1]), (105, out[3][1]), (106, out[3][1].upper()), (None, "the of"),
                  (107, "\n".join(["one line that comes again and again and again"] * 50)), (108, "a" * 100000), (109, "\0 nul \x1c sep")]


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def loose_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- every query with SQL, and empty tables -------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    rel = duck.sql(E.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    pos = [rel.columns.index(c) for c in cols]
    assert rows_of(df, cols) == sorted((tuple(r[i] for i in pos) for r in rel.fetchall()), key=repr)


def test_all_queries_and_the_pipeline_are_registered():
    names = E.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    talks = spark.createDataFrame([], TALK)
    for df in (conv_repair.repair(talks), conv_trie.trie(talks), lsh_forest.near_duplicates(docs), lsh_forest.keep_one(docs), license_scan.license_labels(docs), line_quality.line_quality(docs), line_quality.keep_good(docs), simhash_golay.near_duplicates(docs),
               simhash_golay.keep_one(docs), pii_bootstrap.personal_data(docs), pii_bootstrap.mask(docs), toxicity_pu.toxicity(docs, labels),
               packing.pack(docs, queries.tokenizer_path()), bwt_dedup.remove_repeats(docs), decontam.decontaminate(docs, bench),
               decontam.remove_contaminated(docs, bench), warc.roundtrip(pages), url_lists.pages_as_of(pages)):
        assert df.collect() == []


# ---- 1 WARC ---------------------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    rnd = random.Random(2)
    bits = ["a", "\r", "\n", "\r\n", "\r\n\r\n", "WARC/1.1\r\n", "é", "b" * 30]
    rows = [(i, f"http://x/{i}", "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for i in range(200)]
    rows += [(600, None, None), (601, "u", ""), (602, "u\r\nx", "q" * 150), (603, "u", "q" * 150), (604, "u", "q" * 150), (604, "u", "q" * 150),
             (605, "u", "z" * 99), (606, "u", "z" * 99), (None, "u", "hello"), (607, "u", "x" * 1_000_000)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "page_id long, url string, html string, payload_digest string, n long").repartition(4)
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = sorted(((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if first.get(h, i) != i else "response",
                    first[h] if first.get(h, i) != i else None) for i, _, h in rows), key=repr)
    assert rows_of(warc.roundtrip(df), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]) == want


def test_warc_index_reaches_single_members(spark):
    df = spark.read.parquet(f"{SMALL}/pages.parquet").repartition(3)
    source, target = scratch_path(spark, "t-mono"), scratch_path(spark, "t-members")
    warc.write_monolithic(warc.with_revisits(df), source)
    warc.normalise(spark, source, target)
    index = warc.read_index(spark, target).collect()
    assert len(index) == df.count()
    for x in index:
        data = open(re.sub("^file:/*", "/", x.archive), "rb").read()
        z = zlib.decompressobj(31)
        assert x.record_id.encode() in z.decompress(data[x.offset:x.offset + x.length]) and z.eof and not z.unused_data
    whole = gzip.decompress(data)  # an ordinary reader sees ordinary members
    assert whole.startswith(b"WARC/1.1\r\n")


def test_warc_pieces_and_broken_streams():
    assert list(warc.split_records(iter([b"WARC/1.1\r\nContent-Length: 3", b"a", b"", b"WARC/1.1\r\nContent-Length: 0", b""]))) == [
        b"WARC/1.1\r\nContent-Length: 3\r\n\r\na\r\n", b"WARC/1.1\r\nContent-Length: 0\r\n\r\n"]
    with pytest.raises(ValueError):
        list(warc.split_records(iter([b"WARC/1.1\r\nContent-Length: 9", b"a"])))
    assert warc.SYNC not in warc.member(warc.SYNC * 50) and gzip.decompress(warc.SYNC) == b""


def test_warc_index_members_leave_while_the_stream_is_read():
    n, read = 3 * warc.LINES_PER_MEMBER + 7, []

    def batches():
        for a in range(0, n, 100):
            read.append(a)
            few = range(a, min(n, a + 100))
            block = [random.Random(k).randbytes(3000) for k in few]  # enough bytes for several batches of members
            yield pd.DataFrame({"file": "a", "value": [x for k, b in zip(few, block) for x in (
                f"WARC/1.1\r\nWARC-Record-ID: <{k}>\r\nContent-Length: {len(b)}".encode(), b)]})

    lines, early = [], 0
    for out in warc._rewrite(batches()):
        assert out["seq"][out["kind"] == "index"].is_monotonic_increasing
        for v in out["value"][out["kind"] == "index"]:
            early += read[-1] + 100 < n
            lines += gzip.decompress(v).decode().removesuffix(warc.BLANK).split("\n")
    assert [x.split('"')[1] for x in lines] == [f"<{k}>" for k in range(n)] and early


# ---- 2 licences -----------------------------------------------------------------------------------------

def test_license_scan_against_brute_force(spark):
    rows = edge_texts() + [(300, "Permission is granted, hereby, free of charge to any person: obtaining copy of this software and associated files"),
                           (301, "all\nrights reserved"), (304, "these rights are of all users and none is reserved"),
                           (305, "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files"),
                           (306, "Redistribution and use in source and binary forms, with or without modification,\n * are permitted provided that the\n\n * following conditions are met:"),
                           (307, "filler of the license " * 80 + "redistribution and use in source and binary forms with or without any permitted provided that the following conditions are " + "x " * 300),
                           (302, "MIT\nLicense and mit-license MIT License license mit license"), (303, "released under the MIT licence")]
    got = {(r["doc_id"], r["n_words"]): r for r in license_scan.license_labels(docs_of(spark, rows)).collect()}
    known = [(label, set(t.split()), math.ceil(len(t.split()) / 0.8)) for label, ts in license_scan.TEMPLATES.items() for t in ts]
    for i, t in rows:
        w = loose_words(t)
        spots = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        best, theirs = 0.0, set()
        for label, words, span in known:
            shared = max((len(set(w[k:k + span]) & words) for k in range(len(w))), default=0)
            if shared >= 0.8 * len(words) - 1e-9:
                theirs.add(label)
                best = max(best, shared / len(words))
        r = got[(i, len(w))]
        starts = [k for k, _ in spots]
        assert (r.n_base, r.first_word, r.last_word) == (len(spots), min(starts, default=None), max(starts, default=None)), i
        assert r.base_labels == ",".join(sorted({x for _, x in spots})) and r.labels == ",".join(sorted({x for _, x in spots} | theirs))
        assert r.score == (1.0 if spots else best)
    assert license_scan.license_labels(docs_of(spark, rows)).count() == len(rows)
    labels = {i: r.labels for (i, _), r in got.items()}
    assert [labels[i] for i in (301, 304, 305, 306, 307)] == ["arr", "", "mit", "bsd", "bsd"]


# ---- 3 quality ------------------------------------------------------------------------------------------

def brute_quality(rows):
    host_docs, line_docs = {}, {}
    norm = lambda x: " ".join(plain_words(ascii_lower(x)))
    for i, t, h in rows:
        host_docs.setdefault(h, set()).add(t or "")
        for x in (t or "").split("\n"):
            if norm(x):
                line_docs.setdefault((h, norm(x)), {}).setdefault(t, []).append(i)
    often = {k: min((i for ids in d.values() for i in ids if i is not None), default=None) for k, d in line_docs.items() if len(d) > min(20, max(5, 0.2 * len(host_docs[k[0]])))}
    out = []
    for i, t, h in rows:
        t = t or ""
        w = plain_words(t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            dup += x in seen and bool(plain_words(x))
            seen.add(x)
        spots = {}
        for k in range(len(w) - 7):
            spots.setdefault(tuple(w[k:k + 8]), []).append(k)
        rep = len({k + j for ks in spots.values() if len(ks) > 1 for k in ks for j in range(8)})
        gone = sum(len(plain_words(x)) for x in t.split("\n") if (h, norm(x)) in often and often[(h, norm(x))] != i)
        failed = len(w) < 20 or 100 * rep > 30 * len(w)
        left = len(w) - gone
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, failed, not failed and (not gone or (left >= len(w) / 2 and left >= 20)), gone))
    return sorted(out, key=repr)


def test_line_quality_against_brute_force(spark):
    rows = [(*r, ["s", None, "u"][k % 3]) for k, r in enumerate(edge_texts())]
    prose = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows += [(1000 + k, f"Home | About us\n{prose(k)}\n  home |  ABOUT us ", "site") for k in range(40)]
    rows += [(2000 + k, f"word{k}\nmenu of the site with a lot of words in it that is on all of the pages of the host of course", "site") for k in range(60)]
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed"]
    want = brute_quality(rows)
    assert rows_of(line_quality.line_quality(docs_of(spark, rows)), cols) == want
    assert any(r[-1] for r in want) and any(not r[6] and not r[7] for r in want)
    kept = line_quality.keep_good(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted({repr(r[0]) for r in want if r[7]} | set()) or \
        {r["doc_id"] for r in kept.collect()} == {r[0] for r in want if r[7]}
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert "Home" in texts[1000] and "Home" not in texts[1001] and prose(1) in texts[1001]


@pytest.mark.parametrize("copies", [21, 90, 300])
def test_a_line_in_a_small_part_of_a_large_host_is_template(spark, copies):
    """1 to 15 % of a host of 2,000 documents; 20 documents are not above the limit."""
    prose = lambda k: " ".join(f"w{k}x{j}" for j in range(25))
    rows = [(k, prose(k) + ("\nall rights of the site reserved" if k < copies else "\nread more of it here" if k < copies + 20 else ""), "big") for k in range(2000)]
    got = {r.doc_id: (r.n_removed, r.kept) for r in line_quality.line_quality(docs_of(spark, rows, False)).collect()}
    assert {i for i, (n, _) in got.items() if n} == set(range(1, copies)) and all(k for _, k in got.values())


# ---- 4 SimHash ------------------------------------------------------------------------------------------

def brute_fingerprint(t):
    w = plain_words(ascii_lower(t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[a:a + 3]).encode(), 42) for a in range(len(w) - 2)] or ([xxhash.xxh64_intdigest(" ".join(w).encode(), 42)] if w else [])
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for a in range(len(nodes)):
        for b in range(a):
            if linked(nodes[a], nodes[b]):
                x, y = sorted((find(nodes[a]), find(nodes[b])))
                root[y] = x
    return {x: find(x) for x in nodes}


def test_simhash_against_brute_force(spark):
    rows = [r for r in edge_texts() if r[0] is not None]
    base = " ".join(f"tok{j}" for j in range(400))
    rows += [(500 + k, base + f" end{k}") for k in range(30)]
    got = simhash_golay.near_duplicates(docs_of(spark, rows)).collect()
    fp = [(i, brute_fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in fp})
    root = brute_components(distinct, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in fp:
        least[root[f]] = min(i, least.get(root[f], i))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", least[root[f]]) for i, f in fp)
    one = [r.doc_id for r in simhash_golay.keep_one(docs_of(spark, rows)).collect()]
    assert sorted(one) == sorted(set(least.values()))


@pytest.mark.parametrize("dense", [2, 16, 1000])
def test_simhash_links_all_routes(spark, dense):
    rnd = random.Random(dense)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    fps = {0, (1 << 64) - 1} | {c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (rnd.random() < .3) for c in centres for _ in range(12)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    edges = simhash_golay.links(spark.createDataFrame([(x,) for x in signed], "fp long"), dense=dense)
    got = {r.node: r.root for r in components(edges).collect()}
    want = brute_components(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    group = {}
    for x in signed:
        group.setdefault(want[x], set()).add(x)
    for members in group.values():
        assert {got.get(x, x) for x in members} == {min(members)}


def test_golay_keys_meet_within_two_bits():
    table = simhash_golay.error_table()
    assert sorted(set((table >= 0).sum(1))) == [1, 6]
    rng = np.random.default_rng(0)
    x = rng.integers(-2 ** 63, 2 ** 63 - 1, 3000)
    flip = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False)) for _ in x]
    y = (x.view(np.uint64) ^ np.array(flip, np.uint64)).view(np.int64)
    keys = []
    for v in (x, y):
        r, k = simhash_golay.golay_keys(v)
        keys.append([set(k[r == i].tolist()) for i in range(len(v))])
    assert all(a & b for a, b in zip(*keys))


# ---- 5 lists --------------------------------------------------------------------------------------------

def test_temporal_list_join(spark):
    import datetime as dt

    day = dt.date.fromisoformat
    entries = [("bad.com", day("2024-01-05"), "block"), ("bad.com", day("2024-01-10"), "remove"), ("bad.com", day("2024-01-10"), "allow"), ("x.bad.com", day("2024-01-06"), "allow"),
               ("x.bad.com", day("2024-01-08"), "remove"), ("x.bad.com/ads", day("2024-01-01"), "block"), (None, day("2024-01-01"), "block"), ("bad.com", None, "block"),
               ("bad.com", day("2024-01-07"), "odd")]
    caps = [(1, "http://x.bad.com/ads/1", day("2024-01-03")), (2, "http://x.bad.com/p", day("2024-01-05")), (3, "HTTP://u:p@X.bad.com:80/p", day("2024-01-07")),
            (4, "http://x.bad.com/p", day("2024-01-09")), (5, "http://bad.com", day("2024-01-10")), (6, None, day("2024-01-10")), (7, "bad.com", day("2024-01-06")),
            (8, "http://bad.com/", None), (9, "http://" + "a." * 200 + "bad.com/", day("2024-01-06")), (1, "http://x.bad.com/ads/1", day("2024-01-03"))]
    got = url_lists.as_of(spark.createDataFrame([(*c, None) for c in caps], "page_id long, url string, fetched date, verdict string"),
                          spark.createDataFrame(entries, "key string, day date, action string"))
    assert rows_of(got, ["page_id", "n_active", "matched_key", "verdict"]) == sorted(
        [(1, 1, "x.bad.com/ads", "block"), (1, 1, "x.bad.com/ads", "block"), (2, 1, "bad.com", "block"), (3, 2, "x.bad.com", "allow"), (4, 1, "bad.com", "block"),
         (5, 1, "bad.com", "allow"), (6, 0, None, "none"), (7, 0, None, "none"), (8, 0, None, "none"), (9, 0, None, "none")], key=repr)


# ---- 6 personal data ------------------------------------------------------------------------------------

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, (kind, p) in enumerate(PII.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if j % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for j, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_personal_data_base_spans(spark):
    rnd = random.Random(5)
    bits = ["a", "b9", "@", "x.y", ".", "1", "2", "255", "256", "007", ".", "-", " ", "+", "(", ")", "4111111111111111", "1.2.3.4", "_", "%", "é", "\n", "+1 (377) 555-0271", "a@b.c"]
    rows = edge_texts() + [(1000 + k, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))) for k in range(400)]
    rows += [(2002, "1" * 50000), (2003, "a.b@" + "a." * 20000 + "x"), (2004, "1-" * 30000), (2005, "+1" + " 2" * 30000), (2006, "😀 a@b.co 😀 1.2.3.4"), (2007, "x-" * 50000)]
    got = {}
    for r in pii_bootstrap.personal_data(docs_of(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        b = brute_spans(t)
        listed = [f"{kind}:{s}:{e}" for s, _, kind, e in b]
        for r in got[i]:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[2] == k for x in b) for k in PII), (i, t[:200])
            assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
            assert [x for x in r.spans.split(",") if x and not x.startswith("id:")] == listed


def test_personal_data_learns_contexts(spark):
    rows = [(k, f"words here {w} contact me {w}{k}@ex.com now and then") for k, w in enumerate("abcdefghijklmnop")]
    rows += [(100, "contact me user77xk9 soon"), (101, "contact me on monday"), (102, "the version 20240101 of it"), (103, "lucky number 1234567 here")]
    got = {r.doc_id: r.spans for r in pii_bootstrap.personal_data(docs_of(spark, rows)).collect()}
    assert got[100] == "id:11:20" and got[101] == got[102] == got[103] == ""
    masked = {r.doc_id: r.text for r in pii_bootstrap.mask(docs_of(spark, rows)).collect()}
    assert masked[100] == "contact me [id] soon" and masked[0] == "words here a contact me [email] now and then" and masked[102] == rows[-2][1]


def test_personal_data_backs_off_and_looks_right(spark):
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(6)]
    rows = [(k, f'x{"abcdef"[k]}q any{"uvwxyz"[k]} token = "{h}" then{"ghijkl"[k]}') for k, h in enumerate(hexes)]  # one word on the left, each with another before it
    rows += [(100 + k, f"{w}a {w}b {w}{k}@ex.com wrote on {w}c") for k, w in enumerate("abcdefgh")]  # the word on the right
    rows += [(200, "pq rs user77xk9 wrote it"), (201, "a token of version 20240101 x"), (202, "lucky number 1234567 here")]
    got = {r.doc_id: r.spans for r in pii_bootstrap.personal_data(docs_of(spark, rows)).collect()}
    for (k, t), h in zip(rows, hexes):
        assert got[k] == f"id:{t.index(h)}:{t.index(h) + 40}"
    assert got[200] == "id:6:15" and got[201] == got[202] == ""


def brute_identifiers(rows):
    """Per row the identifiers that the bootstrapped graph finds: plain loops over places, patterns and instances."""
    gap = r"[ \t\n\x0b\f\r" + re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + "]"
    solid = gap.replace("[", "[^", 1)
    kinds = [*PII.items(), ("id", r"(?<![A-Za-z0-9-])(?=[A-Za-z-]*+[0-9])[A-Za-z0-9-]++")]
    one = lambda m: re.sub(r"[ \t\n\x0b\f\r]+", " ", m)
    edges, places, seeds, found, plain = {}, {}, set(), [], {}
    for row, (_, t) in enumerate(rows):
        t = t or ""
        base = [(s, e, kind) for s, _, kind, e in brute_spans(t)]
        for kind, expression in kinds:
            end, ms = 0, list(re.finditer(expression, t))
            for k, m in enumerate(ms):
                left, right = t[end:m.start()], t[m.end():ms[k + 1].start() if k + 1 < len(ms) else len(t)]
                end = m.end()
                if kind == "id" and (len(m[0]) < 6 or any(s < m.end() and m.start() < e for s, e, _ in base)) or kind != "id" and (*m.span(), kind) not in base:
                    continue
                near, after = ascii_lower(left[-80:]), ascii_lower(right[:80])
                if len(left) > 80:
                    near = re.sub("^" + solid + "+", "", near)
                words, marks = re.findall(solid + "+", near), one(re.search(gap + "*$", near)[0])
                mine = {f"{n}<" + " ".join(words[-n:]) + marks for n in (1, 2) if len(words) >= n}
                w = re.match(f"({gap}*)({solid}+)", after)
                if w and not (len(right) > 80 and w.end() == 80):
                    mine.add("1>" + one(w[1]) + w[2])
                for x in mine:
                    edges.setdefault(x, set()).add(m[0])
                    places[x] = places.get(x, 0) + 1
                if kind != "id" or words and words[-1] in pii_bootstrap.CUES and re.search("[=:]", marks):
                    seeds.add(m[0])
                if kind == "id":
                    found.append((row, m.start(), m.end(), mine))
        for expression in [*PII.values(), kinds[-1][1][:-2] + "{6,}+"]:
            t = re.sub(expression, "000000", t)
        w = re.findall(f"({solid}+)({gap}*)", ascii_lower(t))
        for k, (x, marks) in enumerate(w):
            if "000000" not in x:
                near = [f"1<{w[k - 1][0]}{one(w[k - 1][1])}"] if k else []
                near += [f"2<{w[k - 2][0]} {w[k - 1][0]}{one(w[k - 1][1])}"] if k > 1 else []
                near += [f"1>{one(marks)}{w[k + 1][0]}"] if k + 1 < len(w) else []
                for p in near:
                    plain[p] = plain.get(p, 0) + 1
    scores = dict.fromkeys(seeds, 1.0)
    for _ in range(3):
        trusted = {}
        for p, xs in edges.items():
            c = sum(scores.get(x, 0.0) for x in xs) / len(xs) * places[p] / (places[p] + plain.get(p, 0))
            if sum(scores.get(x, 0.0) >= 0.8 for x in xs) >= 3 and c >= 0.8:
                trusted[p] = c
        scores = dict.fromkeys(seeds, 1.0)
        for p, c in trusted.items():
            scores.update({x: max(c, scores.get(x, 0.0)) for x in edges[p]})
    return trusted, sorted((row, s, e) for row, s, e, mine in found if mine & trusted.keys())


def test_personal_data_graph_against_brute_force(spark):
    rnd = random.Random(11)
    hexes = [hashlib.sha1(str(k).encode()).hexdigest()[:rnd.choice([8, 20, 40])] for k in range(60)]
    values = [*hexes, "a.b@c.de", "x9@y.org", "10.0.0.1", "+1 (377) 555-0271", "4111111111111111", "1990", "plain"]
    fill = ["of", "the", "to", "mail", "z" * 90, "call,", "user-77-abc", "Über", "at\n", "12"]
    shapes = ['token = "{}" then', "contact {} now", "the {} of", "my id: {};", "see ({}) to", "password:{} x"]
    rows = edge_texts() + [(1000 + k, " ".join(rnd.choice([rnd.choice(fill), rnd.choice(shapes).format(rnd.choice(values))]) for _ in range(rnd.randint(0, 25)))) for k in range(150)]
    rows += [(2000 + k, f"the of the {w} to the of") for k, w in enumerate(["it", "12", "an 1.2.3.4", "b@c.de", "code 77aabb11"] * 4)]
    trusted, want = brute_identifiers(rows)
    got = [(tuple(map(int, x.split(":")[1:])), r.doc_id) for r in pii_bootstrap.personal_data(docs_of(spark, rows)).collect() for x in r.spans.split(",") if x.startswith("id:")]
    assert sorted(((i is None, i or 0), se) for se, i in got) == sorted(((rows[k][0] is None, rows[k][0] or 0), (s, e)) for k, s, e in want)
    assert len(want) > 50 and '1<token = "' in trusted and not trusted.keys() & {"1<the ", "1> of"}


def test_personal_data_does_not_trust_function_words(spark):
    """Words that stand before few harmless numbers, but mostly before plain words, are no evidence."""
    rows = [(k, f"write to {w}{k}@ex.com about the {w} and go to work or to {w} on foot") for k, w in enumerate("abcdefgh")]
    rows += [(100, "he came to 1234567 of them"), (101, "write to user77xk9 soon")]
    got = {r.doc_id: r.spans for r in pii_bootstrap.personal_data(docs_of(spark, rows)).collect()}
    assert got[100] == "" and got[101] == "id:9:18"  # "write to " is evidence, "to " is not


def test_plain_places_are_made_from_one_list_of_words(spark):
    """Counts by hand (texts without @, + or digits are not searched for matches); words are cut out once and only numbers of places are exploded."""
    docs = docs_of(spark, [(1, "Go  to the\nend, to the x@y.com to the 1234567 of"), (2, "to the"), (3, "É to the end, a +1 (377) 555-0271 of it"), (4, None), (5, "")])
    wanted = ["1<to ", "2<to the ", "2<é to ", "1>, to", "1> end", "1<the ", "1> of", "1<a ", "1<never "]
    found = pii_bootstrap.plain_places(docs, spark.createDataFrame([(p,) for p in wanted], "pattern string"))
    assert {r.pattern: r.plain for r in found.collect()} == {"1<to ": 5, "2<to the ": 2, "1>, to": 1, "1> end": 2, "1<the ": 2}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(") == 1 and plan.count("regexp_extract_all(") == 1 and "arrays_zip" not in plan


def test_mask_merges_and_keeps_rows(spark):
    rows = [(1, "hi a@b.c, 1.2.3.4 é+1 (377) 555-0271!"), (1, "hi a@b.c, 1.2.3.4 é+1 (377) 555-0271!"), (2, None), (None, "x")]
    df = docs_of(spark, rows)
    got = pii_bootstrap.mask(df)
    assert got.columns == df.columns
    assert rows_of(got, ["doc_id", "text"]) == sorted([(1, "hi [email], [ip] é[phone]!")] * 2 + [(2, None), (None, "x")], key=repr)


# ---- 7 toxicity -----------------------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(3)
    stems = ["vil", "gros", "naf"]
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice("abcdefgh") + rnd.choice(["ta", "ro", "mi", "ne"]) * rnd.randint(1, 3) for _ in range(rnd.randint(5, 80))]
        toxic = i % 8 == 0
        for _ in range(2 * toxic):
            w[rnd.randrange(len(w))] = rnd.choice(stems) + rnd.choice(["ta", "ro", "mi", "ne", "pu"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "x"), (3, rows[3][1])]
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity_pu.toxicity(docs_of(spark, rows), lb).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 2000]
    hit = [r for r in held if r.predicted]
    assert sum(r.doc_id % 8 == 0 for r in hit) >= 0.9 * len(hit) and sum(r.doc_id % 8 == 0 for r in hit) >= 0.8 * sum(r.doc_id % 8 == 0 for r in held)
    # labels of held-out rows don't matter
    other = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = toxicity_pu.toxicity(docs_of(spark, rows), other)
    assert {(r.doc_id, round(r.score, 9)) for r in again.collect()} == {(r.doc_id, round(r.score, 9)) for r in got}


# ---- 8 packing ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 5, 300, 20000])
def test_plan_uses_every_piece_once(n):
    rng = np.random.default_rng(n)
    counts = {}
    for length in rng.integers(1, 1025, n).tolist():
        counts[length] = counts.get(length, 0) + 1
    used, sequences = {}, 0
    for combo, m in packing.plan(counts):
        assert sum(combo) <= 1024 and m > 0
        sequences += m
        for length in combo:
            used[length] = used.get(length, 0) + m
    assert used == counts
    assert sequences <= 1.06 * -(-sum(k * v for k, v in counts.items()) // 1024) + 20


def test_exact_complements_come_first():
    assert sorted(packing.plan({1000: 3, 24: 2, 14: 1, 10: 1})) == [((1000, 14, 10), 1), ((1000, 24), 2)]
    assert packing.plan({900: 1, 60: 1, 40: 1, 24: 1}) == [((900, 60, 40, 24), 1)]


def test_packing_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    of = Tokenizer.from_file(queries.tokenizer_path())
    big = 2 ** 60 + 1
    rows = edge_texts() + [(big, "double  spaces   and <|endoftext|> 中文 ½²ª don't\r\n\r\n")]
    got = packing.pack(docs_of(spark, rows), queries.tokenizer_path()).collect()
    pieces, places = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.piece, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for i, t in rows:
        ids = np.array(of.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want.setdefault(i, []).extend((a, b - a, k, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024


# ---- 9 repeats ------------------------------------------------------------------------------------------

def brute_repeats(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for a in range(len(b) - n + 1):
                w = b[a:a + n]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for a in range(len(b) - n + 1):
                if first[b[a:a + n]] < i:
                    gone[a:a + n] = b"\1" * n
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


REPEATS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_repeats_against_brute_force(spark):
    rnd = random.Random(1)
    phrases = ["".join(rnd.choice("abcdé \0") for _ in range(rnd.randint(20, 90))) for _ in range(25)]
    rows = [(rnd.randint(0, 300), "".join(rnd.choice(phrases)[rnd.randint(0, 8):] if rnd.random() < .7 else "".join(rnd.choice("abcdefgh ") for _ in range(40))
                                          for _ in range(rnd.randint(0, 8)))) for _ in range(200)]
    rows += [(400, None), (401, ""), (402, "x" * 49), (403, "x" * 50), (404, "y" * 9000), (405, "y" * 5000 + "z" + "y" * 60), (406, "ab" * 3000), (407, "ba" * 100),
             (408, "same text " * 20), (408, "same text " * 20), (409, "same text " * 20), (None, "same text " * 20)]
    assert rows_of(bwt_dedup.remove_repeats(docs_of(spark, rows)), REPEATS) == brute_repeats(rows)


def test_repeats_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(E.queries()["op9_bwt_dedup"](spark, SMALL), REPEATS) == want


def hot_name_rows():
    """Documents that hold one string in different surroundings, some of them shared."""
    rnd = random.Random(6)
    side = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40))
    sides = [side() for _ in range(50)]
    return [(k, (rnd.choice(sides) if k % 9 == 0 else side()) + "This very sentence stands in all of them." + (rnd.choice(sides) if k % 7 == 0 else side()))
            for k in range(12000)]


def told(names, kinds, limit):
    """What a batch is told of its names: frames of ``_names_of`` answered bucket by bucket."""
    out = []
    for b, mine in names.groupby("bucket"):
        shared = bwt_dedup._shared_in_bucket(limit)(mine)
        out += [(5, kind, b, None, x) for kind, c in zip(kinds, ("names", "hot")) for x in shared[c] if x]
    return out


def strings_sent(rows, buckets, length=50):
    """One batch through names, second names and strings, in this process: the batch's frame and what it sends."""
    texts = pd.DataFrame({"batch": 5, "doc_id": [k for k, _ in rows], "t": [t.encode() for _, t in rows]})
    columns = ["batch", "kind", "bucket", "ids", "data"]
    frame = pd.concat([*bwt_dedup._pack_texts(iter([texts])), pd.DataFrame([(5, 2, 0, texts["doc_id"].tolist(), None)], columns=columns)])
    asked = told(pd.concat(bwt_dedup._names_of(8, length)(iter([texts]))), (1, 4), bwt_dedup.NAME_BYTES)
    hot = pd.concat([frame, pd.DataFrame(asked, columns=columns)])
    asked += told(bwt_dedup._fine_names_of(8, 8, length)(hot), (5, 6), bwt_dedup.FINE_BYTES)
    return frame, bwt_dedup._strings_of(8, 8, buckets, length)(pd.concat([frame, pd.DataFrame(asked, columns=columns)]))


def test_a_hot_name_is_dealt_to_many_buckets():
    buckets = 64
    _, sent = strings_sent(hot_name_rows(), buckets)
    sent = sent[sent["kind"] != 1]
    raw = sent["data"].map(lambda x: len(bwt_dedup._unpack(x, *[""] * 9)[-1])).groupby(sent["bucket"]).sum()
    assert len(raw) == buckets and raw.max() < 3 * raw.mean()


@pytest.mark.parametrize("limit, fine, kinds", [(0, 0, {2}), (0, 1 << 40, {4}), (3000, 3000, {0, 2, 4})])
def test_hot_names_by_second_names_and_windows(monkeypatch, limit, fine, kinds):
    """With a small limit all names, or the larger ones, take the second name, and the larger of those go by windows; rows stay those of brute force."""
    monkeypatch.setattr(bwt_dedup, "NAME_BYTES", limit)
    monkeypatch.setattr(bwt_dedup, "FINE_BYTES", fine)
    monkeypatch.setattr(bwt_dedup, "WINDOW_BYTES", 4000)
    rnd = random.Random(9)
    lines = ["".join(rnd.choice("abc \0") for _ in range(rnd.randint(5, 30))) + "\n" for _ in range(12)]
    rows = [(k, "".join(rnd.choice(lines) for _ in range(rnd.randint(1, 30)))) for k in range(150)]
    rows += [(k, t) for k, t in hot_name_rows()[:400] if k >= 150] + [(900, "y" * 9000), (901, "y" * 60), (902, "ab" * 500)]
    rows = list({t: (k, t) for k, t in reversed(rows)}.values())  # the search sees one document of each text
    frame, sent = strings_sent(rows, 7)
    assert set(sent["kind"]) - {1} == kinds
    gone = pd.concat([bwt_dedup._settle(50)(mine) for _, mine in sent.groupby("bucket")])
    cut = bwt_dedup._cut_out(pd.concat([frame, gone[gone["batch"] == 5]]))
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in cut.itertuples()}
    want = {i: (removed, spans, sha) for i, _, removed, spans, sha in brute_repeats(rows) if removed}
    assert {i: x for i, x in got.items() if x[0]} == want


def test_a_hot_name_against_brute_force(spark):
    rows = hot_name_rows()
    rows += [(12000, rows[3][1]), (12000, rows[4][1]), (12001, rows[3][1][:70]), (None, rows[5][1])]
    assert rows_of(bwt_dedup.remove_repeats(docs_of(spark, rows)), REPEATS) == brute_repeats(rows)


def test_interval_expansion_finds_equal_windows():
    rnd = random.Random(4)
    strings = [bytes(rnd.choice(b"ab\0\xff") for _ in range(rnd.randint(50, 80))) for _ in range(60)]
    strings += [strings[0][5:] + strings[1], strings[2] * 2, b"a" * 120]
    group, owner, offset = bwt_dedup.equal_windows(strings)
    by = {}
    for g, s, o in zip(group.tolist(), owner.tolist(), offset.tolist()):
        by.setdefault(g, set()).add(strings[s][o:o + 50])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({strings[s][o:o + 50] for s, o in zip(owner, offset)})
    assert len(group) == sum(len(s) - 49 for s in strings)


# ---- 10 decontamination ---------------------------------------------------------------------------------

def test_decontamination_against_brute_force(spark):
    rnd = random.Random(8)
    vocab = [f"w{k}" for k in range(6)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 25)))) for k in range(30)]
    items += [(50, None), (51, ""), (52, "One two"), (52, "One two"), (53, "été"), (None, "three four five"), (54, " ".join(["w1"] * 14))]
    rows = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for k in range(80)] + edge_texts()
    rows += [(900 + k, "x y " + (t or "") + " z, one... TWO") for k, (_, t) in enumerate(items)] + [(990, "w1 " * 5000), (991, "three four  five"), (991, "three four  five"), (992, "ÉTÉ été")]
    bench = spark.createDataFrame([(*x, None) for x in items], "item_id long, text string, win string")
    windows = {}
    for i, t in items:
        w = loose_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add("" if i is None else str(i))
    want = []
    for i, t in rows:
        w = loose_words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = docs_of(spark, rows)
    assert rows_of(decontam.decontaminate(docs, bench), cols) == sorted(want, key=repr)
    assert rows_of(decontam.decontaminate(docs, bench, block=40), cols) == sorted(want, key=repr)  # several broadcast blocks
    clean = decontam.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)


# ---- 11 structure repair --------------------------------------------------------------------------------

def least_repair(rows):
    """(cost, audit, lines) by a plain table from the last row to the first; rows (initial, fault, role, text)."""
    after, made = {0: 2, 1: 2, 2: 3, 3: 2}, {0: "user", 1: "user", 2: "assistant", 3: "user"}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    low = lambda found: min(found, key=lambda z: z[:2])

    def inserted(table):
        out = {}
        for state in range(4):
            found, cur, pre, lines = [], state, "", ()
            for k in range(4):
                if cur in table:
                    c, a, x = table[cur]
                    found.append((c + 2 * k, pre + a, lines + x))
                pre, lines, cur = pre + "I", lines + (made[cur] + ":",), after[cur]
            if found:
                out[state] = low(found)
        return out

    table = inserted({0: (0, "", ()), 3: (0, "", ())})
    for initial, fault, role, text in reversed(rows):
        here = {}
        for state in range(4):
            ways = [(3, "D", state, ())]
            if fault not in ("blank", "duplicate"):
                cut = int(fault == "truncated")
                ways += [(cut, "K", keep[state, initial], (f"{role}:{text}",))] if (state, initial) in keep else []
                ways.append((2 + cut, "R", after[state], (f"{made[state]}:{text}",)))
            found = [(w + table[t][0], e + table[t][1], x + table[t][2]) for w, e, t, x in ways if t in table]
            if found:
                here[state] = low(found)
        table = inserted(here)
    return table[0]


def brute_repair(rows):
    convs = {}
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        convs.setdefault(c, []).extend([] if k == 0 else [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1))
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda z: (z[0] is not None, z[0] or 0))
        numbers = {t for t, _, _ in turns if t is not None}
        seen, coded = set(), []
        for _, r, x in turns:
            w = x.strip(" \t\n\x0b\x0c\r")
            coded.append((r[:1], "blank" if not w else "duplicate" if (r, x) in seen else None if w[-1] in ".!?" else "truncated", r, x))
            seen.add((r, x))
        n = lambda f: sum(z[1] == f for z in coded)
        cost, audit, lines = least_repair(coded)
        out.append((c, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, n("blank"), n("duplicate"), n("truncated"),
                    sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


REPAIRED = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_bidirectional_search_finds_the_least_audit():
    rnd = random.Random(11)
    for k in range(3000):
        rows = [(rnd.choice("suaax" if k % 2 else "uauaua"), rnd.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(rnd.randint(0, 60 if k % 50 == 0 else 9))]
        codes = [4 * [None, "blank", "duplicate", "truncated"].index(f) + ("sua".index(i) if i in "sua" else 3) for i, f in rows]
        assert conv_repair.cheapest(codes) == least_repair([(*r, "", "") for r in rows])[:2]


def test_search_over_a_long_conversation():
    rnd = random.Random(3)
    codes = [rnd.choice([0, 1, 2, 1, 2, 7, 14, 13]) for _ in range(20000)]
    cost, audit = conv_repair.cheapest(codes)
    edits = conv_repair.row_edits(codes, audit)
    assert len(edits) == len(codes) and 3 * audit.count("D") + 2 * (audit.count("R") + audit.count("I")) <= cost
    roles = "".join({"K": "suax"[c % 4], "D": ""}.get(e, e.lower()) for c, es in zip(codes, edits) for e in es)
    assert re.fullmatch("(s?(ua)+)?", roles)


def talks_of(spark, rows):
    extra = ", row long, g long, named boolean, slice int, nth long, c long, depth long, code int, edit string, x string"
    return spark.createDataFrame([(*r,) + (None,) * 10 for r in rows], TALK + extra).repartition(3)


def odd_talks():
    rnd = random.Random(5)
    words = ["Yes.", "No!", "why?", "open end", "", " \t", None, "Été.", "x" * 5000 + ".", "a\nb."]
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rnd.choice(words))
            for c in range(60) for t in range(rnd.randint(1, 7))]
    rows += [(200, t, "user" if t % 2 else "assistant", f"turn {t % 5000}.") for t in range(6000)]  # one long conversation, over several slices and blocks
    rows += [(300, None, "user", "no number."), (300, 7, "user", "late."), (301, None, None, None), (302, 2 ** 40, "user", "far."), (302, 1, "system", "near.")]
    return rows + [(310, 3, "user", "same."), (310, 3, "user", "same."), (310, 3, "user", "same.")]


def test_structure_repair_against_brute_force(spark):
    rows = odd_talks() + [(None, 1, "user", "whose?"), (None, 2, "assistant", "mine.")]
    got = rows_of(conv_repair.repair(talks_of(spark, rows)), REPAIRED)
    assert got == brute_repair(rows)
    small = spark.read.parquet(f"{MEDIUM}/conversations.parquet")
    assert rows_of(conv_repair.repair(small), REPAIRED) == brute_repair([tuple(r) for r in small.select("conv_id", "turn", "role", "text").collect()])


# ---- 12 LSH forest --------------------------------------------------------------------------------------

def brute_near(rows, percent=85):
    sets = []
    for i, t in rows:
        w = plain_words(ascii_lower(t or ""))
        sets.append((i, frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k:k + 5]) for k in range(len(w) - 4)])))
    distinct = sorted({s for _, s in sets if s}, key=lambda s: (len(s), repr(sorted(s)[:1])))
    near = lambda a, b: 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b)
    root = brute_components(list(range(len(distinct))), lambda a, b: near(distinct[a], distinct[b]))
    group = {s: root[k] for k, s in enumerate(distinct)}
    least = {}
    for i, s in sets:
        if s and i is not None:
            least[group[s]] = min(i, least.get(group[s], i))
    out = []
    for i, s in sets:
        c = least.get(group[s]) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


NEAR = ["doc_id", "n_shingles", "component_id", "kept"]


def near_copies():
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10 ** 6)}"
    out = []
    for g in range(12):
        base = [word() for _ in range(rnd.choice([6, 14, 60, 300]))]
        for _ in range(8):
            new = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                new[rnd.randrange(len(new))] = word()
            out.append(" ".join(new))
    base = [word() for _ in range(120)]  # a chain: neighbours are near, its ends are not
    for _ in range(30):
        base[rnd.randrange(120)] = word()
        out.append(" ".join(base))
    shared = [word() for _ in range(80)]  # many texts with one long passage that are no near copies
    out += [" ".join(shared + [word() for _ in range(25)]) for _ in range(60)]
    return [(5000 + k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("crowd,depths", [(32, (3, 4, 6, 8, 12)), (3, (3, 4)), (2, (3,))])
def test_forest_against_brute_force(spark, crowd, depths):
    rows = edge_texts() + near_copies()
    assert rows_of(lsh_forest.near_duplicates(docs_of(spark, rows), crowd=crowd, depths=depths), NEAR) == brute_near(rows)


def test_forest_regions_are_filtered_not_multiplied(spark, monkeypatch):
    """Rows of thin and of crowded regions are picked by semi joins with the regions' sizes: none can come out more often than it went in."""
    plans, store = [], lsh_forest.stored

    def watch(df, name):
        if name in ("forest-pairs", "forest-crowded"):
            plans.append(df._jdf.queryExecution().analyzed().toString())
        return store(df, name)

    monkeypatch.setattr(lsh_forest, "stored", watch)
    rows = near_copies()
    assert rows_of(lsh_forest.near_duplicates(docs_of(spark, rows), crowd=3, depths=(3, 4)), NEAR) == brute_near(rows)
    assert len(plans) == 3 and all("Join LeftSemi" in p for p in plans)


def test_forest_filters_texts_before_they_are_shuffled(spark, monkeypatch):
    """Texts of documents in no candidate pair are dropped by the filter's bits where they are read; nothing wanted is lost, null ids included."""
    plans, store = [], lsh_forest.stored

    def watch(df, name):
        if name == "forest-full-sets":
            plans.append(df._jdf.queryExecution().analyzed().toString())
        return store(df, name)

    monkeypatch.setattr(lsh_forest, "stored", watch)
    rows = near_copies() + [(None, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (9999, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1")]
    assert rows_of(lsh_forest.near_duplicates(docs_of(spark, rows)), NEAR) == brute_near(rows)
    assert len(plans) == 1 and "bitmap_construct_agg" in plans[0] and "Join LeftSemi" in plans[0]
    ids = spark.range(40000).selectExpr("if(id = 7, null, id) i", "'x' t")
    wanted = spark.createDataFrame([(None,), (0,), *[(i,) for i in range(30000, 30100)]], "w long")
    for bits in (15, 24):
        left = lsh_forest.likely(ids, "i", wanted, "w", bits)
        found = {r.i for r in left.collect()}
        assert left.columns == ["i", "t"] and {None, 0, *range(30000, 30100)} <= found and len(found) < (400 if bits == 15 else 110)


def test_forest_semi_joins_stay_above_the_filter(spark, monkeypatch):
    """No semi join that shuffles moves below the filter's bits; signatures come from the sets still in play; full sets are shuffled once."""
    plans, store = {}, lsh_forest.stored

    def watch(df, name):
        plans.setdefault(name, []).append((df._jdf.queryExecution().optimizedPlan().toString(), df.inputFiles(), df._jdf.queryExecution().executedPlan().toString()))
        return store(df, name)

    monkeypatch.setattr(lsh_forest, "stored", watch)
    rows, before = near_copies(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert rows_of(lsh_forest.near_duplicates(docs_of(spark, rows), crowd=3, depths=(3, 4)), NEAR) == brute_near(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    (texts, _, _), (shared, _, _) = plans["forest-full-sets"][0], plans["forest-shared"][0]
    assert 0 <= texts.find("Join LeftSemi") < texts.find("getbit") and "getbit" in shared
    pairs = plans["forest-pairs"]
    assert len(pairs) == 2 and not any("forest-sets" in f for f in pairs[1][1]) and any("forest-crowd" in f for f in pairs[1][1])
    (_, _, full), = plans["forest-full-sets"]
    above = full[:full.index("ArrowEvalPython")]
    assert above.count("Exchange hashpartitioning(s0") == 1 and "Exchange hashpartitioning(k" not in above


def test_forest_keeps_one_with_all_columns(spark):
    rows = near_copies()
    kept = lsh_forest.keep_one(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, k in brute_near(rows) if k}


def test_trees_lose_nothing_at_the_threshold():
    for depth in lsh_forest.DEPTHS:
        assert (1 - 0.85 ** depth) ** lsh_forest.trees(depth) <= lsh_forest.MISS
    a = lsh_forest.shingle_hashes(" ".join(map(str, range(3000))))
    b = lsh_forest.shingle_hashes(" ".join(map(str, range(150, 3000))))
    assert abs(int((lsh_forest.signature(a) == lsh_forest.signature(b)).sum()) / 128 - 0.95) < 0.08


# ---- 13 prefix trie -------------------------------------------------------------------------------------

def brute_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [v[2:] for v in sorted(vs)] for c, vs in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h]) + tuple(own[h:])
    member, below, leaves, saved = {}, {}, {}, {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            member.setdefault(path[:d], []).append(c)
    for node in member:
        if node:
            below.setdefault(node[:-1], []).append(node)
    for node, m in member.items():
        for d in range(len(node) + 1):
            saved[node[:d]] = saved.get(node[:d], 0) + ((len(m) - 1) * len(node[-1][1].encode()) if node else 0)
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in below)
    return sorted(((min(m), len(n), min(member[n[:-1]]) if n else None, len(m), len(below.get(n, ())), leaves[n], saved[n],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == n).encode()).hexdigest()) for n, m in member.items()), key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_against_brute_force(spark):
    """Shared first turns, whole copies, a long conversation with a copy, turnless ones and negative ids."""
    rows = [r for r in odd_talks() if r[0] != 200]
    rows += [(400 + c, t, "user" if t % 2 == 0 else "assistant", f"line {t if t < 1 + c % 4 else (t, c // 7)}") for c in range(80) for t in range(1 + c % 6)]
    rows += [(c, t, "user", f"long {t}") for c in (600, 605, 610) for t in range(700)] + [(-7, 1, "user", "minus"), (-5, 1, "user", "base"), (None, 1, "user", "nobody")]
    assert rows_of(conv_trie.trie(talks_of(spark, rows)), NODE) == brute_trie(rows)


def test_trie_where_all_conversations_are_turnless(spark):
    rows = [(c, 1, "user", "x") for c in range(1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:5]
    assert rows_of(conv_trie.trie(talks_of(spark, rows)), NODE) == brute_trie(rows)


def test_names_are_verified(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a", 5, 6), (2, 1, "user", "b", 5, 6)], "conv_id long, turn long, role string, text string, x long, y long")
    assert not conv_trie.names_hold(turns) and conv_trie.names_hold(turns.limit(1))


def test_runs_compose():
    rnd = np.random.default_rng(2)
    b = pd.DataFrame({"x": rnd.integers(-2 ** 63, 2 ** 63, 50), "y": rnd.integers(-2 ** 63, 2 ** 63, 50)})
    whole = conv_trie.lane_values(b, np.arange(1, 51)).sum(0) % conv_trie.P
    m, n = (conv_trie.lane_values(b.iloc[a:z], np.arange(1, z - a + 1)).sum(0) % conv_trie.P for a, z in ((0, 20), (20, 50)))
    assert [int(v) for v in whole] == [(int(a) + pow(s, 20, conv_trie.P) * int(z)) % conv_trie.P for a, z, s in zip(m, n, conv_trie.S)]
    carry = conv_trie.compose([(20, *map(int, m)), (30, *map(int, n)), (1, 0, 0, 0, 0)])
    assert carry[2][:5] == (50, *map(int, whole))


def test_hashes_in_order_over_slices_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_BYTES", 64)
    df = spark.range(4000).selectExpr("cast(id % 3 = 0 as int) * (id % 7) as k", "id", "concat('piece ', id) as p").repartition(5)
    got = {r.k: r.sha for r in ordered.sha256_in_order(df, ["k"], ["id"], ["k", "p"], "|", "t-order").collect()}
    rows = functools.reduce(lambda a, r: a.setdefault(r.k, []).append((r.id, r.p)) or a, df.collect(), {})
    assert got == {k: hashlib.sha256("|".join(p for _, p in sorted(v)).encode()).hexdigest() for k, v in rows.items()}
