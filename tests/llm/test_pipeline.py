"""Each stage of the corpus pipeline against brute force on its own input, with the columns of documents kept."""

from __future__ import annotations

import re
import zlib

import numpy as np

import corpus_pipeline
from airwise.llm import queries
from airwise.llm.common import scratch_path
from tests.conftest import SMALL
from tests.llm.test_operators import (brute_components, brute_fingerprint, brute_quality, brute_spans, loose_words, plain_words, ascii_lower, docs_of)


def stage_inputs(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "t-stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        yield name, docs, out
        docs = out


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "", None, None, None), (90003, "call +1 (377) 555-0271 or mail a@b.co and " + " ".join(f"word{k}x" for k in range(40)), "en", "s", 1)],
                                  docs.schema)
    seen = {}
    for name, before, after in stage_inputs(spark, docs.unionByName(extra), SMALL):
        seen[name] = ([(r.doc_id, r.text, r.source) for r in before.collect()], after)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "simhash near-dedup", "benchmark decontamination", "pii", "best-fit packing"]
    for n in names[:4]:
        assert seen[n][1].columns == docs.columns
    texts = lambda n: {r.doc_id: r.text for r in seen[n][1].collect()}

    rows, _ = seen["quality rules"]
    judged = brute_quality(rows)
    kept = {r[0] for r in judged if r[7]}
    got = texts("quality rules")
    assert set(got) == kept
    words = {i: len(plain_words(t)) for i, t, _ in rows}
    assert all(len(plain_words(got[r[0]])) == words[r[0]] - r[8] for r in judged if r[7])

    rows, _ = seen["simhash near-dedup"]
    fp = {i: brute_fingerprint(t) for i, t, _ in rows}
    root = brute_components(sorted(set(fp.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in fp.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert set(texts("simhash near-dedup")) == set(least.values())

    rows, _ = seen["benchmark decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = loose_words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[k:k + n]) for k in range(len(w) - n + 1 if w else 0)}
    sizes = {len(x) for x in windows}
    dirty = {i for i, t, _ in rows for w in [loose_words(t)] for n in sizes for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in windows}
    assert dirty and set(texts("benchmark decontamination")) == {i for i, _, _ in rows} - dirty

    rows, _ = seen["pii"]
    got = texts("pii")
    for i, t, _ in rows:
        out, at = [], 0
        for s, _, kind, e in brute_spans(t):
            if s >= at:
                out += [t[at:s], f"[{kind}]"]
            at = max(at, e)
        assert got[i] == "".join(out) + t[at:]
    assert "[phone] or mail [email] and" in got[90003]

    from tokenizers import Tokenizer

    of = Tokenizer.from_file(queries.tokenizer_path())
    rows, packed = seen["best-fit packing"]
    want = []
    for i, t, _ in rows:
        ids = np.array(of.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed.collect()) == sorted(want)
    assert re.fullmatch(r"[0-9a-f]{16}", f"{brute_fingerprint(ascii_lower('A b c')):016x}")


def test_stages_take_columns_of_any_name(spark):
    docs = docs_of(spark, [(k, f"text {k} " + " ".join(f"w{k}x{j}" for j in range(30)) + f"\nmail me{k}@b.co", "s") for k in range(12)])
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SMALL)
    assert docs.columns == docs_of(spark, []).columns and docs.count() == 12 and all("[email]" in r.text for r in docs.collect())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
