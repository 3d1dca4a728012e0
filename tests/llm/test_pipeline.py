"""Each stage on its own input, held against what it promises."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from fieldloom.llm import secrets
from fieldloom.llm._common import stored
from fieldloom.llm.tokens import Encoder, vocabulary

from test_operators import brute_base, brute_counts, check_packing, shingle_set

DATA = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, at = docs.columns, {"input": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA))
        at[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == columns
    rules, dedup, clean, mixed, packed = (at[n] for n, _ in corpus_pipeline.STAGES)
    for r in rules:
        n, _, _, _, repeats = brute_counts(r.text)
        assert n >= 50 and repeats * 2 <= n
    assert len(rules) > 0.7 * len(at["input"])
    # No two that stay are near-duplicates, and each that went has one that stays in its class.
    kept, sets = {r.doc_id for r in dedup}, {r.doc_id: shingle_set(r.text) for r in rules}
    assert kept <= sets.keys() and len(kept) == len(dedup)
    where = defaultdict(list)
    for i in sets:
        for x in sets[i]:
            where[x].append(i)
    shared = Counter((a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    linked = defaultdict(set)
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            assert not (a in kept and b in kept)
            linked[a].add(b), linked[b].add(a)
    assert all(linked[i] for i in sets.keys() - kept)
    assert sorted(r.doc_id for r in clean) == sorted(kept)
    for r in clean:
        assert not brute_base(r.text) and r.n_chars == len(r.text)
    before = {r.doc_id: r.text for r in dedup}
    assert all(r.text == before[r.doc_id] for r in clean if not secrets or not re.search(r"\[SECRET\]", r.text))
    often = Counter(r.doc_id for r in mixed)
    assert set(often.values()) <= {1, 2} and often.keys() <= kept
    coder = Encoder(vocabulary("word_bpe_49k.json")).tokenizer
    texts = {r.doc_id: r.text for r in mixed}
    want = {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert sum(r.length for r in packed) == sum(want[i] * n for i, n in often.items())
    once = [r for r in packed if often[r.doc_id] == 1]
    assert len({(r.doc_id, r.piece) for r in once}) == len(once)
    assert check_packing(packed, {}) <= 1.05 * sum(r.length for r in packed) / 2048 + 1
    assert np.isfinite(len(packed))


def test_stages_take_odd_and_empty_rows(spark, odd, empty):
    """Every stage: nulls, repeated rows, very long texts, clashing names, no rows."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, DATA)
        assert out.columns == odd.columns and out.count() <= 2 * odd.count(), name
        assert stage(spark, empty, DATA).isEmpty()
    rules, dedup, clean, mixed = (stage(spark, odd, DATA) for _, stage in corpus_pipeline.STAGES[:-1])
    assert [r.doc_id for r in rules.collect()] == [4]  # only the long text has 50 words
    assert dedup.filter("doc_id = 5").count() == 2 and dedup.filter("doc_id = 7").isEmpty()
    assert sorted(map(str, clean.collect())) != [] and clean.count() == odd.count() and clean.filter("text is null").count() == 1
    assert mixed.filter("text is null or doc_id in (2, 3)").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, DATA)
    assert packed.filter("piece = 0").count() == odd.count() and corpus_pipeline.STAGES[-1][1](spark, empty, DATA).isEmpty()
