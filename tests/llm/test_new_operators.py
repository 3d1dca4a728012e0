"""Operators 11 to 13 against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from fieldloom.llm import jaccard_join, prefix_trie, whitening
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"

# 11

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(rows, rebuild):
    """Nodes of the trie of rows (conv_id, turn, role, text), from a dictionary of prefixes."""
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append(((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16]), (r, x)))
    own = {c: [y for _, y in sorted(v, key=lambda z: z[0])] for c, v in conv.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        new[c] = own.get(base, [])[:h] + v[h:] if rebuild else v
    members, kids, saved, leaves = defaultdict(list), Counter(), Counter(), Counter()
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(new[c]) == len(p))))
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()), key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=str)


def test_trie_of_the_table(spark):
    c = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert rows_of(prefix_trie.report(c)) == trie_of([(r.conv_id, r.turn, r.role, r.text) for r in c.collect()], True)


@pytest.mark.parametrize("block", [2, 5, 10_000])
def test_trie_over_many_blocks(spark, block):
    rng = random.Random(block)
    rows = []
    for c in [*range(-10, 110), 2**40]:
        for i in range(rng.choice([1, 1, 2, 3, 5, 9, 30])):
            rows.append((c, rng.choice([i, i, None, 3]), rng.choice(["user", None]), rng.choice(["a", "b", "", None, "é" * 9])))
    rows += [(500 + k, i, "user", "same") for k in range(60) for i in range(4)]  # equal conversations
    rows += [(None, 0, "user", "no id"), *rows[:5]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert rows_of(prefix_trie.trie(prefix_trie.sequences(df.withColumn("digests", F.lit(1)).withColumn("w", F.lit("x"))), block)) == trie_of(rows, False)
    if block == 2:
        assert rows_of(prefix_trie.report(df)) == trie_of(rows, True)


def test_trie_of_few(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie.report(spark.createDataFrame([], kind)).count() == 0
    one = [(3, 0, "user", "x" * 1_000_000), (3, 1, None, None)]
    assert rows_of(prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame(one, kind)))) == trie_of(one, False)
    turnless = [(11, 0, "user", "a")]  # its base is absent and its only turn is among the first h
    assert rows_of(prefix_trie.report(spark.createDataFrame(turnless, kind))) == trie_of(turnless, True)
    assert prefix_trie.report(spark.createDataFrame(turnless, kind)).first().depth == 0


# 12


def whitened(spark, vectors, **more):
    kind = "vec_id long, embedding array<double>, n int, deviation string, white int"
    return whitening.whiten(spark.createDataFrame([(i, v, 1, "x", 2) for i, v in enumerate(vectors)], kind), **more)


def exact(vectors):
    """Integers, sums and scatter as Python integers."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    scatter = [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return x, s, scatter


def test_scatter_is_exact_for_numbers_of_any_size(spark):
    rng = np.random.default_rng(0)
    for scale in (1.0, 2.0**30, 2.0**50):
        v = (rng.normal(size=(300, 6)) * scale).tolist()
        df = spark.createDataFrame([(x,) for x in v], "v array<double>").repartition(7)
        n, sums, centred = whitening.scatter(df, 6)
        x, s, want = exact(v)
        assert n == 300 and centred == want and [a + n * 1_000_000 for a in sums] == s


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = table.collect()
    x, s, scatter = exact([r.embedding for r in rows])
    n = len(x)
    e, axes = np.linalg.eigh(np.array([[c / n**2 for c in r] for r in scatter]))
    e, axes = e[::-1], axes[:, ::-1]
    centred = np.array([[(n * c - b) / n for c, b in zip(r, s)] for r in x])
    want = centred @ axes[:, :32] / np.sqrt(e[:32])
    found = {(r.vec_id, r.component): r for r in whitening.report(table).collect()}
    assert len(found) == n * 32
    got = np.array([[found[r.vec_id, k + 1].whitened for k in range(32)] for r in rows])
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-9
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-9  # one sign for all rows
    for r, ints in zip(rows, x):
        one = found[r.vec_id, 1]
        assert one.n == n and one.deviation == sum((n * c - b) ** 2 for c, b in zip(ints, s))
    assert np.allclose([found[rows[0].vec_id, k + 1].explained for k in range(32)], e[:32] / e.sum(), rtol=1e-9)
    error = np.abs(np.cov(got.T, bias=True) - np.eye(32)).max()
    assert {r.identity_error for r in found.values()} == {found[rows[0].vec_id, 1].identity_error} and found[rows[0].vec_id, 1].identity_error < 1e-9 and error < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [0.0, 1.0, 0.25], [1.0, 2.0, 0.5], [-3.0, 0.5, 9.0]]
    out = whitened(spark, [*good, None, [1.0, None, 2.0], [nan, 0.0, 0.0], [inf, 0.0, 0.0], [], [1.0, 2.0]]).collect()
    assert {r.vec_id for r in out} == {0, 1, 2, 3} and {r.component for r in out} == {1, 2, 3} and {r.n for r in out} == {4}
    x, s, _ = exact(good)
    assert {r.vec_id: int(r.deviation) for r in out} == {i: sum((4 * c - b) ** 2 for c, b in zip(v, s)) for i, v in enumerate(x)}
    assert whitened(spark, [None, []]).count() == 0 and whitened(spark, []).count() == 0
    same = whitened(spark, [[1.0, 2.0]] * 3).collect()
    assert {(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in same} == {(None, None, None, 0)}
    flat = whitened(spark, [[k, 2.0 * k] for k in (0.0, 1.0, 5.0)]).collect()  # rank one
    assert {r.component for r in flat if r.whitened is None} == {2} and {r.identity_error for r in flat if r.identity_error > 1e-9} == set()
    huge = whitened(spark, [[1e30, 1.0], [-1e30, 2.0], [1e10, 7.0]]).collect()
    assert len(huge) == 6 and all(r.deviation is None or r.deviation >= 0 for r in huge)
    assert whitened(spark, good, components=2).count() == 8


# 13


def gram_sets(texts, size=4):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def joined(texts, ids, t=Fraction(85, 100)):
    """(n_shingles, component_id) by all pairs."""
    s = gram_sets(texts)
    parent = list(range(len(s)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and both >= t * (len(s[i]) + len(s[j]) - both):
                parent[top(i)] = top(j)
    least = defaultdict(list)
    for i in range(len(s)):
        least[top(i)].append(ids[i])
    return sorted(((ids[i], len(s[i]), min((x for x in least[top(i)] if x is not None), default=None)) for i in range(len(s))), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_join_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    assert result(jaccard_join.report(docs)) == joined([r.text for r in rows], [r.doc_id for r in rows])


@pytest.mark.parametrize("block", [3, 1000])
def test_join_around_the_threshold(spark, monkeypatch, block):
    """A crowd of texts that share most n-grams with each other but not enough, pairs just on either side, and copies."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(block)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):
        own = list(base)
        for i in rng.sample(range(120), rng.choice([1, 2, 3, 4, 6, 9])):
            own[i] = f"x{rng.randrange(40)}"
        texts.append(" ".join(own))
    for n in (7, 17, 20, 37, 40, 200):
        for cut in range(5):
            texts.append(" ".join(f"q{n}_{i}" for i in range(n - cut)))
    texts += [texts[3]] * 40 + [texts[3].upper(), "Short ONE", "short one", "short", None, "", " \n"]
    rng.shuffle(texts)
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(6)
    assert result(jaccard_join.report(df)) == joined(texts, ids)


@pytest.mark.parametrize("crowd", [2, 32])
def test_join_of_a_crowd(spark, monkeypatch, crowd):
    """Variants of one text, of which about every second pair is similar: all links, but not all pairs in the last join."""
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "BLOCK", 50)
    rng, texts = random.Random(5), []
    for k in range(240):
        own = [f"w{i}" for i in range(300)]
        for i in rng.sample(range(300), 1 + k % 5):
            own[i] = f"x{k}_{i}"
        texts.append(" ".join(own))
    texts += [" ".join(f"{c}{i}" if i % 9 == 0 else f"w{i}" for i in range(300)) for c in "abcd"]
    seen, real = [], jaccard_join.rest_pairs
    monkeypatch.setattr(jaccard_join, "rest_pairs", lambda *a: seen.append(jaccard_join.stored(real(*a))) or seen[-1])
    met = []
    monkeypatch.setattr(jaccard_join, "lasting", lambda df, keep=jaccard_join.lasting: met.append(seen[-1].count()) or keep(df))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert result(jaccard_join.report(df)) == joined(texts, list(range(len(texts))))
    assert met[0] <= 2 * len(texts)


def test_a_pair_meets_at_its_first_shared_n_gram(spark):
    """Rows 1 and 2 share n-grams 10 to 29 and, behind one that 3 holds, 31 and 32; row 3 shares 30 with 1."""
    held = {1: range(10, 33), 2: [*range(10, 30), 31, 32], 3: [30]}
    rows = [(rid, 25, token, at, True, 2, before) for rid, v in held.items() for at, (token, before) in enumerate(zip(v, [None, *v]))]
    members = spark.createDataFrame(rows, "rid long, n int, token long, at int, index boolean, k long, before long")
    labels = spark.createDataFrame([], "rid long, comp long")
    assert sorted((r.a, r.b, r.at_a, r.at_b) for r in jaccard_join.meetings(members, labels, Fraction(1, 100)).collect()) == [(2, 1, 0, 0), (2, 1, 20, 21), (3, 1, 0, 20)]
    assert sorted((r.a, r.b, r.at_a, r.at_b) for r in jaccard_join.rest_pairs(members, labels, Fraction(1, 100)).collect()) == [(2, 1, 0, 0), (3, 1, 0, 20)]


def test_filters_never_lose_a_pair():
    rng = random.Random(1)
    for p, q in ((85, 100), (4, 5), (1, 2), (1, 1)):
        t = Fraction(p, q)
        for _ in range(300):
            n = rng.randrange(1, 60)
            x = set(rng.sample(range(80), n))
            y = {e for e in x if rng.random() < 0.93} | {e for e in range(80) if rng.random() < 0.02}
            both = len(x & y)
            if not y or both < t * (len(x) + len(y) - both):
                continue
            large, small = sorted((sorted(x), sorted(y)), key=len, reverse=True)
            first = min(set(large) & set(small))
            i, j = large.index(first), small.index(first)
            assert i < jaccard_join.prefix_sizes(len(large), t)[0] and j < jaccard_join.prefix_sizes(len(small), t)[1]
            arrays = [np.array(s, np.uint64) << np.uint64(33) for s in (large, small)]
            differ = int(np.bitwise_count(np.bitwise_xor(*map(jaccard_join.parity, arrays))).sum())
            assert differ <= len(x ^ y)
            assert jaccard_join.alike(*arrays, i, j, np.zeros(jaccard_join.CELLS, np.uint64), t)


def test_large_unlike_sets_do_not_travel(spark, monkeypatch):
    """Sets of 4000 n-grams fill 512 bits, so unlike ones passed; wide parities keep all similar ones and rule these out."""
    rng = np.random.default_rng(3)
    draw = lambda n: np.unique(rng.integers(0, 2**40, n, dtype=np.uint64))
    held = {1: (x := draw(4200)), 2: np.union1d(x[200:], draw(200)), 3: draw(4000), 4: x[: len(x) * 86 // 100]}
    for a, b in ((1, 2), (1, 4), (2, 3)):
        assert jaccard_join.differing(*(np.frombuffer(jaccard_join.wide_parity(held[k]), "<u8") for k in (a, b))) <= len(np.setxor1d(held[a], held[b]))
    seen, real = [], jaccard_join.among
    monkeypatch.setattr(jaccard_join, "among", lambda rows, few, key: seen.append((rows.columns[1:], {r.rid for r in few.collect()})) or real(rows, few, key))
    sets = spark.createDataFrame([(k, len(x), jaccard_join.wide_parity(x), jaccard_join.packed(x)) for k, x in held.items()], "rid long, n int, wide binary, elements binary")
    pairs = spark.createDataFrame([(1, 2, 0, 0), (1, 3, 0, 0), (1, 4, 0, 0)], "a long, b long, at_a int, at_b int")
    out = jaccard_join.verified(pairs, sets, np.zeros(jaccard_join.CELLS, np.uint64), Fraction(85, 100)).collect()
    assert sorted((r.a, r.b) for r in out) == [(1, 2), (1, 4)]
    assert seen[-1] == (["elements"], {1, 2, 4})


def test_join_of_odd_rows(spark, odd, empty):
    assert jaccard_join.report(empty).count() == 0
    rows = odd.collect()
    assert result(jaccard_join.report(odd)) == joined([r.text for r in rows], [r.doc_id for r in rows])
