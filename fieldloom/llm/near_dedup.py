"""Near-duplicates by probability MinHash, banding and exact verification.

Each text is a weighted set of its five-word shingles.  ProbMinHash turns weights
into a signature whose share of equal components estimates the probability Jaccard
similarity.  Each shingle gets the arrivals of a Poisson process with its weight as
rate, each arrival falls on one of M components, a component keeps its earliest.
Arrivals later than the latest kept one can't count any more, which ends a
shingle's process early.

Weights are 1 unless weigh is set, which makes that similarity the Jaccard
similarity of the sets, however often a line is repeated; candidates and verdict
use the same measure.  With weigh a shingle's weight is its count, the verdict is
the exact probability Jaccard similarity of the counts, and the last, exact join
(whose bounds hold for sets alone) is left out: pairs that no hub links are found
as the bands find them.

Bands of the signature name buckets.  A bucket never yields its pairs: its
members are held against two hubs of it, pair by pair exactly (Jaccard of the
sets of shingles, 32-bit fingerprints).  What that links becomes one component,
and a bucket of three rows or fewer is done: all its pairs have met.  Members of
larger buckets that still hold several components go to finer buckets, of twice
as many rows, and there meet hubs of other components.  Hubs only reduce: the
members of the larger first buckets that hold several components even then are
joined exactly (_exact_pairs), so a pair that shares a bucket is either in one
component already or compared, however crowded the bucket.  Texts of the same
words are one representative from the start, so copies cost one row each.

Sets move only for pairs that sizes and 512-bit parities allow (they differ in no
more bits than the sets in shingles).

Result: class_id is the least doc_id among a row's linked rows.  Defined cases:
a text without words (null, empty, blanks) is alone in its class even if
repeated; 1 to 4 words are one shingle; rows with the same doc_id are rows of
their own, null doc_id sorts last as class id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from ._common import among, fresh, in_short_batches, lasting, stored, temporary

M, ROWS = 80, 4
SIMILAR = 0.8
#: Finer buckets: so many subsets of 2 * ROWS components.
FINE = 40
#: Cells that count how common a fingerprint is, longs of a parity bitmap, rows of a side of a block of pairs.
CELLS, PARITY, BLOCK = 1 << 20, 8, 1000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SUBSETS = np.argsort(np.random.default_rng(11).random((FINE, M)), axis=1)[:, : 2 * ROWS]
_SEQUENCE = np.random.default_rng(5).integers(0, 2**63, 2, dtype=np.uint64)


def signature(elements: np.ndarray, weights: np.ndarray, m: int = M) -> np.ndarray:
    """ProbMinHash of distinct 64-bit elements with positive weights: m elements."""
    best, chosen = np.full(m, np.inf), np.zeros(m, np.uint64)
    at, left, rate, drawn = np.zeros(len(elements)), elements, weights.astype(np.float64), 0
    # Arrivals drawn at once: about what fills all components, less when many shingles share the work.
    steps = max(1, int(m * (np.log(m) + 2) / max(1, len(elements))))
    while len(left):
        numbers = np.arange(drawn + 1, drawn + steps + 1, dtype=np.uint64) * _STEP
        bits = words.mix64(left[:, None] + numbers[None, :])
        gaps = -np.log1p(-((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate[:, None]
        times = at[:, None] + np.cumsum(gaps, axis=1)
        slot = (words.mix64(bits) % np.uint64(m)).astype(np.int64)
        t, k = times.ravel(), slot.ravel()
        soon = t < best.max()
        t, k, e = t[soon], k[soon], np.repeat(left, steps)[soon]
        np.minimum.at(best, k, t)
        won = t == best[k]
        chosen[k[won]] = e[won]
        alive = times[:, -1] < best.max()
        at, left, rate, drawn = times[alive, -1], left[alive], rate[alive], drawn + steps
        steps = max(1, int(m * (np.log(m) + 2) / max(1, len(left)))) if len(left) < m else 1
    return chosen


#: Buckets of so many rows or fewer are done when their members have met two hubs.
MET = 3
_PARITIES = [f"p{i}" for i in range(PARITY)]
SKETCH = "same1 long, same2 long, n_set int, coarse array<long>, fine array<long>, elements binary, weights binary, " + ", ".join(f"{c} long" for c in _PARITIES)


def _parity(x: np.ndarray) -> np.ndarray:
    """How many fingerprints fall on each of 64 * PARITY bits, modulo 2, as longs."""
    bits = (np.bincount((x.astype(np.uint64) * _STEP >> np.uint64(64 - 9)).astype(np.int64), minlength=64 * PARITY) & 1).astype(bool)
    return np.packbits(bits).view(np.int64)


def _sketch(column: pa.Array, weigh: bool) -> pa.StructArray:
    rows = {k: [] for k in ("same1", "same2", "n_set", "coarse", "fine", "elements", "weights", *_PARITIES)}
    with np.errstate(over="ignore"):
        for hashed in words.word_hashes(column):
            if not len(hashed):
                for k in rows:
                    rows[k].append(None)
                continue
            elements, counts = np.unique(words.shingles(hashed), return_counts=True)
            kept = signature(elements, counts if weigh else np.ones(len(elements)))
            place = np.arange(1, len(hashed) + 1, dtype=np.uint64)
            same = [int(words.mix64((hashed * (words.mix64(place * s) | np.uint64(1))).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashed))).view(np.int64)[0]) for s in _SEQUENCE]
            coarse = words.mix64(words.combine(kept.reshape(-1, ROWS), 1) + np.arange(M // ROWS, dtype=np.uint64) * _STEP)
            fine = words.mix64(words.combine(kept[_SUBSETS], 2) + np.arange(FINE, dtype=np.uint64) * _STEP)
            small, where = np.unique((elements >> np.uint64(32)).astype("<u4"), return_inverse=True)
            weights = np.bincount(where, weights=counts).astype("<u4").tobytes() if weigh else None
            for k, v in zip(rows, (*same, len(small), coarse.view(np.int64), fine.view(np.int64), small.tobytes(), weights, *_parity(small).tolist()), strict=True):
                rows[k].append(v)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), *[pa.int64()] * PARITY)
    return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))


def _sketches(weigh: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = _sketch(part.column(2), weigh)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made.flatten()], ["rid", "doc_id", *[f.name for f in made.type]])

    return run


def _numbers(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's 32-bit numbers, where Arrow holds them."""
    for x in column:
        yield np.frombuffer(x.as_buffer(), "<u4")


@F.arrow_udf(T.BooleanType())
def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two sorted sets of fingerprints have Jaccard similarity SIMILAR or more."""

    def one(x: np.ndarray, y: np.ndarray) -> bool:
        both = np.intersect1d(x, y, assume_unique=True).size
        return bool(both >= SIMILAR * (x.size + y.size - both))

    return pa.array([one(x, y) for x, y in zip(_numbers(a), _numbers(b), strict=True)], pa.bool_())


def probability_jaccard(x: np.ndarray, v: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum over shared elements i of 1 / sum over all j of max(v_j / v_i, w_j / w_i), of sorted elements x and y with weights v and w.

    In order of v / w the first of the two is the greater for all elements up to i, and the second behind it.
    """
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    a, b = v[i].astype(float), w[j].astype(float)
    order = np.argsort(-a / b, kind="stable")
    a, b = a[order], b[order]
    first, second = np.cumsum(a) + v.sum() - a.sum(), w.sum() - np.cumsum(b)
    return float((1 / (first / a + second / b)).sum())


@F.arrow_udf(T.BooleanType())
def _alike_weighted(a: pa.Array, v: pa.Array, b: pa.Array, w: pa.Array) -> pa.Array:
    return pa.array([probability_jaccard(*row) >= SIMILAR for row in zip(*map(_numbers, (a, v, b, w)), strict=True)], pa.bool_())


def components(nodes: DataFrame, links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(rid, comp): the least rid that links (a, b) lead to, for every node.

    Each step takes the least label over a node's links (one of which leads to
    itself) and then the label of that label, so steps grow with the logarithm
    of the longest path.  What a step makes is written to the shared folder:
    Spark splits a hot key only where both sides of a join come straight from
    their shuffles.  start: labels of an earlier call with fewer links.
    """
    edges = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionAll(nodes.select(F.col("rid").alias("a"), F.col("rid").alias("b"))))
    told = edges.select("a", "b", F.col("b").alias("comp")) if start is None else edges.join(start.withColumnRenamed("rid", "b"), "b")
    while True:
        near = stored(told.groupBy("a").agg(F.min("comp").alias("comp"), F.min(F.when(F.col("a") == F.col("b"), F.col("comp"))).alias("was")))
        up = near.select(F.col("a").alias("comp"), F.col("comp").alias("up"))
        new = stored(near.join(up, "comp").select(F.col("a").alias("rid"), "was", F.col("up").alias("comp")))
        labels = new.select("rid", "comp")
        if new.filter("was <> comp").isEmpty():
            return labels
        told = edges.join(labels.withColumnRenamed("rid", "b"), "b")


def _first_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of every member and two different members of its bucket taken by chance."""
    lot = F.struct(F.xxhash64("rid", "key").alias("lot"), "rid")
    hubs = stored(members.groupBy("key").agg(F.min(lot)["rid"].alias("h1"), F.max(lot)["rid"].alias("h2")))
    return _pairs(members.join(hubs, "key").select("rid", F.explode(F.array("h1", "h2")).alias("h")))


def _later_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) in buckets with several components: members and hubs of another component than theirs.

    Hubs: one member by chance, and one by chance outside the least component.
    """
    tagged = stored(members.join(labels, "rid"))
    low = stored(tagged.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key", "low"))
    open_ = stored(tagged.join(low, "key"))
    lot = F.struct(F.xxhash64("rid", "key").alias("lot"), "rid", "comp")
    hubs = stored(open_.groupBy("key").agg(F.min(lot).alias("h1"), F.min(F.when(F.col("comp") > F.col("low"), lot)).alias("h2")))
    met = open_.join(hubs, "key").select("rid", "comp", F.explode(F.array("h1", "h2")).alias("h"))
    return _pairs(met.filter("comp <> h.comp").select("rid", F.col("h.rid").alias("h")))


def _pairs(met: DataFrame) -> DataFrame:
    return met.filter("rid <> h").select(F.least("rid", "h").alias("a"), F.greatest("rid", "h").alias("b")).distinct()


def _differ(parities: list[str], x: str, y: str) -> F.Column:
    """In how many bits two rows' parities differ: no more than the shingles that one of their sets lacks."""
    return sum((F.bit_count(F.col(f"{p}_{x}").bitwiseXOR(F.col(f"{p}_{y}"))) for p in parities), F.lit(0))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are alike; sets: rid, n_set, elements, weights where these count, and parities where they are known."""
    names = {"elements": "e", "weights": "w"}
    side = lambda c: own.select(F.col("rid").alias(c), *[F.col(k).alias(f"{v}_{c}") for k, v in names.items() if k in sets.columns])
    if "weights" in sets.columns:
        own = sets
        return pairs.join(side("a"), "a").join(side("b"), "b").filter(_alike_weighted("e_a", "w_a", "e_b", "w_b")).select("a", "b")
    known = [c for c in _PARITIES if c in sets.columns]
    n = lambda c: sets.select(F.col("rid").alias(c), F.col("n_set").alias(f"n_{c}"), *[F.col(p).alias(f"{p}_{c}") for p in known])
    sizes = F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b")
    sizes &= 9 * _differ(known, "a", "b") <= F.col("n_a") + F.col("n_b")
    fit = stored(pairs.join(n("a"), "a").join(n("b"), "b").filter(sizes).select("a", "b"))  # before sets travel
    own = among(sets.select("rid", "elements"), fit.select(F.explode(F.array("a", "b")).alias("rid")), "rid")
    return fit.join(side("a"), "a").join(side("b"), "b").filter(_alike("e_a", "e_b")).select("a", "b")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4") % CELLS, minlength=CELLS)
    cell = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(counts[cell])], ["cell", "n"])


def _common(sets: DataFrame) -> np.ndarray:
    """How often the fingerprints of each cell occur in sets: CELLS numbers, whatever the input."""
    made = sets.select("elements").mapInArrow(_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.uint64)
    out[made["cell"].to_numpy()] = made["n"].to_numpy()
    return np.minimum(out, np.uint64(2**31))


PREFIX = "rid long, comp long, n int, token int, at int, " + ", ".join(f"{c} long" for c in _PARITIES)


def _prefixes(common: np.ndarray):
    """The rarest fingerprints of every row, as many as a text of similarity SIMILAR or more can lack, and one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places, sizes, parities = [], [], [], []
            for e in batch.column(2):
                x = np.frombuffer(e.as_buffer(), "<u4")
                often = common[x % CELLS]
                first = np.sort((often << np.uint64(32)) | x)[: len(x) - (4 * len(x) + 4) // 5 + 1]
                at = np.flatnonzero(first >> np.uint64(32) > 1)  # what occurs once leads to no other row
                tokens.append(first[at].astype(np.uint32).view(np.int32))
                places.append(at.astype(np.int32))
                sizes.append(len(x))
                parities.append(_parity(x))
            if tokens:
                row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
                parity = np.stack(parities)[row]
                left = [batch.column(i).take(pa.array(row)) for i in (0, 1)]
                arrays = [*left, pa.array(np.array(sizes, np.int32)[row]), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(places)), *[pa.array(np.ascontiguousarray(parity[:, i])) for i in range(PARITY)]]
                yield pa.RecordBatch.from_arrays(arrays, ["rid", "comp", "n", "token", "at", *_PARITIES])

    return run


def _exact_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows of different components, among them all with Jaccard similarity SIMILAR (4/5) or more.

    sets: rid, comp, elements.  A prefix join: with fingerprints in one order, the
    rarest first, the first that two such sets share is among the first
    n - ceil(4n/5) + 1 of the larger and the first n - ceil(8n/9) + 1 of the
    smaller.  Sizes, places and the parity bitmaps' differing bits (never more
    than the sets' differing elements) rule out others by bounds that hold
    always.  A token's rows meet in blocks of BLOCK by BLOCK.
    """
    rows = stored(sets.select("rid", "comp", "elements").mapInArrow(_prefixes(_common(sets)), PREFIX))
    index = F.col("at") <= F.col("n") - F.floor((8 * F.col("n") + 8) / 9)
    groups = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum(index.cast("long")).alias("small"), F.count("*").alias("all"))
    cut = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    open_ = stored(groups.filter("low < high and small > 0").select("token", cut("small").alias("is"), cut("all").alias("js")))
    dealt = stored(among(rows, open_, "token").join(open_, "token"))
    place = lambda c: F.pmod(F.xxhash64("rid", F.lit(c)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("rid", "comp", "n", "at", *_PARITIES)]
    y = dealt.filter(index).withColumn("i", place("is")).withColumn("j", every("js")).select("token", "i", "j", *part("y"))
    x = dealt.withColumn("j", place("js")).withColumn("i", every("is")).select("token", "i", "j", *part("x"))
    both = F.col("n_x") + F.col("n_y")
    ordered = (F.col("n_y") < F.col("n_x")) | ((F.col("n_y") == F.col("n_x")) & (F.col("rid_y") < F.col("rid_x")))
    near = (F.col("comp_x") != F.col("comp_y")) & ordered & (5 * F.col("n_y") >= 4 * F.col("n_x"))
    near &= (9 * F.least(F.col("n_y") - F.col("at_y"), F.col("n_x") - F.col("at_x")) >= 4 * both) & (9 * _differ(_PARITIES, "x", "y") <= both)
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("token", "i", "j")]
    met = y.alias("l").join(x.alias("r"), [*on, near])
    return _pairs(met.select(F.col("rid_y").alias("rid"), F.col("rid_x").alias("h")))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(rid) of the members of buckets of more than MET rows that hold several components."""
    low = stored(members.join(labels, "rid").groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter(f"low < high and n > {MET}").select("key"))
    return stored(members.join(low, "key").select("rid").distinct())


def _buckets(reps: DataFrame, column: str) -> DataFrame:
    """(key, rid) of the buckets with two members or more."""
    rows = stored(reps).select("rid", F.explode(column).alias("key"))
    shared = stored(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    return among(rows, shared, "key").join(shared, "key")


def classes(docs: DataFrame, text: str = "text", id: str = "doc_id", weigh: bool = False) -> DataFrame:  # noqa: A002
    """One row (rid, doc_id, class_rid, class_id, keeper) for each row of docs that has words.

    rid numbers the rows as Spark reads docs; keeper marks one row of each class.  Steps that have nothing left to do
    are skipped.
    """
    carried = ["rid", "n_set", "elements", *(["weights"] if weigh else _PARITIES)]
    with temporary(docs.sparkSession):
        numbered = in_short_batches(docs).select(F.monotonically_increasing_id().alias("rid"), F.col(id).cast("long").alias("doc_id"), F.col(text))
        sketches = stored(numbered.mapInArrow(_sketches(weigh), f"rid long, doc_id long, {SKETCH}"))
        worded = sketches.filter("n_set is not null")
        same = stored(worded.groupBy("same1", "same2").agg(F.min("rid").alias("rep")))
        reps = same.select(F.col("rep").alias("rid"))
        members = stored(_buckets(worded.select("rid", "coarse").join(reps, "rid", "left_semi"), "coarse"))
        nodes = stored(members.select("rid").distinct())
        # From here on only rows that share a bucket.  The map keeps the others' sets out of the shuffle.
        near = stored(among(worded.select("fine", *carried), nodes, "rid").join(nodes, "rid", "left_semi"))
        sets = near.select(*carried)
        links = stored(_verified(_first_pairs(members), sets))
        labels = components(nodes, links)

        finer = stored(_buckets(near.join(_open(members, labels), "rid", "left_semi").select("rid", "fine"), "fine"))
        more = stored(_verified(_later_pairs(finer, labels), sets)) if not finer.isEmpty() else links.filter("false")
        if not more.isEmpty():
            links = links.unionAll(more)
            labels = components(nodes, links, labels)

        left = stored(_open(members, labels).join(labels, "rid"))
        unsettled = stored(among(sets.select("rid", "elements"), left, "rid").join(left, "rid"))
        if not weigh and not unsettled.isEmpty():
            last = stored(_verified(stored(_exact_pairs(unsettled)), sets))
            if not last.isEmpty():
                labels = components(nodes, links.unionAll(last), labels)
        reps = same.join(labels.withColumnRenamed("rid", "rep"), "rep", "left").select("same1", "same2", F.coalesce("comp", "rep").alias("class_rid"))
        rows = stored(worded.select("rid", "doc_id", "same1", "same2").join(reps, ["same1", "same2"]).select("rid", "doc_id", "class_rid"))
        first = stored(rows.groupBy("class_rid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")).alias("first")))
        return lasting(rows.join(first, "class_rid").select("rid", "doc_id", "class_rid", F.col("first.doc_id").alias("class_id"), (F.col("rid") == F.col("first.rid")).alias("keeper")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, is_kept for every row; rows without words are classes of their own."""
    found = classes(docs)
    rest = docs.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("class_id"), F.lit(True).alias("is_kept"))
    return found.select("doc_id", "class_id", F.col("keeper").alias("is_kept")).unionAll(rest)


def near_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:  # noqa: A002
    """docs without the rows that are near-duplicates of a row that stays: one row of each class.

    docs is numbered in a stored copy, for rows may repeat.
    """
    rid = fresh(docs, "rid")
    numbered = stored(docs.withColumn(rid, F.monotonically_increasing_id()))
    found = classes(numbered.select(F.col(rid).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id")
    gone = found.filter("not keeper").select(F.col("doc_id").alias(rid))
    return numbered.join(gone, rid, "left_anti").select(*docs.columns)
