"""Jaccard join of word n-grams by rare-first prefixes.

A text's set is that of its distinct n-grams of words (A-Z lower-cased); fewer words
than n are one n-gram.  Two rows are linked if the Jaccard similarity of their sets
is THRESHOLD or more.  Sets are kept as 40-bit fingerprints (sizes from 64-bit ones):
two different n-grams of one pair agree with chance 2**-40.

One order of all fingerprints, the rarest first, by counts in CELLS cells.  Of two
similar sets x (the larger) and y the first n-gram in that order that both hold is
among the first |x| - ceil(t |x|) + 1 of x and the first |y| - ceil(2t/(1+t) |y|) + 1
of y: the prefixes.  Rows join on prefix n-grams, and at the first shared one

* length: |y| >= t |x|, also as a key: y goes to its own size class and the next;
* position: no more than min of what is left behind both places can be shared;
* suffix: cut at the same fingerprints, what stands behind the places must not differ
  in its pieces' sizes by more n-grams than similar sets can

each rule the pair out, and so do 512-bit parities of whole sets, which differ in no
more bits than the sets in n-grams and meet for pairs only, not with the n-grams' rows.  Large sets fill 512 bits: before they move, parities
of as many bits as they have n-grams do the same.  What is left is verified, once.

Rows of equal sets are one representative from the start.  An n-gram that more than
CROWD rows hold never yields all its pairs: in rounds HUBS of its rows, others each time,
are hubs, and each component of rows is verified against the HUBS first ones of its
n-grams' hubs.  What is similar is one component.  An n-gram takes part while a round
saves a tenth of the components that it has, and until it has no more than two pairs of
different ones for each row.  Then all n-grams' rows join exactly, pairs of one component
left out, a crowd's largest component only with what is outside it, in blocks of BLOCK by
BLOCK rows of one n-gram and size class.  So each pair of similar sets ends in one component.
A pair meets where it shares an n-gram and not the shared one before: at its first one,
and seldom again.

Sets stay where they are stored until a pair needs them: maps of bits, of a size that
does not depend on the input, drop rows before a shuffle that a join would drop behind it.

Defined cases: a null text or one without words has size 0 and is linked with
nothing; repeated rows are linked, also those of one doc_id; a null doc_id takes part
and counts last as component_id; extra columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from ._common import among, in_short_batches, lasting, stored, temporary
from ._common import small as sized
from .near_dedup import components

SHINGLE, THRESHOLD = 4, Fraction(85, 100)
#: Bytes of a fingerprint, cells of counts, longs of a parity, rows of a side of a block, texts at once.
WIDTH, CELLS, PARITY, BLOCK, RUN = 5, 1 << 17, 8, 1000, 500
#: Hubs that a component is verified against in a round, rows of an n-gram beyond which it has hubs.
HUBS, CROWD = 8, 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PARITIES = [f"p{i}" for i in range(PARITY)]


def packed(x: np.ndarray) -> bytes:
    """Numbers below 2**40 at five bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def unpacked(x: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :WIDTH] = raw
    return out.view("<u8").ravel()


def lowered(column: pa.Array) -> pa.Array:
    """The column with A-Z in lower case, all else as it is."""
    data, offsets = words.buffers(column)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets.tobytes()), pa.py_buffer(_LOWER[data].tobytes()))


def sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each row's distinct n-grams as sorted 64-bit hashes."""
    for hashed in words.word_hashes(lowered(column)):
        yield np.unique(words.shingles(hashed, size)) if len(hashed) else hashed


def parity(x: np.ndarray) -> np.ndarray:
    """512 bits: how many fingerprints fall on each, modulo 2."""
    bit = (words.mix64(x) >> np.uint64(55)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=64 * PARITY) & 1).astype(bool), bitorder="little").view("<u8")


def wide_parity(x: np.ndarray) -> bytes:
    """A parity of the least power of two bits, 64 at least, that is no less than the set's size."""
    size = 64 << max(0, int(len(x) - 1).bit_length() - 6)
    bit = (words.mix64(x) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=size) & 1).astype(bool), bitorder="little").tobytes()


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two wide parities differ (as longs), the wider one folded to the other's bits."""
    a, b = sorted((a, b), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0) ^ a).sum())


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                rows = []
                with np.errstate(over="ignore"):
                    for x in sets(part.column(2), size):
                        if len(x):
                            same = [int(words.mix64(np.bitwise_xor.reduce(words.mix64(x + np.uint64(salt)), keepdims=True) + np.uint64(len(x))).view(np.int64)[0]) for salt in (1, 2)]
                            small = np.unique(x >> np.uint64(24))
                            rows.append((*same, len(x), len(small), packed(small), wide_parity(small), *parity(small).view(np.int64).tolist()))
                        else:
                            rows.append((None, None, 0, 0, None, None, *[0] * PARITY))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * PARITY)
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["rid", "doc_id", "same1", "same2", "n_shingles", "n", "elements", "wide", *_PARITIES])

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, RUN):
            every = np.concatenate([unpacked(x) for x in batch.column(0).slice(at, RUN)])
            counts += np.bincount((every % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    cell = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(counts[cell])], ["cell", "k"])


def common(reps: DataFrame) -> np.ndarray:
    """How often the fingerprints of each cell occur: CELLS numbers, whatever the input."""
    made = reps.select("elements").mapInArrow(_cells, "cell int, k long").groupBy("cell").agg(F.sum("k").alias("k")).toArrow()
    out = np.zeros(CELLS, np.uint64)
    out[made["cell"].to_numpy()] = made["k"].to_numpy()
    return np.minimum(out, np.uint64(2**24 - 1))


def prefix_sizes(n: int, t: Fraction) -> tuple[int, int]:
    """(as the larger or equal set, as the smaller or equal one): numbers of rarest n-grams of which similar sets share one."""
    p, q = t.numerator, t.denominator
    return n + 1 - -(-p * n // q), n + 1 - -(-2 * p * n // (p + q))


def _ordered(often: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A set's fingerprints by (count of their cell, fingerprint)."""
    return x[np.argsort((often[x % np.uint64(CELLS)] << np.uint64(40)) | x)]


def _tokens(often: np.ndarray, t: Fraction):
    """A row for each n-gram of each row's prefix; index: within the shorter prefix of the smaller set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                tokens, places, index, sizes, lengths = [], [], [], [], []
                part = batch.slice(at, RUN)
                for e in part.column(1):
                    x = unpacked(e)
                    large, small = prefix_sizes(len(x), t)
                    tokens.append(_ordered(often, x)[:large])
                    places.append(np.arange(large, dtype=np.int32))
                    index.append(np.arange(large) < small)
                    sizes.append(large)
                    lengths.append(len(x))
                row = np.repeat(np.arange(len(sizes)), sizes)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(np.array(lengths, np.int32)[row]), pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.concatenate(places)), pa.array(np.concatenate(index))], ["rid", "n", "token", "at", "index"])

    return run


def _near(t: Fraction, x: str, y: str) -> F.Column:
    """Length filter of two rows, with integers; x and y: prefixes of their columns' names."""
    n = [F.col(f"{s}n") for s in (x, y)]
    return t.denominator * F.least(*n) >= t.numerator * F.greatest(*n)


def _fits(t: Fraction, x: str, y: str) -> F.Column:
    """Length and position filters of two members of one n-gram, the first that they share."""
    p, q = t.numerator, t.denominator
    n, at = ([F.col(f"{s}{c}") for s in (x, y)] for c in ("n", "at"))
    behind = F.least(n[0] - at[0], n[1] - at[1])
    return _near(t, x, y) & ((p + q) * behind >= p * (n[0] + n[1]))


def _even(t: Fraction, x: str, y: str) -> F.Column:
    """Whether two sets' parities allow them to be similar, by whole sets."""
    p, q = t.numerator, t.denominator
    col = lambda s, c: F.col(f"{s}{c}")
    differ = sum((F.bit_count(col(x, c).bitwiseXOR(col(y, c))) for c in _PARITIES), F.lit(0))
    both = col(x, "n") + col(y, "n")
    return (p + q) * (both - differ) >= 2 * p * both


def hub_pairs(rows: DataFrame, bits: DataFrame, t: Fraction, turn: int) -> DataFrame:
    """(a, b, at_a, at_b): of every component a row a and the HUBS first of its n-grams' hubs b of other components.

    rows: rid, comp, n, token.  An n-gram's hubs are the HUBS rows with the least of HUBS hashes of this turn (lot), so texts that
    share many n-grams meet the same few.  The places are -1: what is shared first is not known here.
    """
    hub = lambda i: F.min(F.struct(F.xxhash64("rid", F.lit(HUBS * turn + i)).alias("lot"), "rid", "comp", "n"))
    hubs = stored(rows.groupBy("token").agg(*[hub(i).alias(f"h{i}") for i in range(HUBS)]))
    met = rows.join(hubs, "token").select("rid", "comp", "n", F.explode(F.array(*[f"h{i}" for i in range(HUBS)])).alias("h")).filter((F.col("comp") != F.col("h.comp")) & _near(t, "", "h."))
    one = F.min(F.struct(F.xxhash64("rid", F.lit(HUBS * turn)).alias("lot"), "rid"))["rid"]
    pairs = stored(met.groupBy("comp", F.col("h.rid").alias("b")).agg(F.min("h.lot").alias("lot"), one.alias("a")))
    near = _plausible(pairs, bits, t).groupBy("comp").agg(F.slice(F.array_sort(F.collect_list(F.struct("lot", "a", "b"))), 1, HUBS).alias("h")).select(F.inline("h"))
    return near.select("a", "b", F.lit(-1).alias("at_a"), F.lit(-1).alias("at_b"))


def _open(rows: DataFrame) -> DataFrame:
    """(token, k, cross, main, comps) of the n-grams with several components: rows, pairs of two components, the largest and the number of them."""
    one = rows.groupBy("token", "comp").agg(F.count("*").alias("m"))
    of = one.groupBy("token").agg(F.sum("m").alias("k"), F.sum(F.col("m") * F.col("m")).alias("within"), F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("comps"))
    return of.select("token", "k", F.expr("(k * k - within) div 2").alias("cross"), "main", "comps").filter("cross > 0")


def crowds(members: DataFrame, bits: DataFrame, elements: DataFrame, often: np.ndarray, t: Fraction) -> DataFrame:
    """(rid, comp) of the rows of crowded n-grams after rounds of hubs."""
    rows = members.filter(F.col("k") > CROWD).select("rid", "n", "token")
    labels = stored(rows.select("rid", F.col("rid").alias("comp")).distinct())
    turn, before = 0, None
    while True:
        tagged = stored(rows.join(labels, "rid"))
        left = _open(tagged).filter(F.col("cross") > 2 * F.col("k"))
        if before is not None:
            left = left.join(before, "token").filter("10 * comps <= 9 * was")
        before = stored(left.select("token", F.col("comps").alias("was")))
        if before.isEmpty():
            return labels
        rows = stored(tagged.join(before, "token", "left_semi"))
        links = stored(verified(stored(hub_pairs(rows, bits, t, turn)), elements, often, t))
        labels, rows, turn = merged(labels, links), rows.select("rid", "n", "token"), turn + 1


def _plausible(pairs: DataFrame, bits: DataFrame, t: Fraction) -> DataFrame:
    own = among(bits, pairs.select(F.explode(F.array("a", "b")).alias("rid")), "rid")
    side = lambda c: own.select(F.col("rid").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("n", *_PARITIES)])
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_even(t, "a_", "b_")).select(*pairs.columns)


def meetings(members: DataFrame, labels: DataFrame, t: Fraction) -> DataFrame:
    """(a, b, at_a, at_b) of members of different components, among them all whose sets are similar; a pair may come repeatedly.

    labels: (rid, comp) of rows whose component is not their own.  Crowded n-grams go by size class, and a crowd's rows are
    parted: its largest component (1) meets as the larger set only what is outside it (0), which meets all.
    """
    tagged = members.join(sized(labels), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    grade = F.floor(F.log(F.col("n")) / float(np.log(float(1 / t))) - 1e-9).cast("int")
    many = tagged.filter(F.col("k") > CROWD).withColumn("class", grade)
    many = stored(many.join(stored(_open(many).select("token", "main")), "token").withColumn("part", (F.col("comp") == F.col("main")).cast("int")).drop("main"))
    few = tagged.filter(F.col("k") <= CROWD).withColumns({c: F.lit(-1) for c in ("class", "part")}).select(*many.columns)

    def smaller(rows: DataFrame) -> DataFrame:
        met = F.when(F.col("part") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return rows.filter("index").withColumn("class", F.explode(F.array(F.col("class"), F.col("class") + 1))).withColumn("part", F.explode(met))

    keys, group = ["token", "class", "part", "i", "j"], ["token", "class", "part"]
    counts = lambda df, c: df.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(c))
    # Only of groups of more than one block, which are few: other rows need no shuffle to be dealt.
    cells = sized(stored(counts(many, "xs").join(counts(smaller(many), "ys"), group).filter("xs > 1 or ys > 1")))
    dealt = lambda df: df.join(cells, group, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("xs", "ys")})
    place = lambda c: F.pmod(F.xxhash64("rid", F.lit(c)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda s: [F.col(c).alias(f"{s}{c}") for c in ("rid", "comp", "n", "at", "before")]
    larger = (F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_rid") < F.col("x_rid")))
    # A pair that shares the n-gram before as well has met there.
    first = ~F.coalesce(F.col("x_before") == F.col("y_before"), F.lit(False))

    def met(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        x, y = x.select(*keys, *part("x_")).alias("l"), y.select(*keys, *part("y_")).alias("r")
        pairs = x.join(y, [*[F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys], first & larger & (F.col("x_comp") != F.col("y_comp")) & _fits(t, "x_", "y_")])
        return pairs.select(*[F.col(f"{x}_{c}").alias(y) for c, x, y in (("rid", "x", "a"), ("rid", "y", "b"), ("at", "x", "at_a"), ("at", "y", "at_b"))])

    x = dealt(many).withColumn("i", place("xs")).withColumn("j", every("ys"))
    y = dealt(smaller(many)).withColumn("j", place("ys")).withColumn("i", every("xs"))
    return met(few, few.filter("index"), ["token"]).unionAll(met(x, y, keys))


def rest_pairs(members: DataFrame, labels: DataFrame, t: Fraction) -> DataFrame:
    """Each pair of meetings() once, with the places of the first n-gram that both hold."""
    return meetings(members, labels, t).groupBy("a", "b").agg(F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))


def alike(x: np.ndarray, y: np.ndarray, at_x: int, at_y: int, often: np.ndarray, t: Fraction) -> bool:
    """Whether two sets are similar; at: places of the first n-gram of their prefixes that both hold (-1: not known), for the suffix filter."""
    p, q = t.numerator, t.denominator
    behind = [np.bincount((_ordered(often, v)[at + 1 :] >> np.uint64(35)).astype(np.int64), minlength=32) for v, at in ((x, at_x), (y, at_y))]
    shared = 1 + np.minimum(*behind).sum()  # at most
    if (p + q) * shared < p * (x.size + y.size):
        return False
    both = np.intersect1d(x, y, assume_unique=True).size
    return bool(q * both >= p * (x.size + y.size - both))


def verified(pairs: DataFrame, elements: DataFrame, often: np.ndarray, t: Fraction) -> DataFrame:
    """The pairs (a, b, at_a, at_b, ...) whose sets are similar; elements: rid, n, wide, elements.

    Sets travel only for pairs that the wide parities allow.
    """
    p, q = t.numerator, t.denominator

    @F.arrow_udf(T.BooleanType())
    def test(a: pa.Array, b: pa.Array, at_a: pa.Array, at_b: pa.Array) -> pa.Array:
        return pa.array([alike(unpacked(x), unpacked(y), i, j, often, t) for x, y, i, j in zip(a, b, at_a.to_pylist(), at_b.to_pylist(), strict=True)], pa.bool_())

    @F.arrow_udf(T.IntegerType())
    def differ(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([differing(*(np.frombuffer(x.as_buffer(), "<u8") for x in row)) for row in zip(a, b, strict=True)], pa.int32())

    def sides(pairs: DataFrame, *columns: str) -> DataFrame:
        own = among(elements.select("rid", *columns), pairs.select(F.explode(F.array("a", "b")).alias("rid")), "rid")
        side = lambda c: own.select(F.col("rid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns])
        return pairs.join(side("a"), "a").join(side("b"), "b")

    both = F.col("n_a") + F.col("n_b")
    near = stored(sides(pairs, "n", "wide").filter((p + q) * (both - differ("wide_a", "wide_b")) >= 2 * p * both).select(*pairs.columns))
    return sides(near, "elements").filter(test("elements_a", "elements_b", "at_a", "at_b")).select(*pairs.columns)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rid, comp) whose components are one where links (a, b) of rows join them."""
    end = lambda c: labels.select(F.col("rid").alias(c), F.col("comp").alias(f"{c}_comp"))
    joins = stored(links.join(end("a"), "a").join(end("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct())
    if joins.isEmpty():
        return labels
    to = components(joins.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), joins)
    return stored(labels.join(sized(to.select(F.col("rid").alias("comp"), F.col("comp").alias("to"))), "comp", "left").select("rid", F.coalesce("to", "comp").alias("comp")))


def linked(docs: DataFrame, text: str = "text", id: str = "doc_id", size: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:  # noqa: A002
    """One row (doc_id, n_shingles, component_id) for each row of docs."""
    with temporary(docs.sparkSession):
        numbered = in_short_batches(docs).select(F.monotonically_increasing_id().alias("rid"), F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        kinds = "rid long, doc_id long, same1 long, same2 long, n_shingles long, n int, elements binary, wide binary, " + ", ".join(f"{c} long" for c in _PARITIES)
        sketches = stored(numbered.mapInArrow(_sketches(size), kinds))
        worded = sketches.filter("n > 0")
        same = stored(worded.groupBy("same1", "same2").agg(F.min("rid").alias("rep")))
        reps = same.select(F.col("rep").alias("rid"))
        elements, bits = worded.select("rid", "n", "wide", "elements"), worded.select("rid", "n", *_PARITIES)
        own = among(worded.select("rid", "elements"), reps, "rid")  # representatives, and a copy here and there
        often = common(own)
        tokens = stored(own.mapInArrow(_tokens(often, threshold), "rid long, n int, token long, at int, index boolean"))
        shared = stored(tokens.groupBy("token").agg(F.count("*").alias("k"), F.max("index").alias("index")).filter("k > 1 and index").select("token", "k"))
        earlier = Window.partitionBy("rid").orderBy("at")
        members = stored(among(tokens, shared, "token").join(shared, "token").join(reps, "rid", "left_semi").withColumn("before", F.lag("token").over(earlier)))
        labels = crowds(members, bits, elements, often, threshold)
        pairs = stored(rest_pairs(members, labels.filter("rid <> comp"), threshold))
        links = stored(verified(stored(_plausible(pairs, bits, threshold)), elements, often, threshold))
        nodes = labels.select("rid").unionAll(links.select(F.explode(F.array("a", "b")).alias("rid"))).distinct()
        labels = merged(stored(nodes.join(labels, "rid", "left").select("rid", F.coalesce("comp", "rid").alias("comp"))), links)
        named = same.join(labels.withColumnRenamed("rid", "rep"), "rep", "left").select("same1", "same2", F.coalesce("comp", "rep").alias("comp"))
        found = stored(worded.select("doc_id", "n_shingles", "same1", "same2").join(named, ["same1", "same2"]).select("doc_id", "n_shingles", "comp"))
        least = found.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        alone = sketches.filter("n = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return lasting(found.join(least, "comp").select("doc_id", "n_shingles", "component_id").unionAll(alone))


def report(docs: DataFrame) -> DataFrame:
    return linked(docs)
