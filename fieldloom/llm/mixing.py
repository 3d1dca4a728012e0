"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents is
worth: a whole part, and a fraction that is rounded dependently.  Two documents
meet and one gives mass to the other, by chance, until one of them is at 0 or 1;
the other goes on with what is left.  A document's chance of the extra copy stays
its fraction, while the sum hardly moves.  Documents meet in order of size, so
the words taken hardly move either.

Rows line up by source, size and a hash of their content; a row's place in its
source comes from a range partitioning and the partitions' counts.  Runs of FAN
places fold to one residual each, FAN residuals fold to one again: a reduction
tree without a task that sees a whole source.  All of it is DataFrame
expressions.  Chance is a hash of content and place, so the result depends on the
rows alone, not on files, partitions or their order.  Rows that are equal in
every column are interchangeable.

Defined cases: null text has size 0 and is never taken; null source is a source,
last in order; a source of size 0 has target 0; repeated rows are rows of their
own; an empty table gives an empty one; no column of the input is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, fresh, lasting, ranked, small, stored, temporary, whole

FAN = 64
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
_ELEMENT = "struct<size:bigint,rid:bigint,doc_id:bigint,base:bigint,f:double,lot:bigint>"
_DONE = "array<struct<rid:bigint,doc_id:bigint,size:bigint,copies:bigint>>"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for each source: capped shares, the excess dealt again by weight until none is above.

    Each round is one sum over the sources; rounds end when no further source is above its cap.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    caps = stored(ranked(sums, [], [F.col("source").asc_nulls_last()], "place").select("source", "source_size", turn.cast("double").alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    level, full = 0.0, -1
    while True:
        capped = F.col("cap") <= level * F.col("w")
        r = caps.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("cap"))).alias("caps"), F.sum(F.when(~capped, F.col("w"))).alias("w"), F.count(F.when(capped, 1)).alias("n")).first()
        if r.n == full or not r.w:
            break
        full, level = r.n, (share * r["all"] - (r.caps or 0.0)) / r.w
    return caps.select("source", "source_size", F.when(F.lit(not r.w) | (F.col("cap") <= level * F.col("w")), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def _meet(level: int):
    """One meeting: the open element and the next one."""

    def step(acc: F.Column, x: F.Column) -> F.Column:
        o = acc["open"]
        a, b, both = o["f"], x["f"], o["f"] + x["f"]
        u = F.pmod(F.xxhash64(o["lot"], x["lot"], F.lit(level)), F.lit(1 << 53)) / float(1 << 53)
        # Below 1 one of them loses all; else one of them is filled.  x goes on if its lot says so.
        goes = F.when(both <= 0, F.lit(False)).when(both < 1, u * both < b).otherwise(u * (2 - both) < 1 - b)
        up = both >= 1
        rest = F.when(up, both - 1).otherwise(both)
        # both < 1: the one that goes on takes the sum, the other ends at 0.
        # both >= 1: `goes` says that the open one is filled, and x goes on with the rest.
        leaves, stays = lambda n: F.when(goes, o[n]).otherwise(x[n]), lambda n: F.when(goes, x[n]).otherwise(o[n])
        done = F.struct(leaves("rid").alias("rid"), leaves("doc_id").alias("doc_id"), leaves("size").alias("size"), (leaves("base") + F.when(up, 1).otherwise(0)).alias("copies"))
        kept = F.struct(*[stays(n).alias(n) for n in ("size", "rid", "doc_id", "base")], rest.alias("f"), stays("lot").alias("lot"))
        met = F.struct(kept.cast(_ELEMENT).alias("open"), F.concat(acc["done"], F.array(done).cast(_DONE)).alias("done"))
        start = F.struct(x.cast(_ELEMENT).alias("open"), acc["done"].alias("done"))
        return F.when(o["rid"].isNull(), start).otherwise(met)

    return step


def _fold(rows: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Rows (keys, place, e) to one row for each key: open residual and those done.  At most FAN meet."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "e"))).alias("all"))
    zero = F.struct(F.lit(None).cast(_ELEMENT).alias("open"), F.array().cast(_DONE).alias("done"))
    folded = F.aggregate(F.transform("all", lambda x: x["e"]), zero, _meet(level))
    return stored(listed.select(*keys, folded.alias("s")).select(*keys, "s.open", "s.done"))


def copies(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """rid, doc_id, source, size, source_size, target, copies for every row (rid, doc_id, source, size, lot)."""
    own = stored(aims.select(F.col("source").alias("_s"), "source_size", "target"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    worth = sizes.join(small(own), sizes["source"].eqNullSafe(own["_s"])).withColumn("worth", F.when(F.col("size") > 0, each).otherwise(0.0))
    parted = worth.withColumn("base", F.floor("worth")).withColumn("f", F.col("worth") - F.floor("worth")).drop("_s", "source_size", "target", "worth")

    sure = parted.filter("f = 0").select("rid", "doc_id", "source", "size", F.col("base").alias("copies"))
    element = F.struct("size", "rid", "doc_id", "base", "f", F.xxhash64("lot", "place").alias("lot")).cast(_ELEMENT)
    lined = ranked(parted.filter("f > 0"), ["source"], [F.col("size"), F.col("lot")], "place")
    rows, done, level, most = lined.select("source", "place", element.alias("e")), [], 0, 1
    while most:
        level += 1
        folded = _fold(rows.withColumn("block", F.expr(f"place div {FAN}")), ["source", "block"], level)
        most = folded.agg(F.max("block")).first()[0]
        rows = folded.select("source", F.col("block").alias("place"), F.col("open").alias("e"))
        done.append(folded.select("source", F.inline("done")))
    u = F.pmod(F.xxhash64(F.col("e.lot"), F.lit(-1)), F.lit(1 << 53)) / float(1 << 53)
    last = rows.select("source", "e.rid", "e.doc_id", "e.size", (F.col("e.base") + F.when(u < F.col("e.f"), 1).otherwise(0)).alias("copies"))
    names = ["rid", "doc_id", "source", "size", "copies"]
    every = reduce(DataFrame.unionAll, [x.select(*names) for x in [sure, last, *done]])
    return every.join(small(own), every["source"].eqNullSafe(own["_s"])).drop("_s")


def _sized(docs: DataFrame, rid: F.Column, lot: F.Column, text: str, id: str, source: str) -> DataFrame:  # noqa: A002
    return stored(docs.select(rid.alias("rid"), F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("size"), lot.alias("lot")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every row of docs."""
    with temporary(docs.sparkSession):
        sizes = _sized(docs, F.monotonically_increasing_id(), F.xxhash64("doc_id", "text"), "text", "doc_id", "source")
        return lasting(copies(sizes, targets(sizes)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")))


def mix(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source") -> DataFrame:  # noqa: A002
    """docs' rows, each as often as the mix takes it (not at all, once or twice).

    docs is numbered in a stored copy, for rows may repeat.  Rows that differ in
    columns that cannot be hashed (maps, variants) alone count as equal.
    """
    rid, copy = fresh(docs, "rid"), fresh(docs, "copy")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    numbered = stored(docs.withColumn(rid, F.monotonically_increasing_id()))
    with temporary(docs.sparkSession):
        sizes = _sized(numbered, F.col(rid), F.xxhash64(*hashed), text, id, source)
        often = lasting(copies(sizes, targets(sizes)).filter("copies > 0").select(F.col("rid").alias(rid), "copies"))
    # A row for each document: merged, as it is at any size, never broadcast.
    often = often.select(rid, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy))
    return numbered.join(often.hint("merge"), rid).select(*docs.columns)
