"""Windows over indexed samples.

Samples are grouped once into blocks of one hop; a window is a run of blocks, put
together from the blocks behind its first one (whole_windows).  Where a window may
lack samples, each sample is sent to the windows that hold it (slide), which are
ordinary equi-groups bounded by the window's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EPS
from ..functions.scalar import held as bounded
from ..shared import let, ranked
from .scans import scan


def indexed(rows: DataFrame, key: str, *order: str, name: str = "i") -> DataFrame:
    """Rows with their place in their series, from 0; no task holds a whole series for it."""
    return ranked(rows, [key], [F.col(c) for c in order], name)


def slide(rows: DataFrame, size: int, hop: int, first: int = 0, index: str = "i", start: str = "s") -> DataFrame:
    """A row for each window start that covers the sample: starts first, first + hop, ..."""
    i = F.col(index)
    low = F.greatest(F.lit(0), F.ceil((i - size + 1 - first) / hop))
    high = F.floor((i - first) / hop)
    starts = F.when(i >= first, F.transform(F.sequence(low, high), lambda k: k * hop + first))
    return rows.filter(i >= first).withColumn(start, F.explode(F.filter(starts, lambda s: (s <= i) & (i < s + size))))


def whole(windowed: DataFrame, size: int, *keys: str) -> DataFrame:
    """(keys, t): windows with all their samples, as sorted arrays of (i, x)."""
    return windowed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("t")).filter(F.size("t") == size)


#: Blocks that one task puts together in order: a long series is many such runs.
RUN = 4096


def whole_windows(rows: DataFrame, size: int, hop: int, first: int, key: str, index: str = "i", start: str = "s") -> DataFrame:
    """(key, start, t): the windows with all their samples, as arrays of (i, x) in order.

    size is a multiple of hop.  Each sample is shuffled once, as part of its block.  Runs of blocks overlap by what a
    window needs beyond its first block, so no task holds a whole series.
    """
    if size % hop:
        return whole(slide(rows, size, hop, first, index, start), size, key, start)
    n = size // hop
    block = F.expr(f"({index} - {first}) div {hop}")
    blocks = rows.filter(F.col(index) >= first).groupBy(key, block.alias("b")).agg(F.array_sort(F.collect_list(F.struct(index, "x"))).alias("t")).filter(F.size("t") == hop)
    run = F.expr(f"b div {RUN}")
    shared = F.when((F.col("b") % RUN < n - 1) & (F.col("b") >= RUN), F.array(run, run - 1)).otherwise(F.array(run))
    w = Window.partitionBy(key, "run").orderBy("b")
    placed = blocks.withColumn("run", F.explode(shared))
    ahead = [F.lead("t", k).over(w) for k in range(1, n)]
    last = F.lead("b", n - 1).over(w) if n > 1 else F.col("b")
    found = placed.select(key, "b", "run", F.concat("t", *ahead).alias("t"), last.alias("last")).filter((F.col("last") == F.col("b") + n - 1) & (F.col("run") == run))
    return found.select(key, (F.col("b") * hop + first).alias(start), "t")


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def median(a: Column) -> Column:
    n = F.size(a)
    return let(F.sort_array(a), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def mad(a: Column) -> Column:
    """1.4826 times the median distance from the median."""
    return 1.4826 * let(median(a), lambda m: median(F.transform(a, lambda x: F.abs(x - m))))


def slope(a: Column, hz: float) -> Column:
    """Least-squares slope over the nominal clock index / hz."""
    n = F.size(a)
    middle = (n - 1) / 2
    top = total(F.transform(a, lambda x, k: (k - middle) * x))
    return top * hz / (n * (n * n - 1) / 12.0)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays held to +-1; null where it is undefined."""

    def about(a: Column) -> Column:
        return let(mean(a), lambda m: F.transform(a, lambda x: x - m))

    def ratio(d: Column) -> Column:
        bottom = F.sqrt(total(F.transform(d["a"], lambda x: x * x)) * total(F.transform(d["b"], lambda x: x * x)))
        return total(F.zip_with(d["a"], d["b"], lambda x, y: x * y)) / F.when(bottom > EPS, bottom)

    return let(let(F.struct(about(a).alias("a"), about(b).alias("b")), ratio), lambda r: bounded(r, -1.0, 1.0))


def _steps(a: Column) -> tuple[Column, Column]:
    n = F.size(a) - 1
    return F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n)


def diff_rms(a: Column) -> Column:
    left, right = _steps(a)
    return F.sqrt(mean(F.zip_with(left, right, lambda x, y: (y - x) * (y - x))))


def lag1(a: Column) -> Column:
    return pearson(*_steps(a))


def first_of(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, ref): mean of the first n samples, null unless all n are there and known."""
    known = rows.filter(F.col("i") < n).groupBy(key).agg(F.avg("x").alias("m"), F.count("x").alias("c"))
    return known.select(key, F.when(F.col("c") == n, F.col("m")).alias("ref"))


def latest(windows: DataFrame, key: str, start: str = "s") -> DataFrame:
    """The rows of each series' newest window."""
    return windows.join(windows.groupBy(key).agg(F.max(start).alias(start)), [key, start])


def islands(rows: DataFrame, key: str, good: Column, least: int) -> DataFrame:
    """Each series' latest uninterrupted run of good rows, if it has `least` rows or more: (key, first_i, last_i, n).

    Along a run both the place and the number of good rows so far grow by one, so their difference names it.
    """
    counted = scan(rows.select(key, "i", good.alias("_good")), [key], ["i"], sums={"_so_far": F.col("_good").cast("long")})
    found = counted.filter("_good").groupBy(key, (F.col("i") - F.col("_so_far")).alias("_run")).agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("n"))
    last = found.groupBy(key).agg(F.max_by(F.struct("first_i", "last_i", "n"), "last_i").alias("r"))
    return last.select(key, "r.*").filter(F.col("n") >= least)


def held(rows: DataFrame, key: str, stuck: Column, value: str = "x") -> DataFrame:
    """The value, or where a reading is stuck the last one that wasn't."""
    return scan(rows, [key], ["i"], carry={"held": F.when(~stuck, F.col(value))})
