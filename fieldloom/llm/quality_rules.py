"""Quality rules with thresholds that each language and source sets itself.

Every text gets whole-text counts in one Arrow pass.  The rates of the texts
that pass the base rules go, as integers, into a mergeable quantile sketch per
(lang, source, rate): buckets of a logarithmic-linear scale with counts, so
sketches of any two parts of the corpus add up bucket by bucket (an ordinary
partial aggregation).  One rule sets the fences of all rates:

* where the language's sketch falls apart above its median, the fence is in the middle
  of the gap.  The gap is the widest between neighbouring values, on a logarithmic
  scale; it counts if it is as wide as the way from the median up to it, and as the way
  from its upper end to the 99 % quantile of what lies above.  So a bulk and a cluster
  far from it are told apart, and a tail that thins out is not cut.
* elsewhere the fence is median + FACTOR * (HIGH % quantile - median).

Both come from the group's sketch and its language's, which weighs as much as PRIOR
texts: a small group leans on its language, a large one stands alone, and no size
switches between them.  (A gap of the group's own counts if its language has one.)  No
limit in a rate's own unit exists.  The fences join back to the rows.

Rates are in thousandths; a lone symbol, repeated line or upper-case word is no
rate yet, so those counts are less by one.

Defined cases: null text counts as empty (base rules fail it); null lang or
source is a group of its own; every row gives one row, repeated or not; no column
of the input is lost whatever its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WORD, fresh, in_short_batches, lasting, pieces, small, stored, struct, temporary

_WORD, _SYMBOL = re.compile(WORD), re.compile(r"[#*$%&|<>]")
COUNTS = T.StructType([T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")])
#: Rates with an upper fence.
RULES = ("symbols", "dup_lines", "repeats", "upper", "word_length")
#: The upper quantile in hundredths, and how often its distance from the median fits below the fence.
HIGH, FACTOR = 99, 4
#: Texts that a language's sketch weighs as much as.
PRIOR = 500
#: Buckets to each power of two: a quantile is off by 1/512 at most, finer than the spread of mean word lengths.
STEPS = 512


def count(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated(words), len(lines), sum(map(str.isupper, words))


def repeated(words: list[str]) -> int:
    """Words inside a three-word window that the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    hit = np.zeros(len(words), bool)
    for j in range(3):
        hit[at + j] = True
    return int(hit.sum())


@F.arrow_udf(COUNTS)
def _counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for x in texts:
        yield struct([count(t) for some in pieces(x) for t in some.to_pylist()], COUNTS)


#: Said to be nondeterministic, so that a filter on the counts does not count anew.
_counts = _counted.asNondeterministic()


def _rates(c: str) -> dict[str, F.Column]:
    """Integers in thousandths; 0 for texts without words."""
    part = lambda a, b, lone=0: F.coalesce(F.expr(f"greatest({c}.{a} - {lone}L, 0L) * 1000L div nullif({c}.{b}, 0L)"), F.lit(0).cast("long"))
    return {"symbols": part("n_symbols", "n_words", 1), "dup_lines": part("n_dup_lines", "n_lines", 1), "repeats": part("n_repeat_words", "n_words"), "upper": part("n_upper", "n_words", 1), "word_length": part("word_chars", "n_words")}


def base_failed(c: str) -> F.Column:
    words, repeats = F.col(f"{c}.n_words"), F.col(f"{c}.n_repeat_words")
    return (words < 50) | (100 * repeats > 50 * words)


def bucket(x: F.Column) -> F.Column:
    """Sketch bucket of a non-negative integer: exact below STEPS, then STEPS to each power of two."""
    power = F.floor(F.log2(F.greatest(x, F.lit(1)) + 0.5)).cast("int")  # the half keeps powers of two off the border
    shift = F.greatest(power - int(np.log2(STEPS)), F.lit(0))
    return (shift.cast("long") * STEPS + F.floor(x / F.pow(F.lit(2.0), shift))).cast("long")


def value(b: F.Column) -> F.Column:
    """The lowest integer of a bucket."""
    shift = F.greatest(F.floor(b / STEPS) - 1, F.lit(0))
    return ((b - shift * STEPS) * F.pow(F.lit(2.0), shift)).cast("long")


def sketch(counted: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows (keys, rate, bucket, n): a sketch for each group and rate, that merges by adding n."""
    rates = F.array(*[F.struct(F.lit(k).alias("rate"), bucket(v).alias("bucket")) for k, v in _rates(column).items()])
    return counted.select(*keys, F.explode(rates).alias("r")).groupBy(*keys, "r.rate", "r.bucket").agg(F.count("*").alias("n"))


def scale(x: F.Column) -> F.Column:
    """A rate's place on a logarithmic scale, in millionths, as an integer."""
    return F.round(F.log(1 + x) * 1e6).cast("long")


def quantiles(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """Total, median, upper quantile and the middle of the gap (null where there is none) of each sketch.

    A window holds one sketch: some thousand buckets at most, whatever the corpus.
    """
    group = [*keys, "rate"]
    every, order = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("bucket")
    upto = sketched.groupBy(*group, "bucket").agg(F.sum("n").alias("n")).withColumn("v", value(F.col("bucket")))
    upto = upto.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(every), "next": F.lead("v").over(order)})
    upto = upto.withColumn("mid", F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("v"))).over(every))
    wide = F.when(F.col("v") >= F.col("mid"), F.struct((scale(F.col("next")) - scale(F.col("v"))).alias("gap"), (-F.col("v")).alias("low"), F.col("next").alias("next"), F.col("upto").alias("upto")))
    upto = upto.withColumn("g", F.max(F.when(F.col("next").isNotNull(), wide)).over(every))
    above = (F.col("v") >= F.col("g.next")) & ((F.col("upto") - F.col("g.upto")) * 100 >= HIGH * (F.col("total") - F.col("g.upto")))
    at = upto.groupBy(*group).agg(F.max("total").alias("total"), F.max("mid").alias("mid"), F.min(F.when(F.col("upto") * 100 >= HIGH * F.col("total"), F.col("v"))).alias("high"), F.max("g").alias("g"), F.min(F.when(above, F.col("v"))).alias("top"))
    low = -F.col("g.low")
    apart = (F.col("g.gap") >= scale(low) - scale(F.col("mid"))) & (F.col("g.gap") >= scale(F.col("top")) - scale(F.col("g.next")))
    return at.select(*group, "total", "mid", "high", F.when(apart, F.sqrt((1 + low) * (1 + F.col("g.next")).cast("double")) - 1).alias("middle"))


def fences(counted: DataFrame, column: str, lang: str = "lang", source: str = "source", prior: int = PRIOR) -> DataFrame:
    """One row per (lang, source) with an upper fence for every rate."""
    rows = counted.filter(~base_failed(column)).select(F.col(lang).alias("l"), F.col(source).alias("s"), F.col(column).alias("c"))
    with temporary(counted.sparkSession):
        return lasting(_fences(stored(sketch(rows, ["l", "s"], "c")), prior))


def _fences(fine: DataFrame, prior: int) -> DataFrame:
    own = quantiles(fine, ["l", "s"])
    broad = quantiles(fine.drop("s"), ["l"]).select(F.col("l").alias("of"), F.col("rate").alias("by"), *[F.col(c).alias(f"{c}_l") for c in ("mid", "high", "middle")])
    joined = own.join(broad, F.col("l").eqNullSafe(F.col("of")) & (F.col("rate") == F.col("by")))
    shrunk = lambda q, p: (F.col("total") * q + prior * F.col(p)) / (F.col("total") + prior)
    mid, high = shrunk(F.col("mid"), "mid_l"), shrunk(F.col("high"), "high_l")
    fence = F.when(F.col("middle_l").isNotNull(), shrunk(F.coalesce("middle", "middle_l"), "middle_l")).otherwise(mid + FACTOR * (high - mid))
    fenced = joined.withColumn("fence", fence)
    return fenced.groupBy("l", "s").agg(*[F.max(F.when(F.col("rate") == r, F.col("fence"))).alias(f"max_{r}") for r in RULES])


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs' columns and one struct `quality` (with as many _ before it as its name needs to be new): counts, base_failed, kept.

    The text is read twice (thresholds, then rows) and never shuffled or written.
    """
    c, q = fresh(docs, "counts"), fresh(docs, "quality")
    counted = in_short_batches(docs).withColumn(c, _counts(F.col(text)))
    return decide(counted, fences(counted, c, lang, source), c, q, lang, source)


def decide(counted: DataFrame, limits: DataFrame, c: str, q: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """Join the fences to the rows and judge each; the counts' column becomes the struct q.

    Rows with texts are not shuffled for it while there are few groups.
    """
    l, s, fence = (fresh(counted, n) for n in ("fence_l", "fence_s", "fence"))  # noqa: E741
    own = small(limits).select(F.col("l").alias(l), F.col("s").alias(s), F.struct(*[F.col(f"max_{r}") for r in RULES]).alias(fence))
    joined = counted.join(own, counted[lang].eqNullSafe(own[l]) & counted[source].eqNullSafe(own[s]), "left")
    inside = F.lit(True)
    for rate, x in _rates(c).items():
        inside &= F.coalesce(value(bucket(x)) <= F.col(f"{fence}.max_{rate}"), F.lit(True))  # at the sketch's resolution
    out = joined.withColumn(q, F.struct(*[F.col(f"{c}.{n}") for n in COUNTS.names], base_failed(c).alias("base_failed"), (~base_failed(c) & inside).alias("kept")))
    return out.drop(l, s, fence, c)


def report(docs: DataFrame) -> DataFrame:
    """doc_id with the counts and the verdict, for every row; the text is read once."""
    counted = stored(in_short_batches(docs).select("doc_id", "lang", "source", _counts(F.col("text")).alias("counts")))
    judged = decide(counted, fences(counted, "counts"), "counts", "quality")
    return judged.select("doc_id", *[F.col(f"quality.{n}") for n in COUNTS.names], "quality.base_failed", "quality.kept")
