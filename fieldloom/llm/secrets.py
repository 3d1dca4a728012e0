"""Secret scans with Spark expressions only.

Patterns give the base spans.  A battery of randomness tests adds spans: every
long token is read in the smallest alphabet that covers it (decimal, hex, base32,
base36, letters of both cases, base62, base64, each in its cases), and gets three
normal scores that are near 0 for random symbols:

* chi-squared, symbols against a uniform alphabet;
* runs above and below the middle of the alphabet;
* serial correlation of neighbours.

Their squares (only an excess of chi-squared counts) add up to a distance from
randomness.  A token must not be rejected as random at 1 %, and it must survive
false-discovery control against ordinary words: the corpus' own words of one
case, read in the same alphabet (a letter by its place in it, or its number modulo
the alphabet's size where it has none), and compounds of words and numbers in the
alphabets that cover them, say how often a word looks that random.
Words of the token's length class count, and of the next shorter ones until they
are FEW: shorter words look more random, so that errs on the safe side.  Benjamini-Hochberg over all tokens of an
alphabet and length class sets the distance up to which at most FDR of the
findings are words.  So short tokens, for which words look random too often, are
left alone by that control and by nothing else.  What is gathered for it are
counts by alphabet, length class and distance, which add up.

Defined cases: null text is empty; positions are code points, end exclusive;
spans of one kind don't overlap; added spans that touch a base span are left
out; letters of one case, and words and numbers joined by - _ + / or by capitals,
are ordinary and never a finding; a corpus without
ordinary words gets no added spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, let, running, stored, whole

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
#: Maximal long tokens.
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
FDR, REJECT = 0.05, 11.34  # the latter: chi-squared of 3 degrees at 1 %
#: Words that can tell a share of FDR.
FEW = 100
#: Lower ends of the length classes, and the cells of the square root of the distance.
CLASSES, CELL, CELLS = (16, 20, 24, 32, 48), 0.25, 80
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets, smallest first: the token's form, its letters' case if they count as one, the symbols in order.
ALPHABETS = {
    "decimal": ("^[0-9]+$", None, _DIGITS),
    "hex": ("^[0-9a-fA-F]+$", "lower", _DIGITS + "abcdef"),
    "base32": ("^([a-z2-7]+|[A-Z2-7]+)$", "lower", _LOWER + "234567"),
    "base36": ("^([a-z0-9]+|[A-Z0-9]+)$", "lower", _LOWER + _DIGITS),
    "letters": ("^[A-Za-z]+$", None, _UPPER + _LOWER),
    "base62": ("^[A-Za-z0-9]+$", None, _UPPER + _LOWER + _DIGITS),
    "base64": ("", None, _UPPER + _LOWER + _DIGITS + "+/"),
}
NAMES = list(ALPHABETS)
#: Letters of one case; compounds of such words with numbers behind them.
PLAIN = "^([A-Za-z][a-z]+|[A-Z]+)$"
#: What compounds of words and numbers lack: a letter behind a number, or a capital that neither begins a word nor stands
#: among capitals alone.  Searched for, so no token is too long for a matcher's stack.
MIXED = "[0-9][A-Za-z]|[a-z][A-Z](?![a-z])|[A-Z][A-Z][a-z]"
_TESTED = "array<struct<start:bigint,end:bigint,word:boolean,cls:int,cells:array<int>,kind:int,distance:double>>"


def found(text: F.Column, pattern: str) -> F.Column:
    """array<struct<start, end>> of leftmost non-overlapping matches, in code points.

    What lies between matches is what split() leaves, so lengths add up to places.
    """
    return _where(text, pattern, lambda hits: _places(hits, F.split(text, pattern, -1)), "array<struct<start:bigint,end:bigint>>")


def _where(text: F.Column, pattern: str, then: Callable[[F.Column], F.Column], kind: str) -> F.Column:
    """then(matches), or an empty array of the kind where there are none; the text is searched once."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) > 0, then(h).cast(kind)).otherwise(F.array().cast(kind)))


def _places(hits: F.Column, gaps: F.Column) -> F.Column:
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.char_length(g).cast("long").alias("g"), F.char_length(h).cast("long").alias("h")))

    def place(b: F.Column) -> F.Column:
        at = running(F.transform(b, lambda x: x["g"] + x["h"]))
        return F.zip_with(b, at, lambda x, a: F.struct((a + x["g"]).alias("start"), (a + x["g"] + x["h"]).alias("end")))

    return let(both, place)


def base_spans(text: F.Column) -> F.Column:
    """array<struct<start, kind, end>> of the three patterns, in no order."""
    tag = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    def assigned(hits: F.Column) -> F.Column:
        values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
        pairs = F.zip_with(_places(hits, F.split(text, ASSIGN, -1)), values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.char_length(v) >= 8).alias("ok")))
        return tag(F.filter(pairs, lambda p: p["ok"]), 0)

    assign = _where(text, ASSIGN, assigned, "array<struct<start:bigint,kind:int,end:bigint>>")
    long_ = lambda pattern, n, kind: tag(F.filter(found(text, pattern), lambda s: s["end"] - s["start"] >= n), kind)
    # A run shorter than 32 is never a part of a longer run, so runs may be asked for as 32 and more.
    return F.concat(assign, long_(ACCESS, 16, 1), long_(HEX.replace("+", "{32,}"), 32, 2))


def tested(text: F.Column) -> F.Column:
    """array<struct<start, end, word, cls, cells, kind, distance>> of long tokens.

    A token has its alphabet's number (kind), one cell of the distance and the
    distance; an ordinary word has a cell for each alphabet that it is read in.
    """

    def judged(hits: F.Column) -> F.Column:
        scored = F.transform(hits, _judge)
        return F.zip_with(_places(hits, F.split(text, TOKEN, -1)), scored, lambda s, x: F.struct(s["start"].alias("start"), s["end"].alias("end"), *[x[n].alias(n) for n in ("word", "cls", "cells", "kind", "distance")]))

    return _where(text, TOKEN, judged, _TESTED)


def _judge(token: F.Column) -> F.Column:
    word = token.rlike("[A-Za-z0-9]") & ~token.rlike("^[0-9]+$") & ~token.rlike(MIXED)
    n = F.char_length(token)
    cls = sum((F.when(n >= c, 1).otherwise(0) for c in CLASSES[1:]), F.lit(0)).cast("int")
    kind = F.lit(len(NAMES) - 1)
    for i in range(len(NAMES) - 2, -1, -1):
        kind = F.when(token.rlike(ALPHABETS[NAMES[i]][0]), i).otherwise(kind)
    cell = lambda d: F.least(F.floor(F.sqrt(d) / CELL), F.lit(CELLS)).cast("int")
    as_word = F.struct(F.lit(True).alias("word"), cls.alias("cls"), F.array(*[F.when(token.rlike(PLAIN) | token.rlike(ALPHABETS[k][0]), cell(_distance(_symbols(token, k), k))) for k in NAMES]).alias("cells"), F.lit(-1).alias("kind"), F.lit(None).cast("double").alias("distance"))

    def as_token(kind: F.Column) -> F.Column:
        by_kind = F.coalesce(*[F.when(kind == i, _distance(_symbols(token, k), k)) for i, k in enumerate(NAMES)])
        return let(by_kind, lambda d: F.struct(F.lit(False).alias("word"), cls.alias("cls"), F.array(cell(d)).alias("cells"), kind.alias("kind"), d.alias("distance")))

    return F.when(word, as_word).otherwise(let(kind, as_token))


def _symbols(token: F.Column, name: str) -> F.Column:
    """The token's symbols as numbers; a letter that the alphabet lacks counts by its number modulo the size."""
    _, case, symbols = ALPHABETS[name]
    read = F.lower(token) if case or name == "decimal" else F.translate(token, "-_", "+/")
    lacks = "".join(c for c in _LOWER if c not in symbols) if name in ("decimal", "hex") else ""
    read = F.translate(read, lacks, "".join(symbols[_LOWER.index(c) % len(symbols)] for c in lacks)) if lacks else read
    return F.transform(F.split(read, r"(?!^)(?!$)", -1), lambda c: F.position(c, F.lit(symbols)) - 1)


def _distance(symbols: F.Column, name: str) -> F.Column:
    k = float(len(ALPHABETS[name][2]))

    def scores(x: F.Column) -> F.Column:
        n = F.size(x)
        m = n.cast("double")
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, s: a + F.pow(F.size(F.filter(x, lambda y: y == s)).cast("double"), F.lit(2.0)))
        chi = (squares * k / m - m - (k - 1)) / F.sqrt(F.lit(2 * (k - 1)))
        head, tail = F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(x, F.lit(2), F.greatest(n - 1, F.lit(0)))
        changes = F.aggregate(F.zip_with(head, tail, lambda a, b: F.when((a * 2 >= k) != (b * 2 >= k), 1.0).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
        runs = (changes - (m - 1) / 2) / F.sqrt((m - 1) / 4)
        middle = (k - 1) / 2
        product = F.aggregate(F.zip_with(head, tail, lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), lambda a, b: a + b)
        serial = product / ((k * k - 1) / 12) / F.sqrt(m - 1)
        plus = F.greatest(chi, F.lit(0.0))
        return plus * plus + runs * runs + serial * serial

    return let(symbols, scores)


def limits(scanned: DataFrame, column: str) -> dict[tuple[int, int], int]:
    """For each alphabet and length class the last cell of distance that false-discovery control lets through.

    One row for each alphabet, class and cell reaches the driver: their product at most.
    """
    each = scanned.select(F.explode(column).alias("t")).select("t.word", "t.cls", "t.kind", F.posexplode("t.cells").alias("i", "cell")).filter("cell is not null")
    kind = F.when(F.col("word"), F.col("i")).otherwise(F.col("kind"))
    table = each.groupBy(kind.alias("kind"), "cls", "cell").agg(F.sum(F.when(F.col("word"), 1).otherwise(0)).alias("words"), F.sum(F.when(~F.col("word"), 1).otherwise(0)).alias("tokens"))
    words, tokens = {}, {}
    for r in table.collect():
        words[r.kind, r.cls, r.cell], tokens[r.kind, r.cls, r.cell] = r.words, r.tokens
    out = {}
    for k in range(len(NAMES)):
        for c in range(len(CLASSES)):
            null, d = [0] * (CELLS + 1), c
            while d >= 0 and sum(null) < FEW:
                null, d = [n + words.get((k, d, i), 0) for i, n in enumerate(null)], d - 1
            seen = [tokens.get((k, c, i), 0) for i in range(CELLS + 1)]
            total, m, below, hits = sum(null), sum(seen), 0, 0
            for i in range(CELLS + 1):
                below, hits = below + null[i], hits + seen[i]
                if total and hits and (1 + below) / (1 + total) * m <= FDR * hits:
                    out[k, c] = i
    return out


def all_spans(base: F.Column, tokens: F.Column, through: dict[tuple[int, int], int]) -> F.Column:
    """array<struct<start, kind, end>>: base spans, and tokens within the limits that touch none of them."""
    allowed = F.array(*[F.lit(through.get((k, c), -1)) for k in range(len(NAMES)) for c in range(len(CLASSES))])
    good = F.filter(tokens, lambda t: ~t["word"] & (F.get(t["cells"], F.lit(0)) <= F.get(allowed, t["kind"] * len(CLASSES) + t["cls"])) & (t["distance"] <= REJECT))
    added = F.transform(good, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    free = F.filter(added, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return F.array_sort(F.concat(base, free))


def written(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row; texts are read once."""
    text = F.col("_text")
    scanned = docs.select("doc_id", whole("text").alias("_text")).select("doc_id", F.array_sort(base_spans(text)).alias("base"), tested(text).alias("tested"))
    scanned = stored(scanned)
    every = all_spans(F.col("base"), F.col("tested"), limits(scanned, "tested"))
    judged = scanned.select("doc_id", "base", every.alias("every"))
    count = lambda c, kind: F.size(F.filter(c, lambda s: s["kind"] == kind)).cast("long")
    return judged.select("doc_id", *[count("base", k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("every")).alias("spans"), count("every", 3).alias("n_random"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by a mark; touching spans get one.  Null text stays null.

    Texts are read twice: for the limits, then to replace.
    """
    t, b, k = (fresh(docs, x) for x in ("_t", "_base", "_tested"))
    clean = whole(text)
    scanned = docs.withColumn(t, clean)
    through = limits(docs.select(tested(clean).alias(k)), k)
    spans = all_spans(F.col(b), F.col(k), through)
    marked = scanned.withColumns({b: base_spans(F.col(t)), k: tested(F.col(t))}).withColumn(b, spans)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(acc: F.Column, s: F.Column) -> F.Column:
        before = F.substring(F.col(t), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        new = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], before, F.lit(mark)).alias("out"))
        return F.when(s["end"] <= acc["at"], acc).when(s["start"] < acc["at"], F.struct(s["end"].alias("at"), acc["out"].alias("out"))).otherwise(new)

    folded = F.aggregate(F.col(b), zero, add)
    rest = F.concat(folded["out"], F.substring(F.col(t), (folded["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return marked.withColumn(text, F.when(F.col(text).isNull() | (F.size(b) == 0), F.col(text)).otherwise(rest)).select(*docs.columns)
