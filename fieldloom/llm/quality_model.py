"""Quality classifier from weak labels.

Overlapping heuristics vote bad, good or abstain on every text, once for quality
and once for toxicity; where labels are given, the annotator is one more labeller
of toxicity, who abstains on all other texts.  Expectation-maximisation estimates
each one's accuracy from how votes agree, on counts of vote patterns over all
documents (at most 3 to the number of labellers, whatever the corpus).  The
posteriors label a bounded sample of rows (TRAIN, and KNOWN annotated ones), on
which a linear scorer over hashed word features is fitted for each; they then
score every whole text.

Defined cases: null text is empty; a text without words scores 0; no bad votes
anywhere give posteriors near the prior; with nothing to train on every text
with words is scored by the prior; repeated rows are rows of their own; a null
label abstains, and so do labels of one id that disagree; other columns of docs
and labels are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from ._common import in_short_batches, pieces, stored, struct, temporary
from .quality_rules import _SYMBOL, _WORD, COUNTS, count

#: Rows that the scorers are fitted on at most (expected numbers; picked by hash): weakly labelled ones, and ones with known toxicity.
TRAIN, KNOWN = 2500, 4000
#: Sizes of the hashed features' spaces, side by side: the word, its first 4 and 6 bytes, its shape, its repetition.
SPACES = (1 << 17, 1 << 16, 1 << 16, 1 << 10, 1 << 2)
FEATURES = sum(SPACES)
#: What a row without an annotator's vote weighs where there are annotated ones.
WEAK = 0.05
#: Abuse in the languages of the tables, a heuristic matter of the second model, and who is spoken to.
INSULTS = re.compile(
    r"\b(?:(?:idiot|moron|loser|imbecile|clown|trash|scum|fool|coward|liar|parasite|freak|degenerate|vermin)s?|stupid|pathetic|worthless|disgusting|dumb|garbage|filth|"
    r"(?:idiote|imbécile|crétin|débile|abruti|salaud|ordure|minable|dégoûtant|pourriture|raclure|menteur|lâche|parasite)s?|pathétique|stupide|"
    r"idioten|dumm(?:e[rs]?|kopf)?|trottel|abschaum|versager|arschloch|dreck|erbärmlich(?:e[rs]?)?|widerlich(?:e[rs]?)?|wertlos(?:e[rs]?)?|lügner|feigling|parasiten|müll|"
    r"(?:idiota|imbécil|estúpid[oa]|patétic[oa]|asqueros[oa]|inútil|basura|escoria|mentiros[oa]|cobarde|payas[oa]|parásito)(?:e?s)?)\b",
    re.IGNORECASE,
)
SPOKEN = re.compile(r"\b(?:you|your|u|du|dich|dein|ihr|euch|tu|toi|vous|votre|tú|eres|ustedes|vosotros|sois)\b", re.IGNORECASE)
#: For each model, name: (good up to, bad from), in thousandths of words or lines unless said.
HEURISTICS = {
    "quality": {"symbols": (20, 200), "symbol_words": (20, 200), "dup_lines": (100, 500), "repeats": (200, 600), "stutter": (30, 200), "upper": (100, 400), "long_words": (9000, 14000), "marks": (30, 300)},
    "toxic": {"insults": (0, 3), "distinct_insults": (0, 2), "insulting_lines": (0, 100), "addressed": (0, 1)},
}
#: How often an annotator errs.
SLIP = 0.001
#: P(vote | class) for votes bad, abstain, good where EM starts: a good text, a text with this heuristic's fault, with another.
GOOD, FAULT, OTHER = np.array([0.005, 0.05, 0.945]), np.array([0.8, 0.1, 0.1]), np.array([0.2, 0.1, 0.7])


@lru_cache(1 << 16)
def _insulting(word: str) -> bool:
    return INSULTS.search(word) is not None


def rates(text: str | None) -> dict[str, tuple[int, ...]]:
    """The heuristics' rates of one whole text."""
    n, chars, symbols, dups, repeats, lines, upper = count(text)
    if not n:
        return {"quality": (1000,) * 8, "toxic": (0,) * 4}
    text = text or ""
    split = _WORD.findall(text)
    stutter = sum(map(eq, split, islice(split, 1, None)))
    with_symbol = sum(map(bool, map(_SYMBOL.search, split))) if symbols else 0
    marks = text.count("!") + text.count("|") + text.count("?")
    # No insult has white space inside, so a text without one in its distinct words has none.
    found = [(m.start(), m[0].lower()) for m in INSULTS.finditer(text)] if any(map(_insulting, set(split))) else []
    lewd = sum(bool(INSULTS.search(x)) for x in text.split("\n")) if found else 0
    told = sum(bool(SPOKEN.search(text, max(0, at - 40), at)) for at, _ in found)  # within some words before
    return {
        "quality": (symbols * 1000 // n, with_symbol * 1000 // n, dups * 1000 // max(1, lines), repeats * 1000 // n, stutter * 1000 // n, upper * 1000 // n, chars * 1000 // n, marks * 1000 // n),
        "toxic": (len(found) * 1000 // n, len({x for _, x in found}), lewd * 1000 // max(1, lines), told),
    }


def votes(text: str | None) -> tuple[int, ...]:
    """For each model its votes (0 bad, 1 abstain, 2 good) as one number in base 3."""
    out = []
    for own, limits in zip(rates(text).values(), HEURISTICS.values(), strict=True):
        number = 0
        for r, (good, bad) in zip(own, limits.values(), strict=True):
            number = number * 3 + (2 if r <= good else 0 if r >= bad else 1)
        out.append(number)
    return tuple(out)


def fit_labels(patterns: np.ndarray, n: np.ndarray, k: int, steps: int = 200, annotated: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern of k labellers, and P(vote | class) as (labeller, vote, class).

    Bad texts are of k kinds (one shouts, another repeats itself), within which votes are independent; class 0 is good.
    Labeller j's accuracy is given[j, 2, 0] on good texts and given[j, 0, 1 + j] on those with its fault.
    annotated: the last labeller is the annotator, who abstains at random and else errs with chance SLIP; that is not
    estimated but anchors the rest, and the kind of that labeller is what no heuristic sees.
    """
    v = (np.asarray(patterns)[:, None] // 3 ** np.arange(k - 1, -1, -1)) % 3
    start = np.stack([np.stack([GOOD, *[FAULT if c == j else OTHER for c in range(k)]], axis=1) for j in range(k)])
    if annotated:
        silent = float(n[v[:, -1] == 1].sum() / max(1.0, n.sum()))
        right, wrong = (1 - silent) * (1 - SLIP) + 1e-9, (1 - silent) * SLIP + 1e-9
        start[-1] = np.array([[wrong, *[right] * k], [silent + 1e-9] * (k + 1), [right, *[wrong] * k]])
    given, prior = start.copy(), np.append(0.7, np.full(k, 0.3 / k))
    post = np.full((len(v), k + 1), 0.5)
    for _ in range(steps):
        logs = np.log(prior) + sum(np.log(given[j, v[:, j]]) for j in range(k))
        logs -= logs.max(axis=1, keepdims=True)
        new = np.exp(logs)
        new /= new.sum(axis=1, keepdims=True)
        moved, post = np.abs(new - post).max(initial=0.0), new
        mass = post * n[:, None]
        prior = (mass.sum(axis=0) + 1) / (n.sum() + k + 1)
        for j in range(k - annotated):
            for c in range(3):
                # A few counts of the start, so that no heuristic is ever certain.
                given[j, c] = mass[v[:, j] == c].sum(axis=0) + 5 * start[j, c]
            given[j] /= given[j].sum(axis=0)
        if moved < 1e-9:
            break
    return post[:, 0], given


#: Kind of a byte: other, lower, upper, digit, mark, symbol, beyond ASCII.
_KIND = np.zeros(256, np.int64)
for _n, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:!?'\"()-", b"#*$%&|<>", range(128, 256)), 1):
    _KIND[list(_bytes)] = _n
_FIRSTS = np.cumsum([0, *SPACES[:-1]])


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each part of rows: hashed features of all words (one column for each of SPACES), and the index of each row's first word."""
    data, offsets = words.buffers(column)
    for a, b in words.parts(offsets):
        own = data[offsets[a] : offsets[b]]
        starts, ends, first = words.spans(own, offsets[a : b + 1] - offsets[a])
        if not len(starts):
            yield np.zeros((0, len(SPACES)), np.int64), first
            continue
        hashed = words.Bytes(own).hashes
        word = hashed(starts, ends)
        heads = [hashed(starts, np.minimum(ends, starts + k)) for k in (4, 6)]
        shape = (_KIND[own[starts]] * 7 + _KIND[own[ends - 1]]) * 16 + np.minimum(ends - starts, 15)
        columns = [*(x % np.uint64(n) for x, n in zip((word, *heads), SPACES, strict=False)), shape, _repetition(word, first)]
        yield np.stack([x.astype(np.int64) + at for x, at in zip(columns, _FIRSTS, strict=True)], axis=1), first


def _repetition(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word 0; 1 in a three-word window that its row has twice or more; 2 if it equals the word before."""
    row = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    out = np.zeros(len(word), np.int64)
    if len(word) > 3:
        with np.errstate(over="ignore"):
            windows = words.shingles(word, 3) + row[2:] * np.uint64(0x9E3779B97F4A7C15)
        _, inverse, n = np.unique(windows, return_inverse=True, return_counts=True)
        at = np.flatnonzero((n[inverse] > 1) & (row[2:] == row[:-2]))
        for j in range(3):
            out[at + j] = 1
    out[1:][(word[1:] == word[:-1]) & (row[1:] == row[:-1])] = 2
    return out


VOTES = T.StructType([T.StructField(m, T.IntegerType()) for m in HEURISTICS])


@F.arrow_udf(VOTES)
def _votes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for x in texts:
        yield struct([votes(t) for some in pieces(x) for t in some.to_pylist()], VOTES)


SAMPLE = "lot long, quality int, toxic int, i binary, x binary"


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for both, first in _features(batch.column(3)):
            for i in range(len(first) - 1):
                index, n = np.unique(both[first[i] : first[i + 1]], return_counts=True)
                rows.append((index.astype("<i4").tobytes(), (n / np.sqrt(max(1, n.sum()))).astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["lot", *HEURISTICS, "i", "x"])


def _sampled(rows: DataFrame, most: int) -> list:
    """Features of rows (lot, quality, toxic, text), the `most` with the least lots if there are more."""
    return [r for r in rows.mapInArrow(_sampler, SAMPLE).orderBy("lot", "i").limit(most).collect() if len(r.i)]


def fit_scorer(rows: list, y: np.ndarray, worth: np.ndarray | None = None, steps: int = 120, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer, by full-batch Adam.

    worth: what each row weighs.  Features of a single row say nothing about others and are left at 0.
    """
    index = [np.frombuffer(r.i, "<i4") for r in rows]
    w = np.zeros(FEATURES + 1)
    if not rows:
        return w
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) for i in index])
    flat, x = np.concatenate(index), np.concatenate([np.frombuffer(r.x, "<f4") for r in rows])
    shared = (np.bincount(flat, minlength=FEATURES) > 1)[flat]
    owner, flat, x = owner[shared], flat[shared], x[shared]
    worth = np.ones(len(rows)) if worth is None else worth
    share = np.clip((y * worth).sum() / worth.sum(), 0.05, 0.95)
    weight = worth * (y / share + (1 - y) / (1 - share))  # both classes weigh alike
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[flat] * x, len(rows)) + w[-1], -30, 30)))
        e = (p - y) * weight / weight.sum()
        g = np.append(np.bincount(flat, e[owner] * x, FEATURES), e.sum()) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
    return w


SCORES = T.StructType([T.StructField(m, T.DoubleType()) for m in HEURISTICS])


def _scorer(weights: np.ndarray):
    """A column function: a text's score by each model's weights."""

    @F.arrow_udf(SCORES)
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in texts:
            out = [np.zeros((0, len(weights)))]
            for both, first in _features(x):
                n = np.diff(first)
                part = np.zeros((len(n), len(weights)))
                for k, w in enumerate(weights):
                    total = np.concatenate([[0.0], np.cumsum(w[both].sum(axis=1))])
                    z = (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(1, len(SPACES) * n)) + w[-1]
                    part[:, k] = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
                out.append(part)
            yield pa.StructArray.from_arrays([pa.array(c) for c in np.concatenate(out).T], names=SCORES.names)

    return score


def _annotated(labelled: DataFrame) -> DataFrame:
    """(_id, said): the annotator's vote on each labelled id, 0 toxic, 2 not."""
    known = labelled.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("_id is not null and toxic is not null")
    one = known.groupBy("_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high")).filter("low = high")
    return one.select("_id", F.when(F.col("low") > 0, 0).otherwise(2).alias("said"))


def classify(docs: DataFrame, labelled: DataFrame | None = None, train: int = TRAIN, known: int = KNOWN) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, score, kept (quality), toxic_score, toxic.

    labelled (doc_id, toxic), if given, is the annotator's.  Rows of the sample without an annotator's vote weigh WEAK
    for toxicity then; quality is learnt from heuristics alone.  Texts are read for their votes, for the samples and to
    be scored; none is shuffled but those picked.
    """
    docs = in_short_batches(docs).select("doc_id", "text")
    lot = F.xxhash64("doc_id", "text")
    picked_by = lambda share: F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    with temporary(docs.sparkSession):
        voted = docs.select("doc_id", _votes(F.col("text")).alias("v")).select("doc_id", *[F.col(f"v.{m}").alias(m) for m in HEURISTICS])
        told = stored(_annotated(labelled)) if labelled is not None else None
        if told is not None:
            said = F.coalesce("said", F.lit(1))
            voted = voted.join(told, F.col("doc_id") == F.col("_id"), "left").withColumn("toxic", F.col("toxic") * 3 + said)
        table = stored(voted.groupBy(*HEURISTICS).agg(F.count("*").alias("n"))).collect()  # 3 to the number of labellers rows at most
        if not table:
            return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("kept"), F.lit(0.0).alias("toxic_score"), F.lit(False).alias("toxic"))
        some = docs.filter(picked_by(min(1.0, train / sum(r.n for r in table))))
        votes_of = lambda df, said: df.select(lot.alias("lot"), _votes(F.col("text")).alias("v"), said.alias("said"), "text").select("lot", F.col("v.quality").alias("quality"), (F.col("v.toxic") * 3 + F.col("said") if told is not None else F.col("v.toxic")).alias("toxic"), "text")
        rows, checked = _sampled(votes_of(some, F.lit(1)), 2 * train), []
        if told is not None:
            share = min(1.0, known / max(1, told.count()))
            few = told.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(F.xxhash64("_id")).limit(2 * known)
            checked = _sampled(votes_of(docs.join(F.broadcast(few), F.col("doc_id") == F.col("_id")), F.col("said")), 2 * known)
    weights = []
    for m, own in HEURISTICS.items():
        counts: dict[int, int] = {}
        for r in table:
            counts[r[m]] = counts.get(r[m], 0) + r.n
        annotator = int(m == "toxic" and told is not None)
        post, _ = fit_labels(np.array(list(counts)), np.array(list(counts.values()), np.float64), len(own) + annotator, annotated=bool(annotator))
        label = dict(zip(counts, post.tolist(), strict=True))
        used = rows + (checked if annotator else [])
        worth = np.repeat([WEAK if annotator and checked else 1.0, 1.0], [len(rows), len(used) - len(rows)])
        weights.append(fit_scorer(used, np.array([label.get(r[m], 0.5) for r in used]), worth))
    scored = docs.select("doc_id", _scorer(np.array(weights))(F.col("text")).alias("s"))
    return scored.select("doc_id", F.col("s.quality").alias("score"), (F.col("s.quality") >= 0.5).alias("kept"), (1 - F.col("s.toxic")).alias("toxic_score"), (F.col("s.toxic") < 0.5).alias("toxic"))
