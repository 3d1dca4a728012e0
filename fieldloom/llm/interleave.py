"""Interleaved document sequences of text and media.

HTML is parsed into an ordered array of structs (position, kind, text, ref,
caption).  Media are addressed by the SHA-256 of their payload; a join on the
digest resolves each reference, and position and caption stay with it.  What the
join carries are the facts read from the stored bytes, so payloads themselves
are not shuffled; they are stored by the task that reads them, once for each row
(once for each digest would take a shuffle of all payloads), and equal ones
resolve to one digest.

Payloads are stored as binary PPM images of 64 pixels a row, 8 bits a sample:
192 payload bytes are one row, which is why payloads are padded to 192.

Defined cases: null HTML gives no items; null text is the empty text, whose
payload is 192 blanks; a caption of a figure without media is text; tags that
HTML lets out (head, body, ends of paragraphs and figures) may lack; a reference that nothing
resolves stays with null facts; void or unclosed tags and broken markup never
fail.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._common import in_short_batches, pieces, stored, struct, whole

UNIT, WIDTH = 192, 64
ITEMS = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("kind", "text", "ref", "caption")]]))
FACTS = T.StructType([T.StructField(n, T.LongType() if n[-5:] in ("bytes", "crc32") else T.StringType()) for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])
_BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th tr ul video audio body html".split())
_MUTE = frozenset("script style template noscript title".split())
_MEDIA = frozenset("img video audio source embed".split())


def _tidy(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class Sequence(HTMLParser):
    """Items of one page in reading order.

    A caption is kept for all media of its figure, before or behind it, that no
    inner figure's caption names; without such media it is a text item.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.mute: list[str] = []
        self.figures: list[tuple[list[int], list[str]]] = []  # items and captions of the open figures
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text, self.words = _tidy(self.words), []
        if text:
            self._add("text", text, None, None)

    def _add(self, kind: str, text: str | None, ref: str | None, caption: str | None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "ref": ref, "caption": caption})

    def _break(self) -> None:
        if self.caption is None:
            self.flush()
        else:
            self.caption.append(" ")

    def _end_caption(self) -> None:
        if self.caption is not None:
            self.figures[-1][1].append(_tidy(self.caption))
            self.caption = None

    def _end_figure(self) -> None:
        self._end_caption()
        self.flush()
        media, said = self.figures.pop()
        caption = _tidy([" ".join(said)])
        if not caption:
            if self.figures:
                self.figures[-1][0].extend(media)
        elif media:
            for i in media:
                self.items[i]["caption"] = caption
        else:
            self._add("text", caption, None, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.mute[-1:] == ["title"]:  # which holds no tags, so it was left open
            self.mute.pop()
        if tag in _MUTE:
            self.mute.append(tag)
        if tag in _BREAKS:
            self._break()
        if tag == "figure":
            self._end_caption()
            self.figures.append(([], []))
        elif tag == "figcaption" and self.figures:
            self._end_caption()
            self.flush()
            self.caption = []
        elif tag in _MEDIA and not self.mute:
            have = dict(attrs)
            if have.get("src"):
                self._break()
                if self.figures:
                    self.figures[-1][0].append(len(self.items))
                self._add("media", None, have["src"], have.get("alt") or None)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in _MUTE:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.mute:
            while self.mute.pop() != tag:
                pass
        if tag == "figcaption":
            self._end_caption()
        if tag == "figure" and self.figures:
            self._end_figure()
        elif tag in _BREAKS:
            self._break()

    def handle_data(self, data: str) -> None:
        if not self.mute:
            (self.words if self.caption is None else self.caption).append(data)

    def finish(self) -> list[dict]:
        self.close()
        while self.figures:
            self._end_figure()
        self.flush()
        return self.items


def parse(html: str | None) -> list[dict]:
    page = Sequence()
    page.feed(html or "")
    return page.finish()


@F.arrow_udf(ITEMS)
def items(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for x in pages:
        yield pa.array([parse(h) for some in pieces(x) for h in some.to_pylist()], to_arrow_type(ITEMS))


def sequences(pages: DataFrame, id: str, html: str = "html") -> DataFrame:  # noqa: A002
    """(id, position, kind, text, ref, caption), a row for each item."""
    return pages.select(F.col(id), F.inline(items(F.col(html))))


def payload(text: str) -> F.Column:
    """UTF-8 bytes of a text column, with blanks up to a positive multiple of UNIT."""
    n = F.octet_length(whole(text))
    blanks = F.when(n == 0, UNIT).otherwise(F.pmod(-n, F.lit(UNIT)))
    return F.concat(whole(text), F.repeat(F.lit(" "), blanks)).cast("binary")


def image(data: F.Column) -> F.Column:
    """The stored form of a payload: a binary PPM."""
    head = F.concat(F.lit(f"P6\n{WIDTH} "), (F.octet_length(data) / UNIT).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(head.cast("binary"), data)


_HEAD = re.compile(rb"P6\s+(\d+)\s+(\d+)\s+255\s")


def samples(stored_form: bytes) -> tuple[np.ndarray, bytes]:
    """Pixels (rows, columns, 3) and the payload of a stored image."""
    head = _HEAD.match(stored_form)
    if not head:
        raise ValueError("these bytes are no 8-bit PPM")
    data = stored_form[head.end() :]
    return np.frombuffer(data, np.uint8).reshape(int(head[2]), int(head[1]), 3), data


def feature(pixels: np.ndarray) -> str:
    """Size, mean and deviation of each channel in hundredths, and the mean hash of an 8 x 8 thumbnail."""
    flat = pixels.reshape(-1, 3).astype(np.int64)
    n = len(flat)
    total, square = flat.sum(axis=0), (flat * flat).sum(axis=0)
    mean = total * 100 // n
    spread = [int(np.sqrt(float(q * n - t * t)) * 100 / n) for t, q in zip(total.tolist(), square.tolist(), strict=True)]
    gray = pixels.sum(axis=2, dtype=np.int64)
    cells = np.add.reduceat(np.add.reduceat(gray, np.arange(8) * pixels.shape[1] // 8, axis=1), np.arange(8) * pixels.shape[0] // 8, axis=0)
    bits = (cells * 64 >= cells.sum()).ravel()
    return f"{pixels.shape[1]}x{pixels.shape[0]} mean={','.join(map(str, mean.tolist()))} sd={','.join(map(str, spread))} hash={np.packbits(bits).tobytes().hex()}"


@F.arrow_udf(FACTS)
def facts(media: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What the stored bytes say."""
    for column in media:
        rows = []
        for raw in column:
            raw = raw.as_py()
            pixels, data = samples(raw)
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(pixels)))
        yield struct(rows, FACTS)


REF = "media:sha256:"


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, media): the texts' payloads as stored images, read from the shared folder."""
    made = docs.select(payload(text).alias("p")).select(F.sha2("p", 256).alias("digest"), image(F.col("p")).alias("media"))
    return stored(made, compression="zstd")


def pages_of(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:  # noqa: A002
    """(doc_id, n_bytes, html): a page for each document that shows its payload with a caption."""
    digest = F.sha2(payload(text), 256)
    name = F.coalesce(F.col(id).cast("string"), F.lit(""))
    html = F.concat(F.lit("<article><p>Document "), name, F.lit(f'</p><figure><img src="{REF}'), digest, F.lit('" alt=""><figcaption>Text of '), name, F.lit("</figcaption></figure></article>"))
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.octet_length(whole(text)).cast("long").alias("n_bytes"), html.alias("html"))


def resolve(sequence: DataFrame, media: DataFrame) -> DataFrame:
    """sequence's rows with the facts of the media that `ref` names; one row each, whatever repeats in media."""
    told = media.select("digest", facts(F.col("media")).alias("f"))
    once = stored(told.groupBy("digest").agg(*[F.min(f"f.{c}").alias(c) for c in FACTS.names]))
    named = sequence.withColumn("digest", F.when(F.col("ref").startswith(REF), F.substring("ref", len(REF) + 1, 64)))
    return named.join(once, "digest", "left")


def report(docs: DataFrame) -> DataFrame:
    """For each document the facts of its stored payload, found through its page."""
    media = store_texts(in_short_batches(docs))
    seen = pages_of(docs).select("doc_id", "n_bytes", F.inline(items(F.col("html")))).filter("kind = 'media'")
    out = resolve(seen, media)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
