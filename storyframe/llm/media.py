"""Interleaved document sequences: ordered text and media references from HTML, resolved by digest.

Media are held by content: a store of (digest, media), where media is a portable greymap of 8-bit samples, 64 to a row,
whose comment keeps the number of bytes.  Sequences refer to media by digest; captions stay with their references.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

WIDTH = 64
_BLOCK = frozenset("address article aside blockquote dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul br figcaption".split())
_MEDIA = frozenset(("img", "video", "audio", "source", "embed"))
_SILENT = frozenset(("script", "style", "noscript", "template"))
_DIGEST = re.compile(r"sha256:([0-9a-f]{64})")


class _Reader(HTMLParser):
    """Ordered items of a page: (kind, text, ref, caption); a caption belongs to the references of its figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.silent, self.figure, self.caption = 0, None, None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if not text:
            return
        if self.caption is not None and self.figure is not None:
            for k in self.figure:
                self.items[k][3] = f"{self.items[k][3]} {text}".strip() if self.items[k][3] else text
            self.caption.append(text)
        else:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCK or tag in _MEDIA:
            self.flush()
        if tag == "figure":
            self.figure, self.pending = [], None
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA:
            attrs = dict(attrs)
            if attrs.get("src"):
                said = " ".join(self.caption) if self.caption else None
                self.items.append(["media", None, attrs["src"], said or (attrs.get("alt") or None if self.figure is None else None)])
                if self.figure is not None:
                    self.figure.append(len(self.items) - 1)
                    if getattr(self, "pending", None):
                        self.items[-1][3] = self.pending

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in _BLOCK:
            self.flush()
        if tag == "figcaption":
            self.pending, self.caption = " ".join(self.caption or []) or None, None
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def items(html: str) -> list[tuple]:
    """(pos, kind, text, ref, digest, caption) of a page, in order; malformed HTML gives what can be read."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return [(i, k, t, r, m[1] if r and (m := _DIGEST.search(r)) else None, c) for i, (k, t, r, c) in enumerate(reader.items)]


_ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
ITEM = "array<struct<pos int, kind string, text string, ref string, digest string, caption string>>"


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, items): the interleaved sequence of each page.  A null or empty page has an empty sequence."""

    def run(batches):
        for batch in batches:
            rows = [[dict(zip(_ITEM.names, i)) for i in items(h.as_py())] for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_ITEM))], [key, "items"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, F.col(html).cast("string").alias(html)).mapInArrow(run, f"{key} {kind}, items {ITEM}")


def resolve(sequences: DataFrame, media: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, kind, text, ref, digest, caption, then the columns of ``media``): one row per item, in place.

    ``media`` has one row per digest.  References that it doesn't know keep their place with nulls.
    """
    flat = sequences.select(key, F.explode("items").alias("i")).select(key, "i.*")
    return flat.join(media, "digest", "left")


def encode(text: bytes) -> tuple[bytes, str]:
    """The stored form of a text and its digest."""
    n = len(text)
    payload = text + bytes(-n % WIDTH if n else WIDTH)
    media = b"P5\n# %d bytes\n%d %d\n255\n" % (n, WIDTH, len(payload) // WIDTH) + payload
    return media, hashlib.sha256(media).hexdigest()


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """Number of bytes, and the samples (rows x 64)."""
    head = re.match(rb"P5\n# (\d+) bytes\n(\d+) (\d+)\n255\n", media)
    n, width, height = (int(x) for x in head.groups())
    return n, np.frombuffer(media, np.uint8, width * height, head.end()).reshape(height, width)


def feature(samples: np.ndarray) -> str:
    flat = samples.reshape(-1)
    total = sum(int(flat[a : a + (1 << 20)].sum(dtype=np.int64)) for a in range(0, len(flat), 1 << 20))
    seen = np.zeros(256, bool)
    seen[flat] = True
    edges = int((samples[:, 1:] != samples[:, :-1]).sum())
    return f"{samples.shape[1]}x{samples.shape[0]}:sum={total}:max={int(flat.max())}:kinds={int(seen.sum())}:edges={edges}"


def documents_as_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, html, digest, media): each document a page with one figure of its text; media once per task and text."""

    def run(batches):
        seen: set[str] = set()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            ids, at, size, out = batch.column(0), 0, 0, []
            for i in range(batch.num_rows):
                media, digest = encode(texts[i].as_py() or b"")
                name = ids[i].as_py()
                html = f'<article><h1>Document {name}</h1><figure><img src="sha256:{digest}"><figcaption>Text of document {name}</figcaption></figure></article>'
                if len(seen) > 1_000_000:
                    seen.clear()
                out.append((html, digest, None if digest in seen else media))
                seen.add(digest)
                size += len(media)
                if size > 1 << 23 or i + 1 == batch.num_rows:
                    h, d, m = zip(*out)
                    yield pa.RecordBatch.from_arrays([ids.slice(at, i + 1 - at), pa.array(h), pa.array(d), pa.array(m, pa.binary())], ["doc_id", "html", "digest", "media"])
                    at, size, out = i + 1, 0, []

    use = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return use.mapInArrow(run, "doc_id long, html string, digest string, media binary")


FACTS = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


def facts(store: DataFrame) -> DataFrame:
    """What the stored media hold, read back: one row per digest."""

    def run(batches):
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                media = media.as_py()
                n, samples = decode(media)
                payload = samples.tobytes()
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), feature(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [c.split()[0] for c in FACTS.split(", ")])

    got = store.select("digest", "media").where("media is not null").mapInArrow(run, FACTS)
    names = [c.split()[0] for c in FACTS.split(", ")][1:]
    return got.groupBy("digest").agg(*[F.min(c).alias(c) for c in names])


def document_media(docs: DataFrame) -> DataFrame:
    """(doc_id, caption, n_bytes, ..., media_sha256, feature): documents through the store and back.

    A null text is empty; an empty text has one row of zero samples.  Repeated rows give repeated rows; an empty table
    gives none; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    pages = written(documents_as_pages(docs), "media")
    # Written, so that the join shuffles plain rows and a digest that many documents share can be split.
    found = resolve(sequences(pages, "doc_id"), written(facts(pages), "facts"), "doc_id").where("kind = 'media'")
    return found.withColumn("media_sha256", F.col("digest"))
