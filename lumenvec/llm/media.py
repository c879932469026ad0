"""Interleaved documents: HTML parsed to ordered items, media resolved by digest.

``parse_sequences`` turns HTML into one row per item: text runs and media
references in document order, each with its position, and a caption for media
inside a <figure>.  ``resolve`` joins the references to a media table by digest,
so payloads are carried once whatever the number of references to them.

A payload is stored losslessly as an 8-bit greyscale PNG of width 64; the
stored bytes are read back and checked before features are computed.

Edge cases: null or empty texts give a payload of 64 zero bytes; null HTML has
no items; a reference without stored media keeps its row with null media
columns; equal payloads share one stored form; duplicate rows stay duplicates;
only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, pick, utf8

UNIT = 64
SCHEME = "urn:sha256:"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(payload: bytes, level: int = 6) -> bytes:
    """8-bit greyscale PNG of width 64; the payload must be a positive multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    framed = np.zeros((len(rows), UNIT + 1), np.uint8)  # filter type 0 before each row
    framed[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    body = zlib.compress(framed.tobytes(), level)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def png_decode(blob: bytes) -> bytes:
    """The samples of a PNG that png_encode() wrote; ValueError if it is damaged."""
    if blob[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, shape, data = 8, None, []
    while at < len(blob):
        (n,) = struct.unpack_from(">I", blob, at)
        kind, body = blob[at + 4 : at + 8], blob[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", blob, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("unsupported PNG")
    framed = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if framed[:, 0].any():
        raise ValueError("unsupported PNG filter")
    return framed[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Height, mean and deviation of the samples, entropy in bits."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    return (
        f"h={len(samples) // UNIT};mean={samples.mean(dtype=np.float64):.4f};"
        f"std={samples.std(dtype=np.float64):.4f};entropy={-(share * np.log2(share)).sum() + 0.0:.4f}"
    )


class _Items(HTMLParser):
    """Text runs and <img>/<audio>/<video> references in order."""

    SKIP = {"script", "style", "title"}
    BLOCK = {"p", "div", "figure", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4",
             "table", "tr", "td", "br", "nav", "footer", "header", "body", "blockquote"}
    MEDIA = {"img": "image", "audio": "audio", "video": "video"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.skip = [], [], 0
        self.figure, self.in_caption, self.caption = [], False, []

    def end_text(self):
        if text := " ".join("".join(self.text).split()):
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.text = []

    def end_figure(self):
        if caption := " ".join("".join(self.caption).split()):
            for item in self.figure:
                item["caption"] = caption
        self.figure, self.caption, self.in_caption = [], [], False

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.BLOCK or tag in self.MEDIA:  # also ends a caption that was left open
            self.in_caption = False
        if tag in self.MEDIA:
            self.end_text()
            attrs = dict(attrs)
            item = {"kind": self.MEDIA[tag], "text": None, "ref": attrs.get("src") or "",
                    "caption": attrs.get("alt") or None}
            self.items.append(item)
            self.figure.append(item)
        elif tag == "figcaption":
            self.end_text()
            self.in_caption = True
        elif tag in self.BLOCK:
            self.end_text()
            if tag == "figure":
                self.end_figure()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.in_caption = False
        elif tag in self.BLOCK:
            self.in_caption = False
            self.end_text()
            if tag == "figure":
                self.end_figure()

    def handle_data(self, data):
        if not self.skip:
            (self.caption if self.in_caption else self.text).append(data)


def parse_html(html: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    parser.end_text()
    parser.end_figure()
    return parser.items


def parse_sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, position, kind, text, ref, digest, caption[, kept columns]): the items of each page in order."""

    def rows(cols):
        kept = [f"keep_{c}" for c in keep]
        out = {k: [] for k in ("id", "position", "kind", "text", "ref", "digest", "caption", *kept)}
        for at, (key, html) in enumerate(zip(cols["id"], cols["html"], strict=True)):
            own = {k: cols[k][at] for k in kept}
            for i, item in enumerate(parse_html(html)):
                ref = item["ref"]
                digest = ref[len(SCHEME) :] if ref and ref.startswith(SCHEME) else None
                for k, v in (item | own | {"id": key, "position": i, "digest": digest}).items():
                    out[k].append(v)
        return out

    source = pick(pages, id=id_col, html=html_col, **{f"keep_{c}": c for c in keep})
    kind = source.schema["id"].dataType.simpleString()
    kept = "".join(f", keep_{c} {source.schema[f'keep_{c}'].dataType.simpleString()}" for c in keep)
    schema = f"id {kind}, position bigint, kind string, text string, ref string, digest string, caption string{kept}"
    return arrow_map(source, rows, schema).withColumnsRenamed({"id": id_col} | {f"keep_{c}": c for c in keep})


def payloads(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, payload) of every text: UTF-8 and zero bytes up to a multiple of 64."""
    raw = pick(docs, text=text_col).select(utf8("text").alias("raw"))
    n = F.octet_length("raw")
    padded = F.greatest(F.lit(1), F.ceil(n / UNIT)).cast("int") * UNIT
    padded_text = raw.select(F.rpad("raw", padded, F.lit(b"\0")).alias("payload"))
    return padded_text.select(F.sha2("payload", 256).alias("digest"), "payload")


def store_media(media: DataFrame) -> DataFrame:
    """(digest, blob): payloads as PNG, written to the shared folder and read from there.

    No shuffle: copies that a task meets together are stored once, others
    again; what is computed from them folds by digest.
    """

    def rows(cols):
        once = dict(zip(cols["digest"], cols["payload"], strict=True))
        return {"digest": list(once), "blob": [png_encode(p) for p in once.values()]}

    return Scratch(media.sparkSession, "media").store("blobs", arrow_map(media, rows, "digest string, blob binary"))


def media_features(stored: DataFrame) -> DataFrame:
    """Features of stored media, computed from the bytes read back; a row per digest."""

    def rows(cols):
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for digest, blob in zip(cols["digest"], cols["blob"], strict=True):
            payload = png_decode(blob)
            sha = hashlib.sha256(payload).hexdigest()
            if sha != digest:
                raise ValueError(f"stored media {digest} reads back as {sha}")
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(sha)
            out["tail_crc32"].append(zlib.crc32(payload[-UNIT:]))
            out["media_bytes"].append(len(blob))
            out["media_sha256"].append(hashlib.sha256(blob).hexdigest())
            out["feature"].append(feature(payload))
        return {"digest": cols["digest"], **out}

    schema = (
        "digest string, payload_bytes bigint, payload_sha256 string, "
        "tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
    return arrow_map(stored, rows, schema).dropDuplicates(["digest"])


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """Join media columns to the references of a sequence by digest; rows stay aligned."""
    return sequences.join(media, "digest", "left")


def document_html(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, html): each document as an interleaved page: a heading and a figure that refers to its payload."""
    raw = pick(docs, id=id_col, text=text_col).select("id", utf8("text").alias("raw"))
    n = F.octet_length("raw")
    padded = F.greatest(F.lit(1), F.ceil(n / UNIT)).cast("int") * UNIT
    digest = F.sha2(F.rpad("raw", padded, F.lit(b"\0")), 256)
    html = F.concat(
        F.lit("<article><p>document</p><figure><img src='" + SCHEME), digest,
        F.lit("'><figcaption>"), n.cast("string"), F.lit(" bytes</figcaption></figure></article>"),
    )
    return raw.select(F.col("id").alias(id_col), n.cast("bigint").alias("n_bytes"), html.alias("html"))
