"""Media columns: interleaved sequences of text and media references, payloads in a store keyed by digest.

A page is parsed into its ordered parts: texts, and references to media with their captions. Payloads stand in a store as
8-bit grey images (a header, then samples in rows of 64), keyed by the digest of the payload; a reference is resolved by a
join on the digest, so each keeps the position and caption of its page. The store is written and read again; what it
is asked for (hashes, sizes, features) is computed from the stored bytes where they lie, and only digests and numbers are
shuffled.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import INLINE, RAW, clean, tokens
from tidemark.llm.shared import empty_text, stage

ROW = 64
SCHEME = "sha256:"
PART = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_HEADER = re.compile(rb"P5\n(\d+) (\d+)\n# bytes (\d+)\n255\n")


def encode_image(data: bytes) -> bytes:
    """Bytes, padded with 0 to whole rows (one at least), as samples of a grey image; its comment holds their number."""
    rows = max(1, -(-len(data) // ROW))
    return b"P5\n%d %d\n# bytes %d\n255\n" % (ROW, rows, len(data)) + data.ljust(rows * ROW, b"\0")


def decode_image(stored: bytes) -> tuple[bytes, int]:
    """The samples of a stored image and the number of bytes before padding."""
    head = _HEADER.match(stored)
    width, height, n = (int(x) for x in head.groups())
    samples = stored[head.end() :]
    if len(samples) != width * height:
        raise ValueError("a stored image is cut short")
    return samples, n


def parts(page: str) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(position, kind, text, digest, caption) in page order.

    A figure's caption goes with its images; an image without one has its alternative text. Images that refer to no
    digest are references with a NULL digest.
    """
    out: list[list] = []
    held: list[str] = []
    figure: list[int] | None = None
    in_caption = False

    def end_text() -> None:
        text = clean("".join(held))
        held.clear()
        if text and in_caption and figure is not None:
            for i in figure:
                out[i][4] = text
        elif text:
            out.append([len(out), "text", text, None, None])

    skipping = 0
    for token in tokens(page):
        if isinstance(token, str):
            if not skipping:
                held.append(token)
            continue
        if token.name in RAW:
            skipping = 0 if token.closing else 1
            end_text()
            continue
        if token.name == "img":
            end_text()
            a = token.attributes()
            source = a.get("src", "")
            digest = source.removeprefix(SCHEME) if source.startswith(SCHEME) else None
            if figure is not None:
                figure.append(len(out))
            out.append([len(out), "media", None, digest, clean(a.get("alt", "")) or None])
        elif token.name not in INLINE:
            end_text()
            if token.name == "figure":
                figure = None if token.closing else []
            elif token.name == "figcaption":
                in_caption = not token.closing
    end_text()
    return [tuple(p) for p in out]


def interleaved(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """id and parts of every row; a NULL or empty page has no parts."""

    @F.pandas_udf(PART)
    def parsed(texts: pd.Series) -> pd.Series:
        names = ("position", "kind", "text", "digest", "caption")
        return texts.map(lambda t: [dict(zip(names, p)) for p in parts(t or "")])

    return pages.select(id_col, parsed(html_col).alias("parts"))


def resolved(sequences: DataFrame, store: DataFrame, id_col: str) -> DataFrame:
    """One row for each part with the columns of ``store``; every part stays, one without payload has NULLs there.

    The join is on the digest: Spark splits a digest that very many references share.
    """
    flat = sequences.select(id_col, F.explode("parts").alias("part")).select(id_col, "part.*")
    return flat.join(store, "digest", "left")


def read_back(media: DataFrame) -> DataFrame:
    """One row a digest: sizes, hashes and features of the stored bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, stored in zip(batch["digest"], batch["media"]):
                payload, n = decode_image(stored)
                own = hashlib.sha256(payload).hexdigest()
                if hashlib.sha256(payload[:n]).hexdigest() != digest:
                    raise ValueError(f"the payload stored under {digest} is another one")
                samples = np.frombuffer(payload, np.uint8)
                counts = np.bincount(samples, minlength=256)
                mean = float(counts @ np.arange(256)) / len(samples)
                spread = float(np.sqrt(max(0.0, counts @ np.square(np.arange(256)) / len(samples) - mean * mean)))
                share = counts[counts > 0] / len(samples)
                entropy = float(-(share * np.log2(share)).sum()) + 0.0
                feature = f"grey8;{ROW}x{len(samples) // ROW};mean={mean:.4f};std={spread:.4f};bits={entropy:.4f};levels={len(share)}"
                rows.append((digest, n, len(payload), own, zlib.crc32(payload[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", "media").mapInPandas(
        run,
        "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string",
    )


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pages, media): for every row a page that refers to its text as an image, and the stored images by digest.

    Rows of one text share a digest. The page has a heading before and a caption with the image.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages, digests, media = [], [], []
            for text in batch["text"]:
                data = text.encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(data).hexdigest()
                caption = entities.escape(" ".join(text[:200].split()[:8]))
                pages.append(f'<article><h1>document</h1><figure><img src="{SCHEME}{digest}"><figcaption>{caption}</figcaption></figure></article>')
                digests.append(digest)
                media.append(encode_image(data))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "html": pages, "digest": digests, "media": media})

    source = docs.select(F.col(id_col).alias("doc_id"), empty_text(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    made = stage(source.mapInPandas(run, f"doc_id {kind}, html string, digest string, media binary"), "media")
    return made.select("doc_id", "html"), made.select("digest", "media")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id and what its stored payload reads back as, with position and caption of the reference.

    A NULL text is empty: 64 zero bytes. Repeated rows give the same result each. Other columns are ignored; an empty table
    gives no rows.
    """
    pages, media = document_media(docs)
    read = read_back(media).dropDuplicates(["digest"])
    rows = resolved(interleaved(pages, "html", "doc_id"), read, "doc_id").where("kind = 'media'")
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        "feature", "position", F.coalesce("caption", F.lit("")).alias("caption"),
    )
