"""Media columns: bytes kept as lossless pictures, read back and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import bounded_batches, chunks

#: Pictures are coded in step in groups of about so many characters or bytes, so that a step's fixed cost is shared by many.
GROUP = 1 << 22


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's bytes filled up with zeros to a positive multiple of 64, and how many were its own."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def feature(payload: bytes) -> str:
    """Mean of each of the 16 pixel columns over all rows and channels, as 16 two-digit hexadecimal numbers."""
    columns = np.frombuffer(payload, np.uint8).reshape(-1, 16, 4)
    return bytes(columns.mean((0, 2)).astype(np.uint8).tolist()).hex()


def to_media(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a lossless WebP file. A null text counts as empty; it gives 64 zero bytes.

    Texts of any length are stored whole. Repeated rows give repeated files, equal texts equal ones; rows of a null id keep
    it. An empty table gives an empty result. Other columns, of any name, don't matter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for a, b in chunks(texts, GROUP):
                pairs = [padded(t) for t in texts[a:b]]
                yield pd.DataFrame({"id": batch["id"].to_numpy()[a:b], "n_bytes": [n for _, n in pairs], "media": webp.write_payloads([p for p, _ in pairs])})

    bounded_batches(rows)
    narrow = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(run, "id string, n_bytes long, media binary").withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)


def read_media(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, payload digests, media digests, feature) from stored files alone.

    Any lossless WebP file can be read. Equal files give equal values; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = batch["media"].tolist()
            for a, b in chunks(files, GROUP):
                payloads = webp.read_payloads(files[a:b])
                yield pd.DataFrame({
                    "id": batch["id"].to_numpy()[a:b],
                    "n_bytes": batch["n_bytes"].to_numpy()[a:b],
                    "payload_bytes": [len(p) for p in payloads],
                    "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
                    "tail_crc32": [zlib.crc32(p[-64:]) for p in payloads],
                    "media_bytes": [len(m) for m in files[a:b]],
                    "media_sha256": [hashlib.sha256(m).hexdigest() for m in files[a:b]],
                    "feature": [feature(p) for p in payloads],
                })

    narrow = rows.select(F.col(id_col).cast("string").alias("id"), "n_bytes", F.col(media_col).alias("media"))
    schema = "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return narrow.mapInPandas(run, schema).withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)
