"""Media columns: payloads kept as progressive JPEGs, and pictures as full-resolution RGB tensors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm import jpeg
from canopygrid.llm.tables import utf8

BLOCK = 64
# Bytes of decoded tensors handed on at a time.
AT_ONCE = 16 << 20


def payload_of(column: str = "text") -> Column:
    """A text's bytes with bytes 0 up to a positive multiple of 64; null is empty."""
    data = utf8(column)
    size = F.octet_length(data)
    whole = F.greatest(F.lit(1), F.ceil(size / BLOCK)) * BLOCK
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), (whole - size).cast("int"))))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode_media(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Replace a binary payload column by a column of progressive JPEGs that hold it losslessly.

    Other columns pass through; a column ``media`` they had is replaced. A null
    payload gives null media; one that is empty or no multiple of 64 bytes is an
    error.
    """
    kept = [c for c in df.columns if c not in (payload, media)]
    df = df.select(*kept, payload)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if p is None else jpeg.encode(p) for p in batch[payload].to_pylist()]
            yield pa.RecordBatch.from_pydict({**{c: batch[c] for c in kept}, media: pa.array(made, pa.binary())})

    fields = _fields(df.select(*kept))
    return df.mapInArrow(write, f"{fields}{', ' if fields else ''}{media} binary")


def decode_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Add payload (the bytes stored by ``encode_media``; null for other pictures), width, height and tensor.

    A tensor is height x width x 3 bytes, RGB, row by row. Media that is null
    or no progressive JPEG gives nulls. Other columns pass through; columns of
    these four names are replaced.
    """
    added = ("payload", "width", "height", "tensor")
    df = df.drop(*added)
    names = df.columns

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 4
        try:
            picture = jpeg.decode(data)
            stored = bool(picture.comments) and picture.comments[0].startswith(b"payload ")
            return jpeg.payload(picture) if stored else None, picture.width, picture.height, jpeg.to_rgb(picture).tobytes()
        except ValueError:
            return (None,) * 4

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, begin, size = [], 0, 0
            for i, data in enumerate(batch[media].to_pylist()):
                found.append(one(data))
                size += len(found[-1][3] or b"")
                if size >= AT_ONCE or i + 1 == batch.num_rows:
                    columns = {n: batch[n].slice(begin, len(found)) for n in names}
                    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
                    columns |= {n: pa.array(v, k) for n, v, k in zip(added, zip(*found), kinds)}
                    yield pa.RecordBatch.from_pydict(columns)
                    found, begin, size = [], i + 1, 0

    return df.mapInArrow(read, f"{_fields(df)}, payload binary, width int, height int, tensor binary")


def digests(docs: DataFrame) -> DataFrame:
    """Every document's text stored as a picture, read back, and described.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (width x height: crc32 of the RGB tensor).
    Null texts count as empty; repeated rows are kept; an empty table gives none.
    """
    data = docs.select(
        F.col("doc_id"), F.octet_length(utf8()).cast("long").alias("n_bytes"), payload_of().alias("payload")
    )
    read = decode_media(encode_media(data))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%dx%d:%08x", "width", "height", F.crc32("tensor")).alias("feature"),
    )
