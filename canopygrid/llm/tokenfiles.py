"""Flat token files: unsigned ids end to end, 64-bit document offsets beside them, read memory-mapped.

A store is a folder of shards and a Parquet ``manifest``. A shard has three
files of plain little-endian numbers: ``.bin`` the ids, 16 bits each where the
vocabulary allows and else 32, ``.off`` the documents' starts and the end
(unsigned 64 bits), ``.ids`` the document ids (64 bits). The manifest has a row
per shard with its token and document bases, prefix sums over the shards in
ascending document order.

Files are named by attempt and enter the manifest only when their task has
ended well, so a repeated task leaves an unused file and nothing else.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.llm.tables import stored, utf8
from canopygrid.llm.tokens import encode_all, vocabulary_path
from canopygrid.session import shared_folder

MANIFEST = "shard int, path string, bits int, n_docs long, n_tokens long, doc_base long, token_base long"
NO_ID = np.iinfo(np.int64).min


def _open(uri: str):
    """File system and path of a URI; a bare path is local or mounted."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _map(uri: str, kind: str) -> np.ndarray:
    """The numbers of a file, mapped where the file system is mounted."""
    from pyarrow import fs

    system, path = _open(uri)
    size = system.get_file_info(path).size
    if not size:
        return np.empty(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), kind)


def _writer(folder: str, vocabulary: str, end_id: int, bits: int) -> Callable:
    kind = f"<u{bits // 8}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        name = uuid.uuid4().hex
        end = np.array([end_id], "<u4").tobytes()
        starts, ids, at, shard = [0], [], 0, None
        with system.open_output_stream(f"{root}/{name}.bin") as out:
            for batch in batches:
                if not batch.num_rows:
                    continue
                shard = batch["shard"][0].as_py()
                ids += [NO_ID if i is None else i for i in batch["doc_id"].to_pylist()]
                for packed in encode_all(batch["text"].to_pylist(), vocabulary):
                    numbers = np.frombuffer(packed + end, "<u4")
                    out.write(numbers.astype(kind).tobytes())
                    at += len(numbers)
                    starts.append(at)
        if shard is None:
            system.delete_file(f"{root}/{name}.bin")
            return
        for suffix, numbers in ((".off", np.array(starts, "<u8")), (".ids", np.array(ids, "<i8"))):
            with system.open_output_stream(f"{root}/{name}{suffix}") as out:
                out.write(numbers.tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "path": [f"{folder}/{name}"],
                "n_docs": pa.array([len(ids)], pa.int64()),
                "n_tokens": pa.array([at], pa.int64()),
            }
        )

    return write


def write_tokens(
    docs: DataFrame,
    folder: str | None = None,
    vocabulary: str | None = None,
    end_id: int = 2,
    bits: int = 16,
) -> str:
    """Write every document's ids, ``end_id`` after each, in ascending doc_id order; returns the folder.

    ``docs`` needs doc_id and text; other columns are not looked at. A null
    text is empty, a null doc_id comes first, rows of one doc_id follow each
    other by text, all repeated rows are kept. No document makes a store
    without shards. A shard's memory is one batch of documents and 16 bytes a
    document, however long the shard is.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    in_order = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("shard", F.spark_partition_id())
    )
    write = _writer(folder, vocabulary or vocabulary_path(), end_id, bits)
    shards = stored(in_order.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "token-shards")
    rows, doc_base, token_base = [], 0, 0
    for r in sorted(shards.collect(), key=lambda r: r.shard):  # a row per task
        rows.append((r.shard, r.path, bits, r.n_docs, r.n_tokens, doc_base, token_base))
        doc_base, token_base = doc_base + r.n_docs, token_base + r.n_tokens
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            ids = _map(f"{shard['path']}.ids", "<i8")
            starts = _map(f"{shard['path']}.off", "<u8").astype(np.int64)
            tokens = _map(f"{shard['path']}.bin", f"<u{shard['bits'] // 8}")
            for a in range(0, len(ids), 4096):
                b = min(a + 4096, len(ids))
                crc = [zlib.crc32(tokens[starts[i] : starts[i + 1]].astype("<u4")) for i in range(a, b)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(ids[a:b], mask=ids[a:b] == NO_ID),
                        "start": pa.array(starts[a:b] + shard["token_base"]),
                        "n_tokens": pa.array(np.diff(starts[a : b + 1])),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a store: its place among all ids, its length and a checksum of its ids as 32-bit numbers."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    shards = max(1, manifest.count())
    return manifest.repartition(shards).mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
