"""Token ids of a corpus in Parquet list columns that can be read selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelframe.llm._text import slices
from voxelframe.llm._tokens import encoder

#: Bytes of text encoded at a time.
CHUNK = 512 << 10


def _ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text's ids, and where each text's ids begin."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    ends = np.cumsum(counts + 1)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = ids
    return out, np.concatenate([[0], ends])


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches with a column `text`, the ids of their rows one after the other, and where each row's begin."""
    own = encoder(tokenizer)
    for batch, texts in slices(batches, "text", CHUNK):
        yield batch, *_ended(*own.encode(texts), end_id)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, encoding: str = "dictionary", row_group_bytes: int = 8 << 20, page_bytes: int = 64 << 10) -> None:
    """Write (doc_id, n_tokens, ids) in ascending doc_id order over the files in `folder`.

    docs: doc_id and text; other columns are left out. A null text is empty and gets only end_id. Rows with a null
    doc_id come first; rows with one doc_id follow each other in the order of their texts. The rows are dealt by
    ranges of (doc_id, hash of text) and sorted, so file numbers follow the ids. encoding: `dictionary`, or `delta`
    for delta-packed integers. Page indexes are always written, so a reader can take n_tokens or a few rows' ids
    without the rest.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding: {encoding}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, begin in encoded(batches, tokenizer, end_id):
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(begin), pa.int64()), lists], ["doc_id", "n_tokens", "ids"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    options = {"compression": "zstd", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.enable.dictionary": str(encoding == "dictionary").lower()}
    if encoding == "delta":
        options["parquet.writer.version"] = "v2"
    ordered.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>").write.options(**options).parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n_tokens, ids, file_no, row_no) in no order; file_no and row_no give the written order."""
    files = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(folder)
    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    return files.select("doc_id", "n_tokens", "ids", number.alias("file_no"), F.col("_metadata.row_index").alias("row_no"))


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file_no, row_no) of each row in the files, counted from the ids themselves.

    start: how many ids stand before the row's in all files. Sums are taken for each file first, so the only window
    without a key has one row for each file.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), batch.column("file_no"), batch.column("row_no")], ["doc_id", "n_tokens", "ids_crc32", "file_no", "row_no"])

    files = read_token_files(spark, folder)
    sizes = files.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    rows = files.select("doc_id", "ids", "file_no", "row_no").mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, file_no long, row_no long")
    inside = Window.partitionBy("file_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(starts, "file_no").select("doc_id", (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "file_no", "row_no")
