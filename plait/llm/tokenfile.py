"""Token-ID files: range-coded blocks with a document directory, written in ascending doc_id order and read back.

A shard is one range of doc_ids; its file is the sequence of its blocks, kept as rows (shard, block, n_ids, payload) of
a Parquet table, so that Spark's writers commit them on any store and a lost executor's shard is made anew. A payload
holds whole documents: the coded ids, then the directory (doc_id, whether it is null, and number of ids of each document)
and its checksum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.llm import common, rangecoder, tokens

BLOCK = 1 << 22  # a block is closed after the batch of documents with which it has so many ids
_HEAD = struct.Struct("<II")  # documents, bytes of the coded ids


def pack_block(docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A block of documents with their numbers of ids, and all ids one after another."""
    coded = rangecoder.encode(ids)
    null = np.array([d is None for d in docs], bool)
    directory = np.array([d or 0 for d in docs], "<i8").tobytes() + lengths.astype("<u4").tobytes() + np.packbits(null).tobytes()
    return _HEAD.pack(len(docs), len(coded)) + coded + directory + struct.pack("<I", zlib.crc32(directory))


def unpack_block(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, and all ids; raises ValueError on damage."""
    n, size = _HEAD.unpack_from(data)
    ids = rangecoder.decode(data[_HEAD.size : _HEAD.size + size])
    directory = data[_HEAD.size + size : -4]
    if zlib.crc32(directory) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise ValueError("damaged directory")
    null = np.unpackbits(np.frombuffer(directory, np.uint8, -1, 12 * n), count=n).astype(bool)
    return pa.array(np.frombuffer(directory, "<i8", n), pa.int64(), mask=null), np.frombuffer(directory, "<u4", n, 8 * n).astype(np.int64), ids


def write(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """The block table (shard, block, n_ids, payload) of docs(doc_id, text, ...), already written."""
    spark = docs.sparkSession
    common.arrow_batches(spark)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, block = tokens.encoder(tokenizer, keeps_blanks=True), TaskContext.get().partitionId(), 0
        held: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            payload = pack_block(held, np.concatenate(lengths), np.concatenate(ids))
            row = [pa.array([x], k) for x, k in ((shard, pa.int32()), (block, pa.int32()), (sum(map(len, ids)), pa.int64()), (payload, pa.binary()))]
            for x in (held, lengths, ids):
                x.clear()
            return pa.RecordBatch.from_arrays(row, ["shard", "block", "n_ids", "payload"])

        size = 0
        for batch in batches:
            some, n = encoder.arrow(batch.column(1))
            held += batch.column(0).to_pylist()
            ended, ends = np.full(len(some) + len(n), end_id, np.uint32), np.cumsum(n)
            for i, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist())):
                ended[a + i : b + i] = some[a:b]
            ids.append(ended)
            lengths.append(n + 1)
            size += len(ids[-1])
            if size >= BLOCK:
                yield close()
                block, size = block + 1, 0
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(common.spread(spark), *order).sortWithinPartitions(*order)
    return common.written(rows.mapInArrow(code, "shard int, block int, n_ids long, payload binary"), "token-blocks", "uncompressed")


def read(blocks: DataFrame) -> DataFrame:
    """shard, block, doc_id, at (ids before it in its block), n_tokens, ids_crc32 of every document in a block table."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                docs, n, ids = unpack_block(data)
                raw, at = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(n) - n
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist())]
                columns = [pa.array([shard] * len(docs), pa.int32()), pa.array([block] * len(docs), pa.int32()), docs, pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    return blocks.select("shard", "block", "payload").mapInArrow(one, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of docs(doc_id, text, ...), from the files written and read back.

    Null texts count as empty and hold end_id alone. Null doc_ids come first; rows with equal doc_id stand in the order of
    a hash of their texts, equal rows side by side. A text longer than a block makes a longer block. A vocabulary must have
    ids below 65536, else the coder raises ValueError. Other columns are
    ignored. An empty table gives no rows.
    """
    blocks = write(docs, tokenizer, end_id)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    own = Window.partitionBy("shard").orderBy("block")
    starts = blocks.select("shard", "block", (F.sum("n_ids").over(own) - F.col("n_ids")).alias("inside")).join(shards, "shard")
    starts = common.written(starts.select("shard", "block", (F.col("before") + F.col("inside")).alias("first")), "token-starts")
    rows = common.small_join(read(blocks), starts, ["shard", "block"], F.xxhash64("doc_id"))
    return rows.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
