"""Token-id output in a bit-plane file format.

Layout of a chunk (all numbers little-endian):

    magic ``BPS1`` | u32 ids in the chunk | u32 ids in a block | u8 unit (1: bit
    planes, 8: byte planes) | u8 planes | u16 zero | u32 blocks
    index: for each block and plane a u32, the length of its compressed bytes
    the compressed planes, block after block

A block of ids is transposed: plane ``k`` holds bit (or byte) ``k`` of every id
in the block, and each plane is compressed with zstandard by itself.  Planes
above the highest set bit of a chunk are left out.

Documents are laid out in ascending id order.  A shard holds a range of ids; it
is a sequence of chunks, and a chunk holds whole documents, so that a lost task
is redone by itself and a reader needs one chunk at a time.  Shards are stored
as Parquet rows: a chunk's bytes beside its entry of the chunk index (shard,
position, first id offset in the shard, document ids and lengths).  Spark's
committer writes them, so the format works on any store that Spark reaches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, scratch, shuffle_partitions, text_of
from .vocab_encode import encoder_for

_HEAD = struct.Struct("<4sIIBBHI")
BLOCK_IDS = 16_384
CHUNK_IDS = 131_072

CHUNK_SCHEMA = "shard int, chunk int, shard_offset long, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def shuffle_planes(ids: np.ndarray, block_ids: int = BLOCK_IDS, unit: int = 1, level: int = 3) -> bytes:
    """The chunk's bytes for ``ids`` (unsigned 32-bit).  ``unit`` 1 makes bit
    planes, 8 byte planes.  No ids give a header alone."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    bits = int(ids.max()).bit_length() if len(ids) else 0
    planes = -(-bits // unit)
    squeeze = zstandard.ZstdCompressor(level=level).compress
    lengths, body = [], []
    blocks = -(-len(ids) // block_ids)
    for b in range(blocks):
        block = ids[b * block_ids : (b + 1) * block_ids]
        by_byte = np.ascontiguousarray(block.view(np.uint8).reshape(-1, 4).T)
        if unit == 8:
            rows = by_byte[:planes]
        else:
            rows = []
            for k in range(planes):
                rows.append(np.packbits((by_byte[k >> 3] >> (k & 7)) & 1))
        for row in rows:
            data = squeeze(row.tobytes())
            lengths.append(len(data))
            body.append(data)
    head = _HEAD.pack(b"BPS1", len(ids), block_ids, unit, planes, 0, blocks)
    return head + np.array(lengths, dtype="<u4").tobytes() + b"".join(body)


def unshuffle_planes(data: bytes) -> np.ndarray:
    """The ids of a chunk."""
    magic, n, block_ids, unit, planes, _, blocks = _HEAD.unpack_from(data)
    if magic != b"BPS1":
        raise ValueError("not a bit-plane chunk")
    lengths = np.frombuffer(data, "<u4", blocks * planes, _HEAD.size)
    at = _HEAD.size + 4 * blocks * planes
    expand = zstandard.ZstdDecompressor().decompress
    out = np.zeros(n, dtype="<u4")
    for b in range(blocks):
        size = min(block_ids, n - b * block_ids)
        by_byte = np.zeros((4, size), np.uint8)
        for k in range(planes):
            length = int(lengths[b * planes + k])
            row = np.frombuffer(expand(data[at : at + length]), np.uint8)
            at += length
            if unit == 8:
                by_byte[k] = row
            else:
                by_byte[k >> 3] |= np.unpackbits(row, count=size) << (k & 7)
        out[b * block_ids : b * block_ids + size] = np.ascontiguousarray(by_byte.T).view("<u4").ravel()
    return out


def together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches in a row as one of about ``size`` bytes, so that what they share is looked up once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(x.nbytes for x in held) + batch.nbytes > size:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _writer(path: str, end_id: int | None, block_ids: int, chunk_ids: int, unit: int):
    end = np.array([] if end_id is None else [end_id], dtype="<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, offset = encoder_for(path), 0, 0
        shard, doc_ids, lengths, parts, held = None, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, offset, doc_ids, lengths, parts, held
            payload = shuffle_planes(np.concatenate(parts), block_ids, unit)
            row = [[shard], [number], [offset], [held], [doc_ids], [lengths], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], ["shard", "chunk", "shard_offset", "n_ids", "doc_ids", "lengths", "payload"])
            number, offset, doc_ids, lengths, parts, held = number + 1, offset + held, [], [], [], 0
            return out

        for batch in together(batches, encoder.SLICE):
            ids, counts = encoder.encode(batch.column("text"))
            at = 0
            for name, doc, n in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), counts.tolist()):
                shard = name
                doc_ids.append(doc)
                lengths.append(n + len(end))
                parts += ids[at : at + n], end
                at += n
                held += lengths[-1]
                if held >= chunk_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    return write


def write_token_shards(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 2,
    block_ids: int = BLOCK_IDS,
    chunk_ids: int = CHUNK_IDS,
    unit: int = 1,
) -> None:
    """Encode ``docs`` and write them as shards in ascending id order to ``path``.

    Null texts are empty and get the end id alone.  Rows that repeat an id lie
    next to each other, in order of their texts; null ids come first.  An empty
    table gives no chunk.  Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    shards = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = shards.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    chunks = shards.mapInArrow(_writer(tokenizer, end_id, block_ids, chunk_ids, unit), CHUNK_SCHEMA)
    chunks.write.option("compression", "none").parquet(path)


def _reader(offsets: dict[int, int], with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unshuffle_planes(row["payload"])
                if len(ids) != row["n_ids"]:
                    raise ValueError(f"chunk {row['chunk']} of shard {row['shard']} is damaged")
                ends = np.cumsum(np.array(row["lengths"], dtype=np.int64))
                starts = ends - np.array(row["lengths"], dtype=np.int64)
                base = offsets[row["shard"]] + row["shard_offset"]
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(base + starts, pa.int64()),
                    "n_tokens": pa.array(row["lengths"], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return read


def read_token_shards(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens,
    ids_crc32`` and, if asked for, ``ids``.

    The driver gets one number per shard, the ids in it; their running sum
    turns offsets in a shard into offsets in the whole output."""
    arrow_batches(spark, 4)
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    totals = {r["shard"]: r["n"] for r in chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    offsets, at = {}, 0
    for shard in sorted(totals):
        offsets[shard], at = at, at + totals[shard]
    schema = DOC_SCHEMA + (", ids array<long>" if with_ids else "")
    return chunks.mapInArrow(_reader(offsets, with_ids), T._parse_datatype_string(schema))
