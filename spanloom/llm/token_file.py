"""Token ids in a binary format of bit planes.

A file set is a folder of Parquet part files, committed by Spark, whose rows
are chunks.  A chunk is one string of bytes and stands alone:

* 8 bytes magic, then as little-endian 64-bit integers: ids in the chunk,
  documents, ids per block, planes (4: byte planes; 32: bit planes), blocks;
* per document its id (64-bit) and its number of ids (64-bit);
* the chunk index: per block and plane the compressed length (64-bit);
* the planes, each compressed with zstandard.

A block of ids is transposed into planes: plane ``p`` holds byte (or bit) ``p``
of each id in turn.  Ids of small vocabularies leave whole planes zero, which
compress to a few bytes.  A chunk holds whole documents: it closes with the
first document that brings it to ``chunk_ids`` ids.

Documents are dealt to shards by ranges of id and sorted, so shard, chunk and
place follow ascending id.  Beside the bytes each row has its shard, its number
there, the ids before it in the shard and its counts: reading these columns
alone gives every chunk's global start.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir
from .tokens import encoder, together

MAGIC = b"IDPLANE1"
CHUNK_IDS = 1 << 18
BLOCK_IDS = 1 << 16
_HEAD = struct.Struct("<8s5q")
CHUNKS = "shard int, chunk long, shard_start long, n_ids long, n_docs long, data binary"


def encode_chunk(doc_ids: list[int | None], ids: list[bytes], block_ids: int = BLOCK_IDS, bits: bool = False) -> bytes:
    """One chunk from documents' ids, each a string of little-endian 32-bit integers.

    A null document id is stored as the least 64-bit integer.
    """
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    sizes, planes = [], []
    for at in range(0, len(flat), block_ids):
        block = flat[at : at + block_ids]
        by_byte = np.ascontiguousarray(block.view(np.uint8).reshape(-1, 4).T)
        if bits:
            by_bit = np.unpackbits(by_byte, axis=1, bitorder="little").reshape(4, -1)
            # Of byte p the bits of all ids in turn, then regrouped by bit.
            grouped = by_bit.reshape(4, len(block), 8).transpose(0, 2, 1).reshape(32, len(block))
            parts = [np.packbits(g, bitorder="little").tobytes() for g in grouped]
        else:
            parts = [p.tobytes() for p in by_byte]
        for p in map(pack, parts):
            sizes.append(len(p))
            planes.append(p)
    n_planes = 32 if bits else 4
    head = _HEAD.pack(MAGIC, len(flat), len(ids), block_ids, n_planes, len(sizes) // n_planes)
    docs = np.array(
        [[np.iinfo(np.int64).min if d is None else d, len(i) // 4] for d, i in zip(doc_ids, ids, strict=True)], dtype="<i8"
    )
    return b"".join([head, docs.tobytes(), np.array(sizes, dtype="<i8").tobytes(), *planes])


def decode_chunk(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, and all ids (``<u4``) of a chunk."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    magic, n, n_docs, block_ids, n_planes, n_blocks = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    at = _HEAD.size
    docs = np.frombuffer(data, dtype="<i8", count=2 * n_docs, offset=at).reshape(-1, 2)
    at += docs.nbytes
    sizes = np.frombuffer(data, dtype="<i8", count=n_blocks * n_planes, offset=at)
    at += sizes.nbytes
    out = np.empty(n, dtype="<u4")
    for b in range(n_blocks):
        length = min(block_ids, n - b * block_ids)
        parts = []
        for s in sizes[b * n_planes : (b + 1) * n_planes]:
            parts.append(np.frombuffer(unpack(data[at : at + int(s)]), dtype=np.uint8))
            at += int(s)
        if n_planes == 32:
            bit = np.stack([np.unpackbits(p, bitorder="little", count=length) for p in parts])
            by_byte = np.packbits(bit.reshape(4, 8, length).transpose(0, 2, 1), axis=2, bitorder="little")[:, :, 0]
        else:
            by_byte = np.stack(parts)
        out[b * block_ids : b * block_ids + length] = np.ascontiguousarray(by_byte.T).view("<u4")[:, 0]
    ids = [None if d == np.iinfo(np.int64).min else int(d) for d in docs[:, 0]]
    return ids, docs[:, 1], out


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    shards: int | None = None,
    chunk_ids: int = CHUNK_IDS,
    block_ids: int = BLOCK_IDS,
    bits: bool = False,
) -> None:
    """Encodes every whole text and writes the ids to the folder ``path``.

    ``tokenizer`` is a file of the tokenizers library, which each executor has
    under that name; no special tokens are added, but ``end_id``, if given, is
    appended to each document.  Null texts count as empty, null ids come first,
    documents of equal id stand side by side.  An empty table gives an empty
    file set.  A very long text is encoded whole; a task holds the ids of one chunk
    and of the documents that are encoded together (``tokens.TOGETHER``).  ``shards`` is the number of range partitions, by default that of
    Spark's shuffles.
    """
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[bytes] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal names, held, n, number, before
            data = encode_chunk(names, held, block_ids, bits)
            row = pa.record_batch(
                [pa.array([v], t) for v, t in ((shard, pa.int32()), (number, pa.int64()), (before, pa.int64()), (n, pa.int64()), (len(held), pa.int64()), (data, pa.binary()))],
                names=["shard", "chunk", "shard_start", "n_ids", "n_docs", "data"],
            )
            names, held, number, before, n = [], [], number + 1, before + n, 0
            return row

        enc = encoder(tokenizer)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in together(batch.column(1)):
                for d, b in zip(ids[part], enc.encode(batch.column(1)[part].to_pylist()), strict=True):
                    names.append(d)
                    held.append(b + end)
                    n += len(held[-1]) // 4
                    if n >= chunk_ids:
                        yield close()
        if held:
            yield close()

    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        narrow.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(chunks, CHUNKS)
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a file set: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids_crc32`` (unsigned, of its ids as little-endian 32-bit integers)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, counts, flat = decode_chunk(batch.column(2)[i].as_py())
                raw, ends = memoryview(flat.tobytes()), np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch(
                    [
                        pa.array([batch.column(0)[i].as_py()] * len(ids), pa.int32()),
                        pa.array(ids, pa.int64()),
                        pa.array(starts + batch.column(1)[i].as_py(), pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(CHUNKS).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row per shard, as many as the writer had partitions: a bounded table.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select(
        F.col("shard").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    rows = files.select("shard", "shard_start", "data").mapInArrow(
        documents, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return rows.join(F.broadcast(base), F.col("shard") == F.col("of")).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file(docs: DataFrame, tokenizer: str, end_id: int | None = None, path: str | None = None, **how) -> DataFrame:
    """``write_ids`` to ``path`` (by default a new folder among the shared ones), then ``read_ids``."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end_id, **how)
    return read_ids(spark, path)
