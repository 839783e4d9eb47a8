"""Best-fit packing of token ids into sequences of fixed length, in bounded space.

Each document's ids are counted and, where longer than a sequence, cut into
pieces.  A packer takes pieces one after another and puts each into the open
sequence whose free space is the least that suffices.  Open sequences are kept
by free space; a bitset has a bit for each free space that occurs, so the best
fit is the lowest set bit from the piece's length on.  At most ``open_bins``
sequences are open; beyond that the fullest one closes.

Only lengths are packed: the pieces (a few numbers each) are dealt by a hash to
packers of about ``pieces_per_packer``, each of which leaves at most
``open_bins`` sequences part-filled, so the loss is small at any size.  Within
a packer pieces come in the order of a hash, which makes a task that runs again
repeat its result, and suits bounded space better than an order by length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder, together

SEQUENCE = 2048
OPEN_BINS = 4096
PIECES_PER_PACKER = 200_000


class Packer:
    """Online best fit with a bounded number of open bins; bins are numbered from 0."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free_set = 0
        self.n_open = self.n_bins = 0

    def add(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece of ``1..capacity`` ids."""
        fits = self.free_set >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.n_bins
            self.n_bins += 1
        if left := free - length:
            if self.n_open == self.open_bins:
                self._take((self.free_set & -self.free_set).bit_length() - 1)
            self.by_free[left].append(bin_)
            self.free_set |= 1 << left
            self.n_open += 1
        return bin_, self.capacity - free

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.free_set &= ~(1 << free)
        self.n_open -= 1
        return bin_


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = SEQUENCE, text: str = "text", doc_id: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every whole text, with ``ids`` if asked for.

    A document's ids are those of its text, null counting as empty, and then
    ``end_id``; only documents of more than ``capacity`` ids are cut.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for near in together(batch.column(1)):
                part = batch.slice(near.start, near.stop - near.start)
                rows = []
                for d, b in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    b += end
                    for k, a in enumerate(range(0, len(b), step)):
                        ids = b[a : a + step]
                        rows.append((d, k, a // 4, len(ids) // 4, zlib.crc32(ids), ids))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in cols[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        pieces, schema
    )


def pack(
    pieces: DataFrame, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS, pieces_per_packer: int = PIECES_PER_PACKER
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` must be stored, as it is read twice.

    Every sequence holds at most ``capacity`` ids, without a gap from offset 0.
    Lengths must be from 1 to ``capacity``.
    """
    schema = pieces.schema
    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema) + "sequence_id long, offset long"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, base = Packer(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.add(n) for n in batch.column("length").to_pylist()]
            bins = pa.array([base + b for b, _ in placed], pa.int64())
            offsets = pa.array([o for _, o in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, bins, offsets], names=[*batch.schema.names, "sequence_id", "offset"])

    packers = max(1, round(pieces.count() / pieces_per_packer))
    deal = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    return (
        pieces.repartition(packers, F.xxhash64(deal, F.lit(1)))
        .sortWithinPartitions(deal, "doc_id", "piece", "length")
        .mapInArrow(packed, out)
    )


def best_fit(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS,
    text: str = "text", doc_id: str = "doc_id", with_ids: bool = False,
) -> DataFrame:
    """Every piece of every text with its place: see ``token_pieces`` and ``pack``.

    Null and empty texts are documents of the end id alone.  Repeated rows and
    equal or null ids are documents of their own.  An empty table gives no
    pieces.  Other columns of ``docs`` are not used.
    """
    return pack(written(token_pieces(docs, tokenizer, end_id, capacity, text, doc_id, with_ids), "pieces"), capacity, open_bins)
