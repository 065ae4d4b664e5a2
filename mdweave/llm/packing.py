"""Best-fit packing of documents into sequences of a fixed length.

Bounded-space online best fit: pieces come in an order that does not depend on
their length, each goes to the open sequence with the least free space that
still holds it, and a sequence is opened if there is none.  A bitset has a bit
for each amount of free space for which a sequence is open, so the best one is
the lowest bit from the piece's length on.  Beyond ``open_sequences`` open ones
the fullest closes first.  The partitions pack on their own; a task holds its
open sequences only.

Defined results: null text is an empty document (its end id alone); null document
ids are packed like others; repeated rows are packed each; an empty table gives no
row.  A longer document is cut so that all its pieces but the first are full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import parts_of, texts_of
from .wordtokens import word_tokens


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids: the first
    has what is left over, the others are full."""
    first = (total - 1) % length + 1
    return [(0, first)] + [(s, length) for s in range(first, total, length)]


class BestFit:
    """Open sequences of one task."""

    def __init__(self, length: int, open_sequences: int, first_id: int):
        self.length, self.most, self.next = length, open_sequences, first_id
        self.free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits = self.open = 0

    def _take(self, space: int) -> int:
        sequence = self.free[space].pop()
        if not self.free[space]:
            self.bits ^= 1 << space
        self.open -= 1
        return sequence

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of the next piece."""
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            sequence = self._take(space)
        else:
            space, sequence = self.length, self.next
            self.next += 1
        if left := space - size:  # a full one is closed at once
            if not self.free[left]:
                self.bits |= 1 << left
            self.free[left].append(sequence)
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return sequence, self.length - space


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids`` of every document's pieces."""

    def run(batches):
        encoder = word_tokens(tokenizer)
        for batch in parts_of(batches):
            rows = []
            for i, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts_of(batch))):
                ids = np.append(ids, end_id).astype("<u4")
                for k, (start, size) in enumerate(cut(len(ids), length)):
                    part = ids[start:start + size]
                    rows.append((i, k, start, size, zlib.crc32(part), part))
            if rows:
                columns = list(zip(*rows))
                offsets = np.r_[0, np.cumsum(columns[3])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(columns[5]).view(np.int32)))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)] + [ids],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>")


def pack(parts: DataFrame, length: int = 2048, open_sequences: int = 512) -> DataFrame:
    """Add ``sequence_id, offset`` to rows with ``doc_id, piece, length`` (and any others).

    Rows are dealt by a hash of document, piece and place in the input, in its order, so that copies
    spread, rows repeated with one id too, and a repeated task packs alike; AQE joins small partitions, and the
    few sequences that each one leaves open are the only waste of the split."""
    schema = StructType(list(parts.schema.fields)).add("sequence_id", "long").add("offset", "long")

    def run(batches):
        bins = BestFit(length, open_sequences, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            if placed:
                sequence, offset = zip(*placed)
                columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "__order"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                                 names=schema.names)

    order = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id() % 4096)
    return (parts.withColumn("__order", order).repartition("__order")
            .sortWithinPartitions("__order").mapInArrow(run, schema))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, open_sequences: int = 512) -> DataFrame:
    """Where every piece of ``docs`` goes (without the ids)."""
    return pack(pieces(docs, tokenizer, length).drop("ids"), length, open_sequences)
