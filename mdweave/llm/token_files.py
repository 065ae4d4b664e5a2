"""Token files: a concatenated id array with Elias-Fano document boundaries.

A data set is a folder of shards; shard k holds the documents of the k-th range
of ascending ids.  ``part-K.ids`` is the bare array of all its ids, little-endian,
2 bytes each if the vocabulary allows, else 4.  ``part-K.idx`` has a header, the
document ids, and the ends of the documents in the array in Elias-Fano form: the
low bits of each end side by side, the high bits in unary as a bit vector, and
the place of every 256th one in it.  ``BoundaryIndex.offset`` finds a boundary
through these places (select), without a table of 64-bit offsets.

Defined results: null text is an empty document (only the end id); null document
ids come first, in order of text; an empty table gives no shard and no row;
repeated ids are separate documents; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_filesystem, parts_of, shared_folder, shuffle_partitions, stage, texts_of, write_file
from .wordtokens import word_tokens

MAGIC = b"MDWTOK1\n"
# magic, id bytes, low bits, documents, ids, select step, places, low bytes, high bytes
HEADER = "<8sIIQQIIQQ"
STEP = 256
READ_IDS = 1 << 20


def elias_fano(ends: np.ndarray, total: int) -> tuple[int, bytes, bytes, bytes]:
    """(low bits, low part, high part, select places) of an ascending sequence of numbers up to ``total``."""
    n = len(ends)
    low_bits = max(0, int(max(1, total) // max(1, n)).bit_length() - 1)
    ends = ends.astype(np.uint64)
    low = (ends[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
    places = (ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    return (low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(), places[::STEP].astype("<u4").tobytes())


class BoundaryIndex:
    """Reader of an index file."""

    def __init__(self, data: bytes):
        (magic, self.id_bytes, self.low_bits, self.documents, self.ids, self.step, places, low,
         high) = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a token index")
        at = struct.calcsize(HEADER)

        def take(size: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, np.uint8, size, at)
            at += size
            return part

        self.valid = take((self.documents + 7) // 8)
        self.doc_ids = take(8 * self.documents).view("<i8")
        self.low, self.high, self.places = take(low), take(high), take(4 * places).view("<u4")

    def offset(self, i: int) -> int:
        """Number of ids in the documents before document ``i``."""
        if i == 0:
            return 0
        i -= 1
        place = int(self.places[i // self.step])
        left, byte = i % self.step, place >> 3
        bits = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        value = byte * 8 + (bits & -bits).bit_length() - 1 - i
        first, low = i * self.low_bits, 0
        for k in range(self.low_bits):
            low |= (int(self.low[(first + k) >> 3]) >> ((first + k) & 7) & 1) << k
        return value << self.low_bits | low

    def offsets(self, first: int, last: int) -> np.ndarray:
        """``offset(first) .. offset(last)``, both included."""
        if last - first < 8:
            return np.array([self.offset(i) for i in range(first, last + 1)], np.int64)
        lo = max(first, 1) - 1  # the ends wanted are lo .. last - 1
        begin = int(self.places[lo // self.step])
        stop = (last - 1) // self.step + 1
        stop = int(self.places[stop]) if stop < len(self.places) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin >> 3:(stop + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits) + (begin >> 3 << 3)
        ones = ones[np.searchsorted(ones, begin):][lo % self.step:][:last - lo]
        value = (ones - np.arange(lo, last)) << self.low_bits
        if self.low_bits:
            a, b = lo * self.low_bits, last * self.low_bits
            low = np.unpackbits(self.low[a >> 3:(b + 7) >> 3], bitorder="little")[a & 7:][:b - a]
            value = value + (low.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return value if first else np.r_[0, value]

    def ids_of(self, first: int, last: int) -> list:
        ok = np.unpackbits(self.valid, bitorder="little")[first:last]
        return [int(d) if v else None for d, v in zip(self.doc_ids[first:last], ok)]


def index_bytes(doc_ids: list, ends: np.ndarray, id_bytes: int) -> bytes:
    """The index file of a shard."""
    total = int(ends[-1]) if len(ends) else 0
    low_bits, low, high, places = elias_fano(ends, total)
    valid = np.packbits(np.array([d is not None for d in doc_ids], bool), bitorder="little").tobytes()
    ids = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    head = struct.pack(HEADER, MAGIC, id_bytes, low_bits, len(doc_ids), total, STEP, len(places) // 4, len(low), len(high))
    return head + valid + ids + low + high + places


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize ``docs`` and write them to ``folder`` in ascending id order.

    The texts are range-partitioned and sorted by id; each partition streams its
    ids to one shard, so only the boundaries of a shard stay in memory.  Returns
    ``shard, path, documents, ids, first`` (ids in the shards before), one row
    per shard.
    """

    def write(batches):
        from tokenizers import Tokenizer
        encoder = word_tokens(tokenizer)
        wide = Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        kind = np.dtype("<u4" if wide else "<u2")
        shard = TaskContext.get().partitionId()
        path, ids, ends = f"{folder}/part-{shard:06d}", [], []

        def parts():
            total = 0
            for batch in parts_of(batches):
                for i, tokens in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts_of(batch))):
                    total += len(tokens) + 1
                    ids.append(i)
                    ends.append(total)
                    yield np.append(tokens, end_id).astype(kind).tobytes()

        stream = parts()
        if (head := next(stream, None)) is not None:
            def rest():
                yield head
                yield from stream
            write_file(f"{path}.ids", rest())
            write_file(f"{path}.idx", [index_bytes(ids, np.array(ends), kind.itemsize)])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path],
                                              "documents": [len(ids)], "ids": [ends[-1]]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shards = stage(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
                   .mapInArrow(write, "shard int, path string, documents long, ids long"))
    # one row per shard, so the running total is a small job
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


RANGES = 64


def read_token_files(shards: DataFrame, documents_per_task: int = 4096) -> DataFrame:
    """Documents of the files: ``doc_id, start`` (ids before it in the data set),
    ``ids`` (array).  Every task reads some ranges of documents through the index, which it
    reads once for ``RANGES`` of them."""
    last = F.greatest(F.floor((F.col("documents") - 1) / documents_per_task), F.lit(0)).cast("long")
    ranges = shards.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), last))) \
        .repartition(shuffle_partitions(shards.sparkSession), "path", F.expr(f"range div {RANGES}")).sortWithinPartitions("path", "range")

    def read(batches):
        opened, index = None, None
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, path = open_filesystem(row["path"])
                if path != opened:
                    opened, index = path, BoundaryIndex(filesystem.open_input_file(f"{path}.idx").read())
                begin = row["range"] * documents_per_task
                end = min(begin + documents_per_task, index.documents)
                at = index.offsets(begin, end)
                kind = np.dtype(f"<u{index.id_bytes}")
                with filesystem.open_input_file(f"{path}.ids") as f:
                    a = 0
                    while a < end - begin:  # at most READ_IDS ids at once, or one document
                        b = max(a + 1, int(np.searchsorted(at, at[a] + READ_IDS, "right")) - 1)
                        f.seek(int(at[a]) * kind.itemsize)
                        ids = np.frombuffer(f.read(int(at[b] - at[a]) * kind.itemsize), kind).astype(np.int32)
                        offsets = pa.array((at[a:b + 1] - at[a]).astype(np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(index.ids_of(begin + a, begin + b), pa.int64()),
                             pa.array(at[a:b] + row["first"], pa.int64()),
                             pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "start", "ids"])
                        a = b

    return ranges.mapInArrow(read, "doc_id long, start long, ids array<int>")


def with_digest(documents: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of documents read back."""

    def digest(batches):
        for batch in batches:
            crc = [zlib.crc32(np.asarray(ids.values, "<u4")) for ids in batch.column("ids")]
            n = pa.array([len(ids) for ids in batch.column("ids")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), n,
                                              pa.array(crc, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files to the shared folder and return what reading them back gives."""
    folder = shared_folder(docs.sparkSession, "token-files")
    return with_digest(read_token_files(write_token_files(docs, folder, tokenizer, end_id)))
