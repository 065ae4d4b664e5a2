"""Byte-level BPE encoding and decoding with a global distinct-word shuffle.

The texts are exploded to pre-tokens with positions, blocks of texts at a time: a block
keeps the positions as numbers of its distinct words.  The distinct words of all blocks
are shuffled by word, each is encoded once, and its ids are joined back to the
blocks, where the texts are reassembled by position.  Words and positions move
as packed column parts, not as a row per pre-token: the whole takes about as much
room as the compressed table.  The positions are written once, bucketed by block, so
that the join back shuffles words only.

Decoding joins ids with the table of token bytes.  The vocabulary bounds that table (50,256
rows), so it is broadcast; an id outside of it is an error.

Defined results: null text is empty (no ids, no bytes); null and repeated document ids
are encoded as they come; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_table
from .common import parts_of, shared_folder, shuffle_partitions, slices, texts_of, worker_cache
from .pretokens import split_spaced
from .wordtokens import Numbered, gather

BLOCK_CHARS = 12_000_000
GROUP_CHARS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed byte by byte of their size."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(numbers) else b""


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def exploded(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of texts as two kinds of rows.

    ``doc_ids, counts, positions, n``: documents of a block, how many pre-tokens
    each has, and the numbers of these.  ``bucket, ranks, words, n``: the distinct
    words of a block that belong to one bucket, and their numbers (the most frequent
    word has number 0, so positions pack well)."""

    def pack_block(block: int, numbers: Numbered, groups: list):
        counts = np.bincount(np.concatenate([g[2] for g in groups]), minlength=len(numbers))
        by_rank = np.argsort(-counts, kind="stable")
        rank = np.empty(len(by_rank), np.int64)
        rank[by_rank] = np.arange(len(by_rank))
        for ids, sizes, positions in groups:
            yield {"block": block, "doc_ids": ids, "counts": sizes.tolist(), "numbers": pack_numbers(rank[positions]),
                   "n": len(positions), "bucket": None, "sizes": None, "words": None, "word_bytes": None}
        words = [w.encode() for w in numbers]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))[by_rank]
        order = np.argsort(bucket, kind="stable")  # by rank within a bucket
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in range(buckets):
            ranks = order[cuts[k]:cuts[k + 1]]
            if len(ranks):
                own = [words[i] for i in by_rank[ranks].tolist()]
                joined = b"".join(own)
                yield {"block": block, "doc_ids": None, "counts": None, "numbers": pack_numbers(np.diff(ranks, prepend=0)),
                       "n": len(own), "bucket": k, "sizes": pack_numbers(np.fromiter(map(len, own), np.int64, len(own))),
                       "words": pa.compress(joined, "zstd", asbytes=True), "word_bytes": len(joined)}

    schema = ("block long, doc_ids array<long>, counts array<int>, numbers binary, n int, bucket int, sizes binary, "
              "words binary, word_bytes int")
    kinds = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
                       ("numbers", pa.binary()), ("n", pa.int32()), ("bucket", pa.int32()), ("sizes", pa.binary()),
                       ("words", pa.binary()), ("word_bytes", pa.int32())])

    def run(batches):
        block, numbers, groups, chars = TaskContext.get().partitionId() << 32, Numbered(), [], 0
        for batch in parts_of(batches):
            ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            for a, b in slices(texts, GROUP_CHARS):
                words, sizes = split_spaced(texts[a:b])
                groups.append((ids[a:b], sizes, np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))))
                chars += sum(map(len, texts[a:b]))
                if chars >= BLOCK_CHARS:
                    for row in pack_block(block, numbers, groups):
                        yield pa.RecordBatch.from_pylist([row], kinds)
                    block, numbers, groups, chars = block + 1, Numbered(), [], 0
        if groups:
            for row in pack_block(block, numbers, groups):
                yield pa.RecordBatch.from_pylist([row], kinds)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) of every text, as tiktoken's ``encode_ordinary`` gives them."""
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # an external table, because only tables keep their buckets: the join back then leaves it in place
    name = scratch_table(spark)
    (exploded(rows, buckets).write.format("parquet").option("path", shared_folder(spark, "pretokens"))
     .bucketBy(buckets, "block").saveAsTable(name))
    blocks = spark.table(name)

    def encode_words(batches):
        import tiktoken
        cache = worker_cache()
        if ("tiktoken", ranks_path) not in cache:
            cache["tiktoken", ranks_path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path),
                                                              special_tokens={})
        once, known = cache["tiktoken", ranks_path].encode_ordinary, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ends = np.cumsum(unpack_numbers(row["sizes"], row["n"])).tolist()
                data, ids, begin = pa.decompress(row["words"], row["word_bytes"], "zstd", asbytes=True), [], 0
                for end in ends:
                    word, begin = data[begin:end], end
                    if (found := known.get(word)) is None:
                        found = known[word] = once(word.decode())
                    ids.append(found)
                flat = np.fromiter((i for f in ids for i in f), np.int64)
                out.append({"block": row["block"], "ranks": row["numbers"], "n": row["n"], "m": len(flat),
                            "sizes": pack_numbers(np.fromiter(map(len, ids), np.int64, len(ids))), "ids": pack_numbers(flat)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("block", pa.int64()), ("ranks", pa.binary()), ("n", pa.int32()), ("m", pa.int32()), ("sizes", pa.binary()),
                ("ids", pa.binary())]))

    words = blocks.where("bucket is not null").select("block", "bucket", "numbers", "n", "sizes", "words", "word_bytes")
    encoded = words.repartition(buckets, "bucket").mapInArrow(
        encode_words, "block long, ranks binary, n int, m int, sizes binary, ids binary")

    def reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
        words = words.to_pylist()
        ranks = [np.cumsum(unpack_numbers(r["ranks"], r["n"])) for r in words]
        sizes = [unpack_numbers(r["sizes"], r["n"]) for r in words]
        flat = np.concatenate([unpack_numbers(r["ids"], r["m"]) for r in words] or [np.zeros(0, np.int64)]).astype(np.int32)
        total = sum(map(len, ranks))
        size, first = np.zeros(total, np.int64), np.zeros(total, np.int64)
        at = 0
        for r, s in zip(ranks, sizes):
            size[r] = s
            first[r] = at + np.cumsum(s) - s
            at += int(s.sum())
        tables = []
        for row in texts.to_pylist():
            positions = unpack_numbers(row["numbers"], row["n"])
            ids = gather(flat, first[positions], size[positions])
            ends = np.r_[0, np.cumsum(size[positions])][np.cumsum(row["counts"])]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids))
            tables.append(pa.table([pa.array(row["doc_ids"], pa.int64()), lists], names=["doc_id", "ids"]))
        return pa.concat_tables(tables)

    texts = blocks.where("bucket is null").select("block", "doc_ids", "counts", "numbers", "n")
    return texts.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(reassemble, "doc_id long, ids array<int>")


class TokenBytes:
    """The table of token bytes as one array, so that ids join it by place."""

    def __init__(self, ranks: dict[bytes, int]):
        table: list = [None] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        self.table = pa.array(table, pa.binary())

    def decode(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The bytes of every list of ids."""
        offsets = ids.offsets.to_numpy()
        flat = ids.values.slice(offsets[0], offsets[-1] - offsets[0])
        tokens = self.table.take(flat)
        if tokens.null_count:
            raise ValueError("an id has no token")
        ends = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1)[offsets - offsets[0]]
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), tokens.buffers()[2]])


def token_bytes(path: str) -> TokenBytes:
    cache = worker_cache()
    if ("token_bytes", path) not in cache:
        cache["token_bytes", path] = TokenBytes(read_ranks(path))
    return cache["token_bytes", path]


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, bytes`` of rows ``doc_id, ids``."""

    def run(batches):
        for part in parts_of(batches, 256):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), token_bytes(ranks_path).decode(part.column("ids"))],
                                             ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded again."""
    encoded = encode(docs, ranks_path, pattern)

    def run(batches):
        table = token_bytes(ranks_path)
        for part in parts_of(batches, 256):
            ids = part.column("ids")
            own = [x.values.to_numpy(zero_copy_only=False).astype("<u4") for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in own], pa.int64()),
                 pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in own]),
                 pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in table.decode(ids)])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
