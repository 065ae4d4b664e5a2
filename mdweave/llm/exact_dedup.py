"""Exact dedup with a two-pass Bloom filter.

The first pass counts the text hashes of all rows in a Bloom filter with counters
that stop at two (two bit maps: seen, seen again).  Each task fills its own bit
maps, and their segments are merged by segment.  In the second pass, a row whose
bits have all been seen again is possibly repeated: only such rows shuffle to be
grouped exactly, the rest pass straight through.  A filter has 16 bits a row and at
most ``most_bits`` (8 MB), which bounds what is broadcast and what a task fills.  More rows than
that suits are cut into ranges of their hashes, each with a filter of its own: the keys are written by
range, and the ranges take their turns, so that as many rows pass straight through at any size.

Defined results: null text is empty; a null ``doc_id`` stays only if no other row of
its group is as long; of rows repeated with the same id, one stays; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, shared_folder, stage

# fixed value: the characters of [\x20\x09-\x0D]
DELETED = b"\x20\x09\x0a\x0b\x0c\x0d"
SEGMENT_BITS = 1 << 18


def text_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int = 1) -> DataFrame:
    """``doc_id, n_code_points, row_key`` (a hash of the text that tells rows of one id
    apart), ``sha`` (of the text without white space) of every row, and the ``range`` of
    the hash among ``ranges`` (a power of two)."""

    def run(batches):
        for batch in batches:
            sha = [hashlib.sha256(t.as_buffer().to_pybytes().translate(None, DELETED) if t.is_valid else b"").digest()
                   for t in batch.column("text")]
            # the first bits of the hash; the filters use the last ones of its words
            part = [int.from_bytes(h[4:8], "little") * ranges >> 32 for h in sha]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("row_key"),
                                              pa.array(sha, pa.binary()), pa.array(part, pa.int32())], KEYS)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n"),
                       F.xxhash64(text).alias("row_key"))
    return rows.mapInArrow(run, KEYS_SQL)


KEYS = ["doc_id", "n_code_points", "row_key", "sha", "range"]
KEYS_SQL = "doc_id long, n_code_points long, row_key long, sha binary, range int"


def filter_bits(rows: int, most_bits: int) -> tuple[int, int]:
    """(bits of a filter, ranges) for 16 bits a row in all."""
    bits = max(SEGMENT_BITS, 1 << (16 * max(rows, 1) - 1).bit_length())
    return min(most_bits, bits), max(1, bits // most_bits)


def probes(column, bits: int) -> np.ndarray:
    """The four bit numbers of every hash of an Arrow column of sha256 values."""
    words = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)
    return (words & np.uint64(bits - 1)).astype(np.int64)


def repeated_bits(keys: DataFrame, bits: int) -> bytes:
    """Pass one: the bit map of what at least two rows have set."""
    segments = bits // SEGMENT_BITS
    size = SEGMENT_BITS // 8

    def fill(batches):
        seen, again = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            at, n = np.unique(probes(batch.column("sha"), bits), return_counts=True)
            again[at[(n > 1) | seen[at]]] = True
            seen[at] = True
        for k in range(segments):
            part = slice(k * SEGMENT_BITS, (k + 1) * SEGMENT_BITS)
            if seen[part].any():
                maps = [pa.compress(np.packbits(x[part]).tobytes(), "zstd", asbytes=True) for x in (seen, again)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32())] + [pa.array([m], pa.binary()) for m in maps],
                                                 ["segment", "seen", "again"])

    def merge(batches):
        maps: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                seen, again = (np.frombuffer(pa.decompress(row[c], size, "zstd", asbytes=True), np.uint8)
                               for c in ("seen", "again"))
                if row["segment"] in maps:
                    s, a = maps[row["segment"]]
                    maps[row["segment"]] = (s | seen, a | again | (s & seen))
                else:
                    maps[row["segment"]] = (seen, again)
        for k, (_, again) in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([again.tobytes()], pa.binary())],
                                             ["segment", "again"])

    merged = (keys.select("sha").mapInArrow(fill, "segment int, seen binary, again binary")
              .repartition("segment").mapInArrow(merge, "segment int, again binary"))
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # bits / 8 bytes in all, however many rows
        out[row.segment * size:(row.segment + 1) * size] = np.frombuffer(row.again, np.uint8)
    return out.tobytes()


def keys_by_range(docs: DataFrame, doc_id: str, text: str, ranges: int) -> list[DataFrame]:
    """The written keys, range by range; a job of one range reads no other."""
    keys = text_keys(docs, doc_id, text, ranges)
    if ranges == 1:
        return [stage(keys)]
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "keys")
    keys.repartition("range", F.col("row_key") % 16).write.partitionBy("range").parquet(folder)
    every = spark.read.schema(KEYS_SQL).parquet(folder)
    return [every.where(F.col("range") == k) for k in range(ranges)]


def flagged_rows(keys: DataFrame, bits: int) -> DataFrame:
    """Pass two of a range: ``keys`` with ``maybe``, whether a row is possibly repeated."""
    bitmap = keys.sparkSession.sparkContext.broadcast(repeated_bits(keys, bits))

    def flag(batches):
        table = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            at = probes(batch.column("sha"), bits)
            maybe = ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield batch.append_column("maybe", pa.array(maybe))

    return keys.select(*KEYS).mapInArrow(flag, KEYS_SQL + ", maybe boolean")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     most_bits: int = 1 << 26) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256,
    row_key`` (longest original, then smallest id of equal texts stays)."""
    bits, ranges = filter_bits(docs.count(), most_bits)
    parts = keys_by_range(docs, doc_id, text, ranges)
    # a range is done before the next one's filter is made
    flagged = flagged_rows(parts[0], bits) if ranges == 1 else reduce(
        lambda a, b: a.unionByName(b), [stage(flagged_rows(keys, bits)) for keys in parts])
    single = flagged.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha", "row_key")
    # repeated rows count first, so that no task holds a group
    rows = stage(flagged.where("maybe").groupBy("sha", "doc_id", "n_code_points", "row_key")
                 .agg(F.count("*").alias("copies")))
    groups = stage(rows.groupBy("sha").agg(
        F.sum("copies").alias("group_size"),
        F.max(F.struct("n_code_points", F.bitwise_not("doc_id").alias("not_id"), "row_key")).alias("best")))
    stays = ((F.col("n_code_points") == F.col("best.n_code_points")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
             & (F.col("row_key") == F.col("best.row_key")))
    multiple = (join_groups(rows, groups, "sha").withColumn("keep_id", F.bitwise_not("best.not_id"))
                .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
                .select("doc_id", "keep_id", "group_size", (stays & (F.col("copy") == 1)).alias("kept"), "sha", "row_key"))
    return single.unionByName(multiple).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "row_key")
