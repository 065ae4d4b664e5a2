"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text.  A text
is compressed piece by piece (1,024 bytes, so that a dictionary tells as much at the end of
a long text as at its start) with either; the difference of the two sizes, divided by the
length of the text, becomes a probability by logistic calibration.

Only rows whose ``crc32(doc_id as text) mod 4`` is not 2 are learned from: remainders 0 and
1 give the dictionaries and remainder 3 the calibration.  Both use a bounded sample of
labelled documents in the order of a hash (``most_documents`` of each label for the
dictionaries, ``most_documents`` in all for the calibration).  Each dictionary learns from at most
``most_pieces`` pieces: ``pieces_per_text`` evenly spaced ones of a text, the first of every text in the order
of a hash before the second of any, so that every document counts before one counts twice.
Every text is scored as a whole.

Defined results: null and empty texts have difference 0; a null ``doc_id`` is scored and
not held out; labels that are null, not 0 or 1, or contradict each other are left
out; an id that repeats calibrates once, by the text of the smallest hash, and its copies give
their pieces once; if one of the labels is missing from the sample, every score is 1.0, or 0.0 if only bad ones
exist; repeated rows are scored each; an empty table gives no row.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_of

PIECE = 1024
DICTIONARY_BYTES = 65536
LEVEL = 3


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def pieces_of(data: bytes) -> list[bytes]:
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


def dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the pieces themselves where they are too few to train one."""
    import zstandard
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, pieces)) // 8))
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY_BYTES]


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; without dictionaries every score is ``constant``."""

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    offset: float = 0.0
    constant: float | None = None

    def compressors(self) -> list:
        import zstandard
        out = []
        for data in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False,
                                                write_dict_id=False))
        return out

    def score(self, difference: float) -> float:
        z = self.slope * difference + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def differences(docs: DataFrame, model: Model, others: list[str]) -> DataFrame:
    """``others`` and ``difference`` of every row's ``text``."""

    def run(batches):
        good, bad = (c.compress for c in model.compressors())
        for batch in batches:
            out = []
            for t in batch.column("text"):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                parts = pieces_of(data)
                out.append((sum(len(bad(p)) for p in parts) - sum(len(good(p)) for p in parts)) / max(1, len(data)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(out, pa.float64())],
                                             others + ["difference"])

    rows = docs.select(*others, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in others)
    return rows.mapInArrow(run, schema + ", difference double")


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit ``y`` best, with a little shrinkage of the slope."""
    scale = float(np.abs(x).max()) or 1.0
    a = np.c_[x / scale, np.ones(len(x))]
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, most_documents: int = 4000, pieces_per_text: int = 16,
        most_pieces: int = 4000) -> Model:
    """Learn the model from ``labels(doc_id, quality)`` of ``docs(doc_id, text)``; the bounds are those of its sample."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where("doc_id is not null and quality in (0, 1)")
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
             .where("quality = other").select("doc_id", "quality", remainder().alias("part"),
                                              F.xxhash64("doc_id").alias("hash")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    chosen = [known.where((F.col("part") < 2) & (F.col("quality") == q)).orderBy("hash", "doc_id").limit(most_documents)
              for q in (0, 1)]
    # the sample is bounded, and so is what is broadcast
    sample = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")

    def cut(batches):
        for batch in parts_of(batches):
            rows = []
            for row in batch.to_pylist():
                parts = pieces_of((row["text"] or "").encode())
                at = [int(i) for i in np.unique(np.linspace(0, len(parts) - 1, pieces_per_text).astype(int))] if parts else []
                # in an order that the text gives, so that the first piece is not always the start
                at.sort(key=lambda i: (zlib.crc32(parts[i]), i))
                rows += [(row["quality"], row["hash"], turn, i, parts[i]) for turn, i in enumerate(at)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["quality", "hash", "turn", "at", "piece"])

    pieces = (sample.select("quality", "hash", "text").mapInArrow(cut, "quality int, hash long, turn int, at int, piece binary")
              .distinct()  # copies under one id count once
              .withColumn("order", F.xxhash64("hash", "at")))
    found = [[bytes(r.piece) for r in pieces.where(F.col("quality") == q).orderBy("turn", "order", "hash", "at", "piece")
              .limit(most_pieces).collect()] for q in (0, 1)]
    if not all(found):
        return Model(constant=0.0 if found[0] else 1.0)
    model = Model(dictionary(found[1]), dictionary(found[0]))
    held = known.where(F.col("part") == 3).orderBy("hash", "doc_id").limit(most_documents)
    # one row of each id, so that the rows are bounded as the ids are
    rows = (differences(texts.join(F.broadcast(held), "doc_id").withColumn("text_hash", F.xxhash64("text")), model,
                        ["doc_id", "quality", "text_hash"])
            .groupBy("doc_id", "quality").agg(F.min(F.struct("text_hash", "difference")).alias("least"))
            .select("doc_id", "quality", "least.difference").orderBy("doc_id").collect())
    y = np.array([r.quality for r in rows], float)
    if len(set(y)) < 2:  # too few to calibrate: one half at no difference
        return Model(model.good, model.bad, 50.0, 0.0)
    return Model(model.good, model.bad, *logistic(np.array([r.difference for r in rows]), y))


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    if model.constant is not None:
        out = rows.withColumn("score", F.lit(model.constant))
    else:
        z = -(F.col("difference") * model.slope + model.offset)
        out = differences(rows, model, ["doc_id"]).withColumn("score", 1 / (1 + F.exp(F.least(z, F.lit(700.0)))))
    return out.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold``."""
    if model.constant is not None:
        return docs if model.constant >= threshold else docs.limit(0)

    @F.pandas_udf("double")
    def difference(texts):
        import pandas as pd
        good, bad = (c.compress for c in model.compressors())
        out = []
        for t in texts:
            data = (t or "").encode()
            parts = pieces_of(data)
            out.append((sum(len(bad(p)) for p in parts) - sum(len(good(p)) for p in parts)) / max(1, len(data)))
        return pd.Series(out)

    z = -(difference("text") * model.slope + model.offset)
    return docs.where(1 / (1 + F.exp(F.least(z, F.lit(700.0)))) >= threshold)
