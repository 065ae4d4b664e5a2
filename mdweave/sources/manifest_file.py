"""The manifest of a collection as one JSON file with 2-space indentation, as the S5 scan reads it.

The file is a sequence of small pieces, one per list entry and a few per install, each with its place (install, field,
order).  The pieces are range-sorted, every task writes what it has of a collection as one part, and a
task per collection streams its parts into the file.  No list is ever one value.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_folder
from .tree import _filesystem

PLACE = ["collection", "pos", "field", "place", "text"]
# fixed values: the fields of an install in their order, and the short escapes of a JSON text
LAYOUT, MANAGED, PREFIX, SELECTED, SOURCE = range(5)
SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}


def quoted(text) -> Column:
    """A JSON text as ``JSON.stringify`` writes it: short escapes, other control characters as \\u00xx, the rest as it is."""
    c = F.col(text) if isinstance(text, str) else text
    escaped = F.replace(c, F.lit("\\"), F.lit(SHORT[92]))
    escaped = F.replace(escaped, F.lit('"'), F.lit(SHORT[34]))
    control = escaped
    for n in range(32):
        control = F.replace(control, F.lit(chr(n)), F.lit(SHORT.get(n, f"\\u{n:04x}")))
    return F.concat(F.lit('"'), F.when(escaped.rlike(r"[\x00-\x1F]"), control).otherwise(escaped), F.lit('"'))


def indented(json_text, depth: int) -> Column:
    """A flat JSON object of texts and numbers, as the manifest tables carry it, with each member on a line of its own."""
    members = F.from_json(json_text, "map<string,string>")
    kinds = F.from_json(json_text, "map<string,variant>")
    inner, end = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    item = F.transform(F.map_entries(members), lambda e: F.concat(
        quoted(e["key"]), F.lit(": "), F.when(F.schema_of_variant(F.element_at(kinds, e["key"])) == "STRING", quoted(e["value"]))
        .otherwise(F.coalesce(e["value"], F.lit("null")))))
    return F.when(F.size(members) > 0, F.concat(F.lit("{" + inner), F.array_join(item, "," + inner), F.lit(end + "}"))).otherwise(F.lit("{}"))


def pieces(installs: DataFrame, managed_files: DataFrame, selected_urls: DataFrame, collections: DataFrame, generated_at: str) -> DataFrame:
    """``collection, pos, field, place, text``: the pieces of all files; put together in this order they are the JSON texts."""
    pad = "      "

    def entries(table, value, order, field):
        rows = table.select("collection", "pos", F.lit(field).alias("field"), order.alias("order"), F.col(value).alias("value"))
        first = rows.groupBy("collection", "pos").agg(F.min(F.struct("order", "value")).alias("__first"))
        text = F.concat(F.when(F.struct("order", "value") == F.col("__first"), F.lit("\n")).otherwise(F.lit(",\n")),
                        F.lit(pad + "  "), quoted("value"))
        place = F.struct(F.lit(1).alias("part"), F.col("order.line_pos").alias("line_pos"), F.col("order.match_pos").alias("match_pos"), F.col("value"))
        return rows.join(first, ["collection", "pos"]).select("collection", "pos", "field", place.alias("place"), text.alias("text")), \
            first.select("collection", "pos", F.lit(True).alias(f"has{field}"))

    none = F.struct(F.lit(0).cast("long").alias("line_pos"), F.lit(0).alias("match_pos"))
    managed, has_managed = entries(managed_files.distinct(), "path", none, MANAGED)
    chosen, has_chosen = entries(selected_urls, "url", F.col("ord"), SELECTED)

    def at(field, part, text):
        place = F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("line_pos"), F.lit(0).alias("match_pos"), F.lit("").alias("value"))
        return F.struct(F.lit(field).alias("field"), place.alias("place"), text.alias("text"))

    first = installs.groupBy("collection").agg(F.min("pos").alias("__first"))
    rows = (installs.join(first, "collection").join(has_managed, ["collection", "pos"], "left").join(has_chosen, ["collection", "pos"], "left"))
    opening = F.concat(F.when(F.col("pos") == F.col("__first"), F.lit("\n    {\n")).otherwise(F.lit(",\n    {\n")), F.lit(pad + '"layout": '),
                       F.when(F.col("layout") == "flat", F.lit('"flat"')).otherwise(F.lit('"nested"')), F.lit(",\n"))

    def closing(field):
        return F.when(F.col(f"has{field}"), F.lit("\n" + pad + "],\n")).otherwise(F.lit("],\n"))
    own = rows.select("collection", "pos", F.explode(F.array(
        at(LAYOUT, 0, opening), at(MANAGED, 0, F.lit(pad + '"managedFiles": [')), at(MANAGED, 2, closing(MANAGED)),
        at(PREFIX, 0, F.concat(F.lit(pad + '"pathPrefix": '), quoted(F.coalesce("path_prefix", F.lit(""))), F.lit(",\n"))),
        at(SELECTED, 0, F.lit(pad + '"selectedUrls": [')), at(SELECTED, 2, closing(SELECTED)),
        at(SOURCE, 0, F.concat(F.lit(pad + '"source": '), indented(F.coalesce("source", F.lit("{}")), 3), F.lit("\n    }"))))).alias("p"))
    own = own.select("collection", "pos", "p.field", "p.place", "p.text")
    ends = collections.select("collection").distinct().join(first, "collection", "left")
    head = F.concat(F.lit('{\n  "generatedAt": '), quoted(F.lit(generated_at)), F.lit(',\n  "installs": ['))
    tail = F.concat(F.when(F.col("__first").isNotNull(), F.lit("\n  ]")).otherwise(F.lit("]")), F.lit(',\n  "version": 2\n}\n'))
    least, most = F.lit(-1), F.lit(2**31 - 1)
    frame = ends.select("collection", F.explode(F.array(F.struct(least.alias("pos"), at(0, 0, head).alias("p")),
                                                        F.struct(most.alias("pos"), at(0, 0, tail).alias("p")))).alias("x"))
    frame = frame.select("collection", "x.pos", "x.p.field", "x.p.place", "x.p.text")
    return own.unionByName(managed).unionByName(chosen).unionByName(frame).select(*PLACE)


def write_manifest_files(tables: dict, collections: DataFrame, root: str, name: str, generated_at: str) -> int:
    """Write ``root/<collection>/<name>`` for each of ``collections(collection)``; how many."""
    spark = collections.sparkSession
    parts = scratch_folder(spark, "manifest-parts")
    order = ["collection", "pos", "field", "place"]
    rows = pieces(tables["installs"], tables["managed_files"], tables["selected_urls"], collections, generated_at)

    def write(batches):
        filesystem, base = _filesystem(parts)
        filesystem.create_dir(base, recursive=True)
        here, out, listed = None, None, []
        for batch in batches:
            for number, collection, text in zip(*(batch.column(c).to_pylist() for c in ("range", "collection", "text"))):
                if (number, collection) != here:
                    if out:
                        out.close()
                    here, file = (number, collection), f"{base}/{uuid.uuid4().hex}"
                    out = filesystem.open_output_stream(file, compression=None)
                    listed.append((collection, number, file))
                out.write(text.encode())
        if out:
            out.close()
            kinds = (pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*listed), kinds)], ["collection", "range", "file"])

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    written = materialize(ranged.select("range", "collection", "text").mapInArrow(write, "collection string, range int, file string"), "table")

    def assemble(batches):
        filesystem, base = _filesystem(root)
        here, out, n = None, None, 0

        def done():
            out.close()
            filesystem.move(f"{base}/{here}/.{name}.new", f"{base}/{here}/{name}")
        for batch in batches:
            for collection, file in zip(batch.column("collection").to_pylist(), batch.column("file").to_pylist()):
                if collection != here:
                    if here is not None:
                        done()
                    here, n = collection, n + 1
                    filesystem.create_dir(f"{base}/{here}", recursive=True)
                    out = filesystem.open_output_stream(f"{base}/{here}/.{name}.new", compression=None)
                with filesystem.open_input_stream(file) as part:
                    while chunk := part.read(1 << 20):
                        out.write(chunk)
        if here is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    joined = written.repartition("collection").sortWithinPartitions("collection", "range").select("collection", "file")
    return joined.mapInArrow(assemble, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
