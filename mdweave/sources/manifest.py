"""Manifest scan with version upgrade, into the long-form tables of
``operators.sync`` (installs, managed_files, selected_urls).

A manifest file is JSON: version 2 ``{"installs": [...]}`` or a legacy
version-1 record that *is* the single install, told by the presence of one of its
keys, whatever the value.  Missing or corrupt files give no installs.  The text is
parsed once into a VARIANT, so every value keeps its JSON type: list
entries and fields of another type than expected are dropped, not coerced.
Lists carry the place of their install, and an install its whole source record as JSON text.
Deviation: an object that repeats a key counts as corrupt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the keys that make a record without ``installs`` an install
LEGACY_KEYS = ("source", "managedFiles", "selectedUrls", "layout", "pathPrefix")
# the whole source record, whatever its fields
SOURCE = ("CASE WHEN startswith(schema_of_variant(try_variant_get(i, '$.source', 'variant')), 'OBJECT') "
          "THEN to_json(try_variant_get(i, '$.source', 'variant')) END")


def _text(path: str) -> F.Column:
    """The value at ``path`` of the install if it is a JSON string."""
    return F.expr(f"CASE WHEN schema_of_variant(try_variant_get(i, '{path}', 'variant')) = 'STRING' "
                  f"THEN try_variant_get(i, '{path}', 'string') END")


def _texts(path: str) -> F.Column:
    """The strings of the list at ``path`` of the install, in order."""
    return F.expr(f"transform(filter(try_variant_get(i, '{path}', 'array<variant>'), "
                  "x -> schema_of_variant(x) = 'STRING'), x -> CAST(x AS STRING))")


def manifest_installs(manifests: DataFrame) -> DataFrame:
    """(collection, text) -> one row per install with its position."""
    parsed = manifests.select("collection", F.try_parse_json("text").alias("m"))
    legacy = " OR ".join(f"try_variant_get(m, '$.{k}', 'variant') IS NOT NULL" for k in LEGACY_KEYS)
    installs = F.expr(
        "CASE WHEN try_variant_get(m, '$.installs', 'array<variant>') IS NOT NULL "
        "THEN filter(try_variant_get(m, '$.installs', 'array<variant>'), "
        "x -> startswith(schema_of_variant(x), 'OBJECT') OR startswith(schema_of_variant(x), 'ARRAY')) "
        f"WHEN {legacy} THEN array(m) END")
    one = parsed.select("collection", F.posexplode(installs).alias("pos", "i"))
    return one.select("collection", F.col("pos").cast("int").alias("pos"), _text("$.source.url").alias("source_url"),
                      _text("$.source.label").alias("source_label"), _text("$.layout").alias("layout"),
                      _text("$.pathPrefix").alias("path_prefix"), F.expr(SOURCE).alias("source"), _texts("$.managedFiles").alias("managed"),
                      _texts("$.selectedUrls").alias("selected"))


def read_manifests(spark: SparkSession, paths, collection_of=None) -> dict:
    """Read manifest files; ``collection`` = the file's directory unless given."""
    raw = spark.read.text(paths, wholetext=True).select(
        F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("collection"), F.col("value").alias("text"))
    return manifest_tables(raw)


def manifest_tables(manifests: DataFrame) -> dict:
    """Long-form tables from (collection, text)."""
    inst = manifest_installs(manifests)
    place = ["collection", "pos", "source_url"]
    ord_ = F.struct(F.col("__ord").cast("long").alias("line_pos"), F.lit(0).alias("match_pos")).alias("ord")
    return {"installs": inst.drop("managed", "selected"),
            "managed_files": inst.select(*place, F.explode("managed").alias("path")),
            "selected_urls": inst.select(*place, F.posexplode("selected").alias("__ord", "url")).select(*place, "url", ord_)}
