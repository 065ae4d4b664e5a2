"""S6 as files: one Markdown file per document below a root folder.

``write_tree`` takes the changes of a run (as ``sources.log`` keeps them).  First a Spark job writes the new files beside the tree,
each task in a folder of its own (``DocumentTree``, a Python data source): if it fails, ``abort`` removes them, and the tree is
as before.  ``commit`` writes down which tasks' folders count, which is what decides.  Then jobs move these files into the tree, remove the deleted
paths, and prune folders that this leaves empty, level by level.  Each of these steps may be repeated: a run that broke off after its
commit is completed by the next one (``complete``).  The driver sees one short message per task and no path.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import materialize

STAGING = ".staging"
#: names in a batch of a listing; files and bytes that a task reads, and bytes of contents that it holds at once
NAMES, FILES, BYTES, HELD = 4096, 2048, 32 << 20, 4 << 20


def _filesystem(uri: str):
    """(pyarrow file system, path) of a folder in the shared store."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _exists(filesystem, path: str) -> bool:
    from pyarrow import fs
    return filesystem.get_file_info(path).type != fs.FileType.NotFound


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name


def checked(path: str) -> str:
    """A relative path that stays below its root."""
    parts = path.split("/")
    if any(p in ("", ".", "..") for p in parts) or parts[0] == STAGING or "\0" in path:
        raise ValueError(f"not a path below the tree: {path!r}")
    return path


@dataclass
class Folder(WriterCommitMessage):
    name: str
    files: int
    deleted: int


class DocumentTree(DataSource):
    """Writes (path, content, deleted) rows to a run's staging folder."""

    @classmethod
    def name(cls) -> str:
        return "document_tree"

    def writer(self, schema, overwrite):
        return TreeWriter(self.options["path"], [f.name for f in schema.fields])


class TreeWriter(DataSourceWriter):
    def __init__(self, staging: str, names: list[str]):
        self.staging, self.names = staging, names

    def write(self, rows):
        filesystem, base = _filesystem(self.staging)
        name, files, deleted = uuid.uuid4().hex, [], []
        folder = f"{base}/{name}"
        filesystem.create_dir(folder, recursive=True)
        # a file has a number, so that staging needs no folders of its own
        with filesystem.open_output_stream(f"{folder}/paths") as listed:
            for row in rows:
                row = dict(zip(self.names, row))
                path = checked(row["path"])
                if row["deleted"]:
                    deleted.append(path)
                    listed.write(json.dumps([None, path]).encode() + b"\n")
                else:
                    with filesystem.open_output_stream(f"{folder}/{len(files)}", compression=None) as out:
                        out.write((row["content"] or "").encode())
                    listed.write(json.dumps([len(files), path]).encode() + b"\n")
                    files.append(path)
        return Folder(name, len(files), len(deleted))

    def commit(self, messages):
        filesystem, base = _filesystem(self.staging)
        text = "".join(f"{m.name}\n" for m in messages if m is not None)
        with filesystem.open_output_stream(f"{base}/committing") as out:
            out.write(text.encode())
        filesystem.move(f"{base}/committing", f"{base}/committed")

    def abort(self, messages):
        filesystem, base = _filesystem(self.staging)
        if _exists(filesystem, base):
            filesystem.delete_dir(base)


def _each(df: DataFrame, act) -> int:
    """``act(list of values)`` on the first column of the rows, in their tasks; how many rows."""
    def run(batches):
        for batch in batches:
            act(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])
    return df.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _move_into(root: str, run: str, tasks: DataFrame) -> None:
    def act(names):
        filesystem, base = _filesystem(root)
        made = set()
        for name in names:
            folder = f"{base}/{STAGING}/{run}/{name}"
            with filesystem.open_input_stream(f"{folder}/paths") as f:
                lines = f.read().decode().splitlines()
            for number, path in map(json.loads, lines):
                target = f"{base}/{path}"
                if number is None:
                    if _exists(filesystem, target):
                        filesystem.delete_file(target)
                elif _exists(filesystem, f"{folder}/{number}"):  # else it was moved before the run broke off
                    if (parent := target.rpartition("/")[0]) not in made:
                        filesystem.create_dir(parent, recursive=True)
                        made.add(parent)
                    filesystem.move(f"{folder}/{number}", target)
    _each(tasks, act)


def _prune(root: str, run: str, tasks: DataFrame) -> None:
    """Remove the folders above deleted paths that are empty, the deepest first."""
    from pyarrow import fs

    def folders(batches):
        filesystem, base = _filesystem(root)
        for batch in batches:
            out = set()
            for name in batch.column(0).to_pylist():
                with filesystem.open_input_stream(f"{base}/{STAGING}/{run}/{name}/paths") as f:
                    for number, path in map(json.loads, f.read().decode().splitlines()):
                        parts = path.split("/")[:-1]
                        out.update("/".join(parts[:k]) for k in range(1, len(parts) + 1) if number is None)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], ["folder"])

    def act(names):
        filesystem, base = _filesystem(root)
        for name in names:
            path = f"{base}/{name}"
            if _exists(filesystem, path) and not filesystem.get_file_info(fs.FileSelector(path)):
                filesystem.delete_dir(path)

    found = materialize(tasks.mapInArrow(folders, "folder string").distinct().withColumn("depth", F.size(F.split("folder", "/"))), "table")
    deepest = found.agg(F.max("depth")).first()[0] or 0
    for depth in range(deepest, 0, -1):
        _each(found.filter(F.col("depth") == depth).select("folder"), act)


def complete(spark: SparkSession, root: str) -> int:
    """Carry out a run that was committed, and remove what others left; how many runs (one at most: each run begins with this)."""
    from pyarrow import fs
    filesystem, base = _filesystem(root)
    if not _exists(filesystem, f"{base}/{STAGING}"):
        return 0
    runs = sorted(i.base_name for i in filesystem.get_file_info(fs.FileSelector(f"{base}/{STAGING}")))
    done = 0
    for run in runs:
        folder = f"{base}/{STAGING}/{run}"
        if _exists(filesystem, f"{folder}/committed"):
            with filesystem.open_input_stream(f"{folder}/committed") as f:
                names = f.read().decode().split()
            # by range: a folder in each task, where hashes would put several into one
            tasks = spark.createDataFrame([(n,) for n in names], "name string").repartitionByRange(max(1, len(names)), "name")
            _move_into(root, run, tasks)
            _prune(root, run, tasks)
            done += 1
        filesystem.delete_dir(folder)
    return done


def write_tree(changes: DataFrame, root: str) -> None:
    """Apply ``changes`` (collection, path, content, deleted) to the files ``root/collection/path``; one run at a time."""
    spark = changes.sparkSession
    complete(spark, root)
    filesystem, base = _filesystem(root)
    filesystem.create_dir(base, recursive=True)
    run = uuid.uuid4().hex
    spark.dataSource.register(DocumentTree)
    rows = changes.select(F.concat_ws("/", "collection", "path").alias("path"), "content", "deleted")
    rows.write.format("document_tree").option("path", f"{root}/{STAGING}/{run}").mode("append").save()
    complete(spark, root)


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of the files below ``root``.  Jobs list the folders, a level at a time: the driver sees how many there are,
    and a task the names in a folder, of which it hands on ``NAMES`` at once."""
    from pyarrow import fs

    def listed(batches):
        filesystem, base = _filesystem(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = filesystem.get_file_info(fs.FileSelector(f"{base}/{folder}"))
                for k in range(0, len(found), NAMES):
                    some = [i for i in found[k:k + NAMES] if i.type in (fs.FileType.File, fs.FileType.Directory) and not _hidden(i.base_name)]
                    yield pa.RecordBatch.from_arrays([pa.array([folder + i.base_name for i in some], pa.string()),
                                                      pa.array([i.size if i.is_file else None for i in some], pa.int64())], ["path", "size"])

    files, folders = [], spark.createDataFrame([("",)], "path string")
    while True:
        level = materialize(folders.mapInArrow(listed, "path string, size long"), "table")
        files.append(level.filter("size > 0"))
        folders = level.filter("size IS NULL").select(F.concat("path", F.lit("/")).alias("path"))
        n = folders.count()
        if not n:
            return reduce(lambda a, b: a.unionByName(b), files)
        folders = folders.repartition(min(n, 200 + n // 1000), "path")


def read_tree(spark: SparkSession, root: str) -> DataFrame | None:
    """(collection, path, content) of the files; None if there is no tree.  (As in Spark's readers, files and folders whose name begins
    with a dot or an underscore, which cleaned path segments don't, are passed by, and empty files, which no document is.)

    Spark's ``binaryFile`` lists all files in the driver and reads 32 in a task, so that millions of documents are as
    many entries there and 100,000s of tasks; here a task reads up to ``FILES`` files or ``BYTES`` on average."""
    filesystem, base = _filesystem(root)
    if not _exists(filesystem, base):
        return None
    files = _files(spark, root)
    count, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()

    def read(batches):
        filesystem, base = _filesystem(root)

        def some():
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["relative", "content"])

        for batch in batches:
            paths, contents, held = [], [], 0
            for path in batch.column(0).to_pylist():
                with filesystem.open_input_stream(f"{base}/{path}", compression=None) as f:
                    contents.append(f.read())
                paths.append(path)
                held += len(contents[-1])
                if held >= HELD:
                    yield some()
                    paths, contents, held = [], [], 0
            yield some()

    tasks = max(1, math.ceil(count / FILES), math.ceil(size / BYTES))
    rows = files.select("path").repartition(tasks, "path").mapInArrow(read, "relative string, content binary")
    return rows.select(F.substring_index("relative", "/", 1).alias("collection"), F.regexp_replace("relative", "^[^/]*/", "").alias("path"),
                       F.decode("content", "UTF-8").alias("content"))
