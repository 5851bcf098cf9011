"""Objects put where none is, and archives copied: what appears under a name appears whole, once, and is never replaced."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.sources.lake import listing

#: Bytes that are copied at once.
PIECE = 4 << 20
_RESULT = "path string, bytes long, created boolean"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(folder)
    if store.type_name not in ("local", "hdfs"):
        raise ValueError(f"a {store.type_name} store cannot create a name only if it is free")
    return store, root.rstrip("/")


def _claim(store: fs.FileSystem, made: str, name: str) -> bool:
    """Gives a whole object its name unless the name is taken; of several at once one succeeds."""
    if store.type_name == "local":
        try:
            os.link(made, name)  # fails if the name is there
        except FileExistsError:
            return False
        finally:
            os.unlink(made)
        return True
    try:
        store.move(made, name)  # HDFS refuses to rename to a name that is there
    except OSError:
        store.delete_file(made)
        if store.get_file_info(name).type == fs.FileType.NotFound:
            raise
        return False
    return True


def _put(store: fs.FileSystem, root: str, path: str, pieces: Iterator[bytes]) -> tuple[int, bool]:
    name = f"{root}/{path}"
    if store.get_file_info(name).type != fs.FileType.NotFound:
        return 0, False
    folder, _, last = name.rpartition("/")
    store.create_dir(folder, recursive=True)
    made, size = f"{folder}/.{last}.{TaskContext.get().taskAttemptId()}.{os.getpid()}", 0
    with store.open_output_stream(made, compression=None) as out:
        for piece in pieces:
            out.write(piece)
            size += len(piece)
    return size, _claim(store, made, name)


def _batch(rows: list[tuple[str, int, bool]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "bytes", "created"])


def put_if_absent(objects: DataFrame, folder: str) -> DataFrame:
    """Puts ``objects`` (path: relative, content: binary) below ``folder`` where no object has the name; (path, bytes, created) of each.

    An object is written under a name of its own and then given its name in one step that fails if the name is taken, so a
    reader sees nothing or all of it, and of two writers at once, tasks that run again among them, one wins; the other's
    ``created`` is false. Null content: an empty object. Runs when the result is read, and once more if it is read again, when
    nothing is left to create. ``folder`` is the URI of a local or HDFS folder that all executors share.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            yield _batch([(p, *_put(store, root, p, iter([c or b""]))) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)])

    return objects.select("path", "content").where("path is not null").mapInArrow(put, _RESULT)


def relative(files: DataFrame, folder: str) -> DataFrame:
    """A ``listing`` of ``folder`` with paths as they are below it."""
    root = fs.FileSystem.from_uri(folder)[1].rstrip("/")
    return files.withColumn("path", F.substring_index("path", f"{root}/", -1))


def mirrored(spark: SparkSession, source: str, target: str, *, glob: str = "*") -> DataFrame:
    """Copies what ``target`` lacks of ``source``; (path, bytes, created) of each copy.

    Two listings and an anti join say what is missing; tasks then copy file by file, a piece at a time, so a file's size
    does not matter. What both have is not read, and what only ``target`` has stays. A copy that stops goes on where it was.
    """
    names = lambda folder: relative(listing(spark, folder, glob=glob), folder)
    store, root = _store(target)
    store.create_dir(root, recursive=True)
    missing = names(source).join(names(target).select("path"), "path", "left_anti")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (here, base), (there, root) = _store(source), _store(target)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with here.open_input_stream(f"{base}/{path}", compression=None) as given:
                    yield _batch([(path, *_put(there, root, path, iter(lambda given=given: given.read(PIECE), b"")))])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return missing.repartition(tasks, "path").select("path").mapInArrow(copy, _RESULT)
