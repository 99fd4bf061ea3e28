"""Folders read on executors: walks that never enter what is left out, and a stream of what changes below a folder.

Paths are URIs or plain paths that pyarrow's file systems know (local mounts, HDFS, object stores) and that all executors see.
Hidden folders (and so `.snapshots`) and excluded ones are not listed. What cannot be read, or goes meanwhile, is passed over;
only the root has to be there.
"""

from __future__ import annotations

import datetime
import json
import re
import time
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from glimmer.shipping import ship
from glimmer.sources.files import TYPES, mime_type
from glimmer.store import written

#: Folders that a task lists before it gives the others back, to be dealt anew.
PER_TASK = 200
_WALK = "kind string, path string, size long, modified timestamp"
_FOUND = pa.schema([("kind", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])


def opened(uri: str) -> tuple:
    """The file system of a URI or plain path, and the path in it; names may have any characters."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(quote(uri if re.match("[a-z0-9]+:", uri) else f"file://{uri}", safe=":/@?=&,+"))


def listed(folder: str) -> list[tuple[str, bool, int, int]]:
    """Entries of a folder: path, whether it is a folder, size, and time of change in microseconds."""
    from pyarrow.fs import FileSelector, FileType

    system, path = opened(folder)
    infos = system.get_file_info(FileSelector(path))
    prefix = folder.rstrip("/")
    return [(f"{prefix}/{i.base_name}", i.type == FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1000) for i in infos if i.type in (FileType.Directory, FileType.File)]


def wanted_folder(path: str, excluded: frozenset[str]) -> bool:
    return not path.rpartition("/")[2].startswith(".") and path not in excluded


def wanted_file(path: str) -> bool:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[2].lower() in TYPES and "." in name


def _descend(excluded: frozenset[str], per_task: int, lister: Callable, roots: frozenset[str]):
    """Lists folders, and those below, up to per_task of them; further ones come out as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo, n, out = batch.column("path").to_pylist(), 0, []
            while todo and n < per_task:
                folder = todo.pop()
                n += 1
                out.append(("folder", folder, 0, 0))
                try:
                    entries = lister(folder)
                except OSError:
                    if folder in roots:
                        raise
                    continue
                for path, is_folder, size, modified in entries:
                    if is_folder:
                        if wanted_folder(path, excluded):
                            todo.append(path)
                    elif wanted_file(path):
                        out.append(("file", path, size, modified))
            out += [("left", path, 0, 0) for path in todo]
            for k in range(0, len(out), 10_000):
                columns = list(zip(*out[k : k + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return run


def walked(spark: SparkSession, roots: list[str], excluded: tuple[str, ...] = (), lister: Callable = listed, per_task: int | None = None) -> DataFrame:
    """kind (folder: was listed, or file), path, size, modified of all below the roots.

    Rounds of tasks: each lists some folders and what is below them, and gives back what it has not come to. excluded: paths of
    folders, as they stand below the roots.
    """
    ship(spark)
    own = frozenset(r.rstrip("/") for r in roots)
    todo, found = spark.createDataFrame([(r,) for r in sorted(own) if ".snapshots" not in r.split("/")], "path string"), None
    run = _descend(frozenset(x.rstrip("/") for x in excluded), per_task or PER_TASK, lister, own)
    while True:
        level = written(todo.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(run, _WALK), "walk")
        found = level if found is None else found.unionByName(level)
        todo = level.filter("kind = 'left'").select("path")
        if not todo.limit(1).count():
            return found.filter("kind <> 'left'")


def media_files(spark: SparkSession, roots: list[str], excluded: tuple[str, ...] = (), lister: Callable = listed) -> DataFrame:
    """path, size, modified, mime_type of the files that are indexed below the roots."""
    files = walked(spark, roots, excluded, lister).filter("kind = 'file'")
    return files.select("path", "size", "modified", mime_type(F.col("path")).alias("mime_type"))


def put_files(rows: DataFrame, path: str, content: str) -> DataFrame:
    """Writes a file for each row from tasks, and gives rows back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column(path).to_pylist(), batch.column(content).to_pylist(), strict=True):
                system, local = opened(p)
                system.create_dir(local.rpartition("/")[0], recursive=True)
                with system.open_output_stream(local) as f:
                    f.write(data)
            yield batch

    return rows.mapInArrow(run, rows.schema)


CHANGES = "kind string, path string, size long, modified timestamp"


class Part(InputPartition):
    def __init__(self, number: int, start: int, end: int) -> None:
        self.number, self.start, self.end = number, start, end


class _Changes(DataSourceStreamReader):
    """An offset is a time. The state of the folder at an offset is kept in files, one for each part, under `state`; a part has
    the root's entries of one hash. A batch that runs again finds its end there and gives the same rows."""

    def __init__(self, options: dict) -> None:
        self.path, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.excluded = frozenset(x.rstrip("/") for x in options.get("excluded", "").split("\n") if x)
        self.parts = int(options.get("parts", "8"))

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(i, start["at"], end["at"]) for i in range(self.parts)]

    def _files(self, number: int) -> dict[str, tuple[int, int]]:
        """Files of the part: below the root's entries of its hash."""
        mine = lambda path: zlib.crc32(path[len(self.path) + 1 :].partition("/")[0].encode()) % self.parts == number
        out, todo = {}, [self.path]
        while todo:
            folder = todo.pop()
            try:
                entries = listed(folder)
            except OSError:
                if folder == self.path:
                    raise
                continue
            for path, is_folder, size, modified in filter(lambda e: mine(e[0]), entries):
                if is_folder and wanted_folder(path, self.excluded):
                    todo.append(path)
                elif not is_folder and wanted_file(path):
                    out[path] = (size, modified)
        return out

    def _kept(self, at: int, number: int) -> dict | None:
        system, base = opened(self.state)
        try:
            with system.open_input_stream(f"{base}/{at}/{number}.json") as f:
                return {p: tuple(v) for p, v in json.loads(f.read()).items()}
        except (OSError, ValueError):
            return None

    def _keep(self, at: int, number: int, files: dict) -> None:
        system, base = opened(self.state)
        system.create_dir(f"{base}/{at}", recursive=True)
        target = f"{base}/{at}/{number}.json"
        half = f"{target}.{time.time_ns()}"
        with system.open_output_stream(half) as f:
            f.write(json.dumps(files).encode())
        system.move(half, target)  # whole or not there

    def read(self, partition: Part) -> Iterator[tuple]:
        before = {} if partition.start == 0 else self._kept(partition.start, partition.number)
        after = self._kept(partition.end, partition.number)
        if after is None:
            after = self._files(partition.number)
            self._keep(partition.end, partition.number, after)
        when = lambda micros: datetime.datetime.fromtimestamp(0, datetime.UTC) + datetime.timedelta(microseconds=micros)
        for path, (size, modified) in after.items():
            kind = "rescan" if before is None else "create" if path not in before else "write" if before[path] != (size, modified) else None
            if kind:
                yield kind, path, size, when(modified)
        for path, (size, modified) in (before or {}).items():
            if path not in after:
                yield "remove", path, size, when(modified)

    def commit(self, end: dict) -> None:
        system, base = opened(self.state)
        for info in system.get_file_info(_selector(base)):
            if info.base_name.isdigit() and int(info.base_name) < end["at"]:
                system.delete_dir(info.path)


def _selector(folder: str):
    from pyarrow.fs import FileSelector

    return FileSelector(folder, allow_not_found=True)


class FolderChanges(DataSource):
    """Stream of changes below a folder: create, write (size or time differ), remove; a rename is a remove and a create. Where the
    state at the start is lost, all files there are come as `rescan`, to be compared with the catalog.

    Options: path, state (a folder of its own, shared by executors), parts, excluded (paths, one a line).
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> _Changes:  # noqa: ANN001
        return _Changes(dict(self.options))


def folder_changes(spark: SparkSession, path: str, state: str, excluded: tuple[str, ...] = (), parts: int = 8) -> DataFrame:
    """A stream of kind, path, size, modified; each trigger compares the folder with how the one before left it."""
    ship(spark)
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").options(path=path, state=state, excluded="\n".join(excluded), parts=str(parts)).load()


def changed_catalog(catalog: DataFrame, changes: DataFrame, root: str) -> DataFrame:
    """catalog (path, size, modified) after a batch of changes; after a rescan, rows below root that were not met are gone."""
    last = changes.select("path", F.col("kind").alias("__kind"), F.col("size").alias("__size"), F.col("modified").alias("__modified"))
    again = changes.filter("kind = 'rescan'").limit(1).select(F.lit(True).alias("__again"))
    both = catalog.join(last, "path", "full_outer").join(F.broadcast(again), F.lit(True), "left")  # one row at most
    gone = (F.col("__kind") == "remove") | (F.col("__again") & F.col("__kind").isNull() & F.col("path").startswith(root.rstrip("/") + "/"))
    kept = both.filter(~F.coalesce(gone, F.lit(False)))
    return kept.select("path", F.coalesce("__size", "size").alias("size"), F.coalesce("__modified", "modified").alias("modified"))
