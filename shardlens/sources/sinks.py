"""Publishing routes and checkpoint lists, and reading checkpoint listings."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from io import TextIOWrapper
from itertools import groupby, islice
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.schema import TABLE_KEY

ROUTE_BUCKETS = 64


@dataclass
class PublishResult:
    """Targets written, targets that had the batch already, targets removed, and the last error met (targets after a
    failing one are still written)."""

    written: list[str] = field(default_factory=list)
    repeated: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    error: str | None = None


class _Folder:
    """A folder in whatever file system its name belongs to."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark._jvm
        self._store = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str) -> list[str]:
        place = self._at(below)
        return [s.getPath().getName() for s in self._store.listStatus(place)] if self._store.exists(place) else []

    def read(self, name: str) -> str:
        source = self._store.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def place(self, name: str, text: str) -> bool:
        """Write a small file under a name of its own and rename it; False if ``name`` is taken already."""
        draft = self._at(f"{name}.{uuid.uuid4().hex}.draft")
        out = self._store.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._store.exists(self._at(name)) and self._store.rename(draft, self._at(name)):
            return True
        self._store.delete(draft, False)
        return False

    def drop(self, name: str = "") -> bool:
        return self._store.delete(self._at(name), True)


def _published(folder: _Folder) -> list[int]:
    """Numbers of the batches that ``folder`` holds, oldest first."""
    return sorted(int(name.removesuffix(".json")) for name in folder.names("manifests") if name.endswith(".json"))


def _publish(laid_out: DataFrame, folder: _Folder, batch_id: int, keep: int) -> bool:
    there = _published(folder)
    if there and batch_id <= there[-1]:
        return False
    data = f"sets/{batch_id}-{uuid.uuid4().hex}"
    laid_out.write.partitionBy("service", "table_bucket").parquet(f"{folder.path}/{data}")
    manifest = {"batch": batch_id, "data": data, "schema": laid_out.schema.json()}
    if not folder.place(f"manifests/{batch_id}.json", json.dumps(manifest)):
        folder.drop(data)  # another attempt of the batch was first
        return False
    for old in _published(folder)[:-keep]:
        name = f"manifests/{old}.json"
        gone = json.loads(folder.read(name))["data"]
        folder.drop(name)
        folder.drop(gone)
    return True


def write_routes(routes: DataFrame, targets: list[str], batch_id: int, previous: list[str] = (), keep: int = 2) -> PublishResult:
    """Publish route set ``batch_id`` to every target folder; folders of ``previous`` that are no target any more go away.

    A set is written to a folder of its own and counts from the moment its manifest is there, so a reader sees whole sets
    only and a lost attempt leaves nothing that is read.  A batch that a target has already changes nothing.  The last
    ``keep`` sets stay for readers that have begun; ``batch_id`` must grow.  Routes are laid out by service and hash of the
    table, so that a table of any size spreads over files and readers of one service prune the rest.
    """
    result = PublishResult()
    laid_out = routes.withColumn("table_bucket", F.pmod("table_id", F.lit(ROUTE_BUCKETS)))
    for target in targets:
        try:
            done = _publish(laid_out, _Folder(routes.sparkSession, target), batch_id, keep)
            (result.written if done else result.repeated).append(target)
        except Exception as e:  # noqa: BLE001 - one bad target must not stop the others
            result.error = f"{target}: {e}"
    for target in previous:
        if target not in targets and drop_folder(routes.sparkSession, target):
            result.removed.append(target)
    return result


def read_routes(spark: SparkSession, target: str, batch_id: int | None = None) -> DataFrame:
    """The newest published route set of a target folder, or that of ``batch_id``."""
    folder = _Folder(spark, target)
    there = [n for n in _published(folder) if batch_id in (None, n)]
    if not there:
        raise ValueError(f"{target}: no route set {'' if batch_id is None else batch_id}".rstrip())
    manifest = json.loads(folder.read(f"manifests/{there[-1]}.json"))
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    whole = spark.read.schema(schema).parquet(f"{folder.path}/{manifest['data']}")
    return whole.select(*[name for name in schema.names if name != "table_bucket"])


def route_publisher(
    build: Callable[[DataFrame], DataFrame], targets: list[str], keep: int = 2
) -> Callable[[DataFrame, int, str], None]:
    """For ``runner.drain_batches``: publish ``build(batch)`` under the id of the micro-batch; an error stops the stream."""

    def each(batch: DataFrame, batch_id: int, out: str) -> None:
        result = write_routes(build(batch), targets, batch_id, keep=keep)
        if result.error:
            raise RuntimeError(result.error)

    return each


def drop_folder(spark: SparkSession, path: str) -> bool:
    """Delete a published folder through Hadoop's file system, wherever it is."""
    return _Folder(spark, path).drop()


def _arrow(path: str) -> tuple:
    """(file system, place) of a local path or of what Arrow's file systems reach."""
    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(path)


def _width(spark: SparkSession) -> int:
    """Tasks for work that is many small files and few bytes; a given number is not merged again."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


# Name of the folder of rows without a table, and lines of a list that are handed on at once.
NO_TABLE, LINES_AT_ONCE = "__HIVE_DEFAULT_PARTITION__", 10000


def write_checkpoint_list(lines: DataFrame, path: str) -> None:
    """Write ``checkpoint_list`` rows as text, one folder per table, files and lines in history order.

    Rows are range partitioned by table and time, so one table's long history spreads over several files.  Every task
    makes the folders of its own tables, so nothing a table is done on the driver.  A file is named by its task and
    moved into place when it is whole: a repeated task writes the same files again.
    """
    spark, order = lines.sparkSession, ["table_id", "start_sec", "session_id"]
    _Folder(spark, path).drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _arrow(path)
        store.create_dir(root)
        task = TaskContext.get()
        name, draft = f"part-{task.partitionId():05d}.txt", f".{task.taskAttemptId()}.draft"
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        for table_id, mine in groupby(rows, key=lambda row: row[0]):
            folder = f"{root}/table_id={NO_TABLE if table_id is None else table_id}"
            store.create_dir(folder)
            with store.open_output_stream(f"{folder}/{draft}") as out:
                while some := list(islice(mine, LINES_AT_ONCE)):
                    out.write("".join(f"{line or ''}\n" for _, line in some).encode())
            store.move(f"{folder}/{draft}", f"{folder}/{name}")
        yield from ()

    ranged = lines.repartitionByRange(_width(spark), *order).sortWithinPartitions(*order)
    ranged.select("table_id", "line").mapInArrow(run, "table_id bigint").write.format("noop").mode("overwrite").save()


def read_checkpoint_list(spark: SparkSession, path: str) -> DataFrame:
    """(table_id, session_id, path) of written checkpoint lists; lines that are no ``session path`` are left out.

    One task names the folders, all of them read: there is a small file a table, too many to be planned by the driver.
    """
    from pyarrow import fs

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            store, root = _arrow(path)
            found = [i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.startswith("table_id=")]
            for k in range(0, len(found), LINES_AT_ONCE):
                yield pa.record_batch({"folder": found[k:k + LINES_AT_ONCE]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _arrow(path)

        def rows(folder: str) -> Iterator[tuple[str, int | None]]:
            key = folder.removeprefix("table_id=")
            files = sorted(i.path for i in store.get_file_info(fs.FileSelector(f"{root}/{folder}")) if i.base_name.startswith("part-"))
            for file in files:
                with store.open_input_stream(file) as stream:
                    for line in TextIOWrapper(stream, encoding="utf-8", errors="replace"):
                        yield line.rstrip("\n"), None if key == NO_TABLE else int(key)

        every = (row for batch in batches for folder in batch.column(0).to_pylist() for row in rows(folder))
        while some := list(islice(every, LINES_AT_ONCE)):
            yield pa.record_batch([pa.array([r[0] for r in some], pa.string()), pa.array([r[1] for r in some], pa.int64())], ["value", "table_id"])

    folders = spark.range(1).mapInArrow(name, "folder string").repartition(_width(spark), "folder")
    found = r"^([0-9]+) (.+)$"
    lines = folders.mapInArrow(run, "value string, table_id bigint").filter(F.col("value").rlike(found))
    part = lambda i: F.regexp_extract("value", found, i)
    return lines.select("table_id", part(1).cast("bigint").alias("session_id"), part(2).alias("path"))


def _entries(path: str) -> list[tuple[str, str]]:
    """(type, name) of what lies directly in a folder, empty files and folders too; a folder that is not there is empty."""
    from pyarrow import fs

    store, place = _arrow(path)
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return [("DIRECTORY" if info.type == fs.FileType.Directory else "FILE", info.base_name) for info in found]


def list_checkpoints(checkpoints: DataFrame, region: str) -> DataFrame:
    """FILE and DIRECTORY entries of every checkpoint folder: (TABLE_KEY, path, region, type, suffix).

    ``checkpoints``: (TABLE_KEY, path), as read from checkpoint lists.  The executors list the folders, each task its
    own share, so nothing is enumerated on the driver and a lost task lists its folders again.  Contents are never read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*row, kind, name) for row in batch.itertuples(index=False) for kind, name in _entries(row.path)]
            yield pd.DataFrame(rows, columns=[*batch.columns, "type", "suffix"])

    wide = checkpoints.select(*TABLE_KEY, "path").repartition(_width(checkpoints.sparkSession), *TABLE_KEY, "path")
    asked = wide.distinct().withColumn("region", F.lit(region))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
    return asked.mapInPandas(run, f"{kinds}, type string, suffix string")
