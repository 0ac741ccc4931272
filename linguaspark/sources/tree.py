"""Folder trees of whole files: a reader that lists by itself, and a writer with a commit step.

Spark's own file sources pass over names that begin with ``_`` or ``.``, fail
or drop unreadable files without a word, and name what they write
themselves. Here

* ``scan`` reads every file of a tree, whatever its name, through a Python
  data source: files are listed once, packed into partitions by size, read in
  the tasks, and one that cannot be read is a row with the reason;
* ``write_files`` puts each ``(path, content)`` row in its place: Spark writes
  them all to a staging folder under the root, and only when that job is done
  each file takes its place by a rename, in the tasks of a second job. A failed job leaves the old files.
"""

from __future__ import annotations

import contextlib
import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import is_local_path, local_fs_path

STAGE = "_linguaspark_stage-"  # folders of files not yet in place; never read
PART_BYTES, PART_FILES = 32 << 20, 2000


def _file_system(root: str):
    """(pyarrow file system, path in it) of a root that pyarrow can open, else None."""
    from pyarrow import fs
    if is_local_path(root):
        return fs.LocalFileSystem(), re.sub("^/+", "/", local_fs_path(root))
    try:
        return fs.FileSystem.from_uri(root)
    except Exception:  # noqa: BLE001  whatever the scheme's driver raises: not ours to read
        return None


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class TreeReader(DataSourceReader):
    def __init__(self, root: str, suffixes: list[str]):
        self.root, self.suffixes = root, tuple(suffixes)

    def _open(self):
        files, base = _file_system(self.root)
        return files, base.rstrip("/")

    def _list(self) -> Iterator[tuple[str, int]]:
        """(path below the root, bytes) of all files; what cannot even be looked at is listed with 0 bytes, to fail when read."""
        from pyarrow import fs
        files, base = self._open()
        if files.get_file_info(base or "/").type != fs.FileType.Directory:
            yield "", 0  # the root is a single file
        elif isinstance(files, fs.LocalFileSystem):
            closed: list[OSError] = []
            for folder, _, names in os.walk(base or "/", onerror=closed.append):
                for path in (os.path.join(folder, n) for n in names):
                    yield path[len(base) + 1:], os.path.getsize(path) if os.path.exists(path) else 0
            yield from ((e.filename[len(base) + 1:], 0) for e in closed)
        else:
            for f in files.get_file_info(fs.FileSelector(base, recursive=True)):
                if f.type != fs.FileType.Directory:
                    yield f.path[len(base) + 1:], f.size or 0

    def partitions(self) -> list[Files]:
        found = [(name, size) for name, size in self._list() if not name or name.endswith(self.suffixes or "") and STAGE not in name]
        out, size = [[]], 0
        for name, n in sorted(found):
            if out[-1] and (size + n > PART_BYTES or len(out[-1]) >= PART_FILES):
                out.append([])
                size = 0
            out[-1].append(name)
            size += n
        return [Files(names) for names in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, base = self._open()
        for name in partition.names:
            try:
                with files.open_input_stream(f"{base}/{name}" if name else base, compression=None) as f:
                    content = f.read().decode("utf-8", "replace")
            except OSError as e:
                yield name, None, f"{type(e).__name__}: {str(e)[:200]}"
            else:
                yield name, content, None


class TreeSource(DataSource):
    """Options: ``path`` (the root), ``suffixes`` (comma-separated; none: all files)."""

    @classmethod
    def name(cls) -> str:
        return "linguaspark_tree"

    def schema(self) -> str:
        return "path string, content string, reason string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], [s for s in self.options.get("suffixes", "").split(",") if s])


@dataclass
class Scan:
    files: DataFrame    # path (relative to the root), content
    rejects: DataFrame  # path, reason


def can_list(root: str) -> bool:
    """Whether ``scan`` can open the root's store (else only Spark's own readers can)."""
    return _file_system(root) is not None


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ()) -> Scan:
    """All files under ``root`` whose names end in one of ``suffixes`` (none given: all), and those that cannot be read."""
    spark.dataSource.register(TreeSource)
    df = spark.read.format("linguaspark_tree").option("path", root).option("suffixes", ",".join(suffixes)).load()
    return Scan(df.where("reason is null").select("path", "content"), df.where("reason is not null").select("path", "reason"))


def write_files(files: DataFrame, root: str, order: str | None = None) -> int:
    """Writes each ``(path, content)`` row as the file ``<root>/<path>`` (content and a line end); returns how many.

    With ``order``, a column, a file is all rows of its path in that order,
    each followed by a line end. One task writes a file row by row, from a
    sort that spills, so no file is held in memory.

    Files that stand there under the same paths are replaced one by one by
    a rename, after all rows are safely written; others stay. A path that
    occurs twice is an error, found before any file is replaced.

    On a path that all tasks share, they write the files and, in a second
    job, rename them. Elsewhere Spark's writer makes a folder a file, and the
    driver renames.
    """
    spark = files.sparkSession
    new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    stage = f"{root.rstrip('/')}/{STAGE}{uuid.uuid4().hex}"
    fs = new_path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        placed = files.withColumnRenamed("path", "place")
        if order:
            placed = placed.repartition("place").sortWithinPartitions("place", order)
        put = _put_local if is_local_path(stage) else _put_remote
        return put(placed.select("place", "content"), root.rstrip("/"), stage, bool(order), fs, new_path)
    finally:
        fs.delete(new_path(stage), True)


NO_NAME = "__HIVE_DEFAULT_PARTITION__"  # what Spark's writer calls a null or empty path


def _put_local(placed: DataFrame, root: str, stage: str, pieces: bool, fs, new_path) -> int:
    spark, folder, base = placed.sparkSession, local_fs_path(stage), local_fs_path(root)
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{folder}/{uuid.uuid4().hex}"  # of this attempt of the task
        os.makedirs(own)
        last, out, n = None, None, 0
        try:
            for batch in batches:
                done = []
                for place, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or not pieces or place != last:
                        if out:
                            out.close()
                        last, n = place, n + 1
                        out = open(f"{own}/{n}", "wb")
                        done.append((place, f"{own}/{n}"))
                    out.write((content or "").encode("utf-8", "surrogatepass") + b"\n")
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["place", "staged"])
        finally:
            if out:
                out.close()

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for place, staged in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                above, name = os.path.split(f"{base}/{place}")
                if above not in made:
                    os.makedirs(above, exist_ok=True)
                    made.add(above)
                with contextlib.suppress(FileNotFoundError):  # Hadoop's checksum of an older file
                    os.remove(f"{above}/.{name}.crc")
                try:
                    os.replace(staged, f"{above}/{name}")
                except FileNotFoundError:  # an earlier attempt of this task has been here
                    if not os.path.exists(f"{above}/{name}"):
                        raise
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    (placed.mapInArrow(write, "place string, staged string")
     .withColumn("place", F.when(F.col("place") != "", F.col("place")).otherwise(NO_NAME)).write.parquet(f"{stage}/moves"))
    moves = spark.read.parquet(f"{stage}/moves")
    twice = moves.groupBy("place").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['place']} occurs more than once")
    return moves.mapInArrow(rename, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def _put_remote(placed: DataFrame, root: str, stage: str, pieces: bool, fs, new_path) -> int:
    placed.write.option("maxRecordsPerFile", 0).partitionBy("place").text(stage)
    moves = []
    for folder in _names(fs, new_path, stage):
        if not folder.startswith("place="):
            continue
        parts = [n for n in _names(fs, new_path, f"{stage}/{folder}") if not n.startswith((".", "_"))]
        place = re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), folder[len("place="):])
        if len(parts) != 1:
            raise ValueError(f"{place} occurs more than once")
        moves.append((f"{stage}/{folder}/{parts[0]}", f"{root}/{place}"))
    with ThreadPoolExecutor(16) as pool:  # renames only: no content passes here
        list(pool.map(_renamer(placed.sparkSession, fs), moves))
    return len(moves)


def _names(fs, new_path, folder: str) -> list[str]:
    return [f.getPath().getName() for f in fs.listStatus(new_path(folder))]


def _renamer(spark: SparkSession, fs):
    """A function that puts a file in the place of another, in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def place(move):
        source, target = (fs.makeQualified(jvm.org.apache.hadoop.fs.Path(p)) for p in move)
        fs.mkdirs(target.getParent())
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(source, target, over)

    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    return place
