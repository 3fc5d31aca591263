"""Digests of files of any size and number: a data source whose tasks hash sets of files of about equal bytes, and a writer of small files."""

from __future__ import annotations

import fnmatch
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at once; what a task holds, whatever the size of a file.
CHUNK = 8 << 20
#: Folders a task that the driver opens levels for, folders of a writing task, and rows of a batch of digests.
SPREAD, FOLDERS, ROWS = 4, 16, 1000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else "file://" + path)


class FileSet(InputPartition):
    """Files, and folders that the task lists itself."""

    def __init__(self, paths: list[str], folders: list[str]) -> None:
        self.paths, self.folders = paths, folders


def balanced(sizes: list[tuple[int, str]], parts: int) -> list[list[str]]:
    """Files dealt to ``parts`` sets, largest first, each to the set with the fewest bytes so far; empty sets are left out."""
    heap = [(0, i) for i in range(max(parts, 1))]
    sets: list[list[str]] = [[] for _ in heap]
    for size, path in sorted(sizes, key=lambda f: (-f[0], f[1])):
        held, i = heapq.heappop(heap)
        sets[i].append(path)
        # A file costs something even if it is empty.
        heapq.heappush(heap, (held + size + 4096, i))
    return [s for s in sets if s]


class DigestReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern, self.parts = options["path"], options.get("pattern", "*"), int(options.get("parts", "8"))

    def _wanted(self, file: fs.FileInfo) -> bool:
        # Hidden files and markers of writers are no data.
        return file.type == fs.FileType.File and not file.base_name.startswith(("_", ".")) and fnmatch.fnmatch(file.base_name, self.pattern)

    def partitions(self) -> list[FileSet]:
        """Levels are opened here, names and sizes only, until there are folders enough for all tasks; tasks list the rest."""
        system, root = opened(self.path)
        files, folders = [], [root]
        while folders and len(folders) < SPREAD * self.parts:
            found = [f for folder in folders for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
            files += [(f.size, f.path) for f in found if self._wanted(f)]
            folders = [f.path for f in found if f.type == fs.FileType.Directory]
        sets, trees = balanced(files, self.parts), balanced([(0, f) for f in folders], self.parts)
        more = max(len(sets), len(trees))
        return [FileSet(s, d) for s, d in zip(sets + [[]] * (more - len(sets)), trees + [[]] * (more - len(trees)))]

    def read(self, partition: FileSet | None) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)

        def paths() -> Iterator[str]:
            yield from partition.paths
            for folder in partition.folders:
                yield from (f.path for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if self._wanted(f))

        def sent(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))],
                                              names=["path", "length", "sha256"])

        made = []
        for path in paths() if partition else ():
            digest, length = hashlib.sha256(), 0
            with system.open_input_stream(path) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
                    length += len(chunk)
            made.append((path, length, digest.hexdigest()))
            if len(made) == ROWS:
                yield sent(made)
                made = []
        if made:
            yield sent(made)


class FileDigests(DataSource):
    """(path, length, sha256) of every file below ``path``; options pattern (of names) and parts (tasks)."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, length long, sha256 string"

    def reader(self, schema: object) -> DigestReader:
        return DigestReader(dict(self.options))


def file_digests(spark: SparkSession, path: str, pattern: str = "*", parts: int | None = None) -> DataFrame:
    """Digests of the files below a folder; a folder that is not there has none.

    One file is hashed by one task, since SHA-256 runs from front to back, in constant memory.
    """
    spark.dataSource.register(FileDigests)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return spark.read.format("file_digests").option("pattern", pattern).option("parts", str(parts)).load(path)


def write_files(rows: DataFrame, folder: str) -> None:
    """A file ``id=<id>`` of each row (id, content), written where the row lies; rows of one id in one task share a file.

    Spark's own writer renames every file of a partition on the driver, one after another,
    which no number of tasks shortens.  Here a task writes straight into folders that carry its
    number, so a second attempt writes over what the first one left.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        at = f"{root}/{TaskContext.get().partitionId():05d}"
        last, stream, n = None, None, 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if stream is None or name != last:
                    if stream is not None:
                        stream.close()
                    elif not n:
                        for i in range(FOLDERS):
                            system.create_dir(f"{at}/{i:02d}")
                    last, n = name, n + 1
                    stream = system.open_output_stream(f"{at}/{zlib.crc32(str(name).encode()) % FOLDERS:02d}/id={name}")
                stream.write(content.as_buffer())
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    rows.select("id", F.col("content").cast("binary")).sortWithinPartitions("id").mapInArrow(run, "files long").agg(F.sum("files")).collect()
