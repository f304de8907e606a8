"""Files under names of their own: a data source that writes lines to the files they name, and reads them.

Spark's own writers name files themselves. Here each row is (file, line); a task writes its files beside
the target under unique names, and the driver moves them to their names when all tasks are done, so that a
lost or repeated task leaves nothing behind. Reading, a task takes many files, since small ones are as many as
runs and each costs a scan of Spark's more than its lines do. Only names pass through the driver.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_STAGING = "_temporary"
#: What a task reads at most (a larger file is a task), and the rows of a batch.
_FILES, _BYTES, _ROWS = 1_000, 32 << 20, 10_000


@dataclass
class Staged(WriterCommitMessage):
    """(file, its name while it is written) of one task."""

    files: list[tuple[str, str]]


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.header, self.job = options["path"], options.get("header"), uuid.uuid4().hex

    def _root(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """Rows come with each file's lines together and in order."""
        system, root = self._root()
        system.create_dir(f"{root}/{_STAGING}/{self.job}", recursive=True)
        staged, current, out = [], None, None
        for batch in iterator:
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != current:
                    if out is not None:
                        out.close()
                    current, where = name, f"{_STAGING}/{self.job}/{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{root}/{where}", compression=None, buffer_size=1 << 18)
                    staged.append((name, where))
                    if self.header:
                        out.write(self.header.encode() + b"\n")
                out.write(line.encode() + b"\n")
        if out is not None:
            out.close()
        return Staged(staged)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = self._root()
        files = [f for m in messages if m for f in m.files]
        if len({name for name, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("lines of one file are in several partitions")
        for folder in {posixpath.dirname(f"{root}/{name}") for name, _ in files}:
            system.create_dir(folder, recursive=True)

        def place(staged: tuple[str, str]) -> None:
            target = f"{root}/{staged[0]}"
            if system.get_file_info(target).type != fs.FileType.NotFound:
                system.delete_file(target)
            system.move(f"{root}/{staged[1]}", target)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(place, files))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = self._root()
        if system.get_file_info(f"{root}/{_STAGING}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{_STAGING}/{self.job}")


@dataclass
class Some(InputPartition):
    """The files of one task."""

    files: list[str]


class NamedFilesReader(DataSourceReader):
    """Rows (file, line) of the files whose names end with the option `ending`, without their first line
    if `header` is true; with `whole` a file's text is one row. Hidden names are left out, as Spark's sources do."""

    def __init__(self, options: dict):
        self.path, self.ending = options["path"], options.get("ending", "")
        self.header, self.whole = (str(options.get(k)).lower() == "true" for k in ("header", "whole"))

    def partitions(self) -> list[Some]:
        system, root = fs.FileSystem.from_uri(self.path)
        hidden = lambda path: any(part[0] in "._" for part in path[len(root) :].split("/") if part)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        out, held = [Some([])], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(self.ending) and not hidden(f.path)), key=lambda f: f.path):
            if out[-1].files and (len(out[-1].files) >= _FILES or held + f.size > _BYTES):
                out.append(Some([]))
                held = 0
            out[-1].files.append(f.path)
            held += f.size
        return out

    def _lines(self, partition: Some) -> Iterator[tuple[str, str]]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.files:
            with io.TextIOWrapper(system.open_input_stream(path, compression=None), encoding="utf-8") as text:
                if self.whole:
                    yield path, text.read()
                    continue
                for i, line in enumerate(text):
                    if i or not self.header:
                        yield path, line.removesuffix("\n")

    def read(self, partition: Some) -> Iterator[pa.RecordBatch]:
        lines = self._lines(partition)
        while some := list(islice(lines, _ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], ["file", "line"])


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, line string"

    def reader(self, schema: StructType) -> NamedFilesReader:
        return NamedFilesReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options)


def write_lines(df: DataFrame, path: str, file: Column, line: Column, order: tuple[str, ...] = (), header: str | None = None) -> None:
    """Each row as a line of the file it names, in the given order, under an optional first line. Files of
    the same name are replaced, others stay; rows without a name are left out. A file is one task's work."""
    df.sparkSession.dataSource.register(NamedFiles)
    named = df.withColumns({"_file": file, "_line": F.coalesce(line, F.lit(""))}).filter("_file is not null")
    # One shuffle by file; the sort makes each file's lines adjacent.
    rows = named.select("_file", "_line", *order).repartition("_file").sortWithinPartitions("_file", *order)
    out = rows.select(F.col("_file").alias("file"), F.col("_line").alias("line")).write.format("named_files").mode("append")
    (out.option("header", header) if header is not None else out).save(path)


def write_csv_files(df: DataFrame, path: str, file: Column, order: tuple[str, ...], tabs: bool = False) -> None:
    """Tables with a header row, one for each name."""
    sep = "\t" if tabs else ","
    write_lines(df, path, file, F.to_csv(F.struct(*df.columns), {"sep": sep}), order, sep.join(df.columns))


def write_json_files(df: DataFrame, path: str, file: Column) -> None:
    """One object for each name (a row each); missing values are null."""
    write_lines(df, path, file, F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"}))


def read_lines(spark: SparkSession, path: str, ending: str, header: bool = False, whole: bool = False) -> DataFrame:
    """(file, line) of the files whose names end so; see NamedFilesReader."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").option("ending", ending).option("header", header).option("whole", whole).load(path)
