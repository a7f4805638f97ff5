"""A pluggable batch source for observation files: ``spark.read.format("observations").load()``.

Options: ``path`` (files or folders of lines date,value; '.' is missing; several are separated by commas), ``series`` (a name),
``start`` and ``end`` (ISO dates). Paths may be URIs of any file system that Arrow opens (``file:``, ``hdfs:``, ``s3:``, ``gs:``), listed
by the driver and read where the partitions run. A file's series is the option's, else its folder's ``series=`` part, else
its name. Lines that do not begin with a date are skipped.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class ObservationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "observations"

    def schema(self) -> str:
        return "series string, d date, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ObservationReader(dict(self.options))


def _opened(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


class ObservationReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options.get("path", "").split(",") if p]
        if not self.paths:
            raise ValueError("the observations source needs a path")
        self.series = options.get("series")
        self.start = dt.date.fromisoformat(options.get("start", "0001-01-01"))
        self.end = dt.date.fromisoformat(options.get("end", "9999-12-31"))

    def partitions(self) -> list[InputPartition]:
        """One for each file; hidden files and markers are no data."""
        from pyarrow import fs

        found = []
        for path in self.paths:
            store, at = _opened(path)
            if store.get_file_info(at).type == fs.FileType.Directory:
                files = [f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
                found += [InputPartition((path, f)) for f in sorted(files)]
            else:
                found.append(InputPartition((path, at)))
        return found

    def read(self, partition: InputPartition):
        root, path = partition.value
        folder = re.search(r"series=([^/]+)", path)
        name = self.series or (folder[1] if folder else path.rsplit("/", 1)[-1].removesuffix(".csv"))
        store, _ = _opened(root)
        with store.open_input_stream(path) as raw:
            for row in csv.reader(io.TextIOWrapper(raw, encoding="utf-8", newline="")):
                try:
                    d = dt.date.fromisoformat(row[0])
                except (ValueError, IndexError):
                    continue
                if self.start <= d <= self.end:
                    try:
                        yield name, d, float(row[1])
                    except (ValueError, IndexError):
                        yield name, d, None


def register(spark) -> None:
    spark.dataSource.register(ObservationSource)
