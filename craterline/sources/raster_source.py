"""A data source for headerless image files: ``spark.read.format("raster_lines")`` and back.

A file holds lines of equal length, band varying fastest. The reader plans partitions by ranges of lines, opens the
file in the task and yields Arrow batches (line, dns); a file of any size is many partitions. The writer puts every
stretch of following lines into a strip, a file named by its first line, so no task holds an image; the reader
takes a folder of strips like one file. Paths are those of pyarrow's file systems (a local or mounted path, or a URI).

Options: ``data_type`` (names of ``constants.RASTER_TYPES``; unknown ones are unsigned bytes), ``samples``, ``bands`` (1) and
``partition_bytes`` (16 MB). Trailing bytes that make no whole line are not read. A value that does not fit the
type of the file is an error when written; null is NaN in floating types and 0 in others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from craterline.constants import RASTER_TYPES

STRIP = re.compile(r"strip-(\d+)$")
#: Bytes of a batch.
CHUNK = 1 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class Layout:
    kind: np.dtype
    width: int

    def __init__(self, options):
        self.kind = np.dtype(RASTER_TYPES.get(options.get("data_type", "uint8").lower(), "u1"))
        self.width = int(options["samples"]) * int(options.get("bands", 1))

    @property
    def length(self) -> int:
        """Bytes of a line."""
        return self.width * self.kind.itemsize


@dataclass
class Lines(InputPartition):
    path: str
    first: int
    start: int
    stop: int


class RasterReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.layout = options["path"], Layout(options)
        self.step = max(1, int(options.get("partition_bytes", 16 << 20)) // self.layout.length)

    def partitions(self):
        system, path = located(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.Directory:
            files = [(int(m[1]), i) for i in system.get_file_info(fs.FileSelector(path)) if (m := STRIP.search(i.path))]
        else:
            files = [(0, info)]
        found = [Lines(i.path, first, at, min(at + self.step, n)) for first, i in sorted(files, key=lambda f: f[0])
                 for n in [i.size // self.layout.length] for at in range(0, n, self.step)]
        return found or [Lines(path, 0, 0, 0)]

    def read(self, partition):
        system, _ = located(self.path)
        rows = max(1, CHUNK // self.layout.length)
        if partition.stop <= partition.start:
            return
        with system.open_input_file(partition.path) as file:
            for at in range(partition.start, partition.stop, rows):
                stop = min(at + rows, partition.stop)
                values = np.frombuffer(file.read_at((stop - at) * self.layout.length, at * self.layout.length), self.layout.kind).astype(np.float64)
                ends = pa.array(np.arange(0, len(values) + 1, self.layout.width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, stop) + partition.first), pa.ListArray.from_arrays(ends, pa.array(values))], names=["line", "dns"])


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.layout = options["path"], Layout(options)

    def write(self, iterator):
        system, path = located(self.path)
        system.create_dir(path, recursive=True)
        out, after = None, None
        try:
            for batch in iterator:
                if not len(batch):
                    continue
                line = batch.column(batch.schema.get_field_index("line")).to_numpy()
                dns = batch.column(batch.schema.get_field_index("dns"))
                values = dns.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if len(values) != len(batch) * self.layout.width:
                    raise ValueError(f"every line must have {self.layout.width} values")
                if self.layout.kind.kind != "f":
                    values = np.nan_to_num(values, nan=0.0)
                    limits = np.iinfo(self.layout.kind)
                    if len(values) and (values.min() < limits.min or values.max() > limits.max):
                        raise ValueError(f"a value does not fit {self.layout.kind}")
                data = values.reshape(len(batch), -1).astype(self.layout.kind)
                for k in range(len(batch)):
                    if out is None or line[k] != after:  # a gap begins a strip
                        if out is not None:
                            out.close()
                        out = system.open_output_stream(f"{path}/strip-{int(line[k]):012d}")
                    out.write(data[k].tobytes())
                    after = line[k] + 1
        finally:
            if out is not None:
                out.close()
        return WriterCommitMessage()


class RasterLines(DataSource):
    @classmethod
    def name(cls):
        return "raster_lines"

    def schema(self):
        return "line long, dns array<double>"

    def reader(self, schema):
        return RasterReader(self.options)

    def writer(self, schema, overwrite):
        return RasterWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make ``raster_lines`` known to the session."""
    spark.dataSource.register(RasterLines)
