"""CSV corpora inside zip archives, which Spark's readers do not open.

``read_zip_csv`` is a Python data source: every entry of every archive is a partition, inflated as a stream and parsed
row by row into Arrow batches, so an entry needs the memory of a batch, whatever its size. Quoted fields may hold line
breaks, commas and doubled quotes; the header names the columns, in any order; columns the schema does not name are passed
over; an empty field is null; a value that does not fit its type fails the job. Archives lie in a folder that driver and
executors both see as files (Python opens them); one entry is one task, so a large corpus should have several.

``write_zip_csv`` writes one archive a partition, with one entry each.
"""

from __future__ import annotations

import csv
import fnmatch
import glob
import io
import itertools
import os
import sys
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from threadtox.session import ship_package

BATCH_ROWS = 4096


def local_path(path: str) -> str:
    """The path as Python opens it; paths of stores that are no file system are refused."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"archives must lie in a folder that is mounted as files, not in {parts.scheme}:")
    return unquote(parts.path) if parts.scheme else path


class Entry(InputPartition):
    def __init__(self, archive: str, name: str):
        super().__init__((archive, name))
        self.archive, self.name = archive, name


class ZipCsvReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.pattern = schema, options["path"], options.get("entries", "*.csv")

    def partitions(self) -> list[Entry]:
        path = local_path(self.path)
        archives = sorted(glob.glob(f"{glob.escape(path)}/*.zip")) if os.path.isdir(path) else sorted(glob.glob(path))
        if not archives and not os.path.isdir(path):
            raise FileNotFoundError(path)
        found = []
        for a in archives:
            with zipfile.ZipFile(a) as z:
                found += [Entry(a, i.filename) for i in z.infolist() if not i.is_dir() and fnmatch.fnmatch(i.filename, self.pattern)]
        return found or [Entry("", "")]

    def read(self, partition: Entry) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        csv.field_size_limit(sys.maxsize)
        target = to_arrow_schema(self.schema)
        with zipfile.ZipFile(partition.archive) as z, z.open(partition.name) as raw:
            rows = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline=""), strict=True)
            header = next(rows, None)
            if header is None:
                return
            places = [header.index(name) for name in target.names]  # a column that is missing fails the job
            while part := list(itertools.islice(rows, BATCH_ROWS)):
                for r in part:
                    if len(r) != len(header):
                        raise ValueError(f"{partition.name}: {len(r)} fields in a row of {len(header)}")
                columns = [pa.array([r[p] or None for r in part], pa.string()).cast(f.type) for p, f in zip(places, target, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)


class ZipCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipcsv"

    def reader(self, schema: StructType) -> ZipCsvReader:
        return ZipCsvReader(schema, self.options)


def read_zip_csv(spark: SparkSession, path: str, schema: str | StructType, entries: str = "*.csv") -> DataFrame:
    """The rows of all entries whose name matches ``entries``, of one archive, of a pattern, or of a folder's archives."""
    ship_package(spark)
    spark.dataSource.register(ZipCsv)
    return spark.read.format("zipcsv").schema(schema).option("entries", entries).load(path)


def write_zip_csv(df: DataFrame, folder: str) -> int:
    """Writes ``df`` as CSV into one archive a partition; returns the rows written. A task that is run again leaves one
    archive: it writes under another name and renames at the end."""
    target, names = local_path(folder), df.columns
    os.makedirs(target, exist_ok=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, n = TaskContext.get().partitionId(), 0
        temporary = f"{target}/.part-{number:05d}-{uuid.uuid4().hex}"
        with zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"part-{number:05d}.csv", "w", force_zip64=True) as raw, \
                io.TextIOWrapper(raw, encoding="utf-8", newline="") as text:
            out = csv.writer(text, quoting=csv.QUOTE_ALL, lineterminator="\n")
            out.writerow(names)
            for b in batches:
                out.writerows(zip(*(["" if x is None else x for x in c.to_pylist()] for c in b.columns), strict=True))
                n += b.num_rows
        os.replace(temporary, f"{target}/part-{number:05d}.zip")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    ship_package(df.sparkSession)
    return df.mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
