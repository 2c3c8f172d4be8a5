"""Encoded grids in byte ranges: files of any size, of which no task holds more than a range.

Spark's whole-file reader ends at 2 GB a file. Here Spark lists the files, their headers are read from their
leading bytes alone, and the rest is dealt out as ranges, each read by the task that has its row. Tasks open files
by themselves: local and shared folders, and stores that pyarrow has a file system for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import grids
from gridloom.sources import shared
from gridloom.sources.files import base_name, listed

RANGE_BYTES = 8 << 20
#: Files whose headers one task reads.
TASK_FILES = 1_000
#: Leading bytes in which a header is looked for, in turn; one that is longer than the last counts as having no data line.
HEADER_BYTES = (grids.HEADER_BYTES, 1 << 20, 64 << 20)


def read_range(path: str, start: int, size: int) -> bytes:
    if path.startswith("file:") or path.startswith("/"):
        with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as f:
            f.seek(start)
            return f.read(size)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return f.read_at(size, start)


def with_bytes(ranges: DataFrame) -> DataFrame:
    """Rows with path, start and size, and `bytes`: that part of the file, shorter where the file ends."""
    names = [c for c in ranges.columns if c != "bytes"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = list(zip(*[batch.column(c).to_pylist() for c in ("path", "start", "size")], strict=True))
            lo = 0
            while lo < len(wanted):  # small ranges come together, but no more than a large one is in memory
                held, hi = wanted[lo][2], lo + 1
                while hi < len(wanted) and held + wanted[hi][2] <= RANGE_BYTES:
                    held, hi = held + wanted[hi][2], hi + 1
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([read_range(*at) for at in wanted[lo:hi]], pa.binary())], names=[*names, "bytes"])
                lo = hi

    return ranges.select(*names).mapInArrow(read, ", ".join([*[f"`{c}` {t}" for c, t in ranges.select(*names).dtypes], "bytes binary"]))


def list_files(spark: SparkSession, folder: str, glob: str = "*.binvox", tiles: bool = False) -> DataFrame:
    """(path, length), with tile where each folder inside is one; contents are not read."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", tiles).load(folder).select("path", "length")
    return listed(read, F.col("path"), folder, tiles)


def headers_of_files(files: DataFrame) -> DataFrame:
    """All columns of `files` (path, length, perhaps tile) with file_name and those of grids.headers() but the payload: a header is read from its file's leading bytes alone.

    The list and what is found are written to the shared folder, so that a folder is listed and a header read
    once, however often they are asked for; longer headers are looked for only where there are such files.
    """
    known, left = None, shared.stage(files, "listed")
    for k, size in enumerate(HEADER_BYTES):
        tasks = max(left.sparkSession.sparkContext.defaultParallelism, -(-left.count() // TASK_FILES))
        parts = with_bytes(left.repartition(tasks, "path").withColumns({"start": F.lit(0).cast("long"), "size": F.least(F.lit(size).cast("long"), "length")}))
        # the path stands for the name, so that equal names of two folders stay apart
        read = grids.headers(parts.select(F.col("path").alias("file_name"), F.col("bytes").alias("content"))).drop("payload").withColumnRenamed("file_name", "path")
        found = shared.stage(left.join(read, "path"), "headers")
        if k + 1 < len(HEADER_BYTES):
            longer = (F.col("status") == "missing_data") & (F.col("length") > size)
            left, found = found.where(longer).select(*files.columns), found.where(~longer)
        known = found if known is None else known.unionByName(found)
        if left.isEmpty():
            break
    return known.withColumn("file_name", base_name(F.col("path")))


def grid_ranges(headed: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, first_run, payload): the payloads of headers_of_files() in ranges, dealt out by range and read there.

    A range is cut to an even length, so that it begins with a whole run. A file without payload has no range.
    """
    size = max(2, range_bytes - range_bytes % 2)
    rest = F.col("length") - F.col("payload_at")
    own = headed.where((F.col("status") == "ok") & (rest > 0)).select("path", "length", "payload_at", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(rest / size) - 1)).alias("k"))
    start = F.col("payload_at") + F.col("k") * size
    cut = own.select("path", start.alias("start"), F.least(F.lit(size).cast("long"), F.col("length") - start).alias("size"), (F.col("k") * (size // 2)).alias("first_run"))
    return with_bytes(cut.repartition("path", "start")).select("path", "first_run", F.col("bytes").alias("payload"))


def scan_grid_ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, tiles: bool = False) -> tuple[DataFrame, DataFrame]:
    """The headers and the payload ranges of all encoded grids in a folder."""
    headed = headers_of_files(list_files(spark, folder, tiles=tiles))
    return headed, grid_ranges(headed, range_bytes)
