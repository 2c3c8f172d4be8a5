"""Encoded grids: file keys, headers, run decoding, offsets, occupied cells, length checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import expressions as X

CHUNK_BYTES = 65_536
CHUNK_RUNS = CHUNK_BYTES // 2
#: Where a header is looked for first; a longer one is looked for in the whole content.
HEADER_BYTES = 4_096

FLOAT = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def file_key(name: Column) -> tuple[Column, Column]:
    """(obj_key, grid) of `<stem>.obj_<grid>.binvox`; the whole name and null where it has another form."""
    pattern = r"^(.*)\.obj_\+?(\d{1,9})\.binvox$"
    key, any_grid = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, r"_\+?(\d{1,9})\.binvox$", 1)
    return F.when(name.rlike(pattern), key).otherwise(name), F.when(any_grid != "", any_grid.cast("int"))


def named_grids(read: DataFrame) -> DataFrame:
    """Rows of headers() with obj_key and grid: by the file's name, and the first dimension where it names no grid."""
    key, grid = file_key(F.col("file_name"))
    return read.withColumns({"obj_key": key, "grid": F.coalesce(grid.cast("long"), "dx").cast("int")})


def headers(files: DataFrame) -> DataFrame:
    """(file_name, status, dx, dy, dz, translate, scale, payload_at, payload) of (file_name, content) rows; payload_at is where the payload begins.

    status is ok, bad_magic, bad_header for a line of another kind or with unreadable values, or
    missing_data, missing_dim, missing_translate, missing_scale. Of a repeated field the last counts.
    """
    # one byte a character, so that places in the text are places in the content
    data = r"(?s)^(.*?\n)[ \t\r]*data[ \t\r]*\n"
    leading = F.decode(F.substring("content", 1, HEADER_BYTES), "ISO-8859-1")
    head = F.when((F.octet_length("content") <= HEADER_BYTES) | leading.rlike(data), leading).otherwise(F.decode("content", "ISO-8859-1"))
    cut = F.regexp_extract(head, data, 0)
    lines = F.transform(F.split(F.regexp_extract(head, r"(?s)^[^\n]*\n(.*?)(?:^|(?<=\n))[ \t\r]*data[ \t\r]*\n", 1), "\n"), lambda s: F.trim(s))
    lines = F.filter(F.transform(lines, lambda s: F.regexp_replace(s, r"\r", "")), lambda s: s != "")
    last = lambda prefix: F.try_element_at(F.filter(lines, lambda s: s.startswith(prefix)), F.lit(-1))
    three = lambda s, kind: F.regexp_extract_all(s, F.lit(kind), F.lit(0))
    whole, part = r"^dim\s+\d+\s+\d+\s+\d+$", rf"^translate\s+{FLOAT}\s+{FLOAT}\s+{FLOAT}$"
    fits = F.forall(lines, lambda s: s.rlike(whole) | s.rlike(part) | s.rlike(rf"^scale\s+{FLOAT}$"))
    dims, moved = three(last("dim"), r"\d+"), three(F.substring(last("translate"), 10, 2**31 - 1), FLOAT)
    status = (
        F.when(~head.startswith("#binvox"), "bad_magic").when(cut == "", "missing_data").when(~fits, "bad_header")
        .when(last("dim").isNull(), "missing_dim").when(last("translate").isNull(), "missing_translate").when(last("scale").isNull(), "missing_scale").otherwise("ok")
    )
    tile = [c for c in files.columns if c == "tile"]
    shown = files.select(*tile, "file_name", status.alias("status"), dims.alias("d"), moved.alias("t"), F.regexp_extract(last("scale"), FLOAT, 0).alias("s"), F.length(cut).alias("at"), "content")
    ok = F.col("status") == "ok"
    number = lambda c: F.when(ok, c)
    return shown.select(
        *tile, "file_name", "status", *[number(F.try_element_at("d", F.lit(k + 1)).try_cast("bigint")).alias(n) for k, n in enumerate(("dx", "dy", "dz"))],
        number(F.transform("t", lambda x: x.cast("double"))).alias("translate"), number(F.col("s").try_cast("double")).alias("scale"),
        number(F.col("at").cast("long")).alias("payload_at"), number(F.expr("substring(content, at + 1)")).alias("payload"),
    )


def decode_runs(payloads: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(file_key, run_no, value, n) of (file_key, payload) rows; a trailing odd byte is left out.

    Payloads are cut into chunks, which are dealt out before they are expanded: a large file is as
    many rows as it has chunks. A file may come in several payloads: `first_run`, where there is such a
    column, is the number of a payload's first run, and all but the last are of even length.
    """
    size = chunk_bytes - chunk_bytes % 2
    first = F.col("first_run") if "first_run" in payloads.columns else F.lit(0)
    pieces = payloads.select("file_key", first.cast("long").alias("first_run"), "payload", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("payload") / size), F.lit(1)) - 1)).alias("chunk"))
    cut = pieces.select("file_key", (F.col("first_run") + F.col("chunk") * (size // 2)).alias("first_run"), F.expr(f"substring(payload, cast(chunk * {size} as int) + 1, {size})").alias("bytes")).where(F.length("bytes") > 1)
    dealt = cut.repartition("file_key", "first_run")
    byte = lambda at: F.conv(F.hex(F.substring("bytes", at, F.lit(1))), 16, 10).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.call_function("div", F.length("bytes"), F.lit(2)) - 1), lambda i: F.struct(byte((i * 2 + 1).cast("int")).alias("value"), byte((i * 2 + 2).cast("int")).alias("n")))
    return dealt.select("file_key", "first_run", F.posexplode(pairs).alias("i", "run")).select("file_key", (F.col("first_run") + F.col("i")).alias("run_no"), "run.value", "run.n")


def decode_runs_arrow(payloads: DataFrame) -> DataFrame:
    """The same rows by numpy in Arrow batches, for throughput."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, payload in zip(batch.column("file_key").to_pylist(), batch.column("payload"), strict=True):
                raw = np.frombuffer(payload.as_buffer() if payload.is_valid else b"", dtype=np.uint8)
                pairs = raw[: len(raw) // 2 * 2].reshape(-1, 2)
                for lo in range(0, len(pairs), 100_000):
                    part = pairs[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.string()), pa.array(np.arange(lo, lo + len(part), dtype=np.int64)), pa.array(part[:, 0].astype(np.int32)), pa.array(part[:, 1].astype(np.int32))], names=["file_key", "run_no", "value", "n"])

    return payloads.select("file_key", "payload").mapInArrow(run, "file_key string, run_no long, value int, n int")


def run_offsets(runs: DataFrame, chunk_runs: int = CHUNK_RUNS) -> DataFrame:
    """Adds `offset`, the cells before each run of its file.

    Two levels: sums of chunks get their prefix in a window of one row a chunk, runs get theirs
    inside their chunk. No window holds a whole large file.
    """
    chunked = runs.withColumn("_chunk", F.call_function("div", F.col("run_no").cast("long"), F.lit(chunk_runs)))
    sums = chunked.groupBy("file_key", "_chunk").agg(F.sum("n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file_key").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    prefix = sums.select("file_key", "_chunk", before.alias("_before"))
    inside = F.coalesce(F.sum(F.col("n").cast("long")).over(W.partitionBy("file_key", "_chunk").orderBy("run_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return chunked.withColumn("_inside", inside).join(prefix, ["file_key", "_chunk"]).withColumn("offset", (F.col("_before") + F.col("_inside")).cast("long")).drop("_chunk", "_before", "_inside")


def occupied_cells(runs: DataFrame, dy: Column, dz: Column) -> DataFrame:
    """(file_key, ix, iy, iz) of every cell in a run of nonzero value; empty runs are gone before any is expanded."""
    full = run_offsets(runs).where("value <> 0 and n > 0").withColumns({"_dy": dy, "_dz": dz})
    cells = full.select("file_key", "_dy", "_dz", "offset", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("step"))
    x, y, z = X.cell_of(F.col("offset") + F.col("step"), F.col("_dy"), F.col("_dz"))
    return cells.select("file_key", x.alias("ix"), y.alias("iy"), z.alias("iz"))


def length_check(runs: DataFrame, dx: Column, dy: Column, dz: Column) -> DataFrame:
    """(file_key, cells, expected, valid): strict decoding asks that runs fill the grid exactly."""
    return runs.groupBy("file_key").agg(F.sum(F.col("n").cast("long")).alias("cells")).withColumn("expected", X.total_cells(dx, dy, dz)).withColumn("valid", F.col("cells") == F.col("expected"))
