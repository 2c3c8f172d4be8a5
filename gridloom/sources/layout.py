"""Voxel files laid out along a space-filling curve, with a manifest that is asked before any of them is read.

Rows are ordered by the curve through coarse cells and, inside a cell, by their coordinates, and are cut
into files of bounded size: a dense cell is as many files as it needs. The manifest has the box of each
file and which files hold each id, so a lookup reads the files that it needs and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import voxels
from gridloom.sources import shared

#: Cells an axis, 21 bits each: positions of the curve are 63 bits.
AXIS_BITS = 21
#: Shifts and masks that spread 21 bits to every third bit (fixed values of the usual doubling).
SPREAD = ((32, 0x001F00000000FFFF), (16, 0x001F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
IDS = ("gmlid", "building_gmlid", "class_gmlid", "object_type")


def spread_bits(n: Column) -> Column:
    for shift, mask in SPREAD:
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return n


def curve_position(size: float) -> Column:
    """Place of a row's cell of side `size` on the curve, which interleaves the bits of the axes' cells.

    Cells beyond 2^20 of them from the origin count as the outermost; rows without coordinates come first.
    """
    half = 1 << AXIS_BITS - 1
    cell = lambda a: F.least(F.greatest(F.coalesce(F.floor(F.nanvl(F.col(a), F.lit(None).cast("double")) / size), F.lit(-half).cast("long")) + half, F.lit(0).cast("long")), F.lit(2 * half - 1).cast("long"))
    x, y, z = (spread_bits(cell(a)) for a in "xyz")
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def write_clustered(rows: DataFrame, path: str, size: float = 8.0, rows_per_file: int = 4_000_000) -> None:
    """Writes voxel rows (x, y, z and further columns) to `path`/data and then the manifest to `path`/boxes and `path`/ids.

    Ranges are drawn by place on the curve and by coordinates, so a hot cell is split as any other; a range
    beyond `rows_per_file` rows is several files, each a stretch of the curve. The manifest is written
    last: what was cut off before has none and isn't read.
    """
    placed = rows.withColumn("_place", curve_position(size))
    order = ["_place", "x", "y", "z"]
    # a fixed number of ranges would make each larger as the input grows
    placed.repartitionByRange(shared.tasks_for(rows), *order).sortWithinPartitions(*order).drop("_place").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/data")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/data").withColumn("file", F.col("_metadata.file_name"))
    ids = [c for c in IDS if c in rows.columns]
    if ids:
        pairs = written.select("file", F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in ids])))
        held = pairs.groupBy("kind", "value", "file").agg(F.count("*").alias("rows"))
        held.repartitionByRange("kind", "value").sortWithinPartitions("kind", "value").write.mode("overwrite").parquet(f"{path}/ids")
    sides = [f(a).alias(f"{a}{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    written.groupBy("file").agg(F.count("*").alias("rows"), *sides).coalesce(1).write.mode("overwrite").parquet(f"{path}/boxes")


def read_files(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """Rows of the named files: their names come to the driver, as many as the lookup needs."""
    names = sorted(r["file"] for r in found.select("file").distinct().toLocalIterator())
    whole = spark.read.parquet(f"{path}/data")
    return spark.read.schema(whole.schema).parquet(*[f"{path}/data/{n}" for n in names]) if names else whole.limit(0)


def read_box(spark: SparkSession, path: str, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Rows whose point lies in the closed box, from the files whose boxes meet it."""
    meets = F.lit(True)
    for a, lo, hi in zip("xyz", low, high, strict=True):
        meets = meets & (F.col(f"{a}min") <= hi) & (F.col(f"{a}max") >= lo)
    return voxels.in_box(read_files(spark, path, spark.read.parquet(f"{path}/boxes").where(meets)), low, high)


def read_id(spark: SparkSession, path: str, column: str, value: str) -> DataFrame:
    """Rows of one gmlid, building, class or object type, from the files that hold it."""
    found = spark.read.parquet(f"{path}/ids").where((F.col("kind") == column) & (F.col("value") == value))
    return voxels.by_id(read_files(spark, path, found), column, value)


def count_in_box(spark: SparkSession, path: str, low: tuple[float, float, float], high: tuple[float, float, float]) -> int:
    """Rows in the closed box: files that lie inside are counted by the manifest alone, only those on its border are read."""
    boxes = spark.read.parquet(f"{path}/boxes")
    inside, meets = F.lit(True), F.lit(True)
    for a, lo, hi in zip("xyz", low, high, strict=True):
        inside = inside & (F.col(f"{a}min") >= lo) & (F.col(f"{a}max") <= hi)
        meets = meets & (F.col(f"{a}min") <= hi) & (F.col(f"{a}max") >= lo)
    whole = boxes.where(inside).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    return whole + voxels.in_box(read_files(spark, path, boxes.where(meets & ~inside)), low, high).count()
