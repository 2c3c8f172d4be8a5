"""Tiles: inventory, ledger, resume, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import expressions as X


def discover(files: DataFrame) -> DataFrame:
    """(kind, tile, path) of relative paths: everything below a first-level folder belongs to that tile; a loose `.gml` file is its own."""
    parts = F.split("path", "/")
    folders = files.where(F.size(parts) > 1).select(F.lit("folder").alias("kind"), parts[0].alias("tile"), "path")
    loose = files.where((F.size(parts) == 1) & F.col("path").endswith(".gml")).select(F.lit("loose").alias("kind"), X.tile_name(F.col("path")).alias("tile"), "path")
    return folders.unionByName(loose)


def inventory(files: DataFrame) -> DataFrame:
    """Tiles, `.gml` files and all files of each kind."""
    return discover(files).groupBy("kind").agg(F.countDistinct("tile").alias("tiles"), F.count_if(F.col("path").endswith(".gml")).alias("gml_files"), F.count("*").alias("files"))


def empty_tiles(files: DataFrame) -> DataFrame:
    """Tiles without any `.gml` file: they are skipped, not failed."""
    return discover(files).groupBy("kind", "tile").agg(F.count_if(F.col("path").endswith(".gml")).alias("n")).where("n = 0").select("kind", "tile")


def name_clashes(files: DataFrame) -> DataFrame:
    """Names that both a folder and a loose file have."""
    return discover(files).groupBy("tile").agg(F.countDistinct("kind").alias("kinds")).where("kinds > 1").select("tile")


def normal_name(column: str = "tile"):
    """A tile's own name: without folder, leading `tile_` and `.gml`."""
    return F.regexp_replace(X.tile_name(F.substring_index(F.col(column), "/", -1)), "^tile_", "")


def latest_status(ledger: DataFrame) -> DataFrame:
    """The status of each tile's last attempt."""
    return ledger.groupBy("tile").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").cast("long").alias("attempts"))


def pending(tiles: DataFrame, finished: DataFrame) -> DataFrame:
    """Tiles without a finished twin, whichever of the name forms each side uses."""
    done = finished.select(normal_name().alias("_name")).distinct()
    return tiles.withColumn("_name", normal_name()).join(done, "_name", "left_anti").drop("_name")


def next_tiles(tiles: DataFrame, n: int = 0) -> DataFrame:
    """The first n pending tiles, folders before loose files and by name; 0 means all."""
    ordered = tiles.orderBy("kind", "tile")
    return ordered.limit(n) if n else ordered


def to_retry(ledger: DataFrame, max_attempts: int = 2) -> DataFrame:
    """Tiles whose last attempt failed and that have attempts left."""
    return latest_status(ledger).where((F.col("status") == "failed") & (F.col("attempts") < max_attempts))


def batch_summary(ledger: DataFrame, tiles: DataFrame) -> DataFrame:
    """Completed, failed, pending and all tiles."""
    known = tiles.select("tile").distinct().join(latest_status(ledger), "tile", "left")
    return known.agg(F.count_if(F.col("status") == "ok").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isNull()).alias("pending"), F.count("*").alias("total"))


def run_outcomes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("runs"))


def failed_runs(ledger: DataFrame) -> DataFrame:
    """(tile, attempts) of those whose last attempt failed."""
    return latest_status(ledger).where("status = 'failed'").select("tile", "attempts")


def require_ok(outcomes: DataFrame) -> None:
    """Raises where nothing succeeded."""
    if outcomes.where("status = 'ok' and runs > 0").isEmpty():
        raise ValueError("no run succeeded")


def require_input(rows: DataFrame, what: str) -> None:
    """Raises where there is nothing to work on."""
    if rows.isEmpty():
        raise ValueError(f"no {what} found")


def step_durations(log: DataFrame, step: str = "tile") -> DataFrame:
    """Seconds between the first and last entry of each step, and the number of entries."""
    seconds = lambda f: F.unix_micros(f(F.col("ts").cast("timestamp")))
    return log.groupBy(step).agg(((seconds(F.max) - seconds(F.min)) / 1e6).alias("seconds"), F.count("*").alias("entries"))
