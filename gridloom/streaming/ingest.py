"""Incremental ingest: new tiles in micro-batches, a ledger of attempts, live counts.

The file source tells which files have arrived, once each. They are noted by micro-batch before any
work, so that a tile can be read again from its noted files: tiles that failed are taken up from the
ledger on the next call, beside the stream, and files that come to a finished tile are reported.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gridloom import schemas
from gridloom.operators import tiles
from gridloom.sources.keyed import KeyedTable

#: Columns of standing counts, by their key.
COUNTS = "count_key string, tile string, obj_key string, voxels long"
#: Characters of an error's text that the ledger keeps.
ERROR_LENGTH = 500


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All attempts so far, with the error of each that failed and the batch that it belongs to; empty before the first."""
    return read_or_empty(spark, path, schemas.TILE_STATUS)


def noted_files(spark: SparkSession, path: str) -> DataFrame:
    """All files that have arrived: tile, path, whether the tile was finished before, and the batch."""
    return read_or_empty(spark, f"{path}_files", schemas.TILE_FILES)


def late_files(spark: SparkSession, path: str) -> DataFrame:
    """(tile, path) of files that came to a finished tile and aren't in its output."""
    return noted_files(spark, path).groupBy("tile", "path").agg(F.min("late").alias("late")).where("late").select("tile", "path")


def record(spark: SparkSession, path: str, outcomes: list[tuple[str, int, str, str | None]], batch: str | None = None) -> None:
    """Appends (tile, attempt, status, error) rows with the present time."""
    rows = spark.createDataFrame(outcomes, "tile string, attempt int, status string, error string").withColumns({"ts": F.current_timestamp(), "batch": F.lit(batch).cast("string")})
    rows.select(*[c.split()[0] for c in schemas.TILE_STATUS.split(", ")]).coalesce(1).write.mode("append").parquet(path)


def isolated(names: list[str], run: Callable[[list[str]], None], settle: Callable[[list[str], str | None], None]) -> None:
    """Runs all names together; where that fails, each half by itself, down to the names that fail alone.

    `settle(names, error)` is told of each group that ran and each name that failed. With f failing
    names among n there are about 2 f log n runs, whatever n.
    """
    if not names:
        return
    try:
        run(names)
    except Exception as e:  # noqa: BLE001  any failure of a tile is an entry in the ledger, and the others go on
        if len(names) == 1:
            settle(names, f"{type(e).__name__}: {e}"[:ERROR_LENGTH])
        else:
            middle = len(names) // 2
            isolated(names[:middle], run, settle)
            isolated(names[middle:], run, settle)
    else:
        settle(names, None)


def work_on(
    spark: SparkSession,
    names: list[str],
    rows_of: Callable[[list[str]], DataFrame],
    ledger_path: str,
    work: Callable[[DataFrame, str], None],
    max_attempts: int = 2,
    together: Callable[[DataFrame], None] | None = None,
    batch: str | None = None,
) -> dict[str, str]:
    """Works on the named tiles, again on those that fail, up to `max_attempts` times each; returns each one's status.

    `together(rows of some tiles)`, where given, does many tiles in one job; it has to replace what an
    earlier try wrote (as `save_tile_outputs` does). Without it `work(rows of a tile, tile)` is called
    tile by tile. Attempts are numbered on from those in the ledger, and each entry is written as soon as
    its job has ended, so that an interrupted run repeats no finished tile. Names come to the driver, rows never do.
    """
    before = tiles.latest_status(ledger(spark, ledger_path)).where(F.col("tile").isin(names)).select("tile", "attempts")
    tries = dict.fromkeys(names, 0) | {r["tile"]: r["attempts"] for r in before.collect()}
    status: dict[str, str] = {}

    def settle(done: list[str], error: str | None) -> None:
        for tile in done:
            tries[tile] += 1
            status[tile] = "failed" if error else "ok"
        record(spark, ledger_path, [(tile, tries[tile], status[tile], error) for tile in done], batch)

    left = list(names)
    for _ in range(max_attempts):
        if together is not None:
            isolated(left, lambda some: together(rows_of(some)), settle)
        else:
            for tile in left:
                isolated([tile], lambda some: work(rows_of(some), some[0]), settle)
        left = [tile for tile in left if status[tile] == "failed"]
    return status


def unfinished(spark: SparkSession, names: DataFrame, ledger_path: str) -> list[str]:
    """Names of tiles without a success in the ledger, whichever name form they come by, in order."""
    done = tiles.latest_status(ledger(spark, ledger_path)).where("status = 'ok'")
    pending = tiles.pending(names.select("tile").distinct().withColumn("kind", F.lit("folder")), done)
    return [row["tile"] for row in tiles.next_tiles(pending).toLocalIterator()]


def process(
    spark: SparkSession,
    arrivals: DataFrame,
    ledger_path: str,
    work: Callable[[DataFrame, str], None],
    max_attempts: int = 2,
    together: Callable[[DataFrame], None] | None = None,
) -> dict[str, str]:
    """work_on() for the unfinished tiles among the given rows (with a column tile)."""
    names = unfinished(spark, arrivals, ledger_path)
    return work_on(spark, names, lambda some: arrivals.where(F.col("tile").isin(some)), ledger_path, work, max_attempts, together)


def note_files(spark: SparkSession, arrivals: DataFrame, ledger_path: str, batch: str, reopen: bool = False) -> DataFrame:
    """Writes the files (tile, path) of one micro-batch and returns them as written; a batch that runs again replaces its note.

    A file is late if its tile was finished by another batch, unless finished tiles are to be opened again.
    """
    done = tiles.latest_status(ledger(spark, ledger_path).where(F.coalesce(F.col("batch") != batch, F.lit(True)))).where("status = 'ok'")
    names = done.select(tiles.normal_name().alias("_name"), F.lit(not reopen).alias("_done")).distinct()
    files = arrivals.select("tile", "path").distinct().withColumn("_name", tiles.normal_name()).join(names, "_name", "left")
    target = f"{ledger_path}_files/batch={batch}"
    files.select("tile", "path", F.coalesce("_done", F.lit(False)).alias("late")).write.mode("overwrite").parquet(target)
    return spark.read.schema("tile string, path string, late boolean").parquet(target)


def noted_rows(spark: SparkSession, source: str, schema: str, ledger_path: str, names: Iterable[str]) -> DataFrame:
    """Rows of all noted files of the named tiles: their paths come to the driver, as many as these tiles have files."""
    files = noted_files(spark, ledger_path).where(F.col("tile").isin(list(names))).select("path").distinct()
    paths = sorted(r["path"] for r in files.toLocalIterator())
    return spark.read.schema(f"{schema}, tile string").option("basePath", source).parquet(*paths)


def retry_failed(
    spark: SparkSession,
    source: str,
    schema: str,
    ledger_path: str,
    work: Callable[[DataFrame, str], None],
    max_attempts: int = 2,
    together: Callable[[DataFrame], None] | None = None,
    give_up: int = 10,
) -> dict[str, str]:
    """Takes up tiles whose last attempt failed from their noted files; those with `give_up` attempts are left alone."""
    noted = noted_files(spark, ledger_path).select("tile").distinct()
    names = [r["tile"] for r in tiles.to_retry(ledger(spark, ledger_path), give_up).join(noted, "tile", "left_semi").orderBy("tile").toLocalIterator()]
    rows_of = lambda some: noted_rows(spark, source, schema, ledger_path, some)
    return work_on(spark, names, rows_of, ledger_path, work, max_attempts, together, f"retry-{uuid.uuid4().hex}")


def ingest_tiles(
    spark: SparkSession,
    source: str,
    schema: str,
    ledger_path: str,
    checkpoint: str,
    work: Callable[[DataFrame, str], None],
    max_attempts: int = 2,
    together: Callable[[DataFrame], None] | None = None,
    give_up: int = 10,
    reopen: bool = False,
    max_files: int | None = None,
) -> StreamingQuery:
    """Takes up tiles that failed before and all files that arrived under `source/tile=.../` since the last call, then ends.

    `work`, `max_attempts` and `together` are those of `work_on`, which gets all noted files of a tile, also
    those of earlier batches. Files of a finished tile are noted as late (`late_files`) and left out, or
    with `reopen` the tile is worked on again with them. A micro-batch that is repeated after a crash
    goes on with the tiles that it had not finished. At most `max_files` files are one micro-batch.
    """
    retry_failed(spark, source, schema, ledger_path, work, max_attempts, together, give_up)
    stream = spark.readStream.schema(f"{schema}, tile string")
    stream = (stream.option("maxFilesPerTrigger", max_files) if max_files else stream).parquet(source)

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        name = f"stream-{number}"
        noted = note_files(own, rows, ledger_path, name, reopen).where("not late").select("tile").distinct()
        if reopen:
            done = ledger(own, ledger_path).where((F.col("batch") == name) & (F.col("status") == "ok")).select("tile")
            names = [r["tile"] for r in noted.join(done, "tile", "left_anti").orderBy("tile").toLocalIterator()]
        else:
            names = unfinished(own, noted, ledger_path)
        work_on(own, names, lambda some: noted_rows(own, source, schema, ledger_path, some), ledger_path, work, max_attempts, together, name)

    files = stream.select("tile", F.col("_metadata.file_path").alias("path"))
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing_counts(spark: SparkSession, source: str, schema: str, counts: KeyedTable, checkpoint: str, max_files: int | None = None) -> StreamingQuery:
    """Takes up all files that arrived under `source/tile=.../` since the last call and brings voxels a tile and object up to date, then ends.

    The counts so far are keyed state of the stream, kept in its checkpoint, so a run reads new files only,
    also after a restart. Each micro-batch upserts the counts that it changed; a batch that is repeated after a
    crash writes the same numbers again. `counts` has the key count_key, tile, obj_key and voxels (COUNTS).
    """
    stream = spark.readStream.schema(f"{schema}, tile string")
    rows = (stream.option("maxFilesPerTrigger", max_files) if max_files else stream).parquet(source)
    counted = rows.groupBy("tile", "obj_key").agg(F.count("*").alias("voxels"))

    def batch(changed: DataFrame, _: int) -> None:
        counts.upsert(changed.withColumn("count_key", F.to_json(F.struct("tile", "obj_key"))))
        counts.compact()

    return counted.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observed(rows: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """The rows, and counts of them that fill in while they are written."""
    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("voxels"), F.approx_count_distinct("obj_key").alias("objects")), seen


class Progress(StreamingQueryListener):
    """Rows and batches so far, for a live display."""

    def __init__(self):
        self.batches = self.rows = 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
