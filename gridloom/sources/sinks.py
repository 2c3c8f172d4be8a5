"""Writers: text and tables, documents by tile, and the choice between them."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.operators import tables, voxels

FORMATS = ("csv", "table", "both")


def write_csv(rows: DataFrame, path: str) -> None:
    """Voxel rows in their ten columns, each part file with a header."""
    voxels.csv_rows(rows).select(*schemas.CSV_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def voxel_columns(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The voxel table's columns, with ids beyond those of `existing`; a null position is an error."""
    names = [c.split()[0] for c in schemas.VOXEL.split(", ")][1:]
    placed = F.coalesce("voxel_position", F.raise_error(F.lit("voxel_position is null")).cast("long"))
    return tables.with_ids(rows.withColumn("voxel_position", placed).select(*names), existing)


def append_voxels(rows: DataFrame, table: str) -> None:
    spark = rows.sparkSession
    voxel_columns(rows, spark.table(table) if spark.catalog.tableExists(table) else None).write.mode("append").saveAsTable(table)


def write_jdbc(rows: DataFrame, url: str, table: str, batch_rows: int = 50_000, **properties: str) -> None:
    """To an external database in batches, by one connection a partition; geometry goes as hex text, ids are the database's."""
    voxel_columns(rows).drop("id").withColumn("vox_geom", F.hex("vox_geom")).write.mode("append").option("batchsize", batch_rows).jdbc(url, table, properties=properties)


def route(rows: DataFrame, output: str, csv_path: str | None = None, table: str | None = None) -> None:
    """Writes the form asked for; a missing destination is an error, never silently nothing."""
    if output not in FORMATS:
        raise ValueError(f"output must be one of {FORMATS}")
    if output in ("csv", "both") and not csv_path:
        raise ValueError("text output needs a path")
    if output in ("table", "both") and not table:
        raise ValueError("table output needs a table name")
    kept = rows.persist(StorageLevel.DISK_ONLY) if output == "both" else rows  # both forms from one evaluation
    try:
        if output in ("csv", "both"):
            write_csv(kept, csv_path)
        if output in ("table", "both"):
            append_voxels(kept, table)
    finally:
        if output == "both":
            kept.unpersist()


def create_schema(spark: SparkSession, database: str = "default", srid: int | None = None) -> None:
    """The three tables where they are missing; existing ones stay and get columns that they lack."""
    for name, schema in schemas.TABLES.items():
        spec = ", ".join(schema.split(", "))
        extra = f" TBLPROPERTIES ('srid' = '{int(srid)}')" if srid and name == "voxel" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({spec}) USING parquet{extra}")
        have = {c.lower() for c in spark.table(f"{database}.{name}").columns}
        missing = [c for c in schema.split(", ") if c.split()[0] not in have]
        if missing:
            spark.sql(f"ALTER TABLE {database}.{name} ADD COLUMNS ({', '.join(missing)})")


def reset_tables(spark: SparkSession, database: str = "default") -> None:
    for name in (*schemas.TABLES, "tile_status"):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def with_all_columns(rows: DataFrame, schema: str) -> DataFrame:
    """Rows with every column of a schema, null where they lack one."""
    empty = rows.sparkSession.createDataFrame([], schema)
    return empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns)


def save_tile_outputs(rows: DataFrame, path: str) -> None:
    """Replaces the folders of the tiles in `rows` (column tile) and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(path)


def fingerprint(files: DataFrame) -> str:
    """One text for a set of files (path, length, modificationTime), whatever their order: it changes with any of them."""
    each = F.xxhash64("path", "length", "modificationTime")
    row = files.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(each), F.lit(0)).alias("x"), F.coalesce(F.sum(each.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).first()
    return f"{row['n']}:{row['x']}:{row['s']}"


def load_or_build(spark: SparkSession, path: str, parameters: str, build, inputs: DataFrame | None = None) -> DataFrame:
    """The stored result for these parameters and input files, or `build()` stored and read back.

    `inputs` lists the files that `build` reads (path, length, modificationTime, as Spark's `binaryFile` source
    gives them): other parameters, or a file that is new, gone or changed, are another store. Each build goes to a
    folder of its own, which a note of one row names once it is whole: what was cut off is never read.
    """
    import hashlib
    import uuid

    from pyspark.errors import AnalysisException

    key = hashlib.sha256(f"{parameters}\n{'' if inputs is None else fingerprint(inputs)}".encode()).hexdigest()[:16]
    note = f"{path}/notes/{key}"
    try:
        folder = spark.read.schema("folder string").parquet(note).first()
    except AnalysisException:
        folder = None
    if folder is None:
        name = f"data/{key}-{uuid.uuid4().hex}"
        build().write.parquet(f"{path}/{name}")
        spark.createDataFrame([(name,)], "folder string").coalesce(1).write.mode("overwrite").parquet(note)
        folder = (name,)
    return spark.read.parquet(f"{path}/{folder[0]}")
