"""Readers: mesh text, sidecars, encoded grids, index documents and tile folders.

Each reader is a thin scan, then a function over file rows that also serves rows from elsewhere.
Spark's file sources leave out names that begin with `_` or `.`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import expressions as X
from gridloom.schemas import SIDECAR

#: Fixed names of documents that are not sidecars, compared without regard to case.
RESERVED = ("index.json", "translate.json", "grid_mapping.json")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def tile_of(path: Column, folder: str) -> Column:
    """The first folder of a path below `folder`; null for a file that lies there itself."""
    root = folder.removeprefix("file:").rstrip("/") + "/"
    below = F.call_function("substring_index", path, F.lit(root), F.lit(-1))
    return F.when(below.contains("/"), F.substring_index(below, "/", 1))


def listed(files: DataFrame, path: Column, folder: str, tiles: bool) -> DataFrame:
    """Files of a folder, or with their tile those of all folders in it."""
    return files.withColumn("tile", tile_of(path, folder)).where("tile is not null") if tiles else files


def text_files(spark: SparkSession, folder: str, glob: str, tiles: bool = False) -> DataFrame:
    """(path, content), one row a file; folders inside are not entered, or with `tiles` each is a tile."""
    read = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", tiles).text(folder, wholetext=True)
    return listed(read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")), F.col("path"), folder, tiles)


def mesh_names(spark: SparkSession, folder: str, tiles: bool = False) -> DataFrame:
    """(obj_key) of all mesh files; contents are not read. Spark's file sources leave out files without a byte."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.obj").option("recursiveFileLookup", tiles).load(folder).select("path")
    return listed(read, F.col("path"), folder, tiles).select(*(["tile"] if tiles else []), stem(base_name(F.col("path"))).alias("obj_key"))


def scan_mesh(spark: SparkSession, folder: str, tiles: bool = False) -> DataFrame:
    """(obj_key, obj_filename, block, line_no, line) of mesh files, with tile where each folder inside is one.

    Lines are split by the reader, so a large file is read in parts: `block` is where a part begins in its
    file, and line_no rises inside a part. Together they order the lines of a file, without counting them.
    """
    read = spark.read.option("pathGlobFilter", "*.obj").option("recursiveFileLookup", tiles).option("lineSep", "\n").text(folder)
    lines = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("line"))
    name = base_name(F.col("path"))
    return listed(lines, F.col("path"), folder, tiles).select(*(["tile"] if tiles else []), stem(name).alias("obj_key"), name.alias("obj_filename"), "block", "line_no", "line")


def mesh_lines(files: DataFrame) -> DataFrame:
    """(obj_key, obj_filename, line_no, line) of file rows whose name ends in `.obj`, numbered from 0."""
    name = base_name(F.col("path"))
    own = files.where(F.col("path").endswith(".obj")).select(stem(name).alias("obj_key"), name.alias("obj_filename"), "content")
    return own.select("obj_key", "obj_filename", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))


def sidecars(files: DataFrame) -> DataFrame:
    """One row for each JSON file but the reserved ones: the five known fields, extra fields as VARIANT, and a status.

    `parsed` or `failed`; failed rows keep their key. A document that isn't an object fails.
    """
    name = base_name(F.col("path"))
    own = files.where(F.col("path").endswith(".json") & ~F.lower(name).isin(*RESERVED))
    whole = F.try_parse_json(F.col("content"))
    known = F.from_json("content", SIDECAR)
    texts = [f.split()[0] for f in SIDECAR.split(", ")]
    # a known field of another type than text or null makes the document fail
    kinds = [F.coalesce(F.schema_of_variant(F.try_variant_get(whole, f"$.{c}", "variant")), F.lit("VOID")).isin("STRING", "VOID") for c in texts]
    good = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    for k in kinds:
        good = good & k
    tile = [c for c in files.columns if c == "tile"]
    shown = own.select(*tile, stem(name).alias("obj_key"), known.alias("known"), whole.alias("extra"), good.alias("good"))
    return shown.select(*tile, "obj_key", *[F.when(F.col("good"), F.col(f"known.{c}")).alias(c) for c in texts], "extra", F.when(F.col("good"), "parsed").otherwise("failed").alias("status"))


def scan_sidecars(spark: SparkSession, folder: str, tiles: bool = False) -> DataFrame:
    return sidecars(text_files(spark, folder, "*.json", tiles))


def scan_grids(spark: SparkSession, folder: str, tiles: bool = False) -> DataFrame:
    """(file_name, content), with tile where each folder inside is one; whole files, so up to 2 GB each (ranges.scan_grid_ranges beyond that)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.binvox").option("recursiveFileLookup", tiles).load(folder)
    return listed(files, F.col("path"), folder, tiles).select(*(["tile"] if tiles else []), base_name(F.col("path")).alias("file_name"), "content")


def write_files(files: DataFrame, folder: str) -> int:
    """Writes each (path, content) row as a file below `folder`, from the task that holds it; returns how many.

    A file is written under another name and then moved, so that a repeated task replaces whole files by equal
    ones. Tasks write by themselves: shared folders, and stores that pyarrow has a file system for.
    """
    from collections.abc import Iterator

    import pandas as pd

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                local = folder.startswith("/") or folder.startswith("file:")
                store, base = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(folder)
                target = f"{base.rstrip('/')}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(part := f"{target}.{uuid.uuid4().hex}") as out:
                    out.write(bytes(content))
                store.move(part, target)
            yield pd.DataFrame({"n": [len(batch)]})

    rows = files.select("path", F.col("content").cast("binary").alias("content"))
    return rows.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def index_entries(documents: DataFrame) -> DataFrame:
    """(obj_key, tag, parent_id, gml_id, class) of index documents in `content`, with the documents' other columns; the CRS entry and entries that don't fit are left out."""
    entry = F.col("entry")
    own = [c for c in documents.columns if c != "content"]
    entries = documents.select(*own, F.explode(F.from_json("content", "map<string,variant>")).alias("obj_key", "entry")).where("obj_key <> 'CRS'")
    shown = entries.select(
        *own,
        "obj_key",
        F.try_variant_get(entry, "$.tag", "string").alias("tag"),
        F.try_variant_get(entry, "$.parentID", "variant").alias("parent"),
        F.try_variant_get(entry, "$.gmlID", "variant").alias("gml"),
        F.try_variant_get(entry, "$.class", "string").alias("class"),
        F.schema_of_variant(entry).alias("kind"),
    )
    listed = lambda c: F.schema_of_variant(F.col(c)).isin("STRING", "ARRAY<STRING>", "ARRAY<VOID>")
    fits = F.col("kind").startswith("OBJECT") & F.col("tag").isNotNull() & listed("parent") & listed("gml")
    return shown.where(fits).select(*own, "obj_key", "tag", X.first_of(F.col("parent")).alias("parent_id"), X.first_of(F.col("gml")).alias("gml_id"), "class")


def scan_index(spark: SparkSession, path: str) -> DataFrame:
    return index_entries(spark.read.text(path, wholetext=True).select(F.col("value").alias("content")))


def scan_tile_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) relative to the folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    root = F.lit(folder.removeprefix("file:").rstrip("/") + "/")
    return files.select(F.call_function("substring_index", F.col("path"), root, F.lit(-1)).alias("path"), "length")
