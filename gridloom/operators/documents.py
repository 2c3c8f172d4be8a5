"""JSON documents of any size as ordered lines: a head, lines of many entries each, and a foot.

The lines of a document, one below the other, are its text. An entry line holds a bounded number of
entries in order of their names, so that neither writing nor reading has a whole document in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import expressions as X
from gridloom.operators import mesh

CHUNK = 10_000
SIDES = tuple(f"{a}{n}" for a in "xyz" for n in ("min", "max"))


def json_text(value: Column) -> Column:
    """A value as JSON, a text with its quotes."""
    held = F.to_json(F.struct(value.alias("v")))
    return F.substring(held, F.lit(6), F.length(held) - 6)


def document_lines(entries: DataFrame, heads: DataFrame, foot: str, group: str, chunk: int = CHUNK) -> DataFrame:
    """(group, line_no, line) of documents with the given (group, head) rows and (group, name, value) entries, values being JSON.

    Entries are sorted once over the whole cluster by group and name; a line is a stretch of `chunk` of them
    inside a partition, so no group is gathered, and lines are numbered in a window of one row a line. A group
    without entries has a head and a foot alone; entries of a group without head are left out.
    """
    ordered = entries.select(group, "name", F.concat(json_text(F.col("name")), F.lit(":"), "value").alias("entry")).repartitionByRange(group, "name").sortWithinPartitions(group, "name")
    # the place of a row in its partition is in the lower 33 bits
    at = F.monotonically_increasing_id()
    cut = ordered.withColumns({"_part": F.shiftright(at, 33), "_chunk": F.call_function("div", at.bitwiseAND(F.lit((1 << 33) - 1)), F.lit(chunk))})
    texts = cut.groupBy(group, "_part", "_chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "entry"))), lambda s: s["entry"]), ",").alias("text"), F.min("name").alias("first"))
    place = F.row_number().over(W.partitionBy(group).orderBy("first", "_part", "_chunk"))
    numbered = texts.withColumn("line_no", place).join(heads.select(group), group, "left_semi")
    lines = numbered.select(group, F.col("line_no").cast("long").alias("line_no"), F.concat(F.when(F.col("line_no") > 1, ",").otherwise(""), "text").alias("line"))
    ends = heads.select(group, F.inline(F.array(F.struct(F.lit(0).cast("long").alias("line_no"), F.col("head").alias("line")), F.struct(F.lit(2**62).alias("line_no"), F.lit(foot).alias("line")))))
    return lines.unionByName(ends)


def write_documents(lines: DataFrame, path: str, group: str) -> None:
    """A text file of each group's document below `path`/group=...: its lines go one by one through the task that writes it."""
    lines.repartition(group).sortWithinPartitions(group, "line_no").select(group, "line").write.mode("overwrite").partitionBy(group).text(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(group, name, value) of written documents, values being JSON; large files are read in parts."""
    lines = spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line").where(F.col("line").startswith('"') | F.col("line").startswith(',"'))
    held = F.concat(F.lit("{"), F.regexp_replace("line", "^,", ""), F.lit("}"))
    group = [c for c in lines.columns if c != "line"]
    return lines.select(*group, F.explode(F.from_json(held, "map<string,variant>")).alias("name", "v")).select(*group, "name", F.to_json("v").alias("value"))


def grid_document_lines(mapping: DataFrame, group: str, target: float, chunk: int = CHUNK) -> DataFrame:
    """The documents of mesh.grid_documents() in lines: target size, number of files, histogram, and the mapping as entries."""
    kinds = mapping.groupBy(group, "grid").agg(F.count("*").alias("files"))  # at most 2041 grid sizes a group
    held = kinds.groupBy(group).agg(F.sum("files").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("grid", "files"))), lambda s: F.concat(F.lit('"'), s["grid"], F.lit('":'), s["files"])), ",").alias("kinds"))
    head = F.concat(F.lit('{"target_voxel_size":'), json_text(F.lit(target)), F.lit(',"total_files":'), F.col("n"), F.lit(',"grid_distribution":{'), "kinds", F.lit('},"grid_mapping":{'))
    return document_lines(mapping.select(group, F.col("obj_filename").alias("name"), F.col("grid").cast("string").alias("value")), held.select(group, head.alias("head")), "}}", group, chunk)


def bbox_document_lines(bboxes: DataFrame, group: str, chunk: int = CHUNK) -> DataFrame:
    """The documents of mesh.bbox_documents() in lines: the box around all, and each object's box as an entry."""
    whole = bboxes.groupBy(group).agg(*[(F.min if s.endswith("min") else F.max)(s).alias(f"_{s}") for s in SIDES])
    head = F.concat(F.lit('{"global_bbox":'), F.to_json(F.struct(F.lit("translate_model").alias("json_featuretype"), *[f"_{s}" for s in SIDES])), F.lit(',"per_file":{'))
    box = F.to_json(F.struct("obj_filename", *[F.col(s).alias(f"_{s}") for s in SIDES], "translate"))
    return document_lines(mesh.with_translate(bboxes).select(group, F.col("obj_key").alias("name"), box.alias("value")), whole.select(group, head.alias("head")), "}}", group, chunk)


def index_document_lines(entries: DataFrame, group: str, srid: int | None = None, dimensions: tuple[str, ...] = ("3",), chunk: int = CHUNK) -> DataFrame:
    """The documents of semantics.index_documents() in lines, the coordinate system an entry before all others."""
    value = F.to_json(F.struct("tag", F.col("parent_id").alias("parentID"), F.col("gml_id").alias("gmlID"), "class"))
    rows = entries.select(group, F.col("obj_filename").alias("name"), value.alias("value"))
    heads = entries.select(group).distinct().withColumn("head", F.lit("{"))
    if srid is not None:
        crs = F.to_json(F.struct(X.crs_name(F.lit(srid)).alias("srsName"), F.array(*map(F.lit, dimensions)).alias("srsDimensions")))
        heads = heads.withColumn("head", F.concat(F.lit('{"CRS":'), crs, F.lit(",")))
    return document_lines(rows, heads, "}", group, chunk)
