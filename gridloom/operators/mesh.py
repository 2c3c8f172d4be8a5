"""Meshes: vertices, axis swap, bounding boxes, grid sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import expressions as X
from gridloom.operators.keys import object_key, tile_key


def _tokens(line):
    return F.array_remove(F.split(F.substring(line, 3, 2**31 - 1), "[ \\t\\r\\f]+"), "")


def parse_vertices(lines: DataFrame) -> DataFrame:
    """Rows of vertex lines with x, y, z; other lines and lines without three leading numbers go."""
    kept = [c for c in lines.columns if c != "line"]
    # through a generator, so that a line is split once and not again for each number
    found = lines.where(F.col("line").startswith("v ")).select(*kept, F.inline(F.array(F.struct(F.slice(_tokens(F.col("line")), 1, 3).alias("_t")))))
    good = found.where((F.size("_t") == 3) & F.array_join("_t", " ").rlike("^" + " ".join([X.NUMBER.removeprefix("^").removesuffix("$")] * 3) + "$"))
    return good.select(*kept, *[F.col("_t")[k].try_cast("double").alias(a) for k, a in enumerate("xyz")])


def swap_axes(lines: DataFrame) -> DataFrame:
    """Vertex lines with their second and third values exchanged as text; others as they are."""
    t = _tokens(F.col("line"))
    swapped = F.concat_ws(" ", F.lit("v"), t[0], t[2], t[1], F.array_join(F.slice(t, 4, 2**31 - 1), " "))
    return lines.withColumn("line", F.when(F.col("line").startswith("v ") & (F.size(t) >= 3), F.rtrim(swapped)).otherwise(F.col("line")))


def object_bbox(vertices: DataFrame) -> DataFrame:
    """Least and largest coordinates and the number of vertices of each object (of each tile, where rows have one).

    NaN components don't count, though their vertex does; an axis of NaN alone is null. Partial
    minima leave one row for each object and task, so objects of any size are safe.
    """
    clean = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    sides = [f(clean(a)).alias(f"{a}{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return vertices.groupBy(*object_key(vertices)).agg(*sides, F.count("*").alias("n_vertices"))


def without_vertices(meshes: DataFrame, bboxes: DataFrame) -> DataFrame:
    """Meshes (obj_key) of which no vertex was read."""
    key = object_key(meshes, bboxes)
    return meshes.join(bboxes.where("n_vertices > 0").select(*key), key, "left_anti")


def require_vertices(meshes: DataFrame, bboxes: DataFrame) -> None:
    """Raises where a mesh has no vertices, and names the first."""
    lone = without_vertices(meshes, bboxes).agg(F.min("obj_key").alias("first"), F.count("*").alias("n")).first()
    if lone["n"]:
        raise ValueError(f"{lone['n']} meshes without vertices, first {lone['first']}")


def with_translate(bboxes: DataFrame) -> DataFrame:
    return bboxes.withColumn("obj_filename", F.concat("obj_key", F.lit(".obj"))).withColumn("translate", F.array("xmin", "ymin", "zmin"))


def global_bbox(bboxes: DataFrame) -> DataFrame:
    """The box around all objects, or around those of each tile."""
    return bboxes.groupBy(*tile_key(bboxes)).agg(*[f(f"{a}{n}").alias(f"{a}{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def grid_mapping(bboxes: DataFrame, target: float = X.DEFAULT_VOXEL_SIZE) -> DataFrame:
    """(obj_key, obj_filename, grid): cells for each axis so that none is larger than the target size."""
    return bboxes.select(*object_key(bboxes), F.concat("obj_key", F.lit(".obj")).alias("obj_filename"), X.grid_size(X.max_dimension(), target).alias("grid"))


def grid_histogram(mapping: DataFrame) -> DataFrame:
    """Files and percentage of each grid size, in each tile where there are tiles; the total comes from the few grouped rows."""
    tile = tile_key(mapping)
    counted = mapping.groupBy(*tile, "grid").agg(F.count("*").alias("files"))
    total = counted.groupBy(*tile).agg(F.sum("files").alias("total"))
    both = counted.join(total, tile) if tile else counted.join(F.broadcast(total))  # one row
    return both.select(*tile, "grid", "files", (F.col("files") * 100.0 / F.col("total")).alias("percent"))


def grid_lookup(meshes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each mesh with its grid; those without take the largest known (in their tile, where there are tiles), or 256 where none is."""
    key, tile = object_key(meshes, mapping), tile_key(meshes)
    fallback = mapping.groupBy(*tile).agg(F.max("grid").alias("_fallback"))
    known = meshes.join(mapping.select(*key, "grid"), key, "left")
    joined = known.join(fallback, tile, "left") if tile else known.join(F.broadcast(fallback))  # one row
    return joined.withColumn("grid", F.coalesce("grid", "_fallback", F.lit(X.FALLBACK_GRID))).drop("_fallback")


def grid_documents(mapping: DataFrame, tile: str, target: float) -> DataFrame:
    """One JSON document for each tile: target size, number of files, histogram and mapping."""
    each = mapping.groupBy(tile).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("obj_filename", "grid"))).alias("entries"))
    held = mapping.groupBy(tile, "grid").agg(F.count("*").alias("files")).groupBy(tile).agg(F.sort_array(F.collect_list(F.struct(F.col("grid").cast("string").alias("grid"), F.col("files").cast("int").alias("files")))).alias("kinds"))
    document = F.to_json(F.struct(F.lit(target).alias("target_voxel_size"), F.col("n").alias("total_files"), F.map_from_entries("kinds").alias("grid_distribution"), F.map_from_entries("entries").alias("grid_mapping")))
    return each.join(held, tile).select(tile, document.alias("document"))


def bbox_documents(bboxes: DataFrame, tile: str) -> DataFrame:
    """One JSON document for each tile: the box around all and a map of boxes by stem."""
    sides = [f"{a}{n}" for a in "xyz" for n in ("min", "max")]
    entry = F.struct("obj_filename", *[F.col(s).alias(f"_{s}") for s in sides], "translate")
    whole = F.struct(F.lit("translate_model").alias("json_featuretype"), *[(F.min(s) if s.endswith("min") else F.max(s)).alias(f"_{s}") for s in sides])
    rows = with_translate(bboxes).groupBy(tile).agg(whole.alias("global_bbox"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("obj_key", entry.alias("box"))))).alias("per_file"))
    return rows.select(tile, F.to_json(F.struct("global_bbox", "per_file")).alias("document"))


def bboxes_of_document(documents: DataFrame) -> DataFrame:
    box = "struct<obj_filename:string,_xmin:double,_xmax:double,_ymin:double,_ymax:double,_zmin:double,_zmax:double,translate:array<double>>"
    held = documents.select(F.from_json("document", f"per_file map<string,{box}>").alias("d")).select(F.explode("d.per_file").alias("obj_key", "box"))
    return held.select("obj_key", "box.obj_filename", *[F.col(f"box._{a}{n}").alias(f"{a}{n}") for a in "xyz" for n in ("min", "max")], "box.translate")
