"""Semantics: index entries, ids, and lookups by object key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import expressions as X
from gridloom.operators.keys import object_key, tile_key


def index_entry(sidecars: DataFrame) -> DataFrame:
    """Index entries of sidecars: namespaced tag, parent list, id and class, with their defaults (an empty id, not UNKNOWN)."""
    role = F.coalesce("thematic_role", F.lit("WallSurface"))
    return sidecars.select(
        *tile_key(sidecars), F.concat("obj_key", F.lit(".obj")).alias("obj_filename"), X.namespaced_tag(role).alias("tag"),
        F.array(F.coalesce("building_id", F.lit(X.UNKNOWN))).alias("parent_id"),
        F.array(F.coalesce("polygon_gml_id", F.lit(""))).alias("gml_id"), "class",
    )


def index_documents(entries: DataFrame, group: str, srid: int | None = None, dimensions: Sequence[str] = ("3",)) -> DataFrame:
    """(group, document): index documents as JSON, one for each value of `group`, the coordinate system `EPSG:srid` first where there is one.

    Entries are those of index_entry(), by file name; a document is one text, so a group is a tile.
    """
    entry = F.concat(F.to_json(F.struct("obj_filename")).substr(F.lit(17), F.length(F.to_json(F.struct("obj_filename"))) - 17), F.lit(":"), F.to_json(F.struct("tag", F.col("parent_id").alias("parentID"), F.col("gml_id").alias("gmlID"), "class")))
    held = entries.select(group, "obj_filename", entry.alias("entry")).groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("obj_filename", "entry"))), lambda s: s["entry"]).alias("entries"))
    crs = F.array(F.concat(F.lit('"CRS":'), F.to_json(F.struct(X.crs_name(F.lit(srid)).alias("srsName"), F.array(*map(F.lit, dimensions)).alias("srsDimensions"))))) if srid is not None else F.array().cast("array<string>")
    return held.select(group, F.concat(F.lit("{"), F.array_join(F.concat(crs, F.col("entries")), ","), F.lit("}")).alias("document"))


def resolved_ids(keys: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Ids of each key; a missing sidecar or field is UNKNOWN."""
    key = object_key(keys, sidecars)
    known = keys.join(sidecars.select(*key, "building_id", "class_gml_id", "polygon_gml_id"), key, "left")
    named = {"building_gmlid": "building_id", "class_gmlid": "class_gml_id", "polygon_gmlid": "polygon_gml_id"}
    return known.select(*keys.columns, *[F.coalesce(c, F.lit(X.UNKNOWN)).alias(n) for n, c in named.items()])


def semantic_lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Object type of each key from an index by file name, first `key.obj`, then `key`; Unknown where neither is there."""
    tile = tile_key(keys)
    if tile != tile_key(index):
        raise ValueError("one table has a column tile and another has not")
    own = index.select(*tile, F.col("obj_filename").alias("_name"), X.object_type(F.col("class"), F.col("tag")).alias("_type"))
    first = keys.withColumn("_name", F.concat("obj_key", F.lit(".obj"))).join(own, [*tile, "_name"], "left").withColumnRenamed("_type", "_first").drop("_name")
    both = first.join(own.withColumnRenamed("_name", "obj_key").withColumnRenamed("_type", "_second"), [*tile, "obj_key"], "left")
    return both.select(*keys.columns, F.coalesce("_first", "_second", F.lit("Unknown")).alias("object_type"))


def with_mesh(sidecars: DataFrame, meshes: DataFrame) -> DataFrame:
    key = object_key(sidecars, meshes)
    return sidecars.join(meshes.select(*key), key, "left_semi")


def without_mesh(sidecars: DataFrame, meshes: DataFrame) -> DataFrame:
    key = object_key(sidecars, meshes)
    return sidecars.join(meshes.select(*key), key, "left_anti")


def outcomes(sidecars: DataFrame, meshes: DataFrame) -> DataFrame:
    """How many sidecars are processed (parsed and with a mesh) and how many skipped."""
    key = object_key(sidecars, meshes)
    marked = sidecars.join(meshes.select(*key, F.lit(True).alias("_there")).distinct(), key, "left")
    done = F.coalesce(F.col("_there"), F.lit(False)) & (F.col("status") == "parsed")
    return marked.agg(F.count_if(done).alias("processed"), F.count_if(~done).alias("skipped"))


def require_processed(summary: DataFrame) -> None:
    """Raises where every sidecar was skipped."""
    if not summary.first()["processed"]:
        raise ValueError("no sidecar with a mesh could be parsed")
