"""The key of an object: its name, and its tile where rows have one."""

from __future__ import annotations

from pyspark.sql import DataFrame

TILE, OBJECT = "tile", "obj_key"


def object_key(*frames: DataFrame) -> list[str]:
    """The columns by which the given tables meet: tile and obj_key, or obj_key alone where none has a tile.

    Names of objects repeat from tile to tile. A table with tiles and one without don't meet: equal names
    would multiply rows.
    """
    tiled = {TILE in f.columns for f in frames}
    if len(tiled) > 1:
        raise ValueError("one table has a column tile and another has not")
    return [*tile_key(frames[0]), OBJECT]


def tile_key(frame: DataFrame) -> list[str]:
    return [TILE] if TILE in frame.columns else []
