"""Tables: upserts, appends, keys, cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources import shared

#: Rows from which on a key is hot: its rows stay where they are and the key comes to them.
HOT_ROWS = 100_000


def last_by_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order, by partial maxima: a hot key costs a row a task."""
    rest = [c for c in rows.columns if c != key and c not in order]
    top = rows.groupBy(key).agg(F.max_by(F.struct(*[*order, *rest]), F.struct(*order)).alias("_row"))
    return top.select(key, "_row.*").select(*rows.columns)


def merge_object(old: DataFrame, new: DataFrame, order: Sequence[str], key: str = "gmlid") -> DataFrame:
    """Upsert: the last new row of each key replaces the old one; other old rows stay. Order columns stay out of the result."""
    latest = last_by_key(new, key, order).select(*old.columns)
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


def with_ids(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows with a first column `id`, unique but not dense, beyond the largest of `existing`; one writer at a time, as with any table of files."""
    last = None if existing is None else existing.agg(F.max("id")).first()[0]
    return rows.select((F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1)).alias("id"), "*")


def object_class_rows(files: DataFrame, dedupe: bool = False, existing: DataFrame | None = None) -> DataFrame:
    """One row for each grid file, with an id that no row of `existing` has; `dedupe` keeps one of each gmlid and type."""
    rows = files.select("object_type", F.col("polygon_gmlid").alias("gmlid"), "building_gmlid", "class_gmlid", "polygon_gmlid")
    if dedupe:
        rows = rows.dropDuplicates(["gmlid", "object_type"])
    return with_ids(rows, existing)


def without_keys(rows: DataFrame, keys: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose key isn't among `keys`; those with a null key stay.

    Rows are written to the shared folder. Those of a hot key, or without one, never meet in one task: there are
    few hot keys, at most one for each `hot_rows` rows, so they are looked up by themselves and go to all tasks.
    """
    held = shared.stage(rows, "rows")
    known = keys.select(key).where(F.col(key).isNotNull())
    often = shared.stage(held.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= hot_rows).select(key), "hot")
    gone = shared.stage(often.join(known, key, "left_semi"), "gone")
    rare = held.where(F.col(key).isNotNull()).join(F.broadcast(often), key, "left_anti").join(known, key, "left_anti")
    hot = held.join(F.broadcast(often.join(F.broadcast(gone), key, "left_anti")), key, "left_semi")
    return rare.unionByName(hot).unionByName(held.where(F.col(key).isNull())).select(*rows.columns)


def foreign_key_violations(children: DataFrame, parents: DataFrame, key: str = "gmlid") -> DataFrame:
    """Child rows with a key that no parent has; null keys refer to nothing and are fine."""
    return without_keys(children.where(F.col(key).isNotNull()), parents, key)


def primary_key_violations(rows: DataFrame, key: str, required: Sequence[str] = ()) -> DataFrame:
    """(key, rows, nulls): keys that occur more than once, are null, or have null required columns."""
    nulls = F.count_if(F.col(key).isNull() | F.lit(False) if not required else F.greatest(*[F.col(c).isNull() for c in (key, *required)]))
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("rows"), nulls.alias("nulls")).where("rows > 1 or nulls > 0")


def cascade_delete(rows: DataFrame, deleted: DataFrame, key: str = "gmlid") -> DataFrame:
    return without_keys(rows, deleted, key)
