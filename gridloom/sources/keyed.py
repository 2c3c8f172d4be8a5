"""A keyed table in folders by hash bucket: an upsert writes its own rows only, and reading merges.

`data` has the folders kind=base|delta / version=N / bucket=B, `state` a snapshot for each version of
which folders count. A snapshot is one small file and is written last, so a version is there as a whole or
not at all; two writers of one version collide on it, and one of them fails.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import tables

GONE, BUCKET, VERSION = "_gone", "bucket", "version"
STATE = "kind string, version int, bucket int"


@dataclass
class KeyedTable:
    """Rows by a unique key. `buckets` is fixed for the table's life: about a bucket a gigabyte of rows."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "gmlid"
    buckets: int = 64

    def version(self) -> int:
        """The newest version; 0 before the first."""
        from pyspark.errors import AnalysisException

        try:
            found = self.spark.read.schema(f"{STATE}, v int").parquet(f"{self.path}/state").agg(F.max("v")).first()[0]
        except AnalysisException:
            found = None
        return found or 0

    def folders(self) -> list[tuple[str, int, int]]:
        """(kind, version, bucket) of the folders that count now: at most one base and the deltas since for each bucket."""
        v = self.version()
        if not v:
            return []
        rows = self.spark.read.schema(STATE).parquet(f"{self.path}/state/v={v}").where("bucket >= 0")
        return sorted(tuple(r) for r in rows.collect())

    def _publish(self, folders: list[tuple[str, int, int]], v: int) -> None:
        # a row of bucket -1 keeps the snapshot of an empty table a file
        rows = self.spark.createDataFrame([*folders, ("none", v, -1)], STATE)
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/state/v={v}")

    def _write(self, rows: DataFrame, kind: str, v: int) -> list[tuple[str, int, int]]:
        """Writes rows with their mark of deletion as one version's folders; returns them."""
        target = f"{self.path}/data/kind={kind}/version={v}"
        placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        # what an interrupted writer of this version left is replaced
        placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
        held = self.spark.read.schema(f"{self.schema}, {GONE} boolean, {BUCKET} int").parquet(target)
        return [(kind, v, r[BUCKET]) for r in held.select(BUCKET).distinct().collect()]

    def _rows(self, folders: Sequence[tuple[str, int, int]]) -> DataFrame:
        data = f"{self.path}/data"
        read = self.spark.read.schema(f"{self.schema}, {GONE} boolean, kind string, {VERSION} int, {BUCKET} int").option("basePath", data)
        return read.parquet(*[f"{data}/kind={k}/version={v}/bucket={b}" for k, v, b in folders])

    def _merged(self, folders: Sequence[tuple[str, int, int]]) -> DataFrame:
        """The newest row of each key, those marked as gone too: partial maxima, so that a version is a row a key and task."""
        return tables.last_by_key(self._rows(folders).drop("kind", BUCKET), self.key, [VERSION]).drop(VERSION)

    def upsert(self, rows: DataFrame, order: Sequence[str] = ()) -> int:
        """The last of the given rows of each key, by `order`, replaces what the table has; returns the new version. Null keys are an error."""
        names = self.spark.createDataFrame([], self.schema).columns
        last = tables.last_by_key(rows.select(*names, *order), self.key, list(order)) if order else rows.select(*names)
        sound = F.coalesce(self.key, F.raise_error(F.lit(f"{self.key} is null")).cast("string"))
        return self._change(last.select(*names).withColumn(self.key, sound).withColumn(GONE, F.lit(False)))

    def delete(self, keys: DataFrame) -> int:
        """Removes the rows of the given keys, by marks that reading and compaction apply."""
        empty = self.spark.createDataFrame([], self.schema)
        marks = keys.select(self.key).distinct()
        return self._change(marks.select(*[F.col(c) if c == self.key else F.lit(None).cast(t).alias(c) for c, t in empty.dtypes], F.lit(True).alias(GONE)))

    def _change(self, rows: DataFrame) -> int:
        v = self.version() + 1
        before = self.folders()
        self._publish(before + self._write(rows, "delta", v), v)
        return v

    def read(self) -> DataFrame:
        """All rows now. Buckets that are a base alone are read as they are; only those with deltas are merged."""
        folders = self.folders()
        touched = {b for kind, _, b in folders if kind == "delta"}
        names = self.spark.createDataFrame([], self.schema)
        plain, mixed = [f for f in folders if f[2] not in touched], [f for f in folders if f[2] in touched]
        parts = ([self._rows(plain)] if plain else []) + ([self._merged(mixed).where(~F.col(GONE))] if mixed else [])
        out = names
        for part in parts:
            out = part.select(*names.columns) if out is names else out.unionByName(part.select(*names.columns))
        return out

    def compact(self, least_deltas: int = 4) -> int:
        """Merges the buckets with at least so many deltas into new bases and touches no other; returns the version, the old one where there are none."""
        folders = self.folders()
        n = {b: sum(kind == "delta" and b == own for kind, _, own in folders) for b in {f[2] for f in folders}}
        due = {b for b, k in n.items() if k >= least_deltas}
        if not due:
            return self.version()
        v = self.version() + 1
        whole = self._merged([f for f in folders if f[2] in due]).where(~F.col(GONE))
        self._publish([f for f in folders if f[2] not in due] + self._write(whole, "base", v), v)
        return v
