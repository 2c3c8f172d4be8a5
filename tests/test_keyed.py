"""The keyed table: merges against a plain dict, bytes written, versions, and standing counts over restarts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gridloom.sources.keyed import KeyedTable
from gridloom.streaming import ingest

SCHEMA = "gmlid string, building_gmlid string, n long"


def parts(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_changes_equal_a_dict(spark, tmp_path):
    """Upserts with repeated keys, deletions and compactions in turn; every version reads as the dict."""
    table, expected, rng = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=4), {}, random.Random(2)
    assert table.read().count() == 0 and table.version() == 0 and table.compact() == 0
    for turn in range(4):
        rows = [(f"k{rng.randrange(40)}", f"b{turn}", turn * 100 + i, i) for i in range(25)]
        table.upsert(spark.createDataFrame(rows, SCHEMA + ", seq int").repartition(3), ["seq"])
        expected |= {r[0]: r[:3] for r in rows}
        gone = [f"k{k}" for k in range(turn, 40, 9)]
        table.delete(spark.createDataFrame([(k,) for k in gone + ["never"]], "gmlid string"))
        for k in gone:
            expected.pop(k, None)
        if turn % 2:
            table.compact(2)
        assert sorted(map(tuple, table.read().collect())) == sorted(expected.values())
    assert table.version() == 10


def test_an_upsert_writes_its_own_rows(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=16)
    table.upsert(spark.range(50_000).select(F.sha2(F.col("id").cast("string"), 256).alias("gmlid"), F.lit("b").alias("building_gmlid"), F.col("id").alias("n")))
    table.compact(1)
    before = parts(tmp_path / "t" / "data")
    table.upsert(spark.range(3).select(F.sha2(F.col("id").cast("string"), 256).alias("gmlid"), F.lit("new").alias("building_gmlid"), F.col("id").alias("n")))
    new = {p: n for p, n in parts(tmp_path / "t" / "data").items() if p not in before}
    assert len(new) <= 3 and sum(new.values()) < 0.01 * sum(before.values())
    assert table.read().where("building_gmlid = 'new'").count() == 3 and table.read().count() == 50_000
    # compaction rewrites the touched buckets alone
    at = parts(tmp_path / "t" / "data")
    table.compact(1)
    rewritten = [p for p in parts(tmp_path / "t" / "data") if p not in at]
    assert 1 <= len(rewritten) <= 3 and table.read().where("building_gmlid = 'new'").count() == 3


def test_versions_are_whole_or_absent(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=2)
    row = lambda *k: spark.createDataFrame([(x, "b", 1) for x in k], SCHEMA)
    table.upsert(row("a", "b"))
    table._write(row("c").withColumn("_gone", F.lit(False)), "delta", 2)  # cut off before its snapshot
    assert {r.gmlid for r in table.read().collect()} == {"a", "b"} and table.version() == 1
    table.upsert(row("d"))
    assert {r.gmlid for r in table.read().collect()} == {"a", "b", "d"}
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        table._publish([], 2)  # a second writer of the same version
    with pytest.raises(Exception, match="gmlid is null"):
        table.upsert(spark.createDataFrame([(None, "b", 1)], SCHEMA))
    assert {r.gmlid for r in table.read().collect()} == {"a", "b", "d"}


def test_standing_counts_over_three_runs(spark, tmp_path):
    source, counts = str(tmp_path / "in"), KeyedTable(spark, str(tmp_path / "counts"), ingest.COUNTS, "count_key", 4)

    def arrive(tile, *names):
        spark.createDataFrame([(n,) for n in names], "obj_key string").coalesce(1).write.mode("append").parquet(f"{source}/tile={tile}")

    def run(**settings):
        q = ingest.standing_counts(spark, source, "obj_key string", counts, str(tmp_path / "ckpt"), **settings)
        q.awaitTermination(120)
        assert q.exception() is None
        batch = spark.read.schema("obj_key string, tile string").parquet(source).groupBy("tile", "obj_key").agg(F.count("*").alias("voxels"))
        got = {tuple(r) for r in counts.read().select("tile", "obj_key", "voxels").collect()}
        assert got == {tuple(r) for r in batch.select("tile", "obj_key", "voxels").collect()}
        return got

    arrive("a", "x", "x", "y")
    arrive("b", "x")
    assert run() == {("a", "x", 2), ("a", "y", 1), ("b", "x", 1)}
    arrive("a", "x", "z", None)
    arrive("b", "y")
    assert ("a", "x", 3) in run(max_files=1)
    version = counts.version()
    assert len(run()) == 6 and counts.version() == version  # nothing new: nothing is written
