"""Upserts, keys, sinks, tile ledger and incremental ingest."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from gridloom.operators import tables, tiles, voxels
from gridloom.sources import files, sinks
from gridloom.streaming import ingest

OBJECT = "gmlid string, building_gmlid string, class_gmlid string, polygon_gmlid string"


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([("a", "1", "c", "p"), ("b", "1", "c", "p")], OBJECT)
    new = spark.createDataFrame([("b", "2", None, "p", 1), ("b", "3", None, "q", 2), ("n", "4", "c", "p", 1)], OBJECT + ", seq int")
    assert {r.gmlid: (r.building_gmlid, r.polygon_gmlid) for r in tables.merge_object(old, new, ["seq"]).collect()} == {"a": ("1", "p"), "b": ("3", "q"), "n": ("4", "p")}


def test_keys_and_cascade(spark):
    parent = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "gmlid string")
    child = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "gmlid string, n int")
    assert [r.n for r in tables.foreign_key_violations(child, parent).collect()] == [2]
    assert {(r.key, r.rows, r.nulls) for r in tables.primary_key_violations(parent, "gmlid").collect()} == {("b", 2, 0), (None, 1, 1)}
    assert sorted(r.n for r in tables.cascade_delete(child, parent.where("gmlid = 'a'")).collect()) == [2, 3]


def test_object_class_append_and_dedupe(spark):
    f = spark.createDataFrame([("Roof", "p", "b", "c"), ("Roof", "p", "b", "c")], "object_type string, polygon_gmlid string, building_gmlid string, class_gmlid string")
    assert tables.object_class_rows(f).count() == 2 and tables.object_class_rows(f, dedupe=True).count() == 1


def test_ids_stay_unique_over_appends(spark):
    f = spark.range(6).selectExpr("concat('t', id) AS object_type", "'p' AS polygon_gmlid", "'b' AS building_gmlid", "'c' AS class_gmlid").repartition(3)
    first = tables.object_class_rows(f)
    second = tables.object_class_rows(f, existing=first)
    ids = [r.id for r in first.collect()] + [r.id for r in second.collect()]
    assert len(set(ids)) == 12


def voxel(spark):
    row = (100001001, 1, 1.5, 690800.0, 12345678.5, "g", "b", "c", "p", "Roof")
    df = spark.createDataFrame([row], "voxel_position long, k int, x double, y double, z double, gmlid string, building_gmlid string, class_gmlid string, polygon_gmlid string, object_type string")
    return df.withColumn("vox_geom", F.unhex(F.lit("0101")))


def test_routes(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS city")
    sinks.reset_tables(spark, "city")
    sinks.create_schema(spark, "city", 25832)
    sinks.create_schema(spark, "city", 25832)
    sinks.route(voxel(spark), "both", str(tmp_path / "csv"), "city.voxel")
    assert spark.table("city.voxel").count() == 1
    sinks.append_voxels(voxel(spark), "city.voxel")
    assert spark.table("city.voxel").select("id").distinct().count() == 2
    with pytest.raises(Exception, match="voxel_position is null"):
        sinks.append_voxels(voxel(spark).withColumn("voxel_position", F.lit(None).cast("long")), "city.voxel")
    parts = [list(csv.reader(open(p))) for p in glob.glob(f"{tmp_path}/csv/part-*.csv")]
    assert max(parts, key=len) == [["voxel_position", "vox_geom", "gmlid", "building_gmlid", "class_gmlid", "polygon_gmlid", "object_type", "X", "Y", "Z"], ["100001001", "0101", "g", "b", "c", "p", "Roof", "1.5", "690800", "12345678.5"]]
    for output, path, table in (("csv", None, None), ("table", None, None), ("both", str(tmp_path), None), ("other", None, None)):
        with pytest.raises(ValueError):
            sinks.route(voxel(spark), output, path, table)
    sinks.reset_tables(spark, "city")
    assert not spark.catalog.tableExists("city.voxel")


def test_schema_gains_missing_columns(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS town")
    sinks.reset_tables(spark, "town")
    spark.sql("CREATE TABLE town.object (gmlid string) USING parquet")
    sinks.create_schema(spark, "town")
    assert spark.table("town.object").columns == ["gmlid", "building_gmlid", "class_gmlid", "polygon_gmlid"]
    assert sinks.with_all_columns(spark.createDataFrame([("a",)], "gmlid string"), OBJECT).first().class_gmlid is None
    sinks.reset_tables(spark, "town")


def test_tile_outputs_replace_their_own_folders(spark, tmp_path):
    df = lambda t, n: spark.createDataFrame([(t, n)], "tile string, n int")
    for rows in (df("a", 1).union(df("b", 1)), df("a", 5)):
        sinks.save_tile_outputs(rows, str(tmp_path / "t"))
    assert {(r.tile, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 5), ("b", 1)}


def test_store_follows_parameters_and_inputs(spark, tmp_path):
    """Built again for other parameters and for a new, changed or removed input; a build that was cut off is never read."""
    calls, folder = [], tmp_path / "in"
    folder.mkdir()

    def build():
        calls.append(1)
        return spark.createDataFrame([(len(calls),)], "n int")

    def load(parameters="size=0.5"):
        inputs = spark.read.format("binaryFile").load(str(folder)).select("path", "length", "modificationTime")
        return sinks.load_or_build(spark, str(tmp_path / "s"), parameters, build, inputs).first().n

    (folder / "a.obj").write_text("v 1 2 3")
    assert [load(), load(), load("size=1"), load()] == [1, 1, 2, 1]
    (folder / "b.obj").write_text("v 1 2 3")
    assert [load(), load()] == [3, 3]
    (folder / "a.obj").write_text("v 1 2 4 5")
    assert [load(), load()] == [4, 4]
    (folder / "b.obj").unlink()
    assert [load(), load()] == [5, 5]

    def broken():
        return spark.range(10).select(F.when(F.col("id") > 5, F.raise_error(F.lit("cut off")).cast("int")).otherwise(1).alias("n"))

    with pytest.raises(Exception, match="cut off"):
        sinks.load_or_build(spark, str(tmp_path / "s"), "other", broken)
    spark.range(1).write.parquet(str(tmp_path / "s" / "data" / "left-behind"))
    assert sinks.load_or_build(spark, str(tmp_path / "s"), "other", build).first().n == 6


def test_inventory(spark, tmp_path):
    for name in ("a/x.gml", "a/deep/y.gml", "b/readme.txt", "a.gml", "c.gml", "notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = files.scan_tile_files(spark, str(tmp_path))
    assert {r.kind: (r.tiles, r.gml_files, r.files) for r in tiles.inventory(found).collect()} == {"folder": (2, 2, 3), "loose": (2, 2, 2)}
    assert [tuple(r) for r in tiles.empty_tiles(found).collect()] == [("folder", "b")]
    assert [r.tile for r in tiles.name_clashes(found).collect()] == ["a"]


def test_pending_names_and_errors(spark):
    t = spark.createDataFrame([("folder", "a"), ("loose", "b.gml"), ("folder", "tile_c"), ("folder", "d")], "kind string, tile string")
    done = spark.createDataFrame([("tile_a",), ("b",), ("out/c",)], "tile string")
    assert [r.tile for r in tiles.pending(t, done).collect()] == ["d"]
    assert [r.tile for r in tiles.next_tiles(t, 2).collect()] == ["a", "d"]
    with pytest.raises(ValueError):
        tiles.require_input(done.where("false"), "mesh")
    with pytest.raises(ValueError):
        tiles.require_ok(tiles.run_outcomes(spark.createDataFrame([("failed",)], "status string")))


class Inbox:
    """A source folder, a ledger and a run over both."""

    def __init__(self, spark, tmp_path):
        self.spark, self.source, self.book, self.checkpoint = spark, str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "ckpt")
        self.serial = 0

    def arrive(self, *names):
        for t in names:
            self.serial += 1
            self.spark.createDataFrame([(self.serial,), (-self.serial,)], "n int").coalesce(1).write.mode("append").parquet(f"{self.source}/tile={t}")

    def run(self, work, **settings):
        q = ingest.ingest_tiles(self.spark, self.source, "n int", self.book, self.checkpoint, work, **settings)
        q.awaitTermination(120)
        assert q.exception() is None

    def latest(self):
        return {r.tile: (r.status, r.attempts) for r in tiles.latest_status(ingest.ledger(self.spark, self.book)).collect()}


def test_ingest_resumes_retries_and_goes_on(spark, tmp_path):
    """Three runs: a tile that fails is taken up again without its files being touched, until it succeeds; a new file of a finished tile is reported."""
    box, done, tries, mended = Inbox(spark, tmp_path), [], {"bad": 0, "flaky": 0}, []

    def work(rows, tile):
        if tile in tries:
            tries[tile] += 1
            if tile == "bad" and not mended or tries[tile] == 1:
                raise RuntimeError(f"no luck with {tile}")
        done.append((tile, rows.count()))

    box.arrive("a", "bad", "flaky")
    box.run(work)
    assert sorted(done) == [("a", 2), ("flaky", 2)] and tries == {"bad": 2, "flaky": 2}
    errors = {(r.tile, r.attempt): r.error for r in ingest.ledger(spark, box.book).where("status = 'failed'").collect()}
    assert errors == {("bad", 1): "RuntimeError: no luck with bad", ("bad", 2): "RuntimeError: no luck with bad", ("flaky", 1): "RuntimeError: no luck with flaky"}
    box.arrive("b", "a", "bad")
    box.run(work)
    # the new file of `bad` comes to a tile that isn't finished: both of its files count from now on
    assert sorted(done) == [("a", 2), ("b", 2), ("flaky", 2)] and tries["bad"] == 6
    assert box.latest() == {"a": ("ok", 1), "bad": ("failed", 6), "flaky": ("ok", 2), "b": ("ok", 1)}
    assert [r.tile for r in tiles.to_retry(ingest.ledger(spark, box.book), 7).collect()] == ["bad"]
    late = ingest.late_files(spark, box.book).collect()
    assert [r.tile for r in late] == ["a"] and "/tile=a/part-" in late[0].path
    mended.append(True)
    box.run(work)  # nothing new has arrived
    assert sorted(done) == [("a", 2), ("b", 2), ("bad", 4), ("flaky", 2)] and box.latest()["bad"] == ("ok", 7)
    box.run(work)
    assert len(done) == 4


def test_tiles_are_given_up_and_opened_again(spark, tmp_path):
    box, done = Inbox(spark, tmp_path), []

    def work(rows, tile):
        done.append((tile, rows.count()))
        if tile == "bad":
            raise RuntimeError(tile)

    box.arrive("a", "bad")
    for _ in range(3):
        box.run(work, max_attempts=1, give_up=2)
    assert done.count(("bad", 2)) == 2 and box.latest()["bad"] == ("failed", 2)
    box.arrive("a")
    box.run(work, max_attempts=1, give_up=2, reopen=True)
    assert done[-1] == ("a", 4) and box.latest()["a"] == ("ok", 2) and ingest.late_files(spark, box.book).count() == 0


def test_a_repeated_batch_repeats_no_finished_tile(spark, tmp_path):
    """A crash between a batch's work and its commit: the batch runs again, goes on, and takes its own files for no late ones."""
    box, done = Inbox(spark, tmp_path), []
    box.arrive("a", "b", "c")
    # what the first micro-batch had written when it was cut off
    files = spark.read.parquet(box.source).select("tile", F.col("_metadata.file_path").alias("path"))
    ingest.note_files(spark, files, box.book, "stream-0")
    ingest.record(spark, box.book, [("a", 1, "ok", None), ("b", 1, "ok", None)], "stream-0")
    box.run(lambda rows, tile: done.append((tile, rows.count())))
    assert done == [("c", 2)] and ingest.late_files(spark, box.book).count() == 0
    assert ingest.noted_files(spark, box.book).count() == 3


def test_failing_tiles_are_isolated_in_few_runs(spark, tmp_path):
    runs, out = [], {}

    def run(names):
        runs.append(list(names))
        if {"t013", "t050"} & set(names):
            raise ValueError(len(names))

    ingest.isolated([f"t{i:03}" for i in range(64)], run, lambda names, error: out.update(dict.fromkeys(names, error)))
    assert {n for n, e in out.items() if e} == {"t013", "t050"} and out["t013"] == "ValueError: 1" and len(out) == 64
    assert len(runs) <= 1 + 2 * 2 * 6
    ingest.isolated([], run, None)


def test_many_files_come_in_several_batches(spark, tmp_path):
    """A tile whose files fall in several micro-batches: it is worked on with what has arrived, and the rest is reported."""
    box, done = Inbox(spark, tmp_path), []
    box.arrive("a", "b", "a")
    box.run(lambda rows, tile: done.append((tile, rows.count())), max_files=1)
    assert sorted(done) == [("a", 2), ("b", 2)] and [r.tile for r in ingest.late_files(spark, box.book).collect()] == ["a"]
    box.run(lambda rows, tile: done.append((tile, rows.count())), max_files=1)
    assert len(done) == 2


def test_a_batch_of_tiles_is_one_job_and_replaces_what_it_wrote(spark, tmp_path):
    out, book = str(tmp_path / "out"), str(tmp_path / "ledger")
    batches, single = [], []

    def together(rows):
        sinks.save_tile_outputs(rows, out)
        batches.append(rows.count())
        if rows.where("tile = 'bad'").count():
            raise RuntimeError("after the write")

    def work(rows, tile):
        single.append(tile)
        if tile == "bad":
            raise RuntimeError(tile)
        sinks.save_tile_outputs(rows, out)

    rows = lambda *names: spark.createDataFrame([(n, t) for t in names for n in (1, 2)], "n int, tile string")
    assert ingest.process(spark, rows("a", "b"), book, work, together=together) == {"a": "ok", "b": "ok"}
    assert batches == [4] and single == []
    assert ingest.process(spark, rows("a", "c", "bad"), book, work, together=together) == {"bad": "failed", "c": "ok"}
    assert batches == [4, 4, 2, 2, 2] and single == []  # both, each half, and the failed one again
    assert spark.read.parquet(out).where("tile != 'bad'").count() == 6
    assert ingest.process(spark, rows("a"), book, work, together=together) == {}


def test_observed_counts(spark, tmp_path):
    rows, seen = ingest.observed(spark.createDataFrame([("a",), ("a",), ("b",)], "obj_key string"), "t1")
    rows.write.parquet(str(tmp_path / "o"))
    assert seen.get == {"voxels": 3, "objects": 2}
