"""Tasks grow in number, and not in size, with the files that are read."""

from pyspark.sql import functions as F

from gridloom.plans import catalogue, jobs
from gridloom.sources import shared


def points(spark, path, n):
    rows = spark.range(n).select(F.concat(F.lit("part_"), F.col("id") % 7).alias("obj_key"), F.rand(1).alias("x"), F.rand(2).alias("y"), F.rand(3).alias("z"))
    rows.coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def side(spark):
    return spark.createDataFrame([("part_1", "b", "c", "p", "RoofSurface", None)], "obj_key string, building_id string, class_gml_id string, polygon_gml_id string, thematic_role string, class string")


def test_tasks_follow_the_files(spark, tmp_path, monkeypatch):
    small, large = points(spark, f"{tmp_path}/a b", 2_000), points(spark, f"{tmp_path}/c", 40_000)
    few, many = (shared.tasks_for(p, 1 << 12) for p in (small, large))
    assert 8 * few < many
    assert shared.tasks_for(spark.range(3)) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(shared, "tasks_for", lambda rows: many)
    assert jobs.voxels_of_points(large, side(spark), 0.1).rdd.getNumPartitions() == many


def test_halves_are_made_in_one_pass(spark):
    plan = catalogue.voxels_all_tiles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan


def test_cells_of_a_triangle_come_in_stretches(monkeypatch):
    """However many candidates are tested at once, the cells are the same, and few are at hand at a time."""
    import numpy as np

    from gridloom.operators import voxelize

    rng = np.random.default_rng(0)
    t = {f"{a}{k}": rng.uniform(0, 17, 20) for k in range(3) for a in "uvw"}
    for a in "uvw":
        three = np.stack([t[f"{a}{k}"] for k in range(3)])
        t[f"{a}_from"], t[f"{a}_to"] = (np.clip(f, 0, 16).astype(int) for f in (np.ceil(three.min(0)) - 1, np.floor(three.max(0))))
    t["grid"] = np.full(20, 17)
    cells = lambda: [(len(row), {(r, *c) for r, c in zip(row.tolist(), cell.T.tolist(), strict=True)}) for row, cell in voxelize._cells_of(t)]
    whole = cells()
    monkeypatch.setattr(voxelize, "AT_ONCE", 50)
    parts = cells()
    assert len(whole) == 1 and len(parts) > 20 and max(n for n, _ in parts) <= 50
    assert set().union(*(s for _, s in parts)) == whole[0][1] and sum(n for n, _ in parts) == whole[0][0]


def test_clustered_files_are_cut_into_ranges_by_the_input(spark, tmp_path, monkeypatch):
    from gridloom.sources import layout

    monkeypatch.setattr(shared, "tasks_for", lambda rows: 9)
    rows = spark.range(900).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"))
    layout.write_clustered(rows, f"{tmp_path}/v")
    held = spark.read.parquet(f"{tmp_path}/v/boxes")
    assert held.count() > 4 and held.agg(F.sum("rows")).first()[0] == 900


def test_rows_of_a_hot_key_stay_apart(spark):
    """Rows of a key that most rows have, and rows without a key, never meet in one task; the result is that of a plain join."""
    from gridloom.operators import tables

    n = F.col("id")
    key = F.when(n % 4 < 2, "lost").when(n % 4 == 2, F.concat(F.lit("k"), n % 90)).when(n % 8 == 3, "there")
    rows = spark.range(4000).select(n, key.alias("gmlid")).repartition(4)
    keys = spark.createDataFrame([("there",), (None,), *[(f"k{i}",) for i in range(0, 90, 3)]], "gmlid string")
    plain = {r.id for r in rows.join(keys, "gmlid", "left_anti").collect()}
    for hot_rows in (1, 400, 10_000):
        assert sorted(r.id for r in tables.without_keys(rows, keys.unionByName(keys), "gmlid", hot_rows).collect()) == sorted(plain)
    left = tables.without_keys(rows, keys, "gmlid", 400)
    places = left.where("gmlid = 'lost' or gmlid is null").groupBy("gmlid", F.spark_partition_id().alias("at")).count().collect()
    assert {r.gmlid for r in places} == {"lost", None} and all(sum(p.gmlid == g for p in places) == 4 for g in ("lost", None))
    assert {r.id for r in tables.foreign_key_violations(rows, keys).collect()} == {r.id for r in rows.where("gmlid is not null").join(keys, "gmlid", "left_anti").collect()}
