"""Clustered voxel files: pruning by manifest, hot cells, and the curve itself."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.sources import layout


def interleaved(x, y, z):
    return sum(((v >> k) & 1) << (3 * k + i) for i, v in enumerate((x, y, z)) for k in range(21))


def test_places_interleave_the_bits(spark):
    rng, half = random.Random(1), 1 << 20
    rows = [tuple(rng.uniform(-3e6, 3e6) for _ in range(3)) for _ in range(200)] + [(0.0, 0.0, 0.0), (-1e12, 1e12, -0.001), (float("nan"), None, 5.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    cell = lambda v: 0 if v is None or v != v else min(max(int(v // 2.0) + half, 0), 2 * half - 1)
    assert [r.p for r in df.select(layout.curve_position(2.0).alias("p")).collect()] == [interleaved(*map(cell, r)) for r in rows]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """60,000 rows in a 100 x 100 x 20 room, a third of them in one cell, buildings apart from each other."""
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_000)) / 1e6)
    hot = F.col("id") % 3 == 0
    rows = spark.range(60_000).select(
        "id", F.when(hot, 50 + u(1)).otherwise(u(1) * 100).alias("x"), F.when(hot, 50 + u(2)).otherwise(u(2) * 100).alias("y"), F.when(hot, 5 + u(3)).otherwise(u(3) * 20).alias("z")
    ).withColumn("building_gmlid", F.concat_ws(".", F.floor(F.col("x") / 10), F.floor(F.col("y") / 10)))
    path = str(tmp_path_factory.mktemp("layout") / "v")
    layout.write_clustered(rows, path, size=4.0, rows_per_file=1000)
    return rows, path


def test_files_are_bounded_and_a_hot_cell_is_split(spark, clustered):
    rows, path = clustered
    boxes = spark.read.parquet(f"{path}/boxes")
    assert boxes.agg(F.sum("rows"), F.max("rows")).first()[0] == 60_000 and boxes.agg(F.max("rows")).first()[0] <= 1000
    inside = boxes.where("xmin >= 48 and xmax < 52 and ymin >= 48 and ymax < 52").count()
    assert inside >= 15  # 20,000 rows of one cell


def test_boxes_read_few_files(spark, clustered):
    rows, path = clustered
    total = spark.read.parquet(f"{path}/boxes").count()
    for low, high, share in (((10.0, 10.0, 0.0), (18.0, 18.0, 20.0), 0.2), ((50.2, 50.2, 5.1), (50.3, 50.3, 5.9), 0.3), ((0.0, 0.0, 0.0), (100.0, 100.0, 20.0), 1.0)):
        got = layout.read_box(spark, path, low, high)
        expected = rows.where(F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1]) & F.col("z").between(low[2], high[2]))
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in expected.collect()) and got.count()
        assert len(got.inputFiles()) <= share * total
        assert layout.count_in_box(spark, path, low, high) == expected.count()
    none = layout.read_box(spark, path, (200.0, 0.0, 0.0), (300.0, 1.0, 1.0))
    assert none.count() == 0 and none.columns == rows.columns and layout.count_in_box(spark, path, (200.0, 0.0, 0.0), (300.0, 1.0, 1.0)) == 0


def test_ids_read_the_files_that_hold_them(spark, clustered):
    rows, path = clustered
    total = spark.read.parquet(f"{path}/boxes").count()
    got = layout.read_id(spark, path, "building_gmlid", "2.7")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in rows.where("building_gmlid = '2.7'").collect())
    assert 0 < len(got.inputFiles()) <= 0.2 * total
    assert layout.read_id(spark, path, "building_gmlid", "nowhere").count() == 0


def test_without_a_manifest_nothing_is_read(spark, clustered, tmp_path):
    rows, _ = clustered
    rows.limit(10).write.parquet(str(tmp_path / "cut" / "data"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        layout.read_box(spark, str(tmp_path / "cut"), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0))


def test_empty_table(spark, clustered, tmp_path):
    rows, _ = clustered
    layout.write_clustered(rows.limit(0), str(tmp_path / "none"))
    assert layout.read_box(spark, str(tmp_path / "none"), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)).count() == 0
