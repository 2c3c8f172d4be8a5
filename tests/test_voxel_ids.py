"""Voxel ids that collide: offsets predicted from sizes against all pairs of cells."""

import itertools

import pytest
from pyspark.sql import functions as F

from gridloom.functions import expressions as X
from gridloom.operators import voxels


def brute_offsets(factors, grid):
    """Offsets between cells of a whole grid with equal positions, each once."""
    weights = [f * w for f, w in zip(factors, X.POSITION_WEIGHTS, strict=True)]
    spans = [range(-(n - 1), n) for n in grid]
    found = {d for d in itertools.product(*spans) if any(d) and sum(w * x for w, x in zip(weights, d, strict=True)) == 0}
    return {d for d in found if next(x for x in d if x) > 0}


@pytest.mark.parametrize(
    ("sizes", "grid"),
    [((1, 1, 1), (2, 3, 1002)), ((1, 1, 4), (2, 5, 600)), ((1, 3, 2), (1, 4, 2048)), ((1, 60, 1), (2, 2048, 3)), ((1, 50.0, 1), (2, 2001, 1)), ((0, 1, 1), (3, 2, 4)), ((1, 1, 1), (8, 8, 8)), ((1, 1, 1), (1, 1, 1)), ((1, 1, 1), (0, 4, 4))],
)
def test_offsets_equal_all_pairs(spark, sizes, grid):
    shape = spark.createDataFrame([(*map(float, sizes), *grid)], "sx double, sy double, sz double, gx int, gy int, gz int")
    factors = shape.select(*[f.alias(a) for a, f in zip("xyz", X.position_factors(F.col("sx"), F.col("sy"), F.col("sz")), strict=True)]).first()
    got = [(r.dx, r.dy, r.dz) for r in voxels.colliding_offsets(shape).collect()]
    if grid[1] > 1000:  # too many offsets to try: those of each dx and dy alone
        weights = [f * w for f, w in zip(factors, X.POSITION_WEIGHTS, strict=True)]
        expected = set()
        for dx, dy in itertools.product(range(grid[0]), range(-(grid[1] - 1), grid[1])):
            dz = -(weights[0] * dx + weights[1] * dy) / weights[2]
            if dz == int(dz) and abs(dz) < grid[2] and (dx, dy) > (0, 0):
                expected.add((dx, dy, int(dz)))
    else:
        expected = brute_offsets(factors, grid)
    assert len(got) == len(set(got)) and set(got) == expected


def test_pairs_equal_equal_positions(spark):
    """Random cells of three objects, one without any offset: pairs by offset are the pairs by position."""
    cells = spark.range(4000).select(
        (F.col("id") % 3).cast("string").alias("obj_key"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int").alias("ix"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(6)).cast("int").alias("iy"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2048)).cast("int").alias("iz")
    ).distinct()
    shapes = spark.createDataFrame([("0", 1.0, 1.0, 1.0), ("1", 1.0, 1.0, 2.0), ("2", 1.0, 100.0, 1.0)], "obj_key string, sx double, sy double, sz double").withColumns({f"g{a}": F.lit(2048) for a in "xyz"})
    offsets = voxels.colliding_offsets(shapes).where("dx = 0")
    placed = cells.join(shapes, "obj_key").withColumn("p", X.voxel_position(*[F.col(c) for c in ("ix", "iy", "iz", "sx", "sy", "sz")]))
    by_position = placed.groupBy("obj_key", "p").agg(F.count("*").alias("n")).groupBy("obj_key").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n")).where("n > 0")
    by_offset = voxels.colliding_pairs(cells, offsets).groupBy("obj_key").count()
    assert {tuple(r) for r in by_position.collect()} == {tuple(r) for r in by_offset.collect()} and by_offset.count() == 2
