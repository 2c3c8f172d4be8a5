"""Voxelizers: points to cells, and triangles to all cells whose closed box they meet.

A grid is a cube of side `scale` with `grid` cells an axis. Inside, coordinates are in cells, so a
cell is the box from its index to its index + 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import expressions as X
from gridloom.operators.keys import object_key
from gridloom.sources import shared


def cell_index(x: Column, origin: Column, size: Column, grid: Column) -> Column:
    """floor((x - origin) / size), held inside the grid; a grid without extent has the one index 0."""
    at = F.coalesce(F.floor(F.try_divide(x - origin, size)), F.lit(0))
    return F.least(F.greatest(at, F.lit(0)), grid - 1).cast("int")


def voxelize_points(vertices: DataFrame, grids: DataFrame) -> DataFrame:
    """(obj_key, ix, iy, iz, points): cells that hold a vertex. `grids` has obj_key, grid, scale, ox, oy, oz."""
    key = object_key(vertices, grids)
    placed = vertices.join(grids, key)
    size = X.voxel_size(F.col("scale"), F.col("grid"))
    cells = placed.select(*key, *[cell_index(F.col(a), F.col(f"o{a}"), size, F.col("grid")).alias(f"i{a}") for a in "xyz"])
    return cells.groupBy(*key, "ix", "iy", "iz").agg(F.count("*").alias("points"))


#: Lines of one stretch where a table tells only their number.
BLOCK_LINES = 100_000


def _drawn(lines: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Vertex and face lines with their block, the vertex lines before each block, and the key of a block.

    Two levels, as for runs: blocks of an object get the prefix of their counts in a window of one row a
    block, lines get theirs inside their block. No window holds a whole large mesh.
    """
    key = object_key(lines)
    block = F.col("block") if "block" in lines.columns else F.call_function("div", F.col("line_no").cast("long"), F.lit(BLOCK_LINES))
    own = lines.withColumn("block", block).withColumn("is_vertex", F.col("line").startswith("v ")).where(F.col("is_vertex") | F.col("line").startswith("f "))
    counts = own.groupBy(*key, "block").agg(F.count_if("is_vertex").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return own, counts.select(*key, "block", before.alias("before")), [*key, "block"]


def faces(lines: DataFrame) -> DataFrame:
    """(obj_key, a, b, c) vertex numbers from 1 of `f` lines: fans of longer faces; `a/b/c` keeps a; negative numbers count back.

    `lines` has obj_key, line_no and line, and may have a block: lines of an object are then in order of
    block and line_no. Vertex lines before a face are counted in its block and in the blocks before.
    """
    own, before, at = _drawn(lines)
    inside = F.sum(F.col("is_vertex").cast("int")).over(W.partitionBy(*at).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    own = own.withColumn("inside", inside).where("not is_vertex").join(before, at).withColumn("seen", F.col("before") + F.col("inside"))
    tokens = F.filter(F.split(F.substring("line", 3, 2**31 - 1), "[ \\t\\r\\f]+"), lambda t: t != "")
    numbers = F.transform(tokens, lambda t: F.substring_index(t, "/", 1).try_cast("long"))
    key = at[:-1]
    found = own.select(*key, F.transform(numbers, lambda n: F.when(n < 0, F.col("seen") + 1 + n).otherwise(n)).alias("n")).where("size(n) >= 3")
    return found.select(*key, F.col("n")[0].alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.size("n") - 2), lambda i: F.struct(F.get("n", i).alias("b"), F.get("n", i + 1).alias("c")))).alias("t")).select(*key, "a", "t.b", "t.c").where("a is not null and b is not null and c is not null")


def vertex_numbers(lines: DataFrame) -> DataFrame:
    """(obj_key, vertex_no from 1, x, y, z): lines that can't be read keep their number. `lines` as in faces()."""
    from gridloom.operators import mesh

    own, before, at = _drawn(lines)
    place = F.row_number().over(W.partitionBy(*at).orderBy("line_no"))
    numbered = own.where("is_vertex").withColumn("inside", place).join(before, at).select(*at[:-1], "line", (F.col("before") + F.col("inside")).alias("vertex_no"))
    return mesh.parse_vertices(numbered).select(*at[:-1], "vertex_no", "x", "y", "z")


def triangles_of_faces(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles with coordinates: `vertices` has obj_key, vertex_no from 1, x, y, z."""
    key = object_key(vertices, triangles)
    out = triangles
    for k, corner in enumerate("abc"):
        own = vertices.select(*key, F.col("vertex_no").alias(corner), *[F.col(a).alias(f"{a}{k}") for a in "xyz"])
        out = out.join(own, [*key, corner])
    return out.select(*key, *[f"{a}{k}" for k in range(3) for a in "xyz"])


def _span(low: Column, high: Column, grid: Column) -> tuple[Column, Column]:
    """First and last cell whose closed range meets [low, high]; a value on a border meets both sides."""
    last = grid.cast("long") - 1
    hold = lambda c: F.least(F.greatest(c, F.lit(0).cast("long")), last)
    return hold(F.ceil(low) - 1), hold(F.floor(high))


#: Columns of cells, and then candidates, that a task tests at once.
AT_ONCE = 1 << 18


def _stretches(counts: np.ndarray) -> Iterator[slice]:
    """Slices of consecutive rows with at most AT_ONCE counts each; one row alone may have more."""
    ends, lo = np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, side="right")))
        yield slice(lo, hi)
        lo = hi


def _repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as often as its count, and the place of each copy among those of its row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _overlaps(corners: list[np.ndarray], edges: list[np.ndarray], normal: np.ndarray, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Places of the candidates (triangle `row`, cell (u, v, w)) that pass the separating-axis test: the normal and nine edge products.

    The three box axes are settled by the ranges that candidates come from.
    """
    slack = 1e-9
    size = (np.abs(normal[0]) + np.abs(normal[1]) + np.abs(normal[2])) * 0.5 + slack
    p = corners[0][:, row] - (cell + 0.5)
    n = normal[:, row]
    kept = np.flatnonzero(np.abs(n[0] * p[0] + n[1] * p[1] + n[2] * p[2]) <= size[row])
    for k in range(3):
        for i in range(3):
            j, m = (i + 1) % 3, (i + 2) % 3
            # axis i crossed with edge k lies in the plane of j and m; both ends of the edge fall on one point there
            own, at = row[kept], cell[:, kept] + 0.5
            ej, em = edges[k][j][own], edges[k][m][own]
            one, other = ((corners[c][m][own] - at[m]) * ej - (corners[c][j][own] - at[j]) * em for c in (k, (k + 2) % 3))
            radius = (np.abs(ej) + np.abs(em)) * 0.5 + slack
            kept = kept[(np.minimum(one, other) <= radius) & (np.maximum(one, other) >= -radius)]
    return kept


def _cells_of(t: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, cells): the cells that triangles meet, in bounded stretches. `t` has u0 .. w2, the spans u_from .. w_to and grid."""
    corners = [np.stack([t[f"{a}{k}"] for a in "uvw"]) for k in range(3)]
    edges = [corners[(k + 1) % 3] - corners[k] for k in range(3)]
    e, f = edges[0], edges[1]
    normal = np.stack([e[1] * f[2] - e[2] * f[1], e[2] * f[0] - e[0] * f[2], e[0] * f[1] - e[1] * f[0]])
    wide = t["v_to"] - t["v_from"] + 1
    columns = (t["u_to"] - t["u_from"] + 1) * wide

    def held(cells: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.clip(np.nan_to_num(cells, nan=0.0), 0, t["grid"][row] - 1).astype(np.int64)

    for part in _stretches(columns):
        row, place = _repeated(columns[part])
        row = row + part.start
        u, v = t["u_from"][row] + place // wide[row], t["v_from"][row] + place % wide[row]
        n = normal[:, row]
        flat = n[2] == 0
        with np.errstate(all="ignore"):
            at = corners[0][2][row] - (n[0] * (u + 0.5 - corners[0][0][row]) + n[1] * (v + 0.5 - corners[0][1][row])) / n[2]
            reach = (np.abs(n[0]) + np.abs(n[1])) / (np.abs(n[2]) * 2) + 1e-6
            low, high = held(np.ceil(at - reach) - 1, row), held(np.floor(at + reach), row)
        low = np.where(flat, t["w_from"][row], np.maximum(low, t["w_from"][row]))
        high = np.where(flat, t["w_to"][row], np.minimum(high, t["w_to"][row]))
        deep = np.maximum(high - low + 1, 0)
        for some in _stretches(deep):
            column, step = _repeated(deep[some])
            column = column + some.start
            cell = np.stack([u[column], v[column], low[column] + step])
            kept = _overlaps(corners, edges, normal, row[column], cell)
            if len(kept):
                yield row[column[kept]], cell[:, kept]


def _hits(key: list[str]):
    """Batches of laid-out triangles to batches of the cells that they meet, axes turned back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in key}
            for row, (u, v, w) in _cells_of(t):
                depth = t["depth"][row]
                turned = [np.select([depth == 2, depth == 1], [one, two], three).astype(np.int32) for one, two, three in ((u, v, w), (v, w, u), (w, u, v))]
                own = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(own) for c in key], *map(pa.array, turned)], names=[*key, "ix", "iy", "iz"])

    return run


def voxelize_surface(triangles: DataFrame, grids: DataFrame, split_above: int = 65_536) -> DataFrame:
    """(obj_key, ix, iy, iz): cells whose closed box meets a triangle (obj_key, x0 .. z2). Each cell once.

    Candidates: the two axes along which the triangle shows its largest face are swept, and along
    the third only the stretch that the plane passes in each column of cells. A triangle without
    area sweeps its whole box. One with more than `split_above` columns is dealt out by stripes
    first, so a huge triangle isn't one task's work. Grids without extent have the one cell 0, 0, 0.
    Triangles with a NaN or infinite corner, and objects without grid, give nothing.
    """
    key = object_key(triangles, grids)
    joined = triangles.join(grids, key)
    size = F.col("scale") / F.col("grid")
    flat = joined.where("not scale > 0").select(*key, *[F.lit(0).alias(f"i{a}") for a in "xyz"]).distinct()
    names = [f"{a}{k}" for k in range(3) for a in "xyz"]
    cells = joined.where("scale > 0").select(*key, "grid", *[((F.col(f"{a}{k}") - F.col(f"o{a}")) / size).alias(f"{a}{k}") for k in range(3) for a in "xyz"])
    finite = F.lit(True)
    for c in names:
        finite = finite & ~F.isnan(c) & (F.abs(F.col(c)) < 1e15)
    cells = cells.where(finite)
    edge = lambda a, k, m: F.col(f"{a}{k}") - F.col(f"{a}{m}")
    cross = lambda a, b: edge(a, 1, 0) * edge(b, 2, 1) - edge(b, 1, 0) * edge(a, 2, 1)
    cells = cells.withColumns({"nx": F.abs(cross("y", "z")), "ny": F.abs(cross("z", "x")), "nz": F.abs(cross("x", "y"))})
    depth = F.when((F.col("nz") >= F.col("nx")) & (F.col("nz") >= F.col("ny")), 2).when(F.col("ny") >= F.col("nx"), 1).otherwise(0)
    cells = cells.withColumn("depth", depth)
    # u, v, w: the axes in cyclic order, w being the depth
    turned = lambda k, i: F.when(F.col("depth") == 2, F.col(f"{'xyz'[i]}{k}")).when(F.col("depth") == 1, F.col(f"{'zxy'[i]}{k}")).otherwise(F.col(f"{'yzx'[i]}{k}"))
    # one struct through a generator: later filters then don't repeat all this arithmetic
    laid = F.struct(*[turned(k, i).alias(f"{a}{k}") for k in range(3) for i, a in enumerate("uvw")])
    own = cells.select(*key, "grid", "depth", F.inline(F.array(laid)))
    grid = F.col("grid")
    spans = {}
    for a in "uvw":
        three = [F.col(f"{a}{k}") for k in range(3)]
        spans |= dict(zip((f"{a}_from", f"{a}_to"), _span(F.least(*three), F.greatest(*three), grid), strict=True))
    own = own.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in spans.items()]))))
    # few bytes of triangles become many candidates: they are dealt out to a number of tasks that grows with the files, which isn't merged again
    tasks = max(int(triangles.sparkSession.conf.get("spark.sql.shuffle.partitions")), shared.tasks_for(triangles))
    own = own.repartition(tasks, *key, *[f"{a}{k}" for k in range(3) for a in "uvw"])
    columns = (F.col("u_to") - F.col("u_from") + 1) * (F.col("v_to") - F.col("v_from") + 1)
    stripes = own.where(columns > split_above).withColumn("u_from", F.explode(F.sequence("u_from", "u_to"))).withColumn("u_to", F.col("u_from"))
    large = stripes.repartition(*key, "u_from", *[f"{a}{k}" for k in range(3) for a in "uvw"])
    types = dict(own.dtypes)
    hit = own.where(columns <= split_above).unionByName(large).mapInArrow(_hits(key), ", ".join([*[f"`{c}` {types[c]}" for c in key], "ix int, iy int, iz int"]))
    return hit.distinct().unionByName(flat)
