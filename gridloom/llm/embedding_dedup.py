"""Near-duplicate vectors by an inverted multi-index.

Vectors are cut in halves, each half has its own codebook, and pairs of codewords form a grid of
cells. Every vector is filed in its nearest cell and looks for partners in the cells nearest to it,
in the order of a multi-sequence traversal over lower bounds of the distance to a cell's vectors; it
ends where the bound exceeds the distance of partners at the least cosine, so no link is lost.
Links are counted and gathered inside blocks, so that pairs never become rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import connected_components, stage


def unit(vectors) -> np.ndarray:
    """Vectors of length one; the largest component is made one first, so that no square over- or underflows."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, 4_000_000 // len(centres))  # bounds the table of distances
    return np.concatenate([squared(x[lo : lo + step], centres).argmin(1) for lo in range(0, len(x), step)])


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        order = np.argsort(near, kind="stable")
        held, starts, counts = np.unique(near[order], return_index=True, return_counts=True)
        centres[held] = np.add.reduceat(x[order], starts, axis=0) / counts[:, None]
    return centres


def traversal(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Cells of the product grid by increasing first[i] + second[j]: the multi-sequence algorithm."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        d, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j]), float(d)
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (first[a[p]] + second[b[q]], p, q))


#: Codewords whose borders are tried for a lower bound, the nearest to a vector first.
BORDERS = 8
#: Moving a row to a block costs about as much as comparing so many pairs.
PAIRS_A_ROW = 600
#: Rows of a block that are compared at once.
SLICE = 512


def border_bounds(d: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Squared lower bounds of the distance from each vector to the vectors filed under each codeword.

    `d` are the squared distances to the codewords, `apart` the distances between codewords. What is
    filed under i is not nearer to any k, so it lies beyond the plane halfway between the two.
    """
    out = np.zeros_like(d)
    for k in np.argsort(d, axis=1, kind="stable")[:, :BORDERS].T:
        gap = apart[k]
        np.maximum(out, np.where(gap > 1e-6, (d - np.take_along_axis(d, k[:, None], 1)) / (2 * np.maximum(gap, 1e-6)), 0), out=out)
    return out * out


class MultiIndex:
    """Codebooks of one vector length; every cell that may hold a vector within `reach` is searched."""

    def __init__(self, sample: np.ndarray, codewords: int, least_cosine: float):
        self.half = sample.shape[1] // 2
        self.one = k_means(sample[:, : self.half], codewords)
        self.two = k_means(sample[:, self.half :], codewords)
        # half the memory; rounded up, which only lowers bounds
        self.apart = [(np.sqrt(squared(c, c)) * (1 + 1e-6)).astype(np.float32) for c in (self.one, self.two)]
        self.reach = np.sqrt(max(0.0, 2 - 2 * least_cosine)) + 1e-6  # beyond rounding errors

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.one), squared(x[:, self.half :], self.two)

    def bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return border_bounds(a, self.apart[0]), border_bounds(b, self.apart[1])

    def within(self, x: np.ndarray) -> float:
        """The mean number of cells within reach."""
        first, second = self.bounds(*self.distances(x))
        return float(np.mean([np.searchsorted(np.sort(b), self.reach**2 - a, side="right").sum() for a, b in zip(first, second, strict=True)]))

    def nearest(self, x: np.ndarray) -> list[list[int]]:
        """For each vector the cells to search, its own first; of two cells within reach of each other's vectors one searches."""
        step = max(1, 2_000_000 // (len(self.one) + len(self.two)))  # bounds the tables of distances
        return [visited for lo in range(0, len(x), step) for visited in self._nearest(x[lo : lo + step])]

    def _nearest(self, x: np.ndarray) -> list[list[int]]:
        a, b = self.distances(x)
        homes = a.argmin(1) * len(self.two) + b.argmin(1)
        out = []
        for home, first, second in zip(homes.tolist(), *self.bounds(a, b), strict=True):
            visited = [home]
            for i, j, d in traversal(first, second):
                if d > self.reach**2:
                    break
                cell = i * len(self.two) + j
                if cell != home and (home < cell) == ((home + cell) % 2 == 0):
                    visited.append(cell)
            out.append(visited)
        return out


def effort(index: MultiIndex, sample: np.ndarray, n: int, block: int) -> float:
    """About the work of comparing `n` vectors like the sample, in pairs."""
    cells = len(index.one) * len(index.two)
    held = n / cells
    asked = held * (1 + index.within(sample)) / 2
    rows = held * np.ceil(asked / block) + asked * np.ceil(held / block)
    return cells * (rows * PAIRS_A_ROW + held * asked)


def build(distinct: DataFrame, least_cosine: float, sample_size: int, per_cell: int, block: int) -> dict[int, MultiIndex]:
    """An index for each vector length in a sample of the vectors with the least hashes.

    Codewords may grow with the root of the largest label's size, so that a cell holds about
    `per_cell` vectors at any size, and the sample with them: `sample_size` vectors, or eight a
    codeword where that is more. Fewer are taken where that saves work: where vectors fill many
    dimensions most cells are within reach of each other, and few cells, cut into blocks, move fewer
    rows. The choice changes no result.
    """
    largest = distinct.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    words = max(2, round((largest / per_cell) ** 0.5))
    rows = distinct.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(max(sample_size, 8 * words)).collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r["vector"]), []).append(r["vector"])
    out = {}
    for n, v in by_size.items():
        sample = unit(v)
        most = min(words, max(1, len(v) // 8))
        best = least = None
        for k in sorted({most, *(2**e for e in range(most.bit_length()) if 2**e < most)}):
            index = MultiIndex(sample, k, least_cosine)
            work = effort(index, sample[:500], largest, block)
            if least is not None and work > 2 * least:
                break  # more cells only move more rows from here on
            if least is None or work < least:
                best, least = index, work
        out[n] = best
    return out


def local_links(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between the searching and the filed vectors of one block: counts, and one anchor for each vector.

    Pairs are bits; all other tables are made for SLICE rows at a time.
    """
    none = pd.DataFrame({"id": [], "links": [], "anchor": []})
    q, m = group[group["searching"]], group[~group["searching"]]
    if not len(q) or not len(m):
        return none
    a, b = unit(q["vector"]), unit(m["vector"])
    qi, mi = q["id"].to_numpy(), m["id"].to_numpy()
    slices = lambda n: (slice(lo, lo + SLICE) for lo in range(0, n, SLICE))
    hit = np.concatenate([(a[s] @ b.T >= least) & (qi[s, None] != mi) for s in slices(len(q))])
    rows, cols = hit.any(1), hit.any(0)
    if not rows.any():
        return none
    hit, qi, mi = hit[rows][:, cols], qi[rows], mi[cols]
    q_home, m_home = q["home"].to_numpy()[rows], m["home"].to_numpy()[cols]
    q_copies, m_copies = q["copies"].to_numpy(dtype=np.float64)[rows], m["copies"].to_numpy(dtype=np.float64)[cols]
    links_q = np.concatenate([hit[s].astype(np.float64) @ m_copies for s in slices(len(qi))])
    # a filed vector of another cell doesn't search the other's own: it counts the link here
    links_m = sum(q_copies[s] @ (hit[s] & (q_home[s, None] != m_home)) for s in slices(len(qi)))
    label_q, label_m, high = qi.copy(), mi.copy(), np.iinfo(np.int64).max
    while True:
        new_q = np.concatenate([np.minimum(label_q[s], np.where(hit[s], label_m, high).min(1)) for s in slices(len(qi))])
        new_m = label_m.copy()
        for s in slices(len(qi)):
            np.minimum(new_m, np.where(hit[s], new_q[s, None], high).min(0), out=new_m)
        if (new_q == label_q).all() and (new_m == label_m).all():
            break
        label_q, label_m = new_q, new_m
    return pd.DataFrame({"id": np.concatenate([qi, mi]), "links": np.concatenate([links_q, links_m]).round().astype(np.int64), "anchor": np.concatenate([label_q, label_m])})


def link(vectors: DataFrame, least_cosine: float = 0.98, sample_size: int = 4096, per_cell: int = 64, block: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each input row.

    Vectors are compared where labels and lengths are equal and the label isn't null. Null, zero or
    empty vectors and those with null or non-finite components link with nothing, nor does a null id.
    Equal vectors of a label are one class with a count: copies aren't expanded into pairs, and
    n_links counts every other row that links directly. component_id is the least id reachable.

    A cell's vectors and those that search it are dealt into blocks of about `block` each, and every
    pair of blocks is one group: a dense cell makes more groups, not larger ones. Repeated rows count
    as copies; further columns, whatever their names, are ignored; an empty table gives no rows.
    Components of any finite size will do, as lengths are taken after scaling.
    """
    value = F.col(embedding)
    odd = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = value.isNotNull() & F.col(label).isNotNull() & F.col(vec_id).isNotNull() & ~odd & F.exists(value, lambda x: x != 0)
    keyed = vectors.select(
        F.col(vec_id).cast("long").alias("id"), value.alias("vector"), F.col(label).cast("string").alias("label"), F.coalesce(good, F.lit(False)).alias("good"),
        F.xxhash64(label, value).alias("k1"), F.xxhash64(F.lit(1), value, label).alias("k2"),
    )
    rows = keyed.where("good")
    classes = stage(rows.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")).withColumn("size", F.size("vector")), "vectors")
    index = build(classes, least_cosine, sample_size, per_cell, block)
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # about 160 MB at a billion vectors a label: 4,000 codewords a half, and their distances

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            visits = [[0]] * len(batch)
            for n, part in batch.groupby("size"):
                if n in shared.value:
                    for i, v in zip(np.flatnonzero(batch["size"] == n), shared.value[n].nearest(unit(part["vector"])), strict=True):
                        visits[i] = v
            yield batch[["id", "copies", "label", "size", "vector"]].assign(cell=[v[0] for v in visits], visits=visits)

    kind = classes.schema["vector"].dataType.simpleString()
    filed = stage(classes.select("id", "copies", "label", "size", "vector").mapInPandas(file, f"id long, copies long, label string, size int, vector {kind}, cell int, visits array<int>"), "cells")
    spot = ["label", "size", "cell"]
    held = filed.groupBy(*spot).agg(F.count("*").alias("n"))
    asked = filed.select("label", "size", F.explode("visits").alias("cell")).groupBy(*spot).agg(F.count("*").alias("m"))
    blocks = held.join(asked, spot).select(*spot, F.ceil(F.col("n") / block).cast("int").alias("held_blocks"), F.ceil(F.col("m") / block).cast("int").alias("asked_blocks"))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    common = ["id", "copies", "vector", "home"]
    wide = filed.withColumn("home", F.col("cell"))
    members = wide.join(blocks, spot).select(*spot, *common, deal("held_blocks").alias("b"), every("asked_blocks").alias("c"), F.lit(False).alias("searching"))
    seekers = wide.drop("cell").withColumn("cell", F.explode("visits")).join(blocks, spot).select(*spot, *common, every("held_blocks").alias("b"), deal("asked_blocks").alias("c"), F.lit(True).alias("searching"))
    groups = members.unionByName(seekers).select("id", "copies", "vector", "searching", "home", F.struct(*spot, "b", "c").alias("at"))
    found = stage(groups.groupBy("at").applyInPandas(lambda g: local_links(g, least_cosine), "id long, links long, anchor long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("src"), F.col("anchor").alias("dst")))
    each = classes.select("k1", "k2", F.col("id").alias("first"), "copies").join(links.withColumnRenamed("id", "first"), "first", "left").join(parts.withColumnRenamed("node", "first"), "first", "left")
    every_row = keyed.drop("vector", "label").join(each.select("k1", "k2", "first", "copies", "links", "component").withColumn("good", F.lit(True)), ["k1", "k2", "good"], "left")
    n_links = F.when(F.col("good"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long")
    component = F.coalesce("component", "first", "id")
    return every_row.select(F.col("id").alias("vec_id"), n_links.alias("n_links"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
