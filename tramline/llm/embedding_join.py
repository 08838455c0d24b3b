"""Embedding near-dedup: an exact metric range join over pivot cells.

Unit vectors u, v have cosine >= t just where their distance is at most r = sqrt(2 - 2t). Each vector has its home in
the cell of its nearest pivot. By the triangle inequality a vector v can have a partner at home in cell j only if its
distance to the border between its own pivot p_i and p_j is at most r; for points of a Euclidean space that distance
is (|v - p_j|^2 - |v - p_i|^2) / (2 |p_i - p_j|), which is sharper than the bound |v - p_j| <= |v - p_i| + 2 r. Such
vectors are replicated to cell j, and then every cell finds all partners of the vectors at home in it by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.graph import connected_components
from tramline.llm.shared import discard, materialise, read_table

THRESHOLD = 0.95
#: Vectors at home in a block at most, on average; a cell with more is dealt out over several blocks.
BLOCK = 8_192
#: Vectors for each pivot, pivots at most, and rows of the sample that pivots are chosen from.
PER_PIVOT, MAX_PIVOTS, SAMPLE = 4_096, 1_024, 4_096
#: Slack of the bounds against rounding.
_EPS = 1e-6


def _usable() -> Column:
    """Whether ``v`` is not null and not empty, its components are finite and one isn't zero."""
    return F.expr("coalesce(size(v) > 0 AND forall(v, x -> x IS NOT NULL AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0), false)")


def _units(column: pa.Array) -> np.ndarray:
    """Usable vectors of one length as unit vectors in double precision."""
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True, initial=0)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, count: int, threshold: float = THRESHOLD) -> np.ndarray:
    """The first rows of a random sample, so dense regions get more; none that would link with one before it."""
    picked: list[int] = []
    for i in range(len(sample)):
        if len(picked) == count:
            break
        if not picked or (sample[picked] @ sample[i]).max() < threshold:
            picked.append(i)
    return sample[picked]


def cells_of(units: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each vector, matrix of which cells a vector goes to, home included)."""
    cosines = units @ pivots.T
    home = cosines.argmax(axis=1)
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    ahead = np.take_along_axis(cosines, home[:, None], 1) - cosines
    radius = np.sqrt(max(0.0, 2 - 2 * threshold))
    goes = ahead <= (radius + _EPS) * between + _EPS
    goes[np.arange(len(units)), home] = True
    return home, goes


def _sends(a: Column, b: Column) -> Column:
    """Of two different blocks just one sends its vectors to the other; half of a block's partners do, half get them."""
    return (a < b) == ((a + b) % 2 == 0)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK, per_pivot: int = PER_PIVOT, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """Per row of ``vectors``: id (long), ``n_links`` (other rows at cosine >= ``threshold``) and ``component_id``.

    Vectors that are null, zero or with null or non-finite components link with nothing; those of one length are
    compared with each other only. Ids are taken to be unique; rows that repeat an id each count as a vector, and
    ``n_links`` is the largest of the rows'. Rows with a null id link with nothing. An empty table gives an empty
    table; other columns are not read.

    Plan: equal vectors are first reduced to one with their number (128-bit hashes, summed on the map side). A length's
    pivots come from a bounded sample of its vectors (few vectors need no sample, as any one pivot will do); its
    cells have numbers of their own, and all lengths share the passes. The lengths and the cells' sizes (one row a
    length, one a cell) reach the driver; vectors are dealt to blocks of about ``block`` home vectors, and of two blocks
    whose cells may share a link one sends its vectors to the other. A block's home vectors come first in its sorted
    rows and the rest stream past them, so memory is bounded and a hot cell is many blocks. Within a block, vectors
    whose angles to the pivot differ too much aren't compared. Each pair of vectors meets once, so links are sums of
    what blocks count; edges only span what a block has linked, so a dense group of m vectors gives O(m) edges a block.
    """
    data = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    usable = data.where(F.col("id").isNotNull() & _usable()).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    distinct = materialise(usable.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("v").alias("v")), "distinct-vectors")
    counts = {r.dim: r.n for r in distinct.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    pivots, first, cells = {}, {}, 0
    for dim, count in sorted(counts.items()):
        wanted = max(1, min(max_pivots, -(-count // per_pivot)))
        pivots[dim] = np.eye(1, dim)
        if wanted > 1:
            sample = distinct.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
            pivots[dim] = choose_pivots(_units(sample), wanted, threshold)
        first[dim], cells = cells, cells + len(pivots[dim])
    if not pivots:
        return data.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kind = dict(data.dtypes)["v"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2))
            for dim in pc.unique(sizes).to_pylist():
                part = batch.filter(pc.equal(sizes, dim))
                home, goes = cells_of(_units(part.column(2)), pivots[dim], threshold)
                away = [(np.flatnonzero(g) + first[dim]).tolist() for g in goes]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(home + first[dim], pa.int32()), pa.array(away, pa.list_(pa.int32())), part.column(2)], ["id", "n", "home", "cells", "v"])

    dealt = materialise(distinct.select("id", "n", "v").mapInArrow(assign, f"id long, n long, home int, cells array<int>, v {kind}"), "pivot-cells")
    sizes = {r.home: r.n for r in dealt.groupBy("home").agg(F.count("*").alias("n")).collect()}
    split = [-(-sizes.get(c, 0) // block) for c in range(cells)]
    ends = np.cumsum(split).tolist()
    cell_of = [c for c, k in enumerate(split) for _ in range(k)]
    n_blocks = len(cell_of)
    begin, number = (F.array(*map(F.lit, x)) for x in ([e - k for e, k in zip(ends, split, strict=True)], split))
    placed = dealt.withColumn("block", (F.get(begin, "home") + F.pmod(F.xxhash64("id"), F.get(number, "home"))).cast("int"))
    at_home = placed.select("block", F.lit(0).alias("role"), "id", "n", "v")
    blocks = F.flatten(F.transform(F.filter("cells", lambda c: F.get(number, c) > 0), lambda c: F.sequence(F.get(begin, c), F.get(begin, c) + F.get(number, c) - 1)))
    guests = placed.select(F.explode(F.filter(blocks, lambda b: (b != F.col("block")) & _sends(F.col("block"), b))).alias("block"), F.lit(1).alias("role"), "id", "n", "v")
    ordered = at_home.unionByName(guests).repartition(n_blocks, "block").sortWithinPartitions("block", "role", "id")
    centre = [pivots[dim][c - first[dim]] for dim in sorted(first) for c in range(first[dim], first[dim] + len(pivots[dim]))]
    reach = float(np.arccos(min(1.0, threshold))) + _EPS

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, home = None, [], None
        for batch in batches:
            key, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.diff(key) | np.diff(role)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                part = batch.slice(s, e - s)
                ids, times, units = part.column(2).to_numpy(), part.column(3).to_numpy(), _units(part.column(4))
                if key[s] != now:
                    if now is not None:
                        yield from (home or _Home(waiting, pivot, threshold, reach)).finish()
                    now, waiting, home, pivot = key[s], [], None, centre[cell_of[key[s]]]
                if role[s] == 0:
                    waiting.append((ids, times, units))
                    continue
                home = home or _Home(waiting, pivot, threshold, reach)
                yield from home.meet(ids, times, units)
        if now is not None:
            yield from (home or _Home(waiting, pivot, threshold, reach)).finish()

    found = materialise(ordered.mapInArrow(compare, "id long, n_links long, u long, v long"), "links")
    links = found.where("id IS NOT NULL").groupBy("id").agg(F.sum("n_links").alias("others"))
    groups = connected_components(found.where("u <> v").select("u", "v"))
    named = distinct.select("h1", "h2", F.col("id").alias("rep"), "n").join(links, F.col("rep") == F.col("id"), "left").drop("id").join(groups, F.col("rep") == F.col("node"), "left")
    named = named.where("n > 1 OR others > 0").select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    named = materialise(named, "link-components")
    for written in (dealt, found, distinct):
        discard(written)
    linked = materialise(usable.select("id", "h1", "h2").join(named, ["h1", "h2"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component")), "linked-rows")
    discard(named)
    out = data.select("id").join(linked, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))


class _Home:
    """The vectors at home in a block, by their angle to the pivot, with what they have been linked to so far."""

    def __init__(self, parts: list[tuple], pivot: np.ndarray, threshold: float, reach: float):
        ids, times, units = (np.concatenate(x) for x in zip(*parts, strict=True))
        angles = np.arccos(np.clip(units @ pivot, -1, 1))
        order = np.argsort(angles, kind="stable")
        self.ids, self.times, self.units, self.angles = ids[order], times[order], units[order], angles[order]
        self.pivot, self.threshold, self.reach = pivot, threshold, reach
        self.counts, self.parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i in range(0, len(ids), 512):
            near, lo = self._near(self.units[i : i + 512], self.angles[i : i + 512])
            near[np.arange(len(near)), np.arange(i, i + len(near)) - lo] = False
            self.counts[i : i + 512] += near @ self.times[lo : lo + near.shape[1]]
            for k in np.flatnonzero(near.any(axis=1)):
                self._tie(np.append(np.flatnonzero(near[k]) + lo, i + k))

    def _near(self, units: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, int]:
        """Which home vectors each of some vectors links with, of those from ``lo`` on that their angles leave."""
        lo = int(np.searchsorted(self.angles, angles.min() - self.reach))
        hi = int(np.searchsorted(self.angles, angles.max() + self.reach, side="right"))
        return units @ self.units[lo:hi].T >= self.threshold, lo

    def _tie(self, rows: np.ndarray) -> None:
        roots = np.unique(self.parent[rows])
        if len(roots) > 1:
            self.parent[np.isin(self.parent, roots)] = roots[0]

    def meet(self, ids: np.ndarray, times: np.ndarray, units: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of vectors of another block: their counts and one edge each."""
        angles = np.arccos(np.clip(units @ self.pivot, -1, 1))
        order = np.argsort(angles, kind="stable")
        for i in range(0, len(order), 512):
            own = order[i : i + 512]
            near, lo = self._near(units[own], angles[own])
            linked = np.flatnonzero(near.any(axis=1))
            if len(linked):
                self.counts[lo : lo + near.shape[1]] += times[own] @ near
                ties = []
                for k in linked:
                    rows = np.flatnonzero(near[k]) + lo
                    self._tie(rows)
                    ties.append(rows[0])
                yield _out(ids[own][linked], near[linked] @ self.times[lo : lo + near.shape[1]], ids[own][linked], self.ids[ties])

    def finish(self) -> Iterator[pa.RecordBatch]:
        some = self.counts > 0
        yield _out(self.ids[some], self.counts[some], self.ids[some], self.ids[self.parent[some]])


def _out(ids: np.ndarray, counts: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Rows of a vector's count and an edge."""
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, counts, u, v)], ["id", "n_links", "u", "v"])


def op4_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
