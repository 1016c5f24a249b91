"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector by the cells of ``K`` random projections.  A query visits its own cell and
perturbed ones in the order of their estimated success: the chance that a neighbour at the query's
search radius, which moves each projection by a normal step, falls into the cell.  A first round
visits a few cells; the distance of the tenth neighbour found there is the radius of the second round, which goes on until the
chance of having passed such a neighbour reaches ``SUCCESS`` over all tables.  Candidates of all tables are
merged and ranked by exact distance.  A query whose first round finds too few is compared with
every vector.

Only the cell width is fitted, on at most ``SAMPLE`` vectors; every vector is indexed.  Cells are cut into blocks of
bounded size, queries of a cell as well; a task compares a block with a block, and every block of a large cell has its own
join key.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumitie.llm.hot import salted_join
from lumitie.sources.stage import Stage

TABLES = 2
SUCCESS = 0.96
SAMPLE = 4096
#: Vectors per cell aimed at, cells per projection within two standard deviations, cells of the first round.
PER_CELL, CELLS_PER_AXIS, FIRST_PROBES = 2048, 3.0, 4
VECTOR_BLOCK, QUERY_BLOCK = 2048, 256
#: Vector blocks that a block of queries without a radius meets in one task, about.
SPAN = 8


@dataclass
class Grid:
    """Projections, offsets and cell width for vectors of one length; lowest and highest cell per function once indexed."""

    length: int
    axes: np.ndarray
    offsets: np.ndarray
    width: float
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @property
    def k(self) -> int:
        return len(self.offsets) // TABLES

    def places(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.axes / self.width + self.offsets

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """A 64-bit cell key per row and table."""
        out = np.zeros((len(codes), TABLES), np.uint64)
        for t in range(TABLES):
            key = np.full(len(codes), (self.length << 8) + t + 1, np.uint64)
            for i in range(t * self.k, (t + 1) * self.k):
                key = (key ^ codes[:, i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[:, t] = key
        return out.view(np.int64)

    def probes(self, place: np.ndarray, t: int, radius: float, most: int | None, target: float) -> Iterator[np.ndarray]:
        """Cells of one table in the order of their success, up to ``most`` of them or the target chance.

        Cells beyond the lowest and highest code of all vectors are empty and pass for visited.
        """
        x, low, high = place, self.low[t * self.k:(t + 1) * self.k], self.high[t * self.k:(t + 1) * self.k]
        step = max(radius / self.width, 1e-12)
        axes, inside = [], 1.0
        for xi, lo, hi in zip(x.tolist(), low.tolist(), high.tolist()):
            home = min(max(math.floor(xi), lo), hi)
            reach = int(min(hi - lo, 6 * step + 1)) + 1
            codes = range(max(lo, home - reach), min(hi, home + reach) + 1)
            ends = [_normal((c - xi) / step) for c in [*codes, codes[-1] + 1]]
            chances = sorted(((max(b - a, 1e-300), c) for a, b, c in zip(ends, ends[1:], codes)), reverse=True)
            inside *= sum(p for p, _ in chances)
            axes.append(chances)
        first = (0,) * self.k
        heap, seen = [(-math.prod(a[0][0] for a in axes), first)], {first}
        done, n = 1.0 - inside, 0
        while heap and (n < most if most is not None else done < target):
            p, at = heapq.heappop(heap)
            yield np.array([axes[i][j][1] for i, j in enumerate(at)])
            done -= p
            n += 1
            for i in range(self.k):
                if at[i] + 1 < len(axes[i]):
                    nxt = (*at[:i], at[i] + 1, *at[i + 1:])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (p / axes[i][at[i]][0] * axes[i][at[i] + 1][0], nxt))


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def usable(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distinct id, v (doubles) and length of the vectors that take part: no null, none without a non-zero component,
    none with a null or non-finite one, and none with a null id."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return (embeddings.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
            .withColumn("length", F.size("v")).distinct())


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def fit(vectors: DataFrame, length: int, count: int) -> Grid:
    """Cell width from a bounded sample, chosen by hash of the id; number of functions from the number of vectors."""
    rows = vectors.where(F.col("length") == length).orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).collect()
    k = max(1, round(math.log(max(count / PER_CELL, 1.01)) / math.log(CELLS_PER_AXIS)))
    rng = np.random.default_rng(length)
    axes = rng.standard_normal((length, TABLES * k))
    spread = float((np.array([r["v"] for r in rows], float) @ axes).std(axis=0).mean())
    return Grid(length, axes, rng.random(TABLES * k), max(4 * spread / CELLS_PER_AXIS, 1e-12))


def build_index(vectors: DataFrame, grid: Grid, stage: Stage) -> DataFrame:
    """Blocks (cell, part, m) of all vectors in all tables; sets the grid's lowest and highest codes."""
    mine = vectors.where(F.col("length") == grid.length).select("id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                codes = np.floor(grid.places(_matrix(piece.column(1)))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(grid.keys(codes).tolist(), pa.list_(pa.int64())),
                     pa.array(codes.tolist(), pa.list_(pa.int64()))], ["id", "v", "cells", "codes"])

    ends = {f"{name}{i}": fn(F.col("codes")[i]) for i in range(TABLES * grid.k) for name, fn in (("low", F.min), ("high", F.max))}
    hashed, seen = stage.write(mine.mapInArrow(run, "id long, v array<double>, cells array<long>, codes array<long>"), "hashed", ends)
    grid.low, grid.high = (np.array([seen[f"{name}{i}"] for i in range(TABLES * grid.k)]) for name in ("low", "high"))
    rows = hashed.select("id", "v", F.posexplode("cells").alias("t", "cell"))
    sizes = stage.write(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "sizes")
    parts = F.ceil(F.col("n") / VECTOR_BLOCK)
    return stage.write(salted_join(rows, sizes, ["cell"], "id").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
                       .groupBy("cell", "t", "part").agg(F.collect_list(F.struct("id", "v")).alias("m")), "blocks")


def _visited(queries: DataFrame, grid: Grid, first: bool) -> DataFrame:
    """Rows (cell, id, v, radius) for the cells that the queries (id, v, radius) visit in a round."""
    target = 1 - (1 - SUCCESS) ** (1 / TABLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                places, radii = grid.places(_matrix(piece.column(1))), piece.column(2).to_pylist()
                rows, cells = [], []
                for i, radius in enumerate(radii):
                    for t in range(TABLES):
                        own = places[i, t * grid.k:(t + 1) * grid.k]
                        found = np.array(list(grid.probes(own, t, radius, FIRST_PROBES if first else None, target)))
                        wide = np.zeros((len(found), TABLES * grid.k), np.int64)
                        wide[:, t * grid.k:(t + 1) * grid.k] = found
                        cells.append(grid.keys(wide)[:, t])
                        rows.append(np.full(len(found), i))
                if rows:
                    take = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), *[c.take(take) for c in piece.columns]], ["cell", "id", "v", "radius"])

    return queries.mapInArrow(run, "cell long, id long, v array<double>, radius double")


def _rows(block: pa.ListScalar) -> list[np.ndarray]:
    """The columns of a block of structs as arrays; vectors as a matrix."""
    out = []
    for column in block.values.flatten():
        whole = column.flatten() if pa.types.is_list(column.type) else column
        values = whole.to_numpy(zero_copy_only=False)
        out.append(values.reshape(len(column), -1) if whole is not column else values)
    return out


def nearest_in_block(x: np.ndarray, ids: np.ndarray, own: int, q: np.ndarray, radius: float, rough: np.ndarray, slack: float, k: int):
    """Places and distances of the ``k`` nearest of a block within the radius; ``rough`` are squared distances within ``slack``."""
    near = np.flatnonzero((rough <= radius * radius * (1 + 1e-9) + slack) & (ids != own))
    if len(near) > 4 * k:
        edge = np.partition(rough[near], k - 1)[k - 1]
        near = near[rough[near] <= edge + 2 * slack]
    score = np.sqrt(((x[near] - q) ** 2).sum(axis=1))
    keep = score <= radius
    near, score = near[keep], score[keep]
    first = np.lexsort((ids[near], score))[:k]
    return near[first], score[first]


def _compared(met: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the ``k`` nearest within the radius, for each pair (q, m) of query and vector blocks.

    A product of both blocks gives the squared distances but for rounding; what may be among the nearest is computed exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (own, q, radius), (ids, x) = _rows(batch.column(0)[at]), _rows(batch.column(1)[at])
                norms, own_norms = (x ** 2).sum(1), (q ** 2).sum(1)
                rough = norms[None, :] + own_norms[:, None] - 2 * (q @ x.T)
                out = []
                for i in range(len(own)):
                    slack = 1e-12 * x.shape[1] * float(norms.max() + own_norms[i])
                    near, score = nearest_in_block(x, ids, own[i], q[i], radius[i], rough[i], slack, k)
                    out.append((np.full(len(near), own[i]), ids[near], score))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return met.select("q", "m").mapInArrow(run, "query_id long, vec_id long, score double")


def _grouped(visits: DataFrame, parts: int, key: str = "cell") -> DataFrame:
    """Queries of each cell in blocks of bounded size; ``parts`` divides all queries into such blocks."""
    return (visits.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy(key, *(["p"] if key != "p" else []))
            .agg(F.collect_list(F.struct("id", "v", "radius")).alias("q")).select(key, "q"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(queries: DataFrame, index: DataFrame, grid: Grid, k: int, stage: Stage) -> DataFrame:
    """Both rounds; joins are merged, as what a query visits is far larger than Catalyst expects from its input."""
    parts = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, parts)
    blocks = index.select("cell", "part", "m").hint("merge")
    large = index.where("part > 0").groupBy("cell").agg(F.max("part").alias("last"))

    def met(visits: DataFrame) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))).alias("part")
        wanted = _grouped(visits, parts).join(large, "cell", "left").select("cell", each, "q")
        return _compared(wanted.hint("merge").join(blocks, ["cell", "part"]), k)

    start = queries.select("id", "v", F.lit(grid.width).alias("radius")).repartition(tasks, "id")
    near = stage.write(_best(met(_visited(start, grid, True).withColumn("radius", F.lit(float("inf")))), k), "first")
    reach = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("radius")).where(F.col("n") >= k)
    known = stage.write(queries.join(reach.select(F.col("query_id").alias("id"), "radius"), "id", "left"), "radii")
    found = near.select("query_id", "vec_id", "score").unionByName(
        met(_visited(known.where("radius is not null").select("id", "v", "radius").repartition(tasks, "id"), grid, False)))
    few = known.where("radius is null")
    if not few.isEmpty():
        # every block of one table meets every block of these queries
        own = index.where("t = 0")
        spans = math.ceil(own.count() / SPAN)
        each = own.select("m", F.pmod(F.xxhash64("cell", "part"), F.lit(spans)).alias("span"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("p"))
        wanted = (_grouped(few.select("id", "v", F.lit(float("inf")).alias("radius")), parts, "p")
                  .select("p", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spans - 1).cast("long"))).alias("span")))
        found = found.unionByName(_compared(wanted.hint("merge").join(each.hint("merge"), ["p", "span"]), k))
    return _best(found, k)


def nearest(embeddings: DataFrame, queries: DataFrame, stage: Stage, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` nearest vectors found, by Euclidean distance and then id.

    A query's own are the rows of its id; of several vectors of one id and length the
    smallest is asked for.  Vectors that cannot take part (see ``usable``) are left out on both sides, repeated
    rows count once, and vectors of different lengths are never neighbours.  With ``k`` candidates or fewer, all are returned.
    """
    vectors = stage.write(usable(embeddings, vec_id, vector), "vectors")
    wanted = stage.write(usable(queries, vec_id, vector).groupBy("id", "length").agg(F.min("v").alias("v")), "queries")
    lengths = vectors.groupBy("length").count().join(wanted.select("length").distinct(), "length").collect()
    out = None
    for row in sorted(lengths):
        grid = fit(vectors, row["length"], row["count"])
        index = build_index(vectors, grid, stage)
        found = _search(wanted.where(F.col("length") == row["length"]).select("id", "v"), index, grid, k, stage)
        if len(lengths) > 1:
            found = stage.write(found, "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = wanted.limit(0).select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
