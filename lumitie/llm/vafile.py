"""Exact centroid clustering over a vector approximation file.

Every vector is also kept as one cell of ``BITS`` bits per component.  A round scans the cells alone: lookup tables per component
give the least and greatest share of each cell in the distance from each centroid, their sums an interval per centroid.
Where the nearest centroid's interval meets others, the difference of the two distances, which is linear in the vector, is bounded
by the cells' widths as well.  Only vectors that stay undecided, or whose centroid has changed, are fetched from
the table of full vectors and compared exactly.  Both tables are bucketed by the same key, so the full vectors are not shuffled.

The sums of a cluster follow from the moves between the last two assignments, so a vector that stays is not read for them either.
A round keeps no state but its centroids, sums and counts; a lost task is simply run again.  Cell bounds are fitted on at most
``SAMPLE`` vectors, which affects what is fetched and never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumitie.sources.stage import Stage

DIMENSIONS, CLUSTERS, ROUNDS = 64, 40, 5
BITS, SAMPLE = 6, 4096
SCALE, SEED = 256, "2:"
#: Components beyond this have no exact distance in 64 bits.
MOST = 1 << 27
VECTORS_PER_BUCKET = 250_000
KEYS = ["k1", "k2"]


def usable(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """k1, k2, vec_id, v: integer components (32 bits each) of the vectors that take part, with a key by id and vector."""
    fine = (F.size(vector) == DIMENSIONS) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    part = embeddings.where(F.col(vector).isNotNull() & fine).select(
        F.xxhash64(vec_id, vector).alias("k1"), F.xxhash64(F.lit(1), vector, vec_id).alias("k2"), F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    if_small = F.when(F.forall("v", lambda x: F.abs(x) <= MOST), F.col("v")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")))
    return part.withColumn("v", if_small.cast("array<int>"))


def _packed(vectors: DataFrame) -> DataFrame:
    """``v`` as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, DIMENSIONS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.tobytes() for x in v], pa.binary())], [*KEYS, "vec_id", "v"])

    return vectors.mapInArrow(run, "k1 long, k2 long, vec_id long, v binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of 32-bit components as 64-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, DIMENSIONS).astype(np.int64)


class Cells:
    """Bounds of the cells of each component, and what they say about distances."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray):
        steps = np.arange(1, 1 << BITS) / (1 << BITS)
        self.marks = np.ceil(np.quantile(sample, steps, axis=0)).astype(np.int64).T
        self.low = np.concatenate([low[:, None], self.marks], 1)
        self.high = np.maximum(np.concatenate([self.marks - 1, high[:, None]], 1), self.low)

    def encode(self, v: np.ndarray) -> np.ndarray:
        """Cells of each vector, four in three bytes."""
        cells = np.stack([np.searchsorted(self.marks[j], v[:, j], "right") for j in range(DIMENSIONS)], 1).astype(np.uint8)
        bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - BITS:]
        return np.packbits(bits.reshape(len(v), -1), axis=1)

    def decode(self, column: pa.Array) -> np.ndarray:
        packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        bits = np.unpackbits(packed, axis=1)[:, :DIMENSIONS * BITS].reshape(len(column), DIMENSIONS, BITS)
        return bits @ (1 << np.arange(BITS - 1, -1, -1))

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest share in the squared distance, by component, cell and centroid."""
        low, high, c = self.low[:, :, None], self.high[:, :, None], centroids.T[:, None, :]
        return (np.maximum(0, np.maximum(low - c, c - high)).astype(float) ** 2, np.maximum(np.abs(low - c), np.abs(high - c)).astype(float) ** 2)

    def nearest(self, cells: np.ndarray, centroids: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The one centroid that can be nearest, -1 where several can."""
        least, most = (np.zeros((len(cells), len(centroids))) for _ in range(2))
        for j in range(DIMENSIONS):
            least += tables[0][j][cells[:, j]]
            most += tables[1][j][cells[:, j]]
        own = most.argmin(1)
        rows = np.arange(len(cells))
        slack = 1 + 1e-9 * most.max(initial=0)
        open_ = least <= most[rows, own][:, None] + slack
        open_[rows, own] = False
        dims = np.arange(DIMENSIONS)
        low, high = self.low[dims, cells].astype(float), self.high[dims, cells].astype(float)
        for k in range(len(centroids)):
            at = np.flatnonzero(open_[:, k])
            if len(at):
                # |x - c_k|^2 - |x - c_own|^2 = sum (c_own - c_k) (2 x - c_own - c_k)
                a = centroids[own[at]].astype(float)
                apart = a - centroids[k]
                x = np.where(apart > 0, low[at], high[at])
                open_[at, k] = (apart * (2 * x - a - centroids[k])).sum(1) <= slack
        return np.where(open_.any(1), -1, own)


def exact(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, the smaller number if equal, and the squared distance."""
    best, near = np.zeros(len(v), np.int64), np.full(len(v), np.iinfo(np.int64).max)
    for k, c in enumerate(centroids):
        d = ((v - c) ** 2).sum(1)
        closer = d < near
        best[closer], near[closer] = k, d[closer]
    return best, near


def _in_pieces(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _ends(full: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest value of each component; a task sends one row for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for piece in _in_pieces(batches):
            v = _matrix(piece.column(0))
            low = v.min(0) if low is None else np.minimum(low, v.min(0))
            high = v.max(0) if high is None else np.maximum(high, v.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(DIMENSIONS), pa.int32()), pa.array(low), pa.array(high)], ["j", "low", "high"])

    rows = full.select("v").mapInArrow(run, "j int, low long, high long").groupBy("j").agg(F.min("low"), F.max("high")).orderBy("j").collect()
    return np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def _moves(approx: DataFrame, full: DataFrame, cells: Cells, before: np.ndarray | None, now: np.ndarray) -> DataFrame:
    """cluster, j, change: what the vectors that move between two assignments change in the sums (j < 64) and counts (j = 64)."""
    k = len(now)

    def undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [cells.tables(c) if c is not None else None for c in (before, now)]
        for piece in _in_pieces(batches):
            own = cells.decode(piece.column(2))
            new = cells.nearest(own, now, tables[1])
            old = cells.nearest(own, before, tables[0]) if before is not None else np.full(len(new), -2)
            fetch = np.flatnonzero((old != new) | (old == -1))
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(fetch)), piece.column(1).take(pa.array(fetch)),
                                              pa.array(old[fetch].astype(np.int32)), pa.array(new[fetch].astype(np.int32))], [*KEYS, "old", "new"])

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, DIMENSIONS + 1), np.int64)
        for piece in _in_pieces(batches):
            old, new, v = piece.column(0).to_numpy().copy(), piece.column(1).to_numpy().copy(), _matrix(piece.column(2))
            copies = piece.column(3).to_numpy()
            for place, centroids in ((old, before), (new, now)):
                open_ = np.flatnonzero(place == -1)
                if len(open_):
                    place[open_] = exact(v[open_], centroids)[0]
            moved = np.flatnonzero(old != new)
            rows = np.concatenate([v[moved], np.ones((len(moved), 1), np.int64)], 1) * copies[moved, None]
            np.add.at(total, new[moved], rows)
            gone = old[moved] >= 0
            np.subtract.at(total, old[moved][gone], rows[gone])
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array((at // (DIMENSIONS + 1)).astype(np.int32)), pa.array((at % (DIMENSIONS + 1)).astype(np.int32)),
                                          pa.array(total.ravel()[at])], ["cluster", "j", "change"])

    wanted = approx.select(*KEYS, "cells").mapInArrow(undecided, "k1 long, k2 long, old int, new int")
    return (wanted.join(full, KEYS).select("old", "new", "v", "copies").mapInArrow(changes, "cluster int, j int, change long")
            .groupBy("cluster", "j").agg(F.sum("change").alias("change")))


def _assigned(both: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = cells.tables(centroids)
        for piece in _in_pieces(batches):
            v, place = _matrix(piece.column(2)), cells.nearest(cells.decode(piece.column(1)), centroids, tables)
            open_ = np.flatnonzero(place < 0)
            place[open_] = exact(v[open_], centroids)[0]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(place.astype(np.int32)), pa.array(((v - centroids[place]) ** 2).sum(1)),
                                              piece.column(3)], ["vec_id", "cluster", "distance", "copies"])

    return both.select("vec_id", "cells", "v", "copies").mapInArrow(run, "vec_id long, cluster int, distance long, copies long")


def _rounds(stage: Stage, approx: DataFrame, full: DataFrame, cells: Cells, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """Run the rounds; the driver holds the sums of each cluster only."""
    sums, before = np.zeros((len(centroids), DIMENSIONS + 1), np.int64), None
    for _ in range(rounds):
        for row in _moves(approx, full, cells, before, centroids).collect():
            sums[row["cluster"], row["j"]] += row["change"]
        before, filled = centroids, sums[:, DIMENSIONS] > 0
        centroids = centroids.copy()
        centroids[filled] = sums[filled, :DIMENSIONS] // sums[filled, DIMENSIONS:]
    out = _assigned(approx.join(full, KEYS), cells, centroids).where("copies > 0")
    out = out.select("vec_id", "cluster", "distance", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).drop("_copy")
    return stage.write(out, "assigned"), centroids


def cluster(embeddings: DataFrame, stage: Stage, vec_id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS,
            rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared, of the integer vectors) for every vector, and the final centroids.

    Vectors that are null, of another length, or with a null or non-finite component take no part.  Repeated rows are
    vectors of their own; a null id stays null and is hashed like an empty one; equal hashes of the first centroids are ordered by vector.
    An empty table gives no row.  Components beyond 2^27 after scaling raise an error, as their distances do not fit 64 bits.
    """
    spark = embeddings.sparkSession
    given = stage.write(_packed(usable(embeddings, vec_id, vector)), "given")
    seed = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = given.select(seed.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    if not chosen:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, DIMENSIONS), np.int64)
    centroids = _matrix(pa.array([bytes(r["v"]) for r in chosen], pa.binary()))
    sample = given.orderBy(F.xxhash64(*KEYS), *KEYS).select("v").limit(SAMPLE).collect()
    cells = Cells(_matrix(pa.array([bytes(r["v"]) for r in sample], pa.binary())), *_ends(given))
    # rows of one id and vector are one full vector; their number travels with the approximation
    buckets = max(1, -(-given.count() // VECTORS_PER_BUCKET), spark.sparkContext.defaultParallelism)
    alike = given.groupBy(*KEYS).agg(F.first("vec_id").alias("vec_id"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"))

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _in_pieces(batches):
            yield pa.RecordBatch.from_arrays([*piece.columns[:2], pa.array([x.tobytes() for x in cells.encode(_matrix(piece.column(2)))], pa.binary())],
                                             [*KEYS, "cells"])

    full = stage.bucketed(alike, "full", KEYS, buckets)
    approx = stage.bucketed(full.select(*KEYS, "v").mapInArrow(approximate, "k1 long, k2 long, cells binary"), "cells", KEYS, buckets)
    stage.drop(given)
    return _rounds(stage, approx, full, cells, centroids, rounds)


def report(embeddings: DataFrame, stage: Stage) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = cluster(embeddings, stage)
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(inertia.values())
    rows = [(k, inertia.get(k, 0), whole, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    each = embeddings.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
