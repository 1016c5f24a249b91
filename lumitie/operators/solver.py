"""Conjugate gradients on DataFrames.

Matrix and vectors stay distributed: the stars are cached as arrays, and a product is formed star by star, so no table of node
pairs is ever written or moved; each task adds up what its stars give to the unknowns.  Where the vectors are too long to be handed to every task,
the links are cached instead, dealt by row or by cells of two blocks of unknowns.  The vectors are one staged table with a row per unknown.  The single-reduction form of
the preconditioned recurrence (Chronopoulos and Gear 1989) needs one Spark job per iteration: the job
updates the vectors, multiplies by the matrix, writes the new state and sums the three
scalars that steer the next step.  A lost executor costs at most one iteration.  Several systems that share
their links advance in one recurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumitie.functions import photometry as P
from lumitie.operators import normal as N
from lumitie.operators.relational import node_columns
from lumitie.operators.robust import scalar_median
from lumitie.sources.stage import Stage


LINKS_PER_PARTITION = 1_000_000
# Numbers of a vector that every task may hold, and blocks into which the unknowns of a longer one are cut.
BROADCAST_VALUES = 1_000_000
BLOCKS = 16
#: Numbers of the vectors that the tasks get as plain arrays, 8 bytes each, and those beyond which systems that share their stars
#: are solved in turn, detections of the stars in a cached row, pairs of detections weighed at once, rows that a task hands back at once, and sums
#: that one task of a step adds up.
PACKED_VALUES = 32_000_000
TOGETHER_VALUES = 4_000_000
CHUNK_DETECTIONS = 500_000
PAIRS_AT_ONCE = 200_000
ROWS_AT_ONCE = 50_000
VALUES_PER_TASK = 100_000


@contextmanager
def shuffle_partitions(spark, n: int):
    """Shuffle into ``n`` partitions inside the block: the vectors are far smaller than the
    tables the session's default is meant for, and every iteration pays for each one.  Links dealt by
    cell meet a vector on cell and unknown without being dealt again."""
    key, whole = "spark.sql.shuffle.partitions", "spark.sql.requireAllClusterKeysForCoPartition"
    before, whole_before = spark.conf.get(key), spark.conf.get(whole)
    spark.conf.set(key, str(min(n, int(before))))
    spark.conf.set(whole, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)
        spark.conf.set(whole, whole_before)


@dataclass
class SolveInfo:
    iterations: int
    converged: bool
    relative_residual: float
    n_params: int = 0
    offset: float = 0.0
    n_anchored: int = 0
    mode: str = ""


def _block(c) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BLOCKS)).cast("int")


def _hold(links: DataFrame, n_values: int, n_parts: int) -> DataFrame:
    """The links, dealt so that the products of a task fall on few unknowns and merge before they are moved.

    A vector of up to ``BROADCAST_VALUES`` numbers goes to every task, and all links of an unknown lie together.  A longer one is cut
    into blocks: a cell holds the links between two blocks, gets one block of the vector and gives sums for one, so an
    iteration moves a row per unknown and block instead of one for nearly every link.
    """
    rows = links.select("i", "j", "w")
    if n_values <= BROADCAST_VALUES:
        return rows.repartition(n_parts, "i")
    cells = rows.withColumn("cell", _block("i") * F.lit(BLOCKS) + _block("j"))
    return cells.repartition(n_parts, "cell").sortWithinPartitions("cell", "j")


def _packed(stars: DataFrame, unknowns: DataFrame) -> DataFrame:
    """The stars (k, m, v) in rows of many, the shorter ones first: c (number in its partition), size (detections of each star) and for each
    detection pos (place of its unknown in their order), m and v, as plain arrays."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, c = [], 0

        def row() -> pa.RecordBatch:
            size = np.concatenate([h[0] for h in held])
            order = np.argsort(size, kind="stable")
            moved = size[order]
            at = np.repeat((np.cumsum(size) - size)[order] - (np.cumsum(moved) - moved), moved) + np.arange(size.sum())
            k, m, v = (np.concatenate([h[n] for h in held])[at] for n in (1, 2, 3))
            held.clear()
            # A detection without an error has no weight.
            arrays = (moved.astype(np.int32), k.astype(np.int64), m, np.where(np.isnan(v), np.inf, v))
            return pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], ["c", "size", "k", "m", "v"])

        for batch in batches:
            lists = [batch.column(n) for n in range(3)]
            held.append((np.diff(lists[0].offsets.to_numpy()), *[x.flatten().to_numpy(zero_copy_only=False).astype(t) for x, t in zip(lists, (np.int64, float, float))]))
            if sum(len(h[1]) for h in held) >= CHUNK_DETECTIONS:
                yield row()
                c += 1
        if any(len(h[0]) for h in held):
            yield row()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = None
        for batch in batches:
            for n in range(batch.num_rows):
                c, size, k, m, v, vector = (batch.column(f)[n].as_py() for f in range(6))
                ids = ids if vector is None else _unpacked(vector)[0]
                k = np.frombuffer(k, np.int64)
                pos = np.searchsorted(ids, k)
                if not len(ids) or not np.array_equal(ids[np.minimum(pos, len(ids) - 1)], k):
                    raise ValueError("a star lies on a node that is not an unknown")
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *[pa.array([x], pa.binary()) for x in (size, pos.astype(np.int32).tobytes(), m, v)]],
                                                 ["c", "size", "pos", "m", "v"])

    chunks = stars.select("k", "m", "v").mapInArrow(gather, "c int, size binary, k binary, m binary, v binary")
    return _with_vector(chunks, _vector(unknowns.select("i"), ())).mapInArrow(place, "c int, size binary, pos binary, m binary, v binary")


def _vector(vec: DataFrame, columns) -> DataFrame:
    """One row: the unknowns with the given columns, as plain arrays of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
        if parts:
            arrays = [np.concatenate(c) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], ["i", *columns])

    parts = vec.select(F.col("i").cast("long"), *[F.col(c).cast("double") for c in columns]).mapInArrow(run, ", ".join(f"{c} binary" for c in ("i", *columns)))
    return parts.agg(F.collect_list(F.struct("i", *columns)).alias("vector"))


def _unpacked(vector: list[dict]) -> list[np.ndarray]:
    """The unknowns of a ``_vector`` in order and its columns; the vector is emptied column by column, so that no second copy of it builds up."""
    names = list(vector[0]) if vector else ["i"]
    order, out = None, []
    for c in names:
        array = np.frombuffer(b"".join([part.pop(c) for part in vector]), np.int64 if c == "i" else float)
        order = np.argsort(array, kind="stable") if order is None else order
        out.append(array[order])
    return out


def _with_vector(held: DataFrame, vector: DataFrame) -> DataFrame:
    """The rows of each partition, the first with the vector."""
    return held.crossJoin(F.broadcast(vector)).withColumn("vector", F.when(F.col("c") == 0, F.col("vector")))


def _weights(size: np.ndarray, pos: np.ndarray, v: np.ndarray):
    """Detections [a, b) of some stars of equal length and the weights of their pairs, (star, detection, detection); 0 on one node."""
    ends = np.searchsorted(size, np.unique(size), "right")
    first, at = 0, 0
    for end in ends.tolist():
        n = int(size[first])
        step = max(1, PAIRS_AT_ONCE // (n * n))
        for _ in range(first, end, step):
            stop = at + n * min(step, end - first)
            first += min(step, end - first)
            p, x = pos[at:stop].reshape(-1, n), v[at:stop].reshape(-1, n)
            with np.errstate(divide="raise"):
                w = 1.0 / (x[:, :, None] + x[:, None, :])
            w[p[:, :, None] == p[:, None, :]] = 0.0
            yield at, stop, w
            at = stop


def _over_stars(held: DataFrame, vector: DataFrame, names, terms) -> DataFrame:
    """i and the sums ``names``: what ``terms(columns of the vector, pos, m, w)`` gives to each detection, added up by unknown in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, columns, sums, met = None, None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                _, size, pos, m, v, given = (batch.column(f)[row].as_py() for f in range(6))
                if given is not None:
                    ids, *columns = _unpacked(given)
                    sums, met = [np.zeros(len(ids)) for _ in names], np.zeros(len(ids), bool)
                size, pos, m, v = np.frombuffer(size, np.int32), np.frombuffer(pos, np.int32), np.frombuffer(m), np.frombuffer(v)
                got = [np.empty(len(pos)) for _ in names]
                for a, b, w in _weights(size, pos, v):
                    shape = w.shape[:2]
                    for out, value in zip(got, terms(columns, pos[a:b].reshape(shape), m[a:b].reshape(shape), w)):
                        out[a:b] = value.ravel()
                for total, out in zip(sums, got):
                    total += np.bincount(pos, out, len(ids))
                met[pos] = True
        if ids is not None:
            at = np.flatnonzero(met)
            for k in range(0, len(at), ROWS_AT_ONCE):
                some = at[k:k + ROWS_AT_ONCE]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), *[pa.array(t[some]) for t in sums]], ["i", *names])

    rows = _with_vector(held, vector).mapInArrow(run, ", ".join(["i long", *[f"{n} double" for n in names]]))
    return rows.groupBy("i").agg(*[F.sum(n).alias(n) for n in names])


def _diagonal_and_sums(held: DataFrame, unknowns: DataFrame) -> DataFrame:
    """i, d, b: diagonal and right-hand side of the stars."""

    def terms(_, pos, m, w):
        return w.sum(2), np.nan_to_num(w * (m[:, None, :] - m[:, :, None])).sum(2)

    return _over_stars(held, _vector(unknowns.select("i"), ()), ("d", "b"), terms)


def _products(held: DataFrame, vec: DataFrame, c: str, tags) -> DataFrame:
    """i, _off<tag>: the weighted sums of the column ``c`` over the partners of each unknown."""

    def terms(columns, pos, m, w):
        return [np.einsum("sij,sj->si", w, x[pos]) for x in columns]

    return _over_stars(held, _vector(vec, [c + t for t in tags]), [f"_off{t}" for t in tags], terms)


def _times_matrix(links: DataFrame, vec: DataFrame, c: str, out: str, tags=("",)) -> DataFrame:
    """Add ``out`` = A * c to ``vec`` (i, d, ...) for every tag; ``links`` are packed stars, or carry both directions and are dealt by ``_hold``."""
    if "pos" in links.columns:
        return _with_products(vec, _products(links, vec, c, tags), c, out, tags)
    rhs = vec.select(F.col("i").alias("j"), *[F.col(c + t).alias(f"_c{t}") for t in tags])
    if "cell" in links.columns:
        blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
        rhs = rhs.withColumn("_b", blocks).withColumn("cell", F.col("_b") * F.lit(BLOCKS) + _block("j")).drop("_b")
        met = links.join(rhs.hint("merge"), ["cell", "j"])
    else:
        met = links.join(F.broadcast(rhs), "j")
    # The products are summed alone: rows that carried the other vectors as well would fill the tasks' memory.
    return _with_products(vec, met.groupBy("i").agg(*[F.sum(F.col("w") * F.col(f"_c{t}")).alias(f"_off{t}") for t in tags]), c, out, tags)


def _with_products(vec: DataFrame, sums: DataFrame, c: str, out: str, tags) -> DataFrame:
    return vec.join(sums, "i", "left").select(*vec.columns, *[
        (F.col("d" + t) * F.col(c + t) - F.coalesce(f"_off{t}", F.lit(0.0))).alias(out + t) for t in tags])


def conjugate_gradient(links: DataFrame, vec: DataFrame, stage: Stage, rtol: float = 1e-5,
                       maxiter: int = 5000, tags=("",), precondition: bool = True, start: DataFrame | None = None):
    """Solve A x = b until |r| <= rtol |b|, for one or several systems that differ in diagonal and right-hand side.

    ``links`` are the cached stars of ``assembled``, or (i, j, w) with both directions of the negated off-diagonal; ``vec`` has
    (i, d, b) the diagonal and right-hand side of every unknown; with ``tags`` it has columns d<tag>, b<tag> for each
    system, and one pass over the matrix serves all.  ``start`` (i, x<tag>) is where to begin, else 0.  The
    diagonal is the preconditioner unless ``precondition`` is false.

    Returns (i, x<tag>...) and an outcome for each tag (a single one for a single system): iteration count, convergence flag
    and the true relative residual |Ax - b| / |b|, by which convergence is judged.
    """
    at_least = links.sparkSession.sparkContext.defaultParallelism
    if "pos" in links.columns:
        with shuffle_partitions(links.sparkSession, max(at_least, math.ceil(vec.count() * len(tuple(tags)) / VALUES_PER_TASK))):
            x, infos = _descend(links, vec, stage, rtol, maxiter, tuple(tags), precondition, start)
        return x, (infos[0] if tuple(tags) == ("",) else dict(zip(tags, infos)))
    n_parts = max(at_least, math.ceil(links.count() / LINKS_PER_PARTITION))
    with shuffle_partitions(links.sparkSession, n_parts):
        held = _hold(links, vec.count() * len(tuple(tags)), n_parts).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            held.count()    # how cached rows lie is known to later plans once they are there
            x, infos = _descend(held, vec, stage, rtol, maxiter, tuple(tags), precondition, start)
        finally:
            held.unpersist()
    return x, (infos[0] if tuple(tags) == ("",) else dict(zip(tags, infos)))


class _Recurrence:
    """The scalars of one system: they steer its next step, and stand still once it has converged."""

    def __init__(self, limit: float):
        self.limit, self.steps, self.alpha, self.beta, self.gamma = limit, 0, 0.0, 0.0, None

    def take(self, seen: dict, t: str) -> None:
        gamma, delta = seen["ru" + t] or 0.0, seen["uw" + t] or 0.0
        if math.sqrt(seen["rr" + t] or 0.0) <= self.limit:
            self.alpha, self.beta = 0.0, 0.0
            return
        if self.gamma is None or not self.alpha:
            self.beta, denom = 0.0, delta
        else:
            self.beta = gamma / self.gamma
            denom = delta - self.beta * gamma / self.alpha
        self.gamma, self.alpha = gamma, (gamma / denom if denom else 0.0)


def _descend(held, vec, stage, rtol, maxiter, tags, precondition, start):
    """Run the recurrence; judge by the true residual, and start again from x while that is too large.

    The state has x, r, p, s and w = A u per system, where u is the preconditioned residual; the scalars of a step come
    from a table of one row, so that the generated code stays the same from step to step.
    """
    spark, zero = vec.sparkSession, F.lit(0.0)
    norms = vec.agg(*[F.sum(F.col("b" + t) * F.col("b" + t)).alias("e" + t) for t in tags]).first()
    norm_b = [math.sqrt(norms["e" + t] or 0.0) for t in tags]
    given = [n + t for t in tags for n in ("d", "b")]

    def u(t, r):
        return F.when(F.col("d" + t) > 0, r / F.col("d" + t)).otherwise(r) if precondition else r

    if start is None:
        at = vec.select("i", *given, *[zero.alias("x" + t) for t in tags])
        ax = at.select("*", *[zero.alias("ax" + t) for t in tags])
    else:
        at = vec.select("i", *given).join(start.select("i", *["x" + t for t in tags]), "i", "left").na.fill(0.0, ["x" + t for t in tags])
        ax = _times_matrix(held, at, "x", "ax", tags)
    dots = {n + t: F.sum(F.col(a + t) * F.col(b + t)) for t in tags for n, a, b in (("rr", "r", "r"), ("ru", "r", "u"), ("uw", "u", "w"))}
    fields = ", ".join(f"alpha{t} double, beta{t} double" for t in tags)
    last, done = [math.inf] * len(tags), [0] * len(tags)
    while True:
        first = ax.select("i", *given, *["x" + t for t in tags], *[(F.col("b" + t) - F.col("ax" + t)).alias("r" + t) for t in tags],
                          *[zero.alias(n + t) for t in tags for n in ("p", "s")])
        first = first.select("*", *[u(t, F.col("r" + t)).alias("u" + t) for t in tags])
        state, seen = stage.write(_times_matrix(held, first, "u", "w", tags), "cg", dots)
        runs = [_Recurrence(rtol * n) for n in norm_b]
        for run, t in zip(runs, tags):
            run.take(seen, t)
        while any(run.alpha for run in runs) and max(done) < maxiter:
            scalars = spark.createDataFrame([tuple(v for run in runs for v in (run.alpha, run.beta))], fields)
            now = state.crossJoin(F.broadcast(scalars))
            p = {t: F.col("u" + t) + F.col("beta" + t) * F.col("p" + t) for t in tags}
            s = {t: F.col("w" + t) + F.col("beta" + t) * F.col("s" + t) for t in tags}
            moved = now.select("i", *given, *[(F.col("x" + t) + F.col("alpha" + t) * p[t]).alias("x" + t) for t in tags],
                               *[(F.col("r" + t) - F.col("alpha" + t) * s[t]).alias("r" + t) for t in tags],
                               *[p[t].alias("p" + t) for t in tags], *[s[t].alias("s" + t) for t in tags])
            moved = moved.select("*", *[u(t, F.col("r" + t)).alias("u" + t) for t in tags])
            after, seen = stage.write(_times_matrix(held, moved, "u", "w", tags), "cg", dots)
            stage.drop(state)
            state = after
            for k, (run, t) in enumerate(zip(runs, tags)):
                done[k] += bool(run.alpha)
                run.take(seen, t)
        ax = _times_matrix(held, state.select("i", *given, *["x" + t for t in tags]), "x", "ax", tags)
        off = ax.agg(*[F.sum((F.col("ax" + t) - F.col("b" + t)) ** 2).alias("e" + t) for t in tags]).first()
        residual = [math.sqrt(off["e" + t] or 0.0) / n if n else 0.0 for t, n in zip(tags, norm_b)]
        # The recurred residual drifts by rounding; a factor of two allows for it.
        if max(done) >= maxiter or all(r <= 2 * rtol or r >= 0.5 * before for r, before in zip(residual, last)):
            x = state.select("i", *["x" + t for t in tags])
            return x, [SolveInfo(n, r <= 2 * rtol, r) for n, r in zip(done, residual)]
        last = residual


@contextmanager
def assembled(system: N.System, terms=(), extra_links=(), tikhonov: float = 0.0, tags: int = 1):
    """The matrix of a system with its additions, as ``conjugate_gradient`` takes it, and the (i, d, b) table."""
    if system.unknowns.count() * tags > PACKED_VALUES:
        yield assemble(system, terms, extra_links, tikhonov)
        return
    stars = system.stars.select("k", "m", "v")
    for extra in extra_links:  # a link is a star of two detections
        half = F.lit(0.5) / F.col("w")
        stars = stars.unionByName(extra.where("w > 0").select(F.array("i", "j").alias("k"), F.array(F.col("wdm") / F.col("w"), F.lit(0.0)).alias("m"), F.array(half, half).alias("v")))
    held = _packed(stars, system.unknowns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held, _summed(system, _diagonal_and_sums(held, system.unknowns), terms, tikhonov)
    finally:
        held.unpersist()


def _summed(system: N.System, parts: DataFrame, terms, tikhonov: float) -> DataFrame:
    """(i, d, b) of every unknown."""
    for t in terms:
        parts = parts.unionByName(t.select("i", "d", "b"))
    sums = parts.groupBy("i").agg(F.sum("d").alias("d"), F.sum("b").alias("b"))
    return system.unknowns.join(sums, "i", "left").select(
        "i", (F.coalesce("d", F.lit(0.0)) + F.lit(tikhonov)).alias("d"), F.coalesce("b", F.lit(0.0)).alias("b"))


def assemble(system: N.System, terms=(), extra_links=(), tikhonov: float = 0.0):
    """Directed links and the (i, d, b) table of a system with its additions."""
    links = system.links
    for extra in extra_links:
        links = links.unionByName(extra.select("i", "j", "w", "wdm"))
    full = N.both_ways(links)
    vec = _summed(system, full.select("i", F.col("w").alias("d"), (-F.col("wdm")).alias("b")), terms, tikhonov)
    if extra_links:
        full = full.groupBy("i", "j").agg(F.sum("w").alias("w"))
    return full.select("i", "j", "w"), vec


def _run(system, cfg, stage, terms=(), extra_links=(), tikhonov=0.0, mode="", must=True, start=None):
    """Solve a system with its additions, from ``start`` (i, x) if given; an unconverged solution raises if it ``must``."""
    with assembled(system, terms, extra_links, tikhonov) as (held, vec):
        vec = stage.write(vec, "cg-vec")
        x, info = conjugate_gradient(held, vec, stage, cfg.solve.tolerance, cfg.solve.max_iterations,
                                     precondition=cfg.solve.precondition, start=start)
    info.n_params = vec.count()
    if must and not info.converged:
        raise RuntimeError(f"{mode} solve stopped at relative residual {info.relative_residual:.3g} "
                           f"after {info.iterations} iterations")
    info.mode = mode
    return x, info


def solve_unanchored(system: N.System, nodes: DataFrame, anchors: DataFrame, cfg, stage: Stage):
    """Solve on overlaps alone, then shift so the anchors' median difference is zero."""
    extra = []
    if cfg.solve.exposure_reg_weight > 0:
        extra.append(N.exposure_links(nodes, cfg.solve.exposure_reg_weight))
    x, info = _run(system, cfg, stage, extra_links=extra, tikhonov=cfg.solve.tikhonov_reg,
                   mode="unanchored")
    zp = x.select(*node_columns("i"), F.col("x").alias("zp_solved"))
    return shift_to_anchors(zp, anchors, info)


def shift_to_anchors(zp: DataFrame, anchors: DataFrame, info: SolveInfo | None = None,
                     exclude: DataFrame | None = None):
    """Subtract the median of zp_solved - zp_fgcm over valid anchor nodes."""
    tied = zp.join(anchors.where(P.valid_zp(F.col("zp_fgcm"))), ["expnum", "ccdnum"])
    if exclude is not None:
        tied = tied.join(exclude, ["expnum", "ccdnum"], "left_anti")
    off = scalar_median(tied.select((F.col("zp_solved") - F.col("zp_fgcm")).alias("o")), "o") or 0.0
    if info is not None:
        info.offset = off
    return zp.withColumn("zp_solved", F.col("zp_solved") - F.lit(off)), info


def outcome_table(spark, infos) -> DataFrame:
    """One row per solve: mode, unknowns, iterations, converged, true relative residual and anchor offset."""
    return spark.createDataFrame([(i.mode, i.n_params, i.iterations, i.converged, i.relative_residual, float(i.offset)) for i in infos],
                                 "mode string, n_params bigint, iterations int, converged boolean, relative_residual double, offset double")


def solve_anchored(system: N.System, nodes: DataFrame, anchors: DataFrame, cfg, stage: Stage, zp: DataFrame | None = None):
    """Solve with a heavy penalty holding anchor nodes at their reference zero-points, from an earlier solution ``zp`` if given."""
    extra = []
    if cfg.solve.exposure_reg_weight > 0:
        extra.append(N.exposure_links(nodes, cfg.solve.exposure_reg_weight))
    terms = N.anchor_terms(nodes, anchors, cfg.solve.des_anchor_weight)
    start = None if zp is None else zp.select(N.node_id().alias("i"), F.col("zp_solved").alias("x"))
    x, info = _run(system, cfg, stage, [terms], extra, mode="anchored", start=start)
    return x.select(*node_columns("i"), F.col("x").alias("zp_solved")), info


def solve_with_prior(system: N.System, nodes: DataFrame, anchors: DataFrame, zpterm: DataFrame,
                     strength: float, offset: float, default: float | None, cfg, stage: Stage,
                     exclude: DataFrame | None = None):
    """Solve with every node pulled to its survey zero-point, then shift to the anchors.

    A node without one is pulled to ``default``, or to the median of the known targets.
    """
    if default is None:
        known = nodes.join(zpterm, ["expnum", "ccdnum"]).select((F.col("zpterm") + F.lit(offset)).alias("t"))
        default = scalar_median(known, "t")
        default = offset if default is None else default
    terms = [N.prior_terms(nodes, zpterm, strength, offset, default)] if strength > 0 else []
    x, info = _run(system, cfg, stage, terms, tikhonov=cfg.solve.tikhonov_reg, mode="prior")
    zp = x.select(*node_columns("i"), F.col("x").alias("zp_solved"))
    return shift_to_anchors(zp, anchors, info, exclude)


def solve_with_priors(system: N.System, nodes: DataFrame, anchors: DataFrame, zpterm: DataFrame, strengths, offset: float,
                      default: float | None, cfg, stage: Stage, exclude: DataFrame | None = None) -> dict:
    """Solutions under several prior strengths, which differ in the diagonal and right-hand side alone.

    As many as ``TOGETHER_VALUES`` allows advance in one recurrence, for every task holds the vectors and sums of all systems in it; neighbouring
    strengths go together, as they take about as many steps.  The stars are cached once for all.

    Returns for each strength the shifted solution and its outcome; an unconverged one raises.
    """
    if default is None:
        known = nodes.join(zpterm, ["expnum", "ccdnum"]).select((F.col("zpterm") + F.lit(offset)).alias("t"))
        default = scalar_median(known, "t")
        default = offset if default is None else default
    pull = N.prior_terms(nodes, zpterm, 1.0, offset, default).groupBy("i").agg(F.sum("d").alias("_d"), F.sum("b").alias("_b"))
    tags = {f"_{k}": lam for k, lam in enumerate(strengths)}
    together = max(1, TOGETHER_VALUES // max(1, system.unknowns.count()))
    out = {}
    with assembled(system, (), (), cfg.solve.tikhonov_reg, min(together, len(tags))) as (held, vec):
        # Links are dealt out anew for each recurrence, and no task holds a whole vector then.
        together = together if "pos" in held.columns else len(tags)
        pulled = stage.write(vec.join(pull, "i", "left").na.fill(0.0, ["_d", "_b"]), "cg-priors")
        for k in range(0, len(tags), together):
            some = dict(list(tags.items())[k:k + together])
            both = pulled.select("i", *[c for t, lam in some.items() for c in (
                (F.col("d") + F.lit(float(lam)) * F.col("_d")).alias("d" + t), (F.col("b") + F.lit(float(lam)) * F.col("_b")).alias("b" + t))])
            x, infos = conjugate_gradient(held, both, stage, cfg.solve.tolerance, cfg.solve.max_iterations, tuple(some))
            for t, lam in some.items():
                if not infos[t].converged:
                    raise RuntimeError(f"prior solve of strength {lam} stopped at relative residual {infos[t].relative_residual:.3g}")
                infos[t].mode = f"prior {lam}"
                out[lam] = (x.select(*node_columns("i"), F.col("x" + t).alias("zp_solved")), infos[t])
    return {lam: shift_to_anchors(zp, anchors, info, exclude) for lam, (zp, info) in out.items()}


def solve_gray(system: N.System, nodes: DataFrame, anchors: DataFrame, flat: DataFrame,
               exposure_mjd: DataFrame, cfg, stage: Stage):
    """Per-exposure solve, shifted to the anchors, expanded to gray + star flat per node.

    A node whose exposure is not an unknown keeps 0; an exposure without MJD uses epoch 0.
    """
    from lumitie.functions.epochs import epoch_index

    extra = []
    if cfg.starflat.gray_smooth_sigma > 0:
        extra.append(N.smoothness_links(system.unknowns.select(F.col("i").alias("expnum")),
                                        exposure_mjd, cfg.starflat.gray_smooth_sigma))
    x, info = _run(system, cfg, stage, extra_links=extra, tikhonov=cfg.solve.tikhonov_reg,
                   mode="unanchored_gray", must=False)
    gray = x.select(F.col("i").alias("expnum"), F.col("x").alias("gray"))
    # Anchor level of an exposure: median over its detectors, bounded by the camera.
    level = (nodes.select("expnum", "ccdnum").join(anchors.where(P.valid_zp(F.col("zp_fgcm"))),
                                                   ["expnum", "ccdnum"])
             .groupBy("expnum").agg(F.median("zp_fgcm").alias("level")))
    diff = gray.join(level, "expnum").select((F.col("gray") - F.col("level")).alias("o"))
    info.offset = scalar_median(diff, "o") or 0.0
    gray = gray.withColumn("gray", F.col("gray") - F.lit(info.offset))

    bounds = cfg.starflat.epoch_boundaries.all_ccds
    placed = (nodes.select("expnum", "ccdnum").join(gray, "expnum", "left")
              .join(exposure_mjd.select("expnum", "mjd"), "expnum", "left")
              .withColumn("epoch_idx", F.coalesce(epoch_index(F.col("mjd"), bounds), F.lit(0)))
              .join(flat, ["ccdnum", "epoch_idx"], "left"))
    zp = F.when(F.col("gray").isNotNull(),
                F.col("gray") + F.coalesce("flat_correction", F.lit(0.0))).otherwise(F.lit(0.0))
    return placed.select("expnum", "ccdnum", zp.alias("zp_solved")), gray, info


def zeropoint_table(zp: DataFrame, anchors: DataFrame, band: str) -> DataFrame:
    """Solution with its reference and their difference (NULL without a reference)."""
    joined = zp.join(anchors.select("expnum", "ccdnum", "zp_fgcm"), ["expnum", "ccdnum"], "left")
    return joined.select("expnum", "ccdnum", F.lit(band).alias("band"), "zp_solved", "zp_fgcm",
                         (F.col("zp_solved") - F.col("zp_fgcm")).alias("delta_zp"))


def diagnostics(table: DataFrame) -> DataFrame:
    """One row of solution statistics against the valid anchors."""
    from lumitie.operators.robust import attach_scalar, quantiles

    valid = P.valid_zp(F.col("zp_fgcm"))
    d = F.when(valid, F.col("delta_zp"))
    base = table.agg(F.count(F.lit(1)).alias("n_params"), F.count(d).alias("n_des"),
                     F.stddev_pop("zp_solved").alias("zp_std"),
                     F.sqrt(F.avg(d * d)).alias("des_diff_rms"),
                     F.max(F.abs(d)).alias("des_diff_max"))
    med_zp = quantiles(table, "zp_solved", {"zp_median": 0.5}).agg(F.max("zp_median").alias("zp_median"))
    med_d = (quantiles(table.where(valid), "delta_zp", {"m": 0.5})
             .agg(F.max("m").alias("des_diff_median")))
    return attach_scalar(attach_scalar(base, med_zp), med_d)
