"""N-gram Jaccard join with Bayesian candidate pruning.

Texts of the same words are merged first, so copies count once.  Each distinct text has the set of its
five-word shingles and MinHash values; texts that agree in all values of a band are candidates.  Inside a band
bucket the values are compared a few at a time, and a pair is dropped as soon as the posterior probability that
its similarity reaches the threshold is below a tolerance.  The pairs that survive join texts to
clusters, inside which every pair is verified by its exact shingle sets.

Pairs never become rows.  Buckets and clusters are cut into blocks of bounded size, blocks meet in pairs, a task
compares two blocks as matrices and returns a forest over the matches and the links of each text.
The pairs of blocks of a group are dealt in squares of bounded size, each by its own key, and nothing grows with a group
but their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumitie.llm.batches import small_batches
from lumitie.llm.prefilter import Prefilter
from lumitie.llm.shingle import MinHash, shingle_set, word_hashes
from lumitie.operators.graph import connected_components
from lumitie.sources.stage import Stage

THRESHOLD = 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8**4)**24, about 3e-6.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Posterior probability of reaching the threshold below which a pair is dropped.
TOLERANCE = 1e-6
STEPS = (16, 32, 64, HASHES)
BUCKET_BLOCK = 256
CLUSTER_BLOCK, CLUSTER_SHINGLES = 128, 400_000
COLUMNS = 1 << 14
#: Blocks along a side of a square of block pairs; a square is dealt to a task by itself.
SPAN = 8


@lru_cache
def least_matches(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among so many compared values for which a pair is kept.

    Values are compared by their low byte, which agrees with probability s + (1 - s) / 256.  With a uniform prior the
    posterior is a beta distribution, whose upper tail is a binomial sum.
    """
    rate, trials = threshold + (1 - threshold) / 256, compared + 1
    tail = 0.0
    for m in range(compared + 1):
        tail += math.comb(trials, m) * rate ** m * (1 - rate) ** (trials - m)
        if tail >= tolerance:
            return m
    return compared


def content_key(words: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(words.tobytes()) + len(words).to_bytes(4, "big")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, t1 and t2 (hashes of the text), content (words), n (shingles), bands and low bytes of the MinHash values.

    content is null for a text without words.
    """
    small_batches(docs.sparkSession)
    part = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.col("text"), F.lit(7)).alias("t2"), F.col("text").alias("_text"))
    schema = (StructType(list(part.drop("_text").schema.fields)).add("content", "binary").add("n", "integer")
              .add("bands", "binary").add("low", "binary"))
    names = schema.names

    def one(text: str | None, hasher: MinHash) -> tuple:
        words = word_hashes(text)
        if not len(words):
            return None, 0, None, None
        shingles = shingle_set(words)
        values = hasher.values(shingles)
        return content_key(words), len(shingles), values.tobytes(), values.astype(np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, kinds = MinHash(HASHES), (pa.binary(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                made = list(zip(*(one(t, hasher) for t in piece.column(3).to_pylist())))
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], *[pa.array(m, k) for m, k in zip(made, kinds)]], names)

    return part.mapInArrow(run, schema)


def _roots(adjacent: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row of its component."""
    root = np.full(len(adjacent), -1)
    for i in range(len(adjacent)):
        if root[i] < 0:
            members = frontier = np.zeros(len(adjacent), bool)
            members[i] = True
            while frontier.any():
                reached = adjacent[frontier].any(axis=0) & ~members
                members = members | reached
                frontier = reached
            root[members] = i
    return root


def _block_pairs(blocks: DataFrame, key: str) -> DataFrame:
    """Rows (a, b) of blocks that must meet; b is null where a block is compared with itself.

    ``blocks``: key, block, blocks (their number under the key), m (members).
    """
    alone = blocks.select(F.col("m").alias("a"), F.lit(None).cast(blocks.schema["m"].dataType).alias("b"), F.col("blocks"), F.col(key).alias("key"))
    several = blocks.where("blocks > 1").select(F.col(key).alias("key"), "block", "m", "blocks", F.expr(f"block div {SPAN}").alias("own"))
    # a row for each square of the grid of pairs that a block takes part in, so that no task has to do a whole group
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(blocks - 1) div {SPAN}"))).alias("other")
    each = several.select("*", other)
    left = each.where("own <= other").select("key", F.col("own").alias("down"), F.col("other").alias("across"), F.col("block").alias("i"),
                                             F.col("m").alias("a"), "blocks")
    right = each.where("own >= other").select("key", F.col("other").alias("down"), F.col("own").alias("across"), F.col("block").alias("j"),
                                              F.col("m").alias("b"))
    met = left.join(right, ["key", "down", "across"]).where(F.col("i") < F.col("j")).select("a", "b", "blocks", "key")
    return alone.unionByName(met)


def _compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Boolean matrix of the pairs that no step prunes."""
    keep = np.ones((len(a), len(b)), bool)
    rows, columns = np.nonzero(keep)
    matches, done = np.zeros(len(rows), np.int32), 0
    for upto in STEPS:
        for k in range(done, upto):
            matches += a[rows, k] == b[columns, k]
        alive = matches >= least_matches(upto)
        rows, columns, matches, done = rows[alive], columns[alive], matches[alive], upto
    keep[:] = False
    keep[rows, columns] = True
    return keep


def surviving_edges(contents: DataFrame, stage: Stage) -> DataFrame:
    """Edges (u, v) between rids that connect all candidate pairs which pruning leaves."""
    bands = contents.select("rid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(
        b, F.substring(F.col("bands"), b * (4 * ROWS) + 1, F.lit(4 * ROWS))))).alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = (bands.join(shared, "band")
               .withColumn("blocks", F.ceil(F.col("size") / BUCKET_BLOCK).cast("int"))
               .withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
               .join(contents.select("rid", "low"), "rid"))
    blocks = members.groupBy("band", "block", "blocks").agg(F.collect_list(F.struct("rid", "low")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[int, int]] = set()
            for at in range(batch.num_rows):
                a, b = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                both = a + (b or [])
                low = np.frombuffer(b"".join(x["low"] for x in both), np.uint8).reshape(len(both), HASHES)
                if b is None:
                    adjacent = _compare(low, low)
                else:
                    adjacent = np.zeros((len(both), len(both)), bool)
                    adjacent[:len(a), len(a):] = _compare(low[:len(a)], low[len(a):])
                    adjacent |= adjacent.T
                out.update((both[i]["rid"], both[r]["rid"]) for i, r in enumerate(_roots(adjacent).tolist()) if r != i)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sorted(out))], ["u", "v"])

    return _block_pairs(blocks, "band").select("a", "b").mapInArrow(run, "u long, v long").distinct()


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of shared shingles, some columns of the incidence matrix at a time."""
    every, place = np.unique(np.concatenate(left + right), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    order = np.argsort(place, kind="stable")
    place, rows = place[order], rows[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(every), COLUMNS):
        a, b = np.searchsorted(place, (low, low + COLUMNS))
        dense = np.zeros((len(left) + len(right), min(COLUMNS, len(every) - low)), np.float32)
        dense[rows[a:b], place[a:b] - low] = 1
        out += dense[:len(left)] @ dense[len(left):].T
    return out


def verified_links(members: DataFrame) -> DataFrame:
    """rid, links, root, blocks from clusters: exact links to other texts, counted with their copies, and a forest over them.

    ``members``: cluster, rid, n, copies, text.  A text's rows must be summed, one for each pair of blocks.
    """
    sized = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK),
                                                      F.ceil(F.sum("n") / CLUSTER_SHINGLES)).cast("int").alias("blocks"))
    blocks = (members.join(sized, "cluster").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
              .groupBy("cluster", "block", "blocks").agg(F.collect_list(F.struct("rid", "copies", "text")).alias("m")))

    def one(a: list, b: list | None) -> Iterator[tuple[int, int, int]]:
        both = a + (b or [])
        sets = [shingle_set(word_hashes(x["text"])) for x in both]
        copies = np.array([x["copies"] for x in both])
        left, right = sets[:len(a)], sets[len(a):] if b is not None else sets
        shared = _shared_counts(left, right)
        sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])
        linked = shared >= THRESHOLD * (sizes - shared) - 1e-6
        adjacent = np.zeros((len(both), len(both)), bool)
        if b is None:
            np.fill_diagonal(linked, False)
            adjacent = linked
        else:
            adjacent[:len(a), len(a):] = linked
            adjacent |= adjacent.T
        counts = adjacent @ copies
        for i, r in enumerate(_roots(adjacent).tolist()):
            if counts[i]:
                yield both[i]["rid"], int(counts[i]), both[r]["rid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = list(one(batch.column(0)[at].as_py(), batch.column(1)[at].as_py()))
                if found:
                    many = batch.column(2)[at].as_py()
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in zip(*found)], pa.array([many] * len(found), pa.int32())],
                                                     ["rid", "links", "root", "blocks"])

    return (_block_pairs(blocks, "cluster").select("a", "b", "blocks")
            .mapInArrow(run, "rid long, links long, root long, blocks int"))


def _texts(docs: DataFrame, members: DataFrame, stage: Stage) -> DataFrame:
    """``members`` with their text; rows of ``docs`` that no member needs are left where they are."""
    keys = members.select(F.concat_ws(":", "t1", "t2").alias("key"))
    rows = docs.where("text is not null").select(F.xxhash64("text").alias("t1"), F.xxhash64(F.col("text"), F.lit(7)).alias("t2"), "text")
    near = Prefilter(keys, stage).keep(rows.withColumn("_key", F.concat_ws(":", "t1", "t2")), "_key").select("t1", "t2", "text")
    return members.join(near.groupBy("t1", "t2").agg(F.first("text").alias("text")), ["t1", "t2"])


def classes(docs: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Staged rows of ``signatures`` and a table content, rid, first_id, copies, root, links, of one row per distinct text."""
    rows = stage.write(signatures(docs.select("doc_id", "text")), "signatures")
    contents = stage.write(
        rows.where("content is not null").groupBy("content")
        .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("t1", "t2")).alias("t"),
             F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("low").alias("low"))
        .withColumn("rid", F.monotonically_increasing_id()), "contents")
    clusters = connected_components(surviving_edges(contents, stage), stage)
    members = stage.write(clusters.select(F.col("node").alias("rid"), F.col("component").alias("cluster"))
                          .join(contents.select("rid", "n", "copies", "t.t1", "t.t2"), "rid"), "members")
    found = stage.write(verified_links(_texts(docs, members, stage)), "links")
    whole = found.where("blocks = 1").select("rid", "root")
    cut = stage.write(found.where("blocks > 1 and rid <> root").select(F.col("rid").alias("u"), F.col("root").alias("v")).distinct(), "edges")
    if not cut.isEmpty():
        whole = whole.unionByName(connected_components(cut, stage).select(F.col("node").alias("rid"), F.col("component").alias("root")))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    table = (contents.select("content", "rid", "first_id", "copies", "t").join(whole.join(links, "rid"), "rid", "left")
             .select("content", "rid", "first_id", "copies", "t", F.coalesce("root", "rid").alias("root"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    return rows, stage.write(table, "classes")


def join_report(docs: DataFrame, stage: Stage) -> DataFrame:
    """Per document row: doc_id, class_id, n_links, class_size.

    Documents of similarity 0.8 or more are linked, copies included; a class is a connected component and
    its id the smallest doc_id in it (null if all are null).  n_links counts the other rows linked to a row.  A null
    text or one without words is linked to nothing and is its own class.
    """
    rows, table = classes(docs, stage)
    ids = table.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    known = table.join(ids, "root").select("content", "class_id", F.col("links").alias("n_links"), "class_size")
    own = rows.where("content is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                                               F.lit(1).cast("long").alias("class_size"))
    return (rows.where("content is not null").select("doc_id", "content").join(known, "content")
            .select("doc_id", "class_id", "n_links", "class_size").unionByName(own))


def one_of_each_class(docs: DataFrame, stage: Stage) -> DataFrame:
    """Rows of ``docs`` of which one of each class stays: the smallest doc_id, null ones last, then by hash of the text.

    Rows without words stay.  Only rows that may have to go are moved.
    """
    rows, table = classes(docs, stage)
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t1", "t2")
    known = (rows.where("content is not null").select("doc_id", "t1", "t2", "content")
             .join(table.select("content", "root"), "content"))
    keys = known.groupBy("root", "doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("rows"))
    best = known.groupBy("root").agg(F.min(order).alias("best"))
    judged = keys.join(best, "root").withColumn("keep", F.col("best") == order)
    touched = stage.write(judged.where("not keep or rows > 1").select("doc_id", "t1", "t2", "keep"), "touched")
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "t1", "t2")
    level = Prefilter(touched.select(name.alias("key")), stage)
    columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    marked = docs.select(*columns, "doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.col("text"), F.lit(7)).alias("t2"))
    marked = level.mark(marked.withColumn("_key", name), "_key", "_may")
    gone = touched.select(name.alias("_key"), "keep").distinct()
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]
    moved = marked.where("_may").join(gone, "_key", "left")
    once = moved.where("keep").dropDuplicates(["_key"])
    return (marked.where("not _may").select(*kept).unionAll(moved.where("keep is null").select(*kept)).unionAll(once.select(*kept)))
