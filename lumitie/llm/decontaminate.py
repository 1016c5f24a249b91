"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is a short set of word shingles that may lie inside a long document.  Containment of
``t`` gives a usable Jaccard similarity only between sets of like size, so both sides are partitioned by size:
items by powers of two, and for each class documents are cut into windows of twice its
upper bound that overlap by half, so that a passage as long as an item lies within one window.  For each pair of size classes
the lowest similarity that containment allows sets the rows per band, as in an ensemble of LSH indexes.
A candidate is verified by the exact containment of the item's shingles in the whole document.

Only windows holding a shingle that some item selected as a minimum can match, so no other window is hashed.

Items are indexed in blocks of bounded size, each sent to all tasks and met by every
document: no document is moved, and the number of items is not limited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumitie.llm.batches import small_batches
from lumitie.llm.shingle import WORDS, MinHash, mixed, shingle_hashes, word_hashes
from lumitie.sources.stage import Stage

HASHES = 64
#: A pair at the threshold is missed with at most this probability by the choice of rows per band.
MISS = 1e-6
ROWS = (4, 2, 1)
BLOCK_ITEMS, BLOCK_SHINGLES = 20_000, 2_000_000
FILTER_BITS = 22
FOUND = "n_shared integer, n_item integer, containment double"


def size_class(n: int) -> int:
    """Smallest c with n <= 2**c."""
    return max(0, int(n - 1).bit_length())


def rows_per_band(threshold: float, item_class: int, window_size: int) -> int:
    """Most rows that keep the chance of missing a contained item below MISS; one row if none does."""
    low, high = 2 ** (item_class - 1) + 1 if item_class else 1, 2 ** item_class
    similarity = min(threshold * n / (window_size + n - threshold * n) for n in (low, high))
    for rows in ROWS:
        if (1 - similarity ** rows) ** (HASHES // rows) <= MISS:
            return rows
    return 1


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of MinHash values."""
    bands = values.astype(np.uint64).reshape(-1, rows)
    key = np.arange(len(bands), dtype=np.uint64) + np.uint64(rows << 32)
    for j in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, j])
    return key


@dataclass
class _Class:
    """Items of one shingle width and size class: sorted band keys with their items, by rows per band."""

    keys: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[int, np.ndarray] = field(default_factory=dict)


@dataclass
class Index:
    """A block of items: ids, shingle sets, band keys, and a filter of the shingles that are a minimum."""

    ids: list
    sets: list[np.ndarray]
    classes: dict[tuple[int, int], _Class]
    minima: dict[int, np.ndarray]
    filters: dict[int, np.ndarray]
    threshold: float


def build_index(items: list[tuple], threshold: float) -> Index:
    """Index of (id, word hashes); items without words are left out."""
    hasher = MinHash(HASHES)
    ids, sets, found, minima = [], [], {}, {}
    for item, words in items:
        width = min(WORDS, len(words))
        if not width:
            continue
        shingles = np.unique(shingle_hashes(words, width))
        at = len(ids)
        ids.append(item)
        sets.append(shingles)
        values = (shingles * hasher.factors + hasher.terms) >> np.uint64(32)
        minima.setdefault(width, set()).update(shingles[values.argmin(axis=1)].tolist())
        for rows in ROWS:
            keys = band_keys(values.min(axis=1).astype(np.uint32), rows)
            found.setdefault((width, size_class(len(shingles))), {}).setdefault(rows, []).append((keys, np.full(len(keys), at, np.int64)))
    classes: dict[tuple[int, int], _Class] = {}
    for name, by_rows in found.items():
        classes[name] = _Class()
        for rows, parts in by_rows.items():
            keys, items_ = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(keys, kind="stable")
            classes[name].keys[rows], classes[name].items[rows] = keys[order], items_[order]
    sorted_minima = {w: np.array(sorted(m), np.uint64) for w, m in minima.items()}
    filters = {}
    for w, m in sorted_minima.items():
        filters[w] = np.zeros(1 << FILTER_BITS, bool)
        filters[w][m >> np.uint64(64 - FILTER_BITS)] = True
    return Index(ids, sets, classes, sorted_minima, filters, threshold)


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which values are in a sorted, non-empty array."""
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def search(text: str | None, index: Index, hasher: MinHash) -> list[tuple]:
    """(item id, shingles shared, shingles of the item) of the items that a whole text contains."""
    words = word_hashes(text)
    out = []
    for width in sorted(index.minima):
        shingles = shingle_hashes(words, width)
        maybe = np.flatnonzero(index.filters[width][shingles >> np.uint64(64 - FILTER_BITS)])
        if not len(maybe):
            continue
        hits = maybe[_member(shingles[maybe], index.minima[width])]
        if not len(hits):
            continue
        candidates: set[int] = set()
        for (w, c), part in index.classes.items():
            if w != width:
                continue
            step = 2 ** c
            # a hit lies in the window that begins with its step and in the one before
            starts = np.unique(np.concatenate([hits // step, hits // step - 1])) * step
            for start in starts[(starts >= 0) & ((starts == 0) | (starts + step < len(shingles)))].tolist():
                window = np.unique(shingles[start:start + 2 * step])
                rows = rows_per_band(index.threshold, c, 2 ** size_class(len(window)))
                keys = band_keys(hasher.values(window), rows)
                low, high = (np.searchsorted(part.keys[rows], keys, side) for side in ("left", "right"))
                for a, b in zip(low[high > low].tolist(), high[high > low].tolist()):
                    candidates.update(part.items[rows][a:b].tolist())
        if candidates:
            own = np.unique(shingles)
            for at in sorted(candidates):
                item = index.sets[at]
                shared = int(_member(item, own).sum())
                if shared >= index.threshold * len(item):
                    out.append((index.ids[at], shared, len(item)))
    return out


def blocks(items: DataFrame, item_id: str, text: str, threshold: float) -> Iterator[Index]:
    """Indexes of bounded size over all items, one after the other; null and empty texts are left out."""
    small_batches(items.sparkSession)
    block, size = [], 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        words = word_hashes(row["t"])
        block.append((row["i"], words))
        size += len(words)
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_SHINGLES:
            yield build_index(block, threshold)
            block, size = [], 0
    if block:
        yield build_index(block, threshold)


def _pairs(docs: DataFrame, shared, keep: list[str], item_type) -> DataFrame:
    part = docs.select(*keep, F.col("text").alias("_text"))
    schema = StructType(list(part.drop("_text").schema.fields)).add("item_id", item_type)
    for name, kind in (c.split() for c in FOUND.split(", ")):
        schema = schema.add(name, kind)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(HASHES)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = [(i, *hit) for i, t in enumerate(piece.column(piece.num_columns - 1).to_pylist())
                         for hit in search(t, shared.value, hasher)]
                if found:
                    rows = pa.array([f[0] for f in found], pa.int64())
                    kept = [c.take(rows) for c in piece.columns[:-1]]
                    new = [pa.array([f[1] for f in found]), pa.array([f[2] for f in found], pa.int32()),
                           pa.array([f[3] for f in found], pa.int32()), pa.array([f[2] / f[3] for f in found], pa.float64())]
                    yield pa.RecordBatch.from_arrays([*kept, *new], names)

    return part.mapInArrow(run, schema)


def contained_items(docs: DataFrame, items: DataFrame, stage: Stage, threshold: float = 0.8, keep=("doc_id",),
                    item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The columns ``keep`` with item_id, n_shared, n_item and containment, a row per document row and item contained in it.

    Null and empty texts contain nothing and are contained nowhere.  Items shorter than a shingle are one
    shingle of all their words.  Repeated rows on either side give repeated results.
    """
    spark, item_type, parts = docs.sparkSession, items.schema[item_id].dataType, []
    for index in blocks(items, item_id, text, threshold):
        shared = spark.sparkContext.broadcast(index)
        parts.append((_pairs(docs, shared, list(keep), item_type), shared))
        if len(parts) > 1:  # more than one block: write each, so that one index at a time is in memory
            parts = [(p if s is None else stage.write(p, "pairs"), s) for p, s in parts]
            for _, s in parts:
                if s is not None:
                    s.destroy()
            parts = [(p, None) for p, _ in parts]
    if not parts:
        return _pairs(docs, spark.sparkContext.broadcast(build_index([], threshold)), list(keep), item_type)
    out = parts[0][0]
    for p, _ in parts[1:]:
        out = out.unionByName(p)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs`` that contain no item, all columns as they are."""
    spark, where = docs.sparkSession, docs.columns.index("text")
    for index in blocks(items, "item_id", "text", threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hasher = MinHash(HASHES)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    piece = batch.slice(at, 256)
                    clean = [not search(t, shared.value, hasher) for t in piece.column(where).to_pylist()]
                    yield piece.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
