"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text: each step doubles it and adds the random value of
the next byte, so it depends on the last 32 bytes alone.  A chunk ends where the hash is the
smallest within ``REACH`` bytes on either side.  Ends depend only on the bytes around them, so equal passages get
equal chunks wherever they stand, whatever was inserted before; and chunks cannot be shorter than ``REACH``.

Chunks are deduplicated by a 128-bit digest.  Half of it is counted first, with a partial aggregation before the
shuffle, so a chunk that fills a third of the corpus arrives as one row per task.  A filter of bounded
size then holds the chunks that may be repeated, and only those are moved with their places.  Neighbouring
repeated chunks form a run; runs of at least ``LEAST_BYTES`` are reported, in a passage for each source of their chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumitie.llm.prefilter import Prefilter
from lumitie.sources.stage import Stage

REACH = 20
LEAST_BYTES = 80
WINDOW = 32
PIECE = 4 << 20
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of gear values, doubled for each byte since; 32 bits hold 32 bytes."""
    out = _GEAR[data]
    width = 1
    while width < WINDOW:
        shifted = np.zeros_like(out)
        shifted[width:] = out[:-width] if width < len(out) else 0
        out = out + (shifted << np.uint32(width))
        width *= 2
    return out


def _smallest(values: np.ndarray, reach: int) -> np.ndarray:
    """Minimum over the next ``reach`` values, by doubling."""
    out, width = values.copy(), 1
    while width < reach:
        step = min(width, reach - width)
        out[:-step] = np.minimum(out[:-step], out[step:])
        width += step
    return out


def chunk_ends(data: bytes) -> np.ndarray:
    """Ends (exclusive) of the chunks of a text, the last one at its end."""
    n = len(data)
    ends = []
    margin = WINDOW + REACH
    for at in range(0, n, PIECE):
        low, high = max(0, at - margin), min(n, at + PIECE + REACH)
        codes = np.frombuffer(data, np.uint8, high - low, low)
        hashes = gear_hashes(codes)
        hashes[:-1][(codes[1:] & 0xC0) == 0x80] = 0xFFFFFFFF  # no end inside a character
        padded = np.concatenate([np.full(REACH, 0xFFFFFFFF, np.uint32), hashes, np.full(REACH, 0xFFFFFFFF, np.uint32)])
        before = _smallest(padded, REACH)[:len(hashes)]
        after = _smallest(padded[REACH + 1:], REACH)[:len(hashes)]
        cut = low + np.flatnonzero((hashes < before) & (hashes <= after)) + 1
        ends.append(cut[(cut > at) & (cut <= min(n, at + PIECE)) & (cut >= REACH) & (cut < n)])
    return np.concatenate([*ends, [n]]).astype(np.int64) if n else np.zeros(0, np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), idx, start, stop (bytes), d1, d2 (digest) of every chunk; null and empty texts have none."""
    part = docs.select("doc_id", F.xxhash64("text").alias("t"), F.col("text").alias("_text"))
    names = ["doc_id", "t", "idx", "start", "stop", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                piece = batch.slice(at, 128)
                counts, idx, starts, stops, digests = [], [], [], [], []
                for text in piece.column(2).to_pylist():
                    data = text.encode("utf-8", "surrogatepass") if text else b""
                    ends = chunk_ends(data)
                    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                    counts.append(len(ends))
                    idx.append(np.arange(len(ends)))
                    starts.append(begins)
                    stops.append(ends)
                    digests += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                rows = pa.array(np.repeat(np.arange(len(counts)), counts))
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(rows) for c in piece.columns[:2]], *[pa.array(np.concatenate(x).astype(np.int32)) for x in (idx, starts, stops)],
                     pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names)

    return part.mapInArrow(run, f"doc_id {part.schema['doc_id'].dataType.simpleString()}, t long, idx int, start int, stop int, d1 long, d2 long")


def repeated_passages(docs: DataFrame, stage: Stage, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """doc_id, t, start, stop, first_doc_id, keep: the passages of each text that occur elsewhere, in bytes of UTF-8.

    Runs of neighbouring repeated chunks of at least ``least_bytes`` are divided into passages where the place of the first
    occurrence changes, so a passage may be shorter.  ``keep`` marks passages that occur here first: in the smallest
    doc_id, then by text and place; first_doc_id is where all chunks of the passage occur first.  Rows with the same id
    and text are one document, so they do not repeat each other; a null id comes first.  Documents without repeated
    passages give no row.
    """
    found = stage.write(chunks(docs), "chunks")
    place = F.struct("doc_id", "t", "idx")
    each = F.xxhash64("doc_id", "t", "idx")
    often = stage.write(found.groupBy("d1").agg(F.min(each).alias("a"), F.max(each).alias("b")).where("a <> b").select(F.col("d1").alias("key")),
                        "often")
    near = Prefilter(often, stage).keep(found, "d1")
    digests = near.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    again = (near.join(digests.select("d1", "d2", "first"), ["d1", "d2"])
             .select("doc_id", "t", "idx", "start", "stop", (place == F.col("first")).alias("is_first"), F.col("first.doc_id").alias("from"))
             .dropDuplicates(["doc_id", "t", "idx"]))
    order = Window.partitionBy("doc_id", "t").orderBy("idx")
    run = Window.partitionBy("doc_id", "t", "run")
    alike = Window.partitionBy("doc_id", "t", "is_first", "from").orderBy("idx")
    return (again.withColumn("run", F.col("idx") - F.row_number().over(order))
            .withColumn("bytes", F.max("stop").over(run) - F.min("start").over(run)).where(F.col("bytes") >= least_bytes)
            .withColumn("piece", F.col("idx") - F.row_number().over(alike))
            .groupBy("doc_id", "t", "is_first", "from", "piece").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
            .select("doc_id", "t", "start", "stop", F.col("from").alias("first_doc_id"), F.col("is_first").alias("keep")))


def without_repeats(docs: DataFrame, stage: Stage, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text``, but for their first occurrence; other columns stay."""
    spans = (repeated_passages(docs, stage, least_bytes).where("not keep").groupBy("doc_id", "t")
             .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_spans"))
             .select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "_spans"))
    joined = docs.withColumn("_h", F.xxhash64("text")).join(
        spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_t")), "left")

    @F.udf("string")
    def cut(text: str | None, spans: list | None) -> str | None:
        if text is None or not spans:
            return text
        data, at, out = text.encode("utf-8", "surrogatepass"), 0, []
        for start, stop in spans:
            out.append(data[at:start])
            at = stop
        return b"".join([*out, data[at:]]).decode("utf-8", "ignore")

    return joined.select(*[cut("text", "_spans").alias(c) if c == "text" else F.col(c) for c in docs.columns])


def report(docs: DataFrame, stage: Stage) -> DataFrame:
    """Per repeated passage: doc_id, start, stop, n_bytes, first_doc_id, keep."""
    return repeated_passages(docs, stage).select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_bytes"),
                                                 "first_doc_id", "keep")
