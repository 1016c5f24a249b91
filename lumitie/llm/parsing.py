"""Repeated byte strings by prefix-free parsing.

A rolling hash over ``WINDOW`` bytes names triggers, and triggers cut texts into phrases; being chosen by their own bytes alone,
they stand at the same places of equal strings.  Where no trigger follows within ``REACH`` bytes, a phrase is cut at denser
triggers, and where even these fail, at every byte.  So each string of ``LENGTH`` bytes reads as the end of a phrase
of at most ``REACH`` bytes and the text from the trigger after it, its anchor.

* Parse: only anchors whose next ``FIRM`` bytes occur at another anchor too can belong to a repeated string (or, for strings that end
  sooner after their anchor, the next ``SURE`` bytes).  Their
  contexts, ``LENGTH`` bytes from the anchor, are brought into order: equal ones become one entry, the entries are
  divided by range, sorted, and compared with their neighbours, which gives the longest match of each anchor.
* Dictionary: suffixes of a phrase matter only where a repeated run begins or breaks off.  Such a suffix, of a bytes, is
  combined with its anchor's place in the order when that anchor matches LENGTH - a bytes at least; equal pairs of suffix and context
  are repeated strings.  Between two anchors whose whole contexts repeat every byte is covered already.

Contexts and strings are compared by 128-bit digests.  Equal texts are one text; a text of ``LENGTH`` bytes or more with a copy
goes as a whole.  Counting is aggregated before every shuffle, joins on very common keys are salted, and what one task holds
together never exceeds one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumitie.llm.batches import small_batches
from lumitie.llm.hot import salted_join
from lumitie.llm.prefilter import Prefilter
from lumitie.sources.stage import Stage

LENGTH = 400
WINDOW, REACH = 16, 256
SURE = LENGTH - REACH
#: Bytes after an anchor that every string holds whose anchor is nearer than LENGTH - FIRM to its start, as most are.
FIRM = 272
#: A trigger on average every 64 bytes, a denser one every 8.
SPARSE, DENSE = 63, 7
PIECE = 1 << 20
#: Bytes of short texts that are parsed together.
GROUP = 1 << 18
#: Contexts in a range of the order, about.
RANGE_ROWS = 50_000
_VALUES = np.random.default_rng(12).integers(1, 1 << 32, 256, dtype=np.uint32)
_BASE = 0x9E3779B1


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes that start at each place, by doubling; 32 bits, of which the high ones are well mixed."""
    out, width, base = _VALUES[data], 1, _BASE
    while width < WINDOW:
        out = out[:-width] + out[width:] * np.uint32(base)
        width, base = 2 * width, base * base & 0xFFFFFFFF
    return (out ^ (out >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)


def triggers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of dense triggers, and which of them are triggers; a trigger is a dense one too."""
    places, sparse = [], []
    for at in range(0, len(data) - WINDOW + 1, PIECE):
        codes = _rolling(data[at:at + PIECE + WINDOW - 1])
        dense = np.flatnonzero((codes & DENSE) == 0)
        places.append(dense + at)
        sparse.append((codes[dense] & SPARSE) == 0)
    return (np.concatenate(places), np.concatenate(sparse)) if places else (np.zeros(0, np.int64), np.zeros(0, bool))


def _cover(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (anchor, first, last start) for the starts of the ranges low..high that have one of ``places`` within REACH bytes; the ranges left."""
    a, b = np.searchsorted(places, low), np.searchsorted(places, high + REACH + 1)
    n = b - a
    stops, some = np.cumsum(n), n > 0
    begins = stops - n
    at = places[np.arange(n.sum()) + np.repeat(a - begins, n)]
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[begins[some]] = low[some] - 1
    ceiling = np.repeat(high, n)
    first, last = np.maximum(before + 1, at - REACH), np.minimum(at, ceiling)
    keep = first <= last
    gaps = (first - before > 1) & (before + 1 <= ceiling)
    end = low - 1
    end[some] = at[stops[some] - 1]
    tail = end < high
    left = np.concatenate([before[gaps] + 1, end[tail] + 1]), np.concatenate([np.minimum(first[gaps] - 1, ceiling[gaps]), high[tail]])
    return np.stack([at[keep], first[keep], last[keep]], 1), *left


def anchors(data: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Rows (anchor, first start, last start): for each start of a string of LENGTH bytes in a text, which anchor it has.

    ``data`` may hold several texts of these ``sizes``, one after the other, which saves most of the cost of short texts.  No
    string crosses from one to the next, and a trigger that does is out of the reach of all strings.
    """
    sizes = np.array([len(data)]) if sizes is None else sizes
    ends = np.cumsum(sizes)
    low, high = (ends - sizes)[sizes >= LENGTH], (ends - LENGTH)[sizes >= LENGTH]
    if not len(low):
        return np.zeros((0, 3), np.int64)
    places, sparse = triggers(data)
    near, *left = _cover(places[sparse], low, high)
    dense, low, high = _cover(places, *left)
    n = high - low + 1
    alone = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
    out = np.concatenate([near, dense, np.repeat(alone[:, None], 3, 1)]).astype(np.int64)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _two(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """td (digest of the text) and the text itself."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.unhex(F.md5(value)).alias("td"), value.alias("text")).where(F.octet_length("text") >= LENGTH)


def _together(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray, np.ndarray]]:
    """Batches of at most ``rows`` rows and, but for single texts, GROUP bytes; their texts joined, sizes and anchors."""
    for batch in batches:
        held = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < len(held):
            room = (held[at - 1] if at else 0) + GROUP
            end = max(at + 1, min(at + rows, int(np.searchsorted(held, room, "right"))))
            piece = batch.slice(at, end - at)
            texts = [_bytes(t) for t in piece.column(1).to_pylist()]
            data, sizes = b"".join(texts), np.array([len(t) for t in texts], np.int64)
            yield piece, data, sizes, anchors(np.frombuffer(data, np.uint8), sizes)
            at = end


def starts_of_anchors(texts: DataFrame) -> DataFrame:
    """td, at, q: every anchor of each text with a hash of the FIRM bytes from it.

    A string whose anchor stands more than LENGTH - FIRM bytes after its start holds fewer of them; for such strings the anchors that serve
    them give a second row, with a hash of SURE bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, sizes, mine in _together(batches):
            ends = np.cumsum(sizes)
            row = np.searchsorted(ends, mine[:, 1], "right")
            near, far = mine[:, 0] + FIRM <= ends[row], mine[:, 0] - mine[:, 1] > LENGTH - FIRM
            hashes = [xxhash.xxh3_64_intdigest(data[a:a + FIRM]) for a in mine[near, 0].tolist()]
            hashes += [xxhash.xxh3_64_intdigest(data[a:a + SURE], 1) for a in mine[far, 0].tolist()]
            at = mine[:, 0] - (ends - sizes)[row]
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(np.concatenate([row[near], row[far]]))), pa.array(np.concatenate([at[near], at[far]])),
                                              pa.array(np.array(hashes, np.uint64).view(np.int64))], ["td", "at", "q"])

    return texts.select("td", "text").mapInArrow(run, "td binary, at long, q long")


def _of_anchors(batches: Iterator[pa.RecordBatch], rows: int = 4096):
    """td, the joined bytes, and for the anchors in ``ats``, some at a time, (anchor, first start, last start), their text's begin and end."""
    for piece, data, sizes, mine in _together(batches):
        ends = np.cumsum(sizes)
        wanted = [np.array(ats.values) + at for ats, at in zip(piece.column(2), (ends - sizes).tolist())]
        mine = mine[np.isin(mine[:, 0], np.concatenate(wanted))]
        for k in range(0, len(mine), rows):
            some = mine[k:k + rows]
            row = np.searchsorted(ends, some[:, 1], "right")
            yield piece.column(0).take(pa.array(row)), data, some, (ends - sizes)[row], ends[row]


def _places(kept: DataFrame) -> DataFrame:
    """The anchors in ``ats``: td, at, first, last (starts they serve), g (hash of the bytes from the first start to the anchor),
    q and c1, c2 (digest of the context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for td, data, some, begin, end in _of_anchors(batches):
            at, first, _ = some.T.tolist()
            stop = np.minimum(some[:, 0] + LENGTH, end).tolist()
            g = [xxhash.xxh3_64_intdigest(data[b:a]) for a, b in zip(at, first)]
            q = [xxhash.xxh3_64_intdigest(data[a:a + SURE]) for a in at]
            yield pa.RecordBatch.from_arrays(
                [td, *[pa.array(np.ascontiguousarray(c)) for c in (some - begin[:, None]).T],
                 *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (g, q)],
                 *_two([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(at, stop)])], ["td", "at", "first", "last", "g", "q", "c1", "c2"])

    return kept.select("td", "text", "ats").mapInArrow(run, "td binary, at long, first long, last long, g long, q long, c1 long, c2 long")


#: Contexts that a task holds back to merge equal ones.
HELD_CONTEXTS = 20_000
_ENTRY = pa.schema([("q", pa.int64()), ("rest", pa.binary()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int64())])


def _entries(kept: DataFrame) -> DataFrame:
    """q, rest (the context beyond SURE bytes), c1, c2, n: the contexts of the anchors in ``ats``, equal ones merged inside a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def rows() -> pa.RecordBatch:
            keys = _two(list(held))
            n, q, rest = zip(*held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.array(q, np.uint64).view(np.int64)), pa.array(rest, pa.binary()), *keys, pa.array(n, pa.int64())],
                                              schema=_ENTRY)

        for _, data, some, _, end in _of_anchors(batches):
            for a, b in zip(some[:, 0].tolist(), np.minimum(some[:, 0] + LENGTH, end).tolist()):
                part = data[a:b]
                key = xxhash.xxh3_128_digest(part)
                if key in held:
                    held[key][0] += 1
                else:
                    held[key] = [1, xxhash.xxh3_64_intdigest(part[:SURE]), part[SURE:]]
            if len(held) >= HELD_CONTEXTS:
                yield rows()
        if held:
            yield rows()

    return kept.select("td", "text", "ats").mapInArrow(run, "q long, rest binary, c1 long, c2 long, n long")


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def _neighbours(rows: Iterator[list]) -> Iterator[list]:
    """Rows (q, rest, c1, c2, n, match) in order, equal contexts merged, each with the longest prefix it shares with the one before or after it."""
    last = None
    for row in rows:
        if last is not None and row[2] == last[2] and row[3] == last[3]:
            last[4] += row[4]
            continue
        if last is not None:
            if row[0] == last[0]:
                same = SURE + _shared(row[1], last[1])
                row[5], last[5] = max(row[5], same), max(last[5], same)
            yield last
        last = row
    if last is not None:
        yield last


def in_order(entries: DataFrame, stage: Stage, ranges: int) -> DataFrame:
    """c1, c2, n, match: the distinct contexts with the length of their longest match.

    A context that occurs more than once matches over its whole size.  Others are compared with the neighbours in the order by
    (q, rest).  The first and last entry of each range are staged as well and compared across ranges: two rows
    for each range, in one task.
    """
    order = entries.repartitionByRange(ranges, "q", "rest").sortWithinPartitions("q", "rest")
    edge = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), ("match", pa.int32()), ("q", pa.int64()), ("rest", pa.binary())])

    def out(rows: list[list], names: list[str]) -> pa.RecordBatch:
        columns = dict(zip(("q", "rest", "c1", "c2", "n", "match"), zip(*rows) if rows else [()] * 6))
        return pa.RecordBatch.from_arrays([pa.array(columns[k], edge.field(k).type) for k in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, last, first = [], None, True
        parts = (batch.slice(at, 2048) for batch in batches for at in range(0, batch.num_rows, 2048))
        for row in _neighbours([*r, 0] for part in parts for r in zip(*[c.to_pylist() for c in part.columns])):
            if row[4] > 1:
                row[5] = SURE + len(row[1])
            if last is not None:
                done.append(last if first else [None, None, *last[2:]])
                first = False
            last = row
            if len(done) == 4096:
                yield out(done, edge.names)
                done = []
        yield out([*done, last] if last is not None else done, edge.names)

    ordered = stage.write(order.mapInArrow(run, "c1 long, c2 long, n long, match int, q long, rest binary"), "order")
    inner = ordered.where("rest is null").select("c1", "c2", "n", "match")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = ("q", "rest", "c1", "c2", "n", "match")
        rows = _neighbours(list(r) for batch in batches for r in zip(*[batch.column(k).to_pylist() for k in order]))
        yield out(list(rows), edge.names[:4])

    edges = ordered.where("rest is not null").coalesce(1).sortWithinPartitions("q", "rest")
    matches = stage.write(inner.unionByName(edges.mapInArrow(across, "c1 long, c2 long, n long, match int")), "matches")
    stage.drop(ordered)
    return matches


def with_runs(anchor: DataFrame) -> DataFrame:
    """Anchors with ``inside``: the whole context repeats, as that of another anchor up to LENGTH bytes before its first start."""
    whole = F.col("match") >= LENGTH
    before = Window.partitionBy("td").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = anchor.withColumn("before", F.max(F.when(whole, F.col("at"))).over(before))
    inside = whole & F.col("before").isNotNull() & (F.col("before") <= F.col("first")) & (F.col("at") - F.col("before") <= LENGTH)
    return seen.withColumn("inside", inside).drop("before")


def ends_of_runs(anchor: DataFrame) -> DataFrame:
    """td, first, last: ranges of starts whose strings are compared one by one, from the table of ``with_runs``.

    A start can begin a repeated string only if its anchor matches over the rest of it.  Between an anchor whose whole
    context repeats and another such anchor up to LENGTH bytes before it, all bytes are covered, so these starts only serve as
    evidence for others: they are taken once for equal suffix and context, where a run begins or breaks off
    at the same SURE bytes elsewhere.
    """
    seen = (anchor.withColumn("last", F.least("last", F.col("at") - F.greatest(F.lit(0), LENGTH - F.col("match"))))
            .where(F.col("first") <= F.col("last")))
    ends = seen.where(~F.col("inside"))
    other = (seen.where("inside").groupBy("c1", "c2", "g", "q").agg(F.min(F.struct("td", "first", "last")).alias("one"))
             .join(ends.select("q").distinct(), "q", "left_semi").select("one.*"))
    return ends.select("td", "first", "last").unionByName(other)


def suffixes(marked: DataFrame) -> DataFrame:
    """td, at, s1, s2: the starts in ``ranges`` and a digest of each phrase suffix with its anchor's context, LENGTH bytes in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = _bytes(batch.column(1)[row].as_py())
                todo = [i for r in batch.column(2)[row].as_py() for i in range(r["first"], r["last"] + 1)]
                for k in range(0, len(todo), 4096):
                    some = todo[k:k + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[row].as_py()] * len(some), pa.binary()), pa.array(some, pa.int64()),
                         *_two([xxhash.xxh3_128_digest(data[i:i + LENGTH]) for i in some])], ["td", "at", "s1", "s2"])

    return marked.select("td", "text", "ranges").mapInArrow(run, "td binary, at long, s1 long, s2 long")


def spans_of(starts: list[int] | np.ndarray) -> np.ndarray:
    """Maximal runs [from, to) covered by strings of LENGTH bytes at these starts."""
    at = np.unique(np.asarray(starts, np.int64))
    if not len(at):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(at) > LENGTH)
    return np.stack([at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + LENGTH], 1)


def _cut(marked: DataFrame) -> DataFrame:
    """td, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) by the starts of repeated strings in ``starts``."""
    import hashlib

    schema = pa.schema([("td", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for td, text, starts in zip(*[c.to_pylist() for c in batch.columns]):
                data, spans = _bytes(text), spans_of(starts)
                out, at = [], 0
                for low, high in spans.tolist():
                    out.append(data[at:low])
                    at = high
                kept = b"".join([*out, data[at:]])
                yield pa.RecordBatch.from_pylist([{"td": td, "n_removed": len(data) - len(kept), "n_spans": len(spans),
                                                   "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept}], schema)

    return marked.select("td", "text", "starts").mapInArrow(
        run, "td binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeated(docs: DataFrame, stage: Stage, text: str = "text") -> DataFrame:
    """Distinct texts with bytes to remove: td (MD5 of the text), n_removed, n_spans, kept_sha256, kept.

    A byte goes if a string of LENGTH bytes over it also starts anywhere else in the corpus.  Null texts are empty, and texts
    below LENGTH bytes have nothing to remove; both give no row.  Rows with equal texts are copies of each other: their text
    goes as a whole.
    """
    small_batches(docs.sparkSession)
    texts = _texts(docs, text)
    found = starts_of_anchors(texts)
    place = F.xxhash64("td", "at")
    often = stage.write(found.groupBy("q").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n"))
                        .where("a <> b").select("q", "n"), "often")
    may = Prefilter(often.select(F.col("q").alias("key")), stage).keep(found, "q")
    again = salted_join(may, often, ["q"], F.struct("td", "at")).select("td", "at").distinct()
    ats = stage.write(again.groupBy("td").agg(F.sort_array(F.collect_list("at")).alias("ats")), "ats")
    mine = Prefilter(ats.select(F.col("td").alias("key")), stage).keep(texts, "td")
    kept, seen = stage.write(mine.groupBy("td").agg(F.first("text").alias("text")).join(ats, "td"), "texts", {"n": F.coalesce(F.sum(F.size("ats")), F.lit(0))})
    for done in (often, ats):
        stage.drop(done)
    order = in_order(_entries(kept), stage, max(1, -(-seen["n"] // RANGE_ROWS)))
    anchor = salted_join(_places(kept), order, ["c1", "c2"], F.struct("td", "at"))
    useful = (F.col("match") >= LENGTH) | (F.col("match") + F.col("at") - F.col("first") >= LENGTH)
    anchor = stage.write(with_runs(anchor.where(useful).drop("n")), "anchors")
    stage.drop(order)
    ranges = ends_of_runs(anchor).groupBy("td").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    ends = stage.write(suffixes(kept.join(ranges, "td")), "suffixes")
    equal = stage.write(ends.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "equal")
    starts = (salted_join(ends, equal, ["s1", "s2"], F.struct("td", "at")).select("td", "at")
              .unionByName(anchor.where(F.col("match") >= LENGTH).select("td", "at"))
              .groupBy("td").agg(F.collect_list("at").alias("starts")))
    out = stage.write(_cut(kept.join(starts, "td")), "cut")
    for done in (kept, anchor, ends, equal):
        stage.drop(done)
    return out


def report(docs: DataFrame, stage: Stage, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    value = F.coalesce(F.col(text), F.lit(""))
    cut = repeated(docs, stage, text).select("td", "n_removed", "n_spans", "kept_sha256")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(value)).alias("td"), F.octet_length(value).cast("long").alias("n_bytes"),
                       F.sha2(value, 256).alias("whole"))
    copies = rows.where(F.col("n_bytes") >= LENGTH).groupBy("td").agg(F.count(F.lit(1)).alias("n"))
    known = stage.write(copies.join(cut, "td", "left").where("n > 1 or n_removed is not null"), "known")
    alone = F.col("n") == 1
    return salted_join(rows, known, ["td"], F.col("doc_id"), "left").select(
        "doc_id", "n_bytes",
        F.when(alone, F.col("n_removed")).when(F.col("n") > 1, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(alone, F.col("n_spans")).when(F.col("n") > 1, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(alone, F.col("kept_sha256")).when(F.col("n") > 1, F.sha2(F.lit(""), 256)).otherwise(F.col("whole")).alias("kept_sha256"))
