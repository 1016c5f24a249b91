"""Audit of how far the sources of a language diverge in their use of words.

Texts are counted inside the tasks that read them, so that a task sends one row per language, source and term that it saw since its
last flush.  A language keeps the terms of enough documents.  Its kept terms are dealt to shards by hash and
numbered inside a shard, and each source has one sorted array of (term id, count) in each shard; a shard's size does not
depend on the corpus.  Sources of a language are dealt to blocks and every pair of blocks gets its own key, so a pair task meets
two arrays of one shard and no task meets all sources at once.

A pair task finds the overlap of the two arrays by galloping: the shorter one is walked in steps, each of which moves a
window through the longer one by doubling.  It prices terms of both, terms of one alone, and reports how many terms it
saw; the absent ones all cost the same and are priced at the end.  Both directions come from one visit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumitie.llm.batches import small_batches
from lumitie.sources.stage import Stage

LEAST_DOCUMENTS = 3
TOP = 200
#: Probabilities are counted in parts of this.
UNIT = 1_000_000_000
#: Kept terms of a shard and sources of a block, about.
SHARD_TERMS, BLOCK_SOURCES = 16_384, 8
#: Terms a task holds before it sends its counts on.
HELD_TERMS = 200_000
#: Parts that share the work of a language where its sizes are looked up.
PARTS = 32
# Fixed value: a term is a run of characters that are Latin letters or beyond ASCII.
TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms_of(text: str) -> list[str]:
    """The terms of a text in order; A to Z alone are lower-cased, which is what lower() does to bytes."""
    return TERM.findall(text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), in parts; a null term for each group that occurs."""
    small_batches(docs.sparkSession)
    part = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def rows():
            for (lang, source), (n, seen) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(n) + 1)), pa.array([source] * (len(n) + 1)), pa.array([None, *n], pa.string()),
                     pa.array([0, *n.values()], pa.int64()), pa.array([0, *[seen[t] for t in n]], pa.int64())], names)
            held.clear()

        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for lang, source, text in zip(*[c.to_pylist() for c in batch.slice(k, 64).columns]):
                    n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                    before = len(n)
                    terms = terms_of(text)
                    n.update(terms)
                    seen.update(set(terms))
                    size += len(n) - before + 1
                if size >= HELD_TERMS:
                    yield from rows()
                    size = 0
        yield from rows()

    return part.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _divided(x: np.ndarray, m: int) -> np.ndarray:
    """floor(UNIT * x / m), exactly, for 0 <= x <= m below 9e15: long division by thousands."""
    out, rest = np.zeros_like(x), x
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // m
        rest = rest % m
    return out


def probability(count: np.ndarray, total: int, v: int) -> np.ndarray:
    """Smoothed probabilities in parts of UNIT, at least 1."""
    return 1 + _divided(np.asarray(count, np.int64) + 1, total + v)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); the square stays below 2^63 as both are at most UNIT + 1."""
    return (p - q) * (p - q) // q


def gallop(short: np.ndarray, long: np.ndarray, stride: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common ids of two sorted arrays without repeats, in each of them."""
    at, here, there = 0, [], []
    for k in range(0, len(short), stride):
        ids = short[k:k + stride]
        step, end = stride, at
        while end < len(long) and long[end] < ids[-1]:
            end += step
            step *= 2
        end = min(end + 1, len(long))
        place = at + np.searchsorted(long[at:end], ids)
        inside = place < end
        inside[inside] = long[place[inside]] == ids[inside]
        here.append(k + np.flatnonzero(inside))
        there.append(place[inside])
        at = int(place[-1])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *here]), np.concatenate([empty, *there])


def both_ways(a: tuple, b: tuple, v: int) -> tuple[int, int, int]:
    """Price of a from b, of b from a, and the number of terms in either; each is (ids, counts, total of the source)."""
    if len(a[0]) > len(b[0]):
        back, forth, seen = both_ways(b, a, v)
        return forth, back, seen
    i, j = gallop(a[0], b[0])
    only_a, only_b = np.ones(len(a[0]), bool), np.ones(len(b[0]), bool)
    only_a[i] = False
    only_b[j] = False
    pa_, pb = probability(a[1], a[2], v), probability(b[1], b[2], v)
    none_a, none_b = probability(np.zeros(1), a[2], v), probability(np.zeros(1), b[2], v)
    sides = [(pa_[i], pb[j]), (pa_[only_a], none_b), (none_a, pb[only_b])]
    return (sum(int(price(p, q).sum()) for p, q in sides), sum(int(price(q, p).sum()) for p, q in sides), len(a[0]) + int(only_b.sum()))


def pair_sums(arrays: DataFrame) -> DataFrame:
    """lang, a, b, forth, back, seen of each unordered pair (a < b) of sources with terms in a shard.

    ``arrays`` has lang, shard, source, ids, counts, total, v, blocks.
    """
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    mine = arrays.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    mine = mine.select("lang", "shard", low.alias("low"), high.alias("high"), "block", "source", "ids", "counts", "total", "v")
    left, right = mine.alias("l"), mine.alias("r")
    keys = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("lang", "shard", "low", "high")]
    # within one block of sources the pair has one task; between two blocks one side comes from each
    once = (F.col("l.low") == F.col("l.high")) | (F.col("l.block") != F.col("r.block"))
    met = left.join(right, [*keys, F.col("l.source") < F.col("r.source"), once]).select(
        "l.lang", F.col("l.source").alias("a"), F.col("r.source").alias("b"), "l.v",
        *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("ids", "counts", "total")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                piece, out = batch.slice(k, 64), []
                values = [[c[i].values.to_numpy(zero_copy_only=False) for i in range(piece.num_rows)] if pa.types.is_list(c.type) else c.to_pylist()
                          for c in piece.columns[3:]]
                for v, *sides in zip(*values):
                    out.append(both_ways(tuple(sides[:3]), tuple(sides[3:]), v))
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], *[pa.array(x, pa.int64()) for x in zip(*out)]],
                                                 ["lang", "a", "b", "forth", "back", "seen"])

    return met.mapInArrow(run, "lang string, a string, b string, forth long, back long, seen long")


def _p(count: str, total: str, v: str) -> str:
    """The probability as an SQL expression, by the same long division."""
    m, rest, out = f"greatest({total} + {v}, 1L)", f"({count} + 1L)", "0L"
    for _ in range(3):
        rest = f"({rest} * 1000L)"
        out, rest = f"({out} * 1000L + {rest} div {m})", f"({rest} % {m})"
    return f"(1L + {out})"


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return df.withColumn("rank", F.row_number().over(order).cast("int"))


def _pairs(groups: DataFrame) -> DataFrame:
    """Unordered pairs of the groups of a language, by blocks: lang, a, b, total_a, total_b, v."""
    mine = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine = mine.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "source", "total", "v")
    left, right = mine.alias("l"), mine.alias("r")
    keys = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("lang", "low", "high")]
    once = (F.col("l.low") == F.col("l.high")) | (F.col("l.block") != F.col("r.block"))
    return left.join(right, [*keys, F.col("l.source") < F.col("r.source"), once]).select(
        "l.lang", F.col("l.source").alias("a"), F.col("r.source").alias("b"), F.col("l.total").alias("total_a"), F.col("r.total").alias("total_b"), "l.v")


def audit(docs: DataFrame, stage: Stage, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: for each source of a language each other one, with the price of the first from the second over all kept terms.
    Part ``term``: the ``top`` kept terms that a source has more often than its language, with their prices.  Null text, lang and
    source are empty strings; each row is a document, repeated ones too; groups without terms take part in pairs.  An empty
    table gives no row.  Other columns are not read.  Exact up to 9e15 occurrences of a language.
    """
    counts = stage.write(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    known = counts.where("term is not null")
    kept = known.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_documents)
    kept = stage.write(kept.drop("docs"), "kept")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    shards = F.ceil(F.col("v") / SHARD_TERMS).cast("long")
    part = F.pmod(F.xxhash64("term", F.lit(2)), F.lit(PARTS)).cast("int")
    dealt = kept.withColumn("part", part).join(sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["lang", "part"])
    numbered = (dealt.drop("part").withColumn("shard", F.pmod(F.xxhash64("term"), shards)).repartition("lang", "shard")
                .withColumn("id", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")).cast("long")))
    mine = stage.write(known.drop("docs").join(numbered, ["lang", "term"]), "mine")
    groups = counts.where("term is null").select("lang", "source")
    totals = mine.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SOURCES).cast("int").alias("blocks"))
    groups = stage.write(groups.join(totals, ["lang", "source"], "left").join(sizes.select("lang", "v"), "lang", "left").join(blocks, "lang")
                         .na.fill(0, ["total", "v"]), "groups")
    # a source without terms in a shard still meets the others there
    every = groups.where("v > 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)))
    arrays = (every.join(mine.groupBy("lang", "shard", "source").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("x")),
                         ["lang", "shard", "source"], "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<id:bigint,n:bigint>>")))
              .withColumns({"ids": F.col("x.id"), "counts": F.col("x.n")}).drop("x"))
    sums = pair_sums(arrays).groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("forth", "back", "seen")])
    none = _pairs(groups).join(sums, ["lang", "a", "b"], "left").na.fill(0, ["forth", "back", "seen"])
    none = none.withColumn("p", F.expr(_p("0L", "total_a", "v"))).withColumn("q", F.expr(_p("0L", "total_b", "v")))

    def way(source: str, item: str, seen: str, p: str, q: str) -> Column:
        price_absent = f"(({p} - {q}) * ({p} - {q})) div {q}"
        return F.struct(F.col(source).alias("source"), F.col(item).alias("item"),
                        F.expr(f"if(v = 0, 0L, {seen} + (v - seen) * ({price_absent}))").alias("value"))

    pairs = none.select("lang", F.explode(F.array(way("a", "b", "forth", "p", "q"), way("b", "a", "back", "q", "p"))).alias("w")).select("lang", "w.*")
    priced = (mine.where("n > 0").join(totals, ["lang", "source"])
              .select("lang", "source", F.col("term").alias("item"), F.expr(_p("n", "total", "v")).alias("p"), F.expr(_p("lang_n", "lang_total", "v")).alias("q"))
              .where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value")))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return (_ranked(pairs).withColumn("part", F.lit("pair")).select(out)
            .unionByName(_ranked(priced).where(F.col("rank") <= top).withColumn("part", F.lit("term")).select(out)))
