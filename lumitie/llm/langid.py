"""Language identification by a mixture of n-gram models.

Each language is a smoothed distribution over hashed letter trigrams.  A document is a mixture
of languages: expectation-maximisation estimates their shares, and languages are added to the
best single one only while the gain in log-likelihood exceeds a penalty.

The models are learnt from a bounded sample, about ``PER_LANGUAGE`` documents of each language, chosen by
the hash of their id.  Counts merge in Spark, and those above zero reach the driver and, once, each executor: at most
``BUCKETS`` of a language, 12 bytes each, for any number of languages.  Prediction is narrow and reads whole texts in
pieces; a text meets all languages, ``CELLS`` probabilities at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumitie.llm.batches import small_batches

#: Labelled documents per language that a model is learnt from, about.
PER_LANGUAGE = 2_000
BUCKETS = 1 << 15
#: Probabilities of a text's trigrams held at once.
CELLS = 1 << 22
SMOOTHING = 0.5
ROUNDS = 12
#: Gain in log-likelihood, times the logarithm of the number of trigrams, that one more language must bring.
PENALTY = 4.0
#: Neighbouring trigrams share letters, so this many count as one independent observation.
OVERLAP = 3.0
PIECE = 1 << 20

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigram_counts(text: str) -> np.ndarray | None:
    """Counts per bucket of the letter trigrams of a text, other characters folded to one blank; None without letters."""
    letters, counts, some = _letters(), np.zeros(BUCKETS, np.int64), False
    tail = np.zeros(1, np.uint32)
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = np.where(letters[points], points, 0).astype(np.uint32)
        some = some or bool(symbols.any())
        symbols = np.concatenate([tail, symbols, np.zeros(1 if at + PIECE >= len(text) else 0, np.uint32)])
        symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])]
        hashed = (symbols[:-2] * np.uint32(0x9E3779B1)) ^ (symbols[1:-1] * np.uint32(0x85EBCA6B) + symbols[2:]) * np.uint32(0xC2B2AE35)
        counts += np.bincount((hashed ^ (hashed >> np.uint32(16))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        tail = symbols[-2:]
    return counts if some else None


@dataclass
class Smoothed:
    """Smoothed trigram probabilities from the counts above zero, sorted by bucket; indexing gives rows of the full table."""

    starts: np.ndarray
    columns: np.ndarray
    counts: np.ndarray
    totals: np.ndarray

    @classmethod
    def of(cls, buckets: np.ndarray, columns: np.ndarray, counts: np.ndarray, languages: int) -> Smoothed:
        order = np.argsort(buckets, kind="stable")
        totals = SMOOTHING * BUCKETS + np.bincount(columns, counts, languages)
        return cls(np.searchsorted(buckets[order], np.arange(BUCKETS + 1)), columns[order].astype(np.int32), counts[order].astype(np.int64), totals)

    def __getitem__(self, buckets: np.ndarray) -> np.ndarray:
        sizes = self.starts[buckets + 1] - self.starts[buckets]
        rows = np.repeat(np.arange(len(buckets)), sizes)
        at = np.arange(len(rows)) + np.repeat(self.starts[buckets] - (np.cumsum(sizes) - sizes), sizes)
        out = np.full((len(buckets), len(self.totals)), SMOOTHING)
        out[rows, self.columns[at]] += self.counts[at]
        return out / self.totals


#: Gives the parts of a text: probabilities of some of its trigrams, one column per language, and their counts.
Parts = Callable[[], "Iterator[tuple[np.ndarray, np.ndarray]]"]


@dataclass
class Model:
    """Languages and their trigram probabilities, one column each."""

    languages: list[str]
    probabilities: np.ndarray | Smoothed

    def parts(self, at: np.ndarray, n: np.ndarray) -> Parts:
        """Parts of a text with counts ``n`` in the buckets ``at``; a single one is kept, several are made anew each time."""
        rows = max(1, CELLS // max(1, len(self.languages)))
        if len(at) <= rows:
            whole = [(self.probabilities[at], n)]
            return lambda: iter(whole)
        return lambda: ((self.probabilities[at[i:i + rows]], n[i:i + rows]) for i in range(0, len(at), rows))

    def shares(self, parts: Parts, columns: int, total: float) -> tuple[np.ndarray, float]:
        """Shares of the columns by expectation-maximisation, and the log-likelihood they reach."""
        share = np.full(columns, 1.0 / columns)
        for _ in range(ROUNDS):
            summed = np.zeros(columns)
            for p, n in parts():
                weighted = p * share
                summed += (n / weighted.sum(axis=1)) @ weighted
            share = summed / total
        return share, float(sum(n @ np.log(p @ share) for p, n in parts()))

    def mixture(self, counts: np.ndarray) -> tuple[dict[str, float], float, float]:
        """Selected languages with their shares; the score of the first; mean log-likelihood over that of a uniform source."""
        at = np.flatnonzero(counts)
        n = counts[at].astype(float)
        parts, total = self.parts(at, n), n.sum()
        single = sum(m @ np.log(p) for p, m in parts())
        chosen = [int(single.argmax())]
        share, best = np.ones(1), float(single.max())
        least = PENALTY * math.log(total + 1)
        if len(self.languages) > 1:
            overall, reach = self.shares(parts, len(self.languages), total)
            while reach - best >= least and len(chosen) < len(self.languages):
                extra = int(np.argmax(np.where(np.isin(np.arange(len(overall)), chosen), -1, overall)))
                some = [(p[:, [*chosen, extra]], m) for p, m in parts()]
                wider, value = self.shares(lambda some=some: iter(some), len(chosen) + 1, total)
                if value - best < least:
                    break
                chosen, share, best = [*chosen, extra], wider, value
        if len(chosen) == 1:
            score = 1 / float(np.exp((single - single.max()) / OVERLAP).sum())
        else:
            score = float(share.max())
        order = sorted(range(len(chosen)), key=lambda k: (-share[k], self.languages[chosen[k]]))
        return {self.languages[chosen[k]]: float(share[k]) for k in order}, score, best / total + math.log(BUCKETS)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no model is learnt from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame) -> Model:
    """Models from text and lang of the documents that are not held out; null texts and languages are left out."""
    small_batches(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    often = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PER_LANGUAGE)
    part = F.coalesce((F.lit(PER_LANGUAGE) / F.col("_n") * 1_000_000).cast("int"), F.lit(1_000_000))
    # at most a row of ``often`` for PER_LANGUAGE documents; the sample is sorted so that a task holds one language's counts at a time
    sample = (usable.join(F.broadcast(often), "lang", "left").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part)
              .select("text", "lang").sortWithinPartitions("lang"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(lang: str | None, total: np.ndarray) -> pd.DataFrame:
            at = np.flatnonzero(total)
            return pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": total[at]})

        last, total = None, np.zeros(BUCKETS, np.int64)
        for frame in frames:
            for text, lang in frame.itertuples(index=False):
                if lang != last:
                    yield rows(last, total)
                    last, total = lang, np.zeros(BUCKETS, np.int64)
                if (found := trigram_counts(text)) is not None:
                    total += found
        yield rows(last, total)

    found = (sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
             .toArrow().combine_chunks())
    languages = sorted(found["lang"].unique().to_pylist())
    column = pc.index_in(found["lang"], pa.array(languages, pa.string())).to_numpy()
    return Model(languages, Smoothed.of(found["bucket"].to_numpy(), column, found["n"].to_numpy(), len(languages)))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with lang_pred, score, languages and fit; ``text`` alone decides.

    A null text and one without any letter is ``und`` with score 0, as is every text if nothing was learnt.
    ``languages`` lists the mixture as ``language:share``, the largest first.  ``fit`` is the mean log-likelihood of a
    trigram under the mixture over that under a uniform source.  Each row stands for itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    part = docs.select(*[F.col(c) for c in keep], F.col("text").alias("_text"))

    def one(text: str | None) -> tuple[str, float, str, float]:
        counts = trigram_counts(text) if text else None
        if counts is None or not shared.value.languages:
            return "und", 0.0, "", 0.0
        shares, score, fit = shared.value.mixture(counts)
        return next(iter(shares)), score, ",".join(f"{k}:{v:.3f}" for k, v in shares.items()), fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found = [one(t) for t in piece.column(piece.num_columns - 1).to_pylist()]
                new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *new], [*keep, "lang_pred", "score", "languages", "fit"])

    schema = StructType(list(part.drop("_text").schema.fields))
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("languages", "string"), ("fit", "double")):
        schema = schema.add(name, kind)
    return part.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, languages."""
    model = learn(docs)
    return (predict(docs.select("doc_id", "text"), model, ["doc_id"])
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages"))


def in_learnt_language(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text has letters and is likelier in the learnt languages than from a uniform source."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    model = learn(docs)
    found = predict(docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)], "text"), model, names)
    return (found.where((F.col("lang_pred") != "und") & (F.col("fit") > 0))
            .select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)]))
