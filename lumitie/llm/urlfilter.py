"""URL filters: host and path rules first, then a cascade of Bloom filters over hosts.

The cascade holds a list exactly.  Level 1 encodes the listed keys.  The keys of the universe
that pass it without being listed are encoded by level 2, the listed keys that pass level 2
by level 3, and so on until a level lets nothing wrong through.  A key's answer is the first
level that refuses it.  For keys of the universe the answer is exact.

A level is cut into shards of 32,768 bits, the size of Spark's bitmaps.  Up to
``MAX_LITERAL_BYTES`` it enters the plan as a constant, so that probing needs no join; a larger
one stays a table and is joined by shard, and no shard grows with the list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumitie.sources.stage import Stage

SHARD_BITS = 32_768
SHARD_BYTES = SHARD_BITS // 8
MAX_LITERAL_BYTES = 256 << 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: str = "url") -> Column:
    """After the first ``://``, ASCII letters in lower case; empty for null or a url without it."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), URL, 1), UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), URL, 2)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def longest_rule(rules: list[Rule], host_: Column, path_: Column) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null; of equal lengths the smaller text wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Level:
    """One Bloom filter: its shards as one constant, or as a table (shard, bits)."""

    number: int
    shards: int
    hashes: int
    data: bytes | None
    table: DataFrame | None = None

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-self.number)), F.lit(self.shards)).cast("int")

    def positions(self, key: Column) -> list[Column]:
        a, b = (F.xxhash64(key, F.lit(2 * self.number + i)) for i in (0, 1))
        return [F.pmod(F.shiftrightunsigned(a, 8) + F.lit(i) * F.shiftrightunsigned(b, 8), F.lit(SHARD_BITS)).cast("int")
                for i in range(self.hashes)]

    def _set(self, bits: Column, first: Column, key: Column) -> Column:
        """Whether all of the key's bits are set in ``bits``, from byte ``first`` on."""
        found = F.lit(True)
        for p in self.positions(key):
            byte = F.conv(F.hex(F.substring(bits, first + F.shiftright(p, 3) + 1, F.lit(1))), 16, 10).cast("int")
            found = found & (F.getbit(byte, p % 8) == 1)
        return found

    def probe(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with a boolean column: may the key be in this level?"""
        k = F.col(key)
        if self.data is not None:
            return df.withColumn(name, self._set(F.lit(self.data), self.shard(k) * SHARD_BYTES, k))
        joined = df.withColumn("_shard", self.shard(k)).join(self.table.withColumnRenamed("shard", "_shard"), "_shard", "left")
        return joined.withColumn(name, F.coalesce(self._set(F.col("_bits"), F.lit(0), k), F.lit(False))).drop("_shard", "_bits")


def _bitmaps(keys: DataFrame, level: Level) -> DataFrame:
    """Table (shard, _bits) of the level's filter over the column ``key``."""
    return (keys.select(level.shard(F.col("key")).alias("shard"), F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
            .groupBy("shard").agg(F.bitmap_construct_agg("p").alias("_bits")))


def _literal(bits: DataFrame, shards: int) -> bytes:
    """The shards as one constant; the caller has bounded their number."""
    data = bytearray(shards * SHARD_BYTES)
    for row in bits.collect():
        data[row["shard"] * SHARD_BYTES:(row["shard"] + 1) * SHARD_BYTES] = row["_bits"]
    return bytes(data)


def build_level(keys: DataFrame, number: int, count: int, rate: float, stage: Stage,
                max_literal: int = MAX_LITERAL_BYTES) -> Level:
    """Encode distinct ``key`` values with about the given rate of false positives."""
    hashes = max(1, round(-math.log2(rate)))
    shards = max(1, math.ceil(count * 1.44 * -math.log2(rate) / SHARD_BITS))
    level = Level(number, shards, hashes, None)
    bits = _bitmaps(keys, level)
    if shards * SHARD_BYTES > max_literal:
        level.table = stage.write(bits, f"level{number}")
    else:
        level.data = _literal(bits, shards)
    return level


def build_cascade(universe: DataFrame, stage: Stage, max_literal: int = MAX_LITERAL_BYTES) -> list[Level]:
    """Levels for ``universe``: distinct non-null ``key`` and a boolean ``listed``.

    An empty list gives no level: nothing is listed.
    """
    state = universe.select("key", F.col("listed").alias("_a"), (~F.col("listed")).alias("_b"))
    levels: list[Level] = []
    while True:
        seen = state.agg(F.count_if("_a").alias("a"), F.count_if("_b").alias("b")).first()
        if not seen["a"]:
            return levels
        rate = 0.5 if levels else min(0.5, max(1e-6, seen["a"] / (math.sqrt(2) * max(1, seen["b"]))))
        level = build_level(state.where("_a"), len(levels) + 1, seen["a"], rate, stage, max_literal)
        levels.append(level)
        state = (level.probe(state, "key", "_pass")
                 .select("key", (F.col("_b") & F.col("_pass")).alias("_n"), F.col("_a").alias("_b"))
                 .withColumnRenamed("_n", "_a"))
        if level.table is not None:
            state = stage.write(state, f"state{level.number}")


def member(df: DataFrame, key: str, levels: list[Level], name: str = "listed") -> DataFrame:
    """``df`` with the exact answer for keys of the universe; a null key is not listed."""
    answer = F.lit(bool(len(levels) % 2))
    for level in levels:
        df = level.probe(df, key, f"_pass{level.number}")
    for level in reversed(levels):
        answer = F.when(F.col(f"_pass{level.number}"), answer).otherwise(F.lit(level.number % 2 == 0))
    return (df.withColumn(name, answer & F.col(key).isNotNull() if levels else F.lit(False))
            .drop(*[f"_pass{level.number}" for level in levels]))


def judge(pages: DataFrame, rules: list[Rule], universe: DataFrame, stage: Stage,
          max_literal: int = MAX_LITERAL_BYTES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict.

    A rule's verdict stands; other pages are blocked if their host is listed.  Null urls and
    urls without ``://`` have empty host and path, fit no rule and are allowed.  Repeated rows
    are judged each; other columns are left out.
    """
    rows = pages.select("page_id", host().alias("host"), path().alias("path"))
    levels = build_cascade(universe, stage, max_literal)
    judged = member(rows, "host", levels, "_listed").withColumn("_rule", longest_rule(rules, F.col("host"), F.col("path")))
    own = F.when(F.col("_listed") & (F.col("host") != ""), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce(F.col("_rule.verdict"), own).alias("verdict"))


def tracking_hosts(pages: DataFrame) -> DataFrame:
    """Universe of hosts; listed are those of which at least a third of the urls carry tracking parameters."""
    tracked = F.coalesce(F.col("url").rlike(r"[?&](utm_[a-z]+|ref)="), F.lit(False))
    return (pages.groupBy(host().alias("key")).agg(F.count_if(tracked).alias("_t"), F.count(F.lit(1)).alias("_n"))
            .select("key", ((F.col("key") != "") & (3 * F.col("_t") >= F.col("_n"))).alias("listed")))
