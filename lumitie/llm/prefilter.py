"""A filter of bounded size for keys, so that rows without a partner need not be moved.

Each key sets three bits of one 64-bit word.  There are at most ``WORDS`` words, so the table may always be
broadcast; with more keys than it suits, it lets more rows through, and the join that follows stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 18
KEYS_PER_WORD = 6


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(3))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 6 * i), F.lit(64)).cast("int"))
            for i in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


class Prefilter:
    """Words of the distinct values of the column ``key`` of a table."""

    def __init__(self, keys: DataFrame, stage):
        self.words = min(WORDS, max(1, keys.count() // KEYS_PER_WORD))
        self.table = stage.write(keys.groupBy(self._word(F.col("key")).alias("_word")).agg(F.bit_or(_mask(F.col("key"))).alias("_bits")), "prefilter")

    def _word(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(self.words))

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with a boolean: false only if the key is not among the keys; null keys are false."""
        hit = F.col("_bits").bitwiseAND(_mask(F.col(key))) == _mask(F.col(key))
        return (df.withColumn("_word", self._word(F.col(key))).join(F.broadcast(self.table), "_word", "left")
                .withColumn(name, F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()).drop("_word", "_bits"))

    def keep(self, df: DataFrame, key: str) -> DataFrame:
        """Rows whose key may be among the keys."""
        return self.mark(df, key, "_may").where("_may").drop("_may")
