"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one part in ``SHARE`` of the rows is dealt over ``PARTS`` parts; there are at most SHARE such keys.
SHARE, PARTS, LEAST = 500, 64, 1_000


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread, how: str = "inner", n: str = "n") -> DataFrame:
    """``many`` joined with ``few``, which has one row per key and in ``n`` how many rows of ``many`` the key has.

    Rows of ``many`` with a very common key are dealt by the hash of the column ``spread``; the key's row in ``few`` is
    repeated for each part.  The broadcast list of common keys has at most SHARE rows by its definition.  ``few`` is
    read more than once, so it should be a staged table.  Null keys find nothing.
    """
    total = few.agg(F.sum(n)).first()[0] or 0
    limit = max(total // SHARE, LEAST)
    common = few.where(F.col(n) > limit).select(*keys, F.lit(True).alias("_common"))
    dealt = (many.join(F.broadcast(common), keys, "left")
             .withColumn("_part", F.when(F.col("_common"), F.pmod(F.xxhash64(spread), F.lit(PARTS))).otherwise(F.lit(0)).cast("int"))
             .drop("_common"))
    last = F.when(F.col(n) > limit, F.lit(PARTS - 1)).otherwise(F.lit(0))
    return dealt.join(few.withColumn("_part", F.explode(F.sequence(F.lit(0), last))), [*keys, "_part"], how).drop("_part")
