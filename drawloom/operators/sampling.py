"""Seeded samples with and without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.operators.batching import KEY_PRIME, ranked, shuffle_key


#: Multiplier and modulus of the portable generator (Park and Miller, 1988; fixed values).
LEHMER, LEHMER_PRIME = 48271, 2147483647


def uniform(number: Column, seed: int) -> Column:
    """A portable pseudo-random value in [0, 1) for each whole number."""
    first = F.pmod((number.cast("bigint") + 1) * LEHMER + seed * 104729, F.lit(LEHMER_PRIME))
    second = F.pmod(first * LEHMER, F.lit(LEHMER_PRIME))
    third = F.pmod(second * LEHMER + 12345, F.lit(LEHMER_PRIME))
    return (second + third / F.lit(float(LEHMER_PRIME))) / F.lit(float(LEHMER_PRIME))


def with_replacement(rows: DataFrame, count: int, seed: int) -> DataFrame:
    """`count` draws of row positions (draw, row...), a row possibly more than once.

    Positions are drawn by a portable generator from (seed, draw); what is broadcast are the `count` draws. No rows give no draws; a column `draw` of rows is replaced.
    """
    rows = rows.drop("draw")
    numbered = ranked(rows, shuffle_key(F.col("row_id"), seed), "row_id", KEY_PRIME, "__drawloom_at")
    n = rows.where(F.col("row_id").isNotNull()).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    draws = rows.sparkSession.range(count).select(F.col("id").cast("int").alias("draw")).join(F.broadcast(n))
    at = F.least(F.floor(uniform(F.col("draw"), seed) * F.col("n")).cast("bigint"), F.col("n") - 1) + 1
    return numbered.join(F.broadcast(draws.select("draw", at.alias("__drawloom_at"))), "__drawloom_at").drop("__drawloom_at")


def without_replacement(rows: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """`count` distinct rows by seeded hash; fewer rows than asked for raise an error."""
    picked = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).orderBy(F.md5(F.concat(F.lit(f"{seed}#"), F.col(key).cast("string"))), key).limit(count)
    have = picked.count()
    if have < count:
        raise ValueError(f"a sample of {count} was asked for, there are {have}")
    return picked
