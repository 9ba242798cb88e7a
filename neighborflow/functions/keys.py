"""Deterministic random keys. A key is a hash of what identifies a draw, so results do not depend on partitioning and
plain SQL reproduces them. ``rand()`` is never used."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def key(*parts) -> Column:
    """Hex digest of the parts joined by bars; literals and columns mix."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def key_int(k: Column) -> Column:
    """63 bits of a key as a whole number from 0: the first 64 without their sign."""
    return F.conv(F.substring(k, 1, 16), 16, -10).cast("long").bitwiseAND(F.lit((1 << 63) - 1))


def uniform(k: Column) -> Column:
    """A number strictly between 0 and 1 from a key: the middle of one of 2^52 equal steps, which a double holds exactly."""
    return (F.shiftright(key_int(k), 11) + F.lit(0.5)) / F.lit(float(1 << 52))


def exponential_key(k: Column, weight: Column) -> Column:
    """ln(u) / w: the largest keys are a draw without replacement in proportion to the weights."""
    return F.ln(uniform(k)) / weight


def epoch_seed(seed: int, epoch: int) -> int:
    """The seed of an epoch: its own for the first, so that one epoch needs no other thought, and a hash of both for others."""
    return seed if epoch == 0 else int(md5(f"{seed}|epoch|{epoch}".encode()).hexdigest()[:8], 16)


def positive_ints(spark: SparkSession, seed: int, subsequence: int, n: int) -> DataFrame:
    """(pos, value): n whole numbers from 0 to 2^31 - 1, the same for a seed and subsequence wherever they are drawn."""
    return spark.range(n).select(F.col("id").alias("pos"), (key_int(key(seed, subsequence, F.col("id"))) % (1 << 31)).alias("value"))


#: Rounds of the bijection below; each moves one of the two digits of a number by a hash of the other.
ROUNDS = 4


def shuffled(x: Column, high: int, low: int, seed: int, role: str) -> Column:
    """A keyed bijection on 0 to high * low - 1: a Feistel network over the two digits of x to the base ``low``, whose
    ranges need not be equal."""
    b = x % low
    a = F.call_function("div", x - b, F.lit(low))
    for i in range(ROUNDS):
        if i % 2 == 0:
            a = (a + key_int(key(seed, role, i, b)) % high) % high
        else:
            b = (b + key_int(key(seed, role, i, a)) % low) % low
    return a * low + b


def permuted(rows: DataFrame, place: str, n: int, seed: int, role: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the image of ``place`` under a keyed bijection on 0 to n - 1, so different places get different
    numbers without any knowing of the others. The network's range is a little larger than n; a number past n goes
    through it again until it is inside. Fewer than sqrt(n) numbers lie outside, so few rows ever go again, and each
    does so at most as often as there are such numbers."""
    from math import isqrt

    from neighborflow.scratch import written

    high = isqrt(max(n - 1, 0)) + 1
    low = -(-n // high) or 1
    found = rows.withColumn(name, shuffled(F.col(place), high, low, seed, role))
    if high * low == n:
        return found
    found = written(found, "permuted")
    done, pending = found.where(F.col(name) < n), found.where(F.col(name) >= n)
    while not pending.isEmpty():
        again = written(pending.withColumn(name, shuffled(F.col(name), high, low, seed, role)), "permuted")
        done, pending = done.unionByName(again.where(F.col(name) < n)), again.where(F.col(name) >= n)
    return done
