"""Which rank owns an entry: even, near-even and round-robin plans as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even_rank(i: Column, n, world: int) -> Column:
    """Blocks of ceil(n / world); the last ranks may have fewer or none."""
    return F.expr("0") if world == 1 else F.floor(i / F.ceil(F.lit(n) / world)).cast("long")


def even_start(rank: Column, n, world: int) -> Column:
    return F.least(rank * F.ceil(F.lit(n) / world), F.lit(n)).cast("long")


def near_even_rank(i: Column, n: int, world: int) -> Column:
    """The first n % world ranks own one more."""
    q, r = divmod(n, world)
    return F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(F.floor((i - r * (q + 1)) / max(1, q)) + r).cast("long")


def near_even_start(rank: Column, n: int, world: int) -> Column:
    q, r = divmod(n, world)
    return (rank * q + F.least(rank, F.lit(r))).cast("long")


def round_robin(i: Column, block: int, world: int) -> tuple[Column, Column]:
    """(rank, slot in the rank) of an entry dealt in blocks."""
    b = F.floor(i / block)
    return (b % world).cast("long"), (F.floor(b / world) * block + i % block).cast("long")
