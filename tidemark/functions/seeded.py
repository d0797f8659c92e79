"""Seeded shuffles inside one row, for item lists of bounded length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numeric import as_column
from tidemark.functions.text import UINT32

# Constants of the linear congruential generator and of the choice re-shuffle.
LCG_FACTOR = 1664525
LCG_INCREMENT = 1013904223
RESHUFFLE_MASK = 0x9E3779B1


def seeded_shuffle(items: Column | str, seed: Column | str) -> Column:
    """Walk the list from its end, swapping each place with a seeded earlier one."""
    items, seed = as_column(items), as_column(seed)
    places = F.sequence(F.size(items) - 1, F.lit(1), F.lit(-1))
    swap = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))
    drawn = F.struct(seed.cast("bigint").alias("state"), F.filter(F.array(swap), lambda _: F.lit(False)).alias("swaps"))

    def draw(acc: Column, i: Column) -> Column:
        # Both factors stay below 2**32, so the product fits a signed 64-bit integer.
        state = (acc["state"] * LCG_FACTOR + LCG_INCREMENT) % UINT32
        j = F.floor(state / F.lit(float(UINT32)) * (i + 1)).cast("int")
        swap = F.struct(i.alias("i"), j.alias("j"))
        return F.struct(state.alias("state"), F.array_append(acc["swaps"], swap).alias("swaps"))

    def exchange(list_: Column, swap: Column) -> Column:
        i, j = swap["i"], swap["j"]
        return F.transform(
            list_, lambda x, n: F.when(n == i, F.get(list_, j)).when(n == j, F.get(list_, i)).otherwise(x)
        )

    # All places are drawn first, and only places are swapped: an item is looked up once, whatever it holds.
    swaps = F.aggregate(places, drawn, draw)["swaps"]
    order = F.aggregate(swaps, F.sequence(F.lit(0), F.size(items) - 1), exchange)
    return F.when(F.size(items) < 2, items).otherwise(F.transform(order, lambda i: F.get(items, i)))


def reshuffle_seed(seed: Column | str) -> Column:
    """Seed of the second shuffle: exclusive or with a fixed mask, read as an unsigned number."""
    return as_column(seed).cast("bigint").bitwiseXOR(F.lit(RESHUFFLE_MASK).cast("bigint"))
