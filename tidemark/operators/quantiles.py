"""Exact quantiles whose state stays small for any group size.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer. Here a mergeable
sketch first brackets the wanted quantile; values outside the bracket are then clamped to its ends,
which cannot move the quantile, and the exact aggregate only sees the distinct values inside.

Over a whole table the bracket is narrowed by further sketches of the rows inside it until at most
``INSIDE`` rows are left between its ends, so the state of the last step does not grow with the table.
Per key (``grouped_medians``) the brackets are a written table of one row a key; those of keys with many rows are
narrowed, round by round, by sketches of the rows inside, until no key has more than ``INSIDE`` rows between its ends.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import finite
from tidemark.operators.sequence import key_join
from tidemark.sources.writers import staged

ACCURACY = 20000
# Twice the rank error the sketch guarantees.
MARGIN = 2.0 / ACCURACY
SALTS = 16
# Steps of the sketch that narrows a key's bracket.
GRID = 256
# Rows that may lie strictly between the ends of a bracket when the exact aggregate runs.
INSIDE = 10_000


def _bracket(c: Column, q: float) -> Column:
    low, high = max(0.0, q - MARGIN), min(1.0, q + MARGIN)
    return F.percentile_approx(c, [low, high], ACCURACY)


def _clamped(c: Column, bracket: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, bracket[0]), bracket[1]))


def _share(q: float, n: int, below: int, inside: int) -> tuple[float, float]:
    """Where the two values around a quantile of ``n`` rows lie among the rows inside a bracket, with the margin."""
    rank = q * (n - 1)
    return (math.floor(rank) - below) / inside - MARGIN, (math.ceil(rank) + 1 - below) / inside + MARGIN


def _brackets(df: DataFrame, wanted: Sequence[tuple[str, float]]) -> list[tuple[float, float] | None]:
    """Per (column, quantile) the ends of a bracket with at most ``INSIDE`` rows strictly between them.

    A round keeps a share of about 6 / ``ACCURACY`` of the rows inside, so a table of 10^12 rows takes three
    sketches. A column without any value has no bracket.
    """
    every = range(len(wanted))
    row = df.agg(
        *[F.count(finite(c)).alias(f"n{i}") for i, (c, _) in enumerate(wanted)],
        *[_bracket(finite(c), q).alias(f"b{i}") for i, (c, q) in enumerate(wanted)],
    ).first()
    ends = [tuple(row[f"b{i}"]) if row[f"b{i}"] is not None else None for i in every]
    within = lambda i: (F.col(wanted[i][0]) > F.lit(ends[i][0])) & (F.col(wanted[i][0]) < F.lit(ends[i][1]))
    # The sketch's guarantee bounds the rows inside; they are counted only where it does not suffice.
    wide = [i for i in every if ends[i] and ends[i][0] < ends[i][1] and 3 * MARGIN * row[f"n{i}"] > INSIDE]
    while wide:
        counts = df.agg(
            *[F.count(F.when(finite(wanted[i][0]) <= F.lit(ends[i][0]), 1)).alias(f"l{i}") for i in wide],
            *[F.count(F.when(finite(wanted[i][0]).isNotNull() & within(i), 1)).alias(f"m{i}") for i in wide],
        ).first()
        wide = [i for i in wide if counts[f"m{i}"] > INSIDE]
        if not wide:
            break
        shares = {i: _share(wanted[i][1], row[f"n{i}"], counts[f"l{i}"], counts[f"m{i}"]) for i in wide}
        inner = df.agg(
            *[
                F.percentile_approx(
                    F.when(within(i), finite(wanted[i][0])), [min(max(x, 0.0), 1.0) for x in shares[i]], ACCURACY
                ).alias(f"b{i}")
                for i in wide
            ]
        ).first()
        for i in wide:
            low, high = inner[f"b{i}"]
            ends[i] = (low if shares[i][0] > 0 else ends[i][0], high if shares[i][1] < 1 else ends[i][1])
    return ends


def exact_quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """One row with ``<column>_q<n>`` (n-th entry of ``qs``) over the whole table, linear interpolation."""
    wanted = [(c, q) for c in columns for q in qs]
    names = [f"{c}_q{n}" for c in columns for n in range(len(qs))]
    values = []
    for (c, q), name, ends in zip(wanted, names, _brackets(df, wanted), strict=True):
        clamped = _clamped(finite(c), [F.lit(e) for e in ends]) if ends else F.lit(None).cast("double")
        values.append(F.percentile(clamped, q).alias(name))
    return df.agg(*values)


def fitted_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians as plain numbers for a fitted model. A column without any value gets 0."""
    exact = exact_quantiles(df, columns, [0.5]).first()
    return {c: 0.0 if exact[f"{c}_q0"] is None else exact[f"{c}_q0"] for c in columns}


def _rows_in(df: DataFrame, keys: Sequence[str], columns: Sequence[str], bounds: DataFrame) -> DataFrame:
    """Rows with the bounds of their key, a hot key spread over several tasks."""
    spread = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
    return key_join(df.withColumn("_salt", salt).select(*keys, *columns, "_salt"), spread, [*keys, "_salt"])


def _narrowed(df: DataFrame, keys: Sequence[str], column: str, bounds: DataFrame, inside: int) -> DataFrame:
    """Narrower brackets of the keys of ``bounds`` (``_lo``, ``_hi``, ``_n``) that still have more rows inside."""
    c = finite(column)
    within = (c > F.col("_lo")) & (c < F.col("_hi"))
    grid = [i / GRID for i in range(GRID + 1)]
    found = _rows_in(df, keys, [column], bounds).groupBy(*keys, "_lo", "_hi", "_n").agg(
        F.count(F.when(c <= F.col("_lo"), 1)).alias("_below"),
        F.count(F.when(within, 1)).alias("_m"),
        F.percentile_approx(F.when(within, c), grid, ACCURACY).alias("_grid"),
    )
    rank = 0.5 * (F.col("_n") - 1)
    low = (F.floor(rank) - F.col("_below")) / F.col("_m") - MARGIN
    high = (F.ceil(rank) + 1 - F.col("_below")) / F.col("_m") + MARGIN
    at = lambda share: F.get("_grid", share.cast("int"))
    lo = F.when(low > 0, at(F.floor(low * GRID))).otherwise(F.col("_lo"))
    hi = F.when(high < 1, at(F.ceil(high * GRID))).otherwise(F.col("_hi"))
    wide = F.col("_m") > inside
    new = found.select(*keys, "_n", F.when(wide, lo).otherwise(F.col("_lo")).alias("_lo"), F.when(wide, hi).otherwise(F.col("_hi")).alias("_hi"),
                       (wide & ((lo > F.col("_lo")) | (hi < F.col("_hi")))).alias("_more"))
    return staged(new, "brackets")


def _key_brackets(df: DataFrame, keys: Sequence[str], columns: Sequence[str], inside: int) -> DataFrame:
    """Per key and column ``_b_<column>``, the ends of a bracket of the median with at most ``inside`` rows between them."""
    counts = [F.count(finite(c)).alias(f"_n_{c}") for c in columns]
    bounds = staged(df.groupBy(*keys).agg(*counts, *[_bracket(finite(c), 0.5).alias(f"_b_{c}") for c in columns]), "brackets")
    most = bounds.agg(*[F.max(f"_n_{c}").alias(c) for c in columns]).first()
    for c in columns:
        # The sketch's guarantee bounds the rows inside; they are counted only where it does not suffice.
        if 3 * MARGIN * (most[c] or 0) <= inside:
            continue
        ends = [F.get(f"_b_{c}", i).alias(n) for i, n in ((0, "_lo"), (1, "_hi"))]
        open_ = bounds.where(3 * MARGIN * F.col(f"_n_{c}") > inside).select(*keys, F.col(f"_n_{c}").alias("_n"), *ends)
        done = None
        while open_ is not None:
            moved = _narrowed(df, keys, c, open_, inside)
            ready = moved.where("not _more").select(*keys, F.array("_lo", "_hi").alias("_narrow"))
            done = ready if done is None else done.unionByName(ready)
            open_ = moved.where("_more").drop("_more") if moved.where("_more").count() else None
        bounds = key_join(bounds, done, keys, "left").withColumn(f"_b_{c}", F.coalesce("_narrow", f"_b_{c}")).drop("_narrow")
    return bounds


def grouped_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], inside: int = INSIDE) -> DataFrame:
    """Exact median of every column per key, safe for a key that holds a large share of the rows.

    The rows are salted before they meet their bracket, so a hot key is spread over several tasks; the
    partial buffers of the final aggregate hold bracketed values only, at most ``inside`` a key and column besides
    equal ones. The salt is taken from all columns of ``df``: leave columns in that tell rows apart (a time, a task).
    A key with a NULL in it has no median.
    """
    joined = _rows_in(df, keys, columns, _key_brackets(df, keys, columns, inside))
    return joined.groupBy(*keys).agg(
        *[F.percentile(_clamped(finite(c), F.col(f"_b_{c}")), 0.5).alias(c) for c in columns]
    )
