"""Mixing sources to target weights: exact block quotas split among output shards by a hypergeometric tree.

Each source is dealt to ``BLOCKS`` blocks by a hash, and its blocks stand in an order permuted by another hash. A source's
target is met by whole passes over its blocks and then the first blocks of a further pass, the last of them in part, so
the number of block draws of each source is exact. A splitting tree halves the shards again and again: the left half's
share of every source is one multivariate-hypergeometric draw from the node's quotas, which gives each shard the mix
that drawing blocks without replacement would, and sums to the quotas exactly. A shard's quota is a range of the permuted
draws, disjoint from those of all others; within a shard rows are put in a random order that needs no other shard.

What the driver sees is one row a source (the weights of a mix are given by source) and the quotas of sources and shards.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import empty_text, stage

BLOCKS = 1024
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
SHARD_WORDS = 1 << 24
SEED = 7


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words of each source: weights share out ``share`` of all words, none above ``most`` times its size."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if rest * weights[i] / total > most * sizes[i]}
        for i in full or open_:
            out[i] = most * sizes[i] if full else rest * weights[i] / total
        if not full:
            break
        rest -= sum(out[i] for i in full)
        open_ -= full
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: rows of nearly equal sums whose columns sum to the quotas."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    drawn = int(quotas.sum()) * left // shards
    method = "marginals" if quotas.sum() < 1_000_000_000 else "count"
    part = rng.multivariate_hypergeometric(quotas, drawn, method=method)
    return np.concatenate([split_quotas(part, left, rng), split_quotas(quotas - part, shards - left, rng)])


def mixture(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), seed: int = SEED, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``keep`` columns of every row with size, source_size, target, taken, draws and mix_row, a key of the row.

    ``draws`` has the shard and the words of each time a row is taken. Words are runs of characters other than ASCII
    white space; a NULL text has none. Sources are ordered by code point, NULL last and a source of its own; the weights
    repeat along that order. Only the last draw of a source cuts a row short, so a source's taken words are its target
    rounded to whole words, and no row is taken more than twice. Repeated rows count each.
    """
    source = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    rows = docs.select(
        *keep,
        source.alias("mix_source"),
        F.col("doc_id").alias("mix_id"),
        F.regexp_count(empty_text(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
    ).withColumn("mix_block", F.pmod(F.xxhash64(F.lit(seed), "mix_id"), F.lit(BLOCKS)).cast("int"))
    if list(keep) == ["doc_id"]:
        rows = stage(rows, "sizes")
    blocks = stage(rows.groupBy("mix_source", "mix_block").agg(F.sum("size").alias("words")), "blocks")
    blocks = blocks.withColumn(
        "turn", F.expr(f"row_number() over (partition by mix_source order by xxhash64({seed + 1}, mix_block), mix_block) - 1")
    ).withColumn("before", F.expr("sum(words) over (partition by mix_source order by turn) - words"))
    totals = blocks.groupBy("mix_source").agg(F.sum("words").alias("words"), F.count("*").alias("blocks")).collect()
    totals.sort(key=lambda r: (r["mix_source"][0] == "n", r["mix_source"]))
    sizes = [r["words"] for r in totals]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(totals))])
    words = [round(t) for t in goal]
    whole = [min(w // n, int(MOST)) if n else 0 for w, n in zip(words, sizes)]
    rest = [w - k * n for w, k, n in zip(words, whole, sizes)]
    spark = docs.sparkSession
    per_source = spark.createDataFrame(
        [(r["mix_source"], r["words"], r["blocks"], *x) for r, *x in zip(totals, goal, whole, rest)],
        "mix_source string, source_size long, blocks long, target double, whole long, rest long",
    )
    partial = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before")))
    blocks = stage(blocks.join(per_source, "mix_source").withColumn("partial", partial), "block-quotas")
    draws = F.sum(F.col("whole") + (F.col("partial") > 0).cast("long"))
    quota = {r["mix_source"]: r["n"] for r in blocks.groupBy("mix_source").agg(draws.alias("n")).collect()}
    shards = max(1, math.ceil(sum(words) / shard_words))
    drawn = np.array([quota[r["mix_source"]] for r in totals], np.int64)
    ranges = np.cumsum(split_quotas(drawn, shards, np.random.default_rng(seed)), axis=0)
    bounds = spark.createDataFrame(
        [(r["mix_source"], ranges[:, i].tolist()) for i, r in enumerate(totals)], "mix_source string, bounds array<long>"
    )

    def shard(turn):
        """The first shard whose bound is above the number of a draw: draws go by pass, then by the block's turn."""
        number = turn * F.col("blocks") + F.col("turn")
        return F.size(F.filter("bounds", lambda b: b <= number))

    passes = F.filter(F.array(*[F.lit(i).cast("long") for i in range(int(MOST))]), lambda i: i < F.col("whole"))
    blocks = stage(
        blocks.join(bounds, "mix_source").select(
            "mix_source", "mix_block", "source_size", "target", "whole", "partial",
            F.transform(passes, shard).alias("shards"), shard(F.col("whole")).alias("last_shard"),
        ),
        "draws",
    )
    order = f"over (partition by mix_source, mix_block order by xxhash64({seed + 2}, mix_id), mix_id, size"
    before = F.expr(f"sum(size) {order} rows unbounded preceding) - size")
    key = F.struct("mix_source", "mix_block", F.expr(f"row_number() {order})").alias("turn"))
    own = F.least("size", F.greatest(F.lit(0), F.col("partial") - F.col("mix_before")))
    ordered = rows.withColumns({"mix_before": before, "mix_row": key})
    taken = ordered.join(blocks, ["mix_source", "mix_block"]).withColumn("mix_own", own)
    drawn_rows = F.concat(
        F.transform("shards", lambda s: F.struct(s.alias("shard"), F.col("size").alias("words"))),
        F.array(F.struct(F.col("last_shard").alias("shard"), F.col("mix_own").alias("words"))),
    )
    return taken.select(
        *keep,
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("mix_own")).alias("taken"),
        F.filter(drawn_rows, lambda d: d["words"] > 0).alias("draws"),
        "mix_row",
    )


def whole_rows(mixed: DataFrame) -> DataFrame:
    """``mixed`` with draws of whole rows only: one that a draw cuts is taken whole if at least half of it is drawn.

    A source cuts one row at most, so its words then differ from its target by at most half of that row.
    """
    near = F.filter("draws", lambda d: 2 * d["words"] >= F.col("size"))
    whole = F.transform(near, lambda d: F.struct(d["shard"].alias("shard"), F.col("size").alias("words")))
    return mixed.withColumn("draws", whole).withColumn("taken", F.size("draws") * F.col("size"))


def shuffled(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """One row for each draw, with shard, words and its position in the shard's own random order.

    The rows of a shard stand together, in that order. Equal draws of one row stand in either order.
    """
    rows = mixed.withColumn("draw", F.explode("draws"))
    rows = rows.select(*[c for c in mixed.columns if c != "draws"], "draw.shard", "draw.words")
    order = f"row_number() over (partition by shard order by xxhash64({seed + 3}, mix_row, words), mix_row, words)"
    return rows.withColumn("position", F.expr(order))


def with_places(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """``mixed`` with ``places``, shard, position and words of each draw of a row, instead of draws and mix_row."""
    mixed = stage(mixed, "mixed")
    found = shuffled(mixed.select("mix_row", "draws"), seed).groupBy("mix_row")
    found = found.agg(F.sort_array(F.collect_list(F.struct("shard", "position", "words"))).alias("places"))
    none = F.array().cast(found.schema["places"].dataType)
    rows = mixed.join(found, "mix_row", "left").withColumn("places", F.coalesce("places", none))
    return rows.drop("mix_row", "draws")
