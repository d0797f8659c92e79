"""Paired-associate items: seeded block selection and recognition choices.

Items are a table like any dimension: form, difficulty, position, id, cue, target, interference_group. A block holds a few
dozen at most; the volume is in the participants. After one join on form and difficulty everything happens inside the
participant's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import StudyPlan
from tidemark.functions.seeded import reshuffle_seed, seeded_shuffle
from tidemark.functions.text import uint32_hash
from tidemark.operators.sequence import key_join
from tidemark.sources.writers import staged

BLOCK = ["form", "difficulty"]


def first_items(candidates: DataFrame, plan: StudyPlan = StudyPlan(), position: str = "position") -> DataFrame:
    """The items of each form and difficulty that a session shows, with their ``place`` from 1."""
    shown = F.when(F.col("difficulty") == "easy", plan.easy_item_count).otherwise(plan.hard_item_count)
    place = F.row_number().over(Window.partitionBy(*BLOCK).orderBy(position))
    most = max(plan.easy_item_count, plan.hard_item_count)
    return candidates.withColumn("place", place).where(F.col("place") <= most).where(F.col("place") <= shown)


def item_pools(items: DataFrame, position: str = "position") -> DataFrame:
    """One row a form and difficulty with its items, as structs, in their order."""
    item = F.struct("id", "cue", "target", "difficulty", "interference_group")
    listed = F.sort_array(F.collect_list(F.struct(F.col(position), item.alias("item"))))
    return items.groupBy(*BLOCK).agg(F.transform(listed, lambda x: x["item"]).alias("_pool"))


def block_items(
    df: DataFrame, items: DataFrame, seed_input: str = "participant_id", count: int | None = None, name: str = "items"
) -> DataFrame:
    """Add the participant's own order of the items of a form and difficulty, cut to ``count`` items.

    The work is in the rows of ``df``, far more than their bytes tell, so they are spread over all tasks first. The pools are
    a written table: a few rows that Spark broadcasts, where a shuffle would bring all rows to a task a form and difficulty.
    """
    seed = uint32_hash(F.concat_ws(":", seed_input, *BLOCK))
    shuffled = seeded_shuffle(F.col("_pool"), seed)
    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joined = key_join(spread, staged(item_pools(items), "item-pools"), BLOCK, "left")
    return joined.withColumn(name, shuffled if count is None else F.slice(shuffled, 1, count)).drop("_pool")


def _each_item(df: DataFrame, items: str) -> DataFrame:
    """One row an item, as by ``explode``.

    The filter that Spark infers from an inner ``explode`` would compute the list, and so the shuffle behind it, again.
    """
    rows = df.select("*", F.posexplode_outer(items).alias("_place", "item"))
    return rows.where(F.col("_place").isNotNull()).drop("_place")


def _others(item: str = "item", items: str = "items") -> Column:
    return F.filter(items, lambda c: c["id"] != F.col(f"{item}.id"))


def distractors(df: DataFrame, items: str = "items") -> DataFrame:
    """One row an item of a block with its candidates for wrong answers and those of its own interference group."""
    wrong = F.filter(_others("item", items), lambda c: c["target"] != F.col("item.target"))
    same = F.filter("candidates", lambda c: c["interference_group"] == F.col("item.interference_group"))
    return _each_item(df, items).withColumn("candidates", wrong).withColumn("same_group", same)


def recognition_choices(
    df: DataFrame,
    items: str = "items",
    seed_input: str = "participant_id",
    choices: int = 4,
    interference: bool = True,
) -> DataFrame:
    """One row per item of a block with its answer choices in seeded order.

    Wrong answers come first from the item's own interference group, then from the rest of the block,
    each target once and never the right one.
    """
    others = _others("item", items)
    if interference:
        same = F.filter("_others", lambda c: c["interference_group"] == F.col("item.interference_group"))
        rest = F.filter("_others", lambda c: c["interference_group"] != F.col("item.interference_group"))
        pool = F.concat(same, rest)
    else:
        pool = F.col("_others")
    wrong = F.array_distinct(
        F.filter(F.transform(pool, lambda c: c["target"]), lambda t: t != F.col("item.target"))
    )

    def choice(value: Column, right: bool) -> Column:
        return F.struct(value.alias("value"), F.lit(right).alias("is_correct"))

    offered = F.concat(
        F.array(choice(F.col("item.target"), True)),
        F.transform(seeded_shuffle("_wrong", "_seed"), lambda t: choice(t, False)),
    )
    # The hash of the participant's part is taken once per row, before the items are unfolded.
    item_seed = uint32_hash(F.concat(F.lit(":"), F.col("item.id"), F.lit(":recognition")), F.col("_seed_head"))
    return (
        _each_item(df.withColumn("_seed_head", uint32_hash(seed_input)), items)
        .withColumn("_others", others)
        .withColumns(
            {
                "_wrong": F.slice(wrong, 1, max(choices - 1, 1)),
                "_seed": item_seed,
            }
        )
        .withColumn("_offered", offered)
        .withColumn("choices", seeded_shuffle("_offered", reshuffle_seed("_seed")))
        .drop("_others", "_wrong", "_seed_head", "_seed", "_offered")
    )
