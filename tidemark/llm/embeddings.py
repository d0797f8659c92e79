"""Near-duplicate vectors: int8 tile products with per-vector error bounds, full precision only where they leave doubt.

A unit vector u is stored as scale * q with int8 q; its error vector e = u - scale * q has a length that is measured in
double precision, not assumed. For two vectors the product of the quantised forms is off by at most

    |e_a| * |u_b| + |u_a - e_a| * |e_b|  <=  |e_a| + (1 + |e_a|) * |e_b|

A tile product is an exact integer (sums of at most 1040 products of int8 stay below 2**24, so float32 arithmetic is
exact; wider vectors use float64). Pairs whose upper bound is below the threshold are out, pairs whose lower bound is
above it are in, and only the rest is recomputed in double precision from the full vectors.

Equal vectors are one row with a weight. Rows are dealt to blocks by a hash; a task gets two blocks. What leaves a task is
one count a row and block, and a spanning forest of the links instead of the links, so a group of any size costs its
rows, not its pairs. The number of tile products is quadratic by the method; no vector or pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import stage

BLOCK_ROWS = 8192
#: Tasks that pairs of blocks are dealt to, at most.
MOST_TASKS = 20_000
TILE = 2048
#: Covers the rounding of the double-precision bounds themselves, which is below 1e-13 for any width in use.
SLACK = 1e-9


def vectors_of(raw: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), width)


class Block:
    """Vectors of one block: unit forms, quantised forms, scales and measured error lengths."""

    def __init__(self, vectors: np.ndarray) -> None:
        # Scaling by the largest component first keeps squares of very small or large values in range.
        self.unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        self.unit /= np.sqrt(np.einsum("ij,ij->i", self.unit, self.unit))[:, None]
        self.scale = np.abs(self.unit).max(axis=1) / 127
        q = np.rint(self.unit / self.scale[:, None])
        self.error = np.sqrt(np.square(self.unit - q * self.scale[:, None]).sum(axis=1)) + 1e-12
        self.q = q.astype(np.float32 if vectors.shape[1] <= 1040 else np.float64)


def linked(a: Block, b: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked rows, tile by tile."""
    for i in range(0, len(a.q), TILE):
        for j in range(0, len(b.q), TILE):
            product = a.q[i : i + TILE] @ b.q[j : j + TILE].T
            ea, eb = a.error[i : i + TILE], b.error[j : j + TILE]
            sa, sb = a.scale[i : i + TILE], b.scale[j : j + TILE]
            # The least integer product that any pair of this tile needs: one cheap comparison for nearly all pairs.
            floor = (threshold - SLACK - ea.max() - (1 + ea.max()) * eb.max()) / (sa.max() * sb.max())
            at = np.flatnonzero(product.ravel() >= floor) if floor > 0 else np.arange(product.size)
            for part in np.array_split(at, max(1, len(at) // (1 << 18))):
                x, y = np.divmod(part, product.shape[1])
                near = product.ravel()[part].astype(np.float64) * sa[x] * sb[y]
                bound = ea[x] + (1 + ea[x]) * eb[y] + SLACK
                sure, doubt = near - bound >= threshold, np.abs(near - threshold) <= bound
                for k in np.array_split(np.flatnonzero(doubt), max(1, int(doubt.sum()) // 8192)):
                    sure[k] = np.einsum("ij,ij->i", a.unit[i + x[k]], b.unit[j + y[k]]) >= threshold
                yield i + x[sure], j + y[sure]


def forest(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of ``label`` along x-y, each the smallest index of its class."""
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(lx, ly)[apart], np.minimum(lx, ly)[apart])
        while (label[label] != label).any():
            label = label[label]


def _compare(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        width, one, two = key
        first, second = rows[rows["block"] == one], rows[rows["block"] == two]
        if one == two:
            second = first
        if first.empty or second.empty:
            return pd.DataFrame({"vec_id": [], "n": [], "root": []}, dtype="int64")
        a = Block(vectors_of(first["v"], width))
        b = a if one == two else Block(vectors_of(second["v"], width))
        shift = 0 if one == two else len(first)
        members = first if one == two else pd.concat([first, second])
        weight = members["weight"].to_numpy()
        count = np.zeros(len(members), np.int64)
        label = np.arange(len(members))
        for x, y in linked(a, b, threshold):
            y = y + shift
            if one == two:
                x, y = x[x != y], y[x != y]
            else:
                np.add.at(count, y, weight[x])
            np.add.at(count, x, weight[y])
            label = forest(x, y, label)
        ids = members["vec_id"].to_numpy()
        out = pd.DataFrame({"vec_id": ids, "n": count, "root": ids[label]})
        return out[(out["n"] > 0) | (out["root"] != out["vec_id"])]

    return run


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors of one length are linked when their cosine in double precision is at least ``threshold``. A vector that is
    NULL, empty, all zero, or holds a NULL or non-finite component links with nothing; so does one of another length.
    A row with a NULL id links with nothing and is kept. Repeated rows of one id link with each other and count once
    each. Other columns are ignored.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    usable = (
        F.col("vec_id").isNotNull()
        & (F.size("e") > 0)
        & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("e", lambda x: x != 0)
    )

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: (np.asarray(x, np.float64) + 0.0).tobytes())

    valid = rows.where(F.coalesce(usable, F.lit(False)))
    valid = stage(valid.select("vec_id", F.size("e").alias("width"), packed("e").alias("v")), "vectors")
    classes = stage(
        valid.groupBy("width", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vector-classes"
    )
    sizes = classes.groupBy("width").count().select("width", F.ceil(F.col("count") / block_rows).alias("blocks"))
    dealt = classes.join(sizes, "width").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "width",
        F.least("block", "other").alias("one"),
        F.greatest("block", "other").alias("two"),
        "block",
        F.col("rep").alias("vec_id"),
        "weight",
        "v",
    )
    # A task for each pair of blocks, whatever its bytes: the work of a pair is quadratic in its rows.
    pairs = F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2).cast("long")
    tasks = max(1, min(sizes.agg(pairs.alias("n")).first()["n"] or 1, MOST_TASKS))
    paired = paired.repartition(tasks, "width", "one", "two")
    found = stage(
        paired.groupBy("width", "one", "two").applyInPandas(_compare(threshold), "vec_id long, n long, root long"),
        "vector-links",
    )
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n")).withColumnRenamed("vec_id", "rep")
    members = valid.join(classes, ["width", "v"]).select("vec_id", "rep", "weight")
    linked_rows = (
        members.join(counts, "rep", "left")
        .groupBy("vec_id")
        .agg(F.max(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    edges = found.select(F.col("root").alias("a"), F.col("vec_id").alias("b"))
    edges = edges.union(members.select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
    comp = components(edges, "a", "b").withColumnRenamed("node", "vec_id")
    component = F.coalesce("component", "vec_id")
    return (
        rows.select("vec_id")
        .join(linked_rows, "vec_id", "left")
        .join(comp, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        )
    )
