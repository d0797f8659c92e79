"""Shape of the plans: shuffles, pruning, and sequences whose rows mostly belong to one key."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.config import FeatureConfig
from tidemark.operators.baseline import earliest_rows
from tidemark.operators.features import window_features
from tidemark.operators.sequence import with_index
from tidemark.operators.signals import normalized_windows
from tidemark.operators.windows import sliding_windows
from tidemark.plans import registry, signals, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_frames(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("frames") / "f")
    tables.frames(spark, "/root/testdata/sf0.001").write.parquet(path)
    return spark.read.parquet(path)


def test_windows_need_one_exchange(stored_frames):
    text = plan(window_features(stored_frames, tables.VIDEO))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("Sort [") == 1


def test_plain_windows_and_normalizing_need_one_exchange(stored_frames):
    out = sliding_windows(stored_frames, ["user_id", "task"], "frame_idx", 12, 3, [F.avg("quality").alias("q")])
    assert plan(out).count("Exchange hashpartitioning") == 1
    out = normalized_windows(stored_frames, "quality", 12, 3, idx="frame_idx")
    assert plan(out).count("Exchange hashpartitioning") == 1


def test_disabled_features_are_not_read(stored_frames):
    config = FeatureConfig(fps=1.0, length_s=12, step_s=3, geometry=False, max_gap=0)
    text = plan(window_features(stored_frames, config).select("user_id", "perclos"))
    assert "pitch" not in text.split("ReadSchema")[-1] and "mouth_mar" not in text.split("ReadSchema")[-1]


def test_earliest_rows_are_cut_before_the_shuffle(stored_frames):
    text = plan(earliest_rows(stored_frames, ["user_id"], ["frame_idx"], 4))
    assert "WindowGroupLimit" in text
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_one_key_with_most_rows_is_spread_over_tasks(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 10 else f"u{i}", "t", i, rng.random(), True) for i in range(20000)]
    schema = "user_id string, task string, n bigint, ear_mean double, valid boolean"
    raw = spark.createDataFrame(rows, schema).repartition(4)
    indexed = with_index(raw, ["user_id", "task"], ["n"], F.floor(F.col("n") / 500.0))
    hot = indexed.where("user_id = 'hot'")
    assert hot.agg(F.count_distinct("frame_idx"), F.max("frame_idx")).first()[:] == (18000, 17999)
    config = FeatureConfig(fps=1.0, length_s=12, step_s=3, brightness=False, geometry=False, max_gap=0, windows_per_chunk=16)
    for c in ("eye_center_x", "eye_center_y", "quality"):
        hot = hot.withColumn(c, F.lit(0.0))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = window_features(hot, config).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    counts = [r["count"] for r in sizes]
    assert len(counts) == 4 and max(counts) < 0.5 * sum(counts)


def test_row_order_and_partitioning_do_not_matter(stored_frames):
    a = window_features(stored_frames.repartition(7), tables.VIDEO)
    b = window_features(stored_frames.orderBy(F.xxhash64("frame_idx", "user_id")), tables.VIDEO)
    key = lambda r: (r.user_id, r.task, r.window_idx)
    rows = zip(sorted(a.collect(), key=key), sorted(b.collect(), key=key))
    assert all(x.blink_count == y.blink_count and x.perclos == y.perclos for x, y in rows)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 80


def test_registered_queries_carry_everything(spark, tmp_path):
    """All base features, four calibration windows, counts with the rows, and every point of a longer vector."""
    names = ["streamed_calibrated_features", "streamed_collection_rows", "streamed_collection_counts", "engineered_with_target_all"]
    queries = registry.all_queries()
    assert set(names) <= set(queries) and set(names) <= set(registry.all_oracles())
    rows = [(1, 0, [float(i) for i in range(70)]), (2, 0, [float(i) for i in range(64)])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.frame_idx: r.points for r in signals._landmarks(spark, str(tmp_path)).collect()}
    assert len(got[1]) == 23 and len(got[2]) == 21 and got[1][-1].z == 68.0
