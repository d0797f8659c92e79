"""Keyed state over several micro-batches, the controller's traces and batch/stream equality."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig
from tidemark.operators.features import window_features
from tidemark.streaming import controller, frames, jobs

SAMPLES = "session_id string, condition string, timestamp_ms bigint, cli double, valid_frame_ratio double, illumination_std double, session_time_s double, phase string"


def samples(session, condition, values, ratio=1.0, light=3.0, step=5000):
    return [(session, condition, i * step, v, ratio, light, i * step / 1000, "learning_easy") for i, v in enumerate(values)]


def test_controller_examples(spark):
    rows = (
        samples("a", "adaptive", [0.85] * 8)
        + samples("b", "baseline", [0.85] * 8)
        + samples("q", "adaptive", [0.5] * 6, ratio=0.5, light=50.0)
        + samples("calm", "adaptive", [0.3] * 40)
    )
    random.Random(1).shuffle(rows)
    got = {}
    for r in controller.controller_events(spark.createDataFrame(rows, SAMPLES)).collect():
        got.setdefault(r.session_id, []).append((r.type, r.outcome, r.timestamp_ms))
    assert got == {
        "a": [("micro_break_60s", "applied", 15000)],
        "b": [("suppressed_trigger", "suppressed", 15000)],
        "q": [("low_confidence_pause", "paused", 15000)],
    }


def test_controller_ladder_and_recovery():
    state, events = controller.Controller(), []
    for i in range(400):
        event = state.step(i * 5000, 0.9, 1.0, 0.0, "adaptive")
        if event:
            events.append((event["type"], event["details"][-15:]))
    kinds = [k for k, _ in events]
    assert kinds[:5] == ["micro_break_60s"] * 2 + ["pacing_change"] * 2 + ["difficulty_step_down"]
    assert "+1s" in events[2][1] and "+2s" in events[3][1] and state.pacing == 2 and state.stepped_down
    state = controller.Controller()
    for i in range(8):
        state.step(i * 5000, 0.9, 0.5, 0.0, "adaptive")
    # The first poor bucket still counts; in low-confidence mode the counter rests.
    assert state.low_confidence and state.overloaded == 1
    for i in range(8, 10):
        state.step(i * 5000, 0.9, 1.0, 0.0, "adaptive")
    assert not state.low_confidence and state.overloaded == 2 and state.breaks == 1


def test_scores_over_batches_equal_one_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = samples("a", "adaptive", [rng.random() for _ in range(60)], step=2500) + samples("b", "baseline", [0.9] * 60, step=2500)
    df = spark.createDataFrame(rows, SAMPLES)
    for n in range(3):
        df.where((F.col("session_time_s") >= n * 50) & (F.col("session_time_s") < (n + 1) * 50)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    many = jobs.run_available(controller.smoothed_scores(jobs.stream_table(spark, str(tmp_path / "in"), files_per_trigger=1)), "many", path=str(tmp_path / "many"))
    assert len(list((tmp_path / "many" / "rows").glob("batch=*"))) == 3
    got = {(r.session_id, r.timestamp_ms): r for r in many.collect()}
    events = {(r.session_id, r.timestamp_ms): r.type for r in controller.controller_events(df).collect()}
    assert {k: r.event_type for k, r in got.items() if r.event_type} == events
    y = 0.5
    for s in rows[:60]:
        y = 0.4 * s[3] + 0.6 * y
        assert got[("a", s[2])].smoothed_cli == pytest.approx(y)


def frame_rows(n, seed):
    rng = random.Random(seed)
    return [("s", i / 2.0, *[rng.random() for _ in range(9)], rng.random() > 0.1) for i in range(n)]


def test_windows_and_calibration_over_batches_equal_batch(spark, tmp_path):
    cfg = FeatureConfig(fps=2.0, length_s=6.0, step_s=1.5, max_gap=0, max_bad_ratio=0.3, min_blink_ms=500, max_blink_ms=2000)
    schema = "session_id string, at double, " + ", ".join(f"{c} double" for c in frames.FRAME_VALUES) + ", valid boolean"
    df = spark.createDataFrame(frame_rows(90, 4), schema)
    for a, b in ((0, 11), (11, 30), (30, 99)):
        df.where((F.col("at") >= a) & (F.col("at") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_table(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    live = jobs.run_available(frames.cut_windows(stream, cfg), "w", lambda b: frames.live_features(b, cfg), str(tmp_path / "w"))
    batch = window_features(df.withColumn("frame_idx", (F.col("at") * 2).cast("bigint")), cfg, ["session_id"])
    names = [*cfg.model_features, *cfg.monitoring_features]
    a = [[r.t_start_s, *[r[n] for n in names]] for r in live.orderBy("t_start_s").collect()]
    b = [[r.t_start_s, *[r[n] for n in names]] for r in batch.orderBy("t_start_s").collect()]
    assert len(a) == len(b) > 10 and all(x == pytest.approx(y) for x, y in zip(a, b))

    picked = ["perclos", "ear_std"]
    rows = live.select("session_id", "emitted_at", "t_end_s", *picked).orderBy("emitted_at").collect()
    for lo, hi in ((0, 3), (3, 5), (5, len(rows))):
        spark.createDataFrame(rows[lo:hi], "session_id string, emitted_at double, t_end_s double, perclos double, ear_std double").coalesce(1).write.mode("append").parquet(str(tmp_path / "cut"))
    out = jobs.run_available(frames.calibrated_features(jobs.stream_table(spark, str(tmp_path / "cut"), files_per_trigger=1), picked, ["t_end_s"]), "c", path=str(tmp_path / "c"))
    got = out.orderBy("emitted_at").collect()
    assert len(got) == len(rows) - 4
    base = sorted(r.perclos for r in rows[:4])
    middle, previous = (base[1] + base[2]) / 2, None
    for r, w in zip(got, rows[4:]):
        assert r.t_end_s == w.t_end_s and r.perclos_centered == pytest.approx(w.perclos - middle)
        assert r.perclos_delta == pytest.approx(0.0 if previous is None else r.perclos_centered - previous)
        previous = r.perclos_centered


def test_throttle_batch_equals_stream(spark, tmp_path):
    rows = [("a", float(t), float(v)) for t, v in [(0, 0), (10, 1), (40, 0), (45, 2), (70, 3), (80, 3), (120, 3), (160, 4)]]
    df = spark.createDataFrame(rows, "session_id string, at_ms double, video_time double")
    want = [0.0, 45.0, 80.0, 160.0]
    assert sorted(r.at_ms for r in frames.throttled(df).collect()) == want
    for lo, hi in ((0, 50), (50, 999)):
        df.where((F.col("at_ms") >= lo) & (F.col("at_ms") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = jobs.run_available(frames.throttled_stream(jobs.stream_table(spark, str(tmp_path / "in"), files_per_trigger=1)), "t", path=str(tmp_path / "t"))
    assert sorted(r.at_ms for r in out.collect()) == want


def test_frame_counts_per_interval(spark, tmp_path):
    df = spark.createDataFrame([("a", 1000 * s + i * 100) for s in range(5) for i in range(s + 1)], "session_id string, ms bigint")
    df.select("session_id", F.timestamp_millis("ms").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.run_available(jobs.frame_counts(jobs.stream_table(spark, str(tmp_path / "in")), late="0 seconds"), "f", path=str(tmp_path / "f"))
    got = sorted(r.frames for r in out.collect())
    assert got == [1, 2, 3, 4]


def test_collection_stream(spark, tmp_path):
    from tidemark import schemas

    req = spark.createDataFrame([("p", None, [(1, 0, "high", "easy", "t", {"blink_rate": 2.0}, 1.0)]), ("q", None, [])], schemas.COLLECTED_SAMPLES)
    req.write.parquet(str(tmp_path / "in"))
    rows, counts = jobs.ingest_collected(jobs.stream_table(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    assert [(r.user_id, r.label, r.blink_rate) for r in rows.collect()] == [("p", 1, 2.0)]
    assert counts.first().total_samples == 1
