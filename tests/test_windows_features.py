"""Window features against a direct per-window computation on small recordings."""

import math
import random

import numpy as np
import pytest

from tidemark.config import FeatureConfig
from tidemark.operators.features import blink_onsets, blink_runs, series_features, window_features
from tidemark.operators.sequence import ewma, with_index, with_previous
from tidemark.operators.windows import interpolate_gaps, sliding_windows
from pyspark.sql import functions as F

COLUMNS = "user_id string, task string, frame_idx bigint, ear_mean double, brightness double, quality double, eye_center_x double, eye_center_y double, mouth_mar double, roll double, pitch double, yaw double, valid boolean"


def make_frames(seed, n, user="u", task="t"):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        valid = rng.random() > 0.08
        closed = rng.random() < 0.45
        ear = None if rng.random() < 0.04 else (0.1 if closed else 0.3) + rng.random() * 0.05
        vals = [rng.random() for _ in range(7)]
        if rng.random() < 0.05:
            vals[3] = float("nan")
        rows.append((user, task, i, ear if valid else 0.0, vals[0] * 200, vals[1], vals[2], *vals[3:7], vals[0], valid))
    return rows


def brute_blinks(ears, lo, hi, t):
    out, start = [], None
    for i, e in enumerate(ears):
        if start is None:
            if e is not None and e < t:
                start = i
        elif e is not None and e >= t:
            if lo <= i - start <= hi:
                out.append((start, i))
            start = None
    return out


def fill(rows, max_gap):
    rows = [list(r) for r in rows]
    src = [list(r) for r in rows]
    good = [i for i, r in enumerate(src) if r[12]]
    for a, b in zip(good, good[1:]):
        gap = b - a - 1
        if 0 < gap <= max_gap:
            for j in range(1, gap + 1):
                w = j / (gap + 1)
                for c in (3, 4, 6, 7, 8, 9):
                    x, y = src[a][c], src[b][c]
                    rows[a + j][c] = None if x is None or y is None else (1 - w) * x + w * y
                rows[a + j][5] = min(src[a][5], src[b][5])
                rows[a + j][12] = True
    return rows


def brute_windows(rows, cfg):
    rows = fill(rows, cfg.max_gap)
    out = {}
    k = 0
    while k * cfg.step + cfg.length <= len(rows):
        w = rows[k * cfg.step : k * cfg.step + cfg.length]
        good = [r for r in w if r[12]]
        bad = (len(w) - len(good)) / len(w)
        if bad <= cfg.max_bad_ratio:
            ears = [r[3] for r in good]
            blinks = brute_blinks(ears, cfg.min_blink_frames, cfg.max_blink_frames, cfg.ear_threshold)
            known = [e for e in ears if e is not None and e > 0]
            fin = lambda c: [r[c] for r in good if r[c] is not None and math.isfinite(r[c])]
            sp = [
                math.hypot(b[6] - a[6], b[7] - a[7]) * cfg.fps
                for a, b in zip(good, good[1:])
                if b[2] == a[2] + 1 and math.isfinite(a[7]) and math.isfinite(b[7])
            ]
            sd = lambda x: float(np.std(x)) if len(x) else 0.0
            out[k] = dict(
                blink_count=float(len(blinks)),
                blink_rate=len(blinks) / (len(good) / cfg.fps / 60.0) if good else None,
                mean_blink_duration=float(np.mean([(e - s) / cfg.fps * 1000 for s, e in blinks])) if blinks else 0.0,
                ear_std=sd(known),
                perclos=sum(e is not None and e < cfg.ear_threshold for e in ears) / len(good) if good else None,
                mouth_open_mean=float(np.mean(fin(8))) if fin(8) else 0.0,
                mouth_open_std=sd(fin(8)),
                roll_std=sd(fin(9)),
                pitch_std=sd(fin(10)),
                yaw_std=sd(fin(11)),
                motion_mean=float(np.mean(sp)) if sp else 0.0,
                motion_std=sd(sp),
                mean_brightness=float(np.mean([r[4] for r in good])) if good else None,
                valid_frame_ratio=len(good) / len(w),
            )
            if not good:
                out[k] = {n: None for n in out[k]}
        k += 1
    return out


@pytest.mark.parametrize("gap,per,bad", [(1, 2, 0.2), (3, 3, 0.3), (0, 64, 1.0)])
def test_window_features_match_direct_computation(spark, gap, per, bad):
    cfg = FeatureConfig(fps=2.0, length_s=6.0, step_s=1.5, min_blink_ms=500, max_blink_ms=2000,
                        max_gap=gap, max_bad_ratio=bad, windows_per_chunk=per)
    sets = {("u1", "a"): make_frames(1, 101, "u1", "a"), ("u1", "b"): make_frames(2, 12, "u1", "b"),
            ("u2", "a"): make_frames(3, 57, "u2", "a"), ("u3", "a"): make_frames(4, 11, "u3", "a")}
    rows = [r for s in sets.values() for r in s]
    random.Random(5).shuffle(rows)
    got = {}
    for r in window_features(spark.createDataFrame(rows, COLUMNS), cfg).collect():
        got[(r.user_id, r.task, r.window_idx)] = r.asDict()
    want = {(u, t, k): v for (u, t), s in sets.items() for k, v in brute_windows(s, cfg).items()}
    assert set(got) == set(want)
    for key, values in want.items():
        for name, value in values.items():
            assert got[key][name] == (value if value is None else pytest.approx(value, abs=1e-9)), (key, name)


def test_blink_examples(spark):
    def frames(n, closed):
        ear = [0.3] * n
        for a, b, v in closed:
            ear[a:b] = [v] * (b - a)
        return spark.createDataFrame([("u", "t", i, e, True) for i, e in enumerate(ear)],
                                     "user_id string, task string, frame_idx bigint, ear_mean double, valid boolean")

    cfg = FeatureConfig()
    runs = blink_runs(frames(60, [(10, 14, 0.15), (40, 44, 0.18)]), cfg, chunk_rows=16).orderBy("start_idx").collect()
    assert [r.start_idx for r in runs] == [10, 40]
    assert blink_runs(frames(100, [(50, 52, 0.15)]), cfg).count() == 0
    assert blink_runs(frames(100, [(40, 60, 0.15)]), cfg, chunk_rows=20).count() == 0
    assert blink_runs(frames(30, [(25, 30, 0.15)]), cfg).count() == 0
    at = np.linspace(100, 1700, 15, dtype=int)
    minute = frames(1800, [(int(p), int(p) + 4, 0.15) for p in at]).withColumn("brightness", F.lit(1.0))
    row = series_features(minute, cfg).first()
    assert row.blink_count == 15 and 14 <= row.blink_rate <= 16 and 120 <= row.mean_blink_duration <= 150


def test_blink_runs_match_direct_scan(spark):
    rows = make_frames(9, 400)
    cfg = FeatureConfig(fps=2.0, min_blink_ms=500, max_blink_ms=1500)
    good = [r for r in rows if r[12]]
    want = {(good[s][2], good[e][2]) for s, e in
            brute_blinks([r[3] for r in good], cfg.min_blink_frames, cfg.max_blink_frames, 0.21)}
    got = {(r.start_idx, r.end_idx) for r in blink_runs(spark.createDataFrame(rows, COLUMNS), cfg, chunk_rows=7).collect()}
    assert got == want and want


def test_window_starts_and_partial_windows(spark):
    df = spark.range(900).selectExpr("'u' user_id", "'t' task", "id frame_idx", "0.3D ear_mean")
    out = sliding_windows(df, ["user_id", "task"], "frame_idx", 300, 75, [F.min("frame_idx").alias("lo")], 4)
    assert sorted(r.lo / 30 for r in out.collect()) == [2.5 * k for k in range(9)]
    short = sliding_windows(df.where("frame_idx < 299"), ["user_id", "task"], "frame_idx", 300, 75, [F.max("frame_idx").alias("hi")])
    assert short.count() == 0
    gaps = sliding_windows(df, ["user_id", "task"], "frame_idx", 10, 100, [F.min("frame_idx").alias("lo")])
    assert sorted(r.lo for r in gaps.collect()) == [100 * k for k in range(9)]


def test_gap_filling_examples(spark):
    schema = "user_id string, task string, frame_idx bigint, ear_mean double, quality double, valid boolean"
    small = spark.createDataFrame([("u", "t", 0, 0.3, 1.0, True), ("u", "t", 1, 0.0, 0.0, False), ("u", "t", 2, 0.4, 1.0, True)], schema)
    mid = interpolate_gaps(small, ["user_id", "task"], 3, chunk_rows=1).where("frame_idx = 1").first()
    assert mid.valid and mid.ear_mean == pytest.approx(0.35) and mid.quality == 1.0
    wide = spark.createDataFrame([("u", "t", i, 0.3, 1.0, i in (0, 5)) for i in range(6)], schema)
    assert interpolate_gaps(wide, ["user_id", "task"], 3, chunk_rows=2).where("valid").count() == 2


def test_index_previous_and_ewma_across_chunks(spark):
    rng = random.Random(3)
    data = [("u" if i % 3 else "v", float(i), rng.random()) for i in range(1500)]
    df = spark.createDataFrame(data, "k string, t double, x double").repartition(5)
    ranked = with_index(df, ["k"], ["t"], F.floor(F.col("t") / 40), "n")
    rows = with_previous(ewma(ranked, ["k"], "n", "x", 0.4, 0.5, "y"), ["k"], ["t"], F.floor(F.col("t") / 17), ["x"]).collect()
    for key in "uv":
        y, prev = 0.5, None
        mine = sorted((r for r in rows if r.k == key), key=lambda r: r.t)
        assert [r.n for r in mine] == list(range(len(mine)))
        for r in mine:
            y = 0.4 * r.x + 0.6 * y
            assert r.y == pytest.approx(y, abs=1e-12)
            assert (r._prev.x if r._prev else None) == prev
            prev = r.x


def test_blink_onsets(spark):
    ears = [0.1, 0.3, 0.1, 0.1, 0.3, 0.1]
    rows = [("u", "t", i, e, i != 4) for i, e in enumerate(ears)]
    df = spark.createDataFrame(rows, "user_id string, task string, frame_idx bigint, ear_mean double, valid boolean")
    # The start counts (assumed 0.3 before it); an invalid frame still moves the previous value.
    assert blink_onsets(df, chunk_rows=2).first().blink_onsets == 3
