"""Quantiles, ranks, alignment, baselines, scores and signals against direct computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig, PhysioConfig
from tidemark.operators import alignment, baseline, quantiles, ranks, scoring, signals


def average_rank(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_quantiles_are_exact(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.8 else "b", rng.choice([1.0, 2.0, 2.0, rng.random() * 5]), rng.gauss(0, 1)) for _ in range(999)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(4)
    got = {r.k: r for r in quantiles.grouped_medians(df, ["k"], ["x", "y"]).collect()}
    for k in "ab":
        assert got[k].x == pytest.approx(np.median([r[1] for r in rows if r[0] == k]))
        assert got[k].y == pytest.approx(np.median([r[2] for r in rows if r[0] == k]))
    q = quantiles.exact_quantiles(df, ["y"], [0.5, 0.95, 0.99]).first()
    assert list(q) == pytest.approx(list(np.percentile([r[2] for r in rows], [50, 95, 99])))


def test_clamped_quantile_with_coarse_sketch(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    monkeypatch.setattr(quantiles, "MARGIN", 0.04)
    rng = random.Random(2)
    xs = [rng.gauss(0, 1) for _ in range(20000)]
    df = spark.createDataFrame([("a", x) for x in xs], "k string, x double").repartition(6)
    assert quantiles.grouped_medians(df, ["k"], ["x"]).first().x == pytest.approx(np.median(xs))
    assert quantiles.exact_quantiles(df, ["x"], [0.95]).first()[0] == pytest.approx(np.percentile(xs, 95))


@pytest.mark.parametrize("kind", ["spread", "ties", "two", "ints"])
def test_narrowed_quantiles(spark, monkeypatch, kind):
    """Several sketches, until few rows lie inside a bracket; ties at and around the quantile."""
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    monkeypatch.setattr(quantiles, "MARGIN", 0.04)
    monkeypatch.setattr(quantiles, "INSIDE", 20)
    rng = random.Random(5)
    draw = {
        "spread": lambda: rng.gauss(0, 1),
        "ties": lambda: rng.choice([0.0, 1.0, rng.random() * 1e-3]),
        "two": lambda: rng.choice([1.0, 2.0]),
        "ints": lambda: float(rng.randrange(300)),
    }[kind]
    xs = [draw() for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double").repartition(5)
    qs = [0.0, 0.05, 0.5, 0.951, 1.0]
    got = quantiles.exact_quantiles(df, ["x"], qs).first()
    assert list(got) == pytest.approx([float(np.quantile(xs, q)) for q in qs], abs=1e-12)
    for (low, high) in quantiles._brackets(df, [("x", q) for q in qs]):
        assert sum(low < x < high for x in xs) <= 20
    assert quantiles.fitted_medians(df, ["x"])["x"] == pytest.approx(float(np.median(xs)))
    assert quantiles.exact_quantiles(df.limit(0), ["x"], [0.5]).first()[0] is None


@pytest.mark.parametrize("kind", ["spread", "ties", "two", "skewed"])
def test_brackets_of_keys_are_narrowed(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    monkeypatch.setattr(quantiles, "MARGIN", 0.04)
    rng = random.Random(11)
    draw = {
        "spread": lambda: rng.gauss(0, 1),
        "ties": lambda: rng.choice([0.0, 1.0, rng.random() * 1e-3]),
        "two": lambda: rng.choice([1.0, 2.0]),
        "skewed": lambda: 10.0 ** rng.uniform(-9, 9),
    }[kind]
    rows = [("hot", i, draw(), rng.random()) for i in range(5000)] + [("warm", i, draw(), None) for i in range(300)]
    rows += [("few", i, draw(), 1.0) for i in range(3)] + [("none", 0, None, float("nan"))]
    df = spark.createDataFrame(rows, "k string, i int, x double, y double").repartition(5)
    got = {r.k: r for r in quantiles.grouped_medians(df, ["k"], ["x", "y"], inside=20).collect()}
    for k in ("hot", "warm", "few"):
        for j, c in ((2, "x"), (3, "y")):
            own = [r[j] for r in rows if r[0] == k and r[j] is not None]
            assert got[k][c] == (pytest.approx(float(np.median(own)), abs=1e-12) if own else None)
    assert got["none"].x is None and got["none"].y is None
    for r in quantiles._key_brackets(df, ["k"], ["x"], 20).where("_b_x is not null").collect():
        assert sum(r._b_x[0] < v < r._b_x[1] for k, _, v, _ in rows if k == r.k and v is not None) <= 20


def test_ranks_spearman_auc(spark):
    rng = random.Random(4)
    rows = [(round(rng.gauss(0, 3), 1), rng.choice([-1.0, 0.0, 0.25, 0.5, 1.0, 8.0]), int(rng.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "x double, y double, c int")
    x, y, c = (np.array(v) for v in zip(*rows))
    rx, ry = average_rank(x), average_rank(y)
    got = {r.x: r.rk for r in ranks.average_ranks(df, "x", "rk").collect()}
    assert all(got[v] == pytest.approx(r) for v, r in zip(x, rx))
    assert ranks.spearman(df, "x", "y").first().spearman == pytest.approx(np.corrcoef(rx, ry)[0, 1])
    p, n = (c == 1).sum(), (c == 0).sum()
    want = (rx[c == 1].sum() - p * (p + 1) / 2) / (p * n)
    assert ranks.roc_auc(df, "c", "x").first().auc == pytest.approx(want)
    assert ranks.spearman(df.limit(2), "x", "y").first().spearman is None
    assert ranks.roc_auc(df.where("c = 1"), "c", "x").first().auc is None


def test_ranges_follow_the_values(spark):
    rng = random.Random(7)
    narrow = [1.0 + rng.random() / 1e6 for _ in range(3000)]
    values = narrow + [0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cuts = ranks.splitters(df, "v", 12)
    rows = ranks.in_ranges(df, "v", cuts).orderBy("v").collect()
    bins = [r[ranks.BIN] for r in rows]
    assert bins == sorted(bins) and len(set(bins)) == 12
    sizes = [bins.count(b) for b in set(bins)]
    assert max(sizes) < 1.3 * len(values) / 12
    got = {r.v: r.rk for r in ranks.average_ranks(df, "v", "rk").collect()}
    assert all(got[v] == r for v, r in zip(values, average_rank(np.array(values))))
    assert ranks.splitters(df.limit(0), "v", 12) == [] and ranks.average_ranks(df.limit(0), "v", "rk").collect() == []
    longs = spark.createDataFrame([(2**60 + i,) for i in range(50)], "v long")
    assert [r.rk for r in ranks.average_ranks(longs, "v", "rk").orderBy("v").collect()] == list(range(1, 51))


def windows(spark, rows):
    return spark.createDataFrame(rows, "user_id string, task string, t_start_s double, t_end_s double, physio_stress_score double")


def test_overlap_join(spark):
    rng = random.Random(6)
    physio = [("u", "t", s, s + 10, rng.random() if rng.random() > 0.1 else None) for s in np.arange(0, 120, 2.5).tolist()]
    video = [("u", "t", s, s + 10.0) for s in [float(i) * 3.7 for i in range(45)]] + [("w", "t", 0.0, 10.0)]
    v = spark.createDataFrame(video, "user_id string, task string, t_start_s double, t_end_s double")
    for bucket in (10.0, 3.0):
        got = {(r.user_id, r.t_start_s): r.physio_stress_score for r in alignment.overlap_join(v, windows(spark, physio), bucket).collect()}
        assert len(got) == len(video)
        for u, t, a, b in video:
            o = [(min(b, e) - max(a, s), x) for pu, _, s, e, x in physio if pu == u and x is not None and min(b, e) > max(a, s)]
            want = sum(w * x for w, x in o) / sum(w for w, _ in o) if o else None
            assert got[(u, a)] == (want if want is None else pytest.approx(want))


def test_label_mode_and_identical_grids(spark):
    rows = [("u", "t", s, s + 10, s / 100) for s in np.arange(0, 50, 10.0).tolist()]
    p = windows(spark, rows)
    v = p.drop("physio_stress_score")
    exact = {r.t_start_s: r.physio_stress_score for r in alignment.label_windows(v, p, "exact").collect()}
    overlap = {r.t_start_s: r.physio_stress_score for r in alignment.label_windows(v, p, "overlap").collect()}
    assert exact == pytest.approx(overlap)
    shifted = v.withColumn("t_start_s", F.col("t_start_s") + 1.0)
    assert alignment.exact_join(shifted, p).count() == 0
    assert alignment.label_windows(shifted, p, "auto").where("physio_stress_score is not null").count() == 5
    with pytest.raises(ValueError):
        alignment.ensure_rows(p.where("false"))


def test_baseline_and_engineered_features(spark):
    rows = [("a", "Relax", 0.0, 1.0), ("a", "Relax", 2.5, 3.0), ("a", "Video1", 0.0, 5.0), ("a", "Relax", 5.0, 7.0), ("a", "Relax", 7.5, 99.0),
            ("a", "Math", 0.0, 4.0), ("a", "Math", 2.5, None), ("a", "Math", 5.0, 9.0), ("b", "Math", 0.0, 2.0), ("b", "Math", 2.5, 4.0)]
    df = spark.createDataFrame(rows, "user_id string, task string, t_start_s double, x double")
    base = baseline.user_baseline(df, ["x"])
    assert {r.user_id: r.baseline_x for r in base.collect()} == {"a": 4.0, "b": 3.0}
    got = {(r.user_id, r.task, r.t_start_s): r for r in baseline.add_centered_and_delta(df, base, ["x"]).collect()}
    assert got[("a", "Math", 0.0)].x_centered == 0.0 and got[("a", "Math", 0.0)].x_delta == 0.0
    assert got[("a", "Math", 5.0)].x_delta == 0.0
    assert got[("a", "Relax", 5.0)].x_delta == 4.0 and got[("b", "Math", 2.5)].x_delta == 2.0
    z = {(r.user_id, r.task, r.t_start_s): r.y_true for r in baseline.add_target(df, "z01", "x").collect()}
    assert z[("b", "Math", 0.0)] == pytest.approx(1 / (1 + math.exp(1)))
    d = {(r.user_id, r.task, r.t_start_s): r.y_true for r in baseline.add_target(df, "delta", "x").collect()}
    assert d[("a", "Relax", 7.5)] == 1.0 and d[("b", "Math", 0.0)] == 0.0 and d[("a", "Math", 2.5)] is None
    with pytest.raises(ValueError):
        baseline.user_baseline(df, ["nope"])


def test_stress_score(spark):
    rows = [(60.0, 50.0, 1.0), (70.0, 40.0, 1.0), (80.0, None, 1.0)]
    df = spark.createDataFrame(rows, "hr double, sdnn double, scr_amplitude_mean double")
    got = [r.physio_stress_score for r in scoring.stress_score(df).orderBy("hr").collect()]
    w = 0.452 + 0.320 + 0.405
    z = (60 - 70) / np.std([60, 70, 80])
    assert got[0] == pytest.approx(1 / (1 + math.exp(-(z * 0.452 - 1.0 * 0.320) / w)))
    assert got[2] is None


def test_physio_windows_on_synthetic_beats(spark):
    cfg = PhysioConfig(rate=50, ecg_half_width=15, eda_half_width=40, resp_half_width=60, tonic_half_width=100, windows_per_chunk=3)
    n = 50 * 40
    t = np.arange(n) / 50
    ecg = np.where(np.arange(n) % 40 == 10, 5.0, 0.0) + 0.01 * np.sin(t)
    rows = [("u", "t", i, float(ecg[i]), float(np.sin(2 * np.pi * t[i] / 5) + t[i] / 10), float(np.sin(2 * np.pi * t[i] / 4))) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id string, task string, sample_idx bigint, ECG double, EDA double, RR double").repartition(5)
    out = {r.t_start_s: r for r in signals.physio_windows(df, cfg).collect()}
    assert len(out) == (n - 500) // 125 + 1
    for r in out.values():
        assert r.hr == pytest.approx(75.0) and r.sdnn == pytest.approx(0.0, abs=1e-6) and r.rmssd == pytest.approx(0.0, abs=1e-6)
        assert r.ecg_quality == 1.0 and r.scr_count == 2.0
        assert r.resp_rate == pytest.approx(15.0, rel=0.02) and r.resp_amplitude_mean == pytest.approx(2 * 2**0.5, rel=0.02)
    assert len(signals.normalized_windows(df, "ECG", 500, 125).where("window_idx = 1").collect()) == 500
    flat = signals.physio_windows(df.withColumn("ECG", F.lit(1.0)), cfg).first()
    assert flat.hr is None and flat.ecg_quality == 0.0


def test_peak_helpers_match_direct_scan():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, 300).astype(float)
    x[rng.random(300) < 0.05] = np.nan
    for w in (1, 3, 10):
        got = signals.local_peaks(x, w)
        for i in range(300):
            near = x[max(0, i - w) : i + w + 1]
            first = x[max(0, i - w) : i]
            want = 0 < i < 299 and not np.isnan(x[i]) and x[i] >= np.nanmax(near) and not (first == x[i]).any()
            assert got[i] == want
        mean = signals.moving_mean(x, w)
        assert all(mean[i] == pytest.approx(np.nanmean(x[max(0, i - w) : i + w + 1])) for i in range(300))


def test_ranks_leave_out_nan_and_infinity(spark):
    from tidemark.operators import scoring

    nan, inf = float("nan"), float("inf")
    rows = [(float(i), float(i * i), i % 2) for i in range(20)] + [(nan, 1.0, 1), (inf, 2.0, 0), (3.0, -inf, 1), (None, 4.0, 0)]
    df = spark.createDataFrame(rows, "x double, y double, label int")
    clean = df.where("x < 1000 and y < 1000 and y > -1000")
    assert ranks.spearman(df, "x", "y").first() == ranks.spearman(clean, "x", "y").first()
    assert ranks.roc_auc(df, "label", "x").first() == ranks.roc_auc(df.where("x < 1000"), "label", "x").first()
    assert scoring.latency_stats(df, "x").first() == scoring.latency_stats(df.where("x < 1000"), "x").first()


def test_merged_sketches_estimate_quantiles(spark):
    from tidemark.operators import sketches

    rng = random.Random(9)
    rows = [(h, rng.expovariate(1.0) * (1 + h)) for h in range(6) for _ in range(3000)] + [(7, None), (7, float("nan")), (8, 2.0)]
    stored = sketches.sketched(spark.createDataFrame(rows, "hour int, v double"), "v", ["hour"])
    values = np.sort([v for _, v in rows if v is not None and v == v])
    r = sketches.estimates(sketches.merged(stored), [0.0, 0.5, 0.95, 1.0]).first()
    assert (r["count"], r["max"], r["mean"]) == (len(values), values[-1], pytest.approx(values.mean()))
    for q, got in zip([0.5, 0.95], [r.q1, r.q2]):
        assert abs(np.searchsorted(values, got) / len(values) - q) < 0.015
    assert (r.q0, r.q3) == (values[0], values[-1])
    hours = {x.hour: x for x in sketches.estimates(stored, [0.5], ["hour"]).collect()}
    assert 7 not in hours and hours[8].q0 == 2.0 and sketches.merged(stored.limit(0), ["hour"]).collect() == []


def test_baseline_joins_without_broadcast(spark, tmp_path):
    # Joins of large tables: neither side is broadcast, both are dealt by user.
    rows = [(u, t, 3.0 * w, float(u + w)) for u in range(40) for t in (("Relax", "Math") if u % 2 else ("Math", "Speaking")) for w in range(6)]
    spark.createDataFrame(rows, "user_id bigint, task string, t_start_s double, x double").write.parquet(str(tmp_path / "w"))
    df = spark.read.parquet(str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = baseline.add_centered_and_delta(df, baseline.user_baseline(df, ["x"]), ["x"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(out) == len(rows)
    # Calm users: the first four windows of Relax; the others: all their windows.
    assert all(r.x_centered == pytest.approx(r.x - r.user_id - (1.5 if r.user_id % 2 else 2.5)) for r in out)
    assert all(r.x_delta == (0.0 if r.t_start_s == 0 else 1.0) for r in out)
