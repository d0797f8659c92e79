"""Rows in any order and any files: reordering, late rows, ends of sessions, the live chain."""

import random
import sys
from collections import Counter

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig
from tidemark.operators import learning
from tidemark.operators.features import features_of_cut_windows, window_features
from tidemark.streaming import arrival, controller, frames, jobs, live

# Workers do not import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRAME = "session_id string, at double, " + ", ".join(f"{c} double" for c in frames.FRAME_VALUES) + ", valid boolean, received double"
CONFIG = FeatureConfig(fps=2.0, length_s=6.0, step_s=1.5, max_gap=0, max_bad_ratio=0.3, min_blink_ms=500, max_blink_ms=2000)


def frame_rows(session, n, seed, start=0.0, lateness=4.0):
    rng = random.Random(seed)
    return [
        (session, start + i / 2, *[rng.random() if rng.random() > 0.03 else None for _ in frames.FRAME_VALUES], rng.random() > 0.1, start + i / 2 + rng.random() * lateness)
        for i in range(n)
    ]


def as_files(spark, rows, schema, path, files, end=10_000.0):
    """Rows dealt to files by their times of receipt, with a last file that moves the clock to ``end``."""
    names = [f.split()[0] for f in schema.split(", ")]
    rows = sorted(rows, key=lambda r: r[-1])
    size = -(-len(rows) // files)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + [[(None,) * (len(names) - 1) + (end,)]]
    for part in parts:
        random.Random(len(part)).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return jobs.stream_table(spark, path, spark.read.schema(schema).parquet(path).schema, files_per_trigger=1)


class Watched(frames.WindowRowProcessor):
    def handleInputRows(self, key, rows, timerValues):
        rows = list(rows)
        assert len(rows) == 1 and len(rows[0]) <= 2 * 2, "more than a slot at once"
        yield from super().handleInputRows(key, iter(rows), timerValues)


def features(df):
    names = [*CONFIG.model_features, *CONFIG.monitoring_features]
    return sorted([(r.session_id, r.t_start_s, *[None if r[n] is None else round(r[n], 9) for n in names]) for r in df.collect()])


@pytest.mark.parametrize("files", [1, 7])
def test_one_session_over_shuffled_files_equals_batch(spark, tmp_path, files):
    rows = frame_rows("s", 90, 4) + frame_rows("t", 40, 5)
    stream = as_files(spark, rows, FRAME, str(tmp_path / "in"), files)
    cut = arrival.in_order(stream, Watched(CONFIG), frames.WINDOW_ROWS, lateness_s=4.0, slot_s=2.0)
    live_rows = jobs.run_available(frames.window_row_features(cut, CONFIG, ["session_id", "t_start_s"]), "w", path=str(tmp_path / "w"))
    batch = window_features(spark.createDataFrame(rows, FRAME).withColumn("frame_idx", (F.col("at") * 2).cast("bigint")), CONFIG, ["session_id"])
    passing = live_rows.where(F.col("bad_ratio") <= CONFIG.max_bad_ratio)
    assert features(passing) == features(batch) and batch.count() > 20


def test_array_features_equal_grouped_features(spark):
    rng = random.Random(6)
    cut, rows = [], []
    for w in range(60):
        own = frame_rows(str(w), rng.randrange(0, 20), w)
        if w % 7 == 0:
            own = [(r[0], r[1], float("nan"), *r[3:-2], False, r[-1]) for r in own]
        cut += [(r[0], i, *r[2:-1]) for i, r in enumerate(own)]
        rows.append((str(w), *[[r[2 + i] for r in own] for i in range(len(frames.FRAME_VALUES) + 1)]))
    a = spark.createDataFrame(cut, "w string, place bigint, " + ", ".join(f"{c} double" for c in frames.FRAME_VALUES) + ", valid boolean")
    b = spark.createDataFrame(rows, "w string, " + ", ".join(f"{c} array<double>" for c in frames.FRAME_VALUES) + ", valid array<boolean>")
    names = [*CONFIG.model_features, *CONFIG.monitoring_features, "bad_ratio"]
    want = {r.w: [r[n] for n in names] for r in features_of_cut_windows(a, CONFIG, ["w"]).collect()}
    got = {r.w: [r[n] for n in names] for r in frames.window_row_features(b, CONFIG, ["w"]).collect()}
    assert len(want) > 50 and all(got[w] == pytest.approx(v, nan_ok=True) for w, v in want.items())
    assert all(got[w][:-1] == [None] * (len(names) - 1) for w in got.keys() - want.keys())


def session_rows(rows, gap):
    """(started, ended, rows) of sessions of sorted times."""
    out = []
    for t in sorted(rows):
        if out and t - out[-1][1] <= gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


@pytest.mark.parametrize("files", [2, 9])
def test_sessions_close_and_late_rows_are_counted(spark, tmp_path, files):
    rng = random.Random(7)
    rows, late, times = [], Counter(), {}
    for s in "abcd":
        t = rng.random() * 20
        for _ in range(60):
            t += rng.choice([0.5, 1.0, 1.0, 3.0, 40.0])
            delay = rng.random() * 5 if rng.random() > 0.1 else 5.1 + rng.random() * 300
            rows.append((s, t, t + delay))
            if delay > 5:
                late[s] += 1
            else:
                times.setdefault(s, []).append(t)
    rows.append(("only late", 1.0, 50.0))
    rows.append(("no time", None, 60.0))
    late |= {"only late": 1, "no time": 1}
    schema = "session_id string, at double, received double"
    stream = as_files(spark, rows, schema, str(tmp_path / "in"), files)
    path, progress = str(tmp_path / "out"), []
    with jobs.state_store(spark, 2):
        query = (
            arrival.session_ends(stream, lateness_s=5.0, gap_s=30.0)
            .writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/check")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        progress = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    out = spark.read.parquet(f"{path}/rows").collect()
    want = {(s, *x) for s, own in times.items() for x in session_rows(own, 30.0)}
    assert {(r.session_id, r.started_s, r.ended_s, r.n_rows) for r in out if r.kind == "session"} == want
    got = Counter()
    for r in out:
        got[r.session_id] += r.n_late
    assert +got == +late
    # Nothing is left of sessions that are over.
    assert max(progress) > 0 and progress[-1] == 0


def test_live_chain_equals_batch(spark, tmp_path):
    rows = frame_rows("s", 120, 8) + frame_rows("t", 100, 9) + frame_rows("t", 70, 10, start=500.0)
    stream = as_files(spark, rows, FRAME, str(tmp_path / "in"), 5)
    table = spark.createDataFrame(rows, FRAME)
    part = F.when(F.col("at") >= 500, "t2").otherwise(F.col("session_id"))
    first = F.when(F.col("at") >= 500, 500.0).otherwise(0.0)
    indexed = table.withColumn("frame_idx", ((F.col("at") - first) * 2).cast("bigint")).withColumn("part", part)
    windows = window_features(indexed, CONFIG, ["part"]).toPandas().sort_values(["part", "t_start_s"])
    base = ["perclos", "ear_std"]
    model = learning.fit_regression(
        spark.createDataFrame([(0.1 * i, 0.2 * (i % 3), 0.1, 0.0, 0.0, 0.3, (i % 5) / 5) for i in range(20)],
                              "perclos double, ear_std double, perclos_centered double, ear_std_centered double, perclos_delta double, ear_std_delta double, y double"),
        ["perclos", "ear_std", "perclos_centered"], "y", "ridge")
    artifacts = learning.Artifacts(model, learning.feature_spec(["perclos", "ear_std", "perclos_centered"], base, "y"), {})
    learning.save_model(artifacts, spark, str(tmp_path / "model"))
    loaded = learning.load_model(spark, str(tmp_path / "model"))
    scores = live.live_scores(stream, loaded, F.lit("adaptive"), CONFIG, n_windows=4, lateness_s=4.0, gap_s=60.0, slot_s=2.0)
    got = {(r.session_id, r.timestamp_ms): r for r in jobs.run_available(scores, "scores", path=str(tmp_path / "out")).collect()}
    want = {}
    for name, own in windows.groupby("part"):
        median = own.iloc[:4][base].median()
        rest = own.iloc[4:].assign(perclos_centered=lambda w: w["perclos"] - median["perclos"])
        cli = learning.score_windows(spark.createDataFrame(rest), loaded).toPandas().sort_values("t_start_s")
        smooth = 0.5
        for t, y in zip(cli["t_end_s"], cli["cli"]):
            smooth = 0.4 * y + 0.6 * smooth
            at = t - 0.5 + (500 if name == "t2" else 0)
            want[name[0], round(at * 1000)] = (y, smooth)
    assert got.keys() == want.keys() and len(want) > 60
    assert all((got[k].raw_cli, got[k].smoothed_cli) == pytest.approx(v) for k, v in want.items())


class Store:
    """State of one key in memory, as a handle gives it; counts the calls."""

    def __init__(self):
        self.calls, self.values, self.entries, self.timers = 0, {}, {}, set()

    def getValueState(self, name, schema):
        return Value(self, name)

    def getMapState(self, name, keys, values):
        return Entries(self)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


class Value:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        self.store.calls += 1
        return self.store.values.get(self.name)

    def exists(self):
        self.store.calls += 1
        return self.name in self.store.values

    def update(self, value):
        self.store.calls += 1
        self.store.values[self.name] = value

    def clear(self):
        self.store.calls += 1
        self.store.values.pop(self.name, None)


class Entries:
    def __init__(self, store):
        self.store = store

    def containsKey(self, key):
        self.store.calls += 1
        return key in self.store.entries

    def getValue(self, key):
        self.store.calls += 1
        return self.store.entries[key]

    def updateValue(self, key, value):
        self.store.calls += 1
        self.store.entries[key] = value

    def removeKey(self, key):
        self.store.calls += 1
        del self.store.entries[key]

    def clear(self):
        self.store.calls += 1
        self.store.entries.clear()


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def run_one_key(monkeypatch, rows, inline, batches, gap=30.0):
    """Closing rows of one key, the calls to its state and the store, with a watermark a second behind every batch."""
    made = {}

    def transform(self, statefulProcessor, **_):
        made["processor"] = statefulProcessor

    monkeypatch.setattr("pyspark.sql.GroupedData.transformWithStateInPandas", transform)
    monkeypatch.setattr(arrival, "INLINE", inline, raising=False)
    arrival.session_ends(rows, lateness_s=5.0, gap_s=gap, slot_s=2.0)
    processor, store, out = made["processor"], Store(), []
    processor.init(store)
    for batch in batches:
        out += list(processor.handleInputRows(("k",), iter([batch]), Now(0)))
        mark = int((batch["received"].max() - 1 + arrival.SHIFT_S) * 1000)
        while due := sorted(t for t in store.timers if t <= mark):
            for part in processor.handleExpiredTimer(("k",), Now(mark), Now(due[0])):
                out += [part]
            store.timers.remove(due[0])
    return [tuple(r) for part in out for r in part[["started_s", "ended_s", "n_rows"]].to_numpy().tolist()], store


@pytest.mark.parametrize("inline", [0, 7, 1000])
def test_waiting_rows_take_few_calls_to_the_state(spark, monkeypatch, inline):
    rng = random.Random(3)
    rows = [("k", t, t + rng.random() * 4) for t in [float(i // 40 * 100 + i % 40) for i in range(400)]]
    frame = pd.DataFrame(sorted(rows, key=lambda r: r[2]), columns=["session_id", "at", "received"])
    batches = [frame.iloc[i : i + 40].reset_index(drop=True) for i in range(0, 400, 40)]
    batches.append(pd.DataFrame([("k", 5000.0, 5000.0)], columns=frame.columns))
    batches.append(pd.DataFrame([("k", None, 9000.0)], columns=frame.columns).astype({"at": float}))
    stream = spark.createDataFrame([], "session_id string, at double, received double")
    got, store = run_one_key(monkeypatch, stream, inline, batches)
    assert got == [(100.0 * i, 100.0 * i + 39, 40) for i in range(10)]
    assert not store.entries
    if inline == 1000:
        # About 200 slots in 12 batches, one timer and one value a batch.
        assert store.calls < 12 * 20


def test_sessions_of_a_bucket_share_calls_to_the_state(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(f"s{i}", t, t + rng.random() * 4) for i in range(150) for t in [float(100 * (j // 6) + j % 6) for j in range(12 + i % 3)]]
    frame = pd.DataFrame(sorted(rows, key=lambda r: r[2]), columns=["session_id", "at", "received"])
    batches = [frame.iloc[i : i + 500].reset_index(drop=True) for i in range(0, len(frame), 500)]
    batches.append(pd.DataFrame([(None, 9000.0)], columns=["at", "received"]).assign(session_id=None).astype({"at": float}))
    stream = spark.createDataFrame([], "session_id string, at double, received double")
    got, store = run_one_key(monkeypatch, stream, 1000, batches)
    times = {s: sorted(t for name, t, _ in rows if name == s) for s, _, _ in rows}
    assert Counter(got) == Counter(x for own in times.values() for x in session_rows(own, 30.0)) and len(got) > 300
    # One value and one timer in a call, whatever the number of sessions; nothing is left of them.
    assert store.calls < 12 * len(batches) and not store.values and not store.entries


class Summed(arrival.SessionProcessor):
    """Rows and their times as sums: what the sessions of a bucket must not mix."""

    def handleInputRows(self, key, rows, timerValues):
        n, total = self.session.get() or (0, 0.0)
        for part in rows:
            for (at,) in arrival.tuples(part, ["at"]):
                n, total = n + 1, total + at
        self.session.set((n, total))
        yield [{"session_id": key[0], "at": at, "n": n, "total": total}]

    def ended(self, key, at, late):
        self.session.set(None)
        return iter(())


def test_chained_sessions_of_a_bucket_keep_their_own_state():
    processor, store = live.UntilEnded(Summed(), "at", True, ["session_id", "at", "kind", "n", "total"]), Store()
    processor.init(store)

    def run(rows):
        store.calls = 0
        frame = pd.DataFrame(rows, columns=["session_id", "at", "kind"])
        out = list(processor.handleInputRows((0,), iter([frame.iloc[:3], frame.iloc[3:]]), None))
        assert store.calls <= 2
        return {(r.session_id, r.at, r.kind == "ended"): None if r.kind == "ended" else (r.n, r.total) for part in out for r in part.itertuples()}

    assert run([("a", 2.0, "w"), ("b", 1.0, "w"), ("a", 1.0, "w"), ("c", 5.0, "w")]) == {
        ("a", 2.0, False): (2, 3.0), ("b", 1.0, False): (1, 1.0), ("c", 5.0, False): (1, 5.0)
    }
    assert run([("b", 4.0, "w"), ("a", 3.0, "ended"), ("a", 9.0, "w"), ("a", 3.0, "w")]) == {
        ("b", 4.0, False): (2, 5.0), ("a", 3.0, False): (3, 6.0), ("a", 3.0, True): None, ("a", 9.0, False): (1, 9.0)
    }
    for s in "abc":
        run([(s, 10.0, "ended")])
    assert not store.values


def test_many_sessions_of_a_stream_take_few_entries_of_state(spark, tmp_path):
    rows = [r for i in range(60) for r in frame_rows(f"s{i}", 14, i)]
    stream = as_files(spark, rows, FRAME, str(tmp_path / "in"), 2, end=2.0)
    with jobs.state_store(spark, 2):
        query = (
            live.live_windows(stream, CONFIG, 4.0, None, buckets=5)
            .writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "check"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        # A value and a timer a bucket, with the timer's two entries, not a session.
        assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5 * 4
