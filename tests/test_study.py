"""Study protocol, items, export, readers and writers."""

import csv
import glob
import io
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import geometry, numeric, seeded, text
from tidemark.operators import export, stimuli, study
from tidemark.sources import readers, writers


def js_hash(s):
    h = 0
    data = s.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = (h * 31 + data[i] + 256 * data[i + 1]) & 0xFFFFFFFF
    return h


def js_shuffle(items, seed):
    state, arr = seed & 0xFFFFFFFF, list(items)
    for i in range(len(arr) - 1, 0, -1):
        state = (1664525 * state + 1013904223) & 0xFFFFFFFF
        j = int(state / 4294967296 * (i + 1))
        arr[i], arr[j] = arr[j], arr[i]
    return arr


def test_hash_and_assignment(spark):
    ids = ["p001", " P002 ", "zoë9", "𝒳1", "", "\tp003\n"]
    df = spark.createDataFrame([(i, n) for i in ids for n in (1, 2)], "participant_id string, session_number int")
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    rows = study.assign_participants(df, now=now).collect()
    for r in rows:
        assert r.hash_value == js_hash(r.participant_id.strip().lower())
        even = r.hash_value % 2 == 0
        assert r.condition == ("adaptive" if even == (r.session_number == 1) else "baseline")
        assert r.form == ("A" if even == (r.session_number == 1) else "B")
        assert str(r.delayed_due_at) == "2024-03-08 12:00:00"
    assert {r.hash_value for r in rows if r.participant_id == "p001"} == {3384257}


def test_shuffle_and_choices(spark):
    items = {(f, d): [(f"{f}{d}{n}", f"cue{n}", f"t{n % 9}", d, f"g{n // 2}") for n in range(12)] for f in "AB" for d in ("easy", "hard")}
    table = spark.createDataFrame([(f, d, n, *x[:3], x[4]) for (f, d), own in items.items() for n, x in enumerate(own)],
                                  "form string, difficulty string, position int, id string, cue string, target string, interference_group string")
    df = spark.createDataFrame([(f"P{i:03d}", f, d) for i in range(12) for f in "AB" for d in ("easy", "hard")],
                               "participant_id string, form string, difficulty string")
    for interference in (True, False):
        rows = stimuli.recognition_choices(stimuli.block_items(df, table, count=10), choices=4, interference=interference).collect()
        for r in rows:
            want = js_shuffle(items[r.form, r.difficulty], js_hash(f"{r.participant_id}:{r.form}:{r.difficulty}"))[:10]
            assert [tuple(i) for i in r["items"]] == want
            me = r.item
            others = [i for i in want if i[0] != me.id]
            if interference:
                others = [i for i in others if i[4] == me.interference_group] + [i for i in others if i[4] != me.interference_group]
            wrong = list(dict.fromkeys(i[2] for i in others if i[2] != me.target))[:3]
            seed = js_hash(f"{r.participant_id}:{me.id}:recognition")
            choice = js_shuffle([(me.target, True)] + [(w, False) for w in js_shuffle(wrong, seed)], seed ^ 0x9E3779B1)
            assert [(c.value, c.is_correct) for c in r.choices] == choice
    assert len(rows) == 12 * 4 * 10


def test_items_are_shuffled_once_a_participant_in_all_tasks(spark):
    table = spark.createDataFrame([("A", "easy", n, f"i{n}", "c", f"t{n}", "g") for n in range(4)],
                                  "form string, difficulty string, position int, id string, cue string, target string, interference_group string")
    people = spark.createDataFrame([("p", "A", "easy"), ("p", "A", "easy"), ("q", "B", "easy"), (None, "A", "easy"), ("r", None, "easy")],
                                   "participant_id string, form string, difficulty string")
    blocks = stimuli.block_items(people, table)
    for rows in (stimuli.distractors(blocks), stimuli.recognition_choices(blocks)):
        plans = rows._jdf.queryExecution()
        assert not [p for p in plans.optimizedPlan().toString().splitlines() if "Filter" in p and "lambdafunction" in p]
        assert "hashpartitioning(form" not in plans.executedPlan().toString()
        assert sorted((r.participant_id or "", r.item.id) for r in rows.collect()) == sorted((p, f"i{n}") for p in ("p", "p", "") for n in range(4))


def test_text_rules(spark):
    df = spark.createDataFrame([("data/p1_Relax_Math.mp4", None), ("x.avi", None), ("a/b_c.mp4", "Own"), ("", None)], "v string, t string")
    got = df.select(text.task_of_video("v").alias("a"), text.task_of_recording("v", "t").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("Math", "Relax_Math"), ("x", "unknown"), ("c", "Own"), (None, "unknown")]
    row = spark.range(1).select(
        text.answer_is_correct(F.lit("\n Harbor\t"), F.lit("harbor")).alias("ok"),
        text.interference_group(F.lit("A-H01")).alias("g"),
        text.record_id(F.lit(" p "), "s", F.lit(1), F.lit("adaptive"), F.lit(5)).alias("rid"),
        numeric.load_level(F.lit(0.4)).alias("level"),
        numeric.eye_state(F.lit(float("nan"))).alias("eye"),
    ).first()
    assert list(row) == [True, "A-H01", "p_s1_adaptive_5", "medium", "unknown"]


def test_geometry_examples(spark):
    def points(n, **at):
        return [(at.get(f"p{i}", (0.0, 0.0, 0.0))) for i in range(n)]

    rows = [
        (0, points(478, p61=(0.0, 0.0, 0.0), p291=(1.0, 0.0, 0.0), p13=(0.5, 0.2, 0.0), p14=(0.5, 0.0, 0.0),
                   p33=(0.0, 0.0, 0.0), p263=(1.0, 1.0, 0.0), p10=(0.0, 0.0, 0.0), p152=(0.0, 1.0, 1.0),
                   p4=(0.5, 0.0, 0.0), p234=(0.0, 0.0, 0.0), p454=(2.0, 0.0, 0.0)), True),
        (1, points(10), True),
        (2, points(478), False),
    ]
    df = spark.createDataFrame(rows, f"frame_idx bigint, points {schemas.POINTS}, detected boolean").selectExpr(
        "'u' user_id", "'t' task", "*", "0.9D quality", "100D brightness")
    a, b, c = geometry.frame_features(df).orderBy("frame_idx").collect()
    assert a.mouth_mar == pytest.approx(0.2) and a.roll == pytest.approx(0.7853981633974483)
    assert (a.eye_center_x, a.eye_center_y) == (0.5, 0.5) and a.pitch == pytest.approx(0.7853981633974483)
    assert a.yaw == pytest.approx(-0.4636476090008061) and a.valid and a.ear_mean == 0.0
    assert b.mouth_mar == b.roll == b.eye_center_x == 0.0 and b.valid
    assert not c.valid and c.quality == 0.0
    box = spark.createDataFrame([([(10.7, 20.2, 0.0), (30.9, 61.0, 0.0)],)], f"p {schemas.POINTS}").select(geometry.face_box("p").alias("b")).first().b
    assert tuple(box) == (6, 12, 28, 57)


def test_session_timing(spark):
    finals = spark.createDataFrame(
        [("r0", "p", 1, "2024-01-01 00:00:00", "2024-01-01 00:00:00"), ("r1", "p", 1, "2024-01-05 00:00:00", "2024-01-05 01:00:00"),
         ("r2", "q", 1, "2024-01-01 00:00:00", "2024-01-03 23:00:00")],
        "record_id string, participant_id string, session_number int, started_at string, completed_at string")
    asks = spark.createDataFrame([("p", 2, False), ("p", 2, True), ("q", 2, True), ("p", 1, False), ("n", 2, False)],
                                 "participant_id string, session_number int, allow_early boolean")
    now = F.lit("2024-01-05 13:00:00").cast("timestamp")
    got = {(r.participant_id, r.session_number, r.allow_early): r for r in study.session_timing(asks, finals, now).collect()}
    assert got[("p", 2, False)].hours_since_first == 12.0 and not got[("p", 2, False)].can_start
    assert got[("p", 2, True)].can_start and got[("p", 2, True)].early_override
    assert not got[("q", 2, True)].too_early and not got[("q", 2, True)].early_override
    assert got[("p", 1, False)].hours_since_first is None and got[("n", 2, False)].can_start


def test_storage(spark):
    schema = "record_id string, participant_id string, saved_at int, delayed_pending boolean, delayed_due_at string"
    drafts = spark.createDataFrame([("a", "p", 1, True, "d"), ("b", "p", 1, True, "d")], schema)
    finals = spark.createDataFrame([("c", "p", 1, True, "x"), ("d", "p", 1, True, "w")], schema)
    written = spark.createDataFrame([("a", "p", 9, True, "n", 1), ("a", "p", 5, True, "y", 2), ("c", "p", 0, True, "z", 1)], schema + ", write_seq int")
    left, merged = study.finalize(drafts, finals, written)
    assert [r.record_id for r in left.collect()] == ["b"]
    assert {r.record_id: r.saved_at for r in merged.collect()} == {"a": 5, "c": 0, "d": 1}
    results = spark.createDataFrame([("a",), ("gone",)], "linked_record_id string")
    assert {r.record_id: r.delayed_pending for r in study.clear_pending(merged, results).collect()} == {"a": False, "c": True, "d": True}
    assert [r.record_id for r in study.pending_tests(merged, results).collect()] == ["d", "c"]


def test_summaries(spark):
    trials = spark.createDataFrame(
        [("s", 1, "learning", "easy", True, 0.0, "i1", 1), ("s", 1, "learning", "easy", True, 0.0, "i1", 2), ("s", 1, "recognition", "easy", True, 100.0, "i1", 3),
         ("s", 1, "recognition", "easy", False, 300.0, "i2", 4), ("s", 2, "cued_recall", "hard", True, 50.0, "i3", 5)],
        "record_id string, block_index int, kind string, difficulty string, correct boolean, reaction_time_ms double, item_id string, timestamp_ms bigint"
    ).selectExpr("*", "concat('t', timestamp_ms) trial_id", "item_id cue", "item_id target")
    acts = spark.createDataFrame([("s", "learning_easy", "applied"), ("s", "learning_hard", "dismissed")], "record_id string, phase string, outcome string")
    got = {r.block_index: r for r in study.block_summaries(trials, acts).collect()}
    assert (got[1].recognition_accuracy, got[1].recognition_mean_rt_ms, got[1].learning_item_count, got[1].adaptation_applied) == (0.5, 200.0, 2, True)
    assert (got[2].recognition_accuracy, got[2].cued_recall_accuracy, got[2].adaptation_applied) == (0.0, 1.0, False)
    whole = study.session_summaries(trials, acts, acts.where("false")).first()
    assert (whole.recognition_accuracy, whole.intervention_count, whole.scored_windows) == (0.5, 1, 0)
    assert [r.item_id for r in study.first_seen_items(trials).collect()] == ["i1"]
    ts = spark.createDataFrame([("s", "2024-01-01 00:00:00", "baseline"), ("s", "2024-01-01 00:01:00", "learn_easy"), ("s", "2024-01-02 00:02:00", "break"), ("s", "2024-01-02 00:02:30", "complete")],
                               "record_id string, at string, phase string").withColumn("at", F.col("at").cast("timestamp"))
    t = study.phase_seconds(ts).first()
    assert (t.total_seconds, t.task_seconds, t.break_seconds) == (86550.0, 86460.0, 30.0)
    assert spark.range(1).select(study.phase_tag(F.lit("test_hard_cued"))).first()[0] == "test_hard_cued_recall"


SESSION = {
    "recordId": "r1", "participantId": "p", "sessionNumber": 1, "condition": "adaptive", "form": "A", "startedAtIso": "2024-01-01T00:00:00Z",
    "session2StartedEarlyOverride": False, "totalSessionSeconds": 10.0, "activeTaskSeconds": 8.0, "breakSeconds": 1.0,
    "cliSamples": [{"timestampMs": 1, "sessionTimeS": 0.1, "phase": "learning_easy", "rawCli": 0.4, "smoothedCli": 0.5, "validFrameRatio": 1.0, "illuminationStd": 3.0,
                    "qualityFlags": {"lowValidFrameRatio": False, "unstableIllumination": False}}],
    "interventions": [{"timestampMs": 2, "sessionTimeS": 0.2, "phase": "learning_easy", "type": "micro_break_60s", "outcome": o, "cli": 0.8, "smoothedCli": 0.8, "validFrameRatio": 1.0} for o in ("applied", "dismissed")],
    "trials": [{"trialId": f"t{i}", "timestampMs": i, "sessionTimeS": i / 1000, "phase": "x", "kind": k, "difficulty": d, "blockIndex": 1, "itemId": item, "cue": 'say "hi", now', "target": "t\nu",
                "recognitionChoices": ["a", "b"] if k == "recognition" else None, "correct": True, "reactionTimeMs": 5.0, "condition": "adaptive", "form": "A"}
               for i, (k, d, item) in enumerate([("learning", "easy", "A-E01"), ("learning", "easy", "A-E01"), ("learning", "hard", "A-H01"), ("recognition", "easy", "A-E01")])],
    "pendingDelayedTest": True, "delayedDueAtIso": "2024-01-08T00:00:00Z",
}


def test_records_export_and_csv(spark, tmp_path):
    path = tmp_path / "records.jsonl"
    path.write_text("\n".join([json.dumps(SESSION), "{broken", "null", json.dumps({**SESSION, "recordId": "r2", "nasaTlx": {"effort": 3.0}})]))
    sessions = readers.read_records(spark, str(path), schemas.SESSIONS)
    assert {r.recordId for r in sessions.select("recordId").collect()} == {"r1", "r2"}
    delayed = sessions.selectExpr("'d1' recordId", "recordId linkedSessionRecordId", "participantId", "sessionNumber", "condition", "form", "delayedDueAtIso dueAtIso", "completedAtIso", "trials")
    tables = export.export_tables(sessions, delayed)
    assert {n: t.count() for n, t in tables.items()} == {"session_summary": 2, "cli_windows": 2, "trials": 8, "interventions": 4, "tlx": 1, "delayed": 8}
    summary = tables["session_summary"].first()
    assert summary.intervention_count == 1 and summary.completed_at == ""
    writers.write_export({"trials": tables["trials"].where("record_id = 'r1'").coalesce(1)}, str(tmp_path / "out"))
    body = open(glob.glob(str(tmp_path / "out/trials/*.csv"))[0], newline="").read()
    rows = list(csv.DictReader(io.StringIO(body)))
    assert len(rows) == 4 and rows[0]["cue"] == 'say "hi", now' and rows[0]["target"] == "t\nu" and '"say ""hi"", now"' in body
    assert rows[3]["recognition_choices"] == "a|b" and rows[0]["selected_choice"] == "" and ',"",' not in body
    packet = study.delayed_packets(sessions).where("recordId = 'r1'").first()
    assert [i.id for i in packet.easyItems] == ["A-E01"] and [i.interferenceGroup for i in packet.hardItems] == ["A-H01"]
    bundle = export.bundle_rows(sessions, delayed)
    writers.write_bundles(bundle, str(tmp_path / "bundle"))
    assert spark.read.json(str(tmp_path / "bundle")).count() == 4


def test_recordings(spark, tmp_path):
    def put(name, content):
        f = tmp_path / "physio" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(content)

    put("2ea4/2ea4_Math.txt", "ECG,EDA,RR\n" + "\n".join(f"{i},{i * 2},{-i}" for i in range(5000)) + "\n")
    put("2ea4/2ea4_Video 1.txt", "RR,ECG,EDA\n1,2,3\n4,nan,6\n")
    put("2ea4/2ea4_Bad.txt", "ECG,EDA\n1,2\n")
    put("2ea4/other.txt", "ECG,EDA,RR\n1,2,3\n")
    put(".hidden/.hidden_Math.txt", "ECG,EDA,RR\n1,2,3\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        samples, rejected = readers.read_recordings(spark, str(tmp_path / "physio"))
        math = samples.where("task = 'Math'").orderBy("sample_idx").collect()
        assert [(r.sample_idx, r.ECG, r.EDA, r.RR) for r in math] == [(i, float(i), 2.0 * i, -1.0 * i) for i in range(5000)]
        other = samples.where("task <> 'Math'").orderBy("sample_idx").collect()
        assert [(r.user_id, r.task, r.ECG, r.EDA, r.RR) for r in other] == [("2ea4", "Video 1", 2.0, 3.0, 1.0), ("2ea4", "Video 1", None, 6.0, 4.0)]
        assert [r.path.endswith("2ea4_Bad.txt") for r in rejected.collect()] == [True]
        assert {r.task for r in readers.find_recordings(spark, str(tmp_path / "physio")).collect()} == {"Math", "Video 1", "Bad"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_recording_faults_name_every_lost_cell(spark, tmp_path):
    def put(name, content):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(content)

    put("p/p_Math.txt", "ECG,EDA,RR\n1,2,3\n4, ,x7\n\n5,inf\n" + "".join(f"{i},1,2\n" for i in range(2000)) + "nan,1,2")
    put("p/p_Bad.txt", "ECG, time\n1,2\n")
    put("q/q_Good.txt", "RR,ECG,EDA\n1,2,3")
    put("q/readme.txt", "ECG,EDA,RR\nx,y,z")
    put("q/q_Empty.txt", "")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        faults = readers.recording_faults(spark, str(tmp_path)).collect()
        samples, rejected = readers.read_recordings(spark, str(tmp_path))
        lost = sum(r[c] is None for r in samples.collect() for c in ("ECG", "EDA", "RR"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.user_id, r.task, r.line, r.column, r.value or "", r.reason) for r in faults) == [
        ("p", "Bad", 0, "EDA", "", "missing column"), ("p", "Bad", 0, "RR", "", "missing column"), ("p", "Math", 2, "EDA", " ", "empty cell"),
        ("p", "Math", 2, "RR", "x7", "no number"), ("p", "Math", 3, "EDA", "inf", "not finite"), ("p", "Math", 3, "RR", "", "missing cell"),
        ("p", "Math", 2004, "ECG", "nan", "not finite")]
    assert lost == 5 and rejected.count() == 1


def test_manifest_labels_features_json(spark, tmp_path):
    (tmp_path / "m.csv").write_text("video_file,label,role,user_id\na.mp4,low,train,u1\n")
    (tmp_path / "bad.csv").write_text("video_file,label\na.mp4,low\n")
    assert readers.read_manifest(spark, str(tmp_path / "m.csv")).first().task is None
    with pytest.raises(ValueError):
        readers.read_manifest(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "labels.csv").write_text("subject/task,binary-stress\n2ea4_Video_1,1\nx_Math,0\n")
    got = readers.read_binary_labels(spark, str(tmp_path / "labels.csv")).collect()
    assert [tuple(r) for r in got] == [("2ea4", "Video_1", 1), ("x", "Math", 0)]
    df = spark.createDataFrame([("u", "v_Math.mp4", 1.5, float("nan"))], "user_id string, video string, blink_rate double, ear_std double")
    writers.write_features(df, str(tmp_path / "f.csv"), fmt="csv")
    back = readers.read_features(spark, str(tmp_path / "f.csv")).first()
    assert back.blink_rate == 1.5 and back.ear_std is None and back.perclos == 0.0 and back.label is None
    writers.write_json(spark, {"a": [1, 2]}, str(tmp_path / "spec"))
    assert readers.read_json(spark, str(tmp_path / "spec")) == {"a": [1, 2]}


def test_collected_samples(spark):
    req = spark.createDataFrame([("p", None, [(1, 0, "high", "easy", "t", {"blink_rate": 2.0}, 1.0), (2, 1, "low", "hard", "t", {}, 1.0)]), ("q", None, [])], schemas.COLLECTED_SAMPLES)
    flat = writers.flatten_collected(req)
    rows = writers.collected_rows(flat).orderBy("timestamp").collect()
    assert [(r.label, r.blink_rate, r.perclos, r.role) for r in rows] == [(1, 2.0, 0.0, "train"), (0, 0.0, 0.0, "train")]
    c = writers.collected_counts(flat).first()
    assert (c.total_samples, c.low, c.high, c.easy, c.medium, c.hard) == (2, 1, 1, 1, 0, 1)


def test_rates(spark):
    ms = [0, 100, 150, 150, 350, 400]
    df = spark.createDataFrame([("u", m) for m in ms], "k string, ms bigint").withColumn("at", F.timestamp_millis("ms"))
    rows = study.frame_rate(df, ["k"], "at").orderBy("ms").collect()
    want, last = [0.0], 0.0
    for a, b in zip(ms, ms[1:]):
        last = 0.1 * (1000 / (b - a)) + 0.9 * last if b > a else last
        want.append(last)
    assert [r.fps for r in rows] == pytest.approx(want)
    m = spark.createDataFrame([("u", i, float(i)) for i in range(20)], "k string, n bigint, v double")
    got = {r.n: r.recent_mean for r in study.recent_mean(m, ["k"], "n", "v", 3, chunk_rows=4).collect()}
    assert got[0] == 0.0 and got[1] == 0.5 and all(got[i] == i - 1.0 for i in range(2, 20))
