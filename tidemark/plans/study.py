"""Study protocol, session records, summaries and export tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import StudyPlan
from tidemark.operators import export, stimuli, study
from tidemark.plans.tables import (
    FINALS_SQL,
    INTERVENTIONS_SQL,
    SESSIONS_SQL,
    TRIALS_SQL,
    delayed_tests,
    events,
    EVENTS_SQL,
    finals,
    instant,
    interventions,
    load,
    rounded,
    sessions,
    trials,
)

PLAN = StudyPlan()
NOW = "1998-06-01 12:00:00"
NOW_US = 896_702_400_000_000


def now():
    return F.timestamp_micros(F.lit(NOW_US))


# --- protocol ------------------------------------------------------------------------------------


def participant_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = load(spark, sf_dir, "customer").select(
        F.concat(F.lit(" "), "c_name", F.lit("\t")).alias("participant_id"),
        F.when(F.col("c_acctbal") > 4000, 1).otherwise(2).alias("session_number"),
    )
    out = study.assign_participants(people, now=now())
    return out.select(
        "participant_normalized",
        "session_number",
        "hash_value",
        "hash_parity",
        F.array_join("condition_order", ",").alias("condition_order"),
        F.array_join("form_order", ",").alias("form_order"),
        "condition",
        "form",
        F.unix_millis("delayed_due_at").alias("due_ms"),
    )


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items of two forms and two difficulties; neighbours share an interference group."""
    parts = load(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B").alias("form"),
        F.when(F.col("p_size") <= 25, "easy").otherwise("hard").alias("difficulty"),
        F.col("p_partkey").alias("position"),
        F.col("p_name").alias("cue"),
        F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("target"),
    )
    first = stimuli.first_items(parts, PLAN)
    return first.select(
        "form",
        "difficulty",
        "position",
        F.concat_ws("-", "form", "difficulty", F.col("place").cast("string")).alias("id"),
        "cue",
        "target",
        F.concat(F.col("difficulty"), F.lit("-g"), F.floor((F.col("place") + 1) / F.lit(2.0)).cast("string")).alias("interference_group"),
    )


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = load(spark, sf_dir, "customer").select(
        F.col("c_name").alias("participant_id"),
        F.when(F.col("c_nationkey") % 2 == 0, "A").otherwise("B").alias("form"),
        F.when(F.col("c_acctbal") > 4000, "easy").otherwise("hard").alias("difficulty"),
    )
    return stimuli.block_items(people, _items(spark, sf_dir))


def block_item_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select(
        "participant_id", "form", "difficulty", F.array_join(F.transform("items", lambda i: i["id"]), ",").alias("item_order")
    )


def recognition_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stimuli.recognition_choices(_blocks(spark, sf_dir), choices=PLAN.recognition_choices, interference=PLAN.hard_interference_enabled)
    return out.select(
        "participant_id",
        F.col("item.id").alias("item_id"),
        F.array_join(F.transform("choices", lambda c: c["value"]), "|").alias("choices"),
        F.array_position(F.transform("choices", lambda c: c["is_correct"]), True).alias("right_place"),
    )


def distractor_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for wrong answers per block item: how many share the group, how many remain."""
    out = stimuli.distractors(_blocks(spark, sf_dir))
    return out.select(
        "participant_id", F.col("item.id").alias("item_id"), F.size("same_group").alias("same_group"), F.size("candidates").alias("candidates")
    )


def session_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("participant_id"),
        F.when(F.col("c_nationkey") < 20, 2).otherwise(1).alias("session_number"),
        (F.col("c_acctbal") > 5000).alias("allow_early"),
    )
    return rounded(study.session_timing(asks, finals(spark, sf_dir), now()))


def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.recent_sessions(finals(spark, sf_dir)).select("participant_id", "record_id", "session_number", "started_at")


def recent_first_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.recent_sessions(finals(spark, sf_dir), 1).select("participant_id", "record_id", "started_at")


def participant_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second sessions in the order of their start."""
    wanted = finals(spark, sf_dir).where("session_number = 2")
    return study.list_sessions(wanted).select("record_id", "participant_id", "started_at")


# --- storage -------------------------------------------------------------------------------------


def _writes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = finals(spark, sf_dir).select("record_id", "participant_id", "status", F.col("started_at").alias("saved_at"), "price")
    drafts = rows.where("status <> 'O'").withColumn("record_id", F.floor(F.col("record_id") / 2.0))
    stored = rows.where("status = 'F'")
    # Some records are written twice, the later write under an older stamp than the first and than the stored record.
    first = rows.where("status = 'P'").withColumns({"record_id": F.col("record_id") - 1, "write_seq": F.lit(1)})
    again = first.where("record_id % 3 = 0").withColumns({"saved_at": F.col("saved_at") - 1000, "write_seq": F.lit(2)})
    written = first.union(again)
    return drafts, stored, written


def finalized_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts, stored, written = _writes(spark, sf_dir)
    return study.finalize(drafts, stored, written)[1].select("record_id", "saved_at")


def open_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts, stored, written = _writes(spark, sf_dir)
    return study.finalize(drafts, stored, written)[0].select("record_id", "saved_at")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 30")
    return line.select(F.col("l_orderkey").alias("linked_record_id"))


def pending_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = study.pending_tests(finals(spark, sf_dir), _results(spark, sf_dir))
    return out.select("record_id", "participant_id", "delayed_due_at")


def pending_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.clear_pending(finals(spark, sf_dir), _results(spark, sf_dir)).select("record_id", "delayed_pending")


# --- trials --------------------------------------------------------------------------------------


def block_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    exposures = (
        trials(spark, sf_dir)
        .groupBy("record_id", "block_index")
        .agg((F.lit(3.5) + F.max(F.when(F.col("tax") >= 0.075, 1.0).otherwise(0.0))).alias("effective_exposure_seconds"))
    )
    return rounded(study.block_summaries(trials(spark, sf_dir), interventions(spark, sf_dir), exposures))


def replaced_block_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["record_id", "block_index"]
    old = trials(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"))
    new = trials(spark, sf_dir).where("kind = 'cued_recall'").groupBy(*keys).agg((-F.count("*")).alias("n"))
    return study.replace_block_summaries(old, new)


def session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = trials(spark, sf_dir).where("kind = 'learning'")
    return rounded(study.session_summaries(trials(spark, sf_dir), interventions(spark, sf_dir), scored))


def delayed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study.delayed_summaries(trials(spark, sf_dir)))


def first_seen_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.first_seen_items(trials(spark, sf_dir))


def phase_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as phase changes of a user's session."""
    phase = F.col("event_type")
    named = (
        F.when(phase == "view", "learn_easy")
        .when(phase == "click", "break")
        .when(phase == "purchase", "test_hard_cued")
        .otherwise("baseline")
    )
    changes = events(spark, sf_dir).select(F.col("user_id").alias("record_id"), F.col("ts").alias("at"), named.alias("phase"))
    return rounded(study.phase_seconds(changes))


def phase_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag, learning and task flags and block of the phases that events stand for."""
    names = list(study.PHASE_TAGS)
    phase = F.get(F.array(*[F.lit(n) for n in names]), F.col("k") % len(names))
    return events(spark, sf_dir).select(
        "event_id",
        study.phase_tag(phase).alias("tag"),
        study.is_learning_phase(phase).alias("learning"),
        study.is_task_phase(phase).alias("active"),
        study.block_of_tag(study.phase_tag(phase)).alias("block"),
    )


def learning_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only samples of learning phases reach the controller."""
    names = list(study.PHASE_TAGS)
    phase = F.get(F.array(*[F.lit(n) for n in names]), F.col("k") % len(names))
    return events(spark, sf_dir).where(study.is_learning_phase(phase)).select("event_id", "user_id", "value")


def trial_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem").withColumn("at", instant("l_shipdate"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", instant("o_orderdate").alias("session_start"))
    kind = F.when(F.col("l_returnflag") == "A", "learning").otherwise("recognition")
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "at",
        "session_start",
        kind.alias("kind"),
        (F.col("at") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("l_quantity").cast("decimal(18,6)"))).alias("question_start"),
    )
    out = study.trial_timing(rows, "at", "session_start", "question_start")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "session_time_s", "reaction_time_ms"))


# --- export --------------------------------------------------------------------------------------


def export_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(export.session_table(sessions(spark, sf_dir)))


def export_cli_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(export.cli_table(sessions(spark, sf_dir)))


def export_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(export.trial_table(sessions(spark, sf_dir)))


def export_interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(export.intervention_table(sessions(spark, sf_dir)))


def export_tlx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(export.tlx_table(sessions(spark, sf_dir)))


def export_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(export.delayed_table(delayed_tests(spark, sf_dir)))


def export_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the participant packages: identity and order of every record."""
    rows = export.bundle_rows(sessions(spark, sf_dir), delayed_tests(spark, sf_dir), now())
    return rows.select(
        "participant_id", "kind", "sort_key", "record_id", F.get_json_object("record", "$.recordId").alias("inner_id")
    )


def delayed_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(c: str):
        return F.array_join(F.transform(c, lambda i: F.concat(i["id"], F.lit("="), i["target"])), ",")

    out = study.delayed_packets(sessions(spark, sf_dir))
    return out.select("recordId", "participantId", "form", joined("easyItems").alias("easy_items"), joined("hardItems").alias("hard_items"))


QUERIES = {
    "participant_assignment": participant_assignment,
    "block_item_order": block_item_order,
    "recognition_choices": recognition_choices,
    "distractor_pools": distractor_pools,
    "session_timing": session_timing,
    "recent_sessions": recent_sessions,
    "recent_first_sessions": recent_first_sessions,
    "participant_sessions": participant_sessions,
    "finalized_sessions": finalized_sessions,
    "open_drafts": open_drafts,
    "pending_tests": pending_tests,
    "pending_flags": pending_flags,
    "block_summaries": block_summaries,
    "replaced_block_summaries": replaced_block_summaries,
    "session_summaries": session_summaries,
    "delayed_summaries": delayed_summaries,
    "first_seen_items": first_seen_items,
    "phase_seconds": phase_seconds,
    "phase_tags": phase_tags,
    "learning_samples": learning_samples,
    "trial_timing": trial_timing,
    "export_session_summary": export_session_summary,
    "export_cli_windows": export_cli_windows,
    "export_trials": export_trials,
    "export_interventions": export_interventions,
    "export_tlx": export_tlx,
    "export_delayed": export_delayed,
    "export_bundles": export_bundles,
    "delayed_packets": delayed_packets,
}

_HASH = (
    "list_reduce(list_concat([0::BIGINT], list_transform(string_split({s}, ''), lambda c: CAST(ord(c) AS BIGINT))),"
    " lambda h, c: (h * 31 + c) % 4294967296)"
)


def _hash(s: str) -> str:
    return _HASH.format(s=s)


def _items_sql() -> str:
    return f"""parts AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS form, CASE WHEN p_size <= 25 THEN 'easy' ELSE 'hard' END AS difficulty,
         p_name AS cue, p_brand || ' ' || p_size AS target, p_partkey FROM part),
ranked_parts AS (SELECT *, row_number() OVER (PARTITION BY form, difficulty ORDER BY p_partkey) AS n FROM parts),
items AS (
  SELECT form, form || '-' || difficulty || '-' || n AS id, cue, target, difficulty, difficulty || '-g' || ((n + 1) // 2) AS grp, n
  FROM ranked_parts WHERE n <= CASE difficulty WHEN 'easy' THEN {PLAN.easy_item_count} ELSE {PLAN.hard_item_count} END)"""


def _shuffle_sql(name: str, source: str, seed: str, items: str, key: str) -> str:
    """Seeded shuffle as a recursion over list positions; ``key`` identifies a row of ``source``."""
    return f"""
{name}_walk AS (
  SELECT {key}, {items} AS a, CAST(len({items}) - 1 AS BIGINT) AS i, CAST({seed} AS BIGINT) AS st FROM {source}
  UNION ALL
  SELECT {key}, list_transform(a, lambda x, p: CASE WHEN p = i + 1 THEN a[j + 1] WHEN p = j + 1 THEN a[i + 1] ELSE x END), i - 1, st2
  FROM (SELECT *, CAST(floor(st2 / 4294967296.0::DOUBLE * (i + 1)) AS BIGINT) AS j
        FROM (SELECT *, (st * 1664525 + 1013904223) % 4294967296 AS st2 FROM {name}_walk WHERE i > 0))),
{name} AS (SELECT {key}, a FROM {name}_walk WHERE i <= 0)
"""


_PEOPLE_SQL = f"""
{_items_sql()},
people AS (
  SELECT c_name AS participant_id, CASE WHEN c_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS form,
         CASE WHEN c_acctbal > 4000 THEN 'easy' ELSE 'hard' END AS difficulty FROM customer),
pools AS (SELECT form, difficulty, list(id ORDER BY n) AS ids FROM items GROUP BY ALL),
seeded AS (
  SELECT p.*, ids, {_hash("participant_id || ':' || form || ':' || difficulty")} AS seed FROM people p JOIN pools USING (form, difficulty)),
{_shuffle_sql('ordered', 'seeded', 'seed', 'ids', 'participant_id, form, difficulty')}
"""

_BLOCK_SQL = _PEOPLE_SQL + """,
placed AS (
  SELECT participant_id, i.*, list_position(a, i.id) AS place FROM ordered o JOIN items i ON i.form = o.form AND i.difficulty = o.difficulty)
"""

_CHOICE_SQL = (
    _BLOCK_SQL
    + f""",
ranked AS (
  SELECT x.participant_id, x.id, x.target, y.target AS wrong, min(CASE WHEN y.grp = x.grp THEN y.place ELSE 100 + y.place END) AS r
  FROM placed x JOIN placed y ON y.participant_id = x.participant_id AND y.id <> x.id AND y.target <> x.target GROUP BY ALL),
first3 AS (
  SELECT participant_id, id, target, list(wrong ORDER BY r) AS wrongs
  FROM (SELECT *, row_number() OVER (PARTITION BY participant_id, id ORDER BY r) AS q FROM ranked) WHERE q <= 3 GROUP BY ALL),
asked AS (SELECT *, {_hash("participant_id || ':' || id || ':recognition'")} AS seed FROM first3),
{_shuffle_sql('mixed', 'asked', 'seed', 'wrongs', 'participant_id, id, target, seed')},
offered AS (SELECT participant_id, id, target, seed, list_concat([target], a) AS l, xor(seed, 2654435761::BIGINT) AS seed2 FROM mixed),
{_shuffle_sql('final', 'offered', 'seed2', 'l', 'participant_id, id, target')}
"""
)

_LATEST = "QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY {o}) = 1"
_ACC = "round(CASE WHEN count(*) FILTER (kind = '{k}') > 0 THEN count(*) FILTER (kind = '{k}' AND correct) / count(*) FILTER (kind = '{k}') ELSE 0 END, 6)"
_RT = "round(coalesce(avg(reaction_time_ms) FILTER (kind = '{k}'), 0), 6)"
_FOUR = (
    f"{_ACC.format(k='recognition')} AS recognition_accuracy, {_RT.format(k='recognition')} AS recognition_mean_rt_ms, "
    f"{_ACC.format(k='cued_recall')} AS cued_recall_accuracy, {_RT.format(k='cued_recall')} AS cued_recall_mean_rt_ms"
)
_WRITES_SQL = FINALS_SQL + """,
rows_ AS (SELECT record_id, participant_id, status, started_at AS saved_at FROM finals),
drafts AS (SELECT record_id // 2 AS record_id, saved_at FROM rows_ WHERE status <> 'O'),
written AS (
  SELECT record_id - 1 AS record_id, saved_at, 1 AS seq FROM rows_ WHERE status = 'P'
  UNION ALL SELECT record_id - 1, saved_at - 1000, 2 FROM rows_ WHERE status = 'P' AND (record_id - 1) % 3 = 0),
merged AS (
  SELECT record_id, saved_at FROM rows_ WHERE status = 'F' AND record_id NOT IN (SELECT record_id FROM written)
  UNION ALL SELECT record_id, arg_max(saved_at, seq) FROM written GROUP BY record_id)
"""
_RESULTS = "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30"
_PHASES = "['baseline','learn_easy','test_easy_recognition','test_easy_cued','learn_hard','test_hard_recognition','test_hard_cued','break','nasa_tlx','complete']"
_TAGS = "['baseline_calibration','learning_easy','test_easy_recognition','test_easy_cued_recall','learning_hard','test_hard_recognition','test_hard_cued_recall','break','nasa_tlx','complete']"
_HEAD = "record_id, participant_id, session_number, condition, form"
_SEEN = """seen AS (SELECT *, row_number() OVER (PARTITION BY record_id, item_id ORDER BY timestamp_ms, trial_id) AS q FROM trials WHERE kind = 'learning')"""

ORACLES = {
    "participant_assignment": f"""WITH p AS (SELECT lower(c_name) AS participant_normalized, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 2 END AS session_number FROM customer),
        h AS (SELECT *, {_hash('participant_normalized')} AS hash_value FROM p)
        SELECT participant_normalized, session_number, hash_value, CASE WHEN hash_value % 2 = 0 THEN 'even' ELSE 'odd' END AS hash_parity,
               CASE WHEN hash_value % 2 = 0 THEN 'adaptive,baseline' ELSE 'baseline,adaptive' END AS condition_order,
               CASE WHEN hash_value % 2 = 0 THEN 'A,B' ELSE 'B,A' END AS form_order,
               CASE WHEN (hash_value + session_number) % 2 = 1 THEN 'adaptive' ELSE 'baseline' END AS condition,
               CASE WHEN (hash_value + session_number) % 2 = 1 THEN 'A' ELSE 'B' END AS form,
               epoch_ms(TIMESTAMP '{NOW}' + INTERVAL 7 DAYS) AS due_ms FROM h""",
    "block_item_order": f"WITH RECURSIVE {_PEOPLE_SQL} SELECT participant_id, form, difficulty, array_to_string(a, ',') AS item_order FROM ordered",
    "recognition_choices": f"WITH RECURSIVE {_CHOICE_SQL} SELECT participant_id, id AS item_id, array_to_string(a, '|') AS choices, CAST(list_position(a, target) AS BIGINT) AS right_place FROM final",
    "distractor_pools": f"""WITH {_items_sql()},
        people AS (SELECT c_name AS participant_id, CASE WHEN c_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS form, CASE WHEN c_acctbal > 4000 THEN 'easy' ELSE 'hard' END AS difficulty FROM customer),
        pairs AS (SELECT x.form, x.difficulty, x.id, count(*) FILTER (y.grp = x.grp) AS s, count(*) AS c
                  FROM items x JOIN items y ON x.form = y.form AND x.difficulty = y.difficulty AND x.id <> y.id AND x.target <> y.target GROUP BY ALL)
        SELECT participant_id, id AS item_id, CAST(s AS INTEGER) AS same_group, CAST(c AS INTEGER) AS candidates FROM people JOIN pairs USING (form, difficulty)""",
    "session_timing": f"""WITH {FINALS_SQL},
        first AS (SELECT participant_id, completed_ms FROM finals WHERE session_number = 1 {_LATEST.format(k='participant_id', o='started_at DESC, record_id DESC')}),
        asks AS (SELECT c_custkey AS participant_id, CASE WHEN c_nationkey < 20 THEN 2 ELSE 1 END AS session_number, c_acctbal > 5000 AS allow_early FROM customer),
        t AS (SELECT a.*, CASE WHEN session_number = 2 THEN (epoch_ms(TIMESTAMP '{NOW}') - completed_ms) / 3.6e6 END AS h FROM asks a LEFT JOIN first USING (participant_id))
        SELECT participant_id, session_number, allow_early, round(h, 6) AS hours_since_first, coalesce(h < 24, false) AS too_early,
               NOT coalesce(h < 24, false) OR allow_early OR session_number = 1 AS can_start,
               session_number = 2 AND allow_early AND coalesce(h < 24, false) AS early_override FROM t""",
    "recent_sessions": f"WITH {FINALS_SQL} SELECT participant_id, record_id, session_number, started_at FROM finals {_LATEST.format(k='participant_id', o='started_at DESC, record_id DESC')}",
    "recent_first_sessions": f"WITH {FINALS_SQL} SELECT participant_id, record_id, started_at FROM finals WHERE session_number = 1 {_LATEST.format(k='participant_id', o='started_at DESC, record_id DESC')}",
    "participant_sessions": f"WITH {FINALS_SQL} SELECT record_id, participant_id, started_at FROM finals WHERE session_number = 2",
    "finalized_sessions": f"WITH {_WRITES_SQL} SELECT record_id, saved_at FROM merged",
    "open_drafts": f"WITH {_WRITES_SQL} SELECT record_id, max(saved_at) AS saved_at FROM drafts WHERE record_id NOT IN (SELECT record_id FROM merged) GROUP BY record_id",
    "pending_tests": f"WITH {FINALS_SQL} SELECT record_id, participant_id, delayed_due_at FROM finals WHERE delayed_pending AND record_id NOT IN ({_RESULTS})",
    "pending_flags": f"WITH {FINALS_SQL} SELECT record_id, delayed_pending AND record_id NOT IN ({_RESULTS}) AS delayed_pending FROM finals",
    "block_summaries": f"""WITH {INTERVENTIONS_SQL},
        hit AS (SELECT DISTINCT record_id, CASE WHEN phase IN ('learning_easy', 'test_easy_recognition', 'test_easy_cued_recall') THEN 1 ELSE 2 END AS block_index, true AS a
                FROM interventions WHERE outcome = 'applied')
        SELECT record_id, block_index, min(difficulty) AS difficulty, count(*) FILTER (kind = 'learning') AS learning_item_count, {_FOUR},
               coalesce(bool_or(a), false) AS adaptation_applied, max(CASE WHEN tax >= 0.075 THEN 4.5::DOUBLE ELSE 3.5 END) AS effective_exposure_seconds
        FROM trials LEFT JOIN hit USING (record_id, block_index) GROUP BY record_id, block_index""",
    "replaced_block_summaries": f"""WITH {TRIALS_SQL} SELECT record_id, block_index,
        CASE WHEN count(*) FILTER (kind = 'cued_recall') > 0 THEN -count(*) FILTER (kind = 'cued_recall') ELSE count(*) END AS n FROM trials GROUP BY ALL""",
    "session_summaries": f"""WITH {INTERVENTIONS_SQL}, i AS (SELECT record_id, count(*) AS c FROM interventions WHERE outcome = 'applied' GROUP BY ALL)
        SELECT record_id, {_ACC.format(k='recognition')} AS recognition_accuracy, {_ACC.format(k='cued_recall')} AS cued_recall_accuracy,
               coalesce(max(c), 0) AS intervention_count, count(*) FILTER (kind = 'learning') AS scored_windows
        FROM trials LEFT JOIN i USING (record_id) GROUP BY record_id""",
    "delayed_summaries": f"WITH {TRIALS_SQL} SELECT record_id, {_FOUR} FROM trials GROUP BY record_id",
    "first_seen_items": f"""WITH {TRIALS_SQL}, {_SEEN}
        SELECT record_id, item_id, cue, target, difficulty, array_to_string(string_split(item_id, '-')[1:2], '-') AS interference_group FROM seen WHERE q = 1""",
    "phase_seconds": f"""WITH {EVENTS_SQL},
        p AS (SELECT user_id, ts_us, CASE event_type WHEN 'view' THEN 't' WHEN 'purchase' THEN 't' WHEN 'click' THEN 'b' ELSE 'o' END AS c,
                     lead(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us) - ts_us AS s FROM ev)
        SELECT user_id AS record_id, coalesce(sum(s), 0) / 1e6 AS total_seconds, coalesce(sum(s) FILTER (c = 't'), 0) / 1e6 AS task_seconds,
               coalesce(sum(s) FILTER (c = 'b'), 0) / 1e6 AS break_seconds FROM p GROUP BY user_id""",
    "phase_tags": f"""WITH {EVENTS_SQL}, p AS (SELECT event_id, {_PHASES}[k % 10 + 1] AS phase, {_TAGS}[k % 10 + 1] AS tag, k % 10 AS n FROM ev)
        SELECT event_id, tag, phase IN ('learn_easy', 'learn_hard') AS learning, n BETWEEN 1 AND 6 AS active,
               CASE WHEN n BETWEEN 1 AND 3 THEN 1 WHEN n BETWEEN 4 AND 6 THEN 2 END AS block FROM p""",
    "learning_samples": f"WITH {EVENTS_SQL} SELECT event_id, user_id, value FROM ev WHERE k % 10 IN (1, 4)",
    "trial_timing": """SELECT l_orderkey, l_linenumber, l_partkey, round((epoch_ms(l_shipdate) - epoch_ms(o_orderdate)) / 1000.0, 6) AS session_time_s,
        CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity * 1000 END AS reaction_time_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "export_session_summary": f"""WITH {SESSIONS_SQL}, a AS (SELECT record_id, count(*) AS c FROM trials WHERE tax >= 0.075 GROUP BY ALL)
        SELECT {_HEAD}, started_at, CASE WHEN status <> 'P' THEN CAST(started_at AS VARCHAR) ELSE '' END AS completed_at, false AS session2_early_override,
               round(price / 100, 6) AS total_session_seconds, round(price / 200, 6) AS active_task_seconds, round(price / 400, 6) AS break_seconds,
               CAST(coalesce(c, 0) AS INTEGER) AS intervention_count, delayed_due_at, delayed_pending FROM lined LEFT JOIN a USING (record_id)""",
    "export_cli_windows": f"""WITH {SESSIONS_SQL} SELECT {_HEAD}, timestamp_ms, session_time_s, phase, round(discount * 10, 6) AS raw_cli, round(discount * 5, 6) AS smoothed_cli,
        round(1 - tax, 6) AS valid_frame_ratio, quantity AS illumination_std, 1 - tax < 0.955 AS low_vfr_flag, quantity > 28 AS unstable_illumination_flag
        FROM flat WHERE kind = 'learning'""",
    "export_trials": f"""WITH {SESSIONS_SQL} SELECT {_HEAD}, trial_id, phase, kind, difficulty, block_index, item_id, cue, target, recognition_choices, selected_choice,
        response_text, correct, reaction_time_ms, timestamp_ms, session_time_s FROM flat""",
    "export_interventions": f"""WITH {SESSIONS_SQL} SELECT {_HEAD}, timestamp_ms, session_time_s, phase, 'micro_break_60s' AS type,
        CASE WHEN tax >= 0.075 THEN 'applied' ELSE 'dismissed' END AS outcome, round(discount * 10, 6) AS cli, round(discount * 5, 6) AS smoothed_cli,
        round(1 - tax, 6) AS valid_frame_ratio, CASE WHEN tax >= 0.075 THEN 'break taken' ELSE '' END AS details FROM flat WHERE tax >= 0.065""",
    "export_tlx": f"""WITH {SESSIONS_SQL} SELECT {_HEAD}, round(price / 3e4, 6) AS mental_demand, round(price / 7e4, 6) AS physical_demand, round(price / 9e4, 6) AS temporal_demand,
        round(price / 1.1e5, 6) AS performance, round(price / 1.3e5, 6) AS effort, round(price / 1.7e5, 6) AS frustration FROM lined WHERE status = 'F'""",
    "export_delayed": f"""WITH {SESSIONS_SQL} SELECT 'd' || record_id AS delayed_record_id, record_id AS linked_session_record_id, participant_id, session_number, condition, form,
        delayed_due_at AS due_at, CAST(started_at AS VARCHAR) AS completed_at, kind, difficulty, block_index, item_id, cue, target, correct, reaction_time_ms,
        selected_choice, response_text, recognition_choices FROM flat WHERE NOT delayed_pending AND kind <> 'learning'""",
    "export_bundles": f"""WITH {SESSIONS_SQL} SELECT participant_id, 'session' AS kind, CAST(started_at AS VARCHAR) AS sort_key, CAST(record_id AS VARCHAR) AS record_id, CAST(record_id AS VARCHAR) AS inner_id FROM lined
        UNION ALL SELECT participant_id, 'delayed_test', CAST(delayed_due_at AS VARCHAR), 'd' || record_id, 'd' || record_id FROM lined WHERE NOT delayed_pending""",
    "delayed_packets": f"""WITH {SESSIONS_SQL}, {_SEEN},
        p AS (SELECT record_id, string_agg(item_id || '=' || target, ',' ORDER BY timestamp_ms, trial_id) FILTER (difficulty = 'easy') AS e,
                     string_agg(item_id || '=' || target, ',' ORDER BY timestamp_ms, trial_id) FILTER (difficulty = 'hard') AS h FROM seen WHERE q = 1 GROUP BY ALL)
        SELECT record_id AS "recordId", participant_id AS "participantId", form, coalesce(e, '') AS easy_items, coalesce(h, '') AS hard_items
        FROM lined LEFT JOIN p USING (record_id)""",
}
