"""Records merged from micro-batches: any order, replays, unfinished batches."""

import random

from tidemark.streaming import jobs
from tidemark.streaming.upsert import Snapshots, current_records, upsert_records

SCHEMA = "record_id long, kind string, saved_at long, write_seq int"


def writes(n, seed):
    rng = random.Random(seed)
    out = [(rng.randrange(30), rng.choice(["draft", "draft", "final"]), rng.randrange(10**6), None) for _ in range(n)]
    return [(r, k, t, i if k == "final" else None) for i, (r, k, t, _) in enumerate(out)]


def plain(rows):
    found = {}
    for record, kind, saved, seq in rows:
        rank = (kind == "final", -1 if seq is None else seq, saved)
        if record is not None and (record not in found or rank > found[record][0]):
            found[record] = (rank, (record, kind, saved, seq))
    return sorted(r for _, r in found.values())


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_replays_and_unfinished_batches(spark, tmp_path):
    rows = writes(120, 3) + [(None, "draft", 1, None)]
    parts = [rows[i::4] for i in range(4)]
    table = Snapshots(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, 5)
    assert content(table.read()) == []
    seen = []
    for n, part in enumerate(parts):
        batch = spark.createDataFrame(part, SCHEMA)
        table.merge(batch, n)
        table.merge(batch, n)
        seen += part
        assert content(table.read()) == plain(seen)
    # A batch before the last one, run again, changes nothing that is read; versions of a batch that did not finish are unseen.
    table.merge(spark.createDataFrame([], SCHEMA), 4)
    assert content(table.read()) == plain(rows)
    later = spark.createDataFrame([(1, "final", 5, 10**6)], SCHEMA).selectExpr("*", "pmod(xxhash64(record_id), 5) as _bucket", "9 as _version")
    later.write.partitionBy("_bucket", "_version").mode("append").parquet(str(tmp_path / "t/rows"))
    assert content(table.read()) == plain(rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = writes(90, 4)
    for i in range(3):
        spark.createDataFrame(rows[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_table(spark, str(tmp_path / "in"), files_per_trigger=1)
    assert content(upsert_records(stream, str(tmp_path / "out"), 3)) == content(current_records(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
