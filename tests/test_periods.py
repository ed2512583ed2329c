"""Upserts of buckets, sketches, and sessions over several batches of a stream."""

import glob
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from arborlake.operators import sketches, storage
from arborlake.streaming import queue, sessions


def files(path):
    return {f for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2000).select("id", F.lit("old").alias("v"))
    storage.write_buckets(rows, path, ["id"], buckets=16)
    before = files(path)
    new = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (9000, "c", 1)], "id long, v string, at int")
    touched = storage.upsert_buckets(path, new, ["id"], latest_by="at", buckets=16)
    assert 1 <= len(touched) <= 2
    kept = {f for f in before if not any(f"bucket={b}/" in f for b in touched)}
    assert kept <= files(path) and not (before - kept) & files(path)
    found = {r["id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert found == {i: "b" if i == 5 else "old" for i in range(2000)} | {9000: "c"}
    assert storage.upsert_buckets(path, new.limit(0), ["id"], buckets=16) == [] and files(path) >= kept


@pytest.mark.parametrize("batches", [1, 7])
def test_merged_sketches_keep_their_errors(spark, batches):
    rng = random.Random(batches)
    rows = [(i % batches, rng.randrange(30_000), rng.lognormvariate(0, 2)) for i in range(60_000)] + [(0, None, None)]
    df = spark.createDataFrame(rows, "batch int, who int, what double")
    merged = sketches.merged(sketches.sketched(df, {"batch": F.col("batch")}, "who", "what"), {"all": F.lit(1)})
    found = sketches.estimated(merged, [0.1, 0.5, 0.99]).first()
    exact = len({r[1] for r in rows if r[1] is not None})
    assert found["n"] == len(rows) and abs(found["distinct_estimate"] - exact) <= 3 * sketches.distinct_error() * exact
    values = sorted(r[2] for r in rows if r[2] is not None)
    for q in (0.1, 0.5, 0.99):
        rank = sum(v <= found[f"q_{round(100 * q)}"] for v in values) / len(values)
        assert math.isclose(rank, q, abs_tol=sketches.RANK_ERROR)


def test_sessions_over_batches(spark, tmp_path):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    events = [(i, rng.randrange(5), start + timedelta(minutes=rng.randrange(3000)), float(i)) for i in range(300)]
    events.sort(key=lambda e: e[2])
    source = str(tmp_path / "in")
    for n in range(3):  # three files in order of time, a batch each
        spark.createDataFrame(events[100 * n : 100 * n + 100], "event_id long, user_id int, ts timestamp, value double").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = queue.drained(sessions.sessions(stream, "30 minutes", "3000 minutes"), str(tmp_path / "out"))
    whole = sessions.sessions(spark.read.parquet(source), "30 minutes", "0 minutes")
    latest = max(e[2] for e in events)
    done = {tuple(r) for r in whole.collect() if r["ended"] <= latest - timedelta(minutes=3000)}
    assert {tuple(r) for r in got.collect()} == done
    wanted = {}
    for _, user, ts, value in events:
        runs = wanted.setdefault(user, [])
        if runs and ts - runs[-1][-1][0] <= timedelta(minutes=30):
            runs[-1].append((ts, value))
        else:
            runs.append([(ts, value)])
    assert {tuple(r) for r in whole.collect()} == {
        (u, r[0][0], r[-1][0] + timedelta(minutes=30), len(r), sum(v for _, v in r)) for u, runs in wanted.items() for r in runs
    }
