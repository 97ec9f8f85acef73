"""Distinct users of windows from stored states against counting them."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skein.operators import distinct, metrics
from skein.streaming import streams

START = datetime(2024, 1, 1)
KIND = "user_id long, create_time timestamp_ntz"


def rows_of(seed, n):
    r = random.Random(seed)
    ids = [0, 1, -1, -40_000, 32_768, 32_769, 5_000_000_000, None] + [r.randrange(-100_000, 100_000) for _ in range(60)]
    return [(r.choice(ids), None if r.random() < 0.02 else START + timedelta(seconds=r.randrange(5 * 86_400))) for _ in range(n)]


def users(rows, a, b):
    return len({u for u, t in rows if u is not None and t is not None and a <= t < b})


def test_any_window_is_a_union_of_states(spark):
    rows = rows_of(1, 2000)
    df = spark.createDataFrame(rows, KIND)
    states = distinct.hourly(df, "create_time")
    r = random.Random(2)
    spans = {}
    for i in range(12):
        a = START + timedelta(seconds=r.randrange(5 * 86_400))
        spans[f"w{i}"] = (a, a + timedelta(seconds=r.choice([60, 1800, 3600, 90_000, 300_000])))
    spans["hours"] = (START + timedelta(hours=3), START + timedelta(hours=30))
    spans["none"] = (START - timedelta(days=9), START - timedelta(days=8))
    asked = {k: (F.lit(str(a)).cast("timestamp_ntz"), F.lit(str(b)).cast("timestamp_ntz")) for k, (a, b) in spans.items()}
    assert distinct.active(states, df, "create_time", asked).first().asDict() == {k: users(rows, a, b) for k, (a, b) in spans.items()}


def test_states_of_parts_merge(spark):
    rows = rows_of(3, 900)
    part = lambda x: distinct.hourly(spark.createDataFrame(x, KIND), "create_time")
    whole, pieces = part(rows), distinct.merged(part(rows[:300]).unionByName(part(rows[300:])))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pieces.select(*whole.columns).collect()))
    assert distinct.counted(whole).first().users == len({u for u, t in rows if u is not None and t is not None})
    assert distinct.counted(part([])).collect()[0].users == 0


def test_a_stream_takes_late_rows_in(spark, tmp_path):
    path, rows = str(tmp_path / "in"), sorted(rows_of(4, 600), key=lambda x: (x[1] is None, x[1]))
    for part in (rows[300:], rows[:200], rows[200:300]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(path)
        states = streams.active_states(spark, path, lambda df: df, str(tmp_path / "root"))
    got = {r.bucket: r.n for r in metrics.active_trend(states, "2024-01-06 00:00:00", 120, "day").collect()}
    day = lambda i: START + timedelta(days=i)
    assert got == {day(i): users(rows, day(i), day(i + 1)) for i in range(6)}
