"""Streams that come in parts: keyed state, timers, both sides of a join, restarts, late and repeated rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import incremental, memory
from skein.streaming import streams

SPAN = "trace_id long, node_id long, phase string, at timestamp, status string, error string"
START = datetime(2024, 1, 1)


def minute(n):
    return START + timedelta(minutes=n)


class Parts:
    """A folder to which files are added, and the stream's own folder."""

    def __init__(self, spark, folder, kind):
        self.spark, self.path, self.root, self.kind = spark, str(folder / "in"), str(folder / "root"), kind

    def add(self, rows):
        self.spark.createDataFrame(rows, self.kind).coalesce(1).write.mode("append").parquet(self.path)
        return self

    def spans(self, **kw):
        found = streams.span_stream(self.spark, self.path, lambda df: df, root=self.root, **kw)
        return {(r.trace_id, r.node_id): (r.status, r.start_time, r.end_time, r.error) for r in found.collect()}

    def changes(self):
        numbers = streams.ChangeTable(self.spark, self.root, None).numbers("changes")
        return [self.spark.read.parquet(f"{self.root}/changes/{n}").count() for n in numbers]


def test_spans_fail_by_timer_and_end_late(spark, tmp_path):
    """A span without a finish fails once the watermark has passed its timeout; a finish that comes after that still ends it."""
    p = Parts(spark, tmp_path, SPAN)
    wait = {"timeout": timedelta(minutes=30), "late": timedelta(minutes=10)}
    p.add([(1, 1, "start", minute(0), None, None), (1, 2, "start", minute(5), None, None), (2, 1, "start", minute(39), None, None)])
    assert {k: v[0] for k, v in p.spans(**wait).items()} == {(1, 1): "RUNNING", (1, 2): "RUNNING", (2, 1): "RUNNING"}
    p.add([(1, 2, "finish", minute(40), "SUCCESS", None), (3, 1, "start", minute(41), None, None)])
    got = p.spans(**wait)
    assert {k: v[0] for k, v in got.items()} == {(1, 1): "FAILED", (1, 2): "SUCCESS", (2, 1): "RUNNING", (3, 1): "RUNNING"}
    assert got[1, 1][1:3] == (minute(0), None)
    p.add([(1, 1, "finish", minute(42), "ERROR", "x" * 9)])
    assert p.spans(error_chars=4, **wait)[1, 1] == ("ERROR", minute(0), minute(42), "xxxx")


def test_timeouts_equal_the_batch_twin(spark, tmp_path):
    r = random.Random(2)
    rows = []
    for span in range(120):
        at = r.randrange(300)
        rows += [(span % 7, span, "start", minute(at), None, None)] * r.choice([0, 1, 1, 1, 2])
        rows += [(span % 7, span, "finish", minute(at + r.randrange(40)), r.choice(["SUCCESS", "ERROR"]), r.choice([None, "late"])) for _ in range(r.choice([0, 1, 1, 2]))]
    rows.sort(key=lambda x: x[3])
    p = Parts(spark, tmp_path, SPAN)
    for at in range(0, len(rows), 40):
        p.add(rows[at : at + 40])
        got = p.spans(timeout=timedelta(minutes=20), late=timedelta(minutes=10))
    whole = incremental.spans(spark.createDataFrame(rows, SPAN)).withColumn("update_time", F.col("start_time"))
    watermark = max(x[3] for x in rows) - timedelta(minutes=10)
    want = incremental.stuck(whole, F.lit(watermark), 20).collect()
    assert got == {(x.trace_id, x.node_id): (x.status, x.start_time, x.end_time, x.error) for x in want}


def test_only_changed_spans_are_written(spark, tmp_path):
    p = Parts(spark, tmp_path, SPAN)
    p.add([(1, n, "start", minute(n), None, None) for n in range(50)])
    p.spans()
    p.add([(1, 3, "finish", minute(60), "SUCCESS", None)] * 2 + [(1, 4, "start", minute(4), None, None)])
    got = p.spans()
    assert p.changes() == [50, 1] and len(got) == 50 and got[1, 3][0] == "SUCCESS"
    assert p.spans() == got and p.changes() == [50, 1]  # nothing new came


def test_ties_and_order_of_events_do_not_matter(spark, tmp_path):
    rows = [(1, 1, "finish", minute(9), "SUCCESS", "b"), (1, 1, "finish", minute(9), "ERROR", "c"), (1, 1, "start", minute(4), None, None), (1, 1, "start", minute(2), None, None)]
    want = [tuple(x) for x in incremental.spans(spark.createDataFrame(rows, SPAN)).select("status", "start_time", "end_time", "error").collect()]
    for i, order in enumerate([rows, rows[::-1], rows[2:] + rows[:2]]):
        p = Parts(spark, tmp_path / str(i), SPAN)
        for row in order:
            p.add([row])
        assert [p.spans()[1, 1]] == want


def test_events_behind_the_watermark_are_dropped(spark, tmp_path):
    p = Parts(spark, tmp_path, SPAN)
    wait = {"timeout": timedelta(minutes=30), "late": timedelta(minutes=10)}
    p.add([(1, 1, "start", minute(100), None, None)])
    p.spans(**wait)
    p.add([(2, 2, "start", minute(80), None, None), (3, 3, "start", minute(95), None, None)])
    assert set(p.spans(**wait)) == {(1, 1), (3, 3)}


def test_timeouts_hold_to_the_microsecond(spark, tmp_path):
    p = Parts(spark, tmp_path, SPAN)
    at = lambda n, us: minute(n) + timedelta(microseconds=us)
    p.add([(1, n, "start", at(0, us), None, None) for n, us in ((1, 399), (2, 400), (3, 401))] + [(2, 1, "start", at(40, 400), None, None)])
    got = p.spans(timeout=timedelta(minutes=30), late=timedelta(minutes=10))
    assert {k: v[0] for k, v in got.items()} == {(1, 1): "FAILED", (1, 2): "RUNNING", (1, 3): "RUNNING", (2, 1): "RUNNING"}


@pytest.mark.parametrize("wait", [None, timedelta(minutes=30)])
def test_spans_need_no_python_for_each_key(spark, tmp_path, monkeypatch, wait):
    """Calls of Python for each span took 0.1 ms and more of every core's time."""
    plans, run = [], streams.run_to_end
    monkeypatch.setattr(streams, "run_to_end", lambda stream, *a, **b: plans.append(stream._jdf.queryExecution().analyzed().toString()) or run(stream, *a, **b))
    p = Parts(spark, tmp_path, SPAN)
    p.add([(1, 1, "start", minute(0), None, None), (1, 1, "start", minute(0), None, None), (1, 1, "finish", minute(1), "SUCCESS", None)])
    assert p.spans(timeout=wait) == {(1, 1): ("SUCCESS", minute(0), minute(1), None)} == p.spans(timeout=wait)
    assert plans and not any(x in plan for plan in plans for x in ("TransformWithState", "Python", "Pandas"))


VOTE = "message_id long, user_id long, vote int, submit_time timestamp, event_id long"
SAID = "message_id long, user_id long, role string, create_time timestamp"


class Votes:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)

    def add(self, votes=(), said=()):
        for name, rows, kind in (("votes", votes, VOTE), ("said", said, SAID)):
            self.spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")
        return self

    def latest(self):
        read = lambda name: streams.file_stream(self.spark, f"{self.folder}/{name}", 100)
        found = streams.owned_votes(read("votes"), read("said"), wait="1 hour", late="30 minutes", root=f"{self.folder}/root")
        return {(r.message_id, r.user_id): r.vote for r in found.collect()}


def test_votes_before_and_after_their_messages(spark, tmp_path):
    v = Votes(spark, tmp_path)
    v.add(votes=[(1, 9, 1, minute(0), 1), (2, 9, 1, minute(1), 2)])
    assert v.latest() == {}
    v.add(said=[(1, 9, "assistant", minute(2)), (3, 9, "assistant", minute(2)), (2, 8, "assistant", minute(2))])
    assert v.latest() == {(1, 9): 1}
    v.add(votes=[(3, 9, -1, minute(3), 3), (1, 9, -1, minute(0), 4), (3, 9, 0, minute(9), 5)])
    assert v.latest() == {(1, 9): 1, (3, 9): -1}  # of equal times the first stays
    v.add(votes=[(1, 9, -1, minute(5), 6), (1, 9, 1, minute(4), 7)], said=[(4, 9, "user", minute(3))])
    assert v.latest() == {(1, 9): -1, (3, 9): -1}


def test_a_vote_waits_no_longer_than_its_message_can_come(spark, tmp_path):
    v = Votes(spark, tmp_path)
    v.add(votes=[(1, 9, 1, minute(0), 1), (5, 9, 1, minute(1), 2)], said=[(7, 9, "assistant", minute(0))])
    v.latest()
    v.add(votes=[(7, 9, 1, minute(200), 3)], said=[(8, 9, "assistant", minute(200))])
    v.latest()
    v.add(said=[(1, 9, "assistant", minute(0)), (9, 9, "assistant", minute(199))], votes=[(9, 9, 1, minute(200), 4)])
    assert v.latest() == {(9, 9): 1}  # the first message came behind the watermark, message 7's vote too long after it


def test_votes_equal_the_batch_twin(spark, tmp_path):
    r = random.Random(4)
    said = [(m, m % 5, r.choice(["assistant", "assistant", "user"]), minute(r.randrange(20))) for m in range(60)]
    votes = [(m, r.choice([m % 5, 3]), r.choice([-1, 0, 1]), minute(r.randrange(20)), e) for e, m in enumerate(r.choices(range(70), k=300))]
    v = Votes(spark, tmp_path)
    for i in range(3):
        v.add(votes[i::3], said[i::3])
        got = v.latest()
    want = memory.latest_votes(spark.createDataFrame(votes, VOTE), spark.createDataFrame(said, SAID)).collect()
    assert got == {(x.message_id, x.user_id): x.vote for x in want}


def test_late_rows_of_closed_hours_are_counted(spark, tmp_path):
    p = Parts(spark, tmp_path, "ts timestamp_ntz, value double")
    late = []
    run = lambda: {r.hour: r.n for r in streams.hourly_counts(spark, p.path, "1 hour", p.root, late.append).collect()}
    p.add([(minute(5), 1.0), (minute(50), 1.0), (minute(70), 2.0)])
    assert run() == {minute(0): 2, minute(60): 1}
    p.add([(minute(55), 1.0), (minute(600), 1.0)])
    assert run() == {minute(0): 3, minute(60): 1, minute(600): 1} and late == [0, 0]
    p.add([(minute(59), 1.0), (minute(610), 1.0)])
    assert run() == {minute(0): 3, minute(60): 1, minute(600): 2} and late == [0, 0, 1]


@pytest.mark.parametrize("every", [1, 2, 50])
def test_change_table_folds_and_repeats(spark, tmp_path, every):
    """A batch that comes again, or whose fold broke off, leaves the same table."""
    kind = "k long, n long"
    table = streams.ChangeTable(spark, str(tmp_path / "t"), lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), every)
    empty = spark.createDataFrame([], kind)
    assert table.read(empty).count() == 0
    for batch in range(6):
        rows = spark.createDataFrame([(batch % 3, 1), (7, 1)], kind)
        table.step(rows, batch)
        if batch == 3:
            table.step(rows, batch)
    (tmp_path / "t" / "folded" / "9").mkdir(parents=True)  # a fold that broke off
    assert {r.k: r.n for r in table.read(empty).collect()} == {0: 2, 1: 2, 2: 2, 7: 6}
    assert len(table.numbers("folded")) <= 2 and (every == 50 or len(table.numbers("changes")) <= 2 * every)
