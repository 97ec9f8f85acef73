"""A folder of files looked at again and again."""

import os

from skein.sources import folder


def test_new_changed_skipped_and_gone_files(spark, tmp_path):
    at, root = tmp_path / "files", str(tmp_path / "looks")
    (at / "deep").mkdir(parents=True)
    now = [1_700_000_000]

    def put(name, text, same_time=False):
        path = at / name
        was = path.stat().st_mtime if path.exists() else None
        path.write_text(text)
        now[0] += 10
        os.utime(path, (was, was) if same_time else (now[0], now[0]))

    def look():
        return {r.path.rsplit("/", 1)[1]: r.status for r in folder.refreshed(spark, str(at), root, "*.md").collect()}

    assert look() == {}
    for name in ("a.md", "deep/b.md", "c.md", "skip.txt"):
        put(name, f"text of {name}")
    assert look() == dict.fromkeys(["a.md", "b.md", "c.md"], "new")
    assert look() == dict.fromkeys(["a.md", "b.md", "c.md"], "header")
    put("a.md", "text of a.md")  # another time, the same text
    put("deep/b.md", "changed")
    put("c.md", "not seen", same_time=True)  # the header says that nothing has changed
    put("d.md", "text")
    put("empty.md", "")  # Spark's scans pass over empty files
    assert look() == {"a.md": "hash", "b.md": "changed", "c.md": "header", "d.md": "new"}
    (at / "deep" / "b.md").unlink()
    assert look() == {"a.md": "header", "b.md": "gone", "c.md": "header", "d.md": "header"}
    put("deep/b.md", "changed")
    assert look() == {"a.md": "header", "b.md": "new", "c.md": "header", "d.md": "header"}


def test_a_key_stands_for_its_newest_file(spark, tmp_path):
    from pyspark.sql import functions as F

    at, root = tmp_path / "files", str(tmp_path / "looks")
    at.mkdir()
    key = F.regexp_extract("path", "/([0-9]+)-[^/]*$", 1)
    look = lambda: {(r.key, r.path[-6:]): r.status for r in folder.refreshed(spark, str(at), root, key=F.nullif(key, F.lit(""))).collect()}
    for i, (name, text) in enumerate([("1-a.md", "x"), ("1-b.md", "y"), ("no.md", "z")]):
        (at / name).write_text(text)
        os.utime(at / name, (1_700_000_000 + i, 1_700_000_000 + i))
    assert look() == {("1", "1-b.md"): "new"}
    (at / "1-c.md").write_text("y")
    assert look() == {("1", "1-c.md"): "hash"}


def test_listing_takes_few_tasks(spark, tmp_path, monkeypatch):
    """A folder of many folders was listed by a task for each, and a first look listed it twice; the session's setting stays."""
    from skein.sources import jsonl

    at, name = tmp_path / "files", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    for i in range(100):
        (at / str(i)).mkdir(parents=True)
        (at / str(i) / "a.md").write_text(str(i))
    group, listed, scan, before = "listing", [], jsonl.binary_files, spark.conf.get(name)
    monkeypatch.setattr(jsonl, "binary_files", lambda *a: listed.append(1) or scan(*a))
    spark.sparkContext.setJobGroup(group, group)
    try:
        look = folder.refreshed(spark, str(at), str(tmp_path / "looks"), "*.md")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(stage).numTasks for job in tracker.getJobIdsForGroup(group) for stage in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(stage)]
    assert look.where("status = 'new'").count() == 100 and len(listed) == 1
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism and spark.conf.get(name) == before
