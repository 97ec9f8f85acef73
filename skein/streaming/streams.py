"""Structured Streaming jobs; each ends with the same rows as its batch twin over the same files, as far as no rows come later than its watermark, if it has one.

With a `root` of its own a job can be stopped and run again: progress and state lie there. Without one it starts anew in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import distinct, memory
from skein.sources.snapshots import shared_folder


def file_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A Parquet file or folder as a stream, `per_trigger` files at a time."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    # A stream reads folders: a single file is picked from its folder by name.
    single = not spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).where(F.col("path").endswith(f"/{name}")).select("path").isEmpty()
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


def run_to_end(stream: DataFrame, step: Callable[[DataFrame, int], None], root: str, mode: str = "append") -> int:
    """Drive a stream over all available input, batch by batch; its progress is kept under `root`, so a later run goes on where this one ended.

    Returns how many rows the stream's stateful operators have dropped for being later than the watermark.
    """
    spark = stream.sparkSession
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    # Keyed state lies in RocksDB on the executors, with its changes in the shared folder; heaps do not hold it.
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        started = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    started.awaitTermination()
    return sum(o["numRowsDroppedByWatermark"] for p in started.recentProgress for o in p["stateOperators"])


class ChangeTable:
    """A table under `root` to which every batch adds what it changes; `fold` makes the table of all changes.

    The changes of batch n are the folder `changes/n`, so a repeated batch writes the same folder again. Every `fold_every` batches all are folded into
    `folded/n`; readers take the newest whole fold and the changes after it. Only touched rows are written by a batch; the rest is
    written once in so many batches. Folds older than the last two go, and the changes they hold.
    """

    def __init__(self, spark: SparkSession, root: str, fold: Callable[[DataFrame], DataFrame], fold_every: int = 50):
        self.spark, self.root, self.fold, self.fold_every = spark, root, fold, fold_every

    def _path(self, name: str):  # noqa: ANN202
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def numbers(self, kind: str) -> list[int]:
        """Of the whole folders of a kind: their batches."""
        fs, where = self._path(kind)
        found = [f.getPath() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(p.getName()) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _rows(self, schema: T.StructType) -> DataFrame | None:
        folds = self.numbers("folded")
        since = folds[-1] if folds else -1
        paths = [f"{self.root}/folded/{n}" for n in folds[-1:]] + [f"{self.root}/changes/{n}" for n in self.numbers("changes") if n > since]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def step(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/changes/{batch}")
        folds = self.numbers("folded")
        if batch - (folds[-1] if folds else -1) < self.fold_every:
            return
        self.fold(self._rows(rows.schema)).write.mode("overwrite").parquet(f"{self.root}/folded/{batch}")
        gone = [("folded", n) for n in folds[:-1]] + [("changes", n) for n in self.numbers("changes") if folds and n <= folds[-1]]
        for kind, n in gone:
            fs, where = self._path(f"{kind}/{n}")
            fs.delete(where, True)

    def newest(self, column: str, schema: T.StructType):  # noqa: ANN201
        """The greatest value of a column in all changes."""
        rows = self._rows(schema)
        return None if rows is None else rows.agg(F.max(column)).first()[0]

    def read(self, empty: DataFrame) -> DataFrame:
        rows = self._rows(empty.schema)
        return empty if rows is None else self.fold(rows)


def _root(spark: SparkSession, root: str | None) -> str:
    """The given folder, or one of its own that goes when the application ends."""
    if root:
        return root
    made = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(made)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return made


VOTE = "message_id long, user_id long, vote int, submit_time timestamp_ntz, event_id long"


def _latest_vote(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("message_id", "user_id").orderBy(F.desc("submit_time"), "event_id")
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def feedback_stream(spark: SparkSession, path: str, messages: DataFrame, root: str | None = None) -> DataFrame:
    """Latest vote per message and user, strictly later votes replacing earlier ones, from an event stream; `messages` as in latest_votes."""
    events = file_stream(spark, path).where(F.col("event_type").isin("purchase", "error"))
    votes = events.select((F.col("event_id") % 50).alias("message_id"), "user_id", F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("vote"), F.col("ts").alias("submit_time"), "event_id")
    on = [c for c in ("message_id", "user_id") if c in messages.columns]
    valid = messages.where("role = 'assistant'").select(*on).distinct()
    root = _root(spark, root)
    state = ChangeTable(spark, root, _latest_vote)
    run_to_end(votes, lambda rows, n: state.step(rows.join(valid, on, "left_semi"), n), root)
    return state.read(spark.createDataFrame([], VOTE)).select("message_id", "user_id", "vote", "submit_time")


def owned_votes(votes: DataFrame, messages: DataFrame, wait: str = "2 hours", late: str = "1 hour", root: str | None = None) -> DataFrame:
    """Latest vote per message from two streams: votes (message_id, user_id, vote, submit_time, event_id) and messages (message_id, user_id, role, create_time).

    A vote of 1 or -1 counts if its message is an assistant's and the voter's own; either may come first. Each side waits in keyed state for the other as long as their
    times can lie within `wait` of each other, then it goes; rows later than `late` behind the newest are dropped. With those limits kept, the rows are those of latest_votes.
    """
    spark = votes.sparkSession
    said = messages.where("role = 'assistant'").select(F.col("message_id").alias("_message"), F.col("user_id").alias("_user"), F.col("create_time").cast("timestamp").alias("_said")).withWatermark("_said", late)
    cast = votes.where(F.col("vote").isin(1, -1)).select("message_id", "user_id", "vote", "submit_time", "event_id", F.col("submit_time").cast("timestamp").alias("_cast")).withWatermark("_cast", late)
    near = F.expr(f"_cast >= _said - INTERVAL {wait} AND _cast <= _said + INTERVAL {wait}")
    met = cast.join(said, (F.col("message_id") == F.col("_message")) & (F.col("user_id") == F.col("_user")) & near)
    root = _root(spark, root)
    state = ChangeTable(spark, root, _latest_vote)
    columns = [f.name for f in T._parse_datatype_string(VOTE)]
    run_to_end(met.select(*columns), lambda rows, n: state.step(_latest_vote(rows), n), root)
    return state.read(spark.createDataFrame([], met.select(*columns).schema)).select("message_id", "user_id", "vote", "submit_time")


def hourly_counts(spark: SparkSession, path: str, late: str = "1 hour", root: str | None = None, on_late: Callable[[int], None] | None = None) -> DataFrame:
    """Tumbling-hour counts and sums with a watermark: each batch adds the windows it changes.

    A window is closed once an event more than `late` after its end has come. Rows of closed windows are dropped, so only without such rows do the counts equal those of the
    whole table; how many groups of rows (of a window and task) were dropped goes to `on_late`.
    """
    events = file_stream(spark, path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counted = events.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "n", "total")
    root = _root(spark, root)
    state = ChangeTable(spark, root, lambda df: df.groupBy("hour").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total")))
    dropped = run_to_end(counted, state.step, root, mode="update")
    if on_late:
        on_late(dropped)
    return state.read(spark.createDataFrame([], "hour timestamp, n long, total double"))


def active_states(spark: SparkSession, path: str, messages: Callable[[DataFrame], DataFrame], root: str | None = None) -> DataFrame:
    """States of distinct users by hour from a message stream: each batch adds its own, and however late a row comes, its hour's state takes it in."""
    root = _root(spark, root)
    said = messages(file_stream(spark, path)).select("user_id", "create_time")
    state = ChangeTable(spark, root, distinct.merged)
    run_to_end(said, lambda rows, n: state.step(distinct.hourly(rows, "create_time"), n), root)
    return state.read(distinct.hourly(messages(spark.read.parquet(path).limit(0)), "create_time"))


def document_stream(spark: SparkSession, path: str, chunk: Callable[[DataFrame], DataFrame], root: str | None = None) -> DataFrame:
    """Chunk documents as they arrive; a document that comes again replaces its chunks."""
    docs = file_stream(spark, path).select("doc_id", "text")
    newest = F.max("_batch").over(Window.partitionBy("doc_id"))
    root = _root(spark, root)
    state = ChangeTable(spark, root, lambda df: df.withColumn("_new", newest).where("_batch = _new").drop("_new"))
    run_to_end(docs, lambda rows, n: state.step(chunk(rows.dropDuplicates(["doc_id"])).withColumn("_batch", F.lit(n)), n), root)
    empty = chunk(spark.createDataFrame([], "doc_id long, text string")).withColumn("_batch", F.lit(0))
    return state.read(empty).drop("_batch")


def rollup_stream(spark: SparkSession, path: str, messages: Callable[[DataFrame], DataFrame], key: tuple[str, ...] = ("conv_id",), root: str | None = None) -> DataFrame:
    """The roll-up of conversations from a message stream: a batch's first, last and number of user messages go into the conversation's row."""
    said = messages(file_stream(spark, path))
    root = _root(spark, root)
    state = ChangeTable(spark, root, lambda df: df.groupBy(*key).agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("user_turns").alias("user_turns")))
    run_to_end(said, lambda rows, n: state.step(memory.rollup(rows, key), n), root)
    return state.read(memory.rollup(messages(spark.read.parquet(path).limit(0)), key))


def _whole(column: Column, kind: T.DataType) -> Column:
    """A time as a number that orders alike: microseconds for time stamps."""
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column)
    return F.unix_micros(column) if isinstance(kind, T.TimestampType) else column.cast("long")


def _timed(column: Column, kind: T.DataType) -> Column:
    """The time that `_whole` gave the number of."""
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_add("MICROSECOND", column, F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.timestamp_micros(column) if isinstance(kind, T.TimestampType) else column.cast(kind)


SPAN = ("trace_id", "node_id")


def _folded(parts: DataFrame) -> DataFrame:
    """What parts of spans, or single events, say of each span; however they are put together, the result is one."""
    return parts.groupBy(*SPAN).agg(F.min("start").alias("start"), *[F.max(c).alias(c) for c in ("end", "error", "status", "newest")])


def _changed(parts: DataFrame) -> DataFrame:
    """From a stream of events: each span that a batch changes, as all its events so far say, one row per span being kept in state.

    A value is kept with the time of the batch that first brought it, so a span has changed if one of its times is that of the batch.
    """
    clock, now = F.unix_micros(F.current_timestamp()), F.col("_now")
    at = lambda c, since: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value"), since.alias("since")))
    least, most = ("start",), ("end", "error", "status")
    held = parts.withColumn("_now", clock).groupBy(*SPAN).agg(F.min(now).alias("_first"), *[F.min(at(c, now)).alias(c) for c in least], *[F.max(at(c, -now)).alias(c) for c in most])
    last = F.greatest("_first", *[F.col(f"{c}.since") for c in least], *[-F.col(f"{c}.since") for c in most])
    return held.where(last == clock).select(*SPAN, *[F.col(f"{c}.value").alias(c) for c in least + most], F.lit(None).cast("long").alias("newest"))


def span_stream(spark: SparkSession, path: str, events: Callable[[DataFrame], DataFrame], error_chars: int = 1000, root: str | None = None, timeout: timedelta | None = None, late: timedelta = timedelta(minutes=10)) -> DataFrame:
    """Spans folded from a stream of start and finish events, in whatever order they come; one without a finish yet is RUNNING.

    Each span is a row of keyed state, and a batch writes only the spans that it changes: a repeated event writes nothing. With a `timeout` (ten minutes at least), events need a
    time stamp; a span that started more than `timeout` before the watermark, which is `late` behind the newest event, and has not ended is FAILED until a finish comes. Events behind the watermark
    are dropped, and state holds the events after it, to know repeated ones. The rows are those of spans(), and with a timeout of spans() and stuck() at the watermark.
    """
    log = events(file_stream(spark, path))
    kind = log.schema["at"].dataType
    at, finish = _whole(F.col("at"), kind), F.col("phase") == "finish"
    parts = log.select(
        *SPAN, F.when(F.col("phase") == "start", at).alias("start"), F.when(finish, at).alias("end"), F.when(finish, F.substring("error", 1, error_chars)).alias("error"),
        F.when(finish, F.col("status")).alias("status"), (at if timeout is not None else F.lit(None).cast("long")).alias("newest"),
    )
    root = _root(spark, root)
    state = ChangeTable(spark, root, _folded)
    failed = F.lit(False)
    if timeout is None:
        run_to_end(_changed(parts), state.step, root, mode="update")
    else:
        fresh = parts.withColumn("_at", F.timestamp_micros("newest")).withWatermark("_at", f"{int(late.total_seconds() * 1000)} milliseconds").dropDuplicates()
        run_to_end(fresh.drop("_at"), lambda rows, n: state.step(_folded(rows), n), root)
        newest = state.newest("newest", parts.schema)
        if newest is not None:
            failed = F.col("start") < newest - (late + max(timeout, timedelta(minutes=10))) // timedelta(microseconds=1)
    status = F.coalesce("status", F.when(failed, "FAILED").otherwise("RUNNING"))
    found = state.read(spark.createDataFrame([], parts.schema))
    return found.select(*SPAN, _timed(F.col("start"), kind).alias("start_time"), _timed(F.col("end"), kind).alias("end_time"), "error", status.alias("status"))
