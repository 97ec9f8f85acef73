"""Operational metrics over trace runs, trace nodes, messages and sessions; "now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import distinct


def one_digit(x: Column) -> Column:
    """Rounded to one digit, halves towards positive infinity."""
    return F.floor(x * 10 + 0.5) / 10


def _window(at: str, start: Column, end: Column) -> Column:
    return (F.col(at) >= start) & (F.col(at) < end)


def bounds(now: str, hours: int) -> tuple[Column, Column, Column]:
    """Start of the window before, start and end of the current window, as literals without time zone."""
    end = F.to_timestamp_ntz(F.lit(now))
    back = lambda k: end - F.expr(f"INTERVAL {k * hours} HOURS")
    return back(2), back(1), end


def overview(frames: dict[str, DataFrame], now: str, hours: int, at: str = "create_time", states: DataFrame | None = None) -> DataFrame:
    """kpi, value, previous, delta and pct (null if the previous is not positive) for sessions, messages and active users.

    With `states` (of distinct.hourly over the messages) active users are counted from them.
    """
    before, start, end = bounds(now, hours)
    cur, prev = _window(at, start, end), _window(at, before, start)

    def row(name: str, df: DataFrame, value: Column, previous: Column) -> DataFrame:
        return df.agg(value.alias("value"), previous.alias("previous")).select(F.lit(name).alias("kpi"), "value", "previous")

    users = frames["messages"]
    rows = [row(n, df, F.count_if(cur), F.count_if(prev)) for n, df in frames.items()]
    if states is None:
        rows.append(row("active_users", users, F.count_distinct(F.when(cur, F.col("user_id"))), F.count_distinct(F.when(prev, F.col("user_id")))))
    else:
        both = distinct.active(states, users, at, {"value": (start, end), "previous": (before, start)})
        rows.append(both.select(F.lit("active_users").alias("kpi"), "value", "previous"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    delta = F.col("value") - F.col("previous")
    return out.withColumn("delta", delta).withColumn("pct", F.when(F.col("previous") > 0, one_digit(delta * 100.0 / F.col("previous"))))


def nearest_rank(rows: DataFrame, value: Column, share: float) -> DataFrame:
    """One row with `p`, the smallest value that at least `share` of the values do not exceed, nulls and not-a-numbers left out; null without values.

    Equal values are counted first, so that only distinct values are ordered, by a running sum over ranges of them.
    """
    counts = rows.where(value.isNotNull() & ~F.isnan(value.cast("double"))).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    size = F.floor(F.log2(F.abs(F.col("v").cast("double")) + 1) * 64).cast("int")
    part = F.when(F.col("v") < 0, -size).otherwise(size)  # ranges of values in their order, by sign and magnitude: a few thousand at most
    parts = counts.groupBy(part.alias("part")).agg(F.sum("n").alias("m"))
    order = Window.orderBy("part")
    placed = parts.withColumn("upto", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    here = placed.where(F.col("upto") >= F.ceil(F.col("all") * share)).orderBy("part").limit(1).select("part", (F.col("upto") - F.col("m")).alias("before"), F.ceil(F.col("all") * share).alias("rank"))
    inside = counts.withColumn("part", part).join(F.broadcast(here), "part")
    reached = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("reached", reached).where("reached >= rank").agg(F.min("v").alias("p"))


def performance(runs: DataFrame, messages: DataFrame, now: str, hours: int, slow_ms: int = 20_000) -> DataFrame:
    """Latency, success, error, slow and no-document figures of the window; running rows don't count in rates."""
    _, start, end = bounds(now, hours)
    ok = (F.col("status") == "SUCCESS") & (F.col("duration_ms") > 0)
    timed = F.when(ok, F.col("duration_ms"))
    done = F.count_if(F.col("status").isin("SUCCESS", "ERROR"))
    share = lambda part, whole: F.when(whole == 0, 0.0).otherwise(one_digit(part * 100.0 / whole))
    from_runs = runs.where(_window("start_time", start, end)).agg(
        F.coalesce(F.floor(F.avg(timed) + 0.5), F.lit(0)).cast("long").alias("avg_ms"),
        share(F.count_if(F.col("status") == "SUCCESS"), done).alias("success_rate"), share(F.count_if(F.col("status") == "ERROR"), done).alias("error_rate"),
        share(F.count_if(ok & (F.col("duration_ms") > slow_ms)), F.count_if(ok)).alias("slow_rate"),
    )
    answers = F.count_if(F.col("role") == "assistant")
    from_messages = messages.where(_window("create_time", start, end)).agg(share(F.sum("no_doc"), answers).alias("no_doc_rate"))
    p95 = nearest_rank(runs.where(_window("start_time", start, end)), timed, 0.95).select(F.coalesce("p", F.lit(0)).cast("long").alias("p95_ms"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(from_runs).join(one(p95), "_k").join(one(from_messages), "_k").drop("_k")  # three tables of one row


def spine(now: str, hours: int, unit: str) -> Column:
    """Every bucket of the window: hours up to the current one, or days from the start date to today."""
    end = F.date_trunc(unit, F.to_timestamp(F.lit(now)))
    if unit == "hour":
        return F.sequence(end - F.expr(f"INTERVAL {max(1, hours) - 1} HOURS"), end, F.expr("INTERVAL 1 HOUR"))
    return F.sequence(F.date_trunc("day", F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {hours} HOURS")), end, F.expr("INTERVAL 1 DAY"))


def trend(rows: DataFrame, at: str, now: str, hours: int, unit: str, values: dict[str, Column]) -> DataFrame:
    """bucket and aggregates per hour or day; buckets without rows are 0."""
    spark = rows.sparkSession
    buckets = spark.range(1).select(F.explode(spine(now, hours, unit)).alias("bucket"))
    counted = rows.groupBy(F.date_trunc(unit, F.col(at)).cast("timestamp").alias("bucket")).agg(*[v.alias(k) for k, v in values.items()])
    return buckets.join(counted, "bucket", "left").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), *[F.coalesce(k, F.lit(0)).alias(k) for k in values])


def active_trend(states: DataFrame, now: str, hours: int, unit: str) -> DataFrame:
    """bucket and n, the distinct users per hour or day, from states of distinct.hourly; buckets without users are 0."""
    buckets = states.sparkSession.range(1).select(F.explode(spine(now, hours, unit)).alias("bucket"))
    found = distinct.counted(states, F.date_trunc(unit, "hour").cast("timestamp")).withColumnRenamed("_k0", "bucket")
    return buckets.join(found, "bucket", "left").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.coalesce("users", F.lit(0)).cast("long").alias("n"))


def trace_stats(runs: DataFrame) -> DataFrame:
    timed = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    return runs.agg(
        F.count_if(F.col("status") == "SUCCESS").alias("success"), F.count_if(F.col("status").isin("ERROR", "FAILED")).alias("failed"), F.count_if(F.col("status") == "RUNNING").alias("running"),
        F.floor(F.avg(timed) + 0.5).cast("long").alias("avg_ms"), one_digit(F.count_if(F.col("status") == "SUCCESS") * 100.0 / F.count(F.lit(1))).alias("success_pct"), F.lit(1).alias("_k"),
    ).join(nearest_rank(runs, timed, 0.95).select(F.col("p").cast("long").alias("p95_ms"), F.lit(1).alias("_k")), "_k").drop("_k")


def node_stats(nodes: DataFrame) -> DataFrame:
    """Per trace: counts by status, mean duration and the slowest node (of equal ones the smaller id)."""
    return nodes.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ERROR").alias("failed"), F.count_if(F.col("status") == "SUCCESS").alias("success"), F.count_if(F.col("status") == "RUNNING").alias("running"),
        F.round(F.avg("duration_ms"), 4).alias("avg_ms"), F.max_by("node_id", F.struct("duration_ms", -F.col("node_id"))).alias("slowest"),
    )


def waterfall(nodes: DataFrame) -> DataFrame:
    """Offset, left and width in percent of each node within its trace's span."""
    whole = Window.partitionBy("trace_id")
    ms = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', {c})") / 1000.0
    timed = nodes.withColumn("_at", ms("start_time")).withColumn("_first", F.min("_at").over(whole)).withColumn("_span", F.greatest(F.max(F.col("_at") + F.col("duration_ms")).over(whole) - F.col("_first"), F.lit(1.0)))
    placed = timed.withColumn("offset_ms", F.floor(F.col("_at") - F.col("_first")).cast("long")).withColumn("left_pct", F.round(F.greatest(F.lit(0.0), F.least(F.lit(99.2), (F.col("_at") - F.col("_first")) * 100 / F.col("_span"))), 4))
    return placed.withColumn("width_pct", F.round(F.greatest(F.lit(0.8), F.least(F.col("duration_ms") * 100 / F.col("_span"), 100 - F.col("left_pct"))), 4)).drop("_at", "_first", "_span")


def band(value: Column, good: float, warning: float, high_is_bad: bool = True) -> Column:
    """good / warning / bad by two thresholds; null is warning."""
    better = (lambda a, b: a < b) if high_is_bad else (lambda a, b: a >= b)
    return F.when(value.isNull(), "warning").when(better(value, good), "good").when(better(value, warning), "warning").otherwise("bad")


def health(figures: DataFrame) -> DataFrame:
    """Bands of the performance figures and the overall state."""
    out = figures.withColumns({
        "latency": band(F.col("avg_ms"), 10_000, 15_000), "success": band(F.col("success_rate"), 99, 95, high_is_bad=False),
        "error": band(F.col("error_rate"), 1, 5), "no_doc": band(F.col("no_doc_rate"), 10, 30),
    })
    bad = (F.col("latency") == "bad") | (F.col("success") == "bad") | (F.col("error") == "bad")
    return out.withColumn("overall", F.when(F.col("success_rate").isNull(), "unknown").when(bad, "critical").when(F.col("no_doc_rate") > 20, "attention").otherwise("healthy"))


def ratios(kpis: DataFrame) -> DataFrame:
    """Sessions and messages per active user and messages per session; null where the denominator is 0."""
    of = lambda k: F.max(F.when(F.col("kpi") == k, F.col("value")))
    wide = kpis.agg(of("sessions").alias("s"), of("messages").alias("m"), of("active_users").alias("u"))
    per = lambda a, b: F.round(F.try_divide(a, b), 4)
    return wide.select(per("s", "u").alias("sessions_per_user"), per("m", "s").alias("messages_per_session"), per("m", "u").alias("messages_per_user"))
