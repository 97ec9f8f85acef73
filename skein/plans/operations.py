"""Queries of the dashboard, of traces and of business reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import distinct, metrics, reports
from skein.plans.catalog import ORACLE_SQL, query
from skein.sources import tables as t
from skein.sources.snapshots import saved
from skein.streaming import streams

NOW = "2024-01-31 00:00:00"
HOURS = 168  # the `7d` window
IN_WINDOW = "{c} >= TIMESTAMP '2024-01-24 00:00:00' AND {c} < TIMESTAMP '2024-01-31 00:00:00'"
IN_BEFORE = "{c} >= TIMESTAMP '2024-01-17 00:00:00' AND {c} < TIMESTAMP '2024-01-24 00:00:00'"


def _kpi_sql(kpi: str, value: str, view: str) -> str:
    cur, prev = IN_WINDOW.format(c="create_time"), IN_BEFORE.format(c="create_time")
    return f"SELECT '{kpi}' AS kpi, {value} FILTER (WHERE {cur}) AS value, {value} FILTER (WHERE {prev}) AS previous FROM {view}"


KPI_SQL = "k AS (" + " UNION ALL ".join([_kpi_sql("sessions", "count(*)", "session"), _kpi_sql("messages", "count(*)", "chat_message"), _kpi_sql("active_users", "count(DISTINCT user_id)", "chat_message")]) + ")"


def _kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = t.chat_messages(spark, sf_dir)
    states = saved(distinct.hourly(said, "create_time"))
    return metrics.overview({"sessions": t.sessions(spark, sf_dir), "messages": said}, NOW, HOURS, states=states)


@query("dash_overview", f"WITH {KPI_SQL} SELECT kpi, value, previous, value - previous AS delta, CASE WHEN previous > 0 THEN floor((value - previous) * 100.0::DOUBLE / previous * 10 + 0.5) / 10 END AS pct FROM k")
def dash_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kpis(spark, sf_dir)


@query("dash_ratios", f"""WITH {KPI_SQL}, w AS (SELECT max(value) FILTER (WHERE kpi = 'sessions') AS s, max(value) FILTER (WHERE kpi = 'messages') AS m, max(value) FILTER (WHERE kpi = 'active_users') AS u FROM k)
SELECT round(s::DOUBLE / u, 4) AS sessions_per_user, round(m::DOUBLE / s, 4) AS messages_per_session, round(m::DOUBLE / u, 4) AS messages_per_user FROM w""")
def dash_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ratios(_kpis(spark, sf_dir))


PERF_SQL = f"""WITH r AS (SELECT * FROM trace_run WHERE {IN_WINDOW.format(c='start_time')}), m AS (SELECT * FROM chat_message WHERE {IN_WINDOW.format(c='create_time')}),
a AS (SELECT CAST(floor(avg(duration_ms) FILTER (WHERE status = 'SUCCESS' AND duration_ms > 0) + 0.5) AS BIGINT) AS avg_ms, CAST(quantile_disc(CASE WHEN status = 'SUCCESS' AND duration_ms > 0 THEN duration_ms END, 0.95) AS BIGINT) AS p95_ms,
floor(count(*) FILTER (WHERE status = 'SUCCESS') * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS success_rate, floor(count(*) FILTER (WHERE status = 'ERROR') * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS error_rate,
floor(count(*) FILTER (WHERE status = 'SUCCESS' AND duration_ms > 20000) * 100.0::DOUBLE / count(*) FILTER (WHERE status = 'SUCCESS' AND duration_ms > 0) * 10 + 0.5) / 10 AS slow_rate FROM r),
b AS (SELECT floor(sum(no_doc) * 100.0::DOUBLE / count(*) FILTER (WHERE role = 'assistant') * 10 + 0.5) / 10 AS no_doc_rate FROM m), p AS (SELECT * FROM a, b) """


@query("dash_performance", PERF_SQL + "SELECT * FROM p")
def dash_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.performance(t.trace_runs(spark, sf_dir), t.chat_messages(spark, sf_dir), NOW, HOURS)


@query("dash_health", PERF_SQL + """, h AS (SELECT *, CASE WHEN avg_ms < 10000 THEN 'good' WHEN avg_ms < 15000 THEN 'warning' ELSE 'bad' END AS latency, CASE WHEN success_rate >= 99 THEN 'good' WHEN success_rate >= 95 THEN 'warning' ELSE 'bad' END AS success,
CASE WHEN error_rate < 1 THEN 'good' WHEN error_rate < 5 THEN 'warning' ELSE 'bad' END AS error, CASE WHEN no_doc_rate < 10 THEN 'good' WHEN no_doc_rate < 30 THEN 'warning' ELSE 'bad' END AS no_doc FROM p)
SELECT *, CASE WHEN 'bad' IN (latency, success, error) THEN 'critical' WHEN no_doc_rate > 20 THEN 'attention' ELSE 'healthy' END AS overall FROM h""")
def dash_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.health(dash_performance(spark, sf_dir))


def _register_trends() -> None:
    windows = {"day": (HOURS, "range(TIMESTAMP '2024-01-24 00:00:00', TIMESTAMP '2024-01-31 00:00:01', INTERVAL 1 DAY)"), "hour": (48, "range(TIMESTAMP '2024-01-29 01:00:00', TIMESTAMP '2024-01-31 00:00:01', INTERVAL 1 HOUR)")}
    rows = lambda: {"n": F.count(F.lit(1))}
    users = lambda: {"n": F.count_distinct("user_id")}
    latency = lambda: {"avg_ms": F.floor(F.avg("duration_ms") + 0.5).cast("long")}
    percent = lambda part, whole: F.coalesce(metrics.one_digit(F.try_divide(F.count_if(part) * 100.0, F.count_if(whole))), F.lit(0.0))
    quality = lambda: {"error_rate": percent(F.col("status") == "ERROR", F.col("status").isin("SUCCESS", "ERROR"))}
    no_doc = lambda: {"no_doc_rate": percent(F.col("no_doc") == 1, F.col("role") == "assistant")}
    share_sql = lambda part, whole, name: f"coalesce(floor(count(*) FILTER (WHERE {part}) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE {whole}), 0) * 10 + 0.5) / 10, 0.0) AS {name}"
    kinds = {
        "sessions": (t.sessions, "create_time", "n", rows, "session", "count(*) AS n"),
        "messages": (t.chat_messages, "create_time", "n", rows, "chat_message", "count(*) AS n"),
        "active": (t.chat_messages, "create_time", "n", users, "chat_message", "count(DISTINCT user_id) AS n"),
        "latency": (lambda s, d: t.trace_runs(s, d).where("status = 'SUCCESS'"), "start_time", "avg_ms", latency, "(SELECT * FROM trace_run WHERE status = 'SUCCESS')", "CAST(floor(avg(duration_ms) + 0.5) AS BIGINT) AS avg_ms"),
        "quality": (t.trace_runs, "start_time", "error_rate", quality, "trace_run", share_sql("status = 'ERROR'", "status IN ('SUCCESS', 'ERROR')", "error_rate")),
        "no_doc": (t.chat_messages, "create_time", "no_doc_rate", no_doc, "chat_message", share_sql("no_doc = 1", "role = 'assistant'", "no_doc_rate")),
    }
    for unit, (hours, spine) in windows.items():
        for kind, (view, at, value, make, source, said) in kinds.items():
            sql = f"WITH b AS (SELECT unnest({spine}) AS bucket), c AS (SELECT date_trunc('{unit}', {at}) AS bucket, {said} FROM {source} GROUP BY 1) SELECT CAST(b.bucket AS TIMESTAMP) AS bucket, coalesce({value}, 0) AS {value} FROM b LEFT JOIN c USING (bucket)"

            def run(spark: SparkSession, sf_dir: str, view=view, at=at, make=make, unit=unit, hours=hours) -> DataFrame:  # noqa: ANN001
                if make is users:
                    return metrics.active_trend(saved(distinct.hourly(view(spark, sf_dir), at)), NOW, hours, unit)
                return metrics.trend(view(spark, sf_dir), at, NOW, hours, unit, make())

            query(f"dash_trend_{kind}_{unit}", sql)(run)


_register_trends()


@query("active_users_stream")
def active_users_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily active users from states that a stream keeps."""
    return metrics.active_trend(streams.active_states(spark, f"{sf_dir}/events.parquet", t.chat_messages_of), NOW, HOURS, "day")


ORACLE_SQL["active_users_stream"] = ORACLE_SQL["dash_trend_active_day"]


@query("hourly_stream", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.hourly_counts(spark, f"{sf_dir}/events.parquet")
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n", F.round("total", 4).alias("total"))


@query("trace_stats", "SELECT count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status IN ('ERROR', 'FAILED')) AS failed, count(*) FILTER (WHERE status = 'RUNNING') AS running, CAST(floor(avg(duration_ms) FILTER (WHERE duration_ms > 0) + 0.5) AS BIGINT) AS avg_ms, CAST(quantile_disc(CASE WHEN duration_ms > 0 THEN duration_ms END, 0.95) AS BIGINT) AS p95_ms, floor(count(*) FILTER (WHERE status = 'SUCCESS') * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS success_pct FROM trace_run")
def trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.trace_stats(t.trace_runs(spark, sf_dir))


@query("trace_node_stats", "SELECT trace_id, count(*) AS total, count(*) FILTER (WHERE status = 'ERROR') AS failed, count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'RUNNING') AS running, round(avg(duration_ms), 4) AS avg_ms, first(node_id ORDER BY duration_ms DESC, node_id) AS slowest FROM trace_node GROUP BY trace_id")
def trace_node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.node_stats(t.trace_nodes(spark, sf_dir))


@query("trace_waterfall", """
WITH a AS (SELECT *, epoch_us(start_time) / 1000.0::DOUBLE AS tm FROM trace_node), b AS (SELECT *, min(tm) OVER (PARTITION BY trace_id) AS f, max(tm + duration_ms) OVER (PARTITION BY trace_id) AS l FROM a),
c AS (SELECT *, greatest(l - f, 1.0) AS span FROM b), d AS (SELECT *, round(greatest(0.0, least(99.2::DOUBLE, (tm - f) * 100 / span)), 4) AS left_pct FROM c)
SELECT trace_id, node_id, CAST(floor(tm - f) AS BIGINT) AS offset_ms, left_pct, round(greatest(0.8::DOUBLE, least(duration_ms * 100 / span, 100 - left_pct)), 4) AS width_pct FROM d""")
def trace_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.waterfall(t.trace_nodes(spark, sf_dir)).select("trace_id", "node_id", "offset_ms", "left_pct", "width_pct")


@query("trace_nodes", "SELECT trace_id, node_id, row_number() OVER (PARTITION BY trace_id ORDER BY start_time, node_id) AS pos FROM trace_node")
def trace_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return t.trace_nodes(spark, sf_dir).select("trace_id", "node_id", F.row_number().over(Window.partitionBy("trace_id").orderBy("start_time", "node_id")).cast("long").alias("pos"))


@query("trace_runs_page", "SELECT trace_id, user_id, duration_ms FROM trace_run WHERE status = 'ERROR' ORDER BY duration_ms DESC, trace_id LIMIT 20 OFFSET 20")
def trace_runs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.matching(t.trace_runs(spark, sf_dir), {"status": "ERROR", "user_id": None})
    return reports.page(rows, [F.desc("duration_ms"), F.col("trace_id")], 2, 20).select("trace_id", "user_id", "duration_ms")


@query("trace_runs_with_user", "SELECT trace_id, user_id, c_name AS user_name FROM trace_run LEFT JOIN (SELECT c_custkey, min(c_name) AS c_name FROM customer GROUP BY 1) ON c_custkey = user_id")
def trace_runs_with_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = t.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("user_name"))
    return reports.lookup(t.trace_runs(spark, sf_dir), users, "user_id", "c_custkey", ["user_name"]).select("trace_id", "user_id", "user_name")


SUM_SQL = "SELECT product, region, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n, round(CAST(sum(amount) AS DOUBLE) / count(*), 4) AS mean, round(CAST(sum(amount) AS DOUBLE) * 100 / (SELECT CAST(sum(amount) AS DOUBLE) FROM sales), 4) AS share FROM sales GROUP BY GROUPING SETS ((), (product), (region))"


@query("sales_summary", SUM_SQL)
def sales_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sales_summary(t.sales(spark, sf_dir))


@query("sales_ranking", "SELECT sales_person, total, row_number() OVER (ORDER BY total DESC, sales_person) AS pos FROM (SELECT sales_person, CAST(sum(amount) AS DOUBLE) AS total FROM sales GROUP BY 1) QUALIFY pos <= 10")
def sales_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sales_ranking(t.sales(spark, sf_dir), 10)


@query("sales_detail", "SELECT l_orderkey, l_linenumber, sales_person, CAST(amount AS DOUBLE) AS amount FROM sales ORDER BY amount DESC, l_orderkey, l_linenumber, sales_person LIMIT 15")
def sales_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.sales(spark, sf_dir).orderBy(F.desc("amount"), "l_orderkey", "l_linenumber", "sales_person").limit(15).select("l_orderkey", "l_linenumber", "sales_person", F.col("amount").cast("double").alias("amount"))


@query("sales_trend", "SELECT (day(date) - 1) // 7 + 1 AS week, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n FROM sales GROUP BY 1")
def sales_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.week_trend(t.sales(spark, sf_dir))


@query("sales_period", " UNION ALL ".join(f"SELECT '{n}' AS period, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n FROM sales WHERE date >= DATE '{a}' AND date < DATE '{b}'" for n, a, b in [("this_month", "2000-05-01", "2000-06-01"), ("last_month", "2000-04-01", "2000-05-01"), ("this_quarter", "2000-04-01", "2000-07-01"), ("last_quarter", "2000-01-01", "2000-04-01"), ("this_year", "2000-01-01", "2001-01-01")]))
def sales_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = t.sales(spark, sf_dir), ["this_month", "last_month", "this_quarter", "last_quarter", "this_year"]
    inside = {n: (F.col("date") >= a) & (F.col("date") < b) for n in names for a, b in [reports.period(n, "2000-05-17")]}
    of = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in inside.items()])))
    return rows.select("amount", of.alias("period")).groupBy("period").agg(F.sum("amount").cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


@query("sales_filter", "SELECT l_orderkey, l_linenumber, sales_person, CAST(amount AS DOUBLE) AS amount FROM sales WHERE region = 'ASIA' AND product = 'Brand#2'")
def sales_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.matching(t.sales(spark, sf_dir), {"region": "ASIA", "product": "Brand#2", "customer": " "}).select("l_orderkey", "l_linenumber", "sales_person", F.col("amount").cast("double").alias("amount"))


@query("ticket_summary", "SELECT product, region, count(*) AS n, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'in_progress') AS in_progress, count(*) FILTER (WHERE status = 'closed') AS closed, count(*) FILTER (WHERE priority IN ('1-URGENT', '2-HIGH')) AS pressing, round(count(*) FILTER (WHERE status IN ('resolved', 'closed'))::DOUBLE / count(*), 4) AS resolve_rate FROM ticket GROUP BY GROUPING SETS ((), (product), (region))")
def ticket_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ticket_summary(t.tickets(spark, sf_dir))


@query("ticket_list", "SELECT ticket_id, priority, CAST(create_date AS VARCHAR) AS create_day FROM ticket WHERE contains(customer, '1') ORDER BY CASE priority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, create_date DESC, ticket_id LIMIT 25")
def ticket_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ticket_list(reports.matching(t.tickets(spark, sf_dir), contains={"customer": "1"}), ["2-HIGH", "1-URGENT"], 25).select("ticket_id", "priority", F.col("create_date").cast("string").alias("create_day"))


@query("ticket_stats", """
SELECT 'category' AS kind, category AS name, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ticket), 4) AS rate FROM ticket GROUP BY category
UNION ALL SELECT 'product', CAST(product AS VARCHAR), count(*), round(avg(CASE WHEN status IN ('resolved', 'closed') THEN 1 ELSE 0 END), 4) FROM ticket GROUP BY product
UNION ALL SELECT * FROM (SELECT 'engineer', engineer, count(*) AS n, NULL FROM ticket WHERE status = 'open' GROUP BY engineer ORDER BY n DESC, engineer LIMIT 5)""")
def ticket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ticket_stats(t.tickets(spark, sf_dir))


@query("catalog_search", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red') OR contains(p_brand, '17')")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.keyword(t.table(spark, sf_dir, "part"), "red", ["p_name"]).unionByName(reports.keyword(t.table(spark, sf_dir, "part").where("not contains(p_name, 'red')"), "17", ["p_brand"])).select("p_partkey", "p_name")
