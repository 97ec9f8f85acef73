"""Queries over documents, chunks, the index and enrichment."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import chunking, enrich, incremental, reports
from skein.operators import vectors as v
from skein.plans.catalog import query
from skein.sources import folder, index, jsonl
from skein.sources import tables as t
from skein.sources.snapshots import SnapshotTable, shared_folder
from skein.streaming import streams


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents")


@query("text_cleanup", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(65279), ''), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS text FROM documents")
def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", chunking.cleaned(F.col("text")).alias("text"))


@query("chunk_fixed")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(_docs(spark, sf_dir).select("doc_id", "text"), "fixed", size=512, overlap=128).drop("text")


@query("chunk_structure")
def chunk_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(_docs(spark, sf_dir).select("doc_id", "text"), "structure").drop("text")


@query("chunk_paragraph")
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunked(_docs(spark, sf_dir).select("doc_id", "text"), "paragraph").drop("text")
    return rows.withColumn("source_id", F.concat(F.col("doc_id").cast("string"), F.lit("#chunk"), F.col("idx").cast("string")))


@query("chunk_lines", "SELECT doc_id, CAST(i // 5 AS INTEGER) AS idx, string_agg(line, chr(10) ORDER BY i) AS content FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) GROUP BY doc_id, i // 5")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.by_lines(_docs(spark, sf_dir).select("doc_id", "text"), 5)


TOKENS_SQL = "CASE WHEN trim({c}) = '' THEN 0 ELSE greatest(1, CAST(ceil(length(regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g')) / 4.0) + length(regexp_replace({c}, '[^一-鿿㐀-䶿]', '', 'g')) + ceil((length({c}) - length(regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g')) - length(regexp_replace({c}, '[^一-鿿㐀-䶿]', '', 'g'))) / 2.0) AS INTEGER)) END"


@query("token_count", f"SELECT doc_id, {TOKENS_SQL.format(c='text')} AS tokens FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", chunking.token_count(F.col("text")).alias("tokens"))


@query("chunk_stats", f"SELECT doc_id, chunk_index, sha256(content) AS content_hash, CAST(length(content) AS INTEGER) AS char_count, {TOKENS_SQL.format(c='content')} AS token_count FROM chunk")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunk_stats(t.chunks(spark, sf_dir))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content_hash", "char_count", "token_count")


@query("chunk_autoindex", "SELECT doc_id, 'extra ' || k AS content, CAST(m + k AS BIGINT) AS chunk_index FROM (SELECT doc_id, max(chunk_index) AS m FROM chunk GROUP BY doc_id), (SELECT unnest([1, 2]) AS k)")
def chunk_autoindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit("extra 1"), F.lit("extra 2"))).alias("content"))
    return chunking.autoindexed(t.chunks(spark, sf_dir), new).select("doc_id", "content", F.col("chunk_index").cast("long").alias("chunk_index"))


@query("file_type_route", """
WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a.PDF' WHEN 1 THEN 'b.md' WHEN 2 THEN 'c' WHEN 3 THEN 'd.docx' ELSE 'e.bin' END AS name, CASE WHEN page_id % 2 = 0 THEN 'text/html' END AS mime FROM pages),
r AS (SELECT *, coalesce(CASE lower(regexp_extract(name, '\\.([^./]+)$', 1)) WHEN 'pdf' THEN 'PDF' WHEN 'md' THEN 'MARKDOWN' WHEN 'docx' THEN 'WORD' END, CASE mime WHEN 'text/html' THEN 'HTML' END) AS type FROM f)
SELECT page_id, type, type IS NOT NULL AND coalesce(type IN ('PDF', 'HTML'), false) AS accepted FROM r""")
def file_type_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    name = F.when(k == 0, "a.PDF").when(k == 1, "b.md").when(k == 2, "c").when(k == 3, "d.docx").otherwise("e.bin")
    files = t.table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.when(F.col("page_id") % 2 == 0, "text/html").alias("mime"))
    return chunking.routed(files, {"pdf": "PDF", "md": "MARKDOWN", "docx": "WORD"}, {"text/html": "HTML"}, {"PDF", "HTML"}).select("page_id", "type", "accepted")


@query("embed_chunks")
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.attach_embeddings(t.chunks(spark, sf_dir), v.hashing_model(16), dimension=16)


@query("index_rows", "SELECT sha256(concat_ws(':', collection, doc_id, chunk_index)) AS id, collection, doc_id, chunk_index, substring(content, 1, 65535) AS content FROM chunk")
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.index_rows(t.chunks(spark, sf_dir)).select("id", "collection", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@query("index_metadata", "SELECT doc_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN 'chunk' ELSE kb_id END AS source, collection AS lang FROM chunk")
def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.create_map(F.lit("source"), "kb_id", F.lit("lang"), "collection", F.lit("other"), F.lit("x"))
    own = F.when(F.col("chunk_index") % 2 == 0, F.create_map(F.lit("source"), F.lit("chunk"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = t.chunks(spark, sf_dir).withColumn("m", incremental.metadata(document, own, ["source", "lang"]))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("m")["source"].alias("source"), F.col("m")["lang"].alias("lang"))


@query(
    "index_metadata_typed",
    """
SELECT doc_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN 'chunk' ELSE kb_id END AS source, n_chars AS chars, collection AS lang, CASE WHEN chunk_index % 3 = 0 THEN chunk_index ELSE -1 END AS line
FROM chunk JOIN (SELECT DISTINCT doc_id, n_chars FROM documents) USING (doc_id) WHERE n_chars > 500
""",
)
def index_metadata_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    size = F.struct(F.col("n_chars").alias("chars"), F.array("lang").alias("langs"))
    described = docs.select("doc_id", "lang", "source", "text", F.parse_json(F.to_json(F.struct("source", size.alias("size"), F.lit(-1).alias("line"), F.lit("x").alias("other")))).alias("document"))
    lines = described.select("doc_id", "document", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    own = F.struct(F.when(F.col("chunk_index") % 2 == 0, "chunk").alias("source"), F.when(F.col("chunk_index") % 3 == 0, F.col("chunk_index")).alias("line"))
    rows = lines.withColumn("m", incremental.typed_metadata(F.col("document"), F.parse_json(F.to_json(own)), ["source", "size", "line"]))
    field = lambda path, kind: F.try_variant_get("m", path, kind)
    return rows.where(field("$.size.chars", "long") > 500).select(
        "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), field("$.source", "string").alias("source"), field("$.size.chars", "long").alias("chars"),
        field("$.size.langs[0]", "string").alias("lang"), field("$.line", "long").alias("line"),
    )


@query("index_delete_by_doc", "SELECT doc_id, chunk_index FROM chunk WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def index_delete_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = t.table(spark, sf_dir, "labels").where("toxic = 1")
    return incremental.deleted(t.chunks(spark, sf_dir), gone).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"))


@query("index_replace", "SELECT doc_id, text FROM snap_new UNION ALL SELECT doc_id, text FROM snap_old WHERE doc_id NOT IN (SELECT doc_id FROM snap_new)")
def index_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = t.snapshots(spark, sf_dir)
    return incremental.replaced(old, new).select("doc_id", "text")


@query("chunk_upsert", "SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' ELSE 'update' END AS action FROM snap_new n LEFT JOIN snap_old o USING (doc_id) WHERE o.hash IS NULL OR o.hash <> n.hash")
def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = t.snapshots(spark, sf_dir)
    return incremental.upserts(old, new).select("doc_id", "action")


@query("index_enabled_diff", "SELECT doc_id, 'add' AS action FROM snap_new WHERE doc_id NOT IN (SELECT doc_id FROM snap_old) UNION ALL SELECT doc_id, 'remove' FROM snap_old WHERE doc_id NOT IN (SELECT doc_id FROM snap_new)")
def index_enabled_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = t.snapshots(spark, sf_dir)
    return incremental.enabled_diff(old, new, "doc_id")


TOGGLE_SQL = """
WITH k AS (SELECT doc_id || ':' || chunk_index AS chunk_id, doc_id, chunk_index % 2 AS enabled FROM chunk),
d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'RUNNING' ELSE 'SUCCESS' END AS status, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS enabled FROM documents),
r AS (SELECT doc_id AS request_id, CASE WHEN doc_id % 13 = 4 THEN -doc_id WHEN doc_id % 5 = 1 THEN doc_id + 1 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 5 = 2 THEN 'x' || chunk_id ELSE chunk_id END AS chunk_id, CAST(doc_id % 2 AS INTEGER) AS enable FROM k),
p AS (SELECT request_id, r.doc_id, enable, count(*) AS asked, count(DISTINCT k.chunk_id) AS found, count(*) FILTER (k.doc_id <> r.doc_id) AS others, count(*) FILTER (k.enabled <> enable) AS changed FROM r LEFT JOIN k USING (chunk_id) GROUP BY 1, 2, 3),
o AS (SELECT request_id, doc_id, enable, changed, CASE WHEN asked > 20 THEN 'TOO_MANY' WHEN d.enabled IS NULL THEN 'NO_DOCUMENT' WHEN status = 'RUNNING' THEN 'RUNNING' WHEN enable = 1 AND d.enabled = 0 THEN 'DOCUMENT_DISABLED' WHEN found <> asked THEN 'UNKNOWN_CHUNK' WHEN others > 0 THEN 'OTHER_DOCUMENT' WHEN changed = 0 THEN 'UNCHANGED' ELSE 'DONE' END AS outcome FROM p LEFT JOIN d USING (doc_id))
"""


def _toggles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests to turn all chunks of a document on or off, some of them wrong; the chunks; the documents."""
    i = F.col("doc_id")
    chunks = t.chunks(spark, sf_dir).select(F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", (F.col("chunk_index") % 2).alias("enabled"))
    documents = _docs(spark, sf_dir).select("doc_id", F.when(i % 7 == 0, "RUNNING").otherwise("SUCCESS").alias("status"), F.when(i % 11 == 0, 0).otherwise(1).alias("enabled"))
    asked = chunks.select(i.alias("request_id"), F.when(i % 13 == 4, -i).when(i % 5 == 1, i + 1).otherwise(i).alias("doc_id"), F.when(i % 5 == 2, F.concat(F.lit("x"), "chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), (i % 2).cast("int").alias("enable"))
    return asked, chunks, documents


@query("toggle_outcome", TOGGLE_SQL + "SELECT request_id, doc_id, enable, outcome, CASE WHEN outcome = 'DONE' THEN changed ELSE 0 END AS changed FROM o")
def toggle_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.toggle_outcome(*_toggles(spark, sf_dir), most=20)


@query("toggled_chunks", TOGGLE_SQL + "SELECT k.chunk_id, k.doc_id, CASE WHEN o.enable = 1 THEN 'add' ELSE 'remove' END AS action FROM o JOIN r USING (request_id) JOIN k ON k.chunk_id = r.chunk_id WHERE outcome = 'DONE' AND k.enabled <> o.enable")
def toggled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.toggled(*_toggles(spark, sf_dir), most=20).select("chunk_id", "doc_id", "action")


@query("fetch_status", """
SELECT n.doc_id, CASE WHEN o.doc_id IS NOT NULL AND (n.doc_id % 3 = 1 OR n.doc_id % 4 = 1) THEN 'header' WHEN n.hash = o.hash THEN 'hash' WHEN o.doc_id IS NULL THEN 'new' ELSE 'changed' END AS status
FROM snap_new n LEFT JOIN snap_old o USING (doc_id)""")
def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity tags are blank, kept or new by turns (of three), times of change kept for one document in four."""
    old, new = t.snapshots(spark, sf_dir)
    i = F.col("doc_id")
    tag = lambda mark: F.when(i % 3 == 0, " ").when(i % 3 == 1, "kept").otherwise(mark)
    time = lambda mark: F.when(i % 4 == 1, F.lit(" Mon, 1 Jan ")).when(i % 4 == 2, mark)
    return incremental.fetch_status(old.withColumns({"etag": tag("a"), "modified": time("x")}), new.withColumns({"etag": tag("b"), "modified": time("y")}))


@query("snapshot_diff", "SELECT doc_id, CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'same' ELSE 'changed' END AS status FROM snap_old o FULL JOIN snap_new n USING (doc_id)")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.snapshot_diff(*t.snapshots(spark, sf_dir))


SCHEDULE_SQL = "WITH s AS (SELECT event_id AS schedule_id, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END AS enabled, CASE WHEN event_id % 11 <> 0 THEN ts + INTERVAL 10 DAY END AS next_run, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 12 DAY END AS lock_until FROM events) "


@query("due_schedules", SCHEDULE_SQL + "SELECT schedule_id, next_run FROM s WHERE enabled = 1 AND (next_run IS NULL OR next_run <= TIMESTAMP '2024-01-31') AND (lock_until IS NULL OR lock_until < TIMESTAMP '2024-01-31') ORDER BY next_run NULLS FIRST, schedule_id LIMIT 20")
def due_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("schedule_id"), F.when(F.col("event_type") == "signup", 0).otherwise(1).alias("enabled"), F.when(F.col("event_id") % 11 != 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("next_run"), F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 12 DAYS")).alias("lock_until"))
    return incremental.due(rows, F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))).select("schedule_id", "next_run")


@query("stuck_runs", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND ts < TIMESTAMP '2024-01-30 23:40:00' THEN 'FAILED' WHEN event_type IN ('view', 'click') THEN 'RUNNING' ELSE 'DONE' END AS status FROM events")
def stuck_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = t.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type").isin("view", "click"), "RUNNING").otherwise("DONE").alias("status"), F.col("ts").alias("update_time"))
    return incremental.stuck(runs, F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")), 20).select("event_id", "status")


@query("schedule_state", """
WITH l AS (SELECT user_id AS schedule_id, event_id AS run_id, ts AS tm, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'success' END AS outcome, CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error FROM events)
SELECT schedule_id, arg_max(outcome, {'a': tm, 'r': run_id}) AS last_outcome, max(CASE WHEN outcome = 'success' THEN tm END) AS last_success, substring(arg_max(error, {'a': tm, 'r': run_id}) FILTER (WHERE error IS NOT NULL), 1, 500) AS last_error, count(*) AS runs FROM l GROUP BY 1""")
def schedule_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("success")
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("error "), F.col("event_id").cast("string")))
    return incremental.schedule_state(t.table(spark, sf_dir, "events").select(F.col("user_id").alias("schedule_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("at"), outcome.alias("outcome"), error.alias("error")))


SPAN_SQL = """
WITH s AS (SELECT event_id // 2 AS trace_id, event_id // 2 AS node_id, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'finish' END AS phase, ts AS tm, CASE WHEN event_id % 2 = 1 THEN CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END END AS status FROM events WHERE event_id % 9 <> 1)
SELECT trace_id, min(CASE WHEN phase = 'start' THEN tm END) AS start_time, max(CASE WHEN phase = 'finish' THEN tm END) AS end_time, coalesce(max(CASE WHEN phase = 'finish' THEN status END), 'RUNNING') AS status FROM s GROUP BY trace_id, node_id"""


def _span_events(events: DataFrame) -> DataFrame:
    """Starts and finishes by turns; as a fixture of spans that have not ended or whose start is lost, one event in nine is left out."""
    half = F.expr("event_id div 2")
    start = F.col("event_id") % 2 == 0
    return events.where("event_id % 9 <> 1").select(
        half.alias("trace_id"), half.alias("node_id"), F.when(start, "start").otherwise("finish").alias("phase"), F.col("ts").alias("at"),
        F.when(~start, F.when(F.col("event_type") == "error", "ERROR").otherwise("SUCCESS")).alias("status"), F.lit(None).cast("string").alias("error"),
    )


@query("span_fold", SPAN_SQL)
def span_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.spans(_span_events(t.table(spark, sf_dir, "events"))).select("trace_id", "start_time", "end_time", "status")


@query("span_stream", SPAN_SQL)
def span_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.span_stream(spark, f"{sf_dir}/events.parquet", _span_events).select("trace_id", "start_time", "end_time", "status")


STALE_SQL = SPAN_SQL.replace("coalesce(max(CASE WHEN phase = 'finish' THEN status END), 'RUNNING')", "coalesce(max(CASE WHEN phase = 'finish' THEN status END), CASE WHEN min(CASE WHEN phase = 'start' THEN tm END) < (SELECT max(tm) FROM s) - INTERVAL 40 MINUTES THEN 'FAILED' ELSE 'RUNNING' END)")


@query("span_timeout_stream", STALE_SQL)
def span_timeout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that have not ended after 30 minutes have failed, seen from 10 minutes before the newest event."""
    found = streams.span_stream(spark, f"{sf_dir}/events.parquet", _span_events, timeout=timedelta(minutes=30), late=timedelta(minutes=10))
    return found.select("trace_id", "start_time", "end_time", "status")


@query("span_timeout", STALE_SQL)
def span_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _span_events(t.table(spark, sf_dir, "events"))
    now = rows.agg(F.max("at") - F.expr("INTERVAL 10 MINUTES")).scalar()
    spans = incremental.spans(rows).withColumn("update_time", F.col("start_time"))
    return incremental.stuck(spans, now, 30).select("trace_id", "start_time", "end_time", "status")


@query("image_meta_join", "SELECT page_id, coalesce(u, '') AS source_url, coalesce(l, '') AS license FROM pages LEFT JOIN (SELECT item_id, 'u' || item_id AS u, CASE WHEN item_id % 2 = 0 THEN 'CC' END AS l FROM benchmark) ON item_id = page_id")
def image_meta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("image_path"), F.explode(F.array(F.lit(1), F.lit(2))).alias("line"), "item_id").select("image_path", "line", F.when(F.col("line") == 2, F.concat(F.lit("u"), F.col("image_path"))).otherwise("old").alias("source_url"), F.when(F.col("item_id") % 2 == 0, "CC").alias("license"))
    rows = t.table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("image_path"))
    return incremental.latest_images(rows, meta).select("page_id", "source_url", "license")


@query("doc_stream", "SELECT doc_id, CAST(i // 5 AS INTEGER) AS idx, string_agg(line, chr(10) ORDER BY i) AS content FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) GROUP BY doc_id, i // 5")
def doc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.document_stream(spark, f"{sf_dir}/documents.parquet", lambda df: chunking.by_lines(df.select("doc_id", "text"), 5))


@query("doc_page", "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15 OFFSET 15")
def doc_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page(_docs(spark, sf_dir), [F.desc("n_chars"), F.col("doc_id")], 2, 15).select("doc_id", "source", "n_chars")


@query("doc_search_with_kb", "SELECT doc_id, source, kb_docs FROM (SELECT doc_id, source FROM documents WHERE contains(text, 'License') ORDER BY doc_id DESC LIMIT 20) LEFT JOIN (SELECT source, count(*) AS kb_docs FROM documents GROUP BY 1) USING (source)")
def doc_search_with_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.keyword(_docs(spark, sf_dir), "License", ["text"]).orderBy(F.desc("doc_id")).limit(reports.clamped(50))
    kb = _docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("kb_docs"))
    return reports.lookup(found.select("doc_id", "source"), kb, "source", "source", ["kb_docs"]).select("doc_id", "source", "kb_docs")


@query("kb_doc_count", "SELECT s.source AS kb_id, count(d.doc_id) AS n FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT * FROM documents WHERE lang = 'fr') d USING (source) GROUP BY 1")
def kb_doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    counts = docs.where("lang = 'fr'").groupBy(F.col("source").alias("kb_id")).agg(F.count(F.lit(1)).alias("n"))
    return docs.select(F.col("source").alias("kb_id")).distinct().join(counts, "kb_id", "left").fillna(0, ["n"])


LOG_SQL = "SELECT event_id, event_type AS mode, CAST(floor(value) AS BIGINT) AS a, CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value / 2) AS BIGINT) END AS b, CAST(floor(value * 1.2) AS BIGINT) AS total FROM events"


@query("chunk_log_other", f"SELECT event_id, greatest(0, CASE WHEN mode = 'click' THEN total - a ELSE total - a - coalesce(b, 0) END) AS other FROM ({LOG_SQL})")
def chunk_log_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("mode"), F.floor("value").cast("long").alias("a"), F.when(F.col("event_id") % 4 != 0, F.floor(F.col("value") / 2)).cast("long").alias("b"), F.floor(F.col("value") * 1.2).cast("long").alias("total"))
    known = F.when(F.col("mode") == "click", F.col("a")).otherwise(F.col("a") + F.coalesce("b", F.lit(0)))
    return rows.select("event_id", F.greatest(F.lit(0).cast("long"), F.col("total") - known).alias("other"))


@query("chunk_log_page", "SELECT event_id, user_id, c_name AS pipeline_name FROM (SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 30) LEFT JOIN customer ON c_custkey = user_id")
def chunk_log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = reports.page(t.table(spark, sf_dir, "events"), [F.desc("ts"), F.col("event_id")], 1, 30)
    names = t.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("pipeline_name"))
    return reports.lookup(newest, names, "user_id", "c_custkey", ["pipeline_name"]).select("event_id", "user_id", "pipeline_name")


@query("enhance_requests", "SELECT doc_id, task, CASE task WHEN 'keywords' THEN 'Keywords of: ' || text ELSE 'Questions on ' || text END AS prompt FROM documents, (SELECT unnest(['keywords', 'questions']) AS task)")
def enhance_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.requests(_docs(spark, sf_dir).select("doc_id", "text"), {"keywords": "Keywords of: {{text}}", "questions": "Questions on {text}"}).select("doc_id", "task", "prompt")


@query("enhance_requests_fallback", """
WITH e AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN upper(lang) || ' better' WHEN doc_id % 3 = 1 THEN ' ' END AS enhanced FROM documents WHERE trim(text) <> '')
SELECT doc_id, task, CASE task WHEN 'rewrite' THEN 'Rewrite: ' || text WHEN 'keywords' THEN 'Keywords of: ' || CASE WHEN trim(enhanced) <> '' THEN enhanced ELSE text END ELSE CASE WHEN trim(enhanced) <> '' THEN enhanced ELSE text END END AS prompt FROM e, (SELECT unnest(['rewrite', 'keywords', 'metadata']) AS task)""")
def enhance_requests_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    enhanced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper("lang"), F.lit(" better"))).when(F.col("doc_id") % 3 == 1, " ")
    rows = _docs(spark, sf_dir).select("doc_id", "text", enhanced.alias("enhanced"))
    return enrich.requests(rows, {"rewrite": "Rewrite: {{text}}", "keywords": "Keywords of: {{content}}", "metadata": ""}, enhanced_col="enhanced").select("doc_id", "task", "prompt")


@query("chunk_metadata_copy", "SELECT doc_id, chunk_index, 'lang=' || collection || ',line=' || chunk_index || ',source=' || kb_id AS metadata FROM chunk")
def chunk_metadata_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.create_map(F.lit("line"), F.col("chunk_index").cast("string"), F.lit("source"), F.lit("chunk"))
    given = F.create_map(F.lit("source"), "kb_id", F.lit("lang"), "collection")
    entries = F.array_sort(F.map_entries(enrich.copied_metadata(own, given)))
    rows = t.chunks(spark, sf_dir).withColumn("metadata", F.concat_ws(",", F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "metadata")


@query("enrich_requests", "SELECT doc_id, chunk_index, 'summary' AS task, 'Summary: ' || content AS prompt FROM chunk")
def enrich_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.requests(t.chunks(spark, sf_dir), {"summary": "Summary: {{text}}"}, "content")
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "task", "prompt")


@query("render_template", "SELECT event_id, 'user ' || user_id || ': ' || event_type || chr(10) || chr(10) || '-' AS said FROM events")
def render_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = enrich.rendered(F.lit("user {{user}}: {kind}\n\n\n\n{none}-"), {"user": F.col("user_id"), "kind": F.col("event_type"), "none": F.lit(None)})
    return t.table(spark, sf_dir, "events").select("event_id", said.alias("said"))


def _answers(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """Model answers made from events: fenced, with words before, broken or empty, by turns."""
    k, said = F.col("event_id") % 4, F.expr(body)
    fenced = F.concat(F.lit("```json\n"), said, F.lit("\n```"))
    return t.table(spark, sf_dir, "events").select("event_id", "user_id", F.when(k == 0, fenced).when(k == 1, F.concat(F.lit("Sure: "), said)).when(k == 2, F.substring(said, 1, 9)).otherwise("").alias("answer"))


@query("parse_model_json", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN user_id END AS user_id, CASE WHEN event_id % 4 < 2 THEN event_type END AS kind FROM events")
def parse_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.parsed(_answers(spark, sf_dir, "concat('{\"user\": ', user_id, ', \"kind\": \"', event_type, '\"}')"), "user long, kind string")
    return rows.select("event_id", F.col("value.user").alias("user_id"), F.col("value.kind").alias("kind"))


@query("merge_enrichment", "SELECT doc_id, max(CASE WHEN toxic = 1 THEN 'bad' ELSE 'fine' END) AS tone, max(CASE WHEN quality = 1 THEN 'good' END) AS grade FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id")
def merge_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = t.table(spark, sf_dir, "labels")
    tone = labels.select("doc_id", F.lit("tone").alias("task"), F.when(F.col("toxic") == 1, "bad").otherwise("fine").alias("result"))
    grade = labels.where("quality = 1").select("doc_id", F.lit("grade").alias("task"), F.lit("good").alias("result"))
    out = enrich.merged(_docs(spark, sf_dir).select("doc_id"), tone.unionByName(grade), "doc_id", ["tone", "grade"])
    return out.select("doc_id", F.coalesce("tone", F.lit("fine")).alias("tone"), "grade")


@query("parse_rewrite", "SELECT event_id, CASE WHEN event_id % 4 < 2 AND user_id % 3 <> 0 THEN 'what about ' || event_type ELSE 'q' || event_id END AS rewrite, CASE WHEN event_id % 4 < 2 AND user_id % 2 = 0 THEN 'a|b' WHEN event_id % 4 < 2 AND user_id % 3 <> 0 THEN 'what about ' || event_type ELSE 'q' || event_id END AS subs FROM events")
def parse_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('{\"rewrite\": \"', if(user_id % 3 <> 0, concat('what about ', event_type), ' '), '\", \"sub_questions\": [', if(user_id % 2 = 0, '\"a\", \" \", \"b\"', ''), ']}')"
    rows = _answers(spark, sf_dir, body).withColumn("question", F.concat(F.lit("q"), F.col("event_id").cast("string")))
    return enrich.rewrites(rows).select("event_id", "rewrite", F.concat_ws("|", "subs").alias("subs"))


@query("parse_intents", "SELECT event_id, 'n' || user_id % 30 AS intent, round(0.01 * (event_id % 100), 2) AS score FROM events WHERE event_id % 4 < 2 AND user_id % 30 < 25")
def parse_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = "concat('[{\"id\": \"n', user_id % 30, '\", \"score\": ', round(0.01 * (event_id % 100), 2), '}]')"
    body = f"if(user_id % 2 = 0, {one}, concat('{{\"results\": ', {one}, '}}'))"
    return enrich.intents(_answers(spark, sf_dir, body), t.taxonomy(spark, sf_dir), "event_id").select("event_id", "intent", F.round("score", 2).alias("score"))


@query("parse_hyperedges", "SELECT event_id, 'e' || user_id AS equipment, CAST(NULL AS VARCHAR) AS fault, 'k=' || event_type AS extended FROM events WHERE event_id % 4 < 2")
def parse_hyperedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('[{\"equipment\": \"e', user_id, '\", \"fault\": \" \", \"extendedEntities\": ', if(user_id % 2 = 0, concat('[{\"label\": \"k\", \"value\": \"', event_type, '\"}]'), concat('{\"k\": \"', event_type, '\"}')), '}]')"
    return enrich.hyperedges(_answers(spark, sf_dir, body), ["equipment", "fault"], "event_id").select("event_id", "equipment", "fault", "extended")


@query("parse_tool_params", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN user_id ELSE 5 END AS n, CASE WHEN event_id % 4 < 2 THEN event_type ELSE 'all' END AS region FROM events")
def parse_tool_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('{\"n\": ', user_id, ', \"region\": \"', event_type, '\", \"undeclared\": 1}')"
    return enrich.tool_parameters(_answers(spark, sf_dir, body), {"n": ("long", 5), "region": ("string", "all")}).select("event_id", "n", "region")


@query("parse_faq", "SELECT event_id AS source_doc, 'q ' || user_id AS question, 'a ' || event_type AS said FROM events WHERE event_id % 4 < 2")
def parse_faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('[{\"question\": \"q ', user_id, '\", \"answer\": \"a ', event_type, '\"}]')"
    return enrich.faqs(_answers(spark, sf_dir, body), "event_id").select("source_doc", "question", "said")


def _own_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that goes when the application ends."""
    made = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(made)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return made


def _as_lines(spark: SparkSession, rows: DataFrame) -> str:
    """Rows as JSON lines in the shared folder."""
    path = _own_folder(spark, "lines")
    rows.write.json(path)
    return path


@query("faq_ingest", """
WITH p AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user')
SELECT conv_id || ':' || turn AS source_doc, question || chr(10) || answer AS content FROM p WHERE trim(coalesce(question, '')) <> '' AND trim(coalesce(answer, '')) <> ''""")
def faq_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = t.table(spark, sf_dir, "conversations")
    answers = said.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = said.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(answers, ["conv_id", "turn"], "left")
    lines = pairs.select("question", "answer", F.lit("chat").alias("category"), F.concat_ws(":", "conv_id", "turn").alias("source_doc"))
    table = SnapshotTable(spark, _own_folder(spark, "faq"))
    table.replace(jsonl.faq(spark, _as_lines(spark, lines)))
    return table.read().select("source_doc", "content")


@query("hyperedge_load", "SELECT CAST(edge_id AS VARCHAR) AS edge, equipment, name FROM hyperedge")
def hyperedge_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = t.hyperedges(spark, sf_dir).select(F.col("edge_id").cast("string").alias("edgeId"), "equipment", "condition", "parameter", "fault", F.col("sop_doc").alias("sopDoc"), F.col("extended_entities").alias("extendedEntities"))
    loaded = jsonl.hyperedges(spark, _as_lines(spark, edges))
    return loaded.select(F.col("edgeId").alias("edge"), "equipment", F.get("extendedEntities", F.lit(0))["value"].alias("name"))


@query("image_desc_ingest", "SELECT sha256(url) AS chunk_id, 'page ' || page_id AS content, 'industrial_images' AS collection FROM pages")
def image_desc_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t.table(spark, sf_dir, "pages").select(F.col("url").alias("image_path"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("description"), F.lit("web").alias("category"))
    return jsonl.image_descriptions(spark, _as_lines(spark, pages), "industrial_images").select("chunk_id", "content", "collection")


@query("random_sample")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "benchmark").orderBy(F.rand(7)).limit(3)


@query("index_write", "SELECT doc_id, hash FROM snap_new WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id, hash FROM snap_old WHERE doc_id NOT IN (SELECT doc_id FROM snap_new) AND doc_id % 11 <> 0")
def index_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written, written again in part, and some deleted, each in one commit; the second commit comes twice."""
    root = _own_folder(spark, "index")
    old, new = (df.select("doc_id", "hash") for df in t.snapshots(spark, sf_dir))
    index.write(old, root, "first")
    index.write(new, root, "second")
    index.write(new.limit(1).withColumn("hash", F.lit("again")), root, "second")
    index.delete(_docs(spark, sf_dir).where("doc_id % 11 = 0"), root, old.schema)
    return index.read(spark, root, old.schema)


@query("image_rewrite", "SELECT sha256(url) AS chunk_id, 'page ' || page_id AS content, 'images' AS collection FROM pages WHERE page_id % 3 <> 0")
def image_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of images is cleared and written anew: nothing of the first writing stays."""
    root = _own_folder(spark, "images")
    pages = t.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("image_path"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("description"), F.lit("web").alias("category"))
    chunks = lambda rows: jsonl.image_descriptions(spark, _as_lines(spark, rows.drop("page_id")), "images").select("chunk_id", "content", "collection")
    first, second = chunks(pages), chunks(pages.where("page_id % 3 <> 0"))
    index.write(first, root)
    index.write(second, root, clear=True)
    return index.read(spark, root, second.schema, "chunk_id")


@query("evaluation_set", "SELECT 'item ' || item_id AS query, text AS golden_answer, CASE item_id % 4 WHEN 0 THEN 'fault' WHEN 1 THEN 'start' ELSE 'other' END AS scene FROM benchmark")
def evaluation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene = F.when(F.col("item_id") % 4 == 0, "fault").when(F.col("item_id") % 4 == 1, "start").otherwise("other")
    rows = t.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("query"), F.col("text").alias("golden_answer"), scene.alias("scene"))
    return jsonl.evaluation_set(spark, _as_lines(spark, rows))


@query("evaluation_report", "SELECT source AS scene, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY source UNION ALL SELECT NULL, count(*), round(avg(n_chars), 4) FROM documents")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary and its rows written as a report, and the summary read from it."""
    root = _own_folder(spark, "report")
    rows = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("scene"), "n_chars")
    jsonl.write_report(rows.rollup("scene").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean")), rows, root)
    return spark.read.schema("scene string, n long, mean double").json(f"{root}/summary")


@query("folder_refresh", "SELECT CAST(g AS VARCHAR) AS key, CASE WHEN g % 7 = 0 THEN 'new' WHEN g % 5 = 0 THEN 'changed' WHEN g % 5 = 1 THEN 'hash' ELSE 'header' END AS status FROM (SELECT DISTINCT page_id // 5 AS g FROM pages)")
def folder_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of five pages each, looked at twice: between the looks some are added, some changed and some written again as they were."""
    files, root = _own_folder(spark, "files"), _own_folder(spark, "looks")
    pages = t.table(spark, sf_dir, "pages").withColumn("g", F.expr("page_id div 5"))

    def put(rows: DataFrame) -> None:
        # Making files takes the time, not their bytes, so tasks go by cores.
        lines = rows.repartition(4 * spark.sparkContext.defaultParallelism, "g").sortWithinPartitions("g", "page_id").select("g", F.to_json(F.struct("page_id", "url", "html")).alias("value"))
        lines.write.partitionBy("g").option("partitionOverwriteMode", "dynamic").mode("overwrite").text(files)

    key = F.regexp_extract("path", "/g=([0-9]+)/", 1)
    put(pages.where("g % 7 <> 0"))
    folder.refreshed(spark, files, root, "*.txt", key)
    put(pages.where("g % 7 = 0 or g % 5 <= 1").withColumn("html", F.when((F.col("g") % 5 == 0) & (F.col("g") % 7 != 0), F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html"))))
    return folder.refreshed(spark, files, root, "*.txt", key).select("key", "status")
