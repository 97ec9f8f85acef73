"""The knowledge index kept up to date: rows of the index, deletion, replacement, upserts, diffs and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTENT_LIMIT = 65_535


def index_rows(chunks: DataFrame, dimension: int | None = None) -> DataFrame:
    """Rows to be written to the index: content cut at the store's limit; a vector of a wrong dimension, or a missing one, is an error."""
    rows = chunks.withColumn("content", F.substring("content", 1, CONTENT_LIMIT))
    if dimension is not None:
        wrong = F.raise_error(F.concat(F.lit("a vector has "), F.coalesce(F.size("embedding").cast("string"), F.lit("no")), F.lit(f" components, not {dimension}")))
        rows = rows.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(wrong.cast(rows.schema["embedding"].dataType)))
    return rows.withColumn("id", F.sha2(F.concat_ws(":", F.col("collection"), F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256))


def metadata(document: Column, chunk: Column, fields: list[str]) -> Column:
    """The configured fields; a chunk's value goes before its document's."""
    both = F.map_concat(F.map_filter(document, lambda k, _: ~F.map_contains_key(chunk, k)), chunk)
    return F.map_filter(both, lambda k, _: k.isin(*fields))


def typed_metadata(document: Column, chunk: Column, fields: list[str]) -> Column:
    """The configured fields of two VARIANT objects as one; numbers, lists and nested objects keep their types.

    A chunk's value goes before its document's, whole. A field that is absent or null in the chunk is taken from the document, one that neither has is left out.
    Names of fields may hold one kind of quotation marks.
    """

    def given(of: Column, field: str) -> Column:
        value = F.try_variant_get(of, f'$["{field}"]' if "'" in field else f"$['{field}']", "variant")
        return F.when(~F.is_variant_null(value), value)

    pairs = [x for f in fields for x in (F.lit(f), F.coalesce(given(chunk, f), given(document, f)))]
    return F.to_variant_object(F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull()))


def deleted(index: DataFrame, keys: DataFrame, on: str = "doc_id") -> DataFrame:
    return index.join(keys.select(on).distinct(), on, "left_anti")


def replaced(existing: DataFrame, new: DataFrame, on: str = "doc_id") -> DataFrame:
    """The rows of `new`, and those of `existing` whose key isn't among them."""
    return deleted(existing, new, on).unionByName(new)


def upserts(existing: DataFrame, new: DataFrame, key: str = "doc_id", content: str = "hash") -> DataFrame:
    """Rows of `new` that insert or change something, with the action."""
    old = existing.select(key, F.col(content).alias("_old"))
    both = new.join(old, key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col(content)))
    return both.withColumn("action", F.when(F.col("_old").isNull(), "insert").otherwise("update")).drop("_old")


def enabled_diff(index: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Keys to add to the index and to take from it."""
    add = wanted.select(key).join(index.select(key), key, "left_anti").withColumn("action", F.lit("add"))
    return add.unionByName(index.select(key).join(wanted.select(key), key, "left_anti").withColumn("action", F.lit("remove")))


def toggle_outcome(requests: DataFrame, chunks: DataFrame, documents: DataFrame, most: int = 500) -> DataFrame:
    """What becomes of each request to enable or disable chunks of a document, and how many chunks it changes.

    `requests` has request_id, doc_id, chunk_id and enable (one row per chunk asked for), `chunks` has chunk_id, doc_id and enabled, `documents` has doc_id,
    status and enabled. A request is refused as a whole: for more than `most` ids, an unknown document, one that is being worked on, enabling in a
    disabled document, ids that do not exist or come twice, chunks of another document, or if nothing would change.
    """
    known = chunks.select("chunk_id", F.col("doc_id").alias("_owner"), F.col("enabled").alias("_now"))
    asked = requests.join(known, "chunk_id", "left")
    per = asked.groupBy("request_id", "doc_id", "enable").agg(
        F.count(F.lit(1)).alias("_asked"), F.count_distinct(F.when(F.col("_owner").isNotNull(), F.col("chunk_id"))).alias("_found"),
        F.count_if(F.col("_owner") != F.col("doc_id")).alias("_others"), F.count_if(F.col("_now") != F.col("enable")).alias("changed"),
    )
    both = per.join(documents.select("doc_id", F.col("status").alias("_status"), F.col("enabled").alias("_on")), "doc_id", "left")
    outcome = (
        F.when(F.col("_asked") > most, "TOO_MANY").when(F.col("_on").isNull(), "NO_DOCUMENT").when(F.col("_status") == "RUNNING", "RUNNING")
        .when((F.col("enable") == 1) & (F.col("_on") == 0), "DOCUMENT_DISABLED").when(F.col("_found") != F.col("_asked"), "UNKNOWN_CHUNK")
        .when(F.col("_others") > 0, "OTHER_DOCUMENT").when(F.col("changed") == 0, "UNCHANGED").otherwise("DONE")
    )
    return both.select("request_id", "doc_id", "enable", outcome.alias("outcome"), F.when(outcome == "DONE", F.col("changed")).otherwise(F.lit(0)).cast("long").alias("changed"))


def toggled(requests: DataFrame, chunks: DataFrame, documents: DataFrame, most: int = 500) -> DataFrame:
    """The chunk rows that the accepted requests change, with the action on the index: add (to be embedded again from the stored text) or remove."""
    accepted = toggle_outcome(requests, chunks, documents, most).where("outcome = 'DONE'").select("request_id")
    wanted = requests.join(accepted, "request_id", "left_semi").select("chunk_id", "enable")
    return chunks.join(wanted, "chunk_id").where("enabled <> enable").withColumn("action", F.when(F.col("enable") == 1, "add").otherwise("remove")).drop("enable")


def fetch_status(known: DataFrame, fetched: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whether each fetched file (etag, modified, hash) is new, changed, or to be skipped: by its header, if the entity tag or the time of change is the known one
    (blank ones never are), else by an equal hash of its content. A skip by header does not look at the hash."""
    kept = lambda c: F.when(F.trim(c) != "", F.trim(c))
    old = known.select(key, kept("etag").alias("_etag"), kept("modified").alias("_modified"), kept("hash").alias("_hash"), F.lit(1).alias("_known"))
    both = fetched.join(old, key, "left")
    same = lambda c, o: F.coalesce(kept(c) == F.col(o), F.lit(False))
    status = F.when(same("etag", "_etag") | same("modified", "_modified"), "header").when(same("hash", "_hash"), "hash").when(F.col("_known").isNull(), "new").otherwise("changed")
    return both.select(key, status.alias("status"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "doc_id", content: str = "hash") -> DataFrame:
    """Status of every key of two snapshots: new, removed, same or changed."""
    both = old.select(key, F.col(content).alias("_o")).join(new.select(key, F.col(content).alias("_n")), key, "full_outer")
    status = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "same").otherwise("changed")
    return both.select(key, status.alias("status"))


def due(schedules: DataFrame, now: Column, n: int = 20) -> DataFrame:
    """Enabled schedules whose next run is open or past and that nobody holds, the most overdue first."""
    ready = (F.col("enabled") == 1) & (F.col("next_run").isNull() | (F.col("next_run") <= now)) & (F.col("lock_until").isNull() | (F.col("lock_until") < now))
    return schedules.where(ready).orderBy(F.col("next_run").asc_nulls_first(), "schedule_id").limit(n)


def stuck(runs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Runs that are RUNNING without an update for the timeout (ten minutes at least) become FAILED."""
    old = (F.col("status") == "RUNNING") & (F.col("update_time") < now - F.expr(f"INTERVAL {max(minutes, 10)} MINUTES"))
    return runs.withColumn("status", F.when(old, "FAILED").otherwise(F.col("status")))


def schedule_state(log: DataFrame, error_chars: int = 500) -> DataFrame:
    """The current state per schedule: its last outcome, its last success (a skip keeps it) and the last error, cut."""
    newest = F.struct("at", "run_id")
    return log.groupBy("schedule_id").agg(
        F.max_by("outcome", newest).alias("last_outcome"), F.max(F.when(F.col("outcome") == "success", F.col("at"))).alias("last_success"),
        F.substring(F.max_by("error", F.when(F.col("error").isNotNull(), newest)), 1, error_chars).alias("last_error"), F.count(F.lit(1)).alias("runs"),
    )


def spans(events: DataFrame, error_chars: int = 1000) -> DataFrame:
    """Start and finish events folded to one row per span; without a finish it is RUNNING."""
    finish = lambda c: F.max(F.when(F.col("phase") == "finish", F.col(c)))
    out = events.groupBy("trace_id", "node_id").agg(F.min(F.when(F.col("phase") == "start", F.col("at"))).alias("start_time"), finish("at").alias("end_time"), finish("status").alias("_s"), F.substring(finish("error"), 1, error_chars).alias("error"))
    return out.withColumn("status", F.coalesce("_s", F.lit("RUNNING"))).drop("_s")


def latest_images(descriptions: DataFrame, meta: DataFrame) -> DataFrame:
    """Descriptions with url and licence of their image; missing ones are empty, of repeated metadata the last counts."""
    last = meta.withColumn("_k", F.row_number().over(Window.partitionBy("image_path").orderBy(F.desc("line")))).where("_k = 1")
    return descriptions.join(last.select("image_path", "source_url", "license"), "image_path", "left").fillna("", ["source_url", "license"])
