"""Queries over questions, intents, the taxonomy, conditions and conditional pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import understanding as u
from skein.operators import vectors
from skein.plans.catalog import query
from skein.sources import tables as t


MOST_INTENTS = 10_000  # whose mean vectors go to all questions


def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, sub, intent, score: cosine of each question to the mean vector of every label. Labels are a configured list, and their means one small value beside the questions."""
    rows = t.vectors(spark, sf_dir)
    mean = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    lines = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("m"))
    known = lines.select(F.struct("label", "m", vectors.norm(F.col("m")).alias("length")).alias("s"))
    listed = F.collect_list("s")
    every = known.agg(F.when(F.count(F.lit(1)) > MOST_INTENTS, F.raise_error(F.lit(f"more than {MOST_INTENTS} intents")).cast("array<struct<label:int,m:array<double>,length:double>>")).otherwise(listed).alias("s"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v", vectors.norm(F.col("v")).alias("length")).withColumn("s", F.explode(every.scalar()))
    dot = F.aggregate(F.zip_with("v", F.col("s.m"), lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return asked.select("query_id", (F.col("query_id") % 4).alias("sub"), F.col("s.label").alias("intent"), F.round(dot / (F.col("length") * F.col("s.length")), 6).alias("score"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four questions as the sub-questions of one."""
    return query_intents(spark, sf_dir).select(F.expr("query_id div 80").alias("query_id"), "sub", "intent", "score").groupBy("query_id", "sub", "intent").agg(F.max("score").alias("score"))


GROUPED_SQL = "g AS (SELECT query_id // 80 AS query_id, sub, intent, max(score) AS score FROM query_intent GROUP BY 1, 2, 3)"


@query("intent_vector", "SELECT query_id, intent, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, intent) AS pos FROM query_intent WHERE score >= 0.05 QUALIFY pos <= 3")
def intent_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = query_intents(spark, sf_dir).where("score >= 0.05").withColumnRenamed("intent", "chunk_id")
    return vectors.ranked(rows, 3).select("query_id", F.col("chunk_id").alias("intent"), "score", F.col("pos").cast("long").alias("pos"))


@query("intent_quota", f"""
WITH {GROUPED_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub ORDER BY score DESC, intent) AS k FROM g WHERE score >= 0.05 QUALIFY k <= 3),
b AS (SELECT *, count(*) OVER w AS n, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER w AS firsts, row_number() OVER (PARTITION BY query_id, k = 1 ORDER BY score DESC, sub, intent) AS r FROM a WINDOW w AS (PARTITION BY query_id))
SELECT query_id, sub, intent, score FROM b WHERE n <= 6 OR k = 1 OR r <= 6 - firsts""")
def intent_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.quota(_grouped(spark, sf_dir), least=0.05, per_sub=3, total=6)


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("intent") % 4 == 3, F.lit(None)).otherwise(F.col("intent") % 4).cast("int")
    return _grouped(spark, sf_dir).withColumn("kind", kind).withColumn("tool_id", F.when(F.col("intent") < 5, F.lit("tool")).otherwise(" "))


KIND_SQL = f"WITH {GROUPED_SQL}, i AS (SELECT *, CASE WHEN intent % 4 = 3 THEN NULL ELSE intent % 4 END AS kind, CASE WHEN intent < 5 THEN 'tool' ELSE ' ' END AS tool_id FROM g) "


@query("intent_kind_filter", KIND_SQL + "SELECT query_id, sub, intent, 'KB' AS kind_name FROM i WHERE coalesce(kind, 0) = 0 AND score >= 0.05 UNION ALL SELECT query_id, sub, intent, 'MCP' FROM i WHERE kind = 2 AND trim(tool_id) <> ''")
def intent_kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _kinds(spark, sf_dir)
    pick = lambda df, name: df.select("query_id", "sub", "intent", F.lit(name).alias("kind_name"))
    return pick(u.kind_filter(rows, 0, 0.05), "KB").unionByName(pick(u.kind_filter(rows, 2), "MCP"))


@query("system_only", KIND_SQL + ", s AS (SELECT query_id, sub, count(*) = 1 AND bool_and(coalesce(kind, 0) = 1) AS one FROM i WHERE score >= 0.3 GROUP BY 1, 2) SELECT query_id, bool_and(one) AS system_only FROM s GROUP BY 1")
def system_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.system_only(_kinds(spark, sf_dir).where("score >= 0.3"))


@query("intent_ambiguity", f"""
WITH {GROUPED_SQL}, i AS (SELECT *, 'topic' || intent % 3 AS name, intent % 2 AS system FROM g WHERE score >= 0.01),
c AS (SELECT query_id, name, list_reverse_sort(list(score)) AS s, count(DISTINCT system) AS systems, max(score) AS top FROM i GROUP BY 1, 2)
SELECT query_id, name, systems, top FROM c WHERE len(s) >= 2 AND s[2] >= s[1] * 0.3 AND systems >= 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY top DESC, name) = 1""")
def intent_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir).withColumn("name", F.concat(F.lit("Topic "), (F.col("intent") % 3).cast("string"))).withColumn("system", F.col("intent") % 2)
    return u.ambiguous(rows, 0.3, 0.01)


@query("intent_guidance", f"""
WITH {GROUPED_SQL}, i AS (SELECT *, 'topic' || intent % 3 AS name, intent % 2 AS system FROM g WHERE score >= 0.01),
c AS (SELECT query_id, name, list_reverse_sort(list(score)) AS s, count(DISTINCT system) AS systems, max(score) AS top FROM i GROUP BY 1, 2),
f AS (SELECT query_id, name FROM c WHERE len(s) >= 2 AND s[2] >= s[1] * 0.3 AND systems >= 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY top DESC, name) = 1),
o AS (SELECT query_id, name, system, max(score) AS top FROM i JOIN f USING (query_id, name) GROUP BY 1, 2, 3)
SELECT query_id, name, CAST(row_number() OVER (PARTITION BY query_id ORDER BY top DESC, system) AS INTEGER) AS pos, system, CASE WHEN system = 0 THEN 'The Vision' ELSE 'Zebra Works' END AS system_name
FROM o WHERE query_id NOT IN (SELECT doc_id FROM documents WHERE contains(regexp_replace(lower(text), '[!-/:-@\\[-`{{-~\\s]+', '', 'g'), 'thevision'))""")
def intent_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir).withColumn("name", F.concat(F.lit("Topic "), (F.col("intent") % 3).cast("string"))).withColumn("system", F.col("intent") % 2)
    found = u.ambiguous(rows, 0.3, 0.01)
    named = rows.select("system").distinct().withColumn("system_name", F.when(F.col("system") == 0, "The Vision").otherwise("Zebra Works"))
    questions = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return u.guidance(found, rows, questions, named, 0.01)


@query("question_split", """
WITH s AS (SELECT conv_id, turn, text, [trim(p) || '?' FOR p IN regexp_split_to_array(text, '[?？。;；\\n]+') IF trim(p) <> ''] AS parts FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id, turn, CASE WHEN len(parts) > 0 THEN parts ELSE [text] END AS parts FROM s)
SELECT conv_id, turn, unnest(range(len(parts))) AS idx, unnest(parts) AS question FROM p""")
def question_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.posexplode(u.sub_questions(F.col("text"))).alias("idx", "question")).withColumn("idx", F.col("idx").cast("long"))


@query("term_normalize", "SELECT doc_id, replace(replace(replace(text, 'License', 'licence text'), 'the', 'THE'), 'tion', 'sion') AS text FROM documents")
def term_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "source_term string, target_term string, match_type int, priority int, enabled int"
    rules = spark.createDataFrame([("the", "THE", 1, 5, 1), ("License", "licence text", None, None, 1), ("tion", "sion", 1, 1, 1), ("of", "OF", 2, 9, 1), ("in", "IN", 1, 9, 0)], kind)
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("text", u.normalized_terms(F.col("text"), u.term_rules(rules)))


TREE_SQL = """WITH RECURSIVE d(ancestor, code, steps) AS (SELECT code, code, 0 FROM tree UNION ALL SELECT d.ancestor, c.code, d.steps + 1 FROM d JOIN tree c ON c.parent = d.code) """


@query("tree_paths", TREE_SQL + "SELECT d.code, string_agg(a.name, ' > ' ORDER BY d.steps DESC) AS path, CAST(count(*) AS INTEGER) AS depth FROM d JOIN tree a ON a.code = d.ancestor GROUP BY d.code")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.paths(t.taxonomy(spark, sf_dir))


@query("tree_leaves", "SELECT code, name FROM tree WHERE code NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL)")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.leaves(t.taxonomy(spark, sf_dir)).select("code", "name")


@query("tree_descendants", TREE_SQL + "SELECT ancestor, code, CAST(steps AS INTEGER) AS steps FROM d")
def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.descendants(t.taxonomy(spark, sf_dir))


@query("tree_system", TREE_SQL + ", e AS (SELECT c.code FROM tree c LEFT JOIN tree p ON p.code = c.parent WHERE p.code IS NULL OR (c.lvl = 1 AND p.lvl = 0)) SELECT d.code, min_by(d.ancestor, d.steps) AS system FROM d JOIN e ON e.code = d.ancestor GROUP BY d.code")
def tree_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.owning_system(t.taxonomy(spark, sf_dir))


@query("tree_cascade_check", TREE_SQL + ", ch AS (SELECT code FROM tree WHERE lvl = 0 OR (lvl = 1 AND name LIKE '%1%')) SELECT d.ancestor AS code, d.code AS child FROM d WHERE steps > 0 AND ancestor IN (SELECT code FROM ch) AND d.code NOT IN (SELECT code FROM ch) AND d.code IN (SELECT code FROM tree WHERE enabled = 1)")
def tree_cascade_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = t.taxonomy(spark, sf_dir)
    return u.cascade_violations(nodes, nodes.where("lvl = 0 or (lvl = 1 and name like '%1%')").select("code"), only_enabled=True)


RULE = {"any": [{"all": [{"field": "k", "operator": "gte", "value": 50}, {"field": "event_type", "operator": "in", "value": ["click", "view "]}]}, {"not": {"field": "event_type", "operator": "regex", "value": "[a-u].*"}}, {"field": "k", "value": " 7"}]}


@query("condition_filter", "SELECT event_id FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) WHERE (k >= 50 AND event_type IN ('click', 'view')) OR NOT (event_type >= 'a' AND event_type < 'v') OR k = 7")
def condition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return rows.where(u.condition(RULE)).select("event_id")


PIPE_SQL = """
WITH a AS (SELECT doc_id, lang, text AS t0, length(text) < 40 AS f1 FROM documents),
b AS (SELECT *, CASE WHEN f1 THEN t0 ELSE t0 || ' THE END' END AS t1 FROM a),
c AS (SELECT *, NOT f1 AND lang = 'en' AS d2 FROM b),
d AS (SELECT *, CASE WHEN d2 THEN replace(t1, 'THE', 'the') ELSE t1 END AS t2 FROM c) """


def _piped(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [
        ("close", None, lambda c: F.concat(c, F.lit(" THE END")), lambda c: F.length(c) < 40),
        ("soften", {"field": "lang", "value": "en"}, lambda c: F.replace(c, F.lit("THE"), F.lit("the")), lambda c: F.lit(False)),
    ]
    return u.run_pipeline(t.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), steps)


@query("pipeline_run", PIPE_SQL + "SELECT doc_id, CASE WHEN f1 THEN 'FAILED' ELSE 'DONE' END AS status, sha256(t2) AS hash, CASE WHEN f1 THEN 'close=failed' ELSE 'close=success,soften=' || CASE WHEN d2 THEN 'success' ELSE 'skipped' END END AS log FROM d")
def pipeline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.concat_ws(",", F.transform("log", lambda e: F.concat(e["step"], F.lit("="), e["status"])))
    return _piped(spark, sf_dir).select("doc_id", "status", F.sha2("text", 256).alias("hash"), log.alias("log"))


@query("step_log", """
WITH n AS (SELECT event_id, event_type AS kind, event_id % 7 <> 0 AS ok, CASE WHEN event_id % 5 = 0 THEN 'Skipped: no need' ELSE 'done' END AS message, user_id, props FROM events)
SELECT event_id, CASE WHEN NOT ok THEN 'failed' WHEN starts_with(message, 'Skipped:') THEN 'skipped' ELSE 'success' END AS status,
CASE kind WHEN 'click' THEN '{"user_id":' || user_id || '}' WHEN 'view' THEN '{"event_id":' || event_id || ',"user_id":' || user_id || '}' END AS output FROM n""")
def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.when(F.col("event_id") % 5 == 0, "Skipped: no need").otherwise("done")
    nodes = t.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), (F.col("event_id") % 7 != 0).alias("ok"), message.alias("message"), "user_id", "props")
    return u.step_log(nodes, {"click": ["user_id"], "view": ["event_id", "user_id"]}).select("event_id", "status", "output")
