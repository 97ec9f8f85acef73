"""Retrieval queries: channels, fusion, reranking, references, hypergraph and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import evaluate, fusion, hypergraph, quantised, vectors
from skein.plans.catalog import query
from skein.sources import tables as t
from skein.sources.snapshots import saved, spread

WEIGHTS = {"INTENT_DIRECTED": 1.0, "VECTOR_GLOBAL": 0.8}


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: rows whose id is divisible by 20."""
    return t.vectors(spark, sf_dir).where("vec_id % 20 = 0")


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels from one search, which keeps the best of every collection: the intent's own ones, and the best of all."""
    asked = questions(spark, sf_dir)
    hits = saved(vectors.top_k(t.vectors(spark, sf_dir), asked, 30, each="label").drop("pos"))
    wanted = asked.select(F.col("vec_id").alias("query_id"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("group")).distinct()
    own = vectors.ranked(hits.join(wanted, ["query_id", "group"], "left_semi").drop("group"), 20)
    return vectors.union_channels(("INTENT_DIRECTED", 1, own), ("VECTOR_GLOBAL", 3, vectors.ranked(hits.drop("group"), 30)))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(fusion.dedup(_channels(spark, sf_dir)), WEIGHTS)


@query("vec_normalize", "SELECT vec_id, i, round(x, 6) AS x FROM (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM unit)")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vectors.normalized(t.vectors(spark, sf_dir))
    return unit.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("vec_topk", "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM cosine QUALIFY pos <= 10")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(t.vectors(spark, sf_dir), questions(spark, sf_dir), 10).select("query_id", "chunk_id", "score", F.col("pos").cast("long").alias("pos"))


@query("vec_topk_ann")
def vec_topk_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.approximate_top_k(t.vectors(spark, sf_dir), questions(spark, sf_dir), 10)


@query("vec_topk_quantised")
def vec_topk_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.quantised_top_k(t.vectors(spark, sf_dir), questions(spark, sf_dir), 10).withColumn("pos", F.col("pos").cast("long"))


@query("channel_global", "SELECT query_id, chunk_id, label AS collection, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, chunk_id) AS pos FROM cosine QUALIFY pos <= 15")
def channel_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.vectors(spark, sf_dir)
    hits = vectors.top_k(rows, questions(spark, sf_dir), 15, each="label").drop("pos")
    with_label = hits.withColumn("collection", F.col("group").cast(rows.schema["label"].dataType))
    order = Window.partitionBy("query_id", "collection").orderBy(F.desc("score"), "chunk_id")
    return with_label.withColumn("pos", F.row_number().over(order).cast("long")).select("query_id", "chunk_id", "collection", "score", "pos")


@query("channel_image", "SELECT query_id, chunk_id, 'IMAGE_SEMANTIC' AS channel, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM cosine WHERE label = 0 QUALIFY pos <= 5")
def channel_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vectors.top_k(t.vectors(spark, sf_dir).where("label = 0"), questions(spark, sf_dir), 5)
    return hits.select("query_id", "chunk_id", F.lit("IMAGE_SEMANTIC").alias("channel"), "score", F.col("pos").cast("long").alias("pos"))


@query("channel_union", "SELECT * FROM channel_rows")
def channel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _channels(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))


@query("fusion_dedup", "SELECT query_id, chunk_id, channel, score, first_pos FROM deduped")
def fusion_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.dedup(_channels(spark, sf_dir)).select("query_id", "chunk_id", "channel", "score", F.col("first_pos").cast("long").alias("first_pos"))


@query("fusion_minmax", "SELECT query_id, chunk_id, channel, fused FROM fused")
def fusion_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", "chunk_id", "channel", "fused")


FUSION_SQL = "SELECT query_id, chunk_id, channel, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first_pos) AS rank FROM fused QUALIFY rank <= 10"


@query("fusion_topk", FUSION_SQL)
def fusion_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.first_n(_fused(spark, sf_dir), 10).select("query_id", "chunk_id", "channel", "fused", F.col("rank").cast("long").alias("rank"))


@query("rerank_noop", FUSION_SQL.replace("<= 10", "<= 5"))
def rerank_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.first_n(_fused(spark, sf_dir), 5).select("query_id", "chunk_id", "channel", "fused", F.col("rank").cast("long").alias("rank"))


@query("rerank_topn", """
WITH prior AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first_pos) AS prior FROM fused),
s AS (SELECT p.*, CASE WHEN chunk_id % 3 = 0 THEN chunk_id % 7 END AS relevance FROM prior p)
SELECT query_id, chunk_id, prior, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN relevance IS NULL THEN 1 ELSE 0 END, relevance DESC, prior) AS rank FROM s QUALIFY rank <= 5""")
def rerank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = _fused(spark, sf_dir)
    scores = fused.where("chunk_id % 3 = 0").select("query_id", "chunk_id", (F.col("chunk_id") % 7).alias("relevance")).distinct()
    return fusion.rerank(fused, scores, 5).select("query_id", "chunk_id", F.col("prior").cast("long").alias("prior"), F.col("rank").cast("long").alias("rank"))


@query("weak_retrieval", "SELECT query_id, max(score) AS best, count(*) AS n, max(score) < 0.4 AS weak FROM deduped GROUP BY query_id")
def weak_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.weak_retrieval(fusion.dedup(_channels(spark, sf_dir)))


@query("weak_gate", """
WITH r AS (SELECT query_id, max(CASE WHEN chunk_id % 4 <> 0 THEN score END) AS best, count(*) AS n FROM deduped WHERE score >= 0.35 GROUP BY query_id)
SELECT vec_id AS query_id, best, coalesce(n, 0) AS n, CASE WHEN vec_id % 60 = 0 THEN 'TOOL' WHEN n IS NULL THEN 'EMPTY' WHEN best >= 0.42 THEN 'KB' ELSE 'WEAK' END AS outcome FROM embeddings LEFT JOIN r ON query_id = vec_id WHERE vec_id % 20 = 0""")
def weak_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.dedup(_channels(spark, sf_dir)).where("score >= 0.35").withColumn("score", F.when(F.col("chunk_id") % 4 != 0, F.col("score")))
    questions = t.table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 60 == 0).alias("has_tool"))
    return fusion.weak_gate(rows, questions, 0.42)


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = fusion.first_n(_fused(spark, sf_dir), 10)
    return top.withColumn("text", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")))


@query("context_blocks", """
WITH r AS (SELECT query_id, chunk_id, channel, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first_pos) AS rank FROM fused QUALIFY rank <= 10)
SELECT query_id, string_agg('[' || channel || '] chunk ' || chunk_id, chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 3 GROUP BY query_id""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.context_blocks(_said(spark, sf_dir), 3)


@query("intent_chunks", """
WITH c AS (SELECT query_id % 4 AS sub, query_id // 80 AS query_id, chunk_id FROM deduped),
i AS (SELECT query_id // 80 AS query_id, sub, intent FROM query_intent WHERE score >= 0.1),
g AS (SELECT q.query_id, q.sub, coalesce(CAST(intent AS VARCHAR), 'shared') AS intent FROM (SELECT DISTINCT query_id, sub FROM c) q LEFT JOIN (SELECT DISTINCT * FROM i) i USING (query_id, sub)),
l AS (SELECT query_id, intent, max(sub) AS sub FROM g GROUP BY query_id, intent)
SELECT query_id, intent, sub, count(*) AS n, sum(chunk_id) AS ids FROM l JOIN c USING (query_id, sub) GROUP BY query_id, intent, sub""")
def intent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.plans.understanding import query_intents

    chunks = fusion.dedup(_channels(spark, sf_dir)).select(F.expr("query_id div 80").alias("query_id"), (F.col("query_id") % 4).alias("sub"), "chunk_id")
    intents = query_intents(spark, sf_dir).where("score >= 0.1").select(F.expr("query_id div 80").alias("query_id"), "sub", "intent").distinct()
    return fusion.intent_chunks(chunks, intents).groupBy("query_id", "intent", "sub").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_id").alias("ids"))


@query("prompt_plan", """
WITH f AS (SELECT query_id, bool_or(label < 3) AS has_kb, bool_or(label >= 5) AS has_tool, count(DISTINCT label) AS n_intents FROM intent_hits GROUP BY query_id)
SELECT query_id, CASE WHEN has_kb AND has_tool THEN 'MIXED' WHEN has_kb THEN 'KB_ONLY' WHEN has_tool THEN 'TOOL_ONLY' ELSE 'EMPTY' END AS plan,
CASE WHEN n_intents = 1 AND query_id % 40 = 0 THEN 'own template' ELSE CASE WHEN has_kb AND has_tool THEN 'MIXED' WHEN has_kb THEN 'KB_ONLY' WHEN has_tool THEN 'TOOL_ONLY' ELSE 'EMPTY' END END AS prompt FROM f""")
def prompt_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.vectors(spark, sf_dir)
    hits = vectors.top_k(rows, questions(spark, sf_dir), 20, same="label").join(rows.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id")
    flags = hits.groupBy("query_id").agg(F.bool_or(F.col("label") < 3).alias("has_kb"), F.bool_or(F.col("label") >= 5).alias("has_tool"), F.count_distinct("label").alias("n_intents"))
    return fusion.prompt_plan(flags.withColumn("template", F.when(F.col("query_id") % 40 == 0, "own template"))).select("query_id", "plan", "prompt")


@query("reference_rows", """
WITH r AS (SELECT query_id, chunk_id, channel, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first_pos) AS rank FROM fused QUALIFY rank <= 10)
SELECT r.query_id, r.chunk_id, 'TEXT' AS type, '文本引用' AS label, CASE WHEN length(d.text) > 200 THEN substring(d.text, 1, 200) || '...' ELSE d.text END AS snippet FROM r JOIN documents d ON d.doc_id = r.chunk_id""")
def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    top = fusion.first_n(_fused(spark, sf_dir), 10).join(docs, "chunk_id")
    return fusion.references(top).select("query_id", "chunk_id", "type", "label", "snippet")


@query("hyperedge_postings", "SELECT edge_id, entity FROM posting")
def hyperedge_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypergraph.postings(t.hyperedges(spark, sf_dir))


@query("hypergraph_match", """
WITH q AS (SELECT DISTINCT edge_id AS query_id, unnest([equipment, condition]) AS entity FROM hyperedge WHERE edge_id % 20 = 0),
n AS (SELECT query_id, count(*) AS asked FROM q GROUP BY query_id),
h AS (SELECT query_id, edge_id, count(*) AS hits FROM q JOIN posting USING (entity) GROUP BY query_id, edge_id)
SELECT query_id, edge_id, hits, round(hits / asked, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, edge_id) AS pos FROM h JOIN n USING (query_id) QUALIFY pos <= 10""")
def hypergraph_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = t.hyperedges(spark, sf_dir)
    asked = edges.where("edge_id % 20 = 0").select(F.col("edge_id").alias("query_id"), F.explode(F.array("equipment", "condition")).alias("entity")).distinct()
    return hypergraph.match(asked, hypergraph.postings(edges), 10)


@query("hyperedge_text", """
SELECT edge_id, concat_ws('; ', 'equipment ' || equipment, 'condition ' || condition, 'parameter ' || parameter, 'name ' || name) AS said, concat_ws(' → ', equipment, condition, parameter) AS path FROM hyperedge""")
def hyperedge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypergraph.described(t.hyperedges(spark, sf_dir)).select("edge_id", "said", "path")


@query("entity_extract", """
SELECT doc_id, entity, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(list_concat(regexp_extract_all(text, 'version [0-9]+'), [w FOR w IN ['License', 'token', 'th'] IF contains(text, w)]))) AS entity FROM documents) GROUP BY doc_id, entity""")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hypergraph.extract_entities(t.table(spark, sf_dir, "documents"), "text", ["version [0-9]+"], ["License", "token", "th"])
    return found.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("n"))


MARKS_SQL = "[\\s\\x0B，。！？、；：（）\\[\\]{}《》.,;:!?()<>/\\\\|_\\-—\"''\u3000]+"
EVAL_SQL = """
WITH q AS (SELECT item_id, item_id % 4 AS scene, text AS golden, list_distinct([w FOR w IN string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ') IF length(w) >= 7]) AS words FROM benchmark),
qw AS (SELECT item_id, unnest(words) AS word FROM q),
dw AS (SELECT DISTINCT doc_id, unnest([w FOR w IN string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ') IF length(w) >= 7]) AS word FROM documents),
s AS (SELECT item_id, doc_id, count(*) AS shared FROM qw JOIN dw USING (word) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM s QUALIFY rank <= 10),
h AS (SELECT r.item_id, r.doc_id, r.rank, contains(regexp_replace(d.text, '{marks}', '', 'g'), regexp_replace(q.golden, '{marks}', '', 'g')) AND regexp_replace(q.golden, '{marks}', '', 'g') <> '' AS hit FROM r JOIN q USING (item_id) JOIN documents d USING (doc_id)),
m AS (SELECT q.item_id, q.scene, coalesce(max(CASE WHEN hit AND rank <= 1 THEN 1 END), 0) AS hit1, coalesce(max(CASE WHEN hit AND rank <= 3 THEN 1 END), 0) AS hit3, coalesce(max(CASE WHEN hit AND rank <= 5 THEN 1 END), 0) AS hit5,
      coalesce(round(1.0 / min(CASE WHEN hit THEN rank END), 6), 0.0) AS rr FROM q LEFT JOIN h USING (item_id) GROUP BY q.item_id, q.scene)
""".replace("{marks}", MARKS_SQL)


def eval_retrieved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation items, and documents ranked per item by the number of shared long words."""
    items = t.table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 4).alias("scene"), F.col("text").alias("golden"))
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "text")
    return items, evaluate.rank_by_shared_words(items, docs, 10).join(spread(docs), "doc_id")


@query("eval_hits", EVAL_SQL + "SELECT item_id, doc_id, rank, hit FROM h")
def eval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by containment or by the ratio of matching characters. The SQL states containment alone: a hit by the ratio is none there."""
    items, found = eval_retrieved(spark, sf_dir)
    return evaluate.hits(found.join(items, "item_id")).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), "hit")


@query("eval_hits_similar")
def eval_hits_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by containment or by the ratio of matching characters."""
    items, found = eval_retrieved(spark, sf_dir)
    return evaluate.hits(found.join(items, "item_id")).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), "hit")


@query("channel_intent", """
WITH w AS (SELECT DISTINCT query_id, intent, CASE WHEN intent % 3 > 0 THEN intent % 3 * 4 ELSE 5 END AS k FROM query_intent WHERE score >= 0.1),
r AS (SELECT c.query_id, c.label AS collection, c.chunk_id, c.score, w.k, row_number() OVER (PARTITION BY c.query_id, c.label ORDER BY c.score DESC, c.chunk_id) AS pos FROM cosine c JOIN w ON w.query_id = c.query_id AND w.intent = c.label)
SELECT query_id, collection, chunk_id, score, pos FROM r WHERE pos <= k * 2""")
def channel_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the collections of a question's intents, twice as many as each intent's k."""
    rows = t.vectors(spark, sf_dir)
    intents = _intents_with_k(spark, sf_dir)
    asked = questions(spark, sf_dir).drop("label").join(intents.select(F.col("query_id").alias("vec_id"), F.col("intent").alias("label")), "vec_id")
    each = vectors.top_k(rows, asked, 16, same="label").join(rows.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("collection")), "chunk_id")
    hits = vectors.channel_intent(each.drop("pos"), intents, least=0.1, fallback=5)
    return hits.select("query_id", "collection", "chunk_id", "score", F.col("pos").cast("long").alias("pos"))


@query("sub_question_k", "SELECT query_id, coalesce(max(CASE WHEN k > 0 THEN k END), 10) AS k FROM (SELECT query_id, intent % 3 * 4 AS k FROM query_intent WHERE score >= 0.1) GROUP BY query_id")
def sub_question_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.sub_question_k(_intents_with_k(spark, sf_dir))


def _intents_with_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of at least 0.1, the k of some not set (0)."""
    from skein.plans.understanding import query_intents

    return query_intents(spark, sf_dir).where("score >= 0.1").withColumn("k", F.col("intent") % 3 * 4)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, found = eval_retrieved(spark, sf_dir)
    return evaluate.rank_metrics(items, evaluate.hits(found.join(items, "item_id"), ratio=None))


@query("eval_rank_metrics", EVAL_SQL + "SELECT item_id, scene, hit1, hit3, hit5, rr FROM m")
def eval_rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


@query("eval_summary", EVAL_SQL + "SELECT scene, count(*) AS n, round(avg(hit1), 4) AS hit1, round(avg(hit3), 4) AS hit3, round(avg(hit5), 4) AS hit5, round(avg(rr), 4) AS mrr FROM m GROUP BY GROUPING SETS ((), (scene))")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(_metrics(spark, sf_dir))


@query("eval_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id || ':7'), doc_id) AS k FROM documents) WHERE k <= 12")
def eval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.stratified_sample(t.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 12, 7)


@query("eval_ab", EVAL_SQL + "SELECT item_id, rr AS rr_a, CASE WHEN item_id % 3 = 0 THEN 0.0 ELSE rr END AS rr_b, round(CASE WHEN item_id % 3 = 0 THEN 0.0 ELSE rr END - rr, 6) AS delta FROM m")
def eval_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _metrics(spark, sf_dir)
    return evaluate.compare(a, a.withColumn("rr", F.when(F.col("item_id") % 3 == 0, 0.0).otherwise(F.col("rr"))))


@query("eval_judge_summary", "SELECT coalesce(round(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 4), 0.0) AS faithfulness, coalesce(round(avg(CASE WHEN event_type = 'never' THEN value END), 4), 0.0) AS relevancy FROM events")
def eval_judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = t.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("faithfulness"), F.when(F.col("event_type") == "never", F.col("value")).alias("relevancy"))
    return evaluate.judge_summary(scores, ["faithfulness", "relevancy"])


BM25_SQL = r"""
WITH dw AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '([\p{Han}\p{Hiragana}\p{Katakana}])', ' \1 ', 'g'), '[\p{L}\p{M}\p{N}]+')) AS word FROM documents),
qw AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(regexp_replace(lower(text), '([\p{Han}\p{Hiragana}\p{Katakana}])', ' \1 ', 'g'), '[\p{L}\p{M}\p{N}]+')) AS word FROM benchmark),
tf AS (SELECT doc_id, word, count(*) AS tf FROM dw GROUP BY 1, 2),
len AS (SELECT doc_id, count(*) AS len FROM dw GROUP BY 1),
whole AS (SELECT count(*) AS n, (SELECT count(*) FROM dw) / count(*) AS mean FROM documents),
idf AS (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, whole GROUP BY word, n),
s AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qw JOIN tf USING (word) JOIN idf USING (word) JOIN len USING (doc_id), whole GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10)
"""


def _bm25(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = t.table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 4).alias("scene"), F.col("text").alias("golden"))
    return items, evaluate.rank_by_bm25(items, t.table(spark, sf_dir, "documents").select("doc_id", "text"), 10)


@query("eval_bm25", BM25_SQL + "SELECT item_id, doc_id, rank, score FROM r")
def eval_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir)[1].select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


@query("eval_bm25_summary", BM25_SQL + r""", q AS (SELECT item_id, item_id % 4 AS scene, text AS golden FROM benchmark),
h AS (SELECT r.item_id, r.rank, contains(regexp_replace(d.text, '{marks}', '', 'g'), regexp_replace(q.golden, '{marks}', '', 'g')) AND regexp_replace(q.golden, '{marks}', '', 'g') <> '' AS hit FROM r JOIN q USING (item_id) JOIN documents d USING (doc_id)),
m AS (SELECT q.item_id, q.scene, coalesce(max(CASE WHEN hit AND rank <= 1 THEN 1 END), 0) AS hit1, coalesce(max(CASE WHEN hit AND rank <= 3 THEN 1 END), 0) AS hit3, coalesce(max(CASE WHEN hit AND rank <= 5 THEN 1 END), 0) AS hit5,
      coalesce(round(1.0 / min(CASE WHEN hit THEN rank END), 6), 0.0) AS rr FROM q LEFT JOIN h USING (item_id) GROUP BY q.item_id, q.scene)
SELECT scene, count(*) AS n, round(avg(hit1), 4) AS hit1, round(avg(hit3), 4) AS hit3, round(avg(hit5), 4) AS hit5, round(avg(rr), 4) AS mrr FROM m GROUP BY GROUPING SETS ((), (scene))""".replace("{marks}", MARKS_SQL))
def eval_bm25_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, found = _bm25(spark, sf_dir)
    docs = spread(t.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return evaluate.summary(evaluate.rank_metrics(items, evaluate.hits(found.join(docs, "doc_id").join(items, "item_id"), ratio=None)))
