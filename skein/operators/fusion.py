"""What follows retrieval: deduplication, fusion, reranking, the weak-retrieval gate, context and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup(rows: DataFrame) -> DataFrame:
    """One row per question and chunk: the higher score, on ties the earlier channel; the first position stays.

    Rows hold query_id, channel, priority, pos, chunk_id, score, and possibly text: a chunk without an id is known by its text.
    """
    key = F.coalesce(F.col("chunk_id").cast("string"), F.sha2("text", 256)) if "text" in rows.columns else F.col("chunk_id").cast("string")
    keyed = rows.withColumn("_key", key)
    same = Window.partitionBy("query_id", "_key")
    best = keyed.withColumn("_k", F.row_number().over(same.orderBy(F.desc("score"), "priority", "pos"))).withColumn("first_pos", F.min(F.col("priority") * 1000000 + F.col("pos")).over(same))
    return best.where("_k = 1").drop("_k", "_key")


def fuse(rows: DataFrame, weights: dict[str, float], enabled: bool = True, digits: int = 6) -> DataFrame:
    """Scores scaled to 0..1 within each question's source and multiplied by the source's weight (1 if unknown).

    A source is the row's own `source`, else its channel. One row alone, or equal scores, keep the raw score times the weight.
    """
    if not enabled:
        return rows.withColumn("fused", F.col("score"))
    source = F.coalesce(F.col("source"), F.col("channel")) if "source" in rows.columns else F.col("channel")
    weight: Column = F.lit(1.0)
    for name, value in weights.items():
        weight = F.when(source == name, value).otherwise(weight)
    group = Window.partitionBy("query_id", "_source")
    sized = rows.withColumn("_source", source).withColumns({"_lo": F.min("score").over(group), "_hi": F.max("score").over(group), "_n": F.count(F.lit(1)).over(group)})
    scaled = F.when((F.col("_n") == 1) | (F.col("_hi") == F.col("_lo")), F.col("score")).otherwise((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return sized.withColumn("fused", F.round(weight * scaled, digits)).drop("_source", "_lo", "_hi", "_n")


def first_n(rows: DataFrame, n: int, by: str = "fused") -> DataFrame:
    """The first n rows of each question: by score descending, then first position."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "first_pos")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rerank(rows: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """Rows in the order of an external scorer (query_id, chunk_id, relevance), n per question.

    With at most n rows a question keeps its order. Scores for unknown chunks are ignored; unscored rows follow in their prior order.
    """
    prior = rows.dropDuplicates(["query_id", "chunk_id"]).withColumns({
        "prior": F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "first_pos")),
        "_all": F.count(F.lit(1)).over(Window.partitionBy("query_id")),
    })
    scored = prior.join(scores, ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy(
        F.when(F.col("_all") <= n, F.col("prior")), F.when(F.col("relevance").isNotNull(), 0).otherwise(1), F.desc_nulls_last("relevance"), "prior"
    )
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("_all")


def weak_retrieval(rows: DataFrame, least: float = 0.4) -> DataFrame:
    """Questions whose best score is below `least`."""
    return rows.groupBy("query_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n")).withColumn("weak", F.col("best") < least)


def weak_gate(rows: DataFrame, questions: DataFrame, least: float = 0.4) -> DataFrame:
    """What each of `questions` (query_id, has_tool) is answered from: TOOL (a tool's result, whatever the scores), KB, or nothing, because
    no chunk was found (EMPTY) or the best score is below `least` (WEAK; chunks without a score count as weak)."""
    best = rows.groupBy("query_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"))
    outcome = F.when(F.col("has_tool"), "TOOL").when(F.col("n").isNull(), "EMPTY").when(F.coalesce(F.col("best") < least, F.lit(True)), "WEAK").otherwise("KB")
    return questions.select("query_id", "has_tool").join(best, "query_id", "left").select("query_id", "best", F.coalesce("n", F.lit(0)).alias("n"), outcome.alias("outcome"))


def context_blocks(rows: DataFrame, k: int, rules: DataFrame | None = None) -> DataFrame:
    """Per question the text of its first k chunks with their source, joined by newlines, after its numbered rules."""
    line = F.concat(F.lit("["), F.col("channel"), F.lit("] "), F.col("text"))
    body = rows.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l")).select("query_id", F.concat_ws("\n", F.transform("_l", lambda x: x["line"])).alias("context"))
    if rules is None:
        return body
    numbered = rules.groupBy("query_id").agg(F.array_sort(F.collect_set("rule")).alias("_r")).select("query_id", F.concat_ws("\n", F.transform("_r", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r))).alias("_rules"))
    return body.join(numbered, "query_id", "left").select("query_id", F.concat_ws("\n", "_rules", "context").alias("context"))


def intent_chunks(chunks: DataFrame, intents: DataFrame) -> DataFrame:
    """Chunks of every sub-question for each of its intents; of one intent's, the last sub-question's stay. Without intents: a shared key."""
    given = chunks.select("query_id", "sub").distinct().join(intents.select("query_id", "sub", "intent"), ["query_id", "sub"], "left")
    keyed = given.select("query_id", "sub", F.coalesce(F.col("intent").cast("string"), F.lit("shared")).alias("intent"))
    last = keyed.groupBy("query_id", "intent").agg(F.max("sub").alias("sub"))
    return last.join(chunks, ["query_id", "sub"])


def prompt_plan(questions: DataFrame) -> DataFrame:
    """Which prompt a question gets, from has_kb, has_tool, n_intents and the single intent's own template."""
    plan = F.when(F.col("has_kb") & F.col("has_tool"), "MIXED").when(F.col("has_kb"), "KB_ONLY").when(F.col("has_tool"), "TOOL_ONLY").otherwise("EMPTY")
    own = (F.col("n_intents") == 1) & (F.coalesce(F.trim("template"), F.lit("")) != "")
    return questions.withColumn("plan", plan).withColumn("prompt", F.when(own, F.col("template")).otherwise(plan))


# What a reference of each type is called.
REFERENCE_LABELS = {"IMAGE": "设备图纸", "HYPERGRAPH": "推理路径", "TEXT": "文本引用"}


def references(rows: DataFrame, snippet: int = 200, url_prefix: str = "/files") -> DataFrame:
    """Reference type, label and snippet of retrieved rows; images with a blank, absolute or climbing path are dropped.

    With image_path, an image's label tells its path, and url is where it is served, each part of the path encoded.
    """
    kind = F.when(F.col("channel") == "IMAGE_SEMANTIC", "IMAGE").when(F.col("channel") == "HYPERGRAPH", "HYPERGRAPH").otherwise("TEXT")
    cut = F.when(F.length("text") > snippet, F.concat(F.substring("text", 1, snippet), F.lit("..."))).otherwise(F.col("text"))
    labels = F.create_map(*[F.lit(x) for pair in REFERENCE_LABELS.items() for x in pair])
    typed = rows.withColumn("type", kind).withColumn("snippet", cut).withColumn("label", labels[F.col("type")])
    if "image_path" in rows.columns:
        path = F.coalesce(F.trim("image_path"), F.lit(""))
        typed = typed.where((F.col("type") != "IMAGE") | ~((path == "") | path.startswith("/") | path.rlike(r"^[A-Za-z]:") | path.contains("..")))
        image = F.col("type") == "IMAGE"
        encoded = F.concat_ws("/", F.transform(F.split("image_path", "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))))
        typed = typed.withColumn("label", F.when(image, F.concat_ws(": ", "label", "image_path")).otherwise(F.col("label"))).withColumn("url", F.when(image, F.concat(F.lit(url_prefix + "/"), encoded)))
    return typed
