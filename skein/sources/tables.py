"""Readers, and the views over the driver's tables on which the queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _status(df: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "ERROR").otherwise("SUCCESS")
    return df.withColumns({"status": status, "duration_ms": F.floor(F.col("value") * 100).cast("long"), "start_time": F.col("ts")})


def trace_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(table(spark, sf_dir, "events")).select(F.col("event_id").alias("trace_id"), "user_id", "status", "duration_ms", "start_time")


def trace_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _status(table(spark, sf_dir, "events"))
    return rows.select(F.expr("event_id div 10").alias("trace_id"), F.col("event_id").alias("node_id"), (F.col("event_id") % 10).alias("depth"), "status", "duration_ms", "start_time")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_messages_of(table(spark, sf_dir, "events"))


def chat_messages_of(events: DataFrame) -> DataFrame:
    assistant = F.col("event_type").isin("purchase", "error")
    no_doc = assistant & (F.get_json_object("props", "$.k") == "0")
    return events.select(
        F.col("event_id").alias("message_id"), "user_id", F.col("ts").alias("create_time"),
        F.when(assistant, "assistant").otherwise("user").alias("role"), F.when(no_doc, 1).otherwise(0).alias("no_doc"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == "view").select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("create_time"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return votes.select((F.col("event_id") % 50).alias("message_id"), "user_id", F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("vote"), F.col("ts").alias("submit_time"), "event_id")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes_of(table(spark, sf_dir, "events"))


def votes_of(events: DataFrame) -> DataFrame:
    """Three votes on each message, one in three by a stranger, one in seven on a message that doesn't exist; the last two come at the same time."""
    rows = events.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    e = F.col("event_id")
    return rows.select(
        F.when(e % 7 == 0, -e).otherwise(e).alias("message_id"), F.when(e % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        ((F.col("n") + e) % 3 - 1).cast("int").alias("vote"), (F.col("ts") + F.when(F.col("n") > 0, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))).alias("submit_time"), (e * 3 + F.col("n")).alias("event_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = (
        t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey"))
        .join(t("region"), F.expr("n_regionkey = r_regionkey")).join(t("part"), F.expr("l_partkey = p_partkey")).join(t("supplier"), F.expr("l_suppkey = s_suppkey"))
    )
    return rows.select(
        F.col("r_name").alias("region"), F.col("p_brand").alias("product"), F.col("s_name").alias("sales_person"), F.col("c_name").alias("customer"),
        (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5).cast("decimal(16,0)") / 100).cast("decimal(18,2)").alias("amount"), F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber",
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey"))
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("closed")
    return rows.select(
        F.col("o_orderkey").alias("ticket_id"), F.col("r_name").alias("region"), F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("category"),
        F.col("o_orderpriority").alias("priority"), status.alias("status"), F.col("n_name").alias("engineer"), F.to_date("o_orderdate").alias("create_date"), F.col("c_nationkey").alias("product"),
    )


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    regions = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.lit(0).alias("lvl"), F.lit(1).alias("enabled"))
    nations = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("code"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.lit(1).alias("lvl"), F.when(F.col("n_nationkey") % 5 == 0, 0).otherwise(1).alias("enabled"))
    people = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("code"), key("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name"), F.lit(2).alias("lvl"), F.lit(1).alias("enabled"))
    return regions.unionByName(nations).unionByName(people)


def hyperedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.array(F.struct(F.lit("name").alias("label"), F.col("p_name").alias("value")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("edge_id"), F.col("p_brand").alias("equipment"), F.col("p_type").alias("condition"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("parameter"), F.lit(None).cast("string").alias("fault"), F.lit(None).cast("string").alias("sop_doc"), name.alias("extended_entities"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by line; the collection is the language and the knowledge base the source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("lang").alias("collection"), F.col("source").alias("kb_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 10 <> 0")
    new = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text")))
    with_hash = lambda df: df.withColumn("hash", F.sha2("text", 256))
    return with_hash(old), with_hash(new)
