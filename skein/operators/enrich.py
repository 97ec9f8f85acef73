"""Enrichment around an external model: request tables to send to it, and response tables read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """Slots {{key}} and {key} filled (null as empty), and three or more newlines as two."""
    filled = template
    for key, value in values.items():
        said = F.coalesce(value.cast("string"), F.lit(""))
        filled = F.replace(F.replace(filled, F.lit("{{" + key + "}}"), said), F.lit("{" + key + "}"), said)
    return F.regexp_replace(filled, r"\n{3,}", "\n\n")


def requests(rows: DataFrame, tasks: dict[str, str], text_col: str = "text", enhanced_col: str | None = None, raw_tasks: tuple[str, ...] = ("rewrite",)) -> DataFrame:
    """One request per row and task, its prompt rendered with the row's text; a blank template is the text itself, and rows without text ask for nothing.

    With `enhanced_col`, tasks other than `raw_tasks` take that text where it isn't blank.
    """
    table = F.array(*[F.struct(F.lit(k).alias("task"), F.lit(v).alias("template")) for k, v in tasks.items()])
    said = F.col(text_col)
    if enhanced_col is not None:
        said = F.when(~F.col("_t.task").isin(*raw_tasks) & F.col(enhanced_col).rlike(r"\S"), F.col(enhanced_col)).otherwise(said)
    asked = rows.withColumn("_t", F.explode(table)).withColumn("_said", said).where(F.col("_said").rlike(r"\S"))
    prompt = F.when(F.trim("_t.template") == "", F.col("_said")).otherwise(rendered(F.col("_t.template"), {"text": F.col("_said"), "content": F.col("_said")}))
    return asked.withColumn("task", F.col("_t.task")).withColumn("prompt", prompt).drop("_t", "_said")


def copied_metadata(chunk: Column, document: Column, attach: bool = True) -> Column:
    """A chunk's metadata with its document's put over it, unless that is switched off; null maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    own, given = F.coalesce(chunk, empty), F.coalesce(document, empty)
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(given, k)), given) if attach else own


def json_part(answer: Column) -> Column:
    """The answer without code fence, from the first opening to the last closing bracket; null if there are none."""
    bare = F.regexp_replace(answer, r"(?s)^\s*```[A-Za-z]*\s*\n?|\n?\s*```\s*$", "")
    found = F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1)
    return F.when(found != "", found)


def parsed(answers: DataFrame, schema: str, column: str = "answer", into: str = "value") -> DataFrame:
    """The answer's JSON by a schema; anything else is null."""
    return answers.withColumn(into, F.from_json(json_part(F.col(column)), schema, {"mode": "PERMISSIVE"}))


def merged(rows: DataFrame, responses: DataFrame, id_col: str, tasks: list[str]) -> DataFrame:
    """Results by task as columns of their row; a task without a result is null."""
    wide = responses.groupBy(id_col).pivot("task", tasks).agg(F.max("result"))
    return rows.join(wide, id_col, "left")


def rewrites(answers: DataFrame, fallback: str = "question") -> DataFrame:
    """rewrite and sub-questions; a blank rewrite is the fallback, no sub-questions are the rewrite."""
    value = parsed(answers, "rewrite string, sub_questions array<string>")
    said = F.coalesce(F.when(F.trim("value.rewrite") != "", F.trim("value.rewrite")), F.col(fallback))
    subs = F.filter(F.coalesce("value.sub_questions", F.array().cast("array<string>")), lambda s: s.isNotNull() & (F.trim(s) != ""))
    out = value.withColumn("rewrite", said).withColumn("_s", subs)
    return out.withColumn("subs", F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.array("rewrite"))).drop("value", "_s")


def intents(answers: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, intent, score) from an array of {id, score} or an object with `results`; unknown ids are dropped."""
    item = "array<struct<id:string,score:double>>"
    part = json_part(F.col("answer"))
    rows = F.coalesce(F.when(part.startswith("["), F.from_json(part, item)), F.from_json(part, f"results {item}")["results"])
    return answers.select(id_col, F.explode(rows).alias("r")).select(id_col, F.col("r.id").alias("intent"), F.col("r.score").alias("score")).join(nodes.select(F.col("code").alias("intent")), "intent", "left_semi")


def hyperedges(answers: DataFrame, slots: list[str], id_col: str) -> DataFrame:
    """One row per hyperedge of an answer; slots that are blank or no strings are null, extensions come as array or object."""
    part = json_part(F.col("answer"))
    listed = F.when(part.startswith("["), F.from_json(part, "array<string>")).when(part.isNotNull(), F.array(part))
    rows = answers.select(id_col, F.posexplode(listed).alias("edge", "body"))
    text = lambda name: F.get_json_object("body", f"$.{name}")
    slot = lambda name: F.when((F.trim(text(name)) != "") & ~text(name).rlike(r"^[\[{]"), text(name)).alias(name)
    extended = F.get_json_object("body", "$.extendedEntities")
    from_array = F.transform(F.from_json(extended, "array<struct<label:string,value:string>>"), lambda e: F.concat(e["label"], F.lit("="), e["value"]))
    from_object = F.transform(F.map_entries(F.from_json(extended, "map<string,string>")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    both = F.when(extended.startswith("["), from_array).when(extended.startswith("{"), from_object)
    return rows.select(id_col, "edge", *[slot(s) for s in slots], F.concat_ws(",", F.array_sort(both)).alias("extended"))


def tool_parameters(answers: DataFrame, declared: dict[str, tuple[str, object]]) -> DataFrame:
    """Declared parameters only, typed (whole numbers become ints), with defaults for missing ones."""
    part = json_part(F.col("answer"))
    out = answers
    for name, (kind, default) in declared.items():
        raw = F.get_json_object(part, f"$.{name}")
        out = out.withColumn(name, F.coalesce(raw.try_cast(kind), F.lit(default).cast(kind)))
    return out


def faqs(answers: DataFrame, source_col: str = "doc_id") -> DataFrame:
    """Question and answer pairs of the outermost [{...}] of an answer, with their source."""
    body = F.regexp_extract("answer", r"(?s)(\[\s*\{.*\}\s*\])", 1)
    rows = F.from_json(body, "array<struct<question:string,answer:string,category:string>>")
    return answers.select(F.col(source_col).alias("source_doc"), F.explode(rows).alias("f")).select("source_doc", "f.question", F.col("f.answer").alias("said"), "f.category")
