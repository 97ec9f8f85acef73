"""Query understanding: terms, splitting, intents, the taxonomy, condition filters and conditional pipelines."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import terms
from skein.sources.snapshots import saved


def term_rules(mappings: DataFrame, most: int = 5000) -> list[tuple[str, str]]:
    """Enabled exact rules in the order of use: priority falling with nulls first, longer terms first. Rules are a small table."""
    usable = mappings.where((F.col("enabled") == 1) & F.coalesce(F.col("match_type") == 1, F.lit(True)) & (F.trim("source_term") != ""))
    order = [F.col("priority").desc_nulls_first(), F.length("source_term").desc(), F.col("source_term")]
    rows = usable.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [(r["source_term"], r["target_term"]) for r in rows]


def normalized_terms(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Each rule's term replaced from left to right, rule after rule; where its target already stands, it is passed over whole. All rules are looked for in one pass."""
    return terms.replaced(text, rules)


def sub_questions(text: Column) -> Column:
    """Parts between question marks, full stops, semicolons and newlines, each ending in a question mark; none is the text."""
    parts = F.filter(F.transform(F.split(text, r"[?？。;；\n]+"), F.trim), lambda p: p != "")
    asked = F.transform(parts, lambda p: F.concat(p, F.lit("?")))
    return F.when(F.size(asked) > 0, asked).otherwise(F.array(text))


def quota(intents: DataFrame, least: float = 0.35, per_sub: int = 3, total: int = 3) -> DataFrame:
    """Intents kept per question (query_id, sub, intent, score): at most `per_sub` in each sub-question; if all are more than `total`, the
    best of every sub-question and then the best of the rest."""
    inside = Window.partitionBy("query_id", "sub").orderBy(F.desc("score"), "intent")
    kept = intents.where(F.col("score") >= least).withColumn("_in", F.row_number().over(inside)).where(F.col("_in") <= per_sub)
    whole = Window.partitionBy("query_id")
    sized = kept.withColumn("_all", F.count(F.lit(1)).over(whole)).withColumn("_firsts", F.sum((F.col("_in") == 1).cast("int")).over(whole))
    rest = Window.partitionBy("query_id", F.col("_in") == 1).orderBy(F.desc("score"), "sub", "intent")
    ranked = sized.withColumn("_rest", F.row_number().over(rest))
    stays = (F.col("_all") <= total) | (F.col("_in") == 1) | (F.col("_rest") <= F.lit(total) - F.col("_firsts"))
    return ranked.where(stays).select("query_id", "sub", "intent", "score")


def kind_filter(intents: DataFrame, kind: int, least: float | None = None) -> DataFrame:
    """Intents of a kind (a null kind is 0); kind 2 needs a tool id."""
    rows = intents.where(F.coalesce("kind", F.lit(0)) == kind)
    if kind == 2:
        rows = rows.where(F.trim(F.coalesce("tool_id", F.lit(""))) != "")
    return rows if least is None else rows.where(F.col("score") >= least)


def system_only(intents: DataFrame) -> DataFrame:
    """Whether every sub-question has exactly one intent and that is a system one (kind 1)."""
    subs = intents.groupBy("query_id", "sub").agg(((F.count(F.lit(1)) == 1) & F.bool_and(F.coalesce("kind", F.lit(0)) == 1)).alias("_one"))
    return subs.groupBy("query_id").agg(F.bool_and("_one").alias("system_only"))


def plain_name(name: Column) -> Column:
    """A name in lower case without punctuation and blanks."""
    return F.regexp_replace(F.lower(name), r"[\p{Punct}\s]+", "")


def ambiguous(intents: DataFrame, ratio: float, least: float = 0.35) -> DataFrame:
    """Per question the best group of equally named intents of different systems whose second score is near the first.

    If `intents` has a column sub, only questions of a single sub-question count.
    """
    rows = intents.where((F.col("score") >= least) & (F.trim("name") != "")).withColumn("_name", plain_name(F.col("name")))
    if "sub" in intents.columns:
        single = intents.groupBy("query_id").agg(F.min("sub").alias("_lo"), F.max("sub").alias("_hi")).where("_lo = _hi").select("query_id")
        rows = rows.join(single, "query_id", "left_semi")
    groups = rows.groupBy("query_id", "_name").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("s"), F.count_distinct("system").alias("systems"), F.max("score").alias("top"))
    close = groups.where((F.size("s") >= 2) & (F.element_at("s", 1) > 0) & (F.element_at("s", 2) >= F.element_at("s", 1) * ratio) & (F.col("systems") >= 2))
    best = Window.partitionBy("query_id").orderBy(F.desc("top"), "_name")
    return close.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("query_id", F.col("_name").alias("name"), "systems", "top")


def guidance(found: DataFrame, intents: DataFrame, questions: DataFrame, systems: DataFrame, least: float = 0.35, options: int | None = None) -> DataFrame:
    """The systems to offer for each ambiguous question (rows of `ambiguous`), best score first; none if the question names one of them.

    `questions` has query_id and text, `systems` has system and system_name. A name of fewer than two characters, once plain, is never found in a question.
    """
    of = intents.where(F.col("score") >= least).select("query_id", plain_name(F.col("name")).alias("name"), "system", "score")
    offered = of.join(found.select("query_id", "name"), ["query_id", "name"], "left_semi").groupBy("query_id", "name", "system").agg(F.max("score").alias("_top"))
    ranked = offered.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_top"), "system"))).drop("_top")
    kept = ranked if options is None else ranked.where(F.col("pos") <= options)
    named = kept.join(systems.select("system", "system_name"), "system", "left").withColumn("system_name", F.coalesce(F.when(F.trim("system_name") != "", F.col("system_name")), F.col("system").cast("string")))
    asked = named.join(questions.select("query_id", plain_name(F.col("text")).alias("_said")), "query_id", "left")
    alias = plain_name(F.col("system_name"))
    names = (F.length(alias) >= 2) & F.coalesce(F.contains("_said", alias), F.lit(False))
    return asked.withColumn("_skip", F.max(names).over(Window.partitionBy("query_id"))).where(~F.col("_skip")).select("query_id", "name", "pos", "system", "system_name")


def lifted(nodes: DataFrame, value: Column, merge: Callable[[Column, Column], Column], stop: Column | None = None) -> DataFrame:
    """(code, value) of every node, its own value merged with those of the nodes above it, up to the first where `stop` holds, that one included.

    Pointers double: in every round a node takes over what the node it points to has gathered, and points where that one points, so a path of n nodes takes log2(n) rounds,
    each a join by the pointer, and finished nodes are joined no more. Parents that are no nodes end a path; a cycle is an error, found when pointers are left after as
    many rounds as a path of all nodes would take.
    """
    known = nodes.select(F.col("code").alias("_p"), F.lit(True).alias("_is"))
    linked = nodes.where("parent is not null").join(known, F.col("parent") == F.col("_p")).select("code", F.col("parent").alias("jump"))
    if stop is not None:
        linked = linked.join(nodes.where(stop).select("code"), "code", "left_anti")
    start = saved(nodes.select("code", value.alias("value")).join(linked, "code", "left"))
    parts, still = [start.where("jump is null")], start.where("jump is not null")
    for _ in range(_rounds(nodes) + 1):
        if still.isEmpty():
            return reduce(DataFrame.unionByName, parts).select("code", "value")
        above = reduce(DataFrame.unionByName, [*parts, still]).select(F.col("code").alias("jump"), F.col("value").alias("_value"), F.col("jump").alias("_jump"))
        now = saved(still.join(above, "jump").select("code", merge(F.col("value"), F.col("_value")).alias("value"), F.col("_jump").alias("jump")))
        parts.append(now.where("jump is null"))
        still = now.where("jump is not null")
    raise ValueError("the tree has a cycle")


def _rounds(nodes: DataFrame) -> int:
    """How often a pointer doubles until it is longer than a path of all nodes."""
    return max(1, nodes.count()).bit_length()


def descendants(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(ancestor, code, steps) for every node and itself, or for the ancestors with a code in `of`; nodes whose parent is missing are roots.

    Pairs of fewer than 2**k steps and the pointers 2**k steps up give those of fewer than 2**(k + 1), so a tree of depth n takes log2(n) rounds, and each pair is made once. A cycle is an error,
    found when pointers are left that are longer than a path of all nodes.
    """
    chosen = nodes.select("code") if of is None else nodes.select("code").join(of.select("code").distinct(), "code", "left_semi")
    jumps = saved(nodes.where("parent is not null").join(nodes.select(F.col("code").alias("parent")), "parent").select("code", F.col("parent").alias("jump")))
    out = chosen.select(F.col("code").alias("ancestor"), "code", F.lit(0).alias("steps"))
    for k in range(_rounds(nodes) + 1):
        if jumps.isEmpty():
            return out
        above = jumps.select(F.col("code").alias("jump"), F.col("jump").alias("_jump"))
        longer = saved(jumps.join(above, "jump").select("code", F.col("_jump").alias("jump")))
        below = jumps.join(out.withColumnRenamed("code", "jump"), "jump").select("ancestor", "code", (F.col("steps") + (1 << k)).alias("steps"))
        # The next round reads the pairs twice: they are saved unless this is the last.
        out = out.unionByName(below if longer.isEmpty() else saved(below))
        jumps = longer
    raise ValueError("the tree has a cycle")


def owning_system(nodes: DataFrame, domain: int = 0, category: int = 1) -> DataFrame:
    """(code, system): the nearest category at the top or under a domain, seen from the node upwards, itself included; else the root."""
    above = nodes.select(F.col("code").alias("_p"), F.col("lvl").alias("_above"))
    marked = nodes.join(above, F.col("parent") == F.col("_p"), "left")
    ends = F.col("_p").isNull() | ((F.col("lvl") == category) & (F.col("_above") == domain))
    own = saved(marked.select("code", "parent", ends.alias("_end")))
    return lifted(own, F.when(F.col("_end"), F.col("code")), F.coalesce, F.col("_end")).withColumnRenamed("value", "system")


def paths(nodes: DataFrame) -> DataFrame:
    """code and its path `root > … > node`."""
    line = lifted(nodes, F.array("name"), lambda own, above: F.concat(above, own))
    return line.select("code", F.concat_ws(" > ", "value").alias("path"), F.size("value").alias("depth"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.where("parent is not null").select(F.col("parent").alias("code")).distinct(), "code", "left_anti")


def cascade_violations(nodes: DataFrame, chosen: DataFrame, only_enabled: bool) -> DataFrame:
    """(code, child): descendants of chosen nodes that aren't chosen (and, to disable, are enabled): each refuses the change."""
    below = descendants(nodes, chosen).where("steps > 0")
    open_ones = nodes.where("enabled = 1") if only_enabled else nodes
    return below.join(open_ones.select("code"), "code", "left_semi").join(chosen.select("code"), "code", "left_anti").select(F.col("ancestor").alias("code"), F.col("code").alias("child"))


def condition(rule: object, fields: Callable[[str], Column] = F.col) -> Column:
    """A JSON condition as a Column: true/false, all, any, not, or {field, operator, value}.

    Equality trims strings. An ordered comparison with something that isn't a number compares as equal, so gte and lte hold.
    """
    if isinstance(rule, str):
        rule = json.loads(rule)
    if rule is None:
        return F.lit(True)
    if isinstance(rule, bool):
        return F.lit(rule)
    if isinstance(rule, dict) and "all" in rule:
        return reduce(lambda a, b: a & b, [condition(r, fields) for r in rule["all"]], F.lit(True))
    if isinstance(rule, dict) and "any" in rule:
        return reduce(lambda a, b: a | b, [condition(r, fields) for r in rule["any"]], F.lit(False))
    if isinstance(rule, dict) and "not" in rule:
        return ~condition(rule["not"], fields)
    if not isinstance(rule, dict) or "field" not in rule:
        raise ValueError(f"no condition: {rule!r}")
    value, asked = fields(rule["field"]).cast("string"), rule.get("value")
    op = str(rule.get("operator", "eq")).lower()
    if op == "exists":
        return value.isNotNull()
    if op == "not_exists":
        return value.isNull()
    sign = lambda other: F.coalesce(F.signum(value.try_cast("double") - F.lit(str(other)).try_cast("double")), F.lit(0.0))
    same = lambda other: F.coalesce(F.trim(value) == F.trim(F.lit(str(other))), F.lit(False))
    tests = {
        "ne": lambda: ~same(asked), "in": lambda: reduce(lambda a, b: a | b, [same(x) for x in asked], F.lit(False)), "contains": lambda: F.coalesce(F.contains(value, F.lit(str(asked))), F.lit(False)),
        "regex": lambda: F.coalesce(value.rlike(f"^(?:{asked})$"), F.lit(False)), "gt": lambda: sign(asked) > 0, "gte": lambda: sign(asked) >= 0, "lt": lambda: sign(asked) < 0, "lte": lambda: sign(asked) <= 0,
    }
    return tests.get(op, lambda: same(asked))()


Step = tuple[str, object, Callable[[Column], Column], Callable[[Column], Column]]


def run_pipeline(docs: DataFrame, steps: list[Step], column: str = "text") -> DataFrame:
    """Steps (name, condition, transform of the column, failure test) over a document table, in order.

    A false condition skips the step; a failure stops the row there. `log` holds one (step, status) for each step a row reached.
    """
    out = docs.withColumn("status", F.lit("RUNNING")).withColumn("log", F.array().cast("array<struct<step:string,status:string>>"))
    for name, rule, change, fails in steps:
        live, wanted, bad = F.col("status") == "RUNNING", condition(rule), fails(F.col(column))
        out = out.withColumn("_do", live & wanted).withColumn("_bad", F.col("_do") & bad)
        state = F.when(F.col("_bad"), "failed").when(F.col("_do"), "success").otherwise("skipped")
        entry = F.array(F.struct(F.lit(name).alias("step"), state.alias("status")))
        out = out.withColumn("log", F.when(live, F.concat("log", entry)).otherwise(F.col("log")))
        out = out.withColumn(column, F.when(F.col("_do") & ~F.col("_bad"), change(F.col(column))).otherwise(F.col(column)))
        out = out.withColumn("status", F.when(F.col("_bad"), "FAILED").otherwise(F.col("status"))).drop("_do", "_bad")
    return out.withColumn("status", F.when(F.col("status") == "RUNNING", "DONE").otherwise(F.col("status")))


def step_log(nodes: DataFrame, kept: dict[str, list[str]], most: int = 1 << 20) -> DataFrame:
    """Status of each step row and its output: the fields kept for its kind, as JSON cut at `most` characters."""
    status = F.when(~F.col("ok"), "failed").when(F.col("message").startswith("Skipped:"), "skipped").otherwise("success")
    chain = F.lit(None).cast("string")
    for kind, columns in kept.items():
        chain = F.when(F.col("kind") == kind, F.to_json(F.struct(*columns))).otherwise(chain)
    return nodes.withColumn("status", status).withColumn("output", F.substring(chain, 1, most))
