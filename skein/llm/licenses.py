"""Licence scan: the units of every whole text against licence templates, by the Dice coefficient of their word bigrams.

A unit and a template are normalised alike (lower case, runs of other characters than letters and digits become blanks) and compared as sets of word
bigrams: 2 |A and B| / (|A| + |B|). A template can reach the threshold t only if the sizes lie within t / (2 - t) of each other,
so size bounds leave few templates per unit. The same bound says how many bigrams of a template a match must contain; words that touch
enough of its bigrams are its anchors, and a unit without any anchor word can't match. Everything is one narrow pass of DataFrame functions:
no shuffle, no Python.

Templates are short notices, the paragraphs of licences and whole licences. Units are lines; paragraphs (between blank lines) that have several
lines; sentences that are no whole line or paragraph; and passages, runs of paragraphs, which are compared with whole licences only. One row per matching unit with its best template (the
highest coefficient, then the template's name); of a document's passages, which overlap, one per licence: the one with the highest coefficient, then
the first, then the shortest.

Edge cases: null and empty texts, and units of one word, have no match; very long lines are units like others, of which the distinct words are counted before
bigrams are made; ties are resolved as said above; repeated rows give repeated results, and a row with a null id results with a null id; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.license_texts import LICENCES, NOTICES

THRESHOLD = 0.8
LEAST_WORDS = 8  # of a licence's paragraph that is a template of its own

# Words of everyday prose, the last to serve as anchors.
COMMON_WORDS = set("a an and any are as at be been but by can copy even file for form free from had has have if in is it its law may means more must name no not of on one or other out program see shall should source such terms that the their them they this to use was we were which will with without work would you your".split())


def paragraphs_of(text: str) -> list[str]:
    return [p for p in re.split(r"\n\s*\n", text.strip()) if p.strip()]


def all_templates() -> list[tuple[str, str, bool]]:
    """Notices, the longer paragraphs of licences, and whole licences, each once, and whether they have several paragraphs."""
    parts = [(name, p, False) for name, text in LICENCES for p in paragraphs_of(text) if len(p.split()) >= LEAST_WORDS]
    whole = [(name, " ".join(text.split()), True) for name, text in LICENCES if len(paragraphs_of(text)) > 1]
    return list(dict.fromkeys([(name, text, False) for name, text in NOTICES] + parts + whole))


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchors(bigrams: list[str], threshold: float) -> set[str]:
    """Words, uncommon and long ones first, that touch so many bigrams that a match must contain one of them."""
    need = len(bigrams) - math.ceil(round(threshold / (2 - threshold) * len(bigrams), 9)) + 1
    chosen: set[str] = set()
    for word in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (w in COMMON_WORDS, -len(w), w)):
        if sum(not chosen.isdisjoint(b.split()) for b in bigrams) >= need:
            break
        chosen.add(word)
    return chosen


TEMPLATES = all_templates()
MOST_PARAGRAPHS = max(len(paragraphs_of(text)) for _, text in LICENCES)  # of a passage


PARAGRAPH_END = r"\n[ \t\r]*\n\s*"
SENTENCE_END = r"[.!?;:][ \t\r\n]+|\n[ \t\r]*\n\s*"


def _words(unit: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))


def _one_of(words: set[str]) -> str:
    """A pattern for any of the words, by first letter so that few are tried at each place."""
    by_letter = [(letter, "|".join(w[1:] for w in group)) for letter, group in groupby(sorted(words), key=lambda w: w[0])]
    return rf"(?i)(?<![a-z0-9])(?:{'|'.join(f'{letter}(?:{rest})' for letter, rest in by_letter)})(?![a-z0-9])"


def _holds(ordered: str, value: Column) -> Column:
    """Whether a sorted column of strings holds the value, by bisection: array_contains would look at each of them for each value."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(30))])
    less = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ordered, at + step - 1) < value, at + step).otherwise(at))
    return F.coalesce(F.get(ordered, less) == value, F.lit(False))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, bool]] = TEMPLATES, threshold: float = THRESHOLD, most_paragraphs: int = MOST_PARAGRAPHS) -> DataFrame:
    """(id, unit, kind, paragraphs, license, shared, dice) of each matching unit; units count from 0 within their kind, passages by their first paragraph."""
    known = [(name, template_bigrams(text), several) for name, text, several in templates]
    anchored = _one_of(set().union(*(anchors(b, threshold) for _, b, _ in known)))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(b) for b in grams]).alias("grams"), F.lit(len(grams)).alias("n"), F.lit(several).alias("several")) for name, grams, several in known])
    ratio = threshold / (2 - threshold)
    largest = max(len(g) for _, g, _ in known) / ratio
    smallest = math.ceil(round(ratio * min(len(g) for _, g, _ in known), 9))

    def unit(kind: str, at: Column, words: Column, paragraphs: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.alias("unit"), (F.lit(0) if paragraphs is None else paragraphs).alias("paragraphs"), words.alias("words"))

    def numbered(kind: str, parts: Column, wanted=lambda said: F.lit(True)) -> Column:  # noqa: ANN001
        every = F.transform(parts, lambda said, i: F.struct(i.alias("unit"), said.alias("said")))
        some = F.filter(every, lambda u: u["said"].rlike(anchored) & wanted(u["said"]))
        return F.transform(some, lambda u: unit(kind, u["unit"], _words(u["said"])))

    # Each step hands its result on as a column of its own, so that it is made once.
    rows = docs.where(F.col(text_col).rlike(anchored)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_paragraphs", F.split("_text", PARAGRAPH_END)).withColumn("_lines", numbered("line", F.split("_text", "\n")))
    rows = rows.withColumn("_longer", numbered("paragraph", F.col("_paragraphs"), lambda said: F.contains(F.trim(said), F.lit("\n"))))
    joined = F.transform(F.filter(F.concat("_paragraphs", F.split("_text", "\n")), lambda p: p.rlike(anchored)), lambda p: F.array_join(_words(p), " "))
    rows = rows.withColumn("_whole", F.array_sort(F.array_distinct(joined)))
    rows = rows.withColumn("_sentences", F.filter(numbered("sentence", F.split("_text", SENTENCE_END)), lambda u: ~_holds("_whole", F.array_join(u["words"], " "))))
    # A passage is found by its first paragraph and their number; one without an anchor word in any of its paragraphs can't match.
    rows = rows.withColumn("_worded", F.transform("_paragraphs", lambda p: F.struct(_words(p).alias("words"), p.rlike(anchored).alias("anchored"))))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(most_paragraphs)), lambda k: F.transform(F.filter(F.sequence(F.lit(0), F.size("_paragraphs")), lambda i: i + k <= F.size("_paragraphs")), lambda i: F.struct(i.alias("at"), k.alias("k")))))
    rows = rows.withColumn("_runs", F.transform(spans, lambda s: F.struct(s["at"].alias("at"), s["k"].alias("k"), F.slice("_worded", s["at"] + 1, s["k"]).alias("parts"))))
    short = lambda parts: F.aggregate(parts, F.lit(0), lambda a, p: F.greatest(a, F.size(F.array_distinct(p["words"])))) <= largest + 1
    runs = F.filter("_runs", lambda r: F.exists(r["parts"], lambda p: p["anchored"]) & short(r["parts"]))
    rows = rows.withColumn("_passages", F.transform(runs, lambda r: unit("passage", r["at"], F.flatten(F.transform(r["parts"], lambda p: p["words"])), r["k"])))
    # A unit of d distinct words has d - 1 distinct bigrams at least, one of w words w - 1 at most.
    fitting = F.filter(F.concat("_lines", "_longer", "_sentences", "_passages"), lambda u: (F.size(u["words"]) - 1 >= smallest) & (F.size(F.array_distinct(u["words"])) - 1 <= largest))
    rows = rows.select("_id", F.transform(fitting, lambda u: F.struct(u["kind"].alias("kind"), u["unit"].alias("unit"), u["paragraphs"].alias("paragraphs"), _bigrams(u["words"]).alias("grams"))).alias("_units"))
    sized = F.filter(F.transform("_units", lambda u: F.struct(u["kind"].alias("kind"), u["unit"].alias("unit"), u["paragraphs"].alias("paragraphs"), u["grams"].alias("grams"), F.size(u["grams"]).alias("n"))), lambda u: (u["n"] >= smallest) & (u["n"] <= largest))
    rows = rows.select("_id", sized.alias("_units"))

    def compared(u: Column, t: Column) -> Column:
        shared = F.size(F.array_intersect(u["grams"], t["grams"]))
        return F.struct((F.lit(-2.0) * shared / (u["n"] + t["n"])).alias("less"), t["name"].alias("name"), shared.alias("shared"))

    def best(u: Column) -> Column:
        near = F.filter(table, lambda t: (t["several"] | (u["kind"] != "passage")) & (t["n"] >= u["n"] * ratio) & (u["n"] >= t["n"] * ratio))
        return F.array_min(F.transform(near, lambda t: compared(u, t)))  # the highest coefficient, then the name

    found = F.filter(F.transform("_units", lambda u: F.struct(u["kind"].alias("kind"), u["unit"].alias("unit"), u["paragraphs"].alias("paragraphs"), best(u).alias("best"))), lambda m: m["best"]["less"] <= -threshold)
    rows = rows.select("_id", found.alias("_found"))
    passages = F.transform(F.filter("_found", lambda m: m["kind"] == "passage"), lambda m: F.struct(m["best"]["name"].alias("name"), m["best"].alias("best"), m["unit"].alias("unit"), m["paragraphs"].alias("paragraphs"), m["kind"].alias("kind")))
    rows = rows.select("_id", "_found", F.array_sort(passages).alias("_sorted"))
    first = F.filter(F.transform("_sorted", lambda m, i: F.struct(m.alias("m"), ((i == 0) | (F.get("_sorted", F.greatest(i - 1, F.lit(0)))["name"] != m["name"])).alias("new"))), lambda x: x["new"])
    single = F.transform(first, lambda x: F.struct(x["m"]["kind"].alias("kind"), x["m"]["unit"].alias("unit"), x["m"]["paragraphs"].alias("paragraphs"), x["m"]["best"].alias("best")))
    rows = rows.select("_id", F.explode(F.concat(F.filter("_found", lambda m: m["kind"] != "passage"), single)).alias("u"))
    return rows.select(F.col("_id").alias(id_col), "u.kind", F.col("u.unit").cast("long").alias("unit"), F.col("u.paragraphs").cast("long").alias("paragraphs"), F.col("u.best.name").alias("license"), F.col("u.best.shared").cast("long").alias("shared"), (-F.col("u.best.less")).alias("dice"))


def licence_query(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({i}, {quoted(name)}, [{', '.join(quoted(b) for b in template_bigrams(text))}], {several})" for i, (name, text, several) in enumerate(TEMPLATES))
    words = lambda said: f"[x FOR x IN string_split(regexp_replace(lower({said}), '[^a-z0-9]+', ' ', 'g'), ' ') IF x <> '']"
    return f"""
WITH t(tid, license, grams, several) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents WHERE text IS NOT NULL),
p AS (SELECT rid, doc_id, regexp_split_to_array(text, '{PARAGRAPH_END}') AS s, string_split(text, chr(10)) AS l, regexp_split_to_array(text, '{SENTENCE_END}') AS e FROM d),
l AS (SELECT rid, doc_id, 'line' AS kind, unnest(range(len(l))) AS unit, 0 AS paragraphs, unnest(l) AS said FROM p),
q AS (SELECT * FROM (SELECT rid, doc_id, 'paragraph' AS kind, unnest(range(len(s))) AS unit, 0 AS paragraphs, unnest(s) AS said FROM p)),
e AS (SELECT rid, doc_id, 'sentence' AS kind, unnest(range(len(e))) AS unit, 0 AS paragraphs, unnest(e) AS said FROM p),
k AS (SELECT rid, doc_id, 'passage' AS kind, a.at AS unit, b.k AS paragraphs, array_to_string(s[a.at + 1 : a.at + b.k], chr(10) || chr(10)) AS said
      FROM (SELECT *, unnest(range(len(s))) AS at FROM p) a JOIN (SELECT unnest(range(2, {MOST_PARAGRAPHS + 1})) AS k) b ON a.at + b.k <= len(a.s)),
w AS (SELECT rid, doc_id, kind, unit, paragraphs, {words('said')} AS words FROM (SELECT * FROM l UNION ALL SELECT * FROM q WHERE contains(trim(said), chr(10)) UNION ALL SELECT * FROM k)),
whole AS (SELECT DISTINCT rid, {words('said')} AS words FROM (SELECT * FROM l UNION ALL SELECT * FROM q)),
es AS (SELECT rid, doc_id, kind, unit, paragraphs, {words('said')} AS words FROM e),
v AS (SELECT * FROM w UNION ALL SELECT * FROM es WHERE NOT EXISTS (SELECT 1 FROM whole WHERE whole.rid = es.rid AND whole.words = es.words)),
g AS (SELECT rid, doc_id, kind, unit, paragraphs, list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS grams FROM v WHERE len(words) > 1),
c AS (SELECT g.*, t.license, len(t.grams) AS n, len(list_intersect(g.grams, t.grams)) AS shared FROM g JOIN t
      ON (t.several OR kind <> 'passage') AND len(g.grams) BETWEEN len(t.grams) * {THRESHOLD / (2 - THRESHOLD)!r} AND len(t.grams) / {THRESHOLD / (2 - THRESHOLD)!r}),
s AS (SELECT *, 2.0::DOUBLE * shared / (len(grams) + n) AS dice FROM c WHERE shared > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY rid, kind, unit, paragraphs ORDER BY dice DESC, license) AS k FROM s WHERE dice >= {THRESHOLD}),
o AS (SELECT *, row_number() OVER (PARTITION BY rid, kind, CASE WHEN kind = 'passage' THEN license ELSE CAST(unit AS VARCHAR) END ORDER BY dice DESC, unit, paragraphs) AS j FROM b WHERE k = 1)
SELECT doc_id, kind, CAST(unit AS BIGINT) AS unit, CAST(paragraphs AS BIGINT) AS paragraphs, license, CAST(shared AS BIGINT) AS shared, dice FROM o WHERE j = 1
"""


LICENCE_SQL = _sql()
