"""Repair of the structure of conversations by cheapest edits, found by bidirectional Dijkstra over the edit lattice.

Messages are read by turn (nulls first, then by role and text). A message is blank, a repeat of an earlier one, truncated (its last visible character ends no sentence) or sound. The
roles' initials of a repaired conversation are nothing, or an s at most and then pairs of u and a. A node of the lattice is the number of messages read and the last role written;
its edges keep a message, give it the role that fits, delete it, or insert an empty message of the role that fits. A heap from the start and one from the ends
meet; they go on until no crossing of the same cost can be left, and of all crossings of least cost the one with the least concatenated audit (the edits'
initials) is taken. An audit determines the repair, since every letter leads from a node to one node only.

Most conversations are short: their rows come sorted to one task, which repairs one after the other. Where a conversation has more than GROUP_ROWS messages or GROUP_BYTES bytes, its
messages are put in order by range over many tasks, repeats are found by grouping, and each chunk of CHUNK messages gets the cheapest audits from every role it
can begin with to every role it can end with. From these small tables a last pass takes the cheapest way through the chunks, from the last to the first, and then reads the
messages in order to hash them; it holds a chunk at a time. Insertions stand before a message of their chunk, so that no audit of a chunk is the beginning of another one.

Edge cases: null roles and texts are one space; a null conversation id is a conversation; null turns come first and leave no gaps. Initials are first characters, so any role that begins with u
counts as u. A conversation all of whose rows are marked absent (`present` false) is returned with zeros, an empty audit and the hash of nothing; an empty table gives no rows.
Repeated rows are repeats. Very long texts are read whole. Columns beside those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import saved, shuffle_width

GROUP_ROWS = 1024
GROUP_BYTES = 8 << 20
CHUNK = 1024

# The costs of edits, what blank means, and what ends a sentence.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

# States: nothing written, then the last initial written.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FITS = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
WRITTEN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by an insertion or a new role
NAMES = {USER: "user", ASSISTANT: "assistant"}
GOALS = (NOTHING, ASSISTANT)

Way = tuple[int, str]  # cost and audit


def code(initial: str, fault: str) -> str:
    """One character for what matters of a message: x must go; else its initial, in upper case if truncated."""
    if fault in "bd":
        return "x"
    known = initial if initial in ("s", "u", "a") else "o"
    return known.upper() if fault == "t" else known


def _ahead(rows: str, i: int, q: int, last: int) -> Iterator[tuple[int, str, int, int]]:
    if i < last:
        yield INSERT, "I", i, WRITTEN[q]
    if i < len(rows):
        yield DELETE, "D", i + 1, q
        if rows[i] != "x":
            more = TRUNCATED * rows[i].isupper()
            yield REROLE + more, "R", i + 1, WRITTEN[q]
            kept = FITS[q].get(rows[i].lower())
            if kept is not None:
                yield more, "K", i + 1, kept


def _behind(rows: str, i: int, q: int, last: int) -> Iterator[tuple[int, str, int, int]]:
    for before in range(4):
        if WRITTEN[before] == q and i < last:
            yield INSERT, "I", i, before
        if i and rows[i - 1] != "x":
            more = TRUNCATED * rows[i - 1].isupper()
            if WRITTEN[before] == q:
                yield REROLE + more, "R", i - 1, before
            if FITS[before].get(rows[i - 1].lower()) == q:
                yield more, "K", i - 1, before
    if i:
        yield DELETE, "D", i - 1, q


def cheapest(rows: str, source: int = NOTHING, goals: tuple[int, ...] = GOALS, open_end: bool = True) -> Way | None:
    """Least cost and then least audit from `source` before the first message to one of `goals` after the last; without `open_end` nothing is inserted after the last."""
    last = len(rows) + open_end
    sides: list[dict[tuple[int, int], Way]] = [{(0, source): (0, "")}, {(len(rows), q): (0, "") for q in goals}]
    done: list[set[tuple[int, int]]] = [set(), set()]
    # Messages read break ties of cost, for keeping costs nothing: what a node's label is made from is settled before the node.
    heaps: list[list[tuple[int, int, int]]] = [[(0, 0, source)], [(0, -len(rows), q) for q in goals]]
    heaps[1].sort()
    best: Way | None = None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        back = int(heaps[1][0][0] <= heaps[0][0][0])
        cost, i, q = heappop(heaps[back])
        node = (abs(i), q)
        if node in done[back]:
            continue
        done[back].add(node)
        audit = sides[back][node][1]
        join = (lambda other, letter="": audit + letter + other) if not back else (lambda other, letter="": other + letter + audit)
        if node in done[1 - back]:
            other = sides[1 - back][node]
            best = min(x for x in (best, (cost + other[0], join(other[1]))) if x)
        for step, letter, j, p in (_behind if back else _ahead)(rows, *node, last):
            at = (j, p)
            if at in done[1 - back]:
                other = sides[1 - back][at]
                best = min(x for x in (best, (cost + step + other[0], join(other[1], letter))) if x)
            way = (cost + step, letter + audit if back else audit + letter)
            if at not in sides[back] or way < sides[back][at]:
                if at not in sides[back] or way[0] < sides[back][at][0]:
                    heappush(heaps[back], (way[0], -j if back else j, p))
                sides[back][at] = way
    return best


@lru_cache(1 << 14)
def _short(rows: str) -> Way:
    return cheapest(rows)  # deleting everything is a way, so there is one


def audit_of(rows: str) -> Way:
    return _short(rows) if len(rows) <= 64 else cheapest(rows)


def replay(messages: Iterator[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str, str, int]]:
    """(edit, role, text, state) of each message of the repaired conversation."""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(messages)
        if letter == "D":
            continue
        if letter == "K":
            state = FITS[state][role[:1]]
            yield letter, role, text, state
        else:
            state = WRITTEN[state]
            yield letter, NAMES[state], text, state


def _legal(before: str | None, now: str) -> bool:
    return before is None or before + now in ("su", "ua", "au")


class _Hash:
    """The hash of `role:text` lines."""

    def __init__(self) -> None:
        self.sha, self.some = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update(("\n" * self.some + f"{role}:{text}").encode())
        self.some = True


def _repaired(conv: object, rows: list[tuple], messages: bool) -> Iterator[tuple]:
    """The result of one short conversation; rows are (turn, role, text, fault)."""
    seen: set[tuple[str, str]] = set()
    faults = ""
    illegal, before = 0, None
    for _, role, text, fault in rows:
        faults += "d" if fault != "b" and (role, text) in seen else fault
        seen.add((role, text))
        illegal += not _legal(before, role[:1])
        before = role[:1]
    cost, audit = audit_of("".join(code(r[1][:1], f) for r, f in zip(rows, faults)))
    lines = _Hash()
    for place, (edit, role, text, _) in enumerate(replay(((r[1], r[2]) for r in rows), audit, NOTHING)):
        if messages:
            yield conv, place, edit, role, text
        else:
            lines.add(role, text)
    if not messages:
        turns = {r[0] for r in rows} - {None}
        yield conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, lines.sha.hexdigest()


def _schema(rows: DataFrame, messages: bool) -> str:
    kind = rows.schema["conv"].dataType.simpleString()
    return f"conv {kind}, place long, edit string, role string, text string" if messages else f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _table(found: list[tuple], like: pa.Field, messages: bool) -> pa.RecordBatch:
    kinds = [like.type, pa.int64(), pa.string(), pa.string(), pa.string()] if messages else [like.type, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = "conv place edit role text" if messages else "conv gaps blank duplicate truncated illegal cost audit repaired_sha256"
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names=names.split())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Field, object, tuple]]:
    """Every row with its conversation, and the column of conversations, in order."""
    for batch in batches:
        field = batch.schema.field("conv")
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            yield field, row[0], row[1:]


def _repair_short(rows: DataFrame, messages: bool) -> DataFrame:
    """Repair conversations of a bounded size, each in the task that has its rows."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        now: object = None
        field = None
        for field, conv, row in _groups(batches):
            if held and conv != now:
                out += _repaired(now, [r[:4] for r in held if r[4]], messages)
                held = []
                if len(out) >= 1000:
                    yield _table(out, field, messages)
                    out = []
            now = conv
            held.append(row)
        if held:
            out += _repaired(now, [r[:4] for r in held if r[4]], messages)
        if out:
            yield _table(out, field, messages)

    ordered = rows.select("conv", "turn", "role", "text", "fault", "present").repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(step, _schema(rows, messages))


def transfers(rows: str) -> list[Way | None]:
    """The cheapest way through a chunk from each state to each state, all 16."""
    return [cheapest(rows, a, (b,), open_end=False) for a in range(4) for b in range(4)]


def _through(chunks: list[list[Way | None]]) -> list[tuple[int, int]]:
    """The states before and after each chunk on the cheapest way, with the least audit, through all."""
    after: list[int | None] = [None if q not in GOALS else 0 for q in range(4)]
    after[USER], after[SYSTEM] = INSERT, 2 * INSERT
    taken: list[list[int]] = []
    for ways in reversed(chunks):
        best = [min(((w[0] + after[b], w[1], b) for b in range(4) if (w := ways[4 * a + b]) and after[b] is not None), default=None) for a in range(4)]
        taken.append([x[2] if x else -1 for x in best])
        after = [x[0] if x else None for x in best]
    state, out = NOTHING, []
    for choice in reversed(taken):
        out.append((state, choice[state]))
        state = choice[state]
    return out


def _repair_long(rows: DataFrame, messages: bool) -> DataFrame:
    """Repair conversations of any size, chunk by chunk."""
    spark = rows.sparkSession
    order = ["conv", "turn", "role", "text"]
    placed = rows.where("present").repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    placed = saved(placed.select(*order, "fault").withColumn("pos", F.monotonically_increasing_id()))
    first = placed.where("fault <> 'b'").groupBy("conv", "role", F.sha2("text", 256)).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    fault = F.when((F.col("fault") != "b") & F.col("_first").isNull(), "d").otherwise(F.col("fault"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    coded = placed.join(first, "pos", "left").select("conv", "pos", "turn", known.alias("known"), fault.alias("fault"))
    coded = saved(coded.withColumn("code", F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper("known")).otherwise(F.col("known"))))
    number = F.expr(f"pos div {CHUNK}")
    chunks = coded.groupBy("conv", number.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("rows"))
    conv = rows.schema["conv"].dataType.simpleString()

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [transfers(x) for x in batch.column("rows").to_pylist()]
            costs = pa.array([[w[0] if w else None for w in ways] for ways in found], pa.list_(pa.int64()))
            audits = pa.array([[w[1] if w else None for w in ways] for ways in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), costs, audits], names=["conv", "chunk", "costs", "audits"])

    ways = saved(chunks.repartition(shuffle_width(spark)).mapInArrow(through, f"conv {conv}, chunk long, costs array<long>, audits array<string>"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the audits only what tells ways of equal cost apart is held: their order."""
        held: list[tuple[int, list[Way | None]]] = []
        out: list[tuple] = []
        now: object = None
        field = None

        def close() -> None:
            states = _through([w for _, w in held])
            for i, ((chunk, _), (a, b)) in enumerate(zip(held, states)):
                tail = "" if i < len(held) - 1 else {USER: "I", SYSTEM: "II"}.get(b, "")
                out.append((now, chunk, a, 4 * a + b + 1, tail))

        for field, conv, (chunk, costs, audits) in _groups(batches):
            if held and conv != now:
                close()
                held = []
            now = conv
            ranks = {x: i for i, x in enumerate(sorted({x for x in audits if x is not None}))}
            held.append((chunk, [None if c is None else (c, ranks[a]) for c, a in zip(costs, audits)]))
        if held:
            close()
        if out:
            kinds = [field.type, pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["conv", "chunk", "state", "way", "tail"])

    chosen = ways.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(choose, f"conv {conv}, chunk long, state int, way int, tail string")
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"]) & (a["chunk"] == b["chunk"])
    marks = chosen.join(ways, same(chosen, ways)).select(chosen["conv"], chosen["chunk"], F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.concat(F.element_at("audits", F.col("way")), "tail").alias("text"), "state", F.element_at("costs", F.col("way")).alias("cost"))
    lines = placed.select("conv", number.alias("chunk"), "pos", "role", "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("long").alias("cost")).unionByName(marks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Follow each chunk's audit, which stands before the chunk's messages."""
        out: list[tuple] = []
        now: object = None
        begun = False
        field = None

        def close() -> None:
            if begun and not messages:
                out.append((now, 0, 0, 0, 0, illegal, cost, "".join(audits), lines.sha.hexdigest()))

        def write(message: list[tuple[str, str]]) -> None:
            """Follow the edit of a message, if one is given, and the insertions that stand before the next."""
            nonlocal at, state, place
            end = at + len(message)
            while end < len(audits[-1]) and audits[-1][end] == "I":
                end += 1
            for edit, role, text, state in replay(iter(message), audits[-1][at:end], state):  # noqa: B020
                if messages:
                    out.append((now, place, edit, role, text))
                    place += 1
                else:
                    lines.add(role, text)
            at = end

        for field, conv, (_, pos, role, text, began, way_cost) in _groups(batches):
            if not begun or conv != now:
                close()
                now, begun = conv, True
                audits, illegal, before, cost, place, at, state, lines = [], 0, None, 0, 0, 0, NOTHING, _Hash()
            if pos < 0:
                audits.append(text)
                # What a chunk's audit ends with in insertions has been added to the last one.
                at, state, cost = 0, began, cost + way_cost + INSERT * (len(text) - len(text.rstrip("I")))
                write([])
            else:
                illegal += not _legal(before, role[:1])
                before = role[:1]
                write([(role, text)])
            if len(out) >= 1000:
                yield _table(out, field, messages)
                out.clear()
        close()
        if out:
            yield _table(out, field, messages)

    done = lines.repartition("conv").sortWithinPartitions("conv", "chunk", "pos").mapInArrow(read, _schema(rows, messages))
    if messages:
        return done
    counted = coded.groupBy(F.col("conv").alias("_conv")).agg(
        *[F.count_if(F.col("fault") == f).alias(f"_{name}") for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("_gaps"),
    )
    return done.join(counted, F.col("conv").eqNullSafe(F.col("_conv"))).select("conv", *[F.col(f"_{c}").alias(c) for c in ("gaps", "blank", "duplicate", "truncated")], "illegal", "cost", "audit", "repaired_sha256")


def repair(conversations: DataFrame, present: Column | None = None, messages: bool = False, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and the hash of what they give; with `messages`, the repaired messages instead.

    `conversations` has conv_id, turn, role and text. Rows where `present` is false only name their conversation.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    seen = F.rtrim("text", F.lit(BLANKS))
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    rows = rows.withColumn("fault", F.when(seen == "", "b").when(F.right(seen, F.lit(1)).isin(*ENDS), "o").otherwise("t"))
    sizes = rows.where("present").groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = saved(sizes.where((F.col("n") > group_rows) | (F.col("size") > group_bytes)).select(F.col("conv").alias("_long")))
    back = lambda df: df.withColumnRenamed("conv", "conv_id")
    if long.isEmpty():
        return back(_repair_short(rows, messages))
    is_long = F.col("conv").eqNullSafe(F.col("_long"))
    short = rows.join(long, is_long, "left_anti")
    return back(_repair_short(short, messages).unionByName(_repair_long(rows.join(long, is_long, "left_semi"), messages)))


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with damage chosen by the crc32 of `conv_id:turn`, and whether a row is still present."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    changed = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fate", copies.alias("copy"))
    return changed.drop("copy"), F.col("fate") != 0


def repair_query(conversations: DataFrame) -> DataFrame:
    rows, present = damaged(conversations)
    return repair(rows, present)


REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([CAST(n AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t FROM range(256) x(n)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], [CAST(ascii(c) AS UBIGINT) FOR c IN string_split(key, '')]),
        lambda a, b: xor(a // 256, t[CAST(xor(a, b) % 256 AS INTEGER) + 1])), 4294967295) % 20 AS fate FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fate <> 0),
o AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS vis,
        lag(role[1]) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
g AS (SELECT *, CASE WHEN vis = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN vis[-1] IN ('.', '!', '?') THEN 'o' ELSE 't' END AS fault FROM o),
e AS (SELECT *, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS x, fault IN ('b', 'd') AS must FROM g),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM e GROUP BY conv_id),
walk AS (
  SELECT conv_id, n, CAST(0 AS BIGINT) AS i, {'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])} AS w0, {'c': CAST(1000000000 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])} AS w1,
    {'c': CAST(2 AS BIGINT), 'a': 'I', 't': ['user:']} AS w2, {'c': CAST(4 AS BIGINT), 'a': 'II', 't': ['user:', 'assistant:']} AS w3 FROM facts
  UNION ALL
  SELECT conv_id, n, i, w0, w1, least(v2, {'c': w0.c + 2, 'a': w0.a || 'I', 't': list_append(w0.t, 'user:')}, {'c': w1.c + 2, 'a': w1.a || 'I', 't': list_append(w1.t, 'user:')}, {'c': v3.c + 2, 'a': v3.a || 'I', 't': list_append(v3.t, 'user:')}) AS w2,
    least(v3, {'c': v2.c + 2, 'a': v2.a || 'I', 't': list_append(v2.t, 'assistant:')}, {'c': w0.c + 4, 'a': w0.a || 'II', 't': list_concat(w0.t, ['user:', 'assistant:'])}, {'c': w1.c + 4, 'a': w1.a || 'II', 't': list_concat(w1.t, ['user:', 'assistant:'])}) AS w3
  FROM (
    SELECT s.conv_id, s.n, e.i,
      {'c': w0.c + 3, 'a': w0.a || 'D', 't': w0.t} AS w0,
      least({'c': w1.c + 3, 'a': w1.a || 'D', 't': w1.t}, {'c': w0.c + CASE WHEN must OR role[1] <> 's' OR role = '' THEN 1000000000 ELSE x END, 'a': w0.a || 'K', 't': list_append(w0.t, role || ':' || text)}) AS w1,
      least({'c': w2.c + 3, 'a': w2.a || 'D', 't': w2.t},
        {'c': w0.c + CASE WHEN must THEN 1000000000 ELSE 2 + x END, 'a': w0.a || 'R', 't': list_append(w0.t, 'user:' || text)}, {'c': w1.c + CASE WHEN must THEN 1000000000 ELSE 2 + x END, 'a': w1.a || 'R', 't': list_append(w1.t, 'user:' || text)},
        {'c': w3.c + CASE WHEN must THEN 1000000000 ELSE 2 + x END, 'a': w3.a || 'R', 't': list_append(w3.t, 'user:' || text)},
        {'c': w0.c + CASE WHEN must OR role[1] <> 'u' OR role = '' THEN 1000000000 ELSE x END, 'a': w0.a || 'K', 't': list_append(w0.t, role || ':' || text)}, {'c': w1.c + CASE WHEN must OR role[1] <> 'u' OR role = '' THEN 1000000000 ELSE x END, 'a': w1.a || 'K', 't': list_append(w1.t, role || ':' || text)},
        {'c': w3.c + CASE WHEN must OR role[1] <> 'u' OR role = '' THEN 1000000000 ELSE x END, 'a': w3.a || 'K', 't': list_append(w3.t, role || ':' || text)}) AS v2,
      least({'c': w3.c + 3, 'a': w3.a || 'D', 't': w3.t}, {'c': w2.c + CASE WHEN must THEN 1000000000 ELSE 2 + x END, 'a': w2.a || 'R', 't': list_append(w2.t, 'assistant:' || text)},
        {'c': w2.c + CASE WHEN must OR role[1] <> 'a' OR role = '' THEN 1000000000 ELSE x END, 'a': w2.a || 'K', 't': list_append(w2.t, role || ':' || text)}) AS v3
    FROM walk s JOIN e ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = s.i + 1)),
ends AS (SELECT conv_id, least(w0, w3) AS w FROM walk WHERE i = n),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(array_to_string(w.t, chr(10)), '')) AS repaired_sha256
FROM every LEFT JOIN facts ON every.conv_id IS NOT DISTINCT FROM facts.conv_id LEFT JOIN ends ON every.conv_id IS NOT DISTINCT FROM ends.conv_id
"""
