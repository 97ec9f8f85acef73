"""Conversation repair against a plain dynamic programme and enumeration."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import repair as rep

SCHEMA = "conv_id long, turn long, role string, text string"
VISIBLE = r"[^\x20\x09-\x0D]"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """Least (cost, audit) and the lines, by a forward table over whole audits."""
    best = {"": (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for q, (c, a, lines) in list(out.items()):
                n = NEXT[q]
                way = (c + 2, a + "I", lines + ({"u": "user", "a": "assistant"}[n] + ":",))
                if n not in out or way < out[n]:
                    out[n] = way
        return out

    for role, text, fault in rows:
        more = int(fault == "truncated")
        after = {}
        for q, (c, a, lines) in inserted(best).items():
            ways = [(q, (c + 3, a + "D", lines))]
            if fault not in ("blank", "duplicate"):
                n = NEXT[q]
                ways.append((n, (c + 2 + more, a + "R", lines + ({"u": "user", "a": "assistant"}[n] + ":" + text,))))
                first = role[:1]
                if first == n or (q == "" and first == "s"):
                    ways.append((first, (c + more, a + "K", lines + (role + ":" + text,))))
            for q2, way in ways:
                if q2 not in after or way < after[q2]:
                    after[q2] = way
        best = after
    best = inserted(best)
    return min(best[q] for q in ("", "a") if q in best)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        visible = re.findall(VISIBLE, text)
        kind = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, kind))
    return out


def brute(rows, damage=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fate = zlib.crc32(key.encode()) % 20 if damage else 9
        convs[conv]
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            convs[conv] += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds = faults(kept)
        turns = {t for t, *_ in kept if t is not None}
        count = lambda k: sum(x[2] == k for x in kinds)  # noqa: E731, B023
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit, lines = plain_repair(kinds)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n, longest=14):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, longest)):
            if r.random() < 0.1:
                continue
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "ux"])
            text = r.choice(["Yes.", "No", "What?", "  ", "a. \t", "b\x1c", f"Line {r.randrange(5)}\nmore!", "漢字。", "…", f"{turn}."])
            rows.append((conv, r.choice([turn, turn, turn, 3, None]), role, text))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if not kw:
        return sorted((tuple(r) for r in rep.repair_query(df).collect()), key=repr)
    damaged, present = rep.damaged(df)
    return sorted((tuple(r) for r in rep.repair(damaged, present, **kw).collect()), key=repr)


def test_random_conversations(spark):
    rows = conversations(1, 300) + [(None, 0, "user", "Hi."), (None, None, None, None), (1000, None, "user", "Alone"), (1000, None, "user", "Alone")]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("chunk", [3, 8])
def test_long_conversations_by_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(rep, "CHUNK", chunk)
    rows = conversations(2, 25, 60) + [(None, i // 2, r, f"{i}.") for i, r in enumerate(["user", "assistant", "tool"] * 9)]
    assert run(spark, rows, group_rows=5) == brute(rows)
    assert run(spark, rows, group_rows=0) == brute(rows)
    assert run(spark, rows, group_bytes=40) == brute(rows)


def test_one_conversation_of_a_third_of_all_rows(spark):
    rows = conversations(3, 200) + [(7777, i, "user" if i % 2 else "assistant", f"Line {i % 900}" + "." * (i % 5 > 0)) for i in range(2600)]
    got = run(spark, rows, group_rows=1024)
    assert [r for r in got if r[0] == 7777][0][1:7] == [r for r in brute(rows) if r[0] == 7777][0][1:7]
    assert got == brute(rows)


def test_repaired_messages(spark):
    """The messages hash to the digest and follow the pattern, by either way."""
    rows = conversations(4, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    digest = {r.conv_id: r for r in rep.repair(df).collect()}
    for size in (1024, 4):
        lines = defaultdict(list)
        for r in sorted(rep.repair(df, messages=True, group_rows=size).collect(), key=lambda r: r.place):
            lines[r.conv_id].append(r)
        for conv, d in digest.items():
            own = lines[conv]
            assert [r.place for r in own] == list(range(len(own)))
            assert re.fullmatch(r"(s?(ua)+)?", "".join(r.role[:1] for r in own))
            assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == d.repaired_sha256
            assert "".join(r.edit for r in own) == d.audit.replace("D", "")


def test_both_heaps_find_the_least_way():
    """Every short skeleton and random longer ones, from each state to each end, against all audits up to a length and the plain table."""
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}

    def table(rows):
        return plain_repair([("", "", "blank") if c == "x" else (names[c.lower()], "", "truncated" if c.isupper() else "") for c in rows])[:2]

    for n in range(4):
        for rows in itertools.product("suaoxSUAO", repeat=n):
            assert rep.cheapest("".join(rows)) == table(rows)
    r = random.Random(6)
    for _ in range(300):
        rows = [r.choice("suauaoxUA") for _ in range(r.randint(4, 30))]
        assert rep.cheapest("".join(rows)) == table(rows)


def test_empty_and_other_columns(spark):
    rows = conversations(5, 20)
    assert run(spark, []) == []
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "fault", "pos", "chunk", "fate", "copy", "audit"):
        df = df.withColumn(name, F.lit("extra"))
    assert sorted((tuple(r) for r in rep.repair_query(df).collect()), key=repr) == brute(rows)
    dropped = [c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][0]
    assert run(spark, [(dropped, 0, "user", "Gone.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
