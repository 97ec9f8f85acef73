"""Text preparation: cleanup, chunkers and statistics. Chunkers return an array of (idx, start, end, text) per text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.snapshots import bounded_batches

# Marks that end a sentence.
CJK_ENDS = "。！？"
LATIN_ENDS = ".!?"
PARAGRAPH_CUTS = "。！？\n"
CHUNK_TYPE = "array<struct<idx:int,start:int,end:int,text:string>>"


def cleaned(text: Column, newlines: int = 3) -> Column:
    """Without byte order mark and blanks before line ends, runs of `newlines` or more newlines as two, and trimmed."""
    out = F.replace(text, F.lit("﻿"), F.lit(""))
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, rf"\n{{{newlines},}}", "\n\n")
    return F.regexp_replace(out, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def token_count(text: Column) -> Column:
    """ceil(ascii / 4) + CJK + ceil(other / 2) over characters; at least 1, but 0 for a blank text."""
    ascii_n = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    cjk_n = F.length(F.regexp_replace(text, r"[^一-鿿㐀-䶿]", ""))
    other = F.length(text) - ascii_n - cjk_n
    count = F.ceil(ascii_n / 4) + cjk_n + F.ceil(other / 2)
    return F.when(text.isNull() | (F.trim(text) == ""), 0).otherwise(F.greatest(count, F.lit(1))).cast("int")


def chunk_stats(chunks: DataFrame, text_col: str = "content") -> DataFrame:
    return chunks.withColumns({"content_hash": F.sha2(text_col, 256), "char_count": F.length(text_col), "token_count": token_count(F.col(text_col))})


def repaired(text: str) -> str:
    """Carriage returns removed; URLs broken over lines and CJK words broken by a newline joined again."""
    lines = text.replace("\r", "").split("\n")
    out = [lines[0]]
    for line in lines[1:]:
        last, head = out[-1], line.lstrip()
        starts_item = re.match(r"(?:[-*•]|\d+[.)、])\s?", head) is not None
        url = re.search(r"https?://\S*$", last)
        if url and head and not starts_item and re.match(r"[\w/%?&=#.~+-]", head):
            out[-1] = last + head
        elif last and line and re.search(r"[一-鿿]$", last) and re.match(r"[一-鿿]", line):
            out[-1] = last + line
        else:
            out.append(line)
    return "\n".join(out)


def fixed_size(text: str, size: int = 512, overlap: int = 128) -> list[tuple[int, int, int, str]]:
    """Windows of `size` characters; an end moves back by at most `overlap` to a newline, else a sentence end. -1 is one chunk.

    The overlap is less than the size. An end that would not go beyond the one before stays where the size puts it.
    """
    if size == -1:
        return [(0, 0, len(text), text)] if text.strip() else []
    size = max(size, 1)
    overlap = min(max(overlap, 0), size - 1)
    out: list[tuple[int, int, int, str]] = []
    start, last = 0, -1
    while start < len(text):
        full = min(start + size, len(text))
        end = _pulled_back(text, start, full, overlap)
        if end <= last:
            end = full
        if text[start:end].strip():
            out.append((len(out), start, end, text[start:end]))
        last = end
        if end == len(text):
            break
        start = end - overlap if end - overlap > start else end
    return out


def _pulled_back(text: str, start: int, end: int, reach: int) -> int:
    """The end after the last mark in reach: newlines go before marks of CJK sentences, those before marks of Latin ones that a blank or the text's end follows."""
    reach = min(reach, end - start)
    if reach <= 0:
        return end
    places = range(end - 1, max(start, end - reach - 2), -1)
    tests = (
        lambda i: text[i] == "\n",
        lambda i: text[i] in CJK_ENDS,
        lambda i: text[i] in LATIN_ENDS and (i + 1 == len(text) or text[i + 1].isspace()),
    )
    return next((i + 1 for test in tests for i in places if test(i)), end)


_HEADING = re.compile(r"#{1,6}\s+.*")
_IMAGE_OR_LINK = re.compile(r'!\[[^\]]*\]\([^)]+\)(\s*"[^"]*")?|\[[^\]]+\]\([^)]+\)')


def blocks(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of headings, code fences (closed or not), lines that are one image or link, and paragraphs; blank lines belong to the block before."""
    out: list[tuple[str, int, int]] = []
    at, open_kind = 0, ""
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        said, start, at = line.rstrip(), at, at + len(line)
        fence = said.startswith("```")
        if open_kind == "CODE":
            out[-1] = ("CODE", out[-1][1], at)
            open_kind = "" if fence else "CODE"
            continue
        if not said:
            open_kind = ""
            continue
        kind = "CODE" if fence else "HEADING" if _HEADING.fullmatch(said) else "ATOMIC" if _IMAGE_OR_LINK.fullmatch(said) else "PARA"
        if kind == "PARA" == open_kind:
            out[-1] = ("PARA", out[-1][1], at)
        else:
            out.append((kind, start, at))
        open_kind = kind if kind in ("CODE", "PARA") else ""
    following = [start for _, start, _ in out[1:]] + [out[-1][2]] if out else []
    return [(kind, start, upto if not text[end:upto].strip(" \t\n") else end) for (kind, start, end), upto in zip(out, following)]


def structure_aware(text: str, target: int = 1400, most: int = 1800, least: int = 600, overlap: int = 0) -> list[tuple[int, int, int, str]]:
    """Blocks packed to at most `most` characters; one overflow while a chunk is shorter than `least`; a short tail joins its predecessor.

    start and end are places in the text, the line ends of which become newlines. With an overlap, a chunk's text begins with the last characters of the
    chunk before. A blank text is one chunk.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text and text.isspace():
        return [(0, 0, len(text), text)]
    spans: list[list[int]] = []
    closed = True
    for _, start, end in blocks(text):
        if closed:
            spans.append([start, end])
            closed = False
        elif end - spans[-1][0] <= most:
            spans[-1][1] = end
        elif spans[-1][1] - spans[-1][0] < least:
            spans[-1][1] = end
            closed = True
        else:
            spans.append([start, end])
    if len(spans) > 1 and spans[-1][1] - spans[-1][0] < min(least, target / 2) and spans[-1][1] - spans[-2][0] <= 2 * most:
        spans[-2:] = [[spans[-2][0], spans[-1][1]]]
    before = [""] + [text[s:e][-overlap:] if overlap > 0 else "" for s, e in spans]
    return [(i, s, e, before[i] + text[s:e]) for i, (s, e) in enumerate(spans)]


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] <= " ":
        start += 1
    while end > start and text[end - 1] <= " ":
        end -= 1
    return start, end


def paragraphs(text: str, most: int = 2000) -> list[tuple[int, int, int, str]]:
    """Paragraphs packed while their characters fit into `most`, two newlines between them; a longer one is cut on its own.

    Its cuts lie after the last PARAGRAPH_CUTS mark past the middle, else at `most`, and its rest is a chunk too. start and end are places in the text.
    """
    out: list[tuple[int, int, str]] = []
    now: list[tuple[int, int]] = []
    length = 0

    def close() -> None:
        nonlocal now, length
        if now:
            out.append((now[0][0], now[-1][1], "\n\n".join(text[s:e] for s, e in now)))
        now, length = [], 0

    at = 0
    for gap in [*re.finditer(r"\n[ \t\n\x0b\f\r]*\n", text), None]:
        start, end = _trimmed(text, at, gap.start() if gap else len(text))
        at = gap.end() if gap else len(text)
        if start == end:
            continue
        if now and length + end - start > most:
            close()
        if not now and end - start > most:
            while end - start > most:
                cut = -1
                for mark in PARAGRAPH_CUTS:  # a mark just at the cut of an earlier kind does not move it
                    place = text.rfind(mark, start + most // 2 + 1, start + most)
                    cut = place + 1 if place > cut else cut
                cut = start + most if cut < 0 else cut
                s, e = _trimmed(text, start, cut)
                out.append((s, e, text[s:e]))
                start, _ = _trimmed(text, cut, end)
            if start < end:
                out.append((start, end, text[start:end]))
            continue
        length += end - start + (2 if now else 0)
        now.append((start, end))
    close()
    return [(i, s, e, said) for i, (s, e, said) in enumerate(out)]


CHUNKERS = {"fixed": lambda t, **o: fixed_size(repaired(t), **o), "structure": structure_aware, "paragraph": paragraphs}


def chunked(docs: DataFrame, strategy: str, text_col: str = "text", **options: int) -> DataFrame:
    """One row per chunk (idx, start, end, content) by a named strategy; texts are handled in Arrow batches of a bounded size."""
    bounded_batches(docs.sparkSession)
    split = CHUNKERS[strategy]

    @F.pandas_udf(CHUNK_TYPE)
    def chunks(text: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("idx", "start", "end", "text"), c)) for c in split(t or "", **options)] for t in text], dtype=object)

    out = docs.withColumn("_c", F.explode(chunks(text_col)))
    return out.select(*docs.columns, F.col("_c.idx").alias("idx"), F.col("_c.start").alias("start"), F.col("_c.end").alias("end"), F.col("_c.text").alias("content"))


def by_lines(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every n lines are a chunk."""
    lines = docs.withColumn("_l", F.split(text_col, "\n")).withColumn("idx", F.explode(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / n).cast("int"))))
    return lines.select(id_col, "idx", F.concat_ws("\n", F.slice("_l", F.col("idx") * n + 1, F.lit(n))).alias("content"))


def autoindexed(existing: DataFrame, new: DataFrame, id_col: str = "doc_id", order: str = "content") -> DataFrame:
    """Chunks without an index go on after their document's largest one."""
    top = existing.groupBy(id_col).agg(F.max("chunk_index").alias("_max"))
    k = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    return new.join(top, id_col, "left").withColumn("chunk_index", F.coalesce(F.col("_max"), F.lit(-1)) + k).drop("_max")


def routed(files: DataFrame, types: dict[str, str], mimes: dict[str, str], allowed: set[str]) -> DataFrame:
    """File type by extension, then by MIME type, and whether the rules allow it (`ALL` allows every known type)."""
    table = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
    extension = F.lower(F.regexp_extract("name", r"\.([^./\\]+)$", 1))
    kind = F.coalesce(F.element_at(table(types), extension), F.element_at(table(mimes), F.lower(F.coalesce("mime", F.lit("")))))
    ok = F.col("type").isNotNull() & (F.lit("ALL" in allowed) | F.coalesce(F.col("type").isin(*allowed), F.lit(False)))
    return files.withColumn("type", kind).withColumn("accepted", ok)
