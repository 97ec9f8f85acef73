"""Length buckets that minimise padding, and token-budget batches inside each bucket.

The lengths of all documents are counted into one global histogram. Dynamic programming over the histogram chooses the bucket
boundaries with the least total padding when every document is padded to its bucket's boundary: the cost of a bucket over lengths
(i, j] is length_j * count - sum of lengths, which makes the recurrence a lower envelope of lines, so the optimum takes time in
the number of distinct lengths times the number of buckets. Inside a bucket, documents are dealt to batches of as many rows as the
token budget holds at the bucket's length (at least one).

Lengths up to EXACT_LENGTHS are counted exactly; longer ones are rounded up to EXACT_LENGTHS steps per doubling, so the
histogram that reaches the driver is bounded at any input size.

Edge cases: a null or empty text has no tokens and lies in the first bucket (length 0 rows are padded like others); very long texts are counted whole, and
a document above the budget is a batch of its own; nothing is cut or dropped; repeated rows are rows, and rows that tie in id and length
share a bucket, in which each has a place of its own; a null id is a row like any other; an empty table gives an empty result.
:func:`packed` keeps all columns of the input, but those named like its results give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import beside, numbered, rows_with, saved

BUCKETS = 16
TOKEN_BUDGET = 16_384
EXACT_LENGTHS = 4096


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rounded(length: Column) -> Column:
    """The length itself, or above EXACT_LENGTHS the next of EXACT_LENGTHS steps per doubling."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)))) - EXACT_LENGTHS.bit_length() + 1, F.lit(0))).cast("long")
    return (F.ceil(length / step) * step).cast("long")


def boundaries(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least padding; `histogram` holds (length, count)."""
    rows = sorted((n, c) for n, c in histogram if c > 0)
    if not rows:
        return []
    lengths = [n for n, _ in rows]
    count, total = [0], [0]
    for n, c in rows:
        count.append(count[-1] + c)
        total.append(total[-1] + n * c)
    m = len(rows)
    best: list[float] = [0] + [float("inf")] * m
    origin: list[list[int]] = []
    for _ in range(min(buckets, m)):
        # best'[j] = L_j * count_j - total_j + min over i < j of (best[i] + total_i - L_j * count_i)
        lines: list[tuple[int, float, int]] = []  # slope -count_i (falling), intercept, i
        head = 0
        now, frm = [0.0] + [float("inf")] * m, [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            if best[i] != float("inf"):
                line = (-count[i], best[i] + total[i], i)
                while len(lines) - head >= 2 and _useless(lines[-2], lines[-1], line):
                    lines.pop()
                lines.append(line)
            x = lengths[j - 1]
            while len(lines) - head >= 2 and lines[head + 1][0] * x + lines[head + 1][1] <= lines[head][0] * x + lines[head][1]:
                head += 1
            if len(lines) > head:
                slope, intercept, i = lines[head]
                now[j], frm[j] = x * count[j] - total[j] + slope * x + intercept, i
        origin.append(frm)
        best = now
    out, j = [], m
    for frm in reversed(origin):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = frm[j]
    return out[::-1]


def _useless(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b lies above a or c everywhere (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def packed(docs: DataFrame, tokens_col: str, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Add bucket, bucket_length, batch (within its bucket) and slot (within its batch) to rows with a token count."""
    level = beside(docs, _id=F.col(id_col), _tokens=F.col(tokens_col), _level=rounded(F.col(tokens_col)))
    histogram = [(r[0], r[1]) for r in level.groupBy("_level").count().collect()]
    bounds = boundaries(histogram, buckets) or [0]
    upper = F.array(*[F.lit(b).cast("long") for b in bounds])
    placed = level.withColumn("_bucket", F.size(F.filter(upper, lambda b: b < F.col("_level")))).withColumn("_upper", F.element_at(upper, F.col("_bucket") + 1))
    at = numbered(placed, "_bucket", ["_id", "_tokens"], "_at")
    rows = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("_upper"), F.lit(1))), F.lit(1))
    return rows_with(at, docs.columns, bucket=F.col("_bucket"), bucket_length=F.col("_upper"), batch=F.floor(F.col("_at") / rows).cast("long"), slot=(F.col("_at") % rows).cast("int"))


def packing_query(docs: DataFrame) -> DataFrame:
    rows = saved(docs.select("doc_id", token_count(F.col("text")).alias("n_tokens")))
    return packed(rows, "n_tokens").select("doc_id", "n_tokens", "bucket", "bucket_length", "batch", "slot")
