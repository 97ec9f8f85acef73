"""Business reports over sales (region, product, sales_person, customer, amount, date) and tickets, and lookups with paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(df: DataFrame, equal: dict[str, object] | None = None, contains: dict[str, str] | None = None) -> DataFrame:
    """One condition per given value; null or blank values are no condition."""
    given = lambda v: v is not None and str(v).strip() != ""
    for name, value in (equal or {}).items():
        if given(value):
            df = df.where(F.col(name) == value)
    for name, value in (contains or {}).items():
        if given(value):
            df = df.where(F.contains(F.col(name), F.lit(value)))
    return df


def keyword(df: DataFrame, word: str, columns: list[str]) -> DataFrame:
    """Rows in which any of the columns contains the word."""
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.col(c), F.lit(word)), F.lit(False))
    return df.where(hit)


def clamped(limit: int, least: int = 1, most: int = 20) -> int:
    """A page size within its bounds."""
    return max(least, min(limit, most))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The rows of one page; the order should end in a unique column."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def lookup(df: DataFrame, other: DataFrame, key: str, other_key: str, columns: list[str]) -> DataFrame:
    """Left lookup of columns by key; of repeated keys one row, the smallest, counts as a whole."""
    first = other.groupBy(other_key).agg(F.min(F.struct(*columns)).alias("_first"))
    keys = first.select(F.col(other_key).alias(key), *[F.col(f"_first.{c}").alias(c) for c in columns])
    return df.join(keys, key, "left")


def sales_summary(sales: DataFrame) -> DataFrame:
    """Total, count and mean over all, by product and by region, with each group's share of the total."""
    sums = sales.groupingSets([[], ["product"], ["region"]], "product", "region").agg(F.sum("amount").cast("double").alias("amount"), F.count(F.lit(1)).alias("n"))
    whole = sales.agg(F.sum("amount").cast("double").alias("_total"), F.lit(1).alias("_k"))
    return sums.withColumn("_k", F.lit(1)).join(F.broadcast(whole), "_k").select("product", "region", F.col("amount").alias("total"), "n", F.round(F.col("amount") / F.col("n"), 4).alias("mean"), F.round(F.col("amount") * 100 / F.col("_total"), 4).alias("share"))


def sales_ranking(sales: DataFrame, n: int) -> DataFrame:
    best = sales.groupBy("sales_person").agg(F.sum("amount").cast("double").alias("total")).orderBy(F.desc("total"), "sales_person").limit(n)
    return best.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("total"), "sales_person")).cast("long"))


def week_trend(sales: DataFrame) -> DataFrame:
    """By week of the month, (day - 1) / 7 + 1; equal weeks of several months fall together."""
    week = (F.floor((F.dayofmonth("date") - 1) / 7) + 1).cast("long")
    return sales.groupBy(week.alias("week")).agg(F.sum("amount").cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


def period(name: str, today: str) -> tuple[Column, Column]:
    """First day, and first day after, of a relative period."""
    day = F.to_date(F.lit(today))
    month, quarter, year = (F.to_date(F.date_trunc(u, day)) for u in ("month", "quarter", "year"))
    return {
        "this_month": (month, F.add_months(month, 1)), "last_month": (F.add_months(month, -1), month), "this_quarter": (quarter, F.add_months(quarter, 3)),
        "last_quarter": (F.add_months(quarter, -3), quarter), "this_year": (year, F.add_months(year, 12)),
    }[name]


def ticket_summary(tickets: DataFrame) -> DataFrame:
    """Counts by status and urgency and the resolve rate, over all, by product and by region."""
    st = lambda s: F.count_if(F.col("status") == s)
    return tickets.groupingSets([[], ["product"], ["region"]], "product", "region").agg(
        F.count(F.lit(1)).alias("n"), st("open").alias("open"), st("in_progress").alias("in_progress"), st("closed").alias("closed"),
        F.count_if(F.col("priority").isin("1-URGENT", "2-HIGH")).alias("pressing"), F.round(F.count_if(F.col("status").isin("resolved", "closed")) / F.count(F.lit(1)), 4).alias("resolve_rate"),
    )


def ticket_list(tickets: DataFrame, priorities: list[str], n: int) -> DataFrame:
    """By position in the list of priorities, then newest."""
    place = F.array_position(F.array(*[F.lit(p) for p in priorities]), F.col("priority"))
    return tickets.orderBy(F.when(place == 0, len(priorities) + 1).otherwise(place), F.desc("create_date"), "ticket_id").limit(n)


def ticket_stats(tickets: DataFrame, engineers: int = 5) -> DataFrame:
    """kind, name, n, rate: categories with their share, resolve rates by product, and the engineers with most open tickets."""
    counted = tickets.groupBy(F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    whole = tickets.agg(F.count(F.lit(1)).alias("_all"), F.lit(1).alias("_k"))
    category = counted.withColumn("_k", F.lit(1)).join(F.broadcast(whole), "_k").select(F.lit("category").alias("kind"), "name", "n", F.round(F.col("n") * 100 / F.col("_all"), 4).alias("rate"))
    product = tickets.groupBy(F.col("product").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("status").isin("resolved", "closed").cast("int")), 4).alias("rate")).select(F.lit("product").alias("kind"), "name", "n", "rate")
    busiest = tickets.where("status = 'open'").groupBy(F.col("engineer").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(engineers)
    return category.unionByName(product).unionByName(busiest.select(F.lit("engineer").alias("kind"), "name", "n", F.lit(None).cast("double").alias("rate")))
