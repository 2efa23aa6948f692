"""Aggregations: composition, medians, bands, top-k and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 part / whole, rounded; null for an empty whole."""
    return F.round(part * 100.0 / F.nullif(whole, F.lit(0)), digits)


def upper_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by…, n, upper_median): the value at place n div 2 from 0, the upper one of two middle values.

    Values are counted first, so a group is one row for each distinct value, however many rows it has.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    counts = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("n", F.sum("_c").over(w))
    return counts.filter("_upto > n div 2").groupBy(*by).agg(F.max("n").alias("n"), F.min(value).alias("upper_median"))


def banded(df: DataFrame, value: str, bands: Sequence[tuple], aggregates: Sequence[Column], closed: bool = False, sentinels: Sequence[str] = ()) -> DataFrame:
    """Aggregates by band of bands (name, low, high), the first that holds the value; closed: high belongs to its band.

    Bands without rows appear too, but for the sentinels. They come from one row of nulls each, so the aggregates must count
    columns, not rows. A row finds its band by itself: no join.
    """
    at, band = F.col(value), F.lit(None).cast("string")
    for name, low, high in reversed(bands):
        band = F.when((at >= low) & ((at <= high) if closed else (at < high)), F.lit(name)).otherwise(band)
    rows = df.withColumns({"band": band, "_there": F.lit(1)}).filter("band is not null")
    empty = df.sparkSession.createDataFrame([(name,) for name, *_ in bands], "band string")
    got = rows.unionByName(empty, allowMissingColumns=True).groupBy("band").agg(*aggregates, F.count("_there").alias("_there"))
    return got.filter(~F.col("band").isin(*sentinels) | (F.col("_there") > 0)).drop("_there") if sentinels else got.drop("_there")


def top_k(counts: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each group in a total order, with their rank."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def reconciled(df: DataFrame, parts: Sequence[str], total: str, printed: dict[str, int]) -> DataFrame:
    """df, if each row's parts sum to its total and the columns to their printed sums; else the query fails."""
    identity = F.lit(0)
    for p in parts:
        identity = identity + F.col(p)
    sums = df.agg(F.count_if(identity != F.col(total)).alias("_off"), *[F.sum(c).alias(f"_{c}") for c in printed])
    ok = F.col("_off") == 0
    for c, n in printed.items():
        ok &= F.col(f"_{c}") == n
    checked = sums.select(F.assert_true(ok, F.lit("table does not reconcile")).isNull().alias("_ok"))
    return df.join(F.broadcast(checked), F.col("_ok")).drop("_ok")


def to_map(df: DataFrame, by: Sequence[str], key: str, value: str, name: str = "entries") -> DataFrame:
    """One row of each group with a map of its keys to values, in order of the keys; a key that stands twice fails."""
    return df.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name))


def to_list(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rows") -> DataFrame:
    """One row of each group with the list of its structs of the `order` columns, sorted by them."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order))).alias(name))


def largest_totals(df: DataFrame, by: str, value: str, least: float, k: int) -> DataFrame:
    """(by, total): the k largest totals that reach `least`; ties by name."""
    return df.groupBy(by).agg(F.sum(value).alias("total")).filter(F.col("total") >= least).orderBy(F.desc("total"), by).limit(k)


def bars(counts: DataFrame, name: str, n: str, k: int = 18) -> DataFrame:
    """(name, n, width): the k largest counts, ties by name, each with its width in percent of the largest."""
    top = counts.select(name, n).orderBy(F.desc(n), name).limit(k)
    return top.withColumn("width", pct(F.col(n), F.max(n).over(Window.partitionBy(F.lit(1))), 1))
