"""Ordered folds inside arrays, and groups by running flags."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def monotone(values: Column) -> Column:
    """The values kept from an array when each must go further than the last kept one, in the direction most steps take."""
    v = F.filter(values, lambda x: x.isNotNull())
    steps = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda a, b: F.signum(b.cast("double") - a.cast("double")))
    way = F.when(F.aggregate(steps, F.lit(0.0), lambda s, d: s + F.coalesce(d, F.lit(0.0))) < 0, -1.0).otherwise(1.0)
    kept = F.aggregate(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1), lambda out, x: F.when((x.cast("double") - F.element_at(out, -1).cast("double")) * way > 0, F.concat(out, F.array(x))).otherwise(out))
    return F.when(F.size(v) < 2, v).otherwise(kept)


@F.arrow_udf(ArrayType(DoubleType()))
def _heads(values: pa.Array, gap: pa.Array) -> pa.Array:
    out = []
    for row, g in zip(values, gap.to_pylist()):
        heads = row.as_py()
        for i in range(1, len(heads or [])):
            x, head = heads[i], heads[i - 1]
            if head is None or x is None or x - head <= g:
                heads[i] = head
        out.append(heads)
    return pa.array(out, pa.list_(pa.float64()))


def cluster_heads(values: Column, gap: float) -> Column:
    """For each value of a sorted array, the head of its cluster: a value further than gap from its head opens one.

    In one pass, by Arrow: an array that an aggregate() adds to is copied whole for each value.
    """
    return _heads(values.cast("array<double>"), F.lit(float(gap)))


def runs(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "run") -> DataFrame:
    """df with the number of its run: a run opens where `starts` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_s", starts.cast("int")).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def join_lines(lines: Column) -> Column:
    """Lines as one text: after a hyphen the next line follows at once and the hyphen goes, else after a space."""
    return F.aggregate(lines, F.lit(""), lambda out, x: F.when(out == "", x).when(out.endswith("-"), F.concat(F.left(out, F.length(out) - 1), x)).otherwise(F.concat(out, F.lit(" "), x)))


def between_markers(df: DataFrame, by: list[str], order: str, marker: Column) -> DataFrame:
    """The rows of each group from its first marked row to its last."""
    w = Window.partitionBy(*by)
    at = F.when(marker, F.col(order))
    return df.withColumn("_a", F.min(at).over(w)).withColumn("_z", F.max(at).over(w)).filter((F.col(order) >= F.col("_a")) & (F.col(order) <= F.col("_z"))).drop("_a", "_z")


def carried(df: DataFrame, by: list[str], order: list[str], names: list[str]) -> DataFrame:
    """df with nulls of the named columns filled by the last value before them in the order, within `by`."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in names})


def forward_picks(candidates: Column) -> Column:
    """For each array of places, in order, the smallest beyond the furthest picked so far, else the smallest; null if empty."""

    def step(state: Column, own: Column) -> Column:
        at = F.coalesce(F.array_min(F.filter(own, lambda d: d > state["last"])), F.array_min(own))
        return F.struct(F.greatest(state["last"], at).alias("last"), F.concat(state["out"], F.array(at)).alias("out"))

    start = F.struct(F.lit(-1.0).alias("last"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(candidates, start, step, lambda state: state["out"])


def section(df: DataFrame, by: list[str], place: str, header: Column, end: Column, beyond: int = 250) -> DataFrame:
    """The rows of each group from its first header on: up to the first end after it, else `beyond` places past the last header.

    Headers themselves go, and groups without one.
    """
    w = Window.partitionBy(*by)
    at = F.col(place)
    opened = df.withColumns({"_h": F.coalesce(header, F.lit(False)), "_e": F.coalesce(end, F.lit(False))})
    opened = opened.withColumns({"_a": F.min(F.when(F.col("_h"), at)).over(w), "_z": F.max(F.when(F.col("_h"), at)).over(w)})
    opened = opened.withColumn("_stop", F.coalesce(F.min(F.when(F.col("_e") & (at > F.col("_a")), at)).over(w), F.col("_z") + beyond))
    return opened.filter((at >= F.col("_a")) & (at < F.col("_stop")) & ~F.col("_h")).drop("_h", "_e", "_a", "_z", "_stop")
