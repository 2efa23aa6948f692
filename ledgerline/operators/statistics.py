"""Segregation, correlation, regression and exact tests."""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dissimilarity(df: DataFrame, minority: str, majority: str) -> DataFrame:
    """(dissimilarity): half the sum over areas of |minority share - majority share|."""
    whole = df.agg(F.sum(minority).alias("_b"), F.sum(majority).alias("_w"))
    terms = df.crossJoin(F.broadcast(whole))
    return terms.agg((0.5 * F.sum(F.abs(F.col(minority) / F.nullif(F.col("_b"), F.lit(0)) - F.col(majority) / F.nullif(F.col("_w"), F.lit(0))))).alias("dissimilarity"))


def dispersion(df: DataFrame, share: str) -> DataFrame:
    """(sd, cv): sample deviation of the areas' shares, and that over their plain mean."""
    return df.agg(F.stddev_samp(share).alias("sd"), (F.stddev_samp(share) / F.avg(share)).alias("cv"))


def location_quotient(df: DataFrame, part: str, whole: str) -> DataFrame:
    """df with `quotient`: an area's share over the share of all areas."""
    total = df.agg(F.sum(part).alias("_p"), F.sum(whole).alias("_w"))
    return df.crossJoin(F.broadcast(total)).withColumn("quotient", (F.col(part) / F.nullif(F.col(whole), F.lit(0))) / F.nullif(F.col("_p") / F.col("_w"), F.lit(0.0))).drop("_p", "_w")


def least_squares(df: DataFrame, x: list[str], y: str) -> tuple[list[float], float]:
    """(coefficients, root mean square residual) of y on 1 and x: one pass of sums, and a small system on the driver."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    cells = [F.sum(a * b).alias(f"m{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    row = df.agg(*cells, *[F.sum(a * F.col(y)).alias(f"v{i}") for i, a in enumerate(terms)], F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n")).first()
    k = len(terms)
    m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    v = np.array([row[f"v{i}"] for i in range(k)])
    c = np.linalg.solve(m, v)
    return c.tolist(), float(np.sqrt(max(0.0, row["yy"] - c @ v) / row["n"]))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of the table [[a, b], [c, d]]: tables as likely or less, with the same margins."""
    row, col, n = a + b, a + c, a + b + c + d

    def ways(x: int) -> int:
        return comb(row, x) * comb(n - row, col - x)

    own = ways(a)
    return sum(w for x in range(max(0, col - (n - row)), min(row, col) + 1) if (w := ways(x)) <= own) / comb(n, col)


def true_share(observed: float, true: float, chance: float) -> float:
    """f of observed = f true + (1 - f) chance."""
    return (observed - chance) / (true - chance)
