"""The weighted ratio of two names, and the best entry of a lexicon by it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerline.operators import joins


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & at.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, of 100."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter name with a stretch of the longer that is no longer than it."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    m = len(short)
    return max(ratio(short, long[max(0, i) : i + m]) for i in range(1 - m, len(long)))


def _tokens(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def _token_ratio(a: str, b: str) -> float:
    ordered = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    both, x, y = _tokens(a, b)
    if not both:
        return max(ordered, ratio(x, y) if x and y else 0.0)
    if not x or not y:
        return 100.0
    return max(ordered, ratio(both, f"{both} {x}"), ratio(both, f"{both} {y}"), ratio(f"{both} {x}", f"{both} {y}"))


def _partial_token_ratio(a: str, b: str) -> float:
    both, x, y = _tokens(a, b)
    return 100.0 if both else max(partial_ratio(x, y) if x and y else 0.0, partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


def weighted_ratio(a: str | None, b: str | None) -> float:
    """0 to 100: the plain ratio, or that of tokens (x 0.95), or, where lengths differ by 1.5 times, of stretches.

    Null and empty names have 0 with all. Fixed values, as the scorer is published: 1.5, 8, 0.95, 0.9, 0.6.
    """
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    if apart < 1.5:
        return max(ratio(a, b), 0.95 * _token_ratio(a, b))
    scale = 0.9 if apart < 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * _partial_token_ratio(a, b))


@F.pandas_udf(DoubleType())
def weighted_ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x, y) for x, y in zip(a, b)], dtype=float)


def _keys(name: Column, cutoff: float) -> Column:
    """Keys of which two names share one if their weighted ratio reaches the cutoff.

    Either they share a token, or one of their forms (as they stand, tokens sorted, distinct tokens sorted) is within so few
    insertions and deletions that of its numbered character pairs, in one order of all pairs, the first ones meet.
    """
    tokens = F.filter(F.split(name, r"\s+"), lambda t: t != "")

    def pairs(kind: str, form: Column) -> Column:
        padded = F.concat(F.lit("\x02"), form, F.lit("\x03"))
        each = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2))
        numbered = F.transform(each, lambda p, i: F.xxhash64(F.lit(kind), p, F.size(F.filter(F.slice(each, 1, i), lambda q: q == p))))
        edits = F.floor(F.lit((1 - cutoff / 100) * 200 / cutoff) * F.length(form) + 1e-9).cast("int")
        return F.slice(F.array_sort(numbered), 1, 2 * edits + 1)

    ordered = F.array_sort(tokens)
    forms = [pairs("plain", name), pairs("sorted", F.array_join(ordered, " ")), pairs("distinct", F.array_join(F.array_distinct(ordered), " "))]
    return F.array_distinct(F.concat(*forms, F.transform(tokens, lambda t: F.xxhash64(F.lit("token"), t))))


def best_match(probes: DataFrame, name: str, lexicon: DataFrame, entry: str, cutoff: float = 92.0) -> DataFrame:
    """probes with `resolved`, the lexicon's entry of the largest weighted ratio, and `score`; ties: smallest entry.

    Null under the cutoff, which must be over 90: no name less than 1.5 times apart in length is then lost, and stretches
    cannot reach it. Only distinct names and entries that share a key meet, and each pair is scored once.
    """
    if not 90 < cutoff <= 100:
        raise ValueError("the cutoff must be over 90 and at most 100")
    a = probes.select(F.col(name).alias("_n")).filter(F.length(name) > 0).distinct().select("_n", F.explode(_keys(F.col("_n"), cutoff)).alias("_k"))
    b = lexicon.select(F.col(entry).alias("_e")).filter(F.length(entry) > 0).distinct().select("_e", F.explode(_keys(F.col("_e"), cutoff)).alias("_k"))
    long, short = F.greatest(F.length("_n"), F.length("_e")), F.least(F.length("_n"), F.length("_e"))
    met = a.join(b, "_k").filter(long < 1.5 * short).select("_n", "_e").distinct()
    scored = met.select("_n", "_e", weighted_ratio_of("_n", "_e").alias("_s")).filter(F.col("_s") >= cutoff)
    best = joins.first_wins(scored, ["_n"], [F.col("_s").desc(), "_e"]).select("_n", F.col("_e").alias("resolved"), F.col("_s").alias("score"))
    return probes.join(best, probes[name] == F.col("_n"), "left").drop("_n")


def resolve(probes: DataFrame, name: str, lexicon: DataFrame, entry: str, aliases: DataFrame, old: str, new: str, rank: str, cutoff: float = 92.0) -> DataFrame:
    """probes with `resolved` and `how`: exact; the first alias by rank that is an entry; the best entry by weighted ratio; the
    best entry for the first alias by rank that has one; else null.

    Empty names resolve to nothing. Each step takes only the distinct names that those before it left.
    """
    names = probes.select(F.col(name).alias("_n")).filter(F.length(name) > 0).distinct()
    entries = lexicon.select(F.col(entry).alias("_e")).distinct()
    pairs = aliases.select(F.col(old).alias("_n"), F.col(new).alias("_new"), F.col(rank).alias("_r"))
    exact = names.join(entries, F.col("_n") == F.col("_e"), "left_semi").select("_n", F.col("_n").alias("resolved"), F.lit("exact").alias("how"))
    left = names.join(exact.select("_n"), "_n", "left_anti")
    known = pairs.join(left, "_n", "left_semi").join(entries, F.col("_new") == F.col("_e"), "left_semi")
    alias = joins.first_wins(known, ["_n"], ["_r", "_new"]).select("_n", F.col("_new").alias("resolved"), F.lit("alias").alias("how"))
    left = left.join(alias.select("_n"), "_n", "left_anti")
    scored = best_match(left.select(F.col("_n").alias("_probe")), "_probe", entries, "_e", cutoff).filter("resolved is not null").select(F.col("_probe").alias("_n"), "resolved", F.lit("fuzzy").alias("how"))
    left = left.join(scored.select("_n"), "_n", "left_anti")
    others = best_match(pairs.join(left, "_n", "left_semi").filter(F.length("_new") > 0).withColumnRenamed("_n", "_probe"), "_new", entries, "_e", cutoff).filter("resolved is not null")
    by_alias = joins.first_wins(others, ["_probe"], ["_r", "_new"]).select(F.col("_probe").alias("_n"), "resolved", F.lit("fuzzy alias").alias("how"))
    found = exact.unionByName(alias).unionByName(scored).unionByName(by_alias)
    return probes.join(found, probes[name] == F.col("_n"), "left").drop("_n")
