"""Mixing sources to target weights by subset-sum budget fitting.

A source takes whole passes of all its documents first. What its target leaves is fitted by document counts per exact
length: a proportional share of each length, then a bounded-knapsack dynamic programme over the words that are left.
Documents are then picked by seeded hash within their length, up to a cut value.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded, cut

#: Words of `[^\x20\x09-\x0D]+` in a text.
WORD = r"[^\x20\x09-\x0D]+"
#: Words that proportional shares leave to the dynamic programme at least; twice the longest document, if that is more.
RESERVE = 50_000
#: Documents of one length that a window ranks at once, about.
RANKED = 2_000


def nearest_sum(lengths: list[int], counts: list[int], goal: int) -> list[int]:
    """How many of each length, at most its count, so that the sum is the nearest to goal; the smaller of two as near.

    Exact: a bounded knapsack over sums as bits of one number. Counts are split into powers of two; the sums that the
    first items reach are kept at every so many items only, and made again where they are needed to trace the choice.
    """
    take = [0] * len(lengths)
    longest = max((n for n, c in zip(lengths, counts, strict=True) if c > 0), default=0)
    if not longest or goal <= 0:
        return take
    span = goal + longest
    mask = (1 << (span + 1)) - 1
    items = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        left, size = min(counts[i], span // lengths[i]) if lengths[i] else 0, 1
        while left > 0:
            size = min(size, left)
            items.append((i, size))
            left -= size
            size *= 2
    stride = max(1, math.isqrt(len(items)))
    kept, reach, used = [], 1, 0
    for k, (i, size) in enumerate(items):
        if k % stride == 0:
            kept.append(reach)
        reach |= (reach << (lengths[i] * size)) & mask
        used = k + 1
        if reach >> goal & 1:
            break
    at = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach >> (goal + 1)
    if above and (above & -above).bit_length() < goal - at:
        at = goal + (above & -above).bit_length()
    while used:
        block = (used - 1) // stride
        before = [kept[block]]
        for i, size in items[block * stride : used - 1]:
            before.append(before[-1] | (before[-1] << (lengths[i] * size)) & mask)
        for (i, size), sums in zip(reversed(items[block * stride : used]), reversed(before), strict=True):
            if not sums >> at & 1:
                take[i] += size
                at -= size * lengths[i]
        used = block * stride
    return take


def fit_lengths(lengths: list[int], counts: list[int], budget: float) -> list[int]:
    """How many documents of each length to take so that their words come as near to budget as they can.

    Never more of a length than its count. Each length gives its share of all words but a reserve, which keeps the mix of
    lengths; the reserve, of twice the longest document at least, is fitted exactly. Where the reserve covers the budget,
    the sum is the nearest that there is.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    goal = min(max(int(round(budget)), 0), total)
    if not goal:
        return [0] * len(lengths)
    longest = max(lengths)
    reserve = max(RESERVE, 2 * longest)
    shared = max(0, goal - reserve)
    take = [shared * c // total for c in counts]
    rest = goal - sum(n * t for n, t in zip(lengths, take, strict=True))
    # Rounding down leaves up to one document of each length: the longest ones first, while the reserve stays.
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if lengths[i] and take[i] < counts[i] and rest - lengths[i] >= reserve:
            take[i] += 1
            rest -= lengths[i]
    more = nearest_sum(lengths, [c - t for c, t in zip(counts, take, strict=True)], rest)
    return [t + m for t, m in zip(take, more, strict=True)]


def fill_targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets in proportion to the weights, that stop at most times a size; excess goes to the others by weight."""
    total = share * sum(sizes)
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        per = total / w if (w := sum(weights[i] for i in sorted(open_))) else 0.0
        full = [i for i in sorted(open_) if weights[i] * per > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = weights[i] * per
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            total -= targets[i]
            open_.discard(i)
    return targets


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of docs(doc_id, text, source).

    size: words of the whole text, 0 for null or empty ones, which take nothing. Sources stand in code point order,
    null last, and weigh `weights`, repeating. taken is 0, 1 or more whole copies of a document's words, at most
    ceil(most) of them. Rows that repeat a doc_id tie and may swap places, which gives the same rows; null ids tie alike.
    An empty table gives no rows; other columns are ignored. The table of sources, one row each, is all that reaches the
    driver; the lengths of one source, a row for each, are fitted in one task.
    """
    docs = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    docs = cut(docs.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")).withColumn("rid", F.monotonically_increasing_id()))
    lengths = cut(docs.groupBy("source", "size").agg(F.count("*").alias("count")))
    found = sorted(((r["source"], int(r["n"])) for r in lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("n")).collect()), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    sizes = [n for _, n in found]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    plan = docs.sparkSession.createDataFrame([(s, n, t) for (s, n), t in zip(found, targets, strict=True)], "source string, source_size bigint, target double")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = int(min(math.floor(target / whole), math.floor(most))) if whole else 0
        rest = target - passes * whole if passes < most else 0.0
        return rows.assign(passes=passes, extra=fit_lengths(rows["size"].tolist(), rows["count"].tolist(), rest))[["source", "size", "count", "source_size", "target", "passes", "extra"]]

    both = lengths.alias("l").join(bounded(plan).alias("p"), F.col("l.source").eqNullSafe(F.col("p.source"))).select("l.source", "size", "count", "source_size", "target")
    chosen = cut(both.groupBy("source").applyInPandas(fit, "source string, size bigint, count bigint, source_size bigint, target double, passes int, extra bigint"))
    chosen = chosen.withColumnsRenamed({"source": "_source", "size": "_size"})
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    # Where a part of a length's documents is taken, they are counted by hash range; only the range that the count ends in
    # is ranked, which gives the draw and row up to which documents are taken.
    ranges = (F.col("count") / F.lit(RANKED)).cast("bigint") + 1
    slot = (F.pmod("draw", F.lit(1 << 31)) * ranges / F.lit(1 << 31)).cast("bigint")
    open_ = docs.join(bounded(chosen.filter("extra > 0 and extra < count").select("_source", "_size", "count", "extra")), same).withColumn("slot", slot)
    by = ["_source", "_size"]
    slots = open_.groupBy(*by, "slot", "extra").agg(F.count("*").alias("here"))
    slots = slots.withColumn("upto", F.sum("here").over(Window.partitionBy(*by).orderBy("slot")))
    last = slots.filter("upto >= extra and upto - here < extra").select(*by, F.col("slot").alias("_slot"), (F.col("extra") - F.col("upto") + F.col("here")).alias("want"))
    last = bounded(cut(last).withColumnsRenamed({"_source": "_s", "_size": "_z"}))
    ending = open_.join(last, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("slot") == F.col("_slot")))
    place = F.row_number().over(Window.partitionBy(*by, "slot").orderBy("draw", "doc_id", "rid"))
    ends = ending.withColumn("place", place).filter("place = want").select(F.col("_source").alias("_s"), F.col("_size").alias("_z"), F.col("slot").alias("_slot"), F.struct("draw", "doc_id", "rid").alias("end"))
    chosen = cut(chosen.join(ends, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")), "left").drop("_s", "_z"))
    upto = (slot < F.col("_slot")) | ((slot == F.col("_slot")) & (F.struct("draw", "doc_id", "rid") <= F.col("end")))
    copies = F.col("passes") + F.when(F.col("extra") == 0, 0).when((F.col("extra") == F.col("count")) | upto, 1).otherwise(0)
    return docs.join(bounded(chosen), same).select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("bigint").alias("taken"))
