"""Joins with explicit order and precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row of each key: the first in a total order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key: the last in a total order."""
    return first_wins(df, keys, [F.col(c).desc() for c in order])


def override(base: DataFrame, newer: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """All keys of both; rows of newer replace those of base, but the columns in keep stay those of base."""
    columns = [c for c in dict.fromkeys([*base.columns, *newer.columns]) if c not in keys]
    a, b = base.withColumn("_a", F.lit(True)).alias("a"), newer.withColumn("_b", F.lit(True)).alias("b")

    def pick(c: str) -> Column:
        if c in keep or c not in newer.columns:
            return F.col(f"a.{c}").alias(c)
        if c not in base.columns:
            return F.col(f"b.{c}").alias(c)
        return F.when(F.col("b._b"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    return a.join(b, list(keys), "full_outer").select(*keys, *[pick(c) for c in columns])


def append_new(existing: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of more whose keys existing lacks, one of each key."""
    return more.join(existing.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))


def filled(base: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of base, and the rows of more whose keys base lacks; columns as in base."""
    return base.unionByName(more.join(base.select(*keys).distinct(), list(keys), "left_anti").select(*base.columns))


def back_joined(df: DataFrame, known: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """df with `value` of the first known row, in a total order, whose keys read the same but for case and outer space.

    A null key finds nothing.
    """
    same = [F.lower(F.trim(F.col(c).cast("string"))) for c in keys]
    names = [f"_k{i}" for i in range(len(keys))]
    build = known.select(*[k.alias(n) for k, n in zip(same, names, strict=True)], F.col(value).alias("_v"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    build = first_wins(build, names, [f"_o{i}" for i in range(len(order))]).select(*names, "_v")
    probes = df.select(F.struct(*df.columns).alias("_row"), *[k.alias(n) for k, n in zip(same, names, strict=True)])
    met = probes.join(build, names, "left")
    return met.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c != value], F.col("_v").alias(value))


def next_after(left: DataFrame, right: DataFrame, key: str, at: str, beyond: str, slack: float = 0.0) -> DataFrame:
    """left with the smallest `beyond` of right, for the same key, strictly after `at` + slack; null if there is none.

    One shuffle by key and one window over the union, whose frame grows from its far end: no row meets another row. Rows
    with a null `at`, and repeated ones, stay; null values of right count for nothing.
    """
    return _nearest(left, right, key, F.col(at) + slack if slack else F.col(at), beyond, True)


def last_before(left: DataFrame, right: DataFrame, key: str, at: str, beyond: str, slack: float = 0.0) -> DataFrame:
    """left with the largest `beyond` of right, for the same key, strictly before `at` - slack; null if there is none."""
    return _nearest(left, right, key, F.col(at) - slack if slack else F.col(at), beyond, False)


def _nearest(left: DataFrame, right: DataFrame, key: str, at: Column, beyond: str, later: bool) -> DataFrame:
    own = [c for c in left.columns if c != beyond]
    rows = left.select(F.struct(*own).alias("_row"), F.col(key).alias("_k"), at.alias("_x"), F.lit(0).alias("_side"))
    more = right.filter(F.col(beyond).isNotNull()).select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(key).alias("_k"), F.col(beyond).alias("_x"), F.lit(1).alias("_side"), F.col(beyond).alias("_y"))
    both = rows.unionByName(more, allowMissingColumns=True)
    order = F.col("_x").desc_nulls_last() if later else F.col("_x").asc_nulls_last()
    seen = F.last("_y", ignorenulls=True).over(Window.partitionBy("_k").orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_y", F.when(F.col("_x").isNotNull(), seen)).filter("_side = 0")
    return found.select(*[F.col("_row").getField(c).alias(c) for c in own], F.col("_y").alias(beyond))


def bracket(rungs: DataFrame, probes: DataFrame, key: str | Sequence[str], at: str, value: str, probe: str, extrapolate: bool = False) -> DataFrame:
    """probes with `interpolated` between the two neighbouring rungs of the same key that enclose `probe`, and `confidence`.

    confidence is "bracketed", "extrapolated" (outside the rungs, by the nearest two of them, if asked for) or null, as is
    `interpolated` then and for keys with fewer than two rungs. Of rungs at one place the first by value counts at that
    place. All probes stay, repeated and unmatched ones too. One window over the union of rungs and probes passes over each
    key once each way; a key's first and last two rungs, which extrapolate, are one row.
    """
    keys = [key] if isinstance(key, str) else list(key)
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    by = [f"_k{i}" for i in range(len(keys))]
    rung = F.struct(F.col(at).cast("double").alias("x"), F.col(value).cast("double").alias("v"))
    steps = rungs.filter(F.col(at).isNotNull() & F.col(value).isNotNull()).select(*named, rung.alias("_r"))
    place = Window.partitionBy(*by)
    ranked = steps.withColumn("_i", F.row_number().over(place.orderBy("_r"))).withColumn("_j", F.row_number().over(place.orderBy(F.desc("_r"))))
    ends = ranked.filter("_i <= 2 or _j <= 2").groupBy(*by).agg(*[F.max(F.when(F.col(c) == i, F.col("_r"))).alias(f"{c}{i}") for c in ("_i", "_j") for i in (1, 2)])
    rows = probes.select(F.struct(*probes.columns).alias("_row"), *named, F.col(probe).cast("double").alias("_x"), F.lit(1).alias("_side"))
    both = rows.unionByName(steps.select(*by, "_r", F.col("_r.x").alias("_x"), F.col("_r.v").alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    up = place.orderBy(F.asc_nulls_first("_x"), "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = place.orderBy(F.desc_nulls_last("_x"), "_side", F.desc("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_a", F.last("_r", ignorenulls=True).over(up)).withColumn("_b", F.last("_r", ignorenulls=True).over(down)).filter("_side = 1")
    same = F.lit(True)
    for c in by:
        same &= F.col(f"m.{c}").eqNullSafe(F.col(f"e.{c}"))
    met = met.alias("m").join(ends.alias("e"), same, "left")

    def line(a: Column, b: Column) -> Column:
        return F.when(a["x"] == b["x"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col("_x") - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)))

    two, a, b = F.col("_i2").isNotNull() & F.col("_x").isNotNull(), F.col("_a"), F.col("_b")
    inside = two & a.isNotNull() & b.isNotNull()
    got = F.when(inside & (b["x"] == F.col("_x")), b["v"]).when(inside, line(a, b))
    how = F.when(inside, F.lit("bracketed"))
    if extrapolate:
        got = got.when(two & a.isNull(), line(F.col("_i1"), F.col("_i2"))).when(two, line(F.col("_j2"), F.col("_j1")))
        how = how.when(two, F.lit("extrapolated"))
    return met.select(*[F.col("_row").getField(c).alias(c) for c in probes.columns], got.alias("interpolated"), how.alias("confidence"))


def two_sided(rungs: DataFrame, probes: DataFrame, key: str, side: str, at: str, value: str, probe: str, row_id: str, length: str) -> DataFrame:
    """probes with `distance` along a line, `side` and `confidence`: by the left ladder, or by the right one if that alone brackets.

    rungs have a ladder for each key and side ("left", "right"); row_id names a probe. The distance is kept within 0 and the
    column `length`. Probes that neither ladder places stay with nulls.
    """
    each = probes.withColumn(side, F.explode(F.array(F.lit("left"), F.lit("right"))))
    placed = bracket(rungs, each, [key, side], at, value, probe, extrapolate=True).filter("confidence is not null")
    order = F.struct((F.col("confidence") != "bracketed").alias("late"), F.col(side).alias("side"))
    best = placed.groupBy(F.col(row_id).alias("_id")).agg(F.min(F.struct(order.alias("o"), "interpolated", "confidence")).alias("b"))
    found = probes.join(best, probes[row_id] == F.col("_id"), "left")
    within = F.greatest(F.lit(0.0), F.least(F.col("b.interpolated"), F.col(length).cast("double")))
    return found.select(*probes.columns, F.when(F.col("b").isNotNull(), within).alias("distance"), F.col("b.o.side").alias(side), F.col("b.confidence").alias("confidence"))


def proportional(number: Column, low: Column, high: Column, note: Column, dx: Column, dy: Column) -> Column:
    """The share of a line at which a number stands between the lowest and highest seen on it; the middle if they are one.

    The line is turned if the note names a direction (north, south, east, west; the first of these that it holds) that the
    line, which goes by (dx, dy) from its first point to its last, starts from at the wrong end.
    """
    share = F.when(high == low, 0.5).otherwise((number - low) / F.nullif((high - low).cast("double"), F.lit(0.0)))
    text = F.lower(F.coalesce(note, F.lit("")))
    turned = F.when(text.contains("north"), dy < 0).when(text.contains("south"), dy > 0).when(text.contains("east"), dx < 0).when(text.contains("west"), dx > 0).otherwise(F.lit(False))
    return F.when((high != low) & turned, 1.0 - share).otherwise(share)


def directional(probes: DataFrame, core: str, direction: str, known: DataFrame, known_core: str, known_direction: str, value: str) -> DataFrame:
    """probes with `value` of the known row of the same core and direction if there is one, else of that without a direction."""
    own = known.filter(F.col(known_direction) != "").select(F.col(known_core).alias("_c"), F.col(known_direction).alias("_d"), F.col(value).alias("_own"))
    plain = known.filter(F.col(known_direction) == "").select(F.col(known_core).alias("_p"), F.col(value).alias("_plain"))
    met = probes.join(own, (probes[core] == F.col("_c")) & (probes[direction] == F.col("_d")), "left").join(plain, probes[core] == F.col("_p"), "left")
    return met.select(*probes.columns, F.coalesce("_own", "_plain").alias(value))


def best_ladder(probes: DataFrame, row_id: str, key: str, number: str, ladders: DataFrame, ladder_key: str, ladder: str, order: str) -> DataFrame:
    """probes with the ladder to use: the only one of their key, or of several the one with the longest side that brackets
    the number, first by `order`; null if none of several does.

    ladders(ladder_key, ladder, order, low, high, rungs): a row for each side, with its lowest and highest number.
    """
    brackets = F.when((F.col("rungs") >= 2) & F.col(number).between(F.col("low"), F.col("high")), F.col("rungs")).otherwise(0)
    sides = ladders.select(F.col(ladder_key).alias("_k"), F.col(ladder).alias("_l"), F.col(order).alias("_o"), "low", "high", "rungs")
    scored = probes.join(sides, probes[key] == F.col("_k")).groupBy(F.col(row_id).alias("_id"), "_l").agg(F.max(brackets).alias("_s"), F.min("_o").alias("_o"))
    best = scored.groupBy("_id").agg(F.count("*").alias("_n"), F.min(F.struct((-F.col("_s")).alias("s"), F.col("_o").alias("o"), F.col("_l").alias("l"))).alias("_b"))
    best = best.filter("_n = 1 or _b.s < 0").select("_id", F.col("_b.l").alias(ladder))
    return probes.join(best, probes[row_id] == F.col("_id"), "left").drop("_id")


def _pieces(text: Column, distance: int) -> Column:
    """An array of struct(i, at, piece): text in distance + 1 pieces, the later ones a letter longer where it does not go up evenly."""
    n, parts = F.length(text), distance + 1
    at = F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda i: F.floor(n * i / parts).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda i: F.struct(i.alias("i"), F.get(at, i).alias("at"), F.substring(text, F.get(at, i) + 1, F.get(at, i + 1) - F.get(at, i)).alias("piece")))


def within_distance(names: DataFrame, name: str, entries: DataFrame, entry: str, distance: int) -> DataFrame:
    """(name, entry, d) of all pairs of distinct names and entries whose edit distance d is at most `distance`.

    An entry is cut into distance + 1 pieces, of which an edit leaves at least one whole: it stands in the name, no further
    than the distance from its place. Names and entries meet by such pieces only, and no pair is lost.
    """
    cut_up = entries.select(F.col(entry).alias("_e")).distinct().select("_e", F.length("_e").alias("_len"), F.explode(_pieces(F.col("_e"), distance)).alias("_p")).select("_e", "_len", F.col("_p.i").alias("_i"), F.col("_p.piece").alias("_t"))
    ours = names.select(F.col(name).alias("_n")).distinct()
    ours = ours.select("_n", F.explode(F.sequence(F.greatest(F.lit(0), F.length("_n") - distance), F.length("_n") + distance)).alias("_len"))
    ours = ours.select("_n", "_len", F.explode(_pieces(F.repeat(F.lit(" "), F.col("_len")), distance)).alias("_p"), "_len").select("_n", ours["_len"], "_p")
    ours = ours.select("_n", "_len", F.col("_p.i").alias("_i"), F.length("_p.piece").alias("_w"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("_p.at") - distance), F.col("_p.at") + distance)).alias("_at"))
    ours = ours.filter(F.col("_at") + F.col("_w") <= F.length("_n")).select("_n", "_len", "_i", F.substring(F.col("_n"), F.col("_at") + 1, F.col("_w")).alias("_t")).distinct()
    met = ours.join(cut_up, ["_len", "_i", "_t"]).select("_n", "_e").distinct()
    return met.withColumn("d", F.levenshtein("_n", "_e", distance)).filter("d >= 0").select(F.col("_n").alias(name), F.col("_e").alias(entry), "d")


def cascade(probes: DataFrame, name: str, lexicon: DataFrame, entry: str, aliases: DataFrame, old: str, new: str, distance: int) -> DataFrame:
    """probes with `resolved` and `how`: exact, then by the first alias, then the nearest entry by edit distance.

    Only distinct unresolved names are compared, with entries that share a piece with them; ties go to the smaller entry.
    """
    names = probes.select(F.col(name).alias("_n")).distinct()
    entries = lexicon.select(F.col(entry).alias("_e")).distinct()
    exact = names.join(entries, F.col("_n") == F.col("_e"), "left")
    alias = first_wins(aliases.select(F.col(old).alias("_n"), F.col(new).alias("_new")).join(entries, F.col("_new") == F.col("_e"), "left_semi"), ["_n"], ["_new"])
    step = exact.join(alias, "_n", "left")
    found = step.filter("_e is not null or _new is not null").select("_n", F.coalesce("_e", "_new").alias("resolved"), F.when(F.col("_e").isNotNull(), "exact").otherwise("alias").alias("how"))
    near = within_distance(step.filter("_e is null and _new is null").select("_n"), "_n", entries, "_e", distance)
    near = first_wins(near, ["_n"], ["d", "_e"]).select("_n", F.col("_e").alias("resolved"), F.lit("fuzzy").alias("how"))
    return probes.join(found.unionByName(near), probes[name] == F.col("_n"), "left").drop("_n")


def in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Pairs of points and boxes (x0, y0, x1, y1) that hold them, half open, by grid cell: an equi-join before the test."""
    cx, cy = F.floor(F.col(x) / cell), F.floor(F.col(y) / cell)
    spread = boxes.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    met = points.withColumn("_cx", cx).withColumn("_cy", cy).join(spread, ["_cx", "_cy"])
    return met.filter((F.col(x) >= F.col("x0")) & (F.col(x) < F.col("x1")) & (F.col(y) >= F.col("y0")) & (F.col(y) < F.col("y1"))).drop("_cx", "_cy")
