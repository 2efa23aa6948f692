import numpy as np
from pyspark.sql import functions as F

from ledgerline.functions import transcribed
from ledgerline.operators import fuzzy, joins, statistics


def test_bracket_keeps_every_probe(spark):
    rungs = spark.createDataFrame([("a", 2, 2287.0), ("a", 254, 1291.0), ("a", 100, 1900.0), ("a", 100, 1800.0), ("b", 7, 1.0)], "k string, no int, d double")
    probes = spark.createDataFrame([("a", 2), ("a", 51), ("a", 51), ("a", 100), ("a", 300), ("a", 1), ("a", None), ("b", 7), ("c", 5)], "k string, house int")
    got = sorted(((r["k"], r["house"], r["interpolated"], r["confidence"]) for r in joins.bracket(rungs, probes, "k", "no", "d", "house", extrapolate=True).collect()), key=str)
    at = {(k, h): (d, c) for k, h, d, c in got}
    assert len(got) == 9 and at[("a", 2)] == (2287.0, "bracketed") and at[("a", 51)] == (2043.5, "bracketed") and at[("a", 100)] == (1800.0, "bracketed")
    assert at[("a", 300)][1] == "extrapolated" and at[("a", 300)][0] < 1291 and at[("a", 1)][0] > 2287 and at[("a", None)] == at[("b", 7)] == at[("c", 5)] == (None, None)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    left = [(i, int(k), int(x)) for i, (k, x) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 40, 60)))] + [(99, 1, None)]
    right = [(int(k), int(x)) for k, x in zip(rng.integers(0, 3, 40), rng.integers(0, 40, 40))] + [(1, None)]
    a, b = spark.createDataFrame(left, "id int, k int, x int"), spark.createDataFrame(right, "k int, y int")
    after = {r["id"]: r["y"] for r in joins.next_after(a, b, "k", "x", "y").collect()}
    before = {r["id"]: r["y"] for r in joins.last_before(a, b, "k", "x", "y", slack=1.5).collect()}
    for i, k, x in left:
        own = [y for q, y in right if q == k and y is not None and x is not None]
        assert after[i] == min((y for y in own if y > x), default=None) and before[i] == max((y for y in own if y < x - 1.5), default=None)


def test_no_pair_within_the_distance_is_lost(spark):
    rng = np.random.default_rng(2)
    names = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 8))) for _ in range(120)})
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    for d in (1, 2):
        got = {(r["n"], r["e"]): r["d"] for r in joins.within_distance(rows, "n", rows.withColumnRenamed("n", "e"), "e", d).collect()}
        want = {(r["n"], r["e"]): r["d"] for r in rows.crossJoin(rows.withColumnRenamed("n", "e")).withColumn("d", F.levenshtein("n", "e")).filter(F.col("d") <= d).collect()}
        assert got == want


def test_resolving_in_order(spark):
    lexicon = spark.createDataFrame([("DALLAS",), ("PERRY",), ("LITTLE MCELDERRY",)], "e string")
    aliases = spark.createDataFrame([("STRAWBERRY", "NOWHERE", 1), ("STRAWBERRY", "DALLAS", 2), ("STRAWBERRY", "PERRY", 3), ("BRANDY", "LITTLE MCELDERY", 1)], "old string, new string, rank int")
    probes = spark.createDataFrame([("DALLAS",), ("STRAWBERRY",), ("LITTLE MCELDERRYS",), ("BRANDY",), ("NONE",), ("",), (None,), ("DALLAS",)], "n string")
    got = [(r["n"], r["resolved"], r["how"]) for r in fuzzy.resolve(probes, "n", lexicon, "e", aliases, "old", "new", "rank").collect()]
    assert sorted(got, key=str) == sorted([("DALLAS", "DALLAS", "exact")] * 2 + [("STRAWBERRY", "DALLAS", "alias"), ("LITTLE MCELDERRYS", "LITTLE MCELDERRY", "fuzzy"), ("BRANDY", "LITTLE MCELDERRY", "fuzzy alias"), ("NONE", None, None), ("", None, None), (None, None, None)], key=str)


def test_choice_of_a_ladder(spark):
    ladders = spark.createDataFrame([("x", "n", 1, 1, 50, 3), ("x", "s", 2, 1, 50, 5), ("y", "only", 1, 1, 9, 2), ("z", "n", 1, 1, 9, 2), ("z", "s", 2, 20, 30, 2)], "k string, l string, o int, low int, high int, rungs int")
    probes = spark.createDataFrame([(1, "x", 10), (2, "y", 99), (3, "z", 15), (4, "z", 25), (5, "w", 1)], "id int, k string, no int")
    got = {r["id"]: r["l"] for r in joins.best_ladder(probes, "id", "k", "no", ladders, "k", "l", "o").collect()}
    assert got == {1: "s", 2: "only", 3: None, 4: "s", 5: None}


def test_shares_along_a_line(spark):
    rows = spark.createDataFrame([(30, 10, 50, "", 0.0, 1.0), (20, 10, 50, "from the North", 0.0, -1.0), (20, 10, 50, "north", 0.0, 1.0), (7, 7, 7, "north", 0.0, -1.0)], "n int, lo int, hi int, note string, dx double, dy double")
    assert [r[0] for r in rows.select(joins.proportional(*[F.col(c) for c in rows.columns])).collect()] == [0.5, 0.75, 0.25, 0.5]


def test_transcribed_entries(spark):
    lines = ["Madden, John, laborer, Strawberry alley, e side s of Smith st, fp", "Adams, coachman, 11 Temple", "Brown, Isaac, near Market", "nothing here"]
    got = [r["e"] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(transcribed.entry(F.col("x")).alias("e")).collect()]
    assert got[0][:] == ("Madden", "John", "laborer", "Strawberry alley, e side s of Smith st, fp") and got[1][:] == ("Adams", "", "coachman", "11 Temple") and got[2][:] == ("Brown", "Isaac", "", "near Market") and got[3] is None


def test_exact_test_of_two_tiers():
    assert round(statistics.fisher_exact(11, 3, 9, 5), 4) == 0.6776 and round(statistics.true_share(0.30, 0.56, 0.061), 3) == 0.479
