import numpy as np
from pyspark.sql import functions as F

from ledgerline.functions import printed
from ledgerline.operators import folds, linkage, statistics
from ledgerline.plans import catalogue

ROW = "id int, r array<struct<x: int, word: string>>"


def test_column_heads_however_read(spark):
    rows = {1: [(10, "Left."), (90, "Right.")], 2: [(10, "Lafl."), (90, "Ei'/ht.")], 3: [(10, "Right."), (90, "Left.")], 4: [(10, "L"), (40, "12"), (90, "R")], 5: [(10, "Left.")], 6: [(10, "Lombard"), (50, "Light"), (90, "Right")], 7: [(10, "Leftwards"), (90, "Right")], 8: []}
    got = {r["id"]: r["h"] and tuple(r["h"]) for r in spark.createDataFrame(list(rows.items()), ROW).select("id", printed.column_heads(F.col("r")).alias("h")).collect()}
    assert got == {1: (10, 90), 2: (10, 90), 3: None, 4: None, 5: None, 6: None, 7: None, 8: None}


def test_numbers_go_to_the_nearer_head(spark):
    rows = {1: [(12, "55"), (88, "56."), (200, "Saratoga"), (240, "st.")], 2: [(50, "7"), (52, "9"), (200, "Pratt")], 3: [(12, "55"), (14, "57"), (15, "x")]}
    got = {r["id"]: tuple(r["t"]) for r in spark.createDataFrame(list(rows.items()), ROW).select("id", printed.table_row(F.col("r"), F.lit(10), F.lit(90), F.lit(150)).alias("t")).collect()}
    assert got == {1: ("55", "56", "Saratoga st"), 2: ("7", "9", "Pratt"), 3: ("55", "", "")}


def test_forward_picks_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [[float(x) for x in rng.integers(0, 30, rng.integers(0, 4))] for _ in range(int(rng.integers(0, 8)))]) for i in range(60)]
    got = {r["i"]: r["p"] for r in spark.createDataFrame(rows, "i int, c array<array<double>>").select("i", folds.forward_picks(F.col("c")).alias("p")).collect()}
    for i, groups in rows:
        last, want = -1.0, []
        for own in groups:
            at = min([d for d in own if d > last] or own, default=None)
            last = max(last, at) if at is not None else last
            want.append(at)
        assert got[i] == want


def test_links_with_payload_and_agreement(spark):
    df = spark.createDataFrame([("1860|a|b", 1), ("1860|c|d", 2), (None, 3)], "key string, n int")
    links = spark.createDataFrame([("1860|a|b", "3", "03"), ("1860|x|y", "", "4")], "key string, ours string, theirs string").withColumn("agree", linkage.agreement(F.col("ours"), F.col("theirs")))
    got = {r["n"]: r["link"] and r["link"]["agree"] for r in linkage.enriched(df, links, "key", ["ours", "agree"]).collect()}
    assert got == {1: True, 2: None, 3: None}
    assert links.filter("agree is null").count() == 1


def test_published_p_value():
    assert round(statistics.fisher_exact(11, 3, 9, 5), 4) == 0.6776


def test_cluster_heads_of_a_long_array_in_one_pass(spark):
    rows = {1: [1.0, 5.0, 5.5, 9.0, 10.0], 2: [], 3: None, 4: [None, 1.0, 9.0], 5: [2.0, 2.0, float("inf"), float("inf")], 6: [float(x // 3) for x in range(120_000)]}
    got = {r["i"]: r["h"] for r in spark.createDataFrame(list(rows.items()), "i int, v array<double>").select("i", folds.cluster_heads(F.col("v"), 4.0).alias("h")).collect()}
    assert [got[i] for i in range(1, 6)] == [[1, 1, 5.5, 5.5, 10], [], None, [None] * 3, [2, 2, float("inf"), float("inf")]]
    assert got[6] == [float(x // 15 * 5) for x in range(120_000)]


def test_visual_rows_count_equal_places_and_brands_without_any(spark, tmp_path):
    rows = [("a", x % 3 * 10) for x in range(1000)] + [("b", None), ("c", 7)]
    spark.createDataFrame(rows, "p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_brand"]: tuple(r)[1:] for r in catalogue.visual_rows(spark, str(tmp_path)).collect()}
    assert got == {"a": (1000, 3, 20.0), "b": (0, 0, None), "c": (1, 1, 7.0)}
