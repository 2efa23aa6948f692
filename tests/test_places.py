import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import addresses, geometry, names, projection
from ledgerline.operators import folds, fuzzy, spatial

POINTS = "array<struct<x:double,y:double>>"


def test_weighted_ratio_of_published_examples():
    assert fuzzy.weighted_ratio("this is a test", "this is a new test!!!") == pytest.approx(85.5)
    assert fuzzy.ratio("this is a test", "this is a test!") == pytest.approx(96.5517, abs=1e-3)
    assert fuzzy.weighted_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == pytest.approx(95.0)
    assert fuzzy.weighted_ratio(None, "a") == fuzzy.weighted_ratio("", "") == 0


@pytest.mark.parametrize("cutoff", [91.0, 92.0, 97.0])
def test_best_match_equals_comparing_all(spark, cutoff):
    rng = random.Random(cutoff)
    words = ["NORTH", "CHARLES", "SARATOGA", "ST", "LITTLE", "MCELDERRY", "OLD", "LA", "A", "B"]

    def name() -> str:
        s = " ".join(rng.choices(words, k=rng.randint(1, 4)))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(s) + 1)
            s = s[:i] + rng.choice(["", "A", "X", " "]) + s[i + rng.randint(0, 1) :]
        return s

    probes, entries = sorted({name() for _ in range(150)}), sorted({name() for _ in range(150)} - {""})
    got = fuzzy.best_match(spark.createDataFrame([(n,) for n in [*probes, None]], "n string"), "n", spark.createDataFrame([(e,) for e in [*entries, None, ""]], "e string"), "e", cutoff)
    want = {None: None}
    for n in probes:
        score, e = min((-fuzzy.weighted_ratio(n, e), e) for e in entries)
        want[n] = e if -score >= cutoff else None
    assert {r["n"]: r["resolved"] for r in got.collect()} == want


def test_a_low_cutoff_is_refused(spark):
    df = spark.createDataFrame([("a",)], "n string")
    with pytest.raises(ValueError):
        fuzzy.best_match(df, "n", df, "n", 90)


def test_overlap_of_polygons_that_are_not_convex():
    rng = np.random.default_rng(1)

    def star() -> np.ndarray:
        a, r = np.sort(rng.uniform(0, 2 * np.pi, 9)), rng.uniform(1, 5, 9)
        return np.c_[r * np.cos(a) + rng.uniform(-2, 2), r * np.sin(a) + rng.uniform(-2, 2)]

    steps = (np.arange(200) + 0.5) * 16 / 200 - 8
    for _ in range(3):
        a, b = star(), star()
        cells = sum(spatial._inside(a, x, y) and spatial._inside(b, x, y) for x in steps for y in steps) * (16 / 200) ** 2
        assert spatial.ring_overlap(a, b) == pytest.approx(cells, abs=0.25)
        assert spatial.ring_overlap(a, a) == pytest.approx(abs(spatial._area(a)))
        assert spatial.ring_overlap(a, b[::-1]) == pytest.approx(spatial.ring_overlap(b, a))


def test_longest_line_merges_and_clips(spark):
    rows = [("A", [(0.0, 0.0), (100.0, 0.0)]), ("A", [(200.0, 0.0), (100.0, 0.0)]), ("A", [(0.0, 90.0), (10.0, 90.0)]), ("B", [(5.0, -5.0), (5.0, 500.0)]), ("C", None), ("C", [(1.0, 1.0)])]
    lines = spark.createDataFrame(rows, f"k string, p {POINTS}")
    whole = {r["k"]: [tuple(p) for p in r["points"]] for r in spatial.longest_line(lines, "k", "p").collect()}
    assert whole == {"A": [(0, 0), (100, 0), (200, 0)], "B": [(5, -5), (5, 500)]}
    cut = {r["k"]: [tuple(p) for p in r["points"]] for r in spatial.longest_line(lines, "k", "p", [(50, -1), (120, -1), (120, 9), (50, 9)]).collect()}
    assert cut == {"A": [(50, 0), (100, 0), (120, 0)]}
    ring = [np.array([(0.0, 0.0), (1.0, 0.0)]), np.array([(1.0, 0.0), (1.0, 1.0), (0.0, 0.0)])]
    assert [c.tolist() for c in spatial.merge_chains(ring)] == [[[0, 0], [1, 0], [1, 1], [0, 0]]]


def test_adjacency_and_crossings_leave_out_what_has_no_shape(spark):
    shapes = spark.createDataFrame([(1, None), (2, []), (3, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]), (4, [(2.0, -1.0), (2.0, 9.0), (3.0, 9.0)])], f"k int, p {POINTS}")
    assert [(r["key_a"], r["key_b"], r["distance"]) for r in spatial.adjacent(shapes, "k", "p", 1.0, 3.0).collect()] == [(3, 4, 0.0)]
    assert [(r["x"], r["y"]) for r in spatial.crossings(shapes, "k", "p", 3.0).collect()] == [(2.0, 0.0)]
    assert spatial.adjacent(shapes.limit(0), "k", "p", 1.0, 3.0).count() == 0


def test_placement_without_street_crossing_or_side(spark):
    lines = spark.createDataFrame([("A", [(0.0, 0.0), (200.0, 0.0)])], f"street string, p {POINTS}")
    meets = spark.createDataFrame([("A", "B", 50.0), ("A", "C", 150.0)], "street string, crossing string, at double")
    rows = [(1, "A", "B", "e", "n"), (2, "A", "B", "w", ""), (3, "A", "B", None, None), (4, "Z", "B", "n", "n"), (5, "A", "Q", "e", "n"), (6, "A", "C", "e", "s")]
    people = spark.createDataFrame(rows, "id int, street string, crossing string, bearing string, side string")
    got = {r["id"]: (r["x"], r["y"], r["tier"]) for r in spatial.place_on_blocks(people, "street", "crossing", "bearing", "side", lines, "p", meets, "at").collect()}
    assert got == {1: (90, 7, "block_face"), 2: (38, 0, "block_face"), 3: (50, 0, "corner"), 4: (None, None, None), 5: (None, None, None), 6: (162, -7, "block_face")}


def test_distance_along_angle_and_simplify(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)],), ([(0.0, 0.0), (5.0, 0.1), (9.0, 0.0)],), (None,)], f"p {POINTS}")
    at = df.select(geometry.distance_along(F.col("p"), F.lit(12.0), F.lit(4.0)).alias("d"), geometry.label_angle(F.lit(-1.0), F.lit(0.0)).alias("a")).collect()
    assert [r["d"] for r in at[:1]] == [14.0] and at[2]["d"] is None and at[0]["a"] == 0
    assert [r["p"] and len(r["p"]) for r in spatial.simplify(df, "p", 1.0).collect()] == [3, 2, None]


def test_entries_and_aliases(spark):
    lines = ["Adams Dennis, coachman, 11 Temple", "Barnet Stephen, caulker, Wolfe st s of Fleet", "Adams Charles, labourer. Pierce st w of Pearl", "f Smith, John, barber, 5 Pratt, dw 214 Montgomery", "nothing", ",", "", None]
    got = [r["e"] and tuple(r["e"]) for r in spark.createDataFrame([(x,) for x in lines], "l string").select(addresses.entry(F.col("l")).alias("e")).collect()]
    assert got == [("Adams", "Dennis", "coachman", "", "11 Temple"), ("Barnet", "Stephen", "caulker", "", "Wolfe st s of Fleet"), ("Adams", "Charles", "labourer", "", "Pierce st w of Pearl"), ("Smith", "John", "barber", "214 Montgomery", "214 Montgomery"), None, ("", "", "", "", ""), None, None]
    stated = ["Dover Alley: now Pin 1850 and so on", "Old Lane: was Elder Row", "Apple: see Pear (b)", "Oak: now opened", "Oak: now Oak St", "Oak: now Elm, later", "x", None]
    pairs = [[tuple(p) for p in r["p"]] for r in spark.createDataFrame([(x,) for x in stated], "l string").select(names.alias_pairs(F.col("l")).alias("p")).collect()]
    assert pairs == [[("DOVER", "PIN", "now")], [("ELDER ROW", "OLD", "was")], [("APPLE", "PEAR", "see"), ("PEAR", "APPLE", "see")], [], [], [], [], []]


def test_conic_round_trip_and_true_scale_on_its_parallels(spark):
    conic = projection.Conic()
    df = spark.createDataFrame([(-77.0, 37 + 40 / 60), (-76.6122, 39.2904), (-79.4, 38.3), (-75.1, 39.45), (None, 39.0)], "lon double, lat double")
    step = 1e-5
    out = df.withColumn("p", conic.to_metres(F.col("lon"), F.col("lat"))).withColumn("q", conic.to_metres(F.col("lon") + step, F.col("lat"))).withColumn("d", conic.to_degrees(F.col("p.x"), F.col("p.y"))).collect()
    assert (out[0]["p"]["x"], out[0]["p"]["y"]) == (pytest.approx(400_000.0), pytest.approx(0.0, abs=1e-6))
    assert out[4]["p"] is None and out[4]["d"] is None
    for r in out[:4]:
        assert (r["d"]["lon"], r["d"]["lat"]) == (pytest.approx(r["lon"], abs=1e-9), pytest.approx(r["lat"], abs=1e-9))
    for r in out[2:4]:
        phi = np.radians(r["lat"])
        e2 = conic.flattening * (2 - conic.flattening)
        true = conic.axis * np.cos(phi) / np.sqrt(1 - e2 * np.sin(phi) ** 2) * np.radians(step)
        assert np.hypot(r["q"]["x"] - r["p"]["x"], r["q"]["y"] - r["p"]["y"]) == pytest.approx(true, rel=1e-6)


def test_aliases_of_notes_and_carried_values(spark):
    rows = [("Gravel al", "now Tyson street from Eutaw"), ("Pearl st", "(formerly Gravel al)"), ("Oak st", "now the alley"), ("Oak st", "now called Elm, late Ash row"), ("Oak st", None), (None, "now Elm")]
    got = spark.createDataFrame(rows, "s string, n string").select(names.note_alias_pairs(F.col("s"), F.col("n")).alias("p")).collect()
    assert [[tuple(p) for p in r["p"]] for r in got] == [[("GRAVEL", "TYSON", "now")], [("GRAVEL", "PEARL", "formerly")], [], [("OAK", "ELM", "now"), ("ASH ROW", "OAK", "formerly")], [], []]
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("b", 1, None)], "k string, i int, v string")
    assert sorted((r["k"], r["i"], r["v"]) for r in folds.carried(df, ["k"], ["i"], ["v"]).collect() if r["v"]) == [("a", 2, "x"), ("a", 3, "x")]


def test_crossings_equal_all_pairs_and_parallel_lines_make_none(spark, monkeypatch):
    rng, meet, made = np.random.default_rng(5), spatial._meet, []
    monkeypatch.setattr(spatial, "_meet", lambda *a, **k: made.append(meet(*a, **k)) or made[-1])
    ends = [[(0.0, 3.0), (9.0, 3.0)]] * 200 + [[(4.0, -1.0), (4.0, 9.0)], [(6.0, 3.0), (6.0, 3.0)]] + rng.integers(-6, 7, (40, 2, 2)).astype(float).tolist()
    rows = [(k, [tuple(p) for p in e]) for k, e in enumerate(ends)]
    got = sorted(tuple(r) for r in spatial.crossings(spark.createDataFrame(rows, f"k int, p {POINTS}"), "k", "p", 5.0).collect())
    lines = spark.createDataFrame([(k, *e) for k, e in rows], "k int, a struct<x:double,y:double>, b struct<x:double,y:double>")
    all_pairs = lines.alias("l").crossJoin(lines.alias("r")).filter("l.k < r.k").select("l.k", "r.k", geometry.segment_crossing(F.col("l.a"), F.col("l.b"), F.col("r.a"), F.col("r.b")).alias("p"))
    want = sorted((a, b, round(p["x"], 6), round(p["y"], 6)) for a, b, p in all_pairs.collect() if p)
    assert len(want) > 200 and [x[:2] for x in got] == [x[:2] for x in want] and np.allclose(got, want, atol=1e-6)
    assert len(made[0].collect()) < 200 * 199 / 2


def test_a_line_of_an_index_is_read_once(spark):
    assert str(names.street_key(F.col("l"))).count("upper(") == 1
    told = str(names.alias_pairs(F.col("l")))
    assert told.count("upper(") == 2 and told.count("trim(l)") == 1


def test_a_note_is_read_once(spark):
    told = str(names.note_alias_pairs(F.col("s"), F.col("n")))
    assert told.count("upper(") == 3 and told.count("coalesce(n,") == 2


def test_an_entry_and_its_address_are_read_once(spark):
    assert str(addresses.entry(F.col("l"))).count("split(") == 2
    assert str(addresses.address(F.col("l"))).count("coalesce(l,") == 1
