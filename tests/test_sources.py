import json
import sqlite3

from pyspark.sql import functions as F

from ledgerline.sources import readers, writers


def test_csv_round_trip_and_append(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ('b "q", c', "x", 2)], "old string, new string, n int")
    writers.write_csv(df, f"{tmp_path}/c", ["new", "old"])
    back = readers.csv_strings(spark, f"{tmp_path}/c")
    assert back.columns == ["new", "old"] and sorted(map(tuple, back.collect())) == [("", "a"), ("x", 'b "q", c')]
    writers.append_csv(back, spark.createDataFrame([("", "a"), ("new", "z")], "new string, old string"), f"{tmp_path}/c", ["old", "new"])
    assert readers.csv_strings(spark, f"{tmp_path}/c").count() == 3


def test_key_from_the_file_name(spark, tmp_path):
    for year in (1850, 1860):
        (tmp_path / f"ward_census_{year}.csv").write_text(f"ward,n\n1,{year}\n")
    got = readers.csv_by_name(spark, f"{tmp_path}/ward_census_*.csv", r"_(\d+)\.csv$", "year").collect()
    assert sorted((r["n"], r["year"]) for r in got) == [("1850", "1850"), ("1860", "1860")]


def test_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n\nfour")
    assert [r["line"] for r in readers.lines(spark, f"{tmp_path}/a.txt").orderBy("line_no").collect()] == ["one", "two", "", "four"]


def test_words_below_the_header(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<D><OBJECT width="100" height="200"><WORD coords="1,30,9,10">HEAD</WORD><WORD coords="5,90,20,80">Pratt</WORD></OBJECT></D>')
    assert [tuple(r)[1:] for r in readers.xml_words(spark, f"{tmp_path}/a.xml", 0.25).collect()] == [(5.0, 80.0, 20.0, 90.0, "Pratt")]


def test_features_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", -76.6, 39.3), (None, -76.5, 39.2)], "name string, lon double, lat double")
    writers.write_feature_collection(df, f"{tmp_path}/f", ["name"], "lon", "lat")
    got = {r["properties"]["name"]: json.loads(r["coordinates"]) for r in readers.geojson(spark, f"{tmp_path}/f").collect()}
    assert got == {"a": [-76.6, 39.3], None: [-76.5, 39.2]}
    writers.write_geojson_lines(df, f"{tmp_path}/l", ["name"], "lon", "lat")
    assert all(json.loads(r["value"])["type"] == "Feature" for r in spark.read.text(f"{tmp_path}/l").collect())
    writers.write_json(df, f"{tmp_path}/j")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/j").collect())[1] == '{"name":null,"lon":-76.5,"lat":39.2}'


def test_control_points(spark, tmp_path):
    writers.write_points(spark.createDataFrame([(1.5, 2.5, 10, 20)], "x double, y double, px int, py int"), f"{tmp_path}/p", ["x", "y"], ["px", "py"])
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/p").collect()] == ["mapX,mapY,pixelX,pixelY,enable", "1.5,2.5,10,-20,1"]


def test_sqlite_stata_and_tables(spark, tmp_path):
    import pandas as pd

    with sqlite3.connect(tmp_path / "a.db") as store:
        store.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        store.executemany("INSERT INTO t VALUES (?, ?)", [(i, None if i == 3 else f"n{i}") for i in range(5)])
    got = readers.sqlite(spark, f"{tmp_path}/a.db", "SELECT id, name FROM t WHERE id > 0", "id int, name string", f"{tmp_path}/t", 2)
    assert sorted((r["id"], r["name"]) for r in got.collect()) == [(1, "n1"), (2, "n2"), (3, None), (4, "n4")]
    assert readers.sqlite(spark, f"{tmp_path}/a.db", "SELECT id, name FROM t WHERE id > 9", "id int, name string", f"{tmp_path}/e").count() == 0
    pd.DataFrame({"age": [999.0, 30.0], "sex": [9, 1]}).to_stata(tmp_path / "a.dta", write_index=False)
    assert readers.stata(spark, f"{tmp_path}/a.dta", f"{tmp_path}/s", 1).agg(F.sum("age")).first()[0] == 1029.0
    writers.write_table(got, f"{tmp_path}/w", ["id"])
    assert spark.read.parquet(f"{tmp_path}/w").count() == 4


def test_missing_and_wrong_files(spark, tmp_path):
    assert readers.or_empty(spark, lambda: readers.csv_strings(spark, f"{tmp_path}/none.csv"), "a string").count() == 0
    (tmp_path / "good.gz").write_bytes(b"\x1f\x8b rest")
    (tmp_path / "bad.gz").write_bytes(b"<html>log in</html>")
    assert {r["path"].rsplit("/", 1)[1]: r["good"] for r in readers.checked(spark, f"{tmp_path}/*.gz", b"\x1f\x8b").collect()} == {"good.gz": True, "bad.gz": False}
    keyed = spark.createDataFrame([('{"1850|Adams|Dennis": {"ward": "3"}}',)], "t string").select(F.explode(readers.keyed_json(F.col("t"), "struct<ward:string>", ["year", "surname", "given"])).alias("e"))
    assert keyed.select("e.year", "e.given", "e.value.ward").first()[:] == ("1850", "Dennis", "3")
