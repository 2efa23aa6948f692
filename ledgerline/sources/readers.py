"""Readers for the record formats: text lines in order, HTML, CSV with the key in the file name, GeoJSON, Stata, keyed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, in order within each file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def html_lines(html: Column) -> Column:
    """The lines of an HTML text: tags end them, entities are read, white space is one space, empty ones go."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", "\n")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    each = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.filter(each, lambda x: x != "")


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a string, quotes doubled inside quotes; what is absent is '', not null."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', emptyValue="", nullValue="\0").na.fill("")


def csv_by_name(spark: SparkSession, path: str, pattern: str, key: str) -> DataFrame:
    """csv_strings of several files with a column taken from the file name by the pattern's first group."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', emptyValue="", nullValue="\0")
    return raw.withColumn(key, F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)).na.fill("")


def xml_words(spark: SparkSession, path: str, header: float) -> DataFrame:
    """(page, x0, y0, x1, y1, word) of OCR words below the header zone, a share of the page's height."""
    schema = T.StructType([T.StructField("_width", T.DoubleType()), T.StructField("_height", T.DoubleType()), T.StructField("WORD", T.ArrayType(T.StructType([T.StructField("_coords", T.StringType()), T.StructField("_VALUE", T.StringType())])))])
    pages = spark.read.format("xml").option("rowTag", "OBJECT").schema(schema).load(path).withColumn("page", F.monotonically_increasing_id())
    words = pages.select("page", "_height", F.explode("WORD").alias("w")).select("page", "_height", F.split("w._coords", ",").alias("c"), F.col("w._VALUE").alias("word"))
    at = [F.get("c", i).try_cast("double").alias(n) for i, n in ((0, "x0"), (3, "y0"), (2, "x1"), (1, "y1"))]
    return words.select("page", *at, "word", "_height").filter(F.col("y0") >= F.col("_height") * header).drop("_height")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties map, kind, coordinates as JSON) of the features of a FeatureCollection."""
    raw = spark.read.text(path, wholetext=True)
    kind = "struct<features: array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>>"
    return raw.select(F.explode(F.from_json("value", kind)["features"]).alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def keyed_json(text: Column, value: str, names: list[str]) -> Column:
    """An array of struct(names…, value) of a JSON object whose keys join the names by |."""
    entries = F.map_entries(F.from_json(text, f"map<string, {value}>"))
    return F.transform(entries, lambda e: F.struct(*[F.get(F.split(e["key"], r"[|]"), i).alias(n) for i, n in enumerate(names)], e["value"].alias("value")))


def stata(spark: SparkSession, path: str, folder: str, rows: int = 200_000) -> DataFrame:
    """A Stata file, by chunks, as Parquet in a shared folder; codes stay codes."""
    import pandas as pd

    with pd.read_stata(path, chunksize=rows, convert_categoricals=False) as chunks:
        for i, chunk in enumerate(chunks):
            spark.createDataFrame(chunk).write.mode("overwrite" if i == 0 else "append").parquet(folder)
    return spark.read.parquet(folder)


def sqlite(spark: SparkSession, path: str, query: str, schema: str, folder: str, rows: int = 200_000) -> DataFrame:
    """A query of a SQLite file that the driver can open, by chunks, as Parquet in a shared folder."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as store:
        cursor, mode = store.execute(query), "overwrite"
        while (chunk := cursor.fetchmany(rows)) or mode == "overwrite":
            spark.createDataFrame(chunk, schema).write.mode(mode).parquet(folder)
            mode = "append"
    return spark.read.parquet(folder)


def checked(spark: SparkSession, path: str, magic: bytes, least: int = 1) -> DataFrame:
    """(path, good) of files: whether each has at least so many bytes and begins with the magic ones; a page that was saved
    in place of data does not."""
    head = F.substring(F.col("content"), 1, len(magic))
    return spark.read.format("binaryFile").load(path).select("path", ((F.col("length") >= least) & (F.hex(head) == magic.hex().upper())).alias("good"))


def or_empty(spark: SparkSession, read, schema: T.StructType | str) -> DataFrame:
    """What read() gives, or no rows of the schema where its files are missing."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
