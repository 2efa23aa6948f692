"""Writers: CSV with fixed columns, appending of new rows, GeoJSON, compact JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.joins import append_new


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """The fields in their order, with '' for null."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields]).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def append_csv(existing: DataFrame, more: DataFrame, path: str, keys: Sequence[str]) -> None:
    append_new(existing, more, keys).write.mode("append").csv(path, header=True, emptyValue="", escape='"')


def feature(properties: Sequence[str], lon: str, lat: str) -> Column:
    """A GeoJSON point feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry")), {"ignoreNullFields": "false"})


def write_geojson_lines(df: DataFrame, path: str, properties: Sequence[str], lon: str, lat: str) -> None:
    """One feature a line, written in parallel."""
    df.select(feature(properties, lon, lat).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A full rebuild of a table, partitioned where an index would stand."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path) if by else df.write.mode("overwrite").parquet(path)


def write_feature_collection(df: DataFrame, path: str, properties: Sequence[str], lon: str, lat: str) -> None:
    """One FeatureCollection in one file, for a table of a size that one file is meant for."""
    rows = df.select(feature(properties, lon, lat).alias("f")).agg(F.sort_array(F.collect_list("f")).alias("f"))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("f", ","), F.lit("]}"))
    rows.select(whole.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One compact object a line, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_points(df: DataFrame, path: str, world: Sequence[str], pixel: Sequence[str]) -> None:
    """Control points as a georeferencer reads them: world x and y, pixel x, and pixel y counted downwards as negative."""
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in world], F.col(pixel[0]).cast("string"), (-F.col(pixel[1])).cast("string"), F.lit("1"))
    head = df.sparkSession.createDataFrame([(0, "mapX,mapY,pixelX,pixelY,enable")], "o int, value string")
    df.select(F.lit(1).alias("o"), line.alias("value")).unionByName(head).coalesce(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)
