"""Printed tables of numbers at cross streets: headings, column heads and rows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.names import squeezed

#: How a house number opens, and what is no entry of a directory but a line of its furniture.
HOUSE_NUMBER = r"^(\d+)"
FURNITURE = r"^[A-Z\s.,'&]+$"


def clean_name(text: Column) -> Column:
    """A printed name with plain apostrophes, single spaces and no stops or dashes around it."""
    plain = squeezed(F.translate(text, "—’", " '"))
    return F.regexp_replace(plain, r"^[ .,\-]+|[ .,\-]+$", "")


def heading(line: Column) -> Column:
    """struct(name, extent): the words in capitals that a line opens with, and what follows them. Null: both ''."""
    words = F.filter(F.split(F.coalesce(line, F.lit("")), r"\s+"), lambda w: w != "")
    small = F.transform(words, lambda w: (F.upper(w) != w) | (F.lower(w) == w))
    at = F.array_position(small, True)
    n = F.when(at == 0, F.size(words)).otherwise(at - 1).cast("int")
    return F.struct(clean_name(F.array_join(F.slice(words, 1, n), " ")).alias("name"), clean_name(F.array_join(F.slice(words, n + 1, F.size(words)), " ")).alias("extent"))


def column_heads(row: Column) -> Column:
    """struct(left, right): the places of "Left." and "Right." above a table, however badly read; null for other rows.

    row: array of struct(x, word), from left to right. Such a row has two or three short words and no number; one opens with
    L, and one after it with R or E, or ends in "ht".
    """
    words = F.transform(row, lambda w: F.struct(w["x"].alias("x"), F.regexp_replace(w["word"], "^[ .,]+|[ .,]+$", "").alias("t")))
    left = F.filter(words, lambda w: w["t"].rlike("^[Ll]"))
    right = F.filter(words, lambda w: w["t"].rlike("^[RrEe]|[Hh][Tt]$"))
    fit = F.size(row).between(2, 3) & ~F.exists(words, lambda w: (F.length(w["t"]) > 7) | w["t"].rlike(HOUSE_NUMBER)) & (F.size(left) == 1) & (F.size(right) == 1)
    a, b = F.get(left, 0)["x"], F.get(right, 0)["x"]
    return F.when(fit & (a < b), F.struct(a.alias("left"), b.alias("right")))


def table_row(row: Column, left: Column, right: Column, name: Column) -> Column:
    """struct(left_no, right_no, cross_street): the first number nearer to each head, and the words from the place `name` on.

    A number as near to one head as to the other is the left one's; '' where there is none.
    """
    numbers = F.filter(row, lambda w: (w["x"] < name) & w["word"].rlike(HOUSE_NUMBER))

    def first(of) -> Column:
        return F.coalesce(F.regexp_extract(F.get(F.filter(numbers, of), 0)["word"], HOUSE_NUMBER, 1), F.lit(""))

    cross = F.array_join(F.transform(F.filter(row, lambda w: w["x"] >= name), lambda w: w["word"]), " ")
    ours = first(lambda w: F.abs(w["x"] - left) <= F.abs(w["x"] - right))
    others = first(lambda w: F.abs(w["x"] - left) > F.abs(w["x"] - right))
    return F.struct(ours.alias("left_no"), others.alias("right_no"), clean_name(cross).alias("cross_street"))


def is_entry(line: Column) -> Column:
    """Whether a line can be an entry: twelve characters or more, and not capitals and stops alone. Null is none."""
    return F.coalesce((F.length(line) >= 12) & ~line.rlike(FURNITURE), F.lit(False))
