"""Casts, guards, filters and codes as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that running text has and no street's name, and how sure each tier is.
PROSE = r"(?i)\b(?:for instance|consult|hence|desired|right hand|examine|counting|arrive|observe|example|going up|wish to|you will|so as to)\b"
TIERS = {"bracketed": 0, "single_anchor": 1, "extrapolated": 1, "street_proportional": 2, "block_face": 0, "corner": 0}
#: Lower ends of the classes of a map, for percentages and for values per dwelling.
PCT_CUTS, VALUE_CUTS = (5, 10, 15, 21), (100_000, 200_000, 400_000, 600_000)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once a row; a plain column is repeated, whole, at each place that names it."""
    return F.get(F.transform(F.array(value), body), 0)


def number(raw: Column, kind: str = "double") -> Column:
    """raw as a number; null, blank and what is none stay null, never 0."""
    return F.trim(raw).try_cast(kind)


def digits(raw: Column, kind: str = "int") -> Column:
    """raw as a number if it is digits alone, else null."""
    return F.when(raw.rlike("^[0-9]+$"), raw.try_cast(kind))


def blank_to_null(raw: Column, most: int | None = None) -> Column:
    """raw without the space around it, null if nothing is left, cut at `most` characters."""
    bare = F.nullif(F.trim(raw), F.lit(""))
    return F.substring(bare, 1, most) if most else bare


def year_keyed(year: Column, columns: Mapping[int, Sequence[str]], otherwise: Column) -> Column:
    """The sum of the columns that the year asks for, nulls as 0; `otherwise` in the years that ask for none.

    Which columns exist says nothing: files of every year have all of them, zero where the year did not ask.
    """
    out = F.coalesce(otherwise, F.lit(0))
    for y, names in columns.items():
        total = F.lit(0)
        for c in names:
            total = total + F.coalesce(F.col(c), F.lit(0))
        out = F.when(year == y, total).otherwise(out)
    return out


def coded(df: DataFrame, codes: Mapping[str, int | str]) -> DataFrame:
    """The rows with these codes. Files that code a level otherwise must be asked by the levels that they share."""
    for c, v in codes.items():
        df = df.filter(F.col(c) == F.lit(v))
    return df


def is_prose(name: Column) -> Column:
    """Whether a name is running text: over four words, a phrase of such, or several words that open with a small letter."""
    n = F.size(F.filter(F.split(name, r"\s+"), lambda w: w != ""))
    return (n > 4) | name.rlike(PROSE) | (name.rlike("^[a-z]") & (n > 1))


def trusted(found: Column, confidence: Column) -> Column:
    """Whether a check was answered yes with high or medium confidence."""
    return F.coalesce((found == "yes") & confidence.isin("high", "medium"), F.lit(False))


def tier_code(tier: Column) -> Column:
    """0 for the surest tiers to 2, which unknown ones have too."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), F.coalesce(tier, F.lit(""))), F.lit(2))


def map_class(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the cuts a value reaches; null without a value."""
    out = F.lit(0)
    for c in cuts:
        out = out + (value >= c).cast("int")
    return F.when(value.isNotNull(), out)


def counted(listed: Column, placed: Column) -> Column:
    """A sentence on how many were listed and placed, by which of the counts there are; '' without a count of those placed."""
    n, p = F.format_number(listed, 0), F.format_number(placed, 0)
    both = F.concat(n, F.lit(" residents parsed from the volume, "), p, F.lit(" placed on a map."))
    return F.when((listed > 0) & (placed > 0), both).when(placed > 0, F.concat(p, F.lit(" residents placed on a map."))).otherwise("")
