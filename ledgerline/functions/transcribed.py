"""The grammar of transcribed directories as column expressions; that of scanned ones is in addresses.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Neighbourhood tags behind an address, bearings, words for nearness, and what opens an address.
HOODS = "(?:ot|fp|fh|sg|ra|hc|wp|gh|op|nl)"
BEARINGS = "(?:n|s|e|w|ne|nw|se|sw|north|south|east|west)"
NEARNESS = r"(?:near|opposite|opp\.?|adjoining)"
ADDRESS_OPENS = r"(?i)^(?:cor\b|corner\b|near\b|opposite\b|opp\b|rear\b|end\b|foot\b|head\b|side\b|back\b|\d|[nsew]\.?\s|[nsew]\.?\s*(?:side|end|of)\b)"
GIVEN = r"^[A-Z][A-Za-z'’\-\.]*\.?$"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "^[ .,]+|[ .,]+$", "")


def without_hood(address: Column) -> Column:
    """An address without neighbourhood tags and marks of doubt."""
    a = F.regexp_replace(address, r"\(\?+\)", " ")
    a = F.regexp_replace(a, rf"(?i)[,\s]+{HOODS}\b\.?\s*$", "")
    a = F.regexp_replace(a, rf"(?i)[,\s]+{HOODS}\b\.?(?=[,\s])", " ")
    return _bare(F.regexp_replace(a, r"\s+", " "))


def address(raw: Column) -> Column:
    """struct(addr_type, house_no, street, bearing, cross_street, side); '' where absent.

    A corner names two streets. Nearness joins a street and a cross street unless a bearing with "of" stands there too. Else
    a side is taken out; a bearing with "of", or before a capital, leads from a cross street; the rest is a street alone,
    which a house number makes numbered.
    """
    a, blank = without_hood(F.coalesce(raw, F.lit(""))), F.lit("")
    corner, near, side = r"(?i)^cor\.?\s+(.+?)\s*[&x]\s*(.+)$", rf"(?i)^(.+?)[,\s]+{NEARNESS}\s+(.+)$", rf"(?i)\b({BEARINGS})\.?\s+side\b"
    is_corner = a.rlike(corner)
    is_near = ~is_corner & a.rlike(near) & ~a.rlike(rf"(?i)\b{BEARINGS}\.?\s+of\b")
    plain = ~is_corner & ~is_near
    sided = plain & a.rlike(side)
    b = F.when(sided, _bare(F.regexp_replace(a, rf"^(.*?){side}", "$1 "))).otherwise(a)
    by_of, by_capital = rf"^(.*?)\b(?i:({BEARINGS})\.?\s+(?:of|off)\b)\s*(.*)$", rf"^(.*?)\b({BEARINGS})\.?\s+(?=[A-Z])(.+)$"
    has_of = plain & b.rlike(by_of)
    has_capital = plain & ~has_of & b.rlike(by_capital)

    def part(i: int) -> Column:
        return F.when(has_of, F.regexp_extract(b, by_of, i)).when(has_capital, F.regexp_extract(b, by_capital, i))

    street = F.when(is_corner, _bare(F.regexp_extract(a, corner, 1))).when(is_near, _bare(F.regexp_extract(a, near, 1))).otherwise(F.coalesce(_bare(part(1)), b))
    cross = F.when(is_corner, _bare(F.regexp_extract(a, corner, 2))).when(is_near, _bare(F.regexp_extract(a, near, 2))).otherwise(F.coalesce(_bare(part(3)), blank))
    lead = r"^(\d+)\s+(.*)$"
    opens = ~is_corner & street.rlike(lead)
    kind = F.when(a == "", "unknown").when(is_corner, "corner").when(is_near, "near").when(has_of | has_capital, "relative").when(opens, "numbered").otherwise("street_only")
    return F.struct(
        kind.alias("addr_type"),
        F.when(opens, F.regexp_extract(street, lead, 1)).otherwise(blank).alias("house_no"),
        F.when(opens, F.regexp_extract(street, lead, 2)).otherwise(street).alias("street"),
        F.coalesce(F.substring(F.lower(part(2)), 1, 1), blank).alias("bearing"),
        cross.alias("cross_street"),
        F.when(sided, F.substring(F.lower(F.regexp_extract(a, side, 1)), 1, 1)).otherwise(blank).alias("side"),
    )


def entry(line: Column) -> Column:
    """struct(surname, given, occupation, addr_raw) of a line; null without a comma.

    The second field is a given name if it is one capitalised word and not the last; the next is a trade if it opens with a
    small letter and not as an address does. All that is left is the address.
    """
    fields = F.transform(F.split(line, ",", -1), lambda p: F.trim(p))
    second = F.get(fields, 1)
    named = second.rlike(GIVEN) & (F.size(fields) > 2)
    rest = F.slice(fields, F.when(named, 3).otherwise(2), F.size(fields))
    first = F.get(rest, 0)
    trade = first.rlike("^[a-z]") & ~first.rlike(ADDRESS_OPENS)
    return F.when(
        F.size(fields) >= 2,
        F.struct(
            F.regexp_replace(F.get(fields, 0), "^[ .]+|[ .]+$", "").alias("surname"),
            F.when(named, F.regexp_replace(second, "^[ .]+|[ .]+$", "")).otherwise(F.lit("")).alias("given"),
            F.when(trade, first).otherwise(F.lit("")).alias("occupation"),
            F.array_join(F.when(trade, F.slice(rest, 2, F.size(rest))).otherwise(rest), ", ").alias("addr_raw"),
        ),
    )
