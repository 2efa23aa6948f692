"""Address grammars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.values import let

#: Compass bearings as directories print them, and below the forms of an address and of an entry.
BEARING = "north|south|east|west|ne|nw|se|sw|n|s|e|w"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "^[ .,]+|[ .,]+$", "")


def address(raw: Column) -> Column:
    """struct(addr_type, house_no, street, bearing, cross_street, side); '' where absent.

    Of the forms, in this order: a side clause ("e side") is taken out; "<street> <bearing> of <cross street>" is
    relative, with an opening house number if it has one; "<number> <street>" is numbered; the rest is street_only.
    """
    side_at = rf"(?i)\b({BEARING})\.?\s+side\b"
    relative = rf"(?i)^(.*?)\b({BEARING})\.?\s+(?:of|oi|ot)\b\s*(.*)$"
    lead = r"^(\d+)\s+(.*)$"
    numbered = r"^(\d+)\s*[½|]?\s+(.+)$"
    blank = F.lit("")

    def sided(a: Column) -> Column:
        return let(F.lower(F.regexp_extract(a, side_at, 1)), lambda side: let(F.when(side != "", F.trim(F.regexp_replace(a, side_at, " "))).otherwise(a), lambda rest: formed(rest, side)))

    def formed(a: Column, side: Column) -> Column:
        bearing = F.lower(F.regexp_extract(a, relative, 2))
        plain = F.when(a.rlike(numbered), of("numbered", a, side, F.regexp_extract(a, numbered, 1), _bare(F.regexp_extract(a, numbered, 2)))).otherwise(of("street_only", a, side, blank, a))
        return let(bearing, lambda b: F.when(a == "", of("unknown", a, side, blank, a)).when(b != "", let(_bare(F.regexp_extract(a, relative, 1)), lambda before: related(a, side, b, before))).otherwise(plain))

    def related(a: Column, side: Column, bearing: Column, before: Column) -> Column:
        street = F.when(before.rlike(lead), F.regexp_extract(before, lead, 2)).otherwise(before)
        return of("relative", a, side, F.regexp_extract(before, lead, 1), street, bearing, _bare(F.regexp_extract(a, relative, 3)))

    def of(kind: str, a: Column, side: Column, house_no: Column, street: Column, bearing: Column = blank, cross_street: Column = blank) -> Column:
        return F.struct(F.lit(kind).alias("addr_type"), house_no.alias("house_no"), street.alias("street"), bearing.alias("bearing"), cross_street.alias("cross_street"), side.alias("side"))

    return let(_bare(F.coalesce(raw, F.lit(""))), sided)


def entry(line: Column) -> Column:
    """struct(surname, given, occupation, dwelling_raw, addr_raw) of a directory's line; null where it has no comma.

    A clause "dw" names the home, which is then the address. Else the last part is, unless only the parts before it open
    with a number.
    """
    named = r"^([A-Z][A-Za-z'’\-]+)\s+(.*)$"
    home = r"(?i)\bdw\.?\s*(.*)$"

    def headed(parts: Column) -> Column:
        return F.when(F.size(parts) >= 2, let(F.get(parts, 0), lambda head: let(F.regexp_extract(head, named, 2), lambda given: following(parts, head, given))))

    def following(parts: Column, head: Column, given: Column) -> Column:
        later = given == ""
        surname = F.when(head.rlike(named), F.regexp_extract(head, named, 1)).otherwise(head)
        first = F.struct(surname.alias("surname"), _bare(F.when(later, F.coalesce(F.get(parts, 1), F.lit(""))).otherwise(given)).alias("given"))
        rest = F.array_join(F.slice(parts, F.when(later, 3).otherwise(2), F.size(parts)), ", ")
        return let(rest, lambda r: let(_bare(F.regexp_extract(r, home, 1)), lambda dwelling: let(worked(r), lambda segments: ended(first, dwelling, segments))))

    def worked(rest: Column) -> Column:
        work = F.when(rest.rlike(home), _bare(F.regexp_replace(rest, home, ""))).otherwise(rest)
        spaced = F.regexp_replace(work, r"\b([a-z]{3,})\.\s+(?=[A-Z])", "$1, ")
        return F.filter(F.transform(F.split(spaced, ","), lambda p: F.trim(p)), lambda s: s != "")

    def ended(first: Column, dwelling: Column, segments: Column) -> Column:
        last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
        before = F.array_join(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), ", ")
        both = F.struct(last.alias("last"), before.alias("before"))
        return let(both, lambda e: let(e["before"].rlike(r"^\d") & ~e["last"].rlike(r"\d"), lambda swap: fields(first, dwelling, e["last"], e["before"], swap)))

    def fields(first: Column, dwelling: Column, last: Column, before: Column, swap: Column) -> Column:
        return let(first, lambda name: F.struct(
            name["surname"].alias("surname"),
            name["given"].alias("given"),
            F.when(swap, last).otherwise(before).alias("occupation"),
            dwelling.alias("dwelling_raw"),
            F.when(dwelling != "", dwelling).when(swap, before).otherwise(last).alias("addr_raw"),
        ))

    return let(F.transform(F.split(F.regexp_replace(line, r"^f\s*", ""), ",", -1), lambda p: F.trim(p)), headed)
