"""Name, street and occupation keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.values import let

#: Street types that a key leaves out, longest forms first, and directions.
STREET_TYPES = "STREET|ST|AVENUE|AVE|AV|ALLEY|ALY|AL|LANE|LA|ROAD|RD|COURT|CT|PLACE|PL|WHARF|WHF|SQUARE|SQ|TERRACE|TER|BOULEVARD|BLVD|DRIVE|DR|PARKWAY|PKWY|HIGHWAY|HWY|CIRCLE|CIR|TURNPIKE|PIKE|WAY|RUN"
DIRECTIONS = "NORTH|SOUTH|EAST|WEST|N|S|E|W"
#: Institutions by words of a name, and businesses by words of an occupation; the first that matches counts.
INSTITUTIONS = (
    ("church", r"\b(church|chapel|meeting ?house|a\.? ?m\.? ?e\.?|bethel|zion)\b"),
    ("school", r"\b(school|academy|seminary|institute)\b"),
    ("cemetery", r"\b(cemeter|burial ?ground|grave ?yard)\b"),
    ("society", r"\b(society|association|lodge|benevolent|beneficial|asylum|orphan|home for)\b"),
)
BUSINESSES = (
    ("food", r"\b(grocer|grocery|eating ?house|restaurant|confection|butcher|baker|oyster (dealer|house)|provision|fruiterer|milk ?dealer)\b"),
    ("lodging", r"\b(boarding|hotel|tavern|inn ?keeper|saloon)\b"),
    ("retail", r"\b(store|shop ?keeper|dealer|merchant|trader|variety|second ?hand|junk|coal ?yard|wood ?yard)\b"),
    ("street trade", r"\b(huckster|pedlar|peddler|market ?dealer|vender|vendor)\b"),
    ("service", r"\b(barber|hair ?dresser|undertaker|livery|cupper|bleeder|midwife)\b"),
)
WAGE_WORK = r"\b(in|at|for)\s+\w+('s)?\s+(store|shop|house)\b"
DENOMINATION = r"\b(colou?red|african|meth|bapt|episc|presby|cath)\b"
PEOPLE_OF = {"school": r"\b(teacher|professor)\b", "church": r"\b(minister|preacher|sexton|clergy)\b"}
#: Beginnings of an occupation and what they are counted as.
OCCUPATIONS = (
    ("labou?rer|iabou?rer|laborc?r|labr", "laborer"), ("washer(wo)?man|washer|wash'?r|laundress", "laundress"), ("drayman|dray", "drayman"),
    ("carter|cartman", "carter"), ("waiter|waitress", "waiter"), ("porter", "porter"), ("seaman|sailor|mariner", "sailor"), ("cook", "cook"),
    ("barber", "barber"), ("shoemaker|bootmaker|boot and shoemaker", "shoemaker"), ("caulker|calker", "caulker"), ("brickmaker|brick maker", "brickmaker"),
    ("whitewasher|white washer", "whitewasher"), ("hucks?ter", "huckster"), ("servant|domestic", "servant"), ("stevedore|stevadore", "stevedore"),
    ("hostler|ostler", "hostler"), ("blacksmith|smith", "blacksmith"), ("carpenter", "carpenter"), ("sawyer", "sawyer"), ("minister|preacher|clergyman", "minister"),
    ("teacher", "teacher"), ("nurse", "nurse"), ("seamstress|sempstress|dressmaker", "seamstress"), ("cooper", "cooper"), ("grocer", "grocer"), ("driver", "driver"),
    ("wagoner|waggoner", "wagoner"), ("bricklayer", "bricklayer"), ("painter", "painter"), ("oysterman|oyster", "oysterman"), ("coachman", "coachman"),
    ("chimney ?sweep", "chimney sweep"), ("fisherman", "fisherman"),
)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def street_key(raw: Column) -> Column:
    """struct(core, dir) of a street name: type words and direction taken off; dir is '' without one.

    A closing direction wins over a leading one. A name that is a direction and a type has an empty core. Null: both ''.
    """

    def opened(s1: Column, closing: Column) -> Column:
        return let(F.regexp_extract(s1, rf"^({DIRECTIONS})\s+\S", 1), lambda leading: key(s1, closing, leading))

    def key(s1: Column, closing: Column, leading: Column) -> Column:
        s2 = F.when(leading != "", F.regexp_replace(s1, rf"^({DIRECTIONS})\s+", "")).otherwise(s1)
        core = F.regexp_replace(s2, rf"\b({STREET_TYPES})\b", " ")
        core = squeezed(F.regexp_replace(core, r"^(L|LITTLE)\b", "LITTLE"))
        return F.struct(core.alias("core"), F.substring(F.when(closing != "", closing).otherwise(leading), 1, 1).alias("dir"))

    def closed(s: Column, closing: Column) -> Column:
        return let(F.when(closing != "", F.regexp_replace(s, rf"\s+({DIRECTIONS})$", "")).otherwise(s), lambda s1: opened(s1, closing))

    plain = squeezed(F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z0-9' ]", " "))
    return let(plain, lambda s: let(F.regexp_extract(s, rf"\s({DIRECTIONS})$", 1), lambda closing: closed(s, closing)))


def occupation_key(raw: Column) -> Column:
    """The occupation that variants are counted as; null for what is too short, or too long to be one."""
    s = squeezed(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[^a-z' ]", " "))
    s = F.trim(F.regexp_replace(s, "^[ ']+|[ ']+$", ""))
    out = F.when((F.size(F.split(s, " ")) > 3) | (F.length(s) > 22), F.lit(None)).otherwise(s)
    for pattern, name in reversed(OCCUPATIONS):
        out = F.when(s.rlike(rf"^({pattern})\b"), F.lit(name)).otherwise(out)
    return F.when(F.length(s) >= 3, out)


#: Directions that a street's label prints as they are, and how it prints types of streets.
LABEL_DIRECTIONS = ("N", "S", "E", "W", "NE", "NW", "SE", "SW")
LABEL_TYPES = {"ST": "St", "AVE": "Ave", "AV": "Ave", "RD": "Rd", "BLVD": "Blvd", "DR": "Dr", "LN": "Ln", "CT": "Ct", "PL": "Pl", "PKWY": "Pkwy", "HWY": "Hwy", "TER": "Ter", "CIR": "Cir", "WAY": "Way", "EXPWY": "Expwy"}


def street_label(raw: Column) -> Column:
    """A street's name in capitals as a label prints it: each word with one capital, or two after "Mc"."""
    types = F.create_map(*[F.lit(x) for kv in LABEL_TYPES.items() for x in kv])

    def printed(w: Column) -> Column:
        low = F.lower(w)
        scottish = F.concat(F.lit("Mc"), F.upper(F.substring(low, 3, 1)), F.substr(low, F.lit(4)))
        capital = F.concat(F.upper(F.left(low, F.lit(1))), F.substr(low, F.lit(2)))
        return F.when(w.isin(*LABEL_DIRECTIONS), w).otherwise(F.coalesce(F.element_at(types, w), F.when(low.rlike("^mc."), scottish).otherwise(capital)))

    return F.array_join(F.transform(F.filter(F.split(raw, r"\s+"), lambda w: w != ""), printed), " ")


def record_class(surname: Column, given: Column, occupation: Column) -> Column:
    """struct(category, subtype): institution by name, else business by occupation, else resident.

    An institution's word that is the whole surname does not count, nor does one whose bearer has a trade; then the next
    pattern is tried. Teachers of schools and clergy of churches are residents.
    """
    surname, given, occ = (F.trim(F.coalesce(c, F.lit(""))) for c in (surname, given, occupation))
    name = F.trim(F.concat_ws(" ", surname, given))

    def of(category: str, subtype: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(subtype).alias("subtype"))

    out = of("resident", "")
    for subtype, pattern in reversed(BUSINESSES):
        out = F.when((occ != "") & ~occ.rlike(f"(?i){WAGE_WORK}") & occ.rlike(f"(?i){pattern}"), of("business", subtype)).otherwise(out)
    for subtype, pattern in reversed(INSTITUTIONS):
        met = F.lower(F.regexp_extract(name, f"(?i){pattern}", 0))
        counts = (met != "") & (met != F.lower(surname)) & ((occ == "") | occ.rlike(f"(?i){DENOMINATION}"))
        found = of("institution", subtype)
        if subtype in PEOPLE_OF:
            found = F.when(occ.rlike(f"(?i){PEOPLE_OF[subtype]}"), of("resident", "")).otherwise(found)
        out = F.when(counts, found).otherwise(out)
    return out


def person_key(year: Column, surname: Column, given: Column) -> Column:
    """year|surname|first given name, in lower case."""
    return F.concat_ws("|", year.cast("string"), F.lower(F.trim(surname)), F.lower(F.get(F.split(F.trim(given), r"\s+"), 0)))


#: How an index of streets writes one name's relation to another, and ends that are no street's name.
RELATION = r"(?i)^([^:]{2,60}):\s*(now part of|became part of|now|was|became|see)\s+([^,;]+?)\s*(?:\b(?:1[6-9]\d\d|20\d\d)\b|n\.d\.|$)"
NO_TARGET = r"(?i)\b(?:street|streets|alley|alleys|and|from|between|to|the|city|part|of|no|not|never|opened|closed|vacated|condemned|widened|extended)\s*$"


def alias_pairs(line: Column) -> Column:
    """array of struct(old, new, relation), as keys of streets, that a line of an index states; empty if none.

    "was" points backwards and "see" both ways. Names whose key is empty, or the same as the other's, are no pair.
    """

    def clean(raw: Column) -> Column:
        bare = F.regexp_replace(F.trim(raw), "^[\"“”']+|[\"“”']+$", "")
        return F.regexp_replace(squeezed(F.regexp_replace(bare, r"\s*\(.*?\)\s*", " ")), r"^[ .,:;]+|[ .,:;]+$", "")

    def read(text: Column) -> Column:
        names = F.struct(clean(F.regexp_extract(text, RELATION, 1)).alias("a"), clean(F.regexp_extract(text, RELATION, 3)).alias("b"))
        return let(F.lower(F.regexp_extract(text, RELATION, 2)), lambda relation: F.when(relation != "", let(names, lambda n: keyed(n["a"], n["b"], relation))))

    def keyed(a: Column, b: Column, relation: Column) -> Column:
        told = (a != "") & (F.length(b) >= 3) & ~b.rlike(NO_TARGET)
        keys = F.struct(street_key(a)["core"].alias("x"), street_key(b)["core"].alias("y"))
        return F.when(told, let(keys, lambda k: pairs(k["x"], k["y"], relation)))

    def pairs(x: Column, y: Column, relation: Column) -> Column:
        def pair(old: Column, new: Column) -> Column:
            return F.struct(old.alias("old"), new.alias("new"), relation.alias("relation"))

        both = F.when(relation == "was", F.array(pair(y, x))).when(relation == "see", F.array(pair(x, y), pair(y, x))).otherwise(F.array(pair(x, y)))
        return F.when((x != "") & (y != "") & (x != y), both)

    none = F.array().cast("array<struct<old:string,new:string,relation:string>>")
    return F.coalesce(let(F.trim(line), read), none)


#: How the note of a street names its newer or older name, where such a name ends, and what opens no name.
NOW_NAMED = r"(?i)\bnow(?:\s+called)?\s+([A-Z][A-Za-z'’\.\- ]{2,28})"
ONCE_NAMED = r"(?i)\b(?:formerly|late)\s+([A-Z][A-Za-z'’\.\- ]{2,28})"
NAME_ENDS = r"(?i)\b(?:from|to|between|going|near|north|south|east|west)\b.*$"
NO_NAME = r"(?i)^(the|and|from|to|of|going|between|north|south|east|west|near|part|opened|closed|a|an)\b"


def note_alias_pairs(street: Column, note: Column) -> Column:
    """array of struct(old, new, relation), as keys of streets, that the note beside a street's name gives; empty if none.

    "now" and "now called" lead to the newer name, "formerly" and "late" to the older one; the first of each counts.
    """

    def pair(pattern: str, relation: str, here: Column) -> Column:
        trimmed = r"^[ .,;:\-]+|[ .,;:\-]+$"
        raw = F.regexp_replace(squeezed(F.regexp_extract(F.coalesce(note, F.lit("")), pattern, 1)), trimmed, "")
        name = F.regexp_replace(F.regexp_replace(raw, NAME_ENDS, ""), trimmed, "")

        def keyed(key: Column) -> Column:
            old, new = (here, key) if relation == "now" else (key, here)
            return F.when((key != "") & (key != here), F.struct(old.alias("old"), new.alias("new"), F.lit(relation).alias("relation")))

        return let(name, lambda other: F.when((other != "") & ~other.rlike(NO_NAME), let(street_key(other)["core"], keyed)))

    none = F.array().cast("array<struct<old:string,new:string,relation:string>>")
    found = let(street_key(street)["core"], lambda here: F.when(here != "", F.array(pair(NOW_NAMED, "now", here), pair(ONCE_NAMED, "formerly", here))))
    return F.coalesce(F.array_compact(found), none)
