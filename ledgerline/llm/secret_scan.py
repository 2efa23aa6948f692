"""Secret scans in DataFrame functions only: base patterns, and a randomness test battery over long tokens.

A token's encoding is inferred from its characters. Uniformity of its alphabet (chi-squared), runs about the middle of
the alphabet and lag-1 serial correlation are tested and combined into one p-value of randomness. How unlikely an ordinary
identifier of its length would change between digits, small and capital letters so often (for letters of one case: how
unlike ordinary text they are) is a second p-value, which shrinks with length. Over all tokens of all documents, the
Benjamini-Hochberg procedure rules out on the first those that are not random, and finds on the second those that are not
ordinary; what is neither ruled out nor ordinary is a secret.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded, cut, packed, text_key, unpacked

#: The base patterns in the order of their kinds, the group whose length counts, and its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: What decides quickly that a text has no match that counts.
QUICK = {"assign": r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
#: The same matches for kinds whose short ones can be passed over: runs that are matched whole or not at all.
LONG = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: A name before = and the value after it are tokens of their own; = belongs to a token only as padding at its end.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-])|(?![A-Za-z0-9+/_-]))"
#: Share of character changes between classes in ordinary identifiers, and bins of -log10 p.
CHANGES, BINS, BIN = 0.06, 1200, 4
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "UPPER": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower32": "abcdefghijklmnopqrstuvwxyz234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "UPPER36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/-_0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}
#: What tokens of each encoding look like, narrow ones first; the rest is base64.
ENCODINGS = {"hex": "^[0-9a-f]+$", "HEX": "^[0-9A-F]+$", "lower": "^[a-z]+$", "UPPER": "^[A-Z]+$", "base32": "^[A-Z2-7]+$", "lower32": "^[a-z2-7]+$", "lower36": "^[a-z0-9]+$", "UPPER36": "^[A-Z0-9]+$", "letters": "^[A-Za-z]+$", "alnum": "^[A-Za-z0-9]+$"}
#: Letters a to z in 10,000 of ordinary English, French, German, Spanish, Italian and Polish text, without accents; at least 5.
LETTERS = (
    (817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7),
    (812, 90, 342, 367, 1715, 107, 87, 74, 758, 61, 5, 546, 297, 710, 560, 252, 136, 669, 795, 724, 643, 184, 5, 43, 13, 33),
    (709, 189, 308, 508, 1640, 166, 301, 458, 655, 27, 142, 344, 253, 978, 303, 67, 5, 700, 758, 615, 516, 85, 192, 5, 5, 113),
    (1203, 222, 402, 501, 1261, 69, 177, 70, 698, 49, 5, 497, 316, 702, 951, 251, 88, 687, 798, 463, 410, 114, 5, 22, 101, 47),
    (1239, 93, 450, 374, 1179, 115, 164, 64, 1014, 5, 5, 651, 251, 688, 983, 306, 51, 637, 498, 562, 318, 210, 5, 5, 5, 118),
    (960, 147, 436, 333, 888, 30, 142, 108, 821, 228, 351, 392, 280, 572, 864, 313, 5, 469, 498, 398, 250, 5, 465, 5, 376, 653),
)
#: For each language, log10 of how much likelier a letter is in random text.
ODDS = [[math.log10(sum(row) / 26 / x) for x in row] for row in LETTERS]


def _matches(text: Column, kind: str, pattern: str, group: int, quick: str) -> Column:
    """An array of (kind, i, gap, len, size, token): the characters since the match before, of the match, of its group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    items = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("g"), sized.alias("s")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["s"]).alias("size"), (x["m"] if kind == "random" else F.lit(None).cast("string")).alias("token")),
    )
    return F.when(text.rlike(quick), items)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _total(value: Column, odds: list[float]) -> Column:
    """The sum of the odds of letters by their places in the alphabet."""
    table = F.array(*map(F.lit, odds))
    return F.aggregate(value, F.lit(0.0), lambda a, v: a + F.coalesce(F.get(table, v.cast("int")), F.lit(0.0)))


def battery(token: Column) -> Column:
    """(encoding, uniform_p, ordinary) of a token: whether it can be random, and -log10 p of an ordinary identifier.

    Letters of one case are measured against ordinary text of six languages, the one that they are most like.
    """
    bare = F.rtrim(token, F.lit("="))
    encoding = F.coalesce(*[F.when(bare.rlike(v), F.lit(k)) for k, v in ENCODINGS.items()], F.lit("base64"))

    def placed(x: Column) -> Column:
        letters = F.coalesce(*[F.when(x["encoding"] == k, F.lit(v)) for k, v in ALPHABETS.items()])
        return _let(letters, lambda a: _let(_places(x["bare"], a), lambda v: _tests(x["bare"], x["encoding"], a, v)))

    return _let(F.struct(bare.alias("bare"), encoding.alias("encoding")), placed)


def _places(bare: Column, letters: Column) -> Column:
    """The places of the characters in an alphabet."""
    return F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: (F.instr(letters, c) - 1).cast("double"))


def _tests(bare: Column, encoding: Column, letters: Column, value: Column) -> Column:
    n = F.length(bare).cast("double")
    sigma = F.when(encoding == "base64", 64.0).otherwise(F.length(letters).cast("double"))
    chars = F.split(bare, "")
    squares = F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.pow(F.length(bare) - F.length(F.replace(bare, c, F.lit(""))), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    chi = sigma / n * squares - n
    z_chi = (chi - (sigma - 1)) / F.sqrt(2 * (sigma - 1))
    high = F.transform(value, lambda v: (v >= F.length(letters) / 2).cast("int"))
    n1 = F.aggregate(high, F.lit(0.0), lambda a, x: a + x)
    n0 = n - n1
    turn = F.aggregate(F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high)), lambda a, b: (a != b).cast("double")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    mean_runs = 2 * n1 * n0 / n + 1
    var_runs = F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(0.25))
    z_runs = (turn + 1 - mean_runs) / F.sqrt(var_runs)
    mean = F.aggregate(value, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(value, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    cross = F.aggregate(F.zip_with(F.slice(value, 1, F.size(value) - 1), F.slice(value, 2, F.size(value)), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    z_serial = F.when(spread > 0, cross / spread * F.sqrt(n)).otherwise(F.sqrt(n))
    joint = F.greatest(z_chi, F.lit(0.0)) ** 2 + z_runs**2 + z_serial**2
    # Chi-squared with three degrees of freedom, by the cube-root normal form and a logistic tail.
    z = (F.pow(joint / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / math.sqrt(2 / 27)
    uniform_p = 1 / (1 + F.exp(1.5976 * z + 0.070565 * z * z * z))
    kinds = F.translate(bare, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_", "0" * 10 + "A" * 26 + "a" * 26 + "aaaa")
    kind = F.split(kinds, "")
    changes = F.aggregate(F.zip_with(F.slice(kind, 1, F.size(kind) - 1), F.slice(kind, 2, F.size(kind)), lambda a, b: ((a != b) & (a != "") & (b != "")).cast("double")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    rate = F.least(F.greatest(changes / n, F.lit(1e-9)), F.lit(1 - 1e-9))
    bits = F.when(rate <= CHANGES, 0.0).otherwise(n * (rate * F.log(rate / CHANGES) + (1 - rate) * F.log((1 - rate) / (1 - CHANGES))))
    # Letters of one case change no class. A likelihood ratio of x or more has a chance of 1/x at most in ordinary text.
    ratio = F.least(*[_total(value, odds) for odds in ODDS])
    ordinary = F.when(encoding.isin("lower", "UPPER"), F.greatest(ratio, F.lit(0.0))).otherwise(bits / math.log(10))
    return F.struct(encoding.alias("encoding"), uniform_p.alias("uniform_p"), ordinary.alias("ordinary"))


def discovery_limit(counts: dict[int, int], rate: float) -> int:
    """The Benjamini-Hochberg limit as a bin of -log10 p: the lowest whose tokens hold a false share of at most rate."""
    total, above, limit = sum(counts.values()), 0, BINS + 1
    for b in range(BINS, -1, -1):
        above += counts.get(b, 0)
        if above and 10 ** (-b / BIN) <= rate * above / total:
            limit = b
    return limit


def find_spans(rows: DataFrame, keep: list[str], rate: float = 0.01, random_rate: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """((rid, keep...) of every row, (rid, kind, start, end) of the secrets) of rows(text, keep...): code points, end exclusive.

    random_rate: the share of random tokens among those that the battery rules out, at most; rate: that of ordinary ones
    among those taken for secrets.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,size:int,token:string>>")
    parts = [_matches(text, k, LONG.get(k, p), g, QUICK[k]) for k, p, g, _ in BASE] + [_matches(text, "random", TOKEN, 0, TOKEN)]
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), *keep, "text")
    found = rows.select("rid", *keep, F.explode_outer(F.concat(*[F.coalesce(p, none) for p in parts])).alias("x")).select("rid", *keep, "x.*")
    # Tokens are tested where their text is read, before any exchange could gather these few rows in one task. Rows without
    # a match stay: rids are drawn once, and nothing is joined back to the texts by them.
    found = cut(found.withColumn("b", battery(F.col("token"))).select("rid", *keep, "kind", "i", "gap", "len", "size", "b.uniform_p", "b.ordinary"))
    every = found.filter("i is null or i = 0").select("rid", *keep).distinct()
    upto = Window.partitionBy("rid", "kind").orderBy("i")
    placed = found.filter("kind is not null").withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, _, _, n in BASE])
    unlike = F.least(F.lit(BINS), F.floor(F.col("ordinary") * BIN)).cast("int").alias("unlike")
    uneven = F.least(F.lit(BINS), F.floor(-F.log10(F.greatest("uniform_p", F.lit(1e-300))) * BIN)).cast("int").alias("uneven")
    counts = found.filter("kind = 'random'").groupBy(unlike, uneven).count().collect()
    sums: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for r in counts:
        for at, b in zip(sums, r[:2], strict=True):
            at[b] = at.get(b, 0) + r["count"]
    limit, ruled_out = discovery_limit(sums[0], rate), discovery_limit(sums[1], random_rate)
    wanted = F.when(F.col("kind") == "random", (unlike >= limit) & (uneven < ruled_out)).otherwise(F.col("size") >= least)
    both = placed.filter(wanted).select("rid", "kind", "start", "end")
    # A random token that overlaps a base span says nothing new: no base span that starts before it may reach into it, none
    # may start in it. Both frames grow from one end, so a text's spans are passed over once each way.
    own = F.col("kind") != "random"
    seen = Window.partitionBy("rid").orderBy("start", "end", own.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = both.withColumn("reach", F.max(F.when(own, F.col("end"))).over(seen)).withColumn("next", F.min(F.when(own, F.col("start"))).over(later))
    return every, marked.filter(own | ((F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end")))).drop("reach", "next")


def scan_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans) for each row of docs(doc_id, text).

    Spans are arrays of (start, place of the kind, kind, end) in that order. Null and empty texts have none. Rows that
    repeat a doc_id, and those with a null one, stay apart; other columns are ignored; an empty table gives no rows.
    """
    every, spans = find_spans(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id"], rate)
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, (k, *_) in enumerate(BASE)], F.lit(len(BASE)))
    each = spans.groupBy("rid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k, *_ in BASE],
        F.sort_array(F.collect_list(F.struct("start", order.alias("place"), "kind", "end"))).alias("spans"),
    )
    all_ = every.join(each, "rid", "left")
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    return all_.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k, *_ in BASE], F.coalesce(F.filter("spans", lambda x: x["place"] < len(BASE)), none).alias("base_spans"), F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]", rate: float = 0.01) -> DataFrame:
    """docs(..., text, ...) with every secret replaced by the mark; all rows stay, columns as in docs, whatever their names.

    Null texts stay null and empty ones empty. Spans go back to the texts by the text itself, so rows that repeat one are
    all redacted alike, whatever their doc_id.
    """
    every, spans = find_spans(docs.select(text_key().alias("key"), "text"), ["key"], rate)
    by = Window.partitionBy("rid").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    merged = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by)).groupBy("rid", "run").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    cuts = merged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("_cuts"))
    cuts = bounded(cut(cuts.join(every, "rid").groupBy(F.col("key").alias("_key")).agg(F.first("_cuts").alias("_cuts"))), items="_cuts")
    both = packed(docs, text_key().alias("_key")).join(cuts, "_key", "left")
    whole = F.col("_row").getField("text")
    pieces = F.transform("_cuts", lambda x, i: F.substring(whole, F.when(i == 0, 1).otherwise(F.get("_cuts", i - 1)["e"] + 1).cast("int"), (x["s"] - F.when(i == 0, 0).otherwise(F.get("_cuts", i - 1)["e"])).cast("int")))
    rest = F.substring(whole, (F.element_at("_cuts", -1)["e"] + 1).cast("int"), F.length(whole))
    text = F.when(F.col("_cuts").isNull(), whole).otherwise(F.concat(F.array_join(pieces, mark), F.lit(mark), rest))
    return unpacked(both, docs.columns, text=text)
