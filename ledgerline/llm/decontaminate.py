"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a benchmark question with other values has the same template.
Windows of template tokens that hold a literal word are hash-joined; a window's placeholder values (slots) travel along.
An item counts against a document if, at one shift or along neighbouring ones, its matched windows cover enough of it and
its slots are filled consistently there: one value of the item stands for one value of the document throughout.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import _powers, bounded, cut, mix64, packed, text_key, unpacked

_U = np.uint64
#: Units that a number may carry, and number words.
UNITS = frozenset("mm cm m km in ft yd mi miles mile inches inch feet foot meters metres meter metre kilometers kilometres mg g kg lb lbs oz grams gram kilograms pounds pound ounces ounce ml l liters litres liter litre gallons gallon s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year dollars dollar cents cent euros euro usd eur mph kmh percent degrees degree".split())
NUMBERS = frozenset("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
#: Template windows of a benchmark up to which executors hold their hashes to thin the documents' windows.
HELD = 2_000_000
_NUMBER, _UNIT, _NAME = 1, 2, 3
#: Classes of code points; a token has that of its first.
_OTHER, _LETTER, _DIGIT, _STOP = 0, 1, 2, 3


@lru_cache(maxsize=3)
def _points(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the code points below size: the class, whether it is a capital, and a hash of its lower case."""
    chars = [chr(i) for i in range(size)]
    kind = np.array([_DIGIT if c.isdecimal() else _LETTER if c.isalnum() else _OTHER for c in chars], dtype=np.int8)
    kind[[ord(c) for c in ".!?\n"]] = _STOP
    low = [c.lower() for c in chars]
    low = np.array([ord(x if len(x) == 1 else c) for c, x in zip(chars, low, strict=True)], dtype=np.uint64)
    return kind, np.array([c.isupper() for c in chars]), mix64((low + _U(1)) * _U(0x9E3779B97F4A7C15))


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(18, n.bit_length()))


def _coded(text: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The code points of a text, and _points for as many as they need."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    top = int(points.max(initial=0))
    return points, _points(next(n for n in (1 << 14, 1 << 17, 0x110000) if top < n))


def _spelt(points: np.ndarray, term: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the lower-case code points from each start to each end."""
    up, down = _scales(len(points))
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(term[points] * up[: len(points)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


@lru_cache(maxsize=100_000)
def _word(token: str) -> int:
    """The hash of one lower-case token."""
    points, (_, _, term) = _coded(token)
    return int(_spelt(points, term, np.zeros(1, np.int64), np.full(1, len(points)))[0])


@lru_cache(maxsize=1)
def _fixed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted hashes of the fixed words with what each is, and by the last 16 bits whether there is any."""
    kinds = {_word(x): _UNIT for x in UNITS} | {_word(x): _NUMBER for x in NUMBERS}
    own = np.array(sorted(kinds), dtype=np.uint64)
    some = np.zeros(1 << 16, bool)
    some[own & _U(0xFFFF)] = True
    return own, np.array([kinds[int(x)] for x in own], dtype=np.int8), some


def templates(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, placeholder type or 0, hash as a word, whether capitalised) of the whole text's template tokens, and where they
    start and end in the text.

    Tokens are runs of letters, numbers with . and , between digits, and the stops, which are no template tokens. A
    capitalised word is a name unless it opens a sentence; a unit is one only after a number.
    """
    text = text or ""
    points, (kinds, capital, term) = _coded(text)
    of = kinds[points]
    at = np.flatnonzero((points[1:-1] == 0x2E) | (points[1:-1] == 0x2C)) + 1
    of[at[(of[at - 1] == _DIGIT) & (of[at + 1] == _DIGIT)]] = _DIGIT
    turn = np.ones(len(of) + 1, bool)
    turn[1:-1] = of[1:] != of[:-1]
    stop = of == _STOP
    turn[:-1] |= stop
    turn[1:] |= stop
    edge = np.flatnonzero(turn)
    some = of[edge[:-1]] > _OTHER
    start, end = edge[:-1][some], edge[1:][some]
    kind = of[start]
    word = _spelt(points, term, start, end)
    if "\u0130" in text or "\u03a3" in text:  # their lower case is of two code points, or of what stands beside them
        for i in np.unique(np.searchsorted(start, np.flatnonzero((points == 0x130) | (points == 0x3A3)), side="right") - 1).tolist():
            word[i] = _word(text[start[i] : end[i]].lower())
    own, what, found = _fixed()
    fixed = np.zeros(len(kind), dtype=np.int8)
    at = np.flatnonzero(found[word & _U(0xFFFF)])
    place = np.minimum(np.searchsorted(own, word[at]), len(own) - 1)
    fixed[at] = np.where(own[place] == word[at], what[place], 0)
    number = (kind == _DIGIT) | (fixed == _NUMBER)
    big = (kind == _LETTER) & (fixed == 0) & capital[points[start]]
    opens = np.concatenate(([True], kind[:-1] == _STOP)) if len(kind) else np.zeros(0, bool)
    after = np.concatenate(([False], number[:-1])) if len(kind) else np.zeros(0, bool)
    slot = np.where(number, _NUMBER, np.where((fixed == _UNIT) & after, _UNIT, np.where(big & ~opens, _NAME, 0)))
    keep = np.flatnonzero(kind != _STOP)
    slot, word = slot[keep], word[keep]
    return np.where(slot > 0, slot.astype(np.uint64), word), slot, word, big[keep], start[keep], end[keep]


class Windows:
    """Hashes of all runs of the tokens of a text: a rolling sum of which a run of any length is a difference."""

    def __init__(self, h: np.ndarray) -> None:
        self.x = mix64(h ^ _U(0xA0761D6478BD642F))
        up, self.down = _scales(len(h))
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.x * up[: len(h)], dtype=np.uint64)))

    def raw(self, k: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        n = len(self.x) - k + 1
        return ((self.total[k:] - self.total[:n]) * self.down[:n])[at]


def _hashed(raw: np.ndarray, k: int) -> np.ndarray:
    return mix64(raw + _U(k))


def _rows(key, text, sizes, wanted: np.ndarray | None, either: bool):
    """Columns of the (wanted) windows of a text: key, size, position, hash, and the slots' values.

    Windows with names are hashed with these as words too, for copies in another letter case; with `either`, those with a
    capitalised first word also with that one alone the other way, as what stands before it decides whether it is a name.
    Windows of placeholders alone say nothing and are left out.
    """
    h, slot, word, capital, start, end = templates(text)
    if not len(h) or len(h) < min(sizes, default=1):
        return
    named = slot == _NAME
    names = np.concatenate(([0], np.cumsum(named)))
    bare = np.where(named, 0, slot)
    filled, also = (np.concatenate(([0], np.cumsum(x > 0))) for x in (slot, bare))
    own, plain = Windows(h), Windows(np.where(named, word, h))
    turned = mix64(np.where(named, word, _U(_NAME)) ^ _U(0xA0761D6478BD642F)) - own.x if either else None

    def value(i: int) -> str:
        return text[start[i] : end[i]].lower()

    for k in sizes:
        n = len(h) - k + 1
        if n < 1:
            continue
        slots, others = filled[k:] - filled[:-k], also[k:] - also[:-k]
        raw = own.raw(k)
        at, there = np.flatnonzero(slots < k), np.flatnonzero((names[k:] > names[:-k]) & (others < k))
        forms = [(_hashed(raw[at], k), at, slot, False), (_hashed(plain.raw(k, there), k), there, bare, False)]
        if either:
            at = np.flatnonzero(capital[:n] & (np.where(slot[:n] > 0, slots - 1, slots + 1) < k))
            forms.append((_hashed(raw[at] + turned[at], k), at, slot, True))
        for w, at, kinds, turn in forms:
            if wanted is not None and len(at):
                place = np.minimum(np.searchsorted(wanted, w), len(wanted) - 1)
                met = wanted[place] == w
                w, at = w[met], at[met]
            for i, x in zip(at.tolist(), w.view(np.int64).tolist(), strict=True):
                first = [value(i)] if (kinds[i] > 0) != turn else []
                yield key, k, i, x, first + [value(j) for j in range(i + 1, i + k) if kinds[j] > 0]


def _table(rows, key: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "k", "pos", "hash", "slots"])


def _window_rows(df: DataFrame, key: str, sizes: list[int], wanted=None, either: bool = False) -> DataFrame:
    def run(batches):
        held = None if wanted is None else wanted.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    rows.extend(_rows(i, t, sizes, held, either))
                    if len(rows) > 20_000:
                        yield _table(rows, key)
                        rows = []
                yield _table(rows, key)

    return df.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{key} bigint, k int, pos bigint, hash bigint, slots array<string>")


def _key(row_id: Column, text: str = "text") -> Column:
    """Names a row by its id and text: rows that share both are one, rows with a null id are told apart by their text."""
    t = text_key(text)
    return F.xxhash64(F.lit(3), row_id.isNull(), row_id, t["a"], t["b"], t["n"])


def contaminations(docs: DataFrame, benchmark: DataFrame, k: int = 8, cover: float = 0.5) -> DataFrame:
    """(doc, item, item_id, cover, exact) of the documents and items that meet consistently; doc is a row's _key.

    The windows of one shift (place in the document less place in the item), or of a run of shifts no more than k apart,
    as where words were put in, must cover `cover` of the item's with each value of the item standing for one value of the
    document. exact: none has another value than the item's. Items shorter than k tokens match as a whole; empty ones, and
    those without a literal word in any window, never. Items are told apart by id and text; a null id is an item like
    others. Null and empty texts match nothing; each row is judged by its own text, whatever its doc_id.
    """
    spark = docs.sparkSession
    item_id, doc_id = F.col("item_id").cast("bigint"), F.col("doc_id").cast("bigint")
    items = benchmark.select(_key(item_id).alias("item"), item_id.alias("item_id"), F.col("text").cast("string").alias("text")).dropDuplicates(["item"])

    def length(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(templates(x)[0]) for x in batch.column(1).to_pylist()], pa.int64())], names=["item", "n"])

    sizes = cut(items.select("item", "text").mapInArrow(length, "item bigint, n bigint").filter("n > 0").select("item", F.least("n", F.lit(k)).cast("int").alias("size")))
    found = sorted(r[0] for r in sizes.select("size").distinct().collect())
    known = cut(_window_rows(items, "item", found).join(sizes, "item").filter("k = size").drop("size"))
    totals = known.groupBy("item").agg(F.count_distinct("pos").alias("total"))
    held = known.select("hash").distinct()
    n = held.limit(HELD + 1).count()
    wanted = spark.sparkContext.broadcast(np.sort(held.toArrow()["hash"].to_numpy().view(np.uint64))) if 0 < n <= HELD else None
    ours = _window_rows(docs.select(_key(doc_id).alias("doc"), "text"), "doc", found, wanted, True) if n else _window_rows(docs.select(_key(doc_id).alias("doc"), "text").limit(0), "doc", [])
    theirs = known.select("item", "k", "hash", F.col("pos").alias("at"), F.col("slots").alias("was"))
    met = cut(ours.join(bounded(theirs), ["k", "hash"]).withColumn("shift", F.col("pos") - F.col("at")))
    if wanted is not None:
        wanted.destroy()
    # Each shift by itself, and runs of neighbouring ones together.
    by = Window.partitionBy("doc", "item").orderBy("shift")
    shifts = met.select("doc", "item", "shift").distinct().withColumn("opens", F.coalesce(F.col("shift") - F.lag("shift").over(by) > k, F.lit(True)).cast("bigint"))
    shifts = shifts.withColumn("run", F.sum("opens").over(by)).drop("opens")
    scopes = F.explode(F.array(F.struct(F.lit(0).alias("scope"), F.col("shift").alias("place")), F.struct(F.lit(1).alias("scope"), F.col("run").alias("place"))))
    rows = cut(met.join(shifts, ["doc", "item", "shift"]).select("doc", "item", "at", F.arrays_zip("was", "slots").alias("pairs"), scopes.alias("s")).select("doc", "item", "s.scope", "s.place", "at", "pairs"))
    line = ["doc", "item", "scope", "place"]
    covered = rows.groupBy(*line).agg(F.count_distinct("at").alias("n"))
    covered = covered.join(bounded(totals), "item").withColumn("cover", F.col("n") / F.col("total")).filter(F.col("cover") >= cover)
    values = rows.select(*line, F.explode("pairs").alias("p")).groupBy(*line, "p.was").agg(F.count_distinct("p.slots").alias("values"), F.max((F.col("p.was") != F.col("p.slots")).cast("int")).alias("other"))
    values = values.groupBy(*line).agg(F.max("values").alias("values"), F.max("other").alias("other"))
    good = covered.join(values, line, "left").filter(F.coalesce("values", F.lit(0)) <= 1)
    good = good.groupBy("doc", "item").agg(F.max("cover").alias("cover"), F.max(F.coalesce("other", F.lit(0)) == 0).alias("exact"))
    return good.join(bounded(items.select("item", "item_id")), "item").select("doc", "item", "item_id", "cover", "exact")


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 8, cover: float = 0.5) -> DataFrame:
    """(doc_id, contaminated, item_ids, cover, exact) for each row of docs(doc_id, text): items found with consistent slots.

    item_ids has no null ids, though their items count. Every row is judged by its own text; other columns are ignored. An
    empty benchmark finds nothing.
    """
    found = contaminations(docs, benchmark, k, cover).groupBy("doc").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("cover").alias("cover"), F.max("exact").alias("exact"))
    found = bounded(cut(found), items="item_ids")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _key(F.col("doc_id").cast("bigint")).alias("doc")).join(found, "doc", "left")
    return rows.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("cover", F.lit(0.0)).alias("cover"), F.coalesce("exact", F.lit(False)).alias("exact"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 8, cover: float = 0.5) -> DataFrame:
    """The documents that no item was found in; columns as in docs.

    Rows with null or empty texts stay; those with a null doc_id, and rows that repeat one, are judged by their text.
    """
    found = bounded(cut(contaminations(docs, benchmark, k, cover).select(F.col("doc").alias("_doc")).distinct()))
    rows = packed(docs, _key(F.col("doc_id").cast("bigint")).alias("_doc"))
    return unpacked(rows.join(found, "_doc", "left_anti"), docs.columns)
