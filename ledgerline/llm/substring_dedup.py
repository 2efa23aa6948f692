"""Substring dedup by sliding sentence spans.

From every sentence, and to those that a mark ends, the shortest run of consecutive sentences with enough words is hashed.
Spans are joined over all documents; those that repeat an earlier place at one shift make up stretches. A stretch with enough
words goes; where it is shorter, an exact check compares all runs of that many words around its spans, wherever these stand.
The first place by (doc_id, word) stays. Sentences are parted into pieces by what their words are, so that a passage is
parted alike wherever it stands, and one of 51 words holds a span of its own wherever it is cut.
"""

from __future__ import annotations

from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import LOWER, _SPACE, _hash_spans, _powers, _tidy, bounded, cut, mix64, packed, written

_U = np.uint64
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
ROWS = 256
#: Of each so many words in a row of a sentence, the one with the smallest hash opens a piece. A common passage of n words then
#: holds a span that begins and ends alike in both documents if 3 * PART + words <= n + 2.
PART = 12


def sentences(text: str | None) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(word hashes, the words that sentences begin with and the end, the bytes): the whole text, A-Z in lower case.

    A sentence ends after a word that ends with . ! or ?; one of PART words or more is parted besides.
    """
    h, begin, _, raw = _parted(text)
    return h, begin, raw


def _parted(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """sentences(text), with which of them end by a mark or with the text before the bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw.translate(LOWER), dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[b]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, bool), raw
    h = np.concatenate([_hash_spans(b[s[0] : e[-1]], s - s[0], e - s[0]) for s, e in _blocks(start, end)])
    marks = np.ones(n + 1, bool)
    marks[1:-1] = _STOP[b[end[:-1] - 1]]
    opens = marks[:-1].copy()
    if n >= PART:
        of = np.cumsum(opens)
        least = np.zeros(n + PART - 1, dtype=np.uint64)
        least[PART - 1 : n] = np.where(of[: n - PART + 1] == of[PART - 1 :], _sliding(h, PART, np.minimum), _U(0))
        opens |= _sliding(least, PART, np.maximum) == h
    begin = np.append(np.flatnonzero(opens), n)
    return h, begin, marks[begin[1:]], raw


def _sliding(x: np.ndarray, k: int, of: np.ufunc) -> np.ndarray:
    """of (minimum or maximum) over each k neighbours."""
    size = 1
    n = len(x) - k + 1
    while 2 * size <= k:
        x, size = of(x[:-size], x[size:]), 2 * size
    return of(x[:n], x[k - size : k - size + n])


def _blocks(start: np.ndarray, end: np.ndarray, size: int = 100_000):
    for i in range(0, len(start), size):
        yield start[i : i + size], end[i : i + size]


def spans(h: np.ndarray, begin: np.ndarray, several: int, words: int, alone: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first sentence, last) of the shortest runs with `several` sentences and `words` words, from and to each sentence.

    A sentence of `alone` words or more is a run by itself besides. Every sentence of a longer run lies in one of its runs.
    ends: the sentences to which runs are wanted; all, if None.
    """
    n = len(begin) - 1
    each = np.arange(n)
    last = np.maximum(each + several - 1, np.searchsorted(begin, begin[:-1] + words) - 1)
    first = np.minimum(each - several + 1, np.searchsorted(begin, begin[1:] - words, side="right") - 1)
    ok, full, long = last < n, first >= 0, np.flatnonzero(begin[1:] - begin[:-1] >= alone)
    full = full if ends is None else full & ends
    pairs = np.unique(np.concatenate((each[ok] * n + last[ok], first[full] * n + each[full], long * n + long)))
    first, last = pairs // max(n, 1), pairs % max(n, 1)
    return _hashed(h, begin[first], begin[last + 1]), first, last


def _hashed(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of the words from each s to each e."""
    up, down = _powers(1 << max(16, (len(h) + 1).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    return mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")


def _rows(docs: DataFrame, of) -> DataFrame:
    """(hash, doc_id, low, high): the word runs that of(row) gives for each row; high is the word after the last."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                got = []
                for row in batch.slice(at, ROWS).to_pylist():
                    w, a, z = of(row)
                    got.append((np.full(len(w), row["doc_id"], dtype=np.int64), w, a, z))
                doc, w, a, z = (np.concatenate(c) for c in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(doc), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], names=["hash", "doc_id", "low", "high"])

    return docs.mapInArrow(run, "hash bigint, doc_id bigint, low int, high int")


def _span_rows(docs: DataFrame, several: int, words: int, alone: int) -> DataFrame:
    def of(row):
        h, begin, ends, _ = _parted(row["text"])
        w, a, z = spans(h, begin, several, words, alone, ends)
        return w, begin[a], begin[z + 1]

    return _rows(_plain(docs), of)


def _window_rows(docs: DataFrame, near: DataFrame, words: int, least: int) -> DataFrame:
    """All runs of `least` words that share `words` with one of the stretches that near(doc_id, spans) names."""

    def of(row):
        h, _, _ = sentences(row["text"])
        n = len(h) - least + 1
        at = np.zeros(max(n, 0) + 1, np.int64)
        for c in row["spans"] if n > 0 else []:
            low, high = max(0, c["low"] + words - least), min(n, c["high"] - words + 1)
            if low < high:
                at[low] += 1
                at[high] -= 1
        at = np.flatnonzero(np.cumsum(at))
        return _hashed(h, at, at + least), at, at + least

    return _rows(_plain(docs).join(bounded(near, items="spans"), "doc_id"), of)


def _first(rows: DataFrame) -> DataFrame:
    """(hash, first): the first place of the hashes that stand at several."""
    out = cut(rows.groupBy("hash").agg(F.min(F.struct("doc_id", "low")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hash", "first"))
    _tidy(rows.sparkSession)  # the shuffle files of what was cut
    return out


def _merged(rows: DataFrame, *line: str) -> DataFrame:
    """rows with the number `run` that those of a line which overlap or touch share."""
    by = Window.partitionBy(*line).orderBy("low", "high")
    reach = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("opens", F.coalesce(F.col("low") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(by)).drop("opens")


def _by_doc(rows: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<low, high>>) of the merged rows of each document."""
    runs = _merged(rows.select("doc_id", "low", "high"), "doc_id").groupBy("doc_id", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return cut(runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans")))


def repeated(docs: DataFrame, several: int = 2, words: int = 15, alone: int = 50, least: int = 51) -> DataFrame:
    """(doc_id, spans array<struct<low, high>>): the words, high exclusive, that non-first passages of `least` words cover.

    Spans are hashed once, and written as a table that goes when their matches are. Their first places are a table of their
    own, so that a hash with very many spans is one row of it, and Spark can split that hash's spans among tasks.
    """
    with ExitStack() as held:
        with written(_span_rows(docs, several, words, alone)) as rows:
            met = rows.join(_first(rows), "hash").select("hash", "doc_id", "low", "high", F.col("first.doc_id").alias("source"), (F.col("low") - F.col("first.low")).alias("shift"))
            met = held.enter_context(written(met))
        _tidy(docs.sparkSession)
        again = _merged(met.filter("doc_id <> source or shift <> 0"), "doc_id", "source", "shift")
        whole = Window.partitionBy("doc_id", "source", "shift", "run")
        again = held.enter_context(written(again.select("hash", "doc_id", "low", "high", (F.max("high").over(whole) - F.min("low").over(whole) >= least).alias("long"))))
        short = cut(again.filter("not long").select("hash").distinct())
        near = _by_doc(met.join(short, "hash", "left_semi"))
        _tidy(docs.sparkSession)
        runs = held.enter_context(written(_window_rows(docs, near, words, least)))
        more = runs.join(_first(runs), "hash").filter("doc_id <> first.doc_id or low <> first.low").select("doc_id", "low", "high")
        return _by_doc(again.filter("long").select("doc_id", "low", "high").union(more))


def remove_repeats(docs: DataFrame, several: int = 2, words: int = 15, alone: int = 50, least: int = 51) -> DataFrame:
    """docs with the sentences that repeat earlier ones taken out, and n_sentences, n_removed, words_removed.

    Spans are runs of `several` or more sentences, with at least `words` words, or single sentences of `alone` words. Every
    passage of `least` words that repeats an earlier one loses the sentences (or pieces of them) that lie wholly within.
    What stays of a text keeps its bytes. Null texts stay null and empty ones empty; rows with a null doc_id stay as they
    are; rows that share a doc_id count as one document, and their first spans all stay. An empty table stays empty. Columns
    of docs stay, whatever their names; where it has one of the three names, its own column is replaced. A document's spans
    are merged, and the runs gathered in one row: their number is bounded by its sentences.
    """
    cover = bounded(repeated(docs, several, words, alone, least).select(F.col("doc_id").alias("_doc"), F.col("spans").alias("_spans")), items="_spans")
    names = ["n_sentences", "n_removed", "words_removed"]
    kept = [c for c in docs.columns if c not in names]
    both = packed(docs, F.col("doc_id").cast("bigint").alias("_doc")).join(cover, "_doc", "left")
    both = both.select(*[F.col("_row").getField(c).alias(f"_{i}") for i, c in enumerate(kept)], "_spans")
    at = kept.index("text")
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                texts, counts = [], []
                for text, cuts in zip(part.column(at).to_pylist(), part.column(len(kept)).to_pylist(), strict=True):
                    h, begin, raw = sentences(text)
                    n = len(begin) - 1
                    gone = np.zeros(n, bool)
                    for c in cuts or []:
                        if c["high"] <= len(h):
                            gone[np.searchsorted(begin, c["low"]) : np.searchsorted(begin, c["high"], side="right") - 1] = True
                    counts.append((n, int(gone.sum()), int((begin[1:] - begin[:-1])[gone].sum())))
                    texts.append(_without(raw, begin, gone) if gone.any() else text)
                cols = [pa.array(texts, pa.string()) if c == at else part.column(c) for c in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in zip(*counts, strict=True))], names=[*kept, *names])

    for name in names:
        schema = schema.add(name, "long")
    return both.mapInArrow(run, schema)


def _without(raw: bytes, begin: np.ndarray, gone: np.ndarray) -> str:
    """The bytes less the sentences gone, each with the space after it."""
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(b) + 1, dtype=np.int8)
    inside[1:] = ~_SPACE[b]
    start = np.append(np.flatnonzero(np.diff(inside) == 1), len(b))[begin]
    start[0] = 0
    return b"".join(raw[a:z] for a, z, g in zip(start[:-1], start[1:], gone, strict=True) if not g).decode("utf-8", "surrogatepass")
