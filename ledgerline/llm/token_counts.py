"""Token counts by heap-and-linked-list byte-pair merging: initial symbols minus merges, no identifiers emitted."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenising pattern of byte-level vocabularies of this kind.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts that a worker keeps of words seen; at the bound they are forgotten and start anew.
KEPT = 500_000
#: A text falls into words with the spaces before them; where it has other white space, the full pattern cuts it.
_FAST = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD = re.compile(r"[^\S \n]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such vocabulary files."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge_count(raw: bytes, first: list[int], ranks: dict[int, int], merged: list[int], byte: list[int]) -> int:
    """Symbols left after merging the bytes: again and again the pair of lowest rank, leftmost first.

    first: the rank of each pair of bytes, -1 for none; ranks: that of (left << 20 | right); merged: the symbol a rank
    makes. The heap holds rank << 32 | place; neighbours are linked lists, and entries whose pair is gone are skipped.
    """
    n = len(raw)
    heap = [r << 32 | i for i, r in enumerate([first[a << 8 | b] for a, b in zip(raw, raw[1:])]) if r >= 0]
    if not heap:
        return n
    heapify(heap)
    symbols = [byte[c] for c in raw]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = ranks.get
    left = n
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        a = symbols[i]
        j = after[i]
        if a < 0 or j >= n:
            continue
        rank = top >> 32
        if get(a << 20 | symbols[j]) != rank:
            continue
        left -= 1
        symbols[i] = new = merged[rank]
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := get(new << 20 | symbols[k])) is not None:
                heappush(heap, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := get(symbols[h] << 20 | new)) is not None:
            heappush(heap, r << 32 | h)
    return left


def supported(vocabulary: dict) -> None:
    """Raise unless a vocabulary file asks for no more than plain byte-level byte-pair merging over PRETOKEN."""
    model, pre = vocabulary["model"], vocabulary.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        wrong.append("another model or pre-tokenizer")
    if vocabulary.get("normalizer"):
        wrong.append("a normalizer")
    if wrong or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in vocabulary.get("added_tokens") or []):
        raise ValueError(f"the vocabulary file asks for what is not built: {', '.join(wrong) or 'stripping or whole-word added tokens'}")


class Counter:
    """Tokens of texts under one vocabulary file; made once in a worker."""

    def __init__(self, vocabulary: str) -> None:
        import regex

        model = json.loads(vocabulary)
        supported(model)
        ids = model["model"]["vocab"]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a] << 20 | ids[b]] = rank
            self.merged.append(ids[a + b])
        self.byte = [ids[c] for c in byte_symbols()]
        self.first = [self.ranks.get(a << 20 | b, -1) for a in self.byte for b in self.byte]
        self.find = regex.compile(PRETOKEN).findall
        special = [t["content"] for t in model.get("added_tokens") or []]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.marks = special
        counter = self

        class Words(dict):
            def __missing__(self, word: str) -> int:
                n = counter.word(word.encode("utf-8", "surrogatepass"))
                if len(self) >= KEPT:
                    self.clear()
                if len(word) <= 64:
                    self[word] = n
                return n

        class Chunks(dict):
            def __missing__(self, chunk: str) -> int:
                n = sum(map(counter.words.__getitem__, counter.find(chunk)))
                if len(self) >= KEPT:
                    self.clear()
                if len(chunk) <= 64:
                    self[chunk] = n
                return n

        class Spaced(dict):
            """By what follows a single space."""

            def __missing__(self, piece: str) -> int:
                n = sum(map(counter.words.__getitem__, counter.find(" " + piece)))
                if len(self) >= KEPT:
                    self.clear()
                if len(piece) <= 64:
                    self[piece] = n
                return n

        self.words, self.chunks, self.spaced = Words(), Chunks(), Spaced()

    def word(self, raw: bytes) -> int:
        if len(raw) == 1:
            return 1
        return merge_count(raw, self.first, self.ranks, self.merged, self.byte)

    def plain(self, text: str) -> int:
        if _ODD.search(text):
            return sum(map(self.words.__getitem__, self.find(text)))
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            return sum(map(self.chunks.__getitem__, _FAST.findall(text)))
        first, *rest = text.split(" ")
        return self.chunks[first] + sum(map(self.spaced.__getitem__, rest))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not any(m in text for m in self.marks):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str | Path, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text).

    Plain byte-level byte-pair encoding by the merges of the vocabulary file (.json); added tokens inside a text count as
    one, no others are added; a file that asks for a normalizer or another pre-tokenizer or model is refused. Null and empty texts have no bytes and no tokens. Repeated rows stay; other columns are ignored.
    The vocabulary, of fixed size, is sent once to each executor.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def run(batches):
        count: Callable = counter(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = [count(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
