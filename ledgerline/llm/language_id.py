"""Language ID with a blended-spectrum string kernel.

Two texts' kernel is the number of character n-grams (n = 1 to 3, hashed) that both hold, over the root of how many
each holds, with orders blended evenly. Nystroem landmarks map it to features; one-versus-rest kernel ridge regression
is fitted on them. A score is linear in the presence vector, so the landmarks and weights fold into one matrix. A text
is scored by stretches of SEGMENT characters, whose scores count by length, so that a passage in another language does
not outvote the rest; the stretches of a batch are scored by one product of their presence matrix with that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labelled import held_out, sample_by_label

_U = np.uint32
#: Hashed n-grams of each order; orders 1 to ORDERS.
BITS, ORDERS = 12, 3
WIDTH = ORDERS << BITS
#: The answer for texts without letters.
UNKNOWN = "und"
#: Characters of a stretch; characters whose n-grams are hashed at once in training; stretches of a matrix.
SEGMENT, PIECE = 400, 1 << 18
ROWS = 128


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Whether a code point is a letter (Unicode's category L)."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)


def letters(text: str | None) -> np.ndarray | None:
    """The whole text's code points, in lower case, each run of others than letters as one space; None without letters."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=_U)
    letter = _letter_table()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, _U(32))
    return c[(c != 32) | np.concatenate(([True], c[:-1] != 32))]


def _mark(there: np.ndarray, c: np.ndarray) -> None:
    h = np.zeros(len(c), dtype=_U)
    for n in range(ORDERS):
        if len(c) <= n:
            break
        h = h[: len(c) - n] * _U(0x01000193) + c[n:]
        there[(n << BITS) + ((h * _U(0x9E3779B1)) >> _U(32 - BITS)).astype(np.int64)] = True


def presence(c: np.ndarray) -> np.ndarray:
    """The sorted hashed n-grams among code points."""
    there = np.zeros(WIDTH, dtype=bool)
    for at in range(0, len(c), PIECE):
        _mark(there, c[max(0, at - ORDERS + 1) : at + PIECE])
    return np.flatnonzero(there)


def unit(at: np.ndarray) -> np.ndarray:
    """The presence vector scaled so that each order that occurs weighs the same and the whole has norm 1."""
    x = np.zeros(WIDTH, dtype=np.float32)
    order = at >> BITS
    counts = np.bincount(order, minlength=ORDERS)
    x[at] = 1.0 / np.sqrt(counts[order] * max(1, np.count_nonzero(counts)))
    return x


class Model:
    """Languages and the matrix that presence vectors are multiplied with."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray) -> None:
        self.langs, self.weights, self.bias = langs, weights, bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities by language of the rows of a presence matrix."""
        f = (x @ self.weights + self.bias) * 8.0
        f = np.exp(f - f.max(axis=1, keepdims=True))
        return f / f.sum(axis=1, keepdims=True)


def fit(samples: list[np.ndarray], langs: list[str], landmarks: int, ridge: float = 1e-2) -> Model:
    """Kernel ridge regression on Nystroem features; samples in a fixed order, landmarks taken in turn from each language."""
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs])
    turns = [np.flatnonzero(y == i) for i in range(len(names))]
    picked = [int(t[k]) for k in range(max(map(len, turns))) for t in turns if k < len(t)][:landmarks]
    z = np.stack([unit(samples[i]) for i in picked])
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    kernel = [np.stack([unit(s) for s in samples[i : i + ROWS]]) @ z.T for i in range(0, len(samples), ROWS)]
    phi = np.concatenate(kernel).astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weigh = (1.0 / np.bincount(y))[y][:, None] * len(y) / len(names)  # languages count alike, however many rows
    bias = (weigh * target).mean(axis=0)
    w = np.linalg.solve(phi.T @ (weigh * phi) + ridge * len(y) * np.eye(phi.shape[1]), phi.T @ (weigh * (target - bias)))
    return Model(names, z.T @ (root @ w).astype(np.float32), bias.astype(np.float32))


def train(docs: DataFrame, per_lang: int = 500, landmarks: int = 320, langs: int = 200, stretches: int = 3) -> Model | None:
    """A model from at most about per_lang documents of each of the `langs` most frequent languages, none held out.

    That sample is bounded by these parameters; so are the stretches, evenly spaced over a whole text, that stand for each
    of its documents. Executors turn them into n-grams, which alone reach the driver.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())

    def grams(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if (c := letters(row["text"])) is not None:
                    parts = np.array_split(c, max(1, round(len(c) / SEGMENT)))
                    at = [presence(parts[i]) for i in sorted({k * len(parts) // stretches for k in range(stretches)})]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([row["doc_id"]] * len(at), pa.int64()), "lang": [row["lang"]] * len(at), "at": pa.array(at, pa.list_(pa.int32()))})

    got = sample_by_label(rows, "lang", per_lang, langs).mapInArrow(grams, "doc_id bigint, lang string, at array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    at = got["at"].combine_chunks()
    flat, ends = at.flatten().to_numpy(), np.cumsum(np.concatenate(([0], np.asarray(at.value_lengths()))))
    samples = [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
    ids, names = got["doc_id"].to_pylist(), got["lang"].to_pylist()
    order = sorted(range(len(names)), key=lambda i: (ids[i] is None, ids[i] or 0, names[i], len(samples[i]), samples[i].tobytes()))
    return fit([samples[i] for i in order], [names[i] for i in order], landmarks)


def predict(model: Model | None, texts: list[str | None]) -> Iterator[tuple[int, str, float]]:
    """(place, language, score) of the texts that have letters."""
    places, sizes, rows = [], [], []
    sums: dict[int, np.ndarray] = {}
    total: dict[int, int] = {}

    def flush() -> None:
        for i, n, f in zip(places, sizes, model.scores(np.stack(rows)), strict=True):
            sums[i] = sums.get(i, 0.0) + n * f
            total[i] = total.get(i, 0) + n
        places.clear(), sizes.clear(), rows.clear()

    for i, text in enumerate(texts if model is not None else []):
        if (c := letters(text)) is None:
            continue
        pieces = max(1, round(len(c) / SEGMENT))
        for part in np.array_split(c, pieces):
            places.append(i)
            sizes.append(len(part))
            rows.append(unit(presence(part)))
            if len(rows) >= ROWS:
                flush()
    if rows:
        flush()
    for i, f in sums.items():
        k = int(np.argmax(f))
        yield i, model.langs[k], float(min(1.0, f[k] / total[i]))


def _batches(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs(doc_id, text).

    `und` with score 0 for null or empty texts and those without letters, and for every text if nothing was learned.
    Equal scores go to the language that sorts first. Repeated rows stay; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for part in _batches(batches):
            langs, scores = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows
            for i, lang, score in predict(model, part.column(2).to_pylist()):
                langs[i], scores[i] = lang, score
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """The documents whose language is known with a score of at least `least`; columns as in docs.

    Null and empty texts and those without letters go, and all if nothing was learned. Repeated rows are each judged by
    their text, whatever their doc_id, null or not; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        model = sent.value
        for part in _batches(batches):
            keep = np.zeros(part.num_rows, dtype=bool)
            for i, _, score in predict(model, part.column(at).to_pylist()):
                keep[i] = score >= least
            yield part.filter(pa.array(keep))

    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
