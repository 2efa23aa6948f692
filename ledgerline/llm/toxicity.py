"""Toxicity by weak supervision.

Voters look at a whole text and vote toxic or nothing: each word of short lexicons, patterns, and words and word beginnings
that the bounded labelled sample shows to be telling. A generative label model estimates by EM, from the votes alone, how
accurate each voter is; voters that vote together beyond what it explains share their weight. A sparse linear classifier on
hashed words and word beginnings is then trained on the posterior labels, and scores every document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labelled import held_out, sample_by_label

#: Lexicons of insults by kind, and patterns over the lower-cased text.
LEXICONS = {
    "intellect": ("idiot", "moron", "stupid", "dumb", "imbecile", "fool"),
    "worth": ("worthless", "pathetic", "loser", "useless"),
    "filth": ("scum", "trash", "garbage", "disgusting", "vermin", "filth"),
    "mockery": ("clown", "joke", "ridiculous"),
    "german": ("dummkopf", "trottel", "abschaum", "versager"),
    "french": ("imbécile", "crétin", "ordure", "minable"),
    "spanish": ("estúpido", "imbécil", "basura", "inútil"),
}
PATTERNS = {
    "second person": r"\byou (?:are|re) (?:an? |such an? )?(?:idiot|moron|loser|clown|fool)",
    "imperative": r"\b(?:shut up|go away|get lost|drop dead)\b",
    "shouting": r"!{3,}",
}
#: Hashed features; word beginnings of these many letters besides whole words.
BITS, BEGIN = 18, (3, 4, 5, 6)
#: Mined voters at most, the sample documents a feature must stand in, other features of the classifier at most, its penalty.
MINED, SUPPORT, MOST, PENALTY = 400, 6, 600, 2e-4
_WORD = re.compile(r"[^\W\d_]+")
_SEEN_WORDS = 300_000
_patterns = [re.compile(p) for p in PATTERNS.values()]


class Features:
    """Hashed features of a text; the features of words seen are kept, up to a bound."""

    def __init__(self) -> None:
        self.words: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        got = self.words.get(word)
        if got is None:
            parts = [word + "$", *(word[:n] for n in BEGIN if len(word) >= n)]
            got = tuple({_hash(p) for p in parts})
            if len(self.words) >= _SEEN_WORDS:
                self.words.clear()
            self.words[word] = got
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, set[str]]:
        words = set(_WORD.findall((text or "").lower()))
        out: set[int] = set()
        for w in words:
            out.update(self.of(w))
        return np.fromiter(out, dtype=np.int64, count=len(out)), words


def _hash(part: str) -> int:
    h = 0xCBF29CE484222325
    for c in part:
        h = (h ^ ord(c)) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 32
    h = h * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return h >> (64 - BITS)


#: One voter for each word of the lexicons and each pattern.
_LEXICON = {w: i for i, w in enumerate(dict.fromkeys(w for lex in LEXICONS.values() for w in lex))}
FIXED = len(_LEXICON) + len(PATTERNS)


def fixed_votes(text: str | None, words: set[str]) -> list[int]:
    """The fixed voters that vote toxic on a text: places of lexicon words, then of patterns."""
    low = (text or "").lower()
    return [i for w, i in _LEXICON.items() if w in words] + [len(_LEXICON) + i for i, p in enumerate(_patterns) if p.search(low)]


def mine(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Features that stand in several toxic sample documents which no feature before them covers, and hardly in clean ones.

    The words that near copies of one toxic document share are covered by the feature that makes it toxic.
    """
    toxic = np.zeros(1 << BITS)
    clean = np.zeros(1 << BITS)
    holders: dict[int, list[int]] = {}
    for i, (at, label) in enumerate(zip(rows, y, strict=True)):
        (toxic if label else clean)[at] += 1
        if label:
            for f in at.tolist():
                holders.setdefault(f, []).append(i)
    n_clean, n_toxic = max(1.0, (1 - y).sum()), max(1.0, y.sum())
    against = (clean + 0.5) / n_clean
    covered, out = np.zeros(len(rows), dtype=bool), []
    while len(out) < MINED:
        rate = (toxic + 0.5) / n_toxic / against
        worth = np.where((toxic >= SUPPORT) & (rate >= 8), toxic * np.log(rate), 0)
        best = int(np.argmax(worth))
        if worth[best] <= 0:
            break
        out.append(best)
        for i in holders[best]:
            if not covered[i]:
                covered[i] = True
                toxic[rows[i]] -= 1
    return np.asarray(out, dtype=np.int64)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Posterior probability of label 1 by row, from the votes alone: EM over voters whose correlations share their weight.

    votes: 1, or 0 where a voter abstains, by row and voter. That all abstain is an event of its own; else abstentions say
    nothing, as voters that stand for different words exclude each other. The posterior begins at `start`, which tells the
    model which of its two classes is the toxic one and is forgotten after the first round. A voter's weight is 1 over 1
    plus its summed residual correlations with the others, so copies of one voter count once.
    """
    silent = ~votes.any(axis=1)
    post, weight = start.copy(), np.ones(votes.shape[1])
    for turn in range(rounds):
        hit = (post @ votes + 0.3) / (post.sum() + 1.0)
        miss = ((1 - post) @ votes + 0.05) / ((1 - post).sum() + 1.0)
        if turn in (1, 5) and votes.shape[1] > 1:
            rest = votes - post[:, None] * hit - (1 - post)[:, None] * miss
            scale = np.sqrt((rest**2).sum(axis=0)) + 1e-9
            corr = np.clip(rest.T @ rest / scale[:, None] / scale[None], 0, 1)
            np.fill_diagonal(corr, 0)
            weight = 1.0 / (1.0 + np.where(corr > 0.1, corr, 0).sum(axis=1))
        prior = float(np.clip(post.mean(), 1e-3, 0.999))
        none = np.log((post[silent].sum() + 0.05) / (post.sum() + 1.0)) - np.log(((1 - post)[silent].sum() + 1.0) / ((1 - post).sum() + 1.0))
        logit = np.log(prior / (1 - prior)) + votes @ (weight * np.log(hit / miss)) + silent * none
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-4:
            break
        post = new
    return post


def fit_linear(x: np.ndarray, target: np.ndarray, weigh: np.ndarray, penalty: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """(weights, bias) of logistic regression on soft labels with an L1 penalty: accelerated proximal steps."""
    weigh = weigh / weigh.sum()
    scaled = x * np.sqrt(weigh)[:, None]
    v = np.ones(x.shape[1]) / max(1, x.shape[1]) ** 0.5
    for _ in range(20):
        u = scaled.T @ (scaled @ v)
        v = u / (np.linalg.norm(u) + 1e-12)
    step = 1.0 / (0.25 * 1.1 * (np.linalg.norm(u) + 1.0) + 1e-9)
    share = float(np.clip(weigh @ target, 1e-3, 0.999))
    w, b = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    y, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        g = weigh * (1 / (1 + np.exp(-np.clip(x @ y + c, -30, 30))) - target)
        new = y - step * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        bias = c - step * g.sum()
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, c = new + (was - 1) / t * (new - w), bias + (was - 1) / t * (bias - b)
        w, b = new, bias
    return w, float(b)


class Model:
    """A linear classifier: weights of the hashed features, which a text's features add up, whatever its length."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), bias
        self.slope, self.shift = 1.0, 0.0

    def raw(self, at: np.ndarray) -> float:
        return float(self.bias + self.weights[at].sum(dtype=np.float64))

    def calibrate(self, z: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> None:
        """Slope and shift of the log odds by weighted logistic regression on labelled rows that the weights have not seen."""
        if not len(y) or not 0 < y.sum() < len(y):
            return
        x = np.stack([z, np.ones_like(z)], axis=1)
        c = np.array([1.0, 0.0])
        weigh = weigh / weigh.mean()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(2), x.T @ (weigh * (p - y)) + 1e-1 * (c - [1.0, 0.0]))
            c = c - np.clip(step, -2, 2)
        self.slope, self.shift = float(max(c[0], 0.1)), float(c[1])

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.raw(at) + self.shift, -30, 30))))


def telling(at: list[np.ndarray], target: np.ndarray, weigh: np.ndarray, most: int) -> np.ndarray:
    """The features whose presence moves the share of the target most, by their weighted score statistic."""
    every, toxic, count = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS, np.int64)
    for x, p, w in zip(at, target, weigh, strict=True):
        every[x] += w
        toxic[x] += w * p
        count[x] += 1
    share = weigh @ target / weigh.sum()
    gain = np.where(count >= SUPPORT, (toxic - share * every) ** 2 / np.maximum(every, 1e-9), 0)
    best = np.argsort(-gain, kind="stable")[:most]
    return best[gain[best] > 0]


def learn(at: list[np.ndarray], fixed: list[list[int]], y: np.ndarray, totals: dict[int, int]) -> Model:
    """A model of labelled rows: their features, the fixed voters' votes, labels, and how many rows of each label there are.

    Labels choose the mined voters, start the label model and calibrate the scores; the classifier learns from the
    posterior of the voters. Every fourth row is kept for the calibration.
    """
    later = np.arange(len(y)) % 4 == 3 if len(y) >= 40 else np.zeros(len(y), bool)
    weigh = np.where(y == 1, totals.get(1, 1) / max(1.0, y.sum()), totals.get(0, 1) / max(1.0, (1 - y).sum()))
    now = np.flatnonzero(~later)
    found = mine([at[i] for i in now], y[now])
    place = np.full(1 << BITS, -1)
    place[found] = np.arange(len(found))
    votes = np.zeros((len(now), FIXED + len(found)))
    for r, i in enumerate(now):
        votes[r, fixed[i]] = 1
        votes[r, FIXED + place[at[i]][place[at[i]] >= 0]] = 1
    start = np.clip(0.9 * y[now] + 0.05, 0.05, 0.95)
    post = label_model(votes, start)
    own = [at[i] for i in now]
    kept = np.unique(np.concatenate((found, telling(own, post, weigh[now], MOST))))
    place[:] = -1
    place[kept] = np.arange(len(kept))
    x = np.zeros((len(now), len(kept)), dtype=np.float32)
    for r, a in enumerate(own):
        x[r, place[a][place[a] >= 0]] = 1
    w, bias = fit_linear(x, post, weigh[now], PENALTY)
    weights = np.zeros(1 << BITS)
    weights[kept] = w
    model = Model(weights, bias)
    check = np.flatnonzero(later)
    model.calibrate(np.array([model.raw(at[i]) for i in check]), y[check], weigh[check])
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = 3000) -> Model | None:
    """A model from at most about per_label labelled documents of each label, none held out.

    That sample is bounded by this parameter, whatever the input: its ids are broadcast, executors turn its texts into
    features, and one row of each id (of rows that repeat an id, the least) reaches the driver. None without such rows.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = sample_by_label(known, "toxic", per_label, 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches):
        features = Features()
        for batch in batches:
            for i, y, text in zip(batch["doc_id"].to_pylist(), batch["toxic"].to_pylist(), batch["text"].to_pylist(), strict=True):
                at, words = features(text)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "toxic": pa.array([y], pa.int32()), "at": pa.array([np.sort(at)], pa.list_(pa.int32())), "votes": pa.array([fixed_votes(text, words)], pa.list_(pa.int32()))})

    got = rows.mapInArrow(run, "doc_id bigint, toxic int, at array<int>, votes array<int>")
    got = got.groupBy("doc_id").agg(F.min(F.struct("toxic", "at", "votes")).alias("r")).select("doc_id", "r.*").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    flat = got["at"].combine_chunks()
    values, ends = flat.flatten().to_numpy(), np.cumsum(np.concatenate(([0], np.asarray(flat.value_lengths()))))
    votes = got["votes"].to_pylist()
    return learn([values[ends[i] : ends[i + 1]] for i in order], [votes[i] for i in order], got["toxic"].to_numpy().astype(float)[order], totals)


def score_toxicity(docs: DataFrame, model: Model | None, cut_at: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text); predicted is 1 from a score of cut_at.

    Null and empty texts score by the bias alone; all score 0 if nothing was learned. Repeated rows stay, other columns
    are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, features = sent.value, Features()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                s = [model.score(features(t)[0]) if model is not None else 0.0 for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn("predicted", (F.col("score") >= cut_at).cast("int"))
