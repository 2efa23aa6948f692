"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt over blocks. In each block, every tree holds the block's rows as one sorted array of 64-bit hash strings:
signs of seeded projections of the centred vectors. A query descends to its longest prefix match in every tree, then all
trees ascend together, one bit at a time, until they have met enough rows. Those are ranked by exact distance, and the
blocks' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block and queries of a group, about: what one task holds.
BLOCK, QUERIES = 20_000, 1_000
DEPTH = 64


class Forest:
    """Sorted hash strings of the rows of a block, in several trees."""

    def __init__(self, vectors: np.ndarray, trees: int, seed: int) -> None:
        self.center = vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])
        rng = np.random.default_rng(seed)
        self.planes = [rng.standard_normal((vectors.shape[1], DEPTH)) for _ in range(trees)]
        self.orders, self.strings = [], []
        for planes in self.planes:
            h = self.hashes(vectors, planes)
            order = np.argsort(h, kind="stable")
            self.orders.append(order)
            self.strings.append(h[order])
        self.size = len(vectors)

    def hashes(self, vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
        bits = np.packbits((vectors - self.center) @ planes > 0, axis=1)
        return bits.view(">u8")[:, 0].astype(np.uint64)

    def candidates(self, queries: np.ndarray, least: int):
        """For each query, the rows of the block that the trees meet until there are `least` of them."""
        own = [self.hashes(queries, p) for p in self.planes]
        drop = np.arange(DEPTH, dtype=np.uint64)  # bits left off, from none to all but one
        for q in range(len(queries)):
            lows, highs = [], []
            for h, strings in zip(own, self.strings, strict=True):
                low = (h[q] >> drop) << drop
                lows.append(np.searchsorted(strings, low, side="left"))
                highs.append(np.searchsorted(strings, low | ((np.uint64(1) << drop) - np.uint64(1)), side="right"))
            low, high = np.asarray(lows), np.asarray(highs)
            met = np.zeros(self.size, dtype=bool)
            level = int(np.searchsorted((high - low).sum(axis=0), min(least, self.size)))  # fewer cannot do
            while True:
                if level >= DEPTH:
                    met[:] = True
                    break
                for order, a, z in zip(self.orders, low[:, level], high[:, level], strict=True):
                    met[order[a:z]] = True
                if np.count_nonzero(met) >= min(least, self.size):
                    break
                level += 1
            yield np.flatnonzero(met)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    ok = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.coalesce(ok, F.lit(False)) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, trees: int = 16, share: float = 0.7, seed: int = 29) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by `every`.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller vec_id. Null and
    zero vectors and those with null or non-finite components take no part; vectors of another length than a query's are
    not its candidates. A query's own row is none either, but other rows with its vec_id are, and rows that repeat a query
    whole are queries each, with k results each. `share` of a block's rows, at least 20 k, are met before a query stops
    ascending: vectors with no structure need that much for a recall of 0.9.
    """
    rows = usable(vectors)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    blocks, groups = max(1, -(-sizes["n"] // BLOCK)), max(1, -(-sizes["q"] // QUERIES))
    data = rows.select(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks).cast("bigint")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "vec_id", "v")
    ask = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    ask = ask.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part"), "vec_id", "v", F.xxhash64("v").alias("mark"), "copies")

    def search(data: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids, qids, marks, copies = data["vec_id"].to_numpy(), *(ask[c].to_numpy() for c in ("vec_id", "mark", "copies"))
        length, qlength = (np.asarray(pc.list_value_length(t["v"].combine_chunks())) for t in (data, ask))
        for d in np.unique(qlength):
            at, qat = np.flatnonzero(length == d), np.flatnonzero(qlength == d)
            if not len(at):
                continue
            order = at[np.argsort(ids[at], kind="stable")]
            x = data["v"].combine_chunks().take(pa.array(order)).flatten().to_numpy().reshape(-1, d)
            q = ask["v"].combine_chunks().take(pa.array(qat)).flatten().to_numpy().reshape(-1, d)
            forest = Forest(x, trees, seed)
            for i, met in enumerate(forest.candidates(q, max(20 * k, int(share * len(x))))):
                own = met[ids[order[met]] == qids[qat[i]]]
                if len(own := own[(x[own] == q[i]).all(axis=1)]):  # equal vectors share all prefixes, so they are met if any is
                    met = met[met != own[0]]
                dist = np.sqrt(((x[met] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[order[met]], dist))[:k]
                n = len(best)
                out.append((np.full(n, qids[qat[i]]), np.full(n, marks[qat[i]]), np.full(n, copies[qat[i]]), ids[order[met[best]]], dist[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        names = ("query_id", "mark", "copies", "vec_id", "score")
        return pa.table({n: pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in zip(names, cols, strict=True)})

    found = data.groupBy("block", "part").cogroup(ask.groupBy("block", "part")).applyInArrow(search, "query_id bigint, mark bigint, copies bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id", "mark").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", each.alias("_copy")).drop("_copy")
