"""N-gram Jaccard join with adaptive multi-match prefixes.

Every distinct shingle set is a node. Shingles are ordered by a document-frequency sketch, rare first, and a node
publishes a prefix of ``n - ceil(t n) + l`` shingles: two sets that reach the threshold share at least
``min(l, l')`` shingles of their prefixes. ``l`` is chosen per document by the estimated cost of its candidates.

Only components are asked for, so candidates are met in two exact steps. First every node is verified against the
most central node that shares a prefix shingle with it: one pair per node and round, however large the group. Then
all pairs of nodes that still lie in different components and share enough prefix shingles are verified. A pair
inside one component cannot change the components, and no other pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded, components, cut, mix64, packed, shingles, unpacked

_U = np.uint64
#: Buckets of the frequency sketch: its size does not depend on the input.
SKETCH_BITS, SKETCH_BLOCK = 20, 1 << 14
#: Longest multi-match requirement, and the cost of verifying a candidate against probing a posting.
MOST_MATCHES, VERIFY_COST = 64, 4.0
#: 64-bit words of the parities that bound the overlap of two sets.
PARITY_WORDS = 4
#: Verified pairs a task may gather in one Arrow batch.
SMALL_BATCH = 512


def _texts(batches) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SMALL_BATCH):
            part = batch.slice(at, SMALL_BATCH)
            yield part.columns[:-1], part.columns[-1].to_pylist()


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Documents per bucket of the shingle hashes of docs(text), over all of them: a fixed number of counters.

    A task's counters travel as blocks, which are summed in groups of bounded size, twice.
    """
    salts = max(1, docs.rdd.getNumPartitions() // 128)

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for _, texts in _texts(batches):
            for text in texts:
                np.add.at(total, (shingles(text, k) >> _U(64 - SKETCH_BITS)).astype(np.int64), 1)
        salt = TaskContext.get().partitionId() % salts
        for i in range(0, len(total), SKETCH_BLOCK):
            yield pa.RecordBatch.from_pydict({"block": pa.array([i // SKETCH_BLOCK], pa.int32()), "salt": pa.array([salt], pa.int32()), "counts": pa.array([total[i : i + SKETCH_BLOCK].astype(np.uint32).tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(c.as_py(), dtype=np.uint32).astype(np.uint64) for c in table["counts"]), np.zeros(SKETCH_BLOCK, np.uint64))
        return pa.table({"block": table["block"][:1], "salt": table["salt"][:1], "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    kind = "block int, salt int, counts binary"
    rows = docs.select("text").mapInArrow(count, kind).groupBy("block", "salt").applyInArrow(add, kind)
    if salts > 1:
        rows = rows.groupBy("block").applyInArrow(add, kind)
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    got = rows.toArrow()
    for block, counts in zip(got["block"].to_pylist(), got["counts"], strict=True):
        sketch[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK] = np.frombuffer(counts.as_buffer(), dtype=np.uint32)
    return sketch


def choose_matches(weight: np.ndarray, n: int, need: int) -> int:
    """The number of shared prefix shingles to ask for: the cheapest by postings probed plus candidates verified.

    At least the root of n, so that no set with few shared shingles in its prefix can be a candidate of any other.
    """
    free, least = n - need, isqrt(n)
    most = max(least, min(MOST_MATCHES, need))
    probed = np.cumsum(weight[: free + most])[free + least - 1 :]
    return int(np.argmin(probed + VERIFY_COST * probed / np.arange(least, most + 1))) + least


def _signatures(k: int, percent: int, sketch):
    def run(batches):
        counts = sketch.value
        base = 2 * int(np.median(counts)) + 2
        seen: set[tuple[int, int]] = set()
        for ids, texts in _texts(batches):
            out = {c: [] for c in ("n", "node", "sig", "matches", "prefix")}
            for text in texts:
                s = shingles(text, k)
                n = len(s)
                out["n"].append(n)
                if not n:
                    for c in ("node", "sig", "matches", "prefix"):
                        out[c].append(None)
                    continue
                node, sig = _node(s)
                out["node"].append(node)
                out["sig"].append(sig)
                if (node, sig) in seen:  # one prefix of each set and task: copies add no postings
                    out["matches"].append(None)
                    out["prefix"].append(None)
                    continue
                seen.add((node, sig))
                often = np.maximum(counts[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)], base)
                order = np.lexsort((s, often))
                need = -(-percent * n // 100)
                matches = choose_matches((often[order] - base + 1).astype(np.float64), n, need)
                out["matches"].append(matches)
                out["prefix"].append(s[order[: n - need + matches]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(out["n"], pa.int64()), pa.array(out["node"], pa.int64()), pa.array(out["sig"], pa.int64()), pa.array(out["matches"], pa.int32()), pa.array(out["prefix"], pa.list_(pa.int64()))],
                names=["doc_id", "mark", "n", "node", "sig", "matches", "prefix"],
            )

    return run, "doc_id bigint, mark bigint, n bigint, node bigint, sig bigint, matches int, prefix array<bigint>"


def _node(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set; the first names its node."""
    return tuple(int(np.add.reduce(mix64(s ^ _U(salt))).astype(np.int64)) for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def parity(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each bit: two sets differ in as many shingles at least as their parities in bits."""
    odd = np.bincount((s & _U(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): mark is a hash of the text, which tells rows of one doc_id, or of none, apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.lit(1), text).alias("mark"), text.alias("text"))


def _fetch(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, items, bits) of the nodes(node, rep), made anew from the texts of their rows; bits is the parity."""
    wanted = bounded(nodes.select("node", F.col("rep.doc_id").alias("_doc"), F.col("rep.mark").alias("_mark")))

    def run(batches):
        seen: set[int] = set()  # rows that share id and text give a node once in each task
        for (names,), texts in _texts(batches):
            found, same = [shingles(t, k) for t in texts], []
            for i, (s, node) in enumerate(zip(found, names.to_pylist(), strict=True)):
                if node not in seen and len(s) and _node(s)[0] == node:
                    seen.add(node)
                    same.append(i)
            items = pa.array([found[i].view(np.int64) for i in same], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(same, pa.int64())), items, pa.array([parity(found[i]) for i in same], pa.list_(pa.int64()))], names=["node", "items", "bits"])

    met = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")))
    return cut(met.select("node", "text").mapInArrow(run, "node bigint, items array<bigint>, bits array<bigint>"))


def _bounds(sets: DataFrame) -> DataFrame:
    """(node, own, p0, p1, ...): shingles that no other of these sets holds, and the parity of the rest."""
    words = range(PARITY_WORDS)
    word = F.shiftright(F.col("token").bitwiseAND(F.lit(64 * PARITY_WORDS - 1)), 6)
    bit = F.expr("shiftleft(1L, cast(token & 63 as int))")
    alone = sets.select(F.explode("items").alias("token"), "node").groupBy("token").agg(F.count("*").alias("df"), F.min("node").alias("node")).filter("df = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("own"), *[F.bit_xor(F.when(word == i, bit)).alias(f"q{i}") for i in words])
    every = sets.select("node", *[F.col("bits")[i].alias(f"p{i}") for i in words]).dropDuplicates(["node"])
    return every.join(alone, "node", "left").select("node", F.coalesce("own", F.lit(0)).alias("own"), *[F.col(f"p{i}").bitwiseXOR(F.coalesce(f"q{i}", F.lit(0))).alias(f"p{i}") for i in words])


def _can_link(percent: int):
    """Whether the overlap of rows x and y can reach the threshold: it is at most what either holds besides its own
    shingles, and half of what is left of both sums after as many as their parities differ in."""
    differ = sum((F.bit_count(F.col(f"x.p{i}").bitwiseXOR(F.col(f"y.p{i}"))) for i in range(PARITY_WORDS)), F.lit(0))
    least = F.lit(percent) * (F.col("x.n") + F.col("y.n"))
    shorter = F.lit(100 + percent) * F.least("x.most", "y.most", "x.n", "y.n") >= least
    return shorter & (F.lit(100 + percent) * (F.col("x.most") + F.col("y.most") - differ) >= F.lit(2) * least)


def _fewest(percent: int):
    """Prefix shingles that a node shares at least with any partner: the root of the smallest size a partner can have."""
    return F.floor(F.sqrt(F.ceil(F.lit(percent) * F.col("n") / F.lit(100))))


def _able(rows: DataFrame, percent: int) -> DataFrame:
    """The postings of nodes that hold enough of them."""
    return rows.withColumn("_c", F.count("*").over(Window.partitionBy("node"))).filter(F.col("_c") >= _fewest(percent)).drop("_c")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    inter = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", inter.alias("i"), (F.size("x") + F.size("y")).alias("s")).filter(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("s") - F.col("i"))).select("a", "b")


def _merged(label: DataFrame, found: DataFrame) -> DataFrame:
    """label after the pairs of found were linked too: only their components are gone through again."""
    ends = found
    for c in ("a", "b"):
        ends = ends.join(label.withColumnsRenamed({"node": c, "comp": f"_{c}"}), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    over = components(ends).select(F.col("comp").alias("_top"), F.col("node").alias("comp"))
    alone = over.select(F.col("comp").alias("node"), F.col("_top").alias("comp")).join(label.select("node"), "node", "left_anti")
    return cut(label.join(over, "comp", "left").select("node", F.coalesce("_top", "comp").alias("comp")).unionByName(alone))


def _linked(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, node, sig) of every row, and (node, sig, first): the first row of a set's component.

    Rows are ordered by doc_id, null last, then mark.
    """
    spark = docs.sparkSession
    docs = _marked(docs)
    sketch = spark.sparkContext.broadcast(frequency_sketch(docs, k))
    run, schema = _signatures(k, percent, sketch)
    signed = cut(docs.mapInArrow(run, schema))
    sketch.destroy()
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    nodes = cut(signed.filter("node is not null").groupBy("node", "sig").agg(F.min(row).alias("rep"), F.max("n").alias("n")))

    posted = signed.filter("prefix is not null").select(F.explode("prefix").alias("token"), "node", "n", "matches")
    posted = posted.repartition(F.col("token")).groupBy("token", "node").agg(F.min("n").alias("n"), F.min("matches").alias("matches"))
    met = Window.partitionBy("token")
    shared = cut(posted.withColumn("df", F.count("*").over(met)).filter("df > 1").drop("df"))
    shared = cut(_able(shared, percent).withColumn("df", F.count("*").over(met)).filter("df > 1").drop("df"))
    reps = nodes.groupBy("node").agg(F.min("rep").alias("rep"))

    # Every node against the most central one that it shares most with.
    label = None
    scored = shared.withColumn("score", F.count("*").over(Window.partitionBy("node")))
    hubs = scored.groupBy("token").agg(F.max(F.struct("score", "node")).alias("h")).select("token", F.col("h.node").alias("hub"))
    near = shared.join(hubs, "token").filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("c"), F.min("n").alias("n")).filter(F.col("c") >= _fewest(percent))
    pairs = cut(near.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("m")).select(F.col("node").alias("a"), F.col("m.hub").alias("b")))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    found = cut(_verified(pairs, _fetch(docs, reps.join(ends, "node"), k), percent))
    if found.limit(1).count():
        label = components(found)

    # What is left: pairs of different components that share enough prefix shingles.
    rows = shared.withColumn("comp", F.col("node")) if label is None else shared.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    for _ in range(2):
        spread = rows.withColumn("lo", F.min("comp").over(met)).withColumn("hi", F.max("comp").over(met)).filter("lo <> hi").drop("lo", "hi")
        rows = cut(_able(spread, percent))
    if rows.limit(1).count():
        # A shingle that no other of these nodes holds is in no overlap of theirs: what is left bounds each node's overlaps.
        sets = _fetch(docs, reps.join(rows.select("node").distinct(), "node"), k)
        rows = rows.join(_bounds(sets), "node").withColumn("most", F.col("n") - F.col("own")).filter(F.lit(100) * F.col("most") >= F.lit(percent) * F.col("n"))
        rows = cut(rows.select("token", "node", "comp", "n", "matches", "most", *[f"p{i}" for i in range(PARITY_WORDS)]))
        x, y = rows.alias("x"), rows.alias("y")
        more = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & _can_link(percent))
        more = more.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("x.matches", "y.matches")).alias("m")).filter("c >= m")
        seen = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = cut(_verified(more.join(seen, ["a", "b"], "left_anti"), sets, percent))
        if found.limit(1).count():
            label = components(found) if label is None else _merged(label, found)

    if label is None:
        named = nodes.select("node", "sig", F.col("rep").alias("first"))
    else:
        placed = nodes.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        first = placed.groupBy("comp").agg(F.min("rep").alias("first"))
        named = placed.join(first, "comp").select("node", "sig", "first")
    return signed.select("doc_id", "mark", "n", "node", "sig"), cut(named)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text).

    Sets of k-word shingles link at a Jaccard similarity of percent/100 or more; component_id is the smallest doc_id
    reachable. Null and empty texts have no shingles and link with nothing; texts under k words are one shingle; rows
    that repeat a doc_id are kept, and so are those without one, which link like others: their component_id is null only
    if no row of their component has an id. Other columns are ignored.
    """
    signed, named = _linked(docs, k, percent)
    rows = signed.join(named, ["node", "sig"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def one_per_component(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One document of each component: that of the smallest doc_id, null last. Columns as in docs, whatever their names.

    Rows that repeat the document's id and text all stay, as one document; of rows without an id that share a text, any one
    stays. Rows whose texts have no words link with nothing and stay, whatever their ids.
    """
    signed, named = _linked(docs, k, percent)
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.mark") == F.col("mark"))
    keep = cut(signed.join(named, ["node", "sig"], "left").filter(F.col("node").isNull() | first).select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("node").isNull().alias("_wordless")).distinct())
    text = F.col("text").cast("string")
    rows = packed(docs, F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(F.lit(1), text).alias("_m"))
    there = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_m") == F.col("_mark"))
    unnamed = keep.filter("_doc is null and not _wordless")
    if not unnamed.limit(1).count():
        return unpacked(rows.join(keep, there, "left_semi"), docs.columns)
    others = rows.join(keep.filter("_doc is not null or _wordless"), there, "left_semi")
    once = rows.filter("_id is null").join(unnamed, there, "left_semi").dropDuplicates(["_m"])
    return unpacked(others.unionByName(once), docs.columns)
