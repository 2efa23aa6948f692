"""What the operators of this package share: lineage cuts, bounded broadcasts, components, hashed words."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000

_U = np.uint64


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared spark.checkpoint.dir; only where none is set and all runs in one process, a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder, with no lineage before them.

    The driver's garbage is collected, so that Spark drops shuffle files that nothing refers to any more.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    gc.collect()
    _tidy(spark)
    return out


def _tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage, and let its C library give back what the compiler's threads no longer hold.

    Without the second, a driver that has compiled many plans keeps some hundred MB that nothing uses.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    kind, text = jvm.java.lang.Class.forName, "java.lang.String"
    types = gateway.new_array(jvm.java.lang.Class, 4)
    for i, name in enumerate(("javax.management.ObjectName", text, "[Ljava.lang.Object;", f"[L{text};")):
        types[i] = kind(name)
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        kind("javax.management.MBeanServerConnection").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # a JVM without that command
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def written(df: DataFrame):
    """df as a Parquet table in the shared checkpoint folder, which goes when the block ends.

    df itself is not held meanwhile, so that its shuffle files can go.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    try:
        yield spark.read.schema(schema).parquet(path)
    finally:
        remove(spark, path)


def packed(df: DataFrame, *more) -> DataFrame:
    """Each row of df as one struct `_row`, and the columns `more`: names of df cannot clash with any others."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *more)


def unpacked(df: DataFrame, columns: list[str], **instead) -> DataFrame:
    """The columns of `_row` as they were, but those named in `instead`, which are replaced."""
    return df.select(*[instead[c].alias(c) if c in instead else F.col("_row").getField(c).alias(c) for c in columns])


def text_key(text="text"):
    """What tells texts apart: two hashes of the text and its length; null has one of its own."""
    t = F.col(text).cast("string") if isinstance(text, str) else text.cast("string")
    return F.struct(F.xxhash64(F.lit(1), t).alias("a"), F.xxhash64(F.lit(2), t).alias("b"), F.coalesce(F.length(t), F.lit(-1)).alias("n"))


def bounded(df: DataFrame, rows: int | None = None, items: str | None = None) -> DataFrame:
    """df with a broadcast hint if a count proves that it has at most so many rows; else df as it is.

    items: an array column, whose items are counted too, as rows may hold any number of them.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    if items and (df.agg(F.sum(F.size(items))).first()[0] or 0) > rows:
        return df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, comp): the smallest node that each end of an edge (a, b) reaches.

    Min-label propagation with pointer jumping. Only a changed-rows count reaches the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")))
    for _ in range(most):
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = label.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = label.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        step = cut(step.join(up, "comp", "left").select("node", "was", F.coalesce("up", "comp").alias("comp")))
        changed = step.filter("comp <> was").limit(1).count()
        label = step.select("node", "comp")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return label


# ---------------------------------------------------------------- words as 64-bit hashes

#: ASCII letters A-Z to lower case; everything else as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PIECE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(_BASE_INV)


def _pieces(raw: bytes):
    """raw in pieces of about a megabyte, cut only after a separator."""
    at = 0
    while len(raw) - at > _PIECE:
        end = at + _PIECE
        while end < len(raw) and not _SPACE[raw[end - 1]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _hash_spans(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = 1 << max(16, (len(b) + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word [^\\x20\\x09-\\x0D]+ of the whole text, A-Z in lower case."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    out = []
    for piece in _pieces(text.encode("utf-8", "surrogatepass").translate(LOWER)):
        b = np.frombuffer(piece, dtype=np.uint8)
        inside = np.zeros(len(b) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[b]
        turn = np.diff(inside)
        out.append(_hash_spans(b, np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)))
    return out[0] if len(out) == 1 else np.concatenate(out)


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; with fewer words, one of the whole sequence; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        total = np.full(n - k + 1, _U(k) * _U(0xD6E8FEB86659FD93), dtype=np.uint64)
        for i in range(k):
            total = mix64(total + words[i : n - k + 1 + i] * _U(2 * i + 3))
    return total


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(rolling(word_hashes(text), k))
