"""Bounded labelled samples for the classifiers: chosen by seeded hash of doc_id, alike at every size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4: rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample_by_label(rows: DataFrame, label: str, per_label: int, labels: int, seed: int = 11) -> DataFrame:
    """About per_label rows (at most 1.25 times and 50) of each of the `labels` most frequent labels.

    A label's rows are thinned by a hash of doc_id at a rate taken from its count, so no label is sorted or gathered.
    Only the counts, one row for each label, reach the driver.
    """
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(labels).collect()
    if not counts:
        return rows.limit(0)
    rate = F.lit(None).cast("double")
    for r in counts:
        rate = F.when(F.col(label) == F.lit(r[0]), F.lit(min(1.0, per_label / r["count"]))).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(draw < rate).limit(int((per_label * 1.25 + 50) * len(counts)))
