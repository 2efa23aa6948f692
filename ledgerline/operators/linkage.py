"""Links between records: current places first, agreement with three values, and blocks with one partner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.joins import first_wins


def live(checks: DataFrame, placed: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], recorded: str) -> DataFrame:
    """checks with `value`: that of the first placed row of the same keys that has one, else the recorded one."""
    known = first_wins(placed.filter(F.col(value).isNotNull()), keys, [F.col(c) for c in order]).select(*keys, F.col(value).alias("_live"))
    return checks.join(known, list(keys), "left").withColumn(value, F.coalesce("_live", recorded)).drop("_live")


def agreement(ours: Column, theirs: Column) -> Column:
    """Whether two numbers written as text are the same; null unless both are digits alone."""
    both = ours.rlike("^[0-9]+$") & theirs.rlike("^[0-9]+$")
    return F.when(both, ours.cast("bigint") == theirs.cast("bigint"))


def enriched(df: DataFrame, links: DataFrame, key: str, payload: Sequence[str], name: str = "link") -> DataFrame:
    """df with a struct of the payload of its link; null without one. links hold a key once."""
    found = links.select(F.col(key).alias("_key"), F.struct(*payload).alias(name))
    return df.join(found, df[key] == F.col("_key"), "left").drop("_key")


def linked(people: DataFrame, records: DataFrame, block: Sequence[str], trait: str, record_id: str) -> DataFrame:
    """people with `record_id` and `how`: the only record of their block and trait, else the only one of their block.

    Records are counted by block and by trait before they meet people, so no pairs arise, however large a block is. Where
    several records fit, or the block's only record has another trait than the person's, there is no link; a record without
    a trait contradicts nobody.
    """
    id_, blocks = F.col(record_id), [F.col(c) for c in block]
    alike = records.filter(F.col(trait).isNotNull()).groupBy(*blocks, trait).agg(F.count("*").alias("_n"), F.min(id_).alias("_same"))
    alone = records.groupBy(*blocks).agg(F.count("*").alias("_m"), F.min(id_).alias("_only"), F.count(trait).alias("_told"))
    met = people.join(alike.filter("_n = 1").drop("_n"), [*block, trait], "left").join(alone.filter("_m = 1"), list(block), "left")
    weak = F.col("_only").isNotNull() & (F.col(trait).isNull() | (F.col("_told") == 0))
    how = F.when(F.col("_same").isNotNull(), "trait").when(weak, "block")
    return met.select(*people.columns, F.coalesce("_same", F.when(weak, F.col("_only"))).alias(record_id), how.alias("how"))
