"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target share of the mixture over
its share of the corpus. A hash of (seed, document) gives each document a
uniform number; the Poisson distribution of the source's rate, inverted at that
number, is the document's count of copies. Copies are then put into one global
order by a second hash. The same seed gives the same mixture on any cluster.

Defined cases: a null source is a source of its own; a row without a document
id hashes as "null" and the MD5 of its text, so that such rows differ; repeated
rows get the same count; a null text has no characters; a source without characters or
without a weight gets rate 0; an empty table gives an empty table; columns
named copy or mix_key are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources up to this number are broadcast; beyond it the join is salted.
BROADCAST_SOURCES = 10_000
SALTS = 32
#: Means up to this have a probability of 0 that a double holds.
FROM_ZERO = 600.0
#: Digits of mix_key that choose the partition.
DIGITS = 8


def uniform(*parts: Column) -> Column:
    """In [0, 1): the first 52 bits of the MD5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def sizes(docs: DataFrame) -> DataFrame:
    """Characters of each source, over all documents."""
    return docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size"))


def tempered(table: DataFrame, temperature: float = 0.5) -> DataFrame:
    """Target weights in proportion to size ** temperature."""
    return table.select("source", F.pow(F.col("size").cast("double"), F.lit(temperature)).alias("weight"))


def rates(table: DataFrame, weights: DataFrame, budget: float = 1.0) -> DataFrame:
    """source, rate: so that the mixture has budget times the corpus's
    characters, shared out by weight (unknown sources: none)."""
    both = table.alias("t").join(weights.alias("w"), F.col("t.source").eqNullSafe(F.col("w.source")), "left").select(
        F.col("t.source").alias("source"), "size", F.coalesce("weight", F.lit(0.0)).alias("weight")
    )
    total = both.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.lit(budget) * F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")
    return both.join(F.broadcast(total)).select(
        "source", F.when((F.col("size") > 0) & (F.col("all_weight") > 0), rate).otherwise(F.lit(0.0)).alias("rate")
    )


def _log_factorial(n: Column) -> Column:
    """ln(n!) of large n by Stirling's series; its error is below 1e-16 from 100 on."""
    x = n.cast("double") + 1
    return (x - 0.5) * F.ln(x) - x + 0.5 * F.lit(math.log(2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x * x * x)


def poisson(rate: Column, u: Column) -> Column:
    """Least k with u < P(count <= k). Counts are added up from 0; for a mean
    above FROM_ZERO from 12 standard deviations below it, under which no double
    holds anything of the sum."""
    reach = F.lit(12) * F.sqrt(rate) + 12
    least = F.when(rate > FROM_ZERO, F.floor(rate - reach)).otherwise(F.lit(0)).cast("int")
    p = F.exp(F.when(least > 0, least * F.ln(rate) - rate - _log_factorial(least)).otherwise(-rate))
    start = F.struct(least.alias("k"), p.alias("p"), p.alias("cdf"))

    def step(state: Column, i: Column) -> Column:
        p = state.p * rate / i.cast("double")
        more = u >= state.cdf
        return F.struct(
            F.when(more, i).otherwise(state.k).alias("k"),
            F.when(more, p).otherwise(state.p).alias("p"),
            F.when(more, state.cdf + p).otherwise(state.cdf).alias("cdf"),
        )

    return F.aggregate(F.sequence(least + 1, F.ceil(rate + reach).cast("int")), start, step, lambda state: state.k)


def _with_rates(docs: DataFrame, table: DataFrame) -> DataFrame:
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    right = table.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    same = F.col("source").eqNullSafe(F.col("__source"))
    if few:
        return docs.join(F.broadcast(right), same).drop("__source")
    left = docs.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)))
    right = right.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, same & (F.col("__salt") == F.col("__copy"))).drop("__source", "__salt", "__copy")


def mix(docs: DataFrame, table: DataFrame, seed: int = 42) -> DataFrame:
    """Every document as often as its Poisson count says, with copy (from 0) and
    mix_key; rows are in the order of (mix_key, copy) over the whole mixture.
    table: source and rate."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    names = [c for c in docs.columns if c not in ("copy", "mix_key")]
    rated = _with_rates(docs.select(*names), table)
    counted = rated.withColumn("__n", poisson(F.col("__rate"), uniform(F.lit(str(seed)), key))).filter("__n > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), key, F.col("copy")).cast("binary")))
    # the keys are uniform, so their first digits say which partition they are in
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("mix_key", 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS) * parts).cast("int")
    dealt = keyed.select(*names, "copy", "mix_key").repartitionById(parts, place)
    return dealt.sortWithinPartitions("mix_key", "copy")
