"""Weighted rendezvous hashing of stable record keys.

Each (key, shard) pair has a pseudo-random score that only the two decide; a row
goes to the shard with the best score. A further shard therefore takes rows only
into itself: for every other pair of shards the comparison stays as it was. With
weights w the score is -w / ln(u), which gives shard j the share w_j / sum(w).

Everything is a DataFrame expression. Slots are dealt in two levels: rows are
counted by (shard, bucket), the counts (shards x buckets of them, whatever the
input's size) are summed up to offsets, and the rank in a bucket is added. No task
ever sorts a whole shard.

Null keys hash like any other constant, so they share a shard. A null text counts
as empty. Repeated keys share a shard and get slots of their own. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of each key. Ties go to the smaller shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive and not empty")

    def scored(j: int, w: float) -> Column:
        # 52 random bits and a half: never 0 and never 1
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(j)), 12).cast("double") + 0.5) * 2.0**-52
        return F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(-j).alias("minus"))

    return (-F.array_max(F.array(*[scored(j, w) for j, w in enumerate(weights)]))["minus"]).cast("int")


def with_slots(df: DataFrame, shard: str, order: Sequence[str], buckets: int = 512) -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... without gaps in each shard. ``order`` names the
    columns that tell rows apart; equal rows are interchangeable."""
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(c) for c in order], F.lit("slot")), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # shards x buckets rows at most, so the broadcast is bounded whatever the input
    offsets = dealt.groupBy(shard, "_bucket").count().select(shard, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(shard, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(within))
    return ranked.join(F.broadcast(offsets), [shard, "_bucket"]).withColumn("slot", (F.col("_offset") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_offset", "_rank")


def shard_documents(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] | None = None, buckets: int = 512) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard if there
    were one more, of mean weight) of each row."""
    w = list(weights or [1.0] * shards)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.col("doc_id")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = rows.withColumn("shard", rendezvous(key, w)).withColumn("grown_shard", rendezvous(key, [*w, sum(w) / len(w)]))
    out = with_slots(placed, "shard", ["doc_id", "size", "text_crc32"], buckets)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
