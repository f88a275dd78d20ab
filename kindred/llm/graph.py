"""Connected components of a table of edges, and a Bloom filter sized by its members."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from kindred.llm.common import discard, release, stored


#: So many links are joined in one task at once, in about 150 MB; more take rounds of joins.
FEW = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[up]
        return v

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    there = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(list(map(root, there)), pa.int64())], ["v", "component"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """v and component (the smallest vertex reachable) for the edges (a, b) of longs, as a
    stored table. Up to ``few`` edges are joined in one task.

    Else, in each round, each vertex's label becomes the smallest among its neighbours' labels;
    from the fourth on also its label's own label, so that chains shrink as powers of
    two. Minima are taken before the shuffle, so a vertex of very many edges costs no task
    more than others. Labels only fall, so an unchanged sum ends it."""
    once = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if once.count() <= few:
        out = stored(once.coalesce(1).mapInArrow(_joined, "v bigint, component bigint"))
        discard(once)
        return out
    both = stored(once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    discard(once)
    label = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "v"))
    before = None
    for turn in itertools.count():
        near = both.join(label.select(F.col("v").alias("b"), "c"), "b").select(F.col("a").alias("v"), "c")
        new = label.unionByName(near).groupBy("v").agg(F.min("c").alias("c"))
        if turn > 2:
            jump = label.select(F.col("v").alias("c"), F.col("c").alias("further"))
            new = new.join(jump, "c", "left").select("v", F.least("c", F.coalesce("further", "c")).alias("c"))
        old, label = label, stored(new)
        discard(old)
        now = label.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
        if now == before:
            out = stored(label.withColumnRenamed("c", "component"))
            discard(both, label)
            return out
        before = now
        if turn % 2:
            release(edges.sparkSession)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes mixed anew, as those that were picked for being small crowd together."""
    h = h.view(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Bloom:
    """Membership of 64-bit hashes, in 8 to 16 bits a member and ``LARGEST`` bits at most.

    A member's bits lie in one of 64 parts, so a part is made in one task from its members
    alone. ``of`` gives None for a table of more than ``LARGEST`` / 8 members: what can't be
    sent to every executor is left to the join that follows a filter."""

    LARGEST = 1 << 29  # 64 MiB
    PARTS = 6

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Bloom | None:
        members = df.select(F.col(column).cast("long").alias("h"))
        n = members.count()
        if 8 * n > cls.LARGEST:
            return None
        bits = max(16, (8 * n).bit_length())
        inner = bits - cls.PARTS

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = np.sort(mixed(batch.column(0).to_numpy()))
                part = h >> np.uint64(64 - cls.PARTS)
                at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(h) else []
                yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array([x.tobytes() for x in np.split(h, at[1:])][: len(at)], pa.binary())], ["part", "members"])

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            for batch in batches:
                for r, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held = parts.setdefault(r, np.zeros(1 << inner, bool))
                    for place in cls._places(np.frombuffer(own, np.uint64), inner):
                        held[place] = True
            for r, held in parts.items():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

        # 64 rows of 1 MiB at most come to the driver
        words = np.zeros(1 << (bits - 6), np.uint64)
        dealt = members.mapInArrow(deal, "part int, members binary").repartition(1 << cls.PARTS, "part")
        for r in dealt.mapInArrow(fill, "part int, bits binary").collect():
            words[r["part"] << (inner - 6) : (r["part"] + 1) << (inner - 6)] = np.frombuffer(bytes(r["bits"]), "<u8")
        return cls(words, bits)

    @staticmethod
    def _places(h: np.ndarray, inner: int) -> Iterator[np.ndarray]:
        """Three places in a part, off the bits below those that name it."""
        for k in range(3):
            yield (h * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)[k])) >> np.uint64(64 - inner)

    def may_have(self, h: np.ndarray) -> np.ndarray:
        h = mixed(h)
        inner = self.bits - self.PARTS
        base, passed = (h >> np.uint64(64 - self.PARTS)) << np.uint64(inner), np.ones(len(h), bool)
        for place in self._places(h, inner):
            p = base | place
            passed &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return passed


def may_have(bloom: Bloom | None, spark: SparkSession, h: Column) -> Column:
    """True where a column of hashes may be among the members."""
    if bloom is None:
        return F.lit(True)
    sent = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf(BooleanType())
    def has(h):
        import pandas as pd

        return pd.Series(sent.value.may_have(h.to_numpy(np.int64)))

    return has(h)
