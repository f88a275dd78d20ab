"""Records to integers: dictionaries, long record values, files and checks.

All of it is one plan of aggregations and equi-joins; no collected domains.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unpivot(df: DataFrame, attributes: Sequence[str], rec_id: str, file_id: str | None = None) -> DataFrame:
    """rec_id, file, aid, value: a row for each record and attribute; missing stays null.
    Values that are not text are cast, so doubles are refused: format them first."""
    absent = [a for a in [*attributes, rec_id, *([file_id] if file_id else [])] if a not in df.columns]
    if absent:
        raise ValueError(f"no such columns: {absent}")
    floating = [c for c, t in df.dtypes if c in attributes and t in ("float", "double")]
    if floating:
        raise ValueError(f"format these as text first: {floating}")
    pairs = F.array(*[F.struct(F.lit(k).alias("aid"), F.col(a).cast("string").alias("value")) for k, a in enumerate(attributes)])
    file = F.col(file_id).cast("string") if file_id else F.lit("0")
    return df.select(F.col(rec_id).alias("rec_id"), file.alias("file"), F.explode(pairs).alias("p")).select("rec_id", "file", "p.*")


def domain(values: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """aid, vid, value, cnt, emp_prob: the dictionary with its smoothed empirical
    distribution, (count + 1) / sum(count + 1) over the domain. ``given``: (aid, value)
    adds values that no record has. Ids follow the order of the values."""
    counted = values.filter("value is not null").groupBy("aid", "value").agg(F.count("*").alias("cnt"))
    if given is not None:
        counted = counted.unionByName(given.select("aid", "value", F.lit(0).cast("bigint").alias("cnt"))).groupBy("aid", "value").agg(F.sum("cnt").alias("cnt"))
    total = counted.groupBy("aid").agg(F.sum(F.col("cnt") + 1).alias("total"))
    vid = F.dense_rank().over(Window.partitionBy("aid").orderBy("value")) - 1
    return counted.join(F.broadcast(total), "aid").select("aid", vid.alias("vid"), "value", "cnt", ((F.col("cnt") + 1) / F.col("total")).alias("emp_prob"))


def encode(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rec_id, file, aid, vid: null for a missing value."""
    return values.join(dictionary.select("aid", "value", "vid"), ["aid", "value"], "left").select("rec_id", "file", "aid", "vid")


def file_ids(values: DataFrame) -> DataFrame:
    """file, fid: files in the order of their labels, from 0."""
    return values.select("file").distinct().withColumn("fid", F.dense_rank().over(Window.orderBy("file")) - 1)


def missing_counts(values: DataFrame) -> DataFrame:
    return values.groupBy("aid").agg(F.count_if(F.col("value").isNull()).alias("n_missing"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("rec_id")).count().filter((F.col("count") > 1) | F.col("rec_id").isNull())


def outside_domain(values: DataFrame, given: DataFrame) -> DataFrame:
    """aid, value: values that records have and a given domain lacks."""
    return values.filter("value is not null").select("aid", "value").distinct().join(given, ["aid", "value"], "left_anti")


def small_domains(dictionary: DataFrame, attributes: int) -> DataFrame:
    """aid, n of attributes with fewer than two values, those with none included."""
    spark = dictionary.sparkSession
    return spark.range(attributes).select(F.col("id").cast("int").alias("aid")).join(dictionary.groupBy("aid").agg(F.count("*").alias("n")), "aid", "left").na.fill(0, ["n"]).filter("n < 2")


def check(df: DataFrame, values: DataFrame, dictionary: DataFrame, key: str, attributes: int, given: DataFrame | None = None) -> None:
    """Raises for keys that repeat, values outside a given domain, and trivial domains."""
    if not duplicate_keys(df, key).isEmpty():
        raise ValueError("record ids must be unique and not null")
    if given is not None and not outside_domain(values, given).isEmpty():
        raise ValueError("records have values outside the given domain")
    if not small_domains(dictionary, attributes).isEmpty():
        raise ValueError("every attribute needs two values at least")
