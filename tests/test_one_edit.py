"""Values within one edit: each pair is made once, without joins."""

import random

from pyspark.sql import functions as F

from kindred.functions.distances import levenshtein
from kindred.operators import similarity as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_values_one_edit_apart_are_found_once(spark):
    r = random.Random(5)
    values = {"", "a", "aa", "aab", "ab", "äb", "b"} | {"".join(r.choice("abä") for _ in range(r.randint(0, 6))) for _ in range(150)}
    for prefix in ("", "aaxa"):
        words = [prefix + v for v in sorted(values)]
        d = spark.createDataFrame([(0, k, w) for k, w in enumerate(words)], "aid int, vid int, value string")
        plain = d.select(F.col("vid").alias("e"), F.col("value").alias("y")).crossJoin(d.select(F.col("vid").alias("r"), F.col("value").alias("x")))
        plain = sorted(tuple(x) for x in plain.withColumn("d", F.levenshtein("y", "x")).filter("d <= 1").select("e", "r", "d").collect())
        for exclude in (True, False):
            own = S.close_pairs(d, levenshtein(1), exclude)
            assert sorted((x.e_vid, x.r_vid, int(x.dist)) for x in own.collect()) == [x for x in plain if not exclude or x[2]]


def test_names_within_one_edit_need_no_joins(spark):
    from kindred.queries import _scaled_threshold

    out = _scaled_threshold(spark.createDataFrame([(f"Customer#{k:09d}",) for k in range(120)], "c_name string"))
    assert out.count() == 120 * 9 + 100 * 9 + 20 + 40
    assert "SortMergeJoin" not in _plan(out) and "Window" not in _plan(out)
