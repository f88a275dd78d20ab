"""Posterior summaries of long samples (sample, rid, eid), and evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reject_nulls(samples: DataFrame) -> DataFrame:
    """``samples``; whatever reads it fails if a label is missing."""
    kinds = dict(samples.dtypes)
    wrong = F.raise_error(F.lit("samples must have no missing labels"))
    return samples.withColumns({c: F.coalesce(c, wrong.cast(kinds[c])) for c in ("sample", "rid", "eid") if c in kinds})


def clusters(samples: DataFrame) -> DataFrame:
    """sample, eid, members: an array in order, as big as a cluster is."""
    return reject_nulls(samples).groupBy("sample", "eid").agg(F.array_sort(F.collect_list("rid")).alias("members"))


def cluster_frequencies(samples: DataFrame) -> DataFrame:
    """digest, members, freq: in how many samples a set of records is a cluster. The digest
    (md5 of the members joined by commas) stands for the set where arrays needn't travel."""
    digest = F.md5(F.array_join("members", ",").cast("binary"))
    return clusters(samples).groupBy(digest.alias("digest")).agg(F.any_value("members").alias("members"), F.count("*").alias("freq"))


def most_probable_clusters(samples: DataFrame) -> DataFrame:
    """rid, cluster, prob: the set that holds the record in most samples, and its share. Ties
    go to the larger set, then to the greater digest."""
    return _best(samples, cluster_frequencies(samples), True)


def _best(samples: DataFrame, frequencies: DataFrame, arrays: bool) -> DataFrame:
    n = samples.agg(F.count_distinct("sample").alias("n_samples"))
    # each member carries the digest only; an array joins once the best is known
    spread = frequencies.select(F.explode("members").alias("rid"), "digest", "freq", F.size("members").alias("size"))
    best = spread.groupBy("rid").agg(F.max(F.struct("freq", "size", "digest")).alias("best"))
    best = best.join(F.broadcast(n)).select("rid", F.col("best.digest").alias("digest"), (F.col("best.freq") / F.col("n_samples")).alias("prob"))
    if not arrays:
        return best
    return best.join(frequencies.select("digest", F.col("members").alias("cluster")), "digest").select("rid", "cluster", "prob", "digest")


def most_probable_digests(samples: DataFrame) -> DataFrame:
    """rid, digest, prob: the same without the arrays."""
    return _best(samples, cluster_frequencies(samples), False)


def shared_most_probable_clusters(most_probable: DataFrame) -> DataFrame:
    """cluster_id (the smallest member) and members: records that have the same most
    probable cluster, known by its digest. Always a partition."""
    groups = most_probable.groupBy("digest").agg(F.array_sort(F.collect_list("rid")).alias("members"))
    return groups.select(F.element_at("members", 1).alias("cluster_id"), "members")


def membership_to_clusters(membership: DataFrame) -> DataFrame:
    """eid, members of (rid, eid); records without a label are left out."""
    return membership.filter("eid is not null").groupBy("eid").agg(F.array_sort(F.collect_list("rid")).alias("members"))


def clusters_to_membership(groups: DataFrame) -> DataFrame:
    return groups.select(F.explode("members").alias("rid"), "cluster_id")


def membership_to_pairs(membership: DataFrame) -> DataFrame:
    """a, b with a < b: the pairs of records under one label."""
    m = membership.filter("eid is not null")
    return m.select(F.col("rid").alias("a"), "eid").join(m.select(F.col("rid").alias("b"), "eid"), "eid").filter("a < b").select("a", "b")


def clusters_to_pairs(groups: DataFrame) -> DataFrame:
    return membership_to_pairs(clusters_to_membership(groups).withColumnRenamed("cluster_id", "eid"))


#: Samples that one row of a record's labels holds at most.
BLOCK = 256


def coreference_probs(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, prob for the pairs asked for; raises if one names an unknown record.

    A record's labels travel as rows of up to BLOCK samples, so a pair meets a few rows and not
    each sample. Joins are by merging: what looks small enough to be broadcast may
    not fit the driver."""
    samples = reject_nulls(samples)
    known = samples.select("rid").distinct()
    asked = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    if not asked.join(known.hint("merge"), "rid", "left_anti").isEmpty():
        raise ValueError("pairs name unknown records")
    block = F.floor(F.col("sample") / BLOCK).alias("block")
    held = samples.groupBy("rid", block).agg(F.array_sort(F.collect_list(F.struct("sample", "eid"))).alias("held"))
    held = held.select("rid", "block", F.col("held.sample").alias("at"), F.col("held.eid").alias("eid"))
    a = held.select(F.col("rid").alias("a"), "block", F.col("at").alias("at_a"), F.col("eid").alias("ea"))
    b = held.select(F.col("rid").alias("b"), "block", F.col("at").alias("at_b"), F.col("eid").alias("eb"))
    met = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), ["b", "block"])
    # mostly both records have the same samples; else each is looked for among the other's
    same = F.transform(F.arrays_zip("ea", "eb"), lambda x: x["ea"] == x["eb"])
    looked = F.flatten(F.transform(F.arrays_zip("at_a", "ea"), lambda x: F.transform(F.filter(F.arrays_zip("at_b", "eb"), lambda y: y["at_b"] == x["at_a"]), lambda y: y["eb"] == x["ea"])))
    met = met.select("a", "b", F.when(F.col("at_a") == F.col("at_b"), same).otherwise(looked).alias("same"))
    counted = met.groupBy("a", "b").agg(F.sum(F.size("same")).alias("n"), F.sum(F.size(F.filter("same", lambda x: x))).alias("together"))
    return counted.filter("n > 0").select("a", "b", (F.col("together") / F.col("n")).alias("prob"))


def pair_probs(samples: DataFrame) -> DataFrame:
    """a, b, prob of all pairs that are together in some sample. Pairs are made once for each
    different cluster, not for each sample that has it."""
    n = samples.agg(F.count_distinct("sample").alias("n_samples"))
    spread = cluster_frequencies(samples).filter(F.size("members") > 1).select("digest", "freq", F.explode("members").alias("a"))
    both = spread.join(spread.select("digest", F.col("a").alias("b")), "digest").filter("a < b").groupBy("a", "b").agg(F.sum("freq").alias("freq"))
    return both.join(F.broadcast(n)).select("a", "b", (F.col("freq") / F.col("n_samples")).alias("prob"))


def linked_entities(samples: DataFrame) -> DataFrame:
    return samples.groupBy("sample").agg(F.count_distinct("eid").alias("n_linked"))


def cluster_sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("eid").agg(F.count("*").alias("size"))


def evaluate_pairs(predicted: DataFrame, truth: DataFrame, n_records: int) -> DataFrame:
    """One row: tp, fp, fn, tn and the pairwise measures."""
    p, t = predicted.select("a", "b", F.lit(1).alias("p")), truth.select("a", "b", F.lit(1).alias("t"))
    both = p.join(t, ["a", "b"], "full_outer")
    c = both.agg(F.count_if(F.expr("p = 1 and t = 1")).alias("tp"), F.count_if(F.expr("p = 1 and t is null")).alias("fp"), F.count_if(F.expr("p is null and t = 1")).alias("fn"))
    return measures(c.withColumn("tn", F.lit(n_records * (n_records - 1) // 2) - F.col("tp") - F.col("fp") - F.col("fn")))


def measures(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return counts.select("tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), specificity.alias("specificity"), recall.alias("sensitivity"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1score"), F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((recall + specificity) / 2).alias("balanced_accuracy"))


def effective_sample_size(series: DataFrame) -> DataFrame:
    """name, n, ess of (name, i, value): batch means with floor(sqrt(n)) values a batch; a
    constant series counts as n independent values."""
    n = series.groupBy("name").agg(F.count("*").alias("n"), F.var_samp("value").alias("v"), F.avg("value").alias("m")).withColumn("size", F.floor(F.sqrt("n")))
    dealt = series.join(F.broadcast(n), "name").withColumn("batch", F.floor(F.col("i") / F.col("size"))).filter("batch < floor(n / size)")
    means = dealt.groupBy("name", "batch").agg(F.avg("value").alias("mean"))
    spread = means.groupBy("name").agg(F.var_samp("mean").alias("between"))
    ess = F.when((F.col("v") == 0) | (F.col("between") == 0), F.col("n").cast("double")).otherwise(F.col("n") * F.col("v") / (F.col("size") * F.col("between")))
    return n.join(spread, "name").select("name", "n", ess.alias("ess"))


def multivariate_effective_sample_size(series: DataFrame) -> DataFrame:
    """name, n, dims, ess of (name, dim, i, value): n * (det sample covariance / det batch-means
    covariance)^(1 / dims), with floor(sqrt(n)) values a batch (Vats, Flegal and Jones, 2019). Constant
    dimensions are left out; if none is left the samples count as independent. A name's series, as
    long as its chain, is read by one task; ess is null with fewer batches than dimensions need."""

    def estimate(group: pd.DataFrame) -> pd.DataFrame:
        wide = group.pivot(index="i", columns="dim", values="value").sort_index().to_numpy(float)
        n = len(wide)
        wide = wide[:, wide.std(axis=0) > 0]
        dims, ess = wide.shape[1], float(n)
        if dims:
            size = int(np.sqrt(n))
            batches = n // size
            means = wide[: batches * size].reshape(batches, size, dims).mean(axis=1)
            if batches <= dims:
                ess = None
            else:
                sign, within = np.linalg.slogdet(np.atleast_2d(np.cov(wide, rowvar=False)))
                other, between = np.linalg.slogdet(size * np.atleast_2d(np.cov(means, rowvar=False)))
                ess = float(n * np.exp((within - between) / dims)) if sign > 0 and other > 0 else None
        return pd.DataFrame({"name": [group["name"].iloc[0]], "n": [n], "dims": [dims], "ess": [ess]})

    return series.select("name", "dim", "i", "value").groupBy("name").applyInPandas(estimate, "name string, n bigint, dims bigint, ess double")
