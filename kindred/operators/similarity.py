"""The attribute index: which record values an entity value may be distorted to.

``close_pairs`` joins a dictionary with itself on a distance. For edit distances
candidates come from segments: of two strings within t edits, one has t + 1 disjoint
segments of which the other holds one unchanged, shifted by t at most. That is an
equi-join on (attribute, length, segment, text); each candidate is then verified. Within one
edit it is simpler: two such strings are equal but for the character at one place, or one is the
other less a character. Values are grouped by what is left, so a pair is made once and no
row is made for a place in a prefix that all values share. Other
distances take a ``blocking`` function, which gives an array of keys of which close
values share one; without one, the values of an attribute are compared by theta-join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.distances import Distance


def _segments(value: str, t: int) -> Column:
    """The t + 1 segments of a string, as (length, number, text)."""
    return F.expr(f"transform(sequence(0, {t}), i -> struct(length({value}) as n, i as i, substring({value}, cast(floor(i * length({value}) / {t + 1}) as int) + 1, cast(floor((i + 1) * length({value}) / {t + 1}) as int) - cast(floor(i * length({value}) / {t + 1}) as int)) as s))")


def _probes(value: str, t: int) -> Column:
    """The texts that a string holds where a string of length n within t edits may have
    segment i."""
    start = f"cast(floor(i * n / {t + 1}) as int)"
    width = f"(cast(floor((i + 1) * n / {t + 1}) as int) - {start})"
    texts = f"transform(filter(sequence({start} - {t}, {start} + {t}), p -> p >= 0 and p + {width} <= length({value})), p -> struct(n, i, substring({value}, p + 1, {width}) as s))"
    return F.expr(f"array_distinct(flatten(flatten(transform(sequence(greatest(0, length({value}) - {t}), length({value}) + {t}), n -> transform(sequence(0, {t}), i -> {texts})))))")


def _within_one(d: DataFrame) -> DataFrame:
    """aid, e_vid, r_vid, y, x of the pairs of different values that one edit apart makes, each
    once. Keys are (place, rest) for a changed character, and (0, text) for one left out: there
    the shorter value brings itself and meets the longer ones, which don't meet each other."""
    bounds = d.groupBy("aid").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.collect_set(F.length("value")).alias("lengths"))
    # the least and the greatest value share what all share; a character within it can stay
    common = F.expr("coalesce(array_min(filter(sequence(1, greatest(1, length(lo))), i -> substring(lo, i, 1) <> substring(hi, i, 1))) - 1, length(lo))")
    d = d.join(F.broadcast(bounds.select("aid", common.alias("common"), "lengths")), "aid")
    places = "filter(sequence(common + 1, greatest(common + 1, length(value))), i -> i <= length(value))"
    rest = "concat(substring(value, 1, i - 1), substring(value, i + 1))"
    changed = F.expr(f"transform({places}, i -> struct(i as place, {rest} as rest, false as less))")
    less = F.expr(f"if(array_contains(lengths, length(value) - 1), transform(array_distinct(transform({places}, i -> {rest})), t -> struct(0 as place, t as rest, true as less)), array())")
    itself = F.expr("if(array_contains(lengths, length(value) + 1), array(struct(0 as place, value as rest, false as less)), array())")
    keyed = d.select("aid", "vid", "value", F.explode(F.concat(changed, less, itself)).alias("key")).select("aid", "key.place", "key.rest", F.struct("vid", "value", "key.less").alias("own"))
    groups = keyed.groupBy("aid", "place", "rest").agg(F.collect_list("own").alias("own")).filter("size(own) > 1")
    # at place 0 only the shorter value, of which there is one at most, has partners
    e = groups.select("aid", "place", "own", F.explode(F.expr("if(place > 0, own, filter(own, o -> not o.less))")).alias("e"))
    either = e.select("aid", "place", "e", F.explode("own").alias("r")).filter("if(place > 0, e.vid <> r.vid, r.less)")
    turned = either.filter("place = 0").select("aid", "place", F.col("r").alias("e"), F.col("e").alias("r"))
    either = either.unionByName(turned)
    return either.select("aid", F.col("e.vid").alias("e_vid"), F.col("r.vid").alias("r_vid"), F.col("e.value").alias("y"), F.col("r.value").alias("x"))


def close_pairs(dictionary: DataFrame, distance: Distance, exclude: bool = True, blocking: Callable[[Column], Column] | None = None) -> DataFrame:
    """aid, e_vid, r_vid, dist of the pairs whose distance isn't null; ``exclude`` leaves
    out a value's distance to itself."""
    d = dictionary.select("aid", "vid", "value")
    t = getattr(distance, "edit_threshold", None)
    e, r = d.select("aid", F.col("vid").alias("e_vid"), F.col("value").alias("y")), d.select("aid", F.col("vid").alias("r_vid"), F.col("value").alias("x"))
    if t == 1:
        pairs = _within_one(d)
        if not exclude:
            pairs = pairs.unionByName(d.select("aid", F.col("vid").alias("e_vid"), F.col("vid").alias("r_vid"), F.col("value").alias("y"), F.col("value").alias("x")))
    elif t is not None or blocking is not None:
        own = e.select("*", F.explode(blocking(F.col("y")) if t is None else _segments("y", t)).alias("key"))
        probe = r.select("*", F.explode(blocking(F.col("x")) if t is None else _probes("x", t)).alias("key"))
        pairs = own.join(probe, ["aid", "key"]).select("aid", "e_vid", "r_vid", "y", "x").distinct()
    else:
        pairs = e.join(r, "aid")
    if exclude:
        pairs = pairs.filter("e_vid <> r_vid")
    return pairs.withColumn("dist", distance(F.col("y"), F.col("x"))).filter("dist is not null").select("aid", "e_vid", "r_vid", "dist")


def distortion_probs(pairs: DataFrame) -> DataFrame:
    """Adds p, exp(-dist) normalised over the record values of each entity value."""
    w = F.exp(-F.col("dist"))
    total = pairs.groupBy("aid", "e_vid").agg(F.sum(w).alias("total"))
    return pairs.join(total, ["aid", "e_vid"]).select("aid", "e_vid", "r_vid", "dist", (w / F.col("total")).alias("p"))


def distance_ranges(dictionary: DataFrame, pairs: DataFrame) -> DataFrame:
    """aid, vid, min_dist, max_dist (null if there is no neighbour) and max_exp_factor,
    exp(-min / (2 * largest distance of the attribute)), 0 without a neighbour, 1 where both
    distances are 0."""
    own = pairs.groupBy("aid", F.col("e_vid").alias("vid")).agg(F.min("dist").alias("min_dist"), F.max("dist").alias("max_dist"))
    widest = own.groupBy("aid").agg(F.max("max_dist").alias("widest"))
    factor = F.when(F.col("min_dist").isNull(), 0.0).when(F.col("widest") == 0, 1.0).otherwise(F.exp(F.lit(-0.5) * F.col("min_dist") / F.col("widest")))
    return dictionary.select("aid", "vid").join(own, ["aid", "vid"], "left").join(F.broadcast(widest), "aid", "left").select("aid", "vid", "min_dist", "max_dist", factor.alias("max_exp_factor"))


def expected_distortion(pairs: DataFrame, phi: DataFrame) -> DataFrame:
    """aid, r_vid, expected, largest: of p(r | e) over entity values distributed as phi."""
    joined = pairs.join(phi.select("aid", F.col("vid").alias("e_vid"), "phi"), ["aid", "e_vid"])
    return joined.groupBy("aid", "r_vid").agg(F.sum(F.col("phi") * F.col("p")).alias("expected"), F.max("p").alias("largest"))


# -- attributes without a distance: closed forms, never a table of all pairs ------------
def constant_prob(emp_r: Column, emp_e: Column, same: Column, exclude: bool = True) -> Column:
    """p(r | e) if any value may be distorted to any other."""
    return F.when(same, 0.0).otherwise(emp_r / (1 - emp_e)) if exclude else emp_r


def constant_norm(phi: DataFrame) -> DataFrame:
    """aid, norm, max_prob: the sum of phi / (1 - emp), and the largest 1 / (1 - emp)."""
    return phi.groupBy("aid").agg(F.sum(F.col("phi") / (1 - F.col("emp_prob"))).alias("norm"), (1 / (1 - F.max("emp_prob"))).alias("max_prob"))


def constant_expected(phi: DataFrame, exclude: bool = True) -> DataFrame:
    """aid, vid, expected: the expectation of p(vid | e) over entity values."""
    if not exclude:
        return phi.select("aid", "vid", F.col("emp_prob").alias("expected"))
    e = F.col("emp_prob")
    return phi.join(F.broadcast(constant_norm(phi)), "aid").select("aid", "vid", (F.col("norm") * e - F.col("phi") * e / (1 - e)).alias("expected"))
