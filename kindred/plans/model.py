"""Building a model: attributes, priors, encoded tables and the initial state."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.distances import Distance
from kindred.functions.distributions import Beta, Dirichlet, DirichletProcess
from kindred.functions.partitions import GeneralizedCoupon, PitmanYor
from kindred.functions.uniforms import uniform
from kindred.operators import encoding, similarity


@dataclass(frozen=True)
class Attribute:
    """distance None: any value may be distorted to any other. blocking: for a distance without an
    edit threshold, an array of keys of which close values share one. distort_prob: a Beta prior
    or a fixed probability. entity_dist: None (the smoothed empirical distribution), a
    Dirichlet prior, or fixed probabilities by value."""

    distance: Distance | None = None
    distort_prob: Beta | float = field(default_factory=lambda: Beta(1, 1))
    distort_dist: DirichletProcess = field(default_factory=DirichletProcess)
    exclude_entity_value: bool = True
    entity_dist: Dirichlet | dict[str, float] | None = None
    blocking: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if self.distance is not None and not callable(self.distance):
            raise ValueError("a distance is a function of two columns")
        if self.blocking is not None and not callable(self.blocking):
            raise ValueError("blocking is a function of a column")
        if not isinstance(self.distort_dist, DirichletProcess):
            raise ValueError("distort_dist must be a DirichletProcess")
        if not isinstance(self.entity_dist, (Dirichlet, dict, type(None))):
            raise ValueError("entity_dist must be a Dirichlet prior, probabilities by value, or None")
        if isinstance(self.entity_dist, dict) and any(not 0 <= p <= 1 for p in self.entity_dist.values()):
            raise ValueError("probabilities must be in [0, 1]")
        if not isinstance(self.distort_prob, Beta) and not 0 <= self.distort_prob <= 1:
            raise ValueError("a fixed distortion probability must be in [0, 1]")
        if isinstance(self.entity_dist, dict) and not math.isclose(sum(self.entity_dist.values()), 1, rel_tol=1e-8):
            raise ValueError("probabilities must sum to 1")
        finite = self.distort_dist.alpha if isinstance(self.distort_dist.alpha, float) else 0.0
        if not math.isinf(finite) and not self.exclude_entity_value:
            raise ValueError("a finite concentration needs exclude_entity_value")

    @property
    def constant(self) -> bool:
        return self.distance is None

    def given(self) -> list[str] | None:
        if isinstance(self.entity_dist, dict):
            return list(self.entity_dist)
        if isinstance(self.entity_dist, Dirichlet) and isinstance(self.entity_dist.alpha, dict):
            return list(self.entity_dist.alpha)
        return None


def CategoricalAttribute(**options) -> Attribute:  # noqa: N802
    return Attribute(distance=None, **options)


@dataclass
class Model:
    """Tables: records (rid, rec_id, file), record_values (rid, fid, aid, vid), domain, close, phi,
    attribute_table, theta, links, entities, distortions. Everything is a plan until a
    chain runs."""

    attributes: dict[str, Attribute]
    prior: PitmanYor | GeneralizedCoupon
    initial_prior: PitmanYor | GeneralizedCoupon
    records: DataFrame
    record_values: DataFrame
    domain: DataFrame
    close: DataFrame
    phi: DataFrame
    attribute_table: DataFrame
    theta: DataFrame
    links: DataFrame
    entities: DataFrame
    distortions: DataFrame

    def __repr__(self) -> str:
        return f"Model({', '.join(self.attributes)}; {self.prior})"


def build_index(dictionary: DataFrame, attributes: dict[str, Attribute]) -> tuple[DataFrame, DataFrame]:
    """The dictionary with its distances' ranges, and the close pairs of all attributes."""
    spark = dictionary.sparkSession
    pairs = spark.createDataFrame([], "aid int, e_vid int, r_vid int, dist double")
    for aid, a in enumerate(attributes.values()):
        if not a.constant:
            pairs = pairs.unionByName(similarity.close_pairs(dictionary.filter(F.col("aid") == aid), a.distance, a.exclude_entity_value, a.blocking))
    close = similarity.distortion_probs(pairs)
    return dictionary.join(similarity.distance_ranges(dictionary, pairs), ["aid", "vid"]), close


def build_model(df: DataFrame, attributes: dict[str, Attribute], prior: PitmanYor | GeneralizedCoupon, rec_id: str, file_id: str | None = None, seed: int = 1, validate: bool = True) -> Model:
    spark = df.sparkSession
    if not attributes or not all(isinstance(a, Attribute) for a in attributes.values()):
        raise ValueError("attributes must be a mapping from columns to Attribute")
    if not isinstance(prior, (PitmanYor, GeneralizedCoupon)):
        raise ValueError("the prior must be PitmanYor or GeneralizedCoupon")
    if len({*attributes, rec_id, *([file_id] if file_id else [])}) < len(attributes) + 1 + bool(file_id):
        raise ValueError("a column can have one part only: attribute, record id or file id")
    attributes = dict(sorted(attributes.items(), key=lambda kv: not kv[1].constant))
    long = encoding.unpivot(df, list(attributes), rec_id, file_id)
    given = [(k, v) for k, a in enumerate(attributes.values()) for v in a.given() or ()]
    given_df = spark.createDataFrame(given, "aid int, value string") if given else None
    dictionary = encoding.domain(long, given_df)
    if validate:
        limited = {k for k, _ in given}
        told = long.filter(F.col("aid").isin(sorted(limited))) if limited else None
        encoding.check(df, long, dictionary, rec_id, len(attributes))
        if told is not None and not encoding.outside_domain(told, given_df).isEmpty():
            raise ValueError("records have values outside the given domain")
    files = encoding.file_ids(long)
    ids = long.select("rec_id", "file").distinct()
    # ids from counts of ranges, so that no task numbers all records
    records = _numbered(ids)
    values = encoding.encode(long, dictionary).join(records.select("rec_id", "rid"), "rec_id").join(F.broadcast(files), "file").select("rid", "fid", "aid", "vid")
    domain, close = build_index(dictionary, attributes)
    n = df.count()
    fixed = [(k, v, float(p)) for k, a in enumerate(attributes.values()) if isinstance(a.entity_dist, dict) for v, p in a.entity_dist.items()]
    phi = domain.select("aid", "vid", "value", "emp_prob")
    if fixed:
        phi = phi.join(F.broadcast(spark.createDataFrame(fixed, "aid int, value string, fixed double")), ["aid", "value"], "left")
        phi = phi.select("aid", "vid", "emp_prob", F.coalesce("fixed", "emp_prob").alias("phi"))
    else:
        phi = phi.select("aid", "vid", "emp_prob", F.col("emp_prob").alias("phi"))
    rows = [(k, a.constant, a.exclude_entity_value, None if math.isinf(a.distort_dist.initial()) else float(a.distort_dist.initial())) for k, a in enumerate(attributes.values())]
    table = spark.createDataFrame(rows, "aid int, constant boolean, exclude boolean, b double")
    start = [(k, float(a.distort_prob.mean() if isinstance(a.distort_prob, Beta) else a.distort_prob)) for k, a in enumerate(attributes.values())]
    theta = files.select("fid").join(spark.createDataFrame(start, "aid int, theta double"))
    links = records.select("rid", F.col("rid").alias("eid"))
    entities = impute(values.select(F.col("rid").alias("eid"), "aid", "vid"), domain, seed)
    distortions = values.select("rid", "aid", F.lit(False).alias("z"))
    return Model(attributes, prior, prior.initial(n), records, values, domain, close, phi, table, theta, links, entities, distortions)


def _numbered(ids: DataFrame) -> DataFrame:
    """rid, rec_id, file: 0, 1, 2, ... in the order of hashes, in two levels."""
    dealt = ids.withColumn("_b", F.pmod(F.xxhash64("rec_id"), F.lit(256)))
    before = dealt.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("rec_id"))
    return dealt.withColumn("_r", rank).join(F.broadcast(before), "_b").select((F.col("_n") + F.col("_r") - 1).alias("rid"), F.col("rec_id").cast("string").alias("rec_id"), "file")


def impute(values: DataFrame, domain: DataFrame, seed: int) -> DataFrame:
    """eid, aid, vid: missing values are drawn from the smoothed empirical distribution, by
    the inverse of its cumulated sum at a uniform that the key decides. Sums and uniforms meet in
    1024 equal ranges of [0, 1), so a hole meets the few values of its own range only."""
    up_to = domain.select("aid", F.col("vid").alias("drawn"), F.sum("emp_prob").over(Window.partitionBy("aid").orderBy("vid")).alias("upto"), F.max("vid").over(Window.partitionBy("aid")).alias("last"))
    up_to = up_to.withColumn("low", F.coalesce(F.lag("upto").over(Window.partitionBy("aid").orderBy("drawn")), F.lit(0.0)))
    bucket = lambda c: F.least(F.floor(c * 1024), F.lit(1023)).cast("int")
    end = F.when(F.col("drawn") == F.col("last"), F.lit(1023)).otherwise(bucket(F.col("upto")))
    up_to = up_to.withColumn("bucket", F.explode(F.sequence(bucket(F.col("low")), F.greatest(end, bucket(F.col("low"))))))
    holes = values.filter("vid is null").withColumn("u", uniform(F.lit(seed), F.lit("impute"), F.col("eid"), F.col("aid"))).withColumn("bucket", bucket(F.col("u")))
    hit = (F.col("u") >= F.col("low")) & ((F.col("u") < F.col("upto")) | (F.col("drawn") == F.col("last")))
    filled = holes.join(up_to, ["aid", "bucket"]).filter(hit).select("eid", "aid", F.col("drawn").alias("vid"))
    return values.filter("vid is not null").unionByName(filled)
