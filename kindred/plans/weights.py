"""The kernel's weights on a fixed state of any size: a chain's task for a part of the state.

A record's weight of a new entity needs its own entity and how many there are, an entity's values need its
records, and a link's weight the two it joins. So entities are dealt out with their records, and
links are weighed between classes of like records and entities (see ``kindred.operators.step``).
Only the dictionary goes through the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import step
from kindred.plans.chains import dictionary_arrays, stored
from kindred.plans.kernel import Chain

#: Records of a part, about.
PART = 5000
SCHEMAS = {"links": "rid bigint, eid bigint, logw double", "new": "rid bigint, logw double", "entities": "eid bigint, aid int, vid int, logw double"}


def _records(s: dict[str, DataFrame]) -> DataFrame:
    """rid, fid, eid and cells (aid, vid, z, held): a row for each record, with its entity's values."""
    cells = s["record_values"].join(s["distortions"].hint("merge"), ["rid", "aid"]).join(s["links"].hint("merge"), "rid")
    cells = cells.join(s["entities"].select("eid", "aid", F.col("vid").alias("held")).hint("merge"), ["eid", "aid"])
    return cells.groupBy("eid", "rid").agg(F.first("fid").alias("fid"), F.array_sort(F.collect_list(F.struct("aid", F.coalesce("vid", F.lit(-1)).alias("vid"), "z", "held"))).alias("cells")).select("eid", "rid", "fid", F.col("cells.vid").alias("x"), F.col("cells.z").alias("z"), F.col("cells.held").alias("held"))


def _matrix(column: pd.Series, kind) -> np.ndarray:
    return np.array(column.tolist(), kind).reshape(len(column), -1)


def _chain(sent, members: pd.DataFrame, outside: pd.DataFrame | None = None) -> Chain:
    """A chain of a part's records, in the order of their ids; after them those ``outside`` of all
    entities."""
    spec, theta, b, prior, entities = sent.value
    x, z, file = _matrix(members["x"], np.int64), _matrix(members["z"], bool), members["fid"].to_numpy(np.int64)
    held = {}
    for e, v in zip(members["eid"].tolist(), members["held"].tolist(), strict=True):
        if e not in held:
            held[e] = np.array(v, int)
    link = dict(enumerate(members["eid"].tolist()))
    if outside is not None:
        x, z, file = np.concatenate([x, _matrix(outside["x"], np.int64)]), np.concatenate([z, _matrix(outside["z"], bool)]), np.concatenate([file, outside["fid"].to_numpy(np.int64)])
    chain = Chain.at(replace(spec, x=x, file=file), link, held, z, theta, b, prior)
    chain.elsewhere = entities - len(held)
    return chain


def kernel_weights(s: dict[str, DataFrame], attributes: list, prior, what: str) -> DataFrame:
    """The weights of ``Chain.weighed`` on the fixed state ``s``, of all its records."""
    spark = s["links"].sparkSession
    spec = dictionary_arrays(s["domain"], s["phi"], s["close"], attributes, prior, prior)
    theta = s["theta"].toPandas().pivot(index="fid", columns="aid", values="theta").to_numpy(float)
    b = [math.inf if r.b is None else r.b for r in s["attributes"].orderBy("aid").collect()]
    n, entities = s["links"].agg(F.count("*"), F.count_distinct("eid")).first()
    sent = spark.sparkContext.broadcast((replace(spec, n_files=len(theta)), theta, b, prior, entities))
    parts = n // PART + 1
    records = _records(s)

    def dealt(which: str):
        def weigh(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("rid")
            ids, chain = part["rid"].to_numpy(), _chain(sent, part)
            r, k1, k2, logw = chain.weighed_columns(which)
            if which == "entities":
                return pd.DataFrame({"eid": r, "aid": k1.astype(np.int32), "vid": k2.astype(np.int32), "logw": logw})
            return pd.DataFrame({"rid": ids[r], "logw": logw} if which == "new" else {"rid": ids[r], "eid": k1, "logw": logw})

        part = F.pmod(F.xxhash64("eid"), F.lit(parts))
        return records.withColumn("part", part).repartition(min(parts, 2000), "part").groupBy("part").applyInPandas(weigh, SCHEMAS["links" if which == "own" else which])

    if what != "links":
        return dealt(what)

    seen = step.observed(s["record_values"], s["distortions"], s["attributes"])
    alike = stored(step.record_classes(s["record_values"], seen, s["links"]))
    groups = stored(step.entity_classes(s["entities"], step.link_state(seen, s["links"], s["entities"], s["domain"])))
    records = stored(records)
    own = dealt("own")
    outside = records.join(alike.select(F.col("rc").alias("rid")).hint("merge"), "rid", "left_semi")
    members = records.join(groups.select(F.col("ec").alias("eid")).hint("merge"), "eid", "left_semi")
    rows, columns = max(12, alike.count() // PART + 1), groups.count() // (4 * PART) + 1
    outside = outside.withColumn("row", F.pmod(F.xxhash64("rid"), F.lit(rows)).cast("int")).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    members = members.withColumn("column", F.pmod(F.xxhash64("eid"), F.lit(columns)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("rid"), right.sort_values("rid")
        found: Iterator = ()
        if len(left) and len(right):
            chain, ids = _chain(sent, right, left), left["rid"].tolist()
            found = [(r, e, w) for k, r in enumerate(ids, len(right)) for e in chain.candidates(k) if math.isfinite(w := chain.link_logweight(k, e))]
        return pd.DataFrame(found, columns=["rc", "ec", "logw"]).astype({"rc": "int64", "ec": "int64", "logw": "float64"})

    members = members.toDF(*members.columns)  # columns of its own: both come from the records
    weighed = outside.groupBy("row", "column").cogroup(members.groupBy("row", "column")).applyInPandas(pairs, "rc bigint, ec bigint, logw double")
    others = step.class_members(weighed, alike, groups).filter("eid <> current").select("rid", "eid", "logw")
    return others.unionByName(own)
