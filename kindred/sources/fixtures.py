"""Record tables, chain states and samples over the provided tables, and a synthetic
look-alike of person records. Each has the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.distances import levenshtein
from kindred.plans.model import Attribute, CategoricalAttribute

#: Attribute, SQL of its value, edit threshold (None: no distance), concentration.
ATTRIBUTES = [
    ("p_type", "p_type", None, None),
    ("p_size", "CAST(p_size AS VARCHAR)", None, 5.0),
    ("p_brand", "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END", 2, None),
    ("p_name", "p_name", 3, 3.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, file, and the attributes of ``part``; a seventeenth has no brand."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("rec_id"), (F.col("p_partkey") % 2).alias("file"), "p_type", F.col("p_size").cast("string").alias("p_size"), F.when(F.col("p_partkey") % 17 != 0, F.col("p_brand")).alias("p_brand"), "p_name")


def part_attributes(exclude: bool = True) -> dict[str, Attribute]:
    return {name: CategoricalAttribute(exclude_entity_value=exclude) if t is None else Attribute(distance=levenshtein(t), exclude_entity_value=exclude) for name, _, t, _ in ATTRIBUTES}


def samples(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """sample, rid, eid: orders labelled by customer, a fifth of them by customer modulo 50."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), "o_custkey")
    s = o.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return s.select("sample", "rid", F.when((F.col("rid") + F.col("sample")) % 5 != 0, F.col("o_custkey")).otherwise(F.col("o_custkey") % 50).alias("eid"))


SAMPLES_SQL = "samp AS (SELECT s.sample, o_orderkey AS rid, CASE WHEN (o_orderkey + s.sample) % 5 <> 0 THEN o_custkey ELSE o_custkey % 50 END AS eid FROM orders, (SELECT unnest(range(10)) AS sample) s)"

#: Values, dictionary, record values, close pairs and distance ranges.
INDEX_SQL = (
    "vals AS ("
    + " UNION ALL ".join(f"SELECT p_partkey AS rid, p_partkey % 2 AS fid, {k} AS aid, {sql} AS value FROM part" for k, (_, sql, _, _) in enumerate(ATTRIBUTES))
    + "), cnts AS (SELECT aid, value, count(*) AS cnt FROM vals WHERE value IS NOT NULL GROUP BY aid, value)"
    ", dom AS (SELECT aid, value, cnt, dense_rank() OVER (PARTITION BY aid ORDER BY value) - 1 AS vid, (cnt + 1)::DOUBLE / (sum(cnt + 1) OVER (PARTITION BY aid))::DOUBLE AS emp FROM cnts)"
    ", rv AS (SELECT v.rid, v.fid, v.aid, d.vid FROM vals v LEFT JOIN dom d ON v.aid = d.aid AND v.value = d.value)"
    ", prs AS (SELECT e.aid, e.vid AS e_vid, r.vid AS r_vid, levenshtein(e.value, r.value)::DOUBLE AS dist FROM dom e JOIN dom r ON e.aid = r.aid AND e.vid <> r.vid WHERE "
    + " OR ".join(f"(e.aid = {k} AND levenshtein(e.value, r.value) <= {t})" for k, (_, _, t, _) in enumerate(ATTRIBUTES) if t is not None)
    + "), cl AS (SELECT *, exp(-dist) / sum(exp(-dist)) OVER (PARTITION BY aid, e_vid) AS p FROM prs)"
    ", rng AS (SELECT d.aid, d.vid, d.emp, m.min_dist, m.max_dist, CASE WHEN m.min_dist IS NULL THEN 0 WHEN w.widest = 0 THEN 1 ELSE exp(-0.5::DOUBLE * m.min_dist / w.widest) END AS factor FROM dom d"
    " LEFT JOIN (SELECT aid, e_vid, min(dist) AS min_dist, max(dist) AS max_dist FROM prs GROUP BY ALL) m ON m.aid = d.aid AND m.e_vid = d.vid LEFT JOIN (SELECT aid, max(dist) AS widest FROM prs GROUP BY ALL) w ON w.aid = d.aid)"
)
_ROWS = ", ".join(f"({k}, {'true' if t is None else 'false'}, {'NULL' if b is None else b}::DOUBLE)" for k, (_, _, t, b) in enumerate(ATTRIBUTES))
#: The fixed state: entity = key div 2, with the values of its first record that has one.
STATE_SQL = (
    f"{INDEX_SQL}, attr AS (SELECT * FROM (VALUES {_ROWS}) t(aid, constant, b))"
    ", lk AS (SELECT p_partkey AS rid, p_partkey // 2 AS eid FROM part)"
    ", ent AS (SELECT eid, aid, coalesce(arg_min(vid, rid), 0) AS vid FROM rv JOIN lk USING (rid) GROUP BY ALL)"
    ", dis AS (SELECT rv.rid, rv.aid, coalesce(rv.vid <> ent.vid, false) AS z FROM rv JOIN lk USING (rid) JOIN ent ON ent.eid = lk.eid AND ent.aid = rv.aid)"
    ", th AS (SELECT f.fid, a.aid, 0.1::DOUBLE + 0.02::DOUBLE * a.aid + 0.01::DOUBLE * f.fid AS theta FROM (SELECT DISTINCT fid FROM rv) f, attr a)"
    ", seen AS (SELECT rv.rid, rv.fid, rv.aid, rv.vid, dis.z, attr.constant, attr.b FROM rv JOIN dis ON rv.rid = dis.rid AND rv.aid = dis.aid JOIN attr ON attr.aid = rv.aid WHERE rv.vid IS NOT NULL)"
)


#: The same where an entity's own value counts as one it may be distorted to. A finite
#: concentration needs that it doesn't, so there is none.
INDEX_IN_SQL = INDEX_SQL.replace(" AND e.vid <> r.vid", "")
STATE_IN_SQL = STATE_SQL.replace(INDEX_SQL, INDEX_IN_SQL).replace(_ROWS, _ROWS.replace("5.0::DOUBLE", "NULL::DOUBLE").replace("3.0::DOUBLE", "NULL::DOUBLE"))


def stored_state(spark: SparkSession, sf_dir: str, exclude: bool = True) -> dict[str, DataFrame]:
    """The same with its tables stored, for plans that read them again and again."""
    return state(spark, sf_dir, exclude, store=True)


def state(spark: SparkSession, sf_dir: str, exclude: bool = True, store: bool = False) -> dict[str, DataFrame]:
    """The index of the part records and a fixed chain state, as tables by name."""
    from kindred.operators import encoding
    from kindred.plans.chains import stored
    from kindred.plans.model import build_index

    keep = stored if store else lambda df: df
    long = encoding.unpivot(part_records(spark, sf_dir), [a for a, *_ in ATTRIBUTES], "rec_id", "file")
    dictionary = keep(encoding.domain(long))
    files = keep(encoding.file_ids(long))
    values = keep(encoding.encode(long, dictionary).join(F.broadcast(files), "file").select(F.col("rec_id").alias("rid"), "fid", "aid", "vid"))
    domain, close = (keep(t) for t in build_index(dictionary, part_attributes(exclude)))
    attributes = spark.createDataFrame([(k, t is None, exclude, b if exclude else None) for k, (_, _, t, b) in enumerate(ATTRIBUTES)], "aid int, constant boolean, exclude boolean, b double")
    links = values.select("rid", F.floor(F.col("rid") / 2).cast("bigint").alias("eid")).distinct()
    links = keep(links)
    first = F.min_by("vid", F.when(F.col("vid").isNotNull(), F.col("rid")))
    entities = keep(values.join(links.hint("merge"), "rid").groupBy("eid", "aid").agg(F.coalesce(first, F.lit(0)).alias("vid")))
    own = values.join(links.hint("merge"), "rid").join(entities.withColumnRenamed("vid", "e_vid").hint("merge"), ["eid", "aid"])
    distortions = keep(own.select("rid", "aid", F.coalesce(F.col("vid") != F.col("e_vid"), F.lit(False)).alias("z")))
    theta = files.select("fid").join(attributes.select("aid")).select("fid", "aid", (F.lit(0.1) + F.lit(0.02) * F.col("aid") + F.lit(0.01) * F.col("fid")).alias("theta"))
    phi = domain.select("aid", "vid", "emp_prob", F.col("emp_prob").alias("phi"))
    return {"long": long, "dictionary": dictionary, "files": files, "record_values": values, "domain": domain, "close": close, "attributes": attributes, "links": links, "entities": entities, "distortions": distortions, "theta": theta, "phi": phi}


def people(spark: SparkSession, n: int = 450, copies: int = 50, seed: int = 1) -> DataFrame:
    """rec_id, file_id, fname_c1, fname_c2, lname_c1, lname_c2, by, bm, bd, identity: person
    records of which ``copies`` repeat another with one edit."""
    r = random.Random(seed)
    syllables = ["ma", "ri", "an", "ha", "el", "ke", "jo", "na", "th", "or", "lu", "is", "be", "ro", "st", "fa"]
    name = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4))).upper()
    first, last = [name() for _ in range(60)], [name() for _ in range(150)]
    rows = [[r.choice(first), None, r.choice(last), None, str(r.randint(1930, 2000)), str(r.randint(1, 12)), str(r.randint(1, 28)), k] for k in range(n)]
    for k in r.sample(range(n), copies):
        row = list(rows[k])
        field = r.choice([0, 2, 4, 5, 6])
        if field in (0, 2):
            at = r.randrange(len(row[field]))
            row[field] = row[field][:at] + r.choice("ABCDEFGHIKLMNOPRSTU") + row[field][at + 1 :]
        else:
            row[field] = str(int(row[field]) % (12 if field == 5 else 28 if field == 6 else 2000) + 1)
        rows.append(row)
    return spark.createDataFrame([(str(i), str(i % 2), *row) for i, row in enumerate(rows)], "rec_id string, file_id string, fname_c1 string, fname_c2 string, lname_c1 string, lname_c2 string, by string, bm string, bd string, identity long")
