"""Registered queries and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.distributions import Beta, Dirichlet, Gamma, ShiftedNegBinom
from kindred.functions.partitions import Ewens, GeneralizedCoupon, PitmanYor, sample_partitions
from kindred.functions.uniforms import uniform, uniform_sql
from kindred.operators import clusters as C
from kindred.operators import encoding as E
from kindred.operators import similarity as S
from kindred.operators import step
from kindred.plans.chains import run_inference, stored
from kindred.plans.kernel import kept
from kindred.plans.model import CategoricalAttribute, build_model, impute
from kindred.plans.weights import kernel_weights
from kindred.sources.fixtures import INDEX_IN_SQL, INDEX_SQL, SAMPLES_SQL, STATE_IN_SQL, STATE_SQL, part_attributes, part_records, samples, state, stored_state, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r9(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9).alias(name)


# -- encoding ---------------------------------------------------------------------------
@query(f"WITH {INDEX_SQL} SELECT aid, vid, value, cnt, round(emp, 9) AS emp_prob FROM dom")
def attr_domain(spark, sf):
    return state(spark, sf)["dictionary"].select("aid", "vid", "value", "cnt", r9("emp_prob", "emp_prob"))


@query(f"WITH {INDEX_SQL} SELECT rid, fid, aid, vid FROM rv")
def record_values(spark, sf):
    return state(spark, sf)["record_values"]


@query(f"WITH {INDEX_SQL} SELECT rid AS rec_id, CAST(fid AS VARCHAR) AS file, aid, value FROM vals")
def unpivot_records(spark, sf):
    return state(spark, sf)["long"]


@query(f"WITH {INDEX_SQL} SELECT aid, count(*) FILTER (WHERE value IS NULL) AS n_missing FROM vals GROUP BY aid")
def missing_counts(spark, sf):
    return E.missing_counts(state(spark, sf)["long"])


@query("SELECT CAST(p_partkey % 2 AS VARCHAR) AS file, dense_rank() OVER (ORDER BY CAST(p_partkey % 2 AS VARCHAR)) - 1 AS fid FROM part GROUP BY 1")
def file_ids(spark, sf):
    return state(spark, sf)["files"]


@query("SELECT p_partkey % 2 AS fid, count(*) AS n_records FROM part GROUP BY 1")
def file_counts(spark, sf):
    return step.file_counts(state(spark, sf)["record_values"])


@query("SELECT l_orderkey AS rec_id, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return E.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey")


@query("SELECT DISTINCT 0 AS aid, p_type AS value FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_partkey <= 3)")
def outside_domain(spark, sf):
    p = table(spark, sf, "part")
    values = p.select(F.lit(0).alias("aid"), F.col("p_type").alias("value"))
    return E.outside_domain(values, values.where("true").join(p.filter("p_partkey <= 3").select(F.col("p_type").alias("value")), "value", "left_semi").select("aid", "value").distinct())


@query("SELECT 1 AS aid, CAST(count(DISTINCT r) AS BIGINT) AS n FROM (SELECT 'same' AS r FROM part)")
def small_domains(spark, sf):
    p = table(spark, sf, "part")
    long = E.unpivot(p.select("p_partkey", "p_type", F.lit("same").alias("r")), ["p_type", "r"], "p_partkey")
    return E.small_domains(E.domain(long), 2)


@query(f"WITH {INDEX_SQL}, full_d AS (SELECT aid, value, cnt FROM cnts WHERE aid = 0 UNION ALL SELECT 0, 'never seen', 0) SELECT value, cnt, round((cnt + 1) / (SELECT sum(cnt + 1) FROM full_d), 9) AS emp_prob FROM full_d")
def given_domain(spark, sf):
    long = state(spark, sf)["long"].filter("aid = 0")
    given = spark.createDataFrame([(0, "never seen")], "aid int, value string")
    return E.domain(long, given).select("value", "cnt", r9("emp_prob", "emp_prob"))


_U = uniform_sql("1", "'impute'", "v.rid", "v.aid")


@query(
    f"WITH {INDEX_SQL}, up AS (SELECT aid, vid, sum(emp) OVER (PARTITION BY aid ORDER BY vid) AS upto FROM dom), h AS (SELECT v.rid, v.aid, {_U} AS u FROM rv v WHERE v.vid IS NULL)"
    " SELECT rid AS eid, aid, vid FROM rv WHERE vid IS NOT NULL UNION ALL SELECT h.rid, h.aid, min(up.vid) FROM h JOIN up ON up.aid = h.aid AND h.u < up.upto GROUP BY ALL"
)
def impute_missing(spark, sf):
    s = state(spark, sf)
    return impute(s["record_values"].select(F.col("rid").alias("eid"), "aid", "vid"), s["domain"], 1)


# -- the index --------------------------------------------------------------------------
@query(f"WITH {INDEX_SQL} SELECT aid, e_vid, r_vid, dist, round(p, 9) AS p FROM cl")
def close_values(spark, sf):
    return state(spark, sf)["close"].select("aid", "e_vid", "r_vid", "dist", r9("p", "p"))


@query(f"WITH {INDEX_SQL} SELECT aid, vid, min_dist, max_dist, round(factor, 9) AS max_exp_factor FROM rng")
def distance_ranges(spark, sf):
    return state(spark, sf)["domain"].select("aid", "vid", "min_dist", "max_dist", r9("max_exp_factor", "max_exp_factor"))


@query("WITH d AS (SELECT DISTINCT c_name AS v FROM customer) SELECT a.v AS y, b.v AS x, levenshtein(a.v, b.v) * 0.5::DOUBLE AS dist FROM d a, d b WHERE levenshtein(a.v, b.v) * 0.5 <= 0.5 AND a.v <> b.v")
def scaled_threshold(spark, sf):
    return _scaled_threshold(table(spark, sf, "customer"))


def _scaled_threshold(customers):
    from kindred.functions.distances import levenshtein, threshold_distance

    # a value is its own id: no dictionary is numbered, and no pair looks its values up
    name = F.col("c_name")
    d = customers.filter(name.isNotNull()).select(F.lit(0).alias("aid"), name.alias("vid"), name.alias("value")).distinct()
    pairs = S.close_pairs(d, threshold_distance(levenshtein(2), 0.5, 0.5))
    return pairs.select(F.col("e_vid").alias("y"), F.col("r_vid").alias("x"), "dist")


@query(f"WITH {INDEX_SQL} SELECT aid, r_vid, round(sum(d.emp * cl.p), 9) AS expected, round(max(cl.p), 9) AS largest FROM cl JOIN (SELECT aid AS a, vid, emp FROM dom) d ON d.a = cl.aid AND d.vid = cl.e_vid GROUP BY aid, r_vid")
def expected_distortion(spark, sf):
    s = state(spark, sf)
    return S.expected_distortion(s["close"], s["phi"]).select("aid", "r_vid", r9("expected", "expected"), r9("largest", "largest"))


@query(f"WITH {INDEX_SQL} SELECT aid, round(sum(emp / (1 - emp)), 9) AS norm, round(1 / (1 - max(emp)), 9) AS max_prob FROM dom WHERE aid < 2 GROUP BY aid")
def constant_norm(spark, sf):
    return S.constant_norm(state(spark, sf)["phi"].filter("aid < 2")).select("aid", r9("norm", "norm"), r9("max_prob", "max_prob"))


@query(f"WITH {INDEX_SQL}, n AS (SELECT aid, sum(emp / (1 - emp)) AS norm FROM dom WHERE aid < 2 GROUP BY aid) SELECT aid, vid, round(norm * emp - emp * emp / (1 - emp), 9) AS expected FROM dom JOIN n USING (aid)")
def constant_expected(spark, sf):
    return S.constant_expected(state(spark, sf)["phi"].filter("aid < 2")).select("aid", "vid", r9("expected", "expected"))


@query(f"WITH {INDEX_SQL} SELECT e.vid AS e_vid, r.vid AS r_vid, round(CASE WHEN e.vid = r.vid THEN 0 ELSE r.emp / (1 - e.emp) END, 9) AS p FROM dom e, dom r WHERE e.aid = 0 AND r.aid = 0")
def constant_probs(spark, sf):
    d = state(spark, sf)["domain"].filter("aid = 0")
    e, r = d.select(F.col("vid").alias("e_vid"), F.col("emp_prob").alias("e")), d.select(F.col("vid").alias("r_vid"), F.col("emp_prob").alias("r"))
    return e.crossJoin(r).select("e_vid", "r_vid", r9(S.constant_prob(F.col("r"), F.col("e"), F.col("e_vid") == F.col("r_vid")), "p"))


# -- single steps on a fixed state --------------------------------------------------------
_CAND = (
    ", need AS (SELECT rid, count(*) AS need FROM seen WHERE NOT z OR NOT constant GROUP BY rid)"
    ", hit AS (SELECT s.rid, e.eid, s.aid FROM seen s JOIN ent e ON e.aid = s.aid AND e.vid = s.vid WHERE NOT s.z"
    " UNION SELECT s.rid, e.eid, s.aid FROM seen s JOIN cl c ON c.aid = s.aid AND c.r_vid = s.vid JOIN ent e ON e.aid = s.aid AND e.vid = c.e_vid WHERE s.z AND NOT s.constant)"
    ", cand AS (SELECT h.rid, h.eid FROM hit h JOIN need n ON n.rid = h.rid GROUP BY h.rid, h.eid, n.need HAVING count(*) = n.need"
    " UNION ALL SELECT r.rid, e.eid FROM (SELECT rid FROM lk WHERE rid NOT IN (SELECT rid FROM need)) r, (SELECT DISTINCT eid FROM ent) e)"
)


@query(f"WITH {STATE_SQL}{_CAND} SELECT rid, eid FROM cand")
def candidates(spark, sf):
    s = stored_state(spark, sf)
    return step.candidates(s["record_values"], s["distortions"], s["entities"], s["close"], s["attributes"])


_P = "CASE WHEN s.constant THEN CASE WHEN e.vid = s.vid THEN 0 ELSE dr.emp / (1 - de.emp) END ELSE coalesce(c.p, 0) END"


@query(
    f"WITH {STATE_SQL}{_CAND}, size AS (SELECT eid, count(*) AS size FROM lk GROUP BY eid)"
    ", cs AS (SELECT c.rid, c.eid, z.size - CASE WHEN l.eid = c.eid THEN 1 ELSE 0 END AS others FROM cand c JOIN size z ON z.eid = c.eid JOIN lk l ON l.rid = c.rid)"
    f", term AS (SELECT cs.rid, cs.eid, s.aid, s.b, {_P} AS p, (SELECT count(*) FROM seen m JOIN lk ml ON ml.rid = m.rid WHERE ml.eid = cs.eid AND m.aid = s.aid AND m.z AND m.rid <> cs.rid) AS disagree,"
    " (SELECT count(*) FROM seen m JOIN lk ml ON ml.rid = m.rid WHERE ml.eid = cs.eid AND m.aid = s.aid AND m.z AND m.rid <> cs.rid AND m.vid = s.vid) AS agree"
    " FROM cs JOIN seen s ON s.rid = cs.rid AND s.z JOIN ent e ON e.eid = cs.eid AND e.aid = s.aid JOIN dom de ON de.aid = s.aid AND de.vid = e.vid JOIN dom dr ON dr.aid = s.aid AND dr.vid = s.vid LEFT JOIN cl c ON c.aid = s.aid AND c.e_vid = e.vid AND c.r_vid = s.vid)"
    ", w AS (SELECT rid, eid, CASE WHEN b IS NULL THEN p ELSE (agree + b * p) / (disagree + b) END AS w FROM term)"
    ", t AS (SELECT rid, eid, min(w) AS least, sum(ln(CASE WHEN w > 0 THEN w ELSE 1 END)) AS s FROM w GROUP BY ALL)"
    " SELECT cs.rid, cs.eid, round(ln(abs(cs.others - 0.3::DOUBLE)) + coalesce(t.s, 0), 6) AS logw FROM cs LEFT JOIN t ON t.rid = cs.rid AND t.eid = cs.eid WHERE cs.others > 0 AND coalesce(t.least, 1) > 0"
)
def link_weights(spark, sf):
    return _link_weights(stored_state(spark, sf))


def _link_weights(s):
    out = step.link_weights(s["record_values"], s["links"], s["distortions"], s["entities"], s["close"], s["domain"], s["attributes"], PitmanYor(1.0, 0.3).existing, 6, stored)
    return out.select("rid", "eid", "logw")


@query(
    f"WITH {STATE_SQL}, n AS (SELECT aid, sum(emp / (1 - emp)) AS norm FROM dom GROUP BY aid), ex AS (SELECT d.aid, d.vid, norm * emp - emp * emp / (1 - emp) AS expected FROM dom d JOIN n USING (aid) WHERE d.aid < 2"
    " UNION ALL SELECT cl.aid, cl.r_vid, sum(d.emp * cl.p) FROM cl JOIN dom d ON d.aid = cl.aid AND d.vid = cl.e_vid GROUP BY ALL)"
    ", w AS (SELECT s.rid, CASE WHEN s.z THEN coalesce(ex.expected, 0) ELSE d.emp END AS w FROM seen s JOIN dom d ON d.aid = s.aid AND d.vid = s.vid LEFT JOIN ex ON ex.aid = s.aid AND ex.vid = s.vid)"
    ", k AS (SELECT count(DISTINCT eid) AS k FROM lk), z AS (SELECT eid, count(*) AS size FROM lk GROUP BY eid)"
    " SELECT l.rid, round(ln(1 + 0.3::DOUBLE * (k.k - CASE WHEN z.size = 1 THEN 1 ELSE 0 END)) + sum(ln(w.w)), 6) AS logw FROM lk l JOIN z ON z.eid = l.eid JOIN w ON w.rid = l.rid, k GROUP BY l.rid, k.k, z.size HAVING min(w.w) > 0"
)
def new_entity_weights(spark, sf):
    return _new_entity_weights(state(spark, sf))


def _new_entity_weights(s, exclude=True):
    close = S.expected_distortion(s["close"], s["phi"]).select("aid", F.col("r_vid").alias("vid"), "expected")
    expected = S.constant_expected(s["phi"].filter("aid < 2"), exclude).unionByName(close)
    out = step.new_entity_weights(s["record_values"], s["links"], s["distortions"], s["phi"], expected, s["attributes"], PitmanYor(1.0, 0.3).new)
    return out.select("rid", F.round("logw", 6).alias("logw"))


_ENTITY = (
    ", linked AS (SELECT l.eid, s.rid, s.aid, s.vid, s.constant, s.b, th.theta FROM seen s JOIN lk l ON l.rid = s.rid JOIN th ON th.fid = s.fid AND th.aid = s.aid)"
    ", sup AS (SELECT DISTINCT k.eid, k.aid, d.vid FROM linked k JOIN dom d ON d.aid = k.aid WHERE k.constant UNION SELECT eid, aid, vid FROM linked WHERE NOT constant UNION SELECT k.eid, k.aid, c.e_vid FROM linked k JOIN cl c ON c.aid = k.aid AND c.r_vid = k.vid WHERE NOT k.constant)"
    ", cell AS (SELECT u.eid, u.aid, u.vid AS e_vid, k.rid, k.vid AS r_vid, k.b, k.theta * CASE WHEN k.constant THEN 1 ELSE de.factor END AS q, CASE WHEN k.constant THEN CASE WHEN u.vid = k.vid THEN 0 ELSE dr.emp / (1 - de.emp) END ELSE coalesce(c.p, 0) END AS p"
    " FROM sup u JOIN linked k ON k.eid = u.eid AND k.aid = u.aid JOIN rng de ON de.aid = u.aid AND de.vid = u.vid JOIN dom dr ON dr.aid = u.aid AND dr.vid = k.vid LEFT JOIN cl c ON c.aid = u.aid AND c.e_vid = u.vid AND c.r_vid = k.vid)"
    ", seq AS (SELECT *, coalesce(sum(CASE WHEN e_vid <> r_vid THEN 1 ELSE 0 END) OVER (PARTITION BY eid, aid, e_vid ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, coalesce(sum(CASE WHEN e_vid <> r_vid THEN 1 ELSE 0 END) OVER (PARTITION BY eid, aid, e_vid, r_vid ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS same FROM cell)"
    ", ww AS (SELECT eid, aid, e_vid, CASE WHEN e_vid = r_vid THEN 1 - q ELSE q * CASE WHEN b IS NULL THEN p ELSE (same + b * p) / (bef + b) END END AS w FROM seq)"
    ", lw AS (SELECT w.eid, w.aid, w.e_vid AS vid, ln(d.emp) + sum(ln(CASE WHEN w.w > 0 THEN w.w ELSE 1 END)) AS logw FROM ww w JOIN dom d ON d.aid = w.aid AND d.vid = w.e_vid GROUP BY w.eid, w.aid, w.e_vid, d.emp HAVING min(w.w) > 0)"
)


def _entity_weights(spark, sf, exclude=True):
    s = state(spark, sf, exclude)
    return step.entity_weights(s["record_values"], s["links"], s["close"], s["domain"], s["phi"], s["attributes"], s["theta"])


@query(f"WITH {STATE_SQL}{_ENTITY} SELECT eid, aid, vid, round(logw, 6) AS logw FROM lw")
def entity_weights(spark, sf):
    return _entity_weights(spark, sf).select("eid", "aid", "vid", F.round("logw", 6).alias("logw"))


@query(f"WITH {STATE_SQL}{_ENTITY} SELECT eid, aid, arg_max(vid, logw - ln(-ln({uniform_sql('7', 'eid', 'aid', 'vid')}))) AS vid FROM lw GROUP BY eid, aid")
def entity_draws(spark, sf):
    return step.draw(_entity_weights(spark, sf), ["eid", "aid"], "vid", 7)


_PROB = "CASE WHEN rv.vid IS NULL THEN th.theta WHEN rv.vid <> ent.vid THEN 1 ELSE 0 END"


@query(f"WITH {STATE_SQL}, pr AS (SELECT rv.rid, rv.aid, {_PROB} AS prob FROM rv JOIN lk ON lk.rid = rv.rid JOIN ent ON ent.eid = lk.eid AND ent.aid = rv.aid JOIN th ON th.fid = rv.fid AND th.aid = rv.aid) SELECT rid, aid, round(prob, 9) AS prob, {uniform_sql('3', chr(39) + 'z' + chr(39), 'rid', 'aid')} < prob AS z FROM pr")
def distortion_draws(spark, sf):
    return _distortion_draws(state(spark, sf))


def _distortion_draws(s):
    out = step.distortion_draws(s["record_values"], s["links"], s["entities"], s["close"], s["domain"], s["attributes"], s["theta"], 3)
    return out.select("rid", "aid", r9("prob", "prob"), "z")


# -- where an entity's own value counts as one it may be distorted to ------------------------
def _included(sql: str) -> str:
    """The SQL of a query, for ``state(..., exclude=False)``."""
    changes = [
        (STATE_SQL, STATE_IN_SQL),
        (INDEX_SQL, INDEX_IN_SQL),
        ("CASE WHEN e.vid = s.vid THEN 0 ELSE dr.emp / (1 - de.emp) END", "dr.emp"),
        ("CASE WHEN u.vid = k.vid THEN 0 ELSE dr.emp / (1 - de.emp) END", "dr.emp"),
        ("CASE WHEN e_vid = r_vid THEN 1 - q ELSE", "CASE WHEN e_vid = r_vid THEN 1 - q + q * p ELSE"),
        ("norm * emp - emp * emp / (1 - emp)", "emp"),
        ("e.vid AS e_vid, r.vid AS r_vid, round(CASE WHEN e.vid = r.vid THEN 0 ELSE r.emp / (1 - e.emp) END, 9)", "e.vid AS e_vid, r.vid AS r_vid, round(r.emp, 9)"),
    ]
    for old, new in changes:
        sql = sql.replace(old, new)
    return sql


@query(_included(ORACLE_SQL["close_values"]))
def close_values_included(spark, sf):
    return state(spark, sf, False)["close"].select("aid", "e_vid", "r_vid", "dist", r9("p", "p"))


@query(_included(ORACLE_SQL["distance_ranges"]))
def distance_ranges_included(spark, sf):
    return state(spark, sf, False)["domain"].select("aid", "vid", "min_dist", "max_dist", r9("max_exp_factor", "max_exp_factor"))


@query(_included(ORACLE_SQL["constant_expected"]))
def constant_expected_included(spark, sf):
    return S.constant_expected(state(spark, sf, False)["phi"].filter("aid < 2"), False).select("aid", "vid", r9("expected", "expected"))


@query(_included(ORACLE_SQL["link_weights"]))
def link_weights_included(spark, sf):
    return _link_weights(stored_state(spark, sf, False))


@query(_included(ORACLE_SQL["new_entity_weights"]))
def new_entity_weights_included(spark, sf):
    return _new_entity_weights(state(spark, sf, False), False)


@query(_included(ORACLE_SQL["entity_weights"]))
def entity_weights_included(spark, sf):
    return _entity_weights(spark, sf, False).select("eid", "aid", "vid", F.round("logw", 6).alias("logw"))


_PROB_IN = "CASE WHEN rv.vid IS NULL THEN th.theta WHEN rv.vid <> ent.vid THEN 1 ELSE th.theta * b.p / (th.theta * b.p + 1 - th.theta) END"


@query(
    f"WITH {STATE_IN_SQL}, own AS (SELECT d.aid, d.vid, CASE WHEN a.constant THEN d.emp ELSE coalesce(cl.p, 0) END AS p FROM dom d JOIN attr a ON a.aid = d.aid LEFT JOIN cl ON cl.aid = d.aid AND cl.e_vid = d.vid AND cl.r_vid = d.vid)"
    f", pr AS (SELECT rv.rid, rv.aid, {_PROB_IN} AS prob FROM rv JOIN lk ON lk.rid = rv.rid JOIN ent ON ent.eid = lk.eid AND ent.aid = rv.aid JOIN th ON th.fid = rv.fid AND th.aid = rv.aid LEFT JOIN own b ON b.aid = rv.aid AND b.vid = rv.vid)"
    f" SELECT rid, aid, round(prob, 9) AS prob, {uniform_sql('3', chr(39) + 'z' + chr(39), 'rid', 'aid')} < prob AS z FROM pr"
)
def distortion_draws_included(spark, sf):
    return _distortion_draws(state(spark, sf, False))


# -- the same weights from the kernel that runs the chains -----------------------------------
def _kernel_weights(spark, sf, what: str, exclude: bool = True):
    """The fixed state goes to tasks as arrays, as a chain's does, and the kernel weighs it."""
    out = kernel_weights(stored_state(spark, sf, exclude), list(part_attributes(exclude).values()), PitmanYor(1.0, 0.3), what)
    return out.withColumn("logw", F.round("logw", 6))


for _exclude, _suffix in ((True, ""), (False, "_included")):
    for _what, _sql in (("links", "link_weights"), ("new", "new_entity_weights"), ("entities", "entity_weights")):

        def _weights(spark, sf, what=_what, exclude=_exclude):
            return _kernel_weights(spark, sf, what, exclude)

        QUERIES[f"kernel_{_sql}{_suffix}"] = _weights
        ORACLE_SQL[f"kernel_{_sql}{_suffix}"] = ORACLE_SQL[f"{_sql}{_suffix}"]


_ALT = (
    ", al AS (SELECT rv.rid, rv.fid, rv.aid, CASE WHEN attr.constant OR rng.factor = 1 THEN 1 ELSE rng.factor * (1 - th.theta) / (rng.factor * (1 - th.theta) + 1 - rng.factor) END AS prob FROM rv JOIN dis ON dis.rid = rv.rid AND dis.aid = rv.aid AND NOT dis.z JOIN lk ON lk.rid = rv.rid JOIN ent ON ent.eid = lk.eid AND ent.aid = rv.aid"
    " JOIN rng ON rng.aid = rv.aid AND rng.vid = ent.vid JOIN attr ON attr.aid = rv.aid JOIN th ON th.fid = rv.fid AND th.aid = rv.aid)"
)


def _auxiliary(spark, sf):
    s = state(spark, sf)
    return step.auxiliary_draws(s["distortions"], s["links"], s["entities"], s["domain"], s["record_values"], s["attributes"], s["theta"], 3)


_ALT_U = uniform_sql("3", "'alt'", "rid", "aid")


@query(f"WITH {STATE_SQL}{_ALT} SELECT rid, fid, aid, {_ALT_U} < prob AS alt FROM al")
def auxiliary_draws(spark, sf):
    return _auxiliary(spark, sf)


@query(f"WITH {STATE_SQL}{_ALT} SELECT fid, aid, CAST(sum(CASE WHEN {_ALT_U} < prob THEN 1 ELSE 0 END) AS BIGINT) AS n FROM al GROUP BY fid, aid")
def corrected_counts(spark, sf):
    return step.corrected_counts(_auxiliary(spark, sf))


@query(f"WITH {STATE_SQL} SELECT d.aid, d.vid, count(e.eid) AS n FROM dom d LEFT JOIN ent e ON e.aid = d.aid AND e.vid = d.vid GROUP BY ALL")
def entity_value_counts(spark, sf):
    s = state(spark, sf)
    return step.entity_value_counts(s["entities"], s["domain"])


@query(f"WITH {STATE_SQL} SELECT rv.fid, rv.aid, CAST(sum(CASE WHEN z THEN 1 ELSE 0 END) AS BIGINT) AS n FROM rv JOIN dis ON dis.rid = rv.rid AND dis.aid = rv.aid GROUP BY ALL")
def distorted_counts(spark, sf):
    s = state(spark, sf)
    return step.distorted_counts(s["record_values"], s["distortions"])


@query(f"WITH {STATE_SQL}, o AS (SELECT rid, CAST(sum(CASE WHEN z THEN 1 ELSE 0 END) AS BIGINT) AS n_distorted FROM dis GROUP BY rid) SELECT n_distorted, count(*) AS records FROM o GROUP BY 1")
def distorted_per_record(spark, sf):
    return step.distorted_per_record(state(spark, sf)["distortions"])


@query(f"WITH {STATE_SQL} SELECT s.rid, s.aid, row_number() OVER (PARTITION BY s.aid, l.eid, s.vid ORDER BY s.rid) AS nth FROM seen s JOIN lk l ON l.rid = s.rid WHERE s.z")
def repeat_index(spark, sf):
    s = state(spark, sf)
    return step.repeat_index(s["record_values"], s["links"], s["distortions"])


@query(f"SELECT o_orderkey, {uniform_sql('42', 'o_orderkey')} AS u FROM orders")
def counter_uniforms(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", uniform(F.lit(42), F.col("o_orderkey")).alias("u"))


# -- posterior summaries ------------------------------------------------------------------
_CL = f"{SAMPLES_SQL}, cs AS (SELECT sample, eid, list(rid ORDER BY rid) AS members FROM samp GROUP BY ALL), cf AS (SELECT members, count(*) AS freq FROM cs GROUP BY members)"
_MP = f"{_CL}, dg AS (SELECT freq, members, len(members) AS n, md5(array_to_string(members, ',')) AS digest FROM cf), sp AS (SELECT unnest(members) AS rid, freq, n, digest FROM dg), mp AS (SELECT rid, max({{'f': freq, 'n': n, 'd': digest}}) AS best FROM sp GROUP BY rid)"


@query(f"WITH {_CL} SELECT md5(array_to_string(members, ',')) AS digest, len(members) AS size, freq FROM cf")
def cluster_frequencies(spark, sf):
    return C.cluster_frequencies(samples(spark, sf)).select("digest", F.size("members").cast("bigint").alias("size"), "freq")


@query(f"WITH {_MP} SELECT rid, best.d AS digest, round(best.f / 10, 9) AS prob FROM mp")
def mp_clusters(spark, sf):
    return C.most_probable_digests(samples(spark, sf)).select("rid", "digest", r9("prob", "prob"))


@query(f"WITH {_MP} SELECT min(rid) AS cluster_id, array_to_string(list(rid ORDER BY rid), ',') AS members FROM mp GROUP BY best.d")
def smp_clusters(spark, sf):
    out = C.shared_most_probable_clusters(C.most_probable_digests(samples(spark, sf)))
    return out.select("cluster_id", F.array_join("members", ",").alias("members"))


@query(f"WITH {SAMPLES_SQL} SELECT eid, array_to_string(list(rid ORDER BY rid), ',') AS members FROM samp WHERE sample = 0 GROUP BY eid")
def membership_clusters(spark, sf):
    return C.membership_to_clusters(samples(spark, sf, 1).select("rid", "eid")).select("eid", F.array_join("members", ",").alias("members"))


@query(f"WITH {SAMPLES_SQL}, pr AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders WHERE o_orderkey + 1 IN (SELECT o_orderkey FROM orders)) SELECT a, b, round(avg(CASE WHEN x.eid = y.eid THEN 1::DOUBLE ELSE 0::DOUBLE END), 9) AS prob FROM pr JOIN samp x ON x.rid = a JOIN samp y ON y.rid = b AND y.sample = x.sample GROUP BY a, b")
def coreference_probs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"))
    pairs = o.withColumn("b", F.col("a") + 1).join(o.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
    return C.coreference_probs(samples(spark, sf), pairs).select("a", "b", r9("prob", "prob"))


_CUST = "cu AS (SELECT s.sample, o_orderkey AS rid, CASE WHEN (o_orderkey + s.sample) % 5 <> 0 THEN o_custkey ELSE o_orderkey + 10000000 END AS eid FROM orders, (SELECT unnest(range(10)) AS sample) s)"


@query(f"WITH {_CUST} SELECT x.rid AS a, y.rid AS b, round(count(*) / 10, 9) AS prob FROM cu x JOIN cu y ON x.sample = y.sample AND x.eid = y.eid AND x.rid < y.rid GROUP BY ALL")
def pair_probs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("rid"), "o_custkey").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(9))))
    s = o.select("sample", "rid", F.when((F.col("rid") + F.col("sample")) % 5 != 0, F.col("o_custkey")).otherwise(F.col("rid") + 10_000_000).alias("eid"))
    return C.pair_probs(s).select("a", "b", r9("prob", "prob"))


@query(f"WITH {SAMPLES_SQL} SELECT sample, count(DISTINCT eid) AS n_linked FROM samp GROUP BY sample")
def linked_entities(spark, sf):
    return C.linked_entities(samples(spark, sf))


@query(f"WITH {SAMPLES_SQL} SELECT eid, count(*) AS size FROM samp WHERE sample = 0 GROUP BY eid")
def cluster_sizes(spark, sf):
    return C.cluster_sizes(samples(spark, sf, 1))


_EVAL = (
    "WITH t AS (SELECT p_partkey AS rid, p_partkey // 2 AS eid FROM part), p AS (SELECT rid, CASE WHEN rid % 13 = 0 THEN eid + 1 ELSE eid END AS eid FROM t), tp AS (SELECT a.rid AS a, b.rid AS b FROM t a JOIN t b ON a.eid = b.eid AND a.rid < b.rid), pp AS (SELECT a.rid AS a, b.rid AS b FROM p a JOIN p b ON a.eid = b.eid AND a.rid < b.rid)"
    ", c AS (SELECT (SELECT count(*) FROM pp JOIN tp USING (a, b)) AS tp, (SELECT count(*) FROM pp ANTI JOIN tp USING (a, b)) AS fp, (SELECT count(*) FROM tp ANTI JOIN pp USING (a, b)) AS fn, (SELECT count(*) * (count(*) - 1) // 2 FROM part) AS pairs)"
    " SELECT tp, fp, fn, pairs - tp - fp - fn AS tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round((pairs - tp - fp - fn) / (pairs - tp - fn), 9) AS specificity, round(tp / (tp + fn), 9) AS sensitivity, round(2 * tp / (2 * tp + fp + fn), 9) AS f1score, round((pairs - fp - fn) / pairs, 9) AS accuracy, round((tp / (tp + fn) + (pairs - tp - fp - fn) / (pairs - tp - fn)) / 2, 9) AS balanced_accuracy FROM c"
)


@query(_EVAL)
def evaluate_pairs(spark, sf):
    p = table(spark, sf, "part")
    truth = p.select(F.col("p_partkey").alias("rid"), F.floor(F.col("p_partkey") / 2).alias("eid"))
    predicted = truth.withColumn("eid", F.when(F.col("rid") % 13 == 0, F.col("eid") + 1).otherwise(F.col("eid")))
    out = C.evaluate_pairs(C.membership_to_pairs(predicted), C.membership_to_pairs(truth), p.count())
    return out.select("tp", "fp", "fn", "tn", *[r9(c, c) for c in out.columns[4:]])


@query(
    "WITH s AS (SELECT event_type AS name, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value FROM events), n AS (SELECT name, count(*) AS n, var_samp(value) AS v, floor(sqrt(count(*))) AS size FROM s GROUP BY name)"
    ", m AS (SELECT s.name, floor(i / size) AS batch, avg(value) AS mean FROM s JOIN n ON n.name = s.name WHERE floor(i / size) < floor(n / size) GROUP BY ALL), b AS (SELECT name, var_samp(mean) AS bt FROM m GROUP BY name) SELECT n.name, n.n, round(n.n * n.v / (n.size * b.bt), 6) AS ess FROM n JOIN b ON n.name = b.name"
)
def effective_sample_size(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    s = e.select(F.col("event_type").alias("name"), (F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1).alias("i"), "value")
    return C.effective_sample_size(s).select("name", "n", F.round("ess", 6).alias("ess"))


@query(
    "WITH s AS (SELECT event_type AS name, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value AS x, (user_id % 97)::DOUBLE AS y FROM events), n AS (SELECT name, count(*) AS n, var_samp(x) * var_samp(y) - covar_samp(x, y) ** 2 AS det, floor(sqrt(count(*))) AS size FROM s GROUP BY name)"
    ", m AS (SELECT s.name, floor(i / size) AS batch, avg(x) AS x, avg(y) AS y FROM s JOIN n ON n.name = s.name WHERE floor(i / size) < floor(n / size) GROUP BY ALL), b AS (SELECT name, var_samp(x) * var_samp(y) - covar_samp(x, y) ** 2 AS det FROM m GROUP BY name)"
    " SELECT n.name, n.n, 2::BIGINT AS dims, round(n.n * sqrt(n.det / (n.size ** 2 * b.det)), 6) AS ess FROM n JOIN b ON n.name = b.name"
)
def multivariate_ess(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    i = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    both = F.explode(F.create_map(F.lit("x"), F.col("value"), F.lit("y"), (F.col("user_id") % 97).cast("double"))).alias("dim", "value")
    s = e.select(F.col("event_type").alias("name"), i.alias("i"), "value", "user_id").select("name", "i", both)
    return C.multivariate_effective_sample_size(s).select("name", "n", "dims", F.round("ess", 6).alias("ess"))



# -- distributions and priors ---------------------------------------------------------------
def _grid(spark, sf):
    return table(spark, sf, "part").select("p_size").distinct()


@query(
    "SELECT DISTINCT p_size, round(exp(lgamma(5) - lgamma(2) - lgamma(3) + ln(p_size / 51.0::DOUBLE) + 2 * ln(1 - p_size / 51.0::DOUBLE)), 9) AS beta, round(exp(3 * ln(0.5::DOUBLE) - lgamma(3) + 2 * ln(p_size) - 0.5::DOUBLE * p_size), 9) AS gamma,"
    " round(exp(lgamma(p_size - 1 + 4.0::DOUBLE) - lgamma(p_size) - lgamma(4) + 4 * ln(0.3::DOUBLE) + (p_size - 1) * ln(0.7::DOUBLE)), 9) AS negbinom FROM part"
)
def densities(spark, sf):
    x = F.col("p_size").cast("double")
    return _grid(spark, sf).select("p_size", r9(Beta(2, 3).density(x / 51.0), "beta"), r9(Gamma(3, 0.5).density(x), "gamma"), r9(ShiftedNegBinom(4, 0.3).density(x), "negbinom"))


@query("SELECT 'beta' AS rv, round(2 / 5, 9) AS mean, round(2 * 3 / (25 * 6), 9) AS var, round(sqrt(2 * 3 / (25 * 6)), 9) AS sd UNION ALL SELECT 'gamma', 6, 12, round(sqrt(12), 9) UNION ALL SELECT 'negbinom', round(4 * 0.7::DOUBLE / 0.3::DOUBLE + 1, 9), round(4 * 0.7::DOUBLE / 0.09::DOUBLE, 9), round(sqrt(4 * 0.7::DOUBLE / 0.09::DOUBLE), 9)")
def moments(spark, sf):
    rows = [(k, float(v.mean()), float(v.var()), v.sd()) for k, v in (("beta", Beta(2, 3)), ("gamma", Gamma(3, 0.5)), ("negbinom", ShiftedNegBinom(4, 0.3)))]
    return spark.createDataFrame(rows, "rv string, mean double, var double, sd double").select("rv", *[r9(c, c) for c in ("mean", "var", "sd")])


@query("WITH a AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 2.0), (2, 5.0)) t(i, alpha)) SELECT x.i, y.i AS j, round(x.alpha / 8, 9) AS mean, round((CASE WHEN x.i = y.i THEN x.alpha / 8 ELSE 0 END - x.alpha * y.alpha / 64) / 9, 9) AS cov FROM a x, a y")
def dirichlet_moments(spark, sf):
    d = Dirichlet((1.0, 2.0, 5.0))
    m, v = d.mean(), d.var()
    return spark.createDataFrame([(i, j, float(m[i]), float(v[i, j])) for i in range(3) for j in range(3)], "i int, j int, mean double, cov double").select("i", "j", r9("mean", "mean"), r9("cov", "cov"))


@query(f"WITH {SAMPLES_SQL}, z AS (SELECT eid, count(*) AS n FROM samp WHERE sample = 0 GROUP BY eid), k AS (SELECT count(*) AS k FROM z) SELECT eid, round(abs(n - 0.25::DOUBLE), 9) AS pitman_yor, round(2 + 0.25::DOUBLE * k, 9) AS pitman_yor_new, CAST(n AS DOUBLE) AS ewens, 2.0::DOUBLE AS ewens_new, round(n + 1.5::DOUBLE, 9) AS coupon, round(1.5::DOUBLE * abs(200000 - k), 9) AS coupon_new, 1.0::DOUBLE AS limit_existing, CAST(abs(200000 - k) AS DOUBLE) AS limit_new FROM z, k")
def seating_weights(spark, sf):
    z = C.cluster_sizes(samples(spark, sf, 1))
    k = z.agg(F.count("*").alias("k"))
    n, c = F.col("size").cast("double"), F.col("k").cast("double")
    py, ew, gc, lim = PitmanYor(2.0, 0.25), Ewens(2.0), GeneralizedCoupon(200000, 1.5), GeneralizedCoupon(200000, math.inf)
    return z.join(F.broadcast(k)).select("eid", r9(py.existing(n), "pitman_yor"), r9(py.new(c), "pitman_yor_new"), ew.existing(n).alias("ewens"), (ew.new(c) + 0.0).alias("ewens_new"), r9(gc.existing(n), "coupon"), r9(gc.new(c), "coupon_new"), lim.existing(n).alias("limit_existing"), lim.new(c).alias("limit_new"))


@query()
def sampled_partitions(spark, sf):
    """Random partitions under hyperpriors, a replicate at a time."""
    return sample_partitions(spark, 100, PitmanYor(Gamma(1, 1), Beta(1, 1)), 50, seed=7)


# -- chains ---------------------------------------------------------------------------------
@query("SELECT unnest(range(5)) AS sample, unnest([20, 23, 26, 29, 32]) AS iter")
def saved_iterations(spark, sf):
    return spark.createDataFrame(list(enumerate(kept(5, 3, 20))), "sample bigint, iter int")


def _chain(spark, sf, **how):
    return run_inference(build_model(part_records(spark, sf), part_attributes(), PitmanYor(Gamma(1, 1), Beta(1, 1)), "rec_id", "file"), **how)


@query()
def gibbs_chain(spark, sf):
    """Scalars of two short seeded chains over part records."""
    return _chain(spark, sf, n_samples=5, thin=2, burnin=4, chains=2, seed=3).table("distort_probs")


@query()
def resumed_chain(spark, sf):
    """A chain continued from its stored state."""
    fit = run_inference(_chain(spark, sf, n_samples=3, seed=3), n_samples=2)
    return fit.table("n_linked_ents")


@query()
def chain_summary(spark, sf):
    return _chain(spark, sf, n_samples=9, seed=3).summary()


@query("SELECT p_partkey AS rec_id, p_partkey % 2 AS fid, 0 AS aid, dense_rank() OVER (ORDER BY p_type) - 1 AS vid, 0.2::DOUBLE AS theta FROM part UNION ALL SELECT p_partkey, p_partkey % 2, 1, dense_rank() OVER (ORDER BY p_brand) - 1, 0.2::DOUBLE FROM part")
def initial_state(spark, sf):
    """A model's start: singletons, entity values as observed, probabilities at their means."""
    prior = Beta(1, 4)
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 2).alias("file"), "p_type", "p_brand")
    m = build_model(p, {c: CategoricalAttribute(distort_prob=prior) for c in ("p_type", "p_brand")}, Ewens(1.0), "p_partkey", "file", validate=False)
    rows = m.records.select("rid", F.col("rec_id").cast("bigint").alias("rec_id")).join(m.links, "rid").join(m.entities, "eid")
    files = m.record_values.select("rid", "fid", "aid")
    return rows.join(files, ["rid", "aid"]).join(F.broadcast(m.theta), ["fid", "aid"]).select("rec_id", "fid", "aid", "vid", "theta")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short seeded chain over part records, and its shared most probable clusters."""
    fit = _chain(spark, sf_dir, n_samples=10, thin=1, burnin=5, seed=1)
    return C.shared_most_probable_clusters(C.most_probable_digests(fit.samples())).select("cluster_id", F.array_join("members", ",").alias("members"))
