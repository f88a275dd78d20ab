"""Every query with SQL gives the rows that DuckDB gives, at sf0.001."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["attr_domain", "close_values_included", "distance_ranges_included", "constant_expected_included", "link_weights_included", "new_entity_weights_included", "entity_weights_included", "distortion_draws_included", "kernel_link_weights", "kernel_new_entity_weights", "kernel_entity_weights", "kernel_link_weights_included", "kernel_new_entity_weights_included", "kernel_entity_weights_included", "pair_probs", "record_values", "impute_missing", "close_values", "distance_ranges", "scaled_threshold", "constant_expected", "candidates", "link_weights", "new_entity_weights", "entity_draws", "distortion_draws", "corrected_counts", "mp_clusters", "smp_clusters", "coreference_probs", "evaluate_pairs", "effective_sample_size", "multivariate_ess", "densities", "seating_weights", "initial_state"]


def plain(rows):
    def cell(v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v):.6g}"
        except ValueError:
            return str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    from kindred import queries

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    own = queries.QUERIES[name](spark, SF)
    columns = sorted(own.columns)
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert plain(tuple(r) for r in own.select(*columns).collect()) == plain(theirs)


def test_entry_contract(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_chains_cover_all_parts(spark):
    from kindred import queries

    parts = {str(r[0]) for r in queries.part_records(spark, SF).select("rec_id").collect()}
    assert {m for r in queries.flagship(spark, SF).collect() for m in r.members.split(",")} == parts
