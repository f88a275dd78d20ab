"""Coreference of many records: nothing is broadcast, and samples that one of two lacks don't count."""

from kindred.operators import clusters as C


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coreference_isnt_broadcast_and_counts_the_samples_of_both(spark):
    rows = [(s, r, (s * 7 + r) % 3) for s in range(600) for r in range(6) if not (r == 5 and s % 2) and not (r == 4 and s < 300)]
    samples = spark.createDataFrame(rows, "sample bigint, rid bigint, eid bigint")
    pairs = [(0, 3), (1, 5), (4, 5), (2, 4), (0, 1)]
    out = C.coreference_probs(samples, spark.createDataFrame(pairs, "a bigint, b bigint"))
    held = {(s, r): e for s, r, e in rows}
    for row in out.collect():
        both = [held[s, row.a] == held[s, row.b] for s in range(600) if (s, row.a) in held and (s, row.b) in held]
        assert row.prob == sum(both) / len(both)
    assert out.count() == len(pairs)
    assert "BroadcastHashJoin" not in _plan(out)
