"""The kernel's weights of a state in parts: the same rows, and no table of records on the driver."""

import pytest

from kindred import queries
from kindred.plans import weights

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["new_entity_weights", "entity_weights", "link_weights", "new_entity_weights_included", "entity_weights_included", "link_weights_included"])
def test_parts_have_the_plans_rows(spark, name, monkeypatch):
    gathered, plain = [], type(spark.range(1)).toPandas
    monkeypatch.setattr(weights, "PART", 13)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: gathered.append(self.columns) or plain(self))
    own = queries.QUERIES[f"kernel_{name}"](spark, SF)
    assert not any({"rid", "eid"} & set(c) for c in gathered)
    theirs = queries.QUERIES[name](spark, SF).select(*own.columns)
    rows = sorted(tuple(r) for r in own.collect())
    others = sorted(tuple(r) for r in theirs.collect())
    assert len(rows) > 100 and [r[:-1] for r in rows] == [r[:-1] for r in others]
    assert all(abs(r[-1] - o[-1]) < 2e-6 for r, o in zip(rows, others, strict=True))
