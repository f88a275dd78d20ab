"""Links and entity values drawn from arrays against those drawn one by one, and what a sweep may cost."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from test_links import spec

from kindred.functions.distributions import Gamma
from kindred.functions.partitions import GeneralizedCoupon, PitmanYor
from kindred.plans import sweep
from kindred.plans.kernel import Chain


def state(prior, n=7, **how):
    """A chain with shared entities and distorted values, made by the plain updates."""
    s = spec(n, **how)
    s.prior = s.initial_prior = prior
    chain = Chain(s, 3, 0)
    for _ in range(6):
        chain.sweep()
    return chain


def copied(chain, plain):
    out = Chain(chain.s, 1, 0)
    ids, values, at = chain._arrays
    out._arrays, out.link = (ids.copy(), values.copy(), at.copy()), chain.link.copy()
    out.z, out.theta, out.phi, out.clustering, out.norm, out.next_entity = chain.z, chain.theta, chain.phi, chain.clustering, chain.norm, chain.next_entity
    if plain:
        out._unfold()
    return out


def alike(one, other):
    """Counts of two samples: no key is off by more than chance allows."""
    for key in one.keys() | other.keys():
        a, b = one[key], other[key]
        assert abs(a - b) < 5 * math.sqrt(a + b + 1), (key, a, b)


@pytest.mark.parametrize("how", [{}, {"exclude": False}, {"kinds": 2}, {"tries": -1000}])
@pytest.mark.parametrize("prior", [PitmanYor(1.0, 0.3), GeneralizedCoupon(20, 0.5), GeneralizedCoupon(20, math.inf)])
def test_links_have_the_plain_updates_distribution(monkeypatch, prior, how):
    how = dict(how)
    if "kinds" in how:  # most records bind more than slots are sorted by
        monkeypatch.setattr(sweep, "KINDS", how.pop("kinds") - 1)
    if "tries" in how:  # ranges are weighed whole
        monkeypatch.setattr(sweep, "TRIES", how.pop("tries"))
    chain = state(prior, **how)
    assert chain.z.any()
    seen = [Counter(), Counter()]
    for plain in (0, 1):
        for k in range(3000):
            c = copied(chain, plain)
            c.update_links(np.random.default_rng(k + plain * 10**6))
            blocks = c.link.tolist()
            seen[plain].update((("pair", i, j) for i in range(7) for j in range(i) if blocks[i] == blocks[j]))
            seen[plain].update(("value", r, a, v) for r, e in enumerate(blocks) for a, v in enumerate(c.value[e].tolist()))
            seen[plain]["n", len(c.members)] += 1
    alike(*seen)


@pytest.mark.parametrize("how", [{}, {"exclude": False}])
def test_entities_have_the_plain_updates_distribution(how):
    chain = state(PitmanYor(1.0, 0.3), 12, **how)
    assert len(chain.sizes()) < 12
    seen = [Counter(), Counter()]
    for plain in (0, 1):
        for k in range(3000):
            c = copied(chain, plain)
            c.update_entities(np.random.default_rng(k + plain * 10**6))
            seen[plain].update((e, a, v) for e, value in c.value.items() for a, v in enumerate(value.tolist()))
    alike(*seen)


def test_tokens_stay_those_beyond_the_first():
    chain = state(PitmanYor(1.0, 0.0), 40)
    for _ in range(5):
        chain.sweep()
        ids, values, at = chain._arrays
        assert (ids[at] == chain.link).all() and len(np.unique(at)) == len(ids) == len(values)
        for a in range(3):  # an undistorted value is the entity's
            there = (chain.s.x[:, a] >= 0) & ~chain.z[:, a]
            assert (values[at][there, a] == chain.s.x[there, a]).all()


def test_a_sweep_does_not_weigh_all_pairs():
    """40000 records of few values: each has thousands of candidates."""
    s = spec(40000)
    s.prior = PitmanYor(Gamma(1, 1), 0.9)
    chain = Chain(s, 3, 0)
    chain.sweep()
    start = time.process_time()
    chain.sweep()
    assert time.process_time() - start < 8


def test_chains_have_tasks_of_their_own(spark):
    from kindred.plans.chains import run_inference
    from kindred.plans.model import CategoricalAttribute, build_model

    df = spark.createDataFrame([(k, str(k % 3), str(k % 2)) for k in range(12)], "id int, a string, b string")
    model = build_model(df, {c: CategoricalAttribute() for c in "ab"}, PitmanYor(1.0, 0.2), "id")
    fit = run_inference(model, 2, chains=3, block=1)
    for block in fit.blocks:
        parts = spark.read.parquet(block).selectExpr("chain", "input_file_name() as f").distinct().collect()
        assert len(parts) == 3 == len({p.f for p in parts})
    assert fit.table("links").count() == 3 * 2 * 12


def test_a_stored_state_goes_on_as_it_was():
    import pickle

    chain = Chain(spec(50), 3, 0)
    chain.sweep()
    again = pickle.loads(pickle.dumps(chain)).resume(chain.s)
    for c in (chain, again):
        c.sweep()
    assert (chain.link == again.link).all() and (chain.z == again.z).all() and (chain.theta == again.theta).all()
    large = Chain(spec(20000), 3, 0)
    large.sweep()
    assert len(pickle.dumps(large)) < 20 * 20000  # as dictionaries it was over 400 bytes a record


def test_a_records_values_come_to_the_driver_in_one_row(spark, monkeypatch):
    from kindred.plans import chains
    from kindred.plans.model import CategoricalAttribute, build_model

    df = spark.createDataFrame([(k, None if k % 4 == 1 else str(k % 3), str(k % 2)) for k in range(40)], "id int, a string, b string")
    model = build_model(df, {c: CategoricalAttribute() for c in "ab"}, PitmanYor(1.0, 0.2), "id")
    sizes, plain = [], chains.columns
    monkeypatch.setattr(chains, "columns", lambda frame: (out := plain(frame), sizes.append(len(next(iter(out.values())))))[0])
    found = chains.specification(model)
    assert max(sizes) == 40
    ids = {r.rid: int(r.rec_id) for r in model.records.collect()}
    for r, k in ids.items():
        assert found.x[r].tolist() == [-1 if k % 4 == 1 else k % 3, k % 2]
    start = {(r.eid, r.aid): r.vid for r in model.entities.collect()}
    assert all(found.start[e, a] == v for (e, a), v in start.items()) and (found.start >= 0).all() and len(start) == 80
