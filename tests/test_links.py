"""Links that are weighed together against one by one, and a sweep's work on many like records."""

import math

import numpy as np
import pytest

from kindred.functions.distributions import Beta
from kindred.functions.partitions import PitmanYor
from kindred.plans.kernel import Chain, Entities, Spec


def spec(n, exclude=True, b=math.inf, domain=6):
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(-1, 3, n), rng.integers(-1, domain, n), rng.integers(0, 4, n)], 1)
    emp = [np.array([0.5, 0.3, 0.2]), np.full(domain, 1 / domain), np.array([0.1, 0.2, 0.3, 0.4])]
    e = np.repeat(np.arange(domain), 2)
    r = (e + np.tile([1, domain - 1], domain)) % domain
    close = [None, (e, r, np.tile([0.25, 0.75], domain)), None]
    return Spec(x, np.zeros(n, int), 1, emp, close, [np.zeros(3), np.full(domain, 0.7), np.zeros(4)], [exclude] * 3, [Beta(1, 1)] * 3, [b, math.inf, math.inf], [p.copy() for p in emp], [None] * 3, PitmanYor(1.0, 0.3), PitmanYor(1.0, 0.3))


@pytest.mark.parametrize("how", [{}, {"exclude": False}, {"b": 2.0}, {"domain": 1500}])
def test_links_weighed_together(how):
    chain = Chain(spec(60, **how), 3, 0)
    seen = 0
    for _ in range(4):
        chain.sweep()
        for r in range(60):
            e = int(chain.link[r])
            value = chain.value[e]
            chain.detach(r)
            held = Entities(chain.value, chain.members, 60, 3)
            options, logw = chain.weighed_links(r, held)
            own = {e: w for e, w in zip(options.tolist(), logw.tolist(), strict=True) if w > -math.inf}
            plain = {e: w for e in chain.candidates(r) if (w := chain.link_logweight(r, e)) > -math.inf}
            assert own.keys() == plain.keys() and all(abs(w - plain[e]) < 1e-9 for e, w in own.items())
            seen += len(own)
            if e not in chain.members:
                chain.members[e], chain.value[e] = set(), value
                for a, v in enumerate(value.tolist()):
                    chain.by_value[a].setdefault(v, set()).add(e)
            chain.members[e].add(r)
    assert seen > (5 if how.get("domain") else 100)


def test_entities_follow_what_is_added_and_dropped():
    rng = np.random.default_rng(1)
    value = {e: rng.integers(0, 3, 2) for e in range(5)}
    held = Entities(value, {e: {e} for e in value}, 9, 2)
    for e in range(5, 300):
        gone = int(rng.choice(list(value)))
        del value[gone]
        held.drop(gone)
        value[e] = rng.integers(0, 3, 2)
        held.add(e, value[e])
        held.size[held.slot[e]] += 1
        for a in (0, 1):
            for v in range(3):
                assert sorted(held.ids[held.holding(a, v)].tolist()) == sorted(k for k, u in value.items() if u[a] == v)


def test_a_sweep_weighs_no_link_by_itself(monkeypatch):
    chain, one_by_one = Chain(spec(400), 3, 0), []
    chain.sweep()
    monkeypatch.setattr(Chain, "link_logweight", lambda self, r, e: one_by_one.append(r) or 0.0)
    chain.sweep()
    assert not one_by_one
