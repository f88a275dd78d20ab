"""Closed forms, invariants and distributions of the chain."""

import math
from collections import Counter

import numpy as np
import pytest

from kindred.functions.distributions import Beta, Dirichlet, DirichletProcess, Gamma, ShiftedNegBinom
from kindred.functions.partitions import Ewens, GeneralizedCoupon, PitmanYor, sample_ewens_pitman, seat
from kindred.operators import clusters as C
from kindred.plans.chains import run_inference
from kindred.plans.kernel import Chain, Spec, kept
from kindred.plans.model import Attribute, CategoricalAttribute, build_model


def test_moments_and_checks():
    assert Beta(2, 3).mean() == 0.4 and math.isclose(Gamma(3, 0.5).var(), 12)
    assert ShiftedNegBinom(4, 0.5).mean() == 5
    for bad in (lambda: Beta(0, 1), lambda: Gamma(1, math.inf), lambda: PitmanYor(-0.5, 0.2), lambda: GeneralizedCoupon(0, 1.0), lambda: Dirichlet((1.0, -1.0)), lambda: DirichletProcess(0.0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        Dirichlet(1.0).mean()


def test_seating_gives_ewens_expectation():
    rng = np.random.default_rng(1)
    blocks = [seat(40, Ewens(2.0), rng).max() + 1 for _ in range(800)]
    assert abs(np.mean(blocks) - sum(2 / (2 + i) for i in range(40))) < 0.3
    assert sample_ewens_pitman(100, 1, -1) == [list(range(100))]


def test_saved_iterations():
    assert kept(3, 5, 0) == [5, 10, 15] and kept(3, 5, 20) == [20, 25, 30]


def test_golden_measures(spark):
    row = C.measures(spark.createDataFrame([(49, 1, 1, 124699)], "tp long, fp long, fn long, tn long")).first()
    assert row.precision == row.recall == row.f1score == 0.98
    assert round(row.specificity, 6) == 0.999992 and round(row.accuracy, 6) == 0.999984 and round(row.balanced_accuracy, 6) == 0.989996


def toy(x, domain=3, prior=None, theta=None):
    x = np.array(x)
    k = x.shape[1]
    emp = [np.full(domain, 1 / domain)] * k
    prior = prior or Ewens(1.0)
    return Spec(x, np.zeros(len(x), int), 1, emp, [None] * k, [np.ones(domain)] * k, [True] * k, theta or [Beta(1, 1)] * k, [math.inf] * k, emp, [None] * k, prior, prior)


def test_prior_only_chain_matches_expectation():
    chain = Chain(toy([[-1]] * 12), 5, 0)
    sizes = []
    for _ in range(3000):
        chain.sweep()
        sizes.append(len(chain.members))
    assert abs(np.mean(sizes) - sum(1 / (1 + i) for i in range(12))) < 0.25


def partitions(n):
    if n == 0:
        yield ()
        return
    for p in partitions(n - 1):
        for label in range(max(p, default=-1) + 2):
            yield (*p, label)


def test_toy_posterior_by_enumeration():
    """Fixed distortion, four records: frequencies of partitions against exact sums."""
    x, t, d = [[0], [0], [1], [-1]], 0.3, 3
    weight = {}
    for p in partitions(4):
        w, k = 1.0, 0
        for label in set(p):
            members = [r for r in range(4) if p[r] == label]
            w *= math.factorial(len(members) - 1)
            k += 1
            w *= sum((1 / d) * math.prod((1 - t) if x[r][0] == e else t / (d - 1) for r in members if x[r][0] >= 0) for e in range(d))
        weight[p] = w
    total = sum(weight.values())
    chain, seen, n = Chain(toy(x, d, Ewens(1.0), [t]), 11, 0), Counter(), 20000
    for _ in range(n):
        chain.sweep()
        names: dict = {}
        seen[tuple(names.setdefault(e, len(names)) for e in chain.link.tolist())] += 1
    assert max(abs(seen[p] / n - w / total) for p, w in weight.items()) < 0.02


def people_model(spark, n=40, copies=10, **options):
    from kindred.functions.distances import levenshtein
    from kindred.sources.fixtures import people

    df = people(spark, n, copies)
    attributes = {"fname_c1": Attribute(distance=levenshtein(3)), "lname_c1": Attribute(distance=levenshtein(3)), "by": CategoricalAttribute(), "bm": CategoricalAttribute(**options), "bd": CategoricalAttribute()}
    return df, build_model(df, attributes, PitmanYor(Gamma(1, 1), Beta(1, 1)), "rec_id", "file_id")


def test_chain_resumes_as_if_unbroken(spark):
    _, model = people_model(spark)
    whole = run_inference(model, 6, seed=4)
    split = run_inference(run_inference(model, 4, seed=4), 2)
    rows = lambda fit: sorted(map(tuple, fit.table("links").collect()))
    assert rows(whole) == rows(split)
    assert whole.extract("n_linked_ents").count() == 6
    with pytest.raises(ValueError):
        whole.extract("nothing")


def test_chain_stops_early_and_goes_on(spark):
    _, model = people_model(spark)
    whole = run_inference(model, 4, thin=2, burnin=3, seed=4)
    calls = []
    part = run_inference(model, 4, thin=2, burnin=3, seed=4, block=2, progress=lambda done, wanted: calls.append((done, wanted)) or len(calls) < 2)
    assert calls == [(2, 9), (4, 9)] and part.n_samples == 1 and part.table("n_linked_ents").count() == 1
    rest = run_inference(part, 3)
    rows = lambda fit: sorted(map(tuple, fit.table("links").collect()))
    assert rest.n_samples == 4 and rows(rest) == rows(whole)
    early = run_inference(model, 4, thin=2, burnin=3, seed=4, block=2, progress=lambda done, wanted: False)
    assert early.n_samples == 0 and rows(run_inference(early, 4)) == rows(whole)
    assert "Effective sample size" in rest.show() and "4 samples" in repr(rest)


@pytest.mark.parametrize("dist", [Dirichlet(1.0), Dirichlet(tuple([2.0] * 12)), {str(v): 1 / 12 for v in range(1, 13)}])
def test_entity_distributions_run(spark, dist):
    _, model = people_model(spark, entity_dist=dist)
    assert run_inference(model, 3, seed=2).table("n_linked_ents").count() == 3
    if isinstance(dist, dict):
        phi = model.phi.join(model.domain.select("aid", "vid", "value"), ["aid", "vid"]).filter("value = '12' and aid = 1").first()
        assert math.isclose(phi.phi, 1 / 12)


def test_dirichlet_of_another_length_is_refused(spark):
    _, model = people_model(spark, entity_dist=Dirichlet((1.0, 2.0)))
    with pytest.raises(ValueError, match="as many parameters"):
        run_inference(model, 1)


def test_validity(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, x string")
    for bad in (
        lambda: Attribute(distance="levenshtein"),
        lambda: Attribute(entity_dist={"a": 0.5}),
        lambda: Attribute(entity_dist={"a": 1.5, "b": -0.5}),
        lambda: Attribute(entity_dist=[0.5, 0.5]),
        lambda: Attribute(distort_prob=1.5),
        lambda: Attribute(distort_dist=3.0),
        lambda: Attribute(distort_dist=DirichletProcess(2.0), exclude_entity_value=False),
        lambda: build_model(df, {}, Ewens(1.0), "k"),
        lambda: build_model(df, {"x": "categorical"}, Ewens(1.0), "k"),
        lambda: build_model(df, {"x": Attribute()}, "ewens", "k"),
        lambda: build_model(df, {"k": Attribute()}, Ewens(1.0), "k"),
        lambda: build_model(df, {"y": Attribute()}, Ewens(1.0), "k"),
        lambda: build_model(df.union(df), {"x": Attribute()}, Ewens(1.0), "k"),
        lambda: build_model(df, {"x": Attribute()}, GeneralizedCoupon(1, 1.0), "k"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_blocking_of_a_distance_of_ones_own(spark):
    from pyspark.sql import functions as F

    own = lambda y, x: F.when(F.substring(y, 1, 1) == F.substring(x, 1, 1), F.levenshtein(y, x).cast("double"))
    df = spark.createDataFrame([(str(k), v) for k, v in enumerate(["ab", "ac", "b", "bcd", "cx", "abc"])], "k string, x string")
    close = lambda a: sorted(map(tuple, build_model(df, {"x": a}, Ewens(1.0), "k").close.collect()))
    blocked = close(Attribute(distance=own, blocking=lambda c: F.array(F.substring(c, 1, 1))))
    assert blocked == close(Attribute(distance=own)) and len(blocked) == 8


def found_in(df, model, fit):
    """Measures of the shared most probable clusters against the identities."""
    found = C.clusters_to_pairs(C.shared_most_probable_clusters(C.most_probable_clusters(fit.samples())))
    truth = C.membership_to_pairs(df.join(model.records.select("rec_id", "rid"), "rec_id").select("rid", "identity").withColumnRenamed("identity", "eid"))
    return C.evaluate_pairs(found, truth, df.count()).first()


def test_duplicates_are_found(spark):
    """500 records with 50 duplicates, after a shorter chain than published; the README has the figures of
    the published one."""
    df, model = people_model(spark, 450, 50)
    row = found_in(df, model, run_inference(model, 80, burnin=120, seed=1))
    assert row.recall >= 0.95 and row.precision >= 0.95


def test_invariants_of_a_sweep():
    rng = np.random.default_rng(0)
    chain = Chain(toy(rng.integers(-1, 3, (30, 2)).tolist()), 1, 0)
    for _ in range(20):
        chain.sweep()
        assert sorted(r for m in chain.members.values() for r in m) == list(range(30))
        assert all(chain.members.values())
        for r, e in enumerate(chain.link.tolist()):
            for a, x in enumerate(chain.s.x[r].tolist()):
                if x >= 0:
                    assert (x != chain.value[e][a]) == chain.z[r, a]


def test_two_level_entity_draw_has_the_weights_of_the_plain_one():
    rng = np.random.default_rng(3)
    for exclude in (True, False):
        spec = toy(rng.integers(-1, 5, (40, 2)).tolist(), 5, Ewens(1.0))
        spec.exclude = [exclude] * 2
        spec.emp = [np.array([0.1, 0.3, 0.2, 0.25, 0.15])] * 2
        chain = Chain(spec, 2, 0)
        for _ in range(5):
            chain.sweep()
        for e in chain.members:
            for a in range(2):
                plain, parts = chain.entity_logweights(e, a), chain.entity_parts(e, a, {})
                assert (plain is None) == (parts is None)
                if plain is not None:
                    support, logw = plain
                    w = np.exp(logw - logw.max())
                    w /= w.sum()
                    values, weights, others = parts
                    total = sum(weights) + others
                    assert np.allclose([w[support == v][0] for v in values], np.array(weights) / total)
                    assert math.isclose(w[~np.isin(support, values)].sum(), others / total, abs_tol=1e-9)


def successive(chain, redraw, statistic, n, rng):
    """Means of a statistic where data are drawn anew from the prior at each turn."""
    out = []
    for _ in range(n):
        redraw(chain, rng)
        out.append(statistic(chain))
    return np.array(out)


@pytest.mark.parametrize(
    ("prior", "read", "expected", "tolerance"),
    [
        (PitmanYor(Gamma(4, 2), Beta(2, 6)), lambda c: (c.alpha, c.d), (2.0, 0.25), (0.25, 0.03)),
        (GeneralizedCoupon(12, Gamma(4, 2)), lambda c: (c.kappa,), (2.0,), (0.25,)),
        (GeneralizedCoupon(ShiftedNegBinom(6, 0.5), 1.5), lambda c: (c.m,), (7.0,), (0.5,)),
    ],
)
def test_hyperparameters_keep_their_prior(prior, read, expected, tolerance):
    """Geweke's successive-conditional test: a partition is seated by the hyperparameters and they
    are updated given it, in turn, so in the long run they follow their prior."""
    rng = np.random.default_rng(8)
    chain = Chain(toy([[-1]] * 8, 3, prior), 3, 0)
    chain.clustering = prior.drawn(rng)

    def redraw(c, rng):
        labels = seat(8, c.clustering, rng)
        c.members = {int(k): set(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist())}
        c.update_prior(rng)

    seen = successive(chain, redraw, lambda c: read(c.clustering), 12000, rng)
    assert (np.abs(seen.mean(axis=0) - expected) < tolerance).all(), seen.mean(axis=0)


def test_entity_distribution_and_distortion_keep_their_priors():
    rng = np.random.default_rng(9)
    spec = toy([[0]] * 20, 3, Ewens(1.0), [Beta(3, 5)])
    spec.phi_alpha = [np.array([1.0, 2.0, 3.0])]
    chain = Chain(spec, 1, 0)

    def phi(c, rng):
        c.value = {e: np.array([rng.choice(3, p=c.phi[0])]) for e in range(6)}
        c.update_phi(rng)

    assert np.allclose(successive(chain, phi, lambda c: c.phi[0].copy(), 6000, rng).mean(axis=0), [1 / 6, 1 / 3, 1 / 2], atol=0.02)

    def theta(c, rng):
        c.z = rng.random((20, 1)) < c.theta[0, 0]
        c.update_theta(~c.z, rng)

    assert abs(successive(chain, theta, lambda c: c.theta[0, 0], 6000, rng).mean() - 3 / 8) < 0.02


def test_concentration_keeps_its_prior():
    """Distorted values of each entity are seated by a Dirichlet process about the base distribution."""
    rng = np.random.default_rng(10)
    spec = toy([[0]] * 12, 4, Ewens(1.0), [0.5])
    spec.b_prior = [Gamma(3, 1.5)]
    chain = Chain(spec, 1, 0)
    chain.members = {e: {3 * e, 3 * e + 1, 3 * e + 2} for e in range(4)}
    chain.value = {e: np.array([0]) for e in range(4)}

    def redraw(c, rng):
        for members in c.members.values():
            before: list[int] = []
            for r in sorted(members):
                old = before and rng.random() < len(before) / (len(before) + c.b[0])
                v = int(rng.choice(before)) if old else int(rng.integers(1, 4))
                c.s.x[r, 0] = v
                before.append(v)
        c.update_concentrations(rng)

    assert abs(successive(chain, redraw, lambda c: c.b[0], 12000, rng).mean() - 2.0) < 0.15


def test_a_single_record_draws_close_values_by_the_plain_weights():
    rng = np.random.default_rng(4)
    spec = toy([[0], [1], [2]], 4, Ewens(1.0), [0.4])
    spec.close = [(np.array([1, 2, 0, 3]), np.array([0, 0, 1, 2]), np.array([0.5, 1.0, 1.0, 0.7]))]
    spec.factor, spec.emp, spec.phi = [np.array([0.9, 0.8, 0.7, 0.6])], [np.array([0.4, 0.3, 0.2, 0.1])], [np.array([0.4, 0.3, 0.2, 0.1])]
    for exclude in (True, False):
        spec.exclude = [exclude]
        chain = Chain(spec, 2, 0)
        for e in range(3):
            support, logw = chain.entity_logweights(e, 0)
            w = np.exp(logw - logw.max())
            drawn = Counter(chain.draw_value(e, 0, rng, {}) for _ in range(6000))
            assert set(drawn) <= set(support.tolist())
            assert max(abs(drawn[int(v)] / 6000 - x) for v, x in zip(support, w / w.sum(), strict=True)) < 0.03
