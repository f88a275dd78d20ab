"""One chain: the partially collapsed Gibbs sampler, in numpy, on encoded tables.

The order of the stages is part of the semantics: hyperparameters of the clustering
prior, links, entity values, entity distributions, concentrations, distortion
indicators, distortion probabilities. The link update is sequential over records, which is
why a chain is a task; the single-step operators in ``kindred.operators.step`` are the
same mathematics as DataFrame plans.
"""

from __future__ import annotations

import math
import zlib
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np

from kindred.functions.distributions import Beta, Gamma
from kindred.functions.partitions import GeneralizedCoupon, PitmanYor
from kindred.plans import sweep


@dataclass
class Spec:
    """What a chain reads: arrays by attribute. close[a]: (e, r, p) edge arrays or None."""

    x: np.ndarray  # records x attributes, -1 where missing; int32 from tables
    file: np.ndarray
    n_files: int
    emp: list[np.ndarray]
    close: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]
    factor: list[np.ndarray]
    exclude: list[bool]
    theta_prior: list  # Beta or a number
    b_prior: list  # Gamma or a number
    phi: list[np.ndarray]
    phi_alpha: list[np.ndarray | None]
    prior: object
    initial_prior: object
    start: np.ndarray | None = None  # entity values at the start; None: drawn here


class Entities:
    """The entities as arrays while links are updated: values and sizes by slot, and for each
    attribute and value the slots that hold it, so that a record's candidates are found and weighed
    together."""

    def __init__(self, value: dict[int, np.ndarray], members: dict[int, set[int]], n: int, k: int):
        m, self.k = len(value), k
        self.values, self.size, self.ids, self.place = np.zeros((n + 1, k), np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros((n + 1, k), np.int64)
        self.ids[:m] = list(value)
        self.size[:m] = [len(members[e]) for e in value]
        if m:
            self.values[:m] = list(value.values())
        self.slot = dict(zip(value, range(m), strict=True))
        self.free = list(range(n, m - 1, -1))
        self.lists: list[dict[int, list]] = [{} for _ in range(k)]
        for a in range(k):
            order = np.argsort(self.values[:m, a], kind="stable")
            held, first = np.unique(self.values[order, a], return_index=True)
            for v, own in zip(held.tolist(), np.split(order, first[1:]), strict=True):
                self.lists[a][v] = [own, len(own)]
                self.place[own, a] = np.arange(len(own))

    def add(self, e: int, value: np.ndarray) -> None:
        i = self.slot[e] = self.free.pop()
        self.values[i], self.size[i], self.ids[i] = value, 0, e
        for a, v in enumerate(value.tolist()):
            own = self.lists[a].setdefault(v, [np.empty(4, np.int64), 0])
            if own[1] == len(own[0]):
                own[0] = np.concatenate([own[0], np.empty(len(own[0]) + 4, np.int64)])
            own[0][own[1]] = i
            self.place[i, a] = own[1]
            own[1] += 1

    def drop(self, e: int) -> None:
        i = self.slot.pop(e)
        for a, v in enumerate(self.values[i].tolist()):
            own = self.lists[a][v]
            own[1] -= 1
            at, last = self.place[i, a], own[0][own[1]]
            own[0][at] = last
            self.place[last, a] = at
        self.size[i] = 0
        self.free.append(i)

    def holding(self, a: int, v: int) -> np.ndarray:
        own = self.lists[a].get(v)
        return np.empty(0, np.int64) if own is None else own[0][: own[1]]

    def count(self, a: int, v: int) -> int:
        own = self.lists[a].get(v)
        return 0 if own is None else own[1]


class Chain:
    def __init__(self, spec: Spec, seed: int, chain: int):
        self.s, self.seed, self.chain, self.iteration = spec, seed, chain, 0
        n, k = spec.x.shape
        rng = self.rng("start")
        self.link = np.arange(n)
        values = (spec.x if spec.start is None else spec.start).astype(np.int32)
        for r, a in np.argwhere(values < 0).tolist():
            values[r, a] = self.pick(spec.emp[a], rng)
        # entities' ids, values, and each record's place among them; or else, once they are asked for, dictionaries
        self._arrays = np.arange(n), values, np.arange(n)
        self._members = self._value = self._by_value = None
        self.next_entity = n
        self.elsewhere = 0  # entities that this chain holds no records of
        self.z = np.zeros((n, k), bool)
        self.theta = np.array([[p.mean() if isinstance(p, Beta) else p for p in spec.theta_prior]] * spec.n_files)
        self.b = [p.mean() if isinstance(p, Gamma) else p for p in spec.b_prior]
        self.phi = [p.copy() for p in spec.phi]
        self.clustering = spec.initial_prior
        self._prepare()

    def _prepare(self) -> None:
        s = self.s
        self.of_e, self.of_r, self.self_p = [], [], []
        self.rows: dict[tuple[int, int], np.ndarray] = {}
        for a, edges in enumerate(s.close):
            by_e: dict[int, dict[int, float]] = {}
            by_r: dict[int, tuple[list[int], list[float]]] = {}
            if edges is not None:
                for e, r, p in zip(*(x.tolist() for x in edges), strict=True):
                    by_e.setdefault(e, {})[r] = p
                    own = by_r.setdefault(r, ([], []))
                    own[0].append(e)
                    own[1].append(p)
            self.of_e.append(by_e)
            self.of_r.append({r: tuple(np.array(c)[np.argsort(es)] for c in (es, ps)) for r, (es, ps) in by_r.items()})
        self.near: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in s.emp]
        self._by_value = None

    # -- entities: arrays between sweeps, dictionaries for what goes entity by entity ----
    def _unfold(self) -> None:
        if self._arrays is None:
            return
        (ids, values, at), self._arrays = self._arrays, None
        self._members = {e: set() for e in ids.tolist()}
        for r, e in enumerate(ids[at].tolist()):
            self._members[e].add(r)
        self._value = dict(zip(ids.tolist(), values.copy(), strict=True))
        self._by_value = None
        self.by_value  # noqa: B018

    def _fold(self) -> None:
        if self._arrays is None:
            ids = np.array(sorted(self._members), np.int64)
            values = np.array([self._value[e] for e in ids.tolist()], np.int32).reshape(len(ids), -1)
            self._arrays = ids, values, ids.searchsorted(self.link)
            self._members = self._value = self._by_value = None

    @contextmanager
    def lent(self, members: dict[int, set[int]]):
        """``members`` in place of the entities' own, while some are drawn one by one."""
        arrays, self._arrays, self._members = self._arrays, None, members
        try:
            yield
        finally:
            self._arrays, self._members = arrays, None

    @property
    def members(self) -> dict[int, set[int]]:
        self._unfold()
        return self._members

    @members.setter
    def members(self, members: dict[int, set[int]]) -> None:
        self._unfold()
        self._members = members

    @property
    def value(self) -> dict[int, np.ndarray]:
        self._unfold()
        return self._value

    @value.setter
    def value(self, value: dict[int, np.ndarray]) -> None:
        self._unfold()
        self._value, self._by_value = value, None

    @property
    def by_value(self) -> list[dict[int, set[int]]]:
        self._unfold()
        if self._by_value is None:
            self._by_value = [{} for _ in self.s.emp]
            for e, v in self._value.items():
                for a, x in enumerate(v.tolist()):
                    self._by_value[a].setdefault(x, set()).add(e)
        return self._by_value

    def sizes(self) -> np.ndarray:
        if self._arrays is not None:
            return np.bincount(self._arrays[2], minlength=len(self._arrays[0]))
        return np.array([len(m) for m in self._members.values()])

    def independent(self) -> bool:
        """Whether distorted values don't depend on each other, so that links and values are drawn from arrays."""
        return all(map(math.isinf, self.b)) and not any(isinstance(p, Gamma) for p in self.s.b_prior) and bool((self.link >= 0).all())

    @classmethod
    def at(cls, spec: Spec, link: dict[int, int], value: dict[int, np.ndarray], z: np.ndarray, theta: np.ndarray, b: list[float], clustering) -> Chain:
        """A chain in a given state. Records without a link take no part."""
        chain = cls(spec, 0, 0)
        chain.link = np.array([link.get(r, -1) for r in range(len(spec.x))])
        chain.members = {}
        for r, e in link.items():
            chain.members.setdefault(e, set()).add(r)
        chain.value = {e: np.array(value[e]) for e in chain.members}
        chain.z, chain.theta, chain.b, chain.clustering = z, theta, list(b), clustering
        chain.norm = [float((f / (1 - e)).sum()) for f, e in zip(chain.phi, spec.emp, strict=True)]
        chain._prepare()
        chain.by_value  # noqa: B018
        return chain

    def weighed(self, what: str) -> list[tuple[int, int, int, float]]:
        """The weights that the next stages would draw by, those of 0 left out: ``links`` as (record,
        entity, -1, log-weight), ``new`` as (record, -1, -1, log-weight), ``entities`` as
        (entity, attribute, value, log-weight), ``own`` as links to the records' own entities."""
        return list(zip(*(c.tolist() for c in self.weighed_columns(what)), strict=True))

    def weighed_columns(self, what: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same as arrays."""
        keys, others, values, logw = [], [], [], []
        if what == "entities":
            for e in self.members:
                for a in range(len(self.s.emp)):
                    if (found := self.entity_logweights(e, a)) is not None:
                        keys.append(np.full(len(found[0]), e))
                        others.append(np.full(len(found[0]), a))
                        values.append(found[0])
                        logw.append(found[1])
            keys, others, values, logw = (np.concatenate(c) if c else np.empty(0) for c in (keys, others, values, logw))
        for r in np.flatnonzero(self.link >= 0).tolist() if what != "entities" else ():
            e = int(self.link[r])
            held = self.value[e]
            self.detach(r)
            if what == "new":
                options, weights = [-1], [self.new_logweight(r)]
            else:
                options = [o for o in self.candidates(r) if what == "links" or o == e]
                weights = [self.link_logweight(r, o) for o in options]
            keys += [r] * len(options)
            others += options
            logw += weights
            if e not in self.members:
                self.members[e], self.value[e] = set(), held
                for a, x in enumerate(held.tolist()):
                    self.by_value[a].setdefault(x, set()).add(e)
            self.members[e].add(r)
        keys, others, logw = np.array(keys, np.int64), np.array(others, np.int64), np.array(logw, float)
        values = np.array(values, np.int64) if what == "entities" else np.full(len(keys), -1)
        there = np.isfinite(logw)
        return keys[there], others[there], values[there], logw[there]

    def rng(self, stage: str) -> np.random.Generator:
        """One stream for each seed, chain, iteration and stage, so a resumed chain goes on as
        an uninterrupted one does."""
        key = (self.seed * 1_000_003 + self.chain) & (2**64 - 1)
        return np.random.Generator(np.random.Philox(key=[key, self.iteration * 1009 + sum(map(ord, stage))]))

    @staticmethod
    def pick(weights: np.ndarray, rng) -> int:
        """An index in proportion to the weights."""
        w = np.asarray(weights)
        c = w.cumsum()
        if not (len(c) and 0 < c[-1] < math.inf) or w.min() < 0:
            raise ValueError("weights must be finite, not negative, and not all 0")
        return min(int(c.searchsorted(rng.random() * c[-1], "right")), len(c) - 1)

    # -- base distribution of distorted values -------------------------------------
    def p(self, a: int, r: int, e: int) -> float:
        if self.s.close[a] is not None:
            return self.of_e[a].get(e, {}).get(r, 0.0)
        emp = self.s.emp[a]
        if not self.s.exclude[a]:
            return float(emp[r])
        return 0.0 if r == e else float(emp[r] / (1 - emp[e]))

    def expected(self, a: int, r: int) -> float:
        """p(r | e) expected over the entity distribution."""
        emp, phi = self.s.emp[a], self.phi[a]
        if self.s.close[a] is not None:
            es, ps = self.of_r[a].get(r, (np.empty(0, int), np.empty(0)))
            return float((phi[es] * ps).sum())
        if not self.s.exclude[a]:
            return float(emp[r])
        return float(self.norm[a] * emp[r] - phi[r] * emp[r] / (1 - emp[r]))

    def q(self, r: int, a: int, e: int) -> float:
        factor = 1.0 if self.s.close[a] is None else self.s.factor[a][e]
        return float(self.theta[self.s.file[r], a] * factor)

    # -- stages ---------------------------------------------------------------------
    def sweep(self) -> None:
        self.iteration += 1
        if self.independent():
            self._fold()
        else:
            self._unfold()
        self.norm = [float((f / (1 - e)).sum()) for f, e in zip(self.phi, self.s.emp, strict=True)]
        self.update_prior(self.rng("prior"))
        self.update_links(self.rng("links"))
        self.update_entities(self.rng("entities"))
        self.update_phi(self.rng("phi"))
        self.update_concentrations(self.rng("concentrations"))
        alternative = self.update_distortions(self.rng("distortions"))
        self.update_theta(alternative, self.rng("theta"))

    def update_prior(self, rng) -> None:
        prior, now = self.s.prior, self.clustering
        sizes = self.sizes()
        n, k = int(sizes.sum()), len(sizes)
        if isinstance(prior, PitmanYor):
            alpha, d = now.alpha, now.d
            i = np.arange(1, k)
            seated = rng.random(k - 1) < alpha / (alpha + d * i)
            if isinstance(prior.alpha, Gamma):
                w = rng.beta(alpha + 1, max(n - 1, 1e-9))
                alpha = rng.gamma(prior.alpha.shape + seated.sum(), 1 / (prior.alpha.rate - math.log(w)))
            if isinstance(prior.d, Beta):
                j = np.concatenate([np.arange(1, c) for c in sizes[sizes > 1].tolist()]) if n > k else np.empty(0)
                fails = (rng.random(len(j)) < 1 - (j - 1) / (j - d)).sum()
                d = rng.beta(prior.d.a + (~seated).sum(), prior.d.b + fails)
            self.clustering = PitmanYor(max(alpha, 1e-12), min(d, 1 - 1e-12))
        elif not math.isinf(now.kappa):
            m, kappa = now.m, now.kappa
            w = max(rng.beta(m * kappa + 1, max(n - 1, 1e-9)), 1e-300)
            if isinstance(prior.kappa, Gamma):
                j = np.concatenate([np.arange(1, c) for c in sizes[sizes > 1].tolist()]) if n > k else np.empty(0)
                hits = (rng.random(len(j)) < kappa / (kappa + j)).sum()
                kappa = max(rng.gamma(prior.kappa.shape + k - 1 + hits, 1 / (prior.kappa.rate - m * math.log(w))), 1e-12)
            if not isinstance(prior.m, int):
                m = int(rng.negative_binomial(prior.m.size + k - 1, 1 - (1 - prior.m.prob) * w**kappa)) + k
            self.clustering = GeneralizedCoupon(m, kappa)

    def candidates(self, r: int):
        sets = []
        for a, x in enumerate(self.s.x[r].tolist()):
            if x < 0:
                continue
            if not self.z[r, a]:
                sets.append(self.by_value[a].get(x, set()))
            elif self.s.close[a] is not None:
                near = self.of_r[a].get(x, ((), ()))[0]
                sets.append(set().union(*[self.by_value[a].get(int(e), ()) for e in near]))
        if not sets:
            return list(self.members)
        sets.sort(key=len)
        return sorted(set.intersection(*sets))

    def link_logweight(self, r: int, e: int) -> float:
        """For an entity that r has been taken out of; -inf if it can't be."""
        total = math.log(self.clustering.existing(len(self.members[e])))
        for a, x in enumerate(self.s.x[r].tolist()):
            if x < 0 or not self.z[r, a]:
                continue
            p, b = self.p(a, x, int(self.value[e][a])), self.b[a]
            if not math.isinf(b):
                mates = [m for m in self.members[e] if self.z[m, a] and self.s.x[m, a] >= 0]
                p = (sum(self.s.x[m, a] == x for m in mates) + b * p) / (len(mates) + b)
            if p <= 0:
                return -math.inf
            total += math.log(p)
        return total

    def new_logweight(self, r: int) -> float:
        w = self.clustering.new(len(self.members) + self.elsewhere)
        total = math.log(w) if w > 0 else -math.inf
        for a, x in enumerate(self.s.x[r].tolist()):
            if x >= 0:
                p = self.expected(a, x) if self.z[r, a] else self.phi[a][x]
                total += math.log(p) if p > 0 else -math.inf
        return total

    def detach(self, r: int) -> None:
        e = int(self.link[r])
        self.members[e].discard(r)
        if not self.members[e]:
            del self.members[e]
            for a, x in enumerate(self.value.pop(e).tolist()):
                self.by_value[a][x].discard(e)

    def weighed_links(self, r: int, held: Entities) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of a record that has been taken out and their log-weights: those of
        ``candidates`` and ``link_logweight``, all at once."""
        s, z = self.s, self.z[r].tolist()
        shown = [(a, x) for a, x in enumerate(s.x[r].tolist()) if x >= 0]
        none = (np.empty(0, np.int64), np.empty(0))
        least, start = None, None
        for a, x in shown:
            if z[a] and s.close[a] is None:
                continue
            own = self.of_r[a].get(x, none)[0].tolist() if z[a] else [x]
            n = sum(held.count(a, v) for v in own)
            if least is None or n < least:
                least, start = n, (a, own)
        if start is None:
            found = np.flatnonzero(held.size)
        else:
            found = np.concatenate([held.holding(start[0], v) for v in start[1]]) if start[1] else none[0]
        for a, x in shown:
            if not z[a] and a != start[0]:
                found = found[held.values[found, a] == x]
        if any(z[a] and not math.isinf(self.b[a]) for a, _ in shown):
            for a, x in shown:
                if z[a] and s.close[a] is not None:
                    found = found[self.near_p(a, x, held.values[found, a]) > 0]
            options = np.sort(held.ids[found])
            return options, np.array([self.link_logweight(r, e) for e in options.tolist()], float)
        logw, w = np.zeros(len(found)), self.clustering.existing(held.size[found].astype(float))
        with np.errstate(divide="ignore"):
            for n, (a, x) in enumerate(shown, 1):
                if z[a]:
                    values = held.values[found, a]
                    if s.close[a] is not None:
                        w = w * self.near_p(a, x, values)
                    elif s.exclude[a]:
                        w = w * s.emp[a][x] / (1 - s.emp[a][values])
                        w[values == x] = 0.0
                    else:
                        w = w * s.emp[a][x]
                if n % 8 == 0:  # a product of many small numbers would become 0
                    logw, w = logw + np.log(w), np.ones(len(found))
            return held.ids[found], logw + np.log(w)

    def near_p(self, a: int, x: int, values: np.ndarray) -> np.ndarray:
        """p(x | each value) for an attribute with a distance."""
        if len(self.s.emp[a]) > 1024:
            es, ps = self.of_r[a].get(x, (np.empty(0, np.int64), np.empty(0)))
            if not len(es):
                return np.zeros(len(values))
            at = np.minimum(es.searchsorted(values), len(es) - 1)
            return np.where(es[at] == values, ps[at], 0.0)
        row = self.rows.get((a, x))
        if row is None:
            row = self.rows[a, x] = np.zeros(len(self.s.emp[a]))
            if x in self.of_r[a]:
                row[self.of_r[a][x][0]] = self.of_r[a][x][1]
        return row[values]

    def update_links(self, rng) -> None:
        if self._arrays is not None:
            ids, values, at = self._arrays = sweep.update_links(self, *self._arrays, rng)
            self.next_entity += len(self.link)
            self.link = ids[at]
            return
        held = Entities(self.value, self.members, len(self.s.x), len(self.s.emp))
        for r in range(len(self.s.x)):
            e = int(self.link[r])
            self.detach(r)
            if e in self.members:
                held.size[held.slot[e]] -= 1
            else:
                held.drop(e)
            options, logw = self.weighed_links(r, held)
            logw = np.append(logw, self.new_logweight(r))
            k = self.pick(np.exp(logw - logw.max()), rng)
            if k < len(options):
                e = int(options[k])
            else:
                e = self.next_entity
                self.next_entity += 1
                self.members[e], self.value[e] = set(), self.new_values(r, rng)
                held.add(e, self.value[e])
                for a, x in enumerate(self.value[e].tolist()):
                    self.by_value[a].setdefault(x, set()).add(e)
            self.members[e].add(r)
            held.size[held.slot[e]] += 1
            self.link[r] = e

    def new_values(self, r: int, rng) -> np.ndarray:
        out = self.s.x[r].copy()
        for a, x in enumerate(out.tolist()):
            if x < 0:
                out[a] = self.pick(self.phi[a], rng)
            elif self.z[r, a] and self.s.close[a] is not None:
                es, ps = self.of_r[a][x]
                out[a] = es[self.pick(self.phi[a][es] * ps, rng)]
            elif self.z[r, a]:
                w = self.phi[a].copy()
                if self.s.exclude[a]:
                    w = w / (1 - self.s.emp[a])
                    w[x] = 0
                out[a] = self.pick(w, rng)
        return out

    def entity_logweights(self, e: int, a: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Support and log-weights of an entity's value; None if nothing was observed."""
        seen = [r for r in sorted(self.members[e]) if self.s.x[r, a] >= 0]
        if not seen:
            return None
        values = {int(self.s.x[r, a]) for r in seen}
        alone = None  # p over the support, if there is one observed value
        if self.s.close[a] is None:
            support = np.arange(len(self.s.emp[a]))
        elif len(values) == 1:
            support, alone = self.around(a, *values)
        else:
            support = np.array(sorted(values.union(*[self.of_r[a].get(v, ((), ()))[0] for v in values])), int)
        with np.errstate(divide="ignore"):
            logw = np.log(self.phi[a][support])
            b = self.b[a]
            before, same = np.zeros(len(support)), {}
            emp = self.s.emp[a]
            for r in seen:
                x = int(self.s.x[r, a])
                theta = self.theta[self.s.file[r], a]
                q = theta * (1.0 if self.s.close[a] is None else self.s.factor[a][support])
                if self.s.close[a] is None:
                    p = emp[x] / (1 - emp[support]) if self.s.exclude[a] else np.full(len(support), emp[x])
                elif alone is not None:
                    p = alone
                else:
                    p = np.array([self.of_e[a].get(int(v), {}).get(x, 0.0) for v in support])
                differs = support != x
                if math.isinf(b):
                    off = p
                else:
                    off = (same.get(x, 0) * differs + b * p) / (before + b)
                on = 1 - q if self.s.exclude[a] else 1 - q + q * p
                logw = logw + np.log(np.where(differs, q * off, on))
                before += differs
                same[x] = same.get(x, 0) + 1
        return support, logw

    def around(self, a: int, x: int) -> tuple[np.ndarray, np.ndarray]:
        """The values that an entity whose records all show x may have, and p(x | each)."""
        found = self.near[a].get(x)
        if found is None:
            es, ps = self.of_r[a].get(x, (np.empty(0, int), np.empty(0)))
            if x not in es:
                es, ps = np.append(es, x), np.append(ps, 0.0)
            order = np.argsort(es)
            found = self.near[a][x] = es[order].astype(int), ps[order]
        return found

    def baseline(self, a: int, m: int, made: dict) -> tuple[np.ndarray, float]:
        """What the weights of all values that none of m records shows have in common, for an
        attribute without a distance; ``made`` keeps them while phi stays the same."""
        if (a, m) not in made:
            base = self.phi[a] / (1 - self.s.emp[a]) ** m if self.s.exclude[a] else self.phi[a]
            made[a, m] = base, float(base.sum())
        return made[a, m]

    def entity_parts(self, e: int, a: int, made: dict) -> tuple[list[int], list[float], float] | None:
        """For an attribute without a distance whose distorted values are independent: the observed
        values, their weights, and the weight of all others together. Weights are divided by that of
        a distorted observation of each record; None if nothing was observed."""
        seen = [r for r in self.members[e] if self.s.x[r, a] >= 0]
        if not seen:
            return None
        emp, phi, exclude = self.s.emp[a], self.phi[a], self.s.exclude[a]
        base, total = self.baseline(a, len(seen), made)
        values = sorted({int(self.s.x[r, a]) for r in seen})
        weights = []
        for v in values:
            w = float(phi[v])
            for r in seen:
                x, theta = int(self.s.x[r, a]), float(self.theta[self.s.file[r], a])
                if x != v:
                    w *= 1 / (1 - float(emp[v])) if exclude else 1.0
                else:
                    on = 1 - theta if exclude else 1 - theta + theta * float(emp[x])
                    w *= on / (theta * float(emp[x])) if theta > 0 else math.inf
            weights.append(w)
        return values, weights, max(total - sum(float(base[v]) for v in values), 0.0)

    def draw_value(self, e: int, a: int, rng, made: dict) -> int:
        if self.s.close[a] is None and math.isinf(self.b[a]):
            # in two levels: an unobserved value is rarely drawn, and only then are all read
            parts = self.entity_parts(e, a, made)
            if parts is None:
                return self.pick(self.phi[a], rng)
            values, weights, others = parts
            total = sum(weights) + others
            if 0 < total < math.inf:
                u = rng.random() * total
                for v, w in zip(values, weights, strict=True):
                    u -= w
                    if u < 0:
                        return v
                rest = self.baseline(a, sum(self.s.x[r, a] >= 0 for r in self.members[e]), made)[0].copy()
                rest[values] = 0
                return self.pick(rest, rng) if rest.any() else values[-1]
        if self.s.close[a] is not None and len(self.members[e]) == 1:
            # one record: no concentration counts, and no logarithms are needed
            (r,) = self.members[e]
            x = int(self.s.x[r, a])
            if x < 0:
                return self.pick(self.phi[a], rng)
            support, p = self.around(a, x)
            q = float(self.theta[self.s.file[r], a]) * self.s.factor[a][support]
            on = 1 - q if self.s.exclude[a] else 1 - q + q * p
            return int(support[self.pick(self.phi[a][support] * np.where(support == x, on, q * p), rng)])
        found = self.entity_logweights(e, a)
        if found is None:
            return self.pick(self.phi[a], rng)
        support, logw = found
        return int(support[self.pick(np.exp(logw - logw.max()), rng)])

    def update_entities(self, rng) -> None:
        if self._arrays is not None:
            sweep.update_entities(self, *self._arrays[1:], rng)
            return
        made: dict = {}
        for e in sorted(self.members):
            for a in range(len(self.s.emp)):
                new = self.draw_value(e, a, rng, made)
                old = int(self.value[e][a])
                if new != old:
                    self.by_value[a][old].discard(e)
                    self.by_value[a].setdefault(new, set()).add(e)
                    self.value[e][a] = new

    def update_phi(self, rng) -> None:
        for a, alpha in enumerate(self.s.phi_alpha):
            if alpha is not None:
                counts = np.bincount(self._arrays[1][:, a] if self._arrays is not None else [v[a] for v in self.value.values()], minlength=len(alpha))
                self.phi[a] = rng.dirichlet(alpha + counts)
        self.norm = [float((f / (1 - e)).sum()) for f, e in zip(self.phi, self.s.emp, strict=True)]

    def update_concentrations(self, rng) -> None:
        for a, prior in enumerate(self.s.b_prior):
            if not isinstance(prior, Gamma):
                continue
            b, shape, rate = self.b[a], prior.shape, prior.rate
            for e, members in self.members.items():
                value, seen, differ = int(self.value[e][a]), {}, 0
                for r in sorted(members):
                    x = int(self.s.x[r, a])
                    if x < 0 or x == value:
                        continue
                    differ += 1
                    i = seen[x] = seen.get(x, 0) + 1
                    base = b * self.p(a, x, value)
                    shape += 1 if i == 1 else float(rng.random() < base / (base + i - 1))
                if differ:
                    rate -= math.log(max(rng.beta(b, differ), 1e-300))
            self.b[a] = max(rng.gamma(shape, 1 / rate), 1e-12)

    def update_distortions(self, rng) -> np.ndarray:
        """New indicators; returns which undistorted values count in the update of theta."""
        s = self.s
        n, k = s.x.shape
        values = self._arrays[1][self._arrays[2]] if self._arrays is not None else np.array([self.value[int(e)] for e in self.link])
        u, v = rng.random((n, k)), rng.random((n, k))
        alternative = np.zeros((n, k), bool)
        for a in range(k):
            x, theta = s.x[:, a], self.theta[s.file, a]
            prob = np.where(x < 0, theta, 1.0)
            same = (x >= 0) & (x == values[:, a])
            if s.exclude[a]:
                prob[same] = 0.0
            else:
                held, which = np.unique(x[same], return_inverse=True)
                p = np.array([self.p(a, y, y) for y in held.tolist()], float)[which]
                t = theta[same]
                prob[same] = t * p / np.maximum(t * p + 1 - t, 1e-300)
            self.z[:, a] = u[:, a] < prob
            m = np.ones(n) if s.close[a] is None else s.factor[a][values[:, a]]
            chance = np.where(m == 1, 1.0, m * (1 - theta) / np.maximum(m * (1 - theta) + 1 - m, 1e-300))
            alternative[:, a] = ~self.z[:, a] & (v[:, a] < chance)
        return alternative

    def update_theta(self, alternative: np.ndarray, rng) -> None:
        for f in range(self.s.n_files):
            of = self.s.file == f
            for a, prior in enumerate(self.s.theta_prior):
                if isinstance(prior, Beta):
                    self.theta[f, a] = rng.beta(prior.a + self.z[of, a].sum(), prior.b + alternative[of, a].sum())

    # -- what is kept of a sample -------------------------------------------------------
    def history(self, links: bool = True) -> list[tuple[str, int | None, int | None, str | None, float]]:
        """(table, i, j, name, value): links by record, counts and parameters."""
        out = [("links", r, None, None, float(e)) for r, e in enumerate(self.link.tolist())] if links else []
        out.append(("n_linked_ents", None, None, None, float(len(self.sizes()))))
        for f in range(self.s.n_files):
            for a in range(len(self.s.emp)):
                out.append(("distort_probs", f, a, None, float(self.theta[f, a])))
                out.append(("distort_counts", f, a, None, float(self.z[self.s.file == f, a].sum())))
        out += [("distort_dist_concs", None, a, None, float(b)) for a, b in enumerate(self.b)]
        out += [("clust_params", None, None, name, float(getattr(self.clustering, name))) for name in self.s.prior.random()]
        return out

    def __getstate__(self):
        state = {k: v for k, v in self.__dict__.items() if k not in ("of_e", "of_r", "self_p", "_by_value", "near", "rows", "s")}
        if self._arrays is not None:  # links are the entities' ids at the records' places
            ids, values, at = self._arrays
            del state["link"], state["_arrays"], state["z"]
            state["packed"] = [(zlib.compress(c.tobytes(), 1), c.dtype.str, c.shape) for c in (ids, values, at, self.z)]
        return state

    def __setstate__(self, state):
        packed = state.pop("packed", None)
        self.__dict__.update(state)
        if packed is not None:
            *self._arrays, self.z = [np.frombuffer(zlib.decompress(c), kind).reshape(shape).copy() for c, kind, shape in packed]
            self.link = self._arrays[0][self._arrays[2]]

    def resume(self, spec: Spec) -> Chain:
        self.s = spec
        self._prepare()
        return self


def kept(n_samples: int, thin: int, burnin: int) -> list[int]:
    """Iterations that are saved. With a burn-in the first is iteration ``burnin`` itself."""
    if n_samples < 1 or thin < 1 or burnin < 0:
        raise ValueError("n_samples and thin must be positive, burnin not negative")
    first = burnin if burnin else thin
    return [first + thin * k for k in range(n_samples)]
