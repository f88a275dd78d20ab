"""A chain's links and entity values, drawn from arrays, where distorted values are independent.

What a link update may create is known before it: the values of a record's new entity depend on no link.
So the entities there are and those there may be ("slots") are sorted once a sweep by the values that
records of a kind bind, and a record finds its slots as a range. A link is drawn by rejection: from a
bound of all its slots' weights and the new entity's weight, accepted as the weight is to its bound, and
drawn anew otherwise. After many rejections the range is weighed whole. Both are exact.

A prior's weight of an entity with n records is a + b (n - 1): each slot counts a, and each record beyond
an entity's first is a token that counts b.
"""

from __future__ import annotations

import math

import numpy as np

#: Sets of attributes that slots are sorted by, at most; records that bind others use a part of theirs.
KINDS = 32
#: Keys of slots stay below this.
ROOM = 2**62
#: Rejections after which a record's slots are weighed, and one more for each hundred of them.
TRIES = 30


def skipping(weights: np.ndarray, without: np.ndarray, rng) -> np.ndarray:
    """For each of ``without`` another index, in proportion to the weights."""
    upto = weights.cumsum()
    own = weights[without]
    u = rng.random(len(without)) * (upto[-1] - own)
    u = np.where(u < upto[without] - own, u, u + own)
    out = np.minimum(upto.searchsorted(u, "right"), len(weights) - 1)
    for i in np.flatnonzero((out == without) | (weights[out] <= 0)).tolist():  # rounding, or no weight at all
        left = weights.copy()
        left[without[i]] = 0
        if left.any():
            out[i] = int(left.argmax())
    return out


def grouped(keys: np.ndarray):
    """Each key with the places that have it."""
    order = np.argsort(keys, kind="stable")
    held, first = np.unique(keys[order], return_index=True)
    return zip(held.tolist(), np.split(order, first[1:]), strict=True) if len(held) else ()


def drawn(weights: np.ndarray, n: int, rng) -> np.ndarray:
    upto = weights.cumsum()
    return np.minimum(upto.searchsorted(rng.random(n) * upto[-1], "right"), len(weights) - 1)


def fresh_values(chain, rng) -> np.ndarray:
    """The values that each record's new entity would have."""
    s, out = chain.s, chain.s.x.astype(np.int32)
    for a in range(out.shape[1]):
        x, phi = s.x[:, a], chain.phi[a]
        missing, off = np.flatnonzero(x < 0), np.flatnonzero((x >= 0) & chain.z[:, a])
        if len(missing):
            out[missing, a] = drawn(phi, len(missing), rng)
        if not len(off):
            continue
        if s.close[a] is not None:
            for v, at in grouped(x[off]):
                es, ps = chain.of_r[a].get(v, (np.empty(0, int), np.empty(0)))
                w = phi[es] * ps
                if w.sum() > 0:  # else a new entity has no weight
                    out[off[at], a] = es[drawn(w, len(at), rng)]
        elif s.exclude[a]:
            out[off, a] = skipping(phi / (1 - s.emp[a]), x[off], rng)
        else:
            out[off, a] = drawn(phi, len(off), rng)
    return out


def bounds(chain, a: int) -> tuple[np.ndarray, np.ndarray]:
    """By value: the expected base probability, and the greatest over entities' values."""
    s, emp, phi = chain.s, chain.s.emp[a], chain.phi[a]
    if s.close[a] is not None:
        e, r, p = s.close[a]
        most = np.zeros(len(emp))
        np.maximum.at(most, r, p)
        return np.bincount(r, phi[e] * p, len(emp)), most
    if not s.exclude[a]:
        return emp, emp
    return chain.norm[a] * emp - phi * emp / (1 - emp), emp / others_rest(emp)


def others_rest(emp: np.ndarray) -> np.ndarray:
    """By value: the least 1 - emp of the other values."""
    if len(emp) < 2:
        return np.ones(len(emp))
    first, second = np.sort(emp)[::-1][:2]
    return 1 - np.where(np.arange(len(emp)) == emp.argmax(), second, first)


def kinds_of(told: np.ndarray, domains: list[int]) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """The sets of attributes to sort by, and each record's: all that it binds, or a part."""
    n, k = told.shape
    if k <= 62:
        codes, first, which, often = np.unique(told @ (1 << np.arange(k)), return_index=True, return_inverse=True, return_counts=True)
    else:
        _, first, which, often = np.unique(told, axis=0, return_index=True, return_inverse=True, return_counts=True)
    wanted = []
    for r in first.tolist():
        own, room = [], 1
        for a in sorted(np.flatnonzero(told[r]).tolist(), key=lambda a: -domains[a]):
            if room * domains[a] < ROOM:
                own.append(a)
                room *= domains[a]
        wanted.append(tuple(sorted(own)))
    often_by: dict = {}
    for w, c in zip(wanted, often.tolist(), strict=True):
        often_by[w] = often_by.get(w, 0) + c
    sets = sorted(often_by, key=lambda w: -often_by[w])
    if len(sets) > KINDS:
        sets = list(dict.fromkeys([*sets[:KINDS], (), *[(a,) for w in sets for a in w]]))
    place = {w: i for i, w in enumerate(sets)}
    fits = lambda w: max((v for v in sets if set(v) <= set(w)), key=len)
    return sets, np.array([place[w] if w in place else place[fits(w)] for w in wanted])[which.reshape(-1)]


class Tokens:
    """Records beyond the first of their entity, by the entity's values."""

    def __init__(self, values: np.ndarray, radix: list[list[tuple[int, int]]], sole: memoryview):
        self.values, self.radix, self.sole = values, radix, sole
        self.by: list[dict[int, list[int]]] = [{} for _ in radix]
        self.place: list[dict[int, int]] = [{} for _ in radix]
        self.crew: dict[int, list[int]] = {}
        self.keys: dict[int, list[int]] = {}

    def join(self, r: int, slot: int) -> None:
        """r comes to an entity that has a record."""
        crew = self.crew.get(slot)
        if crew is None:
            crew = self.crew[slot] = [self.sole[slot]]
            value = self.values[slot].tolist()
            self.keys[slot] = [sum(value[a] * m for a, m in own) for own in self.radix]
        crew.append(r)
        for key, by, place in zip(self.keys[slot], self.by, self.place, strict=True):
            own = by.setdefault(key, [])
            place[r] = len(own)
            own.append(r)

    def leave(self, r: int, slot: int) -> None:
        """r goes from an entity that has others."""
        crew = self.crew[slot]
        gone = crew[1] if crew[0] == r else r
        crew.remove(r)
        for key, by, place in zip(self.keys[slot], self.by, self.place, strict=True):
            own, at = by[key], place.pop(gone)
            last = own.pop()
            if last != gone:
                own[at] = last
                place[last] = at
            elif not own:
                del by[key]
        if len(crew) == 1:
            self.sole[slot] = crew[0]
            del self.crew[slot], self.keys[slot]


def update_links(chain, ids: np.ndarray, values: np.ndarray, at: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entities' ids, their values and each record's place among them, after all links are drawn
    in turn."""
    s, z, m = chain.s, chain.z, len(ids)
    n, k = s.x.shape
    uniforms = rng.random(n)
    values = np.concatenate([values, fresh_values(chain, rng)])
    shown = s.x >= 0
    told, off = shown & ~z, shown & z
    logratio, closed = np.zeros(n), np.zeros(n, bool)
    tops = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for a in range(k):
            expected, most = bounds(chain, a)
            tops.append(most)
            as_told, as_off = np.log(chain.phi[a]), np.log(expected) - np.where(most > 0, np.log(most), 0.0)
            logratio[told[:, a]] += as_told[s.x[told[:, a], a]]
            logratio[off[:, a]] += as_off[s.x[off[:, a], a]]
            closed[off[:, a]] |= most[s.x[off[:, a], a]] <= 0
    ratio = np.where(logratio == -math.inf, 0.0, np.exp(np.clip(logratio, -690, 690)))

    sets, which = kinds_of(told, [len(p) for p in s.emp])
    low, slots, own_key, orders, radix = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
    for i, kind in enumerate(sets):
        key, room, of, own = np.zeros(len(values), np.int64), 1, np.flatnonzero(which == i), []
        for a in kind:
            key += values[:, a].astype(np.int64) * room
            own_key[of] += s.x[of, a].astype(np.int64) * room
            own.append((a, room))
            room *= len(s.emp[a])
        order = np.argsort(key) if kind else np.arange(len(key))
        key = key[order]
        low[of] = key.searchsorted(own_key[of])
        slots[of] = key.searchsorted(own_key[of], "right") - low[of]
        orders.append(order.astype(np.int32 if len(order) < 2**31 else np.int64))
        del order, key
        radix.append(own)
    slots[closed] = 0
    del logratio, closed, shown, told, off

    held = np.zeros(m + n, np.int64)
    held[:m] = np.bincount(at, minlength=m)
    at = at.copy()
    sole = np.concatenate([np.zeros(m, np.int64), np.arange(n)])
    sole[at] = np.arange(n)  # the last of an entity's
    tokens = Tokens(values, radix, memoryview(sole))
    for r in np.flatnonzero((held[at] > 1) & (sole[at] != np.arange(n))).tolist():
        tokens.join(r, int(at[r]))
    size, place, by = memoryview(held), memoryview(at), tokens.by
    rest = [(1 - p).tolist() for p in s.emp]
    least = [others_rest(p).tolist() for p in s.emp]
    constant = [c is None for c in s.close]
    bound = [set(kind) for kind in sets]

    def accepted(r: int, slot: int, i: int) -> float:
        """The weight of a slot to its bound."""
        w, mine = 1.0, values[slot].tolist()
        for a, x in enumerate(s.x[r].tolist()):
            if x < 0 or a in bound[i]:
                continue
            y = mine[a]
            if not z[r, a]:
                w *= x == y
            elif not constant[a]:
                w *= chain.of_e[a].get(y, {}).get(x, 0.0) / tops[a][x]
            elif s.exclude[a]:
                w *= 0.0 if x == y else least[a][x] / rest[a][y]
            if w == 0.0:
                break
        return w

    def weighed(r: int, found: np.ndarray, i: int) -> np.ndarray:
        """``accepted`` of many."""
        w = np.ones(len(found))
        for a, x in enumerate(s.x[r].tolist()):
            if x < 0 or a in bound[i]:
                continue
            y = values[found, a]
            if not z[r, a]:
                w *= x == y
            elif not constant[a]:
                w *= chain.near_p(a, x, y) / tops[a][x]
            elif s.exclude[a]:
                with np.errstate(divide="ignore"):
                    w *= np.where(x == y, 0.0, least[a][x] / (1 - s.emp[a][y]))
        return w

    prior, elsewhere = chain.clustering, chain.elsewhere
    first = float(prior.existing(1))
    more = float(prior.existing(2)) - first
    entities, random = int((held > 0).sum()), rng.random
    for start in range(0, n, 1 << 16):
        part = slice(start, min(n, start + (1 << 16)))
        for r, i, lo, count, key, ratio_r, u in zip(range(start, part.stop), which[part].tolist(), low[part].tolist(), slots[part].tolist(), own_key[part].tolist(), ratio[part].tolist(), uniforms[part].tolist(), strict=True):
            e = place[r]
            left = size[e] = size[e] - 1
            if left:
                tokens.leave(r, e)
            else:
                entities -= 1
            own = by[i].get(key) if count else None
            new = max(float(prior.new(entities + elsewhere)), 0.0) * ratio_r
            plain = first * count
            total = plain + more * len(own) + new if own else plain + new
            u *= total
            tries = 0
            while u >= new and count and total > 0:
                t = u - new
                if t < plain:
                    slot = int(orders[i][lo + min(int(t / first), count - 1)])
                elif own and more > 0:
                    slot = place[own[min(int((t - plain) / more), len(own) - 1)]]
                else:
                    slot = int(orders[i][lo + count - 1])
                if size[slot] and ((w := accepted(r, slot, i)) >= 1.0 or random() < w):
                    break
                tries += 1
                if tries > TRIES + count // 100:
                    found = orders[i][lo : lo + count]
                    found = found[held[found] > 0]
                    w = (first + more * (held[found] - 1)) * weighed(r, found, i)
                    k = chain.pick(np.append(w, new), rng)
                    slot = int(found[k]) if k < len(found) else -1
                    break
                u = random() * total
            else:
                if not new > 0:
                    raise ValueError("weights must be finite, not negative, and not all 0")
                slot = -1
            if slot < 0:
                slot = m + r
                entities += 1
            elif size[slot]:
                tokens.join(r, slot)
            size[slot] += 1
            place[r] = slot
    alive = np.flatnonzero(held)
    again = np.full(m + n, -1)
    again[alive] = np.arange(len(alive))
    return np.concatenate([ids, chain.next_entity + np.arange(n)])[alive], values[alive], again[at]


def update_entities(chain, values: np.ndarray, at: np.ndarray, rng) -> None:
    """Draws the entities' values, in place. Those of one record are drawn together."""
    s = chain.s
    size = np.bincount(at, minlength=len(values))
    single = np.flatnonzero(size[at] == 1)
    shared = np.flatnonzero(size[at] > 1)
    members = {e: set(shared[own].tolist()) for e, own in grouped(at[shared])}
    made: dict = {}
    for a in range(values.shape[1]):
        x, phi, emp, theta = s.x[single, a], chain.phi[a], s.emp[a], chain.theta[s.file[single], a]
        new = np.empty(len(single), np.int64)
        seen, unseen = np.flatnonzero(x >= 0), np.flatnonzero(x < 0)
        if s.close[a] is None:
            v, t = x[seen], theta[seen]
            base, total = chain.baseline(a, 1, made)
            on = 1 - t if s.exclude[a] else 1 - t + t * emp[v]
            # times theta emp, so that theta may be 0
            stay, go = phi[v] * on, np.maximum(total - base[v], 0.0) * t * emp[v]
            moves = ~(rng.random(len(seen)) * (stay + go) < stay) & (go > 0)
            if not np.all((stay + go > 0) & np.isfinite(stay + go)):
                raise ValueError("weights must be finite, not negative, and not all 0")
            new[seen] = v
            new[seen[moves]] = skipping(base, v[moves], rng)
        else:
            for key, own in grouped(x[seen].astype(np.int64) * s.n_files + s.file[single][seen]):
                v, f = divmod(key, s.n_files)
                support, p = chain.around(a, v)
                q = float(chain.theta[f, a]) * s.factor[a][support]
                on = 1 - q if s.exclude[a] else 1 - q + q * p
                w = phi[support] * np.where(support == v, on, q * p)
                if not 0 < w.sum() < math.inf:
                    raise ValueError("weights must be finite, not negative, and not all 0")
                new[seen[own]] = support[drawn(w, len(own), rng)]
        new[unseen] = drawn(phi, len(unseen), rng)
        values[at[single], a] = new
    with chain.lent(members):
        for e in members:
            for a in range(values.shape[1]):
                values[e, a] = chain.draw_value(e, a, rng, made)
