"""The operators against plain versions, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import fingerprints, gif, graph, jaccard, language, packing, pieces, pii, sharding, suffix, toxicity
from kindred.llm.common import held_out

AWKWARD = "doc_id long, text string, lang string, score double, component_id string"


@pytest.fixture(scope="session")
def docs(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, long = text(60), text(400)
    rows = [(k, text(r.randint(1, 80))) for k in range(40)]
    rows += [(100 + k, f"{text(5)} {passage} {text(6)}") for k in range(8)]
    rows += [(200 + k, long) for k in range(4)]
    words = long.split()
    for k in range(12):
        own = list(words)
        for _ in range(k // 3):
            own[r.randrange(len(own))] = "edited"
        rows.append((300 + k, " ".join(own)))
    rows += [(400, None), (401, ""), (402, "   \n"), (403, "ab"), (404, "ünïcödé ▁ 日本 \U0001f600" * 30), (405, "x" * 5000), (405, "x" * 5000), (406, "repeat " * 400), (None, "no key at all"), (407, text(3000))]
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, 0.5, "clash") for k, (i, t) in enumerate(rows)], AWKWARD)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], AWKWARD)


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_empty_tables(nothing):
    assert language.identify(nothing, language.train(nothing)).count() == 0
    for f in (fingerprints.fingerprint_chain, gif.store_texts, pieces.encode_digest, packing.pack, suffix.remove_repeats_digest, sharding.shard_documents, pii.detect, jaccard.join):
        assert f(nothing).count() == 0, f


def test_language(docs, spark):
    train = spark.createDataFrame([(k, t, lang) for k in range(40) for lang, t in (("a", "the then there other weather " * 3), ("b", "quel que quoi lequel oui " * 3))], "doc_id long, text string, lang string")
    profiles = language.train(train)
    assert profiles.predict("whether the other")[0] == "a" and profiles.predict("quelque")[0] == "b"
    assert profiles.predict(None) == profiles.predict("12 34 !") == ("und", 0.0)
    codes, counts = language.grams("Aa b")
    plain = {}
    for n in (1, 2, 3):
        for k in range(len(" aa b ") - n + 1):
            g = " aa b "[k : k + n]
            if g != " ":
                plain[g] = plain.get(g, 0) + 1
    assert sorted(plain.values()) == sorted(counts.tolist()) and len(codes) == len(plain)
    assert language.identify(docs, profiles).count() == docs.count()


def test_language_against_plain_ranks(docs, spark):
    """Distances over dictionaries of ranks, n-gram by n-gram, give the same language and score."""
    r = random.Random(6)
    syllables = {"a": ["the", "ing", "wh"], "b": ["que", "oui", "eau"], "c": ["sch", "ein", "der"]}
    train = spark.createDataFrame([(k, " ".join("".join(r.choice(s) for _ in range(2)) for _ in range(30)), lang) for k in range(60) for lang, s in syllables.items()], "doc_id long, text string, lang string")
    profiles = language.train(train, top=40)
    lists = {lang: {int(profiles.vocabulary[v]): int(row[v]) for v in np.flatnonzero(row >= 0)} for lang, row in zip(profiles.names, profiles.ranks, strict=True)}

    def plain(text):
        codes, counts = language.grams(text or "")
        own = [c for _, c in sorted((-n, c) for c, n in zip(codes.tolist(), counts.tolist(), strict=True))][:40]
        if not own:
            return "und", 0.0
        far = {lang: sum(min(abs(ranks[c] - k), 40) if c in ranks else 40 for k, c in enumerate(own)) for lang, ranks in lists.items()}
        best = min(sorted(far), key=far.get)
        return best, 1 - far[best] / (40 * len(own))

    both = docs.select("doc_id", "text").unionByName(train.select("doc_id", "text"))
    want = sorted((plain(x.text) for x in both.collect()), key=str)
    got = sorted(((x.lang_pred, x.score) for x in language.identify(both, profiles).collect()), key=str)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
    # rows of the held-out fold teach nothing
    fold = train.filter(~(held_out(F.col("doc_id"))))
    again = language.train(fold, top=40)
    assert again.names == profiles.names and (again.ranks == profiles.ranks).all() and (again.vocabulary == profiles.vocabulary).all()


def test_prefix_hashes():
    r = random.Random(1)
    a = "".join(r.choice("ab") for _ in range(300))
    b = a[:150] + "c" + a[151:]
    p, q = fingerprints.Prefixes.of(a), fingerprints.Prefixes.of(b)
    for i, k in ((0, 0), (10, 10), (151, 151), (3, 40)):
        plain = next((n for n in range(min(300 - i, 300 - k)) if a[i + n] != b[k + n]), min(300 - i, 300 - k))
        assert p.extension(i, q, k) == plain
    spans = p.spans(16).tolist()
    assert all((spans[i] == spans[j]) == (a[i : i + 16] == a[j : j + 16]) for i in range(0, 280, 7) for j in range(0, 280, 5))


def plain_likeness(a, b):
    """The estimate of the two sets of 16-character spans, from the smallest hashes of their union."""

    def hashed(t):
        p, n = (1 << 31) - 1, min(16, len(t))
        base = fingerprints.BASES[0]
        own = {t[k : k + n] for k in range(len(t) - n + 1)} if t else set()
        return {sum((ord(c) + 1) * pow(base, k, p) for k, c in enumerate(s)) % p * (0x5BD1E995 % p) % p for s in own}

    if a == b:
        return 1.0
    a, b = hashed(a), hashed(b)
    union = sorted(a | b)[:64]
    return sum(h in a and h in b for h in union) / len(union) if a and b else 0.0


def test_fingerprint_chain(docs):
    got = fingerprints.fingerprint_chain(docs, rows_per_range=10).collect()
    order = sorted(((i, t or "") for i, t in texts(docs)), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = {}
    for k, (i, t) in enumerate(order):
        following, cut = order[(k + 1) % len(order)][1], len(t) // 3
        e = t[: len(t) - cut] + following[:cut]
        shared = [next((n for n, (x, y) in enumerate(zip(t, other, strict=False)) if x != y), min(len(t), len(other))) for other in (e, following)]
        marks = [fingerprints.fingerprint(fingerprints.code_points(x)) for x in (t, e, following)]
        near = [plain_likeness(t, other) for other in (e, following)]
        want.setdefault((i, len(t)), set()).add((hashlib.sha256(e.encode()).hexdigest(), marks[0][0], marks[1][0], *shared, *near))
    assert len(got) == len(order)
    for r in got:
        assert (r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.common_edited, r.common_next, r.near_edited, r.near_next) in want[(r.doc_id, r.n_chars)]


def test_gif_round_trip(docs):
    for raw in (b"", b"a", b"ab" * 5000, bytes(range(256)) * 40, random.Random(2).randbytes(200_000)):
        media = gif.text_to_gif(raw)
        assert gif.gif_to_payload(media)[0] == gif.payload_of(raw)
    got = {(r.doc_id, r.n_bytes): r for r in gif.store_texts(docs).collect()}
    for i, t in texts(docs):
        payload = gif.payload_of((t or "").encode())
        r = got[(i, len((t or "").encode()))]
        assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload))


def test_gif_disposal_transparency_interlace(spark):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])

    def frame(pixels, w, h, left=0, disposal=0, clear=None, interlaced=False):
        control = bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), 5, 0, clear or 0, 0])
        packed = gif.lzw_pack(gif.lzw_codes(bytes(pixels), 4), 4)
        return control + bytes([0x2C, left, 0, 0, 0, w, 0, h, 0, 0x40 if interlaced else 0, 2, len(packed)]) + packed + b"\0"

    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x81, 0, 0]) + palette
    media = head + frame([1, 2], 2, 1) + frame([3], 1, 1, disposal=3) + frame([0, 3], 2, 1, clear=0, disposal=2) + frame([2], 1, 1, left=1) + b";"
    shown = [f.canvas[0, :, :].tolist() for f in gif.decode(media)]
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert shown == [[red, green], [blue, green], [red, blue], [[0, 0, 0, 0], green]]
    tall = b"GIF89a" + bytes([1, 0, 8, 0, 0x81, 0, 0]) + palette + frame([0, 1, 2, 2, 3, 3, 3, 3], 1, 8, interlaced=True) + b";"
    assert next(gif.decode(tall)).indices[:, 0].tolist() == [0, 3, 2, 3, 1, 3, 2, 3]
    df = spark.createDataFrame([(1, media), (2, None), (3, b"junk"), (4, media[:-14]), (5, b"GIF89a" + b"\xff" * 4 + b"\0\0\0;")], "id long, media binary")
    assert [r.start_ms for r in gif.frame_table(df, "id", "media").orderBy("frame").collect()] == [0, 50, 100, 150]
    assert {r.media_id for r in gif.media_errors(df, "id", "media").collect()} == {2, 3, 4, 5}
    assert {r.media_id for r in gif.frame_table(df, "id", "media").collect()} == {1}


def test_gif_deferred_clear_code():
    raw, first = random.Random(6).randbytes(60_000), 256
    table, codes, held = {bytes([i]): i for i in range(256)}, [], b""
    for k in range(len(raw)):
        c = raw[k : k + 1]
        if held + c in table:
            held += c
            continue
        codes.append(table[held])
        if len(table) + 2 < 4096:  # once it is full, the table stays as it is
            table[held + c] = len(table) + 2
        held = c
    codes.append(table[held])
    assert len(codes) > 40_000
    widths = gif._bit_starts(first)[0]
    bits = bytearray(f"{first:09b}"[::-1], "ascii")
    for k, c in enumerate([*codes, first, 65, 66, first + 1]):
        # the width after the last clear code
        j = k if k <= len(codes) else k - len(codes) - 1
        bits += f"{c:0{widths[min(j, len(widths) - 1)]}b}"[::-1].encode()
    stream = np.packbits(np.frombuffer(bits, np.uint8) - 48, bitorder="little").tobytes()
    assert gif.lzw_unpack(stream, first) == raw + b"AB"


def test_pieces(docs):
    first = pieces.encode(docs).collect()
    again = pieces.encode(docs.repartition(7), slice_chars=50).collect()
    by = lambda rows: sorted((str(r.doc_id), r.text, r.pieces) for r in rows)
    assert by(first) == by(again)
    assert sorted((str(i), t or "") for i, t in texts(docs)) == sorted((str(r.doc_id), r.text) for r in first)


def test_pieces_are_drawn_by_weight():
    m = pieces.load(pieces.default_model(), 1.0)
    word = "then"
    paths, ids = {}, {t: i for i, t in enumerate(m.text)}

    def walk(at, path, w):
        if at == len(word):
            paths[tuple(path)] = w
        for end in range(at + 1, len(word) + 1):
            if (k := ids.get(word[at:end])) is not None:
                walk(end, [*path, k], w * math.exp(m.logp[k]))

    walk(0, [], 1.0)
    n, seen = 4000, {}
    for x in m.sample([word] * n, [pieces.key_hash(k, 9) for k in range(n)]):
        seen[tuple(x.tolist())] = seen.get(tuple(x.tolist()), 0) + 1
    total = sum(paths.values())
    assert all(abs(seen.get(p, 0) / n - w / total) < 0.03 for p, w in paths.items())


def plain_pieces(m, text, key):
    """Word by word and state by state; the draws are the operator's."""
    ids, longest, at, out = {m.text[i]: int(i) for length in m.tables for i in m.tables[length][1]}, m.longest, 0, []
    for word in re.findall("▁| *[^ ▁]+| +", text):
        spelled = "\0" if word == "▁" else word.replace(" ", "▁")
        total, edges = [0.0], []
        for end in range(1, len(word) + 1):
            into = [(end - k, ids[spelled[end - k : end]]) for k in range(min(end, longest), 0, -1) if spelled[end - k : end] in ids]
            weights = [total[a] + m.logp[i] for a, i in into]
            if spelled[end - 1] not in ids:
                into.append((end - 1, -1))
                weights.append(total[end - 1] + m.fallback * len(word[end - 1].replace(" ", "▁").encode()))
            top = max(weights)
            run = np.cumsum([math.exp(w - top) for w in weights])
            total.append(top + math.log(run[-1]))
            edges.append((into, run / run[-1]))
        end, own = len(word), []
        while end:
            x = (key + (at + end) * 0x9E3779B97F4A7C15) % 2**64
            u = float(int(pieces._mix(np.array([x], np.uint64))[0]) >> 11) * 2.0**-53
            into, odds = edges[end - 1]
            start, i = into[int((u >= odds).sum())]
            own = ([i] if i >= 0 else [m.byte[b] for b in word[start].encode()]) + own
            end = start
        at, out = at + len(word), out + own
    return out


PIECE_TEXTS = ["the then there thenceforth", "", "▁▁ ▁  x ▁y  ", "  two  spaces ", "ünïcödé 日本\n\U0001f600 \0é\x7f", "x" * 70, "the\nthen\nthe other then", "a\tb " * 30]


def test_pieces_against_a_plain_lattice():
    m = pieces.load(pieces.default_model(), 1.0)
    keys = [pieces.key_hash(k, 5) for k in range(len(PIECE_TEXTS))]
    assert [x.tolist() for x in m.sample(PIECE_TEXTS, keys)] == [plain_pieces(m, t, k) for t, k in zip(PIECE_TEXTS, keys, strict=True)]


def test_pieces_share_what_words_begin_with(monkeypatch):
    """A state for each distinct beginning of a word, not for each character of each word."""
    m = pieces.load(pieces.default_model(), 1.0)
    r = random.Random(8)
    text = " ".join("".join(r.choice(["the", "on", "er"]) for _ in range(r.randint(1, 5))) for _ in range(2000))
    states, lattice = [], m.lattice
    monkeypatch.setattr(m, "lattice", lambda *a: states.append(lattice(*a)) or states[-1])
    m.sample([text], [1])
    words = set(re.findall(" *[^ ]+", text))
    assert max(states[0][0].shape) == len({w[:k] for w in words for k in range(1, len(w) + 1)}) < sum(map(len, words)) / 2


def test_pieces_do_not_rest_on_hashes(monkeypatch):
    """Words and beginnings that only a hash calls equal stay apart."""
    m = pieces.load(pieces.default_model(), 1.0)
    keys = [pieces.key_hash(k, 5) for k in range(len(PIECE_TEXTS))]
    right = [x.tolist() for x in m.sample(PIECE_TEXTS, keys)]
    classes = pieces._classes
    for f in (lambda h, *a: classes(h * 0, *a), lambda h, *a: classes(h % 11, *a)):
        monkeypatch.setattr(pieces, "_classes", f)
        assert [x.tolist() for x in m.sample(PIECE_TEXTS, keys)] == right
    same_size = ["abcd efg hij", "bcda hij efg"]
    monkeypatch.setattr(pieces, "_classes", lambda h, *a: classes(h * 0, *a))
    assert [m.decode(x.tolist()) for x in m.sample(same_size, [1, 2])] == same_size


def test_toxicity(spark, docs):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice(["fine", "day", "tree", "river"]) for _ in range(20)) + (" you awful creature" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert model.score("what an awful creature") > 0.5 > model.score("a fine day by the river")
    assert 0 <= model.score(None) <= 1
    assert toxicity.score(docs, model).count() == docs.count()


def test_toxicity_against_plain_sums(spark):
    """Log-count ratios from plain sets of n-grams; scores from plain sums; the held-out fold teaches nothing."""
    r = random.Random(7)
    rows = [(k, " ".join(r.choice(["fine", "day", "tree", "stone"]) for _ in range(9)) + (" vile rat" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    model = toxicity.train(df.drop("toxic"), labels, least_texts=1, features_kept=1 << 20)
    used = [(t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 5]

    def grams(text):
        c = f" {text.lower()} "
        return {c[k : k + n] for n in (3, 4, 5) for k in range(len(c) - n + 1)}

    hashed = lambda g: int(toxicity.features(g[1:-1])[-1]) if g[0] == g[-1] == " " else None
    pos, neg = sum(y for _, y in used), sum(1 - y for _, y in used)
    place = {int(c): k for k, c in enumerate(model.chosen)}
    assert set(place) == {int(h) for t, _ in used for h in toxicity.features(t)}
    assert pos and neg and all(len(set(toxicity.features(t).tolist())) <= len(grams(t)) for t, _ in used)
    assert hashed(" rat ") in place
    for text in ("a vile rat", "fine day", "", None, "x"):
        z = model.intercept + sum(model.weights[place[h]] for h in set(toxicity.features(text).tolist()) & set(place))
        assert math.isclose(model.score(text), 1 / (1 + math.exp(-max(-40, min(40, z)))), rel_tol=1e-9)
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.train(df.drop("toxic"), turned, least_texts=1, features_kept=1 << 20)
    assert (other.chosen == model.chosen).all() and np.allclose(other.weights, model.weights)
    held = [(model.score(t) >= 0.5) == bool(y) for k, t, y in rows if not zlib.crc32(str(k).encode()) % 5]
    assert sum(held) >= 0.95 * len(held)


def test_packing(docs):
    got = packing.pack(docs, rows_per_partition=20).toPandas()
    tokens = packing.load(packing.default_tokenizer())
    want = sorted(len(tokens.slow.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts(docs))
    assert got["length"].sum() == sum(want)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    sums = got.groupby("sequence_id")["length"].sum()
    assert sums.max() <= 1024 and len(sums) <= packing.lower_bound(np.bincount(got["length"].to_numpy(), minlength=1025), 1024) + 1
    assert packing.cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]
    counted = {i: tokens.slow.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts(docs)}
    for r in got.itertuples():
        key = None if r.doc_id != r.doc_id else int(r.doc_id)
        own = np.array(counted[key][r.start : r.start + r.length], "<u4")
        assert (len(own), zlib.crc32(own.tobytes())) == (r.length, r.ids_crc32)
    assert tokens.fast is not None
    for t in ("<|endoftext|> x", "don't  \n\n y　z", ""):
        assert tokens.ids(t).tolist() == tokens.slow.encode(t, add_special_tokens=False).ids


def test_bounds_never_exceed_optimum():
    r = np.random.default_rng(1)
    for _ in range(200):
        sizes = r.integers(1, 21, r.integers(1, 30))
        assert packing.lower_bound(np.bincount(sizes, minlength=21), 20) <= len(packing.best_fit(sizes, 20)[2])


def test_suffix_dedup(docs, monkeypatch):
    rows = sorted(((i, (t or "").encode()) for i, t in {(i, t) for i, t in texts(docs)}), key=lambda x: (x[0] is not None, x[0] or 0))
    seen, want = set(), {}
    for i, raw in rows:
        gone = bytearray(len(raw))
        for a in range(len(raw) - 99):
            w = raw[a : a + 100]
            if w in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    for hot, common in ((3000, suffix.COMMON), (1, 2)):
        monkeypatch.setattr(suffix, "COMMON", common)
        for r in suffix.remove_repeats_digest(docs, hot=hot).collect():
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_texts_beyond_a_chunk(spark):
    """A text is read in chunks of 8 MiB; the second copy of a half starts before and ends after the cut."""
    half = random.Random(2).randbytes(1_100_000).hex() * 2
    half, n = half[:4_300_000], 2_200_000
    df = spark.createDataFrame([(1, half + "|" + half), (2, "short")], "doc_id long, text string")
    got = {x.doc_id: x for x in suffix.remove_repeats_digest(df).collect()}
    # the first n bytes are all that is new, up to strings that hold the bar
    kept = half[:n] + ("|" if n < len(half) else "")
    assert got[1].n_bytes == 8_600_001 > suffix.CHUNK and got[1].n_removed == 8_600_001 - len(kept)
    assert got[1].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest() and got[2].n_removed == 0


def test_run_index():
    r = random.Random(4)
    base = "".join(r.choice("ab") for _ in range(120)).encode()
    strings = [base[a : a + r.randint(30, 60)] for a in [r.randint(0, 60) for _ in range(20)]]
    index = suffix.RunIndex(strings)
    seen, want, at = set(), [], 0
    for s in strings:
        for a in range(len(s) - 11):
            if s[a : a + 12] in seen:
                want.append(at + a)
            seen.add(s[a : a + 12])
        at += len(s) + 1
    assert index.repeats(12).tolist() == want and index.runs < index.n


def test_run_index_memory():
    """A worker holds an index of a MiB at a time, so its arrays must stay few."""
    import tracemalloc

    r = random.Random(6)
    strings = [r.randbytes(20).hex().encode() * 4 for _ in range(2600)]
    tracemalloc.start()
    index = suffix.RunIndex(strings)
    repeats = index.repeats(100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # of each string, the starts beyond its period of 40
    assert len(repeats) == 2600 * 21 and most < 80 * index.n


def python_operators(node, above: int = 0) -> int:
    """The most Python operators of a plan that a task runs at once."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return python_operators(node.initialPlan(), above)
    above = 0 if "Exchange" in name else above + ("Arrow" in name or "Pandas" in name)
    below = node.children()
    return max([above, *(python_operators(below.apply(k), above) for k in range(below.size()))])


def test_repeats_hold_one_python_worker_a_task(spark):
    """Texts that the filter passes by, and those that it doesn't, keep their columns and get their length."""
    words = random.Random(8)
    passage = " ".join(f"é{words.randrange(10**6)}\U0001f600" for _ in range(20))
    rows = [(1, passage, 7, "a"), (2, f"b {passage} c", 7, "b"), (3, "é\U0001f600 alone", 7, None), (4, None, 7, "d"), (5, "", 7, "e"), (None, "none", 7, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, k string")
    got = suffix.remove_repeats(df)
    assert got.dtypes == df.dtypes
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, "b  c" if i == 2 else t, None if t is None else 4 if i == 2 else len(t), k) for i, t, _, k in rows], key=str)
    for made in (got, suffix.remove_repeats_digest(df)):
        assert python_operators(made._jdf.queryExecution().executedPlan()) == 1


def test_sharding(docs):
    got = sharding.shard_documents(docs, buckets=4).toPandas()
    assert len(got) == docs.count() and (got["law"] == "key").all()
    assert ((got["shard"] == got["grown_shard"]) | (got["grown_shard"] == 24)).all()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])


def test_shards_size_and_crc(docs):
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.size, x.text_crc32) for x in sharding.shard_documents(docs).collect())
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts(docs))
    assert got == want


def test_shard_weights(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "'' as text")
    got = sharding.shard_documents(df, 2, weights=[1.0, 3.0]).groupBy("shard").count().collect()
    assert abs({r["shard"]: r["count"] for r in got}[1] / 20000 - 0.75) < 0.02


def test_pii(docs):
    text = "a.b@c.d x@y.z@w.v 1.2.3.4 300.1.1.1 no 4111 1111 1111 1111 +1 (499) 555-6503 +12 SSN: 123-45-6789 card"
    base, everything = pii.find(text, *pii.model())
    cut = [(k, text[a:b]) for k, a, b in base]
    assert cut == [("email", "a.b@c.d"), ("email", "x@y.z"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (499) 555-6503")]
    assert set(base) <= set(everything) and any(k == "national_id" for k, _, _ in everything)
    assert "[EMAIL]" in pii.redact(text, everything) and "555-6503" not in pii.redact(text, everything)
    for s in ("password=7602ad27cf55AA1c", "api_key: Zk93bQx81LmPq02VtRr7"):
        assert [(k, f"see {s} here"[a:b]) for k, a, b in pii.find(f"see {s} here", *pii.model())[1]] == [("secret", re.split("[=:] ?", s)[1])]
    assert pii.find("key: unbelievable-handwriting", *pii.model())[1] == []
    many = "call 555-123-4567 or SSN 123-45-6789 x at y dot com " * 12_000
    assert len(pii.find(many, *pii.model())[1]) >= 12_000  # sorted intervals: no scan of all that is taken
    assert pii.base_spans("9" * 20000) == [] and pii.find(None, *pii.model()) == ([], [])
    assert pii.detect(docs).count() == docs.count()


def plain_base(text):
    """The contract's patterns, each by its own leftmost non-overlapping search."""
    out = []
    for k, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(x if j % 2 == 0 else sum(divmod(2 * x, 10)) for j, x in enumerate(reversed(d))) % 10 == 0
            fits = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}
            if fits[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_pii_base_against_plain_patterns(spark):
    r = random.Random(12)
    bits = ["a", "Z9", "@", ".", "-", " ", "+", "(", ")", "1", "25", "255", "4111 1111 1111 1111", "x@y.z", "1.2.3.4", "+49 30 1234567", "é", "%", "_", "\n", "0"]
    strings = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    assert all(pii.base_spans(t) == plain_base(t) for t in strings)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(strings[:300])], "doc_id long, text string")
    for x in pii.detect(df).collect():
        want = plain_base(strings[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == kind for k, _, _ in want) for kind in ("email", "ip", "card", "phone")]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(x.spans.split(","))


def test_pii_written_out_at(spark):
    text = "write to john at example.com please"
    assert ("email", 9, 28) in pii.candidates(text)
    far = "a dot b. " + text
    assert [(k, a - 9, b - 9) for k, a, b in pii.candidates(far) if a >= 9] == pii.candidates(text)
    # what a span is doesn't depend on an unrelated " dot "
    own = {text[a:b] for _, a, b in pii.find(text, *pii.model())[1]}
    assert own == {far[a:b] for _, a, b in pii.find(far, *pii.model())[1]}
    assert any(not truth and k == "email" for k, _, _, _, truth in pii.compose(500, 7))


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    r = random.Random(11)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7), (1000, 1001)]
    parent = {v: v for e in edges for v in e if e[0] != e[1]}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), few).collect()
    assert {x.v: x.component for x in got} == {v: find(v) for v in parent} and len(got) == len(parent)


def test_bloom(spark):
    members, others = spark.range(5000).selectExpr("xxhash64(id) as h"), spark.range(5000, 25000).selectExpr("xxhash64(id) as h")
    # the smallest of many hashes crowd at the low end
    for df in (members, members.selectExpr("shiftrightunsigned(h, 20) as h")):
        bloom = graph.Bloom.of(df, "h")
        assert bloom.may_have(df.toPandas()["h"].to_numpy()).all()
        assert bloom.may_have(others.toPandas()["h"].to_numpy()).mean() < 0.1
    assert not graph.Bloom.of(members.filter("false"), "h").may_have(np.arange(100)).any()


def test_join_without_bloom(spark, docs, monkeypatch):
    """Tables that are too large for a filter are joined."""
    keyed = docs.filter("doc_id is not null and doc_id < 204")
    want = sorted(jaccard.join(keyed, n=5, percent=80).collect())
    removed = sorted(suffix.remove_repeats_digest(keyed).collect())
    kept = sorted(x.doc_id for x in jaccard.near_duplicates(keyed).collect())
    monkeypatch.setattr(graph.Bloom, "LARGEST", 8)
    assert graph.Bloom.of(keyed, "doc_id") is None
    assert sorted(jaccard.join(keyed, n=5, percent=80).collect()) == want
    assert sorted(suffix.remove_repeats_digest(keyed).collect()) == removed
    assert sorted(x.doc_id for x in jaccard.near_duplicates(keyed).collect()) == kept


def plain_components(rows, n, percent):
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(docs, n, percent):
    keyed = docs.filter("doc_id is not null")
    want = plain_components(texts(keyed), n, percent)
    for r in jaccard.join(keyed, n=n, percent=percent).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert jaccard.join(docs).count() == docs.count()


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_links(spark, docs, n, percent):
    r = random.Random(8)
    base, rows = [f"w{k}" for k in range(200)], texts(docs.filter("doc_id is not null and doc_id <> 405"))
    for k in range(40):
        own = list(base)
        for at in r.sample(range(200), k % 5):
            own[at] = f"edit{k}"
        rows.append((1000 + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()} for i, w in ((i, (t or "").lower().split(None)) for i, t in rows)}
    want = {(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and a and b and 100 * len(a & b) >= percent * len(a | b)}
    assert len(want) > 100
    degrees = {i: sum(i in p for p in want) for i in sets}
    got = jaccard.join(df, n=n, percent=percent).collect()
    assert {x.doc_id: x.n_links for x in got} == degrees and len(got) == len(rows)
    pairs, membership = (x.collect() for x in jaccard.linked_pairs(df, n=n, percent=percent))
    of = {x.doc_id: x.representative for x in membership}
    met = {(x.a, x.b) for x in pairs}
    assert len(met) == len(pairs) and all(a < b for a, b in met) and set(of) == set(sets)
    assert want == {(i, j) for i in of for j in of if i < j and of[i] is not None and of[j] is not None and (of[i] == of[j] or (min(of[i], of[j]), max(of[i], of[j])) in met)}


def test_near_duplicates_by_row(spark):
    r = random.Random(9)
    text = lambda: " ".join(f"v{r.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda t, k: f"{t} end{k}"
    rows = [(3, a, 0), (5, near(a, 1), 1), (5, b, 2), (6, near(b, 2), 3), (None, c, 4), (None, d, 5), (None, near(d, 3), 6), (None, near(a, 4), 7), (7, e, 8), (7, e, 9), (None, "", 10), (None, "", 11), (8, None, 12), (9, near(c, 5), 13)]
    for key in ("doc_id", "number"):
        df = spark.createDataFrame(rows, f"{key} long, text string, tag int").repartition(3)
        got = jaccard.near_duplicates(df, id_col=key)
        assert got.columns == df.columns
        tags = {x.tag for x in got.collect()}
        # the leaders, one of two null-keyed copies, one of two equal rows, and all empty texts
        assert tags - {5, 6, 8, 9} == {0, 2, 13, 10, 11, 12}
        assert len(tags & {5, 6}) == len(tags & {8, 9}) == 1 and got.count() == 8


def test_stages_on_empty_tables_and_awkward_rows(spark, nothing, docs):
    """Of awkward rows, clashing columns included, only those go that a stage decides against."""
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0
    profiles = language.train(docs.withColumn("lang", F.lit("a")))
    stages = [lambda d: language.filter_language(d, profiles), lambda d: jaccard.near_duplicates(d, n=5, percent=80), suffix.remove_repeats, pii.redact_documents]
    letters = sum(any(c.isalpha() for c in t or "") and t is not None for _, t in texts(docs))
    for stage, left in zip(stages, (letters, None, docs.count(), docs.count()), strict=True):
        empty, full = stage(nothing), stage(docs)
        assert empty.count() == 0 and empty.columns == full.columns == docs.columns
        rows = full.collect()
        assert left is None or len(rows) == left
        assert {x.component_id for x in rows} == {"clash"} and {x.score for x in rows} == {0.5}


def test_pipeline_keeps_columns(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)  # a fixture's size, not the stage's
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            docs.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.filter("offset = 0").count() > 0
