"""Sampled sentence-piece segmentations by forward filtering and backward sampling.

All segmentations of a word into pieces form a lattice: a state for each position, an
edge for each piece that the text there spells. Forward filtering sums the weight of
all paths into each state; backward sampling draws, from the word's end, the last
piece in proportion to the paths that end with it, and goes on from where that
piece starts. A segmentation is drawn in proportion to the product of its pieces' weights.

The draw at a position is a hash of the seed, the row's key and the position, so that
a row's segmentation is the same in every run, partition and batch. Weights are a
unigram model's scores; a model whose scores are only merge ranks gets a Zipf law over
them. ``alpha`` sharpens (above 1) or flattens the weights.

No normalisation takes place: a space is the model's word mark, and characters with no
piece of their own, the mark itself included, become byte pieces. ``Pieces.decode``
gives back exactly the text. Pieces don't cross from one word into the next, a
word being a run of spaces with the characters up to the next space; words of any
length go in whole. Null counts as empty, which has no pieces.

All words of a slice of text go through the lattice together, in numpy, by depth: equal
words once, and words that begin alike share the states of what they have in common, as
what is summed into a state depends on what precedes it alone. Hashes propose what is
equal, characters decide. Memory is bounded by the slice (about a million characters, or one longer text).
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, id_and_text

MARK = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _classes(h: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, ...]:
    """Of equal hashes: the number of each one's class and one place of each class; on demand
    the places in an order in which those of a class lie together."""
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return (which, order[new], order) if ordered else (which, order[new])


def _count_up(sizes: np.ndarray) -> np.ndarray:
    """1 to the size, for each one."""
    ends = np.cumsum(sizes)
    return np.arange(1, int(ends[-1]) + 1) - np.repeat(ends - sizes, sizes)


def _utf8(c: np.ndarray) -> Iterator[np.ndarray]:
    """The first to fourth byte of each character; beyond its last, any."""
    n = Pieces.utf8_size(c).astype(np.int64)
    for k in range(int(n.max())):
        byte = c >> (6 * (n - 1 - k)).clip(0) & 0x3F | 0x80
        if k == 0:
            byte = np.where(n == 1, c, c >> (6 * (n - 1)) | np.array([0, 0, 0xC0, 0xE0, 0xF0])[n])
        yield byte


def key_hash(key: int | None, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little")


class Pieces:
    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model needs a piece for each byte")
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = np.array([sp.get_score(i) for i in range(n)])
        if np.array_equal(-score[plain], np.round(-score[plain])):  # merge ranks: no probabilities
            score = -np.log(2.0 - score)
        self.logp = alpha * score
        self.fallback = float(self.logp[plain].min() - 10.0)  # for each byte
        self.bytes = [bytes([self._byte_of(i)]) if sp.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        self.byte_ids = np.array([self.byte[b] for b in range(256)], np.int32)
        self.chars = np.array([*map(len, self.text), 1])  # the last is -1, bytes, of one character
        self.longest = max(len(self.text[i]) for i in plain)
        self.powers = np.cumprod(np.array([1, *[_P] * (self.longest - 1)], np.uint64))
        by_length: dict[int, list[int]] = {}
        for i in plain:
            by_length.setdefault(len(self.text[i]), []).append(i)
        self.tables, self.seen = {}, {k: np.zeros(1 << 20, np.uint8) for k in range(1, self.longest + 1)}
        for length, ids in sorted(by_length.items()):
            points = np.array([[ord(c) for c in self.text[i]] for i in ids], np.uint64)
            h = np.zeros(len(ids), np.uint64)
            for k in range(length):
                h = h * _P + points[:, k]
            order = np.argsort(h)
            self.tables[length] = (h[order], np.array(ids, np.int32)[order])
            # seen: by hash, 1 where a piece of that length may be, 2 where the end of a longer one may be
            self.seen[length][_mix(h) >> np.uint64(44)] |= 1
            h = np.zeros(len(ids), np.uint64)
            for k in range(1, length):
                h = h + points[:, length - k] * self.powers[k - 1]
                self.seen[k][_mix(h) >> np.uint64(44)] |= 2

    def _byte_of(self, i: int) -> int:
        return int(self.text[i][3:5], 16)

    @staticmethod
    def utf8_size(points: np.ndarray) -> np.ndarray:
        """Bytes of each character; 3 for the word mark as a character of the text."""
        size = np.ones(len(points))
        for least in (0x80, 0x800, 0x10000):
            size[points >= least] += 1
        size[points >= 0x110000] = 3
        return size

    # -- the lattice ------------------------------------------------------------
    def lattice(self, points: np.ndarray, depth: np.ndarray, h: np.ndarray):
        """For words laid end to end; given, by position, its place in its word, from 1, and a hash
        of the word up to there. Words that begin alike share states. Returns, by state and edge,
        the cumulated odds, the state it starts from (the number of states: the word's start)
        and piece (-1: bytes); and the state of each position where a piece may end."""
        which, first = _classes(h)
        own = first[which]
        start = depth == 1
        # equal hashes are equal beginnings if their last characters are, and what precedes these
        if not (np.array_equal(points[own], points) and np.array_equal(depth[own], depth) and (start | (which[own - 1] == np.roll(which, 1))).all()):
            which = first = np.arange(len(points))
        # states are numbered by depth, so that those of a depth lie together
        order = np.argsort(depth[first], kind="stable")
        at = first[order]
        n = len(at)
        number = np.empty(n, np.int32)
        number[order] = np.arange(n, dtype=np.int32)
        state = number[which]
        deep = depth[at]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(deep)[1:])])
        found = []
        single = np.zeros(n, bool)
        alive, place, h = np.arange(n, dtype=np.int32), at, np.zeros(n, np.uint64)  # states that a piece, or more of one, may yet end in
        for length in range(1, self.longest + 1):
            if length > 1:
                fits = np.searchsorted(alive, bounds[min(length, len(bounds)) - 1])
                alive, place, h = alive[fits:], place[fits:], h[fits:]
            if not len(alive):
                break
            h = h + points[place - (length - 1)] * self.powers[length - 1]
            seen = self.seen[length][(_mix(h) >> np.uint64(44)).astype(np.int64)]
            if length in self.tables:
                known, ids = self.tables[length]
                maybe = np.flatnonzero(seen & 1)
                k = np.searchsorted(known, h[maybe]).clip(max=len(known) - 1)
                hit = known[k] == h[maybe]
                maybe, ids = maybe[hit], ids[k[hit]]
                row = alive[maybe]
                if length == 1:
                    single[row] = True
                found.insert(0, (row, np.where(deep[row] == length, n, state[place[maybe] - length]), ids, self.logp[ids]))  # long pieces, likely ones, first
            goes = np.flatnonzero(seen & 2)
            alive, place, h = alive[goes], place[goes], h[goes]
        none = np.flatnonzero(~single)
        cost = self.fallback * self.utf8_size(points[at[none]])
        edges = [*found, (none, np.where(deep[none] == 1, n, state[at[none] - 1]), -1, cost)]
        fill = np.zeros(n, np.int8)
        for row, *_ in edges:  # a state has at most one edge of each length
            fill[row] += 1
        width = int(fill.max(initial=1))
        fill[:] = 0
        before = np.full((width, n), n, np.int32)
        pieces = np.full((width, n), -1, np.int32)
        odds = np.full((width, n), -np.inf)
        for row, start, piece, weight in edges:
            slot = fill[row]
            before[slot, row], pieces[slot, row], odds[slot, row] = start, piece, weight
            fill[row] = slot + 1
        total = np.zeros(n + 1)  # the word's start has log weight 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            into = odds[:, a:b] + total[before[:, a:b]]
            top = into.max(axis=0)
            run = np.cumsum(np.exp(into - top), axis=0)
            total[a:b] = top + np.log(run[-1])
            odds[:, a:b] = run / run[-1]
        return odds.T, before.T, pieces.T, state

    def sample(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Piece ids of each text; ``keys`` are their hashes."""
        chars = np.array([len(t) for t in texts], np.int64)
        text_end = np.cumsum(chars)
        n = int(chars.sum())
        if not n:
            return [np.empty(0, np.int32) for _ in texts]
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        # a word starts with a text, at and after a mark of the text, and where spaces start
        space, mark = raw == ord(" "), raw == ord(MARK)
        begins = space | mark
        begins[1:] &= ~(space[1:] & space[:-1])
        begins[1:] |= mark[:-1]
        begins[(text_end - chars)[chars > 0]] = True
        starts = np.flatnonzero(begins)
        size = np.diff(starts, append=n)
        # a mark of the text is given a point outside Unicode: it has no piece
        points = raw.astype(np.uint64)
        points[space], points[mark] = ord(MARK), 0x110000
        depth = _count_up(size)
        powers = np.cumprod(np.full(int(size.max()), _P))
        h = np.cumsum(points * powers[depth - 1])
        h -= np.repeat(h[starts] - points[starts] * _P, size)  # of each word up to there
        which, first, order = _classes(h[starts + size - 1], True)
        shift = starts[first][which] - starts
        if not (np.array_equal(size[first][which], size) and np.array_equal(points[np.arange(n) + np.repeat(shift, size)], points)):
            which = first = order = np.arange(len(starts))
        length = size[first]
        ends = np.cumsum(length)
        laid = np.arange(int(ends[-1])) + np.repeat(starts[first] - (ends - length), length)
        odds, before, pieces, state = self.lattice(points[laid], depth[laid], h[laid])
        none, width = odds.shape
        odds, before, pieces = odds.ravel(), before.ravel(), pieces.ravel()
        # backward, all words at once; a word's occurrences, which read the same states, lie together
        out = np.full(n, -2, np.int32)
        now = state[ends - 1][which[order]].astype(np.int64)
        place = (starts + size)[order]
        text_of = np.searchsorted(text_end, starts[order], side="right")
        salt = np.array(keys, np.uint64)[text_of] - (text_end - chars)[text_of].astype(np.uint64) * _P
        while len(now):
            u = (_mix(salt + place.astype(np.uint64) * _P) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = now * width
            past = np.flatnonzero(u >= odds[edge])
            while len(past):
                edge[past] += 1
                past = past[u[past] >= odds[edge[past]]]
            piece = pieces[edge]
            out[place - 1] = piece
            now = before[edge].astype(np.int64)
            goes = np.flatnonzero(now < none)
            now, place, salt = now[goes], place[goes] - self.chars[piece[goes]], salt[goes]
        ends_at = np.flatnonzero(out != -2)
        ids = out[ends_at]
        last = np.searchsorted(ends_at, text_end)
        plain = np.flatnonzero(ids == -1)
        if len(plain):
            c = raw[ends_at[plain]]
            n_bytes = np.ones(len(ids), np.int64)
            n_bytes[plain] = self.utf8_size(c)
            up_to = np.concatenate([[0], np.cumsum(n_bytes)])
            ids = np.repeat(ids, n_bytes)
            for k, byte in enumerate(_utf8(c)):
                there = n_bytes[plain] > k
                ids[up_to[plain[there]] + k] = self.byte_ids[byte[there]]
            last = up_to[last]
        return np.split(ids, last[:-1])

    def decode(self, ids) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=2)
def load(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _slices(texts: list[str], most: int) -> Iterator[slice]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, seed: int = 1, alpha: float = 1.0, slice_chars: int = 1_000_000) -> DataFrame:
    """doc_id, pieces (array of ids) and text (what they decode to). ``path`` must be
    readable on every executor; None is the installed vocabulary's place there."""
    return _run(df, id_col, text_col, path, seed, alpha, slice_chars, False)


def encode_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, seed: int = 1, alpha: float = 1.0, slice_chars: int = 1_000_000) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids),
    decoded_sha256 and lossless of each row."""
    return _run(df, id_col, text_col, path, seed, alpha, slice_chars, True)


def _run(df, id_col, text_col, path, seed, alpha, slice_chars, digest):
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path or default_model(), alpha)
        for batch in batches:
            keys = [key_hash(k, seed) for k in batch.column("doc_id").to_pylist()]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [x for s in _slices(texts, slice_chars) for x in model.sample(texts[s], keys[s])]
            said = [model.decode(x.tolist()) for x in ids]
            if digest:
                raw = [s.encode("utf-8", "surrogatepass") for s in said]
                columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                columns += [pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()), pa.array([a == b for a, b in zip(said, texts, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_chars", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array(said, pa.string())], ["doc_id", "pieces", "text"])

    schema = "doc_id bigint, n_chars bigint, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean" if digest else "doc_id bigint, pieces array<int>, text string"
    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)
