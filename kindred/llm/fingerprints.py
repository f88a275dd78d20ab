"""Document fingerprints from prefix polynomial hashes.

For a text c_0 c_1 ... the prefix array S[i] = sum of c_j B^j, j < i, modulo
2^31 - 1, kept for two bases, gives the hash of any span in constant time:
(S[j] - S[i]) B^-i. ``Prefixes`` answers span equality with it and finds longest common
extensions by binary search.

A fingerprint is the hash of the whole text, its length and the 64 smallest distinct
hashes of its 16-character spans, all read off the prefix arrays. Likeness of two
fingerprints is 1 for equal ones and otherwise the bottom-64 estimate of the Jaccard
similarity of the two sets of spans. How far a text and its edit, or its successor, agree from
their starts is their longest common extension, searched for on the prefix arrays; of an edited
text only the spans beyond it are hashed. Texts under 16 characters have one span, the
whole. Null counts as empty. Equal texts have equal fingerprints.

``fingerprint_chain`` also compares each row with its successor in descending order of
the key. Rows are dealt once, to ranges of keys; a range's last row finds the first
row of the next range as a copy that was sent along, so a text is shuffled once and
no task sees more than its range. There are at most ``most_ranges``; beyond, ranges
hold more rows, which pass through a task one at a time. Null keys come last and repeated keys are in order
of their texts, equal rows being interchangeable.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, id_and_text

P = np.uint64((1 << 31) - 1)
BASES = (1_000_003 * 977 % int(P), 918_273_645)
INVERSE = pow(BASES[0], -1, int(P))
SPAN, KEPT = 16, 64


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x below 2^62, by folding twice."""
    x = (x & P) + (x >> np.uint64(31))
    x = (x & P) + (x >> np.uint64(31))
    return np.where(x >= P, x - P, x)


@functools.lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < size:  # B^(i + n) = B^i B^n
        out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), int(P))))])
    return out[:size]


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(10, int(n).bit_length()))[:n]


def _fold(x: np.ndarray) -> np.ndarray:
    return (x & P) + (x >> np.uint64(31))


class Prefixes:
    """Prefix arrays of one text under both bases. The sums aren't reduced (2^29 terms of under
    2^32 fit), so differences need no sign."""

    def __init__(self, points: np.ndarray):
        self.n, self.points, self.sums = len(points), points, []
        c = points.astype(np.uint64) + np.uint64(1)
        for base in BASES:
            sums = np.empty(self.n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_fold(c * powers(base, self.n)), out=sums[1:])
            self.sums.append(sums)

    @classmethod
    def of(cls, text: str) -> Prefixes:
        return cls(code_points(text))

    def span(self, i: int, j: int) -> tuple[int, ...]:
        return tuple((int(s[j]) - int(s[i])) * pow(base, -i, int(P)) % int(P) for s, base in zip(self.sums, BASES, strict=True))

    def equal(self, i: int, other: Prefixes, k: int, length: int) -> bool:
        if i + length > self.n or k + length > other.n:
            return False
        return self.span(i, i + length) == other.span(k, k + length)

    def extension(self, i: int, other: Prefixes, k: int) -> int:
        """Length of the longest common extension of position i and the other's k."""
        low, high = 0, min(self.n - i, other.n - k)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, k, mid) else (low, mid - 1)
        return low

    def spans(self, length: int, start: int = 0) -> np.ndarray:
        """Hashes, under the first base, of all spans of this length from ``start`` on."""
        ends = self.sums[0][start + length :]
        return _mod(_fold(ends - self.sums[0][start : self.n - length + 1]) * powers(INVERSE, self.n - length + 1)[start:])

    def whole(self) -> list[int]:
        return [int(s[-1]) % int(P) for s in self.sums]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _smallest(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) > 64 * n:  # first those that are likely small; all if they are too few
        few = np.unique(h[h < P // np.uint64(max(1, len(h) // (8 * n)))])
        if len(few) >= n:
            return few[:n]
    return np.unique(h)[:n]


def _spans(of: Prefixes, start: int = 0) -> np.ndarray:
    # multiplying by a constant deals the hashes evenly
    return _mod(of.spans(min(SPAN, of.n), start) * np.uint64(0x5BD1E995 % int(P)))


def _written(of: Prefixes, spans: np.ndarray) -> tuple[str, np.ndarray]:
    if not of.n:
        return "0:0:", np.empty(0, np.uint64)
    kept, whole = _smallest(spans, KEPT), of.whole()
    return f"{of.n:x}:{whole[0]:08x}{whole[1]:08x}:" + kept.astype(">u4").tobytes().hex(), kept


def fingerprint(points: np.ndarray) -> tuple[str, np.ndarray]:
    """The fingerprint and, to compare it, its span hashes."""
    of = Prefixes(points)
    return _written(of, _spans(of) if of.n else np.empty(0, np.uint64))


class Fingerprinted:
    """A text's prefix arrays, span hashes and fingerprint."""

    def __init__(self, points: np.ndarray):
        self.of = Prefixes(points)
        self.spans = _spans(self.of) if self.of.n else np.empty(0, np.uint64)
        self.mark = _written(self.of, self.spans)

    def edited(self, changed: np.ndarray) -> tuple[tuple[str, np.ndarray], int]:
        """The fingerprint of a changed text, and the longest common extension of the starts:
        spans that lie in it hash as before."""
        other = Prefixes(changed)
        same = self.of.extension(0, other, 0)
        if min(self.of.n, other.n, same) < SPAN:
            return _written(other, _spans(other) if other.n else np.empty(0, np.uint64)), same
        kept = same - SPAN + 1
        return _written(other, np.concatenate([self.spans[:kept], _spans(other, kept)])), same


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    """1 for equal fingerprints, else the Jaccard estimate from the two bottom sketches."""
    if a[0] == b[0]:
        return 1.0
    if not len(a[1]) or not len(b[1]):
        return 0.0
    union = np.union1d(a[1], b[1])[:KEPT]
    both = np.intersect1d(a[1], b[1], assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def edited(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    cut = len(points) // 3
    return np.concatenate([points[: len(points) - cut], following[:cut]]) if cut else points


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited bigint, common_next bigint"


def fingerprint_chain(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 2_000, most_ranges: int = 10_000) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness; see SCHEMA."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = id_and_text(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    low = F.lit(-(1 << 63))
    rows = rows.withColumn("_key", F.coalesce("doc_id", low))
    n = rows.count()
    ranges = max(1, min(most_ranges, n // rows_per_range))
    cuts = sorted(set(rows.agg(F.percentile_approx("_key", [(k + 1) / ranges for k in range(ranges - 1)], 100 * ranges)).first()[0] or [])) if ranges > 1 else []
    # range 0 has the largest keys; cuts are keys, so equal keys share a range
    places = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(key):
        import pandas as pd

        return pd.Series((len(places) - np.searchsorted(places, key.to_numpy(np.int64), "left")).astype(np.int32))

    rows = rows.withColumn("_range", bucket("_key") if cuts else F.lit(0))
    heads = {r["_range"]: r["head"] for r in rows.groupBy("_range").agg(F.max("_key").alias("head")).collect()}
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    there = sorted(heads)
    # the row at the head of each range goes to the range before it, too: a row a range
    guests = F.create_map(*[F.lit(x) for at, r in enumerate(there) for x in (heads[r], there[at - 1])])
    sent = rows.filter(F.col("_key").isin([*heads.values()])).withColumn("_range", guests[F.col("_key")])
    both = rows.withColumn("_guest", F.lit(False)).unionByName(sent.withColumn("_guest", F.lit(True)))
    dealt = both.repartition(len(there), "_range").sortWithinPartitions("_range", "_guest", F.desc("_key"), "text")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = held_range = None

        def emit(own: tuple[int | None, Fingerprinted], following: tuple[int | None, Fingerprinted]) -> None:
            (key, a), (_, b) = own, following
            changed = edited(a.of.points, b.of.points)
            mark, same = a.edited(changed)
            sha = hashlib.sha256(changed.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
            out.append((key, a.of.n, sha, a.mark[0], mark[0], likeness(a.mark, mark), likeness(a.mark, b.mark), same, a.of.extension(0, b.of, 0)))

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])
                out.clear()

        for batch in batches:
            for key, text, part, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_range", "_guest")), strict=True):
                if held_range != part:
                    held, held_range = None, part
                elif held is None:
                    continue  # the range's guest has been met
                row = (key, Fingerprinted(code_points(text)))
                if held is not None:
                    emit(held, row)
                held = None if guest else row
            yield from flush()
        yield from flush()

    return dealt.mapInArrow(chain, SCHEMA)
