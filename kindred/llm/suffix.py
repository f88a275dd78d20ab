"""Removal of repeated passages with a run-compressed Burrows-Wheeler index.

A byte goes if it is covered by a string of ``length`` bytes (100) that also starts
earlier: in a document with a smaller key, or earlier in the same one. Strings are
judged on the input and never cross documents.

Work is routed by anchors. The anchor of a string is the smallest hash among its
32-byte substrings, so equal strings have equal anchors; strings of one text that
start next to each other and share the anchor form a segment (168 bytes at most).

1. Segments whose anchor occurs once hold nothing that repeats.
2. Of equal segments the earliest stays open; the others are marked whole. Counts
   and minima are taken before the shuffle. Which copies are later is told by a join; segments with
   more copies than ``COMMON``, or than a 2^18th of all, are joined by broadcast (so 2^18 at
   most), and a passage that a third of all documents share costs no task more than others.
3. Segments that share an anchor but differ are what the index is for. Those of an anchor
   meet in one task, which indexes about a MiB of them at a time: suffix order by prefix
   doubling, the Burrows-Wheeler transform as runs, and at each run's head a sample:
   the suffix before it in order and, by longest-common-extension queries, how long the
   two match. Inside a run both only shift by one from the character before, so
   streaming over the text gives all matching statistics from the samples.
   Suffixes whose statistics reach ``length`` repeat; all but the earliest of
   each interval are marked.
4. Anchors with more than ``hot`` different segments would make a task too large. Their
   strings are filed one by one under a 128-bit hash of the whole string, and the
   earliest of each hash stays. This is exact, too, and has no large groups.

A document is a (key, text) pair: rows that repeat both are one document and get the
same result; rows that repeat the key alone are ordered by a hash of the text. Null
keys come first. Null and empty texts have nothing to remove. Texts shorter than
``length`` can't repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, discard, id_and_text, release, stored
from kindred.llm.graph import Bloom, may_have
from kindred.llm.jaccard import _B, _INVERSE, _powers, mix

ANCHOR, CHUNK, POSITION = 32, 1 << 23, np.uint64((1 << 24) - 1)
COMMON = 4096
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _B)


# -- anchors ---------------------------------------------------------------------
def anchors(raw: bytes, length: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment of a text: its anchor's hash, where its first string starts and how
    many strings it has."""
    n = len(raw)
    if n < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    parts = []
    for a in range(0, n - length + 1, CHUNK):
        part = raw[a : a + CHUNK + length - 1]
        words = np.ascontiguousarray(np.ndarray((len(part) - 7,), "<u8", part, strides=(1,)))
        m = len(part) - ANCHOR + 1
        h = words[:m] * _B
        for k, odd in ((8, 0xD6E8FEB86659FD93), (16, 0xC2B2AE3D27D4EB4F), (24, 0xFF51AFD7ED558CCD)):
            h ^= h >> np.uint64(32)
            h += words[k : k + m] * np.uint64(odd)
        h = mix(h)
        # hash and place in one number: the leftmost of equal hashes wins
        low = (h & ~POSITION) | np.arange(m, dtype=np.uint64)
        width, span = length - ANCHOR + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        place = (low & POSITION).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        parts.append((h[place[start]], start + a, np.diff(np.append(start, len(place)))))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Spans:
    """Hashes of any spans of a text from one prefix array."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_B, len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        shift = _powers(_INVERSE, len(self.sums))[start]
        return mix((self.sums[end] - self.sums[start]) * shift + (end - start).astype(np.uint64) * _B)


# -- the index -------------------------------------------------------------------
class RunIndex:
    """Run-compressed Burrows-Wheeler transform of short strings, in their given order.

    heads: text positions whose suffixes head a run; before: the suffix before each in
    order; matched: how many bytes the two share."""

    STEP = 7

    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) + 1 for s in strings])
        self.ends = np.cumsum(size)
        n = int(self.ends[-1])
        self.n = n
        self.rest = np.repeat((self.ends - 1).astype(np.int32), size)  # bytes to the string's end
        self.rest -= np.arange(n, dtype=np.int32)
        self.text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        symbol = np.zeros(n + self.STEP, np.int16)
        symbol[:n] = self.text
        symbol[:n] += 1
        symbol[self.ends - 1] = 0
        key = np.zeros(n, np.int64)
        for t in range(self.STEP):
            key <<= 9
            key |= np.where(self.rest >= t, symbol[t : t + n], np.int16(0))
        self.levels: list[tuple[int, np.ndarray]] = []
        depth, longest = self.STEP, int(size.max())
        while True:
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.append(True, key[1:] != key[:-1]), dtype=np.int32)
            del order
            self.levels.append((depth, rank))
            key[:] = rank
            if depth >= longest or rank.max() == n:
                break
            key *= n + 1
            has = self.rest >= depth
            key[has] += rank[depth:][has[: n - depth]]
            depth *= 2
        # equal suffixes end at different strings' ends, which order them
        key *= n
        key += np.arange(n)
        self.suffixes = np.argsort(key)
        del key
        last = np.where(self.suffixes > 0, symbol[self.suffixes - 1], np.int16(0))  # the transform
        head = np.ones(n, bool)
        head[1:] = (last[1:] != last[:-1]) | (last[1:] == 0)
        self.runs = int(head.sum())
        at = np.flatnonzero(head)
        self.heads, self.before = self.suffixes[at], self.suffixes[np.maximum(at - 1, 0)]
        self.matched = self._extension(self.heads, self.before)
        self.matched[0] = 0
        del self.levels  # of all that is held the most, and of no further use

    def _extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extensions, off the ranks of the doubled prefixes."""
        most = np.minimum(self.rest[a], self.rest[b])
        out = np.zeros(len(a), np.int64)
        for depth, rank in reversed(self.levels):
            for _ in range(2 if depth == self.levels[-1][0] else 1):
                x, y = np.minimum(a + out, self.n - 1), np.minimum(b + out, self.n - 1)
                out += np.where((out < most) & (rank[x] == rank[y]), depth, 0)
        return np.minimum(out + self._few(a, b, out, most), most)

    def _few(self, a, b, out, most):
        """Bytes, under STEP, by which the extension goes on; the first level's key has them."""
        extra = np.zeros(len(a), np.int64)
        going = out < most
        for _ in range(self.STEP - 1):
            x, y = np.minimum(a + out + extra, self.n - 1), np.minimum(b + out + extra, self.n - 1)
            going &= (out + extra < most) & (self.text[x] == self.text[y])
            if not going.any():
                break
            extra += going
        return extra

    def statistics(self) -> np.ndarray:
        """For each position, how many bytes its suffix shares with the one before it in
        order: streamed from the samples, one less with each step inside a run."""
        order = np.argsort(self.heads)
        place, value = self.heads[order], self.matched[order]
        inside = np.diff(np.append(place, self.n))  # the first position heads a run
        shared = np.repeat(place + value, inside)
        shared -= np.arange(self.n)
        return np.maximum(shared, 0, out=shared)

    def repeats(self, length: int) -> np.ndarray:
        """Positions whose next ``length`` bytes also start at an earlier position."""
        shared = self.statistics()[self.suffixes]
        group = np.flatnonzero(np.append(True, shared[1:] < length))
        first = np.minimum.reduceat(self.suffixes, group)
        earliest = np.repeat(first, np.diff(np.append(group, self.n)))
        return np.sort(self.suffixes[(self.suffixes != earliest) & (self.rest[self.suffixes] >= length)])


def intervals(at: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of successive starts as the bytes that they cover."""
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.append(0, breaks + 1)].tolist(), (at[np.append(breaks, len(at) - 1)] + length).tolist(), strict=True))


# -- over tables -------------------------------------------------------------------
_MARKS = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _hashes(docs: DataFrame, length: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, np.uint64)] + [anchors(t, length)[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["anchor"])

    return docs.select("text").mapInArrow(read, "anchor bigint")


def _segments(docs: DataFrame, wanted: Bloom | None, length: int) -> DataFrame:
    """Segments with an anchor that is wanted; a few others may come along."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)  # its size is bounded

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []
            for k, raw in enumerate(batch.column("text").to_pylist()):
                h, start, n = anchors(raw, length)
                kept = np.arange(len(h)) if sent.value is None else np.flatnonzero(sent.value.may_have(h))
                if len(kept):
                    start, n = start[kept], n[kept]
                    of.append(np.full(len(kept), k))
                    rows.append((h[kept].view(np.int64), Spans(raw).of(start, start + n - 1 + length).view(np.int64), start, n))
            if rows:
                at = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("k").take(at), *(pa.array(np.concatenate(c)) for c in zip(*rows, strict=True))], ["doc_id", "k", "anchor", "content", "start", "n"])

    return docs.mapInArrow(read, "doc_id bigint, k bigint, anchor bigint, content bigint, start bigint, n bigint")


def _marked_by_index(open_segments: DataFrame, length: int, most: int = 1 << 20) -> DataFrame:
    """open_segments: doc_id, k, anchor, start, bytes; those of an anchor come together."""
    dealt = open_segments.repartition("anchor").sortWithinPartitions("anchor", F.asc_nulls_first("doc_id"), "k", "start")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def index() -> pa.RecordBatch:
            # earliest first, so that smaller positions of the index start earlier
            held.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
            repeats = RunIndex([r[4] for r in held])
            at = repeats.repeats(length)
            begins = np.append(0, repeats.ends)
            of = np.searchsorted(begins, at, "right") - 1
            cuts = np.searchsorted(of, np.arange(len(held) + 1))
            rows = []
            for r, a, b, c in zip(held, cuts[:-1].tolist(), cuts[1:].tolist(), begins.tolist(), strict=False):
                rows += [(r[1], r[2], x + r[3], y + r[3]) for x, y in intervals(at[a:b] - c, length)]
            return _batch(rows, _MARKS)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "k", "start", "bytes")), strict=True):
                if size >= most and row[0] != held[-1][0]:
                    yield index()
                    held.clear()
                    size = 0
                held.append(row)
                size += len(row[4])
        if held:
            yield index()

    return dealt.mapInArrow(mark, "doc_id bigint, k bigint, `from` bigint, `to` bigint")


def _marked_by_hash(open_segments: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many segments: string by string."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, k, start, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "start", "bytes")), strict=True):
                for a in range(len(raw) - length + 1):
                    d = hashlib.blake2b(raw[a : a + length], digest_size=16).digest()
                    rows.append((key, k, start + a, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            yield _batch(rows, pa.schema([(c, pa.int64()) for c in ("doc_id", "k", "at", "h1", "h2")]))

    strings = open_segments.select("doc_id", "k", "start", "bytes").mapInArrow(explode, "doc_id bigint, k bigint, at bigint, h1 bigint, h2 bigint")
    first = strings.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "k", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = strings.join(first, ["h1", "h2"]).filter(~F.struct("doc_id", "k", "at").eqNullSafe(F.col("first")))
    return later.select("doc_id", "k", F.col("at").alias("from"), (F.col("at") + length).alias("to"))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = id_and_text(df, id_col, text_col, binary=True).withColumn("text", F.coalesce("text", F.lit(b"")))
    return docs.withColumn("k", F.xxhash64("doc_id", "text"))


def marks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = 3000) -> DataFrame:
    """doc_id, k (a hash of key and text) and spans: the bytes to remove, as intervals that
    may overlap. Documents without any have no row."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = _keyed(df, id_col, text_col)
    if length < ANCHOR:
        raise ValueError(f"length must be {ANCHOR} at least")
    repeated = stored(_hashes(docs, length).groupBy("anchor").count().filter("count > 1").select("anchor"))
    wanted = Bloom.of(repeated, "anchor")
    release(spark)
    segments = _segments(docs, wanted, length)
    segments = stored(segments if wanted is not None else segments.join(repeated, "anchor", "left_semi"))
    discard(repeated)
    first = segments.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "k", "start")).alias("first"), F.first("n").alias("n"), F.count("*").alias("copies"))
    first = stored(first)
    release(spark)
    bound = max(COMMON, (first.agg(F.sum("copies")).first()[0] or 0) >> 18)
    earliest, pair = first.select("anchor", "content", "first", "copies"), ["anchor", "content"]
    # fewer than 2^18 pairs have more copies than the bound
    common = F.broadcast(earliest.filter(F.col("copies") > bound).drop("copies"))
    rare = earliest.filter((F.col("copies") > 1) & (F.col("copies") <= bound)).drop("copies")
    copies = segments.join(common, pair).unionByName(segments.join(common, pair, "left_anti").join(rare, pair))
    copies = copies.filter(~F.struct("doc_id", "k", "start").eqNullSafe(F.col("first")))
    marked = copies.select("doc_id", "k", F.col("start").alias("from"), (F.col("start") + F.col("n") - 1 + length).alias("to"))

    kinds = first.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    undecided = first.join(kinds, "anchor").select("anchor", "kinds", "first.*", "n")
    of_docs = undecided.groupBy("doc_id", "k").agg(F.collect_list(F.struct("anchor", "start", "n", "kinds")).alias("parts"))
    of_docs = stored(of_docs)
    likely = docs.filter(may_have(Bloom.of(of_docs, "k"), spark, F.col("k")))
    same = [F.col("d.k") == F.col("p.k"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))]
    once = likely.alias("d").join(of_docs.alias("p"), same[0] & same[1]).select("d.doc_id", "d.k", "text", "parts")
    cut = once.select("doc_id", "k", "text", F.explode("parts").alias("p"))
    cut = cut.select("doc_id", "k", "p.anchor", "p.start", "p.kinds", F.substring("text", F.col("p.start").cast("int") + 1, (F.col("p.n") - 1 + length).cast("int")).alias("bytes"))
    cut = stored(cut.dropDuplicates(["doc_id", "k", "start"]))
    release(spark)
    marked = marked.unionByName(_marked_by_index(cut.filter(F.col("kinds") <= hot), length))
    marked = marked.unionByName(_marked_by_hash(cut.filter(F.col("kinds") > hot), length))
    return marked.groupBy("doc_id", "k").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text, and how many maximal runs were removed."""
    out, done, runs = [], 0, 0
    for start, end in sorted(spans):
        if start > done or not runs:
            out.append(raw[done:start])
            runs += 1
        done = max(done, end)
    return b"".join([*out, raw[done:]]), runs


def _with_spans(df: DataFrame, docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (with k) that may have spans with these, null if none, and all others as they are.
    Only the former are shuffled, always: so the filter's Python workers are done when those of
    what follows begin, and a task never holds two."""
    found = stored(found)
    release(df.sparkSession)
    flagged = docs.withColumn("_may", may_have(Bloom.of(found, "k"), df.sparkSession, F.col("k")))
    f = found.select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "spans").hint("merge")
    joined = flagged.filter("_may").join(f, (F.col("k") == F.col("_k")) & F.col("_key").eqNullSafe(F.col("_id")), "left").drop("_id", "_k", "_may")
    return joined, flagged.filter("not _may").drop("_may")


SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove_repeats_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = 3000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    found = marks(df, id_col, text_col, length, hot)
    docs = _keyed(df, id_col, text_col).withColumn("_key", F.col("doc_id"))
    rows, others = _with_spans(df, docs, found)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, raw, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                kept, runs = kept_bytes(raw, [(s["from"], s["to"]) for s in spans or ()])
                out.append((key, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            yield _batch(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    none = F.lit(0).cast("long")
    whole = others.select("doc_id", F.length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return rows.select("doc_id", "text", "spans").mapInArrow(digest, SCHEMA).unionByName(whole)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = 3000, length_col: str | None = "n_chars") -> DataFrame:
    """``df``, all rows and columns, with repeated bytes removed from the texts; bytes of
    a character that is cut in two go with it. The length in code points is renewed."""
    found = marks(df, id_col, text_col, length, hot)
    names = df.columns
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    docs = df.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(id_col).cast("long").alias("_key"), F.xxhash64(F.col(id_col).cast("long"), raw).alias("k"))
    rows, others = _with_spans(df, docs, found)
    columns = {c: F.col(f"row.`{c}`").alias(c) for c in names}
    rows = rows.select(*columns.values(), F.col("spans").alias("_spans"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index(text_col)
            texts = [t if not spans else kept_bytes(t.encode(), [(s["from"], s["to"]) for s in spans])[0].decode("utf-8", "ignore") for t, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if length_col in names:
                k = names.index(length_col)
                columns[k] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    if length_col in names:
        columns[length_col] = F.length(f"row.`{text_col}`").cast(df.schema[length_col].dataType).alias(length_col)
    return rows.mapInArrow(rewrite, df.schema).unionByName(others.select(*columns.values()))
