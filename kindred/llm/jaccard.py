"""Exact Jaccard self-join of documents on word n-grams, by regions, windows and pivots.

Documents are sets of hashed word n-grams; 1 - Jaccard similarity is a metric. Between
unrelated texts it is 1, so cells around sampled pivots alone would put nearly all
documents into one region. Regions here are cells of coarse projections instead:

1. Equal sets are one point of the space.
2. Distance to the empty set: a region is a range of set sizes. Sets in reach of the
   next range's lower end (the triangle inequality's window) are copied to it.
3. In a region sets differ in at most h n-grams if linked. The space of n-grams is dealt
   into h + 1 + e parts, so that two linked sets agree on more than e parts whole.
   A cell holds the sets that agree on one part. Parts without n-grams make no cell
   for a set that has at most e of them. A set stays in a range only if it shares as many
   cells there as a linked set would make it share (e + 1 less its empty parts), so the few
   cells of a passage that unrelated texts have in common hold nothing.
4. In each cell a pivot is elected (the set in most cells) and the distance of all others to it
   is measured exactly. Members within 1/2 are its Voronoi region; those up to 1/2 plus
   the linking distance are copied to it, as the triangle inequality lets them link
   into it. A region joins on the differences of its sets from the pivot, by the rarest
   elements of these: linear for copies of one text that each have edits of their own.
5. The far members of cells that still hold more than one set (or component, where these
   alone are wanted) join again, recursively, in finer cells: each set is filed under its rarest elements among them.
   Several pivots are elected there at a time, until no cell is open.

Every pair that is linked meets in a cell, and there in a region of one of its pivots or
among the far members; a pair is left unmeasured only if the bounds above rule a link
out. So links and components are exact (up to collisions of 64-bit hashes within a cell).
Where components alone are wanted, pairs that are known to be connected go unmeasured, too.

Where links are counted, a set has a home: the first region that it came into. With size s and
apart, the elements in which it differs from the pivot, its reach is
(100 - percent) s - (100 + percent) apart. Two sets of one home whose reaches add up to 0 or more
are linked, by the triangle inequality, whatever their differences have in common; these pairs are
counted from the reaches alone. All others are measured, those of one home in that home only. So
a group of near copies costs as much as it has members, not pairs.

Words are the runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. With
fewer words than n the whole sequence is the only element. Null, empty and blank texts
have empty sets, which link with nothing. Each row of a repeated key is a document of its
own; rows with a null key form a component only with what they link to, whose id is
the smallest non-null key or else null.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, discard, id_and_text, release, stored
from kindred.llm.graph import Bloom, components, may_have

_B = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
#: Words of a difference's sketch; a power of two.
SKETCH = 4
#: Cells are counted in as many turns; and a set is in fewer ranges than these.
SLICES, RANGES = 4, 16
_RANGE = np.uint64(RANGES - 1)


def _powers(base: np.uint64, n: int, memo: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    have = memo.get(int(base))
    if have is None or len(have) < n:
        have = memo[int(base)] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(1 << 14, 2 * n), base, np.uint64))])
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes | None, n: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    if not raw:
        return np.empty(0, np.uint64)
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)
    gap = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * _powers(_B, len(data)), out=sums[1:])
    words = mix((sums[end] - sums[start]) * _powers(_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))
    if len(words) < n:
        h, tag = words[:1], len(words)
        for w in words[1:]:
            h = mix(h * _B + w)
        return mix(h + np.uint64(tag))
    h = words[: len(words) - n + 1]
    for k in range(1, n):
        h = mix(h * _B + words[k : len(words) - n + 1 + k])
    return np.unique(mix(h + np.uint64(n)))


class Cells:
    """Where a set is filed, for a link at 100 * intersection >= percent * union."""

    GROWTH = 1.4

    def __init__(self, percent: int):
        if not 50 <= percent < 100:
            raise ValueError("percent must be 50 to 99")
        self.percent, self.starts = percent, [1]

    def most_apart(self, larger: int) -> int:
        """n-grams in which two linked sets of at most this size differ: union -
        intersection <= (1 - p) union, and union <= (a + b) / (1 + p)."""
        return (100 - self.percent) * 2 * larger // (100 + self.percent)

    def ranges(self, size: int) -> list[int]:
        while self.starts[-1] <= size:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * self.GROWTH)))
        own = int(np.searchsorted(self.starts, size, "right")) - 1
        # a larger partner has at most size / p n-grams
        reach = size * 100 // self.percent
        out = [own]
        while self.starts[out[-1] + 1 if out[-1] + 1 < len(self.starts) else -1] <= reach and out[-1] + 1 < len(self.starts):
            out.append(out[-1] + 1)
        return out

    def of(self, s: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Cell ids of a sorted set, and by range how many of them the set shares at least if
        it has a link there. The low bits of a cell are those of its range."""
        out, needs = [], []
        for r in self.ranges(len(s)):
            if r + 1 >= len(self.starts):
                self.ranges(self.starts[-1])
            h = self.most_apart(self.starts[r + 1] - 1)
            if not h:
                continue  # linked sets of this size are equal
            spare = 1 + h // 5
            k = h + 1 + spare
            cuts = np.searchsorted((s >> np.uint64(32)) * np.uint64(k) >> np.uint64(32), np.arange(k + 1, dtype=np.uint64))
            sums = np.zeros(len(s) + 1, np.uint64)
            np.cumsum(mix(s ^ _B), out=sums[1:])
            held = np.diff(cuts)
            part = np.arange(k, dtype=np.uint64)
            cell = mix(sums[cuts[1:]] - sums[cuts[:-1]] + mix(part + np.uint64(k << 24) + (np.uint64(r) << np.uint64(50))))
            cell = cell & ~_RANGE | np.uint64(r % RANGES)
            empty = k - int(np.count_nonzero(held))
            # of the more than ``spare`` parts on which a linked set agrees, ``empty`` may have no cell;
            # with more empty ones than that, the linked set may have ``spare`` without a cell
            out.append(cell[held > 0] if empty <= spare else cell)
            needs.append((r % RANGES, spare + 1 - empty if empty <= spare else 1))
        return (np.concatenate(out) if out else np.empty(0, np.uint64)), needs


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


_SLICES = [f"cells_{k}" for k in range(SLICES)]


def _points(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, row (a hash of the text as it stands), size, the set's digest (d1, d2), what it must
    share (16 * number + range's low bits) and its cells, in columns by two bits of the cell."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filing = Cells(percent)
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
            digests = [_digest(s) for s in sets]
            filed = [filing.of(s) for s in sets]
            needs = _lists([np.array([RANGES * need + r for r, need in needs], np.int32) for _, needs in filed], pa.int32())
            slices = [_lists([cells[(cells >> np.uint64(60)) % np.uint64(SLICES) == k].view(np.int64) for cells, _ in filed], pa.int64()) for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in digests], pa.int64()), pa.array([b for _, b in digests], pa.int64()), needs, *slices], ["doc_id", "row", "size", "d1", "d2", "needs", *_SLICES])

    return docs.withColumn("row", F.xxhash64("text")).mapInArrow(file, "doc_id bigint, row bigint, size bigint, d1 bigint, d2 bigint, needs array<int>, " + ", ".join(f"{c} array<bigint>" for c in _SLICES))


def _members(filed: DataFrame) -> DataFrame:
    """d1, d2, cell where a cell holds another set, too, and the set has what it needs of these."""
    spark, shared = filed.sparkSession, []
    for column in _SLICES:
        cells = filed.select("d1", F.explode(column).alias("cell"))
        # min and max by cell, before the shuffle: a cell with one set is of no use
        shared.append(stored(cells.groupBy("cell").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).filter("low <> high").select("cell")))
        release(spark)  # a slice's shuffle goes before the next one's
    wanted = functools.reduce(DataFrame.unionByName, shared)
    bloom = Bloom.of(wanted, "cell")
    sent = spark.sparkContext.broadcast(bloom)  # its size is bounded

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, of = [], []
            for column in _SLICES:
                lists = batch.column(column)
                of.append(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())))
                held.append(lists.flatten().to_numpy(zero_copy_only=False))
            flat, of = np.concatenate(held), np.concatenate(of)
            if sent.value is not None:
                passed = sent.value.may_have(flat)
                flat, of = flat[passed], of[passed]
            lists = batch.column("needs")
            told = lists.flatten().to_numpy(zero_copy_only=False)
            needs = np.zeros(len(lists) * RANGES, np.int64)
            needs[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())) * RANGES + told % RANGES] = told // RANGES
            own = of * RANGES + (flat & (RANGES - 1))
            kept = np.bincount(own, minlength=len(needs))[own] >= needs[own]
            at = pa.array(of[kept])
            yield pa.RecordBatch.from_arrays([batch.column("d1").take(at), batch.column("d2").take(at), pa.array(flat[kept]), pa.array(needs[own[kept]].astype(np.int32))], ["d1", "d2", "cell", "need"])

    likely = filed.filter("size > 0").select("d1", "d2", "needs", *_SLICES).mapInArrow(few, "d1 bigint, d2 bigint, cell bigint, need int")
    members = likely.join(wanted, "cell", "left_semi").distinct()
    if bloom is None:  # no count was taken before the join
        members = stored(members)
        own = ["d1", "d2", (F.col("cell").bitwiseAND(F.lit(RANGES - 1))).alias("range")]
        enough = members.groupBy(*own).agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("n >= need").select("d1", "d2", "range")
        members = members.withColumn("range", own[2]).join(enough, ["d1", "d2", "range"], "left_semi")
    out = stored(members.select("d1", "d2", "cell"))
    discard(*shared)
    return out


def _sets(docs: DataFrame, n: int, wanted: Bloom | None) -> DataFrame:
    """row, d1, d2 and the elements of the rows that are wanted, once a task; a few others may
    come along."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)  # its size is bounded

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            hashes = batch.column("row").to_numpy()
            at = np.arange(len(hashes)) if sent.value is None else np.flatnonzero(sent.value.may_have(hashes))
            if len(seen) > 1_000_000:
                seen.clear()
            at = [k for k in at.tolist() if hashes[k] not in seen and not seen.add(hashes[k])]
            sets = [(int(hashes[k]), shingles(text, n)) for k, text in zip(at, batch.column("text").take(pa.array(at, pa.int64())).to_pylist(), strict=True)]
            sets = [(row, s) for row, s in sets if len(s)]
            digests = [_digest(s) for _, s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([row for row, _ in sets], pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), _lists([s.view(np.int64) for _, s in sets], pa.int64())], ["row", "d1", "d2", "elements"])

    return docs.select(F.xxhash64("text").alias("row"), "text").mapInArrow(read, "row bigint, d1 bigint, d2 bigint, elements array<bigint>")


def _measured(pairs: DataFrame, points: DataFrame, window: int | None = None) -> DataFrame:
    """a, b, size_a, size_b, copies_a, copies_b, common and lacking of pairs (a, b) of points.
    lacking: the elements that one of the two lacks, if at least ``window`` per cent of the
    union are common; else, and with no window, null."""
    a = points.select(F.col("id").alias("a"), F.col("elements").alias("of_a"), F.col("copies").alias("copies_a"))
    b = points.select(F.col("id").alias("b"), F.col("elements").alias("of_b"), F.col("copies").alias("copies_b"))
    both = pairs.join(a, "a").join(b, "b")
    both = both.withColumn("only_a", F.array_except("of_a", "of_b"))
    both = both.select("a", "b", F.size("of_a").alias("size_a"), F.size("of_b").alias("size_b"), "copies_a", "copies_b", (F.size("of_a") - F.size("only_a")).alias("common"), "only_a", "of_a", "of_b")
    # elements of a set are distinct, so the two differences are disjoint
    apart = F.when(_linked(window), F.concat("only_a", F.array_except("of_b", "of_a"))) if window is not None else F.lit(None).cast("array<bigint>")
    return both.select("a", "b", "size_a", "size_b", "copies_a", "copies_b", "common", apart.alias("lacking"))


def _linked(percent: int):
    return F.expr(f"100L * common >= {percent}L * (size_a + size_b - common)")


def _labelled(points: DataFrame, known: DataFrame | None) -> DataFrame:
    """With no known components each point is its own, so that nothing is passed over."""
    if known is None:
        return points.withColumn("component", F.col("id"))
    return points.join(known.withColumnRenamed("v", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _open(cells: DataFrame, known: DataFrame | None) -> DataFrame:
    """cell, id of the cells that hold more than one component."""
    labelled = stored(_labelled(cells.select("cell", "id"), known))
    several = labelled.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("cell")
    out = stored(labelled.join(several, "cell", "left_semi").select("cell", "id"))
    discard(labelled)
    return out


def _elected(cells: DataFrame, pivots: int) -> DataFrame:
    """cell, pivot: the smallest ids of each cell, or one that is in most cells: a text with few
    edits of its own, so that the cells of near copies agree on few pivots. Minima and the limit
    act before the shuffle."""
    if pivots == 1:
        spread = cells.groupBy("id").agg((-F.count("*")).alias("minus"))
        return cells.join(spread, "id").groupBy("cell").agg(F.min(F.struct("minus", "id")).alias("best")).select("cell", F.col("best.id").alias("pivot"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("id"))
    return cells.withColumn("_rank", rank).filter(F.col("_rank") <= pivots).select("cell", F.col("id").alias("pivot"))


def _round(cells: DataFrame, points: DataFrame, pivots: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distances (a: pivot, b: member, sizes, common, lacking) of the members of each cell to its
    pivots, and the cells of those that are still to be joined: members within 1/2 of a
    pivot leave, as whatever links to them is within the pivot's region."""
    elected = _elected(cells, pivots)
    met = cells.join(elected, "cell").filter("id <> pivot")
    measured = stored(_measured(met.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), points, percent - 50))
    near = measured.filter("2 * common > size_a + size_b - common").select(F.col("a").alias("pivot"), F.col("b").alias("id"))
    gone = met.select("cell", "id", "pivot").join(near, ["pivot", "id"]).select("cell", "id").distinct()
    gone = gone.unionByName(elected.select("cell", F.col("pivot").alias("id"))).distinct()
    return measured, cells.join(gone, ["cell", "id"], "left_anti")


def _refiled(cells: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Cells of a finer projection for the members of open cells: a set is filed under
    the rarest of its elements, as many as a linked set can lack, and one more. Rare
    means among these members, so passages that unrelated texts share make no cell."""
    sets = points.join(cells.select("id").distinct(), "id").withColumn("size", F.size("elements"))
    held = sets.select("id", "size", F.explode("elements").alias("cell"))
    often = held.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    shared = held.join(often, "cell")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("n", "cell"))  # a set's own elements
    ranked = shared.withColumn("rank", rank).withColumn("shared", F.count("*").over(Window.partitionBy("id")))
    # elements that no other set has are the rarest and need no cell
    return ranked.filter(F.expr(f"size - shared + rank <= size - ceil({percent} * size / 100) + 1")).select("cell", "id")


def _parities(elements: str, word: int):
    """Word ``word`` of the sketch of an array of distinct, well-mixed hashes."""
    return F.expr(f"aggregate(filter({elements}, e -> (shiftright(e, 6) & {SKETCH - 1}) = {word}), 0L, (bits, e) -> bits ^ shiftleft(1L, cast(e & 63 as int)))")


def _housed(homes: DataFrame | None, measured: DataFrame, percent: int, turn: int) -> DataFrame:
    """id, home (a hash of pivot and turn) and reach of each set that is in a region; the home is
    the smallest pivot's of the first turn that has one. A pivot is at no distance from itself."""
    region = measured.filter("lacking is not null")
    came = region.select(F.col("b").alias("id"), "a", F.size("lacking").cast("bigint").alias("apart"), F.col("size_b").cast("bigint").alias("size"))
    pivots = region.select(F.col("a").alias("id"), "a", F.lit(0).cast("bigint").alias("apart"), F.col("size_a").cast("bigint").alias("size"))
    first = came.unionByName(pivots).groupBy("id").agg(F.min(F.struct("a", "apart", "size")).alias("to"))
    if homes is not None:
        first = first.join(homes.select("id"), "id", "left_anti")
    new = first.select("id", _home("to.a", turn).alias("home"), F.expr(f"{100 - percent}L * to.size - {100 + percent}L * to.apart").alias("reach"))
    out = stored(new if homes is None else homes.unionByName(new))
    discard(homes)
    return out


def _home(pivot: str, turn: int):
    return F.xxhash64(F.col(pivot), F.lit(turn))


def _stars(homes: DataFrame) -> DataFrame:
    """a, b: of each home, the set of the farthest reach and what it is linked to by reach. Whatever
    is linked to any set of its home by reach is linked to that one."""
    best = homes.groupBy("home").agg(F.max(F.struct("reach", "id")).alias("best"))
    return homes.join(best, "home").filter("id <> best.id and reach + best.reach >= 0").select(F.col("best.id").alias("a"), F.col("id").alias("b"))


def _unhoused(links: DataFrame, homes: DataFrame) -> DataFrame:
    """The links that reaches don't tell."""
    for end in ("a", "b"):
        links = links.join(homes.select(F.col("id").alias(end), F.col("home").alias(f"home_{end}"), F.col("reach").alias(f"reach_{end}")), end, "left")
    return links.filter("not coalesce(home_a = home_b and reach_a + reach_b >= 0, false)").select("a", "b", "copies_a", "copies_b")


def _in_regions(measured: DataFrame, known: DataFrame | None, percent: int, homes: DataFrame | None = None, turn: int = 0) -> DataFrame:
    """Pairs that may link among the sets of each pivot's region, which are those within 1/2,
    and in the triangle inequality's window beyond. A set there is its difference from the
    pivot; two sets differ in what their differences differ in, so of two linked ones the
    smaller difference has one of its h / 2 + 1 rarest elements among the h + 1 rarest of
    the larger. Copies of one text, with edits of their own, share no such element. Those
    that share one by chance are told apart by sketches: the parities of a difference's
    elements, dealt into SKETCH words of 64 bits. Two sketches differ in at most as many
    bits as the two sets differ in elements, so a pair with more than a link allows goes."""
    region = measured.filter("lacking is not null")
    # a region of one component (with none known: of one set) has nothing to find
    named = _labelled(region.select(F.col("b").alias("id"), "a"), known)
    several = named.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("a")
    of = _labelled(region.join(several, "a", "left_semi").select(F.col("b").alias("id"), "a", F.col("size_b").alias("size"), "lacking"), known)
    extra: list[str] = []
    if homes is not None:
        of = of.join(homes, "id")
        most = of.groupBy("a", "home").agg(F.count("*").alias("n")).groupBy("a").agg(F.max(F.struct("n", "home")).alias("most"))
        of = of.join(most, "a").withColumn("own", F.col("home") == _home("a", turn))
        # pairs of settled sets are told by their reaches, or looked at in another region
        of = of.withColumn("settled", (F.col("home") == F.col("most.home")) & (~F.col("own") | (F.col("reach") >= 0))).drop("most")
        of = of.join(of.filter("not settled").select("a").distinct(), "a", "left_semi")
        extra = ["home", "own", "reach", "settled"]
    of = of.withColumn("apart", F.size("lacking")).withColumn("h", F.expr(f"({100 - percent}L * (size + (size * 100L) div {percent})) div {100 + percent}"))
    words = [f"s{k}" for k in range(SKETCH)]
    state = ["a", "id", "size", "component", "apart", "h", *words, *extra]
    of = of.select("*", *[_parities("lacking", k).alias(word) for k, word in enumerate(words)])
    of = stored(of.select(*state, "lacking"))
    # ranks are found on keys alone; what describes a set comes after
    held = of.select("a", "id", "apart", F.explode("lacking").alias("e"))
    often = held.groupBy("a", "e").agg(F.count("*").alias("n")).filter("n > 1")
    shared = held.join(often, ["a", "e"])
    own = Window.partitionBy("a", "id")
    ranked = shared.withColumn("rank", F.row_number().over(own.orderBy("n", "e"))).withColumn("rank", F.col("apart") - F.count("*").over(own) + F.col("rank"))
    ranked = ranked.select("a", "id", "e", "rank").join(of.select(*state), ["a", "id"])
    large = stored(ranked.filter("rank <= h + 1").select("a", "e", *state[1:], "rank"))
    # no shared element is needed if the two differences together are at most h
    first = F.lit(1).alias("rank")
    alone = of.filter("apart <= h").select(F.col("a"), F.col("apart").cast("bigint").alias("e"), *state[1:], first)
    small = large.filter("rank <= h div 2 + 1")
    reach = of.filter("apart <= h").select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("h") - F.col("apart")).cast("bigint"))).alias("e"), *state[1:], first)

    def allowed(differing: str):
        return F.expr(f"{100 + percent}L * ({differing}) <= {100 - percent}L * (x.size + y.size)")

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        # a pair is looked at from its smaller difference, in equal ones from its smaller id
        both = x.alias("x").join(y.alias("y"), ["a", "e"]).filter("x.component <> y.component and (x.apart < y.apart or x.apart = y.apart and x.id < y.id)")
        if homes is not None:
            both = both.filter("x.home <> y.home or x.own and x.reach + y.reach < 0")
        # the first element that both have leaves room behind it for all they must share
        both = both.filter(allowed("2 * (x.rank - 1) + y.apart - x.apart")).filter(allowed("2 * (y.rank - 1) + x.apart - y.apart"))
        both = both.filter(allowed("y.apart - x.apart")).filter(allowed(" + ".join(f"bit_count(x.{w} ^ y.{w})" for w in words)))
        return both.filter(F.expr(f"100L * least(x.size, y.size) >= {percent}L * greatest(x.size, y.size)")).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        if homes is None:
            return met(x, y)
        return met(x.filter("not settled"), y).unionByName(met(x.filter("settled"), y.filter("not settled")))

    out = stored(joined(small, large).unionByName(joined(alone, reach)).distinct())
    discard(of, large)
    return out


def _grown(known: DataFrame | None, found: DataFrame) -> DataFrame:
    """id, component once the links (a, b) are known, too, as a stored table; ``known`` goes.
    Only links between different components count, and they are joined as links between these."""
    if known is None:
        merged = components(found)
        out = stored(merged.withColumnRenamed("v", "id"))
        discard(merged)
        return out
    for end in ("a", "b"):
        label = known.select(F.col("id").alias(end), "component")
        found = found.join(label, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    merged = components(found.filter("a <> b"))
    of = merged.select(F.col("v").alias("component"), F.col("component").alias("further"))
    old = known.join(of, "component", "left").select("id", F.coalesce("further", "component").alias("component"))
    new = merged.withColumnRenamed("v", "id").join(known.select("id"), "id", "left_anti").select("id", "component")
    out = stored(old.unionByName(new))
    discard(known, merged)
    return out


def link_points(members: DataFrame, points: DataFrame, percent: int, pivots: int = 8, links: str | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """id and component of what is linked to something. members: (cell, id); points: (id,
    elements, copies: how many rows have the set). With ``links`` "pairs" also all links (a, b,
    copies_a, copies_b), a < b, once each; with "counts" those that reaches don't tell, and the
    homes (id, home, reach) that tell the others. With neither, pairs that are known to be
    connected aren't measured."""
    cells, turn, known, every, homes = members.select("cell", "id"), 0, None, [], None
    while turn == 0 or not cells.isEmpty():
        measured, rest = _round(cells, points, pivots if turn else 1, percent)
        linked, turned = measured.filter(_linked(percent)), F.col("a") > F.col("b")
        near = stored(linked.select(*[F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("copies_a", "copies_b"), ("copies_b", "copies_a"))]))
        if not links and (known is None or not near.isEmpty()):
            known = _grown(known, near)
        if links == "counts":
            homes = _housed(homes, measured, percent, turn)
        pairs = _in_regions(measured, None if links else known, percent, homes, turn)
        found = stored(_measured(pairs, points).filter(_linked(percent)).select("a", "b", "copies_a", "copies_b"))
        discard(pairs)
        release(cells.sparkSession)
        if not links and not found.isEmpty():
            known = _grown(known, found)
        over, cells = cells, _open(rest, None if links else known)
        discard(measured, over)
        if turn == 0 and not cells.isEmpty():
            far, cells = cells, stored(_refiled(cells, points, percent))
            discard(far)
            over, cells = cells, _open(cells, None if links else known)
            discard(over)
        if links:
            every += [near, found]
        else:
            discard(near, found)
        release(cells.sparkSession)
        turn += 1
    discard(cells)
    if not links:
        return known, None, None
    out = stored(functools.reduce(DataFrame.unionByName, every).distinct())
    discard(*every)
    # components weren't needed before, so they are found once
    known = _grown(None, out if homes is None else out.select("a", "b").unionByName(_stars(homes)))
    if homes is not None:
        alike, out = out, stored(_unhoused(out, homes))
        discard(alike)
    return known, out, homes


def _linked_sets(docs: DataFrame, n: int, percent: int, links: str | None) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """The documents' points, without cells; id, d1, d2 and component of the sets that share
    enough cells (null if they link with none); and links and homes as of ``link_points``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    points = stored(_points(docs, n, percent))
    filed = stored(points.select("doc_id", "row", "size", "d1", "d2"))
    members = _members(points)
    discard(points)
    # a row of each set, so that copies are read and shuffled once
    involved = members.select("d1", "d2").distinct()
    rows = stored(filed.join(involved, ["d1", "d2"], "left_semi").groupBy("d1", "d2").agg(F.min("row").alias("row"), F.count("*").alias("copies")))
    release(spark)
    sets = _sets(docs, n, Bloom.of(rows, "row")).join(rows, ["d1", "d2", "row"])
    found = sets.groupBy("d1", "d2").agg(F.first("elements").alias("elements"), F.first("copies").alias("copies"))
    points = stored(found.withColumn("id", F.monotonically_increasing_id()))
    names = stored(points.select("d1", "d2", "id"))
    cells = stored(members.join(names, ["d1", "d2"]).select("cell", "id"))
    discard(members, rows)
    release(spark)
    known, pairs, homes = link_points(cells, points.select("id", "elements", "copies"), percent, links=links)
    named = stored(names.join(known, "id", "left"))
    discard(points, names, cells, known)
    return filed, named, pairs, homes


def _told(filed: DataFrame, named: DataFrame, links: DataFrame, homes: DataFrame) -> DataFrame:
    """d1, d2, n_links and component_id of each set that isn't empty."""
    # equal sets: a row a digest first, so that copies cost nothing in what follows
    least = filed.filter("size > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    of_sets = stored(least.join(named, ["d1", "d2"], "left"))
    copies = of_sets.filter("id is not null").select("id", "copies")
    # a link brings the copies of both ends, so these are summed before any shuffle
    ends = links.select(F.col("a").alias("id"), F.col("copies_b").alias("n")).unionByName(links.select(F.col("b").alias("id"), F.col("copies_a").alias("n")))
    others = ends.groupBy("id").agg(F.sum("n").alias("others"))
    # rows whose reach is at least what a set lacks to 0: sums over the few reaches of a home
    housed = homes.join(copies, "id")
    held = housed.groupBy("home", "reach").agg(F.sum("copies").alias("n"))
    asked = held.select("home", "reach", (-F.col("reach")).alias("key"), F.lit(1).alias("last"), F.lit(0).cast("bigint").alias("n"))
    held = held.select("home", "reach", F.col("reach").alias("key"), F.lit(0).alias("last"), "n")
    upto = Window.partitionBy("home").orderBy(F.desc("key"), "last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = held.unionByName(asked).withColumn("within", F.sum("n").over(upto)).filter("last = 1").select("home", "reach", "within")
    # a set's own copies are counted apart
    told = housed.join(within, ["home", "reach"]).select("id", (F.col("within") - F.when(F.col("reach") >= 0, F.col("copies")).otherwise(0)).alias("by_reach"))
    none = F.lit(0).cast("bigint")
    of_sets = of_sets.join(others, "id", "left").join(told, "id", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", none) + F.coalesce("by_reach", none))
    of_parts = of_sets.filter("component is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    return stored(of_sets.join(of_parts, "component", "left").select("d1", "d2", "n_links", F.coalesce("smallest", "least").alias("component_id")))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (to other rows, equal sets among them)
    of each row."""
    filed, named, links, homes = _linked_sets(id_and_text(df, id_col, text_col, binary=True), n, percent, "counts")
    told = _told(filed, named, links, homes)
    discard(named, links, homes)
    rows = filed.select("doc_id", "size", "d1", "d2")
    out = rows.filter("size > 0").join(told, ["d1", "d2"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id", "n_links")
    return out.unionByName(rows.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links")))


def linked_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """All links, as pairs (a, b), a < b, of representatives, and membership: doc_id and
    representative of each row. A representative stands for rows of one set, which are linked
    with one another; it is a number of this call and null for empty sets."""
    filed, named, links, _ = _linked_sets(id_and_text(df, id_col, text_col, binary=True), n, percent, "pairs")
    sets = filed.filter("size > 0").select("d1", "d2").distinct().join(named, ["d1", "d2"], "left")
    # sets that share no cell have no links; their numbers are below those of the others
    sets = stored(sets.select("d1", "d2", F.coalesce("id", -1 - F.monotonically_increasing_id()).alias("representative")))
    rows = filed.select("doc_id", "size", "d1", "d2")
    membership = rows.filter("size > 0").join(sets, ["d1", "d2"]).select("doc_id", "representative")
    return links.select("a", "b"), membership.unionByName(rows.filter("size = 0").select("doc_id", F.lit(None).cast("bigint").alias("representative")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``df``, all columns, of which one of each group stays, a whole row: one with the
    group's smallest key (null comes last), and of those one of the same text. Rows with
    empty sets are in no group and all stay, as does what links to nothing, whatever its key."""
    filed, named, _, _ = _linked_sets(id_and_text(df, id_col, text_col, binary=True), n, percent, None)
    rows = filed.filter("size > 0").groupBy("d1", "d2", "doc_id", "row").agg(F.lit(1))
    least = rows.groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"))
    least = stored(least.join(named.filter("component is not null").select("d1", "d2", "component"), ["d1", "d2"], "left").select("component", "first"))
    firsts = least.filter("component is null").select("first").unionByName(least.filter("component is not null").groupBy("component").agg(F.min("first").alias("first")).select("first"))
    kept = firsts.select("first.doc_id", "first.row", F.lit(False).alias("_all")).unionByName(filed.filter("size = 0").select("doc_id", "row", F.lit(True).alias("_all")).distinct())

    def named_by(key, row):
        # a null key as two columns, so that joins need no null-safe comparison
        return F.coalesce(key, F.lit(0).cast("bigint")).alias("_key"), key.isNull().alias("_null"), row.alias("_row")

    same, spark = ["_key", "_null", "_row"], df.sparkSession
    kept = kept.select(*named_by(F.col("doc_id"), F.col("row")), "_all")
    there = filed.select(*named_by(F.col("doc_id"), F.col("row"))).groupBy(*same).agg(F.count("*").alias("_n"))
    # rows that go, and rows of which one stays; all others stay where they are, unshuffled
    told = there.join(kept, same, "left").filter("_all is null or _n > 1 and not _all").select(*same, F.col("_all").isNotNull().alias("_one"))
    told = stored(told.withColumn("_hash", F.xxhash64(*same)))
    bloom = Bloom.of(told, "_hash")
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_whole"), *named_by(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string").cast("binary"))))
    keyed = keyed.withColumn("_may", may_have(bloom, spark, F.xxhash64(*same)))
    looked = keyed.filter("_may").join(told.select(*same, "_one"), same, "left")
    once = looked.filter("_one").groupBy(*same).agg(F.first("_whole").alias("_whole"))
    out = keyed.filter("not _may").select("_whole").unionByName(looked.filter("_one is null").select("_whole")).unionByName(once.select("_whole"))
    discard(least)
    return out.select(*[F.col(f"_whole.`{c}`").alias(c) for c in df.columns])
