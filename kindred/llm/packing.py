"""Best-fit packing of token sequences with certified bin counts.

Documents are tokenised whole and closed with an end id; one longer than a sequence is
cut into full pieces, the first of which may be shorter. Full pieces are sequences of
their own. The others are dealt to partitions of bounded size and each is packed by
best-fit decreasing. Dual feasible functions bound from below how many sequences a
partition needs (the sum, Martello and Toth's thresholds, and rounded multiples); a
partition that meets its bound is certified. Those with a gap give up the documents of
all sequences that aren't full; certified ones give up those of their emptiest sequence.
What was given up is dealt anew and packed again, until one partition holds it all, the whole
count meets the whole table's bound, or a turn neither closes nor saves a sequence.

``bounds`` gives the number of sequences and the bound for the table. Null texts count
as empty: one piece, the end id. Equal rows are packed as the separate rows they are.
An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, id_and_text, stored

#: The public pre-tokenisation pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """Ids as the ``tokenizers`` library gives them for a byte-level BPE file, special
    tokens in a text included. Its merges are run by ``tiktoken``, several times as fast;
    texts with a special token's string, and files whose ids aren't in merge order or
    that split, normalise or merge otherwise, go to ``tokenizers`` itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        # the byte-level alphabet: printable bytes stand for themselves, others from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        alphabet = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
        vocabulary = spec["model"]["vocab"]
        try:
            import tiktoken

            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
            fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
            made = [vocabulary[m.replace(" ", "")] for m in merges]
            before = spec.get("pre_tokenizer") or {}
            as_pattern = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            whole = not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            if made == sorted(made) and as_pattern and whole and spec.get("normalizer") is None and not spec.get("truncation"):
                self.fast = fast
        except (ImportError, KeyError):
            pass

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(self.fast._core_bpe.encode_to_tiktoken_buffer(text, set()), "<u4")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Tokens:
    return Tokens(path)


# -- bounds and best fit --------------------------------------------------------
def lower_bound(count: np.ndarray, capacity: int) -> int:
    """No packing of count[s] items of each size s, 0 to capacity, has fewer bins; the best of
    a family of dual feasible functions."""
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # over thresholds a: larger than capacity - a counts whole, smaller than a not at all
    many, mass = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * size))
    a = np.arange(1, capacity // 2 + 1)
    whole = many[-1] - many[capacity - a + 1]
    middle = mass[capacity - a + 1] - mass[a]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 33):  # x -> floor((k + 1) x) / k, or x where (k + 1) x is whole
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing. Bin and offset of each item, and how full each bin is."""
    order = np.argsort(-lengths, kind="stable")
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    rooms = 0  # bit r is set if a bin has room r
    bins, offsets, free = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for item, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = room_of[room].pop()
            if not room_of[room]:
                rooms ^= 1 << room
        else:
            room, own = capacity, len(free)
            free.append(capacity)
        bins[item], offsets[item] = own, capacity - room
        room -= size
        free[own] = room
        if room:
            if not room_of[room]:
                rooms |= 1 << room
            room_of[room].append(own)
    return bins, offsets, capacity - np.array(free, np.int64)


# -- over tables ------------------------------------------------------------------
def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces."""
    first = n_ids - (n_ids - 1) // capacity * capacity
    return [(0, first), *((s, capacity) for s in range(first, n_ids, capacity))]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenise(df: DataFrame, id_col: str, text_col: str, path: str | None, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    bounded_batches(df.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(path or default_tokenizer())
        for batch in batches:
            rows: list[list] = [[] for _ in range(5 + keep_ids)]
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(tokens.ids(text or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    for column, x in zip(rows, [key, k, start, length, zlib.crc32(own.tobytes()), own.tolist()][: 5 + keep_ids], strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    return id_and_text(df, id_col, text_col).mapInArrow(pieces, PIECES + ", ids array<int>" * keep_ids)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, capacity: int = 1024, rows_per_partition: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    pieces = tokenise(df, id_col, text_col, path, end_id, capacity)
    return pack_pieces(pieces, capacity, rows_per_partition)


def _histogram(pieces: DataFrame, capacity: int) -> np.ndarray:
    """Pieces by length: capacity + 1 numbers, however many pieces there are."""
    count = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return count


def pack_pieces(pieces: DataFrame, capacity: int = 1024, rows_per_partition: int = 50_000) -> DataFrame:
    """Packs rows that have a ``length``; adds sequence_id and offset."""
    names = pieces.columns
    pieces = stored(pieces.withColumn("_row", F.monotonically_increasing_id()))
    sizes = _histogram(pieces, capacity)
    bound = lower_bound(sizes, capacity)
    done = [pieces.filter(F.col("length") == capacity).select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    closed, n = int(sizes[capacity]), int(sizes[:capacity].sum())
    left, before = pieces.filter(F.col("length") < capacity), None
    columns = [f for f in pieces.schema.fields]
    for turn in itertools.count():
        if not n:
            break
        parts = max(1, -(-n // rows_per_partition))
        last = parts == 1

        def fit(group: pd.DataFrame) -> pd.DataFrame:  # sent off before the next turn
            group = group.sort_values("_row", kind="stable")
            own = group["length"].to_numpy()
            bins, offsets, full = best_fit(own, capacity)
            certified = len(full) == lower_bound(np.bincount(own, minlength=capacity + 1).astype(np.int64), capacity)
            stays = full == capacity
            if last:
                stays[:] = True
            elif certified:
                stays[:] = True
                stays[int(full.argmin())] = full.min() == capacity
            part = int(group["_part"].iloc[0])
            out = group.drop(columns=["_part"])
            return out.assign(sequence_id=(turn << 46) + (part << 20) + bins, offset=offsets, _stays=stays[bins])

        # partitions hold about rows_per_partition small rows whatever the table's size
        dealt = left.withColumn("_part", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(parts)).cast("int"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", sequence_id bigint, offset bigint, _stays boolean"
        packed = stored(dealt.groupBy("_part").applyInPandas(fit, schema))
        done.append(packed.filter("_stays").select(*names, "sequence_id", "offset"))
        if last:
            break
        stats = packed.agg(F.count_if(~F.col("_stays")).alias("left"), F.count_if(F.col("offset") == 0).alias("bins"), F.count_if(F.col("_stays") & (F.col("offset") == 0)).alias("closed")).first()
        used = closed + stats["bins"]
        if used <= bound or not stats["closed"] and before is not None and used >= before:
            done[-1] = packed.select(*names, "sequence_id", "offset")
            break
        closed, n, before = closed + stats["closed"], stats["left"], used
        left = packed.filter(~F.col("_stays")).select(*pieces.columns)
    return functools.reduce(DataFrame.unionByName, done)


def bounds(packed: DataFrame, capacity: int = 1024) -> tuple[int, int]:
    """Sequences in a packing, and the least that any packing of its pieces has: their
    difference is the gap that is left."""
    return packed.filter("offset = 0").count(), lower_bound(_histogram(packed, capacity), capacity)
