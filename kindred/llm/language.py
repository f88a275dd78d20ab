"""Language identification with rank-order n-gram profiles.

A profile is the list of the most frequent 1- to 3-grams of a language, best first
(Cavnar and Trenkle, 1994). A document's own list is compared with each profile by
the out-of-place distance: the sum over the document's n-grams of how far apart the
two ranks are, an n-gram that the profile lacks counting as far as can be. The
language with the smallest distance wins; equal distances go to the smaller name.

Text is lower-cased, each run of other characters than letters is one space. Null
texts and texts without letters are ``und`` with score 0. With no learned language
everything is ``und``. The score is 1 - distance / largest possible distance, so a
text with no n-gram in any profile scores 0.

Profiles are learned from a bounded sample of whole labelled texts: about
``rows_per_language`` rows of each language, picked by a hash of the key, all rows
where there are fewer. Only rows with a non-null label and key outside the held-out fold
are used; prediction sees the text alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import bounded_batches, held_out, id_and_text

UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 1- to 3-grams, ascending, and their counts. 21 bits a character."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first of each run of others stands for it
    c = np.concatenate([[32], np.where(letter, points, 32)[kept], [32]]).astype(np.int64)
    if c[1] == 32:
        c = c[1:]
    if c[-2] == 32:
        c = c[:-1]
    two = (c[:-1] << 21) | c[1:]
    return np.unique(np.concatenate([c[c != 32], two, (two[:-1] << 21) | c[2:]]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent codes, best first, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """Rank lists by language, as one matrix over the union of their n-grams."""

    def __init__(self, lists: dict[str, list[int]], top: int):
        self.top, self.names = top, sorted(lists)
        self.vocabulary = np.unique(np.concatenate([np.asarray(lists[n], np.int64) for n in self.names])) if lists else np.empty(0, np.int64)
        self.ranks = np.full((len(self.names), len(self.vocabulary)), -1, np.int32)
        for row, name in zip(self.ranks, self.names, strict=True):
            row[np.searchsorted(self.vocabulary, np.asarray(lists[name], np.int64))] = np.arange(len(lists[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(*grams(text), self.top) if text else np.empty(0, np.int64)
        if not len(own) or not len(self.vocabulary):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.vocabulary, own).clip(max=len(self.vocabulary) - 1)
        mine = np.flatnonzero(self.vocabulary[at] == own)
        theirs = self.ranks[:, at[mine]]
        missed = len(own) - len(mine)
        distance = np.where(theirs < 0, self.top, np.minimum(np.abs(theirs - mine), self.top)).sum(axis=1) + missed * self.top
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (len(own) * self.top))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = 300, rows_per_language: int = 5000) -> Profiles:
    """Profiles from the rows outside the held-out fold; see the module for the bound."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    there = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not there:
        return Profiles({}, top)
    share = F.create_map(*[F.lit(x) for lang, n in there.items() for x in (lang, min(1.0, rows_per_language / n))])
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("profile")), 11).cast("double") * 2.0**-53
    sample = rows.filter(uniform < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[int, int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, table in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(table), pa.string()), pa.array(list(table), pa.int64()), pa.array(list(table.values()), pa.int64())], ["lang", "code", "n"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = seen.setdefault(lang, {})
                for code, n in zip(*(x.tolist() for x in grams(text or "")), strict=True):
                    table[code] = table.get(code, 0) + n
            if sum(map(len, seen.values())) > 500_000:  # partial sums: memory stays bounded
                yield from flush()
        yield from flush()

    sums = sample.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).collect()
    lists: dict[str, list[int]] = {}
    for r in sorted(best, key=lambda r: r["rank"]):
        lists.setdefault(r["lang"], []).append(r["code"])
    return Profiles(lists, top)


def identify(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row; one pass, no shuffle."""
    bounded_batches(df.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [profiles.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_and_text(df, id_col, text_col).mapInArrow(predict, "doc_id bigint, lang_pred string, score double")


def filter_language(df: DataFrame, profiles: Profiles, text_col: str = "text", least: float = 0.0, languages: set[str] | None = None) -> DataFrame:
    """The rows of ``df``, all columns, whose language is known: those with letters,
    a score above ``least`` and, if ``languages`` is given, a language among them."""
    bounded_batches(df.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [profiles.predict(t) for t in batch.column(names.index(text_col)).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score > least and (languages is None or lang in languages) for lang, score in said], pa.bool_()))

    names = df.columns
    return df.mapInArrow(keep, df.schema)
