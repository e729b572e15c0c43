"""Phrase collocations by merged count-min sketches and an exact second pass (operator 11).

A-Z are lower-cased, texts are cut at [.,;:!?\\x0A-\\x0D] into pieces and those at blanks and tabs into words. Everything is counted per
lang. Phrases are contiguous words of one piece, up to LONGEST of them.

1. Each task counts the phrases of its texts in a count-min sketch of ROWS rows of cells; a cell stops at the least count that is asked
   for. Sketches are cut into blocks and added up block by block. A cell never holds less than the count of any phrase that falls in it,
   so a phrase with a short cell in some row is rare for certain.
2. The cells that reached the least count become bitmaps. A second pass over the texts lets through the phrases whose cells all did
   (a few rare ones with them) and counts these as they are, by their words, so that no hash decides a count. Those below the least
   count are dropped then. Parts of a phrase occur at least as often as the phrase, so all counts that scores need are among them.
3. A phrase of a words is cut after each of its words; f(first part) = l and f(rest) = r give floor(1000000 * a * a / (l * r)), in decimals of 38 digits
   (exact up to counts of 10^16). The lowest-scoring cut counts, of equals the first.
4. Phrases inside of a longer one that holds half of their occurrences are dropped, and each lang's best by score, count and bytes kept.

The sketch grows with the texts: a cell for each 32 bytes, 2^26 a row at most (16 MB of bitmaps are broadcast, and a task holds
128 MB). Beyond that more rare phrases reach the second pass, which then moves more, with the same result.

Null texts are empty, a null lang is `und`. Rows are counted as they come: repeated rows count again, doc_id and other columns are not
used. An empty table, or one without frequent phrases, gives an empty result. Texts are cut at ends of pieces into slices of
SLICE bytes; a single piece that is longer is taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U, Words, expand, materialise, mix, squeeze, table

LONGEST, LEAST, BEST, COVER = 3, 10, 2000, 50
ROWS, BYTES_PER_CELL, FEWEST, MOST = 2, 32, 16, 26
#: Cells of a block of a sketch, as a power of two.
PART = 16
SLICE = 4 << 20
#: Groups of a lang in which its best phrases are found before they meet.
DEALT = 256
_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK[list(b" \t")] = True
_CUT = re.compile(rb"[.,;:!?\n-\r]")
COUNTED = "lang string, size int, phrase binary, f long"


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Lower-cased texts with their langs, about SLICE bytes at a time. Longer texts are cut at ends of pieces."""
    texts, langs, held = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist()):
            t = (text.as_py() or b"").lower()
            while t:
                end = len(t)
                if end > SLICE:
                    found = _CUT.search(t, SLICE)
                    end = found.end() if found else end
                texts.append(t[:end])
                langs.append(lang)
                held += end
                t = t[end:]
                if held >= SLICE:
                    yield texts, langs
                    texts, langs, held = [], [], 0
    if texts:
        yield texts, langs


class Phrases:
    """The different phrases of some texts, by number of words: where each first starts, how often it occurs, and a hash of lang and words."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        joined = b"\n".join(texts) + b"\n"
        b = np.frombuffer(joined, np.uint8)
        breaks = _BREAK[b]
        ink = ~(breaks | _BLANK[b])
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ink)).view(np.int8)))
        start, size = edge[0::2], edge[1::2] - edge[0::2]
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(b[ink])]).dictionary_encode()
        self.words, self.word = words.dictionary, words.indices.to_numpy()
        self.piece = np.searchsorted(np.flatnonzero(breaks), start)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.langs = sorted(set(langs))
        place = {lang: i for i, lang in enumerate(self.langs)}
        of_text = np.fromiter((place[lang] for lang in langs), np.int64, len(langs))
        self.lang = of_text[np.searchsorted(ends, start, "right")]

    def totals(self) -> np.ndarray:
        """Words by lang."""
        return np.bincount(self.lang, minlength=len(self.langs))

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, first place, count, hash) of the different phrases of n words, for n from 1 to `longest`. Numbers of shorter phrases are paired
        with words, so phrases are told apart exactly."""
        if not len(self.word):
            return
        keys, first, one, count = np.unique(self.lang * len(self.words) + self.word, return_index=True, return_inverse=True, return_counts=True)
        hashed = Words([b"\n".join(self.words.to_pylist())]).hash
        by_lang = Words([x.encode().hex().encode() or b"-" for x in self.langs]).hash
        single = mix(hashed[keys % len(self.words)] * U(0x9FB21C651E98DF25) + by_lang[keys // len(self.words)])
        yield 1, first, count, single
        at, number, h = np.arange(len(one)), one, single
        for n in range(2, longest + 1):
            stays = at + n - 1 < len(one)
            stays[stays] = self.piece[at[stays]] == self.piece[at[stays] + n - 1]
            at, number = at[stays], number[stays]
            if not len(at):
                return
            keys, first, number, count = np.unique(number * len(single) + one[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
            h = mix((h[keys // len(single)] ^ U(n)) * U(0x9FB21C651E98DF25) + single[keys % len(single)])
            yield n, at[first], count, h

    def text(self, places: np.ndarray, n: int) -> pa.Array:
        """The phrases of n words that start there, joined by one space."""
        if n == 1:
            return self.words.take(pa.array(self.word[places]))
        return pc.binary_join_element_wise(*(self.words.take(pa.array(self.word[places + j])) for j in range(n)), pa.scalar(b" ", pa.large_binary()))


def cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in each row of a sketch of 2^bits cells a row."""
    return [(mix(h + U(j * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(64 - bits)).astype(np.int64) for j in range(ROWS)]


def _type(least: int):
    return np.uint8 if least < 256 else np.uint32


def add(row: np.ndarray, at: np.ndarray, count: np.ndarray, least: int) -> None:
    """Adds counts to cells, which stop at `least`."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    at, sums = at[first], np.add.reduceat(count[order], first)
    row[at] = np.minimum(row[at] + np.minimum(sums, least), least)


def _sketch(bits: int, least: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.zeros(1 << bits, _type(least)) for _ in range(ROWS)]
        for texts, langs in slices(batches):
            for _, _, count, h in Phrases(texts, langs).grams(longest):
                for row, at in zip(rows, cells(h, bits)):
                    add(row, at, count, least)
        for j, row in enumerate(rows):
            for k, part in enumerate(row.reshape(-1, min(len(row), 1 << PART))):
                if part.any():
                    yield pa.RecordBatch.from_pydict({"row": pa.array([j], pa.int32()), "part": pa.array([k], pa.int32()), "cells": pa.array([squeeze(part.tobytes())], pa.binary())})

    return run


def _merge(bits: int, least: int):
    """Adds up blocks of sketches that come sorted by row and part, and gives a bitmap of the cells that reached `least`."""
    kind, length = _type(least), min(1 << bits, 1 << PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def done() -> pa.RecordBatch:
            reached = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_pydict({"row": pa.array([key[0]], pa.int32()), "part": pa.array([key[1]], pa.int32()), "reached": pa.array([reached], pa.binary())})

        for batch in batches:
            for row, part, packed in zip(*(batch.column(c).to_pylist() for c in ("row", "part", "cells"))):
                if key != (row, part):
                    if key:
                        yield done()
                    key, total = (row, part), np.zeros(length, np.int64)
                total = np.minimum(total + np.frombuffer(expand(packed, length * kind().itemsize), kind), least)
        if key:
            yield done()

    return run


def bitmaps(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[int, list[np.ndarray]]:
    """(bits, a bitmap for each row): the cells of the merged sketch that reached `least`."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(MOST, max(FEWEST, (size // BYTES_PER_CELL).bit_length()))
    # a sketch for each of few long tasks, as what is added up later grows with their number
    few = docs.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(_sketch(bits, least, longest), "row int, part int, cells binary")
    merged = parts.repartition("row", "part").sortWithinPartitions("row", "part").mapInArrow(_merge(bits, least), "row int, part int, reached binary")
    out = [np.zeros(1 << bits >> 3, np.uint8) for _ in range(ROWS)]
    for r in merged.toLocalIterator():
        at = r["part"] << PART >> 3
        out[r["row"]][at : at + len(r["reached"])] = np.frombuffer(r["reached"], np.uint8)
    return bits, out


def _count(bits: int, reached, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in slices(batches):
            found = Phrases(texts, langs)
            row = lambda lang, n, phrase, f: pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.full(len(f), n, np.int32)), phrase, pa.array(f, pa.int64())], ["lang", "size", "phrase", "f"])
            yield row(found.langs, 0, pa.nulls(len(found.langs), pa.binary()), found.totals())
            for n, first, count, h in found.grams(longest):
                live = np.ones(len(h), bool)
                for bitmap, at in zip(reached.value, cells(h, bits)):
                    live &= (bitmap[at >> 3] >> (at & 7) & 1).astype(bool)
                for i in range(0, int(live.sum()), 1 << 16):
                    pick = np.flatnonzero(live)[i : i + (1 << 16)]
                    langs_of = pa.array(found.langs, pa.string()).take(pa.array(found.lang[first[pick]]))
                    yield row(langs_of, n, found.text(first[pick], n).cast(pa.binary()), count[pick])

    return run


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """docs(text, lang) -> lang, size, phrase, f: exact counts of the phrases that occur at least so often; size 0 holds the words of a lang."""
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    bits, reached = bitmaps(docs, least, longest)
    shared = docs.sparkSession.sparkContext.broadcast(reached)
    exact = docs.mapInArrow(_count(bits, shared, longest), COUNTED).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    frequent = exact.filter((F.col("size") == 0) | (F.col("f") >= least))
    return materialise(frequent.withColumn("phrase", F.col("phrase").cast("string")), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, cover: int = COVER) -> DataFrame:
    """docs(text, lang) -> lang, rank, phrase, a, l, r, n, score."""
    known = counted(docs, least, longest)
    f = known.filter("size > 0").select("lang", "phrase", "f")
    candidates = known.filter("size > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), "size", F.col("f").alias("a"))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cut = candidates.select("lang", "phrase", "w", "size", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cut = cut.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    cut = cut.withColumn("score", F.expr(f"{wide('a')} * {wide('a')} * 1000000 div ({wide('l')} * {wide('r')})").cast("long"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # every phrase within a longer one, with the count of the most frequent longer one
    inner = candidates.filter("size > 2").select("lang", "w", "size", "a", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    inner = inner.select("lang", "w", "a", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("at")).select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(20, 0)") * 100 < F.col("a").cast("decimal(20, 0)") * cover))
    kept = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each of DEALT groups first: a lang's phrases never meet in one task
    kept = kept.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "dealt").orderBy(*order))).filter(F.col("rank") <= best)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    n = known.filter("size = 0").select("lang", F.col("f").alias("n"))
    return kept.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_sketch_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1 AND f >= 10),
u AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS first, array_to_string(ws[j+1:size], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS j FROM c)),
x AS (SELECT u.lang, u.phrase, a, j, i.f AS l, e.f AS r, CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(i.f AS HUGEINT) * e.f) AS BIGINT) AS score
  FROM u JOIN f i ON i.lang = u.lang AND i.phrase = u.first JOIN f e ON e.lang = u.lang AND e.phrase = u.rest),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE size = 3
  UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE size = 3) GROUP BY ALL),
b AS (SELECT s.lang, s.phrase, a, l, r, score FROM s LEFT JOIN o ON o.lang = s.lang AND o.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM k JOIN n ON n.lang = k.lang WHERE rank <= 2000
"""
