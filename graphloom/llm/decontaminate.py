"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment (operator 7).

Words are lower-cased and split at white space; punctuation at either end of a word is dropped.

1. The n-grams of all test items are counted over the whole corpus, in a narrow pass whose tasks pass on one count per gram.
2. Each item keeps as seeds the rarest of every few neighbouring grams (ties by hash), so every stretch of an item has a seed
   however common its words are.
3. Seeds join the words of each document; hits of an item that lie close together on nearby diagonals mark a passage.
4. The passage, as long as the item and a margin at both ends, is aligned with the item by Smith-Waterman (match 2, mismatch and
   gap -1). Score over the score of the item with itself is the similarity of an edited, shortened or paraphrased copy.

The benchmark is taken in parts of at most PART_WORDS words, each small enough to be broadcast; a larger benchmark takes more
passes. Result rows: one per document and item with a passage whose similarity is at least THRESHOLD.

Null or empty texts and items match nothing. Items of fewer than GRAM words are one seed: they match where they occur whole. Rows
with a null doc_id are scored as all others are (as items without an item_id are not); rows of one doc_id, or of none, are scored
per row, and the best passage of each item stays. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXTS, U, Words, bounded, bundled, materialise, slices, table, unbundled

GRAM, STRETCH = 3, 3
MATCH, OTHER = 2, -1
THRESHOLD = 0.5
PART_WORDS = 500_000
_EDGE = b".,;:!?\"'()[]{}<>*&%$#|-_"


class Cleaned(Words):
    """Words of lower-cased texts without the punctuation around them, found on the bytes."""

    def __init__(self, texts: list[bytes]):
        super().__init__([t.decode().lower().encode() for t in texts])

    def _hash(self, joined: bytes) -> np.ndarray:
        edge = np.zeros(256, bool)
        edge[list(_EDGE)] = True
        # the first byte that stays from each place on, and the last one up to it
        place = np.where(edge[self.bytes], len(joined), np.arange(len(joined))).astype(np.int32)
        onward = np.minimum.accumulate(place[::-1])[::-1]
        upto = np.maximum.accumulate(np.where(place == len(joined), -1, place))
        self.start, self.end = np.minimum(onward[np.minimum(self.start, len(joined) - 1)], self.end), np.maximum(upto[self.end - 1] + 1, self.start)
        kept = self.end > self.start
        self.first = np.concatenate(([0], np.cumsum(kept)))[self.first]
        self.start, self.end = self.start[kept], self.end[kept]
        return super()._hash(joined)


def _windows(h: np.ndarray) -> np.ndarray:
    """Hashes of GRAM words from each word on; of all words if there are fewer."""
    n = min(GRAM, len(h))
    out = np.full(max(0, len(h) - n + 1) if n else 0, n, np.uint64)
    for j in range(n):
        out = out * U(0x9FB21C651E98DF25) + h[j : len(h) - n + 1 + j]
    return out


class Part:
    """A part of the benchmark: item words as hashes, and sorted seeds with the item and place of each."""

    def __init__(self, items: list[tuple[int, bytes]]):
        words = Cleaned([t for _, t in items])
        self.ids = [i for i, _ in items]
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        grams = [_windows(w) for w in self.words]
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.place = np.concatenate([np.arange(len(g)) for g in grams] or [np.empty(0, np.int64)])
        self.gram = np.concatenate(grams or [np.empty(0, np.uint64)])
        self.short = sorted({len(w) for w in self.words if 0 < len(w) < GRAM})
        self._sort()

    def _sort(self) -> None:
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]
        self.distinct, self.at = np.unique(self.gram, return_index=True)
        self.table = np.zeros(1 << 20, bool)
        self.table[self.slot(self.distinct)] = True

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return ((h * U(0x9E3779B97F4A7C15)) >> U(44)).astype(np.int64)

    def sparse(self, counts: dict[int, int]) -> Part:
        """Only the rarest gram of every STRETCH neighbours of an item stays."""
        keep = np.zeros(len(self.gram), bool)
        rank = np.array([counts.get(int(g), 0) for g in self.gram.view(np.int64)], np.int64)
        order = np.lexsort((self.place, self.item))
        ends = np.searchsorted(self.item[order], np.arange(len(self.ids) + 1))
        for a, b in zip(ends[:-1], ends[1:]):
            own = order[a:b]
            for i in range(max(1, b - a - STRETCH + 1) if b > a else 0):
                near = own[i : i + STRETCH]
                keep[min(near, key=lambda x: (rank[x], self.gram[x]))] = True
        self.gram, self.item, self.place = self.gram[keep], self.item[keep], self.place[keep]
        self._sort()
        return self

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word of the batch, index into distinct seeds) wherever a seed occurs within one text."""
        where, which = [], []
        for n in sorted({GRAM, *self.short}):
            h = words.hash
            if len(h) < n:
                continue
            g = np.full(len(h) - n + 1, n, np.uint64)
            for j in range(n):
                g = g * U(0x9FB21C651E98DF25) + h[j : len(h) - n + 1 + j]
            at = np.flatnonzero(self.table[self.slot(g)])
            found = np.searchsorted(self.distinct, g[at])
            same = (found < len(self.distinct)) & (self.distinct[np.minimum(found, len(self.distinct) - 1)] == g[at])
            at, found = at[same], found[same]
            text = np.searchsorted(words.first, at, "right") - 1
            inside = at + n <= words.first[text + 1]
            where.append(at[inside])
            which.append(found[inside])
        return (np.concatenate(where), np.concatenate(which)) if where else (np.empty(0, np.int64), np.empty(0, np.int64))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best Smith-Waterman score of two word sequences, end of the best alignment in the passage)."""
    h, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    ramp = np.arange(len(passage) + 1)
    for w in item:
        step = np.zeros(len(passage) + 1, np.int64)
        step[1:] = h[:-1] + np.where(passage == w, MATCH, OTHER)
        step = np.maximum(np.maximum(step, h + OTHER), 0)
        # a run of gaps along the passage costs its length: a running maximum of the scores lifted by their place
        h = np.maximum.accumulate(step - OTHER * ramp) + OTHER * ramp
        if h.max() > best:
            best, end = int(h.max()), int(h.argmax())
    return best, end


def _tally(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        n = np.zeros(len(part.distinct), np.int64)
        for batch in batches:
            for _, texts in slices(batch):
                n += np.bincount(part.hits(Cleaned(texts))[1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(part.distinct[n > 0].view(np.int64)), pa.array(n[n > 0])], ["gram", "n"])

    return run


def passages(words: Words, part: Part) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, from, to): stretches of a text's words where seeds of an item gather."""
    where, which = part.hits(words)
    if not len(where):
        return
    size = np.append(part.at, len(part.gram))
    n = size[which + 1] - size[which]
    at = np.repeat(where, n)
    seed = np.repeat(part.at[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item, begin = part.item[seed], at - part.place[seed]
    text = np.searchsorted(words.first, at, "right") - 1
    order = np.lexsort((begin, item, text))
    text, item, begin = text[order], item[order], begin[order]
    length = np.array([len(w) for w in part.words])[item]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > np.maximum(4, length[1:] // 2))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    for a, b in zip(first, last):
        margin = 4 + length[a] // 4
        yield text[a], item[a], max(words.first[text[a]], begin[a] - margin), min(words.first[text[a] + 1], begin[b] + length[a] + margin)


def _match(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        for batch in batches:
            for cut, texts in slices(batch):
                words, ids, best = Cleaned(texts), cut.column("doc_id").to_pylist(), {}
                for text, item, a, b in passages(words, part):
                    score, end = align(part.words[item], words.hash[a:b])
                    similarity = score / (MATCH * len(part.words[item]))
                    if similarity >= threshold and similarity > best.get((text, item), (0,))[0]:
                        best[text, item] = (similarity, score, int(a + end - words.first[text]))
                rows = [(ids[t], part.ids[i], *v) for (t, i), v in best.items()]
                cols = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "similarity", "score", "end_word"])

    return run


FOUND = "doc_id long, item_id long, similarity double, score long, end_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, similarity, score, end_word (words of the document up
    to the end of the copy)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    words = items.select(F.sum(F.size(F.split("text", "\\s+"))).alias("n")).first()["n"] or 0
    parts = -(-words // PART_WORDS)
    out = None
    for p in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p) if parts > 1 else items
        part = Part([(r["item_id"], r["text"].encode()) for r in own.orderBy("item_id").collect()])
        if not len(part.gram):
            continue
        tally = docs.mapInArrow(_tally(spark.sparkContext.broadcast(part)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        counts = {r["gram"]: r["n"] for r in tally.collect()}
        found = docs.mapInArrow(_match(spark.sparkContext.broadcast(part.sparse(counts)), threshold), FOUND)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], FOUND)
    best = F.max(F.struct("similarity", "score", "end_word")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.similarity", "b.score", "b.end_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those that hold a passage. Each row is judged by its own text, whatever its doc_id."""
    rows = materialise(bundled(docs), "clean-rows", TEXTS)
    hit = contaminated(rows.select(F.col("row").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("row")).distinct()
    return unbundled(rows.join(bounded(materialise(hit, "contaminated")), "row", "left_anti"), docs.columns)


def op7_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
