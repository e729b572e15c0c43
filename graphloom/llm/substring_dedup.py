"""Exact substring dedup by super-k-mer partitioning (operator 10).

A window is 20 consecutive words of one document. Its minimiser is the least hash among the six-word grams in it, so equal
windows have equal minimisers. Consecutive windows that share a minimiser form a super-k-mer, which travels as one packed
string of words to the bucket of its minimiser; there sorting counts each window as the words it is, not as a hash.

1. Texts are packed into compressed batches of about 4 MB (words joined by one space), which are all that is shuffled later.
2. Each batch lists its minimisers, each once with the number of its places. A minimiser with one place in the corpus can't have
   a window that occurs twice, so only the others come back to their batches. A minimiser has a row per batch at most, however
   many documents share it.
3. Batches send the super-k-mers of these minimisers to their buckets; equal strings of a batch are sent once, with their earliest
   place. Minimisers with more than HOT places are cut before that and dealt by window, so that no bucket holds an unbounded group.
4. Buckets cut the strings into windows and keep the earliest place of each. The earliest places return to their batches as bit
   masks; every other place of a window is a repeat, and its words go.

Null text: no words. Documents come in the order of doc_id (null last); rows of one doc_id are documents of their own, in the
order of a hash of their text, and equal rows in any order. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, as_long, expand, materialise, slices, squeeze, table

WINDOW, GRAM = 20, 6
#: Windows of a super-k-mer at most: longer runs (one phrase over and over) are cut, so that a mask fits in a long.
RUN = 32
#: Minimisers with more places than this are dealt by window.
HOT = 200
PACKED = "batch long, doc_id array<long>, tie array<long>, sizes array<int>, packed binary"
SENT = "minimiser long, salt int, words string, last boolean, doc_id long, tie long, batch long, at int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def super_kmers(words: Words) -> tuple[np.ndarray, ...]:
    """(text, start within the text, windows, minimiser, places of the minimiser) of every super-k-mer."""
    grams, n = words.grams(GRAM), WINDOW - GRAM + 1
    if len(words.hash) < WINDOW:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    low, span = grams, 1
    while span < n:
        step = min(span, n - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    sizes = np.diff(words.first)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    within = np.arange(len(low)) + WINDOW <= words.first[text + 1]
    at = np.flatnonzero(within)
    text, low = text[at], low[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - run) % RUN == 0
    first = np.flatnonzero(new)
    windows, places = np.diff(np.append(first, len(at))), np.zeros(len(first), np.int64)
    for j in range(RUN + n - 1):
        places += (j < windows + n - 1) & (grams[np.minimum(at[first] + j, len(grams) - 1)] == low[first])
    return text[first], at[first] - words.first[text[first]], windows, low[first], places


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of documents, in the order of documents within."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part, texts in slices(batch):
            ids = part.column("doc_id").to_pylist()
            texts = [b" ".join(t.split()) for t in texts]
            ties = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts]
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, ties[i]))
            texts = [texts[i] for i in order]
            row = (number, [ids[i] for i in order], [ties[i] for i in order], [len(t) for t in texts], squeeze(b"".join(texts)))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["batch", "doc_id", "tie", "sizes", "packed"])
            number += 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    """Each packed batch with its texts."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            joined = expand(row["packed"], sum(row["sizes"]))
            ends = np.cumsum([0, *row["sizes"]])
            yield row, [joined[a:b] for a, b in zip(ends, ends[1:])]


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, texts in _rows(batches):
        _, _, _, low, places = super_kmers(Words(texts))
        distinct, which = np.unique(low, return_inverse=True)
        n = np.bincount(which, places, len(distinct)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), row["batch"])), pa.array(as_long(distinct)), pa.array(n)], ["batch", "minimiser", "n"])


def _places(words: Words, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    return words.first[text] + start


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, texts in _rows(batches):
        words = Words(texts)
        text, start, windows, low, _ = super_kmers(words)
        at, low = _places(words, text, start), as_long(low)
        hot = np.array(row["hot"] or [], np.int64)
        cold = np.flatnonzero(np.isin(low, np.array(row["cold"] or [], np.int64)))
        warm = np.flatnonzero(np.isin(low, hot))
        n = windows[warm]
        each = np.repeat(at[warm], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for first, size, minimiser, own, salted in ((at[cold], windows[cold], low[cold], text[cold], False), (each, np.ones(len(each), np.int64), np.repeat(low[warm], n), np.repeat(text[warm], n), True)):
            begin, stop = words.start[first], words.end[first + size + WINDOW - 2] if len(first) else first
            strings = [words.joined[a:b] for a, b in zip(begin.tolist(), stop.tolist())]
            # of equal strings the earliest stays
            least = dict(zip(reversed(strings), range(len(strings) - 1, -1, -1)))
            keep = np.fromiter(least.values(), np.int64, len(least))
            salt = np.fromiter((1 + (zlib.crc32(w) & 0xFFFF) for w in least), np.int32, len(least)) if salted else np.zeros(len(least), np.int32)
            ids, ties = pa.array(row["doc_id"], pa.int64()), pa.array(row["tie"], pa.int64())
            doc, least = pa.array(own[keep]), list(least)
            for i in range(0, len(keep), 1 << 16):
                cut = slice(i, i + (1 << 16))
                held = least[cut]
                part = ids.take(doc[cut])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(minimiser[keep[cut]]), pa.array(salt[cut]), pa.array(held, pa.binary()).cast(pa.string()), part.is_null(), part, ties.take(doc[cut]), pa.array(np.full(len(held), row["batch"])), pa.array(first[keep[cut]], pa.int32())],
                    ["minimiser", "salt", "words", "last", "doc_id", "tie", "batch", "at"],
                )


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _cut(batches: Iterator[pa.RecordBatch], keep_text: bool = False) -> Iterator[pa.RecordBatch]:
    for row, texts in _rows(batches):
        words = Words(texts)
        text, start, windows, low, _ = super_kmers(words)
        at = _places(words, text, start)
        own = np.flatnonzero(np.isin(as_long(low), np.array((row["cold"] or []) + (row["hot"] or []), np.int64)))
        # windows of repeated minimisers are repeats, but for the earliest ones
        repeat = np.zeros(len(words.hash) + RUN + 1, np.int64)
        np.add.at(repeat, at[own], 1)
        np.add.at(repeat, at[own] + windows[own], -1)
        repeat = np.cumsum(repeat) > 0
        if row["firsts"]:
            first = np.array([f["at"] for f in row["firsts"]], np.int64)
            mask = np.array([f["mask"] for f in row["firsts"]], np.int64).view(np.uint64)
            for j in range(RUN):
                repeat[first[(mask >> np.uint64(j) & np.uint64(1)) > 0] + j] = False
        edge = np.zeros(len(words.hash) + RUN + WINDOW + 2, np.int64)
        hit = np.flatnonzero(repeat)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + WINDOW, -1)
        gone = np.cumsum(edge)[: len(words.hash)] > 0
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
        kept = []
        for i, t in enumerate(texts):
            if removed[i]:
                t = b" ".join(w for w, g in zip(t.split(), gone[words.first[i] : words.first[i + 1]].tolist()) if not g)
            kept.append(t.decode() if keep_text else _digest(t))
        yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(np.diff(words.first).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def first_places(sent: DataFrame) -> DataFrame:
    """Super-k-mers as SENT -> (batch, firsts: array of (at, mask)): the windows of each that are the earliest of their kind."""
    bucket = sent.repartition("minimiser", "salt").withColumn("w", F.split("words", " ")).drop("words")
    bucket = bucket.withColumn("off", F.explode(F.expr(f"sequence(0, size(w) - {WINDOW})")))
    window = F.expr(f"array_join(slice(w, off + 1, {WINDOW}), ' ')").alias("window")
    place = F.struct("last", "doc_id", "tie", "batch", (F.col("at") + F.col("off")).alias("first"), "at", "off").alias("place")
    earliest = bucket.select("minimiser", "salt", window, place).groupBy("minimiser", "salt", "window").agg(F.min("place").alias("p"))
    mask = F.expr("bit_or(shiftleft(1L, p.off))").alias("mask")
    masks = earliest.groupBy("minimiser", "salt", F.col("p.batch").alias("batch"), F.col("p.at").alias("at")).agg(mask)
    return masks.groupBy("batch").agg(F.collect_list(F.struct("at", "mask")).alias("firsts"))


def _dedup(docs: DataFrame, keep_text: bool) -> DataFrame:
    packed = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack, PACKED), "sub-packed")
    listed = packed.mapInArrow(_list, "batch long, minimiser long, n long").withColumn("total", F.sum("n").over(Window.partitionBy("minimiser")))
    of = lambda condition: F.collect_list(F.when(condition, F.col("minimiser")))
    found = listed.filter("total > 1").groupBy("batch").agg(of(F.col("total") <= HOT).alias("cold"), of(F.col("total") > HOT).alias("hot"))
    found = materialise(found, "sub-found")
    sent = packed.join(found, "batch").mapInArrow(_send, SENT)
    firsts = materialise(first_places(sent), "sub-firsts")
    back = found.join(firsts, "batch", "left")
    return packed.drop("tie").join(back, "batch", "left").mapInArrow(lambda b: _cut(b, keep_text), RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space)."""
    return _dedup(docs, True).withColumnRenamed("kept_sha256", "kept_text")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """As remove_repeats, with the SHA-256 of kept_text in its place."""
    return _dedup(docs, False)


def op10_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS pos0, ws FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, pos0, array_to_string(ws[pos0:pos0+19], ' ') AS x FROM p),
d AS (SELECT doc_id, pos0 FROM (SELECT doc_id, pos0, row_number() OVER (PARTITION BY x ORDER BY doc_id, pos0) AS r FROM g) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(pos0, pos0 + 20)) AS pos FROM d),
l AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM k
"""
