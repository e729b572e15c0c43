"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 6).

Characters are lower-cased, and anything but letters becomes a space; n-grams of 1 to 4 characters are hashed into 2^16
features. The learned log-probability matrix (2^16 features by languages, so its size doesn't grow with the data) is broadcast, and
each batch of whole texts is scored by gathering matrix rows and summing them per document.

Training counts all labelled rows whose crc32(doc_id) mod 4 is not 2, so a rare language is learned from each of its rows.
Ties go to the language that sorts first. Text that is null or has no letter gets `und` and score 0, as does everything if no row
is labelled. Rows with a null doc_id aren't learned from nor held out, and are predicted; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import U, slices, table

ORDERS, BITS, ALPHA = (1, 2, 3, 4), 16, 0.05
#: Characters scored at once.
STEP = 1 << 19
_K = U(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """The lower-case code of every letter, 32 for everything else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(x.lower()[0])
    return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-grams, the first of each text with one more at the end, whether each text has a letter). Grams without a letter
    are feature 2^BITS, as are those that begin behind a text: texts are kept apart by spaces, so no gram tells of another one."""
    gap = "    "
    joined = gap.join(t.decode() for t in texts) + gap
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[codes].astype(np.uint64)
    n = len(c) - max(ORDERS) + 1
    h, blank, out = np.zeros(len(c), np.uint64), np.ones(len(c), bool), np.empty((n, len(ORDERS)), np.int32)
    letter = c != 32
    any_letter = np.zeros(len(c), bool)
    for j, order in enumerate(ORDERS):
        m = len(c) - order + 1
        h = (h[:m] + c[order - 1 :]) * _K
        h ^= h >> U(29)
        any_letter = letter[:m] if order == 1 else any_letter[:m] | letter[order - 1 :]
        f = ((h + U(order)) * _K >> U(64 - BITS)).astype(np.int32)
        out[:, j] = np.where(any_letter, f, 1 << BITS)[:n]
    sizes = np.fromiter((len(t.decode()) for t in texts), np.int64, len(texts)) + len(gap)
    first = np.concatenate(([0], np.cumsum(sizes)))
    # a gram that begins between two texts holds letters of the next one only
    out[np.minimum((first[1:, None] - np.arange(1, len(gap) + 1)).ravel(), n - 1)] = 1 << BITS
    has = np.add.reduceat(letter.astype(np.int64), first[:-1]) > 0
    return out, np.minimum(first, n), has


def _count(langs: list[str]):
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), (1 << BITS) + 1), np.int64)
        for batch in batches:
            for part, texts in slices(batch, limit=STEP):
                f, first, _ = features(texts)
                of = np.repeat([place[x] for x in part.column("lang").to_pylist()], np.diff(first))
                for i in np.unique(of):
                    total[i] += np.bincount(f[: len(of)][of == i].ravel(), minlength=(1 << BITS) + 1)
        lang, feature = np.nonzero(total[:, : 1 << BITS])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(feature, pa.int32()), pa.array(total[lang, feature])], ["lang", "feature", "n"])

    return run


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """labelled(doc_id, text, lang) -> (languages, log-probabilities: a row per feature and one of zeros for blank grams)."""
    labelled = labelled.select("doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros(((1 << BITS) + 1, 0), np.float32)
    rows = labelled.mapInArrow(_count(langs), "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    n = np.full((len(langs), 1 << BITS), ALPHA)
    n[rows["lang"], rows["feature"]] += rows["n"]
    logp = np.log(n / n.sum(axis=1, keepdims=True))
    prior = np.log(np.array([sizes[x] for x in langs]) / sum(sizes.values()))
    out = np.zeros(((1 << BITS) + 1, len(langs)), np.float32)
    out[: 1 << BITS] = logp.T
    return langs, np.vstack([out, prior[None, :].astype(np.float32)])


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, carry: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score: the posterior of the predicted language. With `carry`, these columns of docs
    take the place of doc_id."""
    own = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id") if carry is None else docs.select(*carry)
    names = own.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp, prior = shared.value[:-1], shared.value[-1].astype(np.float64)
        for batch in batches:
            for part, texts in slices(batch, limit=STEP):
                f, first, has = features(texts)
                sums = np.zeros((len(texts), len(langs)))
                for j in range(f.shape[1] if langs else 0):
                    for lo in range(0, len(f), STEP):
                        hi = min(lo + STEP, len(f))
                        a, b = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi, "left")
                        cut = np.clip(first[a:b], lo, hi) - lo
                        live = cut < hi - lo
                        sums[a:b][live] += np.add.reduceat(logp[f[lo:hi, j]], cut[live], axis=0, dtype=np.float64)
                pred, score = ["und"] * len(texts), [0.0] * len(texts)
                if langs:
                    s = sums + prior
                    best = s.argmax(axis=1)
                    post = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                    for i in np.flatnonzero(has):
                        pred[i], score[i] = langs[best[i]], float(post[i])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(pred), pa.array(score)], [*names, "lang_pred", "score"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") if carry is None else docs.select(*{**dict.fromkeys(carry), "text": None})
    return read.mapInArrow(run, StructType([*own.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out() -> Column:
    return F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2"), F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from docs(doc_id, text, lang) and predicts all of them: doc_id, held_out, lang_pred, score."""
    out = predict(docs, *train(docs.filter(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_naive_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
