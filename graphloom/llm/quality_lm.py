"""Quality by an interpolated modified Kneser-Ney model of trusted text (operator 9).

The model is of order 4 over characters as they are (code points, nothing is folded), so its tables grow with the input. Texts are
packed into batches of about STEP bytes or GRAMS different n-grams, whichever comes first (linear counting tells how many there are), so
a batch of a script with thousands of letters is no larger in memory. Each batch gives its distinct n-grams once, with their counts in trusted texts (all of
them, nothing is sampled). Joins of the count tables by n-gram, context and suffix give discounts, continuation counts, back-off weights and
the interpolated probability of every n-gram of the input; below order 1 all code points are equally likely. The probabilities go
back to the batches by a join, and each batch sums them by document: perplexity = exp(-mean log-probability). No table is gathered
on the driver or broadcast whole: the driver sees four counts of counts per order.

A document is kept if its perplexity is at most the given quantile of the trusted documents of its language, with a margin; the
language is the column `lang` (null: a group of its own). The model doesn't know the documents that set the quantile: one in FOLDS of the
trusted ones (by a hash of doc_id) is left out of it and held against it, as all untrusted documents are. Languages of which FEWEST or
fewer were left out take the quantile over those of all languages; where nothing was left out, it is that of the trusted documents.

Null and empty texts have perplexity null and aren't kept. If nothing is trusted, the model is uniform and every document with
text is kept. Rows with a null doc_id are scored, never trusted. Extra columns are ignored; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, expand, materialise, slices, squeeze, table

ORDER = 4
QUANTILE, MARGIN = 0.99, 1.05
FOLDS, FEWEST = 5, 4
#: Different n-grams of a batch, and the bits that count them.
GRAMS, BITS = 1 << 19, 22
#: Bytes of text in a batch and in what is worked on at a time (more only for longer documents), and code points.
STEP, PIECE, POINTS = 32 << 20, 2 << 20, 0x110000
PACKED = "batch long, doc_id array<long>, lang array<string>, trusted array<boolean>, sizes array<int>, packed binary"


def _dense(key: np.ndarray, cells: int) -> tuple[np.ndarray, int]:
    """(rank of each key among the distinct ones, how many these are); keys are below `cells`."""
    if cells <= 1 << 24:
        seen = np.zeros(cells, bool)
        seen[key] = True
        return np.cumsum(seen, dtype=np.int32)[key].astype(np.int64) - 1, int(np.count_nonzero(seen))
    distinct, rank = np.unique(key, return_inverse=True)
    return rank, len(distinct)


def ngrams(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of the n-gram that ends at each character, the distinct n-grams by number, the first character of each text with one
    more at the end). Texts start with ORDER - 1 zeros."""
    pad = "\0" * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(sizes)))
    if not first[-1]:
        return np.zeros(0, np.int64), [], first
    at = np.arange(first[-1]) + np.repeat(np.arange(len(texts)), sizes) * (ORDER - 1)
    symbol, base = _dense(points, POINTS)
    rank, n = symbol[at], base
    for j in range(1, ORDER):
        rank, n = _dense(rank * base + symbol[at + j], n * base)
    where = np.empty(n, np.int64)
    where[rank] = at
    joined = points[where[:, None] + np.arange(ORDER)].astype(np.uint32).tobytes().decode("utf-32-le")
    return rank, [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)], first


class Different:
    """About how many different n-grams some texts have, by linear counting of their hashes."""

    def __init__(self):
        self.seen, self.filled = np.zeros(1 << BITS, bool), 0

    def add(self, text: bytes) -> None:
        x = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = np.zeros(max(0, len(x) - ORDER + 1), np.uint64)
        for j in range(ORDER):
            h = h * np.uint64(0x9FB21C651E98DF25) + x[j : j + len(h)]
        self.seen[((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.filled = int(np.count_nonzero(self.seen))

    def count(self) -> float:
        return -(1 << BITS) * np.log1p(-min(self.filled, (1 << BITS) - 1) / (1 << BITS))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about STEP bytes of text or GRAMS n-grams. They are stored once, so their numbers and rows stay as they are."""
    number, held, size, grams = TaskContext.get().partitionId() << 32, [], 0, Different()

    def row() -> pa.RecordBatch:
        ids, langs, trusted, texts = zip(*held)
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary())
        values = (number, ids, langs, trusted, [len(t) for t in texts], squeeze(b"".join(texts)))
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], ["batch", "doc_id", "lang", "trusted", "sizes", "packed"])

    for batch in batches:
        for part, texts in slices(batch, limit=PIECE):
            held += zip(*(part.column(c).to_pylist() for c in ("doc_id", "lang", "trusted")), texts)
            size += sum(map(len, texts))
            grams.add(b"".join(texts))
            if size >= STEP or grams.count() >= GRAMS:
                yield row()
                number, held, size, grams = number + 1, [], 0, Different()
    if held:
        yield row()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _pieces(row: dict) -> Iterator[tuple[slice, list[str]]]:
    """Documents of a batch, some at a time."""
    joined, ends, first = expand(row["packed"], sum(row["sizes"])), np.cumsum([0, *row["sizes"]]), 0
    for i in range(len(row["sizes"])):
        if i + 1 == len(row["sizes"]) or ends[i + 1] - ends[first] >= PIECE:
            yield slice(first, i + 1), [joined[a:b].decode() for a, b in zip(ends[first : i + 1], ends[first + 1 : i + 2])]
            first = i + 1


def _batch_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each batch. They are added up as Arrow columns: as Python objects they would take several times as much."""
    for row in _rows(batches):
        total = pa.table({"gram": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        for own, texts in _pieces(row):
            rank, distinct, first = ngrams(texts)
            n = np.bincount(rank[np.repeat(np.array(row["trusted"][own], bool), np.diff(first))], minlength=len(distinct))
            both = pa.concat_tables([total, pa.table({"gram": pa.array(distinct, pa.string()), "n": pa.array(n, pa.int64())})])
            total = both.group_by("gram", use_threads=False).aggregate([("n", "sum")]).select(["gram", "n_sum"]).rename_columns(["gram", "n"])
        for part in total.sort_by("gram").to_batches(max_chunksize=1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, row["batch"]), pa.int64()), part.column("gram"), part.column("n")], ["batch", "gram", "n"])


def probabilities(grams: DataFrame) -> DataFrame:
    """grams(gram, n: its count in trusted texts), each once -> gram, p: probability of its last character given those before it."""
    counts = grams.filter("n > 0")
    tail = lambda order: F.substring("gram", ORDER - order + 1, order)
    below = None
    for order in range(1, ORDER + 1):
        # counts of the highest order; below it, the number of different characters that come before a gram
        c = counts if order == ORDER else counts.select(tail(order + 1).alias("g")).distinct().groupBy(F.substring("g", 2, order).alias("gram")).agg(F.count("*").alias("n"))
        of = {r["n"]: r["g"] for r in c.filter("n <= 4").groupBy("n").agg(F.count("*").alias("g")).collect()}
        y = of.get(1, 0) / max(1, of.get(1, 0) + 2 * of.get(2, 0))
        d = [max(0.0, min(i, i - (i + 1) * y * of.get(i + 1, 0) / of[i])) if of.get(i) else 0.5 * i / 2 for i in (1, 2, 3)]
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        c = c.withColumn("cut", cut).withColumn("context", F.substring("gram", 1, order - 1))
        contexts = c.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        contexts = F.broadcast(contexts) if order == 1 else contexts
        wanted = grams.select(tail(order).alias("gram")).distinct().withColumn("context", F.substring("gram", 1, order - 1)).withColumn("suffix", F.substring("gram", 2, order - 1))
        x = wanted.join(c.select("gram", "n", "cut"), "gram", "left").join(contexts, "context", "left")
        x = x.withColumn("below", F.lit(1.0 / POINTS)) if order == 1 else x.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        p = F.coalesce((F.col("n") - F.col("cut")) / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("freed") / F.col("total"), F.lit(1.0)) * F.col("below")
        below = materialise(x.select("gram", p.alias("p")), "lm-p")
    return below


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams found for a batch stay an Arrow column and are looked up there: they are as many as GRAMS and more."""
    for row, found in ((r, b.column("found")[i]) for b in batches for i, r in enumerate(_rows([b.drop_columns(["found"])]))):
        known = found.values if found.is_valid else pa.array([], found.type.value_type)
        grams, logp = known.field("gram"), np.log(known.field("p").to_numpy(zero_copy_only=False).astype(np.float64))
        for own, texts in _pieces(row):
            rank, distinct, first = ngrams(texts)
            at = pc.index_in(pa.array(distinct, pa.string()), value_set=grams)
            if at.null_count:
                raise KeyError(f"{at.null_count} n-grams of batch {row['batch']} have no probability")
            own_logp = logp[at.to_numpy()]
            sums, n = np.concatenate(([0.0], np.cumsum(own_logp[rank]) if len(rank) else [])), np.diff(first)
            with np.errstate(invalid="ignore", divide="ignore"):
                ppl = np.exp(-(sums[first[1:]] - sums[first[:-1]]) / n)
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"][own], pa.int64()), pa.array(row["lang"][own], pa.string()), pa.array(row["trusted"][own], pa.bool_()), pa.array(ppl, mask=n == 0)], ["doc_id", "lang", "trusted", "perplexity"])


def score(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, trusted) -> the same without text, with perplexity by the model of the trusted ones."""
    packed = materialise(docs.select("doc_id", "text", "lang", "trusted").mapInArrow(_pack, PACKED), "lm-packed")
    own = materialise(packed.mapInArrow(_batch_grams, "batch long, gram string, n long"), "lm-grams")
    p = probabilities(materialise(own.groupBy("gram").agg(F.sum("n").alias("n")), "lm-counts"))
    # about one batch a task: what a task holds doesn't depend on how many rows adaptive execution finds small enough to put together
    n = max(1, packed.count())
    found = own.select("batch", "gram").join(p.select("gram", F.col("p").cast("float").alias("p")), "gram").repartition(n, "batch").groupBy("batch").agg(F.collect_list(F.struct("gram", "p")).alias("found"))
    return packed.repartition(n, "batch").join(found.hint("merge"), "batch", "left").mapInArrow(_score, "doc_id long, lang string, trusted boolean, perplexity double")


def left_out(folds: int | None = FOLDS) -> Column:
    """Whether a trusted document sets the quantile instead of being learned."""
    return F.lit(False) if not folds else F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)) == 0


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, folds: int | None = FOLDS) -> DataFrame:
    """docs(doc_id, text, lang), labels(doc_id, quality) -> doc_id, lang, perplexity, threshold, kept. Without folds all trusted documents
    are learned, and set the quantile too."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q = 1").select(F.col("doc_id").alias("__id"), F.lit(True).alias("good"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    good = bounded(materialise(good, "lm-trusted"))
    marked = docs.join(good, docs.doc_id == good["__id"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    scored = materialise(score(marked.select("doc_id", "text", "lang", (F.col("good") & ~left_out(folds)).alias("trusted"))), "lm-scored")
    # the documents held out are trusted ones that the model hasn't learned
    good = scored.filter("perplexity is not null").join(good, F.col("doc_id") == F.col("__id")).select("lang", "perplexity", (~F.col("trusted")).alias("out"))
    at = lambda condition: F.percentile_approx(F.when(condition, F.col("perplexity")), quantile, 10_000)
    n = F.count(F.when(F.col("out"), 1))
    own = good.groupBy(F.col("lang").alias("__lang")).agg(F.when(n > FEWEST, at(F.col("out"))).alias("own"))
    every = good.agg(F.coalesce(at(F.col("out")), at(F.lit(True))).alias("every"))
    if not folds:
        own = good.groupBy(F.col("lang").alias("__lang")).agg(at(F.lit(True)).alias("own"))
    limit = scored.join(bounded(own), scored.lang.eqNullSafe(F.col("__lang")), "left").join(F.broadcast(every))
    threshold = F.coalesce("own", "every", F.lit(float("inf"))) * margin
    return limit.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
