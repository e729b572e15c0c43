"""Hard negatives by full score sorts (operator 13).

The components of a vector become the integers floor(256 x), and a row's score is its integer inner product with an anchor; higher scores
come first, ties by smaller vec_id. Anchors are a stated query set, and meet all rows in blocks: vectors are packed in blocks of
BLOCK, anchors in blocks of ANCHORS. A lane is a task's share of the blocks of vectors: each vector is dealt out once and each block of
anchors once a lane, by a shuffle (nothing is broadcast, so the driver holds none of it). A lane's vectors come before its anchors, which
go by one block at a time and are scored as one product of matrices with each block of the lane.

1. In a block, all scores of an anchor are sorted with their ids (lexsort), and the first POSITIVES rows of the anchor's label kept;
   those of all blocks are merged.
2. Each anchor then goes through the blocks once more with its positives. The rows of other labels are sorted as before; for each positive
   the place of its upper limit, floor(90 % of its score), is found by binary search, and NEGATIVES entries are read from there
   while they reach the lower limit. The first of all blocks make up the result. Positives of negative score have no rows between
   their limits, those of score 0 rows of score 0.

Scores are exact: products are taken in double precision only where no sum can pass 2^53, and as integers otherwise; scores that may
not fit 64 bits are an error.

Rows with a null label or vector, or with null or non-finite components, take no part, nor do vectors of another length than the most
frequent one. Repeated vec_ids are rows of their own: each is an anchor if its id is, and a candidate of all others. A row without a
vec_id is a candidate that comes last among ties, and no anchor. Anchors with fewer rows give what there is; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

SCALE, EVERY, SHIFTED, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES, LOWER, UPPER = 5, 10, 30, 90
BLOCK, ANCHORS, LANES = 4096, 256, 4096
#: Stands for a missing id: after all others.
NAMELESS = (1 << 63) - 1
PACKED = "ids binary, rows binary, labels binary, vectors binary"


def whole_numbers(vectors: DataFrame, label: Column) -> DataFrame:
    """row, id, label, c (array of long) of the rows that take part; rows are numbered in a written table."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.filter(F.col("label").isNotNull() & F.col("v").isNotNull()).filter(~F.exists("v", bad))
    v = v.select("id", "label", F.transform("v", lambda x: F.floor(x * float(SCALE))).alias("c"), F.monotonically_increasing_id().alias("row"))
    v = materialise(v, "negatives")
    size = v.groupBy(F.size("c").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("c") == (size["n"] if size else 0))


def _pack(length: int, limit: int):
    """Rows (id, row, label, c[, limits]) as blocks of at most `limit` of them, each column one string of 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def block() -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*held)]
            order = np.argsort(parts[0], kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([x[order].tobytes()], pa.binary()) for x in parts], ["ids", "rows", "labels", "vectors", "limits"][: len(parts)])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column("id").fill_null(NAMELESS).to_numpy(), *(batch.column(k).to_numpy() for k in ("row", "label")), batch.column("c").flatten().to_numpy().reshape(-1, length)]
            if "limits" in batch.schema.names:
                columns.append(batch.column("limits").flatten().to_numpy().reshape(batch.num_rows, -1))
            for i in range(0, batch.num_rows, limit):
                held.append(tuple(x[i : i + limit] for x in columns))
                if sum(len(h[0]) for h in held) >= limit:
                    yield block()
                    held.clear()
        if held:
            yield block()

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b, exactly."""
    top = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    most = top(a) * top(b) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    raise OverflowError("scores of these vectors may not fit 64 bits")


class Pair:
    """A block of anchors and a block of vectors."""

    def __init__(self, anchors: dict, block: dict, length: int):
        self.ids, self.rows, self.labels = block["ids"], block["rows"], block["labels"]
        self.a_ids, self.a_rows, self.a_labels, self.limits = anchors["ids"], anchors["rows"], anchors["labels"], anchors.get("limits")
        self.scores = products(anchors["vectors"].reshape(len(self.a_ids), length), block["vectors"].reshape(len(self.ids), length))

    def sorted(self, j: int, alike: bool) -> np.ndarray:
        """Places of the rows with the label of anchor j (itself left out), or of the others: by score, then id."""
        pick = np.flatnonzero((self.labels == self.a_labels[j]) & (self.rows != self.a_rows[j]) if alike else self.labels != self.a_labels[j])
        return pick[np.lexsort((self.ids[pick], -self.scores[j, pick]))]


def _pairs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[Pair]:
    """Every block of anchors of a lane with every block of its vectors. Rows come by lane, vectors first; those of one lane are held,
    small blocks as one."""
    lane, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            r = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
            if r["lane"] != lane:
                lane, held = r["lane"], []
            arrays = {k: np.frombuffer(v, np.int64) for k, v in r.items() if k not in ("lane", "asks") and v is not None}
            if r["asks"]:
                for block in held:
                    yield Pair(arrays, block, length)
            elif held and len(held[-1]["ids"]) + len(arrays["ids"]) <= BLOCK:
                held[-1] = {k: np.concatenate((held[-1][k], v)) for k, v in arrays.items()}
            else:
                held.append(arrays)


def _batch(columns: dict, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(columns[k]) if columns[k] else [], t) for k, t in kinds.items()})


def _positives(length: int, k: int):
    kinds = {"anchor": pa.int64(), "id": pa.int64(), "score": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _pairs(batches, length):
            out = {c: [] for c in kinds}
            for j, row in enumerate(p.a_rows):
                best = p.sorted(j, True)[:k]
                for c, x in zip(kinds, (np.full(len(best), row), p.ids[best], p.scores[j, best])):
                    out[c].append(x)
            yield _batch(out, kinds)

    return run


def between(scores: np.ndarray, positive: int, k: int, lower: int, upper: int) -> slice:
    """The first k of descending scores from lower to upper percent of a positive score."""
    top, low = upper * positive // 100, -(-lower * positive // 100)
    first = int(np.searchsorted(-scores, -top, "left"))
    return slice(first, max(first, min(first + k, int(np.searchsorted(-scores, -low, "right")))))


def _negatives(length: int, k: int, lower: int, upper: int):
    kinds = {"anchor": pa.int64(), "place": pa.int32(), "id": pa.int64(), "score": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _pairs(batches, length):
            out = {c: [] for c in kinds}
            limits = p.limits.reshape(len(p.a_ids), -1).tolist()
            for j, row in enumerate(p.a_rows):
                order = p.sorted(j, False)
                scores = p.scores[j, order]
                for place, positive in enumerate(limits[j][1 : 1 + limits[j][0]], 1):
                    best = order[between(scores, positive, k, lower, upper)]
                    for c, x in zip(kinds, (np.full(len(best), row), np.full(len(best), place, np.int32), p.ids[best], p.scores[j, best])):
                        out[c].append(x)
            yield _batch(out, kinds)

    return run


def mine(vectors: DataFrame, anchors: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """vectors(vec_id, embedding), a condition on `id` that names the anchors, and the label ->
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    v = whole_numbers(vectors, label)
    first = v.first()
    if first is None:
        return v.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    length, total = len(first["c"]), v.count()
    blocks = max(1, -(-total // BLOCK))
    lanes = min(blocks, LANES)
    columns = ["id", "row", "label", "c"]
    pack = lambda df, n, limit, *more: df.repartition(n, F.xxhash64("row", F.lit(limit))).select(*columns, *more).mapInArrow(_pack(length, limit), PACKED + ", limits binary" * len(more))
    index = materialise(pack(v, blocks, BLOCK), "negatives-index").withColumn("lane", F.pmod(F.xxhash64("rows"), F.lit(lanes)))
    chosen = v.filter(anchors & F.col("id").isNotNull())
    few = max(1, -(-chosen.count() // ANCHORS))

    def met(a: DataFrame) -> DataFrame:
        """Every block of anchors meets every block of vectors: anchors are copied to as many lanes as there are, vectors to none."""
        a = materialise(a, "negatives-anchors").withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
        both = index.withColumn("asks", F.lit(False)).unionByName(a.withColumn("asks", F.lit(True)), allowMissingColumns=True)
        return both.repartition(lanes, "lane").sortWithinPartitions("lane", "asks")

    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    found = met(pack(chosen, few, ANCHORS)).mapInArrow(_positives(length, positives), "anchor long, id long, score long")
    found = materialise(found.withColumn("place", best("anchor")).filter(F.col("place") <= positives), "negatives-positives")
    # an anchor's positives: their number, then their scores in order, then zeros
    scores = F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x.score)
    limits = found.groupBy(F.col("anchor").alias("row")).agg(F.slice(F.concat(F.array(F.count("*")), scores, F.array_repeat(F.lit(0).cast("long"), positives)), 1, positives + 1).alias("limits"))
    asked = pack(chosen.join(limits, "row"), few, ANCHORS, "limits")
    hard = met(asked).mapInArrow(_negatives(length, negatives, lower, upper), "anchor long, place int, id long, score long")
    hard = hard.withColumn("rank", best("anchor", "place")).filter(F.col("rank") <= negatives)
    name = lambda c: F.when(F.col(c) != NAMELESS, F.col(c))
    pairs = found.select("anchor", "place", name("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.select("anchor", "place", "rank", name("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "place"])
    ids = chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return out.join(ids, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_sorted_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0, shifted)


ORACLE = r"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike, CAST(list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * b.c[i])) AS BIGINT) AS score
  FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
