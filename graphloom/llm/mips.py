"""Maximum inner product search with score-aware anisotropic quantisation (operator 3).

Vectors are cut into parts of two dimensions, and each part is coded by one of 16 centres, four bits. Codes and centres minimise
an anisotropic loss: the part of the error that is parallel to the vector counts ETA times as much as the rest, since it is what
shifts large inner products. What the first code leaves of a vector is coded once more, in the same way and with the vector's own
direction, so a vector has LEVELS codes. Centres are fitted on a bounded sample (at most about SAMPLE vectors): k-means per part, then
turns of coordinate descent over codes and a weighted least-squares fit of the centres, part by part.

Every vector is indexed. Queries come in blocks, and vectors in blocks; each pair of blocks is one row that a task scans: table
lookups over four-bit codes score all pairs, and the best FIRST of a query in a block get exact inner products in double
precision. The K-th best of those is a level that a vector must reach: |q.x - q.code(x)| is at most |q| times the length of what
the codes leave of x. The first code with its bound leaves vectors out, the further ones with their own, much smaller bounds most of the
rest, and each vector that is left is ranked by its exact product. So no vector of the true best K is lost, however many tie or lie
close. Each query then keeps the best K over all blocks; ties resolve to smaller ids.

Vectors that are null, zero, of another length than the most frequent one, or hold null or non-finite components take no part.
Repeated vec_ids are separate candidates, but never of a query with that id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

K, EVERY = 20, 20
PART, CENTRES, ETA = 2, 16, 4.0
SAMPLE, TURNS, SWEEPS = 8192, 4, 3
LEVELS = 3
BLOCK, QUERIES, FIRST = 4096, 1024, 48


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.filter(~F.exists("v", bad)).filter(F.exists("v", lambda x: x != 0))
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("v") == (size["n"] if size else 0))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(x: np.ndarray, centres: np.ndarray, turns: int = 2, unit: np.ndarray | None = None) -> np.ndarray:
    """Four-bit codes of the rows of x, by coordinate descent on the anisotropic loss along `unit` (the rows' own directions)."""
    n, parts = len(x), centres.shape[0]
    unit = units(x) if unit is None else unit
    xs, us = x.reshape(n, parts, PART), unit.reshape(n, parts, PART)
    square = np.stack([((xs[:, m, None, :] - centres[m]) ** 2).sum(-1) for m in range(parts)], 1)
    along = np.stack([((xs[:, m, None, :] - centres[m]) * us[:, m, None, :]).sum(-1) for m in range(parts)], 1)
    code = square.argmin(-1)
    rows = np.arange(n)
    total = along[rows[:, None], np.arange(parts), code].sum(1)
    for _ in range(turns):
        for m in range(parts):
            rest = total - along[rows, m, code[:, m]]
            loss = square[:, m] + (ETA - 1) * (rest[:, None] + along[:, m]) ** 2
            code[:, m] = loss.argmin(-1)
            total = rest + along[rows, m, code[:, m]]
    return code.astype(np.uint8)


def decoded(code: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return centres[np.arange(centres.shape[0]), code].reshape(len(code), -1)


def widened(x: np.ndarray) -> np.ndarray:
    """x with zeros up to a whole number of parts."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PART)))


def fit_levels(x: np.ndarray) -> np.ndarray:
    """Centres, LEVELS x parts x 16 x PART: each level is fitted on what those before it leave."""
    x = widened(x)
    left, unit, out = x, units(x), []
    for _ in range(LEVELS):
        out.append(fit(left, unit))
        left = left - decoded(_codes(left, out[-1], unit=unit), out[-1])
    return np.stack(out)


def encode(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Codes of all levels, one after the other."""
    left, unit, out = x, units(x), []
    for c in centres:
        out.append(_codes(left, c, unit=unit))
        left = left - decoded(out[-1], c)
    return np.concatenate(out, axis=1)


def fit(x: np.ndarray, unit: np.ndarray | None = None) -> np.ndarray:
    """Centres, parts x 16 x PART, fitted on the rows of x."""
    rng = np.random.default_rng(7)
    x = widened(x)
    n, parts = len(x), x.shape[1] // PART
    xs = x.reshape(n, parts, PART)
    centres = np.stack([xs[rng.choice(n, CENTRES, replace=n < CENTRES), m] for m in range(parts)])
    for _ in range(8):
        for m in range(parts):
            near = ((xs[:, m, None, :] - centres[m]) ** 2).sum(-1).argmin(-1)
            size = np.bincount(near, minlength=CENTRES)
            for d in range(PART):
                sums = np.bincount(near, xs[:, m, d], CENTRES)
                centres[m, size > 0, d] = sums[size > 0] / size[size > 0]
    for _ in range(TURNS):
        centres = refit(x, _codes(x, centres, unit=unit), centres, unit=unit)
    return centres


def refit(x: np.ndarray, code: np.ndarray, centres: np.ndarray, sweeps: int = SWEEPS, unit: np.ndarray | None = None) -> np.ndarray:
    """Centres with less of the anisotropic loss for these codes: sum |x - c|^2 + (ETA - 1) (u.(x - c))^2 is minimised over one part at
    a time, where each centre has a system of PART equations of its own, so memory is that of x whatever the number of dimensions."""
    n, parts = code.shape
    centres = centres.copy()
    xs = x.reshape(n, parts, PART)
    us = (units(x) if unit is None else unit).reshape(n, parts, PART)
    along = lambda m: ((xs[:, m] - centres[m, code[:, m]]) * us[:, m]).sum(1)
    total = sum(along(m) for m in range(parts))
    for _ in range(sweeps):
        for m in range(parts):
            u, own = us[:, m], code[:, m]
            rest = total - along(m)
            goal = (ETA - 1) * (rest + (u * xs[:, m]).sum(1))
            sums = lambda w: np.bincount(own, w, CENTRES)
            size = np.bincount(own, minlength=CENTRES)
            a = np.stack([np.stack([sums((ETA - 1) * u[:, d] * u[:, e]) for e in range(PART)], -1) for d in range(PART)], -2)
            a += (size[:, None, None] + 1e-6) * np.eye(PART)
            b = np.stack([sums(xs[:, m, d] + goal * u[:, d]) for d in range(PART)], -1)
            moved = np.linalg.solve(a, b[..., None])[..., 0]
            centres[m, size > 0] = moved[size > 0]
            total = rest + along(m)
    return centres


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _index(centres: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, codes = [], [], []

        def block(i: np.ndarray, x: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(i, kind="stable")
            pad = np.pad(c[order], ((0, 0), (0, c.shape[1] % 2)))
            packed = pad[:, 0::2] | pad[:, 1::2] << 4
            return pa.RecordBatch.from_pydict({"ids": pa.array([i[order].tobytes()], pa.binary()), "vectors": pa.array([x[order].tobytes()], pa.binary()), "codes": pa.array([packed.tobytes()], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy().reshape(-1, size)
            wide = widened(x)
            for i in range(0, len(x), BLOCK):
                ids.append(batch.column("vec_id").to_numpy()[i : i + BLOCK])
                rows.append(x[i : i + BLOCK])
                codes.append(encode(wide[i : i + BLOCK], centres))
                if sum(map(len, ids)) >= BLOCK:
                    yield block(*map(np.concatenate, (ids, rows, codes)))
                    ids, rows, codes = [], [], []
        if ids:
            yield block(*map(np.concatenate, (ids, rows, codes)))

    return run


def _gather_queries(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, size)
            ids = batch.column("vec_id").to_numpy()
            for i in range(0, len(ids), QUERIES):
                yield pa.RecordBatch.from_pydict({"q_ids": pa.array([ids[i : i + QUERIES].tobytes()], pa.binary()), "q_vectors": pa.array([x[i : i + QUERIES].tobytes()], pa.binary())})

    return run


def scan(ids: np.ndarray, x: np.ndarray, packed: np.ndarray, q_ids: np.ndarray, q: np.ndarray, centres: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query ids, vector ids, exact scores, exact scores taken): the best k of a block for each query. Codes leave out only vectors that
    can't be among them."""
    parts = centres.shape[1]
    code = np.empty((len(ids), packed.shape[1] * 2), np.uint8)
    code[:, 0::2], code[:, 1::2] = packed & 15, packed >> 4
    code = code[:, : LEVELS * parts].reshape(len(ids), LEVELS, parts)
    wide = widened(q).reshape(len(q), parts, PART)
    tables = np.einsum("qmd,lmcd->qlmc", wide, centres).astype(np.float32)
    length, rest, left = np.linalg.norm(q, axis=1), widened(x), []
    for c, own in zip(centres, code.transpose(1, 0, 2)):
        rest = rest - decoded(own, c)
        left.append(np.linalg.norm(rest, axis=1))
    # rounding: of the tables and their sums in single precision, and of products in double precision
    slack = 2e-7 * (LEVELS * parts + 2) * np.abs(tables).max(axis=3).sum(axis=(1, 2), dtype=np.float64) + 1e-12 * length * np.linalg.norm(x, axis=1).max(initial=0)
    # sums by row: equal vectors have equal products wherever they stand
    products = lambda pick, j: np.einsum("nd,d->n", x[pick], q[j])
    out, taken = [], 0
    for a in range(0, len(q), 64):
        approx = np.zeros((LEVELS, min(64, len(q) - a), len(ids)), np.float32)
        for level in range(LEVELS):
            if level:
                approx[level] = approx[level - 1]
            for m in range(parts):
                approx[level] += tables[a : a + 64, level, m][:, code[:, level, m]]
        for j in range(a, a + approx.shape[1]):
            pick = np.flatnonzero(ids != q_ids[j])
            if len(pick) > max(k, FIRST):
                s = approx[-1, j - a, pick]
                n = max(k, FIRST)
                first = pick[np.argpartition(s, len(s) - n)[len(s) - n :]]
                level = np.sort(products(first, j))[-k]
                taken += n
                # what isn't a number is never below the level
                for s, own in zip(approx[:, j - a], left):
                    pick = pick[~(s[pick] + length[j] * own[pick] + slack[j] < level)]
            exact = products(pick, j)
            taken += len(pick)
            best = np.lexsort((ids[pick], -exact))[:k]
            out.append((np.full(len(best), q_ids[j]), ids[pick][best], exact[best]))
    return *(np.concatenate(c) for c in zip(*out)), taken


def _scan(centres: np.ndarray, size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                x, q = np.frombuffer(r["vectors"]).reshape(-1, size), np.frombuffer(r["q_vectors"]).reshape(-1, size)
                packed = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
                a, b, s, _ = scan(ids, x, packed, q_ids, q, centres, k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    v = materialise(usable(vectors), "mips")
    total = v.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], empty)
    share = int(min(1.0, SAMPLE / total) * (1 << 30))
    sample = np.array([r["v"] for r in v.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).select("v").collect() or v.select("v").take(SAMPLE)])
    size, centres = sample.shape[1], fit_levels(sample)
    blocks = max(1, -(-total // BLOCK))
    dealt = v.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)))
    index = dealt.repartition(blocks, "part").select("vec_id", "v").mapInArrow(_index(centres, size), "ids binary, vectors binary, codes binary")
    q_parts = max(1, -(-total // (every * QUERIES)))
    queries = v.filter(F.col("vec_id") % every == 0).repartition(q_parts, F.xxhash64("vec_id")).select("vec_id", "v").mapInArrow(_gather_queries(size), "q_ids binary, q_vectors binary")
    # every block of queries meets every block of vectors: queries are copied to as many lanes as there are, vectors to none
    lanes = min(blocks, 4096)
    index = materialise(index.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes))), "mips-index")
    queries = materialise(queries, "mips-queries").withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    found = index.join(queries, "lane").repartition(F.xxhash64("ids", "q_ids")).mapInArrow(_scan(centres, size, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_anisotropic_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
