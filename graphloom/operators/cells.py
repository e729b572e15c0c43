"""Work on edges that needs the vectors of both ends. Vertices fall into blocks by a hash of their id, edges into cells: the block of src and
that of dst. A vector is copied once for each cell of its block, not once for each edge, and a cell's edges are pairs of places in
its two blocks. Sums by vertex leave a cell as one row per vertex. Blocks hold about BLOCK vertices, so a task is bounded by its cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, FEWEST = 1 << 17, 4
#: Edges whose vectors are gathered at a time.
AT_ONCE = 1 << 15

#: From the ids and vectors of both blocks, and the places of src and dst of each edge, to rows.
Work = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def vectors(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _by_cell(work: Work):
    """Rows come by cell; in a cell, vectors of src (kind 0), then those of dst (1), then edges (2)."""

    def done(held: list) -> Iterator[pa.RecordBatch]:
        if not all(held):
            return
        ids, rows = [], []
        for own in held[:2]:
            i = np.concatenate([x for x, _ in own])
            order = np.argsort(i)
            ids.append(i[order])
            rows.append(np.concatenate([x for _, x in own])[order])
            own.clear()
        ends = [np.concatenate([x[k] for x in held[2]]) for k in (0, 1)]
        places = [np.minimum(np.searchsorted(i, e), len(i) - 1) for i, e in zip(ids, ends)]
        there = (ids[0][places[0]] == ends[0]) & (ids[1][places[1]] == ends[1])
        yield from work(ids[0], rows[0], ids[1], rows[1], places[0][there], places[1][there])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, [[], [], []]
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, kinds = (batch.column(c).to_numpy() for c in ("cell", "kind"))
            starts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                if cells[a] != cell:
                    yield from done(held)
                    cell, held = cells[a], [[], [], []]
                part = batch.slice(a, b - a)
                src = part.column("src").to_numpy().copy()
                held[kinds[a]].append((src, vectors(part.column("h"), b - a).copy() if kinds[a] < 2 else part.column("dst").to_numpy().copy()))
        yield from done(held)

    return run


def over_cells(edges: DataFrame, of_src: DataFrame, of_dst: DataFrame, vertices: int, work: Work, schema: str) -> DataFrame:
    """edges(src, dst) with of_src(vid, h) and of_dst(vid, h), a row a vertex each -> what `work` makes of each cell. Edges without
    a vector at both ends are left out."""
    n = max(FEWEST, -(-vertices // BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    none = lambda t: F.lit(None).cast(t)
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = of_src.select("vid", "h", every.alias("o")).select((block("vid") * n + F.col("o")).alias("cell"), F.lit(0).alias("kind"), F.col("vid").alias("src"), none("long").alias("dst"), "h")
    b = of_dst.select("vid", "h", every.alias("o")).select((F.col("o") * n + block("vid")).alias("cell"), F.lit(1).alias("kind"), F.col("vid").alias("src"), none("long").alias("dst"), "h")
    e = edges.filter("src is not null and dst is not null").select((block("src") * n + block("dst")).alias("cell"), F.lit(2).alias("kind"), "src", "dst", none("array<double>").alias("h"))
    return a.union(b).union(e).repartition(n * n, "cell").sortWithinPartitions("cell", "kind").mapInArrow(_by_cell(work), schema)


def list_rows(names: list[str], ids: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ids and numbers, the last column being vectors."""
    width = values[-1].shape[1]
    for i in range(0, len(ids), AT_ONCE):
        cut = [v[i : i + AT_ONCE] for v in (ids, *values)]
        m = pa.ListArray.from_arrays(pa.array(np.arange(len(cut[0]) + 1, dtype=np.int32) * width), pa.array(cut[-1].ravel()))
        yield pa.RecordBatch.from_arrays([*map(pa.array, cut[:-1]), m], names)


def edge_products(a_ids, a, b_ids, b, src, dst) -> Iterator[pa.RecordBatch]:
    """(src, dst, w): the inner product of the vectors of both ends."""
    for i in range(0, len(src), AT_ONCE):
        s, d = src[i : i + AT_ONCE], dst[i : i + AT_ONCE]
        yield pa.RecordBatch.from_arrays([pa.array(a_ids[s]), pa.array(b_ids[d]), pa.array(np.einsum("ij,ij->i", a[s], b[d]))], ["src", "dst", "w"])
