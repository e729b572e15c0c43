"""Near-duplicate documents by odd sketches of MinHash samples (operator 8).

Words are lower-cased (A-Z only) and split at ASCII white space. A document's set holds its distinct five-word shingles (all
words as one shingle below five). Two documents are linked when 100 * |A & B| >= 75 * |A | B|.

1. Per document, in one narrow pass: 32 bands of 4 MinHash samples, and an odd sketch: 2048 more samples (the least hash of each of
   2048 ranges) each flip one of 2048 bits, so that the XOR of two sketches has a population count that tells how many samples
   differ, and so the similarity.
2. Documents with equal fingerprints are compared with the smallest of them on full sets; where the sets are equal, only that
   representative goes on.
3. Within a bucket each member meets the bucket's hub, the member whose buckets are largest in all (that with the fewest edits, in
   a group of edited copies). Sketches screen these pairs, four standard deviations wide, and full sets decide.
4. In buckets whose members then lie in several components, members outside of the largest one are joined with all members, so
   that every remaining pair of a bucket across components is met too. Both sides of a bucket are dealt out in blocks of about PER_BLOCK,
   and each block meets each of the other side in a cell of its own, where sketches are compared as arrays. No pair within a component
   is ever screened or confirmed.

Rows are numbered in a written table first and compared by row; doc_ids are labels that are put on at the end, so null and repeated
doc_ids are rows as all others. component_id is the smallest doc_id of a row's component (null comes last), and kept says whether a
row has it: all rows of a component that repeat its smallest doc_id are kept. Where no row of a component has a doc_id, component_id
is null and one row is kept, that with the least hash of its text. The result doesn't depend on the order of rows or partitions.
Null text and blank text: empty set, linked with nothing. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, Words, as_long, join_by_key, materialise, mix, slices, table, utf8
from .components import components

SHINGLE, SAMPLES, ROWS = 5, 128, 4
BANDS = SAMPLES // ROWS
BINS, BITS = 2048, 2048
#: Standard deviations of the estimate within which a pair is confirmed on full sets.
DEVIATIONS = 4.0
PER_BLOCK = 512
#: Pairs of a cell that are compared at a time.
AT_ONCE = 1 << 15
#: Pairs that are confirmed with one copy of a text.
PER_TEXT = 64
_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
_BAND_OF = (np.arange(SAMPLES, dtype=np.uint64) // U(ROWS) + U(1)) * U(0xA24BAED4963EE407)
SIGNED = "row long, doc_id long, tie long, n_shingles long, f1 long, f2 long, bands array<long>, filled int, sketch array<long>"


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words([t.lower() for t in texts])
    grams, out = words.grams(n), []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in words.hash[a:b]:
                    h = h * U(0x9FB21C651E98DF25) + x
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def samples(s: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(low, np.multiply.outer(_FACTORS, s[i : i + 1024]).min(axis=1), out=low)
    return low


def odd_sketch(s: np.ndarray) -> tuple[int, np.ndarray]:
    """(samples, parity bitmap as 64-bit words) of a sorted set: the least hash of each range is a sample, and flips one bit."""
    ranges = s >> U(53)
    low = s[np.concatenate(([True], ranges[1:] != ranges[:-1]))]
    parity = (np.bincount((mix(low) % U(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return len(low), np.packbits(parity, bitorder="little").view(np.int64)


_ARRAYS = SimpleNamespace(exp=np.exp, sqrt=np.sqrt, floor=np.floor, greatest=np.fmax, least=np.fmin, lit=float)


def _allowed(n, filled, f):
    """How many bits the sketches of a linked pair may differ in. At similarity 0.75, the union fills so many ranges, three quarters of
    them with equal samples; the rest flips bits. What is expected there, and DEVIATIONS more, is let through. n and filled are sums
    over both documents: columns with the functions f of Spark, or arrays with those of numpy."""
    union = BINS * (1 - f.exp(-n / (1.75 * BINS)))
    apart = f.greatest(filled - 1.5 * union, f.lit(0.0))
    # no more samples than shingles differ, but for one more by each shingle that isn't a sample; folding only lowers the count
    most = f.floor(n / 7) + n - filled
    # samples vary as a draw does from which the share of unsampled shingles is missing, and so does the number of ranges filled
    load = n / (1.75 * BINS)
    drawn = 4 * union * 0.1875 * f.greatest(1 - filled / n, f.lit(0.02)) + 2.25 * BINS * f.exp(-load) * (1 - (1 + load) * f.exp(-load))
    rate = 4 * apart / BITS
    slope = f.exp(-2 * apart / BITS)
    folded = BITS / 4 * (1 - f.exp(-rate) * (1 + rate))
    flipped = lambda d: BITS / 2 * (1 - f.exp(-2 * d / BITS))
    return f.least(flipped(apart) + DEVIATIONS * f.sqrt(drawn * slope * slope + folded) + 1, most)


def _screen(a: str, b: str) -> F.Column:
    """Whether two sketches may belong to a linked pair."""
    bits = sum((F.bit_count(F.col(f"s{a}")[i].bitwiseXOR(F.col(f"s{b}")[i])) for i in range(BITS // 64)), F.lit(0))
    return bits <= _allowed(F.col(f"n{a}") + F.col(f"n{b}"), F.col(f"k{a}") + F.col(f"k{b}"), F)


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that come by cell (bucket, i, j) in batches that hold whole cells, with the starts of these and the end. Cells are small."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        differs = sum(np.diff(held.column(c).to_numpy()) != 0 for c in ("bucket", "i", "j"))
        if len(starts := np.flatnonzero(differs) + 1):
            yield held.slice(0, starts[-1]), np.concatenate(([0], starts))
            held = held.slice(starts[-1])
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), a > b, of both sides of each cell (side 0 first) that lie in different components and pass the screen."""
    for rows, bounds in _whole_cells(batches):
        bucket, ids, component, n, k = (rows.column(c).to_numpy() for c in ("bucket", "id", "component", "n", "k"))
        major, left = (rows.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("major", "left"))
        sketch, bands = (rows.column(c).flatten().to_numpy().reshape(len(ids), -1) for c in ("s", "bands"))
        mine, cell = np.flatnonzero(left), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        others = np.add.reduceat(~left, bounds[:-1])[cell[mine]]
        mine, others = mine[others > 0], others[others > 0]
        ends = np.cumsum(others)
        for at in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(ends // AT_ONCE)) + 1):
            own = others[at]
            a = np.repeat(mine[at], own)
            # the other side ends its cell
            b = np.repeat(bounds[cell[mine[at]] + 1] - np.cumsum(own), own) + np.arange(own.sum())
            keep = (component[a] != component[b]) & (major[b] | (ids[a] > ids[b])) & (np.minimum(n[a], n[b]) * 4 >= np.maximum(n[a], n[b]) * 3)
            a, b = a[keep], b[keep]
            bits = np.bitwise_count((sketch[a] ^ sketch[b]).view(np.uint64)).sum(axis=1)
            keep = bits <= _allowed((n[a] + n[b]).astype(float), (k[a] + k[b]).astype(float), _ARRAYS)
            a, b = a[keep], b[keep]
            # a pair with several buckets in common is made in the least of them; a bucket is of one band
            common = np.where(bands[a] == bands[b], bands[a], np.iinfo(np.int64).max).min(axis=1)
            a, b = ids[a[common == bucket[a]]], ids[b[common == bucket[a]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_shingles", "f1", "f2", "bands", "filled", "sketch"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()))
    for batch in batches:
        for part, texts in slices(batch):
            rows = []
            for s in shingle_sets(texts):
                f1, f2 = int(as_long(mix(s).sum(keepdims=True))[0]), int(as_long(mix(s ^ U(0x5851F42D4C957F2D)).sum(keepdims=True))[0])
                if len(s):
                    low = samples(s)
                    band = mix((mix(low) + _BAND_OF).reshape(BANDS, ROWS)[:, 0] + sum(mix(low).reshape(BANDS, ROWS)[:, j] * U(2 * j + 3) for j in range(1, ROWS)))
                    filled, sketch = odd_sketch(s)
                    rows.append((len(s), f1, f2, as_long(band).tolist(), filled, sketch.tolist()))
                else:
                    rows.append((0, 0, 0, [], 0, []))
            labels = [part.column(c) for c in ("row", "doc_id", "tie")]
            yield pa.RecordBatch.from_arrays([*labels, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["row", "doc_id", "tie", *names])


def _pairs(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch of pairs with about `limit` bytes of text: only a cut's texts become Python objects."""
    size = sum(np.nan_to_num(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False)) for c in ("text_a", "text_b"))
    start, held = 0, np.cumsum(size)
    while start < batch.num_rows:
        stop = min(batch.num_rows, int(np.searchsorted(held, (held[start - 1] if start else 0) + limit)) + 1)
        yield batch.slice(start, stop - start)
        start = stop


def _confirm(batches: Iterator[pa.RecordBatch], equal: bool = False) -> Iterator[pa.RecordBatch]:
    """The pairs that are linked, or whose sets are equal, by full sets. A set is worked out once for all pairs of a cut, and not at
    all where both texts are the same: texts of pairs have words."""
    for batch in batches:
        for part in _pairs(batch):
            left, right = (utf8(part.column(c)) for c in ("text_a", "text_b"))
            texts = list(dict.fromkeys(t for pair in zip(left, right) if pair[0] != pair[1] for t in pair))
            sets = dict(zip(texts, shingle_sets(texts))) if texts else {}
            keep = []
            for x, y in zip(left, right):
                if x == y:
                    keep.append(True)
                    continue
                a, b = sets[x], sets[y]
                if equal:
                    keep.append(np.array_equal(a, b))
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(bool(both) and 100 * both >= 75 * (len(a) + len(b) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["u", "v"])


def _links(pairs: DataFrame, texts: DataFrame, equal: bool = False) -> DataFrame:
    """pairs(a, b), b the side that may occur in very many pairs, and texts(row, text) -> the confirmed links (or equal sets), as (u, v)."""
    if not (total := pairs.count()):
        return pairs.sparkSession.createDataFrame([], "u long, v long")
    degree = pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / PER_TEXT).cast("int"))
    salted = join_by_key(pairs, degree, "b", total).select("a", "b", F.expr("cast(pmod(xxhash64(a), salts) as int)").alias("salt"))
    copies = texts.join(degree.withColumnRenamed("b", "row"), "row").select(F.col("row").alias("b"), F.col("text").alias("text_b"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    near = salted.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a").join(copies, ["b", "salt"])
    return materialise(near.select("a", "b", "text_a", "text_b").mapInArrow(lambda b: _confirm(b, equal), "u long, v long"), "dedup-links")


def by_row(rows: DataFrame) -> DataFrame:
    """rows(row, doc_id, tie, text), a written table with different `row`s -> row, doc_id, n_shingles, component_id, first: whether the row
    is the one of its component with the smallest (doc_id, tie, row), nulls last."""
    signed = materialise(rows.select("row", "doc_id", "tie", "text").mapInArrow(_sign, SIGNED), "dedup-signed")
    texts_of = lambda ids: rows.select("row", "text").join(ids, "row", "left_semi")
    classes = signed.filter("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("row").alias("b"), F.count("*").alias("members")).filter("members > 1")
    # written first: a join of two plain exchanges is one whose hot keys adaptive execution can split
    classes = materialise(classes.drop("members"), "dedup-classes")
    alike = materialise(signed.select(F.col("row").alias("a"), "f1", "f2", "n_shingles").join(classes, ["f1", "f2", "n_shingles"]).filter("a <> b").select("a", "b"), "dedup-alike")
    ends = alike.select(F.col("a").alias("row")).union(alike.select("b")).distinct()
    equal = _links(alike, texts_of(ends), True).select(F.col("u").alias("row"), F.col("v").alias("rep"))
    member = signed.select("row", "doc_id", "tie", "n_shingles").join(equal, "row", "left").withColumn("rep", F.coalesce("rep", "row"))
    reps = signed.filter("n_shingles > 0").join(equal, "row", "left_anti")
    reps = materialise(reps.select(F.col("row").alias("id"), "bands", F.col("n_shingles").alias("n"), F.col("filled").alias("k"), F.col("sketch").alias("s")), "dedup-reps")
    named = lambda x: reps.select(F.col("id").alias(x), *(F.col(c).alias(c + x) for c in "nks"))

    banded = reps.select("id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    shared = materialise(banded.join(shared, "bucket"), "dedup-shared")
    weight = shared.groupBy("id").agg(F.sum("members").alias("weight"))
    hubs = shared.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("i"))).alias("h")).select("bucket", (-F.col("h.i")).alias("b"))
    met = shared.join(hubs, "bucket").select(F.col("id").alias("a"), "b").filter("a <> b").distinct()
    tried = materialise(met.join(named("a"), "a").join(named("b"), "b").filter(_screen("a", "b")).select("a", "b"), "dedup-tried")
    texts = materialise(texts_of(weight.select(F.col("id").alias("row"))), "dedup-text")
    links = _links(tried, texts)
    label = components(links)

    placed = shared.join(label, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    held = placed.groupBy("bucket", "component").agg(F.count("*").alias("held"))
    mixed = held.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("held", "component")).alias("most"), F.sum("held").alias("held")).filter("parts > 1")
    blocks = lambda c: F.ceil(c / PER_BLOCK).cast("int")
    mixed = mixed.select("bucket", F.col("most.component").alias("most"), blocks(F.col("held") - F.col("most.held")).alias("lefts"), blocks(F.col("held")).alias("rights"))
    placed = placed.join(mixed, "bucket").withColumn("major", F.expr("component = most")).drop("most")
    placed = materialise(placed.join(reps.select("id", "n", "k", "s", "bands"), "id"), "dedup-rest")
    # members of a bucket's largest component aren't set against each other: the rest meets them and itself
    block, every = (lambda n: F.expr(f"cast(pmod(xxhash64(id), {n}) as int)")), (lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)")))
    side = lambda df, left, i, j: df.select("bucket", i.alias("i"), j.alias("j"), F.lit(left).alias("left"), "id", "component", "major", "n", "k", "s", "bands")
    left = side(placed.filter("not major").withColumn("j", every("rights")), True, block("lefts"), F.col("j"))
    right = side(placed.withColumn("i", every("lefts")), False, F.col("i"), block("rights"))
    cells = left.union(right).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", F.desc("left"))
    rest = cells.mapInArrow(_across, "a long, b long")
    done = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = _links(materialise(rest.join(done, ["a", "b"], "left_anti"), "dedup-more"), texts)
    # what is found so far isn't worked out again: a component is a star of links to its smallest row
    if more.count():
        label = components(label.select(F.col("id").alias("u"), F.col("component").alias("v")).union(more))
    done = member.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    done = materialise(done.select("row", "doc_id", "tie", "n_shingles", "component"), "dedup-done")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tie", "row")
    groups = done.groupBy("component").agg(F.min(order).alias("least"), F.count("*").alias("n")).filter("n > 1")
    groups = materialise(groups.select("component", "n", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("least")), "dedup-groups")
    grouped = join_by_key(done, groups, "component", done.count()).select("row", "doc_id", "n_shingles", "component_id", (F.col("row") == F.col("least")).alias("first"))
    alone = done.join(groups.select("component"), "component", "left_anti")
    return grouped.union(alone.select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    out = by_row(materialise(rows, "dedup-rows"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & F.col("first")).alias("kept"))


def op8_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
g AS (SELECT DISTINCT doc_id, unnest(sh) AS h FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM n UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.reach),
k AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN k ON k.id = doc_id
"""
