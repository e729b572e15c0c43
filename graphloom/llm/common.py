"""Helpers shared by the training-data operators: tables, cut lineage, batches and hashed words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
U = np.uint64
HOT = 4096
#: The level of zstd for copies of whole rows.
TEXTS = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str, level: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends in replicated files. Copies of whole texts are worth a
    higher level of zstd."""
    spark = df.sparkSession
    path = new_path(spark, label)
    write = df.write.option("compression", "zstd")
    (write if level is None else write.option("parquet.compression.codec.zstd.level", level)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bundled(docs: DataFrame) -> DataFrame:
    """(given, text, row): each row's columns but the text in one struct, so that no name of theirs clashes with an operator's own and columns
    of any type go through. Rows are numbered, for good once the frame is written."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("given"), "text", F.monotonically_increasing_id().alias("row"))


def unbundled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col("text") if c == "text" else F.col(f"given.`{c}`").alias(c) for c in columns))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts of a batch of about `limit` bytes of text each, whole rows only."""
    texts = utf8(batch.column(batch.schema.get_field_index(text)))
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit or i == len(texts) - 1:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, held = i + 1, 0


def squeeze(joined: bytes) -> bytes:
    """Texts as they are stored and shuffled: zstd at a level that costs a tenth of the time of hashing their words."""
    return pa.Codec("zstd", compression_level=6).compress(joined, asbytes=True)


def expand(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, size, codec="zstd", asbytes=True)


class Words:
    """The words of some texts: 64-bit hashes, byte bounds, and the first word of each text in `first` (one more at the end)."""

    def __init__(self, texts: list[bytes]):
        self.joined = joined = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(joined, np.uint8)
        ink = ~_IS_SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ink)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(sizes)
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.hash = self._hash(joined)

    def _hash(self, joined: bytes) -> np.ndarray:
        size = self.end - self.start
        short = np.minimum(size, 65).astype(np.uint8)
        order = np.argsort(short, kind="stable")[::-1]
        at, left = self.start[order], short[order].astype(np.int64)
        h = np.full(len(order), 0x9E3779B97F4A7C15, np.uint64)
        live = len(order) - np.searchsorted(left[::-1], np.arange(1, 65))
        for j, n in enumerate(live):
            if not n:
                break
            h[:n] = (h[:n] ^ self.bytes[at[:n] + j]) * U(0x100000001B3)
        out = np.empty(len(order), np.uint64)
        out[order] = h
        for i in np.flatnonzero(size > 64):
            import xxhash

            out[i] = xxhash.xxh3_64_intdigest(joined[self.start[i] : self.end[i]])
        return mix(out ^ size.astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Hashes of n consecutive words from each word on, over the bounds of texts too; the last n - 1 are missing."""
        w = self.hash
        if len(w) < n:
            return np.empty(0, np.uint64)
        h = np.zeros(len(w) - n + 1, np.uint64)
        for j in range(n):
            h = h * U(0x9FB21C651E98DF25) + w[j : len(w) - n + 1 + j]
        return mix(h)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def running_sums(sizes: Column) -> Column:
    """Sums of an array of numbers up to each place, that place included. Step k adds what step k - 1 holds 2^k places before, so an array
    of n takes n log n additions (no accumulator is copied for each element); short arrays skip all later steps."""
    step = lambda a, far: F.when(F.size(a) > far, F.transform(a, lambda v, i: v + F.coalesce(F.get(a, i - far), F.lit(0)))).otherwise(a)
    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(30))), sizes, step)


def normal_tail(z: Column) -> Column:
    """P(Z > z) by a rational approximation of the normal distribution, error under 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with keyed, which has one row a key and in `n` the number of rows with that key, of `total` in all. Keys that hold
    more than one row in HOT, fewer than HOT keys, are broadcast, so that no task takes all rows of such a key; the rest is shuffled."""
    hot = F.broadcast(keyed.filter(F.col("n") > total // HOT + 256))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(keyed, key))


def bounded(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """df with a broadcast hint if it is counted to be small, df itself (a shuffled join) otherwise. For thin rows only."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
