"""Readers of vertex features, labels and masks, and of training configurations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a mask file and their numbers; anything else is 3.
MASKS = {"train": 0, "eval": 1, "val": 1, "test": 2}


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.trim("value"), "\\s+").alias("t"))


def mask_number(word: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MASKS.items() for x in kv)), word), F.lit(3))


def read_vertices(spark: SparkSession, features: str, labels: str, masks: str | None = None) -> DataFrame:
    """(vid, h, label, mask) from `id f0 f1 ...`, `id label` and `id word` lines, joined by id; without a mask file, id mod 3."""
    f = _tokens(spark, features).select(F.col("t")[0].cast("long").alias("vid"), F.transform(F.slice("t", 2, 1 << 30), lambda x: x.cast("double")).alias("h"))
    y = _tokens(spark, labels).select(F.col("t")[0].cast("long").alias("vid"), F.col("t")[1].cast("long").alias("label"))
    v = f.join(y, "vid")
    if masks is None:
        return v.withColumn("mask", (F.col("vid") % 3).cast("int"))
    m = _tokens(spark, masks).select(F.col("t")[0].cast("long").alias("vid"), mask_number(F.col("t")[1]).alias("mask"))
    return v.join(m, "vid", "left").withColumn("mask", F.coalesce("mask", F.lit(3)))


def numbered(lines: DataFrame) -> DataFrame:
    """(vid, value) of a text source: line numbers from 0, in the order of file names and of places within files. Lines are counted by
    block of a file, as tasks read blocks in any order; only one row per block is sorted as a whole."""
    block = [F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__s")]
    placed = lines.select("value", *block, F.monotonically_increasing_id().alias("__m"))
    blocks = placed.groupBy("__f", "__s").agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy("__f", "__s").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return placed.join(blocks, ["__f", "__s"]).select((F.col("__b") + F.col("__m") - F.col("__first")).alias("vid"), "value")


def read_numbered(spark: SparkSession, features: str, labels: str, splits: dict[str, str]) -> DataFrame:
    """(vid, h, label, mask) from comma-separated features and labels by line number, and one id list per split."""
    f = numbered(spark.read.text(features)).select("vid", F.transform(F.split("value", ","), lambda x: x.cast("double")).alias("h"))
    y = numbered(spark.read.text(labels)).select("vid", F.trim("value").cast("long").alias("label"))
    m = None
    for word, path in splits.items():
        ids = spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").cast("long").alias("vid"), F.lit(MASKS[word]).alias("mask"))
        m = ids if m is None else m.union(ids)
    return f.join(y, "vid").join(m, "vid", "left").withColumn("mask", F.coalesce("mask", F.lit(3)))


def write_vertices(v: DataFrame, path: str) -> None:
    """`id f0 f1 ...` lines with four decimals."""
    v.select(F.concat_ws(" ", F.col("vid").cast("string"), F.array_join(F.transform("h", lambda x: F.format_string("%.4f", x)), " "))).write.text(path)


def write_masks(v: DataFrame, path: str) -> None:
    """`id word` lines; a mask without a word is unknown."""
    words = F.element_at(F.create_map(*(F.lit(x) for n, word in ((0, "train"), (1, "val"), (2, "test")) for x in (n, word))), F.col("mask"))
    v.select(F.concat_ws(" ", "vid", F.coalesce(words, F.lit("unknown")))).write.text(path)


@dataclass(frozen=True)
class Config:
    """A training configuration of KEY:VALUE lines. Keys that steer an engine are accepted and have no effect."""

    algorithm: str = ""
    vertices: int = 0
    layers: tuple[int, ...] = ()
    epochs: int = 10
    fanout: tuple[int, ...] = ()
    batch_size: int = 64
    edge_file: str = ""
    feature_file: str = ""
    label_file: str = ""
    mask_file: str = ""
    learn_rate: float = 0.01
    weight_decay: float = 1e-4
    decay_rate: float = 0.97
    decay_epoch: int = 100
    drop_rate: float = 0.5
    proc_local: bool = False
    ignored: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str) -> Config:
        kinds = {f: type(d) for f, d in ((k, getattr(cls, k)) for k in cls.__dataclass_fields__ if k != "ignored")}
        values, ignored = {}, []
        for line in text.splitlines():
            key, colon, value = line.strip().partition(":")
            name, value = key.strip().lower(), value.strip()
            if not colon:
                continue
            if name not in kinds:
                ignored.append(key.strip())
            elif kinds[name] is tuple:
                values[name] = tuple(int(x) for x in value.split("-") if x)
            elif kinds[name] is bool:
                values[name] = value not in ("", "0")
            else:
                values[name] = kinds[name](value)
        return cls(**values, ignored=tuple(ignored))
