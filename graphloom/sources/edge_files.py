"""Binary edge files: packed little-endian records of two uint32, (src, dst), or of these and a weight as the bits of a float (option
"weighted"), 8 or 12 bytes. A data source reads ranges of records in parallel and writes one file per task, moved into place when
the job commits; each job has its own folder for files that aren't committed, so jobs may append to one path at a time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.graph import Graph
from .shared import new_path
from .vertex_files import read_numbered, write_masks, write_vertices

RECORD = np.dtype([("src", "<u4"), ("dst", "<u4")])
WEIGHTED = np.dtype([("src", "<u4"), ("dst", "<u4"), ("w", "<f4")])
#: Records of a read task, and of one of its batches.
TASK, BATCH = 1 << 24, 1 << 18


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)


def _record(options: dict) -> np.dtype:
    return WEIGHTED if str(options.get("weighted", "")).lower() == "true" else RECORD


def _columns(e: np.ndarray) -> pa.RecordBatch:
    kinds = {"src": np.int64, "dst": np.int64, "w": np.float64}
    return pa.RecordBatch.from_arrays([pa.array(e[c].astype(kinds[c])) for c in e.dtype.names], list(e.dtype.names))


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class EdgeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.record = options["path"], _record(options)

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        files, where = _open(self.path)
        info = files.get_file_info(where)
        infos = [info] if info.type == fs.FileType.File else [x for x in files.get_file_info(fs.FileSelector(where)) if x.is_file and not x.base_name.startswith(("_", "."))]
        out = []
        for x in sorted(infos, key=lambda x: x.path):
            n, rest = divmod(x.size, self.record.itemsize)
            if rest:
                raise ValueError(f"{x.path} ends within a record: {x.size} bytes")
            out += [Range(x.path, i, min(TASK, n - i)) for i in range(0, n, TASK)]
        return out or [Range(where, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.path)
        if not partition.count:
            yield _columns(np.empty(0, self.record))
            return
        with files.open_input_file(partition.path) as f:
            f.seek(partition.first * self.record.itemsize)
            left = partition.count
            while left:
                n = min(left, BATCH)
                yield _columns(np.frombuffer(f.read(n * self.record.itemsize), self.record))
                left -= n


class Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class EdgeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.record, self.tasks = options["path"], _record(options), f"_tasks-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, where = _open(self.path)
        name = f"part-{uuid.uuid4().hex}.bin"
        files.create_dir(f"{where}/{self.tasks}", recursive=True)
        with files.open_output_stream(f"{where}/{self.tasks}/{name}") as f:
            for b in batches:
                e = np.empty(b.num_rows, self.record)
                for c in ("src", "dst"):
                    ids = b.column(c).to_numpy()
                    if len(ids) and not 0 <= ids.min() <= ids.max() < 1 << 32:
                        raise ValueError(f"{c} must be from 0 to 2^32 - 1")
                    e[c] = ids
                if "w" in e.dtype.names:
                    e["w"] = b.column("w").to_numpy()
                f.write(e.tobytes())
        return Written(name)

    def commit(self, messages: list) -> None:
        files, where = _open(self.path)
        for m in messages:
            if m is not None:
                files.move(f"{where}/{self.tasks}/{m.name}", f"{where}/{m.name}")
        self._clean(files, where)

    def abort(self, messages: list) -> None:
        self._clean(*_open(self.path))

    def _clean(self, files, where: str) -> None:
        from pyarrow import fs

        # a job without rows has no folder
        if files.get_file_info(f"{where}/{self.tasks}").type == fs.FileType.Directory:
            files.delete_dir(f"{where}/{self.tasks}")


class Edges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edges"

    def schema(self) -> str:
        return "src long, dst long" + ", w double" * (_record(self.options) is WEIGHTED)

    def reader(self, schema) -> EdgeReader:
        return EdgeReader(self.options)

    def writer(self, schema, overwrite: bool) -> EdgeWriter:
        return EdgeWriter(self.options)


def read_binary(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """(src, dst) or, from weighted records, (src, dst, w)."""
    spark.dataSource.register(Edges)
    return spark.read.format("edges").option("weighted", str(weighted).lower()).load(path)


def write_binary(edges: DataFrame, path: str | None = None, weighted: bool = False) -> str:
    """Write edges, with their w if weighted, and return the path; without one, a new folder in the session's shared one."""
    spark = edges.sparkSession
    spark.dataSource.register(Edges)
    path = path or new_path(spark, "edges")
    w = [F.col("w").cast("double").alias("w")] if weighted else []
    edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), *w).write.format("edges").option("weighted", str(weighted).lower()).mode("append").save(path)
    return path


def convert_text(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst[, w]) from lines `src dst [w]`; blank lines and lines that start with # or % are skipped."""
    line = F.trim(F.col("value"))
    parts = F.split(line, "\\s+")
    kept = spark.read.text(path).filter((line != "") & ~line.rlike("^[#%]"))
    return kept.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"), F.try_element_at(parts, F.lit(3)).cast("double").alias("w"))


def prepare_numbered(spark: SparkSession, edges: str, features: str, labels: str, splits: dict[str, str], out: str) -> None:
    """From the files of a numbered data set (`src,dst` lines; features and labels by line number; an id list for each split) to those
    that training reads below `out`: edges in both directions without repeats and with one loop per vertex as binary records, `id f0 f1 ...`,
    `id label` and `id word` lines. Vertices are the lines of the features."""
    parts = F.split("value", ",")
    e = spark.read.text(edges).filter(F.trim("value") != "").select(F.trim(parts[0]).cast("long").alias("src"), F.trim(parts[1]).cast("long").alias("dst"))
    v = read_numbered(spark, features, labels, splits)
    g = Graph(v.select("vid"), e).symmetrize().dedup().with_self_loops()
    write_binary(g.edges, f"{out}/edges")
    write_vertices(v, f"{out}/features")
    v.select(F.concat_ws(" ", "vid", "label")).write.text(f"{out}/labels")
    write_masks(v, f"{out}/masks")
