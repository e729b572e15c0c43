"""Token ids in a Re-Pair compressed binary format (operator 1).

Documents are put in ascending doc_id order by a range exchange. Each task encodes its texts, appends id 0 to each document and
gathers documents into shards of about SHARD_TOKENS ids. A shard is compressed by Re-Pair: round after round, frequent pairs of
neighbouring ids are replaced by new symbols. Pairs never cross documents, so a document is a slice of the symbol sequence and
rules with their expansion lengths decode any part of it. A shard takes ROUNDS rounds, each with the RULES_PER_ROUND most frequent
pairs that occur MIN_PAIRS times or more, so a symbol spans at most 16 ids; of 984,065 ids that leaves 622,981 symbols (40 rounds:
622,323), and only the size of the files depends on it. Each shard is one row (part, seq, shard) of a Parquet table.

Shard format, little-endian: b"RPG1"; five uint32 counts (first new symbol, rules, documents, symbols, bytes per symbol);
rules (left, right) uint32; expansion length per rule uint32; doc_ids int64; null flags uint8; symbol offset per document
uint64 (one more at the end); ids per document uint64; symbols, uint16 or uint32.

A document larger than a shard is a shard of its own. Null and empty texts hold the end id only. A null doc_id sorts first;
equal doc_ids are ordered by text. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U, Words, materialise, slices, table

MAGIC, END = b"RPG1", 0
SHARD_TOKENS = 1 << 21
ROUNDS, MIN_PAIRS, RULES_PER_ROUND = 4, 32, 2048
#: Pieces that the encoder of a Python worker remembers; beyond it, it starts anew.
CACHE = 1 << 20
#: White space beyond ASCII; the few texts that hold any are encoded whole.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Encoder:
    """Encodes texts piece by piece, a word with the white space before it, and remembers pieces. The tokenizer starts a new
    token wherever white space follows something else, so the ids equal those of the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        self.width[list(vocab.values())] = [len(t) for t in vocab]
        self.by_piece = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.begin, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes], run: int = 256) -> None:
        """Pieces are encoded in runs; a token's place tells its piece, as each character of a token stands for one byte."""
        ids, size = [], []
        runs = [new[i : i + run] for i in range(0, len(new), run)]
        for pieces, coded in zip(runs, self._plain([b"".join(r).decode() for r in runs])):
            ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            at = np.cumsum(self.width[coded])
            if len(at) and at[-1] == ends[-1] and np.isin(ends, at).all():
                n = np.diff(np.searchsorted(at, ends), prepend=-1)
            else:
                alone = self._plain([p.decode() for p in pieces])
                coded, n = np.concatenate(alone), np.array([len(x) for x in alone])
            ids.append(coded)
            size.append(n)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.ids, self.size = np.concatenate([self.ids, *ids]), np.concatenate([self.size, *size])
        self.begin = np.cumsum(self.size) - self.size

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, the end id included."""
        whole = [self._odd(t) for t in texts]
        cut = self._pieces([b"" if odd else t for t, odd in zip(texts, whole)])
        plain = iter(self._plain([t.decode() for t, odd in zip(texts, whole) if odd]))
        return [np.append(next(plain) if odd else c, np.int32(END)) for c, odd in zip(cut, whole)]

    def _odd(self, text: bytes) -> bool:
        return not self.by_piece or bool(_OTHER_SPACE.search(text.decode()))

    def _pieces(self, texts: list[bytes]) -> list[np.ndarray]:
        words = Words(texts)
        n, counts = len(words.start), np.diff(words.first)
        data, offset = words.bytes.tobytes(), np.cumsum([0] + [len(t) + 1 for t in texts])
        begin = np.empty(n, np.int64)
        begin[1:] = words.end[:-1]
        lead = words.first[:-1][counts > 0]
        begin[lead] = offset[:-1][counts > 0]
        gap = words.start - begin
        key = words.hash + np.where(gap == 1, words.bytes[begin], 0).astype(np.uint64) * U(0x9E3779B97F4A7C15)
        wide = np.flatnonzero(gap > 1)
        key[wide] += np.array([hash(data[begin[i] : words.start[i]]) & 0xFFFFFFFFFFFFFFFF for i in wide], np.uint64)
        _, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        pieces = [data[a:b] for a, b in zip(begin[where].tolist(), words.end[where].tolist())]
        tails = [t[len(t.rstrip(b" \t\n\r\x0b\x0c")) :] for t in texts]
        if len(self.known) > CACHE:
            self.forget()
        known = self.known
        # a piece at the start of a text has no white space before it, so it can't be told from its neighbour in a run
        new = [p for p in pieces if p not in known]
        spaced = [p for p in new if p[0] in b" \t\n\r\x0b\x0c"]
        if spaced:
            self._learn(spaced)
        lone = [p for p in dict.fromkeys([*(p for p in new if p[0] not in b" \t\n\r\x0b\x0c"), *filter(None, tails)]) if p not in known]
        if lone:
            self._learn(lone, run=1)
        at = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))[inverse]
        size = self.size[at]
        flat, ends = gather(self.ids, self.begin[at], size), np.concatenate(([0], np.cumsum(size)))[words.first]
        out = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        return [np.concatenate((o, gather(self.ids, self.begin[[known[t]]], self.size[[known[t]]]))) if t else o for o, t in zip(out, tails)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def gather(source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches source[begin:begin + size], one after another."""
    if not len(size):
        return source[:0]
    return source[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def repair(ids: np.ndarray, bounds: np.ndarray, first: int, rounds: int = ROUNDS, least: int = MIN_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, document bounds in symbols, rules): each round replaces the most frequent pairs, left to right."""
    s, rules = ids.astype(np.uint32), []
    small = first <= 1 << 16
    limit = 1 << 16 if small else 1 << 31
    for _ in range(rounds):
        if len(s) < 2:
            break
        key = (s[:-1] << np.uint32(16) | s[1:]) if small else s[:-1].astype(np.uint64) << U(32) | s[1:]
        inside = np.ones(len(key), bool)
        inside[bounds[1:-1][bounds[1:-1] > 0] - 1] = False
        pairs, count = _frequent(key[inside], least)
        top = np.lexsort((pairs, -count))[: min(RULES_PER_ROUND, limit - first - len(rules))]
        if not len(top):
            break
        chosen = pairs[top]
        rank = _rank(key, chosen)
        hit = inside & (rank >= 0)
        place = np.arange(len(key), dtype=np.int32)
        run = np.maximum.accumulate(np.where(hit, np.int32(0), place + np.int32(1)))
        hit &= (place - run) % 2 == 0
        used = np.bincount(rank[hit], minlength=len(chosen)) >= 3
        at = np.flatnonzero(hit)
        at = at[used[rank[at]]]
        name = (first + len(rules) + np.cumsum(used) - 1).astype(np.uint32)
        half, low = (16, 0xFFFF) if small else (32, 0xFFFFFFFF)
        rules += [(p >> half, p & low) for p in chosen[used].tolist()]
        s[at] = name[rank[at]]
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        bounds = np.concatenate(([0], np.cumsum(stay)))[bounds]
        s = s[stay]
    return s, bounds, np.array(rules, np.uint32).reshape(-1, 2)


def _frequent(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with at least so many places, and their counts."""
    key = np.sort(key)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(edge, len(key)))
    often = count >= least
    return key[edge[often]], count[often]


def _rank(key: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Each key's place in `chosen`, -1 where it has none: a slot table finds it, and the few slots with two keys are searched."""
    slot = lambda k: (k.astype(np.uint64) * U(0x9E3779B97F4A7C15) >> U(48)).astype(np.int32)
    table = np.full(1 << 16, -1, np.int32)
    own = slot(chosen)
    table[own] = np.arange(len(chosen))
    rank = table[slot(key)]
    rank[(rank >= 0) & (chosen[rank] != key)] = -1
    for i in np.flatnonzero(table[own] != np.arange(len(chosen))):
        rank[key == chosen[i]] = i
    return rank


def pack(doc_ids: list, docs: list[np.ndarray], first: int) -> bytes:
    """One shard."""
    sizes = np.array([len(d) for d in docs], np.uint64)
    symbols, bounds, rules = repair(np.concatenate(docs), np.concatenate(([0], np.cumsum(sizes.astype(np.int64)))), first)
    length = np.ones(first + len(rules), np.uint32)
    for i, (a, b) in enumerate(rules):
        length[first + i] = length[a] + length[b]
    width = 2 if first + len(rules) <= 65536 else 4
    head = struct.pack("<4s5I", MAGIC, first, len(rules), len(docs), len(symbols), width)
    nulls = np.array([i is None for i in doc_ids], np.uint8)
    return b"".join([
        head, rules.astype("<u4").tobytes(), length[first:].astype("<u4").tobytes(), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), nulls.tobytes(),
        bounds.astype("<u8").tobytes(), sizes.astype("<u8").tobytes(), symbols.astype(f"<u{width}").tobytes(),
    ])


class Shard:
    """A shard read back; ids of any document, or of a range within one, without decoding the others."""

    def __init__(self, data: bytes):
        magic, self.first, rules, docs, symbols, width = struct.unpack_from("<4s5I", data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<4s5I")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules, self.length = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        ids, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else int(i) for i, n in zip(ids, nulls)]
        self.offset, self.sizes = take("<u8", docs + 1).astype(np.int64), take("<u8", docs).astype(np.int64)
        self.symbols = take(f"<u{width}", symbols)
        size = np.concatenate((np.ones(self.first, np.int64), self.length.astype(np.int64)))
        self.size, self.begin = size, np.cumsum(size) - size
        self.flat = np.empty(size.sum(), np.int32)
        self.flat[: self.first] = np.arange(self.first)
        for i, (a, b) in enumerate(self.rules):
            to, n = self.begin[self.first + i], size[a]
            self.flat[to : to + n] = self.flat[self.begin[a] : self.begin[a] + n]
            self.flat[to + n : to + n + size[b]] = self.flat[self.begin[b] : self.begin[b] + size[b]]

    def document(self, i: int) -> np.ndarray:
        s = self.symbols[self.offset[i] : self.offset[i + 1]].astype(np.int64)
        return gather(self.flat, self.begin[s], self.size[s])

    def part(self, i: int, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] of document i; only the symbols over that range are expanded."""
        s = self.symbols[self.offset[i] : self.offset[i + 1]].astype(np.int64)
        ends = np.cumsum(self.size[s])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = ends[a - 1] if a else 0
        return gather(self.flat, self.begin[s[a:b]], self.size[s[a:b]])[start - before : stop - before]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        first = coder.tokenizer.get_vocab_size()
        ids: list = []
        docs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs, held, seq
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "shard": pa.array([pack(ids, docs, first)], pa.binary())})
            ids, docs, held, seq = [], [], 0, seq + 1
            return out

        for batch in batches:
            for cut, texts in slices(batch):
                for i, d in zip(cut.column("doc_id").to_pylist(), coder(texts)):
                    ids.append(i)
                    docs.append(d)
                    held += len(d)
                    if held >= SHARD_TOKENS:
                        yield flush()
        if docs:
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "shard"))):
            shard = Shard(data)
            crc = [zlib.crc32(shard.document(i).astype("<u4").tobytes()) for i in range(len(shard.doc_ids))]
            before = np.cumsum(shard.sizes) - shard.sizes
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(before), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.sizes), pa.array(crc, pa.int64())],
                ["part", "seq", "before", "doc_id", "n_tokens", "ids_crc32"],
            )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> the shard table (part, seq, shard), written and read again."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(_encode(path or tokenizer_path()), "part int, seq int, shard binary"), "tokens")


def read_tokens(shards: DataFrame) -> DataFrame:
    """The shard table -> doc_id, start (ids of all documents before), n_tokens, ids_crc32. Only sums per shard and per part
    are put in order, never documents."""
    read = materialise(shards.mapInArrow(_read, "part int, seq int, before long, doc_id long, n_tokens long, ids_crc32 long"), "token-index")
    shard = read.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part = shard.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    begin = shard.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(part, "part").select("part", "seq", (F.col("base") + F.col("own")).alias("begin"))
    return read.join(begin, ["part", "seq"]).select("doc_id", (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))
