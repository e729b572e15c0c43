"""Mixing sources to target weights by index-joined token blocks (operator 4, DataFrame operations only).

The words of a source, document after document, are packed into blocks of BLOCK words (the last one is shorter). The output is
made of shards of SHARD_SLOTS slots. Each slot draws its source by a hashed number, so the counts of a shard are a multinomial
draw of the target shares. Over all shards such counts stray from the targets; so what a source draws beyond its target's slots is
given, slot by slot, to the sources that drew fewer than theirs, and each source ends at its target, to a block. Which of its slots
a source gives away, and to whom, is told by pseudorandom permutations of all of them, so no shard is changed more than another and
each holds a draw of the target shares. The slots of a source are numbered through all shards; slot j of a source with n blocks is mapped to block p(j mod n) of its pass j div n, p being
a swap-or-not permutation of 0..n-1 keyed by the source and the pass. Blocks then join the slots by (source, index). No source has
more slots than two passes. Work grows with slots and blocks: shards and sources are never multiplied.

Sources are ordered by code point, null last, with weights 5, 2, 1 repeating; they share 150 % of all words, and a source stops
at 2 times its size (the excess goes to the others by weight). Packing needs running sums of sizes: they are taken within
chunks of a source (chunks by hash of doc_id and size) and over the chunks' sums, so a source with a third of all rows is no hot group.

Null or empty text has size 0 and is taken 0 times. Rows with a null doc_id are kept. Equal doc_ids are told apart by their
size only; extra columns are ignored by op4 and kept by the pipeline stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, TEXTS, bounded, bundled, materialise, table, unbundled

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
BLOCK, SHARD_SLOTS = 64, 8192
#: Rows of a chunk, about.
CHUNK = 2000
ROUNDS = 16
BINS = 4096


def _key() -> Column:
    """The source as a join key; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes(source, source_size), one row per source -> the same with weight and target. The level that fills the caps is
    found in closed form: sources are sorted by cap per weight, and each one that the level of the rest exceeds stays at its cap."""
    number = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(number) - 1, F.lit(len(weights))) + 1)
    every = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(every)
    return s.withColumn("target", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "weight", "target")


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")) / F.lit(float(1 << 53))


def permuted(df: DataFrame, x: str, n: str, key: tuple[str, ...], out: str) -> DataFrame:
    """df with `out`: where a swap-or-not permutation of 0..n-1 takes x, exact for any n, no table and no retries. Each round is a
    projection of its own, which the planner compiles into one loop."""
    df = df.withColumn(out, F.col(x))
    for r in map(F.lit, range(1, ROUNDS + 1)):
        df = df.withColumn("__other", F.pmod(F.pmod(F.xxhash64(r, *key), F.col(n)) - F.col(out), F.col(n)))
        swap = F.pmod(F.xxhash64(r, F.greatest(out, "__other"), F.lit("swap"), *key), F.lit(2))
        df = df.withColumn(out, F.when(swap == 0, F.col(out)).otherwise(F.col("__other")))
    return df.drop("__other")


def packed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, source, size, ...) -> documents with `start` (words of their source before them; further columns break ties of
    doc_id and size), and the sources (key, source, source_size, weight, target)."""
    ties = [c for c in docs.columns if c not in ("doc_id", "source", "size")]
    # all that orders rows tells their chunks apart, too: a repeated or null doc_id isn't one chunk
    chunk = F.pmod(F.xxhash64("doc_id", "size", *ties), F.col("chunks"))
    rows = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / CHUNK).alias("chunks"))
    sources = targets(rows.select("source", "source_size")).join(rows.select(F.col("source").alias("s"), "chunks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sources = materialise(sources.withColumn("key", _key()), "mix-sources")
    d = docs.withColumn("key", _key()).join(sources.select("key", "chunks"), "key").withColumn("chunk", chunk)
    within = Window.partitionBy("key", "chunk").orderBy("doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("key", "chunk").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("key", "chunk", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    d = d.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(base, ["key", "chunk"])
    return d.select(*docs.columns, "key", (F.col("base") + F.col("own")).alias("start")), sources


def shares(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, n: blocks, from, to: the source's interval of [0, 1), quota: its slots, all: slots of the mix), one row per source."""
    s = sources.filter("target > 0").select("key", F.ceil(F.col("source_size") / block).alias("n"), "source_size", "target")
    # expected slots: a source's short last block counts for what it holds
    s = s.withColumn("want", F.col("target") * F.col("n") / F.col("source_size"))
    every, order = Window.partitionBy(), Window.orderBy("key")
    s = s.withColumn("sum", F.sum("want").over(every)).withColumn("all", F.ceil("sum").cast("long"))
    to = F.sum("want").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.col("sum")
    s = s.withColumn("to", F.when(F.lead("key").over(order).isNull(), F.lit(1.0)).otherwise(F.least(to, F.lit(1.0))))
    s = s.withColumn("from", F.coalesce(F.lag("to").over(order), F.lit(0.0)))
    quota = (F.round(F.col("to") * F.col("all")) - F.round(F.col("from") * F.col("all"))).cast("long")
    return s.select("key", "n", "from", "to", quota.alias("quota"), "all")


def drawn_counts(share: DataFrame, total: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, key, k): the multinomial draw of each shard; sources that it doesn't draw have no row."""
    # sources are looked up by the BINS parts of [0, 1) that their intervals touch
    bins = share.select("key", "from", "to", F.explode(F.expr(f"sequence(floor(`from` * {BINS}), least(floor(`to` * {BINS}), {BINS} - 1))")).alias("bin"))
    slot = share.sparkSession.range(total).select((F.expr(f"id div {shard_slots}")).alias("shard"), _unit(F.lit("draw"), F.col("id")).alias("u"))
    slot = slot.withColumn("bin", F.floor(F.col("u") * BINS))
    drawn = slot.join(bounded(bins), "bin").filter((F.col("from") <= F.col("u")) & (F.col("u") < F.col("to")))
    return drawn.groupBy("shard", "key").agg(F.count("*").alias("k"))


def slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, key, pass, index): one row for each slot of each output shard."""
    spark = sources.sparkSession
    share = materialise(shares(sources, block), "mix-shares")
    counts = materialise(drawn_counts(share, share.agg(F.max("all")).first()[0] or 0, shard_slots), "mix-drawn")
    # slots of a source before each shard, by chunks of shards
    before = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    c = counts.withColumn("chunk", F.expr("shard div 4096"))
    base = c.groupBy("key", "chunk").agg(F.sum("k").alias("held"))
    base = base.select("key", "chunk", F.coalesce(F.sum("held").over(before("key").orderBy("chunk")), F.lit(0)).alias("base"))
    c = c.withColumn("own", F.coalesce(F.sum("k").over(before("key", "chunk").orderBy("shard")), F.lit(0))).join(base, ["key", "chunk"])
    total = counts.groupBy("key").agg(F.sum("k").alias("drawn"))
    known = share.join(total, "key", "left").select("key", "n", "quota", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    known = materialise(known.withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).withColumn("lack", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))), "mix-known")
    # slots that are given away, and those that sources lack, both numbered from 0
    first = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spare, moved = known.filter("over > 0").select("key", first("over").alias("first")), known.agg(F.sum("over")).first()[0] or 0
    lack = known.filter("lack > 0").select("key", "n", "drawn", "lack", first("lack").alias("first"))
    lack = lack.select("key", "n", F.posexplode(F.expr("sequence(drawn, drawn + lack - 1)")).alias("i", "slot"), "first").select("key", "n", "slot", (F.col("first") + F.col("i")).alias("number"))
    c = c.join(bounded(known.join(spare, "key", "left").select("key", "n", "quota", "drawn", "first")), "key").withColumn("at", F.col("base") + F.col("own"))
    # few rows make all slots: they are dealt out (by a fixed number, or adaptive execution would merge them again) before that
    c = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "key")
    s = c.select("shard", "key", "n", "quota", "drawn", "first", F.explode(F.expr("sequence(at, at + k - 1)")).alias("slot"))
    plain = ["shard", "key", "n", "slot"]
    # a source with more slots than its quota keeps those that a permutation of them puts below it, and numbers them so
    more = materialise(permuted(s.filter("drawn > quota"), "slot", "drawn", ("key",), "place"), "mix-more")
    given = more.filter("place >= quota").select("shard", (F.col("first") + F.col("place") - F.col("quota")).alias("from"), F.lit(max(1, moved)).cast("long").alias("moved"), F.lit("moved").alias("all"))
    taken = materialise(permuted(given, "from", "moved", ("all",), "number"), "mix-moved").join(lack, "number").select(*plain)
    s = s.filter("drawn <= quota").select(*plain).union(more.filter("place < quota").select("shard", "key", "n", F.col("place").alias("slot"))).union(taken)
    s = s.filter(F.col("slot") < MOST * F.col("n"))
    s = s.withColumn("pass", F.floor(F.col("slot") / F.col("n"))).withColumn("x", F.pmod("slot", F.col("n")))
    # written here, as conditions on the index (of a join, say) would be pushed through all rounds and multiply them
    return materialise(permuted(s, "x", "n", ("key", "pass"), "index").select("shard", "key", "pass", "index"), "mix-slots")


def draws(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs(doc_id, source, size, ...) -> (documents with their place, sources, the drawn pieces of documents).
    A piece is (doc_id, size, ..., key, start, pass, index, piece_from, piece_words): words of a document that a drawn block holds."""
    placed, sources = packed(docs)
    placed = materialise(placed, "mix-placed")
    edges = placed.filter("size > 0").withColumn("index", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    begin = F.greatest(F.col("start"), F.col("index") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block)
    # slots grow with the words, which the planner doesn't see through an explosion: they are never broadcast
    edges = edges.withColumn("piece_from", begin - F.col("start")).withColumn("piece_words", end - begin)
    return placed, sources, edges.join(slots(sources, block).hint("merge"), ["key", "index"])


def mix(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, taken."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    placed, sources, pieces = draws(materialise(sized, "mix-sizes"))
    taken = pieces.groupBy("key", "start").agg(F.sum("piece_words").alias("taken"))
    held = placed.join(taken.withColumnRenamed("key", "k").withColumnRenamed("start", "at"), (F.col("key") == F.col("k")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left")
    return held.join(sources.select("key", "source_size", "target"), "key").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each document and pass one row with the words of its drawn blocks, joined by one space, and
    n_chars counted anew; other columns stay. The draw is that of mix(). Rows of which nothing is drawn go, as those without words
    do; a row is a document of its own, whatever its doc_id, and equal rows are drawn from one by one."""
    given = docs.columns
    rows = materialise(bundled(docs).withColumn("size", n_words(F.col("text"))), "mix-docs", TEXTS)
    field = lambda c: F.col(f"given.`{c}`").alias(c)
    _, _, pieces = draws(rows.select(field("doc_id"), field("source"), "size", F.xxhash64("given.doc_id", "text", "given.source").alias("hash"), "row"))
    drawn = pieces.groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("piece_from", "piece_words"))).alias("pieces")).drop("pass")
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    # the words are an argument of the outer function, so that a text is split once and not for each of its pieces
    cut = lambda own: F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(own, p.piece_from.cast("int") + 1, p.piece_words.cast("int")))), " ")
    out = rows.join(drawn, "row").withColumn("text", F.transform(F.array(words), cut)[0])
    if "n_chars" in given:
        out = out.withColumn("given", F.col("given").withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))
    return unbundled(out, given)


def op4_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
