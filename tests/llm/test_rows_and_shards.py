"""Final shards of the mix, near duplicates whatever the order of rows, and pipeline stages on columns of any name and type."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import mixing, near_dedup


def text(rng, n=40):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def test_final_shards_are_draws_of_the_targets(spark):
    """Counts of every source over the shards, the last ones by themselves too, by chi-squared; each source at its target."""
    want = {"a": 8000, "b": 6000, "c": 5000, "d": 990, "e": 10}
    sources = spark.createDataFrame([("=" + k, k, 64 * n, 1.0, 64.0 * n) for k, n in want.items()], "key string, source string, source_size long, weight double, target double")
    got = mixing.slots(sources, shard_slots=64).collect()
    assert Counter(r["key"][1:] for r in got) == Counter(want)
    assert len({(r["key"], r["pass"], r["index"]) for r in got}) == sum(want.values())
    counts = defaultdict(Counter)
    for r in got:
        counts[r["shard"]][r["key"][1:]] += 1
    shards = sorted(counts)[:-1]
    assert all(sum(counts[i].values()) == 64 for i in shards)
    p = np.array([want[k] for k in "abcd"]) / sum(want.values())
    for part in (shards, shards[-30:], shards[:30]):
        seen = np.array([[counts[i][k] for k in "abcd"] for i in part])
        chi = ((seen - 64 * p) ** 2 / (64 * p)).sum()
        free = 3.05 * len(part)
        assert abs(chi - free) < 5 * np.sqrt(2 * free) + 0.35 * free, (len(part), chi, free)
        mean = seen.mean(0)
        assert (np.abs(mean - 64 * p) <= 4.5 * np.sqrt(64 * p * (1 - p) / len(part))).all(), (len(part), mean)


def test_near_duplicates_do_not_depend_on_order(spark):
    """Repeated doc_ids of different texts, copies under several doc_ids, and no doc_id at all, in several orders and numbers of partitions."""
    rng = random.Random(8)
    a, b, c = text(rng), text(rng), text(rng)
    rows = [(1, a), (7, a), (7, b), (1, c), (3, b + " x"), (7, c + " y"), (9, a + " z"), (9, None), (9, "one"), (None, "one"), (None, text(rng)), (2, "")]
    seen = set()
    for n in (1, 3, 7):
        rng.shuffle(rows)
        out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        seen.add(tuple(sorted(Counter((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in out).items())))
    assert len(seen) == 1
    got = dict(next(iter(seen)))
    # a with its copies: 1, 7, 9; b: 7 and 3; c: 1 and 7; "one": 9 and null
    assert got == {(1, 36, 1, True): 2, (7, 36, 1, False): 1, (9, 37, 1, False): 1, (7, 36, 3, False): 1, (3, 37, 3, True): 1, (7, 37, 1, False): 1, (9, 0, 9, True): 1, (9, 1, 9, True): 1, (-1, 1, 9, False): 1, (-1, 36, -1, True): 1, (2, 0, 2, True): 1}


def test_screen_lets_pairs_at_the_limit_through(spark):
    """_screen on sketches of pairs with a similarity of 0.75 to 0.8, of small and large sets: none that is linked is left out."""
    rng = np.random.default_rng(3)
    rows = []
    for n in (8, 40, 300, 2000, 9000):
        for _ in range(30):
            union = rng.permutation(np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64)))
            apart = int(len(union) * rng.uniform(0.2, 0.25))
            cut = rng.integers(0, apart + 1)
            a, b = np.sort(union[: len(union) - cut]), np.sort(union[apart - cut :])
            both = len(np.intersect1d(a, b))
            assert 100 * both >= 75 * len(union)
            (ka, sa), (kb, sb) = near_dedup.odd_sketch(a), near_dedup.odd_sketch(b)
            rows.append((len(a), ka, sa.tolist(), len(b), kb, sb.tolist()))
    df = spark.createDataFrame(rows, "na long, ka int, sa array<long>, nb long, kb int, sb array<long>")
    assert df.filter(near_dedup._screen("a", "b")).count() == len(rows)
    far = [(r[0], r[1], r[2], q[3], q[4], q[5]) for r, q in zip(rows[30:], rows[31:]) if r[0] > 30 and q[0] > 30]
    assert spark.createDataFrame(far, df.schema).filter(near_dedup._screen("a", "b")).count() == 0


def test_pairs_across_components_in_cells(spark):
    """Pairs of both sides of every cell beside all pairs of a bucket by the screen's own expression, in batches smaller than a cell."""
    rng = np.random.default_rng(5)
    rows = []
    for group in range(3):
        common = rng.integers(0, 2**64 - 1, 60, dtype=np.uint64)
        for member in range(12):
            s = np.unique(np.concatenate((common[: 60 - member], rng.integers(0, 2**64 - 1, 5 * (member % 3), dtype=np.uint64))))
            k, sketch = near_dedup.odd_sketch(s)
            rows.append((len(rows), group * 100 + member % 4, member % 4 == 0, len(s), k, sketch.tolist(), [group, 10 + member % 2, 20 + group]))
    buckets = [(b, *r) for r in rows for b in r[6]]
    blocks = {b: 3 if b < 10 else 1 for b, *_ in buckets}
    left = [(b, i % blocks[b], j, True, i, *r) for b, i, *r in buckets if not r[1] for j in range(2)]
    right = [(b, i, j % 2, False, j, *r) for b, j, *r in buckets for i in range(blocks[b])]
    cells = spark.createDataFrame(left + right, "bucket long, i int, j int, left boolean, id long, component long, major boolean, n long, k int, s array<long>, bands array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        dealt = cells.repartition(3, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", F.desc("left"))
        got = Counter((r["a"], r["b"]) for r in dealt.mapInArrow(near_dedup._across, "a long, b long").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = spark.createDataFrame(rows, "id long, component long, major boolean, n long, k int, s array<long>, bands array<long>")
    x, y = (one.select(*(F.col(c).alias(c + e) for c in ("id", "component", "major", "n", "k", "s", "bands"))) for e in "ab")
    met = x.join(y, (F.col("ida") > F.col("idb")) & F.arrays_overlap("bandsa", "bandsb") & (F.col("componenta") != F.col("componentb")) & ~(F.col("majora") & F.col("majorb")))
    want = met.filter((F.least("na", "nb") * 4 >= F.greatest("na", "nb") * 3) & near_dedup._screen("a", "b")).select("ida", "idb").collect()
    assert got == Counter((r["ida"], r["idb"]) for r in want) and 50 < len(got) < met.count()


def test_equal_texts_are_linked_without_their_sets(spark, monkeypatch):
    """Only texts that differ are hashed, each once for all its pairs."""
    hashed = []
    monkeypatch.setattr(near_dedup, "shingle_sets", lambda texts, f=near_dedup.shingle_sets: hashed.extend(texts) or f(texts))
    rng = random.Random(4)
    a, b, c = text(rng), text(rng), text(rng)
    pairs = [(1, 0, a, a), (2, 0, a + " x", a), (3, 0, b, a), (4, 0, a, a), (5, 6, c, c + " y")]
    batch = spark.createDataFrame(pairs, "a long, b long, text_a string, text_b string").toArrow().combine_chunks().to_batches()[0]
    links = {(r["u"], r["v"]) for out in near_dedup._confirm(iter([batch])) for r in out.to_pylist()}
    assert links == {(1, 0), (2, 0), (4, 0), (5, 6)} and sorted(hashed) == sorted(x.encode() for x in (a, a + " x", b, c, c + " y"))


def test_stages_take_columns_of_any_name_and_type(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i % 40 if i % 9 else None, text(rng, 30), "en", rng.choice(["a", "b"]), 1, "x", 0.5, i, {"k": i}, (i, "s"), [i], 2, "t") for i in range(60)] + [(61, "123", "en", "a", 1, "x", 0.5, 0, {}, (0, None), [], 2, "t")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, __row long, m map<string,int>, st struct<a:int,b:string>, ar array<int>, row long, given string"
    docs = spark.createDataFrame(rows, kinds)
    spark.createDataFrame([(0, text(rng, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before = held
        held = corpus_pipeline.materialise(stage(spark, held, str(tmp_path)), name)
        sizes.append(held.count())
        if name != "token_output":
            assert held.columns == docs.columns and [t for _, t in held.dtypes] == [t for _, t in docs.dtypes]
    assert sizes[:3] == [60, 60, 60] and sizes[4] == sizes[3] == before.count()
    own = {(r["doc_id"], r["text"]): r for r in docs.collect()}
    kept = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()
    assert all(r == own[r["doc_id"], r["text"]] for r in kept) and len(kept) == 61


def test_dropped_rows_are_counted(spark, tmp_path):
    rng = random.Random(5)
    item, copy = text(rng, 20), text(rng)
    rows = [(i, text(rng), "en", "a", 0) for i in range(20)] + [(20, "99 ##", "en", "a", 0), (21, copy, "en", "a", 0), (22, copy + " x", "en", "a", 0), (23, text(rng) + " " + item + " " + text(rng), "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, counts = corpus_pipeline.run_counted(spark, str(tmp_path))
    assert counts[:3] == [("language_id", 24, 23), ("near_dedup", 23, 22), ("decontaminate", 22, 21)]
    assert [c[1] for c in counts[1:]] == [c[2] for c in counts[:-1]] and counts[-1][2] == out.count()
