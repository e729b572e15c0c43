"""The training-data operators against brute force, round trips and held-out accuracy, on small fixtures with nulls, empty and
long texts, ties, repeated rows, empty tables and columns whose names clash."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat_format, components, decontaminate, language_id, mips, mixing, near_dedup, quality_lm, repair_tokens, secrets, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"
VOCAB = {"en": "the of and that with from this which would there".split(), "de": "der und nicht auch über schön können straße für wird".split()}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "clash") for i, t, lang, src in rows], DOCS)


def words(rng, n, vocab=None):
    return " ".join(rng.choice(vocab) if vocab else "".join(rng.choices("abcdefghijk", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = []
    base = words(rng, 120)
    for i in range(60):
        lang = rng.choice(["en", "de"])
        rows.append((i, words(rng, rng.randint(1, 80), VOCAB[lang]) if i % 2 else words(rng, rng.randint(1, 80)), lang, rng.choice(["a", "b", None])))
    for i in range(60, 90):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(90, None, None, None), (91, "", "en", "b"), (92, " \t\n ", "de", "a"), (93, rows[3][1], "en", "a"), (94, "lone " * 30, "en", "b"), (95, base + " " + words(rng, 3000), "en", "c")]
    return rows


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_components(rows):
    def shingles(t):
        w = word_list("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    s = {i: shingles(t) for i, t, *_ in rows}
    ids, root = list(s), {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and s[a] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s[i]), find(i)) for i in ids}


def test_near_duplicates(spark, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, corpus)).collect()}
    assert got == brute_components(corpus)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_components_are_not_worked_out_twice(spark, corpus, monkeypatch):
    asked = []
    monkeypatch.setattr(near_dedup, "components", lambda links, f=near_dedup.components: asked.append(links) or f(links))
    same = [(i, "one two three four five six seven eight nine ten", "en", None) for i in range(3)] + [(9, "words of no other text at all here", "en", None)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, same)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 9: 9} and len(asked) == 1


def test_near_duplicates_without_doc_ids(spark):
    rng = random.Random(2)
    a, b = words(rng, 50), words(rng, 50)
    rows = [(None, a, "en", "a"), (9, a + " x", "en", "a"), (None, a, "en", "a"), (None, b, "en", "a"), (None, b, "en", "a"), (4, None, "en", "a"), (None, None, "en", "a")]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs(spark, rows)).collect())
    assert got == Counter([(None, 9, False), (9, 9, True), (None, 9, False), (None, None, True), (None, None, False), (4, 4, True), (None, None, True)])


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r["component"] for r in components.components(path).collect()} == {0}


def test_components_of_hot_ids(spark):
    star = [(0, i) for i in range(1, 1500)] + [(i, 9000) for i in range(5000, 6500)]
    edges = spark.createDataFrame([*star, (20000, 20001), (20001, 1499)], "u long, v long")
    got = {r["id"]: r["component"] for r in components.components(edges).collect()}
    want = {i: 0 for i in [*range(1500), 20000, 20001]} | {i: 5000 for i in [*range(5000, 6500), 9000]}
    assert got == want


def test_stars_need_no_further_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialise", lambda df, label, f=components.materialise: written.append(label) or f(df, label))
    edges = spark.createDataFrame([(5, 1), (1, 6), (7, 1), (9, 8), (8, 8)], "u long, v long")
    got = {r["id"]: r["component"] for r in components.components(edges).collect()}
    assert got == {1: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8} and len(written) == 1


def test_screen_lets_links_through():
    rng = np.random.default_rng(0)
    s = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    filled, sketch = near_dedup.odd_sketch(s)
    assert filled <= len(s) and (sketch == near_dedup.odd_sketch(s)[1]).all()


def brute_substrings(rows):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = word_list(t)
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            x = tuple(w[a : a + 20])
            if x in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(x)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), kept)
    return out


def test_substrings(spark, corpus):
    want = brute_substrings(corpus)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.repeat_digests(docs(spark, corpus)).collect()}
    assert got == {i: (a, b, hashlib.sha256(k.encode()).hexdigest()) for i, (a, b, k) in want.items()}
    assert {r["doc_id"]: r["kept_text"] for r in substring_dedup.remove_repeats(docs(spark, corpus)).collect()} == {i: k for i, (_, _, k) in want.items()}
    assert substring_dedup.repeat_digests(docs(spark, [])).count() == 0


def test_substrings_with_hot_minimisers(spark, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    want = brute_substrings(corpus)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeat_digests(docs(spark, corpus)).collect()}
    assert got == {i: b for i, (_, b, _) in want.items()}


def test_substrings_of_null_and_repeated_doc_ids(spark):
    rng = random.Random(9)
    w = [words(rng, 30) for _ in range(4)]
    rows = [(None, w[0] + " a", "en", "a"), (5, w[0] + " b", "en", "a"), (5, w[1], "en", "a"), (5, w[1], "en", "a"), (None, w[2], "en", "a"), (None, w[2], "en", "a"), (7, w[1] + " " + w[3], "en", None), (6, None, None, None)]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.repeat_digests(docs(spark, rows)).collect())
    # doc_id 5 comes before null and 7; of equal rows one stays whole
    assert got == Counter([(None, 31, 30), (5, 31, 0), (5, 30, 0), (5, 30, 30), (None, 30, 0), (None, 30, 30), (7, 60, 30), (6, 0, 0)])


TEXTS = ["", "Hello  world!\n\n It's 12345 done. ", " lead", "tail \t", "é\xa0ü  x", "a" * 5000, "word " * 400, "日本 語", "<|endoftext|> x"]


def test_encoder_equals_whole_texts():
    coder = repair_tokens.Encoder(repair_tokens.tokenizer_path())
    whole = coder.tokenizer.encode_batch(TEXTS, add_special_tokens=False)
    for _ in range(2):
        assert [d.tolist() for d in coder([t.encode() for t in TEXTS])] == [e.ids + [0] for e in whole]


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    made = [rng.integers(0, 6, rng.integers(1, 900)).astype(np.int32) for _ in range(30)]
    shard = repair_tokens.Shard(repair_tokens.pack([None, *range(29)], made, 50257))
    assert len(shard.rules) and len(shard.symbols) < sum(map(len, made)) and shard.doc_ids[0] is None
    for i, d in enumerate(made):
        assert (shard.document(i) == d).all()
        a, b = sorted(rng.integers(0, len(d) + 1, 2))
        assert (shard.part(i, a, b) == d[a:b]).all()


def test_token_index(spark, corpus):
    coder = repair_tokens.Encoder(repair_tokens.tokenizer_path())
    start, want = 0, {}
    for i, t, *_ in corpus:
        ids = coder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = repair_tokens.read_tokens(repair_tokens.write_tokens(docs(spark, corpus)))
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()} == want
    assert repair_tokens.read_tokens(repair_tokens.write_tokens(docs(spark, []))).count() == 0


def test_secrets(spark):
    rng = random.Random(2)
    key = lambda n, a="0123456789abcdef": "".join(rng.choices(a, k=n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(i, f"ü see {key(40, b64)} or 'api_key': \"{key(20)}\" AKIA{key(16, 'ABCDEF123')} token=short {key(32)} end", "en", "a") for i in range(60)]
    rows += [(100, None, "en", "a"), (101, "", "en", "a"), (102, "thereisnothingsecretinthis andtheseareonlywordsofthetext " * 3, "en", "a"), (103, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "en", "a")]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs(spark, rows))).collect()}
    patterns = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    least = {"assign": 12, "access": 18, "hex": 16}
    for i, t, *_ in rows:
        base = []
        for rank, (kind, p) in enumerate(patterns.items()):
            base += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, t or "") if len(m[m.lastindex or 0]) >= least[kind]]
        base = [x for _, _, x in sorted(base)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i]["spans"].split(",")) or not base
    found = sum("random:" in got[i]["spans"] for i in range(60))
    assert found >= 50
    assert got[102]["spans"] == "" and "random" not in got[103]["spans"]
    assert secrets.digest(secrets.scan(docs(spark, []))).count() == 0


def battery(v):
    """The combined p-value of a base64 run, by the definition."""
    k, n = 64, len(v)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = (sum(c * c for c in Counter(v).values()) * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    x = np.array([secrets.ALPHABETS["base64"].index(c) + 1 for c in v], float)
    d = x - x.mean()
    serial = abs((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n)
    low = x <= k / 2
    both = 2 * low.sum() * (n - low.sum())
    turns = abs((low[1:] != low[:-1]).sum() - both / n) / math.sqrt(both * (both - n) / (n * n * (n - 1)))
    t = -sum(math.log(max(1e-9, p)) for p in (tail(chi), 2 * tail(serial), 2 * tail(turns)))
    return math.exp(-t) * (1 + t + t * t / 2)


def test_added_spans_are_random_and_rare(spark):
    rng = random.Random(8)
    b64 = secrets.ALPHABETS["base64"]
    parts = "get set user name from data base order item price list total check value index token count file path read write".split()
    name = lambda: "".join(p if i == 0 else p.title() for i, p in enumerate(rng.choices(parts, k=7)))
    # identifiers only: nothing, or next to nothing, is a secret
    rows = [(i, " ".join(name() for _ in range(4)), "en", "a") for i in range(300)]
    found = [r for r in secrets.scan(docs(spark, rows)).collect() if r["spans"]]
    assert sum(len(r["spans"]) for r in found) <= 0.05 * 1200
    # keys among identifiers and prose: the keys are found, and of what is found few are not keys
    prose = lambda n: " ".join(rng.choice(parts) for _ in range(n))
    keys = {i: "".join(rng.choices(b64, k=44)) for i in range(0, 300, 2)}
    rows = [(i, f"{prose(60)} {name()} {keys[i] if i in keys else ''} {prose(9)}", "en", "a") for i in range(300)]
    frame = docs(spark, rows)
    text = {i: t for i, t, *_ in rows}
    got = {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"] if s["kind"] == "random"] for r in secrets.scan(frame).collect()}
    flagged = [(i, v) for i, vs in got.items() for v in vs]
    assert sum(keys.get(i) == v for i, v in flagged) >= 0.85 * len(keys) and sum(keys.get(i) != v for i, v in flagged) <= 0.05 * len(flagged)
    # what is added follows from the p-values and the cuts
    found = secrets.found_in(frame)
    runs, doc = secrets.judged(found), {r["row"]: r["doc_id"] for r in found.collect()}
    accept = secrets.cuts(runs)
    p = {text[doc[r["row"]]][r["span"]["start"] : r["span"]["stop"]]: (r["p"], r["stratum"]) for r in runs.filter("not decoy").collect()}
    # no table holds what was found
    assert "value" not in str(found.schema) and not any(k in str(r) for r in found.collect() for k in keys.values())
    assert all(np.isclose(q, battery(v), rtol=1e-3, atol=1e-6) for v, (q, _) in p.items() if len(set(v)) > 2)
    assert {v for _, v in flagged} == {v for v, (q, s) in p.items() if q >= accept.get(s, 2)}


def test_secrets_of_a_very_long_text(spark):
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("0123456789abcdef", k=32)) for _ in range(16000))
    began = time.time()
    row = secrets.digest(secrets.scan(docs(spark, [(1, text, "en", "a")]))).first()
    assert row["n_hex"] == 16000 and time.time() - began < 60


def test_mips(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:340] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2003, [float("nan")] * 16), (2004, [])]
    got = mips.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    hit = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        assert list(own["rank"]) == list(range(1, 21)) and np.allclose(own["score"], s[q, own["vec_id"]])
        hit += len(set(own["vec_id"]) & set(np.lexsort((np.arange(900), -s[q].round(9)))[:20]))
    assert set(got["query_id"]) == set(range(0, 900, 20)) and hit / len(got) >= 0.9
    assert mips.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_centres_meet_the_dense_least_squares_fit():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 6))
    start = rng.normal(size=(3, mips.CENTRES, mips.PART))
    code = mips._codes(x, start)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def loss(c):
        left = x - c[np.arange(3), code].reshape(len(x), -1)
        return (left**2).sum() + (mips.ETA - 1) * ((left * unit).sum(1) ** 2).sum()

    # the dense system: one equation for each element of a vector, and one for each vector along itself
    width, weight = 3 * mips.CENTRES * mips.PART, np.sqrt(mips.ETA - 1)
    one = np.zeros((600, 6, width))
    for m in range(3):
        for d in range(mips.PART):
            one[np.arange(600), m * mips.PART + d, (m * mips.CENTRES + code[:, m]) * mips.PART + d] = 1
    along = weight * np.einsum("nd,ndw->nw", unit, one)
    dense = np.linalg.lstsq(np.concatenate([one.reshape(-1, width), along]), np.concatenate([x.ravel(), weight * (x * unit).sum(1)]), rcond=None)[0]
    best = loss(dense.reshape(start.shape))
    losses = [loss(mips.refit(x, code, start, n)) for n in (1, 3, 40)]
    assert loss(start) > losses[0] >= losses[1] >= losses[2]
    assert abs(losses[2] - best) < 1e-3 * best


def test_codes_leave_most_vectors_out():
    """Vectors without any structure: fewer than a tenth of them is ranked exactly, and none of the best is lost."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = mips.fit_levels(x[:1500])
    code = mips.encode(x, centres)
    q = np.arange(0, 2000, 20)
    a, b, s, taken = mips.scan(np.arange(2000), x, code[:, 0::2] | code[:, 1::2] << 4, q, x[q], centres, 20)
    full = x[q] @ x.T
    full[np.arange(100), q] = -np.inf
    assert all(set(b[a == i]) == set(np.argsort(-full[n])[:20]) for n, i in enumerate(q))
    assert taken < 0.1 * 2000 * 100, taken / (2000 * 100)


def test_mips_finds_all_of_a_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x[::3] = x[0] + 1e-3 * rng.normal(size=x[::3].shape)
    x = x.astype(np.float32)
    got = mips.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).toPandas()
    s = np.einsum("qd,nd->qn", x[::20].astype(float), x.astype(float))
    s[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    best = np.argsort(-s, axis=1, kind="stable")[:, :20]
    want = {(20 * j, r + 1): i for j, row in enumerate(best) for r, i in enumerate(row)}
    assert {(a, b): c for a, b, c in zip(got["query_id"], got["rank"], got["vec_id"])} == want


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(0, 300)), "en", rng.choice(["a", "a", "b", "c", "d", None])) for i in range(1500)] + [(5000, None, "en", "a")]
    d = docs(spark, rows)
    a, b = mixing.mix(d).toPandas(), mixing.mix(d).toPandas()
    key = lambda f: sorted(map(tuple, f.values.tolist()))
    assert key(a) == key(b) and len(a) == len(rows) and (a["taken"] <= 2 * a["size"]).all()
    a["source"] = a["doc_id"].map({r[0]: r[3] or "~null" for r in rows})
    sums = a.groupby("source").agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "max"), given=("source_size", "max"))
    weight, total = dict(zip(sorted(sums.index), [5, 2, 1, 5, 2])), sums["size"].sum()
    want, open_ = {}, set(sums.index)
    while True:
        level = (1.5 * total - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sums["size"][s]}
        if not over:
            break
        want |= {s: 2.0 * sums["size"][s] for s in over}
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    assert (sums["size"] == sums["given"]).all() and all(np.isclose(sums["target"][s], want[s]) for s in want)
    assert ((sums["taken"] - sums["target"]).abs() <= 0.03 * sums["target"] + 64).all()
    texts = mixing.mix_documents(d)
    assert texts.columns == d.columns
    out = {r["doc_id"]: r["n"] for r in texts.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert out == {i: n for i, n in zip(a["doc_id"], a["taken"]) if n}
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix_documents(docs(spark, [])).count() == 0


def test_shards_draw_multinomial_counts_and_sources_meet_their_targets(spark):
    want = {"a": 5000, "b": 3000, "c": 1990, "d": 10}
    sources = spark.createDataFrame([("=" + k, k, 64 * n, 1.0, 64.0 * n) for k, n in want.items()], "key string, source string, source_size long, weight double, target double")
    share = mixing.shares(sources)
    counts = Counter({(r["shard"], r["key"]): r["k"] for r in mixing.drawn_counts(share, 10000, 50).collect()})
    for k, n in want.items():
        own, p = np.array([counts[i, "=" + k] for i in range(200)]), n / 10000
        # mean and variance of a binomial count, four standard errors wide
        assert abs(own.mean() - 50 * p) <= 4 * math.sqrt(50 * p * (1 - p) / 200) and abs(own.var() - 50 * p * (1 - p)) <= 4 * 50 * p * math.sqrt(2.5 / 200) + 0.1
    assert all(sum(counts[i, "=" + k] for k in want) == 50 for i in range(200))
    got = mixing.slots(sources, shard_slots=50).collect()
    assert Counter(r["key"][1:] for r in got) == Counter(want) and Counter(r["shard"] for r in got) == Counter(dict.fromkeys(range(200), 50))
    assert len({(r["key"], r["pass"], r["index"]) for r in got}) == 10000


def test_permutations(spark):
    for n in (1, 2, 7, 100):
        df = mixing.permuted(spark.range(n).select("id", F.lit(n).cast("long").alias("n"), F.lit("k").alias("k")), "id", "n", ("k",), "p")
        assert sorted(r["p"] for r in df.collect()) == list(range(n))


def test_chat(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", r"<\|im_end|> <\\| \ <", "a\nb\n", "", None, "<", "|>"]
    rows = [(c, t, ["user", "assistant", "system", None, "as\nsi\\n"][(c + t) % 5], nasty[(c * 3 + t) % 7], "x") for c in range(8) for t in range(c + 1)] + [(None, None, "assistant", "solo", "x"), (3, 0, "user", "tie", "x"), (2, 9, "a\0\\\\n\n\\s", "nul", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    stored = chat_format.examples(chat_format.format_conversations(turns))
    got = {r["conv_id"]: r for r in chat_format.digest(stored).collect()}
    convs = {}
    for c, t, role, text, _ in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, own in convs.items():
        own = sorted(own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in stored.filter("loss_start is not null").collect():
        assert r["text"][r["loss_stop"] :] == "<|im_end|>\n" and r["text"][: r["loss_start"]].endswith("<|im_start|>assistant\n")
    assert chat_format.digest(chat_format.examples(chat_format.format_conversations(turns.limit(0)))).count() == 0
    # rows without a conv_id are conversations of their own
    alone = spark.createDataFrame([(None, i, "assistant", "x") for i in range(3)], "conv_id long, turn long, role string, text string")
    assert [r["n_turns"] for r in chat_format.digest(chat_format.examples(chat_format.format_conversations(alone))).collect()] == [1, 1, 1]


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(3, 60), VOCAB[lang]), lang, "a") for i, lang in enumerate(rng.choices(["en", "de"], k=300))]
    rows += [(1000, None, "en", "a"), (1001, "123 ***", "de", "a"), (1002, "", None, "a"), (1003, "the and " * 40000, None, "a")]
    got = {r["doc_id"]: r for r in language_id.identify(docs(spark, rows)).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]]["held_out"] for r in held) and sum(g["held_out"] for g in got.values()) == len([r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2])
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) / len(held) > 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    assert all(0 <= g["score"] <= 1 for g in got.values())
    assert language_id.identify(docs(spark, [])).count() == 0


def test_rare_language_is_learned_among_many_rows(spark):
    often = spark.range(80_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the and of").otherwise("der und nicht").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    rare = spark.createDataFrame([(100_000 + i, "tänään sää", "fi") for i in range(2)], "doc_id long, text string, lang string")
    langs, model = language_id.train(often.union(rare))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(rare, langs, model).collect()}
    assert langs == ["de", "en", "fi"] and set(got.values()) == {"fi"}
    # every row counts: the features of an English text are each met 40,000 times
    f = language_id.features([b"the and of"])[0].ravel()
    f, times = np.unique(f[f < 1 << language_id.BITS], return_counts=True)
    met = np.exp(model[f, langs.index("en")].astype(float) - model[: 1 << language_id.BITS, langs.index("en")].min()) * language_id.ALPHA
    assert np.allclose(met, 40_000 * times, rtol=1e-3)


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, words(rng, rng.randint(14, 40))) for i in range(20)] + [(99, None), (98, ""), (97, "two words")]
    rows = []
    for i in range(20):
        w = items[i][1].split()
        kind = i % 4
        if kind == 1:
            w[rng.randrange(len(w))] = "changed"
        if kind == 2:
            del w[len(w) // 2]
        passage = " ".join(w).upper() if kind == 3 else " ".join(w)
        rows.append((i, words(rng, 50) + " " + passage + ". " + words(rng, 50), "en", "a"))
    rows += [(100 + i, words(rng, 200), "en", "a") for i in range(20)] + [(200, None, "en", "a"), (201, "", "en", "a"), (202, items[0][1] * 1, "en", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(i, i) for i in range(20)} | {(202, 0)}
    kept = decontaminate.decontaminate(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns and {r["doc_id"] for r in kept.collect()} == set(range(100, 120)) | {200, 201}
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0 and decontaminate.contaminated(docs(spark, []), bench).count() == 0


def brute_align(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 30))
        assert decontaminate.align(a, b)[0] == brute_align(a, b)


def test_quality(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 60, VOCAB["en"]), "en", "a") for i in range(100)] + [(200 + i, "".join(rng.choices("#%&xqz!0", k=300)), "en", "a") for i in range(20)]
    rows += [(300, None, "en", "a"), (301, "", None, "a"), (302, words(rng, 60, VOCAB["en"]), None, "a")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200, 0, 0), (1, 1, 0)], "doc_id long, quality int, lang int")
    got = {r["doc_id"]: r for r in quality_lm.judge(docs(spark, rows), labels).collect()}
    assert sum(got[i]["kept"] for i in range(100)) >= 97 and got[302]["kept"]
    assert not any(got[200 + i]["kept"] for i in range(20)) and not got[300]["kept"] and got[301]["perplexity"] is None
    nothing = quality_lm.judge(docs(spark, rows), labels.limit(0)).collect()
    assert all(r["kept"] == (r["perplexity"] is not None) for r in nothing)


def brute_kneser_ney(trusted):
    """log-probability of the last character of a gram, by the definition."""
    n = quality_lm.ORDER
    windows = lambda t: [("\0" * (n - 1) + t)[i : i + n] for i in range(len(t))]
    levels = {n: Counter(g for t in trusted for g in windows(t))}
    for o in range(n - 1, 0, -1):
        levels[o] = Counter(g[1:] for g in {g[-o - 1 :] for g in levels[n]})
    cuts, sums = {}, {}
    for o, c in levels.items():
        of = Counter(c.values())
        y = of[1] / max(1, of[1] + 2 * of[2])
        cuts[o] = [max(0.0, min(i, i - (i + 1) * y * of[i + 1] / of[i])) if of[i] else i / 4 for i in (1, 2, 3)]
        sums[o] = {}
        for g, m in c.items():
            total, freed = sums[o].get(g[:-1], (0, 0))
            sums[o][g[:-1]] = total + m, freed + cuts[o][min(m, 3) - 1]

    def p(g):
        if not g:
            return 1 / 0x110000
        total, freed = sums[len(g)].get(g[:-1], (0, 0))
        m = levels[len(g)][g]
        return p(g[1:]) if not total else (m - cuts[len(g)][min(m, 3) - 1] if m else 0) / total + freed / total * p(g[1:])

    return lambda t: float(np.exp(-np.mean([np.log(p(g)) for g in windows(t)])))


def test_quality_of_real_characters(spark):
    rng = random.Random(12)
    vocab = "добрый вечер сегодня хорошая погода снова идти домой вместе".split()
    rows = [(i, words(rng, 40, vocab), "ru", "a") for i in range(80)]
    # letters that differ by 12 in code point, and digits
    rows += [(100 + i, "".join(chr(ord(c) + 12 * rng.randint(-8, 8)) if c != " " else c for c in words(rng, 40, vocab)), "ru", "a") for i in range(20)]
    rows += [(200, "год 1999", "ru", "a"), (201, "日本語 😀", "ru", "a")]
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_lm.judge(docs(spark, rows), labels, folds=None).collect()}
    want = brute_kneser_ney([t for i, t, _, _ in rows if i < 60])
    assert all(np.isclose(got[i]["perplexity"], want(t), rtol=1e-6) for i, t, _, _ in rows)
    assert sum(got[i]["kept"] for i in range(80)) >= 78 and not any(got[100 + i]["kept"] for i in range(20))


def test_quality_keeps_good_documents_that_it_has_not_seen(spark):
    """Half of the good documents are labelled: the other half is kept as those are, and as the quantile says."""
    rng = random.Random(21)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000)]
    rows = [(i, words(rng, 30, vocab), "en", "a") for i in range(1200)] + [(2000 + i, "".join(rng.choices("qrstuvwxyz  ", k=200)), "en", "a") for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 1200, 2)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality_lm.judge(docs(spark, rows), labels, quantile=0.95, margin=1.0).collect()}
    unseen = np.mean([got[i] for i in range(1, 1200, 2)])
    assert abs(unseen - 0.95) <= 0.03, unseen
    assert not any(got[2000 + i] for i in range(40))


def test_batches_of_many_letters_are_small(monkeypatch):
    rng = random.Random(4)
    one = quality_lm.Different()
    texts = ["".join(chr(0x4E00 + rng.randrange(10000)) for _ in range(20000)) for _ in range(10)]
    for t in texts:
        one.add(t.encode())
    want = len({t[i : i + 4] for t in texts for i in range(len(t) - 3)})
    assert abs(one.count() - want) <= 0.02 * want
    same = quality_lm.Different()
    for _ in range(50):
        same.add(("abcdefghij" * 2000).encode())
    assert same.count() < 12


def test_batches_of_many_ngrams_are_held_as_columns():
    """What a worker holds for half a million n-grams, in and out, beside one table of the numbers of n-grams."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(0)
    text = rng.integers(0x4E00, 0x4E00 + 2000, 260_000).astype(np.uint32).tobytes().decode("utf-32-le")
    own = {"batch": [7], "doc_id": [[1]], "lang": [["x"]], "trusted": [[True]], "sizes": [[len(text.encode())]], "packed": [quality_lm.squeeze(text.encode())]}
    packed = pa.RecordBatch.from_pydict(own, pa.schema({"batch": pa.int64(), "doc_id": pa.list_(pa.int64()), "lang": pa.list_(pa.string()), "trusted": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()), "packed": pa.binary()}))
    grams = pa.Table.from_batches(list(quality_lm._batch_grams(iter([packed])))).combine_chunks()
    assert grams["n"].to_numpy().sum() == 260_000 and grams["gram"].to_pylist() == sorted(set(grams["gram"].to_pylist()))
    found = pa.array([[{"gram": g, "p": 0.5} for g in grams["gram"].to_pylist()]], pa.list_(pa.struct({"gram": pa.string(), "p": pa.float32()})))
    asked = packed.append_column("found", found)
    tracemalloc.start()
    (out,) = quality_lm._score(iter([asked]))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert abs(out.column("perplexity")[0].as_py() - 2.0) < 1e-9
    assert most < 130


def test_quality_of_batches_and_nothing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i if i % 5 else None, words(rng, 12, VOCAB["en"]), "en", "a") for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    got = lambda: sorted((r["doc_id"] or -1, round(r["perplexity"], 5)) for r in quality_lm.judge(docs(spark, rows).repartition(2), labels).collect())
    want = got()
    monkeypatch.setattr(quality_lm, "STEP", 200)
    monkeypatch.setattr(quality_lm, "PIECE", 90)
    assert got() == want and len(want) == 60
    monkeypatch.setattr(quality_lm, "STEP", 1 << 20)
    monkeypatch.setattr(quality_lm, "GRAMS", 50)
    assert got() == want
    assert quality_lm.judge(docs(spark, []), labels).count() == 0
