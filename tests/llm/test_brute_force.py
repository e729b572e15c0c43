"""Language ID and decontamination by their definitions, and rows that repeat, in operators where nothing else tests them."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, language_id, mips, quality_lm

DOCS = "doc_id long, text string, lang string, source string, score string, lang_pred int"
WORDS = {"en": "the of and that with from this which would there".split(), "de": "der und nicht auch über schön können straße für wird".split(), "el": "και το να στην από είναι ένα που".split()}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "clash", 1) for i, t, lang in rows], DOCS)


def brute_features(text):
    """The hashed grams of one to four characters from each character on that hold a letter."""
    code = lambda c: ord(c.lower()[0]) if c.isalpha() else 32
    x, out, m = [code(c) for c in text] + [32] * 4, [], (1 << 64) - 1
    for i in range(len(text) + 1):
        h = 0
        for order in range(1, 5):
            if i + order > len(x):
                break
            h = (h + x[i + order - 1]) * 0x9E3779B97F4A7C15 & m
            h ^= h >> 29
            if any(c != 32 for c in x[i : i + order]):
                out.append(((h + order) * 0x9E3779B97F4A7C15 & m) >> 48)
    return out


def test_language_id_by_its_definition(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(1, 15))) + rng.choice(["", "!", " 12", " ÄÖ"]), lang) for i, lang in enumerate(rng.choices(list(WORDS), [5, 3, 1], k=150))]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 ...", "en"), (None, "der und the", "de"), (7, "nicht auch", "de"), (7, "nicht auch", "de"), (1003, "of that", None)]
    import zlib

    learned = [(t, lang) for i, t, lang in rows if lang and t is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    n, sizes = {k: np.full(1 << 16, 0.05) for k in WORDS}, Counter(lang for _, lang in learned)
    for t, lang in learned:
        for f in brute_features(t):
            n[lang][f] += 1
    logp = {k: np.log(v / v.sum()) for k, v in n.items()}
    got = defaultdict(list)
    for r in language_id.identify(docs(spark, rows)).collect():
        got[r["doc_id"]].append((r["held_out"], r["lang_pred"], round(r["score"], 3)))
    for i, t, _ in rows:
        out = i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        if not any(c.isalpha() for c in t or ""):
            assert got[i] == [(out, "und", 0.0)]
            continue
        s = {k: np.log(sizes[k] / sum(sizes.values())) + sum(logp[k][f] for f in brute_features(t)) for k in WORDS}
        best = max(s, key=s.get)
        post = 1 / sum(np.exp(v - s[best]) for v in s.values())
        assert any(o == out and pred == best and abs(score - post) < 2e-3 for o, pred, score in got[i]), (i, t, got[i], best, post)
    assert sum(map(len, got.values())) == len(rows)


def cleaned(t):
    return [w for w in (w.strip(".,;:!?\"'()[]{}<>*&%$#|-_") for w in (t or "").lower().split()) if w]


def brute_score(item, passage):
    """The best Smith-Waterman score by the recurrence, cell by cell."""
    best, above = 0, [0] * (len(passage) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(passage, 1):
            row.append(max(0, above[j - 1] + (2 if a == b else -1), above[j] - 1, row[j - 1] - 1))
        best, above = max(best, *row), row
    return best


def test_decontamination_by_its_definition(spark):
    """All documents against all items: what is found are pairs at the threshold or above, with their scores, and all but those whose edits
    leave no seed, which are far from a copy."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 30)))) for i in range(12)] + [(50, None), (51, ""), (None, "no item id here at all")]
    rows = []
    for i, t in items[:12]:
        for edits in (0, 2, 4):
            w = t.split()
            for _ in range(edits):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [word()], [w[at], word()]])
            rows.append((100 * edits + i, " ".join([word() for _ in range(rng.randint(0, 40))] + ["(" + w[0].upper(), *w[1:-1], w[-1] + ")."] + [word() for _ in range(rng.randint(0, 40))]), "en"))
    rows += [(900 + i, " ".join(word() for _ in range(120)), "en") for i in range(6)]
    rows += [rows[0], rows[0], (None, rows[4][1], "en"), (None, rows[7][1], "en"), (5, rows[1][1], "en"), (951, None, "en"), (952, "", "en")]
    want, near = {}, set()
    for i, t, _ in rows:
        for k, item in items[:12]:
            score = brute_score(cleaned(item), cleaned(t)) if t else 0
            if score / (2 * len(cleaned(item))) >= decontaminate.THRESHOLD:
                want[i, k] = max(score, want.get((i, k), 0))
                near |= {(i, k)} if score / (2 * len(cleaned(item))) >= 0.75 else set()
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.contaminated(docs(spark, rows).repartition(3), bench).collect()
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in got}
    assert len(found) == len(got) and found.items() <= want.items() and near <= set(found) and len(near) > 20 and len(want) - len(found) <= 2
    kept = Counter((r["doc_id"], r["text"]) for r in decontaminate.decontaminate(docs(spark, rows), bench).collect())
    hit = {i for i, _ in found}
    texts = {t for i, t, _ in rows if i in hit and i is not None and i != 5}
    assert kept == Counter((i, t) for i, t, _ in rows if t not in texts and not (i == 5 and i in hit))


def test_search_with_repeated_ids_and_other_columns(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    ids = [i % 50 for i in range(60)]
    rows = [(i, v.tolist(), "clash", 1.0, 2) for i, v in zip(ids, x)]
    got = mips.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string, score double, rank int"), k=5).collect()
    for q in (0, 20, 40):
        own = [r for r in got if r["query_id"] == q]
        best = sorted((-float(x[a].astype(float) @ x[b].astype(float)), ids[b]) for a in range(60) if ids[a] == q for b in range(60) if ids[b] != q)
        # a repeated id asks once for each of its rows, and the best of all of them are returned
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and np.allclose([-s for s, _ in best[:5]], [r["score"] for r in own])


@pytest.mark.parametrize("copies", [1, 3])
def test_repeated_rows_have_one_perplexity(spark, copies):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS["en"], k=20)), "en") for i in range(30)]
    d = docs(spark, rows + [rows[0]] * copies).withColumn("perplexity", F.lit("clash"))
    got = Counter((r["doc_id"], r["kept"]) for r in quality_lm.judge(d, spark.createDataFrame([(i, 1, "x") for i in range(30)] * copies, "doc_id long, quality int, text string")).collect())
    assert sum(got.values()) == 30 + copies and max(n for (i, _), n in got.items() if i == 0) == 1 + copies
