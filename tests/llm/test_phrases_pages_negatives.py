"""Collocations, page text and hard negatives against brute force, on small fixtures with nulls, ties, repeated rows and empty tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import collocations, hard_negatives, html_wrappers
from graphloom.llm.html_text import Page, Wrapper, main_text

DOCS = "doc_id long, text string, lang string, score string, phrase int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_phrases(rows, least, longest=3, best=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        live = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in live.items():
            cuts = [(10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            within = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(within(q) and 100 * b >= 50 * a for q, b in live.items()):
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:best], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    vocab = ["new", "York", "CITY", "état", "ÉTAT", "the", "of", "naïve", "x'y", "日本", "a.b", "e-mail"]
    rows = [("New York city, new york\tcity!New York", "en"), (None, "en"), ("", None), ("   ,, ;", "de"), ("word", "xx")] * 3
    for _ in range(120):
        t = "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ": "]) for _ in range(rng.randint(1, 60)))
        rows += [(t, rng.choice(["en", "de", None, "und"]))] * rng.randint(1, 2)
    return rows


def test_phrases(spark, prose, monkeypatch):
    d = spark.createDataFrame([(i % 50, t, lang, "clash", 1) for i, (t, lang) in enumerate(prose)], DOCS).repartition(5)
    want = brute_phrases(prose, 10)
    assert len(want) > 100
    got = lambda: sorted(tuple(r) for r in collocations.collocations(d).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got() == want
    # texts in many slices, and a sketch that is much too small: more reaches the second pass, with the same result
    monkeypatch.setattr(collocations, "SLICE", 100)
    monkeypatch.setattr(collocations, "FEWEST", 3)
    monkeypatch.setattr(collocations, "MOST", 3)
    assert got() == want


def test_phrases_of_other_lengths_and_best(spark, prose):
    d = spark.createDataFrame([(1, t, lang, "", 1) for t, lang in prose], DOCS)
    got = sorted(tuple(r) for r in collocations.collocations(d, least=4, longest=4, best=7).collect())
    assert got == brute_phrases(prose, 4, 4, 7)


def test_phrases_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", 1), (2, "a b", "en", "", 1)], DOCS)).count() == 0


def test_sketch_never_underestimates():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    rows = [np.zeros(64, np.uint8) for _ in range(collocations.ROWS)]
    total = np.zeros(500, int)
    for _ in range(5):
        count = rng.integers(1, 5, 500)
        total += count
        for row, at in zip(rows, collocations.cells(h, 6)):
            collocations.add(row, at, count, 12)
    for row, at in zip(rows, collocations.cells(h, 6)):
        assert (row[at] >= np.minimum(total, 12)).all() and row.max() <= 12


PAGES = "page_id long, url string, html string, text int, host string"
ODD = """<html><head><title>T &amp; U</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="wrap">
<div class="cookie-notice">We use</div><main><article><header><h1>Head &amp; <i>line</i></h1><p>by X</p></header><p>One<b>two</b> &lt;x&gt;<p>Three<br>four &nbsp; &#233;
<ul><li>a<li>b</ul><div class="share">s</div><aside>no</aside><!-- <p>hidden</p> --><script>"<p>"</script><blockquote>q < r</blockquote><p hidden>h</p>
<section class="comments"><article class="comment"><p>c</p></article></section><form>f</form></article></main><footer>f"""


def test_page_text():
    w = Wrapper()
    w.align(Page(ODD))
    assert main_text(Page(ODD), w.regions()) == "Head & line\n\nOnetwo <x>\n\nThree four é\n\na\n\nb\n\nq < r"
    for broken in ("", "no markup", "<p>cut <b", "<", "<p class='x>open</p>", "<!-- open", "</div></p>x", "<script>x", "<table><tr><td>1<td>2<tr><td>3", "<li>" * 5000):
        assert isinstance(main_text(Page(broken), {"levels": [[""]], "fixed": {}}), str)
    assert main_text(Page("<table><tr><td>1<td>2<tr><td>3"), {"levels": [[""]], "fixed": {}}) == "1\n\n2\n\n3"


def story(i):
    return f'<div class="top"><a href=x>Home</a></div><div class="box"><p>Story {i} is about {i * 7} things.</p>{"<p>More.</p>" * (i % 3)}<div>All rights</div></div><div class="r"><a>l{i} link text that is long</a></div>'


def test_wrappers_align_to_optional_and_repeated_groups():
    pages = [Page(story(i)) for i in range(6)]
    parts = [Wrapper(), Wrapper()]
    for i, p in enumerate(pages):
        parts[i % 2].align(p)
    a, b = Wrapper(), Wrapper()
    for x in parts:
        a.add(Wrapper.of(x.plain()))
    for p in reversed(pages):
        b.align(p)
    assert a.expression() == b.expression() and a.regions() == b.regions()
    assert a.expression() == "<div.top>“Home”</div><div.box>(<p>#</p>)+<div>“All rights”</div></div><div.r>#</div>"
    assert [main_text(p, a.regions()) for p in pages[:2]] == ["Story 0 is about 0 things.", "Story 1 is about 7 things.\n\nMore."]
    mixed = Wrapper()
    for t in ("<div><h2>1</h2><p>2</p><h2>3</h2></div>", "<div><p>4</p></div><ul><li>5</ul>"):
        mixed.align(Page(t))
    assert mixed.expression() == "<div>((<h2>#</h2>)?(<p>#</p>)?)+</div>(<ul><li>“5”</li></ul>)?"


def test_pages(spark, monkeypatch):
    rows = [(i, f"http://a.example.com:80/{i}", story(i), 0, "clash") for i in range(9)] + [(20, None, "<p>x</p>", 0, ""), (21, "not a url", None, 0, ""), (22, "HTTPS://u@B.example/x", ODD, 0, ""), (22, "https://b.example/", ODD, 0, ""), (None, "https://b.example/", "", 0, "")]
    d = spark.createDataFrame(rows, PAGES).repartition(4)
    want = sorted((i if i is not None else -1, "Story %d is about %d things." % (i, 7 * i) + "\n\nMore." * (i % 3)) for i, *_ in rows[:9])
    odd = "Head & line\n\nOnetwo <x>\n\nThree four é\n\na\n\nb\n\nq < r"
    want = sorted([*want, (20, "x"), (21, ""), (22, odd), (22, odd), (-1, "")])
    for held in (None, 1):
        if held:
            monkeypatch.setattr(html_wrappers, "HELD", held)
            monkeypatch.setattr(html_wrappers, "SHARED", 0)
        got = html_wrappers.extract(d).collect()
        assert sorted((-1 if r["page_id"] is None else r["page_id"], r["text"]) for r in got) == want
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_wrappers.extract(spark.createDataFrame([], PAGES)).count() == 0
    hosts = {r["host"]: r["n"] for r in html_wrappers.infer_wrappers(d).collect()}
    assert hosts == {"a.example.com": 9, "": 1, "b.example": 3}


VECTORS = "vec_id long, embedding array<float>, label int, score string"


def brute_negatives(rows):
    v = []
    for i, x, y, *_ in rows:
        if y is not None and x is not None and all(e is not None and np.isfinite(e) for e in x):
            v.append((i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [int(np.floor(256 * float(np.float32(e)))) for e in x]))
    big = 1 << 63
    out = []
    for a, (i, y, c) in enumerate(v):
        if i is None or i % 100:
            continue
        s = sorted((-sum(p * q for p, q in zip(c, d)), big if j is None else j, z) for b, (j, z, d) in enumerate(v) if b != a)
        for ps, p, _ in [t for t in s if t[2] == y][:5]:
            fits = [t for t in s if t[2] != y and 30 * -ps <= 100 * -t[0] <= 90 * -ps][:10]
            out += [(i, None if p == big else p, r, None if j == big else j, -ps, -ns) for r, (ns, j, _) in enumerate(fits, 1)]
    return Counter(out)


@pytest.mark.parametrize("block", [4096, 16])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(1).tolist(), int(rng.integers(0, 3)), "clash") for i in range(0, 600, 4)]
    rows += [(400, rows[3][1], 1, ""), (8, rows[5][1], 0, ""), (8, rows[5][1], 2, ""), (None, rows[25][1], 1, ""), (None, rows[25][1], 2, "")]
    rows += [(700, None, 1, ""), (800, [1.0] * 6, None, ""), (900, [float("nan")] * 6, 1, ""), (1000, [None, *[1.0] * 5], 1, ""), (1100, [0.0] * 6, 1, ""), (1200, [float("inf")] * 6, 1, ""), (1300, [1.0], 1, "")]
    d = spark.createDataFrame(rows, VECTORS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(d, F.col("id") % 100 == 0, label).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    want = brute_negatives([r for r in rows if r[1] is None or len(r[1]) == 6])
    assert Counter(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_anchors_of_hard_negatives_are_never_broadcast(spark, monkeypatch):
    """Copies of the anchors for all lanes are as many times larger than the table that they come from."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    rng, seen = np.random.default_rng(3), []
    d = spark.createDataFrame([(i, rng.normal(size=6).tolist(), i % 3, "") for i in range(0, 600, 4)], VECTORS)
    monkeypatch.setattr(hard_negatives, "materialise", lambda df, label, f=hard_negatives.materialise: seen.append((label, df)) or f(df, label))
    hard_negatives.mine(d, F.col("id") % 100 == 0, F.col("label")).count()
    plan = dict(seen)["negatives-positives"]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan and "Join" not in plan


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("id") == 0, F.col("label")).count() == 0


def test_exact_products_and_limits():
    rng = np.random.default_rng(0)
    for top in (1 << 10, 1 << 28):
        a, b = rng.integers(-top, top, (3, 5)), rng.integers(-top, top, (4, 5))
        assert hard_negatives.products(a, b).tolist() == [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a]
    with pytest.raises(OverflowError):
        hard_negatives.products(np.full((1, 5), 1 << 40), np.full((1, 5), 1 << 40))
    scores = np.sort(rng.integers(-50, 50, 200))[::-1]
    for positive in range(-40, 60):
        want = [s for s in scores if 30 * positive <= 100 * s <= 90 * positive][:10]
        assert scores[hard_negatives.between(scores, positive, 10, 30, 90)].tolist() == want
