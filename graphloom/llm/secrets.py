"""Secret scan with a randomness test battery (operator 2, DataFrame operations only).

Base spans come from three patterns. The method adds spans: runs of 20 or more characters of an encoding alphabet are judged by
how random they look. Each run's encoding is inferred (hex, base32, base64), and three tests take "characters drawn evenly and
independently from that alphabet" as their hypothesis: chi-squared uniformity of the alphabet (with the exact mean and
variance at the run's length), Wald-Wolfowitz runs below and above the middle of the alphabet, and lag-one serial correlation.
Fisher's method combines the three p-values: random runs have an even p-value, text and repetition have p-values near 0.

A discovery is a run that looks too random for text. What text looks like is learned from the corpus itself: every 2,000
characters begun give decoys, ordinary words (no run of 20 or more) written together in one of the encodings, as long as the
shortest run of a length class. Per stratum of encoding and length, the share of decoys of that length or less at or above a p-value
is the chance that text gets there, and the Benjamini-Hochberg rule over that chance gives the lowest cut at which at most FDR of what is flagged is
expected to be text; short runs, where the tests see little, so get a stricter cut than long ones. Strata without such a cut
flag nothing; a corpus without ordinary words flags nothing.

One pass over the texts writes what the patterns find, as places (running sums) with strata and p-values: no table ever holds a secret, and
spans are places, whose text is in the document. Runs, decoys and spans are rows from then on.
Counts per stratum and cut (24 strata at most) are all that reaches the driver. Spans are code points, end exclusive, of whole
matches. Null or empty text: no spans. Rows with a null doc_id and repeated rows are kept as they are; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, materialise, normal_tail, running_sums, table

ASSIGN = "((?i)password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs are maximal, so their least length may be part of the pattern; a short assignment still takes up its text.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
RUN = "[A-Za-z0-9+/_-]{20,}={0,2}"
FDR = 0.05
CUTS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: A decoy for each STRIDE characters begun, made of STRETCH characters.
STRIDE, STRETCH = 2000, 400
SPANS = "array<struct<start: int, kind: string, stop: int, value: string>>"
PLACES = "array<struct<start: int, rank: int, kind: string, stop: int>>"
LENGTHS = (24, 28, 32, 40, 48, 64, 96)
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}

def matches(text: Column, pattern: str, kind: str, keep) -> Column:
    """array of (kind, start, stop, value): leftmost non-overlapping matches that `keep` holds for. A place is the length of
    the text between matches, summed, as split and regexp_extract_all walk the text alike."""

    def spans(found: Column) -> Column:
        sizes = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1))), lambda v, g: F.coalesce(F.length(v), F.lit(0)) + F.length(g))
        placed = F.zip_with(found, running_sums(sizes), lambda v, stop: F.struct((stop - F.length(v)).alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), v.alias("value")))
        return F.when(F.size(found) > 0, F.filter(placed, lambda s: keep(s.value))).otherwise(F.expr(f"cast(array() as {SPANS})"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": matches(text, ASSIGN, "assign", lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 12),
        "access": matches(text, ACCESS, "access", lambda v: F.lit(True)),
        "hex": matches(text, HEX, "hex", lambda v: F.lit(True)),
    }


def run_spans(text: Column) -> Column:
    """The runs to be judged. Digits alone are no encoding of a secret."""
    return matches(text, RUN, "random", lambda v: ~v.rlike("^[0-9]*$"))


def encoding(v: Column) -> Column:
    return F.when(v.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex")).when(v.rlike("^[A-Z2-7]+=*$"), F.lit("base32")).otherwise(F.lit("base64"))


def stratum(v: Column) -> Column:
    """Encoding and length class."""
    n = F.length(F.rtrim(v, F.lit("=")))
    size = sum((F.when(n >= x, 1).otherwise(0) for x in LENGTHS), F.lit(0))
    return F.concat(encoding(v), F.lit("-"), size.cast("string"))


def randomness(v: Column) -> Column:
    """The combined p-value of a run under the hypothesis that it is random in the alphabet of its encoding."""
    plain = F.translate(F.rtrim(v, F.lit("=")), "-_", "+/")
    alphabet = F.when(encoding(v) == "hex", ALPHABETS["hex"]).when(encoding(v) == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
    read = F.struct(alphabet.alias("alphabet"), F.when(encoding(v) == "hex", F.lower(plain)).otherwise(plain).alias("v"))
    return let(read, lambda r: _battery(r.v, r.alphabet))


def _battery(v: Column, alphabet: Column) -> Column:
    k, n = F.length(alphabet).cast("double"), F.length(v).cast("double")
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(v, c, F.lit(""))), F.lit(2.0)))
    chi = let((squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n), normal_tail)

    # places in the alphabet; sums for the correlation, and the runs below and above the middle
    index = F.transform(chars, lambda c: F.instr(alphabet, c).cast("double"))
    names = ("first", "last", "total", "squares", "products", "below", "turns")

    def grow(acc: Column, x: Column) -> Column:
        half, before = (x <= k / 2).cast("double"), (acc["last"] <= k / 2).cast("double")
        values = (F.coalesce(acc["first"], x), x, acc.total + x, acc.squares + x * x, acc.products + F.coalesce(acc["last"] * x, F.lit(0.0)), acc.below + half, acc.turns + F.coalesce(F.abs(half - before), F.lit(0.0)))
        return F.struct(*(c.alias(m) for m, c in zip(names, values)))

    def tests(acc: Column) -> Column:
        mean = acc.total / n
        var = acc.squares - acc.total * mean
        lagged = acc.products - mean * (2 * acc.total - acc["first"] - acc["last"]) + (n - 1) * mean * mean
        serial = F.when(var > 0, F.abs(lagged / var + 1 / n) * F.sqrt(n))
        both = 2 * acc.below * (n - acc.below)
        spread = both * (both - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, F.abs(acc.turns - both / n) / F.sqrt(spread))
        return F.array(serial, runs)

    none = F.lit(None).cast("double")
    sums = F.struct(none.alias("first"), none.alias("last"), *(F.lit(0.0).alias(m) for m in names[2:]))
    # a test that can't be taken (one value, or one side of the middle, only) counts as failed
    p = F.transform(F.aggregate(index, sums, grow, tests), lambda z: F.coalesce(2 * normal_tail(z), F.lit(0.0)))
    fisher = F.aggregate(F.concat(p, F.array(chi)), F.lit(0.0), lambda acc, q: acc - F.log(F.greatest(q, F.lit(1e-9))))
    return let(fisher, lambda t: F.exp(-t) * (1 + t + t * t / 2))


def decoys(text: Column) -> Column:
    """Words of the text in the guise of runs: from a hashed place in each STRIDE characters begun, a string in base64 and one in
    another encoding, cut to a hashed length class (to the longest that the words there fill, if they are fewer)."""
    sizes = (20, *LENGTHS)

    def pair(part: Column, i: Column) -> Column:
        h = F.xxhash64(F.length(part), F.substring(part, 1, 64), i)
        place = F.pmod(h, F.greatest(F.length(part) - STRETCH, F.lit(1)))
        plain = F.regexp_replace(F.substr(part, (place + 1).cast("int"), F.lit(STRETCH)), RUN, " ")
        joint = F.element_at(F.array(*map(F.lit, ("", "_", "-", ""))), (F.pmod(F.shiftright(h, 16), F.lit(4)) + 1).cast("int"))
        drawn = F.element_at(F.array(*map(F.lit, sizes)), (F.pmod(F.shiftright(h, 24), F.lit(len(sizes))) + 1).cast("int"))

        def cut(words: Column) -> Column:
            fits = F.array_max(F.filter(F.array(*map(F.lit, sizes)), lambda n: (n <= drawn) & (n <= F.length(words))))
            return F.substr(words, F.lit(1), fits)

        letters = F.regexp_replace(plain, "[^A-Za-z]+", "")
        other = F.when(F.pmod(F.shiftright(h, 40), F.lit(2)) == 0, F.upper(letters)).otherwise(F.translate(F.lower(letters), "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef0123456789"))
        return F.array(let(F.regexp_replace(plain, "[^A-Za-z]+", joint), cut), let(other, cut))

    # parts are cut in one walk along the text: places counted from its start would cost its length for each part
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRIDE}}}"), F.lit(0))
    return F.filter(F.flatten(F.transform(parts, pair)), lambda v: v.isNotNull())


def found_in(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> row, doc_id, base (places of the base patterns), runs (places, stratum, p), decoys (stratum, p): written once,
    without texts or what was found in them."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    judge = lambda v: (stratum(v).alias("stratum"), randomness(v).alias("p"))
    place = lambda s, *more: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.stop.alias("stop"), *more)
    base = F.transform(F.concat(*base_spans(F.col("text")).values()), lambda s: place(s)).alias("base")
    runs = F.transform(run_spans(F.col("text")), lambda s: place(s, *judge(s.value))).alias("runs")
    return materialise(docs.select("row", "doc_id", base, runs, F.transform(decoys(F.col("text")), lambda v: F.struct(*judge(v))).alias("decoys")), "secret-found")


def judged(found: DataFrame) -> DataFrame:
    """(row, span, decoy, stratum, p) of all runs and decoys; span is the place of a run."""
    runs = found.select("row", F.explode("runs").alias("s")).select("row", F.struct("s.start", "s.kind", "s.stop").alias("span"), F.lit(False).alias("decoy"), "s.stratum", "s.p")
    words = found.select("row", F.explode("decoys").alias("s")).select("row", F.lit(None).cast(runs.schema["span"].dataType), F.lit(True), "s.stratum", "s.p")
    return runs.union(words)


def cuts(runs: DataFrame, fdr: float = FDR) -> dict[str, float]:
    """The lowest p-value that each stratum accepts. All runs and decoys are counted."""
    counts = [F.count(F.when((F.col("decoy") == decoy) & (F.col("p") >= c), 1)).alias(f"{name}{i}") for decoy, name in ((False, "run"), (True, "decoy")) for i, c in enumerate((0.0, *CUTS))]
    out, rows = {}, {r["stratum"]: r for r in runs.groupBy("stratum").agg(*counts).collect()}
    for name, row in rows.items():
        kind, _, size = name.partition("-")
        # shorter decoys look no less random than longer ones: with them the chance of text is not understated
        pool = [rows[x] for x in (f"{kind}-{k}" for k in range(int(size) + 1)) if x in rows]
        for i, c in enumerate(CUTS, 1):
            text = (1 + sum(r[f"decoy{i}"] for r in pool)) / (1 + sum(r["decoy0"] for r in pool))
            if row[f"run{i}"] and row["run0"] * text <= fdr * row[f"run{i}"]:
                out[row["stratum"]] = c
                break
    return out


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """docs(doc_id, text) -> doc_id, spans: array of (start, kind, stop) by start, base kinds first as listed. A random
    run that overlaps a base span adds nothing."""
    found = found_in(docs)
    runs = judged(found)
    accept = cuts(runs, fdr)
    table_of = F.create_map(*(F.lit(x) for kv in sorted(accept.items()) for x in kv)) if accept else F.expr("cast(map() as map<string, double>)")
    random = runs.filter(~F.col("decoy") & (F.col("p") >= table_of[F.col("stratum")])).select("row", "span.*")
    spans = found.select("row", F.explode("base").alias("span")).select("row", "span.*").union(random)
    kind = F.col("kind")
    spans = spans.withColumn("rank", F.when(kind == "assign", 0).when(kind == "access", 1).when(kind == "hex", 2).otherwise(3))
    # base spans that begin before a run, and those that begin behind it
    before = lambda *order: Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.max(F.when(F.col("rank") < 3, F.col("stop"))).over(before("start", "rank"))
    onward = F.min(F.when(F.col("rank") < 3, F.col("start"))).over(before(F.desc("start"), F.desc("rank")))
    spans = spans.withColumn("upto", upto).withColumn("onward", onward)
    spans = spans.filter((F.col("rank") < 3) | ~(F.coalesce(F.col("upto") > F.col("start"), F.lit(False)) | F.coalesce(F.col("onward") < F.col("stop"), F.lit(False))))
    own = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "stop"))).alias("spans"))
    kept = F.transform(F.coalesce("spans", F.expr(f"cast(array() as {PLACES})")), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.stop.alias("stop")))
    return found.select("row", "doc_id").join(own, "row", "left").select("doc_id", kept.alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    kinds = [count(k) for k in ("assign", "access", "hex")]
    base = F.filter("spans", lambda s: s.kind != "random")
    return scanned.select("doc_id", *kinds, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))
