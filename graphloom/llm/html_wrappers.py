"""Main text of web pages by wrappers that are inferred for each host (operator 12).

1. Each page becomes a stream of tokens: block elements with the words of class and id, and texts. Markup that isn't closed is closed as
   browsers do; comments, scripts and styles are no tokens.
2. A task aligns the streams of its pages with a wrapper for each host, a union-free regular expression: where streams differ, elements
   become optional or repeated groups, and texts slots. Wrappers add up in any order, so those of all tasks meet in two steps
   (a host is dealt out in the first), and no task holds a host's pages.
3. A wrapper tells where its host keeps the main text: in the article, else in main, else in the innermost container with most
   characters that differ from page to page and stand outside of links and of parts named as menus, adverts and the like; there, texts
   that are the same on all pages belong to the template.
4. Each page is read once more with the regions of its host. A page without the first region is read from the next one.

Within a region everything is kept in page order but elements that are menus, footers, sidebars, notices, adverts, forms, headers (their
headings stay) or reader comments by element or by a word of class, id or role. References are decoded, white space (with line breaks) in
a block is one space, and blocks are joined by two \\n.

Null or empty html gives an empty text. Pages with a null url, or one without a host, are taken as pages of one host. Repeated rows are
pages of their own; other columns are ignored; an empty table gives an empty result. A wrapper grows with the different class and id
words of its host, those with digits left out, not with its pages.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, materialise, table
from .html_text import Page, Wrapper, main_text

#: Wrappers of a host meet in so many groups first.
DEALT = 64
#: Paths that a task holds before it gives its wrappers away.
HELD = 200_000
#: Bytes of regions that are broadcast.
SHARED = 32 << 20
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _row(host: str, w: Wrapper) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"host": pa.array([host], pa.string()), "wrapper": pa.array([json.dumps(w.plain(), ensure_ascii=False)], pa.string())})


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Wrapper] = {}
    size = 0
    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
            w = held.setdefault(host, Wrapper())
            size -= len(w.elements)
            w.align(Page(html.as_py()))
            size += len(w.elements)
            if size > HELD:
                yield from (_row(*x) for x in held.items())
                held, size = {}, 0
    yield from (_row(*x) for x in held.items())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up wrappers that come sorted by host."""
    host, total = None, None
    for batch in batches:
        for name, text in zip(batch.column("host").to_pylist(), batch.column("wrapper")):
            if name != host:
                if total is not None:
                    yield _row(host, total)
                host, total = name, Wrapper()
            total.add(Wrapper.of(json.loads(text.as_py())))
    if total is not None:
        yield _row(host, total)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [Wrapper.of(json.loads(t)) for t in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "host": batch.column("host"), "n": pa.array([w.pages for w in own], pa.int64()), "expression": pa.array([w.expression() for w in own], pa.string()),
            "regions": pa.array([json.dumps(w.regions(), ensure_ascii=False) for w in own], pa.string()),
        })


def with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> host, n (pages with html), expression, regions, a row for each host, written as a table."""
    own = with_host(pages).filter("html is not null").select("host", "html").mapInArrow(_align, "host string, wrapper string")
    dealt = own.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(DEALT)))
    some = dealt.repartition("host", "salt").sortWithinPartitions("host", "salt").select("host", "wrapper").mapInArrow(_merge, "host string, wrapper string")
    whole = some.repartition("host").sortWithinPartitions("host").mapInArrow(_merge, "host string, wrapper string")
    return materialise(whole.mapInArrow(_describe, "host string, n long, expression string, regions string"), "wrappers")


@lru_cache(4096)
def _regions(text: str) -> dict:
    return json.loads(text)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, regions in zip(batch.column("html"), batch.column("regions").to_pylist()):
            html = html.as_py()
            texts.append(main_text(Page(html), _regions(regions)) if html and regions else "")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars, with the wrappers of infer_wrappers()."""
    wrappers = infer_wrappers(pages) if wrappers is None else wrappers
    known = wrappers.select("host", "n", "regions")
    pages = with_host(pages)
    live = pages.filter("html is not null")
    totals = known.agg(F.sum("n").alias("n"), F.sum(F.octet_length("host") + F.octet_length("regions")).alias("bytes")).first()
    # regions are broadcast while all of them are small, else those of hosts with very many pages only
    joined = live.join(F.broadcast(known), "host") if (totals["bytes"] or 0) <= SHARED else join_by_key(live, known, "host", totals["n"])
    columns = ["page_id", "url", "html", "regions"]
    given = joined.select(*columns).unionByName(pages.filter("html is null").withColumn("regions", F.lit(None).cast("string")).select(*columns))
    kind = dict(pages.dtypes)
    return given.mapInArrow(_extract, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op12_host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
