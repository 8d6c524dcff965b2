"""Line dedup: drop lines that a large share of a site's pages contain.

For every host: pages that contain a line, divided by the pages of the host. Lines above a
ratio are boilerplate and are dropped wherever they stand in that host's pages. Lines are
compared without white space around them; blank lines stay.

Only built-in functions run. Lines travel as 64-bit hashes, one for each page and distinct
line, and are counted before the shuffle, so a host with a third of all pages sends no more
than others. Lines on too few pages for any host go before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, free_name, words_of, written
from .components import connected_components

RATIO = 0.02
MIN_PAGES = 5
#: Boilerplate hashes up to this number (8 bytes each) are sent to all executors; more are joined.
BROADCAST_LINES = 250_000
#: Near copies are compared by n-grams of so many words; up to so many pivots go to all executors.
GRAM_WORDS, BROADCAST_PIVOTS = 5, 5_000


def bare(line: Column) -> Column:
    """A line without white space around it."""
    return F.trim(line, F.lit(WHITESPACE)) if hasattr(F, "trim") else line


def page_lines(html: Column) -> Column:
    """The text of a page with a line for every piece between tags; scripts and styles go."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)[^>]*>.*?</(script|style)>", "\n")
    return F.regexp_replace(text, "<[^>]*>", "\n")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null without one."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1)
    return F.when(host != "", host)


def line_key(line: Column) -> Column:
    return F.xxhash64(bare(line))


def _page_lines(text: Column) -> Column:
    """Hashes of the distinct lines of a page, sorted."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: bare(x) != "")
    return F.sort_array(F.array_distinct(F.transform(lines, line_key)))


def _common_lines(pages: DataFrame, ratio: float, min_pages: int, small_hosts: bool) -> DataFrame:
    """``(host, lines)`` of boilerplate from the ``(host, lines)`` of pages."""
    least = min(2, min_pages) if small_hosts else min_pages
    counted = pages.select(
        "host",
        # Null is the page itself, which gives the host's total.
        F.explode(F.concat(F.array(F.lit(None).cast("long")), F.col("lines"))).alias("line"),
    ).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("line").isNull() | (F.col("n") >= least))
    counted = written(counted, "lines")
    totals = counted.where(F.col("line").isNull()).select(F.col("host").alias("of"), F.col("n").alias("total"))
    floor = F.least(F.lit(min_pages), F.floor(F.col("total") / 2) + 1) if small_hosts else F.lit(min_pages)
    return (
        counted.where(F.col("line").isNotNull())
        .join(totals, F.col("host").eqNullSafe(F.col("of")))
        .where((F.col("n") > F.lit(ratio) * F.col("total")) & (F.col("n") >= floor))
        .groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    )


def boilerplate_lines(
    pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES,
    copies_once: bool = False, small_hosts: bool = False,
) -> DataFrame:
    """``(host, lines)``: for each host the sorted hashes of its boilerplate lines.

    A host has less than (mean lines of its pages / ratio) of them, whatever its size. With
    ``copies_once`` pages of the same lines count once, in lines and totals alike, and so do
    near copies: pages with boilerplate whose word 5-grams have a Jaccard measure of 4/5.
    With ``small_hosts`` a host too small for ``min_pages`` to be at most half of its pages has
    lines on more than half of them, and on two at least, as boilerplate.
    """
    texts = pages.select(F.col(host).alias("host"), F.col(text).alias("text"), _page_lines(F.col(text)).alias("lines"))
    if not copies_once:
        return written(_common_lines(texts, ratio, min_pages, small_hosts), "boilerplate")
    pages = texts.select("host", "lines").distinct()
    seen = found = written(_common_lines(pages, ratio, min_pages, small_hosts), "boilerplate")
    # Totals shrink with copies, so lines of more copies may come above the ratio.
    while not found.isEmpty():
        copies = _near_copies(texts, seen).select(F.col("host").alias("of"), F.col("lines").alias("same"))
        counted = pages.join(
            copies, F.col("host").eqNullSafe(F.col("of")) & (F.col("lines") == F.col("same")), "left_anti")
        found = written(_common_lines(counted, ratio, min_pages, small_hosts), "boilerplate")
        both = written(found.union(seen).select("host", F.explode("lines").alias("line")).groupBy("host").agg(
            F.sort_array(F.collect_set("line")).alias("lines")), "boilerplate")
        sizes = [df.agg(F.sum(F.size("lines"))).first()[0] for df in (seen, both)]
        if sizes[0] == sizes[1]:
            break
        seen = both
    return found


def _grams(df: DataFrame) -> DataFrame:
    """Add ``grams``: hashes of the distinct word 5-grams of ``text``; a shorter text is one."""
    df = df.withColumn("words", words_of(F.lower("text")))
    size = F.size("words")
    many = F.transform(F.sequence(F.lit(0), size - GRAM_WORDS), lambda i: F.xxhash64(
        *(F.get(F.col("words"), i + k) for k in range(GRAM_WORDS))))
    return df.withColumn("grams", F.array_distinct(
        F.when(size >= GRAM_WORDS, many).otherwise(F.array(F.xxhash64("words"))))).drop("words")


def _near_copies(texts: DataFrame, seen: DataFrame) -> DataFrame:
    """``(host, lines)`` of pages that hold lines of ``seen`` and copy another page: all of a class but one.

    Each line has two pivots among its pages. Pages are compared with the pivots of their
    lines, and classes are the connected components, so no pairs of a group are formed.
    """
    gone = seen.select(F.col("host").alias("of"), F.col("lines").alias("gone"))
    suspects = texts.join(gone, F.col("host").eqNullSafe(F.col("of"))).where(F.arrays_overlap("lines", "gone"))
    suspects = suspects.groupBy("host", "lines", "gone").agg(F.min("text").alias("text")).select(
        "host", "lines", "text", F.monotonically_increasing_id().alias("page"),
        F.transform(F.array_intersect("lines", "gone"), lambda x: F.xxhash64("host", x)).alias("common"))
    suspects = written(suspects, "suspects")
    lines = suspects.select("page", F.explode("common").alias("line"))
    pivots = lines.groupBy("line").agg(F.array(F.min("page"), F.max("page")).alias("pivots")).select(
        "line", F.explode("pivots").alias("pivot"))
    pivots = written(pivots, "pivots")
    met = lines.join(pivots, "line").where("page <> pivot").groupBy("page").agg(F.collect_set("pivot").alias("pivots"))
    named = pivots.select("pivot").distinct()
    side = _grams(suspects.join(named, F.col("page") == F.col("pivot")).select("pivot", "text")).select(
        "pivot", F.col("grams").alias("others"))
    side = F.broadcast(side) if named.count() <= BROADCAST_PIVOTS else side
    compared = _grams(suspects.select("page", "text").join(met, "page")).select(
        "page", "grams", F.explode("pivots").alias("pivot")).join(side, "pivot")
    links = compared.where(
        9 * F.size(F.array_intersect("grams", "others")) >= 4 * (F.size("grams") + F.size("others"))
    ).select(F.col("page").alias("x"), F.col("pivot").alias("y"))
    others = connected_components(links).where("node <> component").select(F.col("node").alias("page"))
    return suspects.join(others, "page", "left_semi").select("host", "lines")


def drop_boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES,
    dropped: str | None = None, copies_once: bool = False, small_hosts: bool = False,
) -> DataFrame:
    """All rows and columns of ``pages``, with boilerplate lines gone from ``text``.

    A null text stays null; a page of boilerplate only becomes empty; pages without a host
    are one site. Equal rows count as pages of their own, or once with near copies if
    ``copies_once`` is set: a group of copies alone then loses no line. With ``small_hosts`` hosts
    of few pages lose the lines on more than half of them. ``dropped`` names a column for the
    number of lines that went.
    """
    found = boilerplate_lines(pages, host, text, ratio, min_pages, copies_once, small_hosts)
    size = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    site, gone = free_name(pages, "site"), free_name(pages, "gone")
    found = found.select(F.col("host").alias(site), F.col("lines").alias(gone))
    side = F.broadcast(found) if size <= BROADCAST_LINES else found
    joined = pages.join(side, F.col(f"`{host}`").eqNullSafe(F.col(site)), "left")
    lines = F.split(F.col(f"`{text}`"), "\n")
    kept = F.filter(lines, lambda x: (bare(x) == "") | ~F.array_contains(F.col(gone), line_key(x)))
    clean = F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    columns = [clean.alias(text) if c == text else F.col(f"`{c}`") for c in pages.columns]
    if dropped:
        columns.append((
            F.when(F.col(gone).isNull() | F.col(f"`{text}`").isNull(), 0)
            .otherwise(F.size(lines) - F.size(kept)).cast("long").alias(dropped)
        ))
    return joined.select(*columns)
