"""Operator 10: removal of lines that recur over the pages of one site.

Per host, the number of pages that hold a line is divided by the host's number of pages;
lines above a boilerplate ratio are dropped from all pages of that host.

Only line fingerprints (two 64-bit hashes) are shuffled for counting, combined before the
shuffle, so neither a hot host nor a hot line gathers in one task. The few lines above the
ratio come back to their pages as positions, and each page is rebuilt in place.

Cases: a line counts once per page however often it stands there, but all its places are
dropped; lines end at "\\n" and compare exactly; blank lines (empty, or white space only)
are layout and stay; a NULL text has no lines and stays NULL; NULL hosts form one site;
a page that loses all lines keeps an empty text; a line on fewer than ``min_pages`` pages
is no boilerplate, whatever its ratio on a tiny site; repeated rows are separate pages; an
empty table gives no rows; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strata.session import materialize

PERCENT, MIN_PAGES = 10, 5


def _prints(text: Column) -> Column:
    """Per line a struct (p position, a, b fingerprints), without blank lines."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(
        i.alias("p"), F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(7)).alias("b"),
        line.rlike(r"[^\x20\x09-\x0D]").alias("full")))
    return F.filter(lines, lambda x: x["full"])


def drop_site_lines(pages: DataFrame, host: str, text_col: str = "text", percent: int = PERCENT,
                    min_pages: int = MIN_PAGES) -> DataFrame:
    """Three columns: ``page`` (a struct of the input's columns, the text cleaned), n_lines and
    n_dropped (lines of the page, and how many of them went). A line goes when it stands on at
    least ``min_pages`` pages of its host and on more than ``percent`` in 100 of them."""
    key = F.coalesce(F.concat(F.lit("h"), F.col(f"`{host}`").cast("string")), F.lit("n"))
    text = F.col(f"`{text_col}`")
    # Pages that agree in host and text lose the same lines, so text fingerprints name a page;
    # they stay the same when a task runs again.
    print_of = [key.alias("host"), F.xxhash64(text).alias("d1"), F.xxhash64(text, F.lit(3)).alias("d2")]
    shape = pages.select(*print_of, _prints(text).alias("lines"))
    # sorted, a line's copies stand together; the outer lambda names the array, made once
    prints = F.sort_array(F.transform("lines", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    one = F.transform(F.array(prints), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))[0]
    counts = (shape.select("host", F.explode(one).alias("k")).groupBy("host", "k.a", "k.b")
              .agg(F.count("*").alias("c")).filter(F.col("c") >= min_pages))
    total = pages.groupBy(key.alias("host")).agg(F.count("*").alias("n"))
    common = materialize(counts.join(total, "host").filter(100 * F.col("c") > percent * F.col("n"))
                         .select("host", "a", "b"))
    places = (shape.select("host", "d1", "d2", F.explode("lines").alias("x"))
              .select("host", "d1", "d2", "x.a", "x.b", F.col("x.p").alias("p"))
              .join(common, ["host", "a", "b"], "left_semi")
              .groupBy("host", "d1", "d2").agg(F.sort_array(F.collect_set("p")).alias("bad")))
    out = pages.select(F.struct("*").alias("page"), *print_of).join(places, ["host", "d1", "d2"], "left")
    text = F.col(f"page.`{text_col}`")
    lines = F.split(text, "\n", -1)
    # what stands between two positions that go, joined: each line is touched once
    def stay(all_lines):
        start = lambda k: F.when(k == 0, 0).otherwise(F.get("bad", k - 1) + 1)          # noqa: E731
        end = lambda k: F.coalesce(F.get("bad", k), F.size(all_lines))                  # noqa: E731
        parts = F.transform(F.sequence(F.lit(0), F.size("bad")), lambda k: F.slice(all_lines, start(k) + 1, end(k) - start(k)))
        return F.array_join(F.flatten(parts), "\n")

    clean = F.when(F.col("bad").isNull(), text).otherwise(F.transform(F.array(lines), stay)[0])
    page = F.struct(*[(clean if c == text_col else F.col(f"page.`{c}`")).alias(c) for c in pages.columns])
    size = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    return out.select(page.alias("page"), size.alias("n_lines"),
                      F.when(F.col("bad").isNull(), 0).otherwise(F.size("bad")).cast("long").alias("n_dropped"))
