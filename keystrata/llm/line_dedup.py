"""Site-relative line frequency, in DataFrame functions only: lines on too large a share of a host's pages go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .url_filter import host_and_path

#: A line on more than this share of its host's pages is boilerplate ...
RATIO = 0.3
#: ... if it stands on at least so many pages.
LEAST_PAGES = 3
#: Each host's boilerplate lines are repeated for so many salts, which its pages are dealt over.
SALTS = 64


#: What a reader of the page does not see, and tags at which a line ends.
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BLOCK_TAGS = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|nav|article|section|header|footer|title|body|head|html)\b[^>]*>"


def html_lines(html: Column) -> Column:
    """Text lines of a page: scripts, styles and comments go, block tags and line feeds cut, other tags vanish."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(text, BLOCK_TAGS, "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: x != "")


def line_frequencies(lines: DataFrame) -> DataFrame:
    """``host``, ``line``, ``pages`` (that hold it), ``host_pages`` from ``host`` and ``lines`` (an array for each page).

    A page counts once for a line it repeats. Both counts are partial aggregates, so a hot host or line is combined
    before it is shuffled. Lines stand for themselves in the shuffle as 128-bit digests.
    """
    totals = lines.groupBy("host").agg(F.count("*").alias("host_pages"))
    each = lines.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.crc32(x).alias("b"), F.length(x).alias("n"))))).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    return counts.join(totals, "host")


def site_line_dedup(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO) -> DataFrame:
    """One row for each row of ``pages``: ``id``, ``host``, ``n_lines``, ``n_dropped``, ``kept_text``.

    Pages whose url is null or has no ``://`` share the empty host. A null or empty page has no lines and an empty
    text. Repeated rows and ids count as pages of their own, row by row. A host's boilerplate lines are at most
    1 / ``ratio`` times its mean number of lines, so a row of them is small; pages are dealt over ``SALTS`` parts of their host.
    """
    host, _ = host_and_path(F.col(url_col))
    lines = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), html_lines(F.col(html_col)).alias("lines"))
    often = line_frequencies(lines.select("host", "lines")).where(F.col("pages") > ratio * F.col("host_pages"))
    listed = often.groupBy("host").agg(F.collect_list("line").alias("boilerplate"))
    salted = listed.select("host", "boilerplate", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    met = dealt.join(salted, ["host", "salt"], "left")
    mark = lambda x: F.struct(F.xxhash64(x).alias("a"), F.crc32(x).alias("b"), F.length(x).alias("n"))
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("boilerplate", mark(x))))
    met = met.select("id", "host", F.size("lines").cast("long").alias("n_lines"), F.explode(F.array(kept)).alias("kept"))
    return met.select("id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
