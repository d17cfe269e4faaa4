"""Line deduplication by site-relative frequency.

A page's lines are its visible text between block elements.  For each host the
pages that contain a line are divided by the host's pages; a line that two
pages have or more is dropped from all pages of a host where that ratio
exceeds ``BOILERPLATE``, however many pages the host has.  Ratios of a
host's lines sum to its mean number of lines per page, so a host has at most
that mean over ``BOILERPLATE`` boilerplate lines: the list kept for a host is
bounded by its pages' length, never by their number.

Defined results: null html has no lines; a page without a host (null or
relative url) belongs to the host ''; a line of a single page is not
boilerplate, so a host's only page keeps all lines; a line repeated within a page counts once and is dropped
or kept at every place; repeated rows are pages of their own; a script, style
or comment that nothing ends takes the rest of the page, and a tag that none
ends is text, so markup is read in one pass however long the page; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

BOILERPLATE, LEAST_PAGES = 0.3, 2
#: What ends a line, and what vanishes within one (in this order).
BLOCK = r"(?is)<script\b(?:.*?</script\s*>|.*)|<style\b(?:.*?</style\s*>|.*)|<!--(?:.*?-->|.*)|</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>"
INLINE = r"<[^<>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def lines(html: Column) -> Column:
    """Visible lines in order, trimmed of blanks, none empty."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), BLOCK, "\n"), INLINE, "")
    cut = F.transform(F.split(text, "[\n\r]"), lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(" "))))
    return F.filter(cut, lambda x: x != "")


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def boilerplate(pages: DataFrame, ratio: float = BOILERPLATE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, line, pages, ratio) over the limit, from pages of (host, lines)."""
    totals = pages.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("_pages")).where(F.col("_pages") >= least_pages)
    seen = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    found = seen.where("pages > 1").join(totals, F.col("host") == F.col("_host")).withColumn("ratio", F.col("pages") / F.col("_pages"))
    return found.where(F.col("ratio") > ratio).select("host", "line", "pages", "ratio")


def dedup_lines(pages: DataFrame, ratio: float = BOILERPLATE, least_pages: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, n_lines, n_dropped and text, the lines that stay."""
    cut = materialize(pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), lines(F.col(html_col)).alias("lines")), "page-lines")
    found = boilerplate(cut, ratio, least_pages)
    by_host = materialize(found.groupBy(F.col("host").alias("_host")).agg(F.collect_list("line").alias("_drop")), "boilerplate")
    joined = cut.join(by_host, F.col("host") == F.col("_host"), "left")
    stay = F.when(F.col("_drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("_drop", x)))
    joined = joined.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), stay.alias("stay"))
    return joined.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("stay")).alias("n_dropped"), F.array_join("stay", "\n").alias("text"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = rf"""
WITH p AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
         string_split(replace(regexp_replace(regexp_replace(coalesce(html, ''), '{BLOCK}', chr(10), 'g'), '{INLINE}', '', 'g'), chr(13), chr(10)), chr(10)) AS raw
  FROM pages
), c AS (
  SELECT page_id, host, list_filter(list_transform(raw, lambda x: trim(replace(x, chr(9), ' '))), lambda x: x <> '') AS lines FROM p
), t AS (
  SELECT host, count(*) AS n FROM c GROUP BY host
), l AS (
  SELECT page_id, host, unnest(list_distinct(lines)) AS line FROM c
), b AS (
  SELECT l.host AS host, line FROM l JOIN t ON t.host = l.host WHERE n >= {LEAST_PAGES}
  GROUP BY l.host, line, n HAVING count(*) > 1 AND count(*) / n > {BOILERPLATE}
), d AS (
  SELECT host, list(line) AS gone FROM b GROUP BY host
), s AS (
  SELECT page_id, c.host AS host, lines, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, x)) END AS stay
  FROM c LEFT JOIN d ON d.host = c.host
)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(stay) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(stay, chr(10)), '') AS text
FROM s
"""
