"""Line dedup by site-relative frequency.

Pages are grouped by the host of their url. For each line the pages of the
host that hold it are divided by all pages of the host; lines above
``max_ratio`` are boilerplate of that host and are dropped from its pages.
Hosts with fewer than ``min_pages`` pages are left alone, since a ratio says
nothing there.

A host has at most (mean distinct lines of its pages) / ``max_ratio``
boilerplate lines, so the list of them that travels back to its pages is
bounded by the pages' length whatever the host's size. Pages and lines of a
host with many pages are dealt over salts to meet it. Lines are counted as
16-byte digests with partial sums before the shuffle, so a host or line with
a third of all rows arrives as one row a task.

Defined results: a null or empty page has no lines; pages without a host
share the host ''; a line that a page repeats counts once for that page, and
all its copies are dropped together; repeated rows are pages of their own; a
ratio equal to ``max_ratio`` is kept; an empty table gives an empty result;
other columns are kept, those named host_pages, n_lines, n_dropped or text
replaced; very long lines are compared by digest, very long pages line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import LOWER, UPPER, free_name, staged, table, without
from loanlens.llm.joins import counted_join
from loanlens.llm.pages import BLOCK, HIDDEN, TAG, visible_lines
from loanlens.llm.registry import register
from loanlens.llm.url_filter import host_of

MAX_RATIO = 0.2
MIN_PAGES = 5


def _key(c):
    return F.unhex(F.md5(c))


def boilerplate(lines: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, host_pages, drop): per host the digests of its boilerplate lines."""
    hosts = staged(lines.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")), "hosts")
    counts = (lines.select("host", F.explode(F.array_distinct("lines")).alias("line"))
              .groupBy("host", _key(F.col("line")).alias("key")).agg(F.count(F.lit(1)).alias("n")))
    frequent = (counted_join(counts.filter(F.col("n") > 1), hosts.withColumn("pages", F.col("host_pages")), ["host"], "pages")
                .filter((F.col("host_pages") >= min_pages) & (F.col("n") > F.lit(max_ratio) * F.col("host_pages"))))
    drops = frequent.groupBy("host").agg(F.collect_list("key").alias("drop"))
    return hosts.join(drops, "host", "left")


def dedup_lines(lines: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``lines`` (host, lines, ...) with host_pages, n_lines, n_dropped and the kept text."""
    rest = without(lines, "host_pages", "n_lines", "n_dropped", "text")
    drop, left = free_name(rest, "drop"), free_name(rest, "_kept")
    weight = free_name(rest, "n")
    bad = staged(boilerplate(lines, max_ratio, min_pages).select("host", "host_pages", F.col("drop").alias(drop),
                                                                F.col("host_pages").alias(weight)), "boilerplate")
    kept = F.when(F.col(drop).isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col(drop), _key(x))))
    return (counted_join(rest, bad, ["host"], weight).withColumn(left, kept)
            .withColumn("n_lines", F.size("lines").cast("long"))
            .withColumn("n_dropped", (F.size("lines") - F.size(left)).cast("long"))
            .withColumn("text", F.array_join(left, "\n")).drop(left, drop, "lines"))


_ORACLE = f"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', chr(10), 'g'),
        '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)),
      lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS lines
  FROM pages),
h AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY ALL),
d AS (SELECT host, list(line) AS bad FROM c JOIN h USING (host)
      WHERE n > 1 AND host_pages >= {MIN_PAGES} AND n > {MAX_RATIO} * host_pages GROUP BY host),
k AS (SELECT page_id, host, host_pages, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept
      FROM p JOIN h USING (host) LEFT JOIN d USING (host))
SELECT page_id, host, host_pages, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS text
FROM k"""


@register("op8_line_dedup", _ORACLE)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's lines without the boilerplate of its host."""
    pages = table(spark, sf_dir, "pages")
    lines = staged(pages.select("page_id", host_of(F.col("url")).alias("host"), visible_lines(F.col("html")).alias("lines")),
                   "page-lines")
    return dedup_lines(lines).select("page_id", "host", "host_pages", "n_lines", "n_dropped", "text")
