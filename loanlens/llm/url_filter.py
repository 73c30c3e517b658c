"""URL filter: allow/block rules by host and path, then a weighted vocabulary.

The vocabulary is matched by one Aho-Corasick automaton per Python worker
(pyahocorasick), fed with whole Arrow batches. A term counts only between
characters that are not ASCII letters or digits. One strict term, or
``min_soft`` distinct soft terms, rejects the url.

Defined results: a null url, or one without ``://``, has an empty host and
path, matches no rule and is still searched for terms (null: none, so it is
allowed). An empty table gives an empty result. Repeated rows are judged
alike. Columns of the input other than the id and the url do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import LOWER, UPPER, ascii_lower, free_name, table
from loanlens.llm.registry import register

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
STRICT = ["casino", "porn", "xxx", "viagra", "escort", "warez"]
SOFT = ["adult", "bet", "bingo", "bonus", "cheap", "dating", "free", "jackpot", "loan", "pills", "poker", "sex",
        "slots", "win"]
MIN_SOFT = 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def term_hits(strict: list[str], soft: list[str]):
    """Pandas UDF: url -> (occurrences of strict terms, distinct soft terms)."""
    kinds = {t.lower(): True for t in strict} | {t.lower(): False for t in soft}
    lower = str.maketrans(UPPER, LOWER)
    word = frozenset(LOWER + "0123456789")

    @F.pandas_udf("n_strict long, n_soft long")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick
        a = ahocorasick.Automaton()
        for t, s in kinds.items():
            a.add_word(t, (len(t), s, t))
        a.make_automaton()

        def count(url):
            if url is None:
                return 0, 0
            s = url.translate(lower)
            n, found = 0, set()
            for end, (length, is_strict, term) in a.iter(s):
                start = end - length
                if (start >= 0 and s[start] in word) or (end + 1 < len(s) and s[end + 1] in word):
                    continue
                if is_strict:
                    n += 1
                else:
                    found.add(term)
            return n, len(found)

        for urls in batches:
            yield pd.DataFrame([count(u) for u in urls], columns=["n_strict", "n_soft"])
    return hits


def filter_urls(df: DataFrame, url_col: str = "url", rules=RULES, strict: list[str] = STRICT,
                soft: list[str] = SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """``df`` with host, path, rule, n_strict, n_soft and verdict.

    Input columns with one of these names are replaced.
    """
    url, hit, fit = F.col(url_col), free_name(df, "_hit"), free_name(df, "_rule")
    out = (df.withColumn(hit, term_hits(strict, soft)(url))
           .withColumn("host", host_of(url)).withColumn("path", path_of(url))
           .withColumn(fit, rule_of(F.col("host"), F.col("path"), rules)))
    method = F.when((F.col(hit)["n_strict"] > 0) | (F.col(hit)["n_soft"] >= min_soft), "block").otherwise("allow")
    return (out.withColumn("rule", F.col(fit)["rule"])
            .withColumn("n_strict", F.col(hit)["n_strict"]).withColumn("n_soft", F.col(hit)["n_soft"])
            .withColumn("verdict", F.coalesce(F.col(fit)["verdict"], method)).drop(hit, fit))


def _oracle() -> str:
    edge, end = "(^|[^a-z0-9])", "($|[^a-z0-9])"
    terms = lambda ts: "|".join(ts)
    soft = " + ".join(f"regexp_matches(low, '{edge}{t}{end}')::BIGINT" for t in SOFT)
    return f"""
WITH u AS (
  SELECT page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS low,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule,
  regexp_matches(low, '{edge}({terms(STRICT)}){end}') AS strict, {soft} AS n_soft FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN strict OR n_soft >= {MIN_SOFT} THEN 'block' ELSE 'allow' END AS verdict
FROM r"""


@register("op10_url_filter", _oracle())
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
