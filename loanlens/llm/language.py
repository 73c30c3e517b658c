"""Language of pages by Bayesian evidence fusion.

Four kinds of evidence are added in log space for each language l:

* text: hashed byte trigrams of the visible text under one multinomial for
  each language, tempered to ``EFFECTIVE`` trigrams since neighbouring
  trigrams are not independent;
* declared markup language d: P(d | l), from sums of text posteriors over
  all pages, smoothed towards the overall share of d;
* address suffix s (last host label): P(s | l), made the same way;
* host: a prior smoothed in levels, host towards registered domain (last two
  labels) towards all pages, from sums of text posteriors by grouped
  aggregation. A page's own posterior is taken out of its host's sum.

The text model is fitted on about ``SAMPLE_DOCS`` labelled documents chosen
by a hash of their id; the sums behind the other evidence cover all pages.

Defined results: a page without text has no text evidence; without a
declaration or a host that evidence is left out; ties go to the language
whose code comes first; repeated rows are judged alike; an empty table gives
an empty result; without labelled documents the language is null. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import staged, table
from loanlens.llm.pages import declared_language, visible_text
from loanlens.llm.registry import register
from loanlens.llm.url_filter import host_of

DIMS = 1 << 14
SAMPLE_DOCS = 4000
EFFECTIVE = 60
SMOOTH_CHANNEL = 20.0
SMOOTH_DOMAIN = 20.0
SMOOTH_HOST = 10.0

#: Bytes that are not letters count as a space.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Counts of hashed byte trigrams of the lower-cased text."""
    b = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]]
    if len(b) < 3:
        return np.zeros(DIMS, np.int64)
    key = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return np.bincount(key >> np.uint32(32 - (DIMS - 1).bit_length()), minlength=DIMS)


def fit_text_model(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, trigram]) from (doc_id, text, lang)."""
    labelled = docs.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    n = labelled.count()
    if n > sample_docs:
        labelled = labelled.filter(F.pmod(F.xxhash64(F.lit("lang"), F.col("doc_id")), F.lit(1 << 30))
                                   < int(sample_docs / n * (1 << 30)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                c = sum((trigrams(t) for t in texts), np.zeros(DIMS, np.int64))
                at = np.flatnonzero(c)
                yield pd.DataFrame({"lang": lang, "gram": at, "n": c[at]})

    rows = labelled.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.full((len(langs), DIMS), 0.5)
    for r in rows:
        counts[langs.index(r["lang"]), r["gram"]] += r["n"]
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(langs: list[str], logp: np.ndarray, effective: int = EFFECTIVE):
    """Pandas UDF: text -> tempered log likelihood of each language, highest 0."""
    @F.pandas_udf("array<double>")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                c = trigrams(t)
                n = c.sum()
                at = np.flatnonzero(c)
                ll = logp[:, at] @ c[at] * min(1.0, effective / n) if n else np.zeros(len(langs))
                out.append((ll - ll.max()).astype(float))
            yield pd.Series(out)
    return evidence


def _sums(df: DataFrame, key: str, n: int, by: str = "p") -> DataFrame:
    return df.groupBy(key).agg(*[F.sum(F.col(by)[i]).alias(f"{key}_{i}") for i in range(n)])


def fuse(pages: DataFrame, langs: list[str]) -> DataFrame:
    """``pages`` (host, declared, ll, ...) with lang, confidence, text_lang, suffix."""
    n = range(len(langs))
    total = lambda cols: reduce(lambda a, b: a + b, cols)
    norm = F.aggregate("ll", F.lit(0.0), lambda a, x: a + F.exp(x))
    label = F.element_at(F.split("host", r"\."), -1)
    pages = staged(pages.withColumn("p", F.transform("ll", lambda x: F.exp(x) / norm))
                   .withColumn("suffix", label)
                   .withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)), "page-evidence")
    hosts = staged(pages.groupBy("host", "domain", "suffix").agg(*[F.sum(F.col("p")[i]).alias(f"host_{i}") for i in n]), "hosts")
    arr = hosts.select("host", "domain", "suffix", F.array(*[F.col(f"host_{i}") for i in n]).alias("p"))
    everything = arr.agg(*[F.sum(F.col("p")[i]).alias(f"all_{i}") for i in n])
    world = [F.coalesce(F.col(f"all_{i}"), F.lit(0.0)) + 1 for i in n]
    domains = _sums(arr, "domain", len(langs))
    share = lambda key, i: F.col(f"{key}_{i}")

    # host prior: what the host's sum is smoothed towards
    domains = domains.crossJoin(F.broadcast(everything)).select("domain", *[
        ((share("domain", i) + SMOOTH_DOMAIN * world[i] / total(world)) / (total([share("domain", j) for j in n]) + SMOOTH_DOMAIN))
        .alias(f"prior_{i}") for i in n])
    priors = hosts.drop("suffix").join(domains, "domain").drop("domain")

    def channel(df: DataFrame, key: str) -> DataFrame:
        """log P(key | l) for each value of ``key`` (one row a value); an empty value tells nothing."""
        c = _sums(df, key, len(langs)).crossJoin(F.broadcast(everything))
        overall = total([share(key, j) for j in n]) / total(world)
        return c.select(key, *[F.when(F.col(key) == "", F.lit(0.0)).otherwise(
            F.log((share(key, i) + SMOOTH_CHANNEL * overall) / (world[i] + SMOOTH_CHANNEL))).alias(f"{key}_{i}") for i in n])

    out = pages.join(priors, "host").join(channel(pages, "declared"), "declared").join(channel(arr, "suffix"), "suffix")
    own = [F.greatest(share("host", i) - F.col("p")[i], F.lit(0.0)) for i in n]
    score = [F.col("ll")[i] + share("declared", i) + share("suffix", i)
             + F.log((own[i] + SMOOTH_HOST * F.col(f"prior_{i}")) / (total(own) + SMOOTH_HOST)) for i in n]
    out = out.withColumn("_s", F.array(*score)).withColumn("_m", F.array_max("_s"))
    first = lambda a, m: F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(a, m).cast("int"))
    weight = F.aggregate(F.transform("_s", lambda x: F.exp(x - F.col("_m"))), F.lit(0.0), lambda a, x: a + x)
    return (out.withColumn("lang", first(F.col("_s"), F.col("_m"))).withColumn("confidence", 1 / weight)
            .withColumn("text_lang", first(F.col("p"), F.array_max("p"))))


def identify(pages: DataFrame, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(page_id, host, declared, suffix, text_lang, lang, confidence) of every page (page_id, url, html)."""
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), declared_language(F.col("html")).alias("declared"),
                        visible_text(F.col("html")).alias("_text"))
    langs, logp = fit_text_model(labelled, sample_docs)
    cols = ["page_id", "host", "declared", "suffix", "text_lang", "lang", "confidence"]
    if not langs:
        return base.select("page_id", "host", "declared", F.element_at(F.split("host", r"\."), -1).alias("suffix"),
                           F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"),
                           F.lit(None).cast("double").alias("confidence"))
    ev = base.withColumn("ll", text_evidence(langs, logp)("_text")).drop("_text")
    return fuse(ev, langs).select(cols)


@register("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page; the text model comes from the labelled documents."""
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
