"""Line-first quality rules.

Every line with a word is judged by three rules; lines that fail are
removed, and a document that loses more than ``max_lost`` of its words to
removed lines is rejected:

* punctuation: the line does not end like a sentence (``.``, ``!``, ``?``,
  ``…``, ``:``, ``;`` or a closing quote or bracket), or at least
  ``max_shouted`` of its words end in ``!!`` or ``??``;
* navigation: at most ``nav_words`` words one of which is a menu term, or
  at least ``max_separators`` of its words are separators (``|``, ``>`` ...);
* boilerplate: it holds a boilerplate phrase, or at least ``max_symbols`` of
  its words hold two or more characters of ``#*$%&|<>``.

Before that come base statistics of the whole text (words are
``[^\\x20\\x09-\\x0D]+``) and the base verdict: fewer than ``min_words``
words, or more than ``max_repeat`` of the words inside 8-word windows that
occur again in the text.

Defined results: a null or empty text has no words and is rejected by the
base rule, its kept text is empty; ``max_lost`` is a strict bound, so a tie
keeps the document; repeated rows are judged alike; an empty table gives an
empty result. Other columns are passed through; columns named like a result
are replaced.

Texts pass through Arrow batches; a document is worked on as arrays of its
own words, so memory is bounded by the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import free_name, table
from loanlens.llm.registry import register

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT = 0.30
MAX_LOST = 0.50
MAX_SHOUTED = 0.30
MAX_SYMBOLS = 0.20
MAX_SEPARATORS = 0.20
NAV_WORDS = 8
SYMBOLS = "#*$%&|<>"
ENDS = ".!?…:;\"'”’»)]"
SEPARATORS = ["|", ">", "<", "»", "«", "›", "·", "•", "/", "-", "+"]
NAV_TERMS = ["home", "menu", "login", "logout", "sitemap", "sign in", "sign up", "log in", "next page", "previous page",
             "read more", "click here", "back to top", "skip to content", "contact us", "about us"]
BOILERPLATE = ["all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
               "javascript", "lorem ipsum", "subscribe to our newsletter", "this page uses cookies"]

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more.

    Windows are ranked exactly by doubling: the rank of a window of 2k words
    is the rank of its pair of k-word ranks. ``window`` is a power of two.
    """
    n = len(words)
    if n <= window:
        return 0
    ids: dict[str, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    step = 1
    while step < window:
        pair = rank[:-step] * n + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + window, -1)
    return int(np.count_nonzero(np.cumsum(mark[:n])))


def base_stats(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = _WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), dup, repeated_words(words)


def line_fault(line: str, words: list[str], nav: re.Pattern, boiler: re.Pattern) -> str | None:
    """Name of the first rule that a line with words fails."""
    n = len(words)
    if words[-1][-1] not in ENDS or sum(w.endswith(("!!", "??")) for w in words) >= MAX_SHOUTED * n:
        return "punctuation"
    if sum(w in SEPARATORS for w in words) >= MAX_SEPARATORS * n or (n <= NAV_WORDS and nav.search(line.lower())):
        return "navigation"
    if sum(len(_SYMBOL.findall(w)) >= 2 for w in words if not w.isalnum()) >= MAX_SYMBOLS * n or boiler.search(line.lower()):
        return "boilerplate"
    return None


def clean_lines(text: str | None, nav: re.Pattern, boiler: re.Pattern) -> tuple[str, int, int, int, int]:
    """(kept text, words lost, lines lost by punctuation, navigation, boilerplate)."""
    kept, lost, faults = [], 0, {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in (text or "").split("\n"):
        words = _WORD.findall(line)
        fault = line_fault(line, words, nav, boiler) if words else None
        if fault is None:
            kept.append(line)
        else:
            faults[fault] += 1
            lost += len(words)
    return "\n".join(kept), lost, *faults.values()


def _terms(terms: list[str]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(map(re.escape, terms)) + r")\b")


def judge(nav_terms: list[str] = NAV_TERMS, boilerplate: list[str] = BOILERPLATE, with_text: bool = True):
    """Pandas UDF of one text column with all statistics of a document."""
    schema = _BASE + ", lost_words long, n_punctuation long, n_navigation long, n_boilerplate long"
    schema += ", clean_text string" if with_text else ""
    names = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(schema)
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        nav, boiler = _terms(nav_terms), _terms(boilerplate)
        for texts in batches:
            rows = []
            for t in texts:
                kept, *counts = clean_lines(t, nav, boiler)
                rows.append((*base_stats(t), *counts, *([kept] if with_text else [])))
            yield pd.DataFrame(rows, columns=names)
    return stats


def clean_documents(df: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST, min_words: int = MIN_WORDS,
                    max_repeat: float = MAX_REPEAT, with_text: bool = True) -> DataFrame:
    """``df`` with the statistics, base_failed, kept and (``with_text``) the cleaned text."""
    q = free_name(df, "_q")
    out = df.withColumn(q, judge(with_text=with_text)(F.col(text_col)))
    names = [c.split()[0] for c in _BASE.split(", ")] + ["lost_words", "n_punctuation", "n_navigation", "n_boilerplate"]
    for c in names + (["clean_text"] if with_text else []):
        out = out.withColumn(c, F.col(q)[c])
    percent = lambda x: F.lit(round(100 * x))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > percent(max_repeat) * F.col("n_words"))
    out = out.withColumn("base_failed", base)
    return out.withColumn("kept", ~base & (100 * F.col("lost_words") <= percent(max_lost) * F.col("n_words"))).drop(q)


@register("op4_quality_lines")
def op4_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_documents(docs, with_text=False).drop("text")
