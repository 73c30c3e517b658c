"""Visible lines of HTML pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = r"(?is)<(?:script|style|head)\b.*?</(?:script|style|head)\s*>|<!--.*?-->"
BLOCK = (r"(?i)</?(?:p|div|br|li|ul|ol|nav|h[1-6]|article|section|header|footer|main|aside|table|tr|td|th|body|html|"
         r"title|blockquote|pre)\b[^>]*>")
TAG = r"<[^>]*>"
SPACE = " \t\r\x0b\x0c"
DECLARED = r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([a-z]{2,3})"""


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, head and comments; block elements end a line (null: empty)."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    return F.regexp_replace(F.regexp_replace(t, BLOCK, "\n"), TAG, "")


def visible_lines(html: Column) -> Column:
    """Trimmed lines that are not empty."""
    lines = F.transform(F.split(visible_text(html), "\n"), lambda x: F.btrim(x, F.lit(SPACE)))
    return F.filter(lines, lambda x: x != "")


def declared_language(html: Column) -> Column:
    """Primary subtag of ``<html lang=...>`` in lower case, or an empty string."""
    return F.lower(F.coalesce(F.regexp_extract(html, DECLARED, 1), F.lit("")))
